"""Small worked cases and properties of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.functions import models
from podium.functions import scalars as S
from podium.operators import align, boxes, evaluate, images, ordered, speech, structure, summarise, text, vectors
from podium.plans.pipeline import Config, Pipeline, lecture_stages
from podium.sources import readers, sinks
from podium.streaming import windows


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# alignment

WORDS = [(0.5, "Hello"), (1.0, "there."), (2.0, "Next"), (0.0, "."), (3.0, "More"), (4.0, "text!"), (6.0, "End.")]


def aligned(spark, words, slides, first_slide=False):
    w = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(words)], "k int, pos int, start double, word string")
    s = spark.createDataFrame([(1, x) for x in slides], "k int, frame_number int")
    return [(r["kind"], r["transcript"]) for r in align.align(s, w, ["k"], first_slide=first_slide).orderBy("ord").collect()]


def test_alignment_takes_whole_sentences(spark):
    assert aligned(spark, WORDS, [2, 4]) == [("slide", "Hello there. Next."), ("slide", "More text!"), ("conclusion", "End.")]
    assert aligned(spark, WORDS, [2, 4, 9])[-1] == ("slide", "End.")


def test_alignment_with_preface(spark):
    assert [k for k, _ in aligned(spark, WORDS, [2, 4], first_slide=True)] == ["preface", "slide", "slide", "conclusion"]


def simulated(words, slides):
    """The alignment word by word."""
    now, at, out, ended = 0.0, 0, [], False
    for s in slides:
        taken = []
        while not ended:
            if at >= len(words):
                ended = True
                break
            start, word = words[at]
            now = start or now
            taken.append(word)
            at += 1
            if word[-1] in ".!?" and now >= s:
                break
        out.append(" ".join(taken))
    return out + ([] if ended else [" ".join(w for _, w in words[at:])])


def test_alignment_as_word_by_word(spark):
    rng = random.Random(5)
    for _ in range(12):
        t, words = 0.0, []
        for i in range(rng.randrange(1, 25)):
            t += rng.choice([0, 0.5, 1])
            words.append((t, f"w{i}" + rng.choice(["", "", ".", "!"])))
        slides = sorted(rng.sample(range(1, 15), rng.randrange(1, 5)))
        assert [x for _, x in aligned(spark, words, slides)] == simulated(words, slides)


def test_paragraphs_merge_bold_lines(spark):
    rows = [(1, 1, 1, "a"), (1, 2, 1, "b"), (1, 3, 0, "c"), (1, 5, 0, "long enough"), (1, 9, -1, "foot")]
    lines = spark.createDataFrame(rows, "k int, line_num int, category int, text string")
    assert sorted(x for (x,) in got(align.paragraphs(lines, ["k"]), "content")) == ["**a b** c", "long enough"]


def test_structured_summary_and_json(spark):
    slides = spark.createDataFrame([(1, 2), (1, 4)], "k int, frame_number int")
    lines = spark.createDataFrame([(1, 2, 1, 2, "Intro"), (1, 2, 2, 0, "some body"), (1, 4, 1, 2, "Intro")], "k int, frame_number int, line_num int, category int, text string")
    words = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(WORDS)], "k int, pos int, start double, word string")
    figures = spark.createDataFrame([(1, 4, "4_figure_1.png"), (1, 4, "4_figure_0.png")], "k int, frame_number int, path string")
    out = align.structured_summary(slides, lines, words, figures, ["k"]).orderBy("ord").collect()
    assert [r["title"] for r in out] == ["Preface", "Intro", "Intro (1)", "Conclusion"]
    assert out[2]["figure_paths"] == ["4_figure_0.png", "4_figure_1.png"] and out[1]["slide_content"] == ["some body"]
    assert '"title":"Intro (1)"' in align.to_json(align.structured_summary(slides, lines, words, figures, ["k"]), ["k"]).first()["json"]


# structure


def words_table(spark, rows):
    names = "slide int, word_ord int, text string, block_num int, par_num int, line_num int, word_num int, top int, left int, width int, height int, stroke_width double, image_height int, image_width int"
    return spark.createDataFrame(rows, names)


def test_structure_of_a_slide(spark):
    rows = [("Big", 1, 1, 1, 1, 20, 40, 30, 6.0), ("Title", 1, 1, 1, 2, 20, 90, 30, 6.0), ("body", 2, 1, 2, 1, 120, 40, 17, 3.0), ("text", 2, 1, 2, 2, 120, 90, 17, 3.0), ("tiny", 3, 1, 3, 1, 280, 40, 8, 1.5), (" ", 3, 1, 3, 2, 280, 40, 8, 1.5)]
    words = words_table(spark, [(1, i, t, b, p, ln, w, top, left, 40, h, s, 300, 400) for i, (t, b, p, ln, w, top, left, h, s) in enumerate(rows)])
    lines = structure.analyse(words, ["slide"])
    assert got(lines.orderBy("line"), "text", "category") == [("Big Title", 2), ("body text", 0), ("tiny", -1)]
    assert got(structure.raw_text(lines, ["slide"]), "raw") == [("Big Title body text",)]


# ordered rows


def test_keep_last(spark):
    rows = spark.createDataFrame([("h1", "a.jpg"), ("h2", "b.jpg"), ("h1", "c.jpg")], "h string, f string")
    assert sorted(got(ordered.keep_last(rows, ["h"], ["f"]), "f")) == [("b.jpg",), ("c.jpg",)]
    assert sorted(got(ordered.keep_last_value(rows, ["h"], "f"), "f")) == [("b.jpg",), ("c.jpg",)]


def vectors_at(angles):
    return [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]


def test_segments(spark):
    steps = [0, np.arccos(0.9), np.arccos(0.9), np.arccos(0.3), np.arccos(0.9)]
    frames = spark.createDataFrame(vectors_at(np.cumsum(steps)), "i int, v array<double>")
    for by in (None, ["k"]):
        rows = ordered.segment_clusters(frames.withColumn("k", F.lit(1)), "i", "v", by=by).orderBy("i")
        assert got(rows, "cluster_id", "is_best") == [(0, False), (0, False), (1, True), (1, False), (1, False)]
    single = ordered.segment_clusters(frames.limit(1), "i", "v")
    assert got(single, "cluster_id", "is_best") == [(0, False)]
    assert ordered.segment_clusters(frames.filter("i < 0"), "i", "v").count() == 0


def test_global_order_in_buckets_is_the_same(spark):
    rows = spark.createDataFrame([(int(x), float(x % 7)) for x in np.random.default_rng(3).permutation(500)], "i int, v double").repartition(7)
    one_bucket = ordered.running_sum_global(ordered.lead_global(rows, "i", ["v"], most=1), "i", F.col("v"), "s", most=1)
    many = ordered.running_sum_global(ordered.lead_global(rows, "i", ["v"], rows=20), "i", F.col("v"), "s", rows=20)
    assert got(one_bucket.orderBy("i"), "i", "next_v", "s") == got(many.orderBy("i"), "i", "next_v", "s")


def test_top_restored(spark):
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate((0.2, 0.9, 0.9, 0.5))], "k int, o int, r double")
    assert got(ordered.top_restored(rows, "r", "o", 0.5, ["k"]).orderBy("o"), "o") == [(1,), (2,)]
    assert got(ordered.top_restored(rows, "r", "o", 0.75, ["k"]).orderBy("o"), "o") == [(1,), (2,), (3,)]


def test_titles(spark):
    rows = spark.createDataFrame([(1, "Intro"), (2, ""), (3, "Intro"), (4, "Intro"), (5, None)], "o int, t string")
    assert [x for (x,) in got(ordered.default_titles(rows, "t", "o").orderBy("o"), "unique_title")] == ["Intro", "Slide 2", "Intro (1)", "Intro (2)", "Slide 5"]


@pytest.mark.parametrize(("cells", "reach", "want"), [([255, 0, 255, 255, 0, 255, 255, 255, 0], 2, None), ([255, 0, 255, 255, 0, 255, 255, 255, 0], 3, [255, 0, 0, 0, 0, 255, 255, 255, 0]), ([0, 255, 0], 2, [0, 0, 0])])
def test_run_smoothing(spark, cells, reach, want):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(cells)], "k int, c int, v int")
    assert [x for (x,) in got(ordered.run_filled(rows, "v", "c", ["k"], reach).orderBy("c"), "filled")] == (want or cells)
    assert images.run_filled(np.array([cells]), reach)[0].tolist() == (want or cells)


# evaluation


def test_word_errors_both_ways(spark):
    cases = [("the cat sat on mat", "the cat sit on the mat"), ("a b c", ""), ("", "x y"), ("a b c d", "a c d e"), ("same Words", "same  words")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    kernel = evaluate.word_errors_kernel(rows, "i", "a", "b")
    native = rows.select("i", evaluate.alignment_counts(evaluate.normal_tokens("a"), evaluate.normal_tokens("b")).alias("c")).select("i", "c.*")
    names = ("i", "hits", "subs", "dels", "ins")
    assert got(kernel.orderBy("i"), *names) == got(native.orderBy("i"), *names)
    assert got(kernel.filter("i = 0"), *names) == [(0, 4, 1, 0, 1)]
    rate = evaluate.error_rates(kernel).filter("i = 0").first()
    assert [round(rate[k], 4) for k in ("wer", "mer", "wil")] == [0.4, 0.3333, 0.4667]


def test_word_errors_on_random_texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(12))), " ".join(rng.choices("abc", k=rng.randrange(12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    names = ("i", "hits", "subs", "dels", "ins")
    native = df.select("i", evaluate.alignment_counts(evaluate.normal_tokens("a"), evaluate.normal_tokens("b")).alias("c")).select("i", "c.*")
    assert got(evaluate.word_errors_kernel(df, "i", "a", "b").orderBy("i"), *names) == got(native.orderBy("i"), *names)


def test_best_guess(spark):
    r = one(spark, evaluate.best_guess(F.create_map(F.lit("a"), F.lit(0.2), F.lit("b"), F.lit(0.7))))
    assert (r["class"], r["probability"]) == ("b", 0.7)


# text


def test_sentences_and_combinations(spark):
    a = spark.createDataFrame([(1, "One two three four five. short."), (2, None)], "k int, text string")
    b = spark.createDataFrame([(1, "Speech here."), (2, "More.")], "k int, text string")
    assert got(text.sentences(a, "text", ["k"]), "sentence") == [("One two three four five.",), ("short.",)]
    out = dict(got(text.combine(a, b, "text", ["k"], "full_sents", cut_off=0.7), "k", "combined"))
    assert out == {1: "One two three four five. Speech here.", 2: "More."}
    with pytest.raises(ValueError):
        text.combine(a, b, "text", ["k"], "other")


def test_spelling(spark):
    words = spark.createDataFrame([("helo",), ("wrld",), ("zzzzzz",), ("goodday",)], "w string")
    known = spark.createDataFrame([("hello", 5), ("help", 9), ("world", 3), ("good", 4), ("day", 4)], "term string, freq long")
    assert dict(got(text.corrected(words, "w", known), "word", "suggestion"))["wrld"] == "world"
    assert dict(got(text.corrected(words, "w", known), "word", "suggestion"))["zzzzzz"] == "zzzzzz"
    line = spark.createDataFrame([(1, "wrld goodday")], "k int, t string")
    assert got(text.corrected_text(line, "t", ["k"], known), "corrected") == [("world good day",)]
    lines = spark.createDataFrame([(1, "hel lo wor ld good day"), (2, "he llo"), (3, "qqqqq zzzzz hello"), (4, "hello world")], "k int, t string")
    assert dict(got(text.corrected_text(lines, "t", ["k"], known), "k", "corrected")) == {1: "hello world good day", 2: "hello", 3: "qqqqq zzzzz hello", 4: "hello world"}


def test_full_stops(spark):
    words = spark.createDataFrame([(1, 0, "hi", 0.0, 1.0), (1, 1, "there", 1.0, 2.0), (1, 2, "you", 2.0, 3.0)], "k int, pos int, word string, start double, end double")
    out = text.with_full_stops(words, ["k"], "pos", "word", F.col("word") == "there").orderBy("pos2")
    assert [x for (x,) in got(out, "word")] == ["Hi", "there", ".", "You", "."]


def test_combine_by_keywords_of_the_own_part(spark):
    """60 parts whose slides share common words: the sentence that each keeps is the one with its own slides' word, not with another's."""
    slides = spark.createDataFrame([(i, f"über{i} topic lecture über{i} course über{i}") for i in range(60)], "k int, text string")
    speech = spark.createDataFrame([(i, f"We met topic lecture course über{i + 1}. Then über{i} came.") for i in range(60)], "k int, text string")
    words = {(r["k"], r["term"]) for r in summarise.keywords(slides, "text", "k").collect()}
    assert words == {(i, f"über{i}") for i in range(60)}
    out = dict(got(text.combine(slides, speech, "text", ["k"], "keyword_based", coverage=0.5), "k", "combined"))
    assert out == {i: f"Then über{i} came." for i in range(60)}


@pytest.mark.parametrize("method", sorted(summarise.METHODS))
def test_extractive_is_a_subsequence(spark, method):
    body = "The sun is a star. Stars shine with light. A cat sleeps. The sun gives light to planets. Planets move around the sun."
    rows = spark.createDataFrame([(1, body), (2, "")], "k int, t string")
    out = got(summarise.extractive(rows, "t", "k", method, 0.7).orderBy("sent_idx"), "sent_idx", "sentence")
    assert len(out) == 3 and [s for _, s in out] == [x + "." for x in body.rstrip(".").split(". ") if x + "." in {s for _, s in out}]


def test_registered_summaries_read_documents(spark, sf_dir):
    from podium.catalog import text as queries

    assert got(queries.QUERIES["extractive_luhn"](spark, sf_dir).agg(F.max("sent_idx") > 12, F.count_distinct("doc_id") > 500)) == [(True, True)]
    assert got(queries.QUERIES["cluster_summary"](spark, sf_dir).agg(F.max("sent_idx") > 12, F.count_distinct("doc_id") > 500)) == [(True, True)]


def dense_ratings(docs, method):
    """The rank methods and LSA of a whole text by full matrices."""
    terms = sorted({t for d in docs for t in d})
    m = np.array([[d.count(t) for t in terms] for d in docs], float)
    if method == "lsa":
        _, sigma, v = np.linalg.svd((m / np.maximum(1, m.max(axis=0))).T, full_matrices=False)
        return np.sqrt(((sigma[:, None] * v) ** 2).sum(axis=0))
    if method == "text_rank":
        logs = np.log([max(1, len(d)) for d in docs])
        long = np.array([len(d) > 1 for d in docs])
        w = np.where(long[:, None] & long, (m > 0) @ (m > 0).T.astype(float) / np.maximum(1e-9, logs[:, None] + logs), 0)
        np.fill_diagonal(w, 0)
    else:
        m *= np.log(len(docs) / np.maximum(1, (m > 0).sum(axis=0))) + 1
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        w = (m @ m.T > 0.1).astype(float)
    sums = w.sum(axis=1, keepdims=True)
    move = np.divide(w, sums, out=np.full_like(w, 1 / len(w)), where=sums > 0)
    rank = np.full(len(w), 1 / len(w))
    for _ in range(200):
        rank = 0.15 / len(w) + 0.85 * rank @ move
    return rank


@pytest.mark.parametrize("method", sorted(summarise.METHODS))
def test_long_texts_are_rated_as_a_whole(spark, method):
    rng = random.Random(5)
    body = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randrange(1, 12))) for _ in range(450)] + ["the of", "alone"]
    rows = spark.createDataFrame([(1, ". ".join(body) + "."), (2, "The of. And. 1!")], "k int, t string")
    found = summarise.extractive(rows, "t", "k", method, 1.0).cache()
    assert found.filter("k = 2").count() == 3
    rating = dict(got(found.filter("k = 1"), "sent_idx", "rating"))
    docs = [summarise._tokens(s) for s in body]
    want = dense_ratings(docs, method) if method in ("text_rank", "lex_rank", "lsa") else summarise.METHODS[method](docs)
    assert len(rating) == 452 and np.allclose([rating[i] for i in range(452)], want, atol=2e-6)


def test_cluster_rules():
    with pytest.raises(ValueError):
        text.bag_of_words_rules("neural", "extractive", None, False)
    with pytest.raises(ValueError):
        text.bag_of_words_rules("bow", "extractive", "order", True)


# vectors, boxes


def test_kmeans_finds_the_slides_of_each_lecture(spark):
    """30 lectures far from each other, with 4 slides of 5 frames each: every lecture has 4 clusters, one for each slide."""
    rng = random.Random(6)
    frames = [(f"l{k}", i, [1000.0 * k + rng.random() * 0.01, 5.0 * (i // 5), 1.0]) for k in range(30) for i in range(20)]
    df = spark.createDataFrame([*frames, *(("same", i, [1.0, 1.0, 1.0]) for i in range(5))], "k string, n int, v array<double>")
    found = {}
    for k, n, c in got(vectors.cluster_slides(df, "kmeans", "n", "v", "k", num_centroids=4), "k", "n", "cluster_id"):
        found.setdefault(k, {}).setdefault(c, []).append(n // 5)
    assert list(found.pop("same").values()) == [[0] * 5] and len(found) == 30
    assert all(sorted(map(sorted, f.values())) == [[s] * 5 for s in range(4)] for f in found.values())


def test_affinity_finds_two_groups():
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.1, (8, 2)), np.random.default_rng(1).normal(5, 0.1, (9, 2))])
    label = vectors.affinity_labels(x, preference=-8)
    assert len(set(label[:8])) == 1 and len(set(label[8:])) == 1 and label[0] != label[8]


def test_boxes(spark):
    make = lambda *b: F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("xmax", "ymax", "xmin", "ymin"), strict=True)))
    assert one(spark, S.box_overlap(make(10, 10, 0, 0), make(8, 8, 2, 2))) == 36
    rows = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("i"), make(10, 10, 0, 0).alias("box")), F.struct(F.lit(1).alias("i"), make(8, 8, 2, 2).alias("box")), F.struct(F.lit(2).alias("i"), make(30, 30, 20, 20).alias("box")))).alias("r")).select(F.lit(1).alias("im"), "r.*")
    assert sorted(got(boxes.without_parts(rows, "im", "i"), "i")) == [(0,), (2,)]


# images


def picture():
    im = np.zeros((60, 90), np.uint8)
    im[10:50, 15:75] = 200
    im[20:30, 20:40] = 40
    return im


def test_png_round_trip():
    rng = np.random.default_rng(2)
    for im in (rng.integers(0, 256, (7, 5), dtype=np.uint8), rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)):
        assert (images.from_png(images.png(im)) == im).all()


def test_image_kernels(spark):
    im = picture()
    assert images.is_solid(np.full((5, 5), 9, np.uint8)) and not images.is_solid(im)
    cut, status = images.without_border(im)
    assert status == "cut" and abs(cut.shape[0] - 34) <= 4
    assert images.without_border(np.zeros((5, 5), np.uint8)) == (None, "solid")
    assert images.colour_kind(im) == "b&w" and images.entropy(np.zeros((4, 4))) == 0
    page, failed = images.cropped(im)
    assert not failed and abs(page.shape[1] - 60) <= 4
    assert images.average_hash(im) == images.average_hash(im.copy()) and len(images.perceptual_hash(im)) == 16
    move = np.roll(im, 4, axis=1)
    assert images.camera_move(im, im) == 0
    assert images.content_added(np.full((60, 90), 9, np.uint8), im)[0] and not images.content_added(im, move)[0]
    df = spark.createDataFrame([(1, bytearray(images.png(im))), (2, bytearray(images.png(np.zeros((5, 5), np.uint8))))], "k int, content binary")
    assert dict(got(images.borders_removed(df, "k"), "k", "status")) == {1: "cut", 2: "solid"}
    assert got(images.pages_cropped(df.filter("k = 1"), "k"), "failed") == [(False,)]


def test_ransac_and_matching():
    rng = np.random.default_rng(4)
    a = rng.uniform(0, 100, (40, 2))
    h = np.array([[1.1, 0.1, 3], [0.05, 0.9, -2], [0.0005, 0.0002, 1]])
    b = images.mapped(h, a)
    b[:8] += 40
    found, agree = images.ransac(a, b)
    assert agree.sum() == 32 and np.allclose(images.mapped(found, a[8:]), b[8:], atol=0.1)
    d = rng.normal(size=(20, 8))
    assert images.descriptor_matches(d, np.concatenate([d, d + 5])).tolist() == [[i, i] for i in range(20)]


def test_suppression_and_regions():
    b = np.array([[10, 10, 0, 0], [11, 11, 1, 1], [30, 30, 20, 20]])
    assert images.suppressed(b, np.array([0.5, 0.9, 0.1])).tolist() == [1, 2]
    mask = np.zeros((6, 6), bool)
    mask[0:2, 0:2] = mask[4:6, 3:6] = True
    assert images.region_boxes(mask).tolist() == [[2, 2, 0, 0], [6, 6, 3, 4]]


# speech


def test_voice_activity():
    v = lambda s: [(i, c == "V") for i, c in enumerate(s)]
    assert speech.segments_of(v("V" * 10 + "U" * 10 + "V" * 5)) == [(0, 19)]
    assert speech.segments_of(v("UUU" + "V" * 12)) == [(3, 14)]
    assert speech.segments_of(v("")) == []


def test_char_words(spark):
    rows = spark.createDataFrame([(1, 0, "h", 0.0), (1, 1, "i", 0.1), (1, 2, ".", 0.2), (2, 0, "h", 0.0), (2, 1, "i", 0.1), (2, 2, " ", 0.2), (2, 3, ".", 0.3)], "k int, pos int, text string, start_time double")
    out = got(speech.chars_to_words(rows, ["k"]).orderBy("k", "word_idx"), "k", "word", "start", "end")
    assert out == [(1, "hi", 0.0, 0.2), (1, ".", 0.2, 0.2), (2, "hi", 0.0, 0.2), (2, ".", 0.3, 0.3)]


def test_waves_and_recognisers(spark):
    data = speech.write_wave(np.arange(1000, dtype=np.int16), 8000)
    x, rate, seconds = speech.read_wave(data, 16000)
    assert rate == 16000 and len(x) == 2000 and seconds == 0.125
    df = spark.createDataFrame([("a", bytearray(data))], "k string, content binary")
    speech.register("count", lambda pcm, rate: [(0.0, len(pcm) / rate, f"{len(pcm)} samples")])
    recs = speech.recordings(df, "k")
    assert got(speech.transcribed(recs.withColumn("off", F.lit(5.0)), "k", "count", "off"), "word", "start") == [("2000 samples", 5.0)]
    with pytest.raises(ValueError):
        speech.transcribed(recs, "k", "unknown")
    with pytest.raises(ValueError):
        speech.check_rate(44100)


# scalars and sources


def test_scalars(spark):
    value = lambda c: one(spark, c)
    assert [value(S.frame_interval_exact(F.lit(float(s)))) for s in (1199, 1200, 4800)] == [11.99, 6.0, 24.0]
    assert value(S.iso_seconds(F.lit("PT1H2M3S"))) == 3723 and value(S.clock_seconds(F.lit("01:02:03.9"))) == 3723
    assert value(S.title_cased(F.lit("it's a MIX"))) == "It'S A Mix" and value(S.capitalized(F.lit("hELLO you"))) == "Hello you"
    assert value(S.frame_number(F.lit("/a_9/img_00012.jpg"))) == 12 and value(S.figure_frame(F.lit("/x/7_figure_0.png"))) == 7
    assert value(S.iso_date(F.lit("02-29-2024"))) == "2024-02-29T00:00:00Z" and value(S.without_speaker(F.lit("no colon"))) == "no colon"
    assert value(S.is_downloaded(F.lit("False"))) is False and value(S.zero_as_null(F.lit("0"))) is None
    assert abs(sum(value(S.softmax(F.array(F.lit(1.0), F.lit(2.0))))) - 1) < 1e-12


def test_captions(spark, tmp_path):
    (tmp_path / "v1.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\nBob: Hello\nthere\n\n2\n00:01:00,000 --> 00:01:01,000\nbye: now: then\n")
    (tmp_path / "v2.vtt").write_text("WEBVTT\n\n00:05.000 --> 00:06.000 align:start\n<b>Hi</b>\n")
    (tmp_path / "v3.sbv").write_text("0:00:01.000,0:00:02.500\nThird\n")
    (tmp_path / "v4.doc").write_text("nothing")
    files = readers.caption_files(spark, str(tmp_path))
    out = {(r["video_id"], r["pos"]): (r["start"], r["end"], r["word"]) for r in readers.cues(files, "video_id", remove_speakers=True).collect()}
    assert out == {("v1", 0): (1.5, 2.0, "Hello there"), ("v1", 1): (60.0, 61.0, "now: then"), ("v2", 0): (5.0, 6.0, "Hi"), ("v3", 0): (1.0, 2.5, "Third")}
    assert dict(got(readers.transcript(readers.cues(files, "video_id"), "video_id"), "video_id", "transcript"))["v3"] == "Third "


def test_folders_and_catalogs(spark, tmp_path):
    (tmp_path / "in" / "slide").mkdir(parents=True)
    (tmp_path / "in" / "slide" / "img_00003.png").write_bytes(images.png(picture()))
    found = readers.images(spark, str(tmp_path / "in"), "*.png")
    assert got(found, "frame_number", "class") == [(3, "slide")]
    csv = tmp_path / "c.csv"
    csv.write_text(",".join(c.split()[0] for c in readers.VIDEOS.split(", ")) + "\n0,2020,youtube,abc,l,0,T,D,a,b,c,False\n")
    rows = readers.catalog(spark, str(csv))
    assert got(rows, "video_id", "download_link", "downloaded") == [("abc", None, False)] and readers.to_download(rows, "youtube").count() == 1
    frames = readers.extracted_frames(found.select(F.lit(1).alias("k"), "content"), "k", lambda c, every: [c, c, c], 2.0)
    assert sorted(got(frames, "frame_number")) == [(0,), (2,), (4,)]
    sinks.write_clusters(found.withColumn("cluster_id", F.lit(1)).select("path", "cluster_id"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "cluster_id=1").exists()
    assert got(spark.range(1).select(sinks.derived_name(F.lit("/a/x_1.jpg"), "_cropped").alias("p"))) == [("/a/x_1_cropped.jpg",)]


def test_downloads_are_tried_again(spark):
    def fetch(link):
        if link == "bad":
            raise OSError(link)
        return link.encode()

    items = spark.createDataFrame([(1, "good"), (2, "bad")], "k int, link string")
    assert dict(got(readers.downloaded(items, "k", "link", fetch), "k", "failed")) == {1: False, 2: True}


# models


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "k int, content string")
    size = models.as_column("size", lambda: lambda xs: [len(x) for x in xs], "long")
    assert sorted(got(df.select("k", size(F.col("content")).alias("n")))) == [(1, 2), (2, 4)]
    found = models.classified(df, "k", "net", lambda: lambda xs: (np.array([[len(x), 2.5] for x in xs], float), np.ones((len(xs), 3))), ["long", "short"])
    assert dict(got(found, "k", "class")) == {1: "short", 2: "long"}
    assert got(models.low_confidence(found, limit=0.7), "k") == [(1,)]
    fall = models.occlusion(np.ones((4, 4)), lambda xs: [float(x[:2, :2].sum()) for x in xs], 2, 2)
    assert fall.tolist() == [[4.0, 0.0], [0.0, 0.0]]
    scores, geometry = np.zeros((3, 3)), np.zeros((5, 3, 3))
    scores[1, 2], geometry[:4, 1, 2] = 0.9, (2, 5, 3, 1)
    found, best = models.text_regions(scores, geometry)
    assert found.tolist() == [[13, 7, 7, 2]] and best.tolist() == [0.9]
    assert models.retried(lambda x: x)(3) == 3

    def broken(x):
        raise RuntimeError

    assert models.retried(broken, 2, fallback=lambda x: -x)(3) == -3


# the pipeline


def test_lecture_pipeline(spark, tmp_path):
    frames = spark.createDataFrame([("a", i, "slide" if i != 3 else "audience", f"h{i // 2}", [float(np.cos(i // 2 * 1.5)), float(np.sin(i // 2 * 1.5))]) for i in range(8)], "lecture_id string, frame_number int, class string, hash string, features array<double>")
    words = spark.createDataFrame([("a", i, float(i), f"Word{i}." if i % 2 else f"word{i}") for i in range(12)], "lecture_id string, pos int, start double, word string")
    rows = [("a", f, 0, t, 1, 1, 1, 1, 20, 40, 40, 30, 6.0, 300, 400) for f, t in ((1, "Alpha"), (5, "Beta"), (7, "Gamma"))]
    ocr = spark.createDataFrame(rows, "lecture_id string, frame_number int, word_ord int, text string, block_num int, par_num int, line_num int, word_num int, top int, left int, width int, height int, stroke_width double, image_height int, image_width int")
    config = Config.of({"combination_algorithm": "concat"}, gamma=1.0)
    run = Pipeline(spark, lecture_stages(frames, words, ocr), config, str(tmp_path))
    out = run.run_all()
    assert set(run.seconds) == {n for n, _ in run.stages} and out["summary"].count() > 0
    assert "Word11." in out["notes"].first()["text"]
    first = got(out["notes"])
    again = Pipeline(spark, lecture_stages(frames, words, ocr), Config.of(config, skip_to=8), str(tmp_path))
    assert got(again.run_all()["notes"]) == first and set(again.seconds) == {"notes"}
    with pytest.raises(ValueError):
        Config.of({"cluster_method": "other"})
    # the same from a shell: settings from a file and from options, and from a stored stage on
    from podium.plans.__main__ import main, parser

    for name, df in (("frames", frames), ("words", words), ("ocr", ocr)):
        df.write.parquet(str(tmp_path / "tables" / f"{name}.parquet"))
    (tmp_path / "c.json").write_text('{"combination_algorithm": "only_asr", "gamma": 1.0}')
    given = [str(tmp_path / "tables"), str(tmp_path / "store"), "--config", str(tmp_path / "c.json")]
    assert list(main([*given, "--combination_algorithm", "concat"], spark)) == [n for n, _ in run.stages]
    assert got(spark.read.parquet(str(tmp_path / "store" / "notes"))) == first
    assert list(main([*given, "--combination_algorithm", "concat", "--skip_to", "8"], spark)) == ["notes"]
    for wrong in (["--cluster_method", "other"], ["--summarization_abs", "some-model"], ["--no_such_setting", "1"]):
        with pytest.raises(SystemExit):
            main([*given, *wrong], spark)
    assert parser().parse_args([*given, "--coverage", "0.5"]).coverage == 0.5
