"""Small inputs on which queries once differed from their SQL, or ways that failed on larger tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from podium import catalog
from podium.operators import boxes, images, text, vectors
from podium.sources import formats
from tests.test_parity import rows


@pytest.fixture
def same(spark, tmp_path):
    """Asserts that a query gives its SQL's rows on tables given as DuckDB selections."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        found = con.sql(catalog.ORACLE_SQL[name])
        got = catalog.QUERIES[name](spark, str(tmp_path)).select(*found.columns).collect()
        order = range(len(found.columns))
        assert rows([tuple(r) for r in got], order) == rows(found.fetchall(), order)
        return got

    return run


def test_frame_numbers_of_seven_digits(same):
    same("frame_numbers", part="SELECT unnest([7, 999999, 1000002, 12345678])::BIGINT AS p_partkey, 2 AS p_size")


def test_pixels_in_single_precision(same):
    same("image_predicates", embeddings="SELECT i AS vec_id, list_transform(range(64), lambda k: ((i * 64 + k) % 101 - 50) * 0.0025 + 0.0000000001)::FLOAT[] AS embedding FROM range(8) t(i)")


def test_slides_and_sentences_of_nearest_seconds(same):
    """The sentence's end at 10.6 and the slide at 11.2 are one second."""
    same("structured_alignment", events="""SELECT * FROM (VALUES (0, '2024-01-01 00:00:10.6'::TIMESTAMP, 1, 'purchase', 1.0), (1, '2024-01-01 00:00:10.7', 1, 'view', 1.0), (2, '2024-01-01 00:00:11.2', 1, 'signup', 1.0),
    (3, '2024-01-01 00:00:12.5', 1, 'purchase', 1.0), (4, '2024-01-01 00:00:13.5', 1, 'signup', 1.0)) t(event_id, ts, user_id, event_type, value)""")


def test_slides_of_one_second_and_times_that_go_back(same):
    same("structured_alignment_text", events="""SELECT * FROM (VALUES (0, '2024-01-01 00:00:10'::TIMESTAMP, 1, 'view', 1.0), (1, '2024-01-01 00:00:20', 1, 'signup', 1.0), (2, '2024-01-01 00:00:20', 1, 'purchase', 1.0),
    (3, '2024-01-01 00:00:20', 1, 'signup', 1.0), (4, '2024-01-01 00:00:05', 1, 'purchase', 1.0), (5, '2024-01-01 00:00:06', 1, 'signup', 1.0), (6, '2024-01-01 00:00:30', 1, 'purchase', 1.0),
    (7, '2024-01-01 00:00:31', 1, 'view', 1.0), (8, '2024-01-01 00:00:20', 2, 'signup', 1.0), (9, '2024-01-01 00:00:25', 2, 'error', 1.0)) t(event_id, ts, user_id, event_type, value)""")


def test_equal_boxes_are_paired_once(spark, same):
    """The boxes repeat every 1200 numbers; pairs are made of different ones only."""
    parts = "SELECT (i % 8 + 1200 * (i // 8))::BIGINT AS p_partkey, 1 + (i % 2)::INT AS p_size FROM range(480) t(i)"
    for name in ("rect_overlap_sum", "text_covered_boxes", "subfigure_suppression", "box_stability"):
        same(name, part=parts)
    rows = spark.sql("SELECT id, 1 AS image, struct(10 AS xmax, 10 AS ymax, id % 3 AS xmin, 0 AS ymin) AS box FROM range(900)")
    assert boxes._pairs(rows, rows, "image", "box", _n=F.count("*")).count() == 9


def test_many_small_ranges_are_few_tasks():
    files = [formats.Found(i, f"/f{i}.srt", f"f{i}", ".srt", 5000) for i in range(1000)]
    parts = formats.ranges(files, 2048)
    found = formats.tasks(parts)
    assert len(parts) == 3000 and 500 <= len(found) <= 1000 and [p for t in found for p in t.parts] == parts
    assert len(formats.tasks(parts * 100)) < 2000 and len(formats.tasks(parts[:300])) == 300
    assert len(formats.tasks(formats.ranges([formats.Found(0, "/a.wav", "a", ".wav", 100 << 20)], 4 << 20))) == 25


def test_near_pairs_misses_none(spark):
    """All pairs of copies and of different vectors, over several blocks."""
    x = np.random.default_rng(1).normal(size=(60, 3))[np.arange(300) % 60] + np.arange(300)[:, None] // 60 * 0.01
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j) for i, j in zip(*np.nonzero(d < 0.3), strict=True) if i < j}
    got = [(r["a"], r["b"]) for r in vectors.near_pairs(rows, "v", "id", 0.3, block=64).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_lines_are_paired_once_by_many_tasks(spark, same, monkeypatch):
    """The lines repeat every 600 numbers, one of them more often than a row holds; all lines of one image are no longer one task's."""
    monkeypatch.setattr(boxes, "IDS", 8)
    same("line_intersections", part="""SELECT (i % 12 * 7 + 600 * (i // 12))::BIGINT AS p_partkey, 1 + (i % 3 = 0)::INT AS p_size FROM range(120) t(i)
    UNION ALL SELECT (600 * i + 5)::BIGINT, 1 FROM range(100) t(i) UNION ALL SELECT * FROM (VALUES (NULL, 1), (4::BIGINT, NULL))""")
    line = lambda side: spark.range(900).selectExpr("1 AS image", "id", *(f"cast(pmod(id * {m}, 30) AS double) AS {c}" for c, m in (("x1", side), ("y1", 3), ("x2", 7), ("y2", 11))))
    assert boxes._equal_lines(line(1).limit(90), "image", "a").count() == 30
    found = boxes.line_intersections(line(1), line(2), "image")
    assert found.select(F.spark_partition_id()).distinct().count() > 8


def test_regions_and_blur_as_by_hand():
    """Regions by a flood fill and the blur by single sums, on masks of any density; a picture of many runs takes no calls for each row."""
    rng = np.random.default_rng(0)
    for share in (0, 0.3, 0.6, 0.9, 1):
        mask = rng.random((17, 23)) < share
        want, n = np.zeros(mask.shape, int), 0
        for at in zip(*np.nonzero(mask), strict=True):
            if not want[at]:
                n, todo = n + 1, [at]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 17 and 0 <= x < 23 and mask[y, x] and not want[y, x]:
                        want[y, x] = n
                        todo += [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
        lab, found = images.labelled(mask)
        assert found == n and (lab == want).all()
    im = rng.integers(0, 256, (9, 12))
    k = np.exp(-0.5 * np.arange(-3, 4) ** 2)
    k /= k.sum()
    p = np.pad(im.astype(float), 3, mode="edge")
    assert np.allclose(images.blurred(im, 1.0), [[(p[y : y + 7, x : x + 7] * np.outer(k, k)).sum() for x in range(12)] for y in range(9)])


def test_blur_and_regions_make_no_call_a_line(monkeypatch):
    calls = []
    for name in ("convolve", "concatenate"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **b: (calls.append(1), f(*a, **b))[1])
    assert images.edges(np.full((200, 300), 9, np.uint8)).sum() == 0 and len(calls) < 20


def test_sentences_are_rated_where_they_lie(spark):
    """Only the choice among a part's sentences is a shuffle; parts without words, without text and one that repeats are rated as by hand."""
    texts_ = ["Alpha beta gamma. Beta beta delta! The and of. Gamma?", None, "", "...", "Alpha beta. Delta delta gamma. Eta.", "Delta. 1 2 3 gamma alpha. Beta the gamma. Zeta eta. Alpha."]
    df = spark.createDataFrame(list(enumerate(texts_)), "k int, t string")
    found = text.tfidf_selection(df, "t", ["k"], coverage=1.0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = text.sentences(df, "t", ["k"]).withColumn("_key", F.concat_ws("-", "k", "sent_idx"))
    want = {r[0]: r[1] for r in text.tfidf(rows, "sentence", "_key").groupBy("_key").agg(F.sum("weight")).collect()}
    got = {f"{r['k']}-{r['sent_idx']}": r["rating"] for r in found.collect()}
    assert len(got) == rows.count() and all(v == pytest.approx(want.get(k, 0.0), abs=2e-9) for k, v in got.items()) and len(want) > 5
    assert text.tfidf_selection(df.limit(0), "t", ["k"]).count() == 0
