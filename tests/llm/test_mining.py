"""Hard negatives, line dedup and the divergence of sources against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from podium.llm import divergence, hard_negatives, line_dedup
from podium.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def mined_by_force(table, low=80, high=100):
    """Of (id, vector, label) rows."""
    sound = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in table if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound = [(i, v, math.fmod(lab + 1, 10) if i is not None and i % 7 == 0 else lab) for i, v, lab in sound]
    out = []
    for k, (a, x, lab) in enumerate(sound):
        if a is None or a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, v, strict=False)), i is None, i or 0, n, i, other) for n, (i, v, other) in enumerate(sound) if n != k]
        for pos in sorted(r for r in scored if r[-1] == lab)[:5]:
            inside = sorted(r for r in scored if r[-1] != lab and low * -pos[0] <= 100 * -r[0] <= high * -pos[0])[:5]
            out += [(a, pos[4], rank, r[4], -pos[0], -r[0]) for rank, r in enumerate(inside, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_by_force(spark, seed, monkeypatch):
    """Small integer vectors, so that many scores tie; anchors in several broadcasts, levels of few bits."""
    rng = random.Random(seed)
    monkeypatch.setattr(hard_negatives, "DIGIT", 6)
    monkeypatch.setattr(hard_negatives, "SENT", 2)
    monkeypatch.setattr(hard_negatives, "ANCHOR_CELLS", 8)
    monkeypatch.setattr(hard_negatives, "ROW_CELLS", 200)
    table = [(i * 20, [rng.choice((-0.02, 0.0, 0.01, 0.3)) for _ in range(4)], rng.choice((0, 0, 0, 1, 2))) for i in range(150)]
    assert rows(hard_negatives.report(spark.createDataFrame(table, VECTORS))) == mined_by_force(table)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (3, [1.0, 0.5], 2), (3, [1.0, 0.5], 2), (None, [1.0, 0.5], 2), (None, [0.9, 0.5], 1), (5, None, 1),
        (6, [1.0, None], 1), (200, [nan, 1.0], 1), (8, [1.0, inf], 2), (300, [1.0, 1.0], None), (9, [], 2), (400, [], 2), (10, [1.0], 3), (11, [0.8, 0.5, 0.7], 4), (500, [-1.0, 0.0], 5), (12, [1.0, 0.0], 5),
    ]
    df = spark.createDataFrame(table, VECTORS)
    assert rows(hard_negatives.report(df)) == mined_by_force(table)
    assert rows(hard_negatives.report(df.withColumns({k: F.lit(7) for k in ("row", "id", "block", "pos", "w", "need", "hi", "anchor", "vector", "score")}))) == mined_by_force(table)
    assert hard_negatives.report(df.limit(0)).count() == 0 and hard_negatives.report(df.filter("vec_id = 3")).count() == 0


def test_large_components_are_exact_or_refused(spark):
    table = [(0, [600_000.0, 1.0], 1), (1, [599_999.0, 3.0], 1), (2, [590_000.0, 0.125], 2), (3, [500_000.0, 0.5], 2)]
    assert rows(hard_negatives.report(spark.createDataFrame(table, VECTORS))) == mined_by_force([(i, [float(x) for x in v], k) for i, v, k in table])
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.report(spark.createDataFrame([(0, [1e12], 1)], VECTORS))


# line dedup


def lines_by_force(table, least=40, copies=5):
    keys = lambda t: [line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)}) for line in (t or "").split("\n")]
    held, last = Counter(), {}
    for i, t in table:
        for k in {k for k in keys(t) if len(k) >= least}:
            held[k] += 1
            last[k] = max((last.get(k, (False, 0)), (i is not None, i or 0)))
    out = []
    for i, t in table:
        gone = [held[k] >= copies and last[k] != (i is not None, i or 0) for k in keys(t)]
        kept = "\n".join(line for line, g in zip((t or "").split("\n"), gone, strict=True) if not g)
        out.append((i, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_by_force(spark):
    rng = random.Random(5)
    lines = [f"  Line {i} é of the usual kind, which is long enough to count{'!' * (i % 3)}\r" for i in range(60)] + ["short", "", "É" * 39, "É" * 40, "x" * 39 + " ", "X" * 40, "x" * 40]
    table = [(rng.randrange(200), "\n".join(rng.choices(lines, k=rng.randrange(12)))) for _ in range(120)]
    table += [(None, lines[0]), (None, f"{lines[0]}\n{lines[1]}"), (7, None), (8, ""), (9, "\n\n"), (10, (lines[2] + "\n") * 20_000), (11, lines[2]), (11, lines[2])]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in table], SCHEMA)
    assert rows(line_dedup.report(df)) == lines_by_force(table)
    assert rows(line_dedup.report(df, batches=7)) == lines_by_force(table)
    clashing = df.withColumns({k: F.lit(7) for k in ("tk", "keys", "h1", "n", "last", "batch", "_id", "kept")})
    assert rows(line_dedup.report(clashing)) == lines_by_force(table)
    assert line_dedup.report(df.limit(0)).count() == 0


def test_a_key_held_by_rows_without_id_alone(spark):
    table = [(None, "the same long line stands in many rows that have no id\n" + str(i)) for i in range(6)]
    assert rows(line_dedup.report(spark.createDataFrame([(i, t, None, None, 0) for i, t in table], SCHEMA))) == lines_by_force(table)


def test_runs_are_levelled(spark):
    """Each batch's keys that the runs hold often enough are left out; FAN runs of a level become one of the next; files go with the runs."""
    import glob

    runs = line_dedup.Runs(spark, enough=3)
    batch = lambda keys, doc: spark.createDataFrame([(doc, k, k) for k in keys], "doc_id long, h1 long, h2 long")
    sizes = []
    for doc, keys in ((9, [1, 1, 1, 2, 3]), (8, [1, 4]), (7, [1, 2, 5]), (6, [2, 6])):
        runs.add(batch(keys, doc))
        sizes.append([[spark.table(n).count() for n in level] for level in runs.levels])
    assert sizes == [[[3]], [[], [4]], [[2], [4]], [[], [], [6]]]
    assert rows(runs.without(batch([1, 7, 6], 5)).select("doc_id", "h1")) == [(5, 7)]
    found = runs.shared()
    assert rows(found) == [(1, 1, 9), (2, 2, 9)]
    assert not glob.glob(shared_dir(spark).removeprefix("file://") + "/podium-run-*/part*") or not runs.paths


# divergence of sources


def audit_by_force(table, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t, lang, source, _ in table]
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        size = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 1_000_000_000 * (count[lang, s][t] + 1) // (size[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 1_000_000_000 * (sum(count[lang, s][t] for s in sources) + 1) // (sum(size.values()) + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, values in parts.items():
                order = sorted(values, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, n) for n, (item, v) in enumerate(order, 1) if part == "pair" or n <= top]
    return sorted(out, key=repr)


def test_audit_by_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "The", "Äpfel", "äpfel", "日本", "a1b", "x_y", "don't", "😀", "z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    table = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "ü", "z", None)), 0) for i in range(200)]
    table += [(1, None, "en", "silent", 0), (2, "", "fr", "a", 0), (3, "only once", "fr", "b", 0), (4, "alone here", "es", "a", 0), (5, "the " * 50_000, "en", "a", 0)] + [(6, "Copy of a row", "en", "a", 0)] * 3
    df = spark.createDataFrame(table, SCHEMA)
    expected = audit_by_force(table)
    assert rows(divergence.audit(df)) == expected
    assert rows(divergence.audit(df, top=2)) == audit_by_force(table, top=2)
    monkeypatch.setattr(divergence, "CELLS", 16)
    monkeypatch.setattr(divergence, "MOST_SENT", 0)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    clashing = df.withColumns({k: F.lit(7) for k in ("s", "p", "q", "n", "v", "m", "id", "chunk", "vector", "item", "value", "rank")})
    assert rows(divergence.audit(clashing)) == expected
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    n = 10**13
    df = spark.createDataFrame([(n, 3 * n + 1, 7)], "c long, n long, v long")
    assert df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 1) // (3 * n + 8)
