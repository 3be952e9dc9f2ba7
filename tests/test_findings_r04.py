"""Inputs on which queries of round 4 did less than their whole job, or held more than a task has room for."""

from itertools import product

from podium.operators import boxes, text
from tests.test_findings_r03 import same  # noqa: F401


def generated(plan) -> int:
    """Rows that the explodes of the last stage made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return generated(plan.executedPlan())
    if plan.nodeName() == "ResultQueryStage":
        return generated(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    return own + sum(generated(plan.children().apply(i)) for i in range(plan.children().size()))


def test_a_line_of_many_ids_is_not_held_with_all_that_it_meets(spark, monkeypatch):
    """Before its first result, a task made all results of a row of equal lines: 4,000,000 here."""
    monkeypatch.setattr(boxes, "BLOCK", 256, raising=False)
    line = lambda ends: spark.range(2000).selectExpr("1 AS image", "id", *(f"{v}D AS {c}" for c, v in ends.items()))
    found = boxes.line_intersections(line({"x1": 0, "y1": 5, "x2": 9, "y2": 5}), line({"x1": 4, "y1": 0, "x2": 4, "y2": 9}), "image")
    first = found.limit(1)
    assert [tuple(r)[3:] for r in first.collect()] == [(4.0, 5.0)]
    assert 0 < generated(first._jdf.queryExecution().executedPlan()) < 1_000_000
    assert found.selectExpr("count(*)", "count(DISTINCT h * 2000 + v)", "sum(x + y)").first()[:] == (4_000_000, 4_000_000, 36_000_000.0)


def test_blocks_of_both_sides_meet_once(same, monkeypatch):  # noqa: F811
    """Images of several blocks on both sides, of one side only, and without lines."""
    monkeypatch.setattr(boxes, "BLOCK", 4, raising=False)
    monkeypatch.setattr(boxes, "PARTS", 2)
    monkeypatch.setattr(boxes, "IDS", 3)
    got = same("line_intersections", part="""SELECT (i % 40 + 600 * (i // 40))::BIGINT AS p_partkey, (1 + i % 3)::INT AS p_size FROM range(240) t(i)
    UNION ALL SELECT (600 * i + 5)::BIGINT, 1 FROM range(50) t(i) UNION ALL SELECT 2 * i, 7 FROM range(30) t(i) UNION ALL SELECT * FROM (VALUES (NULL, 1), (4::BIGINT, NULL))""")
    assert len(got) > 1000


def test_all_learned_abbreviations_count(spark, monkeypatch):
    """3000 words that a stop belongs to, of which 2000 once counted: held by tasks, and where they are too many for it, joined."""
    terms = ["".join(p) for p in product("abcdefghijklmnopqrstuvwxyzäöüß\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6\u03b7\u03b8абвгдежзиклмнопрст", repeat=2)][:3000]
    texts = [f"The {t}. House over a river?" for t in terms] * 2 + [None, "", "Ab. Moon ac. Moon. Sun. Moon ab.\n\nSun (ad. Moon."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    held = text.learned_sentences(df, "t", ["id"]).collect()
    assert sorted(r["id"] for r in held if r["id"] < 6000) == list(range(6000)) and all(r["sentence"] == texts[r["id"]] for r in held if r["id"] < 6000)
    assert [r["sentence"] for r in held if r["id"] >= 6000] == ["Ab. Moon ac. Moon.", "Sun.", "Moon ab.", "Sun (ad. Moon."]
    monkeypatch.setattr(text, "HELD_ABBREVIATIONS", 10)
    assert sorted(text.learned_sentences(df, "t", ["id"]).collect()) == sorted(held)
