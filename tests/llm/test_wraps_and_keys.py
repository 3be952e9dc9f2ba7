"""Notices that are wrapped, and the key of pseudonyms, which no plan shows; fingerprints searched
by keys of all lengths."""

import random

import pytest
from pyspark.sql import functions as F

from podium.llm import licenses, pii, simhash

WRAPS = ["\n", "\r\n * ", "\n# ", "  ", "\n// ", "\t", " \n\n"]


@pytest.mark.parametrize("wrap", WRAPS)
def test_wrapped_notices(wrap):
    """Each notice, broken at any one of its blanks or at all of them, is found whole and without errors."""
    for marked, label in licenses.NOTICES.items():
        words = marked.replace("{", "").replace("}", "").split(" ")
        plain = licenses.Searcher().find("x " + " ".join(words) + " y") if wrap == WRAPS[0] else None
        for cut in [*range(1, len(words)), None]:
            text = (wrap.join(words) if cut is None else " ".join(words[:cut]) + wrap + " ".join(words[cut:]))
            found = licenses.Searcher().find("say: " + text + " so")
            assert [(x, n) for x, _, _, n, _ in found] == [(label, 0)] and "say: "[: found[0][1]] == "say: " and found[0][2] == 5 + len(text), (text, found)
        assert plain is None or [x[0] for x in plain] == [label]


def test_places_are_those_of_the_text(spark):
    text = "é\n\n  Licensed under the GNU General\n  Public License, version 2 \n and\tmore"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "gpl,gpl-2" and row["n_base"] == 1
    ((label, a, b, errors),) = __import__("json").loads(row["spans"])
    assert (label, errors) == ("gpl-2", 0) and text[a:b].startswith("Licensed") and text[a:b].endswith("version 2")


def test_the_key_is_in_no_plan(spark):
    df = spark.createDataFrame([(1, "call 212-555-0143 or a@b.example.com")], "doc_id long, text string")
    key = "a-key-that-must-not-be-seen"
    out = pii.report(df, key)
    rows = out.collect()
    plan = out._jdf.queryExecution().toString() + out._jdf.queryExecution().executedPlan().treeString()
    assert key not in plan and "_key" in plan and rows[0]["n_found"] == 2
    again = pii.pseudonymise(df.withColumn("_key", F.lit("own")), key)
    assert again.columns == ["doc_id", "text", "_key"] and again.first()["text"] == rows[0]["text"] and again.first()["_key"] == "own"
    assert any(word in pii.KEY_SETTING for word in ("secret", "password", "token"))


@pytest.mark.parametrize(("radius", "n", "blocks"), [(11, 1000, 4), (11, 5_000_000, 3), (3, 10**9, 2), (5, 10**6, 2)])
def test_keys_of_all_lengths_find_the_same(spark, radius, n, blocks):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 1 << 63, (1 << 64) - 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in {*base, *(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 15))) for b in base for _ in range(4))}]
    assert len(simhash._blocks(radius, n)) == blocks
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash._pairs(df.select(F.col("fp").alias("query")), df, radius, n)
    assert sorted((r["query"], r["fp"]) for r in found.collect()) == sorted((a, b) for a in signed for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= radius)


def test_questions_ask_for_less_as_keys_grow():
    """A question never costs more than with 16-bit keys, and at a thousand million fingerprints less than a quarter of that."""
    for power in range(4, 10):
        chosen, fixed = (simhash.cost(b, 11, 10**power) for b in (simhash._blocks(11, 10**power), simhash._cut(4)))
        assert chosen <= fixed and (power < 9 or chosen < fixed / 4)
