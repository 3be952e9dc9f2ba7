"""Rows that share a doc_id, or have none, or are equal."""

import collections

import pytest
import xxhash

from podium.llm import mixing, substring_dedup
from tests.llm.test_llm import repeated_by_force, rows, sorted_rows

SCHEMA = "doc_id long, text string, source string"


def near_keys():
    """Two different texts of which 31 bits of their hashes agree."""
    seen = {}
    for i in range(1 << 20):
        text = f"{i:07d} " + "one and the same long stretch of words that both of them hold, and a third document too " * 4 * (i % 2)
        key = xxhash.xxh3_64_intdigest(text.encode()) >> 33
        if key in seen and len(seen[key]) != len(text):
            return seen[key], text
        seen[key] = text
    raise AssertionError


@pytest.mark.parametrize("ids", [(1, 2), (5, 5), (None, None)])
def test_texts_of_one_id_are_told_apart(spark, ids):
    a, b = near_keys()
    own = [(ids[0], a), (ids[1], b), (7, max(a, b, key=len)[8:])]
    found = sorted_rows(substring_dedup.dedup(spark.createDataFrame([(i, t, None) for i, t in own], SCHEMA)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(map(repr, ((i, *x) for (i, _), x in zip(own, repeated_by_force([t for _, t in own], 200), strict=True))))


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows_meet_a_target_one_by_one(spark, parts):
    """200 equal rows of 10 words with a target of 1800: 180 of them, or nearly, are taken once; repeat gives as many."""
    own = [(1, "a b c d e f g h i j", "x")] * 200 + [(2, "k l", "y")] * 2
    df = spark.createDataFrame(own, SCHEMA).repartition(parts)
    found = [r for r in rows(mixing.mix(df, share=0.8985)) if r[2] == 2000]
    target = found[0][3]
    taken = sum(r[4] for r in found)
    assert 1700 < target < 1800 and abs(taken - target) <= 10 and len(found) == 200 and {r[4] for r in found} == {0, 10}
    counts = collections.Counter(r[0] for r in mixing.repeat(df, share=0.8985).collect())
    assert counts[1] * 10 == taken
    assert taken == sum(r[4] for r in rows(mixing.mix(df.repartition(3), share=0.8985)) if r[2] == 2000)
    assert mixing.repeat(df).columns == df.columns
