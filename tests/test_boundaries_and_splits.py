"""Sentence boundaries that are learned, and exact splits."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from podium.operators import evaluate, text

# boundaries

CASES = [
    ("It costs 3.5 dollars. He paid.", ["It costs 3.5 dollars.", "He paid."]),
    ("See e.g. the sun. Dr. Smith and J. R. Doe came! Why? etc. follows.", ["See e.g. the sun.", "Dr. Smith and J. R. Doe came!", "Why? etc. follows."]),
    ('He said "Stop." Then he left. (It was late.) Go', ['He said "Stop."', "Then he left.", "(It was late.)", "Go"]),
    ("Visit www.example.com now. mail a.b@c.org.", ["Visit www.example.com now. mail a.b@c.org."]),
    ("1. First point. 2. Second point.", ["1. First point.", "2. Second point."]),
    ("A title\n\nA text of it. More.", ["A title", "A text of it.", "More."]),
    ("Approx. Numbers. vs. Others!", ["Approx. Numbers. vs. Others!"]),
    ("", []), (None, []), (" \n ", []), ("...", ["..."]),
]


def test_boundaries_of_a_table_of_cases(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "id int, t string")
    found = defaultdict(list)
    for r in text.learned_sentences(df, "t", ["id"], known=[]).orderBy("id", "sent_idx").collect():
        found[r["id"]].append(r["sentence"])
    assert [found[i] for i in range(len(CASES))] == [want for _, want in CASES]


def learned_by_hand(texts, least):
    n, k = Counter(), Counter()
    for t in texts:
        for w in re.split(r"\s+", t or ""):
            term = re.match(r"^[\"'(\[]*(.*?)\.?[\"')\],;:!?]*$", w).group(1).lower()
            if term:
                n[term] += 1
                k[term] += bool(re.search(r"\.[\"')\],;:!?]*$", w))
    rate = sum(k.values()) / sum(n.values())
    out = {}
    for term in n:
        if k[term] and re.fullmatch(r"[^\W\d_.]*(?:\.*[^\W\d_]+\.*)*", term) and re.search(r"[^\W\d_]", term):
            a, b = k[term], n[term] - k[term]
            letters = len(term) - term.count(".")
            out[term] = round(2 * (a * math.log(0.99) + b * math.log(0.01) - a * math.log(rate) - b * math.log(1 - rate)) * math.exp(-letters) * (term.count(".") + 1) * letters**-b, 6)
    return {t: s for t, s in out.items() if s >= least}


def test_abbreviations_are_learned(spark):
    rng = random.Random(1)
    words = ["sun", "moon", "river", "tree", "house", "light", "stone", "water"]
    texts = [" ".join(rng.choice(["Cpt. Brown", "the u.s.a. team", "ca. ten"] + words * 2) for _ in range(12)) + f" {rng.choice(words)}. " for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "id int, t string")
    found = {r["term"]: round(r["score"], 6) for r in text.abbreviations(df, "t").collect()}
    assert found == pytest.approx(learned_by_hand(texts, text.ABBREVIATION_SCORE), abs=2e-6) and {"cpt", "u.s.a", "ca"} <= set(found) and not set(words) & set(found)
    one = spark.createDataFrame([(1, "Cpt. Brown saw the U.S.A. Team. The moon.")], "id int, t string")
    assert [r["sentence"] for r in text.learned_sentences(one, "t", ["id"], list(found)).collect()] == ["Cpt. Brown saw the U.S.A. Team.", "The moon."]


def test_long_texts_take_linear_time(spark):
    """30,000 sentences of one text: pieces are not made anew for each of them."""
    df = spark.createDataFrame([(1, "Mr. Sun shines on all. " * 30_000)], "id int, t string")
    assert text.learned_sentences(df, "t", ["id"], []).count() == 30_000


# splits


def split_by_force(rows, take, wanted):
    count = Counter(rows)
    groups, kinds = sorted({g for g, _ in rows}), sorted({c for _, c in rows})
    total = {c: sum(count[g, c] for g in groups) for c in kinds}
    return min((round(sum(abs(sum(count[g, c] for g in gs) / total[c] - wanted) for c in kinds) / len(kinds), 9), list(gs)) for gs in combinations(groups, take))


@pytest.mark.parametrize(("n", "take", "kinds", "parts"), [(24, 6, 3, 8), (9, 1, 2, 3), (9, 2, 2, 4), (10, 10, 2, 2), (12, 5, 1, 40)])
def test_best_split_by_force(spark, n, take, kinds, parts):
    rng = random.Random(n + take)
    rows = [(f"g{rng.randrange(n):02d}", f"k{rng.randrange(kinds)}") for _ in range(600)] + [(f"g{i:02d}", "k0") for i in range(n)]
    best = evaluate.best_split(spark.createDataFrame(rows, "g string, c string"), "g", "c", take, 0.25, parts).first()
    deviation, groups = split_by_force(rows, take, 0.25)
    assert (best["groups"], best["proven"]) == (groups, True) and best["deviation"] == pytest.approx(deviation, abs=2e-9)


def test_an_unfinished_search_is_not_proven(spark):
    rng = random.Random(0)
    rows = [(f"g{rng.randrange(30):02d}", f"k{rng.randrange(4)}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, c string")
    best = evaluate.best_split(df, "g", "c", 8, 0.25, parts=2, most=1000).first()
    assert not best["proven"] and len(best["groups"]) == 8
    assert evaluate.best_split(df, "g", "c", 0).count() == 0 and evaluate.best_split(df, "g", "c", 31).count() == 0 and evaluate.best_split(df.limit(0), "g", "c", 1).count() == 0
