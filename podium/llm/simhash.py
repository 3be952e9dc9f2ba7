"""SimHash fingerprints of documents and the search within a Hamming radius, in DataFrame functions alone.

A document's terms are its pairs of neighbouring words (the first word and the last also pair with the edge); a term weighs as often as it
occurs. Each term's 64-bit hash votes on every bit, and a bit is set where the votes for it outweigh those against it. Votes
are counted two bits to a long, in generated code, with partial sums before the shuffle.

Search: the 64 bits are cut into `blocks` of neighbouring bits. Two fingerprints that differ in at most `radius` bits differ in at most
radius // blocks bits of some block, so each block is a table: a fingerprint stands there once, by that block's bits, and a query, of which
there are fewer, asks for all keys within that many bits of its own. All pairs are found, each one in its first such block only.
Equal fingerprints are one row with a count, so groups of copies are never paired.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import materialise

SPACE = r"[\x20\x09-\x0D]+"
BITS = 64
#: Documents in a run of neighbouring ids, at most so many runs, and quantiles between which ids are cut evenly.
RUN, MOST_RUNS, QUANTILES = 1_000, 1_000_000, 128
#: Bits within which near copies are searched: 97 % of edited copies with a five-word Jaccard similarity of 0.8 or more (README).
RADIUS = 11
#: Keys of a block are asked for within so many bits at most.
FLIPS = 2


def with_fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """Rows of df's keys, which are different in every row, with a long of 64 bits for each text: texts maps its name to the text's column.

    No text is null; one without words has the one term of both edges. Where df is dealt by some of the keys, nothing is shuffled.
    """
    half = BITS // 2
    words = lambda t: F.concat(F.array(F.lit("")), F.filter(F.split(F.col(t), SPACE, -1), lambda w: w != ""), F.array(F.lit("")))
    each = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), words(t).alias("w")) for k, t in texts.items()))).alias("t")).select(*keys, "t.name", "t.w")
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i)))
    votes = each.select(*keys, "name", F.explode(hashes).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned(F.col("h"), j).bitwiseAND(1 << half | 1)).alias(f"v{j}") for j in range(half)]
    sums = votes.groupBy(*keys, "name").agg(F.count("*").alias("n"), *lanes)
    ones = [(F.col(f"v{j}").bitwiseAND((1 << half) - 1), j) for j in range(half)] + [(F.shiftrightunsigned(F.col(f"v{j}"), half), j + half) for j in range(half)]
    bits = [F.when(v * 2 > F.col("n"), F.lit((1 << j) - (1 << BITS if j == BITS - 1 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for v, j in ones]
    fp = F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    return sums.select(*keys, "name", fp.alias("fp")).groupBy(*keys).agg(*(F.max(F.when(F.col("name") == k, F.col("fp"))).alias(k) for k in texts))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)).cast("double") / BITS


def text_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def in_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, run, at, ahead, next_text: all documents in runs of neighbouring ids, each with the text of the next one.

    The order is by doc_id, null first, ties by text; after the last document comes the first. A run ends with the head of the next
    run as an additional row (ahead is true). Ids are cut into runs at quantiles and evenly between them; run and at tell every row
    from the others.
    """
    n, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    runs = min(MOST_RUNS, max(1, n // RUN))
    cells = min(QUANTILES, runs)
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / cells for i in range(1, cells)], 0.25 / cells)}) if cells > 1 else []
    each = -(-runs // (len(cuts) + 1))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    run = F.lit(0)
    if cuts:  # how many cuts are at most the id, found by halving; then even steps up to the next cut
        edges = [float(low), *map(float, cuts), float(high) + 1]
        at = F.array(*(F.lit(c).cast("long") for c in cuts))
        cell = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b")), lambda s, _: _halve(s, at, F.col("key")), lambda s: s["a"])
        steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(max(b - a, 1.0)).alias("w")) for a, b in zip(edges, edges[1:], strict=False)))
        step = F.floor((F.col("key").cast("double") - F.get(steps, F.col("cell"))["a"]) * each / F.get(steps, F.col("cell"))["w"])
        run = F.col("cell") * each + F.least(F.greatest(step, F.lit(0)), F.lit(each - 1))
    else:
        cell = F.lit(0)
    parted = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("key")).withColumn("cell", cell).withColumn("run", run.cast("int")).drop("cell")
    heads = parted.groupBy("run").agg(F.min("key").alias("key"))  # at most MOST_RUNS rows
    order = Window.orderBy("run")
    heads = heads.select("key", F.coalesce(F.lag("run").over(order), F.max("run").over(Window.partitionBy())).alias("before"))
    more = parted.join(F.broadcast(heads), "key").select("doc_id", "text", "key", F.col("before").alias("run"), F.lit(True).alias("ahead"))
    own = Window.partitionBy("run").orderBy("ahead", "key", "text")
    both = parted.select("doc_id", "text", "key", "run", F.lit(False).alias("ahead")).unionByName(more)
    return both.withColumn("at", F.row_number().over(own)).withColumn("next_text", F.lead("text").over(own)).drop("key")


def _halve(s: Column, at: Column, x: Column) -> Column:
    """One step of the search for how many cuts are at most x."""
    mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
    right = (s["a"] < s["b"]) & (F.get(at, mid) <= x)
    return F.struct(F.when(right, mid + 1).otherwise(s["a"]).alias("a"), F.when(right | (s["a"] >= s["b"]), s["b"]).otherwise(mid).alias("b"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp of every document.

    The edited text has its last n_chars // 4 code points replaced by the first as many (or all) of the next document. A null text is
    empty; equal rows are told apart by their place. An only document is its own next one; an empty table gives no rows.
    """
    rows = in_runs(docs)
    n = F.length("text").cast("long")
    new = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), F.floor(n / 4).cast("int")))
    rows = rows.select("run", "at", "ahead", "doc_id", n.alias("n_chars"), "text", new.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["run", "at", "ahead", "doc_id", "n_chars", "edited_sha256"]
    done = with_fingerprints(rows, keys, {"fp": "text", "edited_fp": "edited"})
    done = done.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("run").orderBy("at")))
    return done.filter(~F.col("ahead")).drop("run", "at", "ahead")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _long(x: int) -> str:
    """As SQL writes it: the least one has no literal of its own."""
    return f"{x}L" if x > -(1 << (BITS - 1)) else f"(-{(1 << (BITS - 1)) - 1}L - 1L)"


#: Keys of a question, which stand in the plan as one constant.
MOST_KEYS = 10_000


def _cut(n: int) -> list[list[int]]:
    """The bits of n blocks."""
    return [list(range(BITS * i // n, BITS * (i + 1) // n)) for i in range(n)]


def _flipped(block: list[int], flips: int) -> int:
    """How many keys a question asks for in a block's table."""
    return sum(comb(len(block), k) for k in range(flips + 1))


def cost(blocks: list[list[int]], radius: int, n: int) -> float:
    """Keys and candidates of a question among n fingerprints, if their bits are as good as random."""
    return sum(_flipped(b, radius // len(blocks)) * (1 + n / 2 ** len(b)) for b in blocks)


def _blocks(radius: int, n: int) -> list[list[int]]:
    """The bits of each block, one of which differs in at most radius // blocks bits: of at least two blocks, and at most so many that this is FLIPS, as
    many as ask for least among n fingerprints, of those with MOST_KEYS keys at most. So keys grow longer with the number of fingerprints; the pairs
    found are the same."""
    most = max(2, radius // (FLIPS + 1) + 1)
    ways = [_cut(m) for m in range(2, most + 1)]
    few = [x for x in ways if sum(_flipped(b, radius // len(x)) for b in x) <= MOST_KEYS] or ways[-1:]
    return min(few, key=lambda blocks: cost(blocks, radius, n))


def _pairs(asked: DataFrame, there: DataFrame, radius: int, n: int | None = None) -> DataFrame:
    """query, bits and the columns of there: each pair of a query and a fingerprint (column fp) within the radius once, where neither side repeats one.
    n: about how many fingerprints there are; else they are counted."""
    blocks = _blocks(radius, there.count() if n is None else n)
    flips = radius // len(blocks)
    masks = [_signed(sum(1 << b for b in block)) for block in blocks]
    place = lambda t, m, keep: f"named_struct('table', {t}, 'm', {_long(m)}, 'keep', {_long(keep)})"
    listed = lambda places: F.expr(f"array({', '.join(places)})")  # noqa: E731  one constant, however long
    asks = listed(place(t, _signed(sum(1 << b for b in c)), masks[t]) for t, block in enumerate(blocks) for k in range(flips + 1) for c in combinations(block, k))
    stands = listed(place(t, 0, keep) for t, keep in enumerate(masks))
    key = lambda fp: F.col(fp).bitwiseXOR(F.col("_t.m")).bitwiseAND(F.col("_t.keep")).alias("_key")
    a = asked.select("query", F.explode(asks).alias("_t")).select("query", F.col("_t.table").alias("_table"), key("query"))
    b = there.select("*", F.explode(stands).alias("_t")).select(*there.columns, F.col("_t.table").alias("_table"), key("fp"))
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    fine = F.bit_count(differ) <= radius
    for t, mask in enumerate(masks[:-1]):
        fine &= (F.col("_table") <= t) | (F.bit_count(differ.bitwiseAND(F.lit(mask).cast("long"))) > flips)
    # Spark takes the keys asked for to be as few as the queries, and would broadcast them
    return a.hint("merge").join(b, ["_table", "_key"]).filter(fine).select("query", *there.columns, F.bit_count(differ).alias("bits"))


def near(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query, fp, bits: all pairs of a query's fingerprint (column fp) and a fingerprint of fps (column fp) within the radius, each once."""
    return _pairs(queries.select(F.col("fp").alias("query")).distinct(), fps.select("fp").distinct(), radius)


def report(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """Every document's fingerprints and likenesses; n_near, for documents whose id is divisible by `every` (else null), counts the
    other documents whose fingerprints are within the radius.

    A null text is empty; a text without words has the fingerprint of the edges' one term. Equal texts have equal fingerprints and count each
    other; equal rows follow each other in an order of their own; a null doc_id comes first and asks nothing. An only document is its own
    next one. An empty table gives no rows; other columns are ignored.
    """
    rows = materialise(edited(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "fingerprints")
    asked = rows.filter(F.col("doc_id") % every == 0)
    counts = rows.groupBy("fp").agg(F.count("*").alias("n"))
    found = _pairs(asked.select(F.col("fp").alias("query")).distinct(), counts, radius, rows.count()).groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    out = rows.join(found.select(F.col("query").alias("fp"), "n_near"), "fp", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"),
    )
