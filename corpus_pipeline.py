"""The corpus pipeline: quality rules, n-gram Jaccard join, pseudonyms, mixing of sources, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents, further ones too, whatever their names. An empty table gives an empty one. Null and empty
texts have no words: quality_rules drops them; the later stages, each by itself, keep them (near_duplicates links them with nothing,
pseudonyms leaves them as they are, source_mix takes them once, best_fit_packing packs their end id). Equal rows are treated alike, but source_mix takes them one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import mixing, ngram_join, packing, pii, rules
from podium.llm.common import discard, materialise, read_table
from podium.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id's. Rows with equal doc_id and text stay or go together."""
    return ngram_join.keep_first(docs, size=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced; n_chars follows the new text."""
    return pii.pseudonymise(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times)."""
    return mixing.repeat(docs, weights=(1, 2, 3), most=3, share=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]
#: SQL expresses neither the mix (a 64-bit hash that it lacks) nor the packing (ids of a tokenizer).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
