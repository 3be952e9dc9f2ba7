"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from podium.llm import divergence, hard_negatives, line_dedup, rules
from podium.llm.common import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.substring_dedup import dedup

    return dedup(read_table(spark, sf_dir, "documents"), length=200)


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.licenses import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3, share=1.0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.quality import score

    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.3)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.rules import judge

    return judge(read_table(spark, sf_dir, "documents"))


def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.simhash import RADIUS, report

    return report(read_table(spark, sf_dir, "documents"), radius=RADIUS, every=50)


def op8_private_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.pii import key_of, report

    return report(read_table(spark, sf_dir, "documents"), key_of(spark))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.token_files import read, write

    return read(write(read_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, kind="byte"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.ngram_join import join

    return join(read_table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(read_table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"), least=40, copies=5)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"), least=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_repeated_bytes": op2_repeated_bytes,
    "op3_license_notices": op3_license_notices,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_fingerprints": op7_simhash_fingerprints,
    "op8_private_pseudonyms": op8_private_pseudonyms,
    "op9_token_files": op9_token_files,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": rules.sql(),
    "op11_hard_negatives": hard_negatives.sql(),
    "op12_line_dedup": line_dedup.sql(),
    "op13_source_divergence": divergence.sql(),
}
