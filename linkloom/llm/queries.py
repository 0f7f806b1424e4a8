"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import bpe, exact_dedup, jaccard_join, mixing, pii, quality, sharding, spelling, suffix_dedup, token_alignment, token_files, toxicity, warc
from linkloom.llm.common import documents, table
from linkloom.session import scratch_path

END_ID = 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir), width=4, percent=85)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), path, END_ID)
    return token_files.read_tokens(spark, path)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(documents(spark, sf_dir)))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir), keep_text=False)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved_pages(spark, sf_dir)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.adaptive_rules(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_files": op4_token_files,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_align": op11_align,
    "op12_sharding": op12_sharding,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op8_warc_revisits": warc.ORACLE,
}
