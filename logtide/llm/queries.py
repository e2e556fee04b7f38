"""Registered queries of the operators, and their SQL counterparts where SQL can express them.

Every query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import (
    collocations,
    cotraining,
    decontaminate,
    line_crf,
    line_dedup,
    secret_scan,
    sharding,
    simhash,
    suffix_dedup,
    vector_codes,
)
from logtide.llm.common import read_table


def tokenizer_file(name: str = "piece_bpe_32k.model") -> bytes:
    """A public tokenizer file, read where the query is planned; tasks get its bytes."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from logtide.llm.sentencepiece_bpe import encoding_digests

    return encoding_digests(read_table(spark, folder, "documents"), tokenizer_file())


def op2_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_report(read_table(spark, folder, "documents"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup_report(read_table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_report(read_table(spark, folder, "documents"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_report(read_table(spark, folder, "documents"))


def op7_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    return line_crf.quality_report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets_report(read_table(spark, folder, "documents"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontamination_report(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from logtide.llm.toxicity import score_documents

    return score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compression_report(read_table(spark, folder, "embeddings"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocation_report(read_table(spark, folder, "documents"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from logtide.llm.byte_bpe import encoding_digests

    return encoding_digests(read_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_cotraining": op2_cotraining,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_line_crf": op7_line_crf,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
