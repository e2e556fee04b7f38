"""Document pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet and read again as the
next stage's documents. All but the last return the columns of `documents`. The near-duplicate and decontamination
stages compare what the earlier ones left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm.common import read_table, stored
from logtide.llm.decontaminate import drop_contaminated
from logtide.llm.jaccard import keep_one_of_similar
from logtide.llm.line_dedup import drop_repeated_lines
from logtide.llm.queries import tokenizer_file
from logtide.llm.sentencepiece_bpe import encode_documents
from logtide.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactually regularised classifier does not reject."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of three lines, or fewer long ones, that an earlier document or line has."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have similarity 0.8 or more."""
    return keep_one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded): piece ids of each text and the text they stand for."""
    return encode_documents(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: A fitted classifier and MinHash are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result but the last is written to the shared folder of the session."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
