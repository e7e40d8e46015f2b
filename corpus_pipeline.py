"""The corpus pipeline: from raw documents to pieces. Each stage works on all that its predecessor kept.

It is part of the subpackage `llm` and can't be imported without it. Stages take tables of any
columns that hold doc_id and text, with nulls, repeated rows and ids, and names of the operators'
own; all but the last return the columns they were given. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphion.llm import decontaminate, ecoc_language, jaccard_join, line_dedup, sentencepiece_viterbi
from glyphion.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null texts and those without a letter go; rows are judged one by one."""
    return ecoc_language.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less lines that an earlier document holds; n_chars follows where there is one. Every row stays, and null texts stay null."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, that of the least id; texts without words stay, as do different texts of one id."""
    return jaccard_join.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null texts have none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text's pieces, their number, and whether they decode to the text. Null texts have no pieces."""
    v = sentencepiece_viterbi.vocabulary()
    out = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs.select("doc_id", "text"), v), v)
    return out.select("doc_id", F.col("_ids").alias("ids"), F.size("_ids").cast("long").alias("n_pieces"), F.col("_text").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", pieces),
]

#: Language ID, near duplicates and encoding can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch()
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.durable(docs)
            scratch.drop(before)
    return docs
