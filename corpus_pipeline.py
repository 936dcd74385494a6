"""The corpus pipeline: five of the training-data operators, one after another.

toxicity -> line dedup -> SimHash near-dedup -> mixing to target weights ->
SentencePiece encoding. Each stage takes what its predecessor kept, as
documents; between stages the rows are written as Parquet and read again, so a
lost executor never sets a later stage back to the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fraudloom.llm import common, lines, mixing, neardup, spm, toxicity
from fraudloom.scratch import OPENED


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labelled documents not held out, scores below the threshold."""
    return toxicity.accept(docs, common.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that came before elsewhere; documents of which nothing is left go, those that had no text stay."""
    return lines.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 similar or more): the one with the smallest doc_id."""
    return neardup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document pieces in the numbers that the target weights ask for."""
    return mixing.mix(docs, block=256)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return spm.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what a stage wrote on its way is deleted once its result is written."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, opened = docs, list(OPENED)
        docs = scratch.table(stage(spark, before, sf_dir), name)
        scratch.drop(before)
        for s in [x for x in OPENED if x not in opened]:
            s.remove()
    return docs


#: A trained classifier and pseudorandom draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
