"""A training-data pipeline over ``documents``: five stages, each written and read again by the next.

A stage takes and returns the columns of ``documents``, whatever others there are and whatever
they are called; the last returns the mix. Nulls in any column, empty and very long texts,
ties, repeated rows and empty tables have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from loomkit.llm.common import saved, table


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names``, and all others as one, so that what they are called can't matter to an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*(others or [F.lit(0).alias("none")])).alias("others"))


def _unpacked(df: DataFrame, columns: list[str], *names: str) -> list[Column]:
    return [F.col(c) if c in names else F.col(f"others.`{c}`").alias(c) for c in columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7 go; the machine is learned from all labelled rows, for none is held out here.

    A row in, a row out or none; null and empty texts score as a text without terms.
    """
    machine = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(_packed(docs, "doc_id", "text"), machine, keep_text=True)
    return scored.where(F.col("score") < toxicity.TOXIC).select(_unpacked(scored, docs.columns, "doc_id", "text"))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on three sites or more leave every text but the first; n_chars is counted anew where lines went. A row in, a row out."""
    names = ("doc_id", "source", "text")
    cleaned = line_dedup.dedup_lines(_packed(docs, *names))
    out = _unpacked(cleaned, docs.columns, *names)
    n = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long"))
    return cleaned.select([F.coalesce(n, x).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, out, strict=True)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays; texts without words all stay."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each document that it takes, with the number of its copies."""
    return mixing.mix(docs.select("doc_id", "source", "text")).where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_spread_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, sketches and hashed chances have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
