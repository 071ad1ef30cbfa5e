"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, hard_negatives, jaccard_join, language_id, lexical_search, line_dedup, mixing, pii, quality, sentencepieces, toxicity, warc_fixity
from .common import fold, saved, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = fold(F.col("doc_id"), 4) == 2
    profiles = language_id.learn_profiles(docs.where(~out))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = saved(quality.describe(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = toxicity.training_labels(table(spark, sf_dir, "labels").select("doc_id", "quality"))
    model = quality.fit(described.join(labels, "doc_id"), "quality")
    scored = quality.score(described, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a replica in which every record whose page_id mod 97 is 5 has rotted: its first three characters read backwards, which leaves it intact if they are the same."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotted = F.when(F.col("page_id") % 97 == 5, F.concat(F.reverse(F.substring("html", 1, 3)), F.substring("html", 4, 1 << 30))).otherwise(F.col("html"))
    return warc_fixity.audit(warc_fixity.leaves(pages), warc_fixity.leaves(pages, rotted))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", F.col("lines_total").cast("long"), F.col("lines_removed").cast("long"), F.md5("text").alias("text_md5"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return sentencepieces.digest(encoded, model)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    vectors = table(spark, sf_dir, "embeddings").where(hard_negatives.usable(F.col("embedding")))
    rows = vectors.select("vec_id", moved.alias("label"), hard_negatives.whole_parts(F.col("embedding")).alias("parts"), (F.col("vec_id") % 100 == 0).alias("is_anchor"))
    return hard_negatives.mine(rows)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = lexical_search.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search.search(index, n_docs, table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_fingerprints, op3_language_id, op4_quality, op5_decontaminate,
    op6_toxicity, op7_mixing, op8_warc_fixity, op9_line_dedup, op10_pii, op11_sentencepiece, op12_hard_negatives, op13_lexical_search)}

ORACLE_SQL = {"op8_warc_fixity": warc_fixity.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE,
              "op13_lexical_search": lexical_search.ORACLE}
