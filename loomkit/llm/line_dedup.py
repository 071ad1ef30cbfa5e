"""Operator 9: removal of lines that spread over many sites.

A line's spread is its number of distinct sites. HyperLogLog sketches, one per line hash, are
merged by aggregation; only lines whose estimate lies near the threshold are counted exactly.
A line at or above the threshold is boilerplate: its first occurrence in the corpus stays
and all others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, saved

LEAST_SITES = 3
LG_K = 10
SALTS = 16
#: Four standard errors of a sketch of 2^LG_K registers, and never less than one site.
MARGIN = 4 * 1.04 / 2 ** (LG_K / 2)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, site, pos, h) of every line that is not blank; blanks around a line don't count, and a null source is one site."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("whole"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where("trim(line) != ''").select("doc_id", "whole", "site", "pos", F.xxhash64(F.trim("line")).alias("h"))


def boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """(h, first): the hash of each line on at least ``least_sites`` sites, and the (doc_id, pos) that stays, the least."""
    lines = _lines(docs)
    margin = max(1, round(least_sites * MARGIN))
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"))
    likely = saved(few(sketched.select("h", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= least_sites - margin)))
    near = likely.where(F.col("sites") <= least_sites + margin).select("h")
    # A line's sites are told apart where they are read, so that a frequent line brings a row for each site and task at most.
    exact = lines.select("h", "site").distinct().join(near, "h", "left_semi").groupBy("h").agg(F.count("*").alias("exact"))
    return likely.join(exact, "h", "left").where(F.coalesce("exact", "sites") >= least_sites).select("h", "first")


def dedup_lines(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) with boilerplate lines taken from ``text``, and lines_total, lines_removed.

    A row in, a row out: a text may become shorter or empty, but no document goes. Null texts
    stay null with no lines; blank lines are never removed. Repeated rows are one document, so
    what stays in one stays in all; a null doc_id counts as the least. Whole texts count, however
    many lines they have. Columns named lines_total or lines_removed are replaced, others may have any name.
    """
    bad = saved(few(boilerplate(docs, least_sites)))
    # A common line meets its entry in SALTS places, by where it stands, so that exact copies part as well; copies of the entries are dealt out, not sent to every task.
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    drops = (
        _lines(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(bad.withColumn("salt", salt).hint("shuffle_hash"), ["h", "salt"])
        .where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "whole").agg(F.collect_set("pos").alias("drops"))
        .select(F.col("doc_id").alias("drop_id"), F.col("whole").alias("drop_whole"), "drops"))
    others = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("d"))
    at = F.col("d.doc_id").eqNullSafe(F.col("drop_id")) & (F.xxhash64("d.text") == F.col("drop_whole"))
    joined = packed.join(drops.hint("shuffle_hash"), at, "left").withColumn("lines", F.split("d.text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in others], count("lines").alias("lines_total"), count("drops").alias("lines_removed"))


ORACLE = """
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut),
k AS (SELECT doc_id, site, pos, line, trim(line, ' ') AS line_key FROM l),
bad AS (SELECT line_key, min(doc_id * 10000000 + pos) AS first FROM k WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT site) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, bad.line_key IS NOT NULL AND k.doc_id * 10000000 + k.pos <> bad.first AS gone FROM k LEFT JOIN bad ON k.line_key = bad.line_key),
built AS (SELECT doc_id, count(*) AS lines_total, count(*) FILTER (gone) AS lines_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.lines_total, 0) AS lines_total, coalesce(b.lines_removed, 0) AS lines_removed, md5(b.kept) AS text_md5
FROM documents d LEFT JOIN built b ON d.doc_id = b.doc_id
"""
