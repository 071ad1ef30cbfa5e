"""Operator 8: fixity audit of WARC replicas with Merkle trees.

Pages become WARC records in archives of ordered offset ranges. A record has its place in an
archive by its id, not by its rank, so that a record that is missing or added leaves all others
where they are. A place's leaf is the SHA-256 of its records' hashes, lengths and numbers of
copies; a node is the SHA-256 of its children's hashes and lengths, and covers their offset
range. Two replicas are compared from the roots down, and only the children of mismatching
nodes are looked at; the records of mismatching places are told apart by their own hashes. All
of it is DataFrame work on (archive, number, length, hash) rows: the records' bytes are hashed
where they are read and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, saved

FAN_OUT = 16
#: Places of an archive, a power of two, and the levels of nodes above them.
PLACES, LEVELS = 1024, 3
#: Archives of the records without an id, which a hash of their address deals out; their numbers begin here.
UNNAMED, FIRST_UNNAMED = 1 << 20, -(1 << 62)


def warc_record(uri: Column, page_id: Column, payload: Column) -> Column:
    """One WARC/1.0 resource record as text; null values count as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, payload: Column | None = None) -> DataFrame:
    """(archive, number, page_id, copies, offset, length, hash) of the records of ``pages`` (page_id, url, html), archive by archive.

    The place is the last ten bits of page_id, the archive the others, a scheme that both replicas
    share; records without an id get both from a hash of their url. Equal records are one row with
    the number of its ``copies``; different records at one place are ordered by hash. ``offset`` is
    where the first copy begins. Other columns, whatever their names, are ignored.
    """
    record = warc_record(F.col("url"), F.col("page_id"), F.col("html") if payload is None else payload)
    at = F.xxhash64("url")
    named = F.col("page_id").isNotNull()
    bits = PLACES.bit_length() - 1
    archive = F.when(named, F.shiftright(F.col("page_id").cast("long"), bits)).otherwise(F.pmod(F.shiftright(at, bits), F.lit(UNNAMED)) + FIRST_UNNAMED)
    number = F.when(named, F.col("page_id").cast("long").bitwiseAND(F.lit(PLACES - 1))).otherwise(at.bitwiseAND(F.lit(PLACES - 1)))
    rows = pages.select("page_id", archive.alias("archive"), number.alias("number"), record.alias("r"))
    hashed = rows.select("archive", "number", "page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("hash"))
    records = hashed.groupBy("archive", "number", "page_id", "length", "hash").agg(F.count("*").alias("copies"))
    order = W.partitionBy("archive").orderBy("number", "page_id", "hash")
    before = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return records.select("archive", "number", "page_id", "copies", before.cast("long").alias("offset"), "length", "hash")


def places(records: DataFrame) -> DataFrame:
    """(archive, number, length, hash): the leaves of the tree, one for each place that has records."""
    inside = F.array_sort(F.collect_list(F.struct("hash", "length", "copies")))
    text = F.array_join(F.transform(inside, lambda c: F.concat_ws(":", c.hash, c.length, c.copies)), ",")
    return records.groupBy("archive", "number").agg(F.sum(F.col("length") * F.col("copies")).alias("length"), F.sha2(text, 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of (archive, number, length, hash) nodes: each ``FAN_OUT`` neighbours make one."""
    gathered = nodes.groupBy("archive", F.expr(f"number div {FAN_OUT}").alias("up")).agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("number", "hash", "length"))).alias("children"))
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c.number, c.hash, c.length)), ",")
    return gathered.select("archive", F.col("up").alias("number"), "length", F.sha2(text, 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """The levels from the places to one node for each archive, (archive, number, length, hash) each."""
    levels = [saved(few(places(records)))]
    for _ in range(LEVELS):
        levels.append(saved(few(parents(levels[-1]))))
    return levels


def mismatches(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(archive, number) of the places that differ or stand in one replica only; of each level only the children of mismatching nodes are compared."""
    bad = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        y = y.select("archive", "number", F.col("length").alias("length_b"), F.col("hash").alias("hash_b"))
        if bad is not None:
            up = bad.select("archive", F.col("number").alias("up"))
            x, y = (z.withColumn("up", F.expr(f"number div {FAN_OUT}")).join(up, ["archive", "up"], "left_semi").drop("up") for z in (x, y))
        both = x.join(y, ["archive", "number"], "full")
        bad = saved(few(both.where("not (hash <=> hash_b and length <=> length_b)").select("archive", "number")))
    return bad


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """The records of ``original`` with status: intact, corrupt (the replica has another record, or another number of copies, at that place) or missing.

    Both are tables of ``leaves``. What the replica has at a place where nothing of the original is
    missing are rows of status surplus, without an offset (null).
    """
    original, replica = saved(few(original)), saved(few(replica))
    bad = mismatches(tree(original), tree(replica))
    key = ["archive", "number", "length", "hash", "copies"]
    own, other = (x.join(bad, ["archive", "number"], "left_semi") for x in (original, replica))
    lost = own.join(other, key, "left_anti").withColumn("lost", F.lit(True)).select(*key, "page_id", "lost")
    new = other.join(own, key, "left_anti")
    at = ["archive", "number"]
    changed = new.select(*at).distinct().withColumn("changed", F.lit(True))
    found = original.join(lost.drop("page_id").distinct(), key, "left").join(changed, at, "left")
    status = F.when(F.col("lost").isNull(), "intact").when(F.col("changed").isNotNull(), "corrupt").otherwise("missing")
    surplus = new.join(lost.select(*at).distinct(), at, "left_anti")
    columns = ["archive", "number", "page_id", "copies", "offset", "length", "hash"]
    return found.select(*columns, status.alias("status")).union(surplus.withColumn("offset", F.lit(None).cast("long")).select(*columns, F.lit("surplus")))


ORACLE = """
WITH r AS (
  SELECT page_id, page_id // 1024 AS archive, html, coalesce(html, '') AS body,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
l AS (SELECT page_id, archive, page_id % 1024 AS number, strlen(rec) AS length, sha256(rec) AS hash, html FROM r)
SELECT archive, number, page_id, 1::BIGINT AS copies, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, hash,
  CASE WHEN page_id % 97 = 5 AND substring(html, 1, 3) <> reverse(substring(html, 1, 3)) THEN 'corrupt' ELSE 'intact' END AS status
FROM l WINDOW w AS (PARTITION BY archive ORDER BY number)
"""
