"""Operator 7: mixing sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, its source's target over its source's size.
The whole part is certain; the fractions are rounded in pairs (Deville and Tille 1998;
Srinivasan 2001): of two fractional documents one gains what the other loses, weighted by
their sizes, until one is integral, so that the source's words stay on target and every
document's expectation holds. A tree reduces this: groups of ``GROUP`` documents each leave
at most one fractional document, those form groups again, and the last one of a source is
rounded by itself. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, saved

WEIGHTS, SHARE, MOST_COPIES, GROUP = (3, 1, 2), 1.5, 2.0, 64
SEED = 11
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, null last.

    Sources take the weights in turn, in code point order. Targets share ``share`` of all words by
    weight; one that would exceed ``most`` times its source stops there, and the rest is shared
    again: the common level of target over weight is found from the sources in the order of
    their limits. This table has one row for each source, and its window runs in one task.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy()) * share
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left_words = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", left_words / left_weight).withColumn("pos", F.row_number().over(order))
    # The first source in this order whose limit lies above the level fixes the level of all that follow.
    level = F.coalesce(F.min(F.when(F.col("level") < F.col("ratio"), F.struct("pos", "level"))).over(W.partitionBy())["level"], F.lit(float("inf")))
    return w.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _chance(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on ``cols`` alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 53)) / float(1 << 53)


def _settle(state: Column, x: Column) -> Column:
    """Pivotal rounding of the next document ``x`` against the fractional one that is held (null: none)."""
    h = state.held
    up, down = F.least(1 - h.p, x.p * x.size / h.size), F.least(h.p, (1 - x.p) * x.size / h.size)
    rise = x.u * (up + down) < down
    snap = lambda p: F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)
    hp = snap(F.when(rise, h.p + up).otherwise(h.p - down))
    xp = snap(F.when(rise, x.p - up * h.size / x.size).otherwise(x.p + down * h.size / x.size))
    make = lambda d, p: F.struct(d.id.alias("id"), d.size.alias("size"), p.alias("p"), d.u.alias("u"))
    whole = lambda p: (p == 0) | (p == 1)
    a, b = make(h, hp), make(x, xp)
    settled = F.when(whole(hp) & whole(xp), F.array(a, b)).when(whole(hp), F.array(a)).otherwise(F.array(b))
    none = F.lit(None).cast("struct<id:long,size:double,p:double,u:double>")
    return F.struct(
        F.when(h.isNull(), x).when(~whole(hp), a).when(~whole(xp), b).otherwise(none).alias("held"),
        F.when(h.isNull(), state.done).otherwise(F.concat(state.done, settled)).alias("done"))


def _reduce(rows: DataFrame) -> DataFrame:
    """(source, node, id, p, held): the documents of each node after rounding; held marks the one that is still fractional."""
    struct = "struct<id:long,size:double,p:double,u:double>"
    docs = F.array_sort(F.collect_list(F.struct("id", "size", "p", "u")))
    start = F.struct(F.lit(None).cast(struct).alias("held"), F.array().cast(f"array<{struct}>").alias("done"))
    r = rows.groupBy("source", "node").agg(docs.alias("docs")).select("source", "node", F.aggregate("docs", start, _settle).alias("r"))
    held = F.when(F.col("r.held").isNull(), F.array().cast(f"array<{struct}>")).otherwise(F.array("r.held"))
    out = r.select("source", "node", F.explode(F.concat("r.done", held)).alias("d"))
    return out.select("source", "node", "d.id", "d.size", "d.p", "d.u", ((F.col("d.p") > 0) & (F.col("d.p") < 1)).alias("held"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, source, text).

    ``copies`` is whole, ``taken`` is copies times size. All randomness is a hash of doc_id, so
    reruns agree; of rows that are equal in doc_id, source and size any may be the one that is
    taken more often. Documents without words are taken 0 times; if no document has words all
    targets are 0. A null source is a source of its own, the last. Whole texts are counted, and
    other columns, whatever their names, are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    twin = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("size"))
    sized = saved(sized.withColumn("twin", twin).withColumn("id", F.xxhash64("doc_id", "source", "size", "twin")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    goal = targets(sums.select("source", "source_size"), weights, share, most)
    per_source = saved(few(goal.join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("n") / GROUP).alias("nodes"), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("f"))))
    # Spark broadcasts this table where its size allows, and else splits the hot sources of the join.
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    part = F.col("f") - F.floor("f")
    joined = joined.withColumn("p", F.when((part < EPS) | (F.col("size") == 0), 0.0).when(part > 1 - EPS, 1.0).otherwise(part))
    open_rows = joined.where("p > 0 and p < 1").select(
        "source", F.pmod(F.xxhash64(F.lit(SEED), "id"), "nodes").alias("node"), "id", F.col("size").cast("double").alias("size"), "p", _chance("id", F.lit(0)).alias("u"))
    settled, nodes, level = None, per_source.agg(F.max("nodes")).first()[0] or 0, 0
    while nodes:
        done = saved(few(_reduce(open_rows)))
        level += 1
        last = nodes == 1
        whole = done.where(~F.col("held") | F.lit(last)).select("id", "size", F.when(F.col("held"), (_chance("id", F.lit(-1)) < F.col("p")).cast("double")).otherwise(F.col("p")).alias("extra"))
        settled = whole if settled is None else settled.union(whole)
        open_rows = done.where("held").select("source", F.expr(f"node div {GROUP}").alias("node"), "id", "size", "p", _chance("id", F.lit(level)).alias("u"))
        nodes = 0 if last else -(-nodes // GROUP)
    if settled is None:
        settled = joined.select("id", F.col("size").cast("double").alias("size"), F.lit(0.0).alias("extra")).where("false")
    base = joined.select("doc_id", "source", "size", "source_size", "target", "id", F.floor("f").alias("base"), "p")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + F.when(F.col("p") == 1, 1).otherwise(F.coalesce("extra", F.lit(0.0)))).cast("long")
    settled = settled.withColumnRenamed("id", "settled_id").withColumnRenamed("size", "settled_size")
    out = base.join(settled, (F.col("id") == F.col("settled_id")) & (F.col("size") == F.col("settled_size")), "left").withColumn("copies", copies)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
