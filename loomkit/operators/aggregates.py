"""Job reports, modes, ordered lists and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import running_sum, total


def clamp_counters(df: DataFrame) -> DataFrame:
    """``df`` (total, processed, success) with processed at most total and success at most processed."""
    return df.withColumn("processed", F.least("processed", "total")).withColumn("success", F.least("success", "processed"))


def job_status(jobs: DataFrame) -> DataFrame:
    """(batch_id, total, processed, success, failed, percentage) of jobs (batch_id, status: success, failed or pending)."""
    out = jobs.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("success", "failed")).alias("processed"),
        F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("percentage", F.when(F.col("total") == 0, 0).otherwise(F.floor(F.col("processed") / F.col("total") * 100)).cast("int"))


def failure_report(jobs: DataFrame) -> DataFrame:
    """(batch_id, line): one line for each failed file."""
    return jobs.where("status = 'failed'").select("batch_id", F.format_string("%s: %s", "file", "reason").alias("line"))


def failure_lists(jobs: DataFrame) -> DataFrame:
    """(batch_id, lines): the lines of each batch's failures in the order of their ts and file; jobs also have ts."""
    lines = F.array_sort(F.collect_list(F.struct("ts", "file", F.format_string("%s: %s", "file", "reason").alias("line"))))
    return jobs.where("status = 'failed'").groupBy("batch_id").agg(F.transform(lines, lambda x: x.line).alias("lines"))


def bucket_mode(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, low, high, n): the fullest bucket of ``size`` values for each key, the lowest of equals."""
    counts = df.groupBy(key, (F.floor(F.col(value) / size) * size).alias("low")).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max_by(F.struct("low", "n"), F.struct("n", -F.col("low"))).alias("b"))
    return best.select(key, F.col("b.low").alias("low"), (F.col("b.low") + size).alias("high"), F.col("b.n").alias("n"))


def ordered_distinct_concat(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, joined): the distinct texts joined by newlines, in the order of their first place."""
    first = df.where(F.col(text).isNotNull()).groupBy(group, text).agg(F.min(order).alias("at"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda x: x[text])
    return first.groupBy(group).agg(F.array_join(rows, "\n").alias("joined"))


def palette_rank(colors: DataFrame) -> DataFrame:
    """(image_id, rank, pos, r, g, b): the colours that may stand for an image, the most colourful first, of palettes (image_id, pos, r, g, b).

    Bright colours are taken down. Then grays and pure reds go, in the order of their places, until two
    colours are left; of the first five that stay, equally colourful ones are ranked by place. A
    palette of which nothing stays, or that has a colour with a null part, gives the default (24, 24, 24), without a place.
    """
    from ..functions.color import adjust_brightness, colorfulness, hsv_to_rgb, rgb_to_hsv

    image, ahead = W.partitionBy("image_id"), W.partitionBy("image_id").orderBy("pos", "r", "g", "b")
    dimmed = colors.select("image_id", "pos", "r", "g", "b").withColumn("c", adjust_brightness(rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))))
    dimmed = dimmed.withColumn("c", hsv_to_rgb(F.col("c.h"), F.col("c.s"), F.col("c.v")))
    r, g, b = (F.col(f"c.{x}") for x in "rgb")
    # A hue of no degree: green and blue are equal, and red is no less.
    plain = (g == b) & (r >= g)
    gone = plain & (F.count_if(plain).over(ahead.rowsBetween(W.unboundedPreceding, 0)) <= F.greatest(F.count("*").over(image) - 2, F.lit(1)))
    bad = F.bool_or(F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull()).over(image)
    left = dimmed.withColumn("gone", gone | bad).withColumn("place", F.count_if(~F.col("gone")).over(ahead.rowsBetween(W.unboundedPreceding, 0)))
    # Of a palette with nothing left its first row becomes the default.
    none = F.count_if(~F.col("gone")).over(image) == 0
    left = left.withColumn("none", none & (F.row_number().over(ahead) == 1)).where((~F.col("gone") & (F.col("place") <= 5)) | F.col("none"))
    value = lambda x: F.when(F.col("none"), 24).otherwise(x)
    best = W.partitionBy("image_id").orderBy(F.desc(F.round(colorfulness(r, g, b), 9)), "place")
    return left.select("image_id", F.row_number().over(best).alias("rank"), F.when(~F.col("none"), F.col("pos")).alias("pos"), value(r).alias("r"), value(g).alias("g"), value(b).alias("b"))


def budget_need(items: DataFrame, group: str, size: str, spacing: int) -> DataFrame:
    return items.groupBy(group).agg((F.sum(size) + spacing * F.greatest(F.count("*") - 1, F.lit(0))).alias("need"))


def fit_budget_tail(items: DataFrame, budget: int, elide: int) -> DataFrame:
    """``items`` (group_id, pos, size) with shown: all if they fit, else the last and as many before it as fit beside the mark.

    Items in ``ranges.ranged`` ranges are added up by range first, and so no task holds all of a group; that goes for the other budget too.
    """
    of = lambda df, value, name: running_sum(df, "group_id", ["pos"], value, name, descending=True)
    out = of(of(total(items, "group_id", F.col("size"), "_all"), F.col("size"), "_used"), F.lit(1), "_place")
    return out.withColumn("shown", (F.col("_all") <= budget) | (F.col("_place") == 1) | (F.col("_used") + elide <= budget)).drop("_all", "_used", "_place")


def fit_budget_head(items: DataFrame, budget: int, more: int, spacing: int, hidden: bool = False) -> DataFrame:
    """``items`` (group_id, pos, size) with shown: all if they fit, else as many from the front as fit beside the button, which no spacing parts from them.

    Where there are ``hidden`` entries besides, the button counts as one more item of those that must fit.
    """
    of = lambda df, value, name: running_sum(df, "group_id", ["pos"], value, name)
    # Each item brings a spacing; the first of all has none before it.
    wide = F.col("size") + spacing
    out = of(total(items, "group_id", wide, "_all"), wide, "_used")
    need = F.col("_all") - spacing + (more + spacing if hidden else 0)
    return out.withColumn("shown", (need <= budget) | (F.col("_used") - spacing + more <= budget)).drop("_all", "_used")
