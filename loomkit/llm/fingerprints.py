"""Operator 2: document fingerprints by one-permutation MinHash, with DataFrame functions only.

The shingles of a text (five words) are hashed once; the top bits of a hash choose one of
``BINS`` bins, and each bin keeps its least hash. An empty bin borrows from a full one chosen
by a universal hash of both (optimal densification, Shrivastava 2017). Of each bin the low
eight bits are kept, as two hexadecimal digits; likeness is the share of equal bins, less
what chance makes equal (Li and Koenig 2010).
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, few, saved

BINS, BIN_BITS, KEPT_BITS = 128, 7, 8
#: Rows of a range: four times the root of their number, but no more than the former and no fewer than the latter.
MOST_ROWS, LEAST_ROWS = 50_000, 2_000


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def _low(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit((1 << KEPT_BITS) - 1))), 2, "0"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` as ``name``: 256 hexadecimal digits.

    Words are lower-cased and stand between white space; fewer than five words make one
    shingle, and a text without words (null, empty, blank) has the empty fingerprint ''.
    """
    w, s, m = f"{name}_words", f"{name}_sorted", f"{name}_least"
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\S+"), F.lit(0)), lambda x: F.xxhash64(x)))
    n, words = F.size(w), F.col(w)
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), lambda i: F.xxhash64(*[words[i + k] for k in range(SHINGLE_WORDS)]))
    df = df.withColumn(s, F.sort_array(F.when(n >= SHINGLE_WORDS, many).otherwise(F.array(F.xxhash64(w)))))
    values = F.col(s)
    df = df.withColumn(m, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(values[F.greatest(i - 1, F.lit(0))]))))
    # The bins in the order of the signed hashes: the upper half of the bins comes first.
    df = df.withColumn(m, F.array_sort(F.transform(m, lambda x: F.struct(_bin(x).alias("bin"), _low(x).alias("low")))))
    least = F.col(m)
    gap = lambda x, i: x.bin - F.when(i == 0, F.lit(0)).otherwise(least[F.greatest(i - 1, F.lit(0))].bin + 1)
    sparse = F.concat(
        F.array_join(F.transform(m, lambda x, i: F.concat(F.repeat(F.lit("--"), gap(x, i).cast("int")), x.low)), ""),
        F.repeat(F.lit("--"), (F.lit(BINS - 1) - F.element_at(m, -1).bin).cast("int")))
    df = df.withColumn(s, sparse)
    cell = lambda b: F.substring(F.col(s), b * 2 + 1, F.lit(2))
    donor = lambda b: F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(b, x.bin).alias("h"), x.low.alias("low")))).low
    dense = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.when(cell(b) == "--", donor(b)).otherwise(cell(b))), "")
    full = F.when(n == 0, "").when(F.instr(s, "--") == 0, F.col(s)).otherwise(dense)
    return df.withColumn(name, full).drop(w, s, m)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the texts of two fingerprints, 0 to 1; two texts without words are alike, one is like no other."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.substring(a, k * 2 + 1, F.lit(2)) == F.substring(b, k * 2 + 1, F.lit(2)))) / F.lit(float(BINS))
    chance = 2.0**-KEPT_BITS
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


def _count_below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, found in two steps so that a row looks at few of them."""
    step = max(1, math.isqrt(len(cuts)))
    parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    part = F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts]), lambda c: c <= value))
    inside = F.filter(F.array(*[F.array(*[F.lit(c) for c in p]) for p in parts])[F.greatest(part - 1, F.lit(0))], lambda c: c <= value)
    return F.greatest(part - 1, F.lit(0)) * step + F.size(inside)


def _places(docs: DataFrame, order: Column) -> tuple[Column, Column]:
    """(range, part of it) of a row: ranges of doc_id of about equal numbers of rows; a doc_id that would fill several is parted by ``order``."""
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, math.ceil(n / min(MOST_ROWS, max(LEAST_ROWS, 4 * math.isqrt(n)))))
    cuts = [] if ranges == 1 else docs.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    hot = {v: c for v, c in Counter(cuts).items() if c > 1}
    place = _count_below(F.col("doc_id"), sorted(set(cuts))) if cuts else F.lit(0)
    parts = F.element_at(F.create_map(*[F.lit(x) for item in sorted(hot.items()) for x in item]), F.col("doc_id")) if hot else F.lit(None).cast("int")
    parts = F.when(F.col("doc_id").isNull(), max(1, ranges * nulls // max(1, n))).otherwise(F.coalesce(parts, F.lit(1)))
    # The rows of a hot doc_id stand at the start of their range, those behind it in one more part.
    hot_part = F.least(F.floor((order / F.lit(2.0**64) + 0.5) * parts), parts - 1).cast("int")
    rest = F.lit(max(hot.values(), default=0) + 1)
    return F.when(F.col("doc_id").isNull(), -1).otherwise(place), F.when(F.col("doc_id").isNull() | (parts > 1), hot_part).otherwise(rest)


def with_next(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` (doc_id and ``text``) with the fingerprint ``name``, and next_<text> and next_<name> of the next row by doc_id; the last row's next is the first.

    Nulls come first, rows with one doc_id are ordered by their text's hash. The rows are
    dealt into ranges by doc_id, as many as they need, and each range is ordered by itself; the
    first row of the next range is added to its end.
    """
    order = F.xxhash64(text)
    p, q = _places(docs, order)
    docs = docs.select("doc_id", text, F.struct(p.alias("p"), q.alias("q")).alias("place"))
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", order.alias("order"))
    heads = docs.groupBy("place").agg(F.min(key).alias("head"))
    before = F.coalesce(F.lag("place").over(W.orderBy("place")), F.max("place").over(W.partitionBy()))
    # One row for each range.
    heads = saved(few(heads.select(F.col("place").alias("at"), before.alias("before"), F.col("head.doc_id").alias("head_id"), F.col("head.order").alias("head_order"))))
    extra = docs.join(heads, (F.col("place") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (order == F.col("head_order")))
    extra = extra.groupBy("at", "before", "doc_id").agg(F.min(text).alias(text)).select("doc_id", text, F.col("before").alias("place"), F.lit(True).alias("extra"))
    rows = with_fingerprint(docs.withColumn("extra", F.lit(False)), text, name).unionByName(with_fingerprint(extra, text, name))
    w = W.partitionBy("place").orderBy("extra", F.col("doc_id").asc_nulls_first(), order)
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (text, name)]).where("not extra").drop("place", "extra")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of every text and of its edited text, with their likeness and that to the next text.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many
    (or all) of the next text's first. A null text counts as empty. A row in, a row out; whole
    texts count, and other columns, whatever their names, are ignored.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, "text", "fingerprint")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", "edited")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
