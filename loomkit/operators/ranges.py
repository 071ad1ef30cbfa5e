"""Work on the rows of a key in their order, where one key may have more rows than a task can hold.

``ranged`` deals rows to ranges of (key, order) of bounded size: a key with few rows lies in one
range, a key with very many in several that follow one another. Work within ranges is
parallel; what a range needs of the key's earlier ones is carried over as a small summary of
each. Without a column _range all of a key's rows are taken for one range.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import saved

ROWS = 1_000_000
#: Rows of a range that a task goes through one by one.
STEPS = 250_000
RANGE = "_range"


def ranged(df: DataFrame, key: str, order: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` with _range, in ranges of about ``rows`` rows; of two rows of a key the earlier one never has the greater range, and rows that are equal in key and order share one.

    It stays as it is if it has no more rows than that, or has ranges already. The rows are written to the shared
    folder, for the bounds of ranges are drawn from a sample, and must not be drawn twice.
    """
    if RANGE in df.columns:
        return df
    n = -(-df.count() // rows)
    return df if n <= 1 else saved(df.repartitionByRange(n, key, *order).withColumn(RANGE, F.spark_partition_id()))


def by(df: DataFrame, key: str) -> list[str]:
    """What windows over a key's rows are partitioned by."""
    return [key, RANGE] if RANGE in df.columns else [key]


def matched(df: DataFrame, other: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``df`` joined with ``other`` (key, _range, ...) by key and range; null keys are equal."""
    o = other.withColumnsRenamed({key: "_other", RANGE: "_other_range"})
    return df.join(o, F.col(key).eqNullSafe(F.col("_other")) & (F.col(RANGE) == F.col("_other_range")), how).drop("_other", "_other_range")


def carried(df: DataFrame, key: str, summary: dict[str, Column], **values: Column) -> DataFrame:
    """``df`` with ``values``, the same for all rows of a range: window functions over the ``summary``, aggregates by range, of the key's earlier ranges; null in its first one."""
    each = df.groupBy(key, RANGE).agg(*[c.alias(n) for n, c in summary.items()])
    ordered = W.partitionBy(key).orderBy(RANGE)
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    each = each.select(key, RANGE, F.row_number().over(ordered).alias("_n"), *[c.over(earlier).alias(n) for n, c in values.items()])
    # Most keys have one range; only the others' go into the join.
    return matched(df, each.where("_n > 1").drop("_n"), key)


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, name: str, descending: bool = False) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the key up to this one, which must differ in ``order``; from the last row on if ``descending``."""
    local = W.partitionBy(*by(df, key)).orderBy(*[F.desc(c) if descending else F.asc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn(name, F.sum(value).over(local))
    if RANGE not in df.columns:
        return out
    each = df.groupBy(key, RANGE).agg(F.sum(value).alias("_sum"))
    others = W.partitionBy(key).orderBy(F.desc(RANGE) if descending else F.asc(RANGE)).rowsBetween(W.unboundedPreceding, -1)
    each = each.select(key, RANGE, F.sum("_sum").over(others).alias("_before")).where("_before is not null")
    return matched(out, each, key).withColumn(name, F.coalesce(F.col(name) + F.col("_before"), F.col(name), F.col("_before"))).drop("_before")


def total(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows of the key, added up by range first."""
    if RANGE not in df.columns:
        return df.withColumn(name, F.sum(value).over(W.partitionBy(key)))
    each = df.groupBy(key, RANGE).agg(F.sum(value).alias("_sum"))
    return matched(df, each.select(key, RANGE, F.sum("_sum").over(W.partitionBy(key)).alias(name)), key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """(key, _range) of the keys that have several ranges."""
    each = df.groupBy(key, RANGE).agg(F.lit(1).alias("_one"))
    return each.withColumn("_n", F.count("*").over(W.partitionBy(key))).where("_n > 1").select(key, RANGE)


def sorted_runs(t, key: str, order: list[str]):
    """An Arrow table in the order of key and ``order``, and where the rows of each key begin and end."""
    import pyarrow.compute as pc

    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (key, *order)])) if t.num_rows else t
    codes = t[key].combine_chunks().dictionary_encode("encode").indices.to_numpy() if t.num_rows else np.zeros(0, int)
    edges = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)] if len(codes) else np.zeros(1, int)
    return t, list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def stepped(df: DataFrame, key: str, order: list[str], added: list[T.StructField], step: Callable, summarise: Callable, fold: Callable, inputs: list[str]) -> DataFrame:
    """``df`` with the columns ``added``, found by going through a key's rows in order.

    ``step(state, *inputs)`` takes the state before a key's first row (None at its very first) and lists of its rows'
    ``inputs``, and gives a list for each added column. Where a key has several ranges,
    ``summarise(*inputs)`` says of each what it does to any state, and ``fold(state, summary)`` does it.
    """
    names = [c for c in df.columns if c != RANGE]
    kinds = T.StructType([df.schema[c] for c in names] + added)
    rows = df.withColumn("_state", F.lit(None).cast("binary"))
    if RANGE in df.columns:
        pair = T.StructType([df.schema[key], T.StructField(RANGE, T.IntegerType()), T.StructField("_state", T.BinaryType())])

        def summary(t):
            import pyarrow as pa

            t, _ = sorted_runs(t, key, order)
            found = pickle.dumps(summarise(*(t[c].to_pylist() for c in inputs)))
            return pa.table([t[key].slice(0, 1), t[RANGE].slice(0, 1), pa.array([found], pa.binary())], names=pair.names)

        def states(t):
            import pyarrow as pa

            t, state, out = t.sort_by(RANGE), None, []
            for s in t["_state"].to_pylist():
                out.append(pickle.dumps(state))
                state = fold(state, pickle.loads(s))
            return pa.table([t[key], t[RANGE], pa.array(out, pa.binary())], names=pair.names)

        many = matched(df.select(key, RANGE, *[c for c in dict.fromkeys([*order, *inputs]) if c != key]), spread(df, key), key, "left_semi")
        before = many.groupBy(key, RANGE).applyInArrow(summary, pair).groupBy(key).applyInArrow(states, pair)
        rows = matched(df, before, key)

    def run(t):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        t, runs = sorted_runs(t, key, order)
        values, out = [t[c].to_pylist() for c in inputs], [[] for _ in added]
        state = t["_state"]
        for a, b in runs:
            s = state[a].as_py()
            for column, found in zip(out, step(None if s is None else pickle.loads(s), *(v[a:b] for v in values)), strict=True):
                column += found
        schema = to_arrow_schema(kinds)
        return pa.table([*(t[c] for c in names), *(pa.array(v, f.type) for v, f in zip(out, list(schema)[len(names) :], strict=True))], names=schema.names).cast(schema)

    return rows.groupBy(*[RANGE] * (RANGE in rows.columns)).applyInArrow(run, kinds)
