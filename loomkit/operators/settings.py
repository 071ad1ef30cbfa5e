"""Settings: validators and serializers by kind, overlays and changes.

A kind's rule is a column function, so that correcting a table of settings is one expression.
A schema has the columns key, kind, min, max, options, default and, if wanted, restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings that a schema may have: every entity gets each of them, from a broadcast copy.
MOST_SETTINGS = 10_000

#: kind -> (value, item) -> the corrected value; ``item`` gives the schema's columns by name.
VALIDATORS: dict[str, Callable[[Column, Callable[[str], Column]], Column]] = {}
#: kind -> (serialize, deserialize); kinds that are absent are stored as they are.
SERIALIZERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {}


def validator(kind: str):
    """Registers the rule of a kind, in place of any that it had."""
    def add(rule):
        VALIDATORS[kind] = rule
        return rule

    return add


def _shown(bound: Column) -> Column:
    return F.when(bound == F.floor(bound), bound.cast("long").cast("string")).otherwise(bound.cast("string"))


@validator("range")
def _range(value: Column, item) -> Column:
    """Clamped; a value inside stays as it is written, and what is no number falls to the default."""
    n = value.try_cast("double")
    return F.when(n.isNull(), item("default")).when(n < item("min"), _shown(item("min"))).when(n > item("max"), _shown(item("max"))).otherwise(value)


@validator("option")
def _option(value: Column, item) -> Column:
    return F.when(F.array_contains(item("options"), value), value).otherwise(F.element_at(item("options"), 1))


@validator("bool")
def _bool(value: Column, item) -> Column:
    return F.when(value.isin("true", "false"), value).otherwise(F.lit("true"))


@validator("color")
def _color(value: Column, item) -> Column:
    return F.when(value.rlike(r"^#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})\z"), value).otherwise(item("default"))


# A colour is stored with its alpha, #AARRGGBB, and read with or without one.
SERIALIZERS["color"] = (lambda c: F.when(c.rlike(r"^#[0-9A-Fa-f]{6}\z"), F.concat(F.lit("#ff"), F.lower(F.substring(c, 2, 6)))).otherwise(F.lower(c)), lambda c: c)


def _by_kind(value: Column, kind: Column, rules: dict[str, Column], other: Column) -> Column:
    out = None
    for name, rule in rules.items():
        out = F.when(kind == name, rule) if out is None else out.when(kind == name, rule)
    return other if out is None else out.otherwise(other)


def correct_value(value: Column, kind: Column, item: Callable[[str], Column] = F.col) -> Column:
    """The value by its kind's validator; kinds without one keep any value, null being the default."""
    return _by_kind(value, kind, {k: rule(value, item) for k, rule in VALIDATORS.items()}, F.coalesce(value, item("default")))


def serialize(value: Column, kind: Column) -> Column:
    return _by_kind(value, kind, {k: to(value) for k, (to, _) in SERIALIZERS.items()}, value)


def deserialize(value: Column, kind: Column) -> Column:
    return _by_kind(value, kind, {k: of(value) for k, (_, of) in SERIALIZERS.items()}, value)


def overlay_settings(values: DataFrame, schema: DataFrame) -> DataFrame:
    """(entity_id, key, value): every known setting of every entity, corrected, the default where it is missing; unknown keys go, of repeated ones the greatest value counts."""
    if schema.count() > MOST_SETTINGS:
        raise ValueError(f"a schema has at most {MOST_SETTINGS} settings")
    wanted = values.select("entity_id").distinct().crossJoin(F.broadcast(schema))
    given = values.groupBy("entity_id", "key").agg(F.max("value").alias("value"))
    got = wanted.join(given, ["entity_id", "key"], "left").withColumn("value", deserialize(F.col("value"), F.col("kind")))
    return got.select("entity_id", "key", F.when(F.col("value").isNull(), F.col("default")).otherwise(correct_value(F.col("value"), F.col("kind"))).alias("value"))


def changed_settings(old: DataFrame, new: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """(entity_id, key, old_value, new_value) where the two differ, a missing row being null; with a ``schema`` also restart, whether the change needs one."""
    a, b = old.withColumnRenamed("value", "old_value"), new.withColumnRenamed("value", "new_value")
    out = a.join(b, ["entity_id", "key"], "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    if schema is None:
        return out
    flags = schema.groupBy("key").agg(F.bool_or(F.coalesce("restart", F.lit(False))).alias("restart"))
    return out.join(flags, "key", "left").select("entity_id", "key", "old_value", "new_value", F.coalesce("restart", F.lit(False)).alias("restart"))
