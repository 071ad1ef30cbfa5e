"""Hooks: pairs of column functions that encode and decode a picker's column, and defaults for rows that fail."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates


class Formatter(NamedTuple):
    """``encode`` gives the text that is shown of a value, ``decode`` the value of such a text."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


FORMATTERS: dict[str, Formatter] = {
    "text": Formatter(lambda c: c.cast("string"), lambda c: c.cast("string")),
    "digit": Formatter(lambda c: c.cast("string"), lambda c: c.try_cast("int")),
    "pad2": Formatter(dates.pad2, lambda c: c.try_cast("int")),
    "month": Formatter(dates.encode_month, dates.decode_month),
    "year_suffix": Formatter(lambda c: dates.encode_suffix(c, "年"), dates.decode_suffix),
    "month_suffix": Formatter(lambda c: dates.encode_suffix(c, "月"), dates.decode_suffix),
    "day_suffix": Formatter(lambda c: dates.encode_suffix(c, "日"), dates.decode_suffix),
}


def encode(value: Column, formatter: str) -> Column:
    return FORMATTERS[formatter].encode(value)


def decode(text: Column, formatter: str) -> Column:
    return FORMATTERS[formatter].decode(text)


def with_default(fn: Callable, kind: str, default=None) -> Callable[..., Column]:
    """A column function: struct<value: ``kind``, error: string> of ``fn`` row by row.

    A row in which ``fn`` raises has ``default`` as its value and says why in error, which
    ``failure_report`` takes as a reason; else error is null. Nulls are passed to ``fn`` as None.
    """
    @F.pandas_udf(f"value {kind}, error string")
    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = []
        for args in zip(*columns, strict=True):
            try:
                rows.append((fn(*(None if pd.api.types.is_scalar(a) and pd.isna(a) else a for a in args)), None))
            except Exception as e:  # noqa: BLE001
                rows.append((default, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"], dtype=object)

    return run


def or_default(value: Column, default, reason: str | Column) -> Column:
    """struct<value, error> of an expression that is null where it fails, as the ``try_`` functions are: no Python at all.

    Such a row has ``default`` as its value and ``reason`` as error. An expression that may be null without failing takes ``with_default``.
    """
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.coalesce(value, F.lit(default)).alias("value"), F.when(value.isNull(), why).alias("error"))
