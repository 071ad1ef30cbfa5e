"""Calendar and clock expressions; nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_page(d: Column, first_year: int) -> Column:
    return (F.year(d) - first_year) * 12 + F.month(d) - 1


def page_month(page: Column, first_year: int) -> Column:
    return F.make_date((F.floor(page / 12) + first_year).cast("int"), (F.pmod(page, F.lit(12)) + 1).cast("int"), F.lit(1))


def calendar_cell(d: Column, first_year: int) -> Column:
    """struct<row, col> of a day in the grid of Mondays from the first of January of ``first_year``."""
    start = F.make_date(F.lit(first_year), F.lit(1), F.lit(1))
    n = F.datediff(d, start) + F.weekday(start)
    return F.struct(F.floor(n / 7).cast("int").alias("row"), F.pmod(n, F.lit(7)).alias("col"))


def calendar_grid(month: Column) -> Column:
    """The 42 days from the Monday on or before the first of the month."""
    start = F.to_date(F.date_trunc("week", F.date_trunc("month", month)))
    return F.sequence(start, F.date_add(start, 41))


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def to_12h(hour: Column) -> Column:
    return F.struct(F.when(F.pmod(hour, F.lit(12)) == 0, 12).otherwise(F.pmod(hour, F.lit(12))).alias("hour"), F.when(hour < 12, "AM").otherwise("PM").alias("half"))


def from_12h(hour: Column, half: Column) -> Column:
    return F.when((half == "AM") & (hour == 12), 0).when((half == "PM") & (hour != 12), hour + 12).otherwise(hour)


def format_duration(ms: Column) -> Column:
    """h:mm:ss, hours unpadded."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def encode_month(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), n)


def decode_month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")


def encode_suffix(n: Column, suffix: str) -> Column:
    return F.concat(n.cast("string"), F.lit(suffix))


def decode_suffix(text: Column) -> Column:
    """The number before a suffix of one character; null if there is none."""
    return F.substring(text, F.lit(1), F.char_length(text) - 1).try_cast("int")


def pad2(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.char_length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
