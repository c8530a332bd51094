"""Numbers and dates as tables and titles print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for counts and for shares below each limit.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve".split()
SHARES = [
    (0.04, "almost none"), (0.08, "one in fifteen"), (0.12, "one in ten"), (0.17, "one in seven"), (0.22, "one in five"), (0.29, "a quarter"), (0.37, "a third"), (0.45, "nearly half"), (0.55, "half"),
    (0.62, "well over half"), (0.7, "two-thirds"), (0.79, "three-quarters"), (0.9, "most"), (1.01, "nearly all"),
]


def number_word(n: Column) -> Column:
    """A word up to twelve, null beyond."""
    return F.get(F.array(*map(F.lit, NUMBERS)), n.cast("int"))


def share_words(share: Column) -> Column:
    """The first words whose limit is above the share, null for a share that isn't one."""
    out = None
    for limit, words in SHARES:
        out = F.when(share < limit, words) if out is None else out.when(share < limit, words)
    return out


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100).cast("bigint").cast("string"), F.lit("%"))


def round_count(n: Column) -> Column:
    """A count as printed: millions with one digit, else thousands, hundreds or tens, half to even, with commas."""
    to = lambda k: F.format_number(F.bround(n / k).cast("bigint") * k, 0)
    return F.when(n >= 1e6, F.concat(F.format_string("%.1f", n.cast("double") / 1e6), F.lit("m"))).when(n >= 1e4, to(1000)).when(n >= 1e3, to(100)).when(n >= 100, (F.bround(n / 10).cast("bigint") * 10).cast("string")).otherwise(n.cast("bigint").cast("string"))


def padded(n: Column, width: int = 2) -> Column:
    """Zeros in front up to width; longer numbers stay whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def display_name(name: Column, year: Column, names: dict[str, str], by_year: dict[str, tuple[int, str, str]]) -> Column:
    """Printed name: by_year holds names that change with a year (from it on, or where it isn't known, the second); others come from names, or stay."""
    out = name
    for k, v in names.items():
        out = F.when(name == k, v).otherwise(out)
    for k, (since, before, after) in by_year.items():
        out = F.when(name == k, F.when(year.isNull() | (year >= since), after).otherwise(before)).otherwise(out)
    return out


def year_fraction(date: Column) -> Column:
    """The year and the days before the date over 365.25."""
    return F.year(date) + (F.dayofyear(date) - 1) / 365.25


def mid_year_axis(date: Column) -> Column:
    """The year, the share of its true length before the date, less a half."""
    days = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
    return F.year(date) + (F.dayofyear(date) - 1) / days - 0.5


def midpoint(start: Column, end: Column) -> Column:
    """The moment half way between two dates; half days stay."""
    a = start.cast("timestamp_ntz")
    return a + F.make_dt_interval(hours=F.datediff(end, start) * 12)


def quarter(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
