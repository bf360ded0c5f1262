"""ISO-8601 durations as days, by fixed factors and not by the calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a year, month, week, day.
DAYS = {"Y": 365.25, "M": 30.44, "W": 7.0, "D": 1.0}


def iso_days(c: Column) -> Column:
    """Days of a duration like P1Y6M, blanks around it ignored; null for null, any other text, and all-zero durations but P0D.

    The text behind P must be numbers with units, each unit at most once and from years down to days.
    """
    text = F.trim(c)
    parts = F.regexp_extract_all(text, F.lit("[0-9]+[YMWD]"), F.lit(0))
    units = F.array_join(F.transform(parts, lambda x: F.right(x, F.lit(1))), "")
    whole = F.concat(F.lit("P"), F.array_join(parts, "")) == text
    factor = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
    days = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.left(x, F.length(x) - 1).try_cast("double") * F.element_at(factor, F.right(x, F.lit(1))))
    return F.when(text == "P0D", F.lit(0.0)).when(whole & units.rlike("^Y?M?W?D?$") & (days > 0), days)


def onset(c: Column) -> Column:
    """struct(iso8601duration, gestational_weeks): whole weeks are gestational age, other durations stay, the rest is null."""
    weeks = F.regexp_extract(c, r"^P(\d+)W$", 1).try_cast("int")
    return F.when(c.startswith("P"), F.struct(F.when(weeks.isNull(), c).alias("iso8601duration"), weeks.alias("gestational_weeks")))
