"""Clean-up of carelessly written ids, and the newest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is stripped from both ends of ids.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_id(c: Column) -> Column:
    """Trimmed and upper-cased; null where nothing is left."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def newest(df: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """The row of every ``key`` with the latest ``time``, with ``columns`` only.

    An aggregate and not a window: a key that holds a large part of all rows is reduced before the shuffle. Null
    times are oldest; equal times are settled by a hash of the kept columns. Rows without a key are dropped.
    """
    kept = [c for c in columns if c not in (key, time)]
    return newest_values(df, key, time, kept, {c: F.col(c) for c in kept})


def newest_values(df: DataFrame, key: str, time: str, settle: list[str], values: dict[str, Column]) -> DataFrame:
    """(key, time, values) of the newest row of every key: what is asked of a row is worked out before the shuffle, so only that moves.

    ``settle`` names the columns whose hash settles equal times.
    """
    row = F.struct(F.col(time), *[v.alias(n) for n, v in values.items()])
    order = F.struct(F.col(time), F.xxhash64(time, *settle))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key), row.alias("_row"), order.alias("_order"))
    return rows.groupBy(key).agg(F.max_by("_row", "_order").alias("_row")).select(key, "_row.*")
