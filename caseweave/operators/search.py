"""Faceted lookup, autocomplete and collection statistics over (id, kind, value) postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.records import assertions


def postings(records: DataFrame, polarity: str = "observed") -> DataFrame:
    """(id, kind, value, label): what each record can be found by. ``polarity``: observed, excluded or any, for findings."""
    rows = assertions(records).filter(F.col("about").isNotNull())
    if polarity != "any":
        rows = rows.filter((F.col("kind") != "phenotype") | (F.col("excluded") == (polarity == "excluded")))
    return rows.select("id", "kind", F.col("about").alias("value"), "label").distinct()


def with_descendants(values: DataFrame, closed: DataFrame) -> DataFrame:
    """(value): the given terms and all below them."""
    down = closed.select(F.col("ancestor").alias("value"), "term").join(values.select("value").distinct(), "value").select(F.col("term").alias("value"))
    return down.unionByName(values.select("value")).distinct()


def facets(posts: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """(id) of records that have, for each kind in ``wanted``, one of its values (value); all records without facets."""
    out = posts.select("id").distinct()
    for kind, values in wanted.items():
        out = out.join(posts.filter(F.col("kind") == kind).join(values.select("value").distinct(), "value", "left_semi").select("id").distinct(), "id", "left_semi")
    return out


def listing(ids: DataFrame, records: DataFrame, license: str | None = None, limit: int = 50, most: int = 500) -> DataFrame:
    """Records of a result by id, the licence filter before the limit."""
    j = records.join(ids, "id", "left_semi")
    if license is not None:
        j = j.filter(F.col("source.license") == license)
    return j.orderBy("id").limit(min(limit, most))


def suggestions(posts: DataFrame, part: str, kind: str = "phenotype", limit: int = 20) -> DataFrame:
    """(value, label, n_records): values whose label holds ``part`` in any case, most records first; none for fewer than 2 letters."""
    hit = posts.filter((F.col("kind") == kind) & F.lower("label").contains(part.lower())) if len(part) >= 2 else posts.filter("false")
    per = hit.groupBy("value").agg(F.min("label").alias("label"), F.count_distinct("id").alias("n_records"))
    return per.orderBy(F.desc("n_records"), "label", "value").limit(limit)


def gene_suggestions(posts: DataFrame, start: str, limit: int = 20) -> DataFrame:
    """(label, n_records): gene symbols that begin with ``start`` in any case, most records first; none for an empty start."""
    hit = posts.filter((F.col("kind") == "variant") & F.upper("label").startswith(start.upper())) if start else posts.filter("false")
    per = hit.groupBy(F.upper("label").alias("label")).agg(F.count_distinct("id").alias("n_records"))
    return per.orderBy(F.desc("n_records"), "label").limit(limit)


def value_counts(posts: DataFrame) -> DataFrame:
    """(kind, value, n_records)."""
    return posts.groupBy("kind", "value").agg(F.count_distinct("id").alias("n_records"))


def most_common(posts: DataFrame, n: int = 10) -> DataFrame:
    """(kind, value, n_records, place): the ``n`` values of each kind that most records have, ties by value."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n_records"), "value"))
    return value_counts(posts).withColumn("place", place).filter(F.col("place") <= n)


def statistics(posts: DataFrame) -> DataFrame:
    """(kind, n_values, n_records)."""
    return posts.groupBy("kind").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("id").alias("n_records"))
