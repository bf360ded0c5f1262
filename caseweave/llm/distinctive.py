"""How characteristic a term is of a record, against the whole collection.

Residual inverse document frequency: the observed idf of a term, -log2(df / N), minus the idf that a Poisson spread of
its occurrences over the N records would show, -log2(1 - exp(-cf / N)), times how often the record has the term. Terms
piled up in few records score high, terms scattered evenly score low: with ``repeats=True`` a term listed again in a
record counts again, so of two terms found in equally many records the one that is repeated there scores higher. With
``repeats=False`` (the default) a term counts once per record, so cf = df and the residual falls strictly as df rises:
the highest score of a record is that of its rarest term.

* Null sets are empty, null terms are ignored; a record without terms gives no row.
* A term that no record of the collection has keeps the limit of the residual for df -> 0, which is 0, the highest.
* An empty collection: every looked-up term has df 0. Rows repeated for a key are merged before counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.session import cut


def residual_idf(df: Column, cf: Column, n: Column) -> Column:
    """-log2(df/n) + log2(1 - exp(-cf/n)); 0 where df is 0."""
    return F.when(df > 0, (F.log(-F.expm1(-cf / n)) - F.log(df / n)) / F.log(F.lit(2.0))).otherwise(F.lit(0.0))


def term_counts(records: DataFrame, key: str = "id", terms: str = "terms", repeats: bool = False) -> DataFrame:
    """(key, term, tf), a row per term of a record."""
    rows = records.select(F.col(key).alias("key"), F.explode(terms).alias("term")).filter(F.col("term").isNotNull())
    counted = rows.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted if repeats else counted.withColumn("tf", F.lit(1).cast("long"))


def collection_statistics(counts: DataFrame, n_records: DataFrame) -> DataFrame:
    """(term, df, cf, n_records, idf, ridf) over all records; ``n_records`` is one row, one column."""
    n = n_records.first()[0]  # one number
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).withColumn("n_records", F.lit(n).cast("long"))
    return stats.select("*", (-F.log2(F.col("df") / F.col("n_records"))).alias("idf"), residual_idf(F.col("df"), F.col("cf"), F.col("n_records")).alias("ridf"))


def distinctiveness(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(key, term, tf, df, cf, score): every term of every record with its score, terms unknown to the collection too."""
    none = F.lit(0).cast("long")
    return counts.join(stats.select("term", "df", "cf", "ridf"), "term", "left").select(
        "key", "term", "tf", F.coalesce("df", none).alias("df"), F.coalesce("cf", none).alias("cf"), (F.coalesce("ridf", F.lit(0.0)) * F.col("tf")).alias("score")
    )


def most_distinctive(scored: DataFrame, *keys: str) -> DataFrame:
    """All terms of a record whose score is the record's highest, ties included.

    The scores are written once; the maximum is found by an aggregate, so a record of any size is reduced before the
    shuffle.
    """
    scored = cut(scored)
    best = scored.groupBy(*keys).agg(F.max("score").alias("best"))
    return scored.join(best, list(keys)).filter(F.col("score") == F.col("best")).drop("best")
