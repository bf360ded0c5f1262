"""References to records that do not exist, were withdrawn, or came later.

Every key a reference may use (a term's id or one of its alternative ids) gets the interval in which it is valid: from
the time the live term it leads to was added, or never. References and keys are brought together by key, both sides
partitioned and sorted by it and merged in one pass (a sort-merge join; adaptive execution splits a key that holds a
large share of the references over several tasks, since the reference side of an outer join may be split). The
interval separates three kinds of orphans:

``missing``  no term has the key, alone or along the way;
``deleted``  the way ends at a withdrawn term without a successor, or runs in a circle;
``late``     the live term was added after the time of the row that refers to it.

Defined cases: null and blank references are none; a null ``obsolete`` is false; a live term with a null ``added_at``
was always there; a row without a time is never early, and its month is null; repeated rows count once; where several
terms claim one alternative id the least term id holds it, and a term's own id always wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions.ids import clean_id, newest_values, trimmed
from caseweave.operators.dag import term_rows
from caseweave.session import cut, release


def key_validity(terms: DataFrame) -> DataFrame:
    """(ref_id, fate, valid_from) for every usable key; fate is live, deleted or missing (a broken chain).

    Chains of replacements are followed by doubling: each round joins the pointers with themselves, so a chain of
    length n takes log2(n) rounds, and what is still open when a round closes nothing is a circle.
    """
    t = cut(term_rows(terms))
    own = t.select(F.col("id").alias("ref_id"), F.col("id").alias("term"))
    alts = t.select(F.explode("alts").alias("ref_id"), F.col("id").alias("term"))
    alts = alts.groupBy("ref_id").agg(F.min("term").alias("term")).join(own.select("ref_id"), "ref_id", "left_anti")
    keys = cut(own.unionByName(alts))
    # a step leads from a withdrawn term to the term its successor's key belongs to; end marks: live, deleted, missing
    steps = (
        t.join(keys.select(F.col("ref_id").alias("next"), F.col("term").alias("target")), "next", "left")
        .select(
            "id",
            F.when(~F.col("obsolete"), "live").when(F.col("next").isNull(), "deleted").when(F.col("target").isNull(), "missing").alias("fate"),
            F.when(~F.col("obsolete"), F.col("id")).otherwise(F.col("target")).alias("at"),
        )
    )
    steps = cut(steps)
    left = -1
    while (now := steps.filter(F.col("fate").isNull()).count()) not in (0, left):
        # while a chain with an end is open each round closes some; a round that closes none has only circles left
        left = now
        onward = steps.select(F.col("id").alias("at"), F.col("fate").alias("fate2"), F.col("at").alias("at2"))
        moved = steps.join(onward, "at", "left").select("id", F.coalesce("fate", "fate2").alias("fate"), F.when(F.col("fate").isNull(), F.col("at2")).otherwise(F.col("at")).alias("at"))
        before, steps = steps, cut(moved)
        release(before)
    ends = steps.select("id", F.coalesce("fate", F.lit("deleted")).alias("fate"), "at")
    added = t.select(F.col("id").alias("at"), F.col("added_at").alias("valid_from"))
    ends = ends.join(added, "at", "left").select(F.col("id").alias("term"), "fate", F.when(F.col("fate") == "live", F.col("valid_from")).alias("valid_from"))
    return keys.join(ends, "term").select("ref_id", "fate", "valid_from")


def classify(references: DataFrame, validity: DataFrame) -> DataFrame:
    """``references`` (with ``ref_id`` and ``ref_time``) that are orphans, with ``reason``."""
    joined = references.join(validity.hint("merge"), "ref_id", "left")
    reason = (
        F.when(F.col("fate").isNull() | (F.col("fate") == "missing"), "missing")
        .when(F.col("fate") == "deleted", "deleted")
        .when(F.col("valid_from") > F.col("ref_time"), "late")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("fate", "valid_from")


def term_references(records: DataFrame, annotations: DataFrame, terms: DataFrame) -> DataFrame:
    """(ref_table, row_key, ref_id, ref_time): every reference to a term in the three tables."""
    none = F.array().cast("array<string>")
    in_records = F.concat(
        F.coalesce(F.transform("phenotypes", lambda p: p["term"]["id"]), none),
        F.coalesce(F.transform("diagnoses", lambda d: d["disease"]["id"]), none),
    )
    cur = newest_values(records, "id", "ingested_at", ["phenotypes", "diagnoses"], {"refs": F.array_distinct(in_records)})
    rows = [
        cur.select(F.lit("case_records").alias("ref_table"), F.col("id").alias("row_key"), F.explode("refs").alias("r"), F.col("ingested_at").alias("ref_time")),
        annotations.select(F.lit("disease_annotations").alias("ref_table"), F.col("ann_id").cast("string").alias("row_key"), F.col("hpo_id").alias("r"), F.col("created_at").alias("ref_time")),
        terms.select(
            F.lit("terms").alias("ref_table"), trimmed(F.col("term_id")).alias("row_key"),
            F.explode(F.concat(F.coalesce("parents", none), F.array("replaced_by"))).alias("r"), F.col("modified_at").alias("ref_time"),
        ),
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("ref_table", "row_key", clean_id(F.col("r")).alias("ref_id"), "ref_time").filter(F.col("ref_id").isNotNull() & F.col("row_key").isNotNull())


def orphans(records: DataFrame, annotations: DataFrame, terms: DataFrame) -> DataFrame:
    """(ref_table, row_key, ref_id, ref_month, reason), one row each."""
    found = classify(term_references(records, annotations, terms), key_validity(terms))
    return found.select("ref_table", "row_key", "ref_id", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "reason").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, ref_month, reason, n_references, n_rows)."""
    return found.groupBy("ref_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("row_key").alias("n_rows"))
