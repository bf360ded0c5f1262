"""Which candidate papers enter a corpus, and why others do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions.text import REVIEW_TITLE, quotable

ORDER = ("licence_error", "not_open", "fetch_error", "no_body", "review", "already_curated", "duplicate", "no_cases")


def reject_reasons(papers: DataFrame, curated: DataFrame) -> DataFrame:
    """``papers`` (paper_id, pmid, license, abstract, title, n_gold_cases) with ``reason``, the first that applies, or kept.

    ``curated`` is (number). A paper without a number is never curated already and never a duplicate. The first paper
    of a number, by id, is not a duplicate. Where columns ``licence_status`` and ``fetch_status`` tell of failed look-ups,
    those come before what could not be looked at for that.
    """
    failed = lambda name: (F.coalesce(F.col(name) == "error", F.lit(False)) if name in papers.columns else F.lit(False))
    p = papers.withColumn("number", F.nullif(F.regexp_replace("pmid", r"\D", ""), F.lit("")))
    firsts = p.filter("number IS NOT NULL").groupBy("number").agg(F.min("paper_id").alias("_first"))
    j = p.join(firsts, "number", "left").join(curated.select("number").distinct().withColumn("_c", F.lit(True)), "number", "left")
    reason = (
        F.when(failed("licence_status"), ORDER[0])
        .when(~quotable(F.col("license")), ORDER[1])
        .when(failed("fetch_status"), ORDER[2])
        .when(F.coalesce(F.trim("abstract"), F.lit("")) == "", ORDER[3])
        .when(F.coalesce(F.col("title").rlike(REVIEW_TITLE), F.lit(False)), ORDER[4])
        .when(F.col("_c"), ORDER[5])
        .when(F.col("paper_id") != F.col("_first"), ORDER[6])
        .when(F.coalesce("n_gold_cases", F.lit(0)) == 0, ORDER[7])
        .otherwise("kept")
    )
    return j.withColumn("reason", reason).drop("_first", "_c")


def kept_papers(reasoned: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers of ``reject_reasons`` that are kept, by id, the first ``limit`` of them where a corpus is to stop there."""
    kept = reasoned.filter("reason = 'kept'").orderBy("paper_id")
    return kept if limit is None else kept.limit(limit)
