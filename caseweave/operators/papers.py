"""Papers around the records: which may be scored, how many there are, licences, and what a search page needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseweave.functions.text import quotable, split_of

TIERS = ("full_text_quotable", "full_text_facts_only")


def eval_set(gold: DataFrame, availability: DataFrame, salt: str, tiers: tuple[str, ...] = TIERS, retracted: bool = False) -> DataFrame:
    """(pmid, pmcid, tier, license, quotes_permitted, split, track, n_cases) of papers whose text may be read, by pmid as text.

    ``gold`` is (pmid, id), ``availability`` (pmid, pmcid, tier, license, quotes_permitted, retracted), a row per paper.
    Records without a paper count nowhere; retracted papers stay out unless asked for.
    """
    per = gold.filter("pmid IS NOT NULL").groupBy("pmid").agg(F.count(F.lit(1)).alias("n_cases"))
    j = per.join(availability, "pmid").filter(F.col("tier").isin(*tiers))
    if not retracted:
        j = j.filter(~F.coalesce("retracted", F.lit(False)))
    return j.select(
        "pmid", "pmcid", "tier", "license", F.coalesce("quotes_permitted", F.lit(False)).alias("quotes_permitted"), split_of(F.col("pmid"), salt).alias("split"),
        F.when(F.col("n_cases") == 1, "single").otherwise("paper").alias("track"), "n_cases",
    ).orderBy("pmid")


def eval_summary(papers: DataFrame) -> DataFrame:
    """(part, value, papers, cases) of an ``eval_set``: in total, by split, track and tier, and of single-record papers by split."""
    parts = F.array(
        F.struct(F.lit("total").alias("part"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("part"), F.col(c).alias("value")) for c in ("split", "track", "tier")],
        F.when(F.col("track") == "single", F.struct(F.lit("single_split").alias("part"), F.col("split").alias("value"))),
    )
    rows = papers.select("n_cases", F.explode(parts).alias("p")).filter("p IS NOT NULL")
    return rows.groupBy("p.part", "p.value").agg(F.count(F.lit(1)).alias("papers"), F.sum("n_cases").alias("cases"))


def skips(gold: DataFrame, availability: DataFrame, bodies: DataFrame, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """(status, papers): why gold papers are not scored: not_available, tier, retracted, no_pmcid, no_body, or scored; the first that holds.

    ``bodies`` is (pmid) of papers with a text that has a body.
    """
    per = gold.filter("pmid IS NOT NULL").select("pmid").distinct()
    j = per.join(availability.withColumn("_a", F.lit(True)), "pmid", "left").join(bodies.select("pmid").distinct().withColumn("_b", F.lit(True)), "pmid", "left")
    status = (
        F.when(F.col("_a").isNull(), "not_available").when(~F.coalesce(F.col("tier").isin(*tiers), F.lit(False)), "tier").when(F.col("retracted"), "retracted")
        .when(F.coalesce(F.trim("pmcid"), F.lit("")) == "", "no_pmcid").when(F.col("_b").isNull(), "no_body").otherwise("scored")
    )
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("papers"))


def licence_audit(papers: DataFrame) -> DataFrame:
    """(tier, license, papers, quotable, permitted): papers (tier, license, quotes_permitted) by tier and licence; none is ``none``."""
    name = F.coalesce(F.nullif(F.trim("license"), F.lit("")), F.lit("none"))
    per = papers.groupBy(F.coalesce("tier", F.lit("none")).alias("tier"), name.alias("license"))
    return per.agg(F.count(F.lit(1)).alias("papers"), F.count_if(quotable(F.col("license"))).alias("quotable"), F.count_if(F.coalesce("quotes_permitted", F.lit(False))).alias("permitted"))


def source_doc(papers: DataFrame) -> DataFrame:
    """(pmid, source): what a record says of its source, from an ``eval_set``."""
    none = lambda kind: F.lit(None).cast(kind)
    return papers.select("pmid", F.struct(
        "pmid", "pmcid", none("string").alias("doi"), none("string").alias("title"), none("string").alias("journal"), none("int").alias("pub_year"), "license",
        F.col("tier").startswith("full_text").alias("in_oa_subset"), "quotes_permitted", F.lit(False).alias("retracted"),
    ).alias("source"))


def registry_map(papers: DataFrame, numbers: DataFrame) -> DataFrame:
    """(pmid, pmcid): the archive id of every number asked for, null where none is known; of several the least."""
    known = papers.filter("pmid IS NOT NULL AND trim(pmcid) <> ''").groupBy("pmid").agg(F.min(F.trim("pmcid")).alias("pmcid"))
    return numbers.select("pmid").distinct().join(known, "pmid", "left")


def archive_records(replies: DataFrame, key: str = "pmcid", column: str = "xml") -> DataFrame:
    """(key, in_oa_subset, license, retracted) of the archive's XML replies: no record in it, not open."""
    record = F.regexp_extract(column, r"<record\b([^>]*)>", 1)
    attribute = lambda name: F.nullif(F.regexp_extract(record, rf'\b{name}="([^"]*)"', 1), F.lit(""))
    there = F.coalesce(F.col(column).rlike(r"<record\b"), F.lit(False))
    return replies.select(key, there.alias("in_oa_subset"), F.when(there, attribute("license")).alias("license"), F.coalesce(F.lower(attribute("retracted")) == "yes", F.lit(False)).alias("retracted"))


def find_documents(docs: DataFrame, words: list[str], years: tuple[int, int] | None = None, most: int = 20) -> DataFrame:
    """(doc_id) of documents that hold all the words in any case, of the years asked for, the first ``most`` by id."""
    hit = docs
    for w in words:
        hit = hit.filter(F.lower("text").contains(w.lower()))
    if years:
        hit = hit.filter(F.col("pub_year").between(*years))
    return hit.select("doc_id").distinct().orderBy("doc_id").limit(most)


# what a search page needs
def informative(observed: DataFrame, least: int = 3) -> DataFrame:
    """Rows of (id, term), repeats kept, of records with at least ``least`` of them, made distinct then."""
    n = observed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("id")
    return observed.join(n, "id", "left_semi").distinct()


def search_vocabulary(kept: DataFrame, closed: DataFrame, ic: DataFrame, names: DataFrame) -> DataFrame:
    """(number, term, label, ic, n_records, ancestors): terms in use and all above them, numbered by id from 0; ancestors by number.

    The vocabulary is at most the ontology, so numbering it in one task is bounded by that.
    """
    used = kept.groupBy("term").agg(F.count_distinct("id").alias("n_records"))
    vocabulary = closed.join(used.select("term"), "term", "left_semi").select(F.col("ancestor").alias("term")).distinct()
    numbered = vocabulary.withColumn("number", F.row_number().over(W.orderBy("term")) - 1)
    up = closed.select("term", "ancestor").join(numbered.select(F.col("term").alias("ancestor"), "number"), "ancestor").groupBy("term").agg(F.array_sort(F.collect_list("number")).alias("ancestors"))
    j = numbered.join(up, "term").join(ic.select("term", "ic"), "term", "left").join(used, "term", "left").join(names.select(F.col("id").alias("term"), F.col("name").alias("label")), "term", "left")
    return j.select("number", "term", F.coalesce("label", "term").alias("label"), F.round("ic", 3).alias("ic"), F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"), "ancestors")


def gene_postings(records: DataFrame, most: int = 3) -> DataFrame:
    """(gene, ids): records by gene symbol, upper-cased; of each record the first ``most`` variants with a gene."""
    named = F.filter("variants", lambda v: v["gene"]["label"].isNotNull())
    rows = records.select("id", F.explode(F.slice(F.transform(named, lambda v: F.upper(v["gene"]["label"])), 1, most)).alias("gene"))
    return rows.groupBy("gene").agg(F.array_sort(F.collect_set("id")).alias("ids"))
