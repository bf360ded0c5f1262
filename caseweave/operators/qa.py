"""Consistency rules over case records, provenance of spans, vote merging, retractions, annotation profiles.

Every rule is a frame (id, code, severity, a, b); the violations of a collection are their union. Records are read once
(``facts``) and the small rule tables are joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseweave.functions.durations import iso_days
from caseweave.functions.ids import clean_id
from caseweave.functions.text import cue_near
from caseweave.operators import dag

#: Frequency terms and notations, inheritance term, factors, bounds.
OBLIGATE, EXCLUDED_FREQUENCY, Y_LINKED = ("HP:0040280", "1/1", "100%"), "HP:0040285", "HP:0001450"
ERROR_FACTOR, WARN_FACTOR, REVIEW_BELOW, MAX_EVIDENCE = 0.5, 0.9, 0.67, 5


# annotation profiles
def annotations_clean(ann: DataFrame) -> DataFrame:
    """(ann_id, disease, term, negated, frequency, sex, aspect): cleaned rows with both ids."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return (
        ann.select("ann_id", clean_id(F.col("disease_id")).alias("disease"), clean_id(F.col("hpo_id")).alias("term"),
                   F.coalesce(F.upper(F.trim("qualifier")) == "NOT", F.lit(False)).alias("negated"), blank(F.col("frequency")).alias("frequency"),
                   F.upper(blank(F.col("sex"))).alias("sex"), F.upper(blank(F.col("aspect"))).alias("aspect"))
        .filter(F.col("disease").isNotNull() & F.col("term").isNotNull()).distinct()
    )


def profile(ann: DataFrame, kind: str) -> DataFrame:
    """(disease, term) of one kind: phenotypes, excluded, obligate, inheritance."""
    f, neg, a = F.col("frequency"), F.col("negated"), F.col("aspect")
    rule = {
        "phenotypes": ~neg & (a.isNull() | (a == "P")),
        "excluded": neg | F.coalesce(f == EXCLUDED_FREQUENCY, F.lit(False)),
        "obligate": ~neg & F.coalesce(f.isin(*OBLIGATE), F.lit(False)),
        "inheritance": ~neg & F.coalesce(a == "I", F.lit(False)),
    }[kind]
    return ann.filter(rule).select("disease", "term").distinct()


def sex_constraint(ann: DataFrame) -> DataFrame:
    """(disease, sex) where every annotation of the disease names the same sex."""
    per = ann.groupBy("disease").agg(F.min("sex").alias("sex"), F.max("sex").alias("_m"), F.count_if(F.col("sex").isNull()).alias("_n"))
    return per.filter((F.col("sex") == F.col("_m")) & (F.col("_n") == 0) & F.col("sex").isin("MALE", "FEMALE")).select("disease", "sex")


# rules
def violation(df: DataFrame, code: str, severity: str, a: Column, b: Column | None = None) -> DataFrame:
    return df.select("id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), a.cast("string").alias("a"), (b if b is not None else F.lit(None)).cast("string").alias("b")).distinct()


def polarity_contradiction(observed: DataFrame, excluded: DataFrame) -> DataFrame:
    """A term both observed and excluded; both frames are (id, term) with live terms."""
    return violation(observed.select("id", "term").join(excluded.select("id", "term"), ["id", "term"], "left_semi"), "polarity_contradiction", "ERROR", F.col("term"))


def ancestor_contradiction(observed: DataFrame, excluded: DataFrame, closed: DataFrame) -> DataFrame:
    """An observed term below an excluded one: an equi-join on (record, ancestor), not a comparison of pairs."""
    up = observed.select("id", "term").distinct().join(closed.filter("depth > 0").select("term", "ancestor"), "term")
    hit = up.join(excluded.select("id", F.col("term").alias("ancestor")).distinct(), ["id", "ancestor"])
    return violation(hit, "dag_polarity_contradiction", "ERROR", F.col("term"), F.col("ancestor"))


def term_status(raw: DataFrame, alias: DataFrame) -> DataFrame:
    """Unknown terms and terms called by an alternative or withdrawn id; ``raw`` is (id, term) as written."""
    j = raw.select("id", "term").distinct().join(alias.select(F.col("src").alias("term"), "dst"), "term", "left")
    unknown = violation(j.filter(F.col("dst").isNull()), "unknown_hpo_term", "WARN", F.col("term"))
    return unknown.unionByName(violation(j.filter(F.col("dst") != F.col("term")), "outdated_hpo_term", "WARN", F.col("term"), F.col("dst")))


def onset_after_encounter(records: DataFrame) -> DataFrame:
    """Findings that begin more than a day after the age at the last encounter."""
    e = records.select("id", iso_days(F.col("subject.age_at_last_encounter.iso8601duration")).alias("enc"), F.explode("phenotypes").alias("p"))
    late = e.filter(iso_days(F.col("p.onset.iso8601duration")) > F.col("enc") + 1)
    return violation(late, "onset_after_last_encounter", "ERROR", clean_id(F.col("p.term.id")))


def unmappable(diagnoses: DataFrame, alias: DataFrame) -> DataFrame:
    miss = diagnoses.select("id", "disease").distinct().join(alias.select(F.col("src").alias("disease")), "disease", "left_anti")
    return violation(miss, "unmappable_disease", "WARN", F.col("disease"))


def obligate_excluded(diagnoses: DataFrame, excluded: DataFrame, obligate: DataFrame) -> DataFrame:
    j = diagnoses.select("id", "disease").distinct().join(obligate.select("disease", "term"), "disease").join(excluded.select("id", "term").distinct(), ["id", "term"], "left_semi")
    return violation(j, "obligate_phenotype_excluded", "WARN", F.col("disease"), F.col("term"))


def sex_conflict(records: DataFrame, diagnoses: DataFrame, inheritance: DataFrame, y_linked: str = Y_LINKED) -> DataFrame:
    women = records.filter(F.col("subject.sex") == "FEMALE").select("id")
    j = diagnoses.select("id", "disease").distinct().join(inheritance.filter(F.col("term") == y_linked).select("disease").distinct(), "disease").join(women, "id", "left_semi")
    return violation(j, "sex_inheritance_conflict", "ERROR", F.col("disease"))


def gene_mismatch(genes: DataFrame, diagnoses: DataFrame, known: DataFrame) -> DataFrame:
    """Genes that are not known for a diagnosed disease which has known genes; ``known`` is (disease, gene)."""
    k = known.select("disease", "gene").distinct()
    pairs = diagnoses.select("id", "disease").distinct().join(k.select("disease").distinct(), "disease", "left_semi").join(genes.select("id", "gene").distinct(), "id")
    return violation(pairs.join(k, ["disease", "gene"], "left_anti"), "gene_disease_mismatch", "WARN", F.col("disease"), F.col("gene"))


def annotate(records: DataFrame, violations: DataFrame) -> DataFrame:
    """(id, qa_flags, confidence): flags added, confidence halved per error and cut by a tenth per warning; no record is dropped."""
    per = violations.groupBy("id").agg(
        F.collect_set(F.concat_ws(":", "severity", "code")).alias("_flags"), F.count_if(F.col("severity") == "ERROR").alias("_e"), F.count_if(F.col("severity") != "ERROR").alias("_w")
    )
    j = records.select("id", "qa_flags", "confidence").join(per, "id", "left")
    empty = F.array().cast("array<string>")
    damped = F.coalesce("confidence", F.lit(1.0)) * F.pow(F.lit(ERROR_FACTOR), F.col("_e")) * F.pow(F.lit(WARN_FACTOR), F.col("_w"))
    flags = F.array_sort(F.array_union(F.coalesce("qa_flags", empty), F.coalesce("_flags", empty)))
    return j.select("id", flags.alias("qa_flags"), F.when(F.col("_e").isNull(), F.col("confidence")).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), damped)), 4)).alias("confidence"))


# provenance of spans
def span_verdicts(evidence: DataFrame, texts: DataFrame, grounded: DataFrame, closed: DataFrame, pad: int = 240) -> DataFrame:
    """``evidence`` (key, doc_id, term, excluded, start_char, end_char) with ``verdict``.

    ``texts`` is (doc_id, text); ``grounded`` (key, found) holds the live terms that the span (or the text it was
    derived from) yields. A found term supports the claim if it is the claimed one, above it or below it. Where a column
    ``derived`` says that a claim came from a label and not from its span, polarity is taken as asserted.
    """
    kin = closed.select(F.col("term").alias("found"), F.col("ancestor").alias("term"))
    kin = kin.unionByName(closed.select(F.col("ancestor").alias("found"), "term")).distinct()
    backed = evidence.select("key", "term").join(grounded.select("key", "found"), "key").join(kin, ["found", "term"], "left_semi").select("key").distinct().withColumn("_ok", F.lit(True))
    j = _spans(evidence.join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left"), pad).join(backed, "key", "left")
    s, e = F.col("start_char"), F.col("end_char")
    verdict = (
        F.when(s.isNull() | e.isNull(), "no_evidence")
        .when(F.col("_n").isNull() | (e > F.col("_n")) | (s < 0), "offset_out_of_range")
        .when(F.col("_blank"), "empty_span")
        .when(F.col("_ok").isNull(), "term_not_in_span")
        .when((~F.coalesce("derived", F.lit(False)) if "derived" in evidence.columns else F.lit(True)) & (F.col("_cue").isNotNull() != F.coalesce("excluded", F.lit(False))), "polarity_mismatch")
        .otherwise("supported")
    )
    return j.withColumn("verdict", verdict).drop("_n", "_blank", "_cue", "_ok")


def _spans(rows: DataFrame, pad: int) -> DataFrame:
    """``rows`` with the length of ``_text``, whether their span is blank and the cue within ``pad`` characters that negates it, instead of the text."""
    kept = [c for c in rows.columns if c != "_text"]
    at = {c: kept.index(c) for c in ("start_char", "end_char")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, blank, cue = [], [], []
            for text, s, e in zip(batch.column(len(kept)).to_pylist(), *(batch.column(at[c]).to_pylist() for c in at)):
                good = text is not None and s is not None and e is not None and 0 <= s and e <= len(text)
                n.append(None if text is None else len(text))
                blank.append(good and not text[s:e].strip())
                around = max(0, s - pad) if good else 0
                cue.append(cue_near(text[around : e + pad], s - around, e - around) if good else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n, pa.int32()), pa.array(blank, pa.bool_()), pa.array(cue, pa.string())], names=[*kept, "_n", "_blank", "_cue"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "_text").mapInArrow(run, f"{kinds}, _n int, _blank boolean, _cue string")


def support_rates(verdicts: DataFrame) -> DataFrame:
    """(verdict, n, spans_checked, rate), rates to four places."""
    n = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    every = F.sum("n").over(W.partitionBy())  # over the handful of verdicts
    return n.select("verdict", "n", every.alias("spans_checked"), F.round(F.col("n") / F.greatest(every, F.lit(1)), 4).alias("rate"))


def stated_agreement(stated: DataFrame, predicted: DataFrame, closed: DataFrame) -> DataFrame:
    """(id, agrees): whether a stated disease equals a predicted one or is its ancestor or descendant; null where none is stated."""
    kin = closed.select(F.col("term").alias("s"), F.col("ancestor").alias("p")).unionByName(closed.select(F.col("ancestor").alias("s"), F.col("term").alias("p"))).distinct()
    s, p = stated.select("id", F.col("disease").alias("s")).distinct(), predicted.select("id", F.col("disease").alias("p")).distinct()
    good = s.join(p, "id").join(kin, ["s", "p"], "left_semi").select("id").distinct().withColumn("_g", F.lit(True))
    who = predicted.select("id").distinct()
    return who.join(s.select("id").distinct().withColumn("_s", F.lit(True)), "id", "left").join(good, "id", "left").select("id", F.when(F.col("_s"), F.coalesce("_g", F.lit(False))).alias("agrees"))


# votes of several extractors
def merge_votes(votes: DataFrame, n_voters: DataFrame, review_below: float = REVIEW_BELOW) -> DataFrame:
    """(case, key, share, review) of (case, key, voter) rows: one vote per voter and key; shares below the bound go to review."""
    per = votes.select("case", "key", "voter").distinct().groupBy("case", "key").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") / F.col("n_voters"), 4)
    return per.join(n_voters, "case").select("case", "key", share.alias("share"), (F.col("n") / F.col("n_voters") < review_below).alias("review"))


def consensus_records(deliveries: DataFrame, review_below: float = REVIEW_BELOW, most: int = MAX_EVIDENCE) -> DataFrame:
    """(id, n_records, agreement, review_queue, confidence, evidence): the records of several extractors on one case, merged.

    ``deliveries`` is (id, number, phenotypes, diagnoses, variants). Keys are term ids (with ! where excluded), dx: and
    gene: ids; a record votes once a key. ``agreement`` maps keys to shares (four places), ``confidence`` is their mean,
    ``evidence`` maps finding keys to how much evidence stays, at most ``most`` pieces of each.
    """
    size = lambda x: F.greatest(F.coalesce(F.size(x["evidence"]), F.lit(0)), F.lit(0))
    entry = "struct<key:string,n:int>"
    found = F.transform("phenotypes", lambda p: F.struct(F.concat(clean_id(p["term"]["id"]), F.when(F.coalesce(p["excluded"], F.lit(False)), "!").otherwise("")).alias("key"), size(p).alias("n")))
    dx = F.transform("diagnoses", lambda d: F.struct(F.concat(F.lit("dx:"), clean_id(d["disease"]["id"])).alias("key"), F.lit(0).alias("n")))
    gene = F.transform("variants", lambda v: F.struct(F.concat(F.lit("gene:"), clean_id(v["gene"]["id"])).alias("key"), F.lit(0).alias("n")))
    keys = F.concat(*[F.coalesce(x, F.array().cast(f"array<{entry}>")) for x in (found, dx, gene)])
    rows = deliveries.select("id", "number", F.explode(keys).alias("k")).select("id", "number", "k.key", "k.n").filter("key IS NOT NULL")
    once = rows.groupBy("id", "key", "number").agg(F.max("n").alias("n"))
    n_records = deliveries.groupBy("id").agg(F.count_distinct("number").alias("n_records"))
    votes = once.groupBy("id", "key").agg(F.count(F.lit(1)).alias("votes"), F.sum("n").alias("pieces")).join(n_records, "id")
    per = votes.select("id", "key", F.round(F.col("votes") / F.col("n_records"), 4).alias("share"), (F.col("votes") / F.col("n_records") < review_below).alias("review"), F.least("pieces", F.lit(most)).alias("kept"))
    finding = ~F.col("key").startswith("dx:") & ~F.col("key").startswith("gene:")
    entries = lambda value, cond: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(cond, F.struct("key", value))), lambda x: x.isNotNull())))
    merged = per.groupBy("id").agg(
        entries("share", F.lit(True)).alias("agreement"), F.array_sort(F.filter(F.collect_list(F.when(F.col("review"), F.col("key"))), lambda x: x.isNotNull())).alias("review_queue"),
        F.round(F.avg("share"), 4).alias("confidence"), entries("kept", finding).alias("evidence"),
    )
    return n_records.join(merged, "id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def variant_verdicts(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """``evidence`` (key, doc_id, gene_label, hgvs_c, start_char, end_char), the first of each variant, with ``verdict``.

    A span supports a variant if the gene's symbol or the coding change stands in it.
    """
    j = evidence.join(texts.select("doc_id", "text"), "doc_id", "left")
    s, e = F.col("start_char"), F.col("end_char")
    span = F.substring("text", s + 1, e - s)
    holds = lambda c: F.coalesce((c != "") & span.contains(c), F.lit(False))
    verdict = (
        F.when(~F.coalesce("has_evidence", F.lit(False)), "no_evidence").when(s.isNull() | e.isNull() | F.col("text").isNull() | (e > F.length("text")), "offset_out_of_range")
        .when(holds(F.col("gene_label")) | holds(F.col("hgvs_c")), "supported").otherwise("term_not_in_span")
    )
    return j.withColumn("verdict", verdict).drop("text")


def audit(violations: DataFrame, verdicts: DataFrame, agreement: DataFrame, notices: DataFrame) -> DataFrame:
    """(part, value, n): one report of rule violations, span verdicts, agreement with stated diagnoses and retracted sources."""
    parts = [
        violations.select(F.lit("violation").alias("part"), F.concat_ws(":", "severity", "code").alias("value")), verdicts.select(F.lit("span").alias("part"), F.col("verdict").alias("value")),
        agreement.select(F.lit("stated").alias("part"), F.coalesce(F.col("agrees").cast("string"), F.lit("none stated")).alias("value")),
        notices.select(F.lit("retraction").alias("part"), F.when(F.col("notice").isNull(), "clear").otherwise("noticed").alias("value")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


def cap_evidence(evidence: DataFrame, keys: list[str], order: list[str], n: int = MAX_EVIDENCE) -> DataFrame:
    """The first ``n`` rows of each key in order, with ``place``."""
    return evidence.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def majority(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Rows of the most frequent value of each key; ties stay."""
    return counts.withColumn("_m", F.max(n).over(W.partitionBy(*keys))).filter(F.col(n) == F.col("_m")).drop("_m")


# retractions
def retraction_keys(notices: DataFrame) -> DataFrame:
    """(key, reason): PMID:x (not 0) and DOI:lower keys of retraction notices (pmid, doi, reason, at); the last notice wins."""
    reason = F.btrim("reason", F.lit(" ;+"))
    by_pmid = notices.select(F.concat(F.lit("PMID:"), F.trim("pmid")).alias("key"), reason.alias("reason"), "at").filter(~F.col("key").isin("PMID:", "PMID:0"))
    by_doi = notices.select(F.concat(F.lit("DOI:"), F.lower(F.trim("doi"))).alias("key"), reason.alias("reason"), "at").filter(F.col("key") != "DOI:")
    return by_pmid.unionByName(by_doi).groupBy("key").agg(F.max_by("reason", F.struct("at", "reason")).alias("reason"))


def check_retractions(papers: DataFrame, keys: DataFrame, archive: DataFrame) -> DataFrame:
    """``papers`` (id, pmid, doi) with ``notice``: by PMID, else the archive's own flag (pmid), else by DOI."""
    by_pmid = keys.select(F.substring("key", 6, 40).alias("pmid"), F.col("reason").alias("_p")).filter(F.col("key").startswith("PMID:"))
    by_doi = keys.filter(F.col("key").startswith("DOI:")).select(F.substring("key", 5, 400).alias("_doi"), F.col("reason").alias("_d"))
    j = papers.join(by_pmid, "pmid", "left").join(archive.select("pmid").distinct().withColumn("_a", F.lit("flagged by the archive")), "pmid", "left")
    j = j.withColumn("_doi", F.lower(F.trim("doi"))).join(by_doi, "_doi", "left")
    return j.select(*papers.columns, F.coalesce("_p", "_a", "_d").alias("notice"))


def live(df: DataFrame, column: str, alias: DataFrame) -> DataFrame:
    """Rows of ``df`` with ``column`` resolved; unknown ones dropped."""
    return dag.resolve(df, column, alias).filter(F.col(column).isNotNull()).distinct()
