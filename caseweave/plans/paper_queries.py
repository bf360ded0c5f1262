"""Queries for papers, audits, normalisation, merged records and search pages, each with its SQL where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions import text as tx
from caseweave.functions.ids import clean_id, newest_values
from caseweave.operators import dag, extract, grounding, metrics, papers, qa, quotes, rank, records, search
from caseweave.plans import case_queries as cq
from caseweave.plans.case_queries import FIRST_SQL, FULL, RANK_SQL, WITH, Base, clean
from caseweave.plans.queries import query
from caseweave.session import cut, table

# papers
NUMBER = "nullif(regexp_replace(regexp_replace(pmid, '[^0-9]+', '', 'g'), '^0+', ''), '')"
PAPER_SQL = f"""pap AS (SELECT {NUMBER} AS number, * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM eval_papers) WHERE rn = 1),
avail AS (SELECT * FROM (SELECT number AS pmid, pmcid, tier, license, quotes_permitted, row_number() OVER (PARTITION BY number ORDER BY paper_id) AS k FROM pap WHERE number IS NOT NULL) WHERE k = 1),
gone AS (SELECT DISTINCT source.pmid AS pmid FROM cur WHERE source.retracted AND source.pmid IS NOT NULL),
gold AS (SELECT source.pmid AS pmid, count(*) AS n_cases FROM cur WHERE source.pmid IS NOT NULL GROUP BY 1)"""
EVAL_SQL = """es AS (SELECT pmid, pmcid, tier, license, coalesce(quotes_permitted, false) AS quotes_permitted,
  CASE WHEN (('0x' || substr(sha256('weave:' || pmid), 1, 8))::BIGINT % 10000) / 10000.0 < 0.5 THEN 'dev' ELSE 'test' END AS split, CASE WHEN n_cases = 1 THEN 'single' ELSE 'paper' END AS track, n_cases
  FROM gold JOIN avail USING (pmid) WHERE tier IN ('full_text_quotable', 'full_text_facts_only') AND pmid NOT IN (SELECT pmid FROM gone))"""


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """The last row of every paper with its number."""
    cols = ["pmid", "pmcid", "tier", "license", "quotes_permitted", "title"]
    rows = newest_values(table(spark, d, "eval_papers"), "paper_id", "loaded_at", cols, {c: F.col(c) for c in cols})
    number = F.nullif(F.regexp_replace(F.regexp_replace("pmid", r"[^0-9]+", ""), "^0+", ""), F.lit(""))
    return rows.withColumn("number", number)


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """((pmid, id) of current records, (pmid, pmcid, tier, license, quotes_permitted, retracted) of papers)."""
    cur = cut(newest_values(table(spark, d, "case_records"), "id", "ingested_at", ["source"], {"pmid": F.col("source.pmid"), "retracted": F.coalesce("source.retracted", F.lit(False))}))
    gone = cur.filter("retracted AND pmid IS NOT NULL").select("pmid").distinct().withColumn("retracted", F.lit(True))
    cols = ("pmcid", "tier", "license", "quotes_permitted")
    first = _papers(spark, d).filter("number IS NOT NULL").groupBy(F.col("number").alias("pmid")).agg(F.min_by(F.struct(*cols), "paper_id").alias("r")).select("pmid", "r.*")
    return cur.select("pmid", "id"), first.join(gone, "pmid", "left")


@query(f"{FULL}, {PAPER_SQL}, {EVAL_SQL} SELECT * FROM es")
def eval_set(spark: SparkSession, d: str) -> DataFrame:
    return papers.eval_set(*_gold(spark, d), "weave:")


@query(f"""{FULL}, {PAPER_SQL}, {EVAL_SQL}, x AS (SELECT 'total' AS part, 'all' AS value, n_cases FROM es UNION ALL SELECT 'split', split, n_cases FROM es UNION ALL SELECT 'track', track, n_cases FROM es
  UNION ALL SELECT 'tier', tier, n_cases FROM es UNION ALL SELECT 'single_split', split, n_cases FROM es WHERE track = 'single') SELECT part, value, count(*) AS papers, sum(n_cases)::BIGINT AS cases FROM x GROUP BY 1, 2""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return papers.eval_summary(papers.eval_set(*_gold(spark, d), "weave:"))


@query(f"""{FULL}, {PAPER_SQL}, b AS (SELECT DISTINCT pmid FROM documents WHERE has_body AND pmid IS NOT NULL)
SELECT CASE WHEN avail.pmid IS NULL THEN 'not_available' WHEN NOT coalesce(tier IN ('full_text_quotable', 'full_text_facts_only'), false) THEN 'tier' WHEN gold.pmid IN (SELECT pmid FROM gone) THEN 'retracted'
  WHEN coalesce(trim(pmcid), '') = '' THEN 'no_pmcid' WHEN gold.pmid NOT IN (SELECT pmid FROM b) THEN 'no_body' ELSE 'scored' END AS status, count(*) AS papers FROM gold LEFT JOIN avail USING (pmid) GROUP BY 1""")
def skip_counts(spark: SparkSession, d: str) -> DataFrame:
    return papers.skips(*_gold(spark, d), table(spark, d, "documents").filter("has_body AND pmid IS NOT NULL").select("pmid"))


@query(f"""{FULL}, {PAPER_SQL} SELECT coalesce(tier, 'none') AS tier, coalesce(nullif(trim(license), ''), 'none') AS license, count(*) AS papers, count(*) FILTER (trim(license) IN ('CC0', 'CC BY', 'CC BY-SA')) AS quotable,
  count(*) FILTER (coalesce(quotes_permitted, false)) AS permitted FROM pap GROUP BY 1, 2""")
def licence_audit(spark: SparkSession, d: str) -> DataFrame:
    return papers.licence_audit(_papers(spark, d))


@query(f"""{FULL}, {PAPER_SQL}, {EVAL_SQL} SELECT pmid, pmcid, license, starts_with(tier, 'full_text') AS in_oa_subset, quotes_permitted FROM es""")
def source_docs(spark: SparkSession, d: str) -> DataFrame:
    made = papers.source_doc(papers.eval_set(*_gold(spark, d), "weave:"))
    return made.select("pmid", *[F.col(f"source.{c}").alias(c) for c in ("pmcid", "license", "in_oa_subset", "quotes_permitted")])


@query(f"""{FULL}, {PAPER_SQL}, m AS (SELECT number AS pmid, min(trim(pmcid)) AS pmcid FROM pap WHERE number IS NOT NULL AND trim(pmcid) <> '' GROUP BY 1) SELECT gold.pmid, pmcid FROM gold LEFT JOIN m USING (pmid)""")
def registry_map(spark: SparkSession, d: str) -> DataFrame:
    known = _papers(spark, d).select(F.col("number").alias("pmid"), "pmcid")
    return papers.registry_map(known, _gold(spark, d)[0].filter("pmid IS NOT NULL"))


@query("SELECT DISTINCT doc_id FROM documents WHERE contains(lower(text), 'gait') AND contains(lower(text), 'swelling') AND pub_year BETWEEN 2000 AND 2020 ORDER BY doc_id LIMIT 20")
def find_documents(spark: SparkSession, d: str) -> DataFrame:
    return papers.find_documents(table(spark, d, "documents"), ["gait", "swelling"], (2000, 2020))


@query("""SELECT doc_id, length(text) > 2000 AS truncated, md5(substr(text, 1, 2000) || CASE WHEN length(text) > 2000 THEN chr(10) || '[truncated]' ELSE '' END) AS content FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)""")
def model_requests(spark: SparkSession, d: str) -> DataFrame:
    made = extract.requests(table(spark, d, "documents").select("doc_id", "text").distinct(), "Read the report.", "record_individuals", "any", cap=2000)
    body = F.from_json("request", "messages array<struct<content:string>>")
    return made.select("doc_id", "truncated", F.md5(F.get(body["messages"], F.lit(0))["content"]).alias("content"))


# diseases and terms
@query(WITH + f""", xr AS (SELECT regexp_replace(upper(trim(x.xref)), '^ORPHA:', 'ORPHANET:') AS k, dst AS term, coalesce(contains(x.modifier, 'equivalentTo'), false) AS eq FROM (SELECT tid, unnest(xrefs) AS x FROM (SELECT {clean('term_id')} AS tid, xrefs FROM terms)) JOIN alias ON src = tid
  WHERE regexp_matches(upper(trim(x.xref)), '^(OMIM|ORPHA|ORPHANET|DECIPHER):')),
best AS (SELECT k, coalesce(min(term) FILTER (eq), min(term)) AS term FROM xr GROUP BY 1),
asked AS (SELECT DISTINCT disease_id AS disease FROM disease_annotations WHERE disease_id IS NOT NULL UNION SELECT replace(x.xref, 'Orphanet:', 'orpha:') FROM (SELECT unnest(xrefs) AS x FROM terms) WHERE x.xref IS NOT NULL),
keyed AS (SELECT disease, regexp_replace(coalesce({clean('disease')}, ''), '^ORPHA:', 'ORPHANET:') AS k FROM asked)
SELECT disease, CASE WHEN starts_with(keyed.k, 'MONDO:') THEN dst ELSE best.term END AS term FROM keyed LEFT JOIN alias ON src = keyed.k LEFT JOIN best ON best.k = keyed.k""")
def normalise_diseases(spark: SparkSession, d: str) -> DataFrame:
    """Diseases of annotations and all cross references, these written in another way, as live terms."""
    b = Base(spark, d)
    xrefs = b.terms.select(F.explode("xrefs").alias("x")).select(F.replace(F.col("x.xref"), F.lit("Orphanet:"), F.lit("orpha:")).alias("disease"))
    asked = table(spark, d, "disease_annotations").select(F.col("disease_id").alias("disease")).unionByName(xrefs).filter("disease IS NOT NULL")
    return dag.normalise_diseases(asked, b.terms, b.alias)


@query(FULL + """ SELECT ref, dst IS NOT NULL AS known, dst AS term, t.name AS label FROM (SELECT DISTINCT term AS ref FROM ph WHERE term IS NOT NULL UNION SELECT disease FROM dx WHERE disease IS NOT NULL) LEFT JOIN alias ON src = ref LEFT JOIN t ON t.id = dst""")
def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    refs = records.assertions(b.current("phenotypes", "diagnoses", "variants")).filter("kind <> 'variant' AND about IS NOT NULL").select(F.col("about").alias("ref"))
    return dag.look_up(refs, b.rows, b.alias)


# records
@query(FULL + f"""SELECT pmid, kind, about, excluded, hgvs_c, min(id) AS first_id FROM (
  SELECT cur.source.pmid AS pmid, ph.id, 'phenotype' AS kind, term AS about, excluded, NULL AS hgvs_c FROM ph JOIN cur USING (id) UNION ALL SELECT cur.source.pmid, dx.id, 'diagnosis', disease, false, NULL FROM dx JOIN cur USING (id)
  UNION ALL SELECT pmid, id, 'variant', {clean('v.gene.id')}, false, v.hgvs_c FROM (SELECT source.pmid AS pmid, id, unnest(variants) AS v FROM cur)) WHERE pmid IS NOT NULL AND (about IS NOT NULL OR hgvs_c IS NOT NULL) GROUP BY ALL""")
def union_gold(spark: SparkSession, d: str) -> DataFrame:
    return records.union_gold(Base(spark, d).current("source", "phenotypes", "diagnoses", "variants"))


@query(f"""WITH del AS (SELECT id, dense_rank() OVER (PARTITION BY id ORDER BY ingested_at) AS number, phenotypes, diagnoses, variants FROM (SELECT DISTINCT * FROM case_records WHERE id IS NOT NULL AND ingested_at IS NOT NULL)),
k AS (SELECT id, number, {clean('p.term.id')} || CASE WHEN coalesce(p.excluded, false) THEN '!' ELSE '' END AS key, coalesce(len(p.evidence), 0) AS n FROM (SELECT id, number, unnest(phenotypes) AS p FROM del)
  UNION ALL SELECT id, number, 'dx:' || {clean('p.disease.id')}, 0 FROM (SELECT id, number, unnest(diagnoses) AS p FROM del) UNION ALL SELECT id, number, 'gene:' || {clean('p.gene.id')}, 0 FROM (SELECT id, number, unnest(variants) AS p FROM del)),
one AS (SELECT id, key, number, max(n) AS n FROM k WHERE key IS NOT NULL GROUP BY 1, 2, 3), nr AS (SELECT id, count(DISTINCT number) AS n_records FROM del GROUP BY 1),
per AS (SELECT id, key, round(count(*) / n_records::DOUBLE, 4) AS share, count(*) / n_records::DOUBLE < 0.67 AS review, least(sum(n), 5) AS kept FROM one JOIN nr USING (id) GROUP BY id, key, n_records)
SELECT nr.id, any_value(n_records) AS n_records, count(key) AS n_keys, coalesce(string_agg(key, ' ' ORDER BY key) FILTER (review), '') AS review_queue, coalesce(round(avg(share) + 1e-12, 4), 0) AS confidence,
  coalesce(sum(kept) FILTER (NOT starts_with(key, 'dx:') AND NOT starts_with(key, 'gene:')), 0)::BIGINT AS n_evidence FROM nr LEFT JOIN per USING (id) GROUP BY 1""")
def consensus_records(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries of a record as what several extractors say of one case."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "case_records").filter("id IS NOT NULL AND ingested_at IS NOT NULL").select("id", "ingested_at", "phenotypes", "diagnoses", "variants").distinct()
    merged = qa.consensus_records(cut(rows.withColumn("number", F.dense_rank().over(W.partitionBy("id").orderBy("ingested_at")))))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    kept = F.coalesce(F.aggregate(F.map_values("evidence"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return merged.select("id", "n_records", n(F.map_keys("agreement")).alias("n_keys"), F.coalesce(F.array_join("review_queue", " "), F.lit("")).alias("review_queue"), "confidence", kept.alias("n_evidence"))


@query(FULL + """ SELECT id, path FROM (
  SELECT id, unnest([CASE WHEN coalesce(len(p.evidence), 0) = 0 THEN 'phenotypes[' || (i - 1) || ']=' || coalesce(p.term.id, '') END FOR p, i IN coalesce(phenotypes, [])]) AS path FROM cur
  UNION ALL SELECT id, unnest([CASE WHEN coalesce(len(p.evidence), 0) = 0 THEN 'diagnoses[' || (i - 1) || ']=' || coalesce(p.disease.id, '') END FOR p, i IN coalesce(diagnoses, [])]) FROM cur
  UNION ALL SELECT id, unnest([CASE WHEN coalesce(len(p.evidence), 0) = 0 THEN 'variants[' || (i - 1) || ']=' || coalesce(p.gene.id, '') END FOR p, i IN coalesce(variants, [])]) FROM cur) WHERE path IS NOT NULL""")
def unprovenanced_paths(spark: SparkSession, d: str) -> DataFrame:
    return records.unprovenanced(Base(spark, d).current("phenotypes", "diagnoses", "variants")).select("id", F.explode("paths").alias("path"))


@query(FULL + """, o AS (SELECT id, string_agg(term || coalesce(onset, ''), ' ' ORDER BY term, coalesce(onset, '')) FILTER (NOT excluded) AS observed, string_agg(term, ' ' ORDER BY term) FILTER (excluded) AS excluded FROM (
  SELECT id, upper(trim(p.term.id)) AS term, coalesce(p.excluded, false) AS excluded, p.onset.iso8601duration AS onset FROM (SELECT id, unnest(phenotypes) AS p FROM cur) WHERE p.term.id IS NOT NULL) GROUP BY 1),
dd AS (SELECT id, string_agg(p.disease.id || '/' || coalesce(p.status, ''), ' ' ORDER BY p.disease.id || '/' || coalesce(p.status, '')) AS diseases FROM (SELECT id, unnest(diagnoses) AS p FROM cur) WHERE p.disease.id IS NOT NULL GROUP BY 1),
vv AS (SELECT id, string_agg(g, ' ' ORDER BY g) AS genes FROM (SELECT DISTINCT id, coalesce(p.gene.id, '') || '/' || coalesce(p.hgvs_c, '') AS g FROM (SELECT id, unnest(variants) AS p FROM cur) WHERE p.gene.id IS NOT NULL) GROUP BY 1)
SELECT cur.id, source.pmid AS pmid, subject.sex AS sex, subject.age_at_last_encounter.iso8601duration AS age, coalesce(observed, '') AS observed, coalesce(o.excluded, '') AS excluded, coalesce(diseases, '') AS diseases, coalesce(genes, '') AS genes
FROM cur LEFT JOIN o USING (id) LEFT JOIN dd USING (id) LEFT JOIN vv USING (id)""")
def packet_records(spark: SparkSession, d: str) -> DataFrame:
    """Records written as phenopackets and read back, with onsets, status, and variants."""
    r = records.packet_records(records.to_phenopacket(Base(spark, d).current()))
    joined = lambda x: F.coalesce(F.array_join(F.array_sort(x), " "), F.lit(""))
    name = lambda p: F.upper(F.trim(p["term"]["id"]))
    seen = F.filter("phenotypes", lambda p: ~p["excluded"])
    by_term = F.transform(F.array_sort(F.transform(seen, lambda p: F.struct(name(p).alias("t"), F.coalesce(p["onset"]["iso8601duration"], F.when(p["onset"]["gestational_weeks"].isNotNull(), F.concat(F.lit("P"), p["onset"]["gestational_weeks"], F.lit("W"))), F.lit("")).alias("o")))), lambda x: F.concat(x["t"], x["o"]))
    return r.select(
        "id", "source.pmid", "subject.sex", F.col("subject.age_at_last_encounter.iso8601duration").alias("age"), F.coalesce(F.array_join(by_term, " "), F.lit("")).alias("observed"),
        joined(F.transform(F.filter("phenotypes", lambda p: p["excluded"]), name)).alias("excluded"),
        joined(F.transform("diagnoses", lambda x: F.concat(x["disease"]["id"], F.lit("/"), F.coalesce(x["status"], F.lit(""))))).alias("diseases"),
        joined(F.array_distinct(F.transform(F.filter("variants", lambda v: v["gene"]["id"].isNotNull()), lambda v: F.concat(v["gene"]["id"], F.lit("/"), F.coalesce(v["hgvs_c"], F.lit("")))))).alias("genes"),
    )


@query(FULL + "," + FIRST_SQL + """, e AS (SELECT cur.id, cur.source.pmid AS pmid, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM cur LEFT JOIN (SELECT coalesce(pr.id, ob.id) AS id, count(pr.id) FILTER (ob.id IS NOT NULL)::DOUBLE AS tp,
  count(pr.id) FILTER (ob.id IS NULL)::DOUBLE AS fp, count(ob.id) FILTER (pr.id IS NULL)::DOUBLE AS fn FROM pr FULL JOIN ob ON pr.id = ob.id AND pr.term = ob.term GROUP BY 1) USING (id)),
f AS (SELECT id, pmid, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1 FROM e WHERE pmid IS NOT NULL)
SELECT pmid, id, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY round(f1, 9) DESC, id) = 1""")
def best_individual(spark: SparkSession, d: str) -> DataFrame:
    """Of each paper's records the one whose first delivery comes closest to its current one."""
    b, _, _, pred, gold, cases = cq._paper_pairs(spark, d)
    val = lambda x: x.select("id", F.col("term").alias("value"))
    scores = metrics.with_prf(metrics.exact(val(pred), val(gold), ["id"], cases)).withColumn("f1", F.round("f1", 9))
    where = b.current("source").select("id", F.col("source.pmid").alias("pmid")).filter("pmid IS NOT NULL")
    return metrics.best_of(scores.join(where, "id"), "pmid", "id").withColumn("f1", F.round("f1", 6))


@query(FULL + "," + FIRST_SQL + """, pg AS (SELECT DISTINCT cur.source.pmid AS pmid, term FROM ob JOIN cur USING (id) WHERE cur.source.pmid IS NOT NULL), pp AS (SELECT DISTINCT cur.source.pmid AS pmid, term FROM pr JOIN cur USING (id) WHERE cur.source.pmid IS NOT NULL),
c AS (SELECT coalesce(pp.pmid, pg.pmid) AS pmid, count(pp.pmid) FILTER (pg.pmid IS NOT NULL)::DOUBLE AS tp, count(pp.pmid) FILTER (pg.pmid IS NULL)::DOUBLE AS fp, count(pg.pmid) FILTER (pp.pmid IS NULL)::DOUBLE AS fn FROM pp FULL JOIN pg ON pp.pmid = pg.pmid AND pp.term = pg.term GROUP BY 1)
SELECT pmid, n_cases = 1 AS single, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT source.pmid AS pmid, count(*) AS n_cases FROM cur WHERE source.pmid IS NOT NULL GROUP BY 1) LEFT JOIN c USING (pmid)""")
def paper_prf(spark: SparkSession, d: str) -> DataFrame:
    """Findings by paper: of a paper with one record that record's, of others what all of its records say together."""
    b, _, _, pred, gold, _ = cq._paper_pairs(spark, d)
    where = cut(b.current("source").select("id", F.col("source.pmid").alias("pmid")).filter("pmid IS NOT NULL"))
    by_paper = lambda x: x.join(where, "id").select("pmid", F.col("term").alias("value"))
    n = where.groupBy("pmid").agg((F.count(F.lit(1)) == 1).alias("single"))
    return metrics.exact(by_paper(pred), by_paper(gold), ["pmid"], n).join(n, "pmid").select("pmid", "single", "tp", "fp", "fn")


@query(FULL + "," + FIRST_SQL + "," + cq.GRADED_SQL + """, jx AS (SELECT DISTINCT id, ancestor FROM pr JOIN closed USING (term)), jy AS (SELECT DISTINCT id, ancestor FROM ob JOIN closed USING (term)),
jj AS (SELECT coalesce(jx.id, jy.id) AS id, count(*) FILTER (jx.id IS NOT NULL AND jy.id IS NOT NULL) / count(*)::DOUBLE AS j FROM jx FULL JOIN jy ON jx.id = jy.id AND jx.ancestor = jy.ancestor GROUP BY 1),
t4 AS (SELECT sum(tp_p) / sum(tp_p + fp) AS p, sum(tp_r) / sum(tp_r + fn) AS r FROM g)
SELECT (SELECT count(*) FROM cur) AS n_cases, (SELECT round(avg(coalesce(j, 1.0)), 4) FROM cur LEFT JOIN jj USING (id)) AS profile_jaccard_mean, (SELECT count(*) FROM ob) AS gold_observed_total, (SELECT count(*) FROM pr) AS pred_observed_total,
  (SELECT round(2 * p * r / (p + r), 4) FROM t4) AS primary_value""")
def eval_totals(spark: SparkSession, d: str) -> DataFrame:
    """The rest of an evaluation's report beside ``field_cube`` and ``bootstrap_ci``: totals, mean closure Jaccard, graded micro F1."""
    b, closed, pred, gold, graded = cq._graded(spark, d)
    cases = graded.select("id")
    one = lambda df: df.withColumn("_k", F.lit(1))
    parts = [
        graded.agg(F.count(F.lit(1)).alias("n_cases")), metrics.closure_jaccard(pred, gold, closed, ["id"], cases).agg(F.round(F.avg("jaccard"), 4).alias("profile_jaccard_mean")),
        gold.agg(F.count(F.lit(1)).alias("gold_observed_total")), pred.agg(F.count(F.lit(1)).alias("pred_observed_total")),
        metrics.with_prf(graded.agg(*[F.sum(c).alias(c) for c in metrics.PARTS])).select(F.round("f1", 4).alias("primary_value")),
    ]
    out = one(parts[0])
    for x in parts[1:]:
        out = out.join(one(x), "_k")  # a row each
    return out.drop("_k")


@query(f"""WITH p AS (SELECT *, nullif(regexp_replace(pmid, '[^0-9]', '', 'g'), '') AS num FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC) AS rn FROM eval_papers) WHERE rn = 1), s AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY paper_id) AS seen FROM p)
SELECT paper_id FROM s WHERE trim(license) IN ('CC0', 'CC BY', 'CC BY-SA') AND trim(abstract) <> '' AND (title IS NULL OR NOT regexp_matches(title, '(?i)\b(review|meta-analysis|systematic|scoping|narrative)\b|current (status|approaches|perspectives|concepts)|\bstate of the art\b|\bupdate on\b|\badvances in\b|\boverview of\b|\bwhat we know\b'))
  AND (num IS NULL OR num NOT IN (SELECT source.pmid FROM case_records WHERE source.pmid IS NOT NULL)) AND (num IS NULL OR seen = 1) AND n_gold_cases > 0 ORDER BY paper_id LIMIT 20""")
def kept_papers(spark: SparkSession, d: str) -> DataFrame:
    """A corpus that stops at 20 kept papers."""
    from caseweave.plans.corpus import kept_papers as kept
    from caseweave.plans.corpus import reject_reasons

    cols = ["pmid", "license", "abstract", "title", "n_gold_cases"]
    latest = newest_values(table(spark, d, "eval_papers"), "paper_id", "loaded_at", cols, {c: F.col(c) for c in cols})
    curated = table(spark, d, "case_records").select(F.col("source.pmid").alias("number")).filter("number IS NOT NULL").distinct()
    return kept(reject_reasons(latest, curated), 20).select("paper_id")


def _answered(spark: SparkSession, d: str) -> DataFrame:
    """What the records say, put as a model's answer and read against the first text of their paper."""
    b = Base(spark, d)
    quoted = lambda x: F.get(x["evidence"], F.lit(0))["quote"]
    findings = F.transform("phenotypes", lambda p: F.struct(quoted(p).alias("quote"), p["term"]["label"].alias("label"), F.coalesce(p["excluded"], F.lit(False)).alias("absent"), p["onset"]["iso8601duration"].alias("onset")))
    v = F.get("variants", F.lit(0))
    one = F.struct(findings.alias("findings"), v["gene"]["label"].alias("gene_symbol"), v["hgvs_c"].alias("hgvs_c"), quoted(F.get("diagnoses", F.lit(0))).alias("diagnosis_quote"))
    cur = b.current("source", "phenotypes", "diagnoses", "variants")
    texts = _first_texts(spark, d)
    said = cur.select(F.col("source.pmid").alias("pmid"), F.to_json(F.array(one)).alias("individuals")).join(texts.select("pmid", "doc_id"), "pmid").select("doc_id", "individuals")
    docs = texts.select("doc_id", "text", F.array(F.struct(F.lit("body").alias("section"), F.lit(0).alias("start"), F.length("text").alias("end"))).alias("spans"), F.concat(F.lit("PMID:"), "pmid").alias("curie"), F.lit(True).alias("quotes_permitted"))
    labels = dag.label_index(b.terms)
    words = lambda prefix: grounding.dictionary(labels.filter(F.col("term").startswith(prefix)))
    named = cur.select(F.explode("variants").alias("v")).select(F.upper(F.trim("v.gene.label")).alias("symbol"), clean_id(F.col("v.gene.id")).alias("gene")).filter("symbol IS NOT NULL AND gene IS NOT NULL")
    genes = named.groupBy("symbol").agg(F.min("gene").alias("gene")).select("symbol", "gene", F.col("symbol").alias("approved"), F.array("symbol").alias("names"))
    return extract.answers(said, docs, words("HP:"), words("MONDO:"), genes, b.rows.select(F.col("id").alias("term"), F.col("name").alias("label")))


@query(FULL + """, fdoc AS (SELECT * FROM (SELECT doc_id, pmid, text, row_number() OVER (PARTITION BY pmid ORDER BY doc_id) AS k FROM documents WHERE pmid IS NOT NULL) WHERE k = 1),
fi AS (SELECT doc_id, text, regexp_replace(p.evidence[1].quote, '^\\s+|\\s+$', '', 'g') AS q, p IS NOT NULL AS there FROM (SELECT doc_id, text, unnest(phenotypes) AS p FROM cur JOIN fdoc ON fdoc.pmid = cur.source.pmid)),
n AS (SELECT doc_id, count(*) FILTER (there) AS findings, count(*) FILTER (there AND NOT coalesce(q <> '' AND (contains(text, q) OR contains(text, regexp_replace(q, '\\s+', ' ', 'g'))), false)) AS lost FROM fi GROUP BY 1)
SELECT doc_id, count(*) AS individuals, coalesce(any_value(findings), 0) AS findings, coalesce(any_value(lost), 0) AS quote_not_found FROM cur JOIN fdoc ON fdoc.pmid = cur.source.pmid LEFT JOIN n USING (doc_id) GROUP BY 1""")
def answer_counters(spark: SparkSession, d: str) -> DataFrame:
    r = _answered(spark, d)
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("individuals"), F.sum("findings_returned").alias("findings"), F.sum("quote_not_found").alias("quote_not_found"))


@query()
def answer_records(spark: SparkSession, d: str) -> DataFrame:
    r = _answered(spark, d)
    return r.select("doc_id", "record.id", F.size("record.phenotypes").alias("n_findings"), F.size("record.diagnoses").alias("n_diagnoses"), F.size("record.variants").alias("n_variants"), "grounded", "quote_ungroundable")


# audits
def _stated(spark: SparkSession, d: str, b: Base) -> DataFrame:
    cur = b.current("diagnoses")
    stated = cur.select("id", F.explode("diagnoses").alias("x")).filter("x.stated_in_abstract").select("id", clean_id(F.col("x.disease.id")).alias("disease")).filter("disease IS NOT NULL")
    rec = table(spark, d, "case_records").filter("id IS NOT NULL")
    first = rec.groupBy("id").agg(F.min_by("diagnoses", F.struct("ingested_at", F.xxhash64("diagnoses"))).alias("diagnoses"))
    predicted = records.diagnosis_ids(first).select("id", F.explode("diseases").alias("disease"))
    live = lambda x: qa.live(x, "disease", b.alias)
    return qa.stated_agreement(live(stated), live(predicted), b.closure())


@query(FULL + """, fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS FIRST) AS rn FROM case_records WHERE id IS NOT NULL) WHERE rn = 1),
st AS (SELECT DISTINCT id, dst AS s FROM (SELECT id, unnest(diagnoses) AS x FROM cur) JOIN alias ON src = """ + clean("x.disease.id") + """ WHERE x.stated_in_abstract),
pd AS (SELECT DISTINCT id, dst AS p FROM (SELECT id, unnest(diagnoses) AS x FROM fd) JOIN alias ON src = """ + clean("x.disease.id") + """),
ok AS (SELECT DISTINCT id FROM st JOIN pd USING (id) WHERE EXISTS (SELECT 1 FROM closed c WHERE c.term = s AND c.ancestor = p OR c.term = p AND c.ancestor = s))
SELECT id, CASE WHEN id IN (SELECT id FROM st) THEN id IN (SELECT id FROM ok) END AS agrees FROM (SELECT id FROM st UNION SELECT id FROM pd)""")
def stated_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d, Base(spark, d))


def _notices(spark: SparkSession, d: str) -> DataFrame:
    cur = cut(newest_values(table(spark, d, "case_records"), "id", "ingested_at", ["source"], {c: F.col(f"source.{c}") for c in ("pmid", "doi", "retracted")}))
    marked = cur.filter("retracted").select("pmid", "doi", F.lit("marked in the records").alias("reason"), F.col("ingested_at").cast("string").alias("at"))
    archive = _papers(spark, d).filter("tier IS NULL AND number IS NOT NULL").select(F.col("number").alias("pmid"))
    return qa.check_retractions(cur.select("id", "pmid", "doi"), qa.retraction_keys(marked), archive)


@query(FULL + f""", {PAPER_SQL}, mk AS (SELECT source.pmid AS pmid, lower(trim(source.doi)) AS doi FROM cur WHERE source.retracted), ar AS (SELECT DISTINCT number AS pmid FROM pap WHERE tier IS NULL AND number IS NOT NULL)
SELECT id, source.pmid AS pmid, source.doi AS doi, CASE WHEN source.pmid IN (SELECT trim(pmid) FROM mk WHERE trim(pmid) NOT IN ('', '0')) THEN 'marked in the records' WHEN source.pmid IN (SELECT pmid FROM ar) THEN 'flagged by the archive'
  WHEN lower(trim(source.doi)) IN (SELECT doi FROM mk WHERE doi <> '') THEN 'marked in the records' END AS notice FROM cur""")
def retraction_notices(spark: SparkSession, d: str) -> DataFrame:
    """Records whose paper is marked retracted in any record, by number, else by DOI; papers without a tier stand for the archive's own list."""
    return _notices(spark, d)


def _first_texts(spark: SparkSession, d: str) -> DataFrame:
    """(pmid, doc_id, text): the first document of each paper."""
    docs = table(spark, d, "documents").filter("pmid IS NOT NULL")
    first = docs.groupBy("pmid").agg(F.min("doc_id").alias("doc_id"))
    return docs.select("doc_id", "pmid", "text").join(first, ["pmid", "doc_id"], "left_semi").dropDuplicates(["pmid"])


def _variant_evidence(cur: DataFrame, texts: DataFrame) -> DataFrame:
    v = cur.select("id", F.col("source.pmid").alias("pmid"), F.posexplode("variants").alias("pos", "v"))
    e = F.get("v.evidence", F.lit(0))
    flat = v.select(
        F.concat_ws("#", "id", "pos").alias("key"), "pmid", F.coalesce(F.col("v.gene.label"), F.lit("")).alias("gene_label"), F.coalesce(F.col("v.hgvs_c"), F.lit("")).alias("hgvs_c"),
        e["start_char"].alias("start_char"), e["end_char"].alias("end_char"), (F.coalesce(F.size("v.evidence"), F.lit(0)) > 0).alias("has_evidence"),
    )
    return flat.join(texts.select("pmid", "doc_id"), "pmid", "left").drop("pmid")


@query(FULL + """, fdoc AS (SELECT * FROM (SELECT pmid, text, row_number() OVER (PARTITION BY pmid ORDER BY doc_id) AS k FROM documents WHERE pmid IS NOT NULL) WHERE k = 1),
vx AS (SELECT id || '#' || (i - 1) AS key, pm, v, v.evidence[1] AS e FROM (SELECT id, source.pmid AS pm, unnest(variants) AS v, generate_subscripts(variants, 1) AS i FROM cur))
SELECT key, CASE WHEN coalesce(len(v.evidence), 0) = 0 THEN 'no_evidence' WHEN e.start_char IS NULL OR e.end_char IS NULL OR text IS NULL OR e.end_char > length(text) THEN 'offset_out_of_range'
  WHEN v.gene.label <> '' AND contains(substr(text, e.start_char + 1, e.end_char - e.start_char), v.gene.label) OR v.hgvs_c <> '' AND contains(substr(text, e.start_char + 1, e.end_char - e.start_char), v.hgvs_c) THEN 'supported'
  ELSE 'term_not_in_span' END AS verdict FROM vx LEFT JOIN fdoc ON fdoc.pmid = pm""")
def variant_verdicts(spark: SparkSession, d: str) -> DataFrame:
    texts = _first_texts(spark, d)
    return qa.variant_verdicts(_variant_evidence(Base(spark, d).current("source", "variants"), texts), texts).select("key", "verdict")


def _span_verdicts(spark: SparkSession, d: str, b: Base) -> DataFrame:
    """Verdicts of all evidence of findings against the first document of the paper."""
    texts = cut(_first_texts(spark, d))
    p = b.current("source", "phenotypes").select("id", F.col("source.pmid").alias("pmid"), F.posexplode("phenotypes").alias("pos", "p"))
    e = p.select("id", "pmid", "pos", "p", F.posexplode_outer("p.evidence").alias("k", "e"))
    flat = e.select(F.concat_ws("#", "id", "pos", "k").alias("key"), "pmid", clean_id(F.col("p.term.id")).alias("term"), F.coalesce("p.excluded", F.lit(False)).alias("excluded"), "e.start_char", "e.end_char")
    placed = cut(dag.resolve(flat, "term", b.alias).join(texts.select("pmid", "doc_id"), "pmid", "left").drop("pmid"))
    span = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    spans = placed.join(texts.select("doc_id", "text"), "doc_id").filter("start_char >= 0 AND end_char > start_char").select("key", span.alias("text"))
    phrases = grounding.dictionary(dag.label_index(b.terms), dag.label_index(b.terms, ("BROAD", "RELATED"), names=False))
    found = qa.live(grounding.ground(spans, phrases, keep=("key",)).select("key", F.col("term").alias("found")), "found", b.alias)
    return qa.span_verdicts(placed, texts, found, b.closure()).select("key", "verdict")


@query()
def span_rates(spark: SparkSession, d: str) -> DataFrame:
    return qa.support_rates(_span_verdicts(spark, d, Base(spark, d)))


@query()
def qa_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rule violations, span verdicts, agreement with stated diagnoses and retracted sources in one report."""
    b = Base(spark, d)
    return qa.audit(cq._violations(spark, d)[1], _span_verdicts(spark, d, b), _stated(spark, d, b), _notices(spark, d))


@query(FULL + """, ev AS (SELECT DISTINCT pmid, e.quote AS quote FROM (SELECT pmid, unnest(p.evidence) AS e FROM (SELECT source.pmid AS pmid, unnest(phenotypes) AS p FROM cur) UNION ALL
  SELECT pmid, unnest(p.evidence) FROM (SELECT source.pmid AS pmid, unnest(diagnoses) AS p FROM cur) UNION ALL SELECT pmid, unnest(p.evidence) FROM (SELECT source.pmid AS pmid, unnest(variants) AS p FROM cur)) WHERE pmid IS NOT NULL AND trim(e.quote) <> ''),
ok AS (SELECT DISTINCT pmid, quote FROM ev JOIN documents d USING (pmid) WHERE contains(text, regexp_replace(quote, '^\\s+|\\s+$', '', 'g')) OR contains(text, regexp_replace(regexp_replace(quote, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')))
SELECT pmid, count(*) AS quotes, count(ok.quote) AS verified FROM ev LEFT JOIN ok USING (pmid, quote) GROUP BY 1""")
def quote_audit(spark: SparkSession, d: str) -> DataFrame:
    """(pmid, quotes, verified): how many quotes of each paper's records stand in a text of the paper."""
    asked = cut(cq._evidence_quotes(table(spark, d, "case_records")).filter("trim(quote) <> ''").distinct())
    hits = quotes.locate_quotes(cq._paper_texts(spark, d), asked).join(table(spark, d, "documents").select("doc_id", F.col("pmid").alias("key")).distinct(), "doc_id").select("key", "quote").distinct().withColumn("_ok", F.lit(1))
    return asked.join(hits, ["key", "quote"], "left").groupBy(F.col("key").alias("pmid")).agg(F.count(F.lit(1)).alias("quotes"), F.count("_ok").alias("verified"))


# search pages
KEPT_SQL = """seen3 AS (SELECT ph.id, alias.dst AS term FROM ph JOIN alias ON src = ph.term WHERE NOT excluded), keep3 AS (SELECT DISTINCT id, term FROM seen3 WHERE id IN (SELECT id FROM seen3 GROUP BY 1 HAVING count(*) >= 3))"""


@query(FULL + f""", {KEPT_SQL}, used AS (SELECT term, count(*) AS n FROM keep3 GROUP BY 1), voc AS (SELECT DISTINCT ancestor AS term FROM closed JOIN used USING (term)), num AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS number FROM voc),
up AS (SELECT closed.term, string_agg(number::VARCHAR, ' ' ORDER BY number) AS ancestors FROM closed JOIN num ON num.term = ancestor GROUP BY 1)
SELECT number, num.term, coalesce(t.name, num.term) AS label, round(ic, 3) AS ic, coalesce(n, 0) AS n_records, ancestors FROM num JOIN up USING (term) LEFT JOIN ic USING (term) LEFT JOIN used USING (term) LEFT JOIN t ON t.id = num.term""")
def search_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    closed = b.closure()
    rows = records.current_observed(table(spark, d, "case_records"), distinct=False).select("id", F.explode("terms").alias("term"))
    kept = papers.informative(dag.resolve(rows, "term", b.alias).filter("term IS NOT NULL"))
    return papers.search_vocabulary(kept, closed, b.ic(closed), b.rows).withColumn("ancestors", F.array_join("ancestors", " "))


@query(FULL + """, g3 AS (SELECT id, upper(g) AS gene FROM (SELECT id, unnest(list_slice([v.gene.label FOR v IN variants IF v.gene.label IS NOT NULL], 1, 3)) AS g FROM cur)) SELECT gene, string_agg(DISTINCT id, ' ' ORDER BY id) AS ids FROM g3 GROUP BY 1""")
def gene_postings(spark: SparkSession, d: str) -> DataFrame:
    return papers.gene_postings(Base(spark, d).current("variants")).withColumn("ids", F.array_join("ids", " "))


@query(FULL + "," + RANK_SQL.replace("pp AS (SELECT DISTINCT id AS profile, term AS b FROM ob)", "pp AS (SELECT DISTINCT id AS profile, term AS b FROM ob WHERE id IN (SELECT id FROM gx WHERE gene IS NOT NULL))") + " SELECT query, profile, score, n_terms, rank FROM top")
def similar_with_gene(spark: SparkSession, d: str) -> DataFrame:
    """Ranking among the records that name a gene."""
    b = Base(spark, d)
    closed = b.closure()
    named = search.postings(b.current("phenotypes", "diagnoses", "variants")).filter("kind = 'variant'").select("id").distinct()
    every = cut(b.live(b.observed()))
    asked = table(spark, d, "case_hits").filter("hit_id % 50 = 0").select(F.col("query_case_id").alias("id")).distinct()
    queries = every.join(asked, "id", "left_semi").withColumnRenamed("id", "query")
    return rank.search(queries, every.join(named, "id", "left_semi").withColumnRenamed("id", "profile"), closed, b.ic(closed), 20, places=5)


@query(FULL + """, p AS (SELECT id, 'phenotype' AS kind, term AS value FROM ph WHERE NOT excluded UNION SELECT id, 'diagnosis', disease FROM dx UNION SELECT id, 'variant', gene FROM gx)
SELECT kind, value, count(DISTINCT id) AS n_records, row_number() OVER (PARTITION BY kind ORDER BY count(DISTINCT id) DESC, value) AS place FROM p WHERE value IS NOT NULL GROUP BY 1, 2 QUALIFY place <= 10""")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    return search.most_common(search.postings(Base(spark, d).current("phenotypes", "diagnoses", "variants")))


@query(FULL + f""" SELECT upper(v.gene.label) AS label, count(DISTINCT id) AS n_records FROM (SELECT id, unnest(variants) AS v FROM cur) WHERE {clean('v.gene.id')} IS NOT NULL AND starts_with(upper(v.gene.label), 'S') GROUP BY 1 ORDER BY n_records DESC, label LIMIT 20""")
def suggest_genes(spark: SparkSession, d: str) -> DataFrame:
    return search.gene_suggestions(search.postings(Base(spark, d).current("phenotypes", "diagnoses", "variants")), "s")


@query(FULL + """, p AS (SELECT id, 'phenotype' AS kind, term AS value FROM ph WHERE NOT excluded UNION SELECT id, 'diagnosis', disease FROM dx UNION SELECT id, 'variant', gene FROM gx) SELECT kind, value, count(DISTINCT id) AS n_records FROM p WHERE value IS NOT NULL GROUP BY 1, 2""")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.value_counts(search.postings(Base(spark, d).current("phenotypes", "diagnoses", "variants")))


@query(FULL + """ SELECT DISTINCT cur.id FROM cur JOIN gx USING (id) WHERE gene IS NOT NULL AND source.license = 'CC BY' ORDER BY cur.id LIMIT 50""")
def case_listing(spark: SparkSession, d: str) -> DataFrame:
    cur = Base(spark, d).current("source", "phenotypes", "diagnoses", "variants")
    ids = search.postings(cur).filter("kind = 'variant'").select("id").distinct()
    return search.listing(ids, cur, license="CC BY").select("id")


@query()
def prose_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the texts by the extractor's own rules, counted."""
    made = extract.section_sentences(cq._whole_texts(spark, d))
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


@query()
def pattern_offsets(spark: SparkSession, d: str) -> DataFrame:
    return grounding.pattern_offsets(table(spark, d, "documents").select("doc_id", "text").distinct())


@query("SELECT id, coalesce('PMID:' || nullif(trim(source.pmid), ''), 'PMCID:' || nullif(trim(source.pmcid), ''), 'DOI:' || nullif(trim(source.doi), ''), 'UNKNOWN:0') AS curie FROM (SELECT DISTINCT id, source FROM case_records)")
def source_curies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_records").select("id", "source").distinct().select("id", tx.curie(F.col("source.pmid"), F.col("source.pmcid"), F.col("source.doi")).alias("curie"))
