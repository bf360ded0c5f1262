"""Queries over the tables of the training-data problems, and SQL that computes the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions.ids import clean_id
from caseweave.llm import consensus, distinctive, mixing, sentences, setsim, spans, splits, tokenise
from caseweave.operators.records import current_observed
from caseweave.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setsim.similar_pairs(current_observed(table(spark, d, "case_records")), "id", "terms", threshold=0.75, min_size=4)
    return pairs.select(F.col("id_a").alias("case_id_a"), F.col("id_b").alias("case_id_b"))


def scored_terms(spark: SparkSession, d: str, repeats: bool) -> DataFrame:
    """(record_kind, key, term, tf, df, cf, score): terms of current records and of hits, scored against current records."""
    records = cut(current_observed(table(spark, d, "case_records"), distinct=not repeats))
    counts = distinctive.term_counts(records, repeats=repeats)
    stats = distinctive.collection_statistics(counts, records.agg(F.count(F.lit(1))))
    hits = table(spark, d, "case_hits").filter(F.col("hit_id").isNotNull()).select(
        F.col("hit_id").cast("string").alias("id"), F.transform("shared", lambda s: clean_id(s["id"])).alias("terms")
    ).distinct()
    both = counts.withColumn("record_kind", F.lit("case")).unionByName(distinctive.term_counts(hits, repeats=repeats).withColumn("record_kind", F.lit("hit")))
    scored = distinctive.distinctiveness(both.select(F.struct("record_kind", "key").alias("key"), "term", "tf"), stats)
    return scored.select("key.record_kind", "key.key", "term", "tf", "df", "cf", "score")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = distinctive.most_distinctive(scored_terms(spark, d, repeats=False), "record_kind", "key")
    return best.select("record_kind", F.col("key").alias("record_key"), F.col("term").alias("term_id"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    s = scored_terms(spark, d, repeats=True)
    return s.select("record_kind", F.col("key").alias("record_key"), F.col("term").alias("term_id"), "tf", "df", "cf", F.round("score", 6).alias("score"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = splits.overlaps(table(spark, d, "eval_papers"))
    return found.select(F.least("eval_id", "train_id").alias("paper_id_a"), F.greatest("eval_id", "train_id").alias("paper_id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.latest(table(spark, d, "eval_papers"))
    return splits.overlap_report(rows, splits.overlaps_of(rows))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.Consensus(table(spark, d, "extractor_votes")).items.select("item_id", "label")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return consensus.Consensus(table(spark, d, "extractor_votes")).items


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.Consensus(table(spark, d, "extractor_votes")).annotators


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.share_report(mixing.mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).pairs()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents")).shares()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_scores, p3_found, p3_report, p4_found, p6_found, p6_items, p6_annotators, p8_ids, p9_mix, p9_shares,
        p10_found, p10_shares,
    )
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
_CURRENT = """cur AS (
  SELECT id, phenotypes FROM (SELECT id, phenotypes, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) rn
  FROM case_records WHERE id IS NOT NULL) WHERE rn = 1),
seen AS (
  SELECT DISTINCT id, upper(trim(p.term.id, {b})) AS term FROM (SELECT id, unnest(phenotypes) AS p FROM cur)
  WHERE NOT coalesce(p.excluded, false) AND trim(coalesce(p.term.id, ''), {b}) <> '')""".format(b=_BLANKS)

_P2 = f"""WITH {_CURRENT},
df AS (SELECT term, count(*) AS df FROM seen GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM cur),
hit AS (SELECT DISTINCT hit_id::VARCHAR AS id, upper(trim(s.id, {_BLANKS})) AS term FROM (SELECT hit_id, unnest(shared) AS s FROM case_hits)
  WHERE trim(coalesce(s.id, ''), {_BLANKS}) <> ''),
alls AS (SELECT 'case' AS record_kind, id, term FROM seen UNION ALL SELECT 'hit', id, term FROM hit),
scored AS (SELECT record_kind, id, term, coalesce(df, 0) AS df FROM alls LEFT JOIN df USING (term))
"""

_P3 = r"""WITH p AS (
  SELECT paper_id, lower(trim(split, {b})) AS split, abstract, source,
    nullif(regexp_replace(regexp_replace(pmid, '[^0-9]+', '', 'g'), '^0+', ''), '') AS num
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC NULLS LAST) rn FROM eval_papers) WHERE rn = 1),
side AS (SELECT *, CASE WHEN split = 'train' THEN 't' WHEN split IN ('dev', 'test') THEN 'e' END AS side FROM p),
words AS (SELECT paper_id, side, regexp_extract_all(lower(abstract), '[\p{{L}}\p{{N}}]+') AS w FROM side WHERE side IS NOT NULL),
grams AS (SELECT DISTINCT paper_id, side, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT paper_id, side, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 20)),
size AS (SELECT paper_id, count(*) AS n FROM grams GROUP BY 1),
pair AS (SELECT e.paper_id AS e, t.paper_id AS t, count(*) AS k FROM grams e JOIN grams t USING (g)
  WHERE e.side = 'e' AND t.side = 't' GROUP BY 1, 2),
found AS (
  SELECT e, t FROM pair JOIN size a ON a.paper_id = e JOIN size b ON b.paper_id = t WHERE k >= 0.7 * (a.n + b.n - k) - 1e-9
  UNION SELECT a.paper_id, b.paper_id FROM side a JOIN side b ON a.num = b.num WHERE a.side = 'e' AND b.side = 't')
""".format(b=_BLANKS)

_P10 = """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM t)),
once AS (SELECT DISTINCT doc_id, h FROM w), hot AS (SELECT h FROM once GROUP BY 1 HAVING count(*) > 1)
"""

ORACLE: dict[str, str] = {
    "p10_found": _P10 + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM once a JOIN hot USING (h) JOIN once b ON b.h = a.h AND a.doc_id < b.doc_id",
    "p10_shares": _P10 + """, s AS (SELECT DISTINCT doc_id, i FROM w JOIN hot USING (h)), c AS (SELECT doc_id, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS more FROM s)
SELECT c.doc_id, any_value(length(text)) AS n_chars, sum(more)::BIGINT AS shared_chars, round(sum(more) / any_value(length(text))::DOUBLE, 6) AS share FROM c JOIN t USING (doc_id) GROUP BY 1""",
    "p1_found": f"""WITH {_CURRENT},
size AS (SELECT id, count(*) AS n FROM seen GROUP BY id HAVING count(*) >= 4),
s AS (SELECT seen.id, term, n FROM seen JOIN size USING (id)),
pair AS (SELECT a.id AS x, b.id AS y, a.n AS na, b.n AS nb, count(*) AS k FROM s a JOIN s b USING (term) WHERE a.id < b.id GROUP BY 1, 2, 3, 4)
SELECT x AS case_id_a, y AS case_id_b FROM pair WHERE k >= 0.75 * (na + nb - k) - 1e-9""",
    "p2_found": _P2 + """SELECT record_kind, id AS record_key, term AS term_id FROM (
  SELECT *, min(df) OVER (PARTITION BY record_kind, id) AS least FROM scored) WHERE df = least""",
    "p2_scores": f"""WITH {_CURRENT},
obs AS (SELECT id, upper(trim(p.term.id, {_BLANKS})) AS term FROM (SELECT id, unnest(phenotypes) AS p FROM cur) WHERE NOT coalesce(p.excluded, false) AND trim(coalesce(p.term.id, ''), {_BLANKS}) <> ''),
tf AS (SELECT id, term, count(*) AS tf FROM obs GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n FROM cur),
hit AS (SELECT id, term, count(*) AS tf FROM (SELECT id, upper(trim(s.id, {_BLANKS})) AS term FROM (SELECT id, unnest(shared) AS s FROM (SELECT DISTINCT hit_id::VARCHAR AS id, [{{'id': upper(trim(x.id, {_BLANKS}))}} FOR x IN shared] AS shared FROM case_hits))
  WHERE s.id <> '') GROUP BY 1, 2),
alls AS (SELECT 'case' AS record_kind, id, term, tf FROM tf UNION ALL SELECT 'hit', id, term, tf FROM hit)
SELECT record_kind, id AS record_key, alls.term AS term_id, tf, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf,
  round(CASE WHEN df IS NULL THEN 0 ELSE tf * log2((1 - exp(-cf / n)) / (df / n)) END, 6) AS score FROM alls LEFT JOIN st USING (term), n""",
    "p3_found": _P3 + "SELECT least(e, t) AS paper_id_a, greatest(e, t) AS paper_id_b FROM found",
    "p3_report": _P3 + """SELECT split, coalesce(trim(source, {b}), 'unknown') AS source, count(DISTINCT paper_id) AS n_papers, count(hit) AS n_overlapping
  FROM side LEFT JOIN (SELECT DISTINCT e AS paper_id, 1 AS hit FROM found) USING (paper_id) WHERE side = 'e' GROUP BY 1, 2""".format(b=_BLANKS),
}
