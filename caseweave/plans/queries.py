"""Queries of the core, and SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators import flatten, orphans
from caseweave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
_ORPHANS = """WITH RECURSIVE t AS (
  SELECT id, coalesce(obsolete, false) AS obsolete, nxt, added_at FROM (SELECT upper(trim(term_id, {b})) AS id, obsolete, nullif(upper(trim(replaced_by, {b})), '') AS nxt, added_at,
    row_number() OVER (PARTITION BY upper(trim(term_id, {b})) ORDER BY modified_at DESC NULLS LAST) AS rn FROM terms) WHERE rn = 1),
alts AS (SELECT upper(trim(a, {b})) AS k, min(upper(trim(term_id, {b}))) AS id FROM (SELECT term_id, unnest(alt_ids) AS a FROM terms) GROUP BY 1),
keys AS (SELECT id AS k, id FROM t UNION ALL SELECT k, id FROM alts WHERE k NOT IN (SELECT id FROM t)),
way AS (
  SELECT k, t.id, obsolete, nxt, added_at, 0 AS hop FROM keys JOIN t USING (id)
  UNION ALL
  SELECT way.k, t.id, t.obsolete, t.nxt, t.added_at, hop + 1 FROM way JOIN keys ON keys.k = way.nxt JOIN t ON t.id = keys.id WHERE way.obsolete AND hop < 100),
live AS (SELECT k, added_at FROM way WHERE NOT obsolete),
lost AS (SELECT DISTINCT k FROM way WHERE obsolete AND nxt IS NOT NULL AND nxt NOT IN (SELECT k FROM keys)),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) rn FROM case_records WHERE id IS NOT NULL) WHERE rn = 1),
refs AS (
  SELECT 'case_records' AS ref_table, id AS row_key, p.term.id AS r, ingested_at AS tm FROM (SELECT id, ingested_at, unnest(phenotypes) AS p FROM cur)
  UNION ALL SELECT 'case_records', id, d.disease.id, ingested_at FROM (SELECT id, ingested_at, unnest(diagnoses) AS d FROM cur)
  UNION ALL SELECT 'disease_annotations', ann_id::VARCHAR, hpo_id, created_at FROM disease_annotations
  UNION ALL SELECT 'terms', trim(term_id, {b}), unnest(parents), modified_at FROM terms
  UNION ALL SELECT 'terms', trim(term_id, {b}), replaced_by, modified_at FROM terms),
clean AS (SELECT ref_table, row_key, upper(trim(r, {b})) AS ref_id, tm FROM refs WHERE trim(coalesce(r, ''), {b}) <> ''),
found AS (
  SELECT DISTINCT ref_table, row_key, ref_id, strftime(tm, '%Y-%m') AS ref_month,
    CASE WHEN live.k IS NOT NULL THEN 'late' WHEN ref_id NOT IN (SELECT k FROM keys) OR ref_id IN (SELECT k FROM lost) THEN 'missing' ELSE 'deleted' END AS reason FROM clean LEFT JOIN live ON live.k = ref_id
  WHERE live.k IS NULL OR live.added_at > tm)
""".format(b=BLANKS)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(spark, d, "case_records"), table(spark, d, "disease_annotations"), table(spark, d, "terms"))


@query(_ORPHANS + "SELECT DISTINCT ref_table, row_key, ref_id, ref_month FROM found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_key", "ref_id", "ref_month").distinct()


@query(_ORPHANS + "SELECT ref_table, ref_month, reason, count(*) AS n_references, count(DISTINCT row_key) AS n_rows FROM found GROUP BY 1, 2, 3")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return flatten.with_parents(flatten.nodes(table(spark, d, "raw_records")))


def _listed(x: str) -> str:
    """SQL: a JSON value as a list of JSON values, as ``flatten.entries`` reads it."""
    inner = f"({x} ->> '$')"
    return f"""CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '["JSON"]') WHEN 'OBJECT' THEN [{x}::JSON] WHEN 'VARCHAR' THEN CASE WHEN json_valid({inner}) THEN CASE json_type({inner})
  WHEN 'ARRAY' THEN from_json({inner}::JSON, '["JSON"]') WHEN 'OBJECT' THEN [{inner}::JSON] END END END"""


_NESTED = f"""WITH last AS (SELECT raw_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY received_at DESC NULLS LAST) AS rn FROM raw_records WHERE raw_id IS NOT NULL) WHERE rn = 1),
top AS (SELECT raw_id, payload::JSON AS j FROM last WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
arr AS (SELECT raw_id, CASE WHEN list_contains(json_keys(j), 'record') THEN [j -> 'record'] WHEN list_contains(json_keys(j), 'records') THEN CASE WHEN json_type(j -> 'records') = 'ARRAY' THEN from_json(j -> 'records', '["JSON"]') ELSE [j -> 'records'] END ELSE [j] END AS a FROM top),
one AS (SELECT raw_id, unnest(a) AS e, generate_subscripts(a, 1) - 1 AS record_pos FROM arr),
many AS (SELECT raw_id, record_pos, {_listed('e')} AS l FROM one),
rec AS (SELECT raw_id, record_pos, k, r FROM (SELECT raw_id, record_pos, unnest(l) AS r, generate_subscripts(l, 1) AS k FROM many) WHERE json_type(r) = 'OBJECT'),
items AS (SELECT raw_id, record_pos, k, record_id, kind, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS item_pos FROM (
  SELECT raw_id, record_pos, k, r ->> 'id' AS record_id, 'phenotype' AS kind, {_listed("(r -> 'phenotypes')")} AS l FROM rec UNION ALL SELECT raw_id, record_pos, k, r ->> 'id', 'variant', {_listed("(r -> 'variants')")} FROM rec
  UNION ALL SELECT raw_id, record_pos, k, r ->> 'id', 'diagnosis', {_listed("(r -> 'diagnoses')")} FROM rec)),
ev AS (SELECT raw_id, record_pos, k, record_id, kind, item_pos, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS evidence_pos FROM (SELECT *, {_listed("(item -> 'evidence')")} AS l FROM items WHERE json_type(item) = 'OBJECT'))
"""


@query(_NESTED + "SELECT raw_id, record_id, kind AS item_kind, item_pos, evidence_pos, e ->> 'source_id' AS source_id FROM ev WHERE json_type(e) = 'OBJECT' AND kind <> 'diagnosis'")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    ev = flatten.evidence_table(_linked(spark, d)).filter(F.col("item_kind").isin("phenotype", "variant"))
    return ev.select("raw_id", "record_id", "item_kind", "item_pos", "evidence_pos", "source_id")


@query(_NESTED + """, n AS (SELECT raw_id, record_pos, k, count(*) AS nodes FROM (SELECT raw_id, record_pos, k FROM rec UNION ALL SELECT raw_id, record_pos, k FROM items WHERE json_type(item) = 'OBJECT'
  UNION ALL SELECT raw_id, record_pos, k FROM ev WHERE json_type(e) = 'OBJECT') GROUP BY 1, 2, 3)
SELECT raw_id, (1 + 2 * coalesce(sum(nodes) OVER (PARTITION BY raw_id ORDER BY record_pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS record_pre, record_pos, r ->> 'id' AS record_id FROM rec JOIN n USING (raw_id, record_pos, k)""")
def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return flatten.record_table(flatten.nodes(table(spark, d, "raw_records")))


@query()
def p7_assertions(spark: SparkSession, d: str) -> DataFrame:
    return flatten.assertion_table(_linked(spark, d))
