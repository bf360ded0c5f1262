"""Queries for hierarchy, scoring, ranking, checks and search over the case tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions import text as tx
from caseweave.functions.durations import iso_days
from caseweave.functions.ids import clean_id, newest_values, trimmed
from caseweave.operators import dag, extract, grounding, metrics, qa, quotes, rank, records, search
from caseweave.plans.queries import BLANKS, query
from caseweave.session import cut, release, table, there

ROOT = "HP:9005920"  # the test ontology's most general finding; a parameter of the facet query


# SQL building blocks
def clean(c: str) -> str:
    return f"nullif(upper(trim({c}, {BLANKS})), '')"


TERMS_SQL = f"""trow AS (SELECT * FROM (SELECT *, {clean('term_id')} AS tid, row_number() OVER (PARTITION BY {clean('term_id')} ORDER BY modified_at DESC NULLS LAST) AS rn FROM terms WHERE {clean('term_id')} IS NOT NULL) WHERE rn = 1),
t AS (SELECT tid AS id, term_name AS name, coalesce(obsolete, false) AS obsolete, {clean('replaced_by')} AS nxt FROM trow),
alt AS (SELECT {clean('a')} AS src, min(tid) AS dst FROM (SELECT tid, unnest(alt_ids) AS a FROM trow) WHERE {clean('a')} IS NOT NULL GROUP BY 1),
hop AS (SELECT id AS src, nxt AS dst FROM t WHERE obsolete AND nxt IS NOT NULL UNION ALL SELECT src, dst FROM alt WHERE src NOT IN (SELECT id FROM t WHERE obsolete AND nxt IS NOT NULL)),
chain AS (SELECT src, dst, 1 AS n FROM hop UNION ALL SELECT c.src, h.dst, n + 1 FROM chain c JOIN hop h ON h.src = c.dst WHERE n < 50),
fin AS (SELECT src, dst FROM chain WHERE dst NOT IN (SELECT src FROM hop)),
circ AS (SELECT src FROM hop WHERE src NOT IN (SELECT src FROM fin)),
alias AS (SELECT id AS src, id AS dst FROM t WHERE id NOT IN (SELECT src FROM hop) UNION ALL SELECT src, dst FROM fin WHERE dst IN (SELECT id FROM t)
  UNION ALL SELECT src, CASE WHEN src IN (SELECT id FROM t) THEN src ELSE (SELECT dst FROM alt WHERE alt.src = circ.src) END FROM circ),
edge AS (SELECT DISTINCT tid AS child, {clean('p')} AS parent FROM (SELECT tid, unnest(parents) AS p FROM trow)
  WHERE {clean('p')} IN (SELECT id FROM t)),
closed AS (SELECT id AS term, id AS ancestor FROM t UNION SELECT c.term, e.parent FROM closed c JOIN edge e ON e.child = c.ancestor)"""
ANN_SQL = f"""ann AS (SELECT DISTINCT ann_id, {clean('disease_id')} AS disease, {clean('hpo_id')} AS term, coalesce(upper(trim(qualifier)) = 'NOT', false) AS negated,
  nullif(trim(frequency), '') AS frequency, upper(nullif(trim(sex), '')) AS sex, upper(nullif(trim(aspect), '')) AS aspect
  FROM disease_annotations WHERE {clean('disease_id')} IS NOT NULL AND {clean('hpo_id')} IS NOT NULL)"""
IC_SQL = """counts AS (SELECT c.ancestor AS term, count(DISTINCT a.disease) AS n FROM ann a JOIN alias l ON l.src = a.term JOIN closed c ON c.term = l.dst WHERE NOT a.negated GROUP BY 1),
total AS (SELECT count(DISTINCT disease)::DOUBLE AS total FROM ann),
ic AS (SELECT t.id AS term, CASE WHEN n IS NULL THEN ln(total) ELSE -ln(n / total) END AS ic FROM t LEFT JOIN counts ON counts.term = t.id, total)"""
CUR_SQL = f"""cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM case_records WHERE id IS NOT NULL) WHERE rn = 1),
ph AS (SELECT id, {clean('p.term.id')} AS term, coalesce(p.excluded, false) AS excluded FROM (SELECT id, unnest(phenotypes) AS p FROM cur)),
dx AS (SELECT id, {clean('d.disease.id')} AS disease FROM (SELECT id, unnest(diagnoses) AS d FROM cur)),
gx AS (SELECT id, {clean('v.gene.id')} AS gene FROM (SELECT id, unnest(variants) AS v FROM cur)),
ob AS (SELECT DISTINCT id, alias.dst AS term FROM ph JOIN alias ON alias.src = ph.term WHERE NOT excluded),
ex AS (SELECT DISTINCT id, alias.dst AS term FROM ph JOIN alias ON alias.src = ph.term WHERE excluded)"""
WITH = "WITH RECURSIVE " + TERMS_SQL
FULL = f"{WITH},\n{ANN_SQL},\n{IC_SQL},\n{CUR_SQL}\n"


class Base:
    """The shared frames of one folder.

    What follows from the ontology alone is written once per application and version of the ontology's files: a changed
    file is read again, and of all versions the last ``KEPT`` stay.
    """

    KEPT = 4
    _kept: dict[tuple[str, ...], "Base"] = {}

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.terms = table(spark, d, "terms")
        key = (spark.sparkContext.applicationId, d, *sorted(self.terms.select(F.concat_ws(" ", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")).distinct().toPandas().iloc[:, 0]))
        self.first = self._kept.pop(key, self)
        self._kept[key] = self.first
        if self.first is self:
            self._frames: dict[str, DataFrame] = {}
        while len(self._kept) > self.KEPT:
            old = self._kept.pop(next(iter(self._kept)))
            if old.spark.sparkContext._jsc is not None and old.spark.sparkContext.applicationId == spark.sparkContext.applicationId:
                for frame in old._frames.values():
                    release(frame)

    def _frame(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        frames = self.first._frames
        if name not in frames or not there(frames[name]):
            frames[name] = make()
        return frames[name]

    @property
    def rows(self) -> DataFrame:
        return self._frame("rows", lambda: cut(dag.term_rows(self.terms)))

    @property
    def alias(self) -> DataFrame:
        return self._frame("alias", lambda: cut(dag.alias_closure(self.rows)))

    @classmethod
    def forget(cls) -> None:
        """Makes the next query work everything out again, as a bench should."""
        cls._kept.clear()

    def closure(self) -> DataFrame:
        return self._frame("closure", lambda: dag.closure(self.rows))

    def annotations(self) -> DataFrame:
        return qa.annotations_clean(table(self.spark, self.d, "disease_annotations"))

    def ic(self, closed: DataFrame) -> DataFrame:
        ann = self.annotations()
        climbing = dag.resolve(ann.filter("NOT negated").select(F.col("disease").alias("owner"), "term"), "term", self.alias).filter("term IS NOT NULL")
        total = ann.agg(F.count_distinct("disease").cast("double").alias("total"))
        return cut(dag.information_content(self.rows, dag.propagated_counts(climbing, closed), total))

    def current(self, *columns: str) -> DataFrame:
        """The current deliveries with ``columns`` (all, if none are named)."""
        every = ("schema_version", "source", "subject", "phenotypes", "diagnoses", "variants", "confidence", "qa_flags", "extractors")
        return cut(records.current_records(table(self.spark, self.d, "case_records"), *(columns or every)))

    def observed(self) -> DataFrame:
        return records.current_observed(table(self.spark, self.d, "case_records"))

    def live(self, sets: DataFrame) -> DataFrame:
        """(id, term) with terms resolved."""
        return cut(qa.live(records.exploded_terms(sets), "term", self.alias))


@query(WITH + " SELECT src, dst FROM alias")
def alias_closure(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).alias


@query(WITH + " SELECT term, ancestor FROM closed")
def dag_closure(spark: SparkSession, d: str) -> DataFrame:
    return Base(spark, d).closure().select("term", "ancestor")


@query(WITH + """, depth AS (SELECT id AS term, id AS ancestor, 0 AS k FROM t UNION SELECT d.term, e.parent, k + 1 FROM depth d JOIN edge e ON e.child = d.ancestor WHERE k < 6),
least_d AS (SELECT term, ancestor, min(k) AS k FROM depth GROUP BY 1, 2),
pairs AS (SELECT DISTINCT child AS a, parent AS b FROM edge UNION SELECT DISTINCT x.child, y.child FROM edge x JOIN edge y ON x.parent = y.parent AND x.child < y.child)
SELECT a, b, min(x.k + y.k) AS distance FROM pairs JOIN least_d x ON x.term = a JOIN least_d y ON y.term = b AND y.ancestor = x.ancestor GROUP BY 1, 2""")
def dag_path_distance(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    e = cut(dag.edges(b.rows))
    kin = e.select(F.col("child").alias("a"), "parent").join(e.select(F.col("child").alias("b"), "parent"), "parent").filter("a < b")
    pairs = e.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(kin.select("a", "b")).distinct()
    return dag.path_distance(pairs, b.closure())


@query(f"{WITH} SELECT x.xref AS xref, alias.dst AS term FROM (SELECT {clean('term_id')} AS term, unnest(xrefs) AS x FROM terms) s JOIN alias ON alias.src = s.term WHERE x.xref LIKE 'OMIM:%' GROUP BY 1, 2")
def xref_index(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    return dag.xref_index(b.terms, b.alias, ["OMIM:"])


@query(f"""WITH n AS (SELECT {clean('term_id')} AS term, unnest(list_append([s.syn FOR s IN coalesce(synonyms, []) IF s.scope_kind IN ('EXACT', 'NARROW')], term_name)) AS phrase
  FROM terms WHERE NOT coalesce(obsolete, false)) SELECT DISTINCT lower(trim(phrase)) AS phrase, term FROM n WHERE lower(trim(phrase)) <> '' AND term IS NOT NULL""")
def label_index(spark: SparkSession, d: str) -> DataFrame:
    return dag.label_index(table(spark, d, "terms"))


@query(f"{WITH},\n{ANN_SQL},\n{IC_SQL} SELECT term, round(ic, 6) AS ic FROM ic")
def ic_propagated(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    return b.ic(b.closure()).select("term", F.round("ic", 6).alias("ic"))


def _paper_pairs(spark: SparkSession, d: str):  # noqa: ANN202
    """Predicted and gold findings per record, and all records: the earliest delivery against the current one."""
    b = Base(spark, d)
    closed = b.closure()
    ic = b.ic(closed)
    rec = table(spark, d, "case_records").filter("id IS NOT NULL")
    first = rec.groupBy("id").agg(F.min_by("phenotypes", F.struct("ingested_at", F.xxhash64("phenotypes"))).alias("phenotypes"))
    first = cut(first.select("id", records.observed_ids().alias("terms")))
    return b, closed, ic, b.live(first), b.live(b.observed()), first.select("id")


FIRST_SQL = f"""first_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at NULLS FIRST) AS rn FROM case_records WHERE id IS NOT NULL) WHERE rn = 1),
pr AS (SELECT DISTINCT id, alias.dst AS term FROM (SELECT id, unnest(phenotypes) AS p FROM first_d) s JOIN alias ON alias.src = {clean('p.term.id')} WHERE NOT coalesce(p.excluded, false))"""


@query(FULL + "," + FIRST_SQL + """ SELECT cur.id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM cur LEFT JOIN (
  SELECT coalesce(pr.id, ob.id) AS id, count(pr.id) FILTER (ob.id IS NOT NULL)::DOUBLE AS tp, count(pr.id) FILTER (ob.id IS NULL)::DOUBLE AS fp, count(ob.id) FILTER (pr.id IS NULL)::DOUBLE AS fn
  FROM pr FULL JOIN ob ON pr.id = ob.id AND pr.term = ob.term GROUP BY 1) USING (id)""")
def exact_prf(spark: SparkSession, d: str) -> DataFrame:
    b, _, _, pred, gold, cases = _paper_pairs(spark, d)
    val = lambda x: x.select("id", F.col("term").alias("value"))
    return metrics.exact(val(pred), val(gold), ["id"], cases).select("id", "tp", "fp", "fn")


GRADED_SQL = """ic2 AS (SELECT * FROM ic), pp AS (SELECT DISTINCT pr.term AS a, ob.term AS b FROM pr JOIN ob USING (id)),
mica AS (SELECT a, b, max(ic.ic) AS m FROM pp JOIN closed x ON x.term = a JOIN closed y ON y.term = b AND y.ancestor = x.ancestor JOIN ic ON ic.term = x.ancestor GROUP BY 1, 2),
lin AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN i.ic + j.ic = 0 THEN 0 ELSE greatest(0, least(1, 2 * m / (i.ic + j.ic))) END AS lin FROM mica JOIN ic i ON i.term = a JOIN ic j ON j.term = b),
s AS (SELECT pr.id, pr.term AS a, ob.term AS b, CASE WHEN lin >= 0.5 THEN lin ELSE 0 END AS s FROM pr JOIN ob USING (id) LEFT JOIN lin ON lin.a = pr.term AND lin.b = ob.term),
tp_p AS (SELECT id, sum(x) AS tp_p FROM (SELECT id, a, max(s) AS x FROM s GROUP BY 1, 2) GROUP BY 1),
tp_r AS (SELECT id, sum(x) AS tp_r FROM (SELECT id, b, max(s) AS x FROM s GROUP BY 1, 2) GROUP BY 1),
np AS (SELECT id, count(*) AS np FROM pr GROUP BY 1), ng AS (SELECT id, count(*) AS ng FROM ob GROUP BY 1),
g AS (SELECT cur.id, coalesce(tp_p, 0) AS tp_p, coalesce(tp_r, 0) AS tp_r, coalesce(np, 0) - coalesce(tp_p, 0) AS fp, coalesce(ng, 0) - coalesce(tp_r, 0) AS fn
  FROM cur LEFT JOIN np USING (id) LEFT JOIN ng USING (id) LEFT JOIN tp_p USING (id) LEFT JOIN tp_r USING (id))"""


def _graded(spark: SparkSession, d: str):  # noqa: ANN202
    b, closed, ic, pred, gold, cases = _paper_pairs(spark, d)
    both = pred.select("id", F.col("term").alias("a")).join(gold.select("id", F.col("term").alias("b")), "id").select("a", "b").distinct()
    # only pairs that meet in a record are scored
    up = closed.select("term", "ancestor")
    met = both.join(up.select(F.col("term").alias("a"), "ancestor"), "a").join(up.select(F.col("term").alias("b"), "ancestor"), ["b", "ancestor"]).join(ic.select(F.col("term").alias("ancestor"), "ic"), "ancestor")
    sim = dag.lin(met.groupBy("a", "b").agg(F.max("ic").alias("ic")), ic)
    return b, closed, pred, gold, metrics.graded(pred, gold, sim, ["id"], cases=cases)


@query(FULL + "," + FIRST_SQL + "," + GRADED_SQL + " SELECT id, round(tp_p, 5) AS tp_p, round(tp_r, 5) AS tp_r, round(fp, 5) AS fp, round(fn, 5) AS fn FROM g")
def graded_prf(spark: SparkSession, d: str) -> DataFrame:
    *_, g = _graded(spark, d)
    return g.select("id", *[F.round(c, 5).alias(c) for c in ("tp_p", "tp_r", "fp", "fn")])


@query(FULL + "," + FIRST_SQL + """, x AS (SELECT DISTINCT id, ancestor FROM pr JOIN closed USING (term)), y AS (SELECT DISTINCT id, ancestor FROM ob JOIN closed USING (term))
 SELECT cur.id, round(coalesce(j, 1.0), 6) AS jaccard FROM cur LEFT JOIN (
  SELECT coalesce(x.id, y.id) AS id, count(*) FILTER (x.id IS NOT NULL AND y.id IS NOT NULL) / count(*)::DOUBLE AS j FROM x FULL JOIN y ON x.id = y.id AND x.ancestor = y.ancestor GROUP BY 1) USING (id)""")
def profile_jaccard(spark: SparkSession, d: str) -> DataFrame:
    b, closed, _, pred, gold, cases = _paper_pairs(spark, d)
    return metrics.closure_jaccard(pred, gold, closed, ["id"], cases).select("id", F.round("jaccard", 6).alias("jaccard"))


CUBE_SQL = """, rt AS (SELECT *, CASE WHEN n = 1 THEN 'single' ELSE 'paper' END AS track, CASE WHEN (('0x' || substr(sha256('weave:' || pmid), 1, 8))::BIGINT % 10000) / 10000.0 < 0.5 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT id, source.pmid AS pmid, count(*) OVER (PARTITION BY source.pmid) AS n FROM cur) WHERE pmid IS NOT NULL),
f AS (SELECT 'observed_graded' AS field, g.id, tp_p, tp_r, fp, fn FROM g),
r AS (SELECT *, CASE WHEN tp_p + fp = 0 THEN 0 ELSE tp_p / (tp_p + fp) END AS p0, CASE WHEN tp_r + fn = 0 THEN 0 ELSE tp_r / (tp_r + fn) END AS r0 FROM f JOIN rt USING (id)),
c AS (SELECT field, coalesce(track, 'all') AS track, coalesce(split, 'all') AS split, count(*) AS n, sum(tp_p) AS tp_p, sum(tp_r) AS tp_r, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END) AS macro
  FROM r GROUP BY GROUPING SETS ((field, track, split), (field, track), (field, split), (field))),
q AS (SELECT *, CASE WHEN tp_p + fp = 0 THEN 0 ELSE tp_p / (tp_p + fp) END AS p, CASE WHEN tp_r + fn = 0 THEN 0 ELSE tp_r / (tp_r + fn) END AS rr FROM c)
SELECT field, track, split, n, round(p, 5) AS precision, round(rr, 5) AS recall, round(CASE WHEN p + rr = 0 THEN 0 ELSE 2 * p * rr / (p + rr) END, 5) AS micro_f1, round(macro, 5) AS macro_f1 FROM q"""


@query(FULL + "," + FIRST_SQL + "," + GRADED_SQL + CUBE_SQL)
def metric_cube(spark: SparkSession, d: str) -> DataFrame:
    b, _, _, _, g = _graded(spark, d)
    cur = b.current("source")
    tracks = records.track(cur).select("pmid", "track")
    where = cur.select("id", F.col("source.pmid").alias("pmid")).filter("pmid IS NOT NULL").join(tracks, "pmid").withColumn("split", tx.split_of(F.col("pmid"), "weave:"))
    out = metrics.summarise(g.join(where, "id").withColumn("field", F.lit("observed_graded")), ["track", "split"])
    return out.select("field", "track", "split", "n", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "micro_f1", "macro_f1")])


FIELDS = ("observed_exact", "observed_graded", "excluded_exact", "gene_exact", "disease_exact", "disease_normalised")


def _case_scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, field, parts), a row for each of the six fields of every case, of zeros where neither side has a value.

    ``disease_exact`` compares ids as given, ``disease_normalised`` live ones.
    """
    b, _, _, _, g = _graded(spark, d)
    rec = table(spark, d, "case_records").filter("id IS NOT NULL")
    order = F.struct("ingested_at", F.xxhash64("phenotypes"), F.xxhash64("diagnoses", "variants"))  # the delivery _paper_pairs takes
    first = cut(rec.groupBy("id").agg(F.min_by(F.struct("phenotypes", "diagnoses", "variants"), order).alias("r")).select("id", "r.*"))

    def values(side: DataFrame) -> DataFrame:
        plain = lambda sets, name: sets.select("id", F.explode(name).alias("term"))
        diseases = records.diagnosis_ids(side)
        fields = {
            "observed_exact": b.live(records.observed_terms(side)), "excluded_exact": b.live(records.excluded_terms(side)), "gene_exact": plain(records.gene_ids(side), "genes"),
            "disease_exact": plain(diseases, "diseases"), "disease_normalised": b.live(diseases.withColumnRenamed("diseases", "terms")),
        }
        out = None
        for name, x in fields.items():
            one = x.select("id", F.lit(name).alias("field"), F.col("term").alias("value"))
            out = one if out is None else out.unionByName(one)
        return out

    exact = metrics.exact(values(first), values(b.current("phenotypes", "diagnoses", "variants")), ["id", "field"])
    scores = exact.unionByName(g.withColumn("field", F.lit("observed_graded")))
    every = first.select("id", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    return every.join(scores, ["id", "field"], "left").select("id", "field", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in metrics.PARTS])


SCORES_SQL = f"""fx AS (SELECT DISTINCT id, alias.dst AS term FROM (SELECT id, unnest(phenotypes) AS p FROM first_d) JOIN alias ON alias.src = {clean('p.term.id')} WHERE coalesce(p.excluded, false)),
fdx AS (SELECT DISTINCT id, {clean('p.disease.id')} AS v FROM (SELECT id, unnest(diagnoses) AS p FROM first_d)), fgx AS (SELECT DISTINCT id, {clean('p.gene.id')} AS v FROM (SELECT id, unnest(variants) AS p FROM first_d)),
sides AS (SELECT 0 AS side, 'observed_exact' AS field, id, term AS v FROM pr UNION ALL SELECT 1, 'observed_exact', id, term FROM ob UNION ALL SELECT 0, 'excluded_exact', id, term FROM fx UNION ALL SELECT 1, 'excluded_exact', id, term FROM ex
  UNION ALL SELECT 0, 'gene_exact', id, v FROM fgx UNION ALL SELECT 1, 'gene_exact', id, gene FROM gx UNION ALL SELECT 0, 'disease_exact', id, v FROM fdx UNION ALL SELECT 1, 'disease_exact', id, disease FROM dx
  UNION ALL SELECT 0, 'disease_normalised', id, alias.dst FROM fdx JOIN alias ON src = v UNION ALL SELECT 1, 'disease_normalised', id, alias.dst FROM dx JOIN alias ON src = disease),
cells AS (SELECT id, field, v, min(side) = 0 AS p, max(side) = 1 AS g FROM sides WHERE v IS NOT NULL GROUP BY 1, 2, 3),
ex_scores AS (SELECT id, field, count(*) FILTER (p AND g)::DOUBLE AS tp, count(*) FILTER (NOT g)::DOUBLE AS fp, count(*) FILTER (NOT p)::DOUBLE AS fn FROM cells GROUP BY 1, 2),
every AS (SELECT cur.id, f.field FROM cur, (SELECT unnest({list(('observed_exact', 'observed_graded', 'excluded_exact', 'gene_exact', 'disease_exact', 'disease_normalised'))}) AS field) f),
cs AS (SELECT every.id, every.field, coalesce(CASE WHEN every.field = 'observed_graded' THEN (g.tp_p + g.tp_r) / 2 ELSE e.tp END, 0) AS tp, coalesce(CASE WHEN every.field = 'observed_graded' THEN g.fp ELSE e.fp END, 0) AS fp,
  coalesce(CASE WHEN every.field = 'observed_graded' THEN g.fn ELSE e.fn END, 0) AS fn, coalesce(CASE WHEN every.field = 'observed_graded' THEN g.tp_p ELSE e.tp END, 0) AS tp_p, coalesce(CASE WHEN every.field = 'observed_graded' THEN g.tp_r ELSE e.tp END, 0) AS tp_r
  FROM every LEFT JOIN ex_scores e ON e.id = every.id AND e.field = every.field LEFT JOIN g ON g.id = every.id)"""


@query(FULL + "," + FIRST_SQL + "," + GRADED_SQL + "," + SCORES_SQL + " SELECT id, field, round(tp, 5) AS tp, round(fp, 5) AS fp, round(fn, 5) AS fn, round(tp_p, 5) AS tp_p, round(tp_r, 5) AS tp_r FROM cs")
def case_scores(spark: SparkSession, d: str) -> DataFrame:
    return _case_scores(spark, d).select("id", "field", *[F.round(c, 5).alias(c) for c in metrics.PARTS])


@query(FULL + "," + FIRST_SQL + "," + GRADED_SQL + "," + SCORES_SQL + CUBE_SQL.replace("f AS (SELECT 'observed_graded' AS field, g.id, tp_p, tp_r, fp, fn FROM g)", "f AS (SELECT field, id, tp_p, tp_r, fp, fn FROM cs)"))
def field_cube(spark: SparkSession, d: str) -> DataFrame:
    """``metric_cube`` over all fields and cases of ``case_scores``."""
    cur = Base(spark, d).current("source")
    where = cur.select("id", F.col("source.pmid").alias("pmid")).filter("pmid IS NOT NULL").join(records.track(cur).select("pmid", "track"), "pmid").withColumn("split", tx.split_of(F.col("pmid"), "weave:"))
    out = metrics.summarise(_case_scores(spark, d).join(where, "id"), ["track", "split"])
    return out.select("field", "track", "split", "n", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "micro_f1", "macro_f1")])


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap(cut(_case_scores(spark, d)), "id")


# ranking: the earlier search runs give the queries, all current records the profiles
RANK_SQL = """qq AS (SELECT DISTINCT id AS query, term AS a FROM ob WHERE id IN (SELECT query_case_id FROM case_hits WHERE hit_id % 50 = 0)),
pp AS (SELECT DISTINCT id AS profile, term AS b FROM ob),
qa AS (SELECT DISTINCT a FROM qq), pb AS (SELECT DISTINCT b FROM pp),
met AS (SELECT a, b, max(ic.ic) AS ic FROM qa JOIN closed x ON x.term = a JOIN ic ON ic.term = x.ancestor JOIN closed y ON y.ancestor = x.ancestor JOIN pb ON pb.b = y.term GROUP BY 1, 2 HAVING max(ic.ic) > 0),
m AS (SELECT query, profile, a, b, ic FROM qq JOIN met USING (a) JOIN pp USING (b)),
rev AS (SELECT query, profile, sum(x) AS rev FROM (SELECT query, profile, b, max(ic) AS x FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
fwd AS (SELECT query, profile, sum(x) AS fwd FROM (SELECT query, profile, a, max(ic) AS x FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
np AS (SELECT profile, count(*) AS n_terms FROM pp GROUP BY 1), nq AS (SELECT query, count(*) AS nq FROM qq GROUP BY 1),
sc AS (SELECT query, profile, (fwd / nq + rev / n_terms) / 2 AS raw, n_terms FROM rev JOIN fwd USING (query, profile) JOIN np USING (profile) JOIN nq USING (query)),
top AS (SELECT query, profile, round(raw, 5) AS score, n_terms, row_number() OVER (PARTITION BY query ORDER BY round(raw, 9) DESC, profile) AS rank FROM sc QUALIFY rank <= 20)"""


def _ranked(spark: SparkSession, d: str):  # noqa: ANN202
    b = Base(spark, d)
    closed = b.closure()
    ic = b.ic(closed)
    profiles = b.live(b.observed()).select(F.col("id").alias("profile"), "term")
    asked = table(spark, d, "case_hits").filter("hit_id % 50 = 0").select(F.col("query_case_id").alias("query")).distinct()
    queries = cut(profiles.withColumnRenamed("profile", "query").join(asked, "query", "left_semi"))
    return b, closed, ic, queries, profiles, cut(rank.search(queries, profiles, closed, ic, 20, places=5))


@query(FULL + "," + RANK_SQL + " SELECT query, profile, score, n_terms, rank FROM top")
def similar_cases(spark: SparkSession, d: str) -> DataFrame:
    *_, hits = _ranked(spark, d)
    return hits.select("query", "profile", "score", "n_terms", "rank")


@query(FULL + "," + RANK_SQL + """, best AS (SELECT query, b, max(ic) AS ic FROM qq JOIN met USING (a) GROUP BY 1, 2 HAVING max(ic) >= 1.5)
SELECT query, profile, b AS term, round(ic, 5) AS ic, row_number() OVER (PARTITION BY query, profile ORDER BY round(ic, 9) DESC, b) AS place FROM top JOIN pp USING (profile) JOIN best USING (query, b) QUALIFY place <= 12""")
def shared_findings(spark: SparkSession, d: str) -> DataFrame:
    _, closed, ic, queries, profiles, hits = _ranked(spark, d)
    return rank.explain(hits, queries, profiles, closed, ic).withColumn("ic", F.round("ic", 5))


@query(FULL + "," + RANK_SQL + """, lab AS (SELECT DISTINCT id AS profile, disease AS label FROM dx WHERE disease IS NOT NULL)
SELECT query, label, count(*) AS n_profiles, round(sum(score), 3) AS score, array_to_string(list_sort(list(profile)), ' ') AS profiles FROM top JOIN lab USING (profile) GROUP BY 1, 2""")
def disease_tally(spark: SparkSession, d: str) -> DataFrame:
    b, *_, hits = _ranked(spark, d)
    labels = records.diagnosis_ids(b.current("diagnoses")).select(F.col("id").alias("profile"), F.explode("diseases").alias("label"))
    return rank.tally(hits, labels).withColumn("profiles", F.array_join("profiles", " "))


def _disease_ranked(spark: SparkSession, d: str, first: bool = False):  # noqa: ANN202
    """Diseases by the findings of current records, or of their first deliveries, and the records' diagnoses."""
    b = Base(spark, d)
    closed = b.closure()
    ic = b.ic(closed)
    cur = b.current("phenotypes", "diagnoses")
    asked = table(spark, d, "case_hits").filter("hit_id % 50 = 0").select(F.col("query_case_id").alias("id")).distinct()
    found = _paper_pairs(spark, d)[3] if first else b.live(records.observed_terms(cur))
    queries = cut(found.join(asked, "id", "left_semi").select(F.col("id").alias("query"), "term"))
    prof = qa.profile(b.annotations(), "phenotypes")
    profiles = cut(qa.live(prof, "term", b.alias).select(F.col("disease").alias("profile"), "term"))
    top = cut(rank.search(queries, profiles, closed, ic, 100, min_terms=2, places=5))
    gold = records.diagnosis_ids(cur.join(asked, "id", "left_semi")).select(F.col("id").alias("query"), F.explode("diseases").alias("item"))
    return top, gold


DISEASE_SQL = RANK_SQL.replace("pp AS (SELECT DISTINCT id AS profile, term AS b FROM ob)", "pp AS (SELECT DISTINCT disease AS profile, alias.dst AS b FROM ann JOIN alias ON alias.src = ann.term WHERE NOT negated AND (aspect IS NULL OR aspect = 'P'))").replace(
    "FROM pp GROUP BY 1), nq", "FROM pp GROUP BY 1 HAVING count(*) >= 2), nq").replace("rank <= 20", "rank <= 100")


@query(FULL + "," + DISEASE_SQL + " SELECT query, profile, score, n_terms, rank FROM top")
def disease_rank(spark: SparkSession, d: str) -> DataFrame:
    top, _ = _disease_ranked(spark, d)
    return top.select("query", "profile", "score", "n_terms", "rank")


HITS_SQL = """, gold AS (SELECT DISTINCT id AS query, disease AS item FROM dx WHERE disease IS NOT NULL AND id IN (SELECT query_case_id FROM case_hits WHERE hit_id % 50 = 0)),
fr AS (SELECT g.query, min(top.rank) AS rank FROM gold g LEFT JOIN top ON top.query = g.query AND top.profile = g.item GROUP BY 1),
j AS (SELECT fr.*, fr.query IN (SELECT query FROM top) AS a FROM fr)
SELECT count(*) AS n_queries, count(*) FILTER (a) AS n_answered, round(count(*) FILTER (a) / count(*)::DOUBLE, 6) AS coverage, {ks},
  round(coalesce(sum(1.0 / rank), 0) / greatest(count(*) FILTER (a), 1), 6) AS mrr, round(coalesce(sum(1.0 / rank), 0) / count(*), 6) AS mrr_all FROM j""".replace("{ks}", ", ".join(
    f"round(count(*) FILTER (rank <= {k}) / greatest(count(*) FILTER (a), 1)::DOUBLE, 6) AS hit_{k}, round(count(*) FILTER (rank <= {k}) / count(*)::DOUBLE, 6) AS hit_{k}_all" for k in metrics.KS))


def _hits(spark: SparkSession, d: str, first: bool) -> DataFrame:
    top, gold = _disease_ranked(spark, d, first)
    ranked = top.select("query", F.col("profile").alias("item"), "rank")
    out = metrics.hit_at_k(metrics.first_hit(ranked, gold), ranked)
    return out.select("n_queries", "n_answered", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("n_queries", "n_answered")])


@query(FULL + "," + DISEASE_SQL + HITS_SQL)
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """The ceiling: rankings by the findings of current records."""
    return _hits(spark, d, False)


@query(FULL + "," + FIRST_SQL + "," + DISEASE_SQL.replace("FROM ob WHERE id IN (SELECT query_case_id", "FROM pr WHERE id IN (SELECT query_case_id") + HITS_SQL)
def hit_at_k_first(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline: rankings by what the first deliveries found."""
    return _hits(spark, d, True)


# annotation profiles
@query(f"WITH {ANN_SQL} SELECT DISTINCT 'phenotypes' AS kind, disease, term FROM ann WHERE NOT negated AND (aspect IS NULL OR aspect = 'P') UNION ALL SELECT DISTINCT 'excluded', disease, term FROM ann WHERE negated OR coalesce(frequency = 'HP:0040285', false) UNION ALL SELECT DISTINCT 'obligate', disease, term FROM ann WHERE NOT negated AND frequency IN ('HP:0040280', '1/1', '100%') UNION ALL SELECT DISTINCT 'inheritance', disease, term FROM ann WHERE NOT negated AND aspect = 'I'")
def disease_profiles(spark: SparkSession, d: str) -> DataFrame:
    ann = qa.annotations_clean(table(spark, d, "disease_annotations"))
    out = None
    for kind in ("phenotypes", "excluded", "obligate", "inheritance"):
        one = qa.profile(ann, kind).select(F.lit(kind).alias("kind"), "disease", "term")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {ANN_SQL} SELECT disease, min(sex) AS sex FROM ann GROUP BY disease HAVING min(sex) = max(sex) AND count(*) = count(sex) AND min(sex) IN ('MALE', 'FEMALE')")
def sex_constraint(spark: SparkSession, d: str) -> DataFrame:
    return qa.sex_constraint(qa.annotations_clean(table(spark, d, "disease_annotations")))


# consistency rules
DAYS_SQL = "(coalesce(try_cast(regexp_extract({c}, '^P([0-9]+)Y', 1) AS DOUBLE), 0) * 365.25 + coalesce(try_cast(regexp_extract({c}, '^P(?:[0-9]+Y)?([0-9]+)M', 1) AS DOUBLE), 0) * 30.44 + coalesce(try_cast(regexp_extract({c}, '^P(?:[0-9]+Y)?(?:[0-9]+M)?([0-9]+)W', 1) AS DOUBLE), 0) * 7 + coalesce(try_cast(regexp_extract({c}, '^P(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+W)?([0-9]+)D', 1) AS DOUBLE), 0))"
ISO_SQL = "(CASE WHEN trim({c}) = 'P0D' THEN 0 WHEN NOT regexp_full_match(trim({c}), 'P([0-9]+Y)?([0-9]+M)?([0-9]+W)?([0-9]+D)?') THEN NULL WHEN " + DAYS_SQL.replace("{c}", "trim({c})") + " > 0 THEN " + DAYS_SQL.replace("{c}", "trim({c})") + " END)"
VIOLATIONS_SQL = f"""known AS (SELECT DISTINCT dx.disease, gx.gene FROM dx JOIN gx USING (id) JOIN (SELECT id FROM cur WHERE subject.sex = 'FEMALE') USING (id) WHERE gene IS NOT NULL AND disease IS NOT NULL),
obl AS (SELECT DISTINCT disease, alias.dst AS term FROM ann JOIN alias ON alias.src = ann.term WHERE NOT negated AND frequency IN ('HP:0040280', '1/1', '100%')),
v AS (
 SELECT ob.id, 'polarity_contradiction' AS code, 'ERROR' AS severity, ob.term AS a, NULL AS b FROM ob JOIN ex USING (id, term)
 UNION SELECT ob.id, 'dag_polarity_contradiction', 'ERROR', ob.term, c.ancestor FROM ob JOIN closed c USING (term) JOIN ex ON ex.id = ob.id AND ex.term = c.ancestor WHERE c.ancestor <> ob.term
 UNION SELECT id, 'unknown_hpo_term', 'WARN', term, NULL FROM ph WHERE term IS NOT NULL AND term NOT IN (SELECT src FROM alias)
 UNION SELECT id, 'outdated_hpo_term', 'WARN', term, dst FROM ph JOIN alias ON src = term WHERE dst <> term
 UNION SELECT id, 'onset_after_last_encounter', 'ERROR', {clean('p.term.id')}, NULL FROM (SELECT id, subject.age_at_last_encounter.iso8601duration AS e, unnest(phenotypes) AS p FROM cur) WHERE {ISO_SQL.format(c='p.onset.iso8601duration')} > {ISO_SQL.format(c='e')} + 1
 UNION SELECT id, 'unmappable_disease', 'WARN', disease, NULL FROM dx WHERE disease IS NOT NULL AND disease NOT IN (SELECT src FROM alias)
 UNION SELECT dx.id, 'obligate_phenotype_excluded', 'WARN', dx.disease, ex.term FROM dx JOIN obl USING (disease) JOIN ex ON ex.id = dx.id AND ex.term = obl.term
 UNION SELECT dx.id, 'sex_inheritance_conflict', 'ERROR', dx.disease, NULL FROM dx JOIN (SELECT DISTINCT disease FROM ann WHERE NOT negated AND aspect = 'I' AND term = 'HP:9014755') USING (disease) JOIN cur ON cur.id = dx.id WHERE cur.subject.sex = 'FEMALE'
 UNION SELECT dx.id, 'gene_disease_mismatch', 'WARN', dx.disease, gx.gene FROM dx JOIN gx ON gx.id = dx.id WHERE gx.gene IS NOT NULL AND dx.disease IN (SELECT disease FROM known) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.disease = dx.disease AND k.gene = gx.gene))"""


def _violations(spark: SparkSession, d: str):  # noqa: ANN202
    b = Base(spark, d)
    closed = b.closure()
    cur = b.current("subject", "phenotypes", "diagnoses", "variants", "confidence", "qa_flags")
    seen, out = b.live(records.observed_terms(cur)), b.live(records.excluded_terms(cur))
    every = records.assertions(cur).filter("about IS NOT NULL")
    raw = every.filter("kind = 'phenotype'").select("id", F.col("about").alias("term"))
    dx = cut(every.filter("kind = 'diagnosis'").select("id", F.col("about").alias("disease")).distinct())
    gx = cut(every.filter("kind = 'variant'").select("id", F.col("about").alias("gene")).distinct())
    ann = b.annotations()
    obligate = qa.live(qa.profile(ann, "obligate"), "term", b.alias)
    # no gene table here: pairs seen in female patients stand for the known ones
    known = dx.join(gx, "id").join(cur.filter("subject.sex = 'FEMALE'").select("id"), "id", "left_semi").select("disease", "gene").distinct()
    rules = [
        qa.polarity_contradiction(seen, out), qa.ancestor_contradiction(seen, out, closed), qa.term_status(raw, b.alias), qa.onset_after_encounter(cur),
        qa.unmappable(dx, b.alias), qa.obligate_excluded(dx, out, obligate), qa.sex_conflict(cur, dx, qa.profile(ann, "inheritance"), y_linked="HP:9014755"), qa.gene_mismatch(gx, dx, known),
    ]
    v = rules[0]
    for r in rules[1:]:
        v = v.unionByName(r)
    return cur, v


@query(FULL + "," + VIOLATIONS_SQL + " SELECT id, code, severity, a, b FROM v")
def violations(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d)[1]


@query(FULL + "," + VIOLATIONS_SQL + """, per AS (SELECT id, count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity <> 'ERROR') AS w, list(DISTINCT severity || ':' || code) AS f FROM v GROUP BY 1)
SELECT cur.id, array_to_string(list_sort(list_distinct(list_concat(coalesce(qa_flags, []), coalesce(f, [])))), ',') AS flags, CASE WHEN e IS NULL THEN confidence ELSE round(greatest(0, least(1, coalesce(confidence, 1.0) * pow(0.5, e) * pow(0.9, w))) + 1e-12, 4) END AS confidence FROM cur LEFT JOIN per USING (id)""")
def confidence_decay(spark: SparkSession, d: str) -> DataFrame:
    cur, v = _violations(spark, d)
    return qa.annotate(cur, cut(v)).select("id", F.array_join("qa_flags", ",").alias("flags"), "confidence")


@query(FULL + "," + VIOLATIONS_SQL + " SELECT severity, code, count(*) AS n FROM v GROUP BY 1, 2")
def violation_counts(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d)[1].groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH v AS (SELECT DISTINCT case_id, CASE WHEN lower(trim(vote, {BLANKS})) = 'excluded' THEN {clean('term_id')} || '!' ELSE {clean('term_id')} END AS key, extractor FROM extractor_votes WHERE lower(trim(vote, {BLANKS})) IN ('present', 'excluded') AND {clean('term_id')} IS NOT NULL),
n AS (SELECT case_id, count(DISTINCT extractor) AS n FROM extractor_votes GROUP BY 1)
SELECT v.case_id, key, round(count(*) / n::DOUBLE, 4) AS share, count(*) / n::DOUBLE < 0.67 AS review FROM v JOIN n USING (case_id) GROUP BY v.case_id, key, n""")
def consensus_votes(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "extractor_votes")
    label = F.lower(trimmed(F.col("vote")))
    key = F.concat(clean_id(F.col("term_id")), F.when(label == "excluded", "!").otherwise(""))
    rows = v.filter(label.isin("present", "excluded")).select(F.col("case_id").alias("case"), key.alias("key"), F.col("extractor").alias("voter")).filter("key IS NOT NULL")
    n = v.groupBy(F.col("case_id").alias("case")).agg(F.count_distinct("extractor").alias("n_voters"))
    return qa.merge_votes(rows, n).withColumnRenamed("case", "case_id")


# records
@query(FULL + """ SELECT id, 'phenotype' AS kind, term AS about, excluded FROM ph UNION ALL SELECT id, 'diagnosis', disease, false FROM dx UNION ALL SELECT id, 'variant', gene, false FROM gx""")
def assertions(spark: SparkSession, d: str) -> DataFrame:
    return records.assertions(Base(spark, d).current("phenotypes", "diagnoses", "variants")).select("id", "kind", "about", "excluded")


@query(FULL + """, b AS (SELECT id, len([p FOR p IN phenotypes IF coalesce(len(p.evidence), 0) = 0]) AS np, len([p FOR p IN diagnoses IF coalesce(len(p.evidence), 0) = 0]) AS nd, len([p FOR p IN variants IF coalesce(len(p.evidence), 0) = 0]) AS nv,
  len(phenotypes) AS lp FROM cur) SELECT id, coalesce(np, 0) + coalesce(nd, 0) + coalesce(nv, 0) AS n_dropped, coalesce(lp - np, 0) AS n_kept FROM b""")
def enforce_provenance(spark: SparkSession, d: str) -> DataFrame:
    out = records.enforce_provenance(Base(spark, d).current("phenotypes", "diagnoses", "variants"))
    return out.select("id", F.col("n_dropped").cast("long").alias("n_dropped"), F.greatest(F.coalesce(F.size("phenotypes"), F.lit(0)), F.lit(0)).cast("long").alias("n_kept"))


@query(FULL + """, al AS (SELECT id, 'phenotype' AS kind, term AS about, excluded FROM ph UNION ALL SELECT id, 'diagnosis', disease, false FROM dx UNION ALL SELECT id, 'variant', gene, false FROM gx)
SELECT cur.source.pmid AS pmid, kind, about, excluded, min(al.id) AS first_id FROM al JOIN cur ON cur.id = al.id WHERE about IS NOT NULL AND cur.source.pmid IS NOT NULL GROUP BY 1, 2, 3, 4""")
def union_by_paper(spark: SparkSession, d: str) -> DataFrame:
    return records.union_by_paper(Base(spark, d).current("source", "phenotypes", "diagnoses", "variants"))


@query(FULL + """, s AS (SELECT id, count(DISTINCT term) AS n FROM ph WHERE NOT excluded AND term IS NOT NULL GROUP BY 1), x AS (SELECT id, count(DISTINCT term) AS n FROM ph WHERE excluded AND term IS NOT NULL GROUP BY 1)
SELECT cur.id, coalesce(s.n, 0) AS n_observed, coalesce(x.n, 0) AS n_excluded, coalesce(len(diagnoses), 0) AS n_diagnoses, coalesce(len(variants), 0) AS n_variants,
 coalesce('PMID:' || nullif(trim(source.pmid), ''), 'PMCID:' || nullif(trim(source.pmcid), ''), 'DOI:' || nullif(trim(source.doi), ''), 'UNKNOWN:0') AS source FROM cur LEFT JOIN s USING (id) LEFT JOIN x USING (id)""")
def case_summary(spark: SparkSession, d: str) -> DataFrame:
    s = records.summary(Base(spark, d).current("source", "phenotypes", "diagnoses", "variants"))
    return s.select("id", *[F.col(c).cast("long").alias(c) for c in ("n_observed", "n_excluded", "n_diagnoses", "n_variants")], "source")


@query(FULL + """, o AS (SELECT id, count(DISTINCT term) AS n FROM ph WHERE NOT excluded AND term IS NOT NULL GROUP BY 1) SELECT cur.id, source.pmid AS pmid, coalesce(n, 0) AS n_observed FROM cur LEFT JOIN o USING (id)""")
def phenopacket_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = records.from_phenopacket(records.to_phenopacket(Base(spark, d).current()))
    clean_terms = F.filter("observed", lambda x: x.isNotNull())
    return back.select("id", "pmid", F.greatest(F.coalesce(F.size(clean_terms), F.lit(0)), F.lit(0)).cast("long").alias("n_observed"))


@query("SELECT paper_id, pmid, CASE WHEN nullif(trim(pmcid), '') IS NULL OR tier = 'abstract_only' THEN 'abstract_only' WHEN trim(license) IN ('CC0', 'CC BY', 'CC BY-SA') THEN 'full_text_quotable' ELSE 'full_text_facts_only' END AS access, CASE WHEN trim(license) IN ('CC0', 'CC BY', 'CC BY-SA') THEN abstract END AS quote FROM (SELECT DISTINCT paper_id, pmid, pmcid, tier, license, abstract FROM eval_papers)")
def licence_tiers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "eval_papers").select("paper_id", "pmid", "pmcid", "tier", "license", "abstract").distinct()
    access = tx.access_tier(F.nullif(F.trim("pmcid"), F.lit("")).isNotNull(), F.coalesce(F.col("tier") != "abstract_only", F.lit(True)), F.col("license"))
    return p.select("paper_id", "pmid", access.alias("access"), tx.gated_quote(F.col("abstract"), F.col("license")).alias("quote"))


@query(f"""WITH cur AS (SELECT DISTINCT source.pmid AS pmid FROM case_records WHERE source.pmid IS NOT NULL),
p AS (SELECT *, nullif(regexp_replace(pmid, '[^0-9]', '', 'g'), '') AS num FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC) AS rn FROM eval_papers) WHERE rn = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY paper_id) AS seen FROM p),
r AS (SELECT CASE WHEN NOT coalesce(trim(license) IN ('CC0', 'CC BY', 'CC BY-SA'), false) THEN 'not_open' WHEN abstract IS NULL OR trim(abstract) = '' THEN 'no_body'
  WHEN regexp_matches(title, '(?i)\\b(review|meta-analysis|systematic|scoping|narrative)\\b|current (status|approaches|perspectives|concepts)|\\bstate of the art\\b|\\bupdate on\\b|\\badvances in\\b|\\boverview of\\b|\\bwhat we know\\b') THEN 'review'
  WHEN num IN (SELECT pmid FROM cur) THEN 'already_curated' WHEN num IS NOT NULL AND seen > 1 THEN 'duplicate' WHEN coalesce(n_gold_cases, 0) = 0 THEN 'no_cases' ELSE 'kept' END AS reason FROM s)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def reject_cascade(spark: SparkSession, d: str) -> DataFrame:
    from caseweave.plans.corpus import reject_reasons

    p = table(spark, d, "eval_papers")
    latest = p.groupBy("paper_id").agg(F.max_by(F.struct("pmid", "license", "abstract", "title", "n_gold_cases"), F.struct("loaded_at", F.xxhash64("title", "abstract"))).alias("r")).select("paper_id", "r.*")
    curated = table(spark, d, "case_records").select(F.col("source.pmid").alias("number")).filter("number IS NOT NULL").distinct()
    return reject_reasons(latest, curated).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# search
@query(FULL + f""", d AS (SELECT term FROM closed WHERE ancestor = (SELECT min(parent) FROM edge WHERE parent <> '{ROOT}')) SELECT DISTINCT o.id FROM (SELECT DISTINCT id, term FROM ph WHERE NOT excluded AND term IS NOT NULL) o JOIN d USING (term) JOIN gx USING (id) WHERE gene IS NOT NULL""")
def facet_intersection(spark: SparkSession, d: str) -> DataFrame:
    b = Base(spark, d)
    closed = b.closure()
    posts = search.postings(b.current("phenotypes", "diagnoses", "variants"))
    start = dag.edges(b.rows).filter(F.col("parent") != ROOT).agg(F.min("parent").alias("value"))
    genes = posts.filter("kind = 'variant'").select("value")
    return search.facets(posts, {"phenotype": search.with_descendants(start, closed), "variant": genes})


@query(FULL + f""", p AS (SELECT DISTINCT id, {clean('p.term.id')} AS value, p.term.label AS label FROM (SELECT id, unnest(phenotypes) AS p FROM cur) WHERE NOT coalesce(p.excluded, false) AND {clean('p.term.id')} IS NOT NULL)
SELECT value, min(label) AS label, count(DISTINCT id) AS n_records FROM p WHERE lower(label) LIKE '%swell%' GROUP BY 1 ORDER BY n_records DESC, label, value LIMIT 20""")
def suggest_terms(spark: SparkSession, d: str) -> DataFrame:
    return search.suggestions(search.postings(Base(spark, d).current("phenotypes", "diagnoses", "variants")), "swell")


@query(FULL + """, p AS (SELECT id, 'phenotype' AS kind, term AS value FROM ph WHERE NOT excluded UNION SELECT id, 'diagnosis', disease FROM dx UNION SELECT id, 'variant', gene FROM gx) SELECT kind, count(DISTINCT value) AS n_values, count(DISTINCT id) AS n_records FROM p WHERE value IS NOT NULL GROUP BY 1""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.statistics(search.postings(Base(spark, d).current("phenotypes", "diagnoses", "variants")))


# text
@query("SELECT doc_id, regexp_replace(translate(text, '\u2010\u2011\u2013\u2014\u2212\u2018\u2019\u201c\u201d', '-----''''\"\"'), '[ \\t\\x{A0}\\x{2007}\\x{202F}]+', ' ', 'g') AS text FROM (SELECT DISTINCT doc_id, text FROM documents)")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").distinct().select("doc_id", tx.normalised(F.col("text")).alias("text"))


@query()
def ground_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the ontology in all documents, with negation."""
    b = Base(spark, d)
    phrases = grounding.dictionary(dag.label_index(b.terms), dag.label_index(b.terms, ("BROAD", "RELATED"), names=False))
    return grounding.ground(table(spark, d, "documents"), phrases)


# RE2 sees word ends at letters that are not ASCII; they are made word characters first
WORDY = "regexp_replace(text, '[\\p{Lo}\\p{Lm}\\p{Mn}\\p{Mc}À-ÖØ-öø-ʯͰ-ϿЀ-ӿ]', '_', 'g')"


@query(("SELECT doc_id, 'hgvs.c' AS kind, v AS variant, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(WORDY_, '(?i)\\b(?:[NX][MR]_\\d+(?:\\.\\d+)?:)?c\\.[\\d_+\\-*]+(?:[ACGT]+>[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+|delins[ACGT]+)')) AS v FROM documents) GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, 'hgvs.p', v, count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(WORDY_, '\\b(?:[NX]P_\\d+(?:\\.\\d+)?:)?p\\.\\(?[A-Z][a-z]{2}\\d+(?:[A-Z][a-z]{2}|Ter|\\*|fs|del|dup)\\)?')) AS v FROM documents) GROUP BY 1, 2, 3").replace("WORDY_", WORDY))
def variant_mentions(spark: SparkSession, d: str) -> DataFrame:
    return grounding.variant_mentions(table(spark, d, "documents"))


@query((FULL + """, g AS (SELECT DISTINCT v.gene.label AS symbol, """ + clean("v.gene.id") + """ AS gene FROM (SELECT unnest(variants) AS v FROM cur) WHERE v.gene.label IS NOT NULL),
m AS (SELECT doc_id, unnest(regexp_extract_all(WORDY_, '\\b[A-Z][A-Z0-9]{1,9}(?:-[A-Z0-9]{1,4})?\\b')) AS symbol FROM documents)
SELECT doc_id, symbol, gene, count(*) AS n FROM m JOIN (SELECT symbol, min(gene) AS gene FROM g WHERE gene IS NOT NULL GROUP BY 1) USING (symbol) GROUP BY 1, 2, 3""").replace("WORDY_", WORDY))
def gene_mentions(spark: SparkSession, d: str) -> DataFrame:
    v = Base(spark, d).current("variants").select(F.explode("variants").alias("v")).select(F.col("v.gene.label").alias("symbol"), clean_id(F.col("v.gene.id")).alias("gene"))
    symbols = v.filter("symbol IS NOT NULL AND gene IS NOT NULL").groupBy("symbol").agg(F.min("gene").alias("gene"))
    return grounding.gene_mentions(table(spark, d, "documents"), symbols)


@query(FULL + """, ev AS (SELECT DISTINCT pmid, e.quote AS quote FROM (
  SELECT pmid, unnest(p.evidence) AS e FROM (SELECT source.pmid AS pmid, unnest(phenotypes) AS p FROM cur) UNION ALL SELECT pmid, unnest(p.evidence) FROM (SELECT source.pmid AS pmid, unnest(diagnoses) AS p FROM cur)
  UNION ALL SELECT pmid, unnest(p.evidence) FROM (SELECT source.pmid AS pmid, unnest(variants) AS p FROM cur)) WHERE pmid IS NOT NULL),
q AS (SELECT pmid, quote, regexp_replace(quote, '^\\s+|\\s+$', '', 'g') AS q FROM ev), s AS (SELECT pmid, quote, q, regexp_replace(q, '\\s+', ' ', 'g') AS s FROM q WHERE q <> ''),
m AS (SELECT doc_id, quote, instr(text, q) AS a, instr(text, s) AS b FROM s JOIN (SELECT DISTINCT doc_id, pmid, text FROM documents) USING (pmid) WHERE contains(text, q) OR contains(text, s))
SELECT DISTINCT doc_id, quote, CASE WHEN a > 0 THEN a ELSE b END - 1 AS at FROM m""")
def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """Evidence quotes of findings, diagnoses and variants in the texts of their paper."""
    return quotes.locate_quotes(_paper_texts(spark, d), _evidence_quotes(table(spark, d, "case_records")))


def _paper_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("pmid").alias("key"), "text")


def _evidence_quotes(rows: DataFrame) -> DataFrame:
    """(key, quote): quotes of all evidence of current records with the number of the paper; only quotes are shuffled."""
    none = F.array().cast("array<string>")
    lists = [name for name, _ in records.LISTS]
    evidence = F.concat(*[F.coalesce(F.flatten(F.transform(name, lambda x: F.coalesce(F.transform(x["evidence"], lambda e: e["quote"]), none))), none) for name in lists])
    cur = newest_values(rows, "id", "ingested_at", ["source", *lists], {"key": F.col("source.pmid"), "quotes": F.array_distinct(evidence)})
    return cur.filter("key IS NOT NULL").select("key", F.explode("quotes").alias("quote")).filter("quote IS NOT NULL")


@query(f"SELECT id, round({ISO_SQL.format(c='d')}, 4) AS days FROM (SELECT DISTINCT id, subject.age_at_last_encounter.iso8601duration AS d FROM case_records) WHERE d IS NOT NULL")
def iso_duration_days(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_records").select("id", F.col("subject.age_at_last_encounter.iso8601duration").alias("d")).distinct().filter("d IS NOT NULL")
    return c.select("id", F.round(iso_days(F.col("d")), 4).alias("days"))


def _whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents without known sections: the whole text is one abstract."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text").distinct()
    span = F.struct(F.lit("abstract").alias("section"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("heading"))
    return docs.withColumn("spans", F.array(span))


@query()
def extract_records(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary extraction over all documents: findings, best diagnosis and gene per document, flattened to counts."""
    b = Base(spark, d)
    labels = dag.label_index(b.terms)
    finding_words = grounding.dictionary(labels.filter(F.col("term").startswith("HP:")))
    illness = grounding.dictionary(labels.filter(F.col("term").startswith("MONDO:")))
    v = b.current("variants").select(F.explode("variants").alias("v")).select(F.col("v.gene.label").alias("symbol"), clean_id(F.col("v.gene.id")).alias("gene"))
    symbols = v.filter("symbol IS NOT NULL AND gene IS NOT NULL").groupBy("symbol").agg(F.min("gene").alias("gene"))
    r = extract.dictionary_records(_whole_texts(spark, d), finding_words, illness, symbols, b.closure())
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(f"n_{c}")
    return r.select("doc_id", size("phenotypes"), F.get("diagnoses", F.lit(0))["disease"].alias("disease"), F.get("variants", F.lit(0))["gene"].alias("gene"), size("qa_flags"))
