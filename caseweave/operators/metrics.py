"""Precision, recall and F1: exact, graded by semantic similarity, micro, macro, over grouping sets, with intervals.

Scores are long rows (case, field, tp, fp, fn, tp_p, tp_r): ``tp_p`` and ``tp_r`` are the numerators of precision and of
recall, which differ for graded scores. Rows add up, so any grouping is a sum. A ratio with denominator 0 is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("tp", "fp", "fn", "tp_p", "tp_r")
THRESHOLD = 0.5
KS = (1, 3, 5, 10, 20)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 to a frame with the five parts."""
    p = ratio(F.col("tp_p"), F.col("tp_p") + F.col("fp"))
    r = ratio(F.col("tp_r"), F.col("tp_r") + F.col("fn"))
    out = df.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def over_cases(scores: DataFrame, cases: DataFrame | None, keys: list[str], missing: float = 0.0) -> DataFrame:
    """``scores`` with a row for each of ``cases`` (keys), those that neither side has a value for with ``missing``."""
    if cases is None:
        return scores
    rest = [c for c in scores.columns if c not in keys]
    return cases.select(*keys).distinct().join(scores, keys, "left").select(*keys, *[F.coalesce(c, F.lit(missing)).alias(c) for c in rest])


def exact(pred: DataFrame, gold: DataFrame, keys: list[str], cases: DataFrame | None = None) -> DataFrame:
    """(keys, tp, fp, fn, tp_p, tp_r) of two frames (keys, value): one full join, repeated values once.

    A case without values on either side has no row unless ``cases`` (keys) lists it; its parts are 0 then.
    """
    p = pred.select(*keys, "value").distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys, "value").distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [*keys, "value"], "full")
    hit, only_p, only_g = F.col("_p").isNotNull() & F.col("_g").isNotNull(), F.col("_g").isNull(), F.col("_p").isNull()
    n = lambda c: F.count_if(c).cast("double")
    return over_cases(both.groupBy(*keys).agg(n(hit).alias("tp"), n(only_p).alias("fp"), n(only_g).alias("fn"), n(hit).alias("tp_p"), n(hit).alias("tp_r")), cases, keys)


def graded(pred: DataFrame, gold: DataFrame, sim: DataFrame, keys: list[str], threshold: float = THRESHOLD, cases: DataFrame | None = None) -> DataFrame:
    """Best-match scores of two frames (keys, term) under ``sim`` (a, b, lin), a from pred and b from gold.

    Pairs are made within a case only (an equi-join on the keys). Best matches below ``threshold`` count 0.
    Cases without terms are listed as in ``exact``.
    """
    p, g = pred.select(*keys, F.col("term").alias("a")).distinct(), gold.select(*keys, F.col("term").alias("b")).distinct()
    pairs = p.join(g, keys).join(sim.select("a", "b", "lin"), ["a", "b"], "left").withColumn("s", F.when(F.col("lin") >= threshold, F.col("lin")).otherwise(0.0))
    best_p = pairs.groupBy(*keys, "a").agg(F.max("s").alias("s"))
    best_g = pairs.groupBy(*keys, "b").agg(F.max("s").alias("s"))
    side_p = p.join(best_p, [*keys, "a"], "left").groupBy(*keys).agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("tp_p"), F.count(F.lit(1)).alias("np"))
    side_g = g.join(best_g, [*keys, "b"], "left").groupBy(*keys).agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("tp_r"), F.count(F.lit(1)).alias("ng"))
    zero = F.lit(0.0)
    j = side_p.join(side_g, keys, "full").select(*keys, *[F.coalesce(c, zero).alias(c) for c in ("tp_p", "np", "tp_r", "ng")])
    return over_cases(j.select(*keys, ((F.col("tp_p") + F.col("tp_r")) / 2).alias("tp"), (F.col("np") - F.col("tp_p")).alias("fp"), (F.col("ng") - F.col("tp_r")).alias("fn"), "tp_p", "tp_r"), cases, keys)


def closure_jaccard(pred: DataFrame, gold: DataFrame, closed: DataFrame, keys: list[str], cases: DataFrame | None = None) -> DataFrame:
    """(keys, jaccard) of the ancestor sets of two frames (keys, term); 1 for ``cases`` that have terms on neither side."""
    up = closed.select("term", "ancestor")
    side = lambda df, mark: df.select(*keys, "term").distinct().join(up, "term").select(*keys, "ancestor").distinct().withColumn(mark, F.lit(1))
    both = side(pred, "_p").join(side(gold, "_g"), [*keys, "ancestor"], "full")
    return over_cases(both.groupBy(*keys).agg((F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()) / F.count(F.lit(1))).alias("jaccard")), cases, keys, 1.0)


def summarise(scores: DataFrame, dims: list[str]) -> DataFrame:
    """Micro and macro figures of (dims, field, parts) over all grouping sets of ``dims``; 'all' marks a rolled-up dim."""
    scored = with_prf(scores)
    cubed = scored.cube("field", *dims)
    g = cubed.agg(*[F.sum(c).alias(c) for c in PARTS], F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n"), F.grouping("field").alias("_field"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    g = g.filter("_field = 0")
    for d in dims:
        g = g.withColumn(d, F.when(F.col(f"_{d}") == 1, "all").otherwise(F.col(d)))
    return with_prf(g.drop("_field", *[f"_{d}" for d in dims])).withColumnRenamed("f1", "micro_f1")


def bootstrap(scores: DataFrame, case: str, n: int = 1000, seed: int = 20260817, alpha: float = 0.05) -> DataFrame:
    """(field, lo, hi): percentile interval of the micro F1 under resampling of cases; no rows without cases.

    Instead of drawing n times from a list, each case gets for each replicate a Poisson(1) number of copies, drawn by a
    generator seeded with (seed, case): a replicate is a weighted sum, added up per task before anything is shuffled, so
    n rows a field and task leave the scan.
    """
    kind = "field string, rep int, " + ", ".join(f"{c} double" for c in PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            field = np.array(batch.column(0).to_pylist(), object)
            marks = batch.column(1).to_numpy().view(np.uint64)
            values = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(PARTS))], 1)
            order = np.argsort(marks, kind="stable")
            for at in range(0, len(order), 2000):
                rows = order[at : at + 2000]
                names, which = np.unique(marks[rows], return_inverse=True)
                weights = np.stack([np.random.Generator(np.random.PCG64([seed, int(m)])).poisson(1.0, n) for m in names]).astype(float)[which]
                for f in set(field[rows]):
                    mine = field[rows] == f
                    sums[f] = sums.get(f, np.zeros((n, len(PARTS)))) + weights[mine].T @ values[rows][mine]
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * n), pa.array(np.arange(n), pa.int32()), *(pa.array(np.ascontiguousarray(total[:, i])) for i in range(len(PARTS)))], names=["field", "rep", *PARTS])

    part = scores.filter(F.col("field").isNotNull()).select("field", F.xxhash64(F.col(case).cast("string")).alias("mark"), *[F.col(c).cast("double").alias(c) for c in PARTS]).mapInArrow(run, kind)
    # rounded where tasks add up in another order
    sums = with_prf(part.groupBy("field", "rep").agg(*[F.round(F.sum(c), 9).alias(c) for c in PARTS]))
    ranked = sums.groupBy("field").agg(F.array_sort(F.collect_list("f1")).alias("f"), F.count(F.lit(1)).alias("m"))  # n values a field
    lo = F.element_at("f", (F.floor(F.col("m") * alpha / 2) + 1).cast("int"))
    hi = F.element_at("f", F.least(F.col("m"), F.floor(F.col("m") * (1 - alpha / 2)) + 1).cast("int"))
    return ranked.select("field", lo.alias("lo"), hi.alias("hi"))


def best_of(scores: DataFrame, group: str, case: str, by: str = "f1") -> DataFrame:
    """(group, case, by): the case with the highest score of each group, the first by name where they tie."""
    best = scores.groupBy(group).agg(F.min_by(F.struct(case, by), F.struct(-F.col(by), F.col(case))).alias("b"))
    return best.select(group, f"b.{case}", f"b.{by}")


def first_hit(ranked: DataFrame, gold: DataFrame, query: str = "query", item: str = "item") -> DataFrame:
    """(query, rank): rank of the first right answer of ``ranked`` (query, item, rank); null where none is right."""
    right = ranked.join(gold.select(query, item).distinct(), [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("rank"))
    return gold.select(query).distinct().join(right, query, "left")


def hit_at_k(first: DataFrame, answered: DataFrame, query: str = "query", ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: hit@k and MRR over answered queries and over all, and coverage; ``answered`` has the queries with a ranking."""
    joined = first.join(answered.select(query).distinct().withColumn("_a", F.lit(1)), query, "left")
    n, m = F.count(F.lit(1)), F.count("_a")
    out = [n.alias("n_queries"), m.alias("n_answered"), ratio(m, n).alias("coverage")]
    for k in ks:
        hits = F.count_if(F.col("rank") <= k)
        out += [ratio(hits, m).alias(f"hit_{k}"), ratio(hits, n).alias(f"hit_{k}_all")]
    rr = F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0)))
    return joined.agg(*out, ratio(rr, m).alias("mrr"), ratio(rr, n).alias("mrr_all"))
