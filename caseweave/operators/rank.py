"""Ranking of profiles (cases, diseases) by symmetric best match of term sets, with explanations and tallies.

score(query, profile) = (mean over query terms of the best pair IC + mean over profile terms of the best pair IC) / 2, the
IC of a pair being that of its most informative common ancestor. So a term of one side needs only the set of all
ancestors of the other side: no table of pairs of terms is made. Queries go to the profiles in blocks of at most
``BLOCK`` (a bounded broadcast, with the closure of the vocabulary behind a size check); each task keeps its best profiles
per query, so what is shuffled is a few rows per query and task, whatever the number of profiles.

Profiles that share no informative ancestor with the query never appear. Order: score, not rounded (beyond nine places,
where sums of the same numbers may differ), then profile id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseweave.session import cut

MIN_SHARED_IC, MAX_SHARED = 1.5, 12
BLOCK, MAX_CLOSURE = 500, 20_000_000


class Vocabulary:
    """Ancestors with information, as arrays: those of term t are ``ancestor[start[t]:start[t + 1]]``."""

    def __init__(self, closed: DataFrame, ic: DataFrame):
        up = closed.select("term", "ancestor").join(ic.filter("ic > 0").select(F.col("term").alias("ancestor"), "ic"), "ancestor")
        rows = up.select("term", "ancestor", "ic").limit(MAX_CLOSURE + 1).toArrow()
        if rows.num_rows > MAX_CLOSURE:
            raise ValueError(f"the closure has more than {MAX_CLOSURE} rows")
        terms, names = np.array(rows["term"].to_pylist(), object), np.array(rows["ancestor"].to_pylist(), object)
        self.names = sorted({*terms, *names})
        self.number = {t: i for i, t in enumerate(self.names)}
        term, up_to = (np.array([self.number[x] for x in v], np.int64) for v in (terms, names))
        order = np.lexsort((up_to, term))
        self.ancestor, sizes = up_to[order], np.bincount(term, minlength=len(self.names))
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.ic = np.zeros(len(self.names))
        self.ic[up_to] = rows["ic"].to_numpy()

    def numbers(self, terms: list[str]) -> np.ndarray:
        return np.array([self.number[t] for t in terms if t in self.number], np.int64)

    def climb(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ancestors of all terms one after another, where each term's begin); every term of the vocabulary has some."""
        sizes = self.start[terms + 1] - self.start[terms]
        starts = np.cumsum(sizes) - sizes
        flat = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(self.start[terms], sizes)
        return self.ancestor[flat], starts


class Asked:
    """A block of queries against a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, names: list[Any], terms: list[list[str]]):
        self.v, self.names = vocabulary, names
        self.sizes = np.array([len(set(t)) for t in terms], float)
        known = [np.unique(vocabulary.numbers(t)) for t in terms]
        self.known = np.array([len(k) for k in known])
        self.flat, self.starts = vocabulary.climb(np.concatenate(known)) if known else (np.zeros(0, np.int64),) * 2
        self.above = np.zeros((len(names), len(vocabulary.names)))
        for i, k in enumerate(known):
            self.above[i, vocabulary.climb(k)[0]] = 1.0
        self.above *= vocabulary.ic  # IC of what is above the query, else 0
        self.begins = np.cumsum(self.known) - self.known

    def scores(self, terms: list[str]) -> np.ndarray:
        """The score of one profile for every query; 0 where nothing informative is shared."""
        known = np.unique(self.v.numbers(terms))
        if not len(known) or not len(self.starts):
            return np.zeros(len(self.names))
        up, starts = self.v.climb(known)
        back = np.maximum.reduceat(self.above[:, up], starts, axis=1).sum(1)
        mine = np.zeros(len(self.v.names))
        mine[up] = self.v.ic[up]
        best = np.maximum.reduceat(mine[self.flat], self.starts)
        some = self.known > 0
        forth = np.zeros(len(self.names))
        forth[some] = np.add.reduceat(best, self.begins[some])
        return np.where(back > 0, (forth / np.maximum(self.sizes, 1) + back / len(set(terms))) / 2, 0.0)


def search(queries: DataFrame, profiles: DataFrame, closed: DataFrame, ic: DataFrame, n: int, min_terms: int = 1, places: int | None = None) -> DataFrame:
    """(query, profile, score, n_terms, rank): the first ``n`` profiles (profile, term) of every query (query, term).

    Profiles of fewer than ``min_terms`` terms are left out; scores are rounded to ``places`` after the ranking.
    """
    spark = queries.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(closed, ic))
    sets = profiles.groupBy("profile").agg(F.array_sort(F.collect_set("term")).alias("terms")).filter(F.size("terms") >= min_terms)
    sets = cut(sets)  # read once a block
    asked = cut(queries.groupBy("query").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    n_blocks = max(1, -(-asked.count() // BLOCK) * 2 - 1)  # hashed, so a block may hold somewhat more than its share
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "profile": profiles.schema["profile"].dataType.simpleString()}
    out = None
    for block in range(n_blocks):
        mine = asked.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == block).orderBy("query").toArrow()
        if mine.num_rows:
            shared = spark.sparkContext.broadcast((mine["query"].to_pylist(), mine["terms"].to_pylist()))
            one = sets.mapInArrow(_best(vocabulary, shared, n), f"query {kinds['query']}, profile {kinds['profile']}, score double, n_terms int")
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], f"query {kinds['query']}, profile {kinds['profile']}, score double, n_terms int")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "profile"))).filter(F.col("rank") <= n)
    score = F.round("score", places) if places is not None else F.col("score")
    return ranked.select("query", "profile", score.alias("score"), F.col("n_terms").cast("long").alias("n_terms"), "rank")


def _best(vocabulary: Any, shared: Any, n: int):  # noqa: ANN202
    """The best ``n`` profiles per query of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(vocabulary.value, *shared.value)
        kept: list[pa.RecordBatch] = []
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            terms = batch.column(1).to_pylist()
            scores = np.stack([asked.scores(t) for t in terms], 1) if terms else np.zeros((len(asked.names), 0))
            kept.append(_first(asked, batch.column(0), scores, [len(t) for t in terms], n))
        if kept:
            table = pa.Table.from_batches(kept).to_pandas()
            # of the batches' best the best, ties by profile
            table["key"] = -table["score"].round(9)
            best = table.sort_values(["query", "key", "profile"]).groupby("query", sort=False).head(n)
            yield pa.RecordBatch.from_arrays([pa.array(best["query"], kept[0].column(0).type), pa.array(best["profile"], kind), pa.array(best["score"]), pa.array(best["n_terms"], pa.int32())], names=["query", "profile", "score", "n_terms"])

    return run


def _first(asked: Asked, profiles: pa.Array, scores: np.ndarray, sizes: list[int], n: int) -> pa.RecordBatch:
    """For each query the profiles of a batch with one of its ``n`` highest scores, all that tie with the last included."""
    rows, cols = [], []
    rounded = np.round(scores, 9)
    for i in range(len(scores)):
        good = np.flatnonzero(scores[i] > 0)
        if len(good) > n:
            good = good[rounded[i, good] >= np.partition(rounded[i, good], len(good) - n)[len(good) - n]]
        rows.append(np.full(len(good), i))
        cols.append(good)
    r, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
    names = pa.array(asked.names).take(pa.array(r))
    return pa.RecordBatch.from_arrays([names, profiles.take(pa.array(c)), pa.array(scores[r, c]), pa.array(np.array(sizes, np.int32)[c])], names=["query", "profile", "score", "n_terms"])


def explain(hits: DataFrame, queries: DataFrame, profiles: DataFrame, closed: DataFrame, ic: DataFrame, min_ic: float = MIN_SHARED_IC, cap: int = MAX_SHARED) -> DataFrame:
    """(query, profile, term, ic, place): profile terms of the hits whose best IC to the query reaches ``min_ic``, best first, at most ``cap``."""
    up = closed.select("term", "ancestor").join(ic.filter(F.col("ic") >= min_ic).select(F.col("term").alias("ancestor"), "ic"), "ancestor")
    above = queries.select("query", "term").distinct().join(up, "term").select("query", "ancestor").distinct()
    terms = hits.select("query", "profile").join(profiles.select("profile", "term").distinct(), "profile")
    rows = terms.join(up, "term").join(above, ["query", "ancestor"], "left_semi").groupBy("query", "profile", "term").agg(F.max("ic").alias("ic"))
    order = W.partitionBy("query", "profile").orderBy(F.desc(F.round("ic", 9)), "term")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).select("query", "profile", "term", "ic", "place")


def tally(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, label, n_profiles, score, profiles): labels of the hits weighted by score; ``labels`` is (profile, label)."""
    joined = hits.select("query", "profile", "score").join(labels.select("profile", "label").filter(F.col("label").isNotNull()).distinct(), "profile")
    return joined.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n_profiles"), F.round(F.sum("score"), 3).alias("score"), F.array_sort(F.collect_list("profile")).alias("profiles"))
