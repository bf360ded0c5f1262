"""Consensus labels, agreement and annotator reliability from the votes of several annotators.

Message passing on the bipartite graph of items and annotators, one class against the rest, on the edges, the votes:

* an annotator tells an item, for each class, the log-odds that the vote it gave speaks for the class and not for the
  rest, judged by what all *other* items of the annotator are believed to be (so a vote says little if the annotator
  guesses, and the opposite if the annotator swaps two labels);
* an item tells an annotator, for each class, how much the item is believed to be of it, judged by the messages of all
  *other* annotators of the item, scaled so that the classes of an item sum to one.

Messages start from the shares of the other votes and are passed until they change by less than ``tolerance`` on
average and no more than a ``tolerance`` share of them still moves by more than ``MOVING``. ``Consensus.rounds`` and
``Consensus.converged`` say how that went; a run that reaches ``max_rounds`` first warns. The label of an item is the
class with the highest sum of messages and of the prior log-odds. The reliability of an annotator is read off the
converged messages: the mean belief that all others of an item hold in the label it gave, over items that others voted
on too; null if there are none.

An item is one row with the list of its votes, so an item's step moves nothing; what moves in a round are the
annotators' sums, added up per task while it writes the round's messages and kept beside them. That takes the annotators' table in every task: up to ``MAX_ANNOTATORS``
(checked), which also bounds an item's row. With more annotators the same messages are passed over one row per vote by
joins and aggregates (``wide_messages``). Either way the messages of a round are written to the shared folder, so a lost
executor costs one round at most.

Defined cases: a vote is trimmed and lower-cased; null, blank and unknown labels are no vote; of several votes of one
annotator on one item the latest with a label counts (ties: the greater label); votes without item or annotator count
for nothing; an item without any vote gets the most common class, agreement null; empty tables give empty results;
equal scores go to the class named first in ``classes``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.ids import trimmed
from caseweave.session import cut, release

CLASSES = ("present", "excluded", "not_stated")
MAX_ANNOTATORS = 50_000
MOVING = 0.05
SMOOTH = 1.0


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def votes(rows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(item, who, y): the counting vote of every annotator on every item; y indexes ``classes``, null where none counts."""
    label = F.lower(trimmed(F.col("vote")))
    y = reduce(lambda acc, i: acc.when(label == classes[i], F.lit(i)), range(1, len(classes)), F.when(label == classes[0], F.lit(0)))
    counting = F.when(y.isNotNull() & F.col("extractor").isNotNull(), F.struct("voted_at", y.alias("y")))
    return (
        rows.filter(F.col("item_id").isNotNull())
        .select(F.col("item_id").alias("item"), F.col("extractor").alias("who"), counting.alias("v"))
        .groupBy("item", "who")
        .agg(F.max("v").alias("v"))
        .select("item", "who", F.col("v.y").alias("y"))
    )


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


class Sums:
    """What the annotators' votes were given to: n[w, y] votes, s[w, y, c] beliefs; and how far the last round moved."""

    def __init__(self, found: pa.Table, n_annotators: int, k: int):
        self.n, self.s = np.zeros((n_annotators, k)), np.zeros((n_annotators, k, k))
        w, y = found["w"].to_numpy(), found["y"].to_numpy()
        self.n[w, y] = found["n"].to_numpy()
        for c in range(k):
            self.s[w, y, c] = found[f"s{c}"].to_numpy()
        self.votes = max(1.0, self.n.sum())
        self.change, self.moving = (float(np.sum(found[x].to_numpy())) / self.votes for x in ("change", "moving"))
        self.odds = np.array([_log_odds(p) for p in self.s.sum((0, 1)) / self.votes])


def messages(sums: Sums, w: np.ndarray, y: np.ndarray, b: np.ndarray, starts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(beliefs sent back to each vote's annotator, sums per item) from the beliefs ``b`` of the round before."""
    k = b.shape[1]
    mine = y[:, None] == np.arange(k)
    s, n, every, all_n = sums.s[w, y], sums.n[w, y][:, None], sums.s.sum(1)[w], sums.n.sum(1)[w][:, None]
    # without the vote's own belief; the rest is what is not of the class. An annotator nobody can judge yet is taken to
    # be right twice as often as it gives any one wrong label.
    off = SMOOTH * k / (k + 1)
    for_c = (s - b + np.where(mine, 2 * off, off)) / (every - b + SMOOTH * k)
    for_rest = ((n - s) - (1 - b) + np.where(mine, off, (SMOOTH * k - off) / (k - 1))) / ((all_n - every) - (1 - b) + SMOOTH * k)
    told = np.log(np.maximum(for_c, 1e-9) / np.maximum(for_rest, 1e-9))  # sums of floats may fall a little below what they hold
    whole = np.add.reduceat(told, starts) + sums.odds if len(starts) else np.zeros((0, k))
    back = 1.0 / (1.0 + np.exp(np.minimum(told - whole[row], 600.0)))
    return back / np.maximum(back.sum(1, keepdims=True), 1e-300), whole


class Tally:
    """What a task adds up over the votes it wrote: rows without an item, one per annotator and label, with n, change, moving and beliefs in ``b``."""

    def __init__(self, n_annotators: int, k: int):
        self.k, self.out = k, np.zeros((n_annotators * k, k + 3))

    def add(self, w: np.ndarray, y: np.ndarray, b: np.ndarray, change: np.ndarray) -> None:
        cell = w.astype(np.int64) * self.k + y
        for i, values in enumerate((np.ones(len(cell)), change, (change > MOVING).astype(float), *b.T)):
            self.out[:, i] += np.bincount(cell, values, len(self.out))

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        cell = np.flatnonzero(self.out[:, 0])
        one, many = np.ones(len(cell), np.int64), np.full(len(cell), self.k + 3)
        w, y = (cell // self.k).astype(np.int32), (cell % self.k).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.nulls(len(cell), kind), _lists(w, one), _lists(y, one), _lists(self.out[cell].ravel(), many), _lists(np.zeros(0), one * 0)], names=["item", "w", "y", "b", "change"])


class Packed:
    """The votes of a batch of item rows (item, w, y, b, change) as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.batch = batch = batch.filter(batch.column(0).is_valid())
        lists = batch.column(1)
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.w, self.y = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
        self.b = batch.column(3).flatten().to_numpy().reshape(-1, k)
        self.change = batch.column(4).flatten().to_numpy()
        some = np.flatnonzero(self.sizes)  # items with a vote
        self.some, self.starts = some, (np.cumsum(self.sizes) - self.sizes)[some]
        self.row = np.repeat(np.arange(len(some)), self.sizes[some])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def packed_messages(counted: DataFrame, names: pa.Table, k: int, tolerance: float, max_rounds: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """(decided items, annotators, rounds, converged) with one row per item."""
    spark, n_annotators = counted.sparkSession, names.num_rows
    kind = counted.schema["item"].dataType.simpleString()
    layout = f"item {kind}, w array<int>, y array<tinyint>, b array<double>, change array<double>"
    index = spark.createDataFrame(names.append_column("w", pa.array(np.arange(n_annotators), pa.int32())))
    numbered = counted.join(F.broadcast(index), "who", "left")
    vote = F.when(F.col("y").isNotNull(), F.struct("w", F.col("y").cast("tinyint").alias("y")))
    items = numbered.groupBy("item").agg(F.collect_list(vote).alias("v")).select("item", F.col("v.w").alias("w"), F.col("v.y").alias("y"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, kind_of = Tally(n_annotators, k), None
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            mine = np.eye(k)[batch.column(2).flatten().to_numpy()] if len(row) else np.zeros((0, k))
            shares = np.zeros((len(sizes), k))
            np.add.at(shares, row, mine)
            b = (shares[row] - mine + 1.0 / k) / sizes[row][:, None]
            kind_of = batch.column(0).type
            tally.add(lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64), b, np.ones(len(row)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), _lists(b.ravel(), sizes * k), _lists(np.ones(len(row)), sizes)], names=["item", "w", "y", "b", "change"])
        if kind_of is not None:
            yield tally.batch(kind_of)

    def step(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally, kind_of = Tally(n_annotators, k), None
            for batch in batches:
                p = Packed(batch, k)
                a, _ = messages(shared.value, p.w, p.y, p.b, p.starts, p.row)
                change, kind_of = np.abs(a - p.b).mean(1), batch.column(0).type
                tally.add(p.w, p.y, a, change)
                yield pa.RecordBatch.from_arrays([*p.batch.columns[:3], _lists(a.ravel(), p.sizes * k), _lists(change, p.sizes)], names=["item", "w", "y", "b", "change"])
            if kind_of is not None:
                yield tally.batch(kind_of)

        return run

    def decide(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = Packed(batch, k)
                _, whole = messages(shared.value, p.w, p.y, p.b, p.starts, p.row)
                win, agree = np.full(len(p.sizes), -1), np.full(len(p.sizes), np.nan)
                win[p.some] = whole.argmax(1)
                agree[p.some] = np.bincount(p.row, p.y == win[p.some][p.row], len(p.some)) / p.sizes[p.some]
                yield pa.RecordBatch.from_arrays([p.batch.column(0), pa.array(win, pa.int32()), pa.array(agree, from_pandas=True), pa.array(p.sizes, pa.int64())], names=["item", "win", "agreement", "n_votes"])

        return run

    def trust(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n_annotators, 3))
            for batch in batches:
                p = Packed(batch, k)
                a, _ = messages(shared.value, p.w, p.y, p.b, p.starts, p.row)
                judged = (p.sizes[p.some] > 1)[p.row]
                for i, values in enumerate((np.ones(len(p.w)), judged.astype(float), np.where(judged, a[np.arange(len(a)), p.y], 0.0))):
                    out[:, i] += np.bincount(p.w, values, n_annotators)
            w = np.flatnonzero(out[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), *(pa.array(out[w, i]) for i in range(3))], names=["w", "n", "judged", "trust"])

        return run

    parts = ["n", "change", "moving", *(f"s{c}" for c in range(k))]
    state = cut(items.mapInArrow(begin, layout))
    rounds, converged = 0, False
    while True:
        part = state.filter("item IS NULL").select(F.get("w", F.lit(0)).alias("w"), F.get("y", F.lit(0)).cast("int").alias("y"), *[F.get("b", F.lit(i)).alias(x) for i, x in enumerate(parts)])
        sums = Sums(part.groupBy("w", "y").agg(*[F.sum(x).alias(x) for x in parts]).toArrow(), n_annotators, k)  # at most MAX_ANNOTATORS * k rows
        shared = spark.sparkContext.broadcast(sums)
        converged = rounds > 0 and sums.change < tolerance and sums.moving <= tolerance or not sums.n.any()
        if converged or rounds >= max_rounds:
            break
        before, state = state, cut(state.mapInArrow(step(shared), layout))
        release(before)
        rounds += 1
    decided = cut(state.mapInArrow(decide(shared), f"item {kind}, win int, agreement double, n_votes bigint"))
    per = state.mapInArrow(trust(shared), "w int, n double, judged double, trust double").groupBy("w").agg(*[F.sum(x).alias(x) for x in ("n", "judged", "trust")])
    return decided, per.join(F.broadcast(index), "w").select("who", "n", "judged", "trust"), rounds, converged


def wide_messages(counted: DataFrame, k: int, tolerance: float, max_rounds: int) -> tuple[DataFrame, DataFrame, int, bool]:
    """As ``packed_messages`` with one row per vote, for any number of annotators and any number of votes on an item."""
    edges = cut(counted.filter("y IS NOT NULL"))
    one = [F.when(F.col("y") == c, 1.0).otherwise(0.0) for c in range(k)]
    shares = edges.groupBy("item").agg(F.count(F.lit(1)).alias("m"), *[F.sum(one[c]).alias(f"h{c}") for c in range(k)])
    state = cut(edges.join(shares, "item").select("item", "who", "y", *[((F.col(f"h{c}") - one[c] + 1.0 / k) / F.col("m")).alias(f"b{c}") for c in range(k)], F.lit(1.0).alias("change")))
    off, rounds, converged = SMOOTH * k / (k + 1), 0, False
    while True:
        sums = cut(state.groupBy("who", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("change").alias("change"), F.count_if(F.col("change") > MOVING).alias("moving"), *[F.sum(f"b{c}").alias(f"s{c}") for c in range(k)]))
        whole = sums.agg(F.sum("n"), F.sum("change"), F.sum("moving"), *[F.sum(f"s{c}") for c in range(k)]).first()
        n_votes = whole[0] or 0
        odds = [_log_odds(whole[3 + c] / n_votes) if n_votes else 0.0 for c in range(k)]
        per = sums.groupBy("who").agg(F.sum("n").alias("all_n"), *[F.sum(f"s{c}").alias(f"all{c}") for c in range(k)])
        told = state.drop("change").join(sums.drop("change", "moving").join(per, "who"), ["who", "y"])
        sent = []
        for c in range(k):
            b, mine = F.col(f"b{c}"), F.col("y") == c
            for_c = (F.col(f"s{c}") - b + F.when(mine, 2 * off).otherwise(off)) / (F.col(f"all{c}") - b + SMOOTH * k)
            for_rest = ((F.col("n") - F.col(f"s{c}")) - (1 - b) + F.when(mine, off).otherwise((SMOOTH * k - off) / (k - 1))) / ((F.col("all_n") - F.col(f"all{c}")) - (1 - b) + SMOOTH * k)
            sent.append(F.log(F.greatest(for_c, F.lit(1e-9)) / F.greatest(for_rest, F.lit(1e-9))).alias(f"m{c}"))
        told = cut(told.select("item", "who", "y", *[f"b{c}" for c in range(k)], *sent))
        sums_of_items = told.groupBy("item").agg(F.count(F.lit(1)).alias("m"), *[(F.sum(f"m{c}") + F.lit(odds[c])).alias(f"t{c}") for c in range(k)])
        back = told.join(sums_of_items, "item")
        raw = [1.0 / (1.0 + F.exp(F.least(F.col(f"m{c}") - F.col(f"t{c}"), F.lit(600.0)))) for c in range(k)]
        norm = F.greatest(total(raw), F.lit(1e-300))
        converged = rounds > 0 and n_votes > 0 and whole[1] / n_votes < tolerance and whole[2] / n_votes <= tolerance or not n_votes
        if converged or rounds >= max_rounds:
            break
        change = total([F.abs(r / norm - F.col(f"b{c}")) for c, r in enumerate(raw)]) / k
        before, state = state, cut(back.select("item", "who", "y", *[(r / norm).alias(f"b{c}") for c, r in enumerate(raw)], change.alias("change")))
        for x in (before, sums, told):
            release(x)
        rounds += 1
    best = F.greatest(*[F.col(f"t{c}") for c in range(k)])
    win = reduce(lambda acc, c: acc.when(F.col(f"t{c}") == best, F.lit(c)), range(1, k), F.when(F.col("t0") == best, F.lit(0)))
    belief = reduce(lambda acc, c: acc.when(F.col("y") == c, raw[c] / norm), range(1, k), F.when(F.col("y") == 0, raw[0] / norm))
    final = cut(back.select("item", "who", "y", win.alias("win"), "m", belief.alias("belief")))
    agreed = final.groupBy("item").agg(F.first("win").alias("win"), F.avg((F.col("y") == F.col("win")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n_votes"))
    every = counted.select("item").distinct().join(agreed, "item", "left")
    decided = cut(every.select("item", F.coalesce("win", F.lit(-1)).alias("win"), "agreement", F.coalesce("n_votes", F.lit(0).cast("long")).alias("n_votes")))
    judged = F.col("m") > 1
    trust = final.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.count_if(judged).alias("judged"), F.sum(F.when(judged, F.col("belief")).otherwise(0.0)).alias("trust"))
    return decided, trust, rounds, converged


class Consensus:
    """items: (item_id, label, agreement, n_votes); annotators: (extractor, n_votes, reliability); rounds, converged."""

    def __init__(self, rows: DataFrame, classes: tuple[str, ...] = CLASSES, tolerance: float = 1e-3, max_rounds: int = 200):
        k = len(classes)
        counted = cut(votes(rows, classes))
        names = counted.filter("y IS NOT NULL").select("who").distinct().limit(MAX_ANNOTATORS + 1).toArrow()
        if names.num_rows <= MAX_ANNOTATORS:
            decided, trust, self.rounds, self.converged = packed_messages(counted, names, k, tolerance, max_rounds)
        else:
            decided, trust, self.rounds, self.converged = wide_messages(counted, k, tolerance, max_rounds)
        if not self.converged:
            warnings.warn(f"messages still moved after {self.rounds} rounds", RuntimeWarning, stacklevel=2)
        common = decided.filter("win >= 0").groupBy("win").count().orderBy(F.desc("count"), "win").first()
        fallback = classes[common["win"]] if common else classes[0]
        label = reduce(lambda acc, i: acc.when(F.col("win") == i, F.lit(classes[i])), range(1, k), F.when(F.col("win") == 0, F.lit(classes[0])))
        self.items = decided.select(F.col("item").alias("item_id"), label.otherwise(F.lit(fallback)).alias("label"), F.round("agreement", 4).alias("agreement"), "n_votes")
        self.annotators = trust.select(F.col("who").alias("extractor"), F.col("n").cast("long").alias("n_votes"), F.round(F.try_divide("trust", F.col("judged").cast("double")), 4).alias("reliability"))
