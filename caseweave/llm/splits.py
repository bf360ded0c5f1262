"""Records of evaluation splits that also appear in the training split.

A text is compared as the set of its hashed runs of ``width`` words. Neither texts nor whole sets are shuffled or written,
but for the pairs that are left at the end: a set is made again from its text in each of three scans.

1. A table of one-byte logarithmic counters, at most ``2**MAX_BITS`` of them whatever the data's size, tells how common
   each n-gram of the evaluation side is in training. Several n-grams may share a counter: a counter then says too much,
   never too little, which costs time and loses nothing.
2. Of each set of either side only its n-grams rarest by these counters are kept, in one order for all, as many as make sure
   that two sets at the threshold have some of them in common (what the other side has not at all is used up first). A
   set with too few n-grams of the other side is dropped. They are written with a bit vector of the set's parities.
3. Sets meet by the n-grams kept. The vectors of two sets differ in no more bits than the sets in members, so a pair whose
   vectors differ in more than the threshold allows is dropped in the join itself; n-grams beyond ``PASS_ROWS`` are joined
   in several passes, one after the other.
4. Containment of each evaluation set in each training set so met, and the overlap, are computed on the whole sets.

* Null texts and texts below ``min_tokens`` words take no part in the text comparison.
* Repeated rows of an id count once, the last loaded wins, in the report too. Ids are compared within the two sides only.
* Empty tables give no pairs; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions.ids import trimmed
from caseweave.session import cut, release, sweep

#: A word: a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
MIN_BITS, MAX_BITS = 16, 24
#: Counters that travel together, as a power of two.
BLOCK = 12
#: Bit vectors tell sets of up to so many members apart. A larger pair goes on with one hit, and one more for each PER_HIT n-grams that it must share.
PLAIN, PER_HIT = 256, 12
#: 64-bit words of a bit vector.
VECTOR = 3
#: Rows of n-grams above which they are joined in passes, and the most passes.
PASS_ROWS, PASSES = 4_000_000, 4
#: Code points that are walked at once.
SLICE = 1_000_000
#: Repeated ids up to which they are broadcast.
LISTED = 1_000_000
NAME = ["b0", "b1", "b2", "n"]


def split_name(c: Column) -> Column:
    return F.lower(trimmed(c))


def registry_number(c: Column) -> Column:
    """The digits of an id without leading zeros; null for none or 0."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"\D+", ""), "^0+", ""), F.lit(""))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    marks = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(marks, marks[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def words_of(texts: list[str | None]) -> list[list[str]]:
    """The words of every text, lower-cased: what ``WORD`` finds, but all texts at once."""
    lower = [t.lower().replace("\n", " ") if t else "" for t in texts]
    whole = "\n".join(lower)
    other = [c for c in set(whole) if not c.isalnum() and c not in " \n"]
    if len(other) > 200:
        return [WORD.findall(t) for t in lower]
    for c in other:
        whole = whole.replace(c, " ")
    return [t.split() for t in whole.split("\n")]


def _walker(width: int, min_tokens: int) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function of texts: (texts that take part, hashes of their runs of ``width`` words, for each its place among the former)."""
    odd = np.random.default_rng(width).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kept: dict[str, int] = {}
    hashes = np.empty(0, np.uint64)

    def walk(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal hashes
        at, sizes, words = [], [], []
        for i, own in enumerate(words_of(texts)):
            if len(own) >= max(min_tokens, width):
                at.append(i)
                sizes.append(len(own))
                words += own
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(kept) > 500_000:
            kept.clear()
            hashes = np.empty(0, np.uint64)
        new = list(set(words).difference(kept))
        if new:
            kept.update(zip(new, range(len(kept), len(kept) + len(new))))
            hashes = np.concatenate([hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)])
        one = hashes[np.fromiter(map(kept.__getitem__, words), np.int64, len(words))]
        n = len(one) - width + 1
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                h = (h ^ (one[k : k + n] * odd[k])) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        row = np.repeat(np.arange(len(at)), sizes)
        inside = row[:n] == row[width - 1 :]
        return np.array(at), h[inside].view(np.int64), row[:n][inside]

    return walk


def _sets(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, the n-grams of each row in order; rows are in order already."""
    grams = grams.copy()
    ends = np.cumsum(np.bincount(row)).tolist()
    for lo, hi in zip([0, *ends], ends):
        grams[lo:hi].sort()
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[first], row[first]


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def counters(rows: DataFrame, width: int, min_tokens: int, bits: int, only: Any = None) -> np.ndarray:
    """One byte per slot of n-gram hashes: 0 where no text of ``rows`` (text) has one, else 1 and more the more there are.

    Every task adds up its own share, up to 255 a slot, and sends three bytes per slot it met; the driver gets a byte per
    slot. ``only`` is a broadcast table: slots that are 0 there are left out.
    """
    block = min(BLOCK, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, mine = _walker(width, min_tokens), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in _slices(batch, 0):
                slot, n = np.unique(_slots(walk(part.column(0).to_pylist())[1], bits), return_counts=True)
                mine[slot] += n.astype(np.uint32)
        used = np.flatnonzero(mine if only is None else mine * (only.value > 0))
        low, n = (used & ((1 << block) - 1)).astype("<u2"), np.minimum(mine[used], 255).astype(np.uint8)
        marks = [0, *(np.flatnonzero(np.diff(used >> block)) + 1).tolist(), len(used)]
        if len(used):
            blobs = [low[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(marks, marks[1:])]
            yield pa.RecordBatch.from_arrays([pa.array((used >> block)[marks[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "met"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k not in sums:
                    sums[k] = np.zeros(1 << block, np.uint64)
                m = len(met) // 3
                sums[k][np.frombuffer(met, "<u2", m)] += np.frombuffer(met, np.uint8, m, 2 * m)
        for k, n in sums.items():
            level = np.where(n > 0, np.minimum(1 + 8 * np.log2(np.maximum(n, 1)), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    found = rows.select("text").mapInArrow(run, "block int, met binary").repartition("block").mapInArrow(add, "block int, levels binary").toArrow()
    table = np.zeros((1 << (bits - block), 1 << block), np.uint8)
    for k, levels in zip(found["block"].to_pylist(), found["levels"].to_pylist()):
        table[k] = np.frombuffer(levels, np.uint8)
    return table.reshape(-1)


def _need(n: Any, threshold: float) -> Any:
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def rare_grams(rows: DataFrame, width: int, min_tokens: int, bits: int, common: Any, threshold: float) -> DataFrame:
    """(id, side, k0, k1, n, b0, b1, b2, grams): the sets of n members that may have one at the threshold on the other side.

    ``common`` is the broadcast table of counters of what both sides have. A set at the threshold shares ``need`` members, so
    of all but ``need - least`` of those that the other side has it shares ``least``; these are ``grams``. Sets that a task
    has met before have none: their equal stands for them. ``k0`` and ``k1`` are 128 bits that name the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, met = _walker(width, min_tokens), set()
        for batch in batches:
            for part in _slices(batch, 2):
                at, grams, row = walk(part.column(2).to_pylist())
                if not len(at):
                    continue
                grams, row = _sets(grams, row)
                n = np.bincount(row, minlength=len(at))
                often = common.value[_slots(grams, bits)]
                have, need = np.bincount(row[often > 0], minlength=len(at)), _need(n, threshold)
                on = np.flatnonzero(have >= need)
                if not len(on):
                    continue
                left = (have >= need)[row]
                at, n, have, need = at[on], n[on], have[on], need[on]
                grams, often, row = grams[left], often[left], np.repeat(np.arange(len(on)), n)
                ends = np.cumsum(n)
                sides = part.column(1).take(pa.array(at))
                keys, new = [], np.zeros(len(on), bool)
                if len(met) > 200_000:
                    met.clear()
                for i, (lo, hi, side) in enumerate(zip(ends - n, ends, sides.to_pylist())):
                    keys.append(xxhash.xxh3_128_digest(grams[lo:hi].tobytes()))
                    new[i] = (side, keys[-1]) not in met
                    met.add((side, keys[-1]))
                with np.errstate(over="ignore"):
                    place = ((grams.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(64 * VECTOR)
                bit = np.uint64(1) << (place & np.uint64(63))
                words = [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), ends - n).view(np.int64) for k in range(VECTOR)]
                there = (often > 0) & new[row]
                grams, often, row = grams[there], often[there], row[there]
                order = np.argsort(row << 8 | often, kind="stable")  # n-grams as common as each other stay in their order
                grams, row = grams[order], row[order]
                own = np.where(new, have, 0)
                rank = np.arange(len(row)) - (np.cumsum(own) - own)[row]
                length = np.minimum(own, have - need + np.where(n > PLAIN, 1 + need // PER_HIT, 1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(grams[rank < length[row]]))
                names = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), sides, pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(n, pa.int32()), *map(pa.array, words), lists],
                    names=["id", "side", "k0", "k1", "n", "b0", "b1", "b2", "grams"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "side", "text").mapInArrow(run, f"id {kind}, side string, k0 bigint, k1 bigint, n int, b0 bigint, b1 bigint, b2 bigint, grams array<bigint>")


def _id_slot(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("id"), 64 - bits).cast("int")


def whole_sets(rows: DataFrame, width: int, min_tokens: int, bits: int, marked: Any) -> DataFrame:
    """(id, h): the whole sets of the rows whose id's slot is set in the broadcast bits ``marked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walker(width, min_tokens)
        for batch in batches:
            slot = batch.column(1).to_numpy()
            asked = batch.filter(pa.array((marked.value[slot >> 3] >> (slot & 7)) & 1 == 1))
            for part in _slices(asked, 2) if asked.num_rows else ():
                at, grams, row = walk(part.column(2).to_pylist())
                if len(at):
                    grams, row = _sets(grams, row)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at)))])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams))], names=["id", "h"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", _id_slot(bits).alias("slot"), "text").mapInArrow(run, f"id {kind}, h array<bigint>")


def _met(sets: DataFrame, threshold: float, k: int, passes: int) -> DataFrame:
    """(e and t of NAME, hits): vectors and sizes of sets that may be at the threshold, by the ``k``-th of ``passes`` shares of n-grams."""
    sides = []
    for side, x in (("eval", "e"), ("train", "t")):
        one = sets.filter(F.col("side") == side).select(F.explode("grams").alias("gram"), *(F.col(c).alias(x + c) for c in NAME))
        sides.append(one.filter(F.pmod("gram", F.lit(passes)) == k) if passes > 1 else one)
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"e{c}").bitwiseXOR(F.col(f"t{c}"))) for c in NAME[:VECTOR]))
    most = F.lit((1 - threshold) / (1 + threshold)) * (F.col("en") + F.col("tn")) + 1e-6
    both = sides[0].join(sides[1], "gram").filter((F.least("en", "tn") >= F.lit(threshold) * F.greatest("en", "tn") - 1e-9) & (apart <= most))
    return both.groupBy(*(x + c for x in "et" for c in NAME)).agg(F.count(F.lit(1)).alias("hits"))


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(e and t of NAME): pairs of vectors and sizes that have hits enough."""
    names = [x + c for x in "et" for c in NAME]
    rows = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    passes = min(PASSES, 1 + rows // PASS_ROWS)
    parts = []
    for k in range(passes):
        parts.append(cut(_met(sets, threshold, k, passes)))
        if passes > 1:
            sweep(sets.sparkSession)
    hits = parts[0] if passes == 1 else reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.sum("hits").alias("hits"))
    fewer = F.least("en", "tn")
    least = F.when(fewer > PLAIN, 1 + F.floor(F.ceil(fewer * threshold - 1e-9) / PER_HIT)).otherwise(1)
    out = cut(hits.filter(F.col("hits") >= least).select(*names))
    for part in parts:
        release(part)
    return out


def text_overlaps(papers: DataFrame, threshold: float = 0.7, width: int = 3, min_tokens: int = 20) -> DataFrame:
    """(eval_id, train_id, containment, similarity) of (id, side, text); side is 'eval' or 'train'. ``papers`` is read several times."""
    sc = papers.sparkSession.sparkContext
    ev, tr = papers.filter("side = 'eval'"), papers.filter("side = 'train'")
    letters = ev.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(letters / 6 + 2)) + 1))
    asked = sc.broadcast(counters(ev, width, min_tokens, bits))
    common = sc.broadcast(counters(tr, width, min_tokens, bits, asked))
    sets = cut(rare_grams(papers.filter("side in ('eval', 'train')"), width, min_tokens, bits, common, threshold))
    sweep(papers.sparkSession)

    def classes(side: str, x: str) -> DataFrame:
        one = sets.filter(F.col("side") == side).groupBy("k0", "k1", *NAME).agg(F.min("id").alias("id"))
        return one.toDF(*(x + c for c in one.columns))

    pairs = _candidates(sets, threshold)
    met = pairs.join(classes("eval", "e"), [f"e{c}" for c in NAME]).join(classes("train", "t"), [f"t{c}" for c in NAME])
    met = cut(met.filter((F.col("ek0") != F.col("tk0")) | (F.col("ek1") != F.col("tk1"))).select("ek0", "ek1", "eid", "tk0", "tk1", "tid"))
    sweep(papers.sparkSession)
    few = min(26, max(MIN_BITS, math.ceil(math.log2(met.count() * 64 + 2))))
    slots = met.select(F.col("eid").alias("id")).unionByName(met.select(F.col("tid").alias("id"))).select(_id_slot(few).alias("slot")).distinct().toArrow()  # at most 2**26
    flags = np.zeros(1 << few, bool)
    flags[slots["slot"].to_numpy()] = True
    marked = sc.broadcast(np.packbits(flags, bitorder="little"))
    both, ne, nt = F.size(F.array_intersect("he", "ht")), F.size("he"), F.size("ht")
    measured = cut(
        met.join(whole_sets(ev, width, min_tokens, few, marked).toDF("eid", "he"), "eid").join(whole_sets(tr, width, min_tokens, few, marked).toDF("tid", "ht"), "tid")
        .select("ek0", "ek1", "tk0", "tk1", ne.alias("ne"), nt.alias("nt"), both.alias("both"))
        .select("ek0", "ek1", "tk0", "tk1", (F.col("both") / F.col("ne")).alias("containment"), (F.col("both") / (F.col("ne") + F.col("nt") - F.col("both"))).alias("similarity"))
        .filter(F.col("similarity") >= threshold - 1e-9)
    )
    sweep(papers.sparkSession)
    e, t = (sets.filter(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), F.col("k0").alias(f"{x}k0"), F.col("k1").alias(f"{x}k1")) for side, x in (("eval", "e"), ("train", "t")))
    near = measured.join(e, ["ek0", "ek1"]).join(t, ["tk0", "tk1"]).select("eval_id", "train_id", "containment", "similarity")
    same = e.join(t, (F.col("ek0") == F.col("tk0")) & (F.col("ek1") == F.col("tk1"))).select("eval_id", "train_id", F.lit(1.0).alias("containment"), F.lit(1.0).alias("similarity"))
    return near.unionByName(same)


def latest(papers: DataFrame, eval_splits: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(id, side, split, source, number, text): the last loaded row of every paper of either side.

    Only rows of ids that occur again are shuffled with their texts, as long as there are few such ids.
    """
    source = trimmed(F.col("source")) if "source" in papers.columns else F.lit(None).cast("string")
    split = split_name(F.col("split"))
    known = papers.filter(F.col("paper_id").isNotNull()).select("paper_id", "pmid", split.alias("split"), source.alias("source"), "abstract", F.struct("loaded_at", F.xxhash64("pmid", "split", "abstract")).alias("order"))
    again = cut(known.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("paper_id"))

    def newest(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("paper_id").agg(F.max_by(F.struct("pmid", "split", "source", "abstract"), "order").alias("r")).select("paper_id", "r.*"))

    if again.count() > LISTED:
        last = newest(known)
        sweep(papers.sparkSession)
    else:
        listed = F.broadcast(again)
        last = known.join(listed, "paper_id", "left_anti").drop("order").unionByName(newest(known.join(listed, "paper_id", "left_semi")))
    side = F.when(F.col("split") == "train", "train").when(F.col("split").isin(*eval_splits), "eval")
    return last.select(F.col("paper_id").alias("id"), side.alias("side"), "split", "source", registry_number(F.col("pmid")).alias("number"), F.col("abstract").alias("text")).filter(F.col("side").isNotNull())


def overlaps(papers: DataFrame, threshold: float = 0.7, width: int = 3, min_tokens: int = 20, eval_splits: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(eval_id, train_id, same_number, containment, similarity): all overlaps of (paper_id, pmid, split, abstract)."""
    return overlaps_of(latest(papers, eval_splits), threshold, width, min_tokens)


def overlaps_of(rows: DataFrame, threshold: float = 0.7, width: int = 3, min_tokens: int = 20) -> DataFrame:
    """``overlaps`` of the frame that ``latest`` gives."""
    near = text_overlaps(rows, threshold, width, min_tokens)
    numbered = rows.filter(F.col("number").isNotNull())
    e = numbered.filter("side = 'eval'").select(F.col("id").alias("eval_id"), "number")
    t = numbered.filter("side = 'train'").select(F.col("id").alias("train_id"), "number")
    same = e.join(t, "number").select("eval_id", "train_id", F.lit(True).alias("same_number"), F.lit(None).cast("double").alias("containment"), F.lit(None).cast("double").alias("similarity"))
    both = same.unionByName(near.withColumn("same_number", F.lit(False)))
    return both.groupBy("eval_id", "train_id").agg(F.max("same_number").alias("same_number"), F.max("containment").alias("containment"), F.max("similarity").alias("similarity"))


def overlap_report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(split, source, n_papers, n_overlapping): evaluation papers of ``latest`` and those with an overlap, by split and source."""
    who = rows.filter("side = 'eval'").select(F.col("id").alias("paper_id"), "split", F.coalesce("source", F.lit("unknown")).alias("source"))
    hit = found.select(F.col("eval_id").alias("paper_id")).distinct().withColumn("hit", F.lit(1))
    return who.join(hit, "paper_id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_papers"), F.count("hit").alias("n_overlapping"))
