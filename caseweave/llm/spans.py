"""Spans of at least ``length`` code points that appear verbatim in more than one document.

1. Texts that are equal are one class; one text of each class goes on.
2. Reference index. Of each text the anchors are found: windows of ``length // 2`` code points whose hash is least among
   ``length - length // 2 + 1`` neighbouring ones. Any span of ``length`` code points, wherever it stands, selects the
   same anchor, so two texts with a common span share an anchor. Anchors of one text only are dropped; around every
   other one the text gives a reference block, the anchor with ``length - length // 2`` code points on either side.
3. Relative parsing. A text is factored against all reference blocks of its anchors at once: a factor begins at the first
   position whose window of ``length`` code points occurs in a block of another text and goes on greedily as long as the
   next window occurs too. Since the surroundings of neighbouring anchors overlap, a span across the border of a block
   lies whole in another one; factors that touch or overlap are joined per text. Factors are compared code point by
   code point with the block they come from.

Work grows with the number of blocks, not of pairs of texts; pairs are made only where they are asked for (``pairs``).
Blocks are brought together by anchor. An anchor with more than ``HOT`` blocks is not parsed in one task: its windows
become rows of their own and are grouped by their 128-bit hash, with partial aggregates, to the same result. Texts whose
shared windows there are the same set are paired as a group, so a common passage costs its pairs and no more.

Which texts are read again for their blocks is known by broadcast of their ids and anchors where these are few (checked),
else by a join on the id.

Defined cases: null, empty and shorter texts share nothing; offsets and lengths count code points of the text as stored;
repeated rows of a document count once; two documents with equal text share all of it; two rows of an id with different
texts count for the id together; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseweave.functions.windows import TOP, sliding, window_hashes
from caseweave.session import cut

MIN_SPAN = 300
#: Pairs of text and anchor that may be broadcast, 32 bytes each.
MAX_BROADCAST_ANCHORS = 1_000_000
#: Blocks of one anchor that are parsed in one task, and rows brought together before parsing.
HOT, AT_ONCE = 4096, 4096
CHUNK_CHARS = 1 << 20
_MIX = 0x9E3779B97F4A7C15


def anchors(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position in it, hash) of the anchors of ``texts``, all at least ``length`` code points long."""
    gram = length // 2
    span = length - gram + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = window_hashes(codes, gram)
    which = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    inside = np.arange(len(h)) + gram <= ends[which]
    # a run of windows counts only if all lie within one text; runs across a border get the top value and select nothing
    least = sliding(np.where(inside, h, TOP), span, np.minimum)
    last = np.arange(len(least)) + span - 1
    whole = (which[: len(least)] == which[last]) & inside[last]
    least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), span, np.maximum)
    chosen = np.flatnonzero((most == h) & inside)
    return which[chosen], chosen - (ends - sizes)[which[chosen]], h[chosen]


def blocks_of(text: str, wanted: np.ndarray, length: int) -> Iterator[tuple[int, str, int, list[int]]]:
    """(anchor, block, anchor's place in the block, places of the block in the text) for the wanted anchors; equal blocks of a text once."""
    side = length - length // 2
    _, at, h = anchors([text], length)
    keep = np.isin(h, wanted)
    found: dict[tuple[int, str, int], list[int]] = {}
    for p, anchor in zip(at[keep].tolist(), h[keep].view(np.int64).tolist()):
        begin = max(0, p - side)
        found.setdefault((anchor, text[begin : p + length], p - begin), []).append(begin)
    for (anchor, block, p), begins in found.items():
        yield anchor, block, p, begins


class Parsed:
    """The blocks of some anchors, factored against each other.

    ``factors``: (block, start in the block, size), the stretches of a block made of windows that a block of the same
    anchor from another text (``owner``) has too. ``pairs``: arrays of owners that share a window.
    """

    def __init__(self, anchor: np.ndarray, owner: np.ndarray, blocks: list[str], length: int):
        sizes = np.array([len(t) for t in blocks], np.int64)
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        h = window_hashes(codes, length)
        which = np.repeat(np.arange(len(blocks)), sizes)[: len(h)]
        at = np.flatnonzero(np.arange(len(h)) + length <= ends[which])
        with np.errstate(over="ignore"):
            key = h[at] ^ (anchor[which[at]].view(np.uint64) * np.uint64(_MIX))
        order = np.lexsort((at, owner[which[at]], key))
        self.at, self.key = at[order], key[order]
        self.owner = owner[which[self.at]]
        self._keep_shared()
        # compare each stretch with the block it comes from: the first of its windows' kind, for that one the last
        run = np.cumsum(self._first()) - 1
        heads = np.flatnonzero(self._first())
        tails = np.append(heads[1:], len(self.key)) - 1
        source = np.where(np.arange(len(run)) == heads[run], self.at[tails[run]], self.at[heads[run]]) if len(run) else run
        self.factors, good = [], np.ones(len(run), bool)
        by_place = np.argsort(self.at)
        place, source = self.at[by_place], source[by_place]
        for part in np.split(np.arange(len(place)), np.flatnonzero((np.diff(place) != 1) | (np.diff(source) != 1) | (np.diff(which[place]) != 0)) + 1):
            if len(part):
                a, b, size = place[part[0]], source[part[0]], len(part) + length - 1
                if np.array_equal(codes[a : a + size], codes[b : b + size]):
                    block = int(which[a])
                    self.factors.append((block, int(a - ends[block] + sizes[block]), size))
                else:
                    good[by_place[part]] = False
        if not good.all():
            self.at, self.key, self.owner = self.at[good], self.key[good], self.owner[good]
            self._keep_shared()

    def _first(self) -> np.ndarray:
        return np.append(True, self.key[1:] != self.key[:-1]) if len(self.key) else np.zeros(0, bool)

    def _keep_shared(self) -> None:
        """Drops windows that only one owner has; entries are in the order of window, then owner."""
        if len(self.key):
            heads = np.flatnonzero(self._first())
            tails = np.append(heads[1:], len(self.key)) - 1
            shared = np.repeat(self.owner[heads] != self.owner[tails], tails - heads + 1)
            self.at, self.key, self.owner = self.at[shared], self.key[shared], self.owner[shared]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Owners that share a window, each set of owners once however many windows it shares."""
        if not len(self.key):
            return
        new = self._first() | np.append(True, self.owner[1:] != self.owner[:-1])
        key, owner = self.key[new], self.owner[new]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        with np.errstate(over="ignore"):
            mark = owner.astype(np.uint64) * np.uint64(_MIX) + np.uint64(1)
            mark ^= mark >> np.uint64(31)
            mark *= np.uint64(0xD6E8FEB86659FD93)
            mark ^= mark >> np.uint64(32)
            sets = np.add.reduceat(mark, heads)
        sizes = np.diff(np.append(heads, len(key)))
        _, one = np.unique(np.stack([sets, sizes.astype(np.uint64)]), axis=1, return_index=True)
        for i in one.tolist():
            members = owner[heads[i] : heads[i] + sizes[i]]
            for k in range(len(members) - 1):
                yield np.full(len(members) - k - 1, members[k]), members[k + 1 :]


def _class_key(text: Column) -> list[Column]:
    digest = F.md5(F.encode(text, "utf-8"))
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "k0"), (17, "k1"))]


def _grouped(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    """The rows of a partition sorted by its first column in tables that hold every value of it whole."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        values = batch.column(0).to_numpy()
        if len(values) and held and rows >= at_once:
            cut_at = int(np.searchsorted(values, held[-1].column(0)[-1].as_py(), side="right"))
            if cut_at < len(values):
                yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
                held, rows, batch = [], 0, batch.slice(cut_at)
                values = values[cut_at:]
        while len(values) > at_once:
            cut_at = int(np.searchsorted(values, values[at_once], side="right"))
            if cut_at == len(values):
                break
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held, rows, batch = [], 0, batch.slice(cut_at)
            values = values[cut_at:]
        if len(values):
            held.append(batch)
            rows += len(values)
    if held:
        yield pa.Table.from_batches(held)


def _block_batch(batch: pa.RecordBatch, rows: list[int], out: list[tuple[int, str, int, list[int]]]) -> pa.RecordBatch:
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([o[0] for o in out], pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array([o[3] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out])],
        names=["h", "k0", "k1", "begins", "block"],
    )


def _pair_batch(names: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = names[np.concatenate([x for x, _ in held])], names[np.concatenate([y for _, y in held])]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in (a.f0, a.f1, b.f0, b.f1)], names=["a0", "a1", "b0", "b1"])


class SharedSpans:
    """pairs: (doc_id_a, doc_id_b); shares: (doc_id, n_chars, shared_chars, share) of documents that share anything."""

    def __init__(self, documents: DataFrame, length: int = MIN_SPAN):
        self.length = length
        self.rows = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= length))
        keyed = self.rows.select("id", *_class_key(F.col("text")), F.length("text").alias("n"))
        self.members = cut(keyed.distinct())
        self.blocks = cut(self._blocks(cut(self._anchors())))

    def _anchors(self) -> DataFrame:
        """(h, k0, k1, id): anchors that more than one class has, with one document of each class."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(3).to_pylist()
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_CHARS):
                        size += len(texts[end])
                        end += 1
                    which, _, h = anchors(texts[at:end], length)
                    # once per text
                    once = np.unique(np.rec.fromarrays([which, h])) if len(h) else None
                    if once is not None:
                        rows = pa.array(once.f0 + at)
                        yield pa.RecordBatch.from_arrays([pa.array(once.f1.view(np.int64)), *(batch.column(i).take(rows) for i in range(3))], names=["h", "k0", "k1", "id"])
                    at = end

        kind = self.rows.schema["id"].dataType.simpleString()
        made = self.rows.select(*_class_key(F.col("text")), "id", "text").mapInArrow(run, f"h bigint, k0 bigint, k1 bigint, id {kind}")
        one = made.repartition("h").groupBy("h", "k0", "k1").agg(F.min("id").alias("id"))
        # the id is kept here too, so that both uses of the anchors have one exchange
        several = one.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1 AND least IS NOT NULL").select("h")
        return one.join(several.hint("shuffle_hash"), "h", "left_semi").select("h", "k0", "k1", "id")

    def _blocks(self, found: DataFrame) -> DataFrame:
        """(h, k0, k1, begins, block): the reference blocks of the anchors found, with their places in the text."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, out = [], []
                for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                    made = list(blocks_of(text, wanted.values.to_numpy().view(np.uint64), length))
                    rows += [i] * len(made)
                    out += made
                    if len(out) > 10_000:
                        yield _block_batch(batch, rows, out)
                        rows, out = [], []
                if out:
                    yield _block_batch(batch, rows, out)

        per = found.groupBy("id", "k0", "k1").agg(F.collect_list("h").alias("hs"))
        few = found.count() <= MAX_BROADCAST_ANCHORS
        texts = self.rows.select("id", *_class_key(F.col("text")), "text").join(F.broadcast(per) if few else per, ["id", "k0", "k1"]).select("k0", "k1", "text", "hs")
        return texts.mapInArrow(run, "h bigint, k0 bigint, k1 bigint, begins array<bigint>, block string")

    def _hot(self) -> tuple[DataFrame, DataFrame | None]:
        """(blocks of ordinary anchors, those of anchors with more than ``HOT`` blocks or None)."""
        hot = cut(self.blocks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("h"))
        if hot.isEmpty():
            return self.blocks, None
        return self.blocks.join(hot, "h", "left_anti"), self.blocks.join(hot, "h", "left_semi")

    def _parse(self, blocks: DataFrame, layout: str, give: Callable[[Any, Parsed], Iterator[pa.RecordBatch]]) -> DataFrame:
        length, at_once = self.length, AT_ONCE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _grouped(batches, at_once):
                t = t.combine_chunks()
                owners = np.rec.fromarrays([t["k0"].to_numpy(), t["k1"].to_numpy()])
                names, owner = np.unique(owners, return_inverse=True)
                yield from give((t, names), Parsed(t["h"].to_numpy(), owner, t["block"].to_pylist(), length))

        return blocks.repartition("h").sortWithinPartitions("h").mapInArrow(run, layout)

    def _windows(self, blocks: DataFrame) -> DataFrame:
        """(w0, w1, h, k0, k1, begins): every window of the blocks that blocks of several classes have, by 128-bit hash."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    rows, starts, marks = [], [], []
                    for i, block in enumerate(part.column(4).to_pylist()):
                        raw = block.encode("utf-32-le", "surrogatepass")
                        for k in range(len(block) - length + 1):
                            rows.append(i)
                            starts.append(k)
                            marks.append(xxhash.xxh3_128_digest(raw[4 * k : 4 * (k + length)]))
                    if rows:
                        w, take = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2), pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), *(part.column(i).take(take) for i in range(4)), pa.array(starts, pa.int64())], names=["w0", "w1", "h", "k0", "k1", "begins", "start"])

        made = cut(blocks.mapInArrow(run, "w0 bigint, w1 bigint, h bigint, k0 bigint, k1 bigint, begins array<bigint>, start bigint"))
        ends = made.groupBy("w0", "w1").agg(F.min(F.struct("k0", "k1")).alias("least"), F.max(F.struct("k0", "k1")).alias("most")).filter("least <> most").select("w0", "w1")
        return made.join(ends, ["w0", "w1"], "left_semi")

    def pairs(self) -> DataFrame:
        def give(t: Any, parsed: Parsed) -> Iterator[pa.RecordBatch]:
            names, held, n = t[1], [], 0
            for x, y in parsed.pairs():
                held.append((x, y))
                n += len(x)
                if n > 50_000:
                    yield _pair_batch(names, held)
                    held, n = [], 0
            if held:
                yield _pair_batch(names, held)

        usual, hot = self._hot()
        across = self._parse(usual, "a0 bigint, a1 bigint, b0 bigint, b1 bigint", give)
        if hot is not None:
            across = across.unionByName(self._hot_pairs(hot))
        across = cut(across.distinct())
        who = self.members.select("id", "k0", "k1")
        x, y = who.toDF("x", "a0", "a1"), who.toDF("y", "b0", "b1")
        spread = across.join(x, ["a0", "a1"]).join(y, ["b0", "b1"]).filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        same = who.toDF("doc_id_a", "k0", "k1").join(who.toDF("doc_id_b", "k0", "k1"), ["k0", "k1"]).filter(F.col("doc_id_a") < F.col("doc_id_b")).select("doc_id_a", "doc_id_b")
        return spread.unionByName(same).distinct()

    def _hot_pairs(self, hot: DataFrame) -> DataFrame:
        """(a0, a1, b0, b1): texts with the same set of shared windows as a group, and groups that have a window in common."""
        shared = self._windows(hot)
        sets = shared.groupBy("h", "k0", "k1").agg(F.array_sort(F.collect_set(F.struct("w0", "w1"))).alias("ws"))
        sets = cut(sets.withColumn("mark", F.md5(F.to_json("ws"))))
        members = sets.select("mark", "k0", "k1").distinct()
        groups = sets.groupBy("mark").agg(F.first("ws").alias("ws")).select("mark", F.explode("ws").alias("w"))
        met = groups.join(groups.withColumnRenamed("mark", "other"), "w").filter("mark <= other").select("mark", "other").distinct()
        a, b = members.toDF("mark", "a0", "a1"), members.toDF("other", "b0", "b1")
        return met.join(a, "mark").join(b, "other").filter("a0 <> b0 OR a1 <> b1").select(
            *[F.when(F.struct("a0", "a1") < F.struct("b0", "b1"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("a0", "b0"), ("a1", "b1"), ("b0", "a0"), ("b1", "a1"))]
        )

    def shares(self) -> DataFrame:
        def give(t: Any, parsed: Parsed) -> Iterator[pa.RecordBatch]:
            table = t[0]
            for at in range(0, len(parsed.factors), 10_000):
                block, start, size = zip(*parsed.factors[at : at + 10_000])
                take = pa.array(block)
                yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(take) for c in ("k0", "k1", "begins")), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names=["k0", "k1", "begins", "start", "size"])

        usual, hot = self._hot()
        found = self._parse(usual, "k0 bigint, k1 bigint, begins array<bigint>, start bigint, size bigint", give)
        if hot is not None:
            found = found.unionByName(self._windows(hot).select("k0", "k1", "begins", "start", F.lit(self.length).cast("long").alias("size")))
        factors = found.select("k0", "k1", F.explode("begins").alias("begin"), "start", "size").select("k0", "k1", (F.col("begin") + F.col("start")).alias("start"), "size").distinct()
        # joined where they touch: what a factor adds beyond all that begin before it
        order = W.partitionBy("k0", "k1").orderBy("start", "size")
        until = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1))
        fresh = factors.select("k0", "k1", F.greatest(F.col("start") + F.col("size") - F.greatest("start", F.coalesce(until, F.lit(0))), F.lit(0)).alias("new"))
        part = fresh.groupBy("k0", "k1").agg(F.sum("new").alias("shared"))
        copies = self.members.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("copies"))
        per = self.members.join(copies, ["k0", "k1"]).join(part, ["k0", "k1"], "left")
        shared = F.when(F.col("copies") > 1, F.col("n").cast("long")).otherwise(F.coalesce("shared", F.lit(0)))
        return per.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), shared.alias("shared_chars")).filter("shared_chars > 0").withColumn("share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
