"""Mixing sources to target weights, by size in tokens.

The mixture is as large as the targets and repeat caps allow: with shares w and capped supplies cap * tokens, the total
is the least cap * tokens / w over the sources that have text. A source then gives whole passes over its documents and
one part pass, no document more often than the cap.

A source's documents fall into blocks of about ``block_tokens`` tokens by a hash of their id, however many blocks that
takes. In every pass a keyed permutation gives each block its place among the source's draws, so no list of draws exists
anywhere; the driver keeps a few numbers per source. The part pass ends within the block in which the source's quota is
reached: which one that is, is found by sums over ever finer ranges of places, one number per source and range. That
block is cut at the document that brings the source nearest to its quota.

A splitting tree divides the draws among the output shards: at every node the left half of the shards gets its part of
the draws, split over sources by a multivariate hypergeometric draw, down to single shards, which so take disjoint runs
of the permuted blocks of every source. A node's draw depends on the seed and the node alone, so each task walks the
tree for its own documents and only through the nodes they pass. Within a shard documents are put in random order.

Defined cases: source names are trimmed and lower-cased; documents of unlisted or null sources and documents without
tokens take no part; a listed source without documents reaches share 0 and the others keep their proportions; null or
negative shares are 0, a null cap is 1, a cap below 1 excludes the source; repeated rows of a document count once; with
nothing to mix the result is empty. The result depends on the seed alone, not on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseweave.functions.ids import trimmed
from caseweave.llm.tokenise import VOCABULARY, token_counts
from caseweave.session import cut

MAX_SOURCES = 10_000
BLOCK_TOKENS, SHARD_TOKENS = 20_000, 4_000_000
#: Ranges of places a search for the end of a part pass splits a range into.
FAN_OUT = 64
#: Above this many draws at a node numpy draws no hypergeometric numbers; the normal law has the same mean and variance.
EXACT_DRAWS = 900_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def clean_source(name: str):  # noqa: ANN201
    return F.nullif(F.lower(trimmed(F.col(name))), F.lit(""))


@dataclass
class Source:
    """Figures of a source: ``passes`` whole ones, then places below ``end`` of a part pass, the block at ``end`` up to ``rest`` tokens."""

    share: float
    cap: int
    tokens: int = 0
    n_blocks: int = 1
    quota: float = 0.0
    passes: int = 0
    end: int = 0
    rest: float = 0.0

    @property
    def draws(self) -> int:
        return self.passes * self.n_blocks + self.end + (self.rest > 0)


def read_targets(targets: DataFrame) -> dict[str, Source]:
    rows = targets.select(clean_source("source").alias("source"), "target_share", "max_repeat").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: Source(max(0.0, r["target_share"] or 0.0), 1 if r["max_repeat"] is None else int(r["max_repeat"])) for r in rows if r["source"] is not None}


def plan_quotas(sources: dict[str, Source]) -> float:
    """Fills in ``quota`` in tokens and ``passes``; the total."""
    able = {n: s for n, s in sources.items() if s.tokens > 0 and s.share > 0 and s.cap >= 1}
    weight = sum(s.share for s in able.values())
    if not able:
        return 0.0
    total = min(s.cap * s.tokens * weight / s.share for s in able.values())
    for s in able.values():
        s.quota = total * s.share / weight
        s.passes = min(s.cap, int(s.quota / s.tokens + 1e-12))
        s.rest = s.quota - s.passes * s.tokens if s.passes < s.cap else 0.0
        s.rest = s.rest if s.rest > 1e-6 else 0.0
    return total


def places(block: np.ndarray, copy: np.ndarray, source: np.ndarray, n_blocks: np.ndarray, seed: int) -> np.ndarray:
    """The place of every block in the permutation of its source and pass: a Feistel network over the next power of four, walked until it lands below the source's number of blocks."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n_blocks, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        key = _mixed(source.astype(np.uint64) * _M1 + copy.astype(np.uint64) * _M2 + np.uint64(seed % 2**63))
        x, todo = block.astype(np.uint64), np.arange(len(block))
        while len(todo):
            a, b, m, kk = x[todo] >> half[todo], x[todo] & low[todo], low[todo], key[todo]
            for turn in range(4):
                a, b = b, a ^ (_mixed(b + kk + np.uint64(turn) * _M2) & m)
            x[todo] = a << half[todo] | b
            todo = todo[x[todo] >= n_blocks[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def split_node(quotas: np.ndarray, n_left: int, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """The draws of every source that go to the left ``n_left`` of ``n_shards`` shards."""
    left_total, pool = int(round(int(quotas.sum()) * n_left / n_shards)), int(quotas.sum())
    left = np.zeros_like(quotas)
    for i, q in enumerate(quotas.tolist()):
        if pool == q:
            left[i] = left_total
        elif left_total and q:
            if pool <= EXACT_DRAWS:
                got = int(rng.hypergeometric(q, pool - q, left_total))
            else:
                mean = left_total * q / pool
                sd = math.sqrt(max(0.0, mean * (1 - q / pool) * (pool - left_total) / (pool - 1)))
                got = min(q, left_total, max(0, left_total - (pool - q), round(rng.normal(mean, sd))))
            left[i] = got
        pool -= q
        left_total -= int(left[i])
    return left


def shards_of(source: np.ndarray, draw: np.ndarray, quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """The shard of each draw (source, number of the draw within its source), walking only the nodes these draws pass."""
    out = np.zeros(len(draw), np.int64)
    todo = [(0, n_shards, quotas.astype(np.int64), np.arange(len(draw)), draw.astype(np.int64))]
    while todo:
        first, n, q, rows, at = todo.pop()
        if n == 1:
            out[rows] = first
            continue
        half = n // 2
        left = split_node(q, half, n, np.random.default_rng([seed, first, n]))
        goes_left = at < left[source[rows]]
        for chosen, f, m, qq, shift in ((goes_left, first, half, left, 0), (~goes_left, first + half, n - half, q - left, left)):
            if chosen.any():
                r = rows[chosen]
                todo.append((f, m, qq, r, at[chosen] - (shift[source[r]] if m != half or f != first else 0)))
    return out


def _drawn(placed: DataFrame, names: list[str], sources: dict[str, Source], seed: int) -> DataFrame:
    """(doc_id, source, copy, n_tokens, mark, place, draw): every pass of every document of ``placed`` with its block's place."""
    number = {n: i for i, n in enumerate(names)}
    blocks, passes = np.array([sources[n].n_blocks for n in names]), np.array([sources[n].passes for n in names])
    more = np.array([sources[n].rest > 0 for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src = np.array([number[n] for n in batch.column(1).to_pylist()], np.int64)
            times = passes[src] + more[src]
            row = np.repeat(np.arange(len(src)), times)
            copy = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            place = places(batch.column(4).to_numpy()[row], copy, src[row], blocks[src[row]], seed) if len(row) else row
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(4)), pa.array(copy, pa.int32()), pa.array(place, pa.int64()), pa.array(src[row], pa.int32())],
                names=["doc_id", "source", "n_tokens", "mark", "copy", "place", "src"],
            )

    kind = placed.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, source string, n_tokens bigint, mark bigint, copy int, place bigint, src int"
    return placed.select("doc_id", "source", "n_tokens", "mark", "block").mapInArrow(run, layout)


def end_of_passes(drawn: DataFrame, names: list[str], sources: dict[str, Source]) -> None:
    """Sets ``end`` and ``rest`` of every source with a part pass: the place where its quota is reached, and what is left of it there.

    Each round splits the range that holds the end into ``FAN_OUT`` and sums it; one row per source comes back.
    """
    spark = drawn.sparkSession
    open_ = {i: [0, sources[n].n_blocks, sources[n].rest] for i, n in enumerate(names) if sources[n].rest > 0}
    part = drawn.join(F.broadcast(spark.createDataFrame([(i, sources[n].passes) for i, n in enumerate(names)], "src int, last int")), "src").filter(F.col("copy") == F.col("last")).select("src", "place", "n_tokens")
    while any(hi - lo > 1 for lo, hi, _ in open_.values()):
        steps = spark.createDataFrame([(i, lo, hi, max(1, -(-(hi - lo) // FAN_OUT)), rest) for i, (lo, hi, rest) in open_.items() if hi - lo > 1], "src int, lo bigint, hi bigint, step bigint, rest double")
        inside = part.join(F.broadcast(steps), "src").filter("place >= lo AND place < hi")
        sums = inside.groupBy("src", "lo", "hi", "step", "rest", F.expr("(place - lo) div step").alias("range")).agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(W.partitionBy("src").orderBy("range"))  # at most FAN_OUT rows a source
        reached = sums.withColumn("upto", upto).filter("upto >= rest").groupBy("src").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("before"), "lo", "hi", "step"), "range").alias("r"))
        seen = {r["src"]: r["r"] for r in reached.collect()}
        for i, (lo, hi, rest) in list(open_.items()):
            if hi - lo > 1:
                r = seen.get(i)
                if r is None:  # the quota is all there is
                    open_[i] = [hi - 1, hi, math.inf]
                else:
                    begin = r["lo"] + r["range"] * r["step"]
                    open_[i] = [begin, min(hi, begin + r["step"]), rest - r["before"]]
    for i, (lo, _, rest) in open_.items():
        sources[names[i]].end, sources[names[i]].rest = lo, rest


def mix(
    documents: DataFrame, targets: DataFrame, n_shards: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY,
    block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """(shard, position, doc_id, source, copy, n_tokens): the mixture, a row for every copy of a document."""
    spark = documents.sparkSession
    sources = read_targets(targets)
    docs = documents.select("doc_id", clean_source("source").alias("source"), "text").filter(F.col("doc_id").isNotNull() & F.col("source").isin(*sources or [""]))
    sized = token_counts(docs, "doc_id", "text", "source", vocabulary=vocabulary).filter("n_tokens > 0")
    sized = cut(sized.groupBy("doc_id").agg(F.max_by("source", F.struct("n_tokens", "source")).alias("source"), F.max("n_tokens").alias("n_tokens")))
    for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():  # a row per listed source
        sources[r["source"]].tokens = r["n"]
    total = plan_quotas(sources)
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], f"shard int, position bigint, doc_id {kind}, source string, copy int, n_tokens bigint")
    names = sorted(n for n, s in sources.items() if s.quota > 0)
    for n in names:
        sources[n].n_blocks = max(1, math.ceil(sources[n].tokens / block_tokens))
    plan = spark.createDataFrame([(n, sources[n].n_blocks) for n in names], "source string, n_blocks bigint")
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = sized.join(F.broadcast(plan), "source").select("doc_id", "source", "n_tokens", mark.alias("mark"), F.pmod(F.shiftrightunsigned(mark, 8), F.col("n_blocks")).alias("block"))
    drawn = cut(_drawn(placed, names, sources, seed))
    end_of_passes(drawn, names, sources)
    quotas = np.array([sources[n].draws for n in names], dtype=np.int64)
    shards = max(1, min(n_shards or math.ceil(total / shard_tokens), int(quotas.sum())))
    per = np.array([sources[n].n_blocks for n in names], dtype=np.int64)
    figures = spark.createDataFrame([(i, sources[n].passes, sources[n].end, float(sources[n].rest)) for i, n in enumerate(names)], "src int, passes int, last bigint, rest double")
    known = drawn.join(F.broadcast(figures), "src").filter("copy < passes OR place <= last")
    cut_off = (F.col("copy") == F.col("passes")) & (F.col("place") == F.col("last"))
    # one block a source is cut
    before = F.sum("n_tokens").over(W.partitionBy("src").orderBy("mark", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    part = known.filter(cut_off).withColumn("_upto", before).filter(F.col("_upto") - F.col("n_tokens") / 2 <= F.col("rest")).drop("_upto")
    chosen = known.filter(~cut_off).unionByName(part).select("doc_id", "source", "n_tokens", "copy", "place", "src")

    def place_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src = batch.column(5).to_numpy().astype(np.int64)
            draw = batch.column(3).to_numpy().astype(np.int64) * per[src] + batch.column(4).to_numpy()
            shard = shards_of(src, draw, quotas, shards, seed)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns[:4]], names=["shard", "doc_id", "source", "n_tokens", "copy"])

    sharded = chosen.mapInArrow(place_in_shards, f"shard int, doc_id {kind}, source string, n_tokens bigint, copy int")
    order = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("copy")), "doc_id", "copy"))
    return sharded.select("shard", (order - 1).cast("bigint").alias("position"), "doc_id", "source", "copy", "n_tokens")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeat, n_documents, n_copies, n_tokens, actual_share, most_repeats), a row per listed source."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    per = per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_copies"), F.sum("t").alias("n_tokens"), F.max("n").alias("most_repeats"))
    want = targets.select(clean_source("source").alias("source"), "target_share", "max_repeat").filter(F.col("source").isNotNull()).distinct()
    zero = F.lit(0).cast("long")
    out = want.join(per, "source", "left").select("source", "target_share", "max_repeat", *[F.coalesce(c, zero).alias(c) for c in ("n_documents", "n_copies", "n_tokens", "most_repeats")])
    return out.withColumn("actual_share", F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(W.partitionBy())), F.lit(0.0)))
