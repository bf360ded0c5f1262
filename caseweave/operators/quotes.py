"""Where quotes stand in the texts of their paper.

A paper may hold any part of all texts and of all quotes, so its texts are not searched for each of its quotes. Of every
text all hashes of ``GRAM`` code points are taken that are least among ``SPAN`` neighbours; those of a quote are among
those of a text it stands in. Of each quote the one serves as anchor that the fewest quotes of its paper have, by a table
of ``2**SLOT_BITS`` one-byte counters (quotes made of the same phrases differ in the rest). Anchors are salted with the
paper, joined by hash, and only pairs that so meet are compared. Quotes too short for that are found by the hash of their
whole, among the text's runs of the same length. A text sends only hashes that some quote may have, by a table of
``2**SLOT_BITS`` marks; quotes whose anchor no text sent are left out, and texts are fetched again for the pairs found.

Defined cases: a quote is looked for stripped and, failing that, with its white space squeezed; null and blank quotes,
null texts and rows without a paper find nothing; repeated rows count once; the first place in a text is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.functions.text import squeezed
from caseweave.functions.windows import code_points, least_of_neighbours, window_hashes
from caseweave.session import cut

GRAM, SPAN, SLOT_BITS = 16, 16, 24
#: Hashes sent by texts that may be broadcast, 8 bytes each; with more the join of quotes and texts does it all.
MAX_SENT = 2_000_000
SHORT = GRAM + SPAN - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _salted(h: np.ndarray, salt: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h ^ np.uint64(salt % 2**64)) * _ODD + np.uint64(size)
        z ^= z >> np.uint64(31)
        return z * _ODD


def _slot(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SLOT_BITS)


def _hashes(needle: str, salt: int) -> np.ndarray:
    codes = code_points(needle)
    if len(codes) >= SHORT:
        return _salted(least_of_neighbours(window_hashes(codes, GRAM), SPAN), salt, 0)
    return _salted(window_hashes(codes, len(codes)), salt, len(codes))


def usage(needles: DataFrame) -> np.ndarray:
    """One byte per slot: 0 where no needle (salt, needle) has a hash, else 1 + log2 of how many have; added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for salt, needle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine[_slot(_hashes(needle, salt))] += 1
        used = np.flatnonzero(mine)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(mine[part], pa.int64())], names=["slot", "n"])

    level = (F.floor(F.log2(F.sum("n").cast("double"))) + 1).cast("byte")
    found = needles.select("salt", "needle").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(level.alias("n")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def anchored(needles: DataFrame) -> DataFrame:
    """(needle columns, anchor) of (.., salt, needle): the hash of each needle that the fewest have."""
    cols = needles.columns
    shared = needles.sparkSession.sparkContext.broadcast(usage(needles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for i, (salt, needle) in enumerate(zip(batch.column(cols.index("salt")).to_pylist(), batch.column(cols.index("needle")).to_pylist())):
                h = _hashes(needle, salt)
                out[i] = h[np.argmin(shared.value[_slot(h)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*cols, "anchor"])

    kinds = ", ".join(f"`{c}` {needles.schema[c].dataType.simpleString()}" for c in cols)
    return needles.mapInArrow(run, f"{kinds}, anchor bigint")


def locate_quotes(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, quote, at) of (doc_id, key, text) and (key, quote) with the same ``key``."""
    spark = docs.sparkSession
    given = quotes.filter("key IS NOT NULL").select("key", "quote", F.regexp_replace("quote", r"^\s+|\s+$", "").alias("q")).filter("q <> ''")
    salt = F.xxhash64(F.col("key").cast("string")).alias("salt")
    forms = F.filter(F.array(F.struct(F.lit(0).alias("form"), F.col("q").alias("needle")), F.when(squeezed(F.col("q")) != F.col("q"), F.struct(F.lit(1).alias("form"), squeezed(F.col("q")).alias("needle")))), lambda x: x.isNotNull())
    needles = given.select("key", salt, "quote", F.explode(forms).alias("f")).select("key", "salt", "quote", "f.form", "f.needle")
    needles = cut(anchored(cut(needles)))
    lengths = sorted(r[0] for r in needles.select(F.length("needle").alias("n")).filter(F.col("n") < SHORT).distinct().collect())  # fewer than SHORT numbers
    marked = np.zeros(1 << SLOT_BITS, bool)
    marked[needles.select(F.shiftrightunsigned("anchor", 64 - SLOT_BITS).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            rows, out = [], []
            for i, (salt, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                codes = code_points(text)
                kinds = [_salted(least_of_neighbours(window_hashes(codes, GRAM), SPAN), salt, 0)]
                kinds += [_salted(np.unique(window_hashes(codes, n)), salt, n) for n in lengths]
                h = np.concatenate(kinds)
                h = h[table[_slot(h)]]
                rows.append(np.full(len(h), i))
                out.append(h)
            take = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            hashes = np.concatenate(out) if out else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array(hashes.view(np.int64))], names=["doc_id", "key", "mark", "anchor"])

    texts = docs.filter("key IS NOT NULL AND text <> ''").select("doc_id", "key", F.xxhash64("text").alias("mark"), salt, "text")
    kind = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "key")}
    hits = cut(texts.mapInArrow(run, f"doc_id {kind['doc_id']}, key {kind['key']}, mark bigint, anchor bigint"))
    sent = hits.select("anchor").distinct()
    if hits.count() <= MAX_SENT:
        needles = needles.join(F.broadcast(sent), "anchor", "left_semi")
    met = cut(hits.join(needles, ["key", "anchor"]).select("doc_id", "key", "mark", "quote", "form", "needle").distinct())
    found = met.join(texts.select("doc_id", "key", "mark", "text"), ["doc_id", "key", "mark"]).withColumn("at", F.instr("text", F.col("needle")) - 1).filter("at >= 0")
    per = found.groupBy("doc_id", "key", "mark", "quote").agg(F.min_by("at", "form").cast("long").alias("at"))
    return per.select("doc_id", "quote", "at").distinct()
