"""All pairs of set-valued records whose sets overlap above a threshold.

Every set becomes a binary code: bit i says whether the i-th minhash of the set is odd. Two sets of Jaccard similarity J
agree on a bit with probability (1 + J) / 2, so the Hamming distance of their codes tells J.

* The code is cut into segments of ``seg_bits`` bits, the keys of an equi-join. Two codes that differ in fewer bits than
  there are segments agree on one of them by the pigeonhole principle; beyond that distance the number of segments is
  calibrated so that a pair at the threshold agrees on at least one with probability ``recall``.
* A joined pair goes on only if the Hamming distance of the first ``CHECK_BITS`` bits of the same codes lies within the
  radius which a pair at the threshold keeps with probability ``recall``.

What remains is verified on the sets themselves, so a returned pair is always right; ``recall`` (0.999999 unless
told otherwise, for a pair exactly at the threshold, more above it) bounds what is missed. Unless given, the width of a
segment follows from the number of sets: wide enough that two unrelated sets in one segment are rare at any size.

Equal sets are one class with one representative; only representatives are sketched and joined. Results are exact on:

* null sets, null members: a null set is empty, null members are ignored; sets below ``min_size`` take no part;
* repeated rows of an id and repeated members count once; two rows of an id with different sets are merged;
* empty tables: no pairs. Columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.session import cut

CHECK_BITS = 256
MIN_SEG_BITS, MAX_SEG_BITS = 16, 32
SEED = 20260101


def binomial_radius(bits: int, p: float, recall: float) -> int:
    """Least r with P(Binomial(bits, p) <= r) >= recall."""
    total = 0.0
    for r in range(bits + 1):
        total += math.exp(
            math.lgamma(bits + 1) - math.lgamma(r + 1) - math.lgamma(bits - r + 1)
            + (r * math.log(p) if r else 0.0) + ((bits - r) * math.log1p(-p) if bits > r else 0.0)
        )
        if total >= recall:
            return r
    return bits


def segment_width(n_sets: int) -> int:
    """Bits of a segment: a random one of ``n_sets`` codes agrees with a given one less than once a segment."""
    return min(MAX_SEG_BITS, max(MIN_SEG_BITS, math.ceil(math.log2(max(1, n_sets)))))


def calibrate(threshold: float, seg_bits: int, recall: float) -> tuple[int, int, int]:
    """(number of segments, bits checked, Hamming radius of those) for pairs at ``threshold``."""
    if threshold >= 1:
        return 1, seg_bits, 0
    agree = ((1 + threshold) / 2) ** seg_bits
    n_segments = math.ceil(math.log1p(-recall) / math.log1p(-agree))
    checked = min(CHECK_BITS, n_segments * seg_bits)
    return n_segments, checked, binomial_radius(checked, (1 - threshold) / 2, recall)


def one_bit_minhashes(flat: np.ndarray, starts: np.ndarray, n_bits: int) -> np.ndarray:
    """A row of ``n_bits`` bits for every non-empty run of 64-bit member hashes that begins at one of ``starts``."""
    flat = flat.view(np.uint64)
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 2**63, n_bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n_bits, dtype=np.uint64)
    out = np.empty((len(starts), n_bits), dtype=bool)
    with np.errstate(over="ignore"):
        for i in range(n_bits):
            z = flat * odd[i] + add[i]
            z ^= z >> np.uint64(32)
            z *= np.uint64(0xD6E8FEB86659FD93)
            least = np.minimum.reduceat(z, starts)
            out[:, i] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return out


def sketches(sets: DataFrame, n_segments: int, seg_bits: int, checked: int) -> DataFrame:
    """(key, n, segs, c0..c3) of (key, members): the segments of the code, each with its number in the high bits, and the code's first bits."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(seg_bits)).astype(np.int64)
        number = np.arange(n_segments, dtype=np.int64) << seg_bits
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(2)
                offsets = lists.offsets.to_numpy()
                bits = one_bit_minhashes(lists.flatten().to_numpy(), offsets[:-1] - offsets[0], n_segments * seg_bits)
                segs = bits.reshape(part.num_rows, n_segments, seg_bits) @ weights + number
                head = np.zeros((part.num_rows, CHECK_BITS), bool)
                head[:, :checked] = bits[:, :checked]
                code = np.packbits(head, axis=1).view(np.int64)
                ends = pa.array(np.arange(part.num_rows + 1) * n_segments, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(segs.ravel())), *(pa.array(np.ascontiguousarray(code[:, i])) for i in range(4))], names=["key", "n", "segs", "c0", "c1", "c2", "c3"]
                )

    hashed = sets.select("key", F.size("members").alias("n"), F.transform("members", lambda m: F.xxhash64(m)).alias("hashes"))
    kind = sets.schema["key"].dataType.simpleString()
    return hashed.mapInArrow(sketch, f"key {kind}, n int, segs array<bigint>, c0 bigint, c1 bigint, c2 bigint, c3 bigint")


def set_classes(df: DataFrame, id_col: str, set_col: str, min_size: int) -> DataFrame:
    """(id, key, members): every id with its set; ``key`` is the least id that has the same set."""
    clean = F.filter(F.coalesce(F.col(set_col), F.array().cast(df.schema[set_col].dataType)), lambda m: m.isNotNull())
    one = (
        df.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), clean.alias("s"))
        .groupBy("id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("members"))
        .filter(F.size("members") >= max(1, min_size))
        .withColumn("mark", F.md5(F.to_json(F.struct("members"))))
    )
    one = cut(one)
    keys = one.groupBy("mark").agg(F.min("id").alias("key"))
    return cut(one.join(keys, "mark").select("id", "key", "members"))


def class_pairs(
    left: DataFrame, right: DataFrame | None, threshold: float, seg_bits: int | None = None, recall: float = 0.999999
) -> DataFrame:
    """(key_a, key_b, shared, union) of (key, members) rows whose sets reach ``threshold``; one table or two.

    With one table, key_a < key_b. The segments are joined by the planner's own exchange, so adaptive execution may
    split a segment that many codes agree on.
    """
    a_sets, b_sets = left, left if right is None else right
    if seg_bits is None:
        seg_bits = segment_width(max(a_sets.count(), b_sets.count() if right is not None else 0))
    n_segments, checked, radius = calibrate(threshold, seg_bits, recall)

    def by_segment(sets: DataFrame) -> DataFrame:
        coded = cut(sketches(sets, n_segments, seg_bits, checked))
        return coded.select(F.explode("segs").alias("seg"), "key", "n", "c0", "c1", "c2", "c3")

    sa = by_segment(a_sets)
    sb = sa if right is None else by_segment(b_sets)
    ea, eb = sa.toDF("seg", "key_a", "na", "a0", "a1", "a2", "a3"), sb.toDF("seg", "key_b", "nb", "b0", "b1", "b2", "b3")
    far = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    near = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (far <= radius)
    if right is None:
        near = (F.col("key_a") < F.col("key_b")) & near
    found = ea.hint("merge").join(eb, "seg").filter(near).select("key_a", "key_b").distinct()
    # exact check on the sets
    with_a = found.join(a_sets.select(F.col("key").alias("key_a"), F.col("members").alias("ma")), "key_a")
    with_b = with_a.join(b_sets.select(F.col("key").alias("key_b"), F.col("members").alias("mb")), "key_b")
    shared = F.size(F.array_intersect("ma", "mb"))
    return (
        with_b.select("key_a", "key_b", shared.alias("shared"), (F.size("ma") + F.size("mb")).alias("sizes"))
        .select("key_a", "key_b", "shared", (F.col("sizes") - F.col("shared")).alias("union"))
        .filter(F.col("shared") >= F.lit(threshold) * F.col("union") - 1e-9)
    )


def similar_pairs(
    df: DataFrame, id_col: str, set_col: str, threshold: float = 0.75, min_size: int = 4,
    seg_bits: int | None = None, recall: float = 0.999999,
) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: all pairs within one table, members of equal sets included."""
    members = set_classes(df, id_col, set_col, min_size)
    classes = members.filter(F.col("id") == F.col("key")).select("key", "members")
    pairs = class_pairs(classes, None, threshold, seg_bits, recall).select("key_a", "key_b", (F.col("shared") / F.col("union")).alias("similarity"))
    who = members.select("id", "key")
    a, b = who.select(F.col("id").alias("x"), F.col("key").alias("key_a")), who.select(F.col("id").alias("y"), F.col("key").alias("key_b"))
    across = pairs.join(a, "key_a").join(b, "key_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    within = (
        a.join(b, F.col("key_a") == F.col("key_b"))
        .filter(F.col("x") < F.col("y"))
        .select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("similarity"))
    )
    return across.unionByName(within)


def similar_pairs_between(
    left: DataFrame, right: DataFrame, id_col: str, set_col: str, threshold: float = 0.75, min_size: int = 4,
    seg_bits: int | None = None, recall: float = 0.999999,
) -> DataFrame:
    """(id_left, id_right, similarity) of all pairs between two tables."""
    ml, mr = set_classes(left, id_col, set_col, min_size), set_classes(right, id_col, set_col, min_size)
    cl, cr = (m.filter(F.col("id") == F.col("key")).select("key", "members") for m in (ml, mr))
    pairs = class_pairs(cl, cr, threshold, seg_bits, recall)
    a = ml.select(F.col("id").alias("id_left"), F.col("key").alias("key_a"))
    b = mr.select(F.col("id").alias("id_right"), F.col("key").alias("key_b"))
    return pairs.join(a, "key_a").join(b, "key_b").select("id_left", "id_right", (F.col("shared") / F.col("union")).alias("similarity"))
