"""Documents dealt into ranges of doc_id, and which 64-bit hashes of a range other ranges hold.

A group g holds a contiguous range of ids, so "in a smaller document" is decided by g between groups and inside a group
by its own task. A group sends its distinct hashes, sorted and packed (six bytes each, the upper bits implied by bucket
and slot), to buckets of the hash space; a bucket answers each group with one bit for each hash. A passage that a third
of all documents share thus counts once for each group, and the answers take a fiftieth of what was asked.
The texts are dealt once: the passes over a group are co-grouped on the same exchange, which Spark reuses.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm import shared

#: Bytes of text in a group, on average.
GROUP_BYTES = 8_000_000
#: Hashes in a bucket, on average.
BUCKET_HASHES = 1_500_000
U64 = np.uint64
LOW = (1 << 48) - 1


def plan(docs: DataFrame) -> tuple[list[int], int]:
    """Upper bounds (inclusive) of all groups but the last, and the bytes of text. What the driver gets is a number a group."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / GROUP_BYTES))
    if n == 1:
        return [], total
    shares = [(i + 1) / n for i in range(n - 1)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n)).alias("b")).first()["b"] or []
    return sorted({*found}), total


def group_of(bounds: list[int]) -> Column:
    """The number of the group; ids that are null go into one of their own. Two short scans of literals, not one long one."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0))
    step = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    doc = F.col("doc_id")
    coarse = F.size(F.filter(F.lit([p[-1] for p in parts]), lambda b: b < doc))
    fine = F.get(F.array(*[F.lit(p) for p in parts]), F.least(coarse, F.lit(len(parts) - 1)))
    g = F.when(coarse >= len(parts), F.lit(len(bounds))).otherwise(coarse * step + F.size(F.filter(fine, lambda b: b < doc)))
    return F.when(doc.isNull(), F.lit(len(bounds) + 1)).otherwise(g)


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(g, doc_id, text) rows with empty texts for nulls, and the bytes of all texts."""
    rows = shared.slim(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds, total = plan(rows)
    return rows.select(group_of(bounds).cast("int").alias("g"), "doc_id", "text"), total


def bucket_bits(hashes: float) -> int:
    """Buckets are a power of two, 2**16 at most."""
    return min(16, max(0, math.ceil(math.log2(max(1.0, hashes / BUCKET_HASHES)))))


def ordered(table: pa.Table) -> tuple[list[int | None], pa.Array, np.ndarray]:
    """Ids, texts and a dense rank of the id, in order of (id, text); ids that are null rank last, equal."""
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].combine_chunks()
    text = table["text"].combine_chunks()
    values = ids.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
    rank = np.zeros(len(values), np.int64)
    if len(values):
        rank[1:] = np.cumsum(values[1:] != values[:-1])
    return ids.to_pylist(), text, rank


def pack(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed hashes) of sorted distinct hashes."""
    at = np.searchsorted(hashes, np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, np.int64)
    ends = np.append(at[1:], len(hashes))
    slots = 1 << (16 - bits)
    for b in range(1 << bits):
        part = hashes[at[b] : ends[b]]
        if len(part):
            slot = (part >> U64(48)).astype(np.int64) & (slots - 1)
            counts = np.bincount(slot, minlength=slots).astype("<u4")
            low = part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield b, counts.tobytes() + low.tobytes()


def unpack(blob: bytes, bits: int) -> np.ndarray:
    """The hashes again, without the bits of the bucket."""
    slots = 1 << (16 - bits)
    counts = np.frombuffer(blob, "<u4", slots)
    low = np.frombuffer(blob, np.uint8, offset=4 * slots).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view("<u8").ravel().astype(U64) | (np.repeat(np.arange(slots, dtype=U64), counts) << U64(48))


def ask(groups: DataFrame, hashes_of: Callable[[pa.Table], np.ndarray], bits: int) -> DataFrame:
    """(g, bucket, blob): the packed sorted distinct hashes of each group."""

    def run(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        rows = list(pack(hashes_of(table), bits))
        return pa.table({"g": pa.array([g] * len(rows), pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return groups.groupBy("g").applyInArrow(run, "g int, bucket int, blob binary")


def answer(asked: DataFrame, bits: int, earlier_only: bool) -> DataFrame:
    """(g, bucket, bits): for each hash asked about, whether a smaller group (or any other group) holds it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        blobs = [unpack(x.as_py(), bits) for x in table["blob"]]
        sizes = np.array([len(x) for x in blobs])
        whole = np.concatenate(blobs)
        del blobs
        order = np.argsort(whole, kind="stable")
        same = whole[order][1:] == whole[order][:-1]
        held = np.zeros(len(whole), bool)
        held[1:] = same
        if not earlier_only:
            held[:-1] |= same
        found = np.empty(len(whole), bool)
        found[order] = held
        ends = np.cumsum(sizes)
        packed = [np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"g": table["g"], "bucket": table["bucket"], "bits": pa.array(packed, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "g int, bucket int, bits binary")


def answered(hashes: np.ndarray, bits: int, answers: pa.Table) -> np.ndarray:
    """The answers in the order of the group's sorted distinct hashes."""
    out = np.zeros(len(hashes), bool)
    if not len(hashes):
        return out
    known = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))
    at = np.searchsorted(hashes, np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, np.int64)
    ends = np.append(at[1:], len(hashes))
    for b in range(1 << bits):
        if n := int(ends[b] - at[b]):
            out[at[b] : ends[b]] = np.unpackbits(np.frombuffer(known[b], np.uint8), count=n).astype(bool)
    return out
