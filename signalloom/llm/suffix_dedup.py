"""Suffix-array dedup: maximal repeat groups from the common-prefix interval tree of an enhanced suffix array.

1. Anchors. Every string of LENGTH bytes contains an anchor, the k-gram of least hash (leftmost of equals), so equal
   strings have equal anchors at equal places. A run is a maximal stretch of starts with one anchor; its bytes hold all
   its strings. Which anchors occur again is counted over buckets of the hash space (see ``ranges``).
2. Suffix arrays. The runs of anchors that occur again go, by anchor, to buckets; equal runs go once for each group,
   with their number. Suffix arrays over the runs of some anchors at a time are built by rank doubling to LENGTH bytes. Intervals of
   common prefixes that all continue one common byte to their left belong to a longer repeat and go as a whole; the
   others are sorted to their ends and a stack scan over their common-prefix lengths builds the interval tree. Each
   interval whose occurrences differ to their left is a maximal repeat group (within runs), with all its occurrences.
3. Groups of documents get the covered stretches of their runs back and remove them.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import kernels, ranges, shared

LENGTH = 200
GRAM = 24
#: Bytes of text for each bucket of suffix arrays.
ARRAY_BYTES = 6_000_000
#: Bytes of runs that one suffix array takes; the runs of one anchor stay together, whatever their size.
CHUNK_BYTES = 600_000
U64 = np.uint64


def anchors(text: pa.Array, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, row, first start (in the row) and number of starts of every run, in order of row and start."""
    found: list[tuple] = []
    span = length - gram + 1
    for lo, hi, data, off in kernels.blocks(text, 500_000):
        n = len(data)
        if n < length:
            continue
        power, inverse = kernels.powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(kernels.BYTE_HASH[data] * power[:n], out=sums[1:])
        h = kernels.mix((sums[gram:] - sums[: n + 1 - gram]) * inverse[: n + 1 - gram])
        least = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        sizes = np.diff(off)
        begin = np.repeat(off[:-1], sizes)[: len(least)]
        stop = np.repeat(off[1:], sizes)[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + length <= stop)
        if not len(at):
            continue
        spot = (least[at] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        s = at[first]
        row = np.searchsorted(off, s, side="right") - 1 + lo
        found.append((h[spot[first]], row, s - begin[s], count))
    if not found:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Dense ranks of the strings of ``length`` (8 or more) bytes that start at each byte, by doubling; a rank near the end is arbitrary."""
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(U64)
    key = padded[:n].copy()
    for j in range(1, 8):
        key <<= U64(8)
        key |= padded[j : j + n]
    rank, width = _dense(key), 8
    while width < length:
        step = min(width, length - width)
        ahead = np.zeros(n, U64)
        ahead[: n - step] = rank[step:]
        rank = _dense((rank << U64(32)) | ahead)
        width += step
    return rank


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    sortd = key[order]
    new = np.zeros(len(key), U64)
    new[1:] = sortd[1:] != sortd[:-1]
    out = np.empty(len(key), U64)
    out[order] = np.cumsum(new, dtype=U64)
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lengths: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the tree over a suffix array; lengths[i] is between i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lengths) + 1):
        now = lengths[i] if i < len(lengths) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(runs: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences as (run, offset)) of every maximal repeat group of distinct runs; a run's ends bound its repeats."""
    if not runs:
        return
    sizes = np.array([len(r) for r in runs])
    data = np.frombuffer(b"".join(runs), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    rank = ranks(data, least)
    owner = np.repeat(np.arange(len(runs)), sizes)
    offset = np.arange(len(data)) - begin[owner]
    valid = np.flatnonzero(offset + least <= sizes[owner])
    order = valid[np.argsort(rank[valid], kind="stable")]
    if not len(order):
        return
    new = np.ones(len(order), bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    before = np.where(offset[order] == 0, -1, data[order - 1].astype(np.int64))
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    diverse = (count > 1) & ((low != high) | (low < 0))
    for f, c in zip(first[diverse].tolist(), count[diverse].tolist(), strict=True):
        places = order[f : f + c]
        suffixes = sorted((runs[r][o:], r, o, int(b)) for r, o, b in zip(owner[places].tolist(), offset[places].tolist(), before[f : f + c].tolist(), strict=True))
        lengths = [0] + [common_prefix(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:], strict=False)]
        for depth, a, b in intervals(lengths, least):
            lefts = {x[3] for x in suffixes[a : b + 1]}
            if -1 in lefts or len(lefts) > 1:
                yield depth, [(r, o) for _, r, o, _ in suffixes[a : b + 1]]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered(runs: list[bytes], anchor: list[int], number: list[int], least: int) -> dict[int, list[tuple[int, int]]]:
    """Covered stretches of distinct runs, from the maximal repeats among the runs of each anchor; number: occurrences of the run."""
    out: dict[int, list] = {i: [(0, len(runs[i]))] for i in range(len(runs)) if number[i] > 1}  # the run itself is the repeat
    alike: dict[int, list[int]] = defaultdict(list)
    for i, h in enumerate(anchor):
        alike[h].append(i)
    for chosen in _chunks([own for own in alike.values() if len(own) > 1], runs):
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length, places in maximal_repeats([runs[i] for i in chosen], least):
            for r, o in places:
                spans[r].append((o, o + length))
        for r, own in spans.items():
            out.setdefault(chosen[r], _merge(own))
    return out


def _chunks(groups: list[list[int]], runs: list[bytes]) -> Iterator[list[int]]:
    """The groups strung together to CHUNK_BYTES of runs or just beyond."""
    chunk, size = [], 0
    for own in groups:
        chunk += own
        size += sum(len(runs[i]) for i in own)
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept (binary) and the spans.

    A byte goes if a string of ``length`` bytes that covers it also starts at any other place of the table, the same
    document included. Null, empty and short texts lose nothing; repeated rows are other places; rows without an id are
    treated like all others. An empty table gives an empty result; columns besides doc_id and text are left out.
    """
    groups, total = ranges.dealt(docs)
    bits = ranges.bucket_bits(total / 80)
    parts = min(16, max(0, (max(1, -(-total // ARRAY_BYTES)) - 1).bit_length()))

    def hashes_of(table: pa.Table) -> np.ndarray:
        return np.unique(anchors(ranges.ordered(table)[1], length, gram)[0])

    def offer(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, text, _ = ranges.ordered(table)
        h, row, start, count = anchors(text, length, gram)
        known, place, local = np.unique(h, return_inverse=True, return_counts=True)
        again = (ranges.answered(known, bits, answers) | (local > 1))[place]
        runs: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        at = -1
        for k in np.flatnonzero(again).tolist():
            if row[k] != at:
                at = int(row[k])
                data = text[at].as_py().encode()
            s = int(start[k])
            runs[int(h[k]), data[s : s + int(count[k]) - 1 + length]].append(k)
        rows: dict[int, list] = defaultdict(list)
        for (a, run), own in runs.items():
            rows[a >> (64 - parts) if parts else 0].append((a, run, own))
        g = table["g"][0].as_py() if len(table) else 0
        out = []
        for b, own in rows.items():
            blob = np.array([len(own)], "<u8").tobytes() + np.array([a for a, _, _ in own], "<u8").tobytes()
            blob += np.array([(len(run), len(places)) for _, run, places in own], "<u4").tobytes()
            blob += np.array([k for _, _, places in own for k in places], "<u4").tobytes()
            out.append((g, b, blob, zlib.compress(b"".join(run for _, run, _ in own), 1)))
        del runs, rows
        shared.give_back()
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "part": pa.array([x[1] for x in out], pa.int32()), "head": pa.array([x[2] for x in out], pa.binary()), "runs": pa.array([x[3] for x in out], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        index: dict[tuple[int, bytes], int] = {}
        number: list[int] = []
        told: list[tuple[int, np.ndarray, list[int], np.ndarray]] = []  # group, occurrences of each run, its number here, where
        for g, head, data in zip(table["g"].to_pylist(), table["head"].to_pylist(), table["runs"].to_pylist(), strict=True):
            n = int(np.frombuffer(head, "<u8", 1)[0])
            hashes = np.frombuffer(head, "<u8", n, 8).tolist()
            sizes = np.frombuffer(head, "<u4", 2 * n, 8 + 8 * n).reshape(n, 2)
            places = np.frombuffer(head, "<u4", -1, 8 + 16 * n)
            data = zlib.decompress(data)
            own, at = [], 0
            for a, size, many in zip(hashes, sizes[:, 0].tolist(), sizes[:, 1].tolist(), strict=True):
                i = index.setdefault((a, data[at : at + size]), len(number))
                if i == len(number):
                    number.append(0)
                number[i] += many
                own.append(i)
                at += size
            told.append((g, sizes[:, 1], own, places))
        anchor, runs = [a for a, _ in index], [run for _, run in index]
        spans = covered(runs, anchor, number, length)
        out = []
        for g, many, own, places in told:
            ends = np.cumsum(many)
            reply = array("I")
            for i, e, m in zip(own, ends.tolist(), many.tolist(), strict=True):
                for a, b in spans.get(i, ()):
                    for k in places[e - m : e].tolist():
                        reply.extend((k, a, b))
            out.append((g, reply.tobytes()))
        del index, runs, spans, told
        shared.give_back()
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "spans": pa.array([x[1] for x in out], pa.binary())})

    def finish(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, text, _ = ranges.ordered(table)
        h, row, start, count = anchors(text, length, gram)
        got = [np.frombuffer(x, "<u4").reshape(-1, 3).astype(np.int64) for x in replies["spans"].to_pylist()]
        got = np.concatenate(got) if got else np.zeros((0, 3), np.int64)
        rows, a, b = row[got[:, 0]], start[got[:, 0]] + got[:, 1], start[got[:, 0]] + got[:, 2]
        order = np.lexsort((a, rows))
        rows, a, b = rows[order], a[order].tolist(), b[order].tolist()
        at = np.searchsorted(rows, np.arange(len(text) + 1)).tolist()
        sizes, removed, number, digests, kept, cuts = [], [], [], [], [], []
        for i in range(len(text)):
            data = text[i].as_py().encode()
            spans = _merge(list(zip(a[at[i] : at[i + 1]], b[at[i] : at[i + 1]], strict=True)))
            left, done = [], 0
            for s, e in spans:
                left.append(data[done:s])
                done = e
            stay = b"".join([*left, data[done:]])
            sizes.append(len(data))
            removed.append(len(data) - len(stay))
            number.append(len(spans))
            digests.append(hashlib.sha256(stay).hexdigest())
            if with_text:
                kept.append(stay)
                cuts.append([{"start": s, "stop": e} for s, e in spans])
        out = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(number, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out |= {"kept": pa.array(kept, pa.binary()), "spans": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))}
        return pa.table(out)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        schema += ", kept binary, spans array<struct<start:bigint,stop:bigint>>"
    answers = ranges.answer(ranges.ask(groups, hashes_of, bits), bits, earlier_only=False)
    offered = groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(offer, "g int, part int, head binary, runs binary")
    replies = offered.groupBy("part").applyInArrow(compare, "g int, spans binary")
    return groups.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(finish, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, those of repeated 200-byte strings in how many spans, and the digest of the rest."""
    return remove_repeats(shared.table(spark, sf_dir, "documents"))


def brute(documents: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The contract of op10 with a count of every string of ``length`` bytes, for tests."""
    seen: dict[bytes, int] = defaultdict(int)
    rows = [(d, (t or "").encode()) for d, t in documents]
    digest = lambda x: hashlib.blake2b(x, digest_size=12).digest()
    for _, data in rows:
        for i in range(len(data) - length + 1):
            seen[digest(data[i : i + length])] += 1
    out = []
    for d, data in rows:
        spans = _merge([(i, i + length) for i in range(len(data) - length + 1) if seen[digest(data[i : i + length])] > 1])
        left, done = [], 0
        for a, b in spans:
            left.append(data[done:a])
            done = b
        stay = b"".join([*left, data[done:]])
        out.append((d, len(data), len(data) - len(stay), len(spans), hashlib.sha256(stay).hexdigest()))
    return out
