"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, and maximal removal intervals.

Every window of WINDOW words of one document is hashed to 64 bits. Which of a group's windows also start in a smaller
document is counted over buckets of the hash space (see ``ranges``); repeated windows that touch merge into maximal
intervals of words, which are removed. Two of n different windows share a hash with probability n * n / 2**65: below
0.001 for the 1.4e8 words of half a gigabyte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import kernels, ranges, shared

WINDOW = 13


def windows(text: pa.Array, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word (within the row) of every window, and the number of words of each row."""
    hashes, rows, firsts, counts = [], [], [], np.zeros(len(text), np.int64)
    for lo, hi, data, off in kernels.blocks(text):
        starts, ends, doc = kernels.word_spans(data, off, kernels.SPACES)
        counts[lo:hi] = np.bincount(doc, minlength=hi - lo)
        n = len(starts) - window + 1
        if n <= 0:
            continue
        whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
        begin = np.concatenate(([0], np.cumsum(counts[lo:hi])))[:-1]
        hashes.append(kernels.rolling(kernels.span_hashes(data, starts, ends), window)[whole])
        rows.append(doc[whole] + lo)
        firsts.append(whole - begin[doc[whole]])
    if not hashes:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, counts
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(firsts), counts


def _distinct(h: np.ndarray, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, each window's place among them, and the lowest rank that holds each (rows come in rank order)."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    firsts = order[new]
    return h[firsts], place, rank_of[firsts]


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text adds kept and the removed spans of words.

    A word goes if a window that covers it also starts in a document of a smaller id. Null and empty texts, and texts
    shorter than a window, lose nothing. Rows of one doc_id do not count as earlier than each other; rows without an id
    come after all others. An empty table gives an empty result; columns besides doc_id and text are left out.
    Texts of any length are read whole.
    """
    groups, total = ranges.dealt(docs)
    bits = ranges.bucket_bits(total / 6)

    def hashes_of(table: pa.Table) -> np.ndarray:
        _, text, rank = ranges.ordered(table)
        return np.unique(windows(text, rank, window)[0])

    def finish(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, text, rank = ranges.ordered(table)
        h, row, first, counts = windows(text, rank, window)
        known, place, lowest = _distinct(h, rank[row])
        gone = ranges.answered(known, bits, answers)[place] | (lowest[place] < rank[row])
        row, first = row[gone], first[gone]
        at = np.searchsorted(row, np.arange(len(text) + 1))
        removed, digests, kept, spans = [], [], [], []
        for i in range(len(text)):
            words = text[i].as_py().encode().split()
            mine = first[at[i] : at[i + 1]]
            cut: list[tuple[int, int]] = []
            if len(mine):
                breaks = np.flatnonzero(np.diff(mine) > window)
                begins = mine[np.append(0, breaks + 1)]
                stops = mine[np.append(breaks, len(mine) - 1)] + window
                cut = list(zip(begins.tolist(), stops.tolist(), strict=True))
                left, done = [], 0
                for a, b in cut:
                    left += words[done:a]
                    done = b
                words = left + words[done:]
            data = b" ".join(words)
            removed.append(sum(b - a for a, b in cut))
            digests.append(hashlib.sha256(data).hexdigest())
            if with_text:
                kept.append(data.decode())
                spans.append([{"start": a, "stop": b} for a, b in cut])
        out = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out |= {"kept": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))}
        return pa.table(out)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    if with_text:
        schema += ", kept string, spans array<struct<start:bigint,stop:bigint>>"
    answers = ranges.answer(ranges.ask(groups, hashes_of, bits), bits, earlier_only=True)
    return groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(finish, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many of them repeat a smaller document's windows, and the digest of the rest."""
    return remove_repeats(shared.table(spark, sf_dir, "documents"))


def brute(documents: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract of op6 with a dictionary of windows, for tests."""
    smallest: dict[tuple, int] = {}
    rows = [(d, (t or "").encode().split()) for d, t in documents]
    for d, words in rows:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            smallest[key] = min(smallest.get(key, d), d)
    out = []
    for d, words in rows:
        gone = set()
        for i in range(len(words) - window + 1):
            if smallest[tuple(words[i : i + window])] < d:
                gone |= set(range(i, i + window))
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return out
