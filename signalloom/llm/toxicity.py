"""Toxicity by a factorization machine over hashed terms.

A document is the set of the hashes of its terms. The score is the logistic of a bias, a weight for each term and, for
each pair of terms, the inner product of their factors, so that two terms can weigh together what neither does alone.
Terms that fewer than LEAST_ROWS training rows hold carry no weight. Training on a bounded sample of labelled rows first
chooses terms: single ones by their excess and by dual averaging with a penalty on absolute weights, and both terms of
every pair whose joint rows have more of one label than the single terms explain, be these as frequent in either label
as chance has it. Then it fits weights and factors of all these by AdaGrad.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import kernels, shared
from signalloom.llm.language import crc

#: Labelled rows that are learned from, at most: those of the smallest hash of doc_id.
TRAIN_ROWS = 8000
LEAST_ROWS = 5
#: Words are terms, and so are their first bytes, so many, where they are longer: inflected forms share these.
STEMS = (5, 6, 7)
FACTORS = 4
EPOCHS, STEPS, RATE, DECAY = 6, 150, 0.5, 3e-5
#: A term's mean gradient must exceed this for a weight: so many more rows of one label than expected, in a share of all,
#: but no more than SPARSE_ROWS, so that LEAST_ROWS rows of one label are enough in a sample of any size.
SPARSE, SPARSE_ROWS = 0.001, 2.5
#: Terms whose number of toxic rows is within so many standard deviations of what chance gives weigh in pairs only.
SCREEN = 2.0
#: Terms whose joint rows are counted at once.
BLOCK = 512

_FOLD = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32
_BLANK = np.zeros(256, bool)
_BLANK[32] = True


def terms_of(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, 40-bit term hash) of the distinct terms of runs of rows, in order."""
    for lo, hi, data, off in kernels.blocks(text):
        data = _FOLD[data]
        starts, ends, row = kernels.word_spans(data, off, _BLANK)
        keys = [kernels.span_hashes(data, starts, ends)]
        for k in STEMS:
            longer = np.flatnonzero(ends - starts > k)
            keys.append(kernels.span_hashes(data, starts[longer], starts[longer] + k) ^ np.uint64(k << 32))
        rows = np.concatenate([row, *(row[ends - starts > k] for k in STEMS)])
        key = np.unique((np.concatenate(keys) >> np.uint64(24)) | (rows.astype(np.uint64) << np.uint64(40)))
        yield lo, hi, (key >> np.uint64(40)).astype(np.int64), (key & np.uint64((1 << 40) - 1)).astype(np.int64)


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(row, values, n)
    return np.stack([np.bincount(row, values[:, j], n) for j in range(values.shape[1])], axis=1)


class Machine:
    """The machine: its terms, sorted, and their weights and factors. Its size is bounded by the training sample's."""

    def __init__(self, terms: np.ndarray, seed: int = 11):
        self.terms = terms
        self.bias = 0.0
        self.w = np.zeros(len(terms))
        self.v = np.random.default_rng(seed).normal(0, 0.01, (len(terms), FACTORS))

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the term hashes are known, and where these stand."""
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        return known, at[known]

    def raw(self, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[at]
        s = _sums(v, row, n)
        return self.bias + _sums(self.w[at], row, n) + 0.5 * ((s**2).sum(axis=1) - _sums((v**2).sum(axis=1), row, n)), s

    def scores(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        known, at = self.places(term)
        return 1 / (1 + np.exp(-np.clip(self.raw(row[known], at, n)[0], -30, 30)))

    def fit(self, row: np.ndarray, at: np.ndarray, y: np.ndarray, pairs: bool = True) -> None:
        """row: ascending; at: places of the terms of each row. First a choice of terms, then weights and factors of these."""
        n = len(y)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
        self.bias = float(np.log(p / (1 - p)))
        count = np.bincount(at, minlength=len(self.w))
        excess = np.bincount(at, y[row], len(self.w)) - p * count
        single = (count >= LEAST_ROWS) & (np.abs(excess) >= SCREEN * np.sqrt(p * (1 - p) * count))
        held = single[at]
        chosen = single & self._choose(row[held], at[held], y)
        if pairs and n:
            chosen |= pair_terms(row, at, y, self._chances(row, at, y), len(self.w))
        self.terms, self.w, self.v = self.terms[chosen], np.zeros(chosen.sum()), self.v[chosen]
        new = np.cumsum(chosen) - 1
        keep = chosen[at]
        self._refine(row[keep], new[at[keep]], y)

    def _chances(self, row: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of every row, what single terms say, learned from the other half of the rows; half way to the share of toxic rows."""
        out = np.empty(len(y))
        for half in (0, 1):
            mine = np.arange(len(y)) % 2 == half
            other = ~mine[row]
            machine = Machine(self.terms)
            machine.fit((np.cumsum(~mine) - 1)[row[other]], at[other], y[~mine], pairs=False)
            out[mine] = machine.scores(row, self.terms[at], len(y))[mine]
        return np.clip((out + y.mean()) / 2, 1e-6, 1 - 1e-6)

    def _choose(self, row: np.ndarray, at: np.ndarray, y: np.ndarray, seed: int = 13) -> np.ndarray:
        """Dual averaging of weights alone: a term whose mean gradient stays within SPARSE (or SPARSE_ROWS) has no weight."""
        n, rng, bias = len(y), np.random.default_rng(seed), self.bias
        sparse = min(SPARSE, SPARSE_ROWS / max(1, n))
        begin = np.searchsorted(row, np.arange(n + 1))
        total, square, gb, seen = np.zeros(len(self.w)), np.ones(len(self.w)), 1.0, 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for lo in range(0, n, 32):
                rows = order[lo : lo + 32]
                sizes = begin[rows + 1] - begin[rows]
                places = np.concatenate([at[begin[r] : begin[r + 1]] for r in rows])
                local = np.repeat(np.arange(len(rows)), sizes)
                w = -RATE * np.sign(total[places]) * np.maximum(np.abs(total[places]) - sparse * seen, 0) / np.sqrt(square[places])
                g = 1 / (1 + np.exp(-np.clip(bias + _sums(w, local, len(rows)), -30, 30))) - y[rows]
                np.add.at(total, places, g[local])
                np.add.at(square, places, g[local] ** 2)
                gb += (g**2).sum()
                bias -= RATE * float(g.sum()) / np.sqrt(gb)
                seen += len(rows)
        return np.abs(total) > sparse * seen

    def _refine(self, row: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        """Whole-sample AdaGrad on weights and factors of the chosen terms."""
        n = max(1, len(y))
        gw, gv, gb = np.full(len(self.w), 1e-12), np.full(self.v.shape, 1e-12), 1e-12
        for _ in range(STEPS):
            f, s = self.raw(row, at, len(y))
            g = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y) / n
            g_at = g[row]
            dw = np.bincount(at, g_at, len(self.w)) + DECAY * self.w
            dv = _sums(g_at[:, None] * (s[row] - self.v[at]), at, len(self.w)) + DECAY * self.v
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + g.sum() ** 2
            self.w -= RATE * dw / np.sqrt(gw)
            self.v -= 0.1 * RATE * dv / np.sqrt(gv)
            self.bias -= 0.2 * RATE * float(g.sum()) / np.sqrt(gb)


def pair_terms(row: np.ndarray, at: np.ndarray, y: np.ndarray, p: np.ndarray, n_terms: int) -> np.ndarray:
    """Which terms belong to a pair whose joint rows have more of one label than chance in as many pairs.

    p: the chance of each row to be toxic, from single terms. Chernoff's bound on the label's number in the joint rows
    must be below one over the number of pairs. Terms and pairs are left out early only where their rows of that label
    could not reach it, whatever their other rows are.
    """
    out = np.zeros(n_terms, bool)
    need = np.log(max(2.0, n_terms * (n_terms - 1) / 2))
    for label, chance in ((y == 1, p), (y == 0, 1 - p)):
        weight = np.where(label, -np.log(chance), 0)
        able = np.flatnonzero(np.bincount(at, weight[row], n_terms) >= need)
        new = np.full(n_terms, -1)
        new[able] = np.arange(len(able))
        keep = new[at] >= 0
        place, r = new[at[keep]], row[keep]
        # what a term alone has beyond its rows' chances explains as much of its pairs
        rate = np.maximum(1, np.bincount(place, label[r], len(able)) / np.maximum(np.bincount(place, chance[r], len(able)), 1e-9))
        order = np.argsort(place, kind="stable")
        place, r = place[order], r[order]
        begin = np.searchsorted(place, np.arange(0, len(able) + BLOCK, BLOCK))
        number = np.cumsum(label) - 1
        few = label[r]

        def dense(k: int, rows: np.ndarray | None = None) -> np.ndarray:
            at_k = slice(begin[k], begin[k + 1])
            x = np.zeros((min(BLOCK, len(able) - k * BLOCK), len(y) if rows is None else int(label.sum())), np.float32)
            if rows is None:
                x[place[at_k] - k * BLOCK, r[at_k]] = 1
            else:
                x[place[at_k][few[at_k]] - k * BLOCK, number[r[at_k][few[at_k]]]] = 1
            return x

        w, c, some = weight[label].astype(np.float32), chance.astype(np.float32), np.flatnonzero(label)
        for i in range(len(begin) - 1):
            near, whole = dense(i, some), None
            for j in range(i, len(begin) - 1):
                other = dense(j, some)
                open_ = (near * w) @ other.T >= need
                a, b = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                if not len(a) or not len(b):
                    continue
                whole = dense(i) if whole is None else whole
                x, z = whole[a], dense(j)[b]
                size, mean, t = (x @ z.T).astype(float), ((x * c) @ z.T).astype(float), (near[a] @ other[b].T).astype(float)
                mean = mean * np.maximum(rate[i * BLOCK + a][:, None], rate[j * BLOCK + b])
                with np.errstate(divide="ignore", invalid="ignore"):
                    rest = np.where(size > t, (size - t) * np.log((size - t) / (size - mean)), 0)
                    found = (t > mean) & (size >= LEAST_ROWS) & (t * np.log(t / mean) + rest >= need)
                found &= (i * BLOCK + a)[:, None] != j * BLOCK + b
                out[able[i * BLOCK + a[found.any(axis=1)]]] = True
                out[able[j * BLOCK + b[found.any(axis=0)]]] = True
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Machine:
    """A machine from at most ``limit`` labelled rows whose crc32 mod 5 is not 0. Ids labelled both ways count as toxic."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(crc("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = shared.slim(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, row, term in terms_of(batch.column("text")):
                off = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off), pa.array(term))],
                    names=["doc_id", "toxic", "terms"],
                )

    found = rows.select("doc_id", "toxic", "text").mapInArrow(shared.tidy(run), "doc_id bigint, toxic int, terms array<bigint>").toArrow().sort_by("doc_id")
    y = found["toxic"].to_numpy().astype(float)
    lists = found["terms"].combine_chunks()
    term = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    values, count = np.unique(term, return_counts=True)
    machine = Machine(values[count >= LEAST_ROWS])
    keep, at = machine.places(term)
    machine.fit(row[keep], at, y)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per document: doc_id, score, predicted (1 from 0.5 on).

    Null and empty texts get the score of no terms; repeated rows repeat; columns besides doc_id and text are left out.
    Texts of any length are scored whole; equal texts have equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            parts = [machine.scores(row, term, hi - lo) for lo, hi, row, term in terms_of(batch.column("text"))]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return shared.slim(docs, "doc_id", "text").mapInArrow(shared.tidy(run), "doc_id bigint, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from labelled rows whose crc32 mod 5 is not 0; rows without an id are not held out."""
    docs = shared.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, shared.table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
