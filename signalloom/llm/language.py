"""Language identification by hierarchical discrimination: the family first, then the languages within it.

Features are hashed byte 3-grams of the folded text, as shares of all its 3-grams. Linear support vector machines, one
for each family against the rest, choose the family; one machine for each pair of languages of that family votes on the
language. Training is by dual coordinate descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import kernels, shared

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
FAMILY_OF = {lang: name for name, langs in FAMILIES.items() for lang in langs}
UNKNOWN = "und"
#: Size of the hashed feature space.
FEATURES = 4096
#: Labelled rows that are learned from, at most: those of the smallest hash of doc_id.
TRAIN_ROWS = 3000
#: Rows of dense features at a time.
ROWS = 256

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _b in range(128):
    if not chr(_b).isalpha():
        _FOLD[_b] = 32
_ANY_LETTER = regex.compile(r"\p{L}")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of the hashed 3-grams of each row, scaled so that the sum is 1; a blank stands before and after each text."""
    n = len(off) - 1
    sizes = np.diff(off)
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    row = np.repeat(np.arange(n), sizes)
    padded[np.arange(len(data)) + 2 * row + 1] = _FOLD[data]
    x = padded.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - 12)
    # a 3-gram belongs to the row of its middle byte; those around a border between rows are left out
    middle = np.arange(len(data)) + 2 * row
    out = np.bincount(code[middle].astype(np.int64) + row * FEATURES, minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)
    out /= np.maximum(sizes, 1)[:, None]
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (with bias, last) of a linear machine for labels -1 and 1, by dual coordinate descent on the hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = {s: max(1, (y == s).sum()) for s in (-1, 1)}
    most = np.array([cost * len(y) / (2 * share[int(s)]) for s in y])
    norm = (x * x).sum(axis=1)
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i]
            step = min(max(step, 0.0), most[i])
            if step != alpha[i]:
                w += np.float32((step - alpha[i]) * y[i]) * x[i]
                alpha[i] = step
    return w


class Model:
    """Machines for families and, within each, for pairs of languages. Its size depends on the number of languages alone."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.array(langs)
        self.scale = 1 / np.sqrt(x.var(axis=0) + 1e-7)
        self.scale /= np.sqrt((self.scale**2 * (x**2).mean(axis=0)).sum())  # rows of length 1, about
        x = x * self.scale
        family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(langs[family == f].tolist())) for f in self.families}
        rows = []
        if len(self.families) > 1:
            rows += [train_svm(x, np.where(family == f, 1, -1)) for f in self.families]
        self.pairs: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for f in self.families:
            for a, b in combinations(range(len(self.members[f])), 2):
                own = np.isin(langs, [self.members[f][a], self.members[f][b]])
                self.pairs[f].append((a, b, len(rows)))
                rows.append(train_svm(x[own], np.where(langs[own] == self.members[f][a], 1, -1)))
        self.weights = np.array(rows, np.float32).reshape(len(rows), FEATURES + 1)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margins = (x * self.scale) @ self.weights[:, :-1].T + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margins, -20, 20)))
        out = []
        for i in range(len(x)):
            f, score = 0, 1.0
            if len(self.families) > 1:
                f = int(np.argmax(margins[i, : len(self.families)]))
                score = float(sure[i, f])
            members = self.members[self.families[f]]
            votes, weight = np.zeros(len(members)), np.zeros(len(members))
            for a, b, k in self.pairs[self.families[f]]:
                votes[a if margins[i, k] >= 0 else b] += 1
                weight[a] += margins[i, k]
                weight[b] -= margins[i, k]
            best = max(range(len(members)), key=lambda m: (votes[m], weight[m], -m))
            for a, b, k in self.pairs[self.families[f]]:
                if best in (a, b):
                    score *= float(sure[i, k] if best == a else 1 - sure[i, k])
            out.append((members[best], min(1.0, max(0.0, score))))
        return out


def crc(column: str, parts: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def train(docs: DataFrame, limit: int = TRAIN_ROWS) -> Model | None:
    """A model from the text and lang of at most ``limit`` rows whose lang is not null and whose crc32 mod 4 is not 2."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null").where(crc("doc_id", 4) != 2)
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x in _features(batch.column("text")):
                values = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, len(x)), values], names=["lang", "x"])

    found = rows.join(F.broadcast(ids), "doc_id").select("lang", "text").mapInArrow(shared.tidy(run), "lang string, x binary").toArrow()
    langs = found["lang"].to_pylist()[: 2 * limit]
    if not langs:
        return None
    values = found["x"].to_pylist()[: 2 * limit]
    order = sorted(range(len(langs)), key=lambda i: (langs[i], values[i]))
    return Model(np.array([np.frombuffer(values[i], np.float32) for i in order]), [langs[i] for i in order])


def _features(text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, data, off in kernels.blocks(text, 500_000):
        for a in range(0, hi - lo, ROWS):
            b = min(hi - lo, a + ROWS)
            yield lo + a, features(data[off[a] : off[b]], off[a : b + 1] - off[a])


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, and the ``carry`` columns.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null or has no letter, and everywhere if
    there was nothing to learn from. Only the text decides; repeated rows repeat. Columns not named are left out, those
    that are carried are named as ``shared.Carried`` has it. Texts of any length are read whole, in blocks. Of languages
    with equal votes the larger sum of margins wins, then the first name.
    """
    more = shared.Carried(docs, carry, ("doc_id", "lang_pred", "score"))
    inner, outer = more.inner, more.out  # what workers get
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            text = batch.column("text")
            n = len(batch)
            found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * n
            for lo, x in _features(text) if model else ():
                for i, guess in enumerate(model.predict(x)):
                    value = text[lo + i].as_py()
                    if value and _ANY_LETTER.search(value):
                        found[lo + i] = guess
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *(batch.column(c) for c in inner)],
                names=["doc_id", "lang_pred", "score", *outer],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more.columns)
    return rows.mapInArrow(shared.tidy(run), "doc_id bigint, lang_pred string, score double" + more.ddl())


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32 mod 4 is not 2; rows without an id are not held out."""
    docs = shared.table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(crc("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
