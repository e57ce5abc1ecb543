"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole documents.

Symbols are words. All patterns of full length hold WINDOW words; a table keyed by blocks of two words says how far a
scan may advance, so a pair of words that ends no pattern and stands in none skips 12 words at once. Where the table
says 0, the bucket of that closing block gives the candidate patterns, and comparison of the words themselves decides.
Items shorter than a window are patterns of their own length, searched by the same scan with the tables of their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import shared

WINDOW = 13
#: Item text that one set of tables may hold; more items are searched for in further blocks.
BLOCK_TEXT_BYTES = 8_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Tables:
    """Shift and bucket tables for patterns of one length, in words."""

    def __init__(self, length: int):
        self.length = length
        self.span = min(2, length)
        self.far = length - self.span + 1
        self.shift: dict = {}
        self.bucket: dict[object, dict[tuple[bytes, ...], set[str]]] = {}

    def key(self, row: list[bytes] | tuple[bytes, ...], end: int) -> object:
        """The block of words that ends before ``end``."""
        return row[end - 1] if self.span == 1 else (row[end - 2], row[end - 1])

    def add(self, pattern: tuple[bytes, ...], item: str | None) -> None:
        """Take in a pattern of an item; one without an id is searched for, but no item of the result."""
        for end in range(self.span, self.length + 1):
            block = self.key(pattern, end)
            self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
        self.bucket.setdefault(self.key(pattern, self.length), {}).setdefault(pattern, set()).update(() if item is None else (item,))

    def search(self, row: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Starts of all occurrences, with the items that hold the pattern."""
        end, n, length, far = self.length, len(row), self.length, self.far
        shift, bucket, single = self.shift.get, self.bucket, self.span == 1
        while end <= n:
            block = row[end - 1] if single else (row[end - 2], row[end - 1])
            step = shift(block, far)
            if step:
                end += step
                continue
            found = bucket[block].get(tuple(row[end - length : end]))
            if found is not None:
                yield end - length, found
            end += 1


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Tables]:
    """Tables for (item id, text) pairs: one for each pattern length."""
    by: dict[int, Tables] = {}
    for item, text in items:
        row = words(text)
        length = min(window, len(row))
        for i in range(len(row) - length + 1 if row else 0):
            by.setdefault(length, Tables(length)).add(tuple(row[i : i + length]), item)
    return list(by.values())


def hits(row: list[bytes], tables: list[Tables]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged intervals of words inside occurrences, and the items that occur."""
    spans, items = [], set()
    for t in tables:
        for start, found in t.search(row):
            spans.append((start, start + t.length))
            items |= found
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(text: pa.Array, limit: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters, one text at least."""
    run, size = [], 0
    for value in text:
        value = value.as_py()
        run.append(value)
        size += len(value or "")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of at most ``limit`` bytes of text (one item at least), streamed through the driver.

    The rows arrive a partition at a time; the driver never holds more than a block and a partition.
    """
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        n = len((text or "").encode("utf-8", "surrogatepass"))
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>"


def search(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_TEXT_BYTES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, the items that occur (sorted) and the hit spans in words.

    No row is shuffled. Each block of items is broadcast by itself, of bounded size; with several blocks a worker holds
    one at a time. Null texts have no words. Benchmark texts without an item id count as hits, but not as items. Repeated
    rows give repeated results; rows of one item id are one item, each with its own windows. Texts of any length are
    searched whole. ``carry`` names further columns of ``docs`` to pass on, named as ``shared.Carried`` has it.
    """
    more = shared.Carried(docs, carry, ("doc_id", "n_words", "n_hit", "items", "spans"))
    inner, outer = more.inner, more.out  # what workers get
    spark = docs.sparkSession
    context = spark.sparkContext
    sent = [context.broadcast(block) for block in item_blocks(benchmark, block_bytes)]
    built: dict[int, list[Tables]] = {}

    def tables(k: int) -> list[Tables]:
        if k not in built:
            built.clear()
            built[k] = build(sent[k].value, window)
            if len(sent) > 1 and hasattr(sent[k], "_value"):
                del sent[k]._value  # it is read again from the worker's file when its turn comes
        return built[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for part in runs(batch.column("text")):
                rows = [words(t) for t in part]
                found: list[list] = [[] for _ in rows]
                names: list[set] = [set() for _ in rows]
                for k in range(len(sent)):
                    for i, row in enumerate(rows):
                        new, which = hits(row, tables(k))
                        if new:
                            found[i] = merged(found[i] + new)
                            names[i] |= which
                n_words += map(len, rows)
                spans += found
                items += names
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [
                    pa.array(n_words, pa.int64()),
                    pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ]
                + [batch.column(c) for c in inner],
                names=["doc_id", "n_words", "n_hit", "items", "spans", *outer],
            )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more.columns)
    return source.mapInArrow(shared.tidy(run), SCHEMA + more.ddl())


def contaminated():
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of benchmark windows, and the items these are from."""
    found = search(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def brute(documents: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract of op5 by comparison at every position; for tests."""
    patterns = set()
    for item, text in benchmark:
        row = words(text)
        k = min(window, len(row))
        patterns |= {(tuple(row[i : i + k]), item) for i in range(len(row) - k + 1) if row}
    out = []
    for doc, text in documents:
        row = words(text)
        hit, items = set(), set()
        for p, item in patterns:
            for i in range(len(row) - len(p) + 1):
                if tuple(row[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    items |= set() if item is None else {str(item)}
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(row), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(row)))
    return out
