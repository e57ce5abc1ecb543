"""Documents with nulls, empty and long texts, ties, repeated rows and extra columns whose names clash with inner ones."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

from conftest import SMALL


def _sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows() -> list[tuple[int, str | None]]:
    """(doc_id, text): every awkward case once or more; ids unique but for one repeated row."""
    rng = random.Random(5)
    base, passage, line = _sentence(rng, 300), _sentence(rng, 70), "A line that is long enough to be told from noise " + _sentence(rng, 4)
    words = base.split()
    near = " ".join(words[:150] + ["Changed"] + words[151:])
    rows: list[tuple[int, str | None]] = [
        (1, None), (2, ""), (3, " \t\r\n \x0b\x0c"), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, near), (9, base.upper()),
        (10, _sentence(rng, 20_000, 5_000)), (11, "x" * 70_000), (12, "same " * 3_000), (13, "Zürich 日本語 \U0001f600 naïve space " * 40), (14, "12 345 !!! ---"),
        (15, "<|endoftext|> 'tis we'll\n\n  two  blanks\t\ttabs " * 30), (16, passage), (17, f"{_sentence(rng, 40)} {passage} {_sentence(rng, 40)}"), (18, f"{passage} {passage}"),
    ]
    rows += [(20 + i, f"{_sentence(rng, 8)}\n{'  ' * (i % 3)}{line if i % 2 else line.upper()}\t\n{_sentence(rng, 9)}\n") for i in range(8)]
    rows += [(30 + i, f"{line}\n{line}") for i in range(3)]
    rows += [(40 + i, base) for i in range(12)]
    rows += [(60 + i, " ".join(words[: 290 - i] + [f"tail{i}"] * (10 + i))) for i in range(6)]
    return rows + [(7, base)]


@pytest.fixture(scope="session")
def edge():
    return edge_rows()


def frame(spark, rows):
    """The rows with further columns named as inner columns of the operators are."""
    return spark.createDataFrame(
        [(d, t, "xx", None, 1, "k", 2, 3, 4, "d", 5) for d, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, id bigint, a bigint, b bigint, digest string, g int",
    )


@pytest.fixture(scope="session")
def edge_docs(spark, edge):
    return frame(spark, edge).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def real():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]


def rows_of(df, *names) -> list[tuple]:
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)
