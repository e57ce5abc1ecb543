import random

import pytest
from conftest import SMALL
from llm.conftest import frame, rows_of

from signalloom.llm import minhash
from signalloom.llm.components import components, extended

NAMES = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("size", [4, 5])
def test_edge_cases(edge, edge_docs, size):
    assert rows_of(minhash.near_groups(edge_docs, size), *NAMES) == sorted(minhash.brute(edge, size), key=repr)


def test_whole_small_table(spark, real):
    assert rows_of(minhash.op8_minhash(spark, SMALL), *NAMES) == sorted(minhash.brute(real), key=repr)


def test_chains_of_near_copies(spark):
    """Each version differs from the one before it by a few words, so that the ends link only through the middle."""
    rng = random.Random(9)
    docs, words = [], [f"t{rng.randrange(900)}" for _ in range(200)]
    for i in range(40):
        words[(i * 7) % 200] = f"n{i}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(i, " ".join(f"u{rng.randrange(900)}" for _ in range(100))) for i in range(40)]
    assert rows_of(minhash.near_groups(frame(spark, docs), 4), *NAMES) == sorted(minhash.brute(docs), key=repr)


def test_a_large_group_of_variants_with_outliers(spark, monkeypatch):
    """Random edits of one text: most link with its smallest id, others with each other only, others with none."""
    rng = random.Random(12)
    base = [f"b{rng.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(14)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [f"e{rng.randrange(30)}"], [words[k], f"e{rng.randrange(30)}"]])
        docs.append((i, " ".join(words)))
    want = sorted(minhash.brute(docs), key=repr)
    assert 2 < len({w[2] for w in want}) < 150
    assert rows_of(minhash.near_groups(frame(spark, docs), 4), *NAMES) == want
    monkeypatch.setattr(minhash, "RARE", 1)
    assert rows_of(minhash.near_groups(frame(spark, docs), 4), *NAMES) == want


def test_rows_without_id_are_kept(spark):
    found = minhash.near_groups(frame(spark, [(None, "a b c d e f g"), (1, "a b c d e f g"), (None, None)])).collect()
    assert all(r["kept"] for r in found) and len(found) == 3


def test_empty_table(empty_docs):
    assert minhash.near_groups(empty_docs).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100), (5, 3), (None, 4)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {i: i // 20 * 20 for i in range(61) if i != 60} | ({60: 60} if 60 in found else {})


def test_further_edges(spark):
    edges = lambda x: spark.createDataFrame(x, "a bigint, b bigint")
    found = extended(components(edges([(1, 2), (3, 4), (5, 6)])), edges([(4, 6), (6, 9), (8, 7)]))
    assert dict(map(tuple, found.collect())) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 9: 3, 7: 7, 8: 7}


def test_min_and_max_of_one_permutation_are_unbiased():
    import numpy as np

    rng = np.random.default_rng(4)
    both = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.append(both, rng.integers(0, 1 << 63, 100).astype(np.uint64))) for _ in range(2)]
    a, b = minhash.signatures(sets)
    assert abs((a == b).mean() - 400 / 600) < 0.15


def _variants(seed):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(0, 150, 15), rng.randrange(4, 7)):
            words[k] = f"e{rng.randrange(3)}"
        words[140:] = [f"o{i}x{k}" for k in range(rng.randrange(6))] + words[140:]
        docs.append((i, " ".join(words)))
    return docs


def test_a_large_group_of_variants_with_repeated_rows(spark):
    """Repeated rows are no further holders of a shingle: bounds and links are those of single rows."""
    docs = _variants(1)
    want = sorted(minhash.brute(docs), key=repr)
    assert 1 < len({w[2] for w in want}) < 120
    repeated = [d for d in docs for _ in range(3 if d[0] % 2 else 1)]
    found = rows_of(minhash.near_groups(frame(spark, repeated), 4), *NAMES)
    assert sorted(set(found), key=repr) == want and len(found) == len(repeated)
