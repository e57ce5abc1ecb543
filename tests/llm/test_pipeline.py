"""run() against a plain version of each stage; language ID, which learns, is taken from its own operator."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import corpus_pipeline
import pyarrow.parquet as pq
from conftest import SMALL
from tokenizers import Tokenizer

from signalloom.llm import bpe, decontaminate, language, line_dedup, minhash

FOLD = str.maketrans(line_dedup.string.ascii_uppercase, line_dedup.string.ascii_lowercase)


def lines_kept(rows):
    key = lambda line: line.strip(line_dedup.BLANKS).translate(FOLD)
    holders = defaultdict(set)
    for d, t in rows.items():
        for line in t.split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, t in rows.items():
        lines = t.split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and d < max(holders[key(x)]))]
        if len(stay) == len(lines) or "\n".join(stay).strip(" "):
            out[d] = "\n".join(stay)
    return out


def test_run_against_plain_stages(spark):
    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = {r["doc_id"] for r in language.predict(docs, language.train(docs)).collect() if r["lang_pred"] != "und"}
    rows = lines_kept({d: t for d, t in text.items() if d in known})
    kept = {d for d, _, _, stays in minhash.brute(list(rows.items()), 5) if stays}
    rows = {d: t for d, t in rows.items() if d in kept}
    patterns = set()
    for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist():
        w = decontaminate.words(r["text"])
        k = min(13, len(w))
        patterns |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1) if w}
    library, want = Tokenizer.from_file(bpe.default_tokenizer()), {}
    for d, t in rows.items():
        w, hit, whole = decontaminate.words(t), set(), False
        for k in {len(p) for p in patterns}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in patterns:
                    hit |= set(range(i, i + k))
                    whole |= k == 13
        if not whole and not (hit and 20 * len(hit) >= len(w)):
            ids = library.encode(t, add_special_tokens=False).ids
            want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert found == want and 0 < len(want) < len(text)


def test_stages_but_the_last_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_line_dedup_keeps_documents_of_which_no_text_stays(spark):
    line = "x" * 50
    docs = spark.createDataFrame([(i, f"{line}\n{line}" if i else "other", "en", "s", 101) for i in range(7)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.distinct_lines(spark, docs, SMALL).collect()}
    assert found == {0: ("other", 5), 6: (f"{line}\n{line}", 101)} | {i: ("", 0) for i in range(1, 6)}
