"""Carried columns whose names are an operator's own, in any case, or occur twice."""

from signalloom.llm import decontaminate, language, line_dedup, shared

TYPES = "doc_id bigint, text string, lang string, Score string, lang_pred string, n_lines string, kept string, lost string, a string, items string, spans string, N_hit string, carried_0 string, score_given string"
ROWS = [(i, f"words of document {i} that no other holds", "en", *"bcdefghijkl") for i in range(3)] + [(None, None, None, *[None] * 11)]
NAMES = tuple(t.split()[0] for t in TYPES.split(", "))


def carried(found, own):
    names = [c for c in found.columns if c not in own]
    return names, sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)


def want(*names):
    return sorted((tuple(r[NAMES.index(n)] for n in names) for r in ROWS), key=repr)


def test_language(spark):
    docs = spark.createDataFrame(ROWS, TYPES)
    names, rows = carried(language.predict(docs, None, carry=("doc_id", "Score", "lang_pred", "text", "score_given", "text")), ("doc_id", "lang_pred", "score"))
    assert names == ["Score_given", "lang_pred_given", "text", "score_given_given"]
    assert rows == want("Score", "lang_pred", "text", "score_given")


def test_decontamination(spark):
    docs, bench = spark.createDataFrame(ROWS, TYPES), spark.createDataFrame([("i", "words of")], "item_id string, text string")
    own = ("doc_id", "n_words", "n_hit", "items", "spans")
    names, rows = carried(decontaminate.search(docs, bench, carry=("items", "spans", "N_hit", "carried_0", "text")), own)
    assert names == ["items_given", "spans_given", "N_hit_given", "carried_0", "text"]
    assert rows == want("items", "spans", "N_hit", "carried_0", "text")


def test_lines(spark):
    docs = spark.createDataFrame(ROWS, TYPES)
    found = line_dedup.dedup_lines(docs, shared.scratch(spark, "lines"), carry=("n_lines", "kept", "lost", "a", "text"))
    names, rows = carried(found, ("doc_id", "n_lines", "n_dropped", "kept"))
    assert names == ["n_lines_given", "kept_given", "lost", "a", "text"] and rows == want("n_lines", "kept", "lost", "a", "text")
