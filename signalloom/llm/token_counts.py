"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists, for each end position and longest first, the vocabulary entries that end there; dynamic
programming carries the best score and the number of pieces, never the pieces. Ties follow the tokenizers library's
Unigram model: of equal scores the piece that starts first stays. A character that is no entry costs the lowest score
less 10; runs of such characters are one piece, or one piece for each byte where the vocabulary has all byte entries.
Pieces never cross the word border ``▁``, so words are counted once and remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import shared

CACHED_WORDS = 200_000
BORDER = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) pairs by id, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter(dict):
    """Piece counts of words, by word; computes what is missing."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.vocab = {p: s for p, s in pieces}
        self.unknown = min(s for _, s in pieces) - 10.0
        self.bytes = all(f"<0x{b:02X}>" in self.vocab for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for p, s in self.vocab.items():
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p in self.vocab if len(p) == 1}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        score[0] = 0.0
        count, run = [0] * (n + 1), [-1] * (n + 1)  # run: where the run of unknown characters that ends here began
        done = 0
        for end, (length, gain) in self.automaton.iter(word):
            end += 1
            for e in range(done + 1, end):
                self._unknown(word, e, score, count, run)
            done = end - 1
            start = end - length
            if score[start] is not None and (score[end] is None or score[start] + gain > score[end]):
                score[end], count[end], run[end] = score[start] + gain, count[start] + 1, -1
        for e in range(done + 1, n + 1):
            self._unknown(word, e, score, count, run)
        return count[n]

    def _unknown(self, word: str, e: int, score: list, count: list, run: list) -> None:
        """Position e has seen all entries that end there; the unknown character before it comes last."""
        if word[e - 1] in self.single:
            return
        s = score[e - 1] + self.unknown
        if score[e] is None or s > score[e]:
            first = run[e - 1] if run[e - 1] >= 0 else e - 1
            fused = word[first:e]
            many = len(fused.encode()) if self.bytes and fused not in self.vocab else 1
            score[e], count[e], run[e] = s, count[first] + many, first

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.word(word)
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        if len(word) <= 256:
            self[word] = n
        return n

    def text(self, text: str) -> int:
        """Pieces of a whole text: blanks become borders, and a text that starts without one gets one."""
        if not text:
            return 0
        text = text.replace(" ", BORDER)
        words = text.split(BORDER)
        first = [words[0]] if words[0] else []  # a border of its own is prepended
        return sum(map(self.__getitem__, [BORDER + w for w in first + words[1:]]))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path)[0])
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens. Null and empty texts have none; repeated rows repeat; no shuffle.

    Texts of any length are counted whole; of segmentations with equal scores the one the tokenizer takes counts. Columns
    besides doc_id and text are left out.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = [count.text(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return shared.slim(docs, "doc_id", "text").mapInArrow(shared.tidy(run), "doc_id bigint, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of unigram pieces."""
    return count_tokens(shared.table(spark, sf_dir, "documents"))
