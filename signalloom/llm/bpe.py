"""Byte-level BPE: per-prefix dynamic programming gives the exact merge result without running merges.

For every prefix of a piece exactly one token can be the last of its encoding. A suffix automaton of the vocabulary
follows the piece byte by byte; the tokens that end at a position are those of the states on the suffix links from its
state, longest first. The first whose predecessor (the last token of the prefix before it) forms a compatible pair is
the last token. Two tokens are compatible if encoding their concatenation leaves the border between them alone.
Following the last tokens back from the end of the piece emits its ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import shared
from signalloom.llm.decontaminate import runs

#: The split of byte-level BPE into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Encodings of so many pieces stay in memory, twice over, and so many answers on pairs.
CACHED_PIECES, CACHED_PAIRS = 200_000, 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """The suffix automaton of a set of words: its paths from state 0 are the substrings of all words.

    Built over the trie of the words level by level. A word is the longest string of the state that ends it, as no
    longer one ends at just the same places.
    """

    def __init__(self, words: dict[bytes, int]):
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for text, number in words.items():
            node = 0
            for b in text:
                down = trie[node].get(b)
                if down is None:
                    down = trie[node][b] = len(trie)
                    trie.append({})
                node = down
            ends[node] = number
        self.rows: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        word: dict[int, int] = {}
        level = [(0, 0)]
        while level:
            below = []
            for node, state in level:
                for b, down in trie[node].items():
                    reached = self._extend(state, b)
                    if down in ends:
                        word[reached] = ends[down]
                    below.append((down, reached))
            level = below
        #: Words that end where a state's strings do, longest first, as (number, length): all of them, and without its own.
        self.all: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        self.shorter: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.shorter[s] = self.all[self.link[s]]
            self.all[s] = ((word[s], self.length[s]), *self.shorter[s]) if s in word else self.shorter[s]
        self.link[0] = 0

    def _state(self, length: int, row: dict[int, int], link: int) -> int:
        self.rows.append(row)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, b: int, q: int) -> int:
        """The state of the string one byte longer than ``state``'s longest, which so far shares ``q`` with longer ones."""
        if self.length[q] == self.length[state] + 1:
            return q
        copy = self._state(self.length[state] + 1, dict(self.rows[q]), self.link[q])
        self.link[q] = copy
        while state >= 0 and self.rows[state].get(b) == q:
            self.rows[state][b] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, b: int) -> int:
        """The state of ``state``'s longest string and one more byte."""
        q = self.rows[state].get(b)
        if q is not None:
            return self._split(state, b, q)
        made = self._state(self.length[state] + 1, {}, 0)
        while state >= 0 and b not in self.rows[state]:
            self.rows[state][b] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, b, self.rows[state][b])
        return made


class Encoder(dict):
    """Ids of pieces, by piece; computes what is missing."""

    def __init__(self, path: str):
        super().__init__()
        model = json.load(open(path, encoding="utf-8"))
        odd = [k for k in ("normalizer", "post_processor") if model.get(k)]
        if odd or model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        byte = _byte_of()
        vocab = model["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.token: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token[i] = bytes(byte[c] for c in text)
        for text, i in self.added.items():
            self.token[i] = text.encode()
        self.text = [str(i) for i in range(size)]
        self.left, self.right = list(range(size)), list(range(size))
        self.pair: dict[tuple[int, int], int] = {}
        rank = -1
        for merge in model["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[a + b]
            if made <= max(rank, vocab[a], vocab[b]):
                raise ValueError(f"{path}: ids must follow the order of the merges")
            rank = made
            self.pair[vocab[a], vocab[b]] = made
            self.left[made], self.right[made] = vocab[a], vocab[b]
        self.automaton = SuffixAutomaton({self.token[i]: i for i in vocab.values()})
        self.lengths = [len(t) for t in self.token]
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.size = size
        self.fits: dict[int, bool] = {}  # by a * size + b
        self.old: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        known = self.fits[a * self.size + b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when ``a`` and ``b`` are encoded together.

        Merges happen in order of the ids they make. On the border's left stand, one after the other, the parts of ``a``
        that end it, each until the merge that makes the next larger one; on its right those that begin ``b``. A pair of
        parts merges across the border if its merge comes while both stand there. Of equal merges the left one is first:
        it takes the left part away before the border's, but leaves the right part to it.
        """
        never = self.size
        left, until = a, never
        while True:
            right, end = b, never
            while True:
                made = self.pair.get((left, right))
                if made is not None and made < until and made <= end:
                    return False
                if self.left[right] == right:
                    break
                right, end = self.left[right], right
            if self.right[left] == left:
                return True
            left, until = self.right[left], left

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        n = len(data)
        last = [-1] * (n + 1)
        rows, link, length = self.automaton.rows, self.automaton.link, self.automaton.length
        every, shorter = self.automaton.all, self.automaton.shorter
        fits, width = self.fits.get, self.size
        state = matched = end = 0
        row = rows[0]
        for b in data:
            end += 1
            while b not in row:
                state = link[state]
                matched = length[state]
                row = rows[state]
            state = row[b]
            matched += 1
            row = rows[state]
            # a state's longest string counts only if all of it is matched
            for token, size in every[state] if matched == length[state] else shorter[state]:
                before = last[end - size]
                if before < 0:  # the piece begins with the token
                    last[end] = token
                    break
                fit = fits(before * width + token)
                if fit or fit is None and self.compatible(before, token):
                    last[end] = token
                    break
        out = []
        while n:
            out.append(last[n])
            n -= self.lengths[last[n]]
        return tuple(reversed(out))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.piece(piece)
        if len(self) >= CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 256:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        parts = self.special.split(text) if self.special else [text]
        out: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part])
            else:
                out += chain.from_iterable(map(self.__getitem__, PIECES.findall(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of the ids and of the decoded text; with_ids adds ids, decoded.

    Nothing is shuffled. ``path`` must exist on every executor, as the installed vocabulary files do. Null texts count
    as empty: no ids, an empty decoded text. Repeated rows give repeated results; other columns are left out.
    Texts of any length are encoded whole. No two encodings tie: each prefix has one last token.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        sha = hashlib.sha256
        for batch in batches:
            at = 0
            for part in runs(batch.column("text"), 2_000_000):
                n, a, b, all_ids, decoded = [], [], [], [], []
                for text in part:
                    ids = coder.encode(text or "")
                    back = coder.decode(ids)
                    n.append(len(ids))
                    a.append(sha(",".join(map(coder.text.__getitem__, ids)).encode()).hexdigest())
                    b.append(sha(back.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
                        decoded.append(back)
                columns = [batch.column("doc_id").slice(at, len(part)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(part)

    return shared.slim(docs, "doc_id", "text").mapInArrow(shared.tidy(run), SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of the text they decode to."""
    return encode_documents(shared.table(spark, sf_dir, "documents"))
