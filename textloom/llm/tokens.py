"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links; each link knows how many pieces are done when it is taken. One pass over
a word's bytes adds these numbers up, which gives the number of greedy longest-match pieces without building any.
"""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, strings

_WORD = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_END = 256


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceCounter:
    """Counts greedy longest-match pieces of words over ``pieces``: sequences of bytes, or of bytes and the word end."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        # Node 0 is the start of a piece. goto is keyed by node * 257 + symbol.
        goto: dict[int, int] = {}
        parent, symbol, whole = [0], [0], [False]
        for piece in pieces:
            node = 0
            for s in piece:
                key = node * 257 + s
                if (to := goto.get(key)) is None:
                    goto[key] = to = len(parent)
                    parent.append(node), symbol.append(s), whole.append(False)
                node = to
            if piece:
                whole[node] = True
        self.goto, self.fail, self.popped = goto, [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=self._depths(parent).__getitem__):
            if whole[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            n, node = self.popped[parent[v]], self.fail[parent[v]]
            while node >= 0 and (node * 257 + symbol[v]) not in goto:
                n, node = n + self.popped[node], self.fail[node]
            if node >= 0:
                self.fail[v], self.popped[v] = goto[node * 257 + symbol[v]], n

    @staticmethod
    def _depths(parent: list[int]) -> list[int]:
        depth = [0] * len(parent)
        for v in range(1, len(parent)):  # a parent comes before its children
            depth[v] = depth[parent[v]] + 1
        return depth

    def count(self, symbols: list[int] | bytes) -> int:
        """Pieces of one word; 1 if it cannot be cut into pieces, as the unknown piece then stands for it."""
        goto, fail, popped, node, n = self.goto, self.fail, self.popped, 0, 0
        for s in symbols:
            while (to := goto.get(node * 257 + s)) is None:
                n, node = n + popped[node], fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n, node = n + popped[node], fail[node]
            if node < 0:
                return 1
        return n


class WordCounts(dict):
    """Counts of words seen lately; never more than ``most`` of them."""

    def __init__(self, counter: PieceCounter, most: int = 400_000):
        super().__init__()
        self.counter, self.most = counter, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = self.counter.count([*word.encode(), _END])
        return n


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file with word ends."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    chars, out = byte_of_char(), []
    for piece in vocab:
        body, end = (piece[:-4], [_END]) if piece.endswith("</w>") else (piece, [])
        if all(c in chars for c in body):
            out.append((*(chars[c] for c in body), *end))
    return out


@functools.lru_cache(2)
def _counts(path: str) -> WordCounts:
    return WordCounts(PieceCounter(vocabulary(path)))


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, single digits, and runs of other characters that are not white space."""
    return _WORD.findall(text.lower())


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every text, over the vocabulary in ``path`` (default: word_bpe_49k.json of public_tokenizers).

    Null or empty text: 0 and 0. Rows with the same or a null ``doc_id`` are counted each for itself. An empty table
    gives an empty result. Texts of any length are counted whole.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def count(batch: pa.RecordBatch) -> dict:
        counts = _counts(path)
        each = [words(t) for t in strings(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(w) for w in each], "n_tokens": [sum(map(counts.__getitem__, w)) for w in each]}

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(text, count, "doc_id long, n_words long, n_tokens long")
