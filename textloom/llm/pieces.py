"""SentencePiece encoding of merge type by backtracking, and decoding.

A merge encoder joins the two neighbours whose union scores best until none can be joined. The same ids come out without
any merging: an Aho-Corasick automaton over the vocabulary tells the longest piece from each place; going from left to
right, a piece may follow another if merging both texts again would not have joined anything across their border; if
no piece fits at a place, the place is marked as failed in a bitfield and the piece before it becomes shorter.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, strings

SPACE = "▁"
#: What the library writes for an id of the unknown piece; a fixed value.
_UNKNOWN = " ⁇ "


class Vocabulary:
    """A merge-type vocabulary with byte pieces, as the library reads it from ``path``.

    The text must go in unchanged but for a space put before it and spaces written as U+2581; other models are refused,
    and so are vocabularies in which a union can score better than one of its halves, as merges could then not be taken
    back in the order of their scores.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  Ａ ﬁ") != f"{SPACE * 3}Ａ{SPACE}ﬁ":
            raise ValueError("a model that changes texts before it cuts them is not supported")
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a model without byte pieces is not supported")
        self.text = {i: model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.id, self.end_id = {t: i for i, t in self.text.items()}, model.eos_id()
        self._rank(model)
        self._automaton()
        #: No piece goes on with a space after another character, nor over a character that no piece has: texts can be cut there.
        if any(c != SPACE and d == SPACE for t in self.text.values() for c, d in zip(t, t[1:], strict=False)):
            raise ValueError("a piece with a space inside is not supported")
        known = set("".join(self.text.values()))
        line = "" if "\n" in known else "\n"
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + ("|\n" if line else ""))
        self.surface = [b""] * len(ids)
        for i, t in self.text.items():
            self.surface[i] = t.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.surface[model.unk_id()] = _UNKNOWN.encode()
        for i in filter(model.is_control, ids):
            self.surface[i] = b"\xff"  # no UTF-8: it keeps byte pieces before and after it apart
        self.spaced = {i for i, t in self.text.items() if t.startswith(SPACE)}
        self.silent = {i for i in ids if model.is_control(i)}
        self.byte_ids = set(self.bytes.values())

    def _rank(self, model) -> None:
        """Ranks of unions (equal scores share one), and for each piece that merging can reach the halves of its last merge.

        Single characters have rank 0 and no halves.
        """
        order = {s: k + 1 for k, s in enumerate(sorted({model.get_score(i) for i in self.text}, reverse=True))}
        union = {i: order[model.get_score(i)] for i in self.text}
        self.rank, self.halves = dict.fromkeys(self.text, 0), {}
        self.pairs: dict[int, int] = {}
        for i, t in self.text.items():
            for k in range(1, len(t)):
                a, b = self.id.get(t[:k]), self.id.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = union[i]
        for i, t in self.text.items():
            parts, last = [self.id.get(c, -1) for c in t], None
            while len(parts) > 1:
                best = min(((self.pairs[a << 32 | b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a << 32 | b in self.pairs), default=None)
                if best is None:
                    break
                k = best[1]
                last = parts[k], parts[k + 1]
                parts[k : k + 2] = [self.id[self.text[last[0]] + self.text[last[1]]]]
            if parts == [i]:
                self.halves[i] = last
                if last:
                    self.rank[i] = union[i]
        if any(h and max(self.rank[h[0]], self.rank[h[1]]) > self.rank[i] for i, h in self.halves.items()):
            raise ValueError("a union that scores better than its halves is not supported")

    def _automaton(self) -> None:
        """The automaton over all pieces that merging can reach, and for each the next shorter one that it begins with."""
        self.found = ahocorasick.Automaton()
        self.shorter = dict.fromkeys(self.halves, -1)
        for i in self.halves:
            t = self.text[i]
            self.found.add_word(t, (i, len(t) - 1))
            self.shorter[i] = next((j for k in range(len(t) - 1, 0, -1) if (j := self.id.get(t[:k])) in self.halves), -1)
        self.found.make_automaton()
        self.size = {i: len(self.text[i]) for i in self.halves}
        self.fitting: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow piece ``a``: merging the text of both again leaves the border between them alone.

        Merges are taken back, the last one first; of two with equal rank the one on the right came last. Before each
        step the two pieces at the border must not have a union that merging would have taken before what was taken
        back: one on the left goes first at equal rank, one on the right comes after.
        """
        key, rank, halves, pairs, out = a << 32 | b, self.rank, self.halves, self.pairs, None
        limit = 1 << 62  # twice the rank of what was taken back, plus one if that was on the right
        while out is None:
            union = pairs.get(a << 32 | b)
            if union is not None and 2 * union < limit:
                out = False
            elif rank[a] > rank[b]:
                limit, a = 2 * rank[a], halves[a][1]
            elif rank[b]:
                limit, b = 2 * rank[b] + 1, halves[b][0]
            else:
                out = True
        if len(self.fitting) >= 1_000_000:
            self.fitting.clear()
        self.fitting[key] = out
        return out

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part of a text whose spaces are already U+2581."""
        longest = [-1] * len(part)
        for end, (i, back) in self.found.iter(part):  # a longer piece from the same place ends later
            longest[end - back] = i
        if -1 not in longest:
            return self._backtrack(longest, 0, len(part))
        out, at = [], 0
        while at < len(part):
            to = at
            while to < len(part) and longest[to] >= 0:
                to += 1
            out += self._backtrack(longest, at, to) if to > at else []
            if to < len(part):
                out += [self.bytes[b] for b in part[to].encode()]
            at = to + 1
        return out

    def _backtrack(self, longest: list[int], begin: int, end: int) -> list[int]:
        """The pieces of the characters from ``begin`` to ``end``, all of which have a piece of their own."""
        size, shorter, fits, fitting = self.size, self.shorter, self.fits, self.fitting
        out, failed, at, last, piece = [], None, begin, -1, longest[begin]
        while True:
            while piece >= 0:
                to = at + size[piece]
                if failed is None or not failed[(to - begin) >> 3] >> ((to - begin) & 7) & 1:
                    if last < 0 or (known := fitting.get(last << 32 | piece)) or (known is None and fits(last, piece)):
                        break
                piece = shorter[piece]
            else:
                if failed is None:
                    failed = bytearray(((end - begin) >> 3) + 1)
                failed[(at - begin) >> 3] |= 1 << ((at - begin) & 7)
                piece = out.pop()
                at, last = at - size[piece], out[-1] if out else -1
                continue
            out.append(piece)
            if to == end:
                return out
            at, last, piece = to, piece, longest[to]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that encoding puts before it; bytes that are no UTF-8 become U+FFFD one by one."""
        begin, end = 0, len(ids)
        while begin < end and ids[begin] in self.silent:
            begin += 1
        while begin < end and ids[end - 1] in self.silent:
            end -= 1
        ids = ids[begin:end]
        body = b"".join(map(self.surface.__getitem__, ids))
        first = ids[0] if ids else None
        if first in self.spaced:
            body = body[1:]
        try:
            return body.decode()
        except UnicodeDecodeError:
            return "".join(self._decode_runs(ids, first))

    def _decode_runs(self, ids: list[int], first: int | None) -> Iterator[str]:
        """As ``decode``, where some run of byte pieces is no UTF-8 or a control id stands inside."""
        run, started = b"", False
        for i in [*ids, -1]:
            if i in self.byte_ids:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        yield run[:n].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    yield "�"
                run, started = run[n:], True
            if i >= 0 and i not in self.silent:
                text = self.surface[i].decode()
                yield text[1:] if i == first and not started and i in self.spaced else text
                started = True


class Parts(dict):
    """Ids of short parts of texts seen lately, as bytes: at most ``most`` of them, and as many that were seen before those."""

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000):
        super().__init__()
        self.vocabulary, self.most, self.older = vocabulary, most, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("i", self.vocabulary.encode_part(part)).tobytes()
        if len(part) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str, end: bytes) -> np.ndarray:
        """Ids of a whole text, then ``end``. An empty text has none of its own."""
        parts = self.vocabulary.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join(map(self.__getitem__, parts)) + end, np.int32)


@functools.lru_cache(2)
def _parts(path: str) -> Parts:
    return Parts(Vocabulary(path))


def _default(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def encode_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every text, over the model in ``path`` (default: piece_bpe_32k.model of public_tokenizers).

    The ids are those of the library's encoder, with its end id last if asked for. ``decoded`` adds what ``ids`` decode
    to. One map without a shuffle: nothing is kept but parts seen lately, so a lost task is simply run again.

    Null or empty text: just the end id, decoded as the empty text. Rows with the same or a null ``doc_id`` are encoded
    each for itself. An empty table gives an empty result. A text of any length is encoded whole, in memory in
    proportion to it. Other columns play no part.
    """
    path = _default(path)

    def encode(batch: pa.RecordBatch) -> dict:
        parts = _parts(path)
        end = np.array([parts.vocabulary.end_id] if with_end else [], np.int32).tobytes()
        ids = [parts.encode(t, end) for t in strings(batch.column("text"))]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        out = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))}
        return out | ({"decoded": [parts.vocabulary.decode(x.tolist()) for x in ids]} if decoded else {})

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(text, encode, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""), 128)


def decode_pieces(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and decoded: the texts of sequences of ids, as the library's decoder gives them.

    Null or empty ``ids``: the empty text; a null among the ids counts as the unknown piece. Ids that the model does not
    have are an error. Rows with the same or a null ``doc_id`` are decoded each for itself.
    """
    path = _default(path)

    def decode(batch: pa.RecordBatch) -> dict:
        own = _parts(path).vocabulary
        each = batch.column("ids").to_pylist()
        if any(i is not None and not 0 <= i < len(own.surface) for ids in each for i in ids or ()):
            raise ValueError("an id that the model does not have")
        return {"doc_id": batch.column("doc_id"), "decoded": [own.decode([i or 0 for i in ids or ()]) for ids in each]}

    ids = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_rows(ids, decode, "doc_id long, decoded string", 128)
