"""Packing by powers of two.

A document's ids are cut into pieces whose lengths are powers of two: as many full sequences as it holds, then the
binary digits of the rest. Every piece is a sequence of its own and shares a bucket with pieces of its length, so no
sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, strings

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
#: Beyond these scripts, character tables of different Unicode versions could cut words differently.
_FAR = re.compile("[^\u0000-\u024f\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u20ac]")
#: One special token of the vocabulary, with its id: fixed values of the file.
_SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Ids of the vocabulary in ``path``, as ``tokenizers`` gives them.

    With the same vocabulary as ranks in ``ranks``, texts of common scripts go through the faster ``tiktoken``, whose
    ids are the same; any other text, and every text where there are no ranks, goes through ``tokenizers``.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.full, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=_SPECIAL)

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not _FAR.search(text):
            return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


def cut(n: int, most: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: ``most`` (a power of two) again and again, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def write_bucketed(packed: DataFrame, path: str) -> None:
    """Pieces of equal length in folders of their own, so that a reader takes batches of one shape from each."""
    packed.write.partitionBy("bucket").parquet(path)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks: str | None = None, most: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked for, ids.

    ``path`` is a vocabulary file for ``tokenizers`` (default: byte_bpe_50k.json of public_tokenizers), ``most`` the
    length of a full sequence, ``end_id`` the id that ends each document. ``bucket`` is the binary logarithm of the
    length: ``write_bucketed`` lays equal lengths together. A piece is a sequence, so ``offset``
    is 0 and ``sequence_id`` numbers the pieces, without a shuffle; it is unique within a result.

    Null or empty text: the one piece that holds ``end_id``. Rows with the same or a null ``doc_id`` are packed each
    for itself. An empty table gives an empty result. A text of any length is encoded whole.
    """
    assert most & (most - 1) == 0, "a full sequence must be a power of two long"
    if path is None:
        import public_tokenizers

        path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")

    def pieces(batch: pa.RecordBatch) -> dict:
        own, doc, start, length, crc, total, ids = encoder(path, ranks), [], [], [], [], [], []
        for d, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
            got = np.append(own.ids(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
            at = 0
            for n in cut(len(got), most):
                piece = got[at : at + n]
                doc.append(d), start.append(at), length.append(n), crc.append(zlib.crc32(piece.tobytes())), total.append(len(got))
                ids.append(piece.view(np.int32) if with_ids else None)
                at += n
        return {"doc_id": doc, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "ids": ids}

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = map_rows(text, pieces, _SCHEMA, 256).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"), "ids")
    return out if with_ids else out.drop("ids")
