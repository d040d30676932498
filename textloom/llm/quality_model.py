"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of
features that a text has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, map_rows, utf8
from .quality_rules import base_counts, histograms, shares

WORD_BITS = 14
_MARKS = b".,;:!?'\"()-"
N_STATS = 20


class Rows(NamedTuple):
    """Sparse rows: those of document i are ``at[i]:at[i + 1]``."""

    at: np.ndarray
    index: np.ndarray
    value: np.ndarray


def statistics(text: bytes) -> list[float]:
    """Structure statistics and metadata of a text, each about 0 to 1."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = base_counts(text)
    classes, common, chars = histograms(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    words = text.split()
    per_word = 1 / max(n_words, 1)
    return [
        *(shares(classes) / 1e6),
        1 - common[-1] * per_word,
        min(1.0, word_chars * per_word / 12),
        min(1.0, n_symbols * per_word),
        n_dup_lines / max(len(lines), 1),
        n_repeat * per_word,
        min(1.0, len(set(words)) * per_word),
        min(1.0, math.log1p(n_words) / 12),
        min(1.0, math.log1p(len(lines)) / 8),
        min(1.0, n_words / max(len(lines), 1) / 100),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(len(lines), 1),
        sum(w[:1].isupper() for w in words) * per_word,
        min(1.0, math.log1p(chars) / 14),
    ]


def features(texts: list[bytes], hashes: WordHashes) -> Rows:
    """Word features (tf with square root, unit length) below 2**WORD_BITS, statistics after them."""
    at, index, value = [0], [], []
    first = 1 << WORD_BITS
    for text in texts:
        words = [w for w in (x.strip(_MARKS) for x in text.lower().split()) if w]
        slot, n = np.unique((hashes.of(words) >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        tf = np.sqrt(n.astype(np.float64))
        index.append(np.concatenate([slot, first + np.arange(N_STATS)]))
        value.append(np.concatenate([tf / max(np.sqrt((tf * tf).sum()), 1e-12), statistics(text)]))
        at.append(at[-1] + len(index[-1]))
    return Rows(np.array(at), np.concatenate(index) if index else np.zeros(0, np.int64), np.concatenate(value) if value else np.zeros(0))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def parts(self, x: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the sums of v_if x_i of every row; every row has features."""
        v = self.factors[x.index] * x.value[:, None]
        total = np.add.reduceat(v, x.at[:-1], axis=0)
        squares = np.add.reduceat(v * v, x.at[:-1], axis=0)
        return self.bias + np.add.reduceat(self.linear[x.index] * x.value, x.at[:-1]) + 0.5 * (total * total - squares).sum(1), total

    def scores(self, x: Rows) -> np.ndarray:
        if len(x.at) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.parts(x)[0], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, k: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss of (index, value, label) rows; without rows, a machine that says 0.5."""
    size, rng = (1 << WORD_BITS) + N_STATS, np.random.default_rng(seed)
    m = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, k)))
    if not rows:
        m.factors[:] = 0
        return m
    y = np.array([r[2] for r in rows], float)
    # Both labels weigh alike to half: otherwise rare low quality would hardly count.
    weight = np.where(y == 1, (0.5 / max(y.mean(), 1e-9)) ** 0.5, (0.5 / max(1 - y.mean(), 1e-9)) ** 0.5)
    g0, g1, g2 = 1e-8, np.full(size, 1e-8), np.full((size, k), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            index, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            bounds = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])])
            raw, total = m.parts(Rows(bounds, index, value))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * weight[part] / len(part)
            each = np.repeat(err, np.diff(bounds)) * value
            v = m.factors[index]
            grad_v = each[:, None] * (np.repeat(total, np.diff(bounds), axis=0) - v * value[:, None])
            slots, where = np.unique(index, return_inverse=True)
            d1 = np.bincount(where, each, len(slots)) + decay * m.linear[slots]
            d2 = np.zeros((len(slots), k))
            np.add.at(d2, where, grad_v)
            d2 += decay * m.factors[slots]
            d0 = err.sum()
            g0 += d0 * d0
            g1[slots] += d1 * d1
            g2[slots] += d2 * d2
            m.bias -= rate * d0 / g0**0.5
            m.linear[slots] -= rate * d1 / np.sqrt(g1[slots])
            m.factors[slots] -= rate * d2 / np.sqrt(g2[slots])
    return m


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", sample: int = 8_000) -> FactorisationMachine:
    """A machine learnt from at most ``sample`` labelled rows that aren't held out: those with the smallest hashes of their id.

    The sample of ids is bounded by that parameter, so it is broadcast to the documents; features are made where the
    texts are, and only they come to the driver, some 200 numbers a row. Of rows that repeat an id, one teaches.
    """
    ids = labels.where(~held_out(label_id_col) & F.col(label_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    # The row of the smallest hash, however often an id is repeated: partial sums leave one a task.
    text = text.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))).alias("first")).select("doc_id", "label", "first.text")

    def make(batch: pa.RecordBatch) -> dict:
        x = features(utf8(batch.column("text")), WordHashes())
        cut = list(zip(x.at[:-1], x.at[1:], strict=True))
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "index": [x.index[a:b].astype("<i4").tobytes() for a, b in cut], "value": [x.value[a:b].astype("<f4").tobytes() for a, b in cut]}

    rows = map_rows(text, make, "doc_id long, label int, index binary, value binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["index"], r["value"]))
    return fit([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4").astype(float), r["label"]) for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: label 1 likelier) and predicted (1 from 0.5 on) of every whole text.

    The score depends on the text alone. Labels of held-out rows, null labels and labels without a document teach
    nothing; an id labelled twice counts with its larger label. Null or empty text gets the score of a text without
    words. A null ``doc_id`` gives held_out = false. Without labels every score is 0.5. Rows with the same ``doc_id``
    are scored each for itself. An empty table gives an empty result. Texts of any length are scored whole.
    """
    machine = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    # 2**WORD_BITS rows of 9 numbers, about 1 MB: bounded by the parameters of the machine.
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    hashes: list[WordHashes] = []

    def score(batch: pa.RecordBatch) -> dict:
        if not hashes:
            hashes.append(WordHashes())
        return {"doc_id": batch.column("doc_id"), "score": shared.value.scores(features(utf8(batch.column("text")), hashes[0]))}

    out = map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
