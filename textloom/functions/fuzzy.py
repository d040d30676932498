"""Similarity of two texts: the share of what matching blocks cover. SQL has no equal, so tasks work on arrays of many pairs at once.

The longest block that two texts share (the first one in the first text, then in the second) splits both, and what is
left of it and right of it is split again, until nothing is shared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: In a second text of so many characters, one that makes up more than a hundredth (and one) of it begins no block; a fixed value.
LONG = 200
#: Most cells of one array.
CELLS = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _seeds(codes: np.ndarray) -> np.ndarray:
    """Which characters of a second text may begin a block."""
    if len(codes) < LONG:
        return np.ones(len(codes), bool)
    values, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    return (n <= len(codes) // 100 + 1)[at]


def _padded(parts: list[np.ndarray], fill: int, kind: type) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, kind)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


def _longest(a: list[np.ndarray], b: list[np.ndarray], seeds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin in a, begin in b and length of the longest block of each pair; the length is 0 where there is none."""
    x, y, seed = _padded(a, 0xFFFFFFFF, np.uint32), _padded(b, 0xFFFFFFFE, np.uint32), _padded(seeds, False, bool)
    n = len(a)
    i, j, k = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    run = np.zeros((n, y.shape[1] + 1), np.int32)
    rows = np.arange(n)
    for at in range(x.shape[1]):
        longer = np.zeros_like(run)
        longer[:, 1:] = (run[:, :-1] + 1) * ((x[:, at : at + 1] == y) & seed)
        end = longer.argmax(1)
        size = longer[rows, end]
        new = size > k
        k[new], i[new], j[new] = size[new], at + 1 - size[new], end[new] - size[new]
        run = longer
    if not all(s.all() for s in seeds):  # blocks grow over characters that begin none
        most_a, most_b = np.array([len(p) for p in a]), np.array([len(p) for p in b])
        while (grow := (i > 0) & (j > 0) & (x[rows, i - 1] == y[rows, j - 1])).any():
            i, j, k = i - grow, j - grow, k + grow
        while (grow := (i + k < most_a) & (j + k < most_b) & (x[rows, np.minimum(i + k, x.shape[1] - 1)] == y[rows, np.minimum(j + k, y.shape[1] - 1)])).any():
            k = k + grow
    return i, j, k


def matched(first: list[str], second: list[str]) -> np.ndarray:
    """How many characters the matching blocks of each pair of texts cover."""
    a, b = [_codes(t) for t in first], [_codes(t) for t in second]
    seeds, total = [_seeds(t) for t in b], np.zeros(len(first), np.int64)
    todo = [(p, 0, len(a[p]), 0, len(b[p])) for p in range(len(first)) if len(a[p]) and len(b[p])]
    while todo:
        todo.sort(key=lambda r: r[4] - r[3])
        more, at = [], 0
        while at < len(todo):
            to, wide = at, 1
            while to < len(todo) and (to - at) * (wide := todo[to][4] - todo[to][3] + 1) < CELLS:
                to += 1
            some = todo[at : max(to, at + 1)]
            i, j, k = _longest([a[p][al:ah] for p, al, ah, _, _ in some], [b[p][bl:bh] for p, _, _, bl, bh in some], [seeds[p][bl:bh] for p, _, _, bl, bh in some])
            for (p, al, ah, bl, bh), di, dj, n in zip(some, i.tolist(), j.tolist(), k.tolist(), strict=True):
                if n:
                    total[p] += n
                    if di and dj:
                        more.append((p, al, al + di, bl, bl + dj))
                    if al + di + n < ah and bl + dj + n < bh:
                        more.append((p, al + di + n, ah, bl + dj + n, bh))
            at += len(some)
        todo = more
    return total


def ratios_of(first: list[str], second: list[str]) -> np.ndarray:
    """Twice the matched characters over all characters of each pair; 0 if one text is empty."""
    both = np.array([len(x) + len(y) if x and y else 0 for x, y in zip(first, second, strict=True)])
    return np.where(both > 0, 2.0 * matched(first, second) / np.maximum(both, 1), 0.0)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios_of(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Twice the length of the matching blocks over the total length; 0 if one text is empty or null."""
    return _ratio(a, b)


def bound(a: Column, b: Column) -> Column:
    """What the ratio cannot exceed, from the lengths alone: lets pairs be left out before ``ratio`` runs."""
    return F.coalesce(2.0 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(0.0))


@F.pandas_udf(ArrayType(DoubleType()))
def _ratios(a: pd.Series, many: pd.Series) -> pd.Series:
    each = [list(m) if m is not None else [] for m in many]
    flat = ratios_of([x or "" for x, m in zip(a, each, strict=True) for _ in m], [y or "" for m in each for y in m])
    ends = np.cumsum([len(m) for m in each])
    return pd.Series([flat[e - len(m) : e].tolist() for e, m in zip(ends, each, strict=True)])


def ratios(a: Column, many: Column) -> Column:
    """``ratio`` of a text with each of an array."""
    return _ratios(a, many)
