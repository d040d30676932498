"""Removal of byte strings that repeat across documents, by a hash-compared suffix sort.

Every 50-byte window has an anchor: of the 20-byte grams in it, the leftmost of the least frequent class, and there of
the smallest hash. Equal windows have equal anchors at the same place in them, so anchors (one in about 16 bytes) bring
all equal windows together:

0. ``gram_classes``: a sketch of how often grams occur. A frequent gram is an anchor only of windows that have nothing
   rarer, which are inside frequent text and so alike; the windows around it, which differ, have rarer anchors.
1. ``_anchor_rows``: the anchors of every document, bucketed by hash; ``_shared_rows`` tells each document which of
   its anchors other documents have too.
2. ``_context_rows``: the bytes around shared anchors, that is, all windows that have this anchor; ``_span_rows``
   sorts the windows of a bucket as suffixes. Two suffixes are compared through prefix polynomial hashes: a binary
   search finds their common extension and the next byte decides. Runs of suffixes with 50 bytes in common are equal
   windows (the bytes are compared, too), and all of them that start in a document other than the smallest go.
3. ``_apply``: the union of the windows that go is cut out of each text.

What a task has seen twice is settled there and only one representative travels on, so a passage that very many
documents share reaches its bucket once for each task, not once for each document.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import frequency_sketch, mixed, utf8

GRAM = 20
#: Bytes of text that one numpy pass handles, anchors that a task gathers before it sends them.
SLICE_BYTES, FLUSH_ANCHORS = 1 << 20, 1 << 20
#: Bytes of text for each bucket and each block of documents; bytes of contexts that are sorted at once (a pass takes
#: about a hundred times as much memory).
BUCKET_BYTES, SORT_BYTES = 8 << 20, 1 << 19
_POS = np.uint64(22)
#: Counters of the sketch of grams; a gram is frequent from so many times the average count on. Classes take 5 bits.
CELLS, FREQUENT, CLASS_BITS = 1 << 21, 4, 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_U64 = np.uint64


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def _joined(parts: list[list[np.ndarray]], kinds: tuple[str, ...]) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


class PrefixHashes:
    """Polynomial hashes of all substrings of a buffer, from those of its prefixes."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        power, self.inverse = np.full(n + 1, _BASE), np.full(n + 1, _BASE_INVERSE)
        power[0] = self.inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.prefix = np.zeros(n + 1, _U64)
        np.cumsum(_BYTE[buffer] * power[:n], out=self.prefix[1:])
        self.buffer = buffer

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, ``most`` at most: a binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        for _ in range(most.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low


def suffix_order(hashes: PrefixHashes, start: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The suffixes ``start`` ordered by group (given in order) and then by their first ``most`` bytes.

    A bottom-up mergesort of all groups at once: at each level every suffix looks up its place in the run beside its
    own by binary search, and each comparison is one search for a common extension.
    """
    n = len(start)
    order = np.arange(n)
    if not n:
        return order
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    begin, size = np.repeat(first, size), np.repeat(size, size)
    inside = np.arange(n) - begin
    run = 1
    while run < size.max():
        mine = inside // run
        other = mine ^ 1
        length = np.clip(size - other * run, 0, run)
        at = np.flatnonzero(length > 0)
        left = (mine[at] & 1) == 0
        low, high = np.zeros(len(at), np.int64), length[at].copy()
        base, own = begin[at] + other[at] * run, start[order[at]]
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) >> 1
            rival = start[order[base[k] + mid]]
            shared = hashes.common(own[k], rival, most)
            a, b = hashes.buffer[np.minimum(own[k] + shared, len(hashes.buffer) - 1)], hashes.buffer[np.minimum(rival + shared, len(hashes.buffer) - 1)]
            equal = shared == most
            before = np.where(equal, ~left[k], b < a)  # the rival comes before this suffix
            low[k], high[k] = np.where(before, mid + 1, low[k]), np.where(before, high[k], mid)
        to = np.arange(n)
        to[at] = begin[at] + np.minimum(mine[at], other[at]) * run + (inside[at] - mine[at] * run) + low
        placed = np.empty(n, np.int64)
        placed[to] = order
        order = placed
        run *= 2
    return order


def gram_classes(docs: DataFrame, window: int) -> np.ndarray:
    """A class for each cell of gram hashes: 0, or one more for each doubling from FREQUENT times the average count of a cell on."""

    def grams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in _text_slices(utf8(batch.column("text"))):
            raw = b"".join(part[1])
            if len(raw) >= window:
                yield _grams(PrefixHashes(np.frombuffer(raw, np.uint8)))

    counts = frequency_sketch(docs.select("text"), CELLS, grams)
    times = counts / (FREQUENT * max(float(counts.mean()), 1.0))
    return np.clip(np.floor(np.log2(np.maximum(times, 0.5))) + 1, 0, (1 << CLASS_BITS) - 1).astype(np.uint8)


def _grams(hashes: PrefixHashes) -> np.ndarray:
    """The hash of the gram at each place, across the ends of texts, too: those are in no window."""
    n = len(hashes.buffer)
    return mixed((hashes.prefix[GRAM:] - hashes.prefix[: n - GRAM + 1]) * hashes.inverse[: n - GRAM + 1])


def _text_slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= SLICE_BYTES):
            total += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def anchors(texts: list[bytes], window: int, classes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of ``texts``: (prefix hashes, first text, text of each anchor, its place, first and last window that has it), places in the slice."""
    for at, part in _text_slices(texts):
        for found in _anchors_of(part, window, classes):
            yield found[0], at, *found[1:]


def _anchors_of(texts: list[bytes], window: int, classes: np.ndarray) -> Iterator[tuple]:
    raw = b"".join(texts)
    n, wide = len(raw), window - GRAM + 1
    if n < window:
        return
    hashes = PrefixHashes(np.frombuffer(raw, np.uint8))
    gram = _grams(hashes)
    # The class fills the high bits. The place fills the low ones, so that the leftmost of equal grams is the smallest;
    # texts of over 4 MB stand alone in their slice and take more bits.
    bits, high = _U64(max(int(_POS), n.bit_length())), _U64(64 - CLASS_BITS)
    key = (classes[gram & _U64(CELLS - 1)].astype(_U64) << high) | (gram >> _U64(CLASS_BITS) >> bits << bits) | np.arange(len(gram), dtype=_U64)
    step = 1
    while step * 2 <= wide:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < wide:
        key = np.minimum(key[: len(key) - (wide - step)], key[wide - step :])
    place = (key & ((_U64(1) << bits) - _U64(1))).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(place)]
    ok = np.arange(len(place)) + window <= ends[text]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return
    place, text = place[starts], text[starts]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    yield hashes, gram[place[new]], text[new], place[new], starts[new], starts[last]


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
        yield int(key[order[a]]), order[a:b]


def _block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(_U64) + _U64(1)) % _U64(blocks)).astype(np.int32)


def _bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (gram % _U64(buckets)).astype(np.int32)


_ROW = pa.schema([("key", pa.int32()), ("salt", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
_ROW_DDL = "key int, salt int, n int, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ROW)], schema=_ROW)


def _anchor_rows(window: int, buckets: int, classes: Broadcast):
    """Anchors by bucket. Salt 0: of each gram that one document of the task has, or a representative (flagged) of those
    that several have. Other salts, spread: the anchors already known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, docs, held = [], [], 0

        def send() -> pa.RecordBatch:
            gram, doc = np.concatenate(grams), np.concatenate(docs)
            order = np.lexsort((doc, gram))
            gram, doc = gram[order], doc[order]
            once = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]
            gram, doc = gram[once], doc[once]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            many = np.diff(np.r_[first, len(gram)]) > 1
            rows = []
            for b, i in _by(_bucket_of(gram[first], buckets)):
                o = first[i][np.argsort(doc[first[i]], kind="stable")]
                rows.append((b, 0, len(o), _pack(doc[o], gram[o], np.repeat(many, np.diff(np.r_[first, len(gram)]))[o].astype(np.uint8))))
            known = np.repeat(many, np.diff(np.r_[first, len(gram)]))
            if known.any():
                gram, doc = gram[known], doc[known]
                for b, i in _by(_block_of(doc, buckets)):
                    rows.append((b, 1, len(i), _pack(doc[i], gram[i], np.ones(len(i), np.uint8))))
            grams.clear(), docs.clear()
            return _rows(rows)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for _, at, gram, text, *_ in anchors(utf8(batch.column("text")), window, classes.value):
                grams.append(gram), docs.append(ids[at + text])
                held += len(gram)
                if held >= FLUSH_ANCHORS:
                    yield send()
                    held = 0
        if grams:
            yield send()

    return run


def _shared_rows(blocks: int):
    """Of one bucket: the anchors that several documents have, by block of documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpack(b, n, "<i8", "<u8", "u1") for n, b in zip(table["n"].to_pylist(), table["blob"].to_pylist(), strict=True)]
        doc, gram, many = _joined(parts, ("<i8", "<u8", "u1"))
        if key[1].as_py() == 0 and len(doc):
            order = np.lexsort((doc, gram))
            doc, gram, many = doc[order], gram[order], many[order]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            n = np.diff(np.r_[first, len(gram)])
            several = (doc[first] != doc[first + n - 1]) | (np.maximum.reduceat(many, first) > 0)
            keep = np.repeat(several, n)
            doc, gram = doc[keep], gram[keep]
        rows = [(b, 0, len(i), _pack(doc[i], gram[i])) for b, i in _by(_block_of(doc, blocks))]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _text_rows(blocks: int):
    """Documents by block, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), utf8(batch.column("text"))
            size = np.array([len(t) for t in texts], np.int64)
            rows = []
            for b, i in _by(_block_of(ids, blocks)):
                head = ids[i].astype("<i8").tobytes() + size[i].tobytes()
                rows.append((b, 0, len(i), zstandard.compress(head + b"".join(texts[j] for j in i), 3)))
            if rows:
                yield _rows(rows)

    return run


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids, texts = [np.zeros(0, np.int64)], []
    for n, blob in zip(table["n"].to_pylist(), table["blob"].to_pylist(), strict=True):
        raw = zstandard.decompress(blob)
        ids.append(np.frombuffer(raw, "<i8", n))
        at = 16 * n
        for size in np.frombuffer(raw, "<i8", n, 8 * n):
            texts.append(raw[at : at + size])
            at += size
    return np.concatenate(ids), texts


_SPAN = ("<i8", "<u4", "<u4", "<u4")
_CONTEXT = ("<i8", "<u8", "<u4", "<u4", "u1", "u1")


def _context_rows(window: int, buckets: int, classes: Broadcast):
    """Of one block: the bytes around shared anchors, by bucket (salt 0), and the spans that the block has settled itself (salt 1)."""

    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        ids, texts = _texts(docs)
        parts = [_unpack(b, n, "<i8", "<u8") for n, b in zip(shared["n"].to_pylist(), shared["blob"].to_pylist(), strict=True)]
        doc, gram = _joined(parts, ("<i8", "<u8"))
        if not len(doc) or not texts:
            return _ROW.empty_table()
        wanted = np.unique(mixed(doc.view(_U64)) ^ gram)
        tags = np.array([zlib.crc32(t) for t in texts], np.uint32)
        found, context = [], []
        for hashes, at, gram, text, place, low, high in anchors(texts, window, classes.value):
            pair = mixed(ids[at + text].view(_U64)) ^ gram
            where = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            i = np.flatnonzero(wanted[where] == pair)
            if not len(i):
                continue
            begin = np.r_[0, np.cumsum([len(t) for t in texts[at : at + int(text[-1]) + 1]])][text[i]]
            n = high[i] - low[i] + window
            found.append([ids[at + text[i]], gram[i], tags[at + text[i]], (low[i] - begin).astype(np.uint32), (place[i] - low[i]).astype(np.uint8), n, mixed(hashes.of(low[i], n) + mixed(((place[i] - low[i]) << 8 | n).astype(_U64)))])
            many = np.repeat(low[i] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            context.append(hashes.buffer[many])
        if not found:
            return _ROW.empty_table()
        doc, gram, tag, low, left, n, whole = (np.concatenate([f[k] for f in found]) for k in range(7))
        context = np.concatenate(context)
        begin = np.r_[0, np.cumsum(n)[:-1]]
        order = np.lexsort((doc, whole))
        first = np.flatnonzero(np.r_[True, whole[order][1:] != whole[order][:-1]])
        size = np.diff(np.r_[first, len(order)])
        head = np.repeat(order[first], size)  # of the smallest document that has these bytes here
        later = doc[order] > doc[head]
        # Equal hashes are settled here only if the bytes are equal.
        later[later] = _equal(context, begin[order][later], begin[head][later], n[order][later], n[head][later])
        gone = np.zeros(len(doc), bool)
        gone[order[later]] = True
        rows = [(b, 1, len(i), _pack(doc[i], tag[i], low[i], (low[i] + n[i]).astype(np.uint32))) for b, i in ((b, np.flatnonzero(gone)[j]) for b, j in _by(_block_of(doc[gone], buckets)))]
        left_over = np.flatnonzero(~gone)
        for b, j in _by(_bucket_of(gram[left_over], buckets)):
            i = left_over[j]
            i = i[np.argsort(gram[i], kind="stable")]  # like beside like packs better
            many = np.repeat(begin[i] - np.r_[0, np.cumsum(n[i])[:-1]], n[i]) + np.arange(n[i].sum())
            rows.append((b, 0, len(i), _pack(doc[i], gram[i], tag[i], low[i], left[i], n[i].astype(np.uint8), context[many])))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _equal(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the strings of lengths n and m at a and b are the same bytes."""
    same = n == m
    for k in range(int(n.max()) if len(n) else 0):
        i = np.flatnonzero(same & (k < n))
        same[i] = buffer[a[i] + k] == buffer[b[i] + k]
    return same


def _span_rows(window: int, blocks: int):
    """Of one bucket: spans that go, by block of documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        spans: list[list[np.ndarray]] = []
        counts, blobs = table["n"].to_pylist(), table["blob"].to_pylist()
        if key[1].as_py():
            spans = [_unpack(b, n, *_SPAN) for n, b in zip(counts, blobs, strict=True)]
        else:
            parts, context = [], []
            for n, blob in zip(counts, blobs, strict=True):
                raw = zstandard.decompress(blob)
                at, part = 0, []
                for kind in _CONTEXT:
                    part.append(np.frombuffer(raw, kind, n, at))
                    at += np.dtype(kind).itemsize * n
                parts.append(part), context.append(np.frombuffer(raw, np.uint8, -1, at))
            columns, context = _joined(parts, _CONTEXT), np.concatenate(context or [np.zeros(0, np.uint8)])
            del parts, counts, blobs
            for i, own in _slices(columns[1], columns[5], context):
                doc, gram, tag, low, left, n = (c[i] for c in columns)
                spans += _sorted_spans(window, doc, gram, tag, low, left.astype(np.int64), n.astype(np.int64), own)
        doc, tag, low, high = _joined(spans, _SPAN)
        rows = [(b, 0, len(i), _pack(doc[i], tag[i], low[i], high[i])) for b, i in _by(_block_of(doc, blocks))]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _slices(gram: np.ndarray, n: np.ndarray, context: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records of whole anchor grams, about SORT_BYTES of context at a time, and their contexts."""
    n = n.astype(np.int64)
    begin = np.r_[0, np.cumsum(n)[:-1]]
    order = np.argsort(gram, kind="stable")
    ends = np.cumsum(n[order])
    cuts = np.append(np.flatnonzero(gram[order][1:] != gram[order][:-1]) + 1, len(order))  # ends of grams
    full, at = ends[cuts - 1] if len(order) else ends, 0
    while at < len(order):
        most = ends[at] - n[order[at]] + SORT_BYTES
        k = max(int(np.searchsorted(full, most, "right")) - 1, int(np.searchsorted(cuts, at, "right")))
        i = order[at : cuts[k]]
        at = int(cuts[k])
        own = n[i]
        yield i, context[np.repeat(begin[i] - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum())]


def _sorted_spans(window: int, doc, gram, tag, low, left, n, context) -> list[list[np.ndarray]]:
    begin = np.r_[0, np.cumsum(n)[:-1]]
    hashes = PrefixHashes(context)
    # Contexts that are equal as a whole: all their windows go, but for the smallest document.
    whole = mixed(hashes.of(begin, n) + mixed((left << 8 | n).astype(_U64)) + gram)
    order = np.lexsort((doc, whole))
    first = np.flatnonzero(np.r_[True, whole[order][1:] != whole[order][:-1]])
    head = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
    later = doc[order] > doc[head]
    later[later] = _equal(context, begin[order][later], begin[head][later], n[order][later], n[head][later])
    gone = np.zeros(len(doc), bool)
    gone[order[later]] = True
    i = np.flatnonzero(gone)
    out = [[doc[i], tag[i], low[i], (low[i] + n[i]).astype(np.uint32)]]
    # The windows of the others, as suffixes; a window that has no equal by its hash needs no sorting.
    rest = np.flatnonzero(~gone)
    if not len(rest):
        return out
    k = n[rest] - window + 1
    record = np.repeat(rest, k)
    offset = np.arange(len(record)) - np.repeat(np.r_[0, np.cumsum(k)[:-1]], k)
    start = begin[record] + offset
    mark = mixed(hashes.of(start, window) + gram[record])
    order = np.argsort(mark, kind="stable")
    twin = mark[order][1:] == mark[order][:-1]
    i = order[np.r_[False, twin] | np.r_[twin, False]]
    if not len(i):
        return out
    # Groups for the sort: windows whose anchor is the same gram at the same place.
    group = mixed(gram[record[i]] + mixed((left[record[i]] - offset[i]).astype(_U64)))
    i = i[np.argsort(group, kind="stable")]
    record, offset, start = record[i], offset[i], start[i]
    group = mixed(gram[record] + mixed((left[record] - offset).astype(_U64)))
    order = suffix_order(hashes, start, group, window)
    a, b = start[order[:-1]], start[order[1:]]
    same = (group[order[1:]] == group[order[:-1]]) & (hashes.common(a, b, window) == window)
    full = np.full(len(a), window)
    same[same] = _equal(context, a[same], b[same], full[same], full[same])
    first = np.flatnonzero(np.r_[True, ~same])
    least = np.repeat(np.minimum.reduceat(doc[record[order]], first), np.diff(np.r_[first, len(order)]))
    i = order[doc[record[order]] > least]
    at = low[record[i]] + offset[i].astype(np.uint32)
    # Windows that follow on each other become one span.
    sort = np.lexsort((at, tag[record[i]], doc[record[i]]))
    r, at = record[i][sort], at[sort]
    new = np.flatnonzero(np.r_[True, (doc[r][1:] != doc[r][:-1]) | (tag[r][1:] != tag[r][:-1]) | (at[1:] > at[:-1] + np.uint32(1))]) if len(r) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(r)] - 1 if len(r) else new
    out.append([doc[r][new], tag[r][new], at[new], at[last] + np.uint32(window)])
    return out


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_out(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs removed, and the rest."""
    if not len(low):
        return 0, 0, text
    order = np.argsort(low, kind="stable")
    low, high = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64))
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    begin, end = low[new], high[np.r_[new[1:], len(low)] - 1]
    cuts = zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)
    return int((end - begin).sum()), len(begin), b"".join(text[a:b] for a, b in cuts)


def _apply(with_text: bool):
    """Of one block: every document without its spans."""

    def run(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        ids, texts = _texts(docs)
        parts = [_unpack(b, n, *_SPAN) for n, b in zip(spans["n"].to_pylist(), spans["blob"].to_pylist(), strict=True)]
        doc, tag, low, high = _joined(parts, _SPAN)
        order = np.lexsort((tag, doc))
        doc, tag, low, high = doc[order], tag[order], low[order], high[order]
        rows = []
        for d, text in zip(ids, texts, strict=True):
            a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
            t = np.uint32(zlib.crc32(text)) if a < b else 0
            a, b = a + np.searchsorted(tag[a:b], t), a + np.searchsorted(tag[a:b], t, "right")
            removed, runs, kept = cut_out(text, low[a:b], high[a:b])
            rows.append((int(d), len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left) of every text.

    Each byte that is covered by a ``window``-byte string which also starts in a document with a smaller ``doc_id``
    goes; strings are judged on the input and never cross documents.

    Null or empty text: 0 bytes, nothing removed. Texts below ``window`` bytes stay whole. Rows that repeat a
    ``doc_id`` do not count as smaller than each other. Rows with a null ``doc_id`` stay whole and remove nothing.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known, lost = text.where("doc_id IS NOT NULL"), text.where("doc_id IS NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    classes = docs.sparkSession.sparkContext.broadcast(gram_classes(known, window))
    shared = known.mapInArrow(_anchor_rows(window, parts, classes), _ROW_DDL).groupBy("key", "salt").applyInArrow(_shared_rows(parts), _ROW_DDL)
    blocks = known.mapInArrow(_text_rows(parts), _ROW_DDL)
    contexts = blocks.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(_context_rows(window, parts, classes), _ROW_DDL)
    spans = contexts.groupBy("key", "salt").applyInArrow(_span_rows(window, parts), _ROW_DDL)
    out = blocks.groupBy("key").cogroup(spans.groupBy("key")).applyInArrow(_apply(with_text), _RESULT_DDL)
    whole = lost.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), (F.col("text").cast("binary") if with_text else F.lit(None).cast("binary")).alias("kept"))
    out = out.unionByName(whole)
    return out if with_text else out.drop("kept")
