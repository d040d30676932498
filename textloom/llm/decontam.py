"""Benchmark decontamination: rare n-gram seeds join texts to test items, then Smith-Waterman alignment.

An alignment of m matches and e errors has at least m - e - 1 pairs of matches in a row. So of an item's P word pairs,
whatever scores enough shares a number L with the document, and any P - L + 1 of them hold one that it shares. The
item's seeds are those P - L + 1 that are rarest in the corpus: no alignment is lost, however frequent a passage is. The
score of the best local alignment finds exact, edited and paraphrased copies alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import BROADCAST_BYTES, Scratch, WordHashes, map_rows, mixed

_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\t\n\r\x0b\x0c"
_SPACES = bytes.maketrans(_PUNCTUATION.encode(), b" " * len(_PUNCTUATION))
#: Words of a passage between its first and last seed, unless an item reaches further.
_PASSAGE_WORDS = 4096
#: Bytes of a text that are cut into words at once, and of passages that a task holds before it hands them on.
_SLICE_BYTES = 1 << 20
#: Numbers that a task of the count holds before it hands them on.
_HELD = 1 << 20


def cleaned(text: str) -> bytes:
    """Lower-cased UTF-8 with spaces in place of ASCII punctuation and white space."""
    return text.lower().encode("utf-8", "replace").translate(_SPACES)


def words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return cleaned(text).split()


def bounds(size: int, least: float) -> tuple[int, int, int, int]:
    """Of an item of ``size`` words: the lowest score that counts, the words that its alignments span at most, the words in an n-gram, and how many of these it must share."""
    # A little less, as rounding must not lose a score that is just enough.
    wanted = max(int(np.ceil(size * least - 1e-6)), 1)
    n = 1 if wanted < 2 else 2  # a score of 1 needs no pair: then single words are counted
    return wanted, size + max(size - wanted, 1), n, wanted - (n - 1)


class Items:
    """Test items as word numbers, with what their alignments need at least."""

    def __init__(self, rows: list[tuple[int, str]], n: int, least: float):
        self.vocabulary, self.ids, self.words = {}, [], []
        for item, text in sorted(rows):
            w = words(text)
            if len(w) >= n:
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64))
        self.bounds = [bounds(len(w), least) for w in self.words]
        self.grams = [self.keys(w, b[2]) for w, b in zip(self.words, self.bounds, strict=True)]

    def number(self, text: str | bytes) -> np.ndarray:
        w = text.split() if isinstance(text, bytes) else words(text)
        get = self.vocabulary.get
        return np.fromiter((get(x, -1) for x in w), np.int64, len(w))

    def keys(self, w: np.ndarray, n: int) -> np.ndarray:
        """A number for each n-gram; -1 where it has a word that no item has."""
        if n == 1:
            return w
        return np.where((w[:-1] >= 0) & (w[1:] >= 0), w[:-1] * len(self.vocabulary) + w[1:], -1)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences (match 1, mismatch and gap -1), and the first place in b where it ends (exclusive)."""
    n = len(b)
    row, step = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = row
    for word in a:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == word, 1, -1))
        row = np.maximum.accumulate(new + step) - step  # gaps in a: each costs one
        best = np.maximum(best, row)
    end = int(best.argmax())
    return int(best[end]), end


def _merged(begin: np.ndarray, end: np.ndarray, cut: np.ndarray | bool = False) -> np.ndarray:
    """Where runs of overlapping spans begin, of spans sorted by their begin; a new one begins wherever ``cut`` holds, too."""
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > np.maximum.accumulate(end)[:-1]
    return np.flatnonzero(fresh | cut)


def regions(doc: np.ndarray, items: Items, item: int) -> Iterator[tuple[int, int]]:
    """(first word, last word + 1): parts of a document that hold all alignments of the item that score enough.

    An alignment spans a bounded number of words, and has each n-gram that it shares at a place of its own: so windows
    of that many words count, whose n-grams are the item's often enough. Linear in the document, whatever repeats.
    """
    _, span, n, least = items.bounds[item]
    shared = np.concatenate([[0], np.cumsum(np.isin(items.keys(doc, n), items.grams[item]))])
    first = np.arange(len(shared))
    begin = np.flatnonzero(shared[np.minimum(first + span, len(shared) - 1)] - shared >= least)
    if len(begin):
        runs = _merged(begin, begin + span)
        for a, b in zip(runs, [*runs[1:], len(begin)], strict=True):
            yield int(begin[a]), min(int(begin[b - 1]) + span, len(doc))


def leaks(doc: np.ndarray, items: Items) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word + 1) of the best alignment of each item that scores enough: the one that ends first, then the shortest."""
    for item, w in enumerate(items.words):
        wanted, span = items.bounds[item][:2]
        score, begin, stop = wanted - 1, 0, 0
        for a, b in regions(doc, items, item):
            s, e = align(w, doc[a:b])
            if s > score:
                score, begin, stop = s, a, a + e
        if score >= wanted:
            begin = max(begin, stop - span)
            yield item, score / len(w), stop - align(w[::-1], doc[begin:stop][::-1])[1], stop


def word_hashes(data: bytes, known: WordHashes) -> np.ndarray:
    """A 64-bit hash for each word of a cleaned text, which is cut a slice at a time."""
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + _SLICE_BYTES)
        end = len(data) if end < 0 else end
        parts.append(known.of(data[at:end].split()))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Filter:
    """Which n-grams of a text may be known ones, and how far these reach: by the leading bits of their hashes.

    With all bits, what it lets through is wrong only where hashes are equal; with fewer, more often.
    """

    #: Of each n-gram: 8 for its bits, 4 for its reach, 16 for a table that most others end at.
    BYTES = 28

    def __init__(self, keys: np.ndarray, reach: np.ndarray, shift: int):
        order = np.argsort(keys)
        self.keys, self.reach, self.shift = keys[order], np.minimum(reach[order], 0xFFFFFFFF).astype(np.uint32), np.uint64(shift)
        self.quick = np.zeros(1 << ((16 * len(keys)).bit_length() - 1), bool)
        self.mask = np.uint64(len(self.quick) - 1)
        self.quick[self.keys & self.mask] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams that are let through, and how far each reaches."""
        key = grams >> self.shift
        at = np.flatnonzero(self.quick[key & self.mask])
        i = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        same = self.keys[i] == key[at]
        return at[same], self.reach[i[same]].astype(np.int64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each n-gram of words, n being 1 or 2."""
    return mixed(h) if n == 1 else mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least: float = 0.5, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, score, start_word and end_word of every document and item whose alignment scores ``least`` or more.

    The score is the alignment's, divided by the item's number of words. However many items there are, the documents are
    read twice: to count the items' word pairs, and for passages around seeds. ``block_bytes`` bounds the filter of
    n-grams that goes to the tasks for both; what a small one lets through too much goes in the join with the seeds.

    Items of fewer than ``n`` words, null or empty ones among them, are too short to tell and match nothing; so do
    null or empty texts. Items that share an id are judged each for itself, and the best score of the id counts. Rows
    with the same or a null ``doc_id`` are each reported. No items or no documents give an empty result. Of equal
    scores in a text, the one that ends first counts, then the shortest. Texts of any length are searched whole, in
    passages of bounded length: a task needs some thirty times the memory of its longest text.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _search(text, benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")), n, least, block_bytes)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least: float = 0.5, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which ``find_leaks`` would find nothing.

    Texts are judged, so ids, repeated or null, play no part, and a text goes with all its copies. Null and empty texts stay.
    """
    digest = lambda c: F.sha2(c, 256)
    text = docs.select(digest(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    found = _search(text, benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")), n, least, block_bytes)
    leaking = found.select(F.col("doc_id").alias("digest")).distinct()
    kept = docs.select(F.struct("*").alias("document"), digest(F.col(text_col)).alias("digest")).join(leaking, "digest", "left_anti")
    return kept.select("document.*")


def _search(text: DataFrame, benchmark: DataFrame, n: int, least: float, block_bytes: int) -> DataFrame:
    """Leaks of rows (doc_id, text), whatever the type of ``doc_id``."""
    assert n >= 1
    spark, scratch = text.sparkSession, Scratch(text.sparkSession, "leaks")
    ship(spark)
    kind = text.schema["doc_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"doc_id {kind}, item_id long, score double, start_word long, end_word long")
    # Numbered once and written, so that an item keeps its number.
    items = scratch.write(benchmark.where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct().withColumn("item_no", F.monotonically_increasing_id()))
    grams = scratch.write(_item_grams(items, n, least))
    size = grams.agg(F.count("*").alias("n"), F.collect_set("order").alias("orders")).first()
    if not size["n"]:
        scratch.drop(grams, items)
        return nothing
    known = _filter(grams, size["n"], block_bytes)
    count = _counts(text, known, size["orders"]).groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = Window.partitionBy("item_no").orderBy("n", "gram", "place")
    ranked = grams.join(count, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rarest))
    # What the corpus does not have can be no seed of a match.
    seeds = scratch.write(ranked.where("r <= seeds AND n > 0").groupBy("gram", "item_no").agg(F.first("reach").alias("reach")))
    known.unpersist()
    size_of_seeds = seeds.count()
    if not size_of_seeds:
        scratch.drop(seeds, grams, items)
        return nothing
    known = _filter(seeds, size_of_seeds, block_bytes)
    passages = scratch.write(_passages(text.withColumn("row", F.monotonically_increasing_id()), kind, known, size["orders"]))
    near = passages.select("row", "start", F.explode("grams").alias("gram")).join(seeds, "gram").select("row", "start", "item_no").distinct()
    each = _aligned(near.join(passages.drop("grams"), ["row", "start"]).join(items, "item_no"), kind, n, least)
    best = F.min(F.struct((-F.col("score")).alias("less"), "end_word", (-F.col("start_word")).alias("later"))).alias("best")
    found = scratch.write(
        each.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), best)
        .select("doc_id", "item_id", (-F.col("best.less")).alias("score"), (-F.col("best.later")).alias("start_word"), F.col("best.end_word").alias("end_word"))
    )
    known.unpersist()
    scratch.drop(passages, seeds, grams, items)
    return found


def _item_grams(items: DataFrame, n: int, least: float) -> DataFrame:
    """Each place of each item's n-grams, with the number of its seeds and the words that an alignment reaches from a seed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for no, text in zip(batch.column("item_no"), batch.column("item_text"), strict=True):
                h = word_hashes(cleaned(text.as_py()), known)
                if len(h) >= n:
                    _, span, order, shared = bounds(len(h), least)
                    g = gram_hashes(h, order).view(np.int64)
                    same = lambda x, k, m=len(g): pa.array(np.full(m, x, k))
                    yield pa.RecordBatch.from_arrays(
                        [same(no.as_py(), np.int64), pa.array(np.arange(len(g))), pa.array(g), same(len(g) - shared + 1, np.int64), same(span, np.int64), same(order, np.int32)],
                        ["item_no", "place", "gram", "seeds", "reach", "order"],
                    )

    return items.select("item_no", "item_text").mapInArrow(cut, "item_no long, place long, gram long, seeds long, reach long, order int")


def _filter(grams: DataFrame, n: int, most_bytes: int) -> Broadcast:
    """The filter of ``n`` n-grams for the tasks: their hashes, or as many leading bits of them as keep it below ``most_bytes``."""
    most = max(1, most_bytes // Filter.BYTES)
    shift = 0 if n <= most else min(63, 65 - most.bit_length())
    rows = grams.groupBy(F.shiftrightunsigned("gram", shift).alias("key") if shift else F.col("gram").alias("key")).agg(F.max("reach").alias("reach")).toArrow()
    return grams.sparkSession.sparkContext.broadcast(Filter(rows["key"].to_numpy().astype(np.int64).view(np.uint64), rows["reach"].to_numpy(), shift))


def _counts(text: DataFrame, known: Broadcast, orders: list[int]) -> DataFrame:
    """(gram, n): how often the texts have the n-grams that the filter lets through, added up in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen, grams, n, fresh, waiting = known.value, WordHashes(), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            each, inverse = np.unique(np.concatenate([grams, *fresh]), return_inverse=True)
            return each, np.bincount(inverse, np.concatenate([n, np.ones(waiting, np.int64)]), len(each)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

        for batch in batches:
            for x in batch.column("text"):
                if x.is_valid:
                    h = word_hashes(cleaned(x.as_py()), seen)
                    for order in orders:
                        g = gram_hashes(h, order)
                        g = g[wanted.hits(g)[0]]
                        fresh.append(g)
                        waiting += len(g)
                if waiting >= _HELD:
                    grams, n = added()
                    fresh, waiting = [], 0
                    if len(grams) >= _HELD:
                        yield out()
                        grams, n = grams[:0], n[:0]
        grams, n = added()
        if len(grams):
            yield out()

    return text.select("text").mapInArrow(count, "gram long, n long")


def _passages(text: DataFrame, kind: str, known: Broadcast, orders: list[int]) -> DataFrame:
    """(row, doc_id, start, words, grams): what lies around seeds, as far as an alignment can reach; ``grams`` are the seeds of the passage."""
    doc_id = text.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = known.value, WordHashes()
        core = max(_PASSAGE_WORDS, int(wanted.reach.max()))
        for batch in batches:
            out, held, type_ = [], 0, batch.schema.field("doc_id").type

            def full(out: list, type_: pa.DataType = type_) -> pa.RecordBatch:
                types = (pa.int64(), type_, pa.int64(), pa.binary(), pa.list_(pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], ["row", "doc_id", "start", "words", "grams"])

            for row, doc, x in zip(batch.column("row"), batch.column("doc_id"), batch.column("text"), strict=True):
                data = cleaned(x.as_py() or "")
                h = word_hashes(data, seen)
                at, keys, reach = [], [], []
                for order in orders:
                    g = gram_hashes(h, order)
                    p, r = wanted.hits(g)
                    at.append(p)
                    keys.append(g[p])
                    reach.append(r)
                del g, p, r
                at, keys, reach = (x[0] if len(orders) == 1 else np.concatenate(x) for x in (at, keys, reach))
                if not len(at):
                    continue
                if len(orders) > 1:
                    by = np.argsort(at, kind="stable")
                    at, keys, reach = at[by], keys[by], reach[by]
                begin, end = np.maximum(at - reach, 0), np.minimum(at + reach + 2, len(h))
                # Seeds can reach back in front of one before: sorted by begin only from there on.
                begin = np.minimum.accumulate(begin[::-1])[::-1]
                runs = _merged(begin, end, np.diff(at // core, prepend=-1) != 0)
                first, last = np.minimum.reduceat(begin, runs), np.maximum.reduceat(end, runs)
                del reach, begin, end, h
                filled = np.frombuffer(data, np.uint8) != 32
                edge = np.diff(filled.view(np.int8), prepend=0, append=0)
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for a, b, i, j in zip(first.tolist(), last.tolist(), runs, [*runs[1:], len(at)], strict=True):
                    passage = data[starts[a] : stops[b - 1]]
                    out.append((row.as_py(), doc.as_py(), a, passage, np.unique(keys[i:j]).view(np.int64)))
                    held += len(passage)
                    if held >= _SLICE_BYTES:
                        yield full(out)
                        out, held = [], 0
            if out:
                yield full(out)

    return text.select("row", "doc_id", "text").mapInArrow(cut, f"row long, doc_id {doc_id.simpleString()}, start long, words binary, grams array<long>")


def _aligned(pairs: DataFrame, kind: str, n: int, least: float) -> DataFrame:
    """The best alignment of each passage with an item that scores enough."""

    def score(batch: pa.RecordBatch) -> dict:
        made: dict[int, Items] = {}
        out: dict[str, list] = {k: [] for k in ("row", "doc_id", "item_id", "score", "start_word", "end_word")}
        for row, doc, start, passage, no, item, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "words", "item_no", "item_id", "item_text")), strict=True):
            if no not in made:
                made[no] = Items([(item, text)], n, least)
            for _, s, a, b in leaks(made[no].number(passage), made[no]):
                for k, v in zip(out, (row, doc, item, s, start + a, start + b), strict=True):
                    out[k].append(v)
        return out

    return map_rows(pairs.select("row", "doc_id", "start", "words", "item_no", "item_id", "item_text"), score, f"row long, doc_id {kind}, item_id long, score double, start_word long, end_word long", rows=256)
