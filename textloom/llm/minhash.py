"""Near duplicates by min-max hashing.

Each permutation of the shingle hashes gives two values of the signature, its minimum and its maximum, so half as
many hash evaluations fill the bands. Documents that share a band are candidates; their whole shingle sets confirm
each link. In a bucket of a band every member is compared with one of them, its centre, which joins up most of a group
of copies; members that are still apart then meet by what they do not share with the centre, rarest first. Links are
followed to connected components by joins, never on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, Scratch, WordHashes, frequency_sketch, map_rows, mixed, utf8

#: Values that are permuted at once; links in a partition; members of a bucket that are paired directly.
BLOCK_VALUES, EDGES, SMALL = 1 << 15, 1 << 18, 16
#: Counters of the sketch of differences, 4 bytes each, broadcast as a whole.
CELLS = 1 << 20
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text: A-Z lower-cased, words between ASCII white space."""
    words = text.translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for i in range(min(size, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


class MinMax:
    """Bands of ``rows`` values from minima and maxima under random permutations of 64-bit hashes.

    With the defaults, 90 permutations give 180 values in 36 bands of 5: two sets with a similarity of 0.8 share no
    band with a probability of about (1 - 0.8 ** 5) ** 36 = 6e-7, and two with 0.3 share one in a twelfth of cases.
    """

    def __init__(self, bands: int = 36, rows: int = 5, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = (bands * rows + 1) // 2
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)

    def of(self, s: np.ndarray) -> list[int]:
        """Band hashes, as signed 64-bit numbers; none of an empty set."""
        if not len(s):
            return []
        low, high = np.empty(len(self.a), np.uint64), np.empty(len(self.a), np.uint64)
        block = max(1, BLOCK_VALUES // len(s))
        for i in range(0, len(self.a), block):
            x = self.a[i : i + block, None] * s
            x += self.b[i : i + block, None]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x.min(1, out=low[i : i + block])
            x.max(1, out=high[i : i + block])
        # A band takes at most one value of a permutation, which keeps its values independent.
        values = np.concatenate([low, high])[: self.bands * self.rows].reshape(self.rows, self.bands)
        out = np.arange(self.bands, dtype=np.uint64)
        for row in values:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + row)
        return out.view(np.int64).tolist()


def signatures(docs: DataFrame, size: int, minmax: MinMax) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the whole set; null if it is empty) and bands of every row."""
    hashes: list[WordHashes] = []

    def sign(batch: pa.RecordBatch) -> dict:
        if not hashes:
            hashes.append(WordHashes())
        sets = [shingles(t, size, hashes[0]) for t in utf8(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "bands": [minmax.of(s) for s in sets]}

    return map_rows(docs, sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, a digest and the shingle set, for the documents in ``ids``.

    Up to a checked size the ids are broadcast, so that no text is shuffled; beyond it both sides are shuffled.
    """
    few = ids.count() * 16 <= BROADCAST_BYTES
    text = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    hashes: list[WordHashes] = []

    def make(batch: pa.RecordBatch) -> dict:
        if not hashes:
            hashes.append(WordHashes())
        sets = [shingles(t, size, hashes[0]).tobytes() for t in utf8(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "set_key": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "shingles": sets}

    return map_rows(text, make, "doc_id long, set_key binary, shingles binary")


def sets_of(scratch: Scratch, ids: DataFrame, sets: DataFrame) -> DataFrame:
    """Just the sets that are needed, as a table of its own: so Spark shuffles both sides of a join with it and can split a hot key."""
    few = ids.count() * 16 <= BROADCAST_BYTES
    return scratch.write(sets.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))


def confirmed(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for each of ``pairs``: whether 100 * intersection >= percent * union."""
    own = sets_of(scratch, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), sets)
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")

    def compare(batch: pa.RecordBatch) -> dict:
        ok, key, held = [], None, None
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            if y != key:
                key, held = y, np.frombuffer(y, np.uint64)
            one = np.frombuffer(x, np.uint64)
            same = 0
            if 100 * min(len(one), len(held)) >= percent * max(len(one), len(held)):
                merged = np.concatenate([one, held])
                merged.sort(kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
            ok.append(100 * same >= percent * (len(one) + len(held) - same))
        return {"a": batch.column("a"), "b": batch.column("b"), "linked": ok}

    out = scratch.write(map_rows(both.select("a", "b", "left", "right"), compare, "a long, b long, linked boolean"))
    scratch.drop(own)
    return out


def differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with ``differ``: the symmetric difference of the set and its centre's, as 64-bit numbers."""
    both = rows.join(sets.select("doc_id", F.col("shingles").alias("left")), "doc_id").join(sets.select(F.col("doc_id").alias("centre"), F.col("set_key").alias("key"), F.col("shingles").alias("right")), "centre")

    def differ(batch: pa.RecordBatch) -> dict:
        out = []
        for x, y, key in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "key")), strict=True):
            d = np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)
            # The centre's digest keeps the differences from different centres apart.
            out.append(mixed(d ^ np.uint64(int.from_bytes(key[:8], "little"))).tobytes())
        return {"differ": out}

    return map_rows(both.select(F.struct(*rows.columns).alias("of"), "left", "right", "key"), differ, "differ binary", carry="of").select("of.*", "differ")


def difference_counts(far: DataFrame) -> np.ndarray:
    """How often each difference occurs, as a frequency sketch of CELLS counters."""

    def numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for at in range(0, batch.num_rows, 1024):
            yield np.frombuffer(b"".join(batch.column("differ")[at : at + 1024].to_pylist()), np.uint64)

    return frequency_sketch(far.select("differ"), CELLS, numbers)


def places(far: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """``far`` with the differences by which members of a bucket that are linked to each other, but not both to its centre, must meet.

    Let D(x) be the symmetric difference of the set x and the centre's c, k = (100 - percent) / (100 + percent). Two sets
    are linked if |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= k (|x| + |y|). An x that is not linked to c has |D(x)| > k (|x| + |c|),
    so they share more than (|D(y)| + k (|c| - |y|)) / 2 differences; and at least |D(x)| - |x| (100 - percent) / percent of
    them, because they share no more than |D(y)|. In an order that is the same for all, here the rarest by the sketch
    first, the first |D| - (what they must share) + 1 differences of both have one in common: ``probe`` for any member,
    ``index`` for one of another component than the centre's. Each comes with its place in the order. One that the
    sketch counts once cannot be shared and is left out.
    """
    held = far.sparkSession.sparkContext.broadcast(sketch)

    def order(batch: pa.RecordBatch) -> dict:
        probe, index, many = [], [], []
        for x, other, n, centre in zip(*(batch.column(c).to_pylist() for c in ("differ", "other", "n_shingles", "n_centre")), strict=True):
            d = np.frombuffer(x, np.uint64)
            often = held.value[d & np.uint64(CELLS - 1)]
            by = np.lexsort((d, often))
            d, often = d[by].view(np.int64), often[by]
            slack = (100 - percent) * n // percent
            share = ((100 + percent) * len(d) + (100 - percent) * (centre - n)) // (2 * (100 + percent)) + 1
            at = np.flatnonzero(often > 1)
            each = [{"element": e, "at": i} for e, i in zip(d[at].tolist(), at.tolist(), strict=True)]
            probe.append(each[: int(np.searchsorted(at, len(d) - max(1, share, len(d) - slack) + 1))])
            index.append(each[: int(np.searchsorted(at, slack + 1))] if other else [])
            many.append(len(d))
        return {"n_differ": many, "probe": probe, "index": index}

    kind = "array<struct<element:long,at:int>>"
    rows = far.select(F.struct("doc_id", "n_shingles", "component").alias("of"), "differ", "n_shingles", "n_centre", (F.col("component") != F.col("of")).alias("other"))
    return map_rows(rows, order, f"n_differ int, probe {kind}, index {kind}", carry="of").select("of.*", "n_differ", "probe", "index")


def fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def met_by_differences(at: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a place and, as both orders are the same, can share enough after it."""
    one, two = (at.select(*(F.col(c).alias(f"{c}{k}") for c in ("doc_id", "n_shingles", "component", "n_differ")), F.explode(side).alias("e")).select("*", F.col("e.element").alias("element"), F.col("e.at").alias(f"at{k}")).drop("e") for k, side in ((1, "probe"), (2, "index")))
    need = (100 + percent) * (F.col("n_differ1") + F.col("n_differ2")) - (100 - percent) * (F.col("n_shingles1") + F.col("n_shingles2"))
    able = F.least(F.col("n_differ1") - F.col("at1"), F.col("n_differ2") - F.col("at2"))
    on = [one["element"] == two["element"], F.col("component1") != F.col("component2"), fits(F.col("n_shingles1"), F.col("n_shingles2"), percent), 2 * (100 + percent) * able >= need]
    return one.join(two, on).select(F.greatest("doc_id1", "doc_id2").alias("a"), F.least("doc_id1", "doc_id2").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of ``edges`` (a, b): the component is its smallest node, which has no row itself.

    Large-star and small-star steps by turns: the number of rounds grows with the logarithm of the longest path. The
    smallest neighbours are a table of their own, so Spark can split the many rows of a hot node. Edges stand in
    partitions of EDGES rows, so small graphs don't make many small files.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        parts = max(1, state[0] // EDGES)
        # Each edge's larger end goes to the smallest neighbour of its smaller end, if that is smaller still.
        low = scratch.write(now.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        large = now.join(low.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = scratch.write(large.distinct().coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = scratch.write(small.where("u <> v").distinct().coalesce(parts))
        scratch.drop(now, low, large)
        now = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def centre_of_bucket() -> Column:
    """The member that meets the most others: centre, n_centre and of, its component."""
    return F.min(F.struct((-F.col("met")).alias("order"), F.col("doc_id").alias("centre"), F.col("n_shingles").alias("n_centre"), F.col("component").alias("of"))).alias("c")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) that join up all class representatives which links connect.

    Every bucket of a band links its members to one of them, its centre: the one that meets the most others over all
    bands. Of buckets whose members are then still in several components, those of up to SMALL members are compared
    in pairs, so a member has fewer than SMALL pairs for each band; in larger ones the members meet by their differences
    from the centre. So a pair that shares a band stays uncompared only if other links have already joined its two
    documents, or their differences from the centre rule it out.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    each = classes.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    full = each.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = each.join(full, "band")
    # The original of many near copies, which may be far from each other, meets the most others over all its bands.
    met = shared.groupBy("doc_id").agg(F.sum("members").alias("met"))
    band = scratch.write(shared.drop("members").join(met, "doc_id"))
    # An id that stands in rows with different texts keeps all of its sets; any of them can make a link.
    sets = scratch.write(whole_sets(docs, band.select("doc_id").distinct(), size).dropDuplicates(["doc_id", "set_key"]))
    ordered = [F.greatest("doc_id", "centre").alias("a"), F.least("doc_id", "centre").alias("b")]

    bucket = scratch.write(band.withColumn("component", F.col("doc_id")).groupBy("band").agg(centre_of_bucket()).select("band", "c.centre", "c.n_centre"))
    to_centre = band.join(bucket, "band").where((F.col("doc_id") != F.col("centre")) & fits(F.col("n_shingles"), F.col("n_centre"), percent))
    pairs = scratch.write(to_centre.select(*ordered).distinct())
    tested = confirmed(scratch, pairs, sets, percent)
    comp = scratch.write(components(tested.where("linked")))
    scratch.drop(bucket, pairs)

    named = scratch.write(band.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    open_ = scratch.write(named.groupBy("band").agg(centre_of_bucket(), F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "members", "c.centre", "c.n_centre", "c.of"))
    rows = scratch.write(named.drop("met").join(open_, "band"))
    scratch.drop(band, named, open_)
    small = rows.where(F.col("members") <= SMALL).select("band", "doc_id", "n_shingles", "component")
    other = small.select("band", F.col("doc_id").alias("centre"), F.col("n_shingles").alias("n_centre"), F.col("component").alias("of"))
    direct = small.join(other, "band").where(F.col("component") < F.col("of")).where(fits(F.col("n_shingles"), F.col("n_centre"), percent)).select(*ordered)
    large = rows.where(F.col("members") > SMALL).drop("band", "members").distinct()
    own = sets_of(scratch, large.select(F.explode(F.array("doc_id", "centre")).alias("doc_id")).distinct(), sets)
    far = scratch.write(differences(large, own))
    at = scratch.write(places(far, difference_counts(far), percent))
    pairs = scratch.write(direct.union(met_by_differences(at, percent)).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    scratch.drop(rows, own, far, at)
    found = confirmed(scratch, pairs, sets, percent)
    scratch.drop(pairs, sets, tested)
    return comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found.where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 36, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (whether it is that) of every row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct ``shingle``-word
    shingles; a text with fewer words has the one shingle of all its words. Equal sets form a class at once, by their
    digest, so copies are never paired.

    Null or empty text, or text of white space: an empty set, linked with nothing. Rows that repeat a ``doc_id`` count
    as one document for links, each with its own n_shingles. Rows with a null ``doc_id`` are linked with nothing and
    kept. An empty table gives an empty result. Texts of any length count as a whole.
    """
    scratch = Scratch(docs.sparkSession, "signatures")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.write(signatures(text, shingle, MinMax(bands, rows)))
    known = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = scratch.write(known.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("c")).select("set_key", "c.*"))
    found = links(text.where("doc_id IS NOT NULL"), classes.drop("set_key"), shingle, percent)
    # An id that stands in several classes joins them.
    member = known.join(classes.select("set_key", F.col("doc_id").alias("first")), "set_key").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    comp = components(found.union(member))
    scratch.drop(classes)
    out = signed.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
