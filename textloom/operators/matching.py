"""Joins of strings with texts: which texts hold which strings, and which are alike, without meeting all of them.

One side goes to the tasks in blocks of bounded size; the other stays where it is, so nothing but pairs is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..shipping import ship
from ..sources.tables import staged

#: Characters of one block of strings.
BLOCK_CHARS = 1 << 21
#: The automaton knows so many characters of a string; the rest of a longer one is compared where these are found.
KNOWN_CHARS = 64
#: Characters are counted in so many classes; pairs of texts are compared so many at a time.
CLASSES, PAIRS = 64, 4096


def _blocks(strings: DataFrame) -> Iterator[list[str]]:
    """The different strings of a one-column table, in blocks of about BLOCK_CHARS characters."""
    name = strings.columns[0]
    own = staged(strings.where(F.col(name) != "").distinct())
    blocks = max(1, -(-(own.agg(F.sum(F.length(name))).first()[0] or 0) // BLOCK_CHARS))
    for b in range(blocks):
        if some := own.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == b).toArrow().column(0).to_pylist():
            yield some


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) of every non-empty string in ``needles`` (needle) and text in ``texts`` (text) that contains it, each pair once.

    The strings become an automaton with output links, block by block; a text is read once for each block, by the task
    that has it, however many strings there are in a block or occurrences in a text.
    """
    spark = texts.sparkSession
    ship(spark)
    held, out = texts.select("text").where("text <> ''").distinct(), None
    blocks = _blocks(needles.select("needle"))
    for some in blocks:
        shared = spark.sparkContext.broadcast(some)
        held = staged(held) if out is None else held  # what several passes read
        found = held.mapInArrow(_inside(shared), "needle string, text string")
        out = found if out is None else out.union(found)
    return held.select(F.lit("").alias("needle"), "text").limit(0) if out is None else out


def _inside(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        heads: dict[str, list[str]] = {}
        for s in shared.value:
            heads.setdefault(s[:KNOWN_CHARS], []).append(s)
        found = ahocorasick.Automaton()
        for head, own in heads.items():
            found.add_word(head, (len(head) - 1, own))
        found.make_automaton()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pairs = set()
                for end, (back, own) in found.iter(text):
                    pairs.update(s for s in own if len(s) <= KNOWN_CHARS or text.startswith(s, end - back))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(pairs)), pa.array([text] * len(pairs))], ["needle", "text"])

    return run


def alike(asked: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(asked, text, ratio) of every pair of non-empty strings of ``asked`` (asked) and ``texts`` (text) whose ``fuzzy.ratio`` is ``least`` or more.

    Matching blocks cover at most the characters that both have, each as often as both have it. So only texts whose
    length fits are looked at, only by counts of their characters (in classes, which cannot lower the bound), and only
    what may reach ``least`` by these counts is compared. ``texts`` is the side that goes to the tasks.
    """
    spark = texts.sparkSession
    ship(spark)
    own, out = asked.select("asked").where("asked <> ''").distinct(), None
    for some in _blocks(texts.select("text")):
        shared = spark.sparkContext.broadcast(sorted(some, key=len))
        own = staged(own) if out is None else own
        found = own.mapInArrow(_alike(shared, least), "asked string, text string, ratio double")
        out = found if out is None else out.union(found)
    return own.select("asked", F.lit("").alias("text"), F.lit(0.0).alias("ratio")).limit(0) if out is None else out


def _counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes % np.uint32(CLASSES), minlength=CLASSES).astype(np.int32)


def _alike(shared, least: float):
    def compared(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        ratio = fuzzy.ratios_of([a for a, _ in pairs], [t for _, t in pairs])
        keep = np.flatnonzero(ratio >= least).tolist()
        return pa.RecordBatch.from_arrays([pa.array([pairs[i][0] for i in keep], pa.string()), pa.array([pairs[i][1] for i in keep], pa.string()), pa.array(ratio[keep])], ["asked", "text", "ratio"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = shared.value
        size, counts, pairs = np.array([len(t) for t in texts]), np.array([_counts(t) for t in texts]), []
        for batch in batches:
            for a in batch.column(0).to_pylist():
                # 2 * min(lengths) / (sum of lengths) must reach `least`, too.
                low, high = np.searchsorted(size, len(a) * least / (2 - least) - 1e-6), np.searchsorted(size, len(a) * (2 - least) / least + 1e-6, "right")
                common = np.minimum(counts[low:high], _counts(a)).sum(1)
                for i in np.flatnonzero(2.0 * common >= (least - 1e-9) * (len(a) + size[low:high])).tolist():
                    pairs.append((a, texts[low + i]))
                if len(pairs) >= PAIRS:
                    yield compared(pairs)
                    pairs = []
        if pairs:
            yield compared(pairs)

    return run


def sharing_tokens(asked: DataFrame, texts: DataFrame, least: float, inside: DataFrame | None = None) -> DataFrame:
    """(asked, text) of every pair where the share of the tokens in ``asked`` (asked, tokens) that ``texts`` (text) contains may reach ``least``.

    Of m tokens at least m * least must be inside, so one of the m - ceil(m * least) + 1 that the fewest texts contain
    is: only those are joined. ``inside`` may have the pairs of ``containing`` for the tokens and texts, and more.
    """
    a = asked.select("asked", "tokens").where(F.size("tokens") > 0).distinct()
    if inside is None:
        inside = staged(containing(a.select(F.explode("tokens").alias("needle")), texts))
    inside = inside.join(texts.select("text").distinct(), "text", "left_semi")
    often = inside.groupBy("needle").agg(F.count("*").alias("n"))
    each = a.select("asked", F.size("tokens").alias("m"), F.posexplode("tokens").alias("i", "needle")).join(often, "needle", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "needle")))
    first = each.groupBy("asked", "m").agg(order.alias("all")).select("asked", F.explode(F.slice("all", F.lit(1), F.col("m") - F.ceil(F.col("m") * least - 1e-9).cast("int") + 1)).alias("t"))
    return first.select("asked", F.col("t.needle").alias("needle")).join(inside, "needle").select("asked", "text").distinct()
