"""Quality rules: counts, and the distance of a text's distributions from those of its language.

The references are the average character-class and common-word histograms of each language, taken over every
document of the corpus that is long enough. A document whose own histograms lie too far off, by Jensen-Shannon
distance, is rejected; short documents are not judged by a histogram that they are too short to fill.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import map_rows, utf8

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Classes of bytes: lower, upper, digit, white space, sentence marks, other marks, other controls, first bytes beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[:] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(WHITE)] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(b"#*$%&|<>@[]\\^_`{}~+=/")] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8  # inside a character: not counted
N_CLASSES = 8
#: Common words of four languages, the vocabulary of the word histograms.
COMMON = {
    w: i
    for i, w in enumerate(
        dict.fromkeys(
            (
                "the of and to a in is it that for on with as was at by be this are or an not from have he you but his her they "
                "de la le les et des en un une du que qui est pour dans sur par au pas plus avec il elle ne se ce "
                "der die das und in zu den von mit sich nicht ist ein eine dem im auf auch es für als an werden aus "
                "el los las y del se con por su para al lo como una más o pero sus"
            ).split()
        )
    )
}
_COMMON = {w.encode(): i for w, i in COMMON.items()}
N_WORDS = len(COMMON) + 1
#: Shares are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    continued = len(text) - len(text.translate(None, _CONTINUATION))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict = {}
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            j = seen.setdefault(w, i)
            if j != i:
                covered[j : j + 3] = covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return len(words), len(text.translate(None, WHITE)) - continued, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def histograms(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of character classes and of common words (the last: all other words); code points."""
    classes = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 9)[:N_CLASSES]
    words = [w.strip(b".,;:!?'\"()-") for w in text.lower().split()]
    own = np.bincount(np.fromiter((_COMMON.get(w, N_WORDS - 1) for w in words), np.int64, len(words)), minlength=N_WORDS)
    return classes, own, int(classes.sum())


def shares(counts: np.ndarray) -> np.ndarray:
    return np.floor(counts * UNIT / max(counts.sum(), 1)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms."""
    p, q = p / max(p.sum(), 1e-12), q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(kl) / 2)))


def base_failed(n_words: Column, n_repeat_words: Column, least_words: int) -> Column:
    return (n_words < least_words) | (100 * n_repeat_words > 50 * n_words)


def language_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least_words: int = 50, least_documents: int = 20, most_languages: int = 1000) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Average histograms of each language, over all documents of at least ``least_words`` words.

    Each task adds up its own documents, so a row for each task and language is shuffled. What reaches the driver is
    a row of about a hundred numbers for each language: of ``most_languages`` at most, those with the most documents.
    The key '' stands for all languages together and serves the others, and those of fewer than ``least_documents``
    documents that are long enough: a document must not be compared with hardly more than itself.
    """

    def gather(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                classes, words, _ = histograms(text)
                if words.sum() >= least_words:
                    own = np.concatenate([shares(classes), shares(words), [1]])
                    for key in {lang, ""}:
                        sums[key] = sums[key] + own if key in sums else own.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    ship(docs.sparkSession)
    n = N_CLASSES + N_WORDS + 1
    text = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    rows = text.mapInArrow(gather, "lang string, sums array<long>").groupBy("lang").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(n))).alias("sums")).where((F.col("lang") == "") | (F.col("sums")[n - 1] >= least_documents)).orderBy(F.col("lang") != "", F.desc(F.col("sums")[n - 1]), "lang").limit(most_languages + 1).collect()
    return {r["lang"]: (np.array(r["sums"][:N_CLASSES], float), np.array(r["sums"][N_CLASSES : n - 1], float)) for r in rows}


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, least_documents: int = 20, most_class: float = 0.3, most_word: float = 0.35, least_chars: int = 200, least_judged_words: int = 100, carry: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance and kept for every text; with ``carry``, the whole row as ``document``.

    A document is kept unless it fails the base rules (under ``least_words`` words, or more than half of its words in
    repeated 3-word windows), its character classes are further than ``most_class`` from its language (judged from
    ``least_chars`` characters on) or its common words further than ``most_word`` (from ``least_judged_words`` words
    on). A distance that is not judged is null.

    Null or empty text: all counts 0, which fails. A null language, and one of fewer than ``least_documents`` documents
    that are long enough: the average over all languages. Rows with the same or a null ``doc_id`` are judged each for
    itself. An empty table gives an empty result. Texts of any length are counted whole.
    """
    # About a hundred numbers for each of a bounded number of languages.
    shared = docs.sparkSession.sparkContext.broadcast(language_references(docs, text_col=text_col, lang_col=lang_col, least_words=least_words, least_documents=least_documents))

    def judge(batch: pa.RecordBatch) -> dict:
        refs, counts, by_class, by_word = shared.value, [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
            counts.append(base_counts(text))
            classes, words, chars = histograms(text)
            ref = refs.get(lang) or refs.get("")
            by_class.append(distance(classes, ref[0]) if ref and chars >= least_chars else None)
            by_word.append(distance(words, ref[1]) if ref and counts[-1][0] >= least_judged_words else None)
        each = zip(*counts) if counts else [[]] * 5  # noqa: B905
        return {"doc_id": batch.column("doc_id"), **dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, each), strict=True)), "class_distance": by_class, "word_distance": by_word}

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"), *([F.struct("*").alias("document")] if carry else []))
    out = map_rows(text, judge, f"doc_id long, {_COUNTS}, class_distance double, word_distance double", carry="document" if carry else None)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"), least_words)
    far = F.coalesce(F.col("class_distance") > most_class, F.lit(False)) | F.coalesce(F.col("word_distance") > most_word, F.lit(False))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)
