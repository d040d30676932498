"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line goes down the tree by its number of tokens and then by its leading tokens. Tokens that hold a digit or an @ are
variable fields from the start. In its leaf, a line stands under several templates: a short one under itself and under
itself with any one more token as a field; a long one under itself, and under itself with the first or the second half
of the rest as one field. A template of which fewer than one token in four is constant tells nothing, so rows of numbers
or addresses recur only by their exact text. A template that recurs in enough documents is boilerplate: its lines are
dropped everywhere but in the first document that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, let

#: Tokens that are variable wherever they stand; the possessive part keeps the search linear.
VARIABLE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*"


#: A template counts from this share of constant tokens on, one in so many.
CONSTANT = 4


#: Constant tokens that a short line must keep beside the one that is made a field.
LEAST_CONSTANT = 4


def templates(line: Column, depth: int, least_tokens: int, long_tokens: int) -> Column:
    """Keys of the templates of a line (key and check, two hashes, and whether the line is long); none of a blank line."""
    cut = lambda x: F.split(F.trim(F.regexp_replace(x, r"[ \t\r\f\x0b]{2,}|[\t\r\f\x0b]", " ")), " ")
    masked = let(cut(F.regexp_replace(line, VARIABLE, "<*>")), lambda t: _keys(t, depth, least_tokens, long_tokens, line))
    keys = F.when(line.rlike("[0-9@]"), masked).otherwise(let(cut(line), lambda t: _keys(t, depth, least_tokens, long_tokens)))
    return F.when(F.trim(F.translate(line, "\t\r\f\x0b", "    ")) != "", keys)


def _key(*parts: Column, long: Column | None = None) -> Column:
    """Hashes of 64 and of 32 bits from different functions: 96 bits tell templates apart in any corpus."""
    return F.struct(F.xxhash64(*parts).alias("key"), F.hash(*parts).alias("check"), (F.lit(False) if long is None else long).alias("long"))


def _keys(tokens: Column, depth: int, least_tokens: int, long_tokens: int, line: Column | None = None) -> Column:
    """With ``line``, tokens may be variable: a key of too few constant ones gives way, that of the whole line to its exact text."""
    n = F.size(tokens)
    half = F.greatest(F.floor((n - depth) / 2).cast("int"), F.lit(0))
    lead = F.slice(tokens, 1, depth)
    before, after = F.slice(tokens, depth + 1, half), F.slice(tokens, F.lit(depth + 1) + half, F.greatest(n, F.lit(0)))
    constants = lambda *parts: sum((F.size(F.array_remove(x, "<*>")) for x in parts), F.lit(0))
    whole, first, second = _key(F.lit(0), n, tokens, long=n > long_tokens), _key(F.lit(1), n, lead, before), _key(F.lit(2), n, lead, after)
    if line is not None:
        whole = F.when(constants(tokens) * CONSTANT >= n, whole).otherwise(_key(F.lit(3), line, long=n > long_tokens))
        first = F.when(constants(lead, before) * CONSTANT >= F.size(lead) + F.size(before), first)
        second = F.when(constants(lead, after) * CONSTANT >= F.size(lead) + F.size(after), second)
    # A field that one line writes as a number and another as a word gives the same template.
    without = lambda p: F.concat(F.slice(tokens, F.lit(1), p - 1), F.array(F.lit("<*>")), F.slice(tokens, p + 1, n))
    each = F.transform(F.filter(F.sequence(F.lit(1), n), lambda p: F.get(tokens, p - 1) != "<*>"), lambda p: _key(F.lit(0), n, without(p)))
    both = F.array(whole, first, second)
    short = F.when(constants(tokens) > LEAST_CONSTANT, F.concat(F.array(whole), each)).otherwise(F.array(whole))
    return F.when(n >= least_tokens, both if line is None else F.array_compact(both)).otherwise(short)


def drop_template_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, least_tokens: int = 12, least_documents: int = 3, long_tokens: int = 50, long_documents: int = 2, carry: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every document; with ``carry``, the whole row as ``document``.

    Lines are split at \\n. Lines of ``least_tokens`` tokens or more have templates with a variable half after ``depth``
    leading tokens that stay fixed; shorter ones have templates with any one token variable. A template recurs if
    ``least_documents`` documents or more have it, and a line of more than ``long_tokens`` tokens recurs as a whole
    from ``long_documents`` on. The first document of a template, that with the smallest ``doc_id``, keeps its lines. Blank
    lines are never dropped.

    Null or empty text: one blank line, kept; kept_text is ''. Rows that repeat a ``doc_id`` count as one document;
    so do all rows with a null one, which come last in order. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("__doc"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(own).alias("__text"), (F.struct("*").alias("document") if carry else own.alias("text")),
    )
    if carry:  # the text goes once through the shuffle, inside the row
        own = F.coalesce(F.col("document").getField(text_col).cast("string"), F.lit(""))
        line = text.withColumn("text", own)
    else:
        line, own = text, F.col("text")
    line = line.select("__doc", "__text", F.posexplode(F.split("text", "\n")).alias("__line", "line"))
    # Written once, as numbers only: three joins and counts read it, and cutting lines into templates is most of the work.
    key = scratch.write(line.select("__doc", "__text", "__line", F.explode(templates(F.col("line"), depth, least_tokens, long_tokens)).alias("t")).select("__doc", "__text", "__line", "t.*"))
    # Smallest and largest document first: most templates have one document and go before documents are counted.
    # Both are tables of their own, so that Spark can split the rows of a hot template in the joins with them.
    spread = scratch.write(key.groupBy("key", "check").agg(F.min("__doc").alias("first"), F.max("__doc").alias("last")).where("first < last").select("key", "check", "first"))
    several = key.join(spread, ["key", "check"])
    number = several.groupBy("key", "check", "__doc").agg(F.min("first").alias("first"), F.max("long").alias("long")).groupBy("key", "check").agg(F.count("*").alias("documents"), F.min("first").alias("first"), F.max("long").alias("long"))
    number = scratch.write(number.where(F.col("documents") >= F.when(F.col("long"), long_documents).otherwise(least_documents)).select("key", "check", "first"))
    scratch.drop(spread)
    gone = key.join(number, ["key", "check"]).where(F.col("__doc") != F.col("first")).groupBy("__doc", "__text").agg(F.collect_set("__line").alias("__gone"))
    parts = F.split(own, "\n")
    # The places left, by a hash-based difference: linear in the lines of a text, however many it has.
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "__gone")
    kept = F.when(F.col("__gone").isNull(), own).otherwise(let(parts, lambda p: F.array_join(F.transform(left(p), lambda i: F.get(p, i)), "\n")))
    return text.join(gone, ["__doc", "__text"], "left").select(
        "doc_id", F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"), *(["document"] if carry else []))
