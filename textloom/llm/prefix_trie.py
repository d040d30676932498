"""The trie of conversation prefixes, built level by level.

Conversations that begin with the same turns share the nodes of these turns. At each depth the live conversations are
grouped by (parent node, next turn); the smallest conv_id of a group names its node. A conversation that is alone in its
node has no more to share: the rest of it is a chain that is written down at once. Then levels are joined from the
deepest to the root, which rolls up leaves and savings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch

#: Members of a node are first grouped in so many parts, so that no task sees a large node whole.
PARTS = 64
#: What belongs to one conversation is joined to its turns in blocks of so many turns.
BLOCK = 1024
_NOBODY = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(scratch: Scratch, conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, piece, at, key, n_bytes) in order, and the pieces of conversations (conv_id, piece, first, before, n).

    A conversation is dealt out by ranges of its turns; a turn's place is ``before + at - first + 1``. So a conversation
    that holds most of all turns is numbered by many tasks, and only counts of pieces meet. Texts stay behind: a turn
    goes on as its digest.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes")).where("conv_id IS NOT NULL")
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # copies of one turn, too, may lie in several ranges
    order = ["conv_id", "turn", "key", "row"]
    turns = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).select("conv_id", F.shiftright("at", 33).alias("piece"), "at", "key", "n_bytes"))
    of = Window.partitionBy("conv_id")
    pieces = turns.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    return turns, pieces.select("conv_id", "piece", "first", F.coalesce(F.sum("m").over(of.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(of).alias("n"))


def rebuilt_conversations(conversations: DataFrame, *, every: int = 5, most: int = 8, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame, Scratch]:
    """Conversations that begin with turns of another: (conv_id, depth, key, n_bytes, last), (conv_id, length), and their scratch tables.

    Conversation c takes the first h turns of c - c % ``every`` (all if it has fewer, none if it is not there), h being
    crc32(decimal c) % (``most`` + 1), then its own turns after its first h. ``%`` has the sign of c, as in SQL.

    Turns are ordered by ``turn``, null first; of equal ones by digest of role and text. Null role or text: empty. Rows
    without a ``conv_id`` take no part; repeated rows are turns each for itself. No order of input rows plays a part.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, pieces = numbered_turns(scratch, conversations, conv_col, turn_col, role_col, text_col)
    pieces = scratch.write(pieces)
    every_ = F.lit(every).cast("long")
    own = pieces.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every_).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = scratch.write(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("n_base"))
    placed = turns.join(pieces.join(convs.drop("n"), "conv_id"), ["conv_id", "piece"]).withColumn("place", F.col("before") + F.col("at") - F.col("first") + 1)
    rest = placed.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "key", "n_bytes", "length")
    heads = placed.where((F.col("place") <= most) & (F.col("conv_id") == F.col("base"))).select("base", F.col("place").alias("depth"), "key", "n_bytes")
    lent = heads.join(convs, "base").where("depth <= taken").select("conv_id", "depth", "key", "n_bytes", "length")
    by = ["depth", "conv_id"]
    out = scratch.write(rest.union(lent).select("conv_id", "depth", "key", "n_bytes", (F.col("depth") == F.col("length")).alias("last")).repartitionByRange(*by).sortWithinPartitions(*by))
    scratch.drop(turns, pieces)
    return out, convs.select("conv_id", "length"), scratch


def _members(turns: DataFrame, live: DataFrame) -> DataFrame:
    """The live conversations with their node one level deeper.

    Groups are formed in parts first, and a conversation is joined to the part that it is in, not to the whole group.
    """
    part = F.pmod(F.xxhash64("conv_id"), F.lit(PARTS))
    here = turns.join(live, "conv_id").select("conv_id", F.col("node").alias("parent"), "key", "n_bytes", "last", part.alias("part"))
    parts = here.groupBy("parent", "key", "part").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
    whole = parts.groupBy("parent", "key").agg(F.min("least").alias("node"), F.sum("n").alias("n_convs"))
    return here.join(parts.join(whole, ["parent", "key"]).select("parent", "key", "part", "node", "n_convs"), ["parent", "key", "part"]).select("conv_id", "node", "parent", "n_convs", "n_bytes", "last")


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each (depth, node), ascending and comma-joined.

    Ids are sorted over ranges and joined to runs of text by the tasks that hold them; then one task for each node reads
    the runs in order, one batch at a time. A node's digest is a sequence by its nature, but nobody holds all its ids.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for d, node, c in zip(rows["depth"], rows["node"], rows["conv_id"], strict=True):
                if not out or out[-1][:2] != (d, node):
                    out.append((d, node, c, []))
                out[-1][3].append(str(c))
            yield pa.RecordBatch.from_pydict({"depth": pa.array([x[0] for x in out], pa.int64()), "node": pa.array([x[1] for x in out], pa.int64()), "first": pa.array([x[2] for x in out], pa.int64()), "ids": pa.array([",".join(x[3]) for x in out], pa.string())})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        close = lambda: pa.RecordBatch.from_pydict({"depth": pa.array([held[0]], pa.int64()), "node": pa.array([held[1]], pa.int64()), "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for r in batch.to_pylist():
                if held != (r["depth"], r["node"]):
                    if held:
                        yield close()
                    held, state = (r["depth"], r["node"]), hashlib.sha256(r["ids"].encode())
                else:
                    state.update(b"," + r["ids"].encode())
        if held:
            yield close()

    by = ["depth", "node", "conv_id"]
    joined = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(runs, "depth long, node long, first long, ids string")
    return joined.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digests, "depth long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, depth from 1, key, n_bytes, last), without gaps, ``lengths`` (conv_id, length) for every
    conversation, those without turns, too. Node ids, members, children, leaves (childless nodes of the subtree, itself
    included), savings (for each node of the subtree its members but one, times the bytes of its last turn) and the
    digest of the conversations that end there. Jobs grow with the longest prefix that two conversations share, not with
    the longest conversation. Tables of a level go to the shared folder, so no lineage grows over levels and a lost
    executor costs its tasks alone.

    An empty table has no node at all, not even a root.
    """
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    root = lengths.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    many = root["n"] > 1
    level = scratch.write(lengths.select("conv_id", F.lit(root["node"]).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(root["n"]).alias("n_convs"), F.lit(0).cast("long").alias("n_bytes"), (F.col("length") == 0).alias("last")))
    levels = [level]
    live = lambda t: t.where("n_convs > 1 AND NOT last").select("conv_id", "node")
    while many and not live(level).isEmpty():
        level = scratch.write(_members(turns.where(F.col("depth") == len(levels)).drop("depth"), live(level)))
        levels.append(level)
    # One row for each node: a group is summed by tasks before it meets.
    nodes = [t.groupBy("node").agg(F.first("parent").alias("parent"), F.first("n_convs").alias("n_convs"), F.first("n_bytes").alias("n_bytes"), F.count_if("last").alias("n_ends")) for t in levels]
    each = [t.withColumn("depth", F.lit(d).cast("long")) for d, t in enumerate(levels)]
    ends = _union([t.where("n_convs > 1 AND last").select("depth", "node", "conv_id") for t in each])
    digests = scratch.write(_end_digests(ends))
    rolled: list[DataFrame] = []
    for d in reversed(range(len(levels))):
        n = nodes[d]
        alone = F.col("n_convs") == 1
        if rolled:
            below = rolled[-1].groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            n = n.join(below, "node", "left")
        else:
            n = n.select("*", *(F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")))
        rolled.append(scratch.write(n.select(
            "node", F.lit(d).cast("long").alias("depth"), "parent", "n_convs", "n_ends",
            F.when(alone, 1 - F.col("n_ends")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))))
    upper = _union(rolled)
    chain = _chains(turns, upper.where("n_convs = 1 AND n_ends = 0").select(F.col("node").alias("conv_id"), F.col("depth").alias("top")).join(lengths, "conv_id"))
    upper = upper.join(digests, ["depth", "node"], "left")
    digest = F.when(F.col("n_ends") == 0, F.lit(_NOBODY)).when(F.col("n_convs") == 1, F.sha2(F.col("node").cast("string"), 256)).otherwise(F.col("ends_sha256"))
    out = upper.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))
    scratch.drop(*levels)
    return out.union(chain)


def _chains(turns: DataFrame, alone: DataFrame) -> DataFrame:
    """The nodes below those that one conversation has for itself, (conv_id, top, length): one for each further turn.

    A conversation meets its turns in blocks, so that a very long one is no hot key.
    """
    blocks = alone.select("conv_id", "top", F.explode(F.sequence(F.floor((F.col("top") + 1) / BLOCK), F.floor(F.col("length") / BLOCK))).alias("block"))
    rows = turns.withColumn("block", F.floor(F.col("depth") / BLOCK)).join(blocks, ["conv_id", "block"]).where("depth > top")
    one, ends = F.lit(1).cast("long"), F.sha2(F.col("conv_id").cast("string"), 256)
    return rows.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("last"), ends).otherwise(F.lit(_NOBODY)).alias("ends_sha256"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
