"""Prefix trie of conversations by collapsing whole sequences.

A node is a distinct sequence of first turns.  Nothing walks the trie turn by
turn: identical conversations are first grouped into one weighted sequence
with a list of the conversations that end there; sequences that are a proper
prefix of another one are dropped by an anti join, and what is left are the
leaves; then the prefixes of the weighted sequences are summed into nodes.

Keys.  A turn's digest covers its role, text and place; the key of a prefix
is its length and the sum of its turns' digests (128 bits in four parts).  A
sum needs no order, so the key of a whole conversation is a plain aggregate,
and the keys of all its prefixes are running sums.  Equal prefixes have equal
keys; different ones meet with probability 2^-128.

Sums over subtrees need no walk either.  A node's saving is
``(n_convs - 1) * chars``.  Summed over a subtree, the first part is what the
members have from this depth on (weight times the rest of the sequence).  The
second part counts every node once: it belongs to the sequence of its
smallest conversation, and a sequence owns its nodes from some depth to its
end.  Both are sums over the prefixes that share a key.

Scale.  Texts are shuffled once, to put turns in order; after that rows are
digests.  A conversation of any length is spread over tasks
(:func:`~quarry.llm.common.in_order`, ``CHUNK``), groups of identical
conversations are summed before the shuffle, nodes with many children are
split by :func:`~quarry.llm.common.join_unique`, and end lists come in pieces
of ``PIECE`` ids.

Edge cases: rows without a conv_id belong to no conversation; a null turn
comes first; equal turns are ordered by role, then text; repeated rows are
turns of their own; a null role or text is empty; other columns do not
matter; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_order, join_unique, map_batches, running, shuffle_partitions, stage_table

GROUP = 100               # conversations that share a template: the one whose id the group starts with
BORROWED = 6              # a conversation borrows fewer turns than this
CHUNK = 65536             # turns of a conversation that are joined as one
PIECE = 4096              # ids in a piece of an end list
PARTS = 4                 # 32-bit parts of a key
_SUMS = [f"s{i}" for i in range(PARTS)]


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``digest`` of role and text, ``chars``."""
    t = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    t = t.withColumns({"digest": F.unhex(F.md5(said)), "chars": F.length("text").cast("bigint")})
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running(in_order(t, "conv_id", order, ["digest", "chars"], "turns"), "conv_id", {"pos": F.lit(1)}).drop("seq")


def _spread(rows: DataFrame, per_conv: DataFrame, length: Column, pos: str, how: str = "inner") -> DataFrame:
    """Join of turns with a table of one row per conversation, in pieces of
    ``CHUNK`` turns, so that a long conversation does not meet in one task."""
    pieces = per_conv.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.floor(length / CHUNK).cast("int"))))
    at = rows.withColumn("__piece", F.floor(F.col(pos) / CHUNK).cast("int"))
    return at.join(pieces, ["conv_id", "__piece"], how).drop("__piece")


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its group's first one."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(BORROWED)).cast("bigint")


def rebuild(turns: DataFrame) -> DataFrame:
    """Rebuilt conversations, ``conv_id, pos, digest, chars``: the first h
    turns of the conversation that starts the group, then the own ones after
    the first h.  Each has a row at ``pos`` 0 with no turn."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    convs = convs.withColumns({"h": borrowed_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    lent = turns.where(F.col("pos") < BORROWED).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    taken = convs.select("conv_id", "base", "h").join(lent, "base").where(F.col("pos") <= F.col("h"))
    n_taken = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    shift = convs.join(n_taken, "conv_id", "left").select("conv_id", "n_own", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    own = _spread(turns, shift, F.col("n_own"), "pos").where(F.col("pos") > F.col("h"))
    columns = ["conv_id", "pos", "digest", "chars"]
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    top = convs.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("chars"))
    return top.unionByName(taken.select(columns)).unionByName(own.select(columns))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with the parts of their digest and place; 0 where there is no turn."""
    full = F.md5(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), F.col("digest")))
    part = {s: F.coalesce(F.conv(F.substring(full, 8 * i + 1, 8), 16, 10).cast("bigint"), F.lit(0)) for i, s in enumerate(_SUMS)}
    return turns.select("conv_id", "pos", "chars", *[c.alias(s) for s, c in part.items()])


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def prefix_trie(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (key, parent, conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens) and ``ends`` (key, piece, conv_ids):
    the conversations that end at a node, ascending, in pieces."""
    turns = stage_table(_placed(rebuilt), "rebuilt")
    whole = turns.groupBy("conv_id").agg(F.max("pos").alias("length"), F.sum("chars").alias("total"), *[F.sum(s).alias(s) for s in _SUMS])
    whole = stage_table(whole.select("conv_id", "length", "total", _key(F.col("length"), [F.col(s) for s in _SUMS]).alias("key")), "whole-conversations")
    ends = end_lists(whole)

    # Weighted sequences, each standing for all conversations that are identical.
    sequences = stage_table(whole.groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.first("length").alias("length"), F.first("total").alias("total")), "sequences")
    kept = _spread(turns, sequences.select("conv_id", "length"), F.col("length"), "pos")
    dealt = in_order(kept, "conv_id", [F.col("pos")], ["pos", "chars", *_SUMS], "sequence-turns")
    sums = {"upto": F.col("chars"), **{f"k{i}": F.col(s) for i, s in enumerate(_SUMS)}}
    upto = running(dealt, "conv_id", sums)
    upto = upto.select("conv_id", F.col("pos").alias("depth"), "chars", "upto",
                       _key(F.col("pos"), [F.col(f"k{i}") for i in range(PARTS)]).alias("key"),
                       F.when(F.col("pos") > 0, _key(F.col("pos") - 1, [F.col(f"k{i}") - F.col(s) for i, s in enumerate(_SUMS)])).alias("parent"))
    weights = sequences.select("conv_id", "weight", "length", "total")
    prefixes = stage_table(_spread(upto, weights, F.col("length"), "depth"), "prefixes")

    # Leaves: sequences that are not a proper prefix of another one.
    proper = prefixes.where("depth < length").select("key").distinct()
    leaves = sequences.join(proper, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    rest = F.col("total") - F.col("upto") + F.col("chars")              # characters from this depth to the sequence's end
    nodes = stage_table(prefixes.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("chars").alias("chars"),
        F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * rest).alias("said")), "trie-nodes")
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("chars").alias("own"))
    per = sequences.select("conv_id", "length").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    own_rest = F.when(F.col("depth") >= F.col("since"), rest).otherwise(F.coalesce("own", F.lit(0)))
    under = (_spread(prefixes.drop("length"), per, F.col("length"), "depth").groupBy("key")
             .agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(own_rest).alias("once")))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    full = stage_table(nodes.join(under, "key").join(children, "key", "left").select(
        "key", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", (F.col("said") - F.col("once")).alias("saved_tokens")), "trie-sums")

    above = full.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    below = join_unique(full.where(F.col("parent").isNotNull()), above, "parent", "__n", full.count()).drop("__n")
    root = full.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return root.unionByName(below), ends


def end_lists(whole: DataFrame) -> DataFrame:
    """(key, piece, conv_ids) from one (conv_id, key) per conversation."""
    ranked = running(in_order(whole, "key", [F.col("conv_id")], ["conv_id"], "ends"), "key", {"rank": F.lit(1)})
    pieces = ranked.groupBy("key", F.floor((F.col("rank") - 1) / PIECE).alias("piece"))
    return pieces.agg(F.sort_array(F.collect_list("conv_id")).alias("conv_ids"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each key; rows come in key and piece order."""
    def done():
        return pa.RecordBatch.from_pydict({"key": [now], "ends_sha256": [state.hexdigest()]}, schema=pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))

    now, state = None, None
    for batch in batches:
        for key, piece, ids in zip(*[batch.column(c).to_pylist() for c in ("key", "piece", "ids")], strict=True):
            if key != now:
                if state is not None:
                    yield done()
                now, state = key, hashlib.sha256()
            state.update((("," if piece else "") + ids).encode())
    if state is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256).  A SHA-256 has no parts that could be joined, so
    the pieces of one list are read one after the other by one task, which
    holds one at a time."""
    text = ends.select("key", "piece", F.concat_ws(",", F.col("conv_ids").cast("array<string>")).alias("ids"))
    dealt = text.repartition(shuffle_partitions(ends.sparkSession), "key").sortWithinPartitions("key", "piece")
    return map_batches(dealt, _digests, "key binary, ends_sha256 string")
