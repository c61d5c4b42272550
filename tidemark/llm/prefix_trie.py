"""A z-fast trie of conversations (operator 11): which turns conversations share from their start, and what sharing saves.

Nodes of the trie are compacted: one for each place where conversations part or end, with all turns since the node above on
its edge.  A node is found by the hash of its handle, the prefix whose length is the number with the most trailing zero bits
among the depths of its edge.  A conversation of n turns finds the deepest node whose handle it begins with, its exit, by fat
binary search: some log2(n) joins with the handles.  Conversations are inserted in batches.  A batch has one conversation for
each first turn that leaves the trie at an exit, taken by hash; edges that conversations leave in the middle are split, and
the others of the same turn are located anew, from there on.  Where a batch takes one of many, it leaves of each other only
those that go further together with it, half of them on average, so that batches are about as many as the logarithm of the
conversations, and no more than turns in the longest one.  At the end edges are expanded into one node a turn.

Counts of subtrees are sums by doubling: each node sends its sum to the node 1, 2, 4, .. levels above, so that a trie of h
levels takes log2(h) rounds.  Conversations that end at one node are counted before, and their ids are joined in sorted
blocks, which one task hashes as they come.

A turn is 16 bytes of its SHA-256 hash and a number, its length.  A conversation's turns are one row of 24 bytes each; nothing
else is collected.  Texts are shuffled once, to be put in order.

* null role or text: empty; null turn: before all others; equal turn numbers: by role, then text
* repeated rows: turns like any other; null ``conv_id``: no conversation, left out
* an empty table: no nodes; a conversation without turns belongs to the root alone
* very long texts: their hash and length are what is kept; columns other than the four named ones are not read
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

BYTES = 16
#: Key of the root, which has no turn.
ROOT = bytes(BYTES)
#: Characters of a block of joined ids.
BLOCK_CHARS = 1 << 16

NODE = ("id", "up", "handle", "first", "start", "end", "edge", "chars")


def conversations(convs: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the digest and length of each turn in order, one row a conversation."""
    role, text = F.coalesce(convs["role"], F.lit("")), F.coalesce(convs["text"], F.lit(""))
    rows = convs.select("conv_id", "turn", role.alias("role"), text.alias("text")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.unhex(F.substring(F.sha2(said, 256), 1, 2 * BYTES))
    placed = rows.select("conv_id", F.row_number().over(order).alias("pos"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    turns = F.array_sort(F.collect_list(F.struct("pos", "digest", "chars")))
    return placed.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first turns are those of the group's first conversation, up to ``heads`` - 1 of them by hash of the id."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("start"))
    keyed = own.select("conv_id", "turns", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    none = F.array().cast(own.schema["turns"].dataType)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return keyed.join(base, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("start", none), F.lit(1), F.col("h")), rest).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``(conv_id, key, len, path, chars)``: hashes of all prefixes on end, that of the whole, and lengths summed up to each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column(1):
                at, path = ROOT, []
                for digest in (t["digest"].as_py() for t in turns):
                    at = hashlib.blake2b(at + digest, digest_size=BYTES).digest()
                    path.append(at)
                out.append((at, len(path), b"".join(path), np.cumsum([0, *(t["chars"].as_py() for t in turns)]).tolist()))
            key, n, path, chars = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(path, pa.binary()), pa.array(chars, pa.list_(pa.int64()))], ["conv_id", "key", "len", "path", "chars"])

    return convs.mapInArrow(run, f"conv_id {convs.schema['conv_id'].dataType.simpleString()}, key binary, len int, path binary, chars array<long>")


def _at(path: Column, depth: Column) -> Column:
    """The hash of a path's first ``depth`` turns."""
    return F.when(depth == 0, F.lit(ROOT)).otherwise(F.substr(path, BYTES * (depth - 1) + 1, F.lit(BYTES)))


def fattest(low: Column, high: Column) -> Column:
    """The number above ``low``, up to ``high``, with the most trailing zero bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", high, _bits(low, high)), _bits(low, high)).cast("int")


def _bits(low: Column, high: Column) -> Column:
    return F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1


def _matches(path: Column, start: Column, end: Column, edge: Column) -> Column:
    """How many turns of an edge (start, end] ``path`` has, whose hashes are equal as long as the turns before are."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(end - start, F.lit(1))), lambda d: F.substr(path, BYTES * (start + d - 1) + 1, F.lit(BYTES)) == F.substr(edge, BYTES * (d - 1) + 1, F.lit(BYTES))))


def _node(start: Column, end: Column, up: Column, edge: Column, chars: Column) -> list[Column]:
    """Columns of a node: ``edge`` and ``chars`` begin after and at ``start``."""
    handle = fattest(start, end)
    return [_at(edge, end - start).alias("id"), up.alias("up"), _at(edge, handle - start).alias("handle"), _at(edge, F.lit(1)).alias("first"), start.alias("start"), end.alias("end"), edge.alias("edge"), chars.alias("chars")]


def locate(pending: DataFrame, nodes: DataFrame | None, longest: int) -> DataFrame:
    """``pending`` (key, len, path, chars, low) with ``depth``, where each leaves the trie, and ``inside``, the edge that it leaves in the middle, or null.

    ``low`` is the depth of a node that lies on the conversation's way.
    """
    own = ("key", "len", "path", "chars")
    if nodes is None:
        return pending.select(*own, F.col("low").alias("depth"), F.lit(None).cast("binary").alias("inside"))
    none = F.lit(None)
    q = pending.select(*own, "low", F.col("low").alias("a"), F.col("len").alias("b"), none.cast("binary").alias("hit"), none.cast("int").alias("hit_start"), none.cast("int").alias("hit_end"), none.cast("binary").alias("hit_edge"))
    found, children = (nodes.select(F.col(c).alias("sought"), F.col("id").alias("n_id"), F.col("start").alias("n_start"), F.col("end").alias("n_end"), F.col("edge").alias("n_edge")) for c in ("handle", "first"))
    # A key of 17 bytes is nobody's: searches that are over don't meet under null.
    nobody = F.concat("key", F.lit(b"\0"))
    for _ in range(longest.bit_length() + 1):
        f = fattest(F.col("a"), F.col("b"))
        sought = F.when(F.col("a") < F.col("b"), _at(F.col("path"), f)).otherwise(nobody)
        met = q.withColumn("sought", sought).join(found, "sought", "left")
        yes, going = F.col("n_id").isNotNull(), F.col("a") < F.col("b")
        q = met.select(
            *own, "low",
            F.when(yes, F.col("n_end")).otherwise(F.col("a")).alias("a"),
            F.when(going & ~yes, f - 1).otherwise(F.col("b")).alias("b"),
            *(F.when(yes, F.col(f"n{c}")).otherwise(F.col(f"hit{c or ''}")).alias(f"hit{c}") for c in ("_start", "_end", "_edge")),
            F.when(yes, F.col("n_id")).otherwise(F.col("hit")).alias("hit"),
        )
    depth = F.when(F.col("hit").isNull(), F.col("low")).otherwise(F.col("hit_start") + _matches(F.col("path"), F.col("hit_start"), F.col("hit_end"), F.col("hit_edge")))
    left = q.withColumn("depth", depth).withColumn("whole", F.col("hit").isNull() | (F.col("depth") == F.col("hit_end")))
    # At a node, the exit may be the child of the next turn, whose handle is deeper than where they part.
    child = F.when(F.col("whole") & (F.col("depth") < F.col("len")), _at(F.col("path"), F.col("depth") + 1)).otherwise(nobody)
    met = left.withColumn("sought", child).join(children, "sought", "left")
    in_child = F.col("n_id").isNotNull()
    below = F.col("n_start") + _matches(F.col("path"), F.col("n_start"), F.col("n_end"), F.col("n_edge"))
    out = met.select(*own, F.when(in_child, below).otherwise(F.col("depth")).alias("depth"), F.when(in_child, F.col("n_id")).when(~F.col("whole"), F.col("hit")).alias("edge_id"), F.when(in_child, F.col("n_end")).otherwise(F.col("hit_end")).alias("edge_end"))
    return out.select(*own, "depth", F.when(F.col("depth") < F.col("edge_end"), F.col("edge_id")).alias("inside"))


def inserted(exits: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The nodes with edges split and one conversation for each turn that leaves at an exit, and that conversations' nodes alone."""
    out = exits.filter("depth < len").withColumn("next", _at(F.col("path"), F.col("depth") + 1))
    taken = out.groupBy("next").agg(F.min_by(F.struct("path", "len", "depth", "chars"), F.struct(F.xxhash64("key"), F.col("key"))).alias("x")).select("x.*")
    rest = lambda c, i: F.slice(c, i + 1, F.greatest(F.size(c), F.lit(1)))
    edge = F.substr("path", BYTES * F.col("depth") + 1, BYTES * (F.col("len") - F.col("depth")))
    leaves = taken.withColumn("edge", edge).withColumn("tail", rest(F.col("chars"), F.col("depth"))).withColumn("up", _at(F.col("path"), F.col("depth")))
    leaves = leaves.select(*_node(F.col("depth"), F.col("len"), F.col("up"), F.col("edge"), F.col("tail")))
    if nodes is None:
        return leaves, leaves
    cuts = exits.filter("inside is not null").groupBy(F.col("inside").alias("id")).agg(F.array_sort(F.collect_set("depth")).alias("cuts"))
    parts = nodes.join(cuts, "id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    parts = parts.withColumn("ends", F.concat("cuts", F.array("end"))).withColumn("starts", F.concat(F.array("start"), F.col("cuts")))
    parts = parts.withColumn("x", F.explode(F.arrays_zip("starts", "ends")))
    low, high = F.col("x.starts") - F.col("start"), F.col("x.ends") - F.col("start")
    piece = F.substr("edge", BYTES * low + 1, BYTES * (high - low))
    parts = parts.select(F.col("x.starts").alias("s"), F.col("x.ends").alias("e"), F.when(low == 0, F.col("up")).otherwise(_at(F.col("edge"), low)).alias("u"), piece.alias("p"), F.slice("chars", low + 1, high - low + 1).alias("c"))
    return parts.select(*_node(F.col("s"), F.col("e"), F.col("u"), F.col("p"), F.col("c"))).unionByName(leaves), leaves


def trie(sequences: DataFrame) -> DataFrame:
    """Compacted nodes ``NODE`` but the root, from distinct ``sequences`` (key, len, path, chars), in batches."""
    pending = sequences.filter("len > 0").select("key", "len", "path", "chars", F.lit(0).alias("low"))
    nodes, longest = None, sequences.agg(F.max("len")).first()[0] or 0
    while True:
        exits = stored(locate(pending, nodes, longest), "trie-exits")
        grown, leaves = inserted(exits, nodes)
        nodes = stored(grown, "trie-nodes")
        going = exits.filter("depth < len")
        left = going.agg(F.count("*").alias("all"), F.count_distinct(_at(F.col("path"), F.col("depth") + 1)).alias("taken")).first()
        if left["all"] == left["taken"]:
            return nodes
        pending = going.join(nodes.select(F.col("id").alias("key")), "key", "left_anti").select("key", "len", "path", "chars", F.col("depth").alias("low"))


def subtrees(values: DataFrame, above: DataFrame, sums: tuple[str, ...], least: str) -> DataFrame:
    """``values`` (id, ..) with ``sums`` and the minimum ``least`` over each node and all below it; ``above`` has (id, up).

    After k rounds a node has what lies less than 2^k levels below it, and its link leads 2^k levels up.
    """
    links = stored(above, "trie-links")
    while not links.isEmpty():
        sent = links.join(values, "id").groupBy(F.col("up").alias("id")).agg(*(F.sum(c).alias(f"in_{c}") for c in sums), F.min(least).alias("in_least"))
        got = values.join(sent, "id", "left")
        values = stored(got.select("id", *((F.col(c) + F.coalesce(f"in_{c}", F.lit(0))).alias(c) for c in sums), F.least(F.col(least), F.col("in_least")).alias(least)), "trie-sums")
        links = stored(links.join(links.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up")), "trie-links")
    return values


def joined_hashes(rows: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: SHA-256 of each key's ids, ascending and joined by commas, from rows (key, conv_id).

    Ids are joined in blocks where they lie sorted by range; one task hashes a key's blocks one after the other.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, out = None, None, [], 0, []

        def cut() -> None:
            nonlocal ids, size
            if ids:
                out.append((key, first, ",".join(ids)))
            ids, size = [], 0

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or size >= BLOCK_CHARS:
                    cut()
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(out)
            out = []
        cut()
        yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        keys, firsts, texts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if k != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_py().encode())
            yield _hashes(out)
        if digest is not None:
            yield _hashes([(key, digest.hexdigest())])

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        keys, texts = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["key", "ends_sha256"])

    laid = rows.select("key", F.col("conv_id").cast("long").alias("conv_id")).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = laid.mapInArrow(blocks, "key binary, first long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def shared_prefixes(members: DataFrame) -> DataFrame:
    """Every node of the trie of ``members`` (``paths``), edges expanded to one node a turn.

    ``(node, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: ``node`` is the
    prefix's hash, ``conv_id`` its smallest member, ``saved_tokens`` characters of last turns over the subtree, each times the
    members that need not repeat them.
    """
    members = stored(members, "trie-members")
    ends = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")), "trie-ends")
    known = members.select(F.col("conv_id").alias("least"), "len", "path", "chars")
    sequences = stored(ends.join(known, "least").select("key", "n", "least", "len", "path", "chars"), "trie-sequences")
    nodes = trie(sequences.select("key", "len", "path", "chars"))

    # The characters that a subtree saves are those of its members from there on, less those of its edges.
    zero = F.lit(0).cast("long")
    ended = sequences.select(F.col("key").alias("id"), "n", "least", (F.col("n") * F.get("chars", F.col("len"))).alias("told"))
    kids = nodes.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    root = ends.limit(1).select(F.lit(ROOT).alias("id"), zero.alias("written"))
    every = root.unionByName(nodes.select("id", (F.element_at("chars", -1) - F.element_at("chars", 1)).alias("written"))).join(kids, "id", "left")
    every = stored(every.withColumn("n_children", F.coalesce("n_children", zero)), "trie-kids")
    own = every.join(ended, "id", "left").select("id", F.coalesce("n", zero).alias("n"), F.coalesce("told", zero).alias("told"), "written", (F.col("n_children") == 0).cast("long").alias("leaves"), "least")
    sums = subtrees(stored(own, "trie-sums"), nodes.select("id", "up"), ("n", "told", "written", "leaves"), "least")

    hashes = joined_hashes(members.select("key", "conv_id")).withColumnRenamed("key", "id")
    last = sums.join(every.select("id", "n_children"), "id").join(hashes, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    last = stored(last, "trie-last")
    top = last.filter(F.col("id") == F.lit(ROOT)).select(F.col("id").alias("node"), F.lit(0).alias("depth"), F.col("least").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), (F.col("told") - F.col("written")).alias("saved_tokens"), "ends_sha256")
    above = last.select(F.col("id").alias("up"), F.col("least").alias("above"))
    each = nodes.join(last, "id").join(above, "up").withColumn("depth", F.explode(F.sequence(F.col("start") + 1, F.col("end"))))
    is_end, before = F.col("depth") == F.col("end"), F.get("chars", F.col("depth") - F.col("start") - 1)
    # Of the edge itself, only what lies above this depth is not the subtree's.
    written = F.col("written") - (before - F.get("chars", F.lit(0)))
    return top.unionByName(
        each.select(
            _at(F.col("edge"), F.col("depth") - F.col("start")).alias("node"),
            "depth",
            F.col("least").alias("conv_id"),
            F.when(F.col("depth") == F.col("start") + 1, F.col("above")).otherwise(F.col("least")).cast("long").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(is_end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("told") - F.col("n") * before - written).alias("saved_tokens"),
            F.when(is_end, F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
