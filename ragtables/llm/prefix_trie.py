"""Prefix trie of conversations by a splitter skeleton.

Conversations are paths: strings of 16 bytes per turn, a digest of role and text. Sorted paths are dealt into ranges. A
node (a prefix) has members in several ranges only if it is a prefix of the last path of one range and of the first path
of the next, so these shared prefixes, the trie of the places where the sorted paths are split, are the skeleton. Of it
two depths per range are broadcast: how far its first path agrees with the path before it, and its last path with the
path after it. Each task walks its sorted paths with a stack and finishes all other nodes; of a skeleton node it gives out
a partial aggregate. All parts of these add up: what counts once for a node is counted in the range where the node
begins or ends. One reduction by node gives the rest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtables.llm.common import broadcast_checked, words_of
from ragtables.session import materialize

#: Each conversation takes its first turns from that with the next lower multiple of BLOCK; their number is below HEADS.
BLOCK, HEADS = 20, 4
#: Bytes of a turn in a path.
STEP = 16
TURNS_PER_RANGE, MOST_RANGES = 8_192, 32_768
#: Ids of the conversations that end at a skeleton node go on in strings of about so many bytes.
ENDS_BYTES = 1 << 18


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words): 16 bytes of a hash of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(key, 1, 2 * STEP)).alias("digest"), F.size(words_of(F.col("text"))).alias("words"))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation c, rebuilt: the first h turns of conversation c - c % 20, then its own after
    its first h, where h is the crc32 of c as decimal text, modulo 4. Texts are digested before the shuffle."""
    turns = digested(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("t"))
    whole = materialize(turns.select("conv_id", F.col("t.digest").alias("d"), F.col("t.words").alias("w")), "turns")
    heads = whole.filter(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("base"), F.slice("d", 1, HEADS - 1).alias("hd"), F.slice("w", 1, HEADS - 1).alias("hw"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", h).join(heads, "base", "left")

    def joined(own, head):
        start = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(whole.schema[own].dataType))
        return F.concat(start, F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))

    # An empty piece makes the result binary where there are no turns.
    path = F.aggregate(joined("d", "hd"), F.lit(b""), lambda a, x: F.concat(a, x))
    return both.select("conv_id", path.alias("path"), joined("w", "hw").alias("words"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two paths have in common at their start."""
    return len(os.path.commonprefix((a, b))) // STEP


@dataclass
class Node:
    """An open node of the walk, with sums over what the range has of it so far."""

    begins: bool
    words: int = 0
    key: bytes | None = None
    conv_id: int | None = None
    convs: int = 0
    children: int = 0
    inner: bool = False
    leaves: int = 0
    saved: int = 0
    ends: bytearray = field(default_factory=bytearray)
    waiting: list[tuple] = field(default_factory=list)


_NODE = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                   ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("range", pa.int64()),
                   ("ends", pa.binary())])
_NODE_COLUMNS = ("kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                 "saved_tokens long, ends_sha256 string, node binary, parent binary, range long, ends binary")
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Finished nodes, those that lack the conversation of a parent in the skeleton, and parts of skeleton nodes.
FINISHED, HANGING, PART = "finished", "hanging", "part"
ROWS = 4_096


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """Names of the prefixes of 0 to ``depth`` turns."""
    sha, keys = hashlib.sha256(), []
    for d in range(depth + 1):
        keys.append(sha.digest()[:STEP])
        sha.update(path[d * STEP : (d + 1) * STEP])
    return keys


class Walk:
    """Nodes of one range from its paths in order; rows come out in ``out``.

    The prefixes of up to ``low`` turns of the first path have members in an earlier range, those of up to ``high`` turns
    of the last path in a later one; -1 stands for none. Memory holds the nodes of the range that wait for their parent.
    """

    def __init__(self, number: int, low: int, high: int):
        self.number, self.low, self.high = number, low, high
        self.path: bytes | None = None
        self.stack: list[Node] = []
        self.out: list[tuple] = []

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        if self.path is None:
            keys = prefix_keys(path, self.low)
            self.stack = [Node(d > self.low, words[d - 1] if d else 0, keys[d] if d <= self.low else None)
                          for d in range(len(path) // STEP + 1)]
            for above, node in zip(self.stack, self.stack[1:], strict=False):
                above.children, above.inner = int(node.begins), True
        else:
            while len(self.stack) > shared_turns(self.path, path) + 1:
                self._close()
            for d in range(len(self.stack), len(path) // STEP + 1):
                self.stack[-1].children += 1
                self.stack[-1].inner = True
                self.stack.append(Node(True, words[d - 1]))
        self.path, last = path, self.stack[-1]
        last.convs += 1
        last.conv_id = conv_id if last.conv_id is None else min(last.conv_id, conv_id)
        last.ends += b",%d" % conv_id

    def finish(self) -> None:
        """Close all nodes; of the last path some go on in a later range."""
        for node, key in zip(self.stack, prefix_keys(self.path, self.high), strict=False):
            node.key = key
        while self.stack:
            self._close(len(self.stack) - 1 <= self.high)

    def _close(self, goes_on: bool = False) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if not goes_on and not node.inner:
            node.leaves += 1
        # Once for each member, less once for the node.
        node.saved += node.words * (node.convs - node.begins)
        if above:
            above.convs += node.convs
            above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
            above.leaves += node.leaves
            above.saved += node.saved
        sums = (node.convs, node.children, node.leaves, node.saved)
        ends = bytes(node.ends[1:])
        if node.key is None:
            row = (node.conv_id, depth, *sums, hashlib.sha256(ends).hexdigest())
            if above:
                above.waiting.append(row)
            else:
                self.out.append(_row(FINISHED, row, None))
            self.out.extend(_row(FINISHED, r, node.conv_id) for r in node.waiting)
        else:
            self.out.append((PART, node.conv_id, depth, None, *sums, None, node.key, above.key if above else None, self.number, ends))
            self.out.extend(_row(HANGING, r, None, node.key) for r in node.waiting)


def _row(kind: str, row: tuple, parent_conv: int | None, parent: bytes | None = None) -> tuple:
    conv_id, depth, *rest = row
    return (kind, conv_id, depth, parent_conv, *rest, None, parent, None, None)


def _walked(depths):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for number, conv_id, path, words in zip(*(batch.column(c).to_pylist() for c in ("range", "conv_id", "path", "words")), strict=True):
                if walk is None or number != walk.number:
                    if walk:
                        walk.finish()
                        yield from (batch_of(walk.out[i : i + ROWS]) for i in range(0, len(walk.out), ROWS))
                    walk = Walk(number, *depths.value[number])
                walk.add(conv_id, path, words)
                if len(walk.out) >= ROWS:
                    yield batch_of(walk.out)
                    walk.out = []
        if walk:
            walk.finish()
            yield from (batch_of(walk.out[i : i + ROWS]) for i in range(0, len(walk.out), ROWS))

    return walked


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, last, before, after = (batch.column(c).to_pylist() for c in ("first", "last", "before", "after"))
        low = [-1 if b is None else shared_turns(b, f) for b, f in zip(before, first, strict=True)]
        high = [-1 if a is None else shared_turns(l, a) for a, l in zip(after, last, strict=True)]
        yield pa.record_batch([batch.column("range"), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["range", "low", "high"])


def skeleton(ranges: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range how many turns its first path shares with the path before it, and its last path with the one after it.

    In the order of the sorted paths these depths give the trie of the splitter paths. Two numbers for each of at most
    ``MOST_RANGES`` ranges.
    """
    ends = ranges.groupBy("range").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("range")
    ends = ends.select("range", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    return {r["range"]: (r["low"], r["high"]) for r in ends.mapInArrow(_borders, "range long, low long, high long").collect()}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from (node, range, ends) in order; the hash reads one range's ids at a time."""
    node, sha, started, rows = None, None, False, []
    for batch in batches:
        for key, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != node:
                if sha:
                    rows.append((node, sha.hexdigest()))
                node, sha, started = key, hashlib.sha256(), False
            sha.update(b"," + ends if started else ends)
            started = True
    if sha:
        rows.append((node, sha.hexdigest()))
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame, turns_per_range: int = TURNS_PER_RANGE) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the module and :func:`rebuilt_paths`.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Turns are ordered by turn, null first, then by a digest of role and text; null roles and texts are empty; repeated
    rows are turns of their own. Rows without conv_id belong to no conversation. A conversation that is rebuilt without
    turns is a member of the root alone. An empty table has no node. Other columns are ignored.

    Paths are dealt into ranges by path and conv_id, so a group of any number of equal conversations is many tasks. A
    range has about ``turns_per_range`` turns (more beyond ``MOST_RANGES`` ranges). A conversation is one cell of 20 bytes a
    turn. The ids that end at a node of the skeleton are hashed by one task per node, as SHA-256 is sequential, from one row per range.
    """
    spark = conversations.sparkSession
    paths = materialize(rebuilt_paths(conversations), "paths")
    turns = paths.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    number = min(MOST_RANGES, turns // turns_per_range + 1)
    ranges = materialize(paths.repartitionByRange(number, "path", "conv_id").withColumn("range", F.spark_partition_id().cast("long")), "ranges")
    depths = spark.sparkContext.broadcast(skeleton(ranges))
    dealt = ranges.select("range", "path", "conv_id", "words").repartition(number, "range").sortWithinPartitions("range", "path", "conv_id")
    rows = materialize(dealt.mapInArrow(_walked(depths), _NODE_COLUMNS), "nodes")

    parts = rows.filter(F.col("kind") == PART)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    reduced = parts.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums)
    ends = parts.filter(F.octet_length("ends") > 0).select("node", "range", "ends")
    hashes = ends.repartition("node").sortWithinPartitions("node", "range").mapInArrow(_hashed, "node binary, ends_sha256 string")
    reduced = materialize(reduced.join(hashes, "node", "left"), "skeleton")
    names = broadcast_checked(reduced.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id")), "names", row_bytes=96)
    none = F.lit(hashlib.sha256().hexdigest())
    reduced = reduced.join(names, F.col("parent") == F.col("of"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    hanging = rows.filter(F.col("kind") == HANGING).drop("parent_conv_id").join(names, F.col("parent") == F.col("of"))
    return rows.filter(F.col("kind") == FINISHED).select(OUT).unionByName(hanging.select(OUT)).unionByName(reduced.select(OUT))
