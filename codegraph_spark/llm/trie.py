"""A prefix trie over conversations with subtree totals by time-forward processing.

A node is a distinct sequence of first turns (role and text). Every conversation becomes one row per turn with a running sum of hashed
(depth, turn) terms; equal sums at a depth are one node (93 bits of hash). Totals then flow from the leaves to the root: nodes stand in
reverse level order, each takes the messages its children left for it from a priority queue, and leaves one for its parent. A queue
holds ``HELD`` messages and spills the rest as sorted runs to an unnamed file of its task.

Shards are subtrees: nodes that more than a ``MOST_HEAVY``-th of all rows share are heavy, so there are at most ``MOST_HEAVY`` of them, and
the topmost light node of a path is the root of its shard. A shard has at most that share of the conversations, however many share a
first turn. Shard roots leave their messages to heavy nodes, summed before they are shuffled, and the heavy nodes are the last shard.
A chain of turns that one conversation has alone is in one shard; it passes through in constant memory.

Defined results: rows without ``conv_id`` belong to no conversation; null roles and texts are empty; turns go by turn, nulls first, then
role and digest of the text; repeated rows are repeated turns; no conversation gives no node; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegraph_spark.llm.placing import ordered, place, placed, starts
from codegraph_spark.plans.lineage import cut
from codegraph_spark.plans.prefix import running_sum

MOST_HEAVY = 10_000
HEAVY = 256  # conversations; nodes of fewer are never heavy
HELD = 100_000
RUN_CHUNK = 4_096
ENDS_CHUNK = 256
ROOT = "0:0"


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, ``said`` (digest of role and text) and ``n_chars`` (code points of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.unhex(said).alias("said"), F.length(text).cast("long").alias("n_chars"))


def lined_up(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns in order (see ``placing.ordered``) and where every conversation begins."""
    rows = ordered(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "said"])
    return rows, cut(starts(rows, ["conv_id"]))


def whole(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation as it stands: turns (conv_id, depth, said, n_chars) and lengths (conv_id, n)."""
    rows, begins = lined_up(digests(conversations))
    turns = place(rows, begins, ["conv_id"]).select("conv_id", (F.col("pos") + 1).alias("depth"), "said", "n_chars")
    return turns, begins.groupBy("conv_id").agg(F.max("size").alias("n"))


def branched(conversations: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths where conversation c begins with the first h turns of c - c % every, h = crc32(c) % most, before its own from h on."""
    rows, begins = lined_up(digests(conversations))
    base = F.col("conv_id") - F.col("conv_id") % every
    first = place(rows, begins, ["conv_id"]).where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1))
    first = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "said", "n_chars"))).alias("first"))
    sizes = begins.groupBy("conv_id").agg(F.max("size").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    facts = sizes.withColumns({"base": base, "h": h}).join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.least("h", F.coalesce(F.size("first"), F.lit(0))).cast("long")
    facts = cut(facts.select("conv_id", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"), "first"))
    moved = cut(begins.join(facts.select("conv_id", "h", "taken"), "conv_id"))
    own = place(rows, moved, ["conv_id"]).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "said", "n_chars")
    lent = facts.where("taken > 0").select("conv_id", F.explode(F.slice("first", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    return own.unionByName(lent.select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.said", "t.n_chars")), facts.select("conv_id", "n")


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n_chars, ``node`` and ``parent`` of every turn."""
    high = F.xxhash64(F.lit(1), "depth", "said").bitwiseAND(F.lit((1 << 63) - 1)).cast("decimal(19,0)")
    low = F.pmod(F.xxhash64(F.lit(2), "depth", "said"), F.lit(10**9)).cast("decimal(9,0)")
    term = (high * F.lit(10**9).cast("decimal(10,0)") + low).cast("decimal(28,0)")
    summed = running_sum(turns.select("conv_id", "depth", "n_chars", term.alias("term")), ["conv_id"], "depth", F.col("term"), "upto")
    named = lambda d, s: F.concat(d.cast("string"), F.lit(":"), s.cast("string"))
    upto = F.col("upto").cast("decimal(38,0)")
    return summed.select("conv_id", "depth", "n_chars", named(F.col("depth"), upto).alias("node"), named(F.col("depth") - 1, upto - F.col("term")).alias("parent"))


class SpillingQueue:
    """Messages (order, children, leaves, saved) by order; beyond ``held`` they wait on disk in sorted runs."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.n_runs = held, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self.heap.sort()
            file = tempfile.TemporaryFile()
            for lo in range(0, len(self.heap), RUN_CHUNK):
                pickle.dump(self.heap[lo : lo + RUN_CHUNK], file)
            file.seek(0)
            self.heap = []
            self._advance(self.n_runs, _stored(file))
            self.n_runs += 1

    def _advance(self, number: int, run) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, run))

    def take(self, order: tuple):
        """All messages of ``order``, which no later message precedes."""
        while self.heap and self.heap[0][0] == order:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][0] == order:
            head, number, run = heapq.heappop(self.runs)
            self._advance(number, run)
            yield head

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def _stored(file):
    while True:
        try:
            yield from pickle.load(file)
        except EOFError:
            file.close()
            return


NODE = "node string, parent string, anchor string, conv_id long, depth long, n_convs long, n_chars long, in_children long, in_leaves long, in_saved long"
TOTALS = "n_children long, n_leaves long, saved_tokens long"


def time_forward(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """The nodes with n_children, n_leaves and saved_tokens; partitions hold whole shards in reverse level order."""

    def run(batches):
        queue = SpillingQueue(held)
        for b in batches:
            children_of, leaves_of, saved_of = [], [], []
            cols = [b.column(c).to_pylist() for c in ("node", "parent", "anchor", "depth", "n_convs", "n_chars", "in_children", "in_leaves", "in_saved")]
            for node, parent, anchor, depth, n, chars, children, leaves, saved in zip(*cols, strict=True):
                for _, c, below, s in queue.take((-depth, node)):
                    children, leaves, saved = children + c, leaves + below, saved + s
                leaves = leaves if children else 1
                saved += (n - 1) * chars
                if parent is not None and node != anchor:
                    queue.push(((1 - depth, parent), 1, leaves, saved))
                children_of.append(children)
                leaves_of.append(leaves)
                saved_of.append(saved)
            totals = [pa.array(x, pa.int64()) for x in (children_of, leaves_of, saved_of)]
            yield pa.RecordBatch.from_arrays([*b.columns, *totals], [*b.schema.names, "n_children", "n_leaves", "saved_tokens"])
        if len(queue):
            raise RuntimeError("messages without a receiver: a shard was torn apart")

    return nodes.mapInArrow(run, f"{NODE}, {TOTALS}")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node`` and ends_sha256, the digest of its ascending, comma-joined ``conv_id``; long lists are joined in chunks and hashed as a stream."""
    at = placed(ends, ["node"], ["conv_id"])
    chunk = at.groupBy("node", F.floor(F.col("pos") / ENDS_CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunk = chunk.select("node", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches):
        node, digest = None, None
        for b in batches:
            names, found = [], []
            for name, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if name == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    names.append(node)
                    found.append(digest.hexdigest())
                node, digest = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    return chunk.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(run, "node string, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, most_heavy: int = MOST_HEAVY, heavy: int = HEAVY, held: int = HELD) -> DataFrame:
    """Per node: node, parent, conv_id (smallest member), parent_conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = cut(paths(turns))
    none = F.lit(0).cast("long")
    nodes = rows.groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars")
    )
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), "conv_id", none.alias("depth"), "n_convs", none.alias("n_chars"))
    nodes = cut(nodes.unionByName(top))
    bound = max(heavy, math.ceil(rows.count() / most_heavy))
    is_heavy = (F.col("n_convs") > bound) | (F.col("depth") == 0)
    upper = cut(nodes.where(is_heavy))  # at most most_heavy nodes and the root
    names = F.broadcast(upper.select("node"))
    anchors = rows.join(names, "node", "left_anti").groupBy("conv_id").agg(F.min_by("node", "depth").alias("anchor"))
    lower = nodes.where(~is_heavy).join(anchors, "conv_id").withColumns({"in_children": none, "in_leaves": none, "in_saved": none})
    columns = [c.split()[0] for c in NODE.split(", ")]
    lower = lower.select(*columns).repartition("anchor").sortWithinPartitions(F.desc("depth"), "node")
    lower = cut(time_forward(lower, held))
    sent = lower.where("node = anchor").groupBy("parent").agg(F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))
    last = upper.join(sent.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["in_children", "in_leaves", "in_saved"])
    last = last.withColumn("anchor", F.lit(None).cast("string")).select(*columns).repartition(1).sortWithinPartitions(F.desc("depth"), "node")
    last = time_forward(last.withColumn("anchor", F.lit("")), held)
    every = lower.unionByName(last).drop("anchor", "n_chars", "in_children", "in_leaves", "in_saved")
    # parents that many share are met in a broadcast join, the others in a shuffle
    above = F.broadcast(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    below = lower.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    under = every.where("depth > 0").join(above, "parent", "left")
    at_light = under.where("parent_conv_id is null").drop("parent_conv_id").join(below, "parent")
    every = under.where("parent_conv_id is not null").unionByName(at_light).unionByName(every.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    last_turn = rows.join(lengths.withColumnRenamed("n", "depth"), ["conv_id", "depth"]).select("node", "conv_id")
    ends = ends_digests(last_turn.unionByName(lengths.where("n = 0").select(F.lit(ROOT).alias("node"), "conv_id")))
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
