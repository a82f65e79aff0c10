"""Near-duplicate documents by SimHash and a binary trie self-join.

A document's fingerprint has a bit set where over half the hashes of its word shingles have it set. Fingerprints that differ in at most
``max_bits`` bits are linked, and a group is what links reach.

The fingerprints' binary trie is joined with itself: a pair of nodes carries the bits in which its two paths differ, splits into the
pairs of their children, and is dropped as soon as it exceeds the error budget. To spread the trie over tasks the 64 bits are cut into
``BLOCKS`` blocks; two fingerprints within the budget agree in at least ``BLOCKS - max_bits`` blocks, so for every choice of that many
blocks a trie is rooted at paths equal in them and the rest of the bits is searched with the full budget. This loses no link at any
size. Only distinct fingerprints take part, and a task reports a spanning forest of its links, never the pairs of a group.

Defined results: null and empty texts have the fingerprint zero, which is linked like any other; fewer words than a shingle are one
shingle; repeated rows each get their row; rows with a null ``doc_id`` take part but never name a group (a group of only such rows has
a null ``component_id``); other columns do not matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegraph_spark.llm.batches import text_slices
from codegraph_spark.plans.lineage import cut

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
SEED = 42
CHUNK = 1 << 17  # hashes whose bits are unpacked at once
FRONTIER = 1 << 18  # node pairs handled at once
SMALL = 24  # a pair of nodes with so many leaf pairs is compared leaf by leaf


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    n = max(1, len(words) - shingle + 1)
    first = (end - size + 1)[:n].tolist()
    last = end[len(words) - n :].tolist()
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(first[lo : lo + CHUNK], last[lo : lo + CHUNK], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fingerprint (as a long) of every row."""

    def of(batches):
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(_signed([fingerprint(t, shingle) for t in texts]))], ["doc_id", "text_hash", "fingerprint"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fingerprint long")


def block_orders(max_bits: int, blocks: int = BLOCKS) -> list[tuple[list[int], int]]:
    """For each choice of equal blocks: the order of bits (from the top) that puts them first, and how many bits they are."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    spans = [list(range(edges[i], edges[i + 1])) for i in range(blocks)]
    orders = []
    for chosen in combinations(range(blocks), blocks - max_bits):
        head = [b for i in chosen for b in spans[i]]
        orders.append((head + [b for i in range(blocks) if i not in chosen for b in spans[i]], len(head)))
    return orders


def _reorder(values: np.ndarray, order: list[int]) -> np.ndarray:
    out = np.zeros_like(values)
    for to, source in enumerate(order):
        out |= ((values >> np.uint64(63 - source)) & np.uint64(1)) << np.uint64(63 - to)
    return out


def _bits_of(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class _Forest:
    """Component labels of sorted leaves; every union is recorded as an edge."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            other = la != lb
            if not other.any():
                return
            a, b, la, lb = a[other], b[other], la[other], lb[other]
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            # each root takes one smaller root: no cycle can arise
            root, at = np.unique(high, return_index=True)
            self.edges += zip(a[at].tolist(), b[at].tolist(), strict=True)
            label[root] = low[at]
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def settle(self) -> np.ndarray:
        """Runs of equal labels, so that a range of leaves can be seen to be one component."""
        return np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])


def trie_join(leaves: np.ndarray, head: int, max_bits: int) -> list[tuple[int, int]]:
    """Spanning edges (positions) of the links among sorted distinct 64-bit leaves that agree in their first ``head`` bits."""
    n = len(leaves)
    forest = _Forest(n)
    top = leaves >> np.uint64(64 - head) if head else np.zeros(n, np.uint64)
    start = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    stop = np.append(start[1:], n)
    several = stop - start > 1
    start, stop = start[several], stop[several]
    zero = np.zeros(len(start), np.int16)
    stack = [(head, start[i : i + FRONTIER], stop[i : i + FRONTIER], start[i : i + FRONTIER], stop[i : i + FRONTIER], zero[i : i + FRONTIER]) for i in range(0, len(start), FRONTIER)]
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        runs = forest.settle()
        one = (runs[a0] == runs[a1 - 1]) & (runs[b0] == runs[b1 - 1]) & (forest.label[a0] == forest.label[b0])
        size = (a1 - a0) * (b1 - b0)
        leaf = ~one & ((size <= SMALL) | (depth == 64))
        if leaf.any():
            la0, lb0, lb, ls = a0[leaf], b0[leaf], (b1 - b0)[leaf], size[leaf]
            pair = np.repeat(np.arange(len(ls)), ls)
            inside = np.arange(len(pair)) - np.repeat(np.cumsum(ls) - ls, ls)
            i, j = la0[pair] + inside // lb[pair], lb0[pair] + inside % lb[pair]
            near = (i < j) & (_bits_of(leaves[i] ^ leaves[j]) <= max_bits)
            forest.link(i[near], j[near])
        go = ~one & ~leaf
        if not go.any():
            continue
        a0, a1, b0, b1, bits = a0[go], a1[go], b0[go], b1[go], bits[go]
        bit = np.uint64(1) << np.uint64(63 - depth)
        above = ~np.uint64((1 << (64 - depth)) - 1)

        def middle(lo, hi, bit=bit, above=above):
            return np.clip(np.searchsorted(leaves, (leaves[lo] & above) | bit), lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = a0 == b0
        children = [(a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1)]
        swap = ~same
        children.append((am[swap], a1[swap], b0[swap], bm[swap], bits[swap] + 1))
        c = [np.concatenate(x) for x in zip(*children, strict=True)]
        keep = (c[0] < c[1]) & (c[2] < c[3]) & (c[4] <= max_bits) & ~((c[0] == c[2]) & (c[1] - c[0] < 2))
        c = [x[keep] for x in c]
        near_first = np.argsort(-c[4], kind="stable")  # the last chunk is handled first
        c = [x[near_first] for x in c]
        stack += [(depth + 1, *[x[i : i + FRONTIER] for x in c]) for i in range(0, len(c[0]), FRONTIER)]
    return forest.edges


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect what links of at most ``max_bits`` bits connect."""
    orders = block_orders(max_bits, blocks)
    bit = [F.lit(1 << (63 - b) if b else -(1 << 63)) for b in range(64)]
    keys = []
    for i, (order, head) in enumerate(orders):
        mask = F.lit(0).cast("long")
        for b in order[:head]:
            mask = mask.bitwiseOR(bit[b])
        keys.append(F.struct(F.lit(i).alias("trie"), F.col("fingerprint").bitwiseAND(mask).alias("root")))
    rooted = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("k.trie", "k.root", "fingerprint")

    def join(batches):
        got: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            trie, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in np.unique(trie).tolist():
                got.setdefault(i, []).append(value[trie == i].astype(np.int64))
        for i, parts in got.items():
            order, head = orders[i]
            value = np.concatenate(parts).view(np.uint64)
            turned = _reorder(value, order)
            by = np.argsort(turned)
            value, turned = value[by].view(np.int64), turned[by]
            edges = np.array(trie_join(turned, head, max_bits), np.int64).reshape(-1, 2)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(value[edges[:, 0]]), pa.array(value[edges[:, 1]])], ["a", "b"])

    return rooted.repartition("trie", "root").select("trie", "fingerprint").mapInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: the smallest node that edges reach.

    Rounds of: take the least root among the neighbours' roots, hand it to the own root as well, then follow roots of roots. A round is
    written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        across = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b")
        least = across.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        told = roots.join(least, "node").select("node", "root", F.least("root", "seen").alias("seen"))
        offers = told.select("node", "seen").union(told.select(F.col("root").alias("node"), "seen"))
        best = offers.groupBy("node").agg(F.min("seen").alias("up"))
        jump = best.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = best.join(jump, "up").select("node", F.least("up", "top").alias("root"))
        new = cut(roots.select("node", F.col("root").alias("was")).join(new, "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved")))
        roots = new.select("node", "root")
        if new.where("moved").isEmpty():
            return roots


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fingerprint (long), ``root`` (least fingerprint of the group) and component_id (its least doc_id) of every row."""
    rows = cut(fingerprints(docs, shingle))
    distinct = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fingerprint"), max_bits))
    placed = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")
    placed = cut(placed)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(placed.join(least, "root").select("fingerprint", "root", "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The row with the least ``doc_id`` of every group, with the columns of ``docs``; of rows that tie, one stays."""
    return one_of_each(docs, near_duplicates(docs, shingle, max_bits))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` with the least ``doc_id`` of every group in ``found`` (doc_id, text_hash, root, component_id)."""
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    stay = cut(stay.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (rows["_hash"] == stay["_hash"])
    kept = rows.join(stay, same).select("row", "_id", stay["_hash"].alias("_hash"))
    return kept.dropDuplicates(["_id", "_hash"]).select("row.*")
