"""A Merkle manifest of a dataset, kept by checkpoints.

Rows are leaves, in order inside runs; every two consecutive nodes of a level have one parent (the last one of an odd level has a parent
of its own), up to one subroot a run, and the subroots in order of their runs make one more tree up to the root. Only every ``STRIDE``-th
level is stored, as aligned subtrees of at most ``2 ** STRIDE`` nodes. A proof is not read from stored nodes: from the root downwards each
stored subtree regenerates the levels between itself and its top, gives every node its siblings there and the proof of the top, and
forgets them again.

A digest is the lower-case hexadecimal SHA-256 of the concatenated texts below it. A proof is an array from leaf to root of ``side``
(``left``, ``right``, or ``lone`` where a level has no sibling) and ``hash``.

Work per level is one shuffle of the stored nodes, a ``2 ** STRIDE``-th of the level below; a subtree is the largest group in any task.
Places in a run come from ranges and counts (``placing``), so a run that holds all rows is no bottleneck.

Defined results: null values are ``-`` in a leaf, empty ones ``0:``; leaves of equal order stand by their digest; repeated rows are
leaves each; a null run is a run of its own and stands first; an empty table has no leaf, no root and no proof; other columns do not
matter. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegraph_spark.llm.placing import placed
from codegraph_spark.plans.lineage import cut

STRIDE = 6
YIELD_ROWS = 2048
STEP = "struct<side: string, hash: string>"
_ARROW_STEP = pa.struct([("side", pa.string()), ("hash", pa.string())])


def encoded(*values: Column) -> Column:
    """The values one after the other: ``-`` for null, else UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_hash(*values: Column) -> Column:
    return F.sha2(encoded(*values), 256)


def run_key(value: Column) -> Column:
    """A text without nulls that sorts like ``value`` by bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _parent(pair: list[str]) -> str:
    return hashlib.sha256("".join(pair).encode()).hexdigest()


def grow(hashes: list[str], size: int, stride: int) -> list[list[str]]:
    """The levels of an aligned subtree from its stored nodes up to its top; ``size``: nodes of the run on the stored level."""
    levels = [hashes]
    for _ in range(min(stride, (size - 1).bit_length())):
        low = levels[-1]
        levels.append([_parent(low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


@dataclass
class Tree:
    """``stored``: tables of subtrees (run, size, block, nodes) from the leaves upwards; ``roots``: run and hash."""

    stored: list[DataFrame]
    roots: DataFrame
    stride: int


def plant(leaves: DataFrame, stride: int = STRIDE) -> Tree:
    """The tree of every run. ``leaves``: run, pos, size, hash and ``keep`` (a struct that proofs bring back)."""

    def tops(batches):
        for b in batches:
            got = [grow(h, n, stride)[-1][0] for h, n in zip(b.column("hashes").to_pylist(), b.column("size").to_pylist(), strict=True)]
            size = [(n + (1 << stride) - 1) >> stride for n in b.column("size").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("run"), b.column("block"), pa.array(size, pa.int64()), pa.array(got, pa.string())], ["run", "pos", "size", "hash"])

    stored, nodes = [], leaves
    while True:
        block = F.shiftright("pos", stride)
        node = F.struct("pos", "hash", "keep") if "keep" in nodes.columns else F.struct("pos", "hash")
        stored.append(cut(nodes.groupBy("run", "size", block.alias("block")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))))
        low = stored[-1].select("run", "size", "block", F.col("nodes.hash").alias("hashes"))
        nodes = cut(low.mapInArrow(tops, "run string, pos long, size long, hash string"))
        if (nodes.agg(F.max("size")).first()[0] or 1) == 1:
            return Tree(stored, nodes.select("run", "hash"), stride)


def climb_down(tree: Tree, above: DataFrame) -> DataFrame:
    """keep, hash and ``proof`` of every leaf, and the columns of ``above``: run, ``proof`` of the run's root and others to hand down."""
    handed = [f for f in above.schema.fields if f.name not in ("run", "proof")]
    paths, stride = above.withColumn("pos", F.lit(0).cast("long")), tree.stride
    for k, table in reversed(list(enumerate(tree.stored))):
        kept = table.schema["nodes"].dataType.elementType
        names = ["pos", "hash", *(["keep"] if k == 0 else [])]
        names = [n for n in names if n in kept.names]

        def prove(batches, names=names):
            for b in batches:
                nodes = b.column("nodes")
                for lo in range(0, b.num_rows, max(1, YIELD_ROWS >> stride)):
                    part = b.slice(lo, max(1, YIELD_ROWS >> stride))
                    flat = part.column("nodes").flatten()
                    sides, hashes, offsets, owner = [], [], [0], []
                    for row, (found, size, top) in enumerate(zip(part.column("nodes").to_pylist(), part.column("size").to_pylist(), part.column("proof").to_pylist(), strict=True)):
                        levels = grow([n["hash"] for n in found], size, stride)[:-1]
                        top_sides, top_hashes = [s["side"] for s in top], [s["hash"] for s in top]
                        for i in range(len(found)):
                            for up, level in enumerate(levels):
                                mate = (i >> up) ^ 1
                                sides.append("lone" if mate >= len(level) else "right" if mate & 1 else "left")
                                hashes.append(level[mate] if mate < len(level) else None)
                            sides += top_sides
                            hashes += top_hashes
                            offsets.append(len(sides))
                        owner += [row] * len(found)
                    steps = pa.StructArray.from_arrays([pa.array(sides, pa.string()), pa.array(hashes, pa.string())], fields=list(_ARROW_STEP))
                    owner = pa.array(owner, pa.int64())
                    columns = [part.column("run").take(owner), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)]
                    columns += [part.column(f.name).take(owner) for f in handed]
                    columns += [flat.field(flat.type.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, ["run", "proof", *[f.name for f in handed], *names])
                del nodes

        # paths are wide rows: written, so that their size tells whether they may be broadcast
        met = table.join(cut(paths).withColumnRenamed("pos", "block"), ["run", "block"])
        types = [f"run string, proof array<{STEP}>", *[f"`{f.name}` {f.dataType.simpleString()}" for f in handed], *[f"{n} {kept[n].dataType.simpleString()}" for n in names]]
        paths = met.mapInArrow(prove, ", ".join(types))
        if k:
            paths = paths.drop("hash")
    return paths.drop("run", "pos")


def manifest(rows: DataFrame, run: Column, order: list[str], leaf: Column, keep: list[Column | str], stride: int = STRIDE) -> tuple[Tree, Tree]:
    """The trees of all runs and the tree of their subroots."""
    base = rows.select(run_key(run).alias("run"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], leaf.alias("hash"), F.struct(*keep).alias("keep"))
    by = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    low = plant(placed(base, ["run"], [*by, F.col("hash").asc()]).select("run", "pos", "size", "hash", "keep"), stride)
    tops = low.roots.select(F.lit("").alias("all"), "run", "hash")
    high = placed(tops, ["all"], ["run"]).select(F.col("all").alias("run"), "pos", "size", "hash", F.struct("run").alias("keep"))
    return low, plant(high, stride)


def proofs(low: Tree, high: Tree) -> DataFrame:
    """``keep``, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row."""
    root = high.roots.select("run", F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof"))
    tops = climb_down(high, root).select(F.col("keep.run").alias("run"), F.col("hash").alias("subroot"), "root", "proof")
    return climb_down(low, tops).select("keep", F.col("hash").alias("leaf"), "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to."""
    step = lambda h, s: F.when(s["side"] == "left", F.concat(s["hash"], h)).when(s["side"] == "right", F.concat(h, s["hash"])).otherwise(h)
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(step(h, s), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of the siblings, from leaf to root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["hash"]), ""), 256)
