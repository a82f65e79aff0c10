"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on a sample of bounded expected size; every vector is then filed under its leaf. A query walks the tree best bin
first: a priority queue holds nodes by the inner product of their centre with the query, and opened leaves come out in visiting order.
How many leaves are enough is calibrated: for a bounded sample of queries the exact neighbours are found against all rows, and the
number of visits is widened until the visited leaves hold ``recall`` of them.

A search runs in two rounds. The nearest leaves give each query its k-th score so far; the other leaves are then visited with it, so
that only better candidates travel. Leaves are cut into cells of bounded size, whatever share of the rows they hold, and a cell meets
its queries in one matrix product. Scores of what stays are summed anew, in one order, in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, vectors of another length than the most frequent one
and rows with a null id take no part; of rows with one id the least vector counts; fewer candidates than k are all returned; ties go to
the smaller id; without a query or candidate the result is empty; other columns do not matter.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codegraph_spark.plans.lineage import cut

FIT_ROWS = 20_000  # expected rows of the sample that the tree is fitted on, at most
CALIBRATION_QUERIES = 128  # expected number, at most
BRANCHES = 8
DEPTH = 3
CELL = 2_048  # vectors of a cell
RECALL = 0.97
FIRST_LEAVES = 4  # visited in the first round
SEED = 11


@dataclass
class Tree:
    """Nodes in breadth-first order; ``leaf`` is the leaf's number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray


def _k_means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """Cluster of every row; centres start at rows drawn far from each other."""
    centre = x[[int(rng.integers(len(x)))]]
    far = ((x - centre[0]) ** 2).sum(axis=1)
    while len(centre) < k and far.max() > 0:
        pick = int(rng.choice(len(x), p=far / far.sum()))
        centre = np.vstack([centre, x[pick]])
        far = np.minimum(far, ((x - x[pick]) ** 2).sum(axis=1))
    for _ in range(rounds):
        of = (centre @ x.T - 0.5 * (centre**2).sum(axis=1)[:, None]).argmax(axis=0)
        centre = np.vstack([x[of == i].mean(axis=0) if (of == i).any() else centre[i] for i in range(len(centre))])
    return (centre @ x.T - 0.5 * (centre**2).sum(axis=1)[:, None]).argmax(axis=0)


def fit_tree(x: np.ndarray, branches: int = BRANCHES, depth: int = DEPTH, least: int = 16, seed: int = SEED) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, level = [x.mean(axis=0)], [[]], [(0, x, 0)]
    while level:
        node, rows, d = level.pop(0)
        if d == depth or len(rows) < least * branches:
            continue
        of = _k_means(rows, branches, rng)
        parts = [rows[of == i] for i in np.unique(of)]
        if len(parts) < 2:
            continue
        for part in parts:
            children[node].append(len(centres))
            level.append((len(centres), part, d + 1))
            centres.append(part.mean(axis=0))
            children.append([])
    leaf = np.full(len(centres), -1, np.int64)
    ends = [i for i, c in enumerate(children) if not c]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centres), children, leaf)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into, going to the nearest centre at every node."""
    at = np.zeros(len(x), np.int64)
    while True:
        open_nodes = [n for n in np.unique(at).tolist() if tree.children[n]]
        if not open_nodes:
            return tree.leaf[at]
        for n in open_nodes:
            rows, kids = np.flatnonzero(at == n), np.array(tree.children[n])
            c = tree.centres[kids]
            at[rows] = kids[(c @ x[rows].T - 0.5 * (c**2).sum(axis=1)[:, None]).argmax(axis=0)]


def best_bins(tree: Tree, q: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves in best-bin-first order."""
    queue, out = [(0.0, 0)], []
    while queue and len(out) < visits:
        _, node = heapq.heappop(queue)
        kids = tree.children[node]
        if not kids:
            out.append(int(tree.leaf[node]))
            continue
        for score, kid in zip((tree.centres[kids] @ q).tolist(), kids, strict=True):
            heapq.heappush(queue, (-score, kid))
    return out


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and v (array of double), one row per id, of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _top(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best candidates of each query with a score of at least its floor."""
    rough = q @ v.T
    rough[qid[:, None] == ids[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(q).sum(axis=1) * np.abs(v).max())
    edge = floor - slack
    if len(ids) > k:
        edge = np.maximum(edge, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - slack)
    r, c = np.nonzero((rough >= edge[:, None]) & (rough > -np.inf))
    score = (q[r] * v[c]).sum(axis=1)
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.searchsorted(r, np.arange(len(qid)))
    keep = np.arange(len(r)) - first[r] < k
    return qid[r[keep]], ids[c[keep]], score[keep]


def _best(found: DataFrame, k: int, extra: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *(extra or []))


def _fit(rows: DataFrame, n: int, fit_rows: int, branches: int, depth: int) -> Tree:
    unit = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(unit < min(1.0, fit_rows / n)).select("id", "v").toPandas().sort_values("id")
    if not len(sample):
        sample = rows.limit(1).toPandas()
    return fit_tree(np.array(sample["v"].tolist(), np.float64), branches, depth)


def calibrate(filed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, n_queries: int, bound: int = CALIBRATION_QUERIES) -> int:
    """Leaf visits after which the visited leaves hold ``recall`` of the exact neighbours of a sample of the queries."""
    unit = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = queries.where(unit < min(1.0, bound / n_queries)).toPandas().sort_values("id")
    leaves = int((tree.leaf >= 0).sum())
    if not len(sample):
        return leaves
    qid, q = sample["id"].to_numpy(), np.array(sample["v"].tolist(), np.float64)
    shared = filed.sparkSession.sparkContext.broadcast((qid, q))

    def exact(batches):
        ids_, q_ = shared.value
        for b in batches:
            ids, leaf, v = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            for lo in range(0, len(ids), CELL):
                who, what, score = _top(ids_, q_, np.full(len(ids_), -np.inf), ids[lo : lo + CELL], v[lo : lo + CELL], k)
                by = np.argsort(ids[lo : lo + CELL])
                at = by[np.searchsorted(ids[lo : lo + CELL][by], what)]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(what), pa.array(score), pa.array(leaf[lo : lo + CELL][at])], ["query_id", "vec_id", "score", "leaf"])

    found = _best(filed.select("id", "leaf", "v").mapInArrow(exact, "query_id long, vec_id long, score double, leaf long"), k, ["leaf"]).toPandas()
    place = {int(i): {leaf: p for p, leaf in enumerate(best_bins(tree, x, leaves))} for i, x in zip(qid, q, strict=True)}
    at = np.sort([place[i][leaf] for i, leaf in zip(found["query_id"].tolist(), found["leaf"].tolist(), strict=True)])
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else leaves


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", recall: float = RECALL,
           fit_rows: int = FIT_ROWS, branches: int = BRANCHES, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every query; ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors, id_column, vector))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = sizes[0]["n"]
    rows = rows.where(F.size("v") == sizes[0]["dim"])
    tree = _fit(rows, n, fit_rows, branches, depth)
    shared = spark.sparkContext.broadcast(tree)

    def file(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf_of(shared.value, _matrix(b.column(1)))), b.column(1)], ["id", "leaf", "v"])

    filed = cut(rows.mapInArrow(file, "id long, leaf long, v array<double>"))
    queries = filed.where(is_query).select("id", "v")
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = calibrate(filed, queries, tree, k, recall, n_queries)
    # cells of a leaf: a bounded table, one row per leaf
    cells = {r["leaf"]: -(-r["n"] // CELL) for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared_cells = spark.sparkContext.broadcast(cells)
    n_cells = F.create_map(*[x for leaf, c in sorted(cells.items()) for x in (F.lit(leaf), F.lit(c))])
    celled = filed.withColumn("cell", F.pmod(F.xxhash64("id", F.lit(SEED + 2)), n_cells[F.col("leaf")]).cast("int"))

    def routes(first: int, last: int):
        def run(batches):
            tree_, cells_ = shared.value, shared_cells.value
            for b in batches:
                v = _matrix(b.column(1))
                spots = [[(leaf, c) for leaf in best_bins(tree_, x, last)[first:] for c in range(cells_.get(leaf, 0))] for x in v]
                of = np.repeat(np.arange(len(v)), [len(s) for s in spots])
                leaf, cell = (pa.array([p[i] for s in spots for p in s], t) for i, t in ((0, pa.int64()), (1, pa.int32())))
                yield pa.RecordBatch.from_arrays([leaf, cell, *[b.column(i).take(pa.array(of)) for i in range(3)]], ["leaf", "cell", "id", "v", "floor"])

        return run

    def meet(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        v, ids = np.array(c["v"].tolist(), np.float64), c["id"].to_numpy()
        parts = []
        for lo in range(0, len(q), CELL):
            b = q.iloc[lo : lo + CELL]
            parts.append(_top(b["id"].to_numpy(), np.array(b["v"].tolist(), np.float64), b["floor"].to_numpy(), ids, v, k))
        who, what, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"query_id": who, "vec_id": what, "score": score})

    def visit(asking: DataFrame, first: int, last: int) -> DataFrame:
        routed = asking.select("id", "v", "floor").mapInArrow(routes(first, last), "leaf long, cell int, id long, v array<double>, floor double")
        return routed.groupBy("leaf", "cell").cogroup(celled.groupBy("leaf", "cell")).applyInPandas(meet, "query_id long, vec_id long, score double")

    near = cut(_best(visit(queries.withColumn("floor", F.lit(float("-inf"))), 0, FIRST_LEAVES), k))
    if visits > FIRST_LEAVES:
        floors = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(float("-inf")).alias("floor"))
        asking = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        near = _best(near.drop("rank").unionByName(visit(asking, FIRST_LEAVES, visits)), k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
