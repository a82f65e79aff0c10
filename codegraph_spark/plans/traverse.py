"""Bounded breadth-first expansion of many seeds at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegraph_spark.plans.lineage import cut
from codegraph_spark.plans.topk import top_k


def known_direction(direction: str | None) -> str:
    """``in`` or ``out``; anything else means both."""
    d = (direction or "").strip().lower()
    return d if d in ("in", "out") else "both"


def _orient(edges: DataFrame, direction: str) -> DataFrame:
    direction = known_direction(direction)
    fwd = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    rev = edges.select(F.col("dst").alias("at"), F.col("src").alias("next"))
    if direction == "out":
        return fwd
    if direction == "in":
        return rev
    return fwd.unionByName(rev)


def _bounds(seen: DataFrame, frontier: DataFrame, lists: DataFrame, max_nodes: int) -> DataFrame:
    """(query_id, _bound) of the queries that may still gain nodes: no node beyond ``_bound`` (low, next) is among the ones gained.

    A query that lacks r nodes looks at the heads of its sorted lists ``lists(at, _list)``, about 2 r in all. If r of them are new to it,
    the r-th is the bound; else there is none.
    """
    held = seen.groupBy("query_id").agg(F.collect_list("node").alias("_seen"))
    stands = frontier.groupBy("query_id").agg(F.count(F.lit(1)).alias("_lists"))
    held = cut(held.join(stands, "query_id").withColumn("_lacks", max_nodes - F.size("_seen")).filter("_lacks > 0"))
    taken = frontier.join(held.select("query_id", F.ceil(2 * F.col("_lacks") / F.col("_lists")).cast("int").alias("_take")), "query_id")
    heads = taken.join(lists, "at").select("query_id", F.explode(F.slice("_list", F.lit(1), F.col("_take"))).alias("e"))
    heads = heads.groupBy("query_id").agg(F.collect_set(F.struct("e.low", "e.next")).alias("_heads"))
    new = F.sort_array(F.filter("_heads", lambda e: ~F.array_contains("_seen", e["next"])))
    met = held.join(heads, "query_id").withColumn("_new", new)
    return met.select("query_id", F.when(F.size("_new") >= F.col("_lacks"), F.get("_new", F.col("_lacks") - 1)).alias("_bound"))


def reach(seeds: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], labels: DataFrame, depth: int, max_nodes: int | None, direction: str = "both") -> DataFrame:
    """(query_id, node, distance) of every node within ``depth`` steps of its seed.

    ``seeds(query_id, node)``, ``edges(src, dst, …)``, ``labels(node, label)``.  Instead of all edges, a function may give those at the
    nodes of the frontier.
    Nodes keep their least distance; per query at most ``max_nodes`` are kept, by
    (distance, lower(label), node).  A query that already holds ``m`` nodes gains
    at most ``max_nodes - m``, so in that order at most ``max_nodes`` neighbours of
    a node matter, and longer lists are cut there without changing the result.
    From the second level on, where a query stands on many nodes, the heads of their lists tell first how far in the order it may gain
    nodes (``_bounds``).  ``max_nodes`` None keeps every node and ranks none.
    """
    order = [F.lower("label"), F.col("next")]
    oriented = None if callable(edges) else _orient(edges, direction).filter("at <> next")
    seen = cut(seeds.select("query_id", "node").distinct().withColumn("distance", F.lit(0)))
    for level in range(1, depth + 1):
        frontier = seen.filter(F.col("distance") == level - 1).select("query_id", F.col("node").alias("at"))
        # only nodes that a query stands on have their neighbours labelled and ranked
        if callable(edges):
            oriented = _orient(edges(frontier.select(F.col("at").alias("node"))), direction).filter("at <> next")
        steps = oriented.join(frontier.select("at").distinct(), "at", "left_semi").distinct()
        if max_nodes is None:
            met = frontier.join(steps, "at").select("query_id", F.col("next").alias("node")).distinct()
            kept = met.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("distance", F.lit(level))
            seen = seen.unionByName(cut(kept))
            continue
        steps = steps.join(labels.select(F.col("node").alias("next"), "label").hint("merge"), "next", "left").withColumn("label", F.coalesce("label", "next"))
        steps = top_k(steps, ["at"], order, max_nodes, rank="_place").drop("_place")
        held = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("_held"))
        if level == 1:
            found = frontier.join(steps, "at").groupBy("query_id", F.col("next").alias("node")).agg(F.min("label").alias("label"))
        else:
            entry = F.struct(F.lower("label").alias("low"), "next", "label")
            lists = cut(steps.groupBy("at").agg(F.sort_array(F.collect_list(entry)).alias("_list")))
            bounded = frontier.join(_bounds(seen, frontier, lists, max_nodes), "query_id")
            near = F.filter("_list", lambda e: F.struct(e["low"], e["next"]) <= F.col("_bound"))
            # most lists begin beyond the bound
            near = F.when(F.col("_bound").isNull(), F.col("_list")).when(F.struct(F.col("_list")[0]["low"], F.col("_list")[0]["next"]) <= F.col("_bound"), near)
            found = bounded.join(lists, "at").select("query_id", F.explode(near).alias("e"))
            found = found.groupBy("query_id", F.col("e.next").alias("node")).agg(F.min("e.label").alias("label"))
        fresh = found.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        kept = (
            top_k(fresh, ["query_id"], [F.lower("label"), "node"], max_nodes, rank="_place")
            .join(held, "query_id")
            .filter(F.col("_place") + F.col("_held") <= max_nodes)
            .select("query_id", "node", F.lit(level).alias("distance"))
        )
        # each level is a table: it is read for the next one and several times for the edges
        seen = seen.unionByName(cut(kept))
    return seen


def joined_edges(nodes: DataFrame, edges: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """The edges of ``induced_edges`` for any number of nodes per query, by joins row by row."""
    direction = known_direction(direction)
    end = lambda c: nodes.select("query_id", F.col("node").alias(c), (F.col("distance") < depth).alias(f"_{c}"))
    met = edges.join(end("src"), "src").join(end("dst"), ["query_id", "dst"])
    near = {"out": F.col("_src"), "in": F.col("_dst"), "both": F.col("_src") | F.col("_dst")}[direction]
    return met.filter(near).select("query_id", *edges.columns)


NEIGHBOURS = 2048  # of a node that stand in one row
HUBS = 10_000  # nodes near in most queries, whose lists every task may hold
HUB_NEIGHBOURS = 100
HUB_QUERIES = 16


def induced_edges(nodes: DataFrame, edges: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """Edges met while expanding: both ends kept, an expanded end nearer than ``depth``.

    Every such edge has a near end, so only near nodes meet their neighbours. These travel as short lists that are intersected with the
    nodes of a query, so a hub in many queries makes a few rows per query instead of one row per neighbour. The nodes of a query would
    travel to each of these lists; short lists of the nodes that most queries are near to come to the queries instead.
    """
    direction = known_direction(direction)
    near = nodes.filter(F.col("distance") < depth)
    known = nodes.select("node").distinct()
    inside = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    asked = near.groupBy("node").agg(F.count(F.lit(1)).alias("_stand"))
    held = nodes.groupBy("query_id").agg(
        F.collect_list("node").alias("_all"), F.collect_list(F.when(F.col("distance") < depth, F.col("node"))).alias("_near"),
        F.collect_list(F.when(F.col("distance") >= depth, F.col("node"))).alias("_far"),
    )

    def met(at: str, other: str, ends: str) -> DataFrame:
        stood = asked.withColumnRenamed("node", at)
        mine = inside.join(stood, at, "left_semi")
        degree = mine.groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
        part = F.pmod(F.xxhash64(other), F.ceil(F.col("_n") / NEIGHBOURS)).alias("_part")
        lists = cut(mine.join(degree, at).select(*edges.columns, part).groupBy(at, *rest, "_part").agg(F.collect_list(other).alias("_next")))
        size = lists.groupBy(at).agg(F.sum(F.size("_next")).alias("_n")).filter(F.col("_n") <= HUB_NEIGHBOURS)
        hubs = cut(stood.filter(F.col("_stand") >= HUB_QUERIES).join(size, at).orderBy(F.desc("_stand"), at).limit(HUBS).select(at))
        each = held.select("query_id", F.col(ends).alias("_ends"), F.explode("_near").alias(at))
        if not hubs.isEmpty():
            hubs = F.broadcast(hubs)
            near_hubs = each.join(F.broadcast(lists.join(hubs, at, "left_semi")), at)
            both = near_hubs.unionByName(each.join(hubs, at, "left_anti").join(lists, at))
        else:
            both = each.join(lists, at)
        both = both.select("query_id", at, *rest, F.array_intersect("_next", "_ends").alias("_met"))
        # outer: else Spark would intersect once more to leave out empty lists
        every = both.select("query_id", at, *rest, F.explode_outer("_met").alias(other)).filter(F.col(other).isNotNull())
        return every.select("query_id", *edges.columns)

    if direction == "out":
        return met("src", "dst", "_all")
    if direction == "in":
        return met("dst", "src", "_all")
    # edges between near nodes are met from their source
    return met("src", "dst", "_all").unionByName(met("dst", "src", "_far"))
