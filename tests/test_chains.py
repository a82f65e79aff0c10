"""Ancestor search over chains against plain walks."""

import random
from collections import deque

from pyspark.sql import functions as F

from codegraph_spark.operators import history
from codegraph_spark.plans import chains


def walk(parents, head):
    dist, todo = {head: 0}, deque([head])
    while todo:
        c = todo.popleft()
        for p in parents.get(c, ()):
            if p not in dist:
                dist[p] = dist[c] + 1
                todo.append(p)
    return dist


def random_history(rnd, n):
    """Mostly a main line, with branches, merges, edges that skip and several roots."""
    parents = {}
    for i in range(1, n):
        ps = {i - 1 if rnd.random() < 0.7 else rnd.randrange(i)}
        while rnd.random() < 0.3:
            ps.add(rnd.randrange(max(0, i - 20), i))
        if rnd.random() > 0.02:
            parents[f"c{i:04}"] = [f"c{p:04}" for p in ps]
    return parents


def test_ancestors_and_bases_against_plain_walks(spark):
    rnd = random.Random(4)
    for n in (150,):  # one random history
        parents = random_history(rnd, n)
        edges = spark.createDataFrame([(p, c) for c, ps in parents.items() for p in ps], "parent_commit_id string, child_commit_id string")
        pairs = [(q, f"c{rnd.randrange(n):04}", f"c{rnd.randrange(n):04}") for q in range(40)] + [(99, "alone", "c0001"), (98, "c0007", "c0007"), (97, "alone", "alone")]
        df = spark.createDataFrame(pairs, "query_id long, left_commit string, right_commit string")
        index = history.commit_chains(edges)
        base, apart = {}, set()
        for q, a, b in pairs:
            x, y = walk(parents, a), walk(parents, b)
            both = [(x[c] + y[c], max(x[c], y[c]), c) for c in x if c in y]
            if both:
                base[q] = (min(both)[2], min(both)[0])
            apart |= {(q, "left", c) for c in x if c not in y} | {(q, "right", c) for c in y if c not in x}
        assert {r["query_id"]: (r["base_commit"], r["total"]) for r in history.merge_base(index, df).collect()} == base
        assert {tuple(r) for r in history.divergence(index, df).collect()} == apart
        heads = df.select("query_id", F.lit("s").alias("side"), F.col("left_commit").alias("commit_id"))
        got = {(r["query_id"], r["commit_id"]): r["distance"] for r in history.ancestors(edges, heads).collect()}
        assert got == {(q, c): d for q, a, _ in pairs for c, d in walk(parents, a).items()}


def test_long_line_takes_few_rounds(spark, monkeypatch):
    """50,000 commits in a row with side branches: rounds grow with the logarithm, not with the length."""
    n, rounds = 50_000, []
    real = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: rounds.append(1) or real(df))
    line = spark.range(1, n).select(F.format_string("c%06d", F.col("id") - 1).alias("parent_commit_id"), F.format_string("c%06d", "id").alias("child_commit_id"))
    side = spark.range(1, n // 1000).select(F.format_string("c%06d", F.col("id") * 1000).alias("parent_commit_id"), F.format_string("b%06d", "id").alias("child_commit_id"))
    back = spark.range(1, n // 1000).select(F.format_string("b%06d", "id").alias("parent_commit_id"), F.format_string("c%06d", F.col("id") * 1000 + 7).alias("child_commit_id"))
    index = history.commit_chains(line.unionByName(side).unionByName(back))
    pairs = spark.createDataFrame([(1, "c049999", "c000003"), (2, "b000030", "c049999"), (3, "b000007", "b000030")], "query_id long, left_commit string, right_commit string")
    got = {r["query_id"]: (r["base_commit"], r["total"]) for r in history.merge_base(index, pairs).collect()}
    # the side branch of 1,000 k leaves at 1,000 k and comes back seven later
    assert got[2] == ("b000030", 49_999 - 30_007 + 1 - 5 * 19) and got[3] == ("b000007", 1 + (30_000 - 7_007) - 5 * 22 + 1)
    assert got[1] == ("c000003", 49_999 - 3 - 5 * 49)
    assert len(rounds) <= 2 * 18 + 8


def test_search_does_not_rewrite_what_it_found(spark, monkeypatch):
    """A wide graph of many hops: most of what was found is written anew a few times, not in every round."""
    written = []
    real = chains.cut

    def cut(df):
        out = real(df)
        if "fresh" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(chains, "cut", cut)
    k = F.col("id")
    up = F.array_distinct(F.array(F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string")))
    edges = spark.range(1, 100_000).select(k.cast("string").alias("child_commit_id"), F.explode(up).alias("parent_commit_id"))
    pairs = spark.range(300).select(k.alias("query_id"), (99_000 + k).cast("string").alias("left_commit"), (99_600 + k).cast("string").alias("right_commit"))
    got = {tuple(r) for r in history.divergence(edges, pairs).collect()}
    parents = {str(i): {str(i // 2), str(i // 3)} for i in range(1, 100_000)}
    for q in (0, 123):
        x, y = walk(parents, str(99_000 + q)), walk(parents, str(99_600 + q))
        assert {r[1:] for r in got if r[0] == q} == {("left", c) for c in x if c not in y} | {("right", c) for c in y if c not in x}
    assert sum(n > written[-1] / 2 for n in written) <= 4


def test_rename_chain_of_many_hops(spark):
    n = 500
    commits = spark.range(n).select(F.lit("r").alias("repo_name"), F.format_string("c%05d", "id").alias("commit_id"), F.timestamp_seconds(F.col("id") * 60).alias("author_date_utc"))
    moves = spark.range(n).select(
        F.lit("r").alias("repo_name"), F.format_string("c%05d", "id").alias("commit_id"), F.format_string("f%d", F.col("id") + 1).alias("path"), F.format_string("f%d", "id").alias("prev_path")
    )
    # a later rename into an older name does not count
    late = spark.createDataFrame([("r", "c00499", "f10", "elsewhere")], "repo_name string, commit_id string, path string, prev_path string")
    req = spark.createDataFrame([(1, f"f{n}"), (2, "f10"), (3, "none")], "query_id long, path string")
    got = history.rename_chain(commits, moves.unionByName(late), req).collect()
    names = {q: [r["path"] for r in sorted(got, key=lambda r: r["hop"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert names[1] == [f"f{i}" for i in range(n, -1, -1)] and names[2] == ["f10", "elsewhere"] and names[3] == ["none"]


def test_circles_are_told(spark):
    import pytest

    with pytest.raises(ValueError):
        chains.MAX_DOUBLINGS, keep = 5, chains.MAX_DOUBLINGS
        try:
            chains.chain_index(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))
        finally:
            chains.MAX_DOUBLINGS = keep
