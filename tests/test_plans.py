import random

from conftest import rows
from pyspark.sql import functions as F

from codegraph_spark.functions import text as tx
from codegraph_spark.plans import intervals, prefix, products, substring, traverse
from codegraph_spark.plans.topk import top_k


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(tx.tokenize(F.lit("Foo.bar foo BAR:: x yy/zz"))) == ["Foo", "bar", "yy", "zz"]
    assert get(tx.search_tokens(F.lit("?"))) == ["?"]
    assert get(tx.lines_of(F.lit("a\r\nb\rc\n"))) == ["a", "b", "c"]
    assert get(tx.count_occurrences(F.lit("aAaa"), F.lit("aa"), True)) == 2
    assert get(tx.nth_occurrence(F.lit("a.b.c"), F.lit("."), F.lit(2))) == 3
    assert get(tx.nth_occurrence(F.lit("aaa"), F.lit("aa"), F.lit(2))) == -1
    assert get(tx.canonical_path(F.lit("/a/b/../c/./d"))) == "/a/c/d"
    assert get(tx.clamp(F.lit(0), 20, 1, 50)) == 20 and get(tx.clamp(F.lit(99), 20, 1, 50)) == 50
    assert get(tx.est_tokens(F.lit("abc"))) == 1 and get(tx.est_tokens(F.lit("a" * 9))) == 2
    assert get(tx.compact_title(F.lit("Class"), F.lit("N"), F.lit("s" * 200))) == "Class: N" + (" :: " + "s" * 200)[:120]
    assert get(tx.prepare_snippet(F.lit("a\r\nb\nc"), F.lit(100), F.lit(2))) == "a\nb"
    assert get(tx.savings_pct(F.lit(80), F.lit(70), F.lit(90))) == 12.5
    assert get(tx.is_excluded(F.lit("/a/Bin/x.cs"), F.array(F.lit("bin")))) is True
    assert get(tx.is_excluded(F.lit("/a/binary/x.cs"), F.array(F.lit("bin")))) is False
    assert tx.edge_types(["Callers", "nope"]) == ["callers"]


def test_interval_joins_match_brute_force(spark):
    rnd = random.Random(4)
    ivs = [(f"f{rnd.randint(0, 2)}", s, s + rnd.choice([0, 3, 40, 500, 2000]), i) for i in range(200) for s in [rnd.randint(1, 3000)]]
    pts = list({(f"f{rnd.randint(0, 2)}", rnd.randint(1, 5000)) for _ in range(200)})
    items = spark.createDataFrame(ivs, "f string, s int, e int, id int")
    points = spark.createDataFrame(pts, "f string, p int")
    got = intervals.best_containing(points, items, ["f"], "p", F.col("s"), F.col("e"), F.struct(F.col("e") - F.col("s"), -F.col("s"), F.col("id")))
    want = {}
    for f, p in pts:
        hits = [(e - s, -s, i) for g, s, e, i in ivs if g == f and s <= p <= e]
        if hits:
            want[(f, p)] = min(hits)[2]
    assert {(r.f, r.p): r.hit["id"] for r in got.collect()} == want
    after = intervals.first_at_or_after(points, items, ["f"], "p", "s", "hit")
    want = {(f, p): min(s for g, s, _, _ in ivs if g == f and s >= p) for f, p in pts if any(g == f and s >= p for g, s, _, _ in ivs)}
    assert {(r.f, r.p): r.hit for r in after.collect()} == want


def test_prefix_scans_match_one_pass(spark):
    data = [("k", i, i if i % 7 == 3 else None, i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int, v int, w int")
    got = {r.i: (r.ff, r.fx, r.rs) for r in prefix.running_sum(
        prefix.fill_forward(prefix.fill_forward(df, ["k"], "i", F.col("v"), "ff", block=16), ["k"], "i", F.col("v"), "fx", block=16, inclusive=False),
        ["k"], "i", F.col("w"), "rs", block=16).collect()}
    last, total = None, 0
    for _, i, v, w in data:
        before = last
        last = v if v is not None else last
        total += w
        assert got[i] == (last, before, total)


def test_substring_join_is_exact(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["alpha", "beta", "étage", "a.b", "x", "the end", "zz", "İx", "🎉y"]
    texts = [(i, f"r{i % 2}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for i in range(120)] + [(500, "r0", None), (501, "r1", "")]
    needles = [(1, "a"), (2, "TA"), (3, "étage"), (4, "a.b x"), (5, ""), (6, "the end zz"), (7, "nothing here"), (8, "🎉"), (9, "a"), (10, None), (11, "x 🎉y"), (12, "q")]
    t = spark.createDataFrame(texts, "i int, r string, t string")
    n = spark.createDataFrame(needles, "q int, n string")
    want = sorted(((i, q) for i, _, s in texts for q, x in needles if s and x and x.lower() in s.lower()), key=str)
    for limit in (substring.SPLIT_AT, 3):
        monkeypatch.setattr(substring, "SPLIT_AT", limit)
        monkeypatch.setattr(substring, "MOST_SPLIT", 10_000 if limit > 3 else 5)
        for repeated in (True, False):
            assert rows(substring.contains_join(t, "t", n, "n", ["i"], substring.LINE_GRAMS, repeated=repeated), "i", "q") == want
    by_repo = n.withColumn("r", F.lit("r1"))
    got = substring.contains_join(t, "t", by_repo, "n", ["i"], on=["r"])
    assert rows(got, "i", "q") == [w for w in want if w[0] % 2]
    assert substring.contains_join(t, "t", n.filter("q = 5"), "n", ["i"]).count() == 0 and substring.contains_join(t.limit(0), "t", n, "n", ["i"]).count() == 0
    plan = substring.contains_join(t, "t", n, "n", ["i"], substring.NAME_GRAMS)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_one_needle_and_many_share_the_plan(spark):
    t = spark.range(3000).select("id", F.concat(F.lit("line "), F.col("id").cast("string"), F.lit(" of text")).alias("t"))
    plan = lambda n: substring.contains_join(t, "t", n, "n", ["id"], substring.LINE_GRAMS, repeated=False)._jdf.queryExecution().optimizedPlan().toString()
    shape = lambda n: [x.strip(" +-:").split(" ")[0].split("(")[0] for x in plan(n).split("\n")]
    few = spark.range(1).select(F.col("id").alias("q"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" of")).alias("n"))
    many = spark.range(10_000).select(F.col("id").alias("q"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" of")).alias("n"))
    assert shape(few) == shape(many)


def test_top_k_is_limited_before_the_shuffle(spark):
    base = spark.range(1000).withColumn("g", F.col("id") % 2).withColumn("limit", F.lit(2) + F.col("g"))
    df = top_k(base, ["g"], ["id"], 50, F.col("limit"))
    assert [r.id for r in df.orderBy("id").collect()] == [0, 1, 2, 3, 5]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_reach_gives_shortest_distances(spark):
    rnd = random.Random(2)
    edges = list({(f"n{rnd.randint(0, 30)}", f"n{rnd.randint(0, 30)}") for _ in range(45)})
    e = spark.createDataFrame([(a, b, "t") for a, b in edges], "src string, dst string, type string")
    labels = spark.createDataFrame([(f"n{i}", f"L{i}") for i in range(31)], "node string, label string")
    seeds = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "query_id long, node string")
    got = {(r.query_id, r.node): r.distance for r in traverse.reach(seeds, e, labels, 3, 400, "out").collect()}
    want = {}
    for q in range(6):
        frontier, seen = {f"n{q}"}, {f"n{q}": 0}
        for dist in range(1, 4):
            frontier = {b for a, b in edges if a in frontier and b not in seen}
            seen.update({n: dist for n in frontier})
        want.update({(q, n): dd for n, dd in seen.items()})
    assert got == want
    capped = traverse.reach(seeds, e, labels, 3, 4, "out").groupBy("query_id").count().collect()
    assert all(r["count"] <= 4 for r in capped)


def test_hub_in_many_queries(spark):
    """A node of high degree that many queries hold: answers stay bounded and match a plain walk."""
    from codegraph_spark.plans import traverse

    degree, queries = 20_000, 200
    edges = spark.range(degree).select(F.lit("hub").alias("src"), F.format_string("n%05d", "id").alias("dst"), F.lit("e").alias("type"))
    edges = edges.unionByName(spark.createDataFrame([("n00001", "n00002", "e"), ("n00002", "far", "e")], "src string, dst string, type string"))
    labels = edges.select(F.col("dst").alias("node"), F.col("dst").alias("label"))
    seeds = spark.range(queries).select(F.col("id").alias("query_id"), F.lit("hub").alias("node"))
    got = traverse.reach(seeds, edges, labels, 2, 10, "out")
    rows = {(r["query_id"], r["node"]): r["distance"] for r in got.collect()}
    assert len(rows) == queries * 10 and rows[7, "n00000"] == 1 and (7, "far") not in rows
    met = traverse.induced_edges(got, edges, 2, "sideways").filter("query_id = 7").collect()
    assert {(r["src"], r["dst"]) for r in met} == {("hub", f"n{i:05d}") for i in range(9)} | {("n00001", "n00002")}


def test_levels_meet_few_candidates(spark, monkeypatch):
    """A query that lacks nine nodes does not meet the neighbours of its thirty nodes; the answer is that of plain search."""
    rnd = random.Random(8)
    names = {f"n{i}": rnd.choice("abcdABCD") + str(rnd.randint(0, 40)) for i in range(700)}
    pairs = {(f"n{i}", f"n{rnd.randint(0, 699)}") for i in range(700) for _ in range(rnd.choice([0, 2, 30, 60]))}
    asked = [(q, f"n{rnd.randint(0, 699)}") for q in range(40)] + [(3, "n5"), (41, "gone")]
    want = {}
    for q in {q for q, _ in asked}:
        held = {n: 0 for p, n in asked if p == q}
        for level in (1, 2, 3):
            fresh = {b for a, b in pairs if held.get(a) == level - 1} - held.keys()
            room = max(0, 40 - len(held))
            held |= dict.fromkeys(sorted(fresh, key=lambda n: (names[n].lower(), n))[:room], level)
        want |= {(q, n): d for n, d in held.items()}
    met = []
    real = traverse.top_k
    monkeypatch.setattr(traverse, "top_k", lambda df, keys, *a, **k: (met.append(df.count()) if keys == ["query_id"] else None) or real(df, keys, *a, **k))
    e = spark.createDataFrame([(a, b, "t") for a, b in sorted(pairs)], "src string, dst string, type string")
    got = traverse.reach(
        spark.createDataFrame(asked, "query_id long, node string"), e, spark.createDataFrame(list(names.items()), "node string, label string"), 3, 40, "out"
    )
    assert {(r.query_id, r.node): r.distance for r in got.collect()} == want
    assert met[1] + met[2] < 3000


def test_lists_of_hubs_come_to_the_queries(spark, monkeypatch):
    rnd = random.Random(9)
    e = spark.createDataFrame(sorted({(f"n{rnd.randint(0, 20) * rnd.randint(0, 9)}", f"n{rnd.randint(0, 150)}", rnd.choice("xy")) for _ in range(900)}), "src string, dst string, type string")
    held = spark.createDataFrame(sorted({(q, f"n{rnd.randint(0, 30)}"): (rnd.randint(0, 2),) for q in range(60) for _ in range(30)}.items()), "k struct<query_id:long,node:string>, d struct<distance:int>").select("k.*", "d.*")
    hubs = []
    real = F.broadcast
    monkeypatch.setattr(traverse.F, "broadcast", lambda df: hubs.append(df.count()) or real(df))
    for direction in ("out", "in", "both"):
        assert rows(traverse.induced_edges(held, e, 2, direction)) == rows(traverse.joined_edges(held, e, 2, direction))
    assert len(hubs) == 8 and all(hubs), hubs


def test_large_products_are_cut_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(products, "PAIRS_IN_PART", 1000)
    key = lambda n: F.when(F.col("id") < n, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k")
    left = spark.range(400).select(key(300), F.col("id").alias("l"))
    right = spark.range(400).select(key(300), (F.col("id") - F.col("id") % 2).alias("r"))
    for weight in (1, 1000):
        assert rows(products.product_join(left, right, ["k"], ["l"], None, weight), "k", "l", "r") == rows(left.join(right, "k"), "k", "l", "r")
    cells, copies = products.grid(left, right, ["k"], ["l"])
    # 90,000 pairs of 300 and 300 rows in about 90 parts: each row goes to some ten of them
    assert 80 <= cells.filter("k = 'hot'").select("_part").distinct().count() <= 110
    assert cells.count() < 4000 and copies.count() < 4000
    wide, copies = products.grid(left, right, ["k"], ["l"], None, 1000)
    assert wide.count() == 400 and copies.count() > 20_000
    assert products.product_join(left, right.filter("k = 'hot' and r = 0"), ["k"], ["l"]).count() == 600


def test_places_are_asked_for_in_used_levels_only(spark):
    ivs = spark.createDataFrame([(1, 1, 10), (2, 30, 70), (3, 5, 3)], "id int, s int, e int")
    blocks = ivs.filter("e >= s").select("id", F.explode(intervals.covering_blocks(F.col("s"), F.col("e"))).alias("b"))
    levels = intervals.levels_of(blocks, "b")
    assert levels == [0, 1]
    at = spark.range(100).select(F.col("id").alias("p"), F.explode(intervals.containing_blocks(F.col("id"), levels)).alias("b"))
    assert at.count() == 200
    assert rows(at.join(blocks, "b"), "id", "p") == rows(ivs.join(spark.range(100).toDF("p"), F.col("p").between(F.col("s"), F.col("e"))), "id", "p")
    assert spark.range(3).select(F.explode(intervals.containing_blocks(F.col("id"), intervals.levels_of(blocks.filter("b < 0"), "b")))).count() == 0
