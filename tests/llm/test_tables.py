"""Nearest neighbours, source mixing and the pipeline against plain versions."""

import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codegraph_spark.llm import ann, mixing, queries

SF = "/root/testdata/sf0.001"


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[1000:2000] = x[1000]  # a third of all rows is one vector
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(5000, None, 0), (5020, [], 0), (5040, [0.0] * 24, 0), (5060, [float("nan")] * 24, 0), (5080, [1.0] * 23 + [None], 0), (5100, [1.0], 0), (None, rows[0][1], 0), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = ann.search(df, F.col("id") % 20 == 0, k=10, branches=4).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == set(range(0, 3000, 20))
    hits = 0
    for q, rs in found.items():
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, 11)) and all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in rs)
        assert [(-s, i) for _, i, s in rs] == sorted((-s, i) for _, i, s in rs)
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        kth = np.sort(score)[-10]
        hits += sum(s >= kth - 1e-12 for _, _, s in rs)
    assert hits >= 0.9 * 10 * len(found)
    few = ann.search(df.where("vec_id < 5"), F.col("id") % 20 == 0)
    assert few.count() == 4
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0 and ann.search(df.where("vec_id = 7"), F.col("id") % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
def test_nearest_recall_on_shared_table(spark):
    sf = SF.replace("0.001", "0.01")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    got = queries.op7_nearest(spark, sf).collect()
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = m @ x[q]
        s[ids == q] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        total += 20
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * total


def test_water_filling(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for p in range(30):
        kids = {f"k{i}": (float(rng.integers(0, 4)), float(rng.integers(0, 50))) for i in range(int(rng.integers(1, 7)))}
        budget = float(rng.integers(0, 150))
        rows += [(p, k, w, s, budget) for k, (w, s) in kids.items()]
        want |= {(p, k): v for k, v in brute.water_fill(kids, budget).items()}
    df = spark.createDataFrame(rows, "p int, domain string, weight double, supply double, parent_budget double")
    for r in mixing.share_out(df, ["p"]).collect():
        assert abs(r["budget"] - want[r["p"], r["domain"]]) < 1e-6


def test_shortage_goes_to_siblings_first(spark):
    docs = [(i, "w " * n, lang, src) for i, (n, lang, src) in enumerate([(10, "en", "a")] * 5 + [(10, "en", "b")] * 20 + [(10, "de", "a")] * 40 + [(0, None, None)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("domain", F.lit("clash"))
    rows = mixing.leaves(df, F.lit("d"))
    plan = {(r["language"], r["source"]): r for r in mixing.plan(rows, 400, 1.0, 1).collect()}
    assert plan["en", "a"]["allotted"] == 50 and plan["en", "b"]["allotted"] == 150 and plan["de", "a"]["allotted"] == 200
    chosen = mixing.mix(df, F.lit("d"), 1.0, 1, budget_tokens=400).collect()
    for key in (("en", "a"), ("en", "b"), ("de", "a")):
        assert sum(r["n_tokens"] for r in chosen if (r["language"], r["source"]) == key) == plan[key]["allotted"]
    double = mixing.mix(df, F.lit("d"), 1.0, 3, budget_tokens=10_000).collect()
    assert len([r for r in double if r["doc_id"] == 0]) == 3 and len({(r["doc_id"], r["epoch"]) for r in double}) == len(double)
    again = mixing.mix(df.repartition(3), F.lit("d"), 1.0, 1, budget_tokens=400).collect()
    assert {r["doc_id"] for r in again} == {r["doc_id"] for r in chosen}


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
def test_pipeline_stages_keep_their_promise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "encode"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.line_dedup(spark, docs, SF).count() == docs.count()
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and final.where("n_tokens <> size(ids)").count() == 0
    wide = docs.withColumn("row", F.lit(1)).withColumn("dropped", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("score", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
