"""The Merkle manifest, the conversation trie and decontamination against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegraph_spark.llm import decontam, merkle, placing, trie

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and per leaf its siblings with their sides."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            if k ^ 1 < len(level):
                proofs[i].append(("right" if k % 2 == 0 else "left", level[k ^ 1]))
            else:
                proofs[i].append(("lone", None))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], proofs


DOCS = [(i, f"s{i % 3}", lang, None if i % 11 == 0 else i, t) for i, (lang, t) in enumerate(
    [("en", "x" * (i % 7)) for i in range(70)] + [("de", "ü")] * 5 + [(None, "n"), ("", ""), ("ß", None), ("zz", "y" * 500_000)])] + [(None, None, "en", 1, ""), (3, "s0", "en", 3, "xxx"), (3, "s0", "en", 3, "xxx")]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_merkle_against_a_plain_tree(spark, stride):
    df = spark.createDataFrame(DOCS, SCHEMA).withColumns({"run": F.lit(1), "pos": F.lit("x"), "hash": F.lit(0), "proof": F.lit(2)})
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    trees = merkle.manifest(df, F.col("lang"), ["doc_id"], merkle.leaf_hash(*fields), ["doc_id", "lang"], stride)
    got = merkle.proofs(*trees).withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("digest", merkle.proof_digest(F.col("proof")))
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    runs = defaultdict(list)
    for r in DOCS:
        runs[r[2]].append(((-1 if r[0] is None else r[0]), H(*map(put, r))))
    order = sorted(runs, key=lambda k: (k is not None, (k or "").encode()))
    low = {k: plain_tree([h for _, h in sorted(runs[k])]) for k in order}
    root, high = plain_tree([low[k][0] for k in order])
    want = []
    for k, above in zip(order, high, strict=True):
        for (_, leaf), proof in zip(sorted(runs[k]), low[k][1], strict=True):
            steps = proof + above
            want.append((leaf, low[k][0], root, steps, H(*[h for _, h in steps if h])))
    rows = [(r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]], r["digest"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert got.where("folded <> root").count() == 0
    wrong = got.select(merkle.folded(F.sha2(F.col("leaf"), 256), F.col("proof")).alias("f"), "root")
    assert wrong.where("f = root").count() == 0


def test_merkle_of_one_and_of_none(spark):
    df = spark.createDataFrame(DOCS[:1], SCHEMA)
    make = lambda d: merkle.proofs(*merkle.manifest(d, F.col("lang"), ["doc_id"], merkle.leaf_hash(F.col("doc_id")), ["doc_id"]))
    (one,) = make(df).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == H("1:0") and one["proof"] == []
    assert make(df.limit(0)).count() == 0


def test_places_in_long_runs(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("run"), (F.col("id") % 2).alias("o"))
    got = placing.placed(df, ["run"], ["o"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["run"]].append((r["pos"], r["o"], r["size"]))
    for rows in by.values():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows))) and {s for *_, s in rows} == {len(rows)}
        assert [o for _, o, _ in rows] == sorted(o for _, o, _ in rows)
    assert len(got) == 1000


def plain_trie(talks):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    rows = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        joined = ",".join(map(str, sorted(ends[node])))
        rows.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids(node)), sum(not kids(n) for n in below), saved, H(joined)))
    return rows


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[c].append((r or "", x or ""))
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    return out


TALKS = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t} {(c * 7 + t) % 3 if t > 2 else ''}") for c in range(95, 240) for t in range(c % 9 + 1)]
TALKS += [(1000 + c, t, "user", "same é🎉") for c in range(300) for t in range(3)]  # copies without a base
TALKS += [(200, None, None, None), (100, None, "user", ""), (None, 0, "user", "nobody"), (777, 0, None, "z" * 100_000)]
TALKS += [(300, t, "user", str(t)) for t in range(900)] + [(301, t, "user", str(t)) for t in range(900)]


@pytest.mark.parametrize(("most_heavy", "heavy", "held"), [(10_000, 256, 100_000), (10, 4, 2), (2, 1, 1)])
def test_trie_against_plain_prefixes(spark, most_heavy, heavy, held):
    small = [r for r in TALKS if r[0] not in (300, 301)]
    df = spark.createDataFrame(small, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "depth": F.lit(2), "said": F.lit(3)})
    turns, lengths = trie.branched(df)
    got = trie.trie(turns, lengths, most_heavy, heavy, held)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == sorted(plain_trie(rebuilt(small)), key=str)


def test_trie_of_long_conversations_and_of_none(spark):
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string")
    turns, lengths = trie.whole(df)
    rows = trie.trie(turns, lengths).collect()
    (top,) = [r for r in rows if r["depth"] == 0]
    assert top["n_convs"] == len({r[0] for r in TALKS if r[0] is not None})
    assert max(r["depth"] for r in rows) == 900
    long = [r for r in rows if r["depth"] == 1 and r["conv_id"] == 300]
    assert long[0]["saved_tokens"] == sum(len(str(t)) for t in range(900)) and long[0]["n_leaves"] == 1
    assert trie.trie(*trie.branched(df.limit(0))).count() == 0


def test_spilling_queue_keeps_order():
    q = trie.SpillingQueue(3)
    rng = np.random.default_rng(0)
    orders = [(-5, f"{k:02}") for k in rng.integers(0, 9, 60)]
    for i, o in enumerate(orders):
        q.push((o, i, 0, 0))
    found = [[m[1] for m in q.take(o)] for o in sorted(set(orders))]
    assert sorted(sum(found, [])) == list(range(60)) and len(q) == 0


def plain_hits(text, items, window):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, met = low(text), set(), set()
    for item, t in items:
        b = low(t)
        for i in range(max(1, len(b) - window + 1)) if b else ():
            g = b[i : i + window]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit |= set(range(s, s + len(g)))
                    met.add("" if item is None else str(item))
    return len(w), len(hit), sorted(met)


def test_decontamination_against_plain_search(spark):
    rng = np.random.default_rng(3)
    vocab = ["a", "b", "c", "The", "é", "É", "漢字", "İ", "x9", "K"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(1, 30, 40))] + [(5, "zz yy"), (None, "only here"), (41, None), (42, " ... "), (43, "Solo"), (10, "a b c the a b c the a b c the"), (9, "a b c the a b c the a b c the")]
    texts = [say(int(n)) for n in rng.integers(0, 300, 60)] + [None, "", "...", "zz,yy", "ONLY here", "solo", "a-b.c;The " * 40, items[3][1].upper(), " ".join(t for _, t in items if t)]
    texts += ["q" * (decontam.SEGMENT * 2 + 17) + " " + items[0][1] + " " + "r" * (decontam.SEGMENT - 5) + " zz yy", "only here " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"row": F.lit("r"), "hash": F.lit(1), "met": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("wid", F.lit(1))
    found, listed = decontam.scan(docs, bench, window=6, shingle=3)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"] or []) for r in found.join(listed, "met", "left").collect()}
    for i, t in enumerate(texts):
        n, hits, met = plain_hits(t, items, 6) if i < len(texts) - 1 else (120_000, 120_000, [""])
        assert got[i] == (n, hits, sorted(met)), i
    (some, _) = decontam.scan(docs, bench.limit(0))
    assert some.where("n_hit > 0").count() == 0 and some.count() == len(texts)
    assert decontam.scan(docs.limit(0), bench)[0].count() == 0


def test_words_across_segments():
    data = ("Äb" * 300_000 + " x1 " + "Q" * decontam.SEGMENT).encode()
    h, start, end, low = decontam.words_of(np.frombuffer(data, np.uint8))
    assert len(h) == 3 and [int(e - s) for s, e in zip(start, end, strict=True)] == [900_000, 2, decontam.SEGMENT]
    alone = decontam.words_of(np.frombuffer(b"x1", np.uint8))[0]
    assert h[1] == alone[0] and decontam.words_of(np.frombuffer(b"  " + data, np.uint8))[0].tolist() == h.tolist()
