"""Operators over texts against plain versions, on odd inputs and on the shared tables."""

import os
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codegraph_spark.llm import bpe, chat, langid, licenses, linedups, neardups, quality, queries, simhash, token_counts
from codegraph_spark.llm import vocabulary as voc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", "clash") for i, t in enumerate(brute.TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "the cat", None, None, None)], DOCS).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def shared(spark):
    if not os.path.isdir(SF):
        pytest.skip("shared tables are not here")
    return SF


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op6_chat_format", "op7_nearest")])
def test_empty_documents(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_language_accuracy(spark, shared):
    docs = spark.read.parquet(f"{shared}/documents.parquet").select("doc_id", "lang")
    r = queries.op1_language_id(spark, shared).join(docs, "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert held and sum(x["lang_pred"] == x["lang"] for x in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 for x in r)


def test_language_odd(spark, odd, empty):
    train = spark.createDataFrame([("the cat is in the house and the dog", "en"), ("die katze ist in dem haus und der hund", "de"), ("кошка в доме и собака", "ru")], "text string, lang string")
    model = langid.train(train)
    got = by_id(langid.identify(odd, model).select("row.*", "lang_pred", "score", "spans"))
    assert got[5]["lang_pred"] == "de" and got[6]["lang_pred"] == "en"
    for i in (0, 1, 2, 4):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, [])
    text = "the cat is in the house and the dog " * 3 + "кошка в доме и собака " * 3
    langs, scores, spans = langid.label_texts([text], model)
    assert [s["lang"] for s in spans[0]] == ["en", "ru"] and text[spans[0][1]["start"]] == "к"
    nobody = langid.train(empty)
    assert langid.label_texts(["abc"], nobody) == (["und"], [0.0], [[]])


def test_viterbi_is_best_path():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 0, 5, 200, 64, 65])
    scores = rng.normal(0, 5, (int(lengths.sum()), 3)).astype(np.float32)
    got, at = langid.viterbi(scores, lengths, 7.0), 0
    for n in lengths:
        s, label = scores[at : at + n], got[at : at + n]
        value = sum(s[range(n), label]) - 7.0 * int((label[1:] != label[:-1]).sum()) if n else 0
        best = np.zeros(3)
        for row in s:
            best = np.maximum(best, best.max() - 7.0) + row
        assert abs(value - (best.max() if n else 0)) < 1e-2
        at += n


def test_language_in_pieces(monkeypatch):
    texts = ["the cat " * 50, None, "die katze und der hund " * 40, "x" * 500]
    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(0, 1, (2, langid.BUCKETS)).astype(np.float32), np.ones((len(langid.SCRIPTS), 2), bool))
    whole = langid.label_texts(texts[:3], model)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert langid.label_texts(texts[:3], model) == whole
    assert len(langid.label_texts(texts, model)[0]) == 4


def test_licenses(spark, odd, shared):
    got = {(r["doc_id"], r["text_hash"]): r for r in licenses.scan(odd).collect()}
    texts = {(r["doc_id"], r["h"]): r["text"] for r in odd.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()}
    assert got.keys() == texts.keys()
    for key, r in got.items():
        n, n_base, first, last, labels = brute.base_licenses(texts[key])
        exact = [s for s in r["spans"] if s["exact"]]
        starts = [s["start"] for s in exact]
        assert (r["n_words"], len(exact), min(starts, default=None), max(starts, default=None), ",".join(sorted({s["label"] for s in exact}))) == (n, n_base, first, last, labels)
    gpl = next(r for (i, _), r in got.items() if i == 14)
    assert [s["label"] for s in gpl["spans"]] == ["gpl-3"] and 0 < gpl["spans"][0]["coverage"] < 1  # a word was put in
    docs = spark.read.parquet(f"{shared}/documents.parquet").select("doc_id", "text").collect()
    q = by_id(queries.op2_license_scan(spark, shared))
    for d in docs:
        r = q[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.base_licenses(d["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_line_dedup(spark):
    shared_line = "Page {} of the same old report"
    rows = [(i, f"own line of {'abcdefgh'[i]} {'stuvwxyz'[i]} {'klmnopqr'[i]}\n{shared_line.format(i)}\nshort\nthe quick brown fox jumps over {w} lazy dogs", "s") for i, w in enumerate(["ten", "two", "six", "one"])]
    docs = spark.createDataFrame([*rows, (4, None, "s"), (5, "", "s"), (None, shared_line.format(9), "s"), rows[1]], "doc_id long, text string, kept_text string")
    got = {}
    for r in linedups.drop_recurring(docs).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect():
        got.setdefault(r["doc_id"], []).append((r["kept_text"], r["n_lines"], r["n_dropped"]))
    assert got[0] == [(rows[0][1], 4, 0)]  # the first document keeps its lines
    assert got[1] == [("own line of b t l\nshort", 4, 2)] * 2
    assert got[4] == [(None, 0, 0)] and got[5] == [("", 1, 0)] and got[None] == [("", 1, 1)]
    out = linedups.dedup_lines(docs.withColumn("n_chars", F.length("text")))
    assert out.columns == [*docs.columns, "n_chars"] and {r["n_chars"] for r in out.where("doc_id = 1").collect()} == {len("own line of b t l\nshort")}
    assert linedups.dedup_lines(docs, min_docs=50).where("doc_id = 2").collect()[0]["text"] == rows[2][1]


def test_line_dedup_finds_rarer_templates_of_a_leaf(spark):
    often = [(i, f"Please contact the sales team in {w} for all offers of today") for i, w in enumerate("abcdefghijkl")]
    rare = [(20 + i, f"Please contact the press office about {w} before noon on working days") for i, w in enumerate("mnopq")]
    rarest = [(40 + i, f"Please contact the night desk when {w} is closed or cannot answer") for i, w in enumerate("rst")]
    once = [(60, "Please contact the captain himself because nobody else ever knows that secret")]
    docs = spark.createDataFrame([*often, *rare, *rarest, *once], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["n_dropped"] for r in linedups.drop_recurring(docs, split=True).collect()}
    assert {i for i, n in got.items() if not n} == {0, 20, 40, 60}


def test_line_dedup_of_short_lines(spark):
    lines = "All rights reserved.\n---\n12\nこれは同じ長い段落です。空白はありません。"
    docs = spark.createDataFrame([(i, f"{lines}\nPage {i}\nown{'abcd'[i]}") for i in range(4)] + [(9, None), (10, "")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["kept_text"] for r in linedups.drop_recurring(docs, short=True).collect()}
    assert got[0].startswith(lines) and got[9] is None and got[10] == ""
    assert all(got[i] == f"---\n12\nPage {i}\nown{'abcd'[i]}" for i in (1, 2, 3))


def test_simhash(spark, odd, shared):
    assert [simhash.fingerprint(t) for t in brute.TEXTS if t is None or t.isascii()] == [brute.fingerprint(t) for t in brute.TEXTS if t is None or t.isascii()]
    for df in (odd, spark.read.parquet(f"{shared}/documents.parquet")):
        r = simhash.near_duplicates(df).collect()
        assert len(r) == df.count()
        ids = sorted({x["doc_id"] for x in r} - {None})
        prints = [next(x["fingerprint"] for x in r if x["doc_id"] == i) % (1 << 64) for i in ids]
        label = brute.components(prints, 4)
        want = {i: ids[label[k]] for k, i in enumerate(ids)}
        assert all(x["component_id"] == want[x["doc_id"]] for x in r if x["doc_id"] is not None)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted(set(want.values()))


def test_trie_join_loses_no_link():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40, np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in centre for _ in range(30)]
    values = np.unique(np.array([*centre, *near], np.uint64))
    label = np.arange(len(values))
    for order, head in simhash.block_orders(4):
        turned = simhash._reorder(values, order)
        by = np.argsort(turned)
        for a, b in simhash.trie_join(turned[by], head, 4):
            assert np.bitwise_count(values[by[a]] ^ values[by[b]]) <= 4
            la, lb = label[by[a]], label[by[b]]
            label[label == max(la, lb)] = min(la, lb)
    assert (label == brute.components(values, 4)).all()


def test_near_copies_against_all_pairs(spark, odd, shared):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))] for _ in range(12)]
    edited = []
    for w in base:
        for k in range(12):
            v = list(w)
            for _ in range(k % 6):
                v[rng.randrange(len(v))] = f"x{rng.randint(0, 10**9)}"
            edited.append(" ".join(v))
    made = spark.createDataFrame([*enumerate(edited), (1000, None), (1001, " "), (1002, "a b"), (1003, "A  b"), (None, edited[0])], "doc_id long, text string").withColumn("row", F.lit(1))
    far = 0
    for df in (made, odd, spark.read.parquet(f"{shared}/documents.parquet")):
        rows = df.collect()
        ids = sorted({x["doc_id"] for x in rows} - {None})
        texts = {x["doc_id"]: x["text"] for x in rows}
        label, n_far = brute.copies([texts[i] for i in ids])
        far += n_far
        want = {i: ids[label[k]] for k, i in enumerate(ids)}
        got = neardups.near_copies(df).collect()
        assert len(got) == len(rows) and all(x["component_id"] == want[x["doc_id"]] for x in got if x["doc_id"] is not None)
        kept = neardups.keep_one(df)
        assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted(set(want.values()))
    assert far  # near copies whose fingerprints differ in more than four bits


def odd_strings(n):
    rng = random.Random(4)
    parts = [*"abcdefghijklmnopqrstuvwxyz'sSTΣİK éßÀ²Ⅷ5½٣漢字🎉<|>!?.\t\n\x1c\x85", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "'ll", "ing", "tion"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_bpe_and_counts_agree_with_library(spark, odd, shared):
    library, v = Tokenizer.from_file(PATH), voc.load(PATH)
    texts = [*brute.TEXTS, *odd_strings(3000)]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in bpe.Encoder(v).encode(texts)] == want
    small = bpe.Encoder(v, keep=10)
    assert [y.tolist() for i in range(0, len(texts), 100) for y in small.encode(texts[i : i + 100])] == want
    machine = token_counts.Compiler(v)
    assert token_counts.count_tokens(texts, machine, v).tolist() == list(map(len, want))
    names = bpe.docs_names(PATH)
    assert [bpe.decode(np.array(x, int), names).decode() for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{shared}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: e.ids for i, e in zip(docs, library.encode_batch([t or "" for t in docs.values()], add_special_tokens=False), strict=True)}
    for r in queries.op5_bpe(spark, shared).collect():
        x = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(x), brute.sha(np.array(x, "<u4").tobytes()), brute.sha(library.decode(x, skip_special_tokens=False)))
    for r in queries.op8_token_count(spark, shared).collect():
        n = len(ids[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((docs[r["doc_id"]] or "").encode()), n, n > 2048)
    encoded = bpe.encode(odd.drop("row"), PATH).select("row.*", "ids")
    back = bpe.decode_ids(encoded.withColumn("decoded", F.lit(1)), PATH).collect()
    assert len(back) == odd.count() and all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in back)


def test_machine_forgets_and_goes_on():
    v = voc.load(PATH)
    texts = odd_strings(400)
    want = token_counts.count_tokens(texts, token_counts.Compiler(v), v)
    tight = token_counts.Compiler(v, max_states=50)
    assert [token_counts.count_tokens([t], tight, v)[0] for t in texts] == want.tolist()


def test_chat(spark, shared):
    odd_text = "a\\b [/INST] <s> </s> <\\s> \\n [\\INST] <<SYS>>\n\x01"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", odd_text), (1, 2, "user", None), (1, None, "sys\\tem\n", "first"), (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, 1, "assistant", "x"),
             (4, 5, None, odd_text), (None, 0, "assistant", "n"), (3, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("lines", F.lit(1))
    made = chat.examples(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    for c, r in got.items():
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        trained = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), brute.sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(trained), brute.sha(trained))
    assert made.where("conv_id = 3").count() == 3 and made.where("conv_id = 2").collect()[0]["target"] is None
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0
    talks = spark.read.parquet(f"{shared}/conversations.parquet").collect()
    q = {r["conv_id"]: r for r in queries.op6_chat_format(spark, shared).collect()}
    assert q.keys() == {t["conv_id"] for t in talks} | {-1}
    assert q[-1]["loss_chars"] == 21 and q[-1]["loss_sha256"] == brute.sha("</s>[INST] ok [/INST]")
    for c in q.keys() - {-1}:
        mine = sorted((t for t in talks if t["conv_id"] == c), key=lambda t: t["turn"])
        assert q[c]["turns_sha256"] == brute.sha("".join(f"{t['role']}\n{t['text'] or ''}\n" for t in mine))
        assert q[c]["loss_sha256"] == brute.sha("".join(t["text"] or "" for t in mine if t["role"] == "assistant"))


def test_quality_counts(spark, odd, shared):
    for df in (odd, spark.read.parquet(f"{shared}/documents.parquet")):
        for r in quality.counts(df).collect():
            assert tuple(r)[1:6] + (r["base_failed"],) == brute.quality_counts(r["row"]["text"])
    judged = quality.judge(spark.read.parquet(f"{shared}/documents.parquet"), min_group=20).collect()
    assert len(judged) == 200 and all(r["distance"] is None for r in judged if r["base_failed"])


def test_quality_rejects_outliers(spark):
    rng = random.Random(2)
    fine = [(i, " ".join(rng.choice(["alpha", "beta", "of", "gamma", "delta", "to", "epsilon", "zeta", "in"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(80, 300))), "en", "s" if i % 3 else None) for i in range(300)]
    bad = [(1000 + i, " ".join("#*$%" + str(j) for j in range(100 + i)), "en", "s") for i in range(20)]
    rows = spark.createDataFrame([*fine, *bad, (2000, None, "en", "s"), (2001, fine[0][1], "xx", "y")], "doc_id long, text string, lang string, source string")
    got = by_id(quality.judge(rows))
    assert not any(got[1000 + i]["kept"] for i in range(20))
    assert sum(got[i]["kept"] for i in range(300)) >= 297
    assert got[2000]["base_failed"] and got[2001]["kept"] and got[2001]["distance"] is not None


def test_quality_judges_small_groups(spark):
    """A few texts of a language are judged with all rows, a small source with its language; copies do not make other texts outliers."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "of", "gamma", "delta", "to", "zeta", "in"]) + str(rng.randint(0, 999)) for _ in range(n))
    bad = " ".join("#*$%" + str(j) for j in range(120))
    rows = [(i, text(rng.randint(80, 300)), "en", "s") for i in range(70)]
    rows += [(100 + i, text(rng.randint(80, 300)), "en", "few") for i in range(3)] + [(110, bad, "en", "few")]
    rows += [(120 + i, text(rng.randint(80, 300)), "fr", None) for i in range(2)] + [(130, bad, "fr", None), (131, bad, None, None)]
    copied = text(150)
    rows += [(1000 + i, copied, "en", "s") for i in range(150)]
    schema = "doc_id long, text string, lang string, source string"
    got = by_id(quality.judge(spark.createDataFrame(rows, schema)))
    assert len(got) == len(rows) and all(r["distance"] is not None for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {110, 130, 131}
    fit = quality.grouped(spark.createDataFrame([("en", "s")] * 60 + [("en", "t")] * 3 + [("fr", None)] * 2, "l string, s string"), "l", "s", 50)
    place = {(r["_l"], r["_s"]): r["g"] for r in fit[1].collect()}
    assert place == {("en", "s"): '["=en","=s"]', ("en", "t"): '["=en","*"]', ("fr", None): '["*","*"]'}
    assert {r["g"]: r["count"] for r in fit[0].groupBy("g").count().collect()} == {'["=en","=s"]': 60, '["=en","*"]': 63, '["*","*"]': 65}
    few = by_id(quality.judge(spark.createDataFrame(rows[60:80], schema)))
    assert all(r["distance"] is None and r["kept"] for r in few.values())


def test_robust_estimate_against_numpy(spark):
    """One group, exact quantiles: the same concentration steps in numpy."""
    rng = np.random.default_rng(9)
    names = [f for f, _ in quality.FEATURES]
    x = rng.normal(0, 1, (200, len(names)))
    x[:20] += 15
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{n} double" for n in names))
    got = quality.robust_estimates(rows).collect()[0]
    floor = np.diag([f**2 for _, f in quality.FEATURES])

    def low(v, share):
        return np.sort(v)[int(np.ceil(share * len(v))) - 1]

    dev = np.abs(x - [low(x[:, i], 0.5) for i in range(x.shape[1])])
    mad = np.array([low(dev[:, i], 0.5) for i in range(x.shape[1])])
    z2 = (dev / (1.4826 * mad + np.sqrt(np.diag(floor)))) ** 2
    results = []
    for d in (z2.sum(axis=1), z2[:, 1:].sum(axis=1)):
        for _ in range(quality.STEPS + 1):
            near = x[d <= low(d, quality.SUBSET)]
            mean, cov = near.mean(axis=0), np.cov(near.T) + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        results.append((np.linalg.slogdet(cov)[1], mean))
    want = min(results, key=lambda r: r[0])
    assert got["log_det"] <= want[0] + 1e-6
    assert np.allclose(want[1], [got[f"m{i}"] for i in range(len(names))], atol=0.3)


def test_viterbi_with_many_labels():
    """More labels than a byte can name, several sequences, against a plain search."""
    rng = np.random.default_rng(5)
    n_labels, lengths, penalty = 200, np.array([3, 0, 700, 1]), 2.0
    scores = rng.normal(size=(int(lengths.sum()), n_labels)).astype(np.float32)
    scores[5:300, 180] += 6
    got = langid.viterbi(scores, lengths, penalty)
    at = 0
    for n in lengths[lengths > 0]:
        s, v, back = scores[at : at + n], None, []
        for row in s:
            if v is None:
                v = row.astype(float)
                continue
            best = v.argmax()
            back.append(np.where(v[best] - penalty > v, best, np.arange(n_labels)))
            v = np.maximum(v, v[best] - penalty) + row
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        mine = got[at : at + n].tolist()
        cost = lambda p, s=s: sum(float(s[i, x]) for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert abs(cost(mine) - cost(path[::-1])) < 1e-2
        at += n
    assert 180 in got.tolist()


def test_documents_without_labels_stay(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(docs).count() == 2
    words = {"en": "the house and the garden ", "de": "das haus und der garten "}
    rows = [(i, words[lang] * 20, lang) for i in range(20) for lang in words] + [(99, words["en"] * 9 + words["de"] * 8 + words["en"], None), (100, "12 34", None)]
    kept = {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert 99 in kept and 100 not in kept and 3 in kept


def test_states_stay_bounded_inside_a_text():
    with open(queries.VOCABULARY, encoding="utf-8") as f:
        v = voc.parse(f.read())
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("etaoinshrdlu"), 6000)) + " ab cd"
    free, tight = token_counts.Compiler(v), token_counts.Compiler(v, max_states=300)
    want = token_counts.count_tokens([text, "plain words"], free, v)
    assert len(free.states) > 2000 and (token_counts.count_tokens([text, "plain words"], tight, v) == want).all() and len(tight.states) < 1000


def test_language_training_holds_one_piece_of_text():
    """Counting features of a long text takes memory for a piece of it, and the counts do not depend on the pieces."""
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"word{i % 977} größer {chr(0x3b1 + i % 20)}" for i in range(90_000))
    batch = pa.RecordBatch.from_pydict({"text": [text, "the cat", "", text[:999]], "lang": ["a", "b", "b", "a"]})
    langid._tables()
    count = lambda: [c.to_pylist() for c in next(iter(langid._count_features(["a", "b"])(iter([batch])))).columns]
    tracemalloc.start()
    got = count()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 1_400_000 and peak < 60 << 20
    keep, langid.TRAINING_PIECE = langid.TRAINING_PIECE, 1 << 30
    try:
        assert count() == got
    finally:
        langid.TRAINING_PIECE = keep
