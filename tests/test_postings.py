"""Scans that read only the files a gram index names, against scans over every line."""

import random
import re
import string

import pytest
from conftest import rows

from codegraph_spark.functions.required import literal_texts, required_texts
from codegraph_spark.operators import ranked
from codegraph_spark.plans import postings
from codegraph_spark.sources.scan import explode_lines


@pytest.mark.parametrize(
    "pattern, texts",
    [
        (r"^The cat", ["The cat"]),
        (r"abc+d", ["abc", "d"]),
        (r"colou?r", ["colo", "r"]),
        (r"ab{0,2}cd", ["a", "cd"]),
        (r"fn \w+\(self\)", ["fn ", "(self)"]),
        (r"x(one|two)y", ["x", "y"]),
        (r"a[^\]b]c", ["a", "c"]),
        (r"(a)(b)\12c", ["c"]),
        (r"one|two", []),
        (r"\x41bc", []),
        (r"a[b[cd]]e", []),
        (r"(?i)abc", []),
        (r"\Qa|b\E", []),
        ("", []),
    ],
)
def test_required_texts(pattern, texts):
    assert required_texts(pattern) == texts


def test_every_match_holds_the_required_texts():
    rng = random.Random(5)
    bits = ["ab", "c", "x?", "y*", "z+", "[ab]", "(ab|c)", ".", r"\.", r"\d", "^", "$", "a{0,1}", "b{2}", "(?:x)", "A"]
    texts = ["".join(rng.choice("abcxyzA.1 ") for _ in range(30)) for _ in range(300)]
    met = 0
    for _ in range(400):
        pattern = "".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
        need = required_texts(pattern)
        for text in texts:
            m = re.search(pattern, text)
            if m:
                met += 1
                assert all(t in m.group() for t in need), (pattern, text)
    assert met > 1000


def test_literals_ignoring_case_keep_only_sure_characters():
    assert literal_texts("Make ÄB list", True) == ["ma", "e ", "b l", "st"]
    assert literal_texts("Make", False) == ["Make"] and literal_texts("", True) == []


def _files(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma ray", "delta.x", "KELVIN", "Kelvin", "naïve", "日本語", "x", "", "𝒳yz"]
    made = []
    for n in range(40):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5))]
        made.append((f"r{n % 2}", f"/f{n // 2}", rng.choice(["\n", "\r\n"]).join(lines)))
    made += [("r0", "/long", "q" * 9000 + "needle" + "q" * 5000), ("r0", "/edge", "p" * 4094 + "needle"), ("r1", "/empty", ""), ("r1", "/null", None)]
    return spark.createDataFrame(made, "repo_name string, file_path string, content string").repartition(3)


def test_indexed_scans_equal_scans_of_all_lines(spark, tmp_path):
    files = _files(spark)
    postings.write(postings.build(files), str(tmp_path / "grams"))
    index = spark.read.parquet(str(tmp_path / "grams"))
    lines = explode_lines(files)
    patterns = [(1, "alpha", False), (2, "BETA", True), (3, r"delta\.x$", False), (4, "[ag]", False), (5, "needle", False), (6, "日本語", False), (7, "absent", False),
                (8, "kelvin", True), (9, "ray|x", False), (10, "𝒳yz", False)]
    found = ranked.indexed_scan(ranked.regex_scan, files, index, patterns)
    assert rows(found) == rows(ranked.regex_scan(lines, patterns).select(*found.columns)) and {r[0] for r in rows(found)} == {1, 2, 3, 4, 5, 6, 8, 9, 10}
    first = ranked.indexed_scan(ranked.regex_scan, files, index, patterns, max_matches=2)
    assert rows(first) == rows(ranked.regex_scan(lines, patterns, 2).select(*first.columns))
    asked = [(1, "literal", "KELVIN", True), (2, "literal", "naïve", False), (3, "regex", r"gamma r\w", False), (4, "literal", "x", False), (5, "literal", "NEEDLE", True)]
    assert rows(ranked.indexed_scan(ranked.rg_search, files, index, asked)) == rows(ranked.rg_search(lines, asked))
    assert not ranked.indexed_scan(ranked.regex_scan, files.limit(0), index.limit(0), patterns).count()


def test_few_files_are_read(spark):
    files = _files(spark)
    met = postings.candidate_lines(files, postings.build(files), {0: ["needle"], 1: ["nothing"]})
    assert {r.file_path for r in met.select("file_path").distinct().collect()} == {"/long", "/edge"}


@pytest.mark.parametrize("whole", [postings.WHOLE, 30])
def test_grams_of_short_files_need_no_exchange(spark, monkeypatch, capsys, whole):
    """The grams of every file were shuffled to make them distinct; now only those of long files are."""
    monkeypatch.setattr(postings, "WHOLE", whole)
    files = _files(spark).filter("content is null or not contains(content, '𝒳')").localCheckpoint()  # halves of it make grams of their own
    want = set()
    for r in files.collect():
        text = "".join(c.lower() if c in string.ascii_uppercase else c for c in r.content or "")
        want |= {(text[i : i + 3], r.repo_name, r.file_path) for i in range(len(text) - 2) if not set(text[i : i + 3]) & {"\r", "\n"}}
    got = rows(postings.build(files))
    assert len(got) == len(want) and set(got) == want
    postings.build(files).explain()
    whole_part = capsys.readouterr().out.split("Union")[-1].split("\n   :- ")[1].split("\n   +- ")[0]
    assert "Generate" in whole_part and "Exchange" not in whole_part
