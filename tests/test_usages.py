"""Usage extractors whose patterns SQL cannot say, against plain Python over all document lines."""

import os
import re
import time
from collections import Counter

import pytest

from codegraph_spark.functions import text as tx
from codegraph_spark.operators import extract
from codegraph_spark.sources import corpus
from codegraph_spark.workloads import QUERIES

SF = "/root/testdata/sf0.001"


def ascii_classes(pattern):
    """The pattern as the JVM reads it: word and blank characters are ASCII, word edges are not."""
    return pattern.replace(r"[\w", "[A-Za-z0-9_").replace(r"\w", "[A-Za-z0-9_]").replace(r"\s", "[ \\t\\n\\x0b\\f\\r]")


def find(pattern, text):
    return [m.group(1) for m in re.finditer(ascii_classes(pattern), text)]


def plain_rust(text):
    code = re.sub(r"//.*$", "", text)
    found = find(extract.CALL_NAME, code)
    for path in find(extract.RUST_PATH, code):
        found += path.split("::")
    for p in (extract.RUST_ANNOTATION, extract.RUST_GENERIC, extract.RUST_LITERAL):
        found += find(p, code)
    return {t for t in found if len(t) >= 2 and t not in extract.RUST_STOP_WORDS and t.strip("_")}


def plain_csharp(text):
    if re.match(ascii_classes(r"\s*(?:using|namespace)\b"), text):
        return set()
    code = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)\'', "", text)
    code = re.sub(r"//.*$", "", code)
    declared = set()
    for p in (*(r.pattern for r in extract.CSHARP_RULES), r"\b(?:var|[\w.<>\[\]?]+)\s+([_A-Za-z]\w*)\s*="):
        m = re.search(ascii_classes(p), code)
        declared |= {m.group(1)} if m else set()
    found = {t for p in extract.CSHARP_USE_POSITIONS for t in find(p, code)}
    return {t for t in found if len(t) >= 3 and t not in extract.CSHARP_STOP_WORDS and t not in declared}


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
@pytest.mark.parametrize(("name", "plain"), [("rust_usages", plain_rust), ("csharp_usages", plain_csharp)])
def test_usages_of_all_documents(spark, name, plain):
    want = Counter(t for r in corpus.document_lines(spark, SF).select("text").collect() for t in plain(r["text"]))
    assert want and {r["token"]: r["uses"] for r in QUERIES[name](spark, SF).collect()} == want


@pytest.mark.parametrize(("run", "plain"), [(extract.rust_usages, plain_rust), (extract.csharp_usages, plain_csharp)])
def test_usages_of_code(spark, run, plain):
    code = [
        "let x: Foo<Bar, &'a mut Baz> = crate::util::make(one, two)?; // call(three)", "impl Thing for Other { fn go(&self) -> Self { Other { a: 1 } } }", "_ = __(a1);",
        "using System.Text;", 'var total = items.Sum(x => x.Price) + Helper.Tax("a.b(c)");', "public int Count => _list.Count;", "[Test] public void Runs() { Assert.Equal(expected, actual); }",
        "if (left == right && Ready) return Compute<Result, Error>(left, right);", "new Order(id, name) { Total = 3 };",
    ]
    lines = spark.createDataFrame([("r", "/f", i, t) for i, t in enumerate(code)], "repo_name string, file_path string, line int, text string")
    got = {}
    for r in run(lines).collect():
        got.setdefault(r["line"], set()).add(r["token"])
    assert got == {i: plain(t) for i, t in enumerate(code) if plain(t)}


def plain_lexical(text):
    runs = {t for t in re.findall(r"[^\W]+", text) if re.fullmatch(extract.IDENTIFIER, t)}
    runs = {t for t in runs if len(t) >= 3 and t not in extract.LEXICAL_STOP_WORDS}
    return {t for t in runs if any(f"{a}{t}{b}" in text for a, b in tx.USAGE_SHAPES)}


LEXICAL_LINES = [
    "one two three", "alpha", " beta ", "gamma  delta", "Foo.bar(baz)", "my_foo( foo", "a::b::ccc::ddd", "Map<Key><Val> Set<Row>", "x: Foo, y = Bar,z=Qux", "äfoo( foo über_x",
    "...ends.with.dots.", "pre.fixed pre", "fixed: prefix pre", "a\ttabbed b tabbed", "return class_ class", "", "name name( name:: ::name <name> name",
]


def test_lexical_usages_of_lines(spark):
    lines = spark.createDataFrame([("r", "/f", i, t) for i, t in enumerate(LEXICAL_LINES)], "repo_name string, file_path string, line int, text string")
    got = {}
    for r in extract.lexical_usages(lines).collect():
        got.setdefault(r["line"], []).append(r["token"])
        assert r["context"] == LEXICAL_LINES[r["line"]].strip(" \t")
    assert {i: sorted(ts) for i, ts in got.items()} == {i: sorted(plain_lexical(t)) for i, t in enumerate(LEXICAL_LINES) if plain_lexical(t)}


def test_lexical_usages_read_a_line_once(spark):
    """Each token was looked for in the whole line, nine times: this line was not done after 100 s."""
    text = " ".join(f"word{i}" for i in range(20_000)) + " " + ",".join(f"left{i}" for i in range(20_000))
    lines = spark.createDataFrame([("r", "/f", 1, text)], "repo_name string, file_path string, line int, text string")
    start = time.perf_counter()
    assert extract.lexical_usages(lines).select("token").count() == 19_999
    assert time.perf_counter() - start < 10


def test_csharp_usages_look_for_declarations_once(spark):
    """Declarations were looked for again for each token of a line: this line was not done after 60 s."""
    text = "int total = " + " + ".join(f"Item{i}" for i in range(10_000)) + ";"
    lines = spark.createDataFrame([("r", "/f", 1, text)], "repo_name string, file_path string, line int, text string")
    start = time.perf_counter()
    assert extract.csharp_usages(lines).select("token").count() == 10_000
    assert time.perf_counter() - start < 15
