import json
import random

import pytest
from pyspark.sql import functions as F
from conftest import rows
from samples import files_df

from codegraph_spark.functions.import_groups import leaf_paths
from codegraph_spark.operators import extract, linking, registry
from codegraph_spark.sources import scan


@pytest.fixture(scope="module")
def index(spark):
    ix = registry.index_corpus(files_df(spark))
    return {n: getattr(ix, n).cache() for n in ("files", "symbols", "refs", "file_imports", "raw_imports")}


def test_csharp_symbols(index):
    got = {(r.name, r.kind, r.line_start, r.line_end) for r in index["symbols"].filter("repo_name = 'cs'").collect()}
    assert {
        ("Counter", "Class", 7, 22), ("Total", "Property", 9, 9), ("Bump", "Method", 11, 15), ("Render", "Method", 17, 21),
        ("IShape", "Interface", 3, 6), ("Area", "Method", 5, 5), ("Square", "Class", 8, 16), ("Side", "Property", 10, 10),
        ("Mood", "Enum", 18, 22), ("Runner", "Class", 5, 14), ("Go", "Method", 7, 13),
    } <= got
    assert not {n for n, *_ in got} & {"counter", "return", "Calm"}
    sig = {r.name: r.signature for r in index["symbols"].filter("repo_name = 'cs'").collect()}
    assert sig["Square"] == "Square : IShape, IDisposable" and sig["Counter"] == "Counter" and sig["Bump"] == "public int Bump(int step)"
    ids = {r.id for r in index["symbols"].collect()}
    assert "cs::/r/Counter.cs::Bump::Method::11" in ids and "rs:/s/src/store/basket.rs:add_item:3" in ids


def test_rust_symbols_leave_methods_out(index):
    got = {(r.name, r.kind) for r in index["symbols"].filter("repo_name = 'rs'").collect()}
    assert {("add_item", "Function"), ("Item", "Struct"), ("Shade", "Enum"), ("Named", "Trait"), ("Named for Item", "TraitImpl"), ("inner", "Module"), ("helper", "Function")} <= got
    assert not {n for n, _ in got} & {"fresh", "name"}


def test_imports(spark, index):
    raw = {(r.file_path, r["import"]) for r in index["raw_imports"].collect()}
    assert ("/r/Counter.cs", "System") in raw and ("/r/Counter.cs", "system") not in raw and ("/s/src/main.rs", "store") in raw
    got = {(r.from_file, r.to_file) for r in index["file_imports"].filter("repo_name <> 'cs'").collect()}
    assert got == {
        ("/s/src/main.rs", "/s/src/store/basket.rs"), ("/s/src/main.rs", "/s/src/model/item.rs"), ("/s/src/store/basket.rs", "/s/src/model/item.rs"),
        ("/w/apps/front/src/main.rs", "/w/base-kit/src/lib.rs"),
    }


def test_references(index):
    refs = {(r.symbol_id.split("/")[-1], r.in_file.split("/")[-1], r.line) for r in index["refs"].collect()}
    assert ("basket.rs:add_item:3", "main.rs", 8) in refs and ("basket.rs:drop_item:7", "main.rs", 9) in refs
    assert ("Counter.cs::Render::Method::17", "Calls.cs", 10) in refs and ("Shapes.cs::Square::Class::8", "Calls.cs", 11) in refs
    assert ("lib.rs:load_settings:5", "main.rs", 5) in refs
    assert not [r for r in refs if r[0].startswith("basket.rs:add_item") and r[1:] == ("basket.rs", 3)]
    assert all(r.context for r in index["refs"].collect())


def test_file_nodes(index):
    n = {r.file_path: (r.language, r.symbol_count, r.imports) for r in index["files"].collect()}
    assert n["/s/src/store/basket.rs"] == ("Rust", 2, ["/s/src/model/item.rs"]) and "/s/Cargo.toml" not in n


def test_leaf_paths(spark):
    want = {
        "a::{b, c::{d, e as f}, self};": ["a::b", "a::c::d", "a::c::e", "a"],
        "pub use x::*;": ["x"], "use a::b as c": ["a::b"], "a::{b": ["a::{b"], "use {x, y::z};": ["x", "y::z"], "a::{b::{self, c},};": ["a::b", "a::b::c"], "": [],
    }
    df = spark.createDataFrame([(k,) for k in want], "text string")
    assert {r["text"]: r["p"] for r in df.select("text", leaf_paths(F.col("text")).alias("p")).collect()} == want


def test_manifests(spark):
    m = {r.crate_root: r for r in extract.parse_manifests(files_df(spark)).collect()}
    assert m["/w"].is_workspace and m["/w"].members == ["base-kit", "apps/*"] and m["/w"].crate_name is None
    assert m["/w/apps/front"].crate_name == "front" and [tuple(p) for p in m["/w/apps/front"].path_deps] == [("base_kit", "/w/base-kit")]
    assert m["/w/base-kit"].crate_key == "base_kit"


def _symbols(spark, data):
    return spark.createDataFrame(data, "id string, repo_name string, file_path string, name string, kind string, line_start int, line_end int, signature string")


def test_ranked_linking_prefers_imports_and_fitting_kinds(spark):
    s = _symbols(spark, [
        ("far", "r", "/z.rs", "run", "Function", 4, 5, None), ("near", "r", "/imp.rs", "run", "Unknown", 9, 9, None),
        ("fn", "r", "/a.rs", "Thing", "Function", 1, 1, None), ("st", "r", "/b.rs", "Thing", "Struct", 1, 1, None),
    ])
    use = spark.createDataFrame(
        [("r", "/main.rs", "run", 3, "run(1);"), ("r", "/main.rs", "Thing", 5, "let t: Thing = x;"), ("r", "/main.rs", "run", 1, "use a::run;")],
        "repo_name string, file_path string, token string, line int, context string",
    )
    imports = spark.createDataFrame([("r", "/main.rs", "/imp.rs")], "repo_name string, from_file string, to_file string")
    got = rows(linking.link_ranked(use, s, imports), "symbol_id", "line")
    assert got == [("near", 3), ("st", 5)]


def test_enclosing_symbol_rules(spark):
    s = _symbols(spark, [
        ("open1", "r", "/o.rs", "a", "Function", 1, 0, None), ("open2", "r", "/o.rs", "b", "Function", 10, 0, None),
        ("outer", "r", "/x.cs", "C", "Class", 1, 20, None), ("inner", "r", "/x.cs", "m", "Method", 5, 8, None), ("late", "r", "/x.cs", "D", "Class", 30, 31, None),
    ])
    pts = spark.createDataFrame([("r", "/o.rs", 12), ("r", "/x.cs", 6), ("r", "/x.cs", 9), ("r", "/x.cs", 25), ("r", "/x.cs", 40), ("r", "/none", 1)], "repo_name string, file_path string, line int")
    got = {(r.file_path, r.line): r.symbol_id for r in linking.enclosing_symbol(pts, s).collect()}
    assert got == {("/o.rs", 12): "open2", ("/x.cs", 6): "inner", ("/x.cs", 9): "outer", ("/x.cs", 25): "inner", ("/x.cs", 40): "late"}


def test_link_decl_site_takes_nearest_start(spark):
    s = _symbols(spark, [("a", "r", "/d.cs", "X", "Class", 1, 50, None), ("b", "r", "/d.cs", "X", "Method", 10, 20, None)])
    sites = spark.createDataFrame([("r", "/u.cs", 3, "X()", "X", "/D.cs", 12), ("r", "/d.cs", 10, "X", "X", "/d.cs", 10)], "repo_name string, file_path string, line int, context string, name string, decl_file string, decl_line int")
    assert rows(linking.link_decl_site(sites, s), "symbol_id", "in_file", "line") == [("b", "/u.cs", 3)]


def test_lexical_link_options(spark):
    s = _symbols(spark, [(f"s{i}", "r", f"/f{i:02}.cs", "Same", "Class", 1, 2, None) for i in range(40)])
    use = spark.createDataFrame([("r", "/u.cs", "Same", 5, "Same()"), ("r", "/f00.cs", "Same", 1, "class Same")], "repo_name string, file_path string, token string, line int, context string")
    assert linking.link_lexical(use, s, candidates_per_name=32).count() == 32 + 31
    assert linking.link_lexical(use, s).count() == 40 + 39
    assert linking.link_lexical(use, s, refs_per_file=10).count() == 20


def test_texts_join_uses_not_pairs(spark, monkeypatch):
    met = []
    real = linking.product_join
    monkeypatch.setattr(linking, "product_join", lambda left, *a: met.append(left) or real(left, *a))
    s = _symbols(spark, [(f"s{i}", "r", f"/f{i:02}.cs", "Same", "Class", 1, 2, None) for i in range(40)])
    lines = spark.createDataFrame([("r", "/u.cs", 5, " Same(Same) "), ("r", "/u.cs", 6, "other()"), ("r", "/F00.cs", 1, "class Same")], "repo_name string, file_path string, line int, text string")
    use = spark.createDataFrame([("r", "/u.cs", "Same", 5), ("r", "/u.cs", "Same", 5), ("r", "/u.cs", "other", 6), ("r", "/F00.cs", "Same", 1)], "repo_name string, file_path string, token string, line int")
    got = rows(linking.link_lexical(use, s, lines=lines), "symbol_id", "in_file", "line", "context")
    want = [(f"s{i}", "/u.cs", 5, "Same(Same)") for i in range(40)] + [(f"s{i}", "/F00.cs", 1, "class Same") for i in range(1, 40)]
    assert got == sorted(want, key=str)
    # the text of a line comes in with its two uses of a declared name, not with their 80 pairs
    assert [rows(left, "in_file", "context") for left in met] == [[("/F00.cs", "class Same"), ("/u.cs", "Same(Same)")]]


def test_usages(spark):
    lines = spark.createDataFrame(
        [("r", "/a.rs", "Rust", 1, "let x = foo::make(&y, Vec<Item>); // hidden(1)"), ("r", "/a.rs", "Rust", 2, "fn go(a: &'a mut Thing) -> Shade { Point { x } }")],
        "repo_name string, file_path string, language string, line int, text string",
    )
    got = {(r.token, r.line) for r in extract.rust_usages(lines).collect()}
    assert {("make", 1), ("foo", 1), ("Item", 1), ("Thing", 2), ("Shade", 2), ("Point", 2)} <= got and ("hidden", 1) not in got and ("fn", 2) not in got


def test_text_parsers(spark):
    log = [
        "error[E01]: first", "noise", "error[E02]: second", " --> src/a.rs:3:4", "  --> src/b.rs:9:9", "src/x.cs(10,5): warning CS1: hm",
        "src/t.ts:7:2 - error TS9: bad", "warning: plain", "--> src/c.rs:1:2",
    ]
    lines = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(log)], "log_id string, line int, text string")
    got = [tuple(r)[2:] for r in extract.parse_diagnostics(lines).orderBy("log_line").collect()]
    assert got == [
        ("src/a.rs", 3, 4, "error", "E02", "second"), ("src/x.cs", 10, 5, "warning", "CS1", "hm"),
        ("src/t.ts", 7, 2, "error", "TS9", "bad"), ("src/c.rs", 1, 2, "warning", "", "plain"),
    ]
    patch = ["+++ b/a.cs", "@@ -1,2 +3 @@ x", "+y", "@@ -9 +9,4 @@", "+++ b/b.cs", "@@ -5,0 +6,2 @@"]
    p = spark.createDataFrame([("c", i, t) for i, t in enumerate(patch)], "commit_id string, line int, text string")
    assert rows(extract.parse_hunks(p), "path", "ordinal", "old_start", "old_count", "new_start", "new_count") == [
        ("a.cs", 1, 1, 2, 3, 1), ("a.cs", 2, 9, 1, 9, 4), ("b.cs", 1, 5, 0, 6, 2)
    ]
    status = spark.createDataFrame([("s", 1, "R  old.cs -> new.cs"), ("s", 2, "?? x.cs"), ("s", 3, "x"), ("s", 4, " M y.cs")], "snapshot_id string, line int, text string")
    assert rows(extract.parse_status(status), "path", "xy", "staged", "unstaged", "untracked", "renamed_from") == [
        ("new.cs", "R ", True, False, False, "old.cs"), ("x.cs", "??", False, False, True, None), ("y.cs", " M", False, True, False, None)
    ]
    noisy = ["\x1b[32mgo\x1b[0m", "go", "---|", "go ", "│ x", "go"]
    n = spark.createDataFrame([("l", i, t) for i, t in enumerate(noisy)], "log_id string, line int, text string")
    assert [r.text for r in extract.sanitize_log(n).orderBy("seq").collect()] == ["go (x3)", "| x", "go"]
    num = spark.createDataFrame([("c", "3\t1\tsrc/{a => b}/x.cs"), ("c", "-\t-\tpic.png"), ("c", "R100\tsrc/a/x.cs\tsrc/b/x.cs"), ("c", "A\tpic.png")], "commit_id string, text string")
    assert rows(extract.parse_numstat(num), "path", "prev_path", "status", "inserted", "deleted", "is_binary") == [
        ("pic.png", None, "A", None, None, True), ("src/b/x.cs", "src/a/x.cs", "R", 3, 1, False)
    ]


def test_configuration_and_scan(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"App": {"Repos": [{"Name": "One", "Path": "/r", "Languages": ["Rust"]}]}}))
    p = scan.read_projects(spark, str(tmp_path / "p.json"), "App").first()
    assert p.name == "One" and p.exclude_paths == ["bin", "obj", "node_modules", ".git"]
    (tmp_path / "d.json").write_text(json.dumps({"Repos": [{"Name": "One", "Path": "/r"}, {"Name": "ONE", "Path": "/q"}]}))
    with pytest.raises(ValueError):
        scan.read_projects(spark, str(tmp_path / "d.json"))
    (tmp_path / "t.json").write_text(json.dumps({"name": "pack", "repo": None, "tasks": [{"id": "a", "title": "t", "kind": "history_touch_count", "path": "x\\y.cs"}]}))
    assert scan.read_task_pack(spark, str(tmp_path / "t.json")).first().path == "x/y.cs"
    (tmp_path / "e.json").write_text(json.dumps({"name": "pack", "tasks": []}))
    with pytest.raises(ValueError):
        scan.read_task_pack(spark, str(tmp_path / "e.json"))
    for rel in ("src/a.cs", "src/bin/b.cs", "src/c.txt"):
        f = tmp_path / "root" / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("class A {}\n")
    found = scan.scan_files(spark, str(tmp_path / "root"), [".cs"])
    assert [r.file_path.split("/root/")[1] for r in found.collect()] == ["src/a.cs"] and found.first().content == "class A {}\n"


def test_registry_rejects_taken_extensions():
    r = registry.default_registry()
    with pytest.raises(ValueError):
        registry.register_language(r, "Other", [".CS"], [])
    assert registry.register_language(r, "Py", [".py"], []).extensions()["Py"] == [".py"]


def test_unknown_pattern_language_is_dropped(spark):
    files = spark.createDataFrame([("r", "/a.CS"), ("r", "/b.md")], "repo_name string, file_path string")
    assert rows(scan.assign_language(files, scan.language_table(spark)), "file_path", "language") == [("/a.CS", "CSharp")]


def plain_ranked(use, symbols, imports):
    """(symbol id, file, line): the best symbol of each usage and a close second, from all symbols of its name."""
    out = set()
    for file, token, line, text in use:
        if text.startswith("use "):
            continue
        called = f"{token}(" in text
        typed = any(f"{a}{token}{b}" in text for a, b in ((": ", ""), ("-> ", ""), ("<", ">"), (" ", " {")))
        found = []
        for sid, f, name, kind, start in symbols:
            if name != token:
                continue
            score = 18 + max(0, 16 - min(16, abs(start - line))) if f == file else 0
            score += 30 * ((file, f) in imports) + 24 * (called and kind in linking.CALLABLE) + 22 * (typed and kind in linking.TYPE_KINDS)
            if not called and not typed:
                score += 9 if kind in linking.CALLABLE else 8 if kind in ("Struct", "Class", "Interface", "Trait") else 3
            found.append((-score, f, start, sid))
        best = sorted(found)[:2]
        out |= {(sid, file, line) for n, (s, f, start, sid) in enumerate(best) if -s >= 12 and (n == 0 or s - best[0][0] <= 2) and (f, start) != (file, line)}
    return sorted(out, key=str)


@pytest.mark.parametrize("with_lines", [True, False])
def test_ranked_linking_of_many_usages(spark, with_lines):
    """With lines, usages need no text of their own: it was written and shuffled once per usage."""
    r = random.Random(3)
    names, files, kinds = ["run", "make", "Thing", "Other"], [f"/f{i}" for i in range(4)], ["Function", "Method", "Struct", "Enum", "Field", "Class"]
    symbols = sorted({(r.choice(files), r.choice(names), r.choice(kinds), r.randint(1, 60)) for _ in range(150)})
    symbols = [(f"s{i:03}", *s) for i, s in enumerate(symbols)]
    imports = [(a, b) for a in files for b in files if r.random() < 0.3] + [("/f0", "/f0")]
    shapes = ["x = {}(1)", "let a: {} = b", "{} and {}", "use a::{};", "<{}>", "-> {} {{", "a.{}", " {} {{ x }}"]
    lines = [(f, n, r.choice(shapes).replace("{}", "%s").replace("{{", "{").replace("}}", "}")) for f in files for n in range(1, 40)]
    lines = [(f, n, t.replace("%s", r.choice(names), 1).replace("%s", r.choice(names))) for f, n, t in lines]
    use = [(f, name, n, t.strip()) for f, n, t in lines for name in names if name in t]
    usages = spark.createDataFrame([("r", *u) for u in use], "repo_name string, file_path string, token string, line int, context string")
    table = _symbols(spark, [(i, "r", f, name, kind, start, start, None) for i, f, name, kind, start in symbols])
    told = spark.createDataFrame([("r", a, b) for a, b in imports], "repo_name string, from_file string, to_file string")
    text = spark.createDataFrame([("r", *x) for x in lines], "repo_name string, file_path string, line int, text string")
    got = linking.link_ranked(usages.drop("context"), table, told, lines=text) if with_lines else linking.link_ranked(usages, table, told)
    assert rows(got, "symbol_id", "in_file", "line") == plain_ranked(use, symbols, set(imports))
