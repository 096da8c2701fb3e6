import random

from pyspark.sql import functions as F

from cairn.operators import chunk, extract, sections


def test_sections(spark):
    docs = [
        ("test.md", "# Title\n\nintro\n## A\nbody a\n## B\nbody b\n### C\nbody c\n"),
        ("README.txt", "two plain\nlines\n"),
        ("long.md", "## X\n" + "x" * 500 + "\n" + "y" * 500 + "\n## Y\n"),
        ("none.md", None),
        ("empty.md", ""),
    ]
    df = spark.createDataFrame(docs, "path string, content string")
    got = {(r["path"], r["ordinal"]): r for r in sections.doc_sections(df.withColumn("ordinal", F.lit("clash"))).collect()}
    assert [got["test.md", i]["name"] for i in range(4)] == ["Title", "A", "B", "C"]
    assert got["test.md", 1]["start_line"] == 4 and got["test.md", 0]["parent_context"] == "test.md" and got["test.md", 0]["body_text"] == "intro"
    assert got["README.txt", 0]["name"] == "README" and got["README.txt", 0]["body_text"] == "two plain\nlines"
    assert len(got["long.md", 0]["body_text"]) == 800 and got["long.md", 1]["body_text"] is None
    assert got["empty.md", 0]["body_text"] is None and not any(k[0] == "none.md" for k in got)


def test_toml(spark):
    text = "[package]\nname='x'\n\n[dependencies.serde]\nv = [\n[1, 2],\n]\n[[bin]]\n"
    df = spark.createDataFrame([("Cargo.toml", text)], "path string, content string")
    assert [(r["name"], r["start_line"], r["end_line"]) for r in sections.toml_tables(df).orderBy("ordinal").collect()] == [("package", 1, 3), ("dependencies.serde", 4, 7), ("bin", 8, 8)]
    got = extract.parse_file("Cargo.toml", text)["symbols"]
    assert [(s["name"], s["kind"]) for s in got] == [("package", "table"), ("dependencies.serde", "table"), ("bin", "table")]


def test_fallbacks():
    scss = extract.parse_file("styles/app.scss", "@mixin big($x) {\n  a: b;\n}\n.button-primary {\n  color: red;\n}\n")["symbols"]
    assert ".button-primary" in [s["name"] for s in scss] and len(scss) >= 2
    assert [s["kind"] for s in extract.parse_file("a.kt", "fun foo() {\n}\n")["symbols"]] == ["file"]
    assert [(s["name"], s["end_line"]) for s in extract.parse_file("a.kt", "fun foo() {\n x()\n}\n", True)["symbols"]] == [("foo", 3)]
    org = extract.parse_file("a.org", "* One\ntext\n** Inner\n* Two\n")["symbols"]
    assert [(s["name"], s["kind"], s["end_line"]) for s in org] == [("One", "h1", 3), ("Two", "h1", 4)]
    fish = extract.parse_file("a.fish", "function hi\n echo\nend\n")["symbols"]
    assert [(s["name"], s["end_line"]) for s in fish] == [("hi", 3)]
    assert extract.parse_file("x.unknown", "a")["error"] and extract.parse_file("x.py", "def (")["error"]


def spans(path, text, whole_words=False):
    return [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in extract.parse_file(path, text, whole_words)["symbols"]]


def test_outlines():
    scss = ".a:hover .b {\n  x: y;\n  .inner { z: 1; }\n}\n.c\n{\n  x: y;\n}\n#id[x] { a: b; }\n@media print {\n.q { }\n}\np { }\n. { }\n%ph\n"
    assert spans("a.scss", scss) == [(".a", "css-rule", 1, 4), (".c", "css-rule", 5, 8), ("#id", "css-rule", 9, 9), ("@media", "css-rule", 10, 12), ("%ph", "css-rule", 15, 15)]
    assert spans("a.org", "  * One\ntext\n  ** Inner\n*\nnone\n* Two\n") == [("One", "h1", 1, 3), ("Two", "h1", 6, 6)]
    gleam = "pub opaque type Box {\n  Box\n}\nopaque type A\npub enum B\nenum C\npub fn f() -> Int {\n  1\n}\n"
    assert [s[0] for s in spans("a.gleam", gleam, True)] == ["Box", "A", "B", "C", "f"] and [s[1] for s in spans("a.gleam", gleam, True)] == ["pub", "opaque", "pub", "enum", "pub"]
    kt = "class A {\n  fun inner() {\n  }\n}\nprivate open class B\n{\n}\nval x =\n  1\n\n    .map { it }\nfun z() = 2\nfun open() {\n"
    assert spans("a.kt", kt, True) == [("A", "class", 1, 4), ("B", "private", 5, 7), ("x", "val", 8, 11), ("z", "fun", 12, 12), ("open", "fun", 13, 13)]
    assert spans("a.dot", "digraph {\n node [x]\n}\n") == [("", "digraph", 1, 3), ("[x]", "node", 2, 2)]
    assert [s["parent_context"] for s in extract.parse_file("a.dot", "digraph {\n node [x]\n}\n")["symbols"]] == [None, "digraph:"]
    assert spans("a.fish", "function a\n  function b\n  end\n  echo\nend\nfunction c\n") == [("a", "function", 1, 5), ("c", "function", 6, 6)]
    assert spans("b.kt", "") == [("b.kt", "file", 1, 1)]


def test_extents_equal_a_scan():
    """The one-pass extents against a plain scan from each line."""
    from cairn.operators.scanners import Lines

    rng = random.Random(11)
    for _ in range(200):
        text = [" " * rng.randint(0, 4) + rng.choice(("a {", "}", "b", "", "} else {", ".m()", "{ }", "x {{", "}}")) for _ in range(rng.randint(1, 25))]
        f = Lines(text)
        for i, s in enumerate(text):
            depth = s.count("{") - s.count("}")
            want = i
            if depth > 0:
                for want in range(i + 1, len(text)):
                    depth = max(0, depth + text[want].count("{") - text[want].count("}"))
                    if not depth:
                        break
                want = want if not depth else len(text) - 1
            assert f.brace[i] == want, (text, i)
            if s.strip():
                end = i
                for j in range(i + 1, len(text)):
                    if text[j].strip():
                        if f.width[j] <= f.width[i] and not text[j].strip().startswith("."):
                            break
                        end = j
                assert f.indent[i] == end, (text, i)


def test_long_heads_and_many_declarations():
    args = ",\n    ".join(f"java.util.Map<String, Integer> parameter{i}" for i in range(200))
    assert spans("A.java", f"class A {{\n  public void run(\n    {args}\n  ) {{\n    go();\n  }}\n}}\n") == [("A", "class_declaration", 1, 206), ("run", "method_declaration", 2, 205)]
    many = extract.parse_file("a.rs", "".join(f"mod m{i} {{\n    fn f{i}() {{\n        g{i}(1);\n    }}\n}}\n" for i in range(4000)))
    assert len(many["symbols"]) == 8000 and many["symbols"][-1]["parent_context"] == "module:m3999" and len(many["calls"]) == 4000
    annotated = extract.parse_file("A.java", "class A {\n  @Override\n  public int size() {\n    return n();\n  }\n}\n")
    assert [s["name"] for s in annotated["symbols"]] == ["A", "size"]


def test_documentation_above():
    above = lambda text: extract.comment_above(text.split("\n"), text.count("\n") + 1)
    assert above("/// one\n/// two\nfn f") == "one two" and above("//! inner\nx") == "inner" and above("// plain\nx") is None
    assert above("/** first\n * second\n */\nx") == "first second" and above("/** all */\nx") == "all */" and above("/**\n *\n * after\n */\nx") == "after"
    assert above("# one\n# two\nx") == "one two" and above("#!x\ny") is None and above("#' r\nf") == "r" and above("x = 1\n\ny") is None and above("only") is None


def test_import_names():
    name = lambda path, text: next(s["name"] for s in extract.parse_file(path, text)["symbols"] if s["kind"] == "import")
    assert name("a.rs", "use std::io::Read;\n") == "Read" and name("a.rs", "use std::{fs, io};\n") == "{fs, io}" and name("a.py", "from os.path import join\n") == "os.path"
    assert name("a.ts", "import { A } from 'a'\n") == "{" and name("a.go", 'package x\n\nimport "fmt"\n') == '"fmt"'


def test_calls_of_further_languages():
    zig = extract.parse_file("a.zig", "pub fn main() void {\n    helper(1); // not(this)\n    main();\n}\n")
    assert zig["calls"] == [{"from_name": "main", "to_name": "helper", "from_line": 2}]
    page = extract.parse_file("a.html", "<html>\n<script>\nfunction f() {\n  draw();\n}\n</script>\n</html>\n")
    assert page["calls"] == [{"from_name": "f", "to_name": "draw", "from_line": 4}]


def test_html():
    page = """<html>
<!-- the page -->
<style>
body { color: red; }
</style>
<body>
<canvas id="game"></canvas>
<div class="container main">x</div>
<script>
const COLS = 10;
// helper section
function generateMap(a) {
  return a;
}
</script>
</body>
</html>
"""
    s = extract.parse_file("index.html", page)["symbols"]
    by = {x["name"]: x for x in s}
    assert {"game", "div.container main", "the page", "COLS", "generateMap", "body", "helper section"} <= set(by)
    assert by["generateMap"]["start_line"] == 12 and by["generateMap"]["parent_context"] == "script" and by["body"]["kind"] == "rule_set"


def test_code():
    rust = extract.parse_file("a.rs", "use std::fs;\n\n/// Parses.\n/// Twice.\npub fn parse(x: u32) -> u32 {\n    helper(x) // }\n}\n\nimpl Foo {\n    fn inner(&self) {\n        parse(1);\n    }\n}\n")
    names = [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in rust["symbols"]]
    assert ("parse", "function_item", 5, 7) in names and ("inner", "function_item", 10, 12) in names
    by = {s["name"]: s for s in rust["symbols"]}
    assert by["inner"]["parent_context"] == "impl:Foo" and by["parse"]["doc_comment"] == "Parses. Twice."
    assert {(c["from_name"], c["to_name"]) for c in rust["calls"]} >= {("parse", "helper"), ("inner", "parse")}
    js = extract.parse_file("a.js", "export const run = (a) => {\n  return go(a);\n};\n")["symbols"]
    assert [s["kind"] for s in js] == ["lexical_declaration", "function_declaration"]


def slices_by_hand(lines, limit=800, overlap=2):
    out, i = [], 0
    while i < len(lines):
        n, j = 0, i
        while j < len(lines) and (j == i or n + len(lines[j]) + 1 <= limit):
            n += len(lines[j]) + 1
            j += 1
        out.append((i, j - 1))
        if j >= len(lines):
            break
        i = max(j - overlap, i + 1)
    return out


def test_slices_equal_the_loop(spark):
    rng = random.Random(3)
    cases = [["x" * rng.choice((0, 5, 60, 300, 790, 900)) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>").select("i", chunk.slices(F.col("l")).alias("s"))
    for r in df.collect():
        assert [(x["first"], x["last"]) for x in r["s"]] == slices_by_hand(cases[r["i"]])


def test_chunks(spark):
    body = "\n".join(f"line {i} of the body with some padding text" for i in range(100))
    rows = [
        (1, "doWork", "function_item", "src/ui/Panel.tsx", "class:A", "Does work.", body, 50, 149),
        (2, "Usage", "doc_section", "doc.md", None, None, "one\ntwo\nthree", 4, 7),
        (3, "empty", "const_item", "a.rs", None, None, None, 3, 3),
        (4, "copy", "function_item", "a.ts", None, None, "t('menu.open') + t(\"menu.open\") + 'nope'", 1, 1),
    ]
    df = spark.createDataFrame(rows, "symbol_id long, name string, kind string, path string, parent_context string, doc_comment string, body_text string, start_line long, end_line long")
    got = {}
    for r in chunk.chunk_symbols(df, {"menu.open": "Open the file"}).orderBy("symbol_id", "chunk_index").collect():
        got.setdefault(r["symbol_id"], []).append(r)
    first = got[1]
    assert first[0]["start_line"] == 50 and first[-1]["end_line"] == 149 and len(first) > 3
    assert all(b["start_line"] == a["end_line"] - 1 for a, b in zip(first, first[1:]))
    assert first[0]["embed_text"].startswith("function_item: doWork (do work) | file: Panel | context: class:A | Does work. | line 0")
    assert first[0]["fts_name"] == "doWork do work" and first[0]["fts_path"] == "Panel.tsx Panel panel ui src"
    assert (got[2][0]["start_line"], got[2][0]["end_line"]) == (5, 7)
    assert got[3][0]["embed_text"] == "const_item: empty | file: a" and got[3][0]["fts_body"] == ""
    assert got[4][0]["embed_text"].endswith(" | i18n: Open the file") and "Open the file" in got[4][0]["fts_body"]


def test_gate_and_locales(spark):
    df = spark.createDataFrame([("import", "x", "y" * 200), ("function_item", "key", "y" * 100), ("function_item", "key", "y" * 130), ("function_item", "foo", "y" * 39), ("function_item", "foo", "é" * 20)], "kind string, name string, t string")
    assert [r[0] for r in df.select(chunk.worth_embedding(F.col("kind"), F.col("name"), F.col("t"))).collect()] == [False, False, True, False, True]
    assert chunk.flatten_json({"a": {"b": "x", "c": ["no"], "d": {"e": "y"}}, "f": " ", "g": 1}) == {"a.b": "x", "a.d.e": "y"}
    paths = {"/x/locales/en.json": True, "app/i18n/de.ts": True, "a.arb": True, "x.strings": True, "res/values-de/strings.xml": True, "/l10n/a.js": True, "src/en.json": False, "locales.json": False, "res/strings.xml": False}
    files = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["x"] for r in files.select("p", chunk.is_locale_file(F.concat(F.lit("/"), F.col("p"))).alias("x")).collect()} == paths
    d = spark.createDataFrame([("w/locales/de.json", '{"a": "Hallo", "b": "nur"}'), ("w/locales/en.json", '{"a": "Hello"}'), ("w/locales/bad.json", "{"), ("w/locales/x.ts", None)], "path string, content string")
    assert {r["key"]: r["value"] for r in chunk.locale_dictionary(d).collect()} == {"a": "Hello", "b": "nur"}


SCANNED = {
    "a.rb": ("class Foo\n  def bar\n    if x\n    end\n  end\nend\n", [("Foo", "class", 1, 6), ("bar", "method", 2, 5)]),
    "a.lua": ("local function f(a)\n  if a then\n  end\nend\n", [("f", "function_declaration", 1, 4)]),
    "a.ex": ("defmodule A.B do\n  def go(x) do\n    x\n  end\nend\n", [("A.B", "module", 1, 5), ("go", "function", 2, 4)]),
    "a.sh": ("run() {\n  echo '}'\n}\n", [("run", "function_definition", 1, 3)]),
    "a.hs": ("data T = A\n  | B\n\nf :: Int\nf = 1\n", [("T", "data_type", 1, 2), ("f", "function", 4, 4)]),
    "a.clj": ("(ns a.b)\n(defn f [x]\n  (+ x 1))\n", [("a.b", "module", 1, 1), ("f", "function_definition", 2, 3)]),
    "a.erl": ("-module(a).\nf(0) -> 1;\nf(X) ->\n  X.\n", [("a", "module", 1, 1), ("f", "function", 2, 4)]),
    "a.proto": ("message M {\n  int32 a = 1;\n  enum E { X = 0; }\n}\n", [("M", "struct_declaration", 1, 4), ("E", "enum_declaration", 3, 3)]),
    "a.tf": ('resource "aws" "web" {\n  a = 1\n}\n', [("web", "declaration", 1, 3)]),
    "a.css": ("body {\n  color: red;\n}\n@media (x) {\n  .a { b: c }\n}\n", [("body", "rule_set", 1, 3), ("@media (x)", "media_statement", 4, 6), (".a", "rule_set", 5, 5)]),
    "a.yaml": ("a:\n  b: 1\nc: 2\n", [("a", "declaration", 1, 2), ("c", "declaration", 3, 3)]),
    "a.ini": ("[one]\nx=1\n[two]\n", [("one", "section", 1, 2), ("two", "section", 3, 4)]),
    "Makefile": ("all: x\n\tcc\n\nx:\n", [("all", "declaration", 1, 2), ("x", "declaration", 4, 4)]),
    "a.sol": ("contract C {\n  function f() public { }\n}\n", [("C", "class_declaration", 1, 3), ("f", "function_definition", 2, 2)]),
    "a.v": ("module m(a);\nendmodule\n", [("m", "module", 1, 2)]),
    "a.ml": ("let rec f x =\n  x\nmodule M = struct\nend\n", [("f", "value_definition", 1, 2), ("M", "module_definition", 3, 3)]),
    "a.jl": ("struct P\n  x\nend\nfunction f(x)\n  for i in x\n  end\nend\n", [("P", "struct_definition", 1, 3), ("f", "function_definition", 4, 7)]),
    "a.r": ("f <- function(x) {\n  x\n}\n", [("f", "function_definition", 1, 3)]),
    "a.zig": ("pub fn f(x: u8) u8 {\n  return x;\n}\n", [("f", "function_declaration", 1, 3)]),
}


def test_scanned_languages():
    for path, (text, want) in SCANNED.items():
        got = extract.parse_file(path, text)
        assert [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in got["symbols"]] == want, path
        assert extract.parse_file(path, "")["error"] is None
    assert extract.parse_file("a.rb", SCANNED["a.rb"][0])["symbols"][1]["parent_context"] == "class:Foo"
