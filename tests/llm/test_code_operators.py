"""Syntax, provenance, ranking, similar vectors and mixing."""

import ast
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import mixture, nearest, neighbours, provenance, rank, syntax
from cairn.llm.grammars import grammar_of
from cairn.llm.least import Union, _unpaired
from cairn.llm.repair import code_tokens, re_pair, shared_rules

VALID = {
    "a.py": "import os\nfrom . import x as y\n\n@dec(1)\nasync def f(a, *b, c: int = 1, **d) -> 'T':\n    '''doc'''\n    async with g(a) as h, i:\n        return [x for x in h if x > 1 if y] or {k: v for k, v in b}\n    for i, (j, *k) in z: pass\n    else:\n        x: int = 5; y += 1\n    try:\n        raise E from None\n    except (A, B) as e:\n        pass\n    finally:\n        del a[0], b.c\n    lambda q, *r: q if r else (yield)\n    return f'{a}' 'b' if not a else -b ** 2\nclass C(B, metaclass=M): x = 1\nmatch a:\n    case {'k': [1, *_]} | P(x=1) if a: pass\n",
    "a.c": '#include <x.h>\n#define A(x) \\\n  ((x) + 1)\ntypedef struct node { int a : 3; struct node *next; } node_t;\nenum e { A1, B1 = 2, };\nstatic const char *names[] = { "a" "b", [3] = "c", NULL };\nint (*fp)(int, char *) = 0;\nint main(int argc, char **argv) {\n  for (int i = 0, j; i < 9; i++) if (i & 1) continue; else x[i] = (node_t){ .a = 1 };\n  do { p->q.r++; } while (*s++ = *t++);\n  switch (c) { case \'{\': { break; } default: goto end; }\nend:\n  return sizeof(int) * a ? b : (char)c;\n}\n',
    "A.java": 'package a.b;\nimport static java.util.*;\n/** x */\n@A(b = {1, 2}) public abstract class X<T extends Comparable<? super T>> extends Y<T> implements Z, W {\n  private final Map<String, List<int[]>> m = new HashMap<>() {{ put("a", null); }};\n  static { int x = 1; }\n  public X(int... a) throws E { super(a); this.b = a.length > 1 ? x -> { return x; } : Foo::new; }\n  <U> U g(final U u) { for (String s : list) { if (s instanceof String t && t.isEmpty()) continue; } try (R r = new R()) { throw new E(); } catch (A | B e) { } finally { } return (U) (Object) u; }\n  abstract void h();\n  enum K { A { void f() {} }, B(1); int v; K(int... x) {} }\n  record P(int a, String b) { P { } }\n  int sw(int k) { return switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; }\n  String t = """\n    "x" }\n    """;\n}\n',
    "a.go": 'package main\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:"a"`\n\t*Base\n}\n\ntype I interface {\n\tF(x int, y ...string) (int, error)\n\tfmt.Stringer\n}\n\nvar x, y = map[string][]int{"a": {1, 2}}, func(a int) int { return a }\n\nfunc (t *T[K]) M(ctx context.Context, f func(int) error) (r chan<- int, err error) {\n\tif v, ok := t.m[1].(string); ok && v != "" {\n\t\treturn nil, fmt.Errorf("x %d", 1)\n\t} else if x := (T{}); x.a > 1 {\n\t}\nouter:\n\tfor i := 0; i < 10; i++ {\n\t\tfor k := range m {\n\t\t\tcontinue outer\n\t\t}\n\t}\n\tswitch v := x.(type) {\n\tcase int, string:\n\t\tgo f(1)\n\tdefault:\n\t\tdefer func() { <-c }()\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t\t_ = v\n\t}\n\ts := []*T{{a: 1}, &T{\n\t\tb: 2,\n\t}}\n\treturn\n}\n',
    "a.rs": "#![allow(x)]\nuse std::{fs, io::{self, Read as R}};\n\n#[derive(Debug, Clone)]\npub struct S<'a, T: Clone + 'a> where T: Sized { pub a: &'a [T], b: Option<Box<dyn Fn(u8) -> u8 + Send>> }\nstruct U(pub u8, i32);\nenum E { A, B(u8), C { x: u8 } }\nimpl<'a, T> Iterator for S<'a, T> { type Item = T; fn next(&mut self) -> Option<Self::Item> { None } }\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nconst X: [u8; 4] = [0; 4];\nasync unsafe fn f<F>(mut x: u8, (a, b): (u8, u8), g: impl Fn(&str) -> bool) -> Result<(), Box<dyn Error>> where F: Fn() {\n    let v: Vec<Vec<u8>> = x.iter().map(|&y| y as u32).collect::<Vec<_>>();\n    let Some(z) = opt else { return Err(\"x\".into()); };\n    match v { Some(n @ 1..=5) if n > 2 => {} , E::C { x, .. } => x?, b'{' | b'}' => 'a', _ => unreachable!() }\n    'l: loop { if let Some(q) = it.next() { break 'l; } else if x < y && z >> 1 > 2 { continue } }\n    for (i, c) in s.chars().enumerate().rev() { println!(\"{}\", c); }\n    let c = move || -> u8 { 1 }; let r = r#\"raw \" } \"#; let k = S { a: &x[1..], ..Default::default() };\n    unsafe { *p = !q; }\n    if a == b { c } else { d }.e()\n}\n",
    "a.ts": 'import type { A } from "a";\nimport b, { c as d } from "b";\nimport * as e from "e";\nexport abstract class X<T extends A = B> extends Y<T> implements Z {\n  private readonly a?: Map<string, number[]> = new Map();\n  static #p = 1\n  constructor(public x: number, private y = 2) { super(); }\n  @dec() get z(): string | undefined { return this.#p as unknown as string }\n  async *gen<K extends keyof T>(k: K, ...r: T[K][]): AsyncGenerator<T> { yield* k; }\n  [key: string]: any;\n}\ninterface I extends J { (x: number): string; readonly a?: string; b(): void, [k: string]: unknown }\ntype U<T> = T extends (infer R)[] ? R : { [K in keyof T]?: T[K] } | "lit" | -1;\nenum E { A = 1, B = "b" }\ndeclare module "m" { export const q: number; }\nexport default function f<T,>({ a, b: { c = 1 }, ...rest }: P = {}, [x, , y]: number[]): asserts x is string {\n  const re = /[{(]x\\/[/]/gi, t = `a ${b ? `n ${c}` : "}"} d`\n  for (const [k, v] of Object.entries(o)) if (k) continue; else break\n  label: for (let i = 0, n = 1; i < n; i++) { if (a < b && c > d) break label }\n  const g = async (x) => ({ ...x, [y]: z, m() { return 1 }, get q() { return 2 } }), h = x => y => { return x }\n  try { await g?.(x)?.[0]!.y } catch { throw new Error("x") } finally { }\n  switch (x) { case 1: case 2: { y(); break } default: z() }\n  do { i-- } while (i > 0)\n  return a ?? b ? c : d\n}\nexport { X as default, E }; export * from "z"\n',
    "a.json": '{"a": [1, -2.5e+3, true, null, {"b": "\\u00e9 \\n"}], "c": {}}',
}


@pytest.mark.parametrize("path", sorted(VALID))
def test_valid(path):
    language, checked, invalid, cost, line, cause = syntax.examine(path, VALID[path])
    assert checked and not invalid, (language, line, cause, cost)
    assert not syntax.examine(path, VALID[path].replace("\n", "\r\n"))[2]


@pytest.mark.parametrize("path", sorted(VALID))
def test_damage(path):
    """Cut, merged, mismatched and unbalanced texts are flagged, and the cause is told."""
    text = VALID[path]
    cut = text[: len(text) * 2 // 3]
    assert syntax.examine(path, cut[: cut.rindex("{" if path != "a.py" else "(") + 1])[2]
    half = text.index("\n", len(text) // 2) + 1 if "\n" in text else 0
    if half:
        got = syntax.examine(path, text[:half] + "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n" + text[half:])
        assert got[2] and got[5] == "conflict"
    assert syntax.examine(path, "<!DOCTYPE html>\n<html><body><p>It's a page</p></body></html>\n")[2]
    for bracket in ")]}":
        at = text.rfind(bracket)
        if at > 0:
            assert syntax.examine(path, text[:at] + text[at + 1 :])[2], bracket


def test_python_agrees_with_the_interpreter():
    rng, text = random.Random(1), VALID["a.py"]
    lines, wrong = text.split("\n"), 0
    for _ in range(150):
        k = rng.randrange(len(lines))
        tokens = lines[k].split(" ")
        rng.random() < 0.5 and tokens.pop(rng.randrange(len(tokens)))
        broken = "\n".join([*lines[:k], " ".join(tokens) if rng.random() < 0.7 else lines[k][: rng.randrange(len(lines[k]) + 1)], *lines[k + 1 :]])
        try:
            ast.parse(broken)
            bad = False
        except SyntaxError:
            bad = True
        wrong += syntax.examine("a.py", broken)[2] != bad
    assert wrong <= 8  # names, scopes and assignment targets aside


def test_json_agrees_with_the_parser():
    rng, text = random.Random(2), VALID["a.json"]
    for _ in range(300):
        k = rng.randrange(len(text))
        broken = text[:k] + rng.choice(("", ",", "1", "]", '"', " ")) + text[k + 1 :]
        try:
            json.loads(broken)
            bad = False
        except ValueError:
            bad = True
        assert syntax.examine("a.json", broken)[2] == bad, broken


def test_costs_that_are_least_ones():
    capped = lambda p, t: syntax.judge(p, t)[3::3]
    assert capped("a.py", "x = (1,\n")[1] is True and capped("a.json", '{"a": 1,}') == (1, False) and capped("a.json", "{}") == (0, False)
    cost, least = capped("a.py", "".join(f"x{i} = 1 2 3 4\n" for i in range(60)))
    assert cost >= 8 and least


def least_edits(a, text):
    """Least edits by plain search over (position, state of the automaton that is not determinised)."""
    level, seen, cost = {(0, s) for s in a._closure((a.start,))}, set(), 0
    while True:
        todo, following = list(level), set()
        while todo:
            i, s = todo.pop()
            if (i, s) in seen:
                continue
            if i == len(text) and s == a.final:
                return cost
            seen.add((i, s))
            for label, t in a.arcs[s]:
                behind = a._closure((t,))
                todo += [(i + 1, u) for u in behind if i < len(text) and a.grammar.matches(label, text[i])]
                following |= {(k, u) for u in behind for k in (i, min(i + 1, len(text)))}
            following |= {(i + 1, s)} if i < len(text) else set()
        level, cost = following - seen, cost + 1


@pytest.mark.parametrize("language, bracket", [("json", "["), ("json", "{"), ("c", "{"), ("go", "("), ("python", "<l|")])
def test_least_repair_against_plain_search(language, bracket):
    grammar = grammar_of(language)[1]
    union = Union(grammar, grammar.contents[bracket])
    chars = [x if isinstance(x, str) else grammar.group(x[0], x[1] or 1) for x in union.on]
    rng = random.Random(4)
    for n in range(15):
        text = "".join(rng.choice(chars) for _ in range(n % 8))
        cost, edits = union.least(text)
        assert cost == len(edits) == min(least_edits(grammar.automaton(x), text) for x in grammar.contents[bracket])
        assert edits == sorted(edits) and union.least(text, (cost + 1, []))[0] == cost


def test_fewest_brackets():
    pairs, rng = {")": "(", "]": "[", "}": "{"}, random.Random(6)

    def fewest(s):
        if not s:
            return 0
        return min([1 + fewest(s[1:]), *(fewest(s[1:k]) + fewest(s[k + 1 :]) for k in range(1, len(s)) if pairs.get(s[k]) == s[0])])

    for _ in range(300):
        s = "".join(rng.choice("([)]" if rng.random() < 0.7 else "{}") for _ in range(rng.randrange(10)))
        assert sum(map(len, _unpaired([(c, 1) for c in s]))) == fewest(s), s


def test_costs_beyond_the_bounds(spark):
    """Costs above 8 in a group and 24 in a text, edits that are far apart or many in a place, contents of open groups."""
    rows = [("a.json", "[" + " ".join(map(str, range(30))) + "]", 15), ("b.py", "".join(f"x{i} = 1 2 3 4\n" for i in range(60)), 120), ("c.json", '{"a": [1 2 3, {"b"', 5), ("d.json", "[1, 2" + " ]" * 40, 39), ("e.json", "[" + ", ".join(["1", "2 3"] * 20) + "]", 20), ("f.json", '{"a": 1,}', 1), ("g.json", "[1]", 0), ("h.rs", "fn f() {" * 3000, 3000)]
    df = spark.createDataFrame([(p, c) for p, c, _ in rows], "path string, content string")
    got = {r["path"]: (r["invalid"], r["cost"], r["capped"]) for r in syntax.flag_files(df.withColumn("file_id", F.col("path"))).collect()}
    assert got == {p: (cost > 0, cost, False) for p, _, cost in rows}


def test_flags(spark):
    rows = [(1, "r/a.py", "x = 1\n"), (1, "r/a.py", "x = 1\n"), (2, "r/b.py", "def f(:\n"), (3, "s/a.json", ""), (4, "s/a.py", ""), (5, "s/a.py", None), (6, "s/a.md", "# <<<"), (7, None, "x"), (8, "s/x.rs", "fn f() {" * 3000), (9, "s/a.zig", "}")]
    df = spark.createDataFrame(rows, "file_id long, path string, content string").withColumn("language", F.lit("wrong")).withColumn("k", F.lit(0))
    flags = syntax.flag_files(df)
    got = {r["file_id"]: r for r in flags.collect()}
    assert len(got) == 9 and {k for k, r in got.items() if r["invalid"]} == {2, 3, 8} and not got[9]["checked"]
    r = {(x["grouping"], x["name"]): (x["files"], x["invalid"], x["rate"]) for x in syntax.rates(flags).collect()}
    assert r["repo", "r"] == (2, 1, 0.5) and r["language", "json"] == (1, 1, 1.0) and r["language", "python"] == (3, 1, 0.333333)
    assert syntax.flag_files(df.limit(0)).count() == 0


# ---------------------------------------------------------------- provenance


def test_re_pair():
    tokens = "f ( 0 ) { return 0 } ".split() * 50
    left, rules, uses = re_pair(tokens)
    assert left + 2 * rules < 40 and max(uses) > 5
    rng = random.Random(1)
    noise = [str(rng.randrange(10**6)) for _ in range(300)]
    assert re_pair(noise)[0] == 300 and re_pair([]) == (0, 0, []) and re_pair(["a"])[0] == 1


def test_shared_rules_do_not_depend_on_the_surroundings():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(200)}"
    copy = [word() for _ in range(400)]
    a, b = [word() for _ in range(150)] + copy, copy + [word() for _ in range(90)]
    common = {h for h, _ in shared_rules(a)} & {h for h, _ in shared_rules(b)}
    size = dict(shared_rules(a))
    assert sum(size[h] for h in common) > 250
    assert not {h for h, _ in shared_rules([word() for _ in range(400)])} & {h for h, _ in shared_rules(copy)}


def hand(seed, n=30):
    rng = random.Random(seed)
    w = lambda: rng.choice("read write open close merge split index cache token chunk frame graph node edge".split()) + str(rng.randrange(99)) * 0 + rng.choice("_a _b _c _d _e".split())
    return "".join(f"def {w()}_{w()}({w()}, {w()}):\n    if {w()} is {w()}:\n        return {w()}({w()} + {rng.randrange(9)})\n    {w()} = [{w()} for {w()} in {w()}]\n    return {w()}.{w()}({w()})\n\n" for _ in range(n))


def test_kinds(spark):
    generated = "".join(f"def span_{i}(m):\n    m.digest_{i} = {i * 7 % 100}\n    return m\n\n" for i in range(40))
    rng = random.Random(4)
    numbers = "V = [\n" + ",\n".join(", ".join(str(rng.randrange(256)) for _ in range(16)) for _ in range(60)) + "]\n"
    blob = 'X = "' + "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(900)) + '"\n'
    squeezed = ";".join(f"var {chr(97 + i % 26)}{i}=function({chr(97 + i % 24)}){{return {chr(97 + i % 24)}.x?{i}:a{i * 3 % 7}({i})}}" for i in range(60)) + ";"
    prose = 'HELP = "' + "; ".join(f"cannot {a} the {b}" for a in ("read", "merge", "build", "drop") for b in ("cache", "node", "frame", "token", "edge")) + '"\n' + hand(7)
    rows = [
        (1, "one/src/a.py", hand(1)), (2, "one/src/gen_x.py", generated), (3, "one/src/t.py", numbers), (4, "one/src/b.py", blob), (5, "one/src/m.js", squeezed), (6, "one/src/lib.py", hand(5)), (7, "two/util/other.py", "# (c) lib authors\n" + hand(5)),
        (8, "two/vendor/x/y.py", hand(9)), (9, "two/dist/app.bundle.js", None), (10, "two/src/c.py", None), (11, "two/src/e.py", ""), (12, "two/src/p.py", prose), (13, "two/src/log.py", "".join(f"2025-03-{i % 28 + 1:02d} 10:00:00 WARN x\n" for i in range(30))),
        (14, "two/lib/minify/q.py", "# the report is generated nightly\nBANNER = 'Code generated by x. DO NOT EDIT.'\n" + hand(11)), (2, "one/src/gen_x.py", generated), (15, None, "x"), (16, "two/notes.md", "long " * 400), (17, "two/conf.json", '{"a": 1}'),
    ]
    df = spark.createDataFrame(rows, "file_id long, path string, content string").withColumn("kind", F.lit("clash")).withColumn("k", F.lit(0))
    sizes = spark.createDataFrame([(10, 5_000_000)], "file_id long, size long")
    got = {r["file_id"]: r["kind"] for r in provenance.find_foreign(df, sizes).collect()}
    assert got == {2: "generated", 3: "data", 4: "data", 5: "minified", 6: "vendored", 7: "vendored", 8: "vendored", 9: "minified", 10: "minified", 13: "data"}
    by = {r["file_id"]: r["evidence"] for r in provenance.find_foreign(df, sizes).collect()}
    assert by == {2: "rule reuse", 3: "literals", 4: "literals", 5: "white space", 6: "shared rules", 7: "shared rules", 8: "folder", 9: "path", 10: "size", 13: "literals"}
    assert provenance.find_foreign(df.limit(0)).count() == 0


def test_header_counts_wherever_it_stands():
    short = "package x\n" * 0 + "".join(f"import {w}\n" for w in ("one", "two", "six")) + "\n" * 20 + "# Code generated by x. DO NOT EDIT.\nV = 1\n"
    assert provenance.examine("one/src/a.py", short) == ("generated", "header")


def noise(n, seed=6):
    rng = random.Random(seed)
    return "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(n))


def test_wrapped_literals_are_data():
    kind = lambda path, text: provenance.examine(path, text)[0]
    lines = [noise(76, i) for i in range(12)] + [noise(40)]
    wrapped = "\n".join(lines)
    for text in (f'X = b"""\n{wrapped}\n"""\n', f"X = '''{wrapped}'''\r\n", "X = (\n" + "".join(f'    b"{s}"\n' for s in lines) + ")\n", "X = [\n" + "".join(f'    "{s}",\n' for s in lines) + "]\n"):
        assert kind("one/src/b.py", text) == "data", text
    assert kind("one/src/b.ts", f"export const x = `{wrapped}`;\n") == "data" and kind("one/src/b.rs", f'const X: &str = "{wrapped}";\n') == "data"
    assert kind("one/src/b.py", f'X = """\n{wrapped}\n"""\n' + hand(12)) is None
    sql = 'Q = """\n' + "\n".join(f"select {a}, count(*) from {b} where {a} is not null" for a in ("one", "two", "six") for b in ("read", "node", "edge")) + '\n"""\n'
    names = "NAMES = [" + ", ".join(f'"{a}_{b}"' for a in ("read", "merge", "build", "drop", "seal") for b in ("cache", "node", "frame", "token", "edge")) + "]\n"
    assert kind("one/src/q.py", sql) is None and kind("one/src/n.py", names) != "data"


def test_long_literals_are_examined_whole():
    kind = lambda s: provenance.examine("one/src/b.py", f'X = "{s}"\n')[0]
    assert kind("A" * 5000 + noise(60_000)) == "data" and kind(noise(5000) + "AB" * 30_000) is None and kind(noise(9000)) == "data" and kind("A" * 9000) is None
    assert provenance.dense("A" * 8000 + noise(12_000)) == 12_000


def test_docstrings_are_no_tokens():
    for text in ('"""told"""\nx = 1', '# c\n\n"""told"""\nx = 1', 'def f(\n    a,\n) -> int:\n    """told"""\n    return 1', 'class A:  # note\n    r"""told"""', '@doc """\ntold\n"""\nx'):
        assert "told" not in "".join(code_tokens(text, "python"))
    for text in ('x = """told"""', 'x = {\n  "k":\n  """told"""}', 'x = f(\n"""told""")'):
        assert '"""told"""' in code_tokens(text, "python")


# ---------------------------------------------------------------- ranking


def test_leximin(spark):
    rng = random.Random(3)
    rows = [(q, q * 100 + i, rng.choice((None, float("nan"), rng.random(), 0.5)), rng.choice((None, -rng.random() * 1e6)), rng.choice((0.1, None, 0.3))) for q in (1, 2, 3) for i in range(40 if q == 1 else 7)]
    rows += [rows[0], (None, 999, 0.5, None, None), (4, 1000, None, None, None), (4, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "q long, id long, a double, b double, c double").withColumn("vector", F.lit("clash")).withColumn("position", F.lit(0))
    got = {r["id"]: r for r in rank.leximin(df, "q", "id", {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, weights={"b": F.lit(2.0), "c": F.when(F.col("q") == 2, 0.0).otherwise(1.0)}).collect()}

    ok = lambda v: v is not None and v == v
    want = {}
    items = {r[1]: r for r in rows if r[1] is not None}
    for q in {r[0] for r in items.values()}:
        group = [r for r in items.values() if r[0] == q]
        vectors = {}
        for r in group:
            v = []
            for k, w in ((2, 1.0), (3, 2.0), (4, 0.0 if q == 2 else 1.0)):
                if ok(r[k]) and w > 0:
                    values = [x[k] for x in group if ok(x[k])]
                    n = len(values)
                    v.append((((sum(x < r[k] for x in values) + (sum(x == r[k] for x in values) - 1) / 2) / (n - 1)) if n > 1 else 0.5) ** w)
            vectors[r[1]] = sorted(v) + [1.0] * (3 - len(v)) if v else [-1.0] * 3
        for n, i in enumerate(sorted(vectors, key=lambda i: ([-x for x in vectors[i]], i)), 1):
            want[i] = n
    assert {i: r["position"] for i, r in got.items()} == want
    assert rank.leximin(df.limit(0), "q", "id", {"a": F.col("a")}).count() == 0


def test_one_group_with_ties_is_ranked_by_many_tasks(spark):
    """One query has all rows, most of them alike or without a score; positions are total and nothing is lost."""
    df = spark.range(20_000).selectExpr("'q' as q", "id", "case when id % 3 = 0 then 0.5 when id % 3 = 1 then cast(id as double) end as a", "cast(null as double) as b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 20,000 rows are little
    try:
        got = rank.leximin(df, "q", "id", {"a": F.col("a"), "b": F.col("b")})
        parts = [n for n in got.rdd.glom().map(len).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(parts) < 15_000
    rows = sorted(((r["position"], r["id"]) for r in got.collect()))
    scored = sorted((i for i in range(20_000) if i % 3 == 1), reverse=True)
    want = scored + [i for i in range(20_000) if i % 3 == 0] + [i for i in range(20_000) if i % 3 == 2]
    assert [i for _, i in rows] == want and [p for p, _ in rows] == list(range(1, 20_001))

# ---------------------------------------------------------------- similar vectors


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 64))
    near = base[:120] + rng.normal(size=(120, 64)) * 0.25 * np.linalg.norm(base[:120], axis=1, keepdims=True) / 8
    vectors = np.concatenate([base, near, base[:10] * 3, np.repeat(base[399:], 5, axis=0)])
    ids = np.arange(len(vectors))
    rows = [(int(i), 0, v.tolist()) for i, v in zip(ids, vectors)] + [(0, 0, base[0].tolist()), (0, 1, base[7].tolist()), (9001, 0, None), (9002, 0, [0.0] * 64), (9003, 0, [float("nan")] * 64), (9004, 0, [1.0] * 32), (None, 0, base[0].tolist())]
    df = spark.createDataFrame(rows, "symbol_id long, chunk_index long, embedding array<float>").withColumn("a", F.lit(1)).withColumn("fp", F.lit("clash"))
    got = {(r["symbol_id_a"], r["symbol_id_b"]) for r in neighbours.similar_pairs(df).collect()}
    f = np.concatenate([vectors, base[7:8]]).astype(np.float32).astype(np.float64)
    want = neighbours.brute_force(np.append(ids, 0), f, 0.9)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def test_hot_copies_collapse(spark):
    """A third of all rows are one vector: one fingerprint, no row per pair in the index."""
    v = np.random.default_rng(1).normal(size=(200, 64))
    rows = [(i, v[i % 200 if i % 3 else 0].tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "symbol_id long, embedding array<float>")
    pairs, members = neighbours.links(df)
    assert pairs.count() == 0 and members.groupBy("fp").count().agg(F.max("count")).first()[0] >= 500


def test_nearest(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    v[2000:2400] = v[:400] + 0.3 * v[2000:2400]
    rows = [(i, 0, v[i].tolist()) for i in range(3000)] + [(0, 0, v[0].tolist()), (20, 1, v[5].tolist()), (9000, 0, None), (9020, 0, [0.0] * 64), (None, 0, v[1].tolist())]
    df = spark.createDataFrame(rows, "symbol_id long, chunk_index long, embedding array<float>").withColumn("g", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {}
    for r in nearest.nearest(df, df.where("symbol_id % 20 = 0")).collect():
        got.setdefault((r["symbol_id"], r["chunk_index"]), []).append((r["rank"], r["neighbour_symbol_id"], r["neighbour_chunk_index"]))
    keys = [(i, 0) for i in range(3000)] + [(20, 1)]
    u = np.concatenate([v, v[5:6]]).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for j, (g, c) in enumerate(keys):
        if g % 20 == 0:
            s = np.where([x[0] == g for x in keys], -3, u @ u[j])
            want = {keys[x] for x in np.argsort(-s)[:10]}
            mine = got[g, c]
            assert sorted(m[0] for m in mine) == list(range(1, 11)) and all(m[1] != g for m in mine)
            hit += len(want & {(a, b) for _, a, b in mine})
    assert len(got) == 151 and hit >= 0.9 * 1510
    assert nearest.nearest(df.limit(0), df).count() == 0
    few = nearest.nearest(df.where("symbol_id in (1, 2, 3)"), df.where("symbol_id = 2"), k=10).collect()
    assert {r["neighbour_symbol_id"] for r in few} == {1, 3}


def test_nearest_in_small_tiles(spark, monkeypatch):
    """Few cells, and cells cut into many tiles, give the same neighbours as one search; several tables are merged."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1200, 64))
    v[:400] = v[0] + 0.4 * v[:400]  # a third of all rows in one place
    df = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "symbol_id long, chunk_index long, embedding array<float>")
    rows = lambda **more: {(r["symbol_id"], r["rank"]): r["neighbour_symbol_id"] for r in nearest.nearest(df, df, k=3, **more).collect()}
    exact = rows(index=nearest.exhaustive())
    u = v.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(len(u))
    assert exact == {(i, r + 1): int(j) for i in range(1200) for r, j in enumerate(np.argsort(-s[i], kind="stable")[:3])}
    for name, value in (("QUERY_BLOCK", 50), ("ROW_BLOCK", 64), ("MAX_CELLS", 30)):
        monkeypatch.setattr(nearest, name, value)
    assert rows(index=nearest.exhaustive()) == exact
    found = rows(index=nearest.Coarse(64, 5, 2.0, 0.6, tables=3))
    assert sum(found.get(x) == y for x, y in exact.items()) > 0.9 * len(exact)


def test_recall(spark):
    shape = "symbol_id long, chunk_index long, cosine double"
    exact = spark.createDataFrame([(1, 0, 0.9), (1, 0, 0.8), (2, 0, 0.7), (2, 0, 0.6)], shape)
    found = spark.createDataFrame([(1, 0, 0.9), (1, 0, 0.8), (1, 0, 0.8), (2, 0, 0.7)], shape)
    assert tuple(nearest.recall(found, exact).first()) == (2, 0.75, 0.5)


def test_hot_bucket_is_compared_in_tiles(spark):
    """A third of all rows are distinct vectors in one place: no group holds them all, and no pair is lost."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    v = np.concatenate([centre + 0.25 * rng.normal(size=(300, 64)), rng.normal(size=(600, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "symbol_id long, embedding array<float>")
    index = neighbours.Index(tables=3, functions=4, width=6.0, probes=2, hamming=30)
    pairs = lambda hot: {(r["a"], r["b"]): r["cosine"] for r in neighbours.links(df, index=index, hot=hot)[0].collect()}
    whole = pairs(1 << 20)
    assert len(whole) > 30_000 and pairs(64) == whole


def test_colliding_fingerprints_stay_apart(spark):
    """Vectors are told apart by both hashes."""
    v = np.random.default_rng(4).normal(size=(4, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate([v[0], v[0], v[1], v[2]])], "symbol_id long, embedding array<float>")
    classes = {}
    for r in neighbours.links(df)[1].collect():
        classes.setdefault(tuple(r["fp"]), set()).add(r["g"])
    assert sorted(map(sorted, classes.values())) == [[0, 1], [2], [3]] and all(len(k) == 2 for k in classes)


def test_fit_is_a_rule():
    a, b = neighbours.Index.fit(1000, 0.9), neighbours.Index.fit(1_000_000, 0.9)
    assert a == neighbours.Index.fit(1000, 0.9) and b.functions > a.functions and b.tables > a.tables


# ---------------------------------------------------------------- mixing


def test_sainte_lague():
    assert mixture.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    rng = random.Random(1)
    for _ in range(50):
        w = {f"s{i}": rng.random() for i in range(rng.randint(1, 9))}
        seats, got = rng.randint(0, 400), None
        got = mixture.sainte_lague(w, seats)
        slow = {k: 0 for k in w}
        for _ in range(seats):
            slow[max(w, key=lambda k: (w[k] / (2 * slow[k] + 1), k))] += 1
        assert sum(got.values()) == seats and all(abs(got[k] - slow[k]) <= 1 for k in w)
    assert mixture.sainte_lague({"a": 1.0, "b": 1.0}, 10, {"a": 2}) == {"a": 2, "b": 8}
    assert mixture.sainte_lague({}, 5) == {} and mixture.sainte_lague({"a": 0.0}, 5) == {"a": 0}


def test_mixture(spark, data):
    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    many = docs
    for k in range(1, 6):
        many = many.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000 * k))
    records, report = mixture.mix(many.unionByName(docs).withColumn("tokens", F.lit("clash")), targets)
    rows = [r.asDict() for r in report.collect()]
    live = [r for r in rows if r["available_tokens"] > 0]
    scale = sum(r["target_share"] for r in live)
    assert all(r["most_copies"] <= r["max_repeats"] for r in rows) and abs(sum(r["reached_share"] for r in rows) - 1) < 1e-4
    assert all(abs(r["reached_share"] - r["target_share"] / scale) < 0.05 for r in live)
    got = records.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and sum(r["tokens"] * r["copies"] for r in got) == sum(r["used_tokens"] for r in rows)
    assert sorted(map(tuple, mixture.mix(many, targets)[0].collect())) == sorted(map(tuple, got))  # seeded
    empty, none = mixture.mix(docs.limit(0), targets)
    assert empty.count() == 0 and mixture.mix(docs, targets.limit(0))[0].count() == 0


def test_mixture_of_many_sources(spark, monkeypatch):
    """No target is lost, whatever their number; shards follow the records, so many sources fit the bound."""
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('word ', id) as text", "concat('s', id % 49) as source")
    targets = spark.range(10_001).selectExpr("concat('s', id) as source", "1.0 as target_share", "3 as max_repeats")
    monkeypatch.setattr(mixture, "SHARD_RECORDS", 1)
    monkeypatch.setattr(mixture, "MAX_CELLS", 400)
    records, report = mixture.mix(docs, targets)
    rows = report.collect()
    assert len(rows) == 10_001 and sum(r["available_tokens"] > 0 for r in rows) == 49
    assert all(abs(r["reached_share"] - 1 / 49) < 0.003 for r in rows if r["available_tokens"]) and records.select("source").distinct().count() == 49
    asked, _ = mixture.mix(docs, targets.where("source in ('s1', 's2')"), size_tokens=120)
    assert 100 <= asked.selectExpr("sum(tokens * copies) as n").first()["n"] <= 140
    monkeypatch.setattr(mixture, "MAX_CELLS", 90)
    with pytest.raises(ValueError):
        mixture.mix(docs, targets)
