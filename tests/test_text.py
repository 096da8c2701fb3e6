import pytest
from pyspark.sql import functions as F

from cairn.functions import language, text, vector


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "words", "joined"),
    [
        ("getUserSettings", ["get", "user", "settings"], "get user settings"),
        ("HTTPServer", ["http", "server"], "http server"),
        ("v2Handler", ["v2", "handler"], "v2 handler"),
        ("delete_symbols_for_file", ["delete", "symbols", "for", "file"], "delete symbols for file"),
        ("kebab-case-name", ["kebab", "case", "name"], "kebab case name"),
        ("dotted.key.path", ["dotted", "key", "path"], "dotted key path"),
        ("base64Encode", ["base64", "encode"], "base64 encode"),
        ("parseJSON", ["parse", "json"], "parse json"),
        ("x_y_data_data", ["data"], "data"),
        ("Icon", ["icon"], None),
        ("db", ["db"], None),
        ("", [], None),
        ("_", [], None),
        ("été_naïve", ["été", "naïve"], "été naïve"),
        (None, None, None),
    ],
)
def test_identifier_words(spark, name, words, joined):
    df = spark.createDataFrame([(name,)], "n string").select(text.identifier_words(F.col("n")).alias("w"), text.identifier_word_string(F.col("n")).alias("s")).first()
    assert df["w"] == words and df["s"] == joined


def test_body_split_words(spark):
    body = "fooBar(x); getUserName(fooBar); plain words HTTPServer"
    assert one(spark, text.body_split_words(F.col("b")), b=body) == "foo bar get user name http server"
    assert one(spark, text.body_split_words(F.col("b"), 13), b=body) == "foo bar get"
    long = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}Item" for i in range(300))
    got = one(spark, text.body_split_words(F.col("b")), b=long)
    assert 380 < len(got) <= 400 and not got.endswith(" ")


def test_query_tokens_and_terms(spark):
    assert one(spark, text.query_tokens(F.col("q")), q="the Icon.tsx and for a with X") == ["icon", "tsx"]
    assert one(spark, text.query_tokens(F.col("q")), q="Data data DATA") == ["data", "data", "data"]
    assert one(spark, text.match_terms(F.col("q")), q="*)(^") == []
    assert one(spark, text.match_terms(F.col("q")), q='fooBar(arg) AND "x" OR NEAR the file delete_for-file. -a- fooBar') == ["fooBar", "arg", "OR", "NEAR", "delete_for-file"]
    assert len(one(spark, text.match_terms(F.col("q")), q=" ".join(f"t{i}x" for i in range(20)))) == 12


@pytest.mark.parametrize(("n", "want"), [(1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 3), (0, 1)])
def test_required(spark, n, want):
    assert one(spark, text.required_matches(F.col("n")), n=n) == want


@pytest.mark.parametrize(
    ("name", "path", "want"),
    [("Icon", "src/ui/Icon.tsx", 0.25), ("icon", "other.tsx", 0.15), ("IconButton", "misc.tsx", 0.10), ("unrelatedThing", "misc.rs", 0.0), ("", "misc.rs", 0.10)],
)
def test_boost(spark, name, path, want):
    q = text.query_tokens(F.lit("Icon component"))
    assert one(spark, text.lexical_boost(q, F.col("n"), F.col("p")), n=name, p=path) == want


def test_test_names(spark):
    files = {"src/a.test.ts": True, "src/a.spec.js": True, "x/db_test.rs": True, "x/db_tests.rs": True, "a/tests/x.py": True, "a/__tests__/x.js": True, "src/contest.rs": False, "src/latest.ts": False}
    symbols = {"test_x": True, "parse_test": True, "all_tests": True, "Tests": True, "attest": False, "testing": False}
    for p, want in files.items():
        assert one(spark, text.is_test_file(F.col("p")), p=p) is want, p
    for n, want in symbols.items():
        assert one(spark, text.is_test_symbol(F.col("n")), n=n) is want, n


def test_lines_and_names(spark):
    assert one(spark, text.lines(F.col("t")), t="a\r\nb\n\n") == ["a", "b", ""]
    assert one(spark, text.lines(F.col("t")), t="") == []
    for base, stem in ((".bashrc", ".bashrc"), ("c.tar.gz", "c.tar"), ("plain", "plain")):
        assert one(spark, text.stem_of(F.col("b")), b=base) == stem
    assert one(spark, text.same_name(F.col("a"), "fooBAR"), a="FOObar") is True
    assert one(spark, text.same_name(F.col("a"), "é"), a="É") is False
    assert one(spark, text.index_tokens(F.col("t")), t="Crème_brûlée fooBar") == ["creme", "brulee", "foobar"]


def test_language(spark):
    cases = {"a/b.rs": "rust", "Makefile": "make", "x.h": "c", "x.jsx": "tsx", "x.R": "r", "x.PY": None, "go.mod": "gomod", ".env": None, "a.env": "bash", "README": None, "x.tar.json": "json", "a.mm": "objc"}
    for p, want in cases.items():
        assert language.detect(p) == want, p
        assert one(spark, language.language_column(F.col("p")), p=p) == want, p
    assert language.detect_doc("a.mdx") == "markdown" and language.detect_doc("a.MD") is None and language.detect(None) is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [[1.0, 0.0], [5.0, 5.0], [0.0, 1.0]], [1, 0, 1])], "a array<float>, b array<float>, t array<array<float>>, m array<int>")
    r = df.select(vector.dot(F.col("a"), F.col("b")).alias("d"), vector.normalize(F.col("a")).alias("n"), vector.mean_pool(F.col("t"), F.col("m")).alias("p"), vector.dot(F.col("a"), F.array(F.lit(1.0))).alias("x")).first()
    assert r["d"] == 24.0 and r["n"] == pytest.approx([0.6, 0.8]) and r["p"] == pytest.approx([2**-0.5, 2**-0.5]) and r["x"] is None
