from cairn.functions.params import Bm25Params, HybridParams
from cairn.operators import fusion, graph, lexical, vectors

DOCS = "symbol_id long, chunk_key string, fts_name string, fts_path string, fts_body string, start_line long, end_line long"
SYMBOLS = "symbol_id long, name string, kind string, path string, signature string, start_line long, end_line long"


def unit(i, j=None, a=1.0):
    v = [0.0] * 4
    v[i] = a
    if j is not None:
        v[j] = (1 - a * a) ** 0.5
    return v


def search(spark, symbols, bodies, vecs, query, vec, limit=15, p=HybridParams()):
    s = spark.createDataFrame([(i, n, k, path, None, 1, 9) for i, n, k, path in symbols], SYMBOLS)
    q = spark.createDataFrame([(1, query, limit)], "query_id long, query_text string, max_hits int")
    c = spark.createDataFrame([(i, f"{i}-0", n, path, bodies.get(i, ""), 2, 5) for i, n, k, path in symbols], DOCS)
    scored = lexical.search(c, q, "chunk_key", ["fts_name", "fts_path", "fts_body"])
    from pyspark.sql import functions as F

    leg = lexical.lexical_leg(scored, c.select("chunk_key", "symbol_id", "start_line", "end_line", F.concat_ws(" ", "fts_name", "fts_path", "fts_body").alias("fts_text")))
    sem = None
    if vec is not None:
        e = spark.createDataFrame([(i, 0, 3, 4, v) for i, v in vecs.items()], "symbol_id long, chunk_index long, start_line long, end_line long, embedding array<float>")
        sem = vectors.vector_leg(e, spark.createDataFrame([(1, vec)], "query_id long, vec array<double>"), min_cosine=p.min_cosine)
    return fusion.fuse(sem, leg, q, s, limit=limit, p=p).orderBy("position").collect()


def test_cap_and_gate(spark):
    symbols = [(i, f"s{i}", "function_item", "a.rs") for i in range(5)] + [(9, "other", "function_item", "b.rs")]
    got = search(spark, symbols, {}, {**{i: unit(0) for i in range(5)}, 9: unit(1)}, "zzz", unit(0))
    assert len(got) == 3 and {r["file_path"] for r in got} == {"a.rs"} and all(r["match_type"] == "semantic" and r["score"] >= 0.35 for r in got)
    assert [r["symbol_id"] for r in got] == [0, 1, 2] and got[0]["start_line"] == 3


def test_nothing(spark):
    assert search(spark, [(1, "alpha", "function_item", "a.rs")], {1: "beta"}, {1: unit(1)}, "zzz", unit(0)) == []


def test_body_term_without_vector(spark):
    got = search(spark, [(1, "alpha", "function_item", "a.rs"), (2, "beta", "function_item", "b.rs")], {1: "x xyzzy_special_case y", 2: "case special xyzzy"}, {}, "xyzzy_special_case", None)
    assert [(r["symbol_id"], r["match_type"]) for r in got] == [(1, "lexical")]


def test_fusion_beats_single_legs(spark):
    symbols = [(1, "a", "function_item", "a1.rs"), (2, "b", "function_item", "b2.rs"), (3, "c", "function_item", "c3.rs")]
    got = search(spark, symbols, {2: "flurble flurble", 3: "flurble"}, {1: unit(0), 3: unit(0, 1, 0.8)}, "flurble", unit(0))
    assert got[0]["symbol_id"] == 3 and got[0]["match_type"] == "hybrid" and {r["symbol_id"] for r in got} == {1, 2, 3}


def test_evidence_gate(spark):
    assert search(spark, [(1, "zeta", "function_item", "z.rs")], {1: "upload only"}, {}, "retry upload failed", None) == []
    assert len(search(spark, [(1, "zeta", "function_item", "z.rs")], {1: "upload retry"}, {}, "retry upload failed", None)) == 1


def test_operators_are_data(spark):
    symbols = [(1, "fooBar", "function_item", "a.rs")]
    for q in ('foo" OR "1', "AND OR NOT", "a*", "^x", "-y", "col:z", "NEAR(a b)", "*)(^"):
        search(spark, symbols, {}, {}, q, None)
    assert len(search(spark, symbols, {}, {}, "fooBar(arg)", None)) == 1


def test_limit_is_a_prefix(spark):
    symbols = [(i, f"n{i}", "function_item", f"f{i}.rs") for i in range(8)]
    bodies = {i: "word " * (i + 1) for i in range(8)}
    full = [r["symbol_id"] for r in search(spark, symbols, bodies, {}, "word", None, 8)]
    assert [r["symbol_id"] for r in search(spark, symbols, bodies, {}, "word", None, 3)] == full[:3]


def test_vectors_skip_bad_ones(spark):
    rows = [(1, 0, 1, 1, unit(0)), (1, 1, 0, 1, unit(0)), (2, 0, 1, 1, [1.0]), (3, 0, 1, 1, None), (4, 0, 1, 1, [float("nan")] * 4), (5, 0, 1, 1, unit(0, 1, 0.4))]
    e = spark.createDataFrame(rows, "symbol_id long, chunk_index long, start_line long, end_line long, embedding array<float>")
    got = vectors.vector_leg(e, spark.createDataFrame([(7, unit(0))], "query_id long, vec array<double>"), min_cosine=0.399).collect()
    assert [(r["symbol_id"], r["chunk_index"], r["rank"]) for r in got] == [(1, 1, 1), (5, 0, 2)]
    none = vectors.vector_leg(e, spark.createDataFrame([], "query_id long, vec array<double>"))
    assert none.count() == 0


def test_bm25_parameters(spark):
    d = spark.createDataFrame([("a", "x x y"), ("b", "y"), ("c", None), ("d", "z")], "k string, t string")
    q = spark.createDataFrame([(1, "xx"), (2, "x-y"), (3, "yy zz")], "query_id long, query_text string")
    assert lexical.search(d, q, "k", ["t"], Bm25Params(weights=(1.0,))).where("query_id = 2").count() == 1
    assert lexical.search(d.limit(0), q, "k", ["t"], Bm25Params(weights=(1.0,))).count() == 0


def test_directory(spark):
    s = spark.createDataFrame([(1, "f", "function_item", "a", 0, 3), (2, "F", "function_item", "a", 1, 1), (3, "g", "function_item", "a", 2, 5), (4, "f", "function_item", "b", 0, 2)], "symbol_id long, name string, kind string, path string, ordinal long, start_line long").selectExpr("*", "start_line as end_line", "cast(null as string) as signature")
    assert [r["symbol_id"] for r in graph.symbol_lookup(s, "F").collect()] == [2, 1, 4]
    calls = spark.createDataFrame([("a", "g", "f"), ("a", "g", "f"), ("a", "g", "gone"), ("b", "f", "f")], "path string, from_name string, to_name string")
    r = graph.resolve_calls(calls, s)
    assert sorted((x["from_id"], x["to_id"]) for x in r.collect()) == [(3, 1), (3, 1), (4, 4)]
    assert [x["symbol_id"] for x in graph.find_callers(r, s, "f").collect()] == [3, 3, 4]
    assert [x["symbol_id"] for x in graph.find_callers(r, s, "f", "a").collect()] == [4]
    assert [x["symbol_id"] for x in graph.file_outline(s, "a").collect()] == [2, 1, 3]
    f = spark.createDataFrame([("a", "l", "h", 1, 2, None), ("b", "l", "h", 1, 2, "h"), ("c", "l", "h2", 1, 2, "h")], "path string, language string, hash string, last_modified long, size long, embed_hash string")
    assert sorted(x["path"] for x in graph.pending(f).collect()) == ["a", "c"]
    up = {x["path"]: x for x in graph.upsert_files(f, f.where("path = 'b'").drop("embed_hash").selectExpr("path", "language", "'new' as hash", "last_modified", "size")).collect()}
    assert up["b"]["hash"] == "new" and up["b"]["embed_hash"] == "h" and up["a"]["hash"] == "h"


def test_more_queries_than_a_task_holds(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    e = spark.createDataFrame([(i // 2, i % 2, i, i + 1, x.tolist()) for i, x in enumerate(v)] + [(900, 0, 1, 1, None), (901, 0, 1, 1, [1.0])], "symbol_id long, chunk_index long, start_line long, end_line long, embedding array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[::3])] + [(999, None)], "query_id long, vec array<double>")
    whole = sorted(map(tuple, vectors.vector_leg(e, q, min_cosine=0.2, k=5).collect()))
    monkeypatch.setattr(vectors, "MAX_QUERIES", 9)
    assert sorted(map(tuple, vectors.vector_leg(e, q, min_cosine=0.2, k=5).collect())) == whole and len(whole) > 300


def test_parameters_of_each_query(spark):
    """Weights, rrf_k and limits are those of the query's row; a weight of 0 takes a leg's ranks out of the score."""
    from cairn.operators.fusion import LEG

    v = spark.createDataFrame([(q, s, 1, 2, r) for q in (1, 2, 3) for r, s in enumerate((7, 8, 9), 1)], LEG)
    b = spark.createDataFrame([(q, s, 1, 2, r) for q in (1, 2, 3) for r, s in enumerate((9, 8), 1)], LEG)
    q = spark.createDataFrame([(1, 1.0, 0.0, 60.0, 2), (2, 0.0, 2.0, 10.0, 0), (3, 0.0, 0.0, 60.0, 5)], "query_id long, w_vector double, w_bm25 double, rrf_k double, max_hits int")
    got = {(r["query_id"], r["symbol_id"]): r["rrf"] for r in fusion.rrf(v, b, queries=q).collect()}
    assert abs(got[1, 7] - 1) < 1e-12 and abs(got[1, 9] - 61 / 63) < 1e-12 and got[2, 7] == 0 and abs(got[2, 9] - 1) < 1e-12 and abs(got[2, 8] - 11 / 12) < 1e-12 and got[3, 9] == 0
    ranked = spark.createDataFrame([(k, s, 1.0 / s) for k in (1, 2, 3) for s in range(1, 9)], "query_id long, symbol_id long, score double")
    counts = {r["query_id"]: r["count"] for r in fusion.limit_results(ranked, 15, q).groupBy("query_id").count().collect()}
    assert counts == {1: 2, 2: 1, 3: 5}
