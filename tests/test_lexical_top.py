"""Best documents of each query without rows for the others."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.params import Bm25Params
from cairn.operators import lexical, lexical_top, vectors
from cairn.plans import queries as plans

WORDS = ["alpha", "beta", "gamma", "delta", "Über", "x1", "fetch", "header"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    texts = [" ".join(r.choices(WORDS, k=r.randrange(6))) for _ in range(120)]
    texts += ["fetch_header beta", "fetch header", "header fetch", "fetch", "a-a-a", None, "", "alpha alpha alpha"] + ["beta gamma"] * 30  # ties
    docs = spark.createDataFrame([(f"{i:05d}", i, t, texts[-i]) for i, t in enumerate(texts)], "k string, n long, t string, u string")
    asked = ["alpha", "Alpha alpha", "beta gamma", "gamma beta", "fetch_header", "fetch-header-beta", "a-a", "uber", "nowhere", "", None, "the for", "alpha delta x1 fetch_header", "..", "header beta"]
    return docs, spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "k", "bm25", "rank").collect()))


@pytest.mark.parametrize("digits", [9, 6, 1])
@pytest.mark.parametrize("block, group, limit", [(1 << 16, 1 << 20, 200_000), (16, 1 << 20, 200_000), (16, 20, 3)])
def test_equals_all_scores(corpus, monkeypatch, digits, block, group, limit):
    """Also over many blocks, groups and blocks of queries; equal scores go by key."""
    docs, asked = corpus
    monkeypatch.setattr(lexical_top, "BLOCK", block)
    monkeypatch.setattr(lexical_top, "GROUP", group)
    p = Bm25Params(weights=(3.0, 1.0))
    every = lexical.search(docs, asked, "k", ["t", "u"], p).withColumn("bm25", F.round("bm25", digits))
    for k in (1, 7, 500):
        want = lexical.top(every, k, [F.col("bm25").desc(), F.col("k").asc()])
        got = lexical_top.search_top(docs, asked, "k", ["t", "u"], k, p=p, digits=digits, keep=("n",), limit=limit)
        assert _rows(got) == _rows(want)
        assert got.where("int(k) <> n").count() == 0


def test_weights_that_are_no_whole_numbers(corpus):
    docs, asked = corpus
    p = Bm25Params(weights=(0.3, 1.7))
    want = lexical.top(lexical.search(docs, asked, "k", ["t", "u"], p), 9, [F.col("bm25").desc(), F.col("k").asc()])
    assert _rows(lexical_top.search_top(docs.unionAll(docs), asked, "k", ["t", "u"], 9, p=p)) == _rows(want)  # repeated rows count once


def test_nothing_to_search(corpus):
    docs, asked = corpus
    assert lexical_top.search_top(docs.limit(0), asked, "k", ["t"], 5, p=Bm25Params(weights=(1.0,))).count() == 0
    assert lexical_top.search_top(docs, asked.limit(0), "k", ["t"], 5, p=Bm25Params(weights=(1.0,))).count() == 0
    assert lexical_top.search_top(docs, asked, "k", ["t"], 0, p=Bm25Params(weights=(1.0,))).count() == 0


def most_rows(spark, run):
    """The most rows that an operator of the statements of ``run`` gave."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before, most = store.executionsCount(), 0
    run()
    bus.waitUntilEmpty(30_000)
    every = store.executionsList()
    for i in range(before, every.size()):
        of = every.apply(i).executionId()
        values, nodes = store.executionMetrics(of), store.planGraph(of).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())):
                if m.name() == "number of output rows" and (got := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(got.get().replace(",", "")))
    return most


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """1500 chunks and 60 queries that share a word with each."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.range(1500).selectExpr("id as symbol_id", "concat('src/f', id % 300, '.rs') as path", "0L as chunk_index", "1L as start_line", "2L as end_line", "concat('name', id) as fts_name", "'' as fts_path", "concat('alpha word', id % 60, ' word', id % 7) as fts_body").write.parquet(f"{d}/symbol_chunks.parquet")
    spark.range(1500).selectExpr("id as symbol_id", "concat('name', id) as name", "'function' as kind", "concat('src/f', id % 300, '.rs') as path", "cast(null as string) as signature", "1L as start_line", "2L as end_line").write.parquet(f"{d}/symbols.parquet")
    spark.range(60).selectExpr("id as query_id", "concat('alpha word', id) as query_text", "5 as max_hits", "60.0D as rrf_k", "1.0D as w_vector", "1.0D as w_bm25", "5 as k_candidates").write.parquet(f"{d}/search_queries.parquet")
    return d


def test_chunks_without_rows_for_all_pairs(spark, tables):
    """Of 90,000 pairs of a query and a chunk that share a word only those near the best become rows."""
    got = []
    assert most_rows(spark, lambda: got.append(plans.bm25_chunks_topk(spark, tables).count())) < 40_000
    assert got == [60 * 50]


def test_hybrid_without_rows_for_all_pairs(spark, tables):
    got = []
    assert most_rows(spark, lambda: got.append(plans.hybrid_lexical_only(spark, tables).count())) < 40_000
    assert 0 < got[0] <= 60 * 5


@pytest.mark.parametrize("blocks", [1, 100])
def test_vectors_by_small_steps(spark, monkeypatch, blocks):
    """Candidates that are dropped on the way change nothing: against all cosines, with equal ones."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(240, 4)).astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[60:120] = v[:60]
    v = v.astype(np.float32).astype(float)
    e = spark.createDataFrame([(i // 2, i % 2, None if i % 5 == 0 else i, i, x.tolist()) for i, x in enumerate(v)], "symbol_id long, chunk_index long, start_line long, end_line long, embedding array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:40])], "query_id long, vec array<double>")
    want = []
    for i in range(40):
        c = np.round(np.clip(v @ v[i], 0, 1), 9)
        best = {}
        for j in sorted(range(240), key=lambda j: (-c[j], -1 if j % 5 == 0 else j, j % 2)):
            if c[j] >= 0.2:
                best.setdefault(j // 2, j)
        for rank, j in enumerate(sorted(best.values(), key=lambda j: (-c[j], j // 2))[:6], 1):
            want.append((i, j // 2, j % 2, None if j % 5 == 0 else j, j, c[j], rank))
    for name, value in (("CELLS", 300), ("KEPT", 1), ("ROWS", 7), ("MAX_QUERIES", 9), ("MATRICES", blocks)):
        monkeypatch.setattr(vectors, name, value)
    got = vectors.vector_leg(e.unionAll(e), q, min_cosine=0.2, k=6)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[6])) == want


def test_names_without_rows_for_all_pairs(spark, tables, tmp_path):
    """75 symbols asked by three names that 500 chunks each have."""
    c, s = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("symbol_chunks", "symbols"))
    c.withColumn("fts_name", F.expr("concat('name', symbol_id % 3)")).write.parquet(f"{tmp_path}/symbol_chunks.parquet")
    s.withColumn("name", F.expr("concat('name', symbol_id % 3)")).write.parquet(f"{tmp_path}/symbols.parquet")
    got = []
    assert most_rows(spark, lambda: got.extend(plans.identifier_eval(spark, str(tmp_path)).collect())) < 20_000
    assert tuple(got[0]) == (75, 1.0, 1.0)


def test_known_items_without_rows_for_all_pairs(spark, tables):
    spark.range(60).selectExpr("id as query_id", "id as symbol_id", "3 as grade").write.parquet(f"{tables}/judgments.parquet")
    spark.range(60).selectExpr("id as hit_id", "id as query_id", "id as symbol_id").write.parquet(f"{tables}/search_hits.parquet")
    spark.range(60).selectExpr("id as symbol_id", "0L as chunk_index", "1L as start_line", "2L as end_line", "transform(sequence(0, 63), x -> float(if(x = id, 1, 0))) as embedding").write.parquet(f"{tables}/symbol_embeddings.parquet")
    got = []
    assert most_rows(spark, lambda: got.extend(plans.known_item_eval(spark, tables).collect())) < 40_000
    assert tuple(got[0]) == (60, 1.0, 1.0, 1.0)
