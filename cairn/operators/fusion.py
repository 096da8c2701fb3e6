"""Fusion of the two retrieval legs: evidence gate, reciprocal ranks, boosts and penalties, per-file cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.params import HybridParams
from cairn.functions.text import has_evidence, is_test_file, is_test_symbol, lexical_boost, query_tokens

LEG = "query_id long, symbol_id long, start_line long, end_line long, rank int"


def setting(queries: DataFrame, name: str, default: float) -> Column:
    """A parameter of each query: its own column where there is one and it is not NULL, else the default."""
    return F.coalesce(F.col(name), F.lit(default)) if name in queries.columns else F.lit(default)


def dense(df: DataFrame, order: list[Column], query: str = "query_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def evidence_gate(lexical: DataFrame, semantic: DataFrame, queries: DataFrame, symbols: DataFrame, p: HybridParams = HybridParams(), texts: DataFrame | None = None) -> DataFrame:
    """Lexical hits that the vector leg confirms or that have evidence of their own, with dense new ranks.

    ``lexical`` needs fts_text, or ``texts`` has it by columns that both have; these meet last, so no text is moved
    with each of its hits. ``symbols`` needs name and path. Legs are at most k_candidates rows a query, so these
    joins move little.
    """
    q = queries.select("query_id", query_tokens(F.col("query_text")).alias("_tokens"))
    seen = semantic.select("query_id", "symbol_id", F.lit(True).alias("_seen"))
    h = lexical.join(q, "query_id").join(symbols.select("symbol_id", "name", "path"), "symbol_id").join(seen, ["query_id", "symbol_id"], "left")
    if texts is not None:
        h = h.join(texts, [c for c in texts.columns if c != "fts_text"])
    kept = h.where(F.col("_seen") | has_evidence(F.col("_tokens"), F.col("name"), F.col("path"), F.col("fts_text"), p.min_bm25_term_matches))
    return dense(kept.drop("_tokens", "_seen", "name", "path", *["fts_text"] * (texts is not None)), [F.col("rank").asc()])


def rrf(semantic: DataFrame, lexical: DataFrame, p: HybridParams = HybridParams(), queries: DataFrame | None = None) -> DataFrame:
    """``query_id, symbol_id, rrf, r_vector, r_bm25, start_line, end_line``: weighted reciprocal ranks over the
    best reachable sum (0 where no leg weighs). A symbol in both legs keeps the lines of its vector hit. Weights
    and rrf_k are those of ``queries`` where it has them."""
    v = semantic.select("query_id", "symbol_id", F.col("rank").alias("r_vector"), F.col("start_line").alias("_vs"), F.col("end_line").alias("_ve"))
    b = lexical.select("query_id", "symbol_id", F.col("rank").alias("r_bm25"), F.col("start_line").alias("_bs"), F.col("end_line").alias("_be"))
    both = v.join(b, ["query_id", "symbol_id"], "full_outer")
    wv, wb, k = F.lit(float(p.w_vector)), F.lit(float(p.w_bm25)), F.lit(float(p.rrf_k))
    if queries is not None:
        own = queries.select("query_id", setting(queries, "w_vector", p.w_vector).alias("_wv"), setting(queries, "w_bm25", p.w_bm25).alias("_wb"), setting(queries, "rrf_k", p.rrf_k).alias("_k"))
        both, wv, wb, k = both.join(own, "query_id"), F.col("_wv").cast("double"), F.col("_wb").cast("double"), F.col("_k").cast("double")
    part = lambda r, w: F.coalesce(w / (k + F.col(r)), F.lit(0.0))
    most = (wv + wb) / (k + 1)
    score = F.when(most > 0, (part("r_vector", wv) + part("r_bm25", wb)) / most).otherwise(0.0)
    has_v = F.col("r_vector").isNotNull()
    return both.select("query_id", "symbol_id", score.alias("rrf"), "r_vector", "r_bm25", F.when(has_v, F.col("_vs")).otherwise(F.col("_bs")).alias("start_line"), F.when(has_v, F.col("_ve")).otherwise(F.col("_be")).alias("end_line"))


def adjust(fused: DataFrame, queries: DataFrame, symbols: DataFrame, p: HybridParams = HybridParams()) -> DataFrame:
    """Boosts, penalties, clamping and the score gate; the result's columns. Lines of the chunk count if it
    has any, else the symbol's."""
    q = queries.select("query_id", query_tokens(F.col("query_text")).alias("_tokens"))
    s = symbols.select("symbol_id", "name", "kind", "path", "signature", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    f = fused.join(q, "query_id").join(s, "symbol_id")
    score = F.col("rrf") + lexical_boost(F.col("_tokens"), F.col("name"), F.col("path"))
    score = score - F.when(F.col("kind") == "doc_section", p.doc_penalty).otherwise(0.0) - F.when(is_test_file(F.col("path")) | is_test_symbol(F.col("name")), p.test_penalty).otherwise(0.0)
    f = f.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).where(F.col("score") >= p.min_hybrid)
    chunk = F.col("start_line") > 0
    kind = F.when(F.col("r_vector").isNotNull() & F.col("r_bm25").isNotNull(), "hybrid").when(F.col("r_vector").isNotNull(), "semantic").otherwise("lexical")
    return f.select("query_id", "symbol_id", "name", "kind", F.col("path").alias("file_path"), F.when(chunk, F.col("start_line")).otherwise(F.col("_s")).alias("start_line"), F.when(chunk, F.col("end_line")).otherwise(F.col("_e")).alias("end_line"), "signature", kind.alias("match_type"), "score")


def cap_per_file(results: DataFrame, per_file: int = 3) -> DataFrame:
    """The best ``per_file`` results of each file, before any limit."""
    w = Window.partitionBy("query_id", "file_path").orderBy(F.col("score").desc(), "symbol_id")
    return results.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_file).drop("_n")


def limit_results(results: DataFrame, limit: int = 15, queries: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` results of each query (at least one), with their position; of ``queries`` that have
    ``max_hits`` as many as each asks for."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "symbol_id")
    ranked = results.withColumn("position", F.row_number().over(w))
    if queries is None or "max_hits" not in queries.columns:
        return ranked.where(F.col("position") <= max(1, limit))
    own = queries.select("query_id", F.greatest(setting(queries, "max_hits", limit), F.lit(1)).alias("_most"))
    return ranked.join(own, "query_id").where(F.col("position") <= F.col("_most")).drop("_most")


def fuse(semantic: DataFrame | None, lexical: DataFrame | None, queries: DataFrame, symbols: DataFrame, *, limit: int = 15, p: HybridParams = HybridParams(), texts: DataFrame | None = None) -> DataFrame:
    """The whole pipeline behind the legs; a missing leg is empty, and the other one still answers. Columns
    w_vector, w_bm25, rrf_k and max_hits of ``queries`` go before ``p`` and ``limit``. ``texts`` as in
    :func:`evidence_gate`."""
    spark = queries.sparkSession
    semantic = spark.createDataFrame([], LEG) if semantic is None else semantic
    lexical = spark.createDataFrame([], LEG + ", fts_text string") if lexical is None else evidence_gate(lexical, semantic, queries, symbols, p, texts)
    return limit_results(cap_per_file(adjust(rrf(semantic, lexical, p, queries), queries, symbols, p), p.per_file), limit, queries)
