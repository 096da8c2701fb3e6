"""Queries of the engine over the given tables. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.language import doc_language_column, language_column
from cairn.functions.params import Bm25Params, HybridParams
from cairn.operators import chunk, extract, fusion, graph, lexical, lexical_top, sections, vectors
from cairn.session import BROADCAST_ROWS, broadcast_checked, cut, dedupe, table
from cairn.sources.workspace import is_minified
from cairn.streaming.watch import debounce

FIELDS = ["fts_name", "fts_path", "fts_body"]
PARAMS = HybridParams(min_bm25_term_matches=2)


def _symbols(spark, d):
    return dedupe(table(spark, d, "symbols"), "symbol_id")


def _queries(spark, d):
    return dedupe(table(spark, d, "search_queries"), "query_id")


def _hits(spark, d):
    return dedupe(table(spark, d, "search_hits"), "hit_id")


def _chunks(spark, d, repeated=False):
    c = table(spark, d, "symbol_chunks")
    c = c if repeated else dedupe(c, "symbol_id", "chunk_index")
    return c.withColumn("chunk_key", F.format_string("%012d-%06d", "symbol_id", "chunk_index"))


# ---------------------------------------------------------------- functions


def identifier_split(spark, d):
    n = _symbols(spark, d).select("name").distinct()
    return n.select("name", F.array_join(text.identifier_words(F.col("name")), " ").alias("words"), text.identifier_word_string(F.col("name")).alias("word_string"))


def body_split_words(spark, d):
    return _symbols(spark, d).select("symbol_id", text.body_split_words(F.coalesce("body_text", F.lit(""))).alias("words"))


def query_terms(spark, d):
    q, tokens = _queries(spark, d), text.query_tokens(F.col("query_text"))
    return q.select("query_id", F.array_join(tokens, " ").alias("tokens"), F.array_join(text.match_terms(F.col("query_text")), " OR ").alias("terms"), text.required_matches(F.size(tokens)).cast("long").alias("required"))


def language_detect(spark, d):
    f = dedupe(table(spark, d, "files"), "file_id")
    return f.select("file_id", language_column(F.col("path")).alias("code_language"), doc_language_column(F.col("path")).alias("doc_language"))


def test_flags(spark, d):
    return _symbols(spark, d).select("symbol_id", text.is_test_file(F.col("path")).alias("test_file"), text.is_test_symbol(F.col("name")).alias("test_symbol"))


def lexical_boost_layers(spark, d):
    h = _hits(spark, d).join(_queries(spark, d).select("query_id", "query_text"), "query_id")
    return h.select("hit_id", text.lexical_boost(text.query_tokens(F.col("query_text")), F.col("name"), F.col("file_path")).alias("lexical_boost"))


def minified_detect(spark, d):
    c = dedupe(table(spark, d, "file_contents"), "file_id")
    return c.where("content is not null").select("file_id", is_minified(F.col("content")).alias("minified"))


def embed_gate(spark, d):
    s = _symbols(spark, d)
    t = chunk.embedding_text(F.col("kind"), F.col("name"), F.col("parent_context"), F.col("doc_comment"), F.col("body_text"))
    return s.select("symbol_id", F.octet_length(t).cast("long").alias("bytes"), chunk.worth_embedding(F.col("kind"), F.col("name"), t).alias("worth"))


def path_terms(spark, d):
    return dedupe(table(spark, d, "files"), "file_id").select("file_id", chunk.path_terms(F.col("path")).alias("terms"))


# ---------------------------------------------------------------- extraction and chunks


def doc_sections(spark, d):
    c = dedupe(table(spark, d, "file_contents"), "file_id").where(doc_language_column(F.col("path")).isNotNull())
    return sections.doc_sections(c.withColumn("content", F.regexp_replace("content", "\r\n|\r", "\n")))


def extract_symbols(spark, d):
    c = dedupe(table(spark, d, "file_contents"), "file_id").where("content is not null")
    return extract.symbols_of(extract.parse(c.select("path", "content"))).drop("body_text")


def extract_calls(spark, d):
    c = dedupe(table(spark, d, "file_contents"), "file_id").where("content is not null")
    return extract.calls_of(extract.parse(c.select("path", "content")))


def chunk_symbols(spark, d):
    got = chunk.chunk_symbols(_symbols(spark, d).select("symbol_id", "name", "kind", "path", "parent_context", "doc_comment", "body_text", "start_line", "end_line"))
    return got.select("symbol_id", "chunk_index", "start_line", "end_line", "embed_text", "fts_name", "fts_path", "fts_body")


def _body_calls(spark, d):
    """Calls as the bodies of symbols show them, and symbols, both by repository: names are resolved within it."""
    s = _symbols(spark, d)
    names = F.regexp_extract_all(F.col("body_text"), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))
    calls = s.where("body_text is not null").select(F.col("repo").alias("path"), F.col("name").alias("from_name"), F.explode(names).alias("to_name"))
    return calls.where("from_name != to_name"), s.select(F.col("repo").alias("path"), F.col("symbol_id").alias("ordinal"), "name", "symbol_id")


def call_resolution(spark, d):
    """Calls resolved to the first symbol of each name in their repository; repeated calls are kept and numbered."""
    r = graph.resolve_calls(*_body_calls(spark, d))
    return r.groupBy("from_id", "to_id", "kind").agg(F.count(F.lit(1)).alias("times"))


def callers_by_name(spark, d):
    """Callers of every called name outside the first path that has a symbol of that name."""
    s = _symbols(spark, d)
    r = graph.resolve_calls(*_body_calls(spark, d))
    asked = s.groupBy("name").agg(F.min("path").alias("exclude_path"), F.min("symbol_id").alias("query_id"))
    got = graph.callers(r, s, asked)
    return got.select("query_id", F.col("position").cast("long").alias("position"), "symbol_id", "name", "file_path", "start_line")


# ---------------------------------------------------------------- retrieval


def _leg_of(spark, d, asked):
    """The lexical leg with each query's own number of candidates, and the texts that fusion needs of the chunks."""
    q = asked.select("query_id", fusion.setting(asked, "k_candidates", PARAMS.k_candidates).cast("int").alias("k"))
    most, n = q.agg(F.coalesce(F.max("k"), F.lit(0)), F.count(F.lit(1))).first()
    own = F.broadcast(q) if n <= BROADCAST_ROWS else q
    first = lexical_top.search_top(_chunks(spark, d, repeated=True), asked, "chunk_key", FIELDS, 2 * most, keep=("symbol_id", "chunk_index", "start_line", "end_line"))
    leg = lexical.best_symbols(first.join(own, "query_id").where(F.col("rank") <= 2 * F.col("k")), most).where(F.col("rank") <= F.col("k")).drop("k")
    return leg, _chunks(spark, d).select("symbol_id", "chunk_index", F.concat_ws(" ", *FIELDS).alias("fts_text")), most, own


def bm25_chunks_topk(spark, d):
    """Best 50 symbols of each query by its best chunk."""
    first = lexical_top.search_top(_chunks(spark, d, repeated=True), _queries(spark, d), "chunk_key", FIELDS, 100, keep=("symbol_id",), digits=6)
    return lexical.best_symbols(first, 50).select("query_id", "symbol_id", "chunk_key", "bm25", F.col("rank").cast("long").alias("rank"))


def code_search(spark, d):
    """Full text over names and signatures, 20 symbols a query."""
    s = _symbols(spark, d)
    scored = lexical.search(s, _queries(spark, d), "symbol_id", ["name", "signature"], Bm25Params(weights=(1.0, 1.0))).withColumn("bm25", F.round("bm25", 6))
    got = lexical.top(scored, 20, [F.col("bm25").desc(), F.col("symbol_id").asc()])
    return got.select("query_id", "symbol_id", "bm25", F.col("rank").cast("long").alias("rank"))


def vector_topk(spark, d):
    """Ten most similar vectors for every vector whose id is divisible by 20, against all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.lit(0).cast("long").alias("chunk_index"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), "embedding")
    q = v.where("symbol_id % 20 = 0").select(F.col("symbol_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))
    got = vectors.vector_leg(v, q, min_cosine=0.15, k=10)
    return got.select("query_id", "symbol_id", F.round("cosine", 5).alias("cosine"))


def _query_vectors(spark, d):
    """A vector for each query that has a hit with one: that of the hit with the smallest id."""
    e = table(spark, d, "symbol_embeddings").where("chunk_index = 0 and size(embedding) = 64").select("symbol_id", "embedding")
    h = _hits(spark, d).select("query_id", "symbol_id", "hit_id").join(e.select("symbol_id"), "symbol_id")  # only ids; repeated rows change no minimum
    of = h.groupBy("query_id").agg(F.min_by("symbol_id", "hit_id").alias("symbol_id"))
    return e.join(broadcast_checked(of), "symbol_id").select("query_id", F.col("embedding").cast("array<double>").alias("vec")).dropDuplicates(["query_id"])


def hybrid_search(spark, d):
    """The whole pipeline for all queries, each with its own weights, rrf_k, candidates and number of hits: both
    legs, evidence gate, fusion, boosts, caps and limits."""
    leg, texts, most, k = _leg_of(spark, d, _queries(spark, d))
    e = table(spark, d, "symbol_embeddings")  # of a symbol's chunks one counts, so repeated rows do too
    semantic = cut(vectors.vector_leg(e, _query_vectors(spark, d), min_cosine=PARAMS.min_cosine, k=most).join(k, "query_id").where("rank <= k").drop("k"))
    got = fusion.fuse(semantic, leg, _queries(spark, d), _symbols(spark, d), p=PARAMS, texts=texts)
    return got.select("query_id", F.col("position").cast("long").alias("position"), "symbol_id", "match_type", F.round("score", 5).alias("score"), "file_path", "start_line", "end_line")


def hybrid_lexical_only(spark, d):
    leg, texts, *_ = _leg_of(spark, d, _queries(spark, d))
    got = fusion.fuse(None, leg, _queries(spark, d), _symbols(spark, d), p=PARAMS, texts=texts)
    return got.select("query_id", F.col("position").cast("long").alias("position"), "symbol_id", "match_type", F.round("score", 5).alias("score"))


def _legs(spark, d):
    h = _hits(spark, d)
    best = lambda order: F.row_number().over(Window.partitionBy("query_id", "symbol_id").orderBy(*order, "hit_id"))
    rank = lambda order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "symbol_id"))
    v = h.where("cosine >= 0.4 and not isnan(cosine)").withColumn("_n", best([F.col("cosine").desc()])).where("_n = 1").withColumn("rank", rank([F.col("cosine").desc()])).where("rank <= 50")
    b = h.where("bm25 is not null and not isnan(bm25)").withColumn("_n", best([F.col("bm25").asc()])).where("_n = 1").withColumn("rank", rank([F.col("bm25").asc()])).where("rank <= 50")
    cols = ["query_id", "symbol_id", "start_line", "end_line", "rank"]
    return v.select(*cols), b.select(*cols)


def rrf_fusion(spark, d):
    """Reciprocal rank fusion of the two rankings behind the stored hits."""
    v, b = _legs(spark, d)
    got = fusion.rrf(v, b, queries=_queries(spark, d))
    return got.select("query_id", "symbol_id", F.round("rrf", 6).alias("rrf"), F.col("r_vector").cast("long").alias("r_vector"), F.col("r_bm25").cast("long").alias("r_bm25"), "start_line", "end_line")


def evidence_gate(spark, d):
    """Lexical hits that survive, with dense ranks."""
    v, b = _legs(spark, d)
    body = _chunks(spark, d).where("chunk_index = 0").select("symbol_id", F.concat_ws(" ", *FIELDS).alias("fts_text"))
    leg = b.join(body, "symbol_id", "left").withColumn("fts_text", F.coalesce("fts_text", F.lit("")))
    return fusion.evidence_gate(leg, v, _queries(spark, d), _symbols(spark, d)).select("query_id", "symbol_id", F.col("rank").cast("long").alias("rank"))


def per_file_cap(spark, d):
    """At most three stored hits per query and file, best first."""
    h = _hits(spark, d).where("score is not null and not isnan(score)")
    return fusion.cap_per_file(_one(h)).select("query_id", "symbol_id", "file_path", "score")


def _one(h):
    n = F.row_number().over(Window.partitionBy("query_id", "symbol_id").orderBy(F.col("score").desc(), "hit_id"))
    return h.withColumn("_k", n).where("_k = 1").select("query_id", "symbol_id", "file_path", "score")


def known_item_eval(spark, d):
    """Share of queries whose best-judged symbols stand among the first 1, 3 and 15 results."""
    good = dedupe(table(spark, d, "judgments"), "query_id", "symbol_id").where("grade = 3").select("query_id", "symbol_id")
    hits = hybrid_search(spark, d).select("query_id", "symbol_id", "position").join(good, ["query_id", "symbol_id"]).groupBy("query_id").agg(F.min("position").alias("best"))
    each = good.select("query_id").distinct().join(hits, "query_id", "left")
    share = lambda k: F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 4).alias(f"top_{k}")
    return each.agg(F.count(F.lit(1)).alias("queries"), share(1), share(3), share(15))


def identifier_eval(spark, d):
    """Share of symbols whose name, asked as a query, brings a symbol of that name first and among the first three,
    for every symbol whose id is divisible by 20 and that is no import, against all."""
    s = _symbols(spark, d)
    asked = s.where("symbol_id % 20 = 0 and kind not like 'import%' and kind != 'use_declaration'").select(F.col("symbol_id").alias("query_id"), F.col("name").alias("query_text"))
    leg, texts, *_ = _leg_of(spark, d, asked)
    got = fusion.fuse(None, leg, asked, s, p=PARAMS, texts=texts)
    best = got.join(asked, "query_id").where(F.lower("name") == F.lower("query_text")).groupBy("query_id").agg(F.min("position").alias("best"))
    share = lambda k: F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 4).alias(f"top_{k}")
    return asked.join(best, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), share(1), share(3))


# ---------------------------------------------------------------- directory and maintenance


def symbol_lookup_nocase(spark, d):
    """For every query text, and every name in capitals, its first 20 symbols."""
    s = _symbols(spark, d)
    asked = _queries(spark, d).select("query_id", F.col("query_text").alias("name")).unionByName(s.groupBy("name").agg((-F.min("symbol_id")).alias("query_id")).select("query_id", text.fold_ascii(F.col("name")).alias("name")))
    return graph.lookup(s, asked).withColumn("position", F.col("position").cast("long"))


def file_outline(spark, d):
    """Every file's symbols in order."""
    return graph.outlines(_symbols(spark, d)).select("path", F.col("position").cast("long").alias("position"), "symbol_id", "name", "kind", "start_line", "end_line")


def index_stats(spark, d):
    f, e = dedupe(table(spark, d, "files"), "file_id"), dedupe(table(spark, d, "symbol_embeddings"), "symbol_id", "chunk_index")
    return graph.index_counts(f, _symbols(spark, d), e.where("embedding is not null"))


def embedding_pending(spark, d):
    return graph.pending(dedupe(table(spark, d, "files"), "file_id")).select("file_id", "path", "hash", "embed_hash")


def unchanged_skip(spark, d):
    """Latest sightings whose content the index does not have."""
    s = dedupe(table(spark, d, "file_scans"), "scan_id").where("hash is not null")
    last = s.groupBy("path").agg(F.max_by("hash", "ingested_at").alias("hash"))
    return graph.changed_files(last, dedupe(table(spark, d, "files"), "file_id")).select("path", "hash")


def _readable(spark, d):
    """Paths whose latest sighting could be read: code and documentation paths, each by its own walk."""
    s = dedupe(table(spark, d, "file_scans"), "scan_id")
    last = s.groupBy("path").agg(F.max_by(F.struct("hash"), "ingested_at").alias("x")).where("x.hash is not null").select("path")
    code = last.where(language_column(F.col("path")).isNotNull())
    return code.unionByName(last.where(doc_language_column(F.col("path")).isNotNull()))


def prune_anti_join(spark, d):
    """Symbols of the files that are still there."""
    return graph.prune(_symbols(spark, d), _readable(spark, d)).select("symbol_id", "path")


def cascade_delete(spark, d):
    """What remains of symbols, chunks and vectors after the unreadable files were deleted."""
    f = dedupe(table(spark, d, "files"), "file_id").select("path")
    gone = f.join(_readable(spark, d), "path", "left_anti")
    left = lambda t, *key: graph.prune_out(dedupe(table(spark, d, t), *key), gone).select(F.lit(t).alias("tab"), "symbol_id")
    every = left("symbols", "symbol_id").unionByName(left("symbol_chunks", "symbol_id", "chunk_index")).unionByName(left("symbol_embeddings", "symbol_id", "chunk_index"))
    return every.groupBy("tab", "symbol_id").agg(F.count(F.lit(1)).alias("n"))


def upsert_files(spark, d):
    """The file table after the latest sightings were taken in."""
    s = dedupe(table(spark, d, "file_scans"), "scan_id").where("hash is not null")
    last = s.groupBy("path").agg(F.max_by(F.struct("hash", F.col("last_modified").cast("long").alias("last_modified"), "size"), "ingested_at").alias("x")).select("path", "x.*")
    new = last.withColumn("language", language_column(F.col("path")))
    return graph.upsert_files(dedupe(table(spark, d, "files"), "file_id"), new)


def change_feed_debounce(spark, d):
    """Events debounced per user: a batch begins with the first event and takes those of the next hour."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return debounce(e, ["user_id"], "ts", 3600).select("user_id", F.unix_micros("batch").alias("batch"), F.col("events").cast("long").alias("events"), "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        identifier_split, body_split_words, query_terms, language_detect, test_flags, lexical_boost_layers, minified_detect, embed_gate, path_terms, doc_sections, extract_symbols, extract_calls, chunk_symbols, call_resolution,
        callers_by_name, bm25_chunks_topk, code_search, vector_topk, hybrid_search, hybrid_lexical_only, rrf_fusion, evidence_gate, per_file_cap, known_item_eval, identifier_eval, symbol_lookup_nocase, file_outline, index_stats, embedding_pending,
        unchanged_skip, prune_anti_join, cascade_delete, upsert_files, change_feed_debounce,
    )
}
