"""Queries over the training-data operators, and SQL where SQL can state the result."""

from pyspark.sql import functions as F

from cairn.llm import docpairs, encode, mixture, mojibake, nearest, neighbours, provenance, rank, split, syntax
from cairn.session import spread, table


def _contents(spark, d):
    return spread(table(spark, d, "file_contents").select("file_id", "path", "content"))


def _texts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p1_pairs(spark, d):
    return docpairs.pairs_with_code(table(spark, d, "symbols"))


def p1_found(spark, d):
    return docpairs.pair_documentation(table(spark, d, "symbols")).select("symbol_id")


def p2_pieces(spark, d):
    """All pieces of all oversized chunks, renumbered within their symbol."""
    return split.renumber(split.split_items(table(spark, d, "symbol_chunks")))


def p2_shifted(spark, d):
    """New indexes of the chunks that stay whole beside pieces."""
    chunks = table(spark, d, "symbol_chunks")
    return split.shift_unsplit(split.split_items(chunks), chunks)


def p2_found(spark, d):
    parts = split.split_items(table(spark, d, "symbol_chunks"))
    return parts.where("piece = 1").select("symbol_id", F.col("parent_index").alias("chunk_index"))


def p3_ranking(spark, d):
    got = rank.fuse_hits(table(spark, d, "search_hits"), table(spark, d, "search_queries"))
    return got.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


def p4_found(spark, d):
    pairs = neighbours.similar_pairs(table(spark, d, "symbol_embeddings"))
    return pairs.select("symbol_id_a", "symbol_id_b")


def p4_neighbours(spark, d):
    """Ten nearest vectors of other symbols, for every vector whose symbol_id is divisible by 20, against all."""
    e = table(spark, d, "symbol_embeddings")
    got = nearest.nearest(e, e.where("symbol_id % 20 = 0"))
    return got.withColumn("cosine", F.round("cosine", 6))


def p4_recall(spark, d):
    """Recall of p4_neighbours against an exhaustive search of the same queries."""
    e = table(spark, d, "symbol_embeddings")
    asked = e.where("symbol_id % 20 = 0")
    return nearest.recall(nearest.nearest(e, asked), nearest.nearest(e, asked, index=nearest.exhaustive()))


def p6_files(spark, d):
    return provenance.find_foreign(_contents(spark, d), table(spark, d, "files"))


def p6_found(spark, d):
    return provenance.find_foreign(_contents(spark, d), table(spark, d, "files")).select("file_id")


def p7_flags(spark, d):
    return syntax.flag_files(_contents(spark, d))


def p7_rates(spark, d):
    return syntax.rates(syntax.flag_files(_contents(spark, d)))


def p7_found(spark, d):
    return syntax.flag_files(_contents(spark, d)).where("invalid").select("file_id")


def p8_ids(spark, d):
    return encode.encode_corpus(_texts(spark, d)).select("doc_id", "ids")


def p9_mixture(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark, d):
    return mojibake.repair_corpus(_texts(spark, d)).select("doc_id")


def p10_restored(spark, d):
    return mojibake.repair_corpus(_texts(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_pieces, p2_shifted, p3_ranking, p4_found, p4_neighbours, p4_recall, p6_found, p6_files, p7_found, p7_flags, p7_rates, p8_ids, p9_mixture, p9_shares, p10_found, p10_restored)}

SQL = {
    "p2_found": "SELECT DISTINCT symbol_id, chunk_index FROM symbol_chunks WHERE length(embed_text) > 800",
    "p3_ranking": """
WITH h AS (SELECT DISTINCT ON (hit_id) * FROM search_hits), q AS (SELECT DISTINCT ON (query_id) * FROM search_queries),
l AS (SELECT query_id, hit_id, 0 AS m, cosine AS v FROM h UNION ALL SELECT query_id, hit_id, 1, -bm25 FROM h UNION ALL SELECT query_id, hit_id, 2, score FROM h),
r AS (SELECT query_id, hit_id, m, CASE WHEN count(*) OVER (PARTITION BY query_id, m) > 1
        THEN (rank() OVER (PARTITION BY query_id, m ORDER BY v) - 1 + (count(*) OVER (PARTITION BY query_id, m, v) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY query_id, m) - 1) ELSE 0.5 END::DOUBLE AS p
      FROM l WHERE v IS NOT NULL AND NOT isnan(v)),
w AS (SELECT query_id, hit_id, pow(p, CASE m WHEN 0 THEN coalesce(w_vector, 1) WHEN 1 THEN coalesce(w_bm25, 1) ELSE 1 END::DOUBLE) AS p
      FROM r LEFT JOIN q USING (query_id) WHERE CASE m WHEN 0 THEN coalesce(w_vector, 1) WHEN 1 THEN coalesce(w_bm25, 1) ELSE 1 END > 0),
v AS (SELECT query_id, hit_id, list(p ORDER BY p) AS vector FROM w GROUP BY ALL),
o AS (SELECT h.query_id, h.hit_id, symbol_id, boost, coalesce(vector, []) AS vector, CASE WHEN vector IS NULL THEN [-1.0::DOUBLE, -1.0, -1.0] ELSE list_resize(vector, 3, 1.0::DOUBLE) END AS pad,
        cosine IS NOT NULL AND NOT isnan(cosine) AS c, bm25 IS NOT NULL AND NOT isnan(bm25) AS b FROM h LEFT JOIN v USING (query_id, hit_id))
SELECT query_id, hit_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY pad DESC, boost DESC NULLS LAST, hit_id) AS position,
  list_transform(vector, lambda x: round(x, 6)) AS vector, CASE WHEN c AND b THEN 'hybrid' WHEN c THEN 'semantic' WHEN b THEN 'lexical' ELSE 'none' END AS evidence FROM o""",
    "p4_found": """
WITH v AS (SELECT DISTINCT symbol_id, embedding FROM symbol_embeddings
           WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
u AS (SELECT symbol_id, embedding::DOUBLE[] AS e FROM v)
SELECT DISTINCT least(a.symbol_id, b.symbol_id) AS symbol_id_a, greatest(a.symbol_id, b.symbol_id) AS symbol_id_b
FROM u a JOIN u b ON a.symbol_id < b.symbol_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
}
