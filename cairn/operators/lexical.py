"""Inverted index and field-weighted BM25.

The index is postings ``(doc, its length, field, token, tf, positions)``, sorted by slots of the token's hash, and
the global statistics ``(n_docs, avg_len)``. A query reads only parts that hold slots of its own tokens: terms are
at most twelve per query, and joined by broadcast as long as their number is small. Without a kept index the
same occurrences are taken from the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.params import Bm25Params
from cairn.functions.text import any_of, index_tokens, match_terms
from cairn.session import BROADCAST_ROWS, cut

#: Ranges of the tokens' hashes by which kept postings are sorted.
SLOTS = 4096
#: Decimals of a score; further ones depend on the order of summation.
DIGITS = 9


def _tokens(fields: list[str]) -> Column:
    """All tokens of a row as ``array<struct<field, token, pos>>``."""
    def one(i: int, f: str) -> Column:
        return F.transform(index_tokens(F.col(f)), lambda t, p: F.struct(F.lit(i).alias("field"), t.alias("token"), p.cast("int").alias("pos")))

    return F.flatten(F.array(*[one(i, f) for i, f in enumerate(fields)]))


def postings(docs: DataFrame, key: str, fields: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, <keep>, dl, field (number), token, tf, positions``. NULL fields have no tokens."""
    rows = docs.select(key, *keep, _tokens(fields).alias("x")).withColumn("dl", F.size("x"))
    rows = rows.select(key, *keep, "dl", F.explode("x").alias("x")).select(key, *keep, "dl", "x.*")
    return rows.groupBy(key, *keep, "dl", "field", "token").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(docs: DataFrame, key: str, fields: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, <keep>, dl``: tokens over all fields."""
    return docs.select(key, *keep, sum((F.size(index_tokens(F.col(f))) for f in fields), F.lit(0)).alias("dl"))


def statistics(dl: DataFrame) -> DataFrame:
    """One row: ``n_docs, avg_len``."""
    return dl.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_len"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query_text") -> DataFrame:
    """``key, term, tokens``: one row per term; tokens are the term's parts, several for a phrase."""
    t = queries.select(F.col(key), F.explode(match_terms(F.col(text))).alias("term"))
    return t.withColumn("tokens", index_tokens(F.col("term"))).where(F.size("tokens") > 0)


def parts_of(terms: DataFrame) -> DataFrame:
    """``term, n, place, token`` of each distinct term, whichever queries ask for it."""
    return terms.select("term", "tokens").distinct().select("term", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))


def occurrences(docs: DataFrame, key: str, fields: list[str], parts: DataFrame) -> DataFrame:
    """``term, n, place, key, dl, field, pos`` of the asked tokens in documents; texts are read where they lie, and
    only what is asked for goes on."""
    rows = docs.select(key, _tokens(fields).alias("x")).withColumn("dl", F.size("x"))
    return rows.select(key, "dl", F.explode("x").alias("x")).select(key, "dl", "x.*").join(parts, "token").drop("token")


def occurrences_in(post: DataFrame, parts: DataFrame) -> DataFrame:
    """The same from postings that are kept."""
    return post.join(parts, "token").withColumn("pos", F.explode("positions")).drop("token", "tf", "positions")


def idf(n_docs: Column, df: Column, p: Bm25Params) -> Column:
    return F.greatest(F.ln((n_docs - df + 0.5) / (df + 0.5)), F.lit(p.least_idf))


def bm25(found: DataFrame, terms: DataFrame, stats: DataFrame, key: str, p: Bm25Params = Bm25Params(), query: str = "query_id", bounded: bool = False) -> DataFrame:
    """``query, key, bm25`` (higher is better) of :func:`occurrences`: weighted term frequencies in one saturation
    per term.

    A phrase counts where its tokens follow each other: their positions moved back by their places in the phrase
    agree, so no two postings lists are joined with each other. Occurrences are counted map-side before they are
    shuffled; the term frequencies, one small row per term and document, are kept for the document frequencies
    and for the scores, and partitioned by document, where the sums per query stay. Each (term, document) is
    scored once and handed to the queries that ask for the term. ``bounded`` tells that the terms are few (their
    number was checked), so they and their document frequencies, of which there are no more, are broadcast.
    Scores are rounded to DIGITS, so equal documents tie whatever order their parts were added in.
    """
    small = F.broadcast if bounded else lambda x: x
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), F.col("field") + 1)
    at = F.when(F.col("n") > 1, F.col("pos") - F.col("place")).otherwise(0).alias("at")
    begun = found.groupBy("term", "n", key, "dl", "field", at).agg(F.count(F.lit(1)).alias("got")).where("n = 1 or got = n")
    tf = cut(begun.groupBy("term", key, "dl").agg(F.sum(weight * F.when(F.col("n") > 1, 1).otherwise(F.col("got"))).alias("tf")))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows grow by the queries that ask, which their size does not show
    scored = tf.repartition(parts, key).join(small(df), "term").crossJoin(F.broadcast(stats))  # stats is one row
    part = idf(F.col("n_docs"), F.col("df"), p) * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avg_len")))
    rounded = F.floor(F.sum("part") * 10**DIGITS + 0.5) / 10**DIGITS
    return scored.select("term", key, part.alias("part")).join(small(terms.select(query, "term")), "term").groupBy(query, key).agg(rounded.alias("bm25"))


def asked(queries: DataFrame, query: str = "query_id", text: str = "query_text") -> tuple[DataFrame, DataFrame, bool]:
    """``(terms, parts, bounded)``: the terms, their tokens (broadcast where they are few), and whether they are."""
    terms = query_terms(queries, query, text)
    bounded = queries.select(F.coalesce(F.sum(F.size(match_terms(F.col(text)))), F.lit(0))).first()[0] <= BROADCAST_ROWS
    parts = parts_of(terms)
    return terms, F.broadcast(parts) if bounded else parts, bounded


def search(docs: DataFrame, queries: DataFrame, key: str, fields: list[str], p: Bm25Params = Bm25Params(), query: str = "query_id", text: str = "query_text") -> DataFrame:
    """``query, key, bm25`` of documents without a kept index; only asked tokens leave their partition."""
    terms, parts, bounded = asked(queries, query, text)
    return bm25(occurrences(docs, key, fields, parts), terms, statistics(lengths(docs, key, fields)), key, p, query, bounded)


def search_index(post: DataFrame, stats: DataFrame, queries: DataFrame, key: str, p: Bm25Params = Bm25Params(), query: str = "query_id", text: str = "query_text") -> DataFrame:
    """``query, key, bm25`` from kept postings that have ``slot`` (:func:`token_slot`) and are sorted by it: parts
    of files whose slots hold no asked token are not read."""
    terms, parts, bounded = asked(queries, query, text)
    if bounded:
        wanted = [r["slot"] for r in parts.select(token_slot(F.col("token")).alias("slot")).distinct().limit(SLOTS // 8 + 1).collect()]
        if len(wanted) <= SLOTS // 8:  # else nearly every part has one
            post = post.where(any_of([F.col("slot") == x for x in wanted]))  # as equalities, which reach the scan in any number
    return bm25(occurrences_in(post.drop("slot"), parts), terms, stats, key, p, query, bounded)


def token_slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


def top(scored: DataFrame, k: int | Column, order: list[Column], query: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each query, with ``rank`` from 1; Spark prunes per partition before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def lexical_leg(scored: DataFrame, chunks: DataFrame, k: int = 50, query: str = "query_id", per_query: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Per query the best chunk of each symbol: the first ``2 k`` chunks are cut before symbols are made
    distinct, then ``k`` symbols remain. Expects bm25 with ``chunk_key`` and symbol_id in ``chunks``, whose other
    columns come along. ``per_query`` has a smaller k of its own for each query; ``few`` tells that 2 k rows of
    all queries were checked to be few, so they go to the chunks rather than the chunks to them."""
    first = top(scored, 2 * k, [F.col("bm25").desc(), F.col("chunk_key").asc()], query)
    if per_query is not None:
        first = first.join(F.broadcast(per_query) if few else per_query, query).where(F.col("rank") <= 2 * F.col("k"))
    each = chunks.join(F.broadcast(first), "chunk_key") if few else first.join(chunks, "chunk_key")
    got = best_symbols(each, k, query)
    return got if per_query is None else got.where(F.col("rank") <= F.col("k")).drop("k")


def best_symbols(first: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """The first ``k`` symbols of each query, by the best of their ranked chunks."""
    best = first.withColumn("_n", F.row_number().over(Window.partitionBy(query, "symbol_id").orderBy("rank"))).where("_n = 1").drop("_n", "rank")
    return top(best, k, [F.col("bm25").desc(), F.col("chunk_key").asc()], query)
