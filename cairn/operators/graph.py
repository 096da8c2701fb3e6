"""Symbol directory and call graph: joins over symbols, files and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import fold_ascii


def resolve_calls(calls: DataFrame, symbols: DataFrame, kind: str = "calls") -> DataFrame:
    """``from_id, to_id, kind``: both ends resolved within the file, to the first symbol of that name.

    ``calls`` has path, from_name, to_name; ``symbols`` path, ordinal, name, symbol_id. Calls with an
    unresolved end are dropped, repeated calls kept.
    """
    first = symbols.groupBy("path", "name").agg(F.min_by("symbol_id", "ordinal").alias("id"))
    a = first.select("path", F.col("name").alias("from_name"), F.col("id").alias("from_id"))
    b = first.select("path", F.col("name").alias("to_name"), F.col("id").alias("to_id"))
    return calls.join(a, ["path", "from_name"]).join(b, ["path", "to_name"]).select("from_id", "to_id", F.lit(kind).alias("kind"))


def callers(relations: DataFrame, symbols: DataFrame, asked: DataFrame, limit: int = 50) -> DataFrame:
    """For every row of ``asked`` (query_id, name, exclude_path or NULL) the first ``limit`` symbols that call one
    of that name (by case) outside that path, with their position by path and line; duplicates stay."""
    to = symbols.select(F.col("symbol_id").alias("to_id"), "name").join(asked.select("query_id", "name", "exclude_path"), "name").drop("name")
    who = relations.where("kind = 'calls'").select("from_id", "to_id").join(to, "to_id").join(symbols, F.col("from_id") == F.col("symbol_id"))
    who = who.where("exclude_path is null or path != exclude_path")
    w = Window.partitionBy("query_id").orderBy("path", "start_line", "symbol_id")
    got = who.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return got.select("query_id", "position", "symbol_id", "name", "kind", F.col("path").alias("file_path"), "start_line", "end_line", "signature")


def find_callers(relations: DataFrame, symbols: DataFrame, name: str, exclude_path: str | None = None, limit: int = 50) -> DataFrame:
    """:func:`callers` of one name."""
    asked = symbols.sparkSession.createDataFrame([(0, name, exclude_path)], "query_id long, name string, exclude_path string")
    return callers(relations, symbols, F.broadcast(asked), limit).orderBy("position").drop("query_id", "position")


def lookup(symbols: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """For every row of ``asked`` (query_id, name) the first ``limit`` symbols of that name, whatever the case of
    ASCII letters, with their position by path and line."""
    names = asked.select("query_id", fold_ascii(F.col("name")).alias("_name"))
    got = symbols.withColumn("_name", fold_ascii(F.col("name"))).join(names, "_name")
    w = Window.partitionBy("query_id").orderBy("path", "start_line", "symbol_id")
    return got.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).select("query_id", "position", "symbol_id", "name", "kind", F.col("path").alias("file_path"), "start_line", "signature")


def symbol_lookup(symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """:func:`lookup` of one name."""
    asked = symbols.sparkSession.createDataFrame([(0, name)], "query_id long, name string")
    return lookup(symbols, F.broadcast(asked), limit).orderBy("position").drop("query_id", "position")


def outlines(symbols: DataFrame) -> DataFrame:
    """Every file's symbols with their ``position`` by line."""
    return symbols.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "ordinal")))


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    """All symbols of a file by line; the store is asked for the file's bucket alone."""
    return outlines(symbols.where(F.col("path") == path)).orderBy("position").drop("position")


def pending(files: DataFrame) -> DataFrame:
    """Files whose vectors are missing or stale."""
    return files.where(F.col("embed_hash").isNull() | (F.col("embed_hash") != F.col("hash")))


def index_counts(files: DataFrame, symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: files, symbols, embeddings, pending."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("embed_hash").isNull() | (F.col("embed_hash") != F.col("hash"))).alias("pending"))
    return f.crossJoin(symbols.agg(F.count(F.lit(1)).alias("symbols"))).crossJoin(vectors.agg(F.count(F.lit(1)).alias("embeddings"))).select("files", "symbols", "embeddings", "pending")


def prune(rows: DataFrame, keep: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key is still there; an anti-join's complement, so a NULL key never stays."""
    return rows.join(keep.select(key).distinct(), key, "left_semi")


def prune_out(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key is not among those that went."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """New records replace old ones by path; embed_hash stays with the path."""
    o = old.select("path", *[F.col(c).alias(f"_o_{c}") for c in ("language", "hash", "last_modified", "size", "embed_hash")])
    n = new.select("path", *[F.col(c).alias(f"_n_{c}") for c in ("language", "hash", "last_modified", "size")], F.lit(True).alias("_new"))
    both = o.join(n, "path", "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
    return both.select("path", pick("language"), pick("hash"), pick("last_modified"), pick("size"), F.col("_o_embed_hash").alias("embed_hash"))


def changed_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned records whose (path, hash) is not known."""
    return scan.join(files.select("path", "hash"), ["path", "hash"], "left_anti")
