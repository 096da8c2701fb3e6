"""The index: Parquet directories behind a manifest that one rename replaces.

Tables are cut into buckets by the path's hash. An update rewrites the buckets of the changed paths only, into a
directory of its own; the manifest names, per table and bucket, the directory that holds it, so untouched buckets
stay where they are and a file's rows are found in one bucket. Postings are sorted by token instead: an update adds
a segment with those of the changed paths, and its list of changed paths hides what older segments say about
them; segments are merged when there are many, or when much is hidden. A run that dies leaves the old manifest
current. Directories that neither the current manifest nor the one before names are removed.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import content_hash, nonblank, oversize_hash
from cairn.functions.language import doc_language_column, language_column
from cairn.operators import chunk, extract, graph, lexical, sections
from cairn.session import broadcast_checked, cut
from cairn.sources.workspace import MAX_BYTES, decode_text, is_minified

VERSION = 2
_POSTINGS = "dl int, field int, token string, tf long, positions array<int>, slot int"
SCHEMAS = {
    "files": "path string, language string, hash string, last_modified long, size long, embed_hash string",
    "symbols": f"path string, ordinal long, {extract.SYMBOL}, symbol_id long",
    "relations": "path string, from_id long, to_id long, kind string",
    "chunks": "path string, symbol_id long, chunk_index long, start_line long, end_line long, embed_text string, fts_name string, fts_path string, fts_body string, chunk_key string",
    "embeddings": "path string, symbol_id long, chunk_index long, start_line long, end_line long, embedding array<float>",
    "lengths": "path string, chunk_key string, dl int",
    "symbol_lengths": "path string, symbol_id long, dl int",
    "postings": f"path string, chunk_key string, {_POSTINGS}",
    "symbol_postings": f"path string, symbol_id long, {_POSTINGS}",
}
SEGMENTED = ("postings", "symbol_postings")
TABLES = tuple(t for t in SCHEMAS if t not in SEGMENTED)
FIELDS, SYMBOL_FIELDS = ["fts_name", "fts_path", "fts_body"], ["name", "signature"]
#: Files of a bucket when an index begins, and the fewest and most buckets.
BUCKET_FILES, LEAST_BUCKETS, MOST_BUCKETS = 4096, 16, 1 << 14
#: Tables that are written at the same time.
WRITERS = 4
#: Segments of postings before they are merged, and the share of hidden paths from which all are.
MAX_SEGMENTS, HIDDEN_SHARE = 8, 0.25
#: Seconds a writer waits for another, and after which a lock is taken for left behind.
WAIT, STALE = 600.0, 6 * 3600.0


class Conflict(RuntimeError):
    """Another writer holds the index or has changed it meanwhile."""


def scan_records(scan: DataFrame) -> DataFrame:
    """``path, content, language, hash, last_modified, size, stub`` of scanned files; oversized and minified
    ones are stubs, which are recorded without symbols. Files that are no UTF-8 are left out."""
    s = decode_text(scan)
    big = F.col("content").isNull()
    lang = F.coalesce(language_column(F.col("path")), doc_language_column(F.col("path")))
    stub = big | ((language_column(F.col("path")).isNotNull()) & F.coalesce(is_minified(F.col("content")), F.lit(False)))
    return s.select("path", "content", lang.alias("language"), F.when(big, oversize_hash(F.col("length"), F.col("mtime"))).otherwise(content_hash(F.col("content"))).alias("hash"), F.col("mtime").alias("last_modified"), F.col("length").alias("size"), stub.alias("stub"))


def symbol_key(path, ordinal):
    """A stable 63-bit key of (path, ordinal)."""
    return F.xxhash64(path, ordinal).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def derive(records: DataFrame, i18n: dict[str, str] | DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of the given records, and the paths that did not parse (their old rows stay)."""
    live = records.where(~F.col("stub"))
    code = live.where(language_column(F.col("path")).isNotNull())
    parsed = cut(extract.parse(code.select("path", "content")).select("path", "parsed"))
    failed = parsed.where("parsed.error is not null").select("path")
    docs = sections.doc_sections(live.where(doc_language_column(F.col("path")).isNotNull()).select("path", "content"))
    none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    docs = docs.select("path", "ordinal", "name", "kind", "parent_context", *none(("signature", "string"), ("doc_comment", "string")), "body_text", "start_line", F.lit(1).cast("long").alias("start_col"), "end_line", F.lit(1).cast("long").alias("end_col"))
    symbols = cut(extract.symbols_of(parsed.where("parsed.error is null")).unionByName(docs).withColumn("symbol_id", symbol_key(F.col("path"), F.col("ordinal"))))
    relations = graph.resolve_calls(extract.calls_of(parsed), symbols).join(symbols.select(F.col("symbol_id").alias("from_id"), "path"), "from_id").select("path", "from_id", "to_id", "kind")
    text = chunk.embedding_text(F.col("kind"), F.col("name"), F.col("parent_context"), F.col("doc_comment"), F.col("body_text"))
    kept = symbols.where(chunk.worth_embedding(F.col("kind"), F.col("name"), text))
    chunks = chunk.chunk_symbols(kept.select("path", "symbol_id", "name", "kind", "parent_context", "doc_comment", "body_text", "start_line", "end_line"), i18n)
    chunks = cut(chunks.withColumn("chunk_key", F.format_string("%019d-%06d", "symbol_id", "chunk_index")).select(*[c.split()[0] for c in SCHEMAS["chunks"].split(", ")]))
    slotted = lambda x: x.withColumn("slot", lexical.token_slot(F.col("token")))
    post, named = slotted(lexical.postings(chunks, "chunk_key", FIELDS, ("path",))), slotted(lexical.postings(symbols, "symbol_id", SYMBOL_FIELDS, ("path",)))
    dl, names = lexical.lengths(chunks, "chunk_key", FIELDS, ("path",)), lexical.lengths(symbols, "symbol_id", SYMBOL_FIELDS, ("path",))
    files = records.select("path", "language", "hash", "last_modified", "size", F.when(F.col("stub"), F.col("hash")).alias("embed_hash"))
    return {"files": files, "symbols": symbols, "relations": relations, "chunks": chunks, "lengths": dl, "symbol_lengths": names, "postings": post, "symbol_postings": named}, failed


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """``buckets`` of a new index, by default one for each BUCKET_FILES files of its first update; an existing one
        keeps its own number."""
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._hadoop)

    def _p(self, s: str):
        return self._jvm.org.apache.hadoop.fs.Path(s)

    # -------------------------------------------------------------- manifest

    def manifest(self) -> dict:
        """The current manifest; an empty one where there is none or its schema is of another version."""
        pointer = self._p(f"{self.path}/CURRENT")
        if self._fs.exists(pointer):
            stream = self._fs.open(pointer)
            try:
                state = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            if state.get("version") == VERSION:
                return state
        return {"version": VERSION, "id": None, "buckets": self._buckets or LEAST_BUCKETS, "tables": {t: {} for t in TABLES}, "segments": {t: [] for t in SEGMENTED}, "hidden": [], "seq": 0, "before": []}

    def current(self) -> str | None:
        return self.manifest()["id"]

    @staticmethod
    def _places(m: dict) -> set[str]:
        return {d for t in m["tables"].values() for d in t.values()} | {d for t in m["segments"].values() for d, _ in t} | {d for d, _ in m["hidden"]}

    def _publish(self, m: dict, since: str | None) -> None:
        """Makes ``m`` current if the index still is as it was, and removes what nothing names any more."""
        old = self.manifest()
        if old["id"] != since:
            raise Conflict("the index was changed by another writer")
        m |= {"id": uuid.uuid4().hex, "before": sorted(self._places(old))}
        tmp = self._p(f"{self.path}/CURRENT.{m['id']}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p(self.path).toUri(), self._hadoop).rename(tmp, self._p(f"{self.path}/CURRENT"), options)
        keep = self._places(m) | set(m["before"])
        for status in self._fs.listStatus(self._p(self.path)):
            if status.isDirectory() and status.getPath().getName() not in keep:
                self._fs.delete(status.getPath(), True)

    @contextmanager
    def writing(self, wait: float = WAIT):
        """One writer at a time: a lock file that is created or not, in one step."""
        lock, until = self._p(f"{self.path}/LOCK"), time.time() + wait
        self._fs.mkdirs(self._p(self.path))
        while True:
            try:
                self._fs.create(lock, False).close()
                break
            except Exception as e:  # noqa: BLE001 - what the file system says where the file exists
                if not self._fs.exists(lock):
                    if "AlreadyExists" not in str(e):
                        raise
                    continue
                if time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > STALE:
                    self._fs.delete(lock, False)
                elif time.time() > until:
                    raise Conflict("another writer holds the index") from None
                time.sleep(0.1)
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    # -------------------------------------------------------------- reading

    def bucket(self, path):
        return F.pmod(F.xxhash64(path), F.lit(self.manifest()["buckets"])).cast("int")

    def _buckets_of(self, paths: list[str]) -> list[int]:
        some = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return sorted({r["b"] for r in some.select(self.bucket(F.col("path")).alias("b")).collect()})

    def read(self, table: str, paths: list[str] | None = None) -> DataFrame:
        """A table; with ``paths`` the rows of these files, from their buckets alone."""
        m = self.manifest()
        if table in SEGMENTED:
            got = self._segments(m, table)
            return got if paths is None else got.where(F.col("path").isin(paths))
        got = self._from(m, table, None if paths is None else self._buckets_of(paths))
        return got if paths is None else got.where(F.col("path").isin(paths))

    def _from(self, m: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        held = m["tables"][table]
        places = [f"{self.path}/{d}/{table}/bucket={b}" for b, d in sorted(held.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*places) if places else self.spark.createDataFrame([], SCHEMAS[table])

    def _segments(self, m: dict, table: str, some: list | None = None) -> DataFrame:
        """Postings of the segments, without those of files that a later update changed."""
        got = None
        for d, seq in m["segments"][table] if some is None else some:
            part = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{d}/{table}").withColumn("_seq", F.lit(seq))
            got = part if got is None else got.unionByName(part)
        if got is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        hidden = None
        for d, seq in m["hidden"]:
            part = self.spark.read.schema("path string").parquet(f"{self.path}/{d}/hidden").withColumn("_until", F.lit(seq))
            hidden = part if hidden is None else hidden.unionByName(part)
        if hidden is not None:
            last = broadcast_checked(hidden.groupBy("path").agg(F.max("_until").alias("_until")))
            got = got.join(last, "path", "left").where("_until is null or _seq >= _until").drop("_until")
        return got.drop("_seq")

    def all_files(self) -> DataFrame:
        return self.read("files").orderBy("path")

    def file_by_path(self, path: str) -> DataFrame:
        return self.read("files", [path])

    def chunks_for_file(self, path: str) -> DataFrame:
        return self.read("chunks", [path]).orderBy("symbol_id", "chunk_index")

    # -------------------------------------------------------------- updates

    def _write_all(self, m: dict, place: str, tables: dict[str, DataFrame], buckets: list[int]) -> None:
        """Writes the buckets' new rows of several tables and new segments, at the same time, into ``place``; then the
        manifest names it for the buckets that have any."""
        columns = lambda t: [c.split()[0] for c in SCHEMAS[t].split(", ")]

        def write(table: str) -> None:
            rows, at = tables[table].select(*columns(table)), f"{self.path}/{place}/{table}"
            if table in SEGMENTED:
                rows.repartitionByRange("slot").sortWithinPartitions("slot", "token").write.parquet(at)
            else:
                keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(m["buckets"])).cast("int"))
                keyed.repartition("bucket").sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(at)

        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(write, tables))
        for table in tables:
            if table in SEGMENTED:
                m["segments"][table].append([place, m["seq"]])
                continue
            at, held = self._p(f"{self.path}/{place}/{table}"), m["tables"][table]
            made = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(at) if s.isDirectory()}
            for x in map(str, buckets):
                held.pop(x, None)
            held |= {x: place for x in made if x.isdigit()}

    def _merge(self, m: dict, files: int) -> None:
        """Merges segments: the younger ones where there are many, all where much of the index is hidden."""
        hidden = sum(n for _, n in m.get("hidden_counts", []))
        whole = hidden > HIDDEN_SHARE * max(1, files)
        for table in SEGMENTED:
            held = m["segments"][table]
            some = held if whole else held[1:] if len(held) > MAX_SEGMENTS else []
            if len(some) > 1 or whole and some:
                place = f"commit-{uuid.uuid4().hex}"
                rows = self._segments(m, table, some)
                m["segments"][table] = [x for x in held if x not in some]
                self._write_all(m, place, {table: rows}, [])
        if whole:
            m["hidden"], m["hidden_counts"] = [], []

    def apply(self, records: DataFrame, *, keep: DataFrame | None = None, gone: DataFrame | None = None, i18n=None, wait: float = WAIT) -> dict[str, int]:
        """Takes scanned records (see :func:`scan_records`); unchanged hashes are skipped. ``keep`` holds all
        paths that exist (others are pruned), ``gone`` paths to delete. Files that fail to parse get their
        new hash but keep their old symbols. What is read and written is the buckets of the changed paths;
        nothing changed writes nothing."""
        with self.writing(wait):
            m = self.manifest()
            since, known = m["id"], self._from(m, "files")
            fresh = cut(graph.changed_files(records, known))
            left = known.select("path").join(keep.select("path").distinct(), "path", "left_anti") if keep is not None else self.spark.createDataFrame([], "path string")
            if gone is not None:
                left = left.unionByName(known.select("path").join(gone.select("path").distinct(), "path", "left_semi"))
            touched = cut(fresh.select("path", F.lit(False).alias("gone")).distinct().unionByName(left.distinct().withColumn("gone", F.lit(True))))
            changed, removed = (touched.where(c).count() for c in ("not gone", "gone"))
            if since is None and self._buckets is None:
                m["buckets"] = max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-changed // BUCKET_FILES)))
            if not changed + removed:
                return {"changed": 0, "removed": 0}
            buckets = sorted(r["b"] for r in touched.select(F.pmod(F.xxhash64("path"), F.lit(m["buckets"])).cast("int").alias("b")).distinct().collect())
            derived, failed = derive(fresh, i18n)
            dropped = touched.where("gone").select("path")
            replaced = cut(touched.where("not gone").select("path").join(failed, "path", "left_anti").unionByName(dropped))
            m["seq"] += 1
            place = f"commit-{uuid.uuid4().hex}"
            files = graph.prune_out(graph.upsert_files(self._from(m, "files", buckets), derived["files"]), dropped)
            stubs = derived["files"].where("embed_hash is not null").select("path", F.col("embed_hash").alias("_stub"))
            files = files.join(stubs, "path", "left").withColumn("embed_hash", F.coalesce("_stub", "embed_hash")).drop("_stub")
            tables = {"files": files} | {t: derived[t] for t in SEGMENTED}
            for t in TABLES[1:]:
                rest = graph.prune_out(self._from(m, t, buckets), replaced)
                tables[t] = rest.unionByName(derived[t].select(rest.columns)) if t in derived else rest
            self._write_all(m, place, tables, buckets)
            if since is not None:
                replaced.write.parquet(f"{self.path}/{place}/hidden")
                m["hidden"].append([place, m["seq"]])
                m["hidden_counts"] = [*m.get("hidden_counts", []), [m["seq"], changed + removed]]
            self._merge(m, self._from(m, "files").count())
            self._publish(m, since)
            return {"changed": changed, "removed": removed}

    def embed_pending(self, encoder, wait: float = WAIT) -> int:
        """Vectors for the files whose vectors are missing or stale; a file is marked done only if all its
        chunks have one. Writes the buckets of these files alone."""
        with self.writing(wait):
            m = self.manifest()
            since = m["id"]
            todo = cut(graph.pending(self._from(m, "files")).select("path", "hash"))
            buckets = sorted(r["b"] for r in todo.select(F.pmod(F.xxhash64("path"), F.lit(m["buckets"])).cast("int").alias("b")).distinct().collect())
            if not buckets:
                return 0
            chunks = self._from(m, "chunks", buckets).join(todo.select("path"), "path", "left_semi")
            made = cut(encoder.encode(chunks).select("path", "symbol_id", "chunk_index", "start_line", "end_line", "embedding"))
            failed = made.where("embedding is null").select("path").distinct()
            done = cut(graph.prune_out(todo, failed))
            place = f"commit-{uuid.uuid4().hex}"
            vectors = graph.prune_out(self._from(m, "embeddings", buckets), todo.select("path")).unionByName(made.where("embedding is not null"))
            files = self._from(m, "files", buckets).join(done.select("path", F.lit(True).alias("_done")), "path", "left").withColumn("embed_hash", F.when(F.col("_done"), F.col("hash")).otherwise(F.col("embed_hash"))).drop("_done")
            self._write_all(m, place, {"embeddings": vectors, "files": files}, buckets)
            self._publish(m, since)
            return done.count()


__all__ = ["MAX_BYTES", "SCHEMAS", "Conflict", "Store", "derive", "nonblank", "scan_records"]
