"""The engine: one workspace, its index and the user-facing queries."""

from __future__ import annotations

import argparse
import json
import sys
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.params import Bm25Params, HybridParams
from cairn.functions.text import cut_bytes, lines
from cairn.operators import chunk, fusion, graph, lexical, vectors
from cairn.session import cut, reach_workers
from cairn.sources.workspace import as_text, index_location, read_paths, read_workspace, root_of_uri
from cairn.store import Store, scan_records

SNIPPETS, SNIPPET_LINES, SNIPPET_BYTES = 5, 40, 2400
#: Seconds a search waits for its encoder.
MODEL_WAIT = 5.0


class NotReady(RuntimeError):
    """The index has no symbols yet."""


def locale_copy(spark: SparkSession, root: str) -> DataFrame:
    """``key, value`` of the workspace's locale files; no other file is read."""
    files = read_workspace(spark, root, only=chunk.LOCALE)
    return cut(chunk.locale_dictionary(files.withColumn("content", as_text(F.col("content")))))


class Engine:
    def __init__(self, spark: SparkSession, root: str, index: str, encoder: vectors.Encoder | None = None, params: HybridParams = HybridParams(), bm25: Bm25Params = Bm25Params()):
        reach_workers(spark)
        self.spark, self.root, self.store = spark, root, Store(spark, index)
        self.encoder, self.params, self.bm25 = encoder, params, bm25
        self._run: dict | None = None
        self._encoding: ThreadPoolExecutor | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, cache: str, **more) -> Engine:
        place = root_of_uri(root)
        if place is None:
            raise ValueError(f"not a directory: {root}")
        return cls(spark, place, index_location(cache, place), **more)

    # -------------------------------------------------------------- building

    def index(self) -> dict:
        """Scans the workspace: only changed files are parsed, files that went are pruned; then vectors are made for
        what has none. Phases: indexing, then embedding or lexical_only, then ready; failed with its error."""
        self._run = {"phase": "indexing"}
        try:
            scan = read_workspace(self.spark, self.root)
            self.store.apply(scan_records(scan), keep=scan.select("path"), i18n=locale_copy(self.spark, self.root))
            if self.encoder is not None:
                self._run = {"phase": "embedding"}
                self.store.embed_pending(self.encoder)
        except Exception as e:
            self._run = {"phase": "failed", "error": str(e)[:500]}
            raise
        self._run = None
        return self.status()

    def start(self) -> threading.Thread:
        """The same in the background; lexical queries answer as soon as the scan is in, and ``status`` tells the
        phase. An error ends it in the phase failed."""
        def run() -> None:
            try:
                self.index()
            except Exception:  # noqa: BLE001 - it is in the status
                pass

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def status(self) -> dict:
        row = graph.index_counts(self.store.read("files"), self.store.read("symbols"), self.store.read("embeddings")).first().asDict()
        settled = "empty" if not row["files"] else "ready" if not row["pending"] else "lexical_only"
        return {"phase": settled, **(self._run or {}), **row}

    def _require(self) -> None:
        if self.store.current() is None or not self.store.read("symbols").limit(1).count():
            raise NotReady("the workspace has no index yet; run index() first")

    # -------------------------------------------------------------- queries

    def _queries(self, text: str, limit: int) -> DataFrame:
        return self.spark.createDataFrame([(0, text, limit)], "query_id long, query_text string, max_hits int")

    def hybrid(self, text: str, vec: list[float] | None = None, limit: int = 15) -> DataFrame:
        self._require()
        q = self._queries(text, limit)
        symbols, chunks, p = self.store.read("symbols"), self.store.read("chunks"), self.params
        scored = lexical.search_index(self.store.read("postings"), lexical.statistics(self.store.read("lengths")), q, "chunk_key", self.bm25)
        some = chunks.select("chunk_key", "symbol_id", "start_line", "end_line", F.concat_ws(" ", "fts_name", "fts_path", "fts_body").alias("fts_text"))
        leg = lexical.lexical_leg(scored, some, p.k_candidates, few=True)
        semantic = None
        if vec is not None:
            semantic = vectors.vector_leg(self.store.read("embeddings"), self.spark.createDataFrame([(0, vec)], "query_id long, vec array<double>"), min_cosine=p.min_cosine, k=p.k_candidates)
        return fusion.fuse(semantic, leg, q, symbols, limit=max(1, limit), p=p)

    def semantic_search(self, text: str, vec: list[float] | None = None, limit: int = 15) -> dict:
        """``mode, note, results`` with snippets for the first results."""
        if vec is None and self.encoder is not None:
            vec = self._query_vector(text)
        got = self.attach_snippets(self.hybrid(text, vec, limit)).orderBy("position").collect()
        left = self.status()["pending"]
        note = f"{left} files have no vectors yet" if left else None
        return {"mode": "hybrid" if vec is not None else "lexical-only", "note": note, "results": [r.asDict() for r in got]}

    def _query_vector(self, text: str) -> list[float] | None:
        """The query's vector, None where the model is not there within MODEL_WAIT seconds or does not load; it goes
        on loading for the next query."""
        if self._encoding is None:
            self._encoding = ThreadPoolExecutor(1)
        try:
            return self._encoding.submit(self.encoder.encode_query, text).result(timeout=MODEL_WAIT)
        except Exception:  # noqa: BLE001 - without a vector the search is lexical
            return None

    def attach_snippets(self, results: DataFrame) -> DataFrame:
        """Lines of the first five results, at most 40 lines and 2400 bytes, cut between characters. Only the
        files of these results are read."""
        first = results.where(F.col("position") <= SNIPPETS)
        paths = sorted({r["file_path"] for r in first.select("file_path").distinct().collect()})  # at most SNIPPETS
        files = read_paths(self.spark, self.root, paths).select(F.col("path").alias("file_path"), as_text(F.col("content")).alias("_text"))
        wanted = F.greatest(F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(SNIPPET_LINES)), F.lit(0)).cast("int")
        text = F.array_join(F.slice(lines(F.col("_text")), F.greatest(F.col("start_line"), F.lit(1)).cast("int"), wanted), "\n")
        with_text = results.join(F.broadcast(files), "file_path", "left").withColumn("snippet", F.when(F.col("position") <= SNIPPETS, cut_bytes(text, SNIPPET_BYTES)))
        return with_text.drop("_text")

    def code_search(self, text: str, limit: int = 20) -> DataFrame:
        """Full text over names and signatures, equal weights."""
        self._require()
        stats = lexical.statistics(self.store.read("symbol_lengths"))
        scored = lexical.search_index(self.store.read("symbol_postings"), stats, self._queries(text, limit), "symbol_id", Bm25Params(weights=(1.0, 1.0)))
        return scored.join(self.store.read("symbols"), "symbol_id").orderBy(F.col("bm25").desc(), "symbol_id").limit(limit).select("symbol_id", "name", "kind", F.col("path").alias("file_path"), "start_line", "signature")

    def symbol_lookup(self, name: str) -> DataFrame:
        self._require()
        return graph.symbol_lookup(self.store.read("symbols"), name)

    def file_outline(self, path: str) -> DataFrame:
        self._require()
        rel = path[len(self.root.rstrip("/")) + 1 :] if path.startswith(self.root.rstrip("/") + "/") else path
        return graph.file_outline(self.store.read("symbols", [rel]), rel)

    def find_callers(self, name: str, path: str | None = None) -> DataFrame:
        self._require()
        return graph.find_callers(self.store.read("relations").drop("path"), self.store.read("symbols"), name, path)


class Workspaces:
    """Open workspaces; a query goes to the one named, which is opened if need be, else to the one that holds the
    file, else to the first. ``opening`` turns a root into an engine."""

    def __init__(self, opening: Callable[[str], Engine] | None = None):
        self.engines: dict[str, Engine] = {}
        self.opening = opening

    def add(self, engine: Engine) -> None:
        self.engines[engine.root.rstrip("/")] = engine

    def pick(self, workspace: str | None = None, file: str | None = None) -> Engine:
        if workspace is not None:
            root = (root_of_uri(workspace) or workspace).rstrip("/")
            if root not in self.engines:
                if self.opening is None:
                    raise NotReady(f"{workspace} is not open")
                self.add(self.opening(root))
            return self.engines[root]
        if not self.engines:
            raise NotReady("no workspace is open")
        holding = [r for r in self.engines if file and file.startswith(r + "/")]
        return self.engines[max(holding, key=len) if holding else next(iter(self.engines))]


def to_json(results: DataFrame) -> DataFrame:
    """One pretty JSON text per row, with camelCase names."""
    camel = lambda c: c.split("_")[0] + "".join(p.title() for p in c.split("_")[1:])
    return results.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in results.columns]), {"pretty": "true"}).alias("json"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn")
    parser.add_argument("command", choices=["index", "search", "symbols", "lookup", "outline", "callers", "status"])
    parser.add_argument("root")
    parser.add_argument("argument", nargs="?", default="")
    parser.add_argument("--cache", default=".cairn")
    parser.add_argument("--limit", type=int, default=15)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    try:
        engine = Engine.open(spark, a.root, a.cache)
        if a.command in ("index", "status"):
            out = engine.index() if a.command == "index" else engine.status()
        elif a.command == "search":
            out = engine.semantic_search(a.argument, limit=a.limit)
        else:
            run = {"symbols": lambda: engine.code_search(a.argument, a.limit), "lookup": lambda: engine.symbol_lookup(a.argument), "outline": lambda: engine.file_outline(a.argument), "callers": lambda: engine.find_callers(a.argument)}
            out = [r.asDict() for r in run[a.command]().collect()]
        print(json.dumps(out, indent=2, default=str))
        return 0
    except (NotReady, ValueError, KeyError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
