"""Workspace sources: a directory as a table of files, with ignore rules, and the locations of indexes.

``cairn_workspace`` is a Python data source: a directory walk plans batches of paths on the driver, and the
executors read contents. Unlike the built-in file listing it keeps names that begin with an underscore.
"""

from __future__ import annotations

import gzip
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cairn.functions.language import detect, detect_doc

#: Files above this many bytes are recorded, but never read.
MAX_BYTES = 1_500_000
#: A file of at least this many bytes with longer lines than that on average is minified.
MINIFIED_BYTES, MINIFIED_LINE = 50_000, 300
#: Folders that live updates pass over.
WATCH_IGNORED = frozenset(("node_modules", "dist", "target"))
SCHEMA = "path string, length long, mtime long, content binary"


class IgnoreRules:
    """Patterns of one ignore file: comments, negation, anchoring, folders only, ``*``, ``?``, ``**``, classes."""

    def __init__(self, text: str, base: str = ""):
        self.base, self.rules = base, []
        for raw in text.splitlines():
            s = raw.rstrip()
            if not s or s.startswith("#"):
                continue
            negated = s.startswith("!")
            s = s[1:] if negated else s.removeprefix("\\")
            folder = s.endswith("/")
            s = s.rstrip("/")
            anchored = "/" in s
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._pattern(s.lstrip("/")) + r"\Z"), negated, folder))

    @staticmethod
    def _pattern(s: str) -> str:
        out, i = "", 0
        while i < len(s):
            if s.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif s.startswith("**", i):
                out, i = out + ".*", i + 2
            elif s[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif s[i] == "?":
                out, i = out + "[^/]", i + 1
            elif s[i] == "[" and (end := s.find("]", i + 2)) > 0:
                out, i = out + "[" + s[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, i = out + re.escape(s[i]), i + 1
        return out

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept again, None: not mentioned. The path is relative to the root."""
        if self.base and not path.startswith(self.base + "/"):
            return None
        rel, got = path[len(self.base) + 1 :] if self.base else path, None
        for pattern, negated, folder in self.rules:
            if (is_dir or not folder) and pattern.match(rel):
                got = not negated
        return got


def walk(root: str) -> Iterator[str]:
    """Relative paths of the files that are not hidden and not ignored, in sorted order. Folders that are
    links are not entered."""

    def enter(rel: str, rules: list[IgnoreRules]):
        here = os.path.join(root, rel) if rel else root
        own = os.path.join(here, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = [*rules, IgnoreRules(f.read(), rel)]
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.name.startswith("."):
                continue
            path = f"{rel}/{e.name}" if rel else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            said = [v for r in rules if (v := r.verdict(path, is_dir)) is not None]
            if said and said[-1]:
                continue
            if is_dir:
                yield from enter(path, rules)
            elif e.is_file():
                yield path

    yield from enter("", [])


def is_indexable(path: str) -> bool:
    return detect(path) is not None or detect_doc(path) is not None


def is_watch_ignored(path: str, rules: IgnoreRules | None = None) -> bool:
    """Any hidden part or one of the ignored folders anywhere in the path, or the root's rules."""
    parts = [p for p in path.split("/") if p not in ("", ".", "..")]
    return any(p.startswith(".") or p in WATCH_IGNORED for p in parts) or bool(rules and any(rules.verdict("/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1)))


class Batch(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


def read_files(root: str, paths: list[str]) -> Iterator[tuple]:
    for p in paths:
        full = os.path.join(root, p)
        try:
            st = os.stat(full)
            content = None
            if st.st_size <= MAX_BYTES:
                with open(full, "rb") as f:
                    content = f.read()
        except OSError:
            continue  # gone or unreadable: not recorded
        yield (p, st.st_size, int(st.st_mtime), content)


class _Reader(DataSourceReader):
    def __init__(self, root: str, size: int, every: bool, only: str):
        self.root, self.size, self.every, self.only = root, size, every, re.compile(only) if only else None

    def partitions(self):
        paths = [p for p in walk(self.root) if (self.only.search(p.lower()) if self.only else self.every or is_indexable(p))]
        return [Batch(self.root, paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [Batch(self.root, [])]

    def read(self, partition):
        yield from read_files(partition.root, partition.paths)


class _StreamReader(DataSourceStreamReader):
    """Emits a file whenever its time or size changes, and a tombstone (length -1) when it goes. An offset is the
    number of a state of the tree, which is kept in the ``state`` folder until a later one is committed, so
    offsets stay small and a restart replays exactly what was not committed."""

    def __init__(self, root: str, size: int, state: str):
        self.root, self.size, self.state = root, size, state
        os.makedirs(state, exist_ok=True)

    def _tree(self) -> dict:
        out = {}
        for p in walk(self.root):
            if is_indexable(p) and not is_watch_ignored(p):
                try:
                    st = os.stat(os.path.join(self.root, p))
                    out[p] = [st.st_mtime_ns, st.st_size]
                except OSError:
                    continue
        return out

    def _kept(self) -> list[int]:
        return sorted(int(f[:-8]) for f in os.listdir(self.state) if f.endswith(".json.gz"))

    def _load(self, n: int) -> dict:
        if not n:
            return {}
        with gzip.open(os.path.join(self.state, f"{n}.json.gz"), "rt") as f:
            return json.load(f)

    def initialOffset(self):
        return {"state": 0}

    def latestOffset(self):
        now, last = self._tree(), max(self._kept(), default=0)
        if now == self._load(last):
            return {"state": last}
        place = os.path.join(self.state, f"{last + 1}.json.gz")
        with gzip.open(place + ".part", "wt") as f:
            json.dump(now, f)
        os.replace(place + ".part", place)
        return {"state": last + 1}

    def partitions(self, start, end):
        a, b = self._load(start["state"]), self._load(end["state"])
        changed = sorted(p for p in b if a.get(p) != b[p])
        gone = sorted(p for p in a if p not in b)
        out = [Batch(self.root, changed[i : i + self.size]) for i in range(0, len(changed), self.size)]
        if gone:
            out.append(Batch("", gone))
        return out or [Batch(self.root, [])]

    def read(self, partition):
        if not partition.root:
            for p in partition.paths:
                yield (p, -1, 0, None)
        else:
            yield from read_files(partition.root, partition.paths)

    def commit(self, end):
        for n in self._kept():
            if n < end["state"]:
                os.remove(os.path.join(self.state, f"{n}.json.gz"))


class WorkspaceSource(DataSource):
    """Options: path (the root), state (for a stream: a folder for states of the tree, beside its checkpoint), batch (files per task), all (also files without a known language), only (a regular
    expression for lower-case paths; others are not read)."""

    @classmethod
    def name(cls):
        return "cairn_workspace"

    def schema(self):
        return SCHEMA

    def _options(self):
        return self.options.get("path", "."), int(self.options.get("batch", "256"))

    def reader(self, schema):
        root, size = self._options()
        return _Reader(root, size, self.options.get("all", "false").lower() == "true", self.options.get("only", ""))

    def streamReader(self, schema):
        root, size = self._options()
        state = self.options.get("state", "")
        if not state:
            raise ValueError("a stream needs the option state, a folder of its own")
        return _StreamReader(root, size, state)


def read_workspace(spark: SparkSession, root: str, *, everything: bool = False, only: str = "", batch: int = 256) -> DataFrame:
    spark.dataSource.register(WorkspaceSource)
    return spark.read.format("cairn_workspace").option("path", root).option("batch", str(batch)).option("all", str(everything).lower()).option("only", only).load()


def read_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """These files of the workspace, without a walk."""
    return spark.createDataFrame(list(read_files(root, paths)), SCHEMA)


def as_text(content):
    """Bytes as text, NULL where they are no UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def decode_text(files: DataFrame) -> DataFrame:
    """``content`` as text: files whose bytes are no UTF-8 are left out; oversized ones keep NULL."""
    return files.withColumn("_text", as_text(F.col("content"))).where("content is null or _text is not null").drop("content").withColumnRenamed("_text", "content")


def is_minified(content):
    """At least 50,000 bytes with more than 300 bytes a line (whole division)."""
    n = F.octet_length(content)
    count = F.greatest(F.regexp_count(content, F.lit("\n")) + F.when(content.endswith("\n") | (content == ""), 0).otherwise(1), F.lit(1))
    return (n >= MINIFIED_BYTES) & (F.floor(n / count) > MINIFIED_LINE)


# ---------------------------------------------------------------- places


def root_of_uri(uri: str) -> str | None:
    """The directory of a file URI or of a plain path; None for other schemes."""
    if uri.startswith("file://"):
        rest = uri[len("file://") :]
        return unquote(rest if rest.startswith("/") else rest[rest.find("/") :] if "/" in rest else rest)
    return None if re.match(r"[A-Za-z][\w+.-]*://", uri) else uri


def index_location(cache: str, root: str) -> str:
    """``<cache>/indexes/<stem of at most 40 safe characters>-<hash of the root>``."""
    import xxhash

    full = os.path.abspath(root)
    stem = re.sub(r"[^A-Za-z0-9._-]", "_", Path(full).name)[:40] or "root"
    return os.path.join(cache, "indexes", f"{stem}-{xxhash.xxh3_64_intdigest(full.encode()):016x}")
