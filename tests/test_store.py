import os
import threading

import pytest
from pyspark.sql import functions as F

from cairn import api, store
from cairn.functions.text import cut_bytes
from cairn.operators import chunk, vectors
from cairn.store import Conflict, Store


def records(spark, files, stub=()):
    return spark.createDataFrame([(p, c, None if p.endswith(".md") else "python", f"h{hash(c) & 0xFFFF}", 1, len(c or ""), p in stub) for p, c in files.items()], "path string, content string, language string, hash string, last_modified long, size long, stub boolean")


def source(k, word="alpha"):
    return f"def work_{k}(path):\n    # {word} and some padding so that it is worth a chunk\n    return send_{word}(path, {k})\n"


def names(s, word):
    q = s.spark.createDataFrame([(0, word)], "query_id long, query_text string")
    from cairn.operators import lexical

    got = lexical.search_index(s.read("postings"), lexical.statistics(s.read("lengths")), q, "chunk_key").join(s.read("chunks"), "chunk_key")
    return sorted(r["path"] for r in got.select("path").distinct().collect())


@pytest.fixture()
def index(spark, tmp_path):
    s = Store(spark, str(tmp_path / "index"), buckets=16)
    s.apply(records(spark, {f"src/f{k}.py": source(k) for k in range(12)} | {"a.md": "# One\nalpha text with enough words to be worth a chunk\n## Two\nbeta text with enough words to be worth a chunk"}))
    return s


def held(s):
    return {os.path.relpath(os.path.join(d, f), s.path): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(s.path) for f in fs if f.endswith(".parquet")}


def test_a_change_rewrites_its_bucket_alone(spark, index):
    before, files = index.manifest(), held(index)
    assert index.apply(records(spark, {"src/f3.py": source(3, "omega")})) == {"changed": 1, "removed": 0}
    after = index.manifest()
    b = str(index._buckets_of(["src/f3.py"])[0])
    for t in store.TABLES:
        old, new = before["tables"][t], after["tables"][t]
        assert {k: v for k, v in new.items() if k != b} == {k: v for k, v in old.items() if k != b}
        assert all(f in held(index) and held(index)[f] == m for f, m in files.items() if f.startswith(f"{old.get(next(iter(old), ''), '')}/{t}/") and f"bucket={b}/" not in f)
    assert names(index, "omega") == ["src/f3.py"] and "src/f3.py" not in names(index, "alpha") and len(names(index, "alpha")) == 12
    assert index.apply(records(spark, {"src/f3.py": source(3, "omega")})) == {"changed": 0, "removed": 0} and index.manifest() == after
    assert index.read("symbols", ["src/f3.py"]).count() == 1 and index.read("symbols").count() == 14
    assert [r["path"] for r in index.all_files().collect()] == sorted(r["path"] for r in index.read("files").collect())
    assert index.file_by_path("src/f4.py").count() == 1 and index.file_by_path("nowhere").count() == 0
    assert [r["chunk_index"] for r in index.chunks_for_file("a.md").collect()] == [0, 0]


def test_buckets_follow_the_first_update(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_FILES", 1)
    monkeypatch.setattr(store, "LEAST_BUCKETS", 2)
    s = Store(spark, str(tmp_path / "i"))
    s.apply(records(spark, {f"{k}.md": f"# T{k}\nwords of section {k} that are long enough for a chunk" for k in range(5)}))
    s.apply(records(spark, {f"x{k}.md": "# X\nmore" for k in range(9)}))
    assert s.manifest()["buckets"] == 5 and s.read("files").count() == 14 and s.read("files", ["3.md"]).count() == 1


def test_no_ghosts(spark, index):
    gone = spark.createDataFrame([("src/f1.py",), ("nowhere",)], "path string")
    assert index.apply(records(spark, {}), gone=gone) == {"changed": 0, "removed": 1}
    assert "src/f1.py" not in names(index, "alpha") and index.read("lengths").where("path = 'src/f1.py'").count() == 0
    keep = spark.createDataFrame([(f"src/f{k}.py",) for k in range(5)], "path string")
    index.apply(records(spark, {}), keep=keep)
    assert names(index, "alpha") == [f"src/f{k}.py" for k in (0, 2, 3, 4)] and names(index, "beta") == []
    assert all(index.read(t).where("path = 'a.md'").count() == 0 for t in store.SCHEMAS)
    assert index.manifest()["hidden"] == []  # more than a quarter was hidden, so all was merged
    index.apply(records(spark, {"src/f0.py": "def ("}))
    assert "src/f0.py" in names(index, "alpha")  # it does not parse: its new hash, its old symbols
    index.apply(records(spark, {"src/f0.py": "big"}, stub={"src/f0.py"}))
    assert "src/f0.py" not in names(index, "alpha") and index.file_by_path("src/f0.py").first()["embed_hash"] is not None


def test_segments_are_merged(spark, index, monkeypatch):
    monkeypatch.setattr(store, "MAX_SEGMENTS", 2)
    monkeypatch.setattr(store, "HIDDEN_SHARE", 9.0)
    for k in range(4):
        index.apply(records(spark, {"src/f0.py": source(0, f"word{k}"), f"new{k}.py": source(50 + k)}))
    m = index.manifest()
    assert all(len(x) <= 3 for x in m["segments"].values()) and names(index, "word3") == ["src/f0.py"] and names(index, "word2") == []
    assert len(names(index, "alpha")) == 12 - 1 + 1 + 4
    places = {p for p in os.listdir(index.path) if p.startswith("commit-")}
    assert places <= index._places(m) | set(m["before"])


def test_one_writer(spark, index):
    with index.writing():
        with pytest.raises(Conflict):
            index.apply(records(spark, {"src/f0.py": source(0, "late")}), wait=0.3)
    m = index.manifest()
    index.apply(records(spark, {"src/f0.py": source(0, "first")}))
    with pytest.raises(Conflict):
        index._publish(m, m["id"])
    done = []
    jobs = [threading.Thread(target=lambda k=k: done.append(Store(spark, index.path).apply(records(spark, {f"t{k}.py": source(70 + k)})))) for k in range(2)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert done == [{"changed": 1, "removed": 0}] * 2 and index.read("files").count() == 15


def test_vectors_touch_their_buckets(spark, index):
    def load():
        import numpy as np

        return lambda texts: np.ones((len(texts), 4))

    assert index.embed_pending(vectors.Encoder(lambda: load(), 4)) == 13 and index.embed_pending(vectors.Encoder(lambda: load(), 4)) == 0
    index.apply(records(spark, {"src/f2.py": source(2, "omega")}))
    before = index.manifest()["tables"]["embeddings"]
    assert index.embed_pending(vectors.Encoder(lambda: load(), 4)) == 1
    after, b = index.manifest()["tables"]["embeddings"], str(index._buckets_of(["src/f2.py"])[0])
    assert {k: v for k, v in after.items() if k != b} == {k: v for k, v in before.items() if k != b}
    assert index.read("embeddings").count() == index.read("chunks").count()


def test_snippets_are_cut_between_characters(spark):
    texts = ["", "abc", "é" * 10, "a" + "é" * 10, "🚀" * 5, "a🚀🚀🚀", "日本語のテキスト", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(1, 14):
        for r in df.select("t", cut_bytes(F.col("t"), most).alias("c")).collect():
            if r["t"] is None or len(r["t"].encode()) <= most:
                assert r["c"] == r["t"]
            else:
                assert r["c"] == r["t"].encode()[:most].decode("utf-8", "ignore") + "\n... (truncated)"


def test_locale_table_equals_dictionary(spark):
    copy = {"menu.open": "Open it", "menu.close": "Close it", "same": "Open it", "long": "x" * 399, "more": "y"}
    bodies = ["t('menu.open') + t(\"menu.close\") + 'same' + 'nope'", "'long' 'menu.open' 'more' 'menu.close'", "no keys", "it's 'menu.open'", None, "'a' 'menu.open' \"menu.open\""]
    s = spark.createDataFrame([(i, f"f{i}", "function_item", "a.ts", None, None, b, 1, 1) for i, b in enumerate(bodies)], "symbol_id long, name string, kind string, path string, parent_context string, doc_comment string, body_text string, start_line long, end_line long")
    a, b = chunk.chunk_symbols(s, copy), chunk.chunk_symbols(s, spark.createDataFrame(list(copy.items()), "key string, value string"))
    assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert chunk.resolve_keys(bodies[0], copy) == "Open it Close it" and chunk.resolve_keys(bodies[1], copy) == "x" * 399 + " Open it"[:0] and chunk.resolve_keys(bodies[3], copy) == ""


def test_locale_copy_reads_locale_files_only(spark, tmp_path):
    (tmp_path / "i18n").mkdir()
    (tmp_path / "i18n/en.json").write_text('{"menu": {"open": "Open"}}')
    (tmp_path / "i18n/de.json").write_text('{"menu": {"open": "Auf", "shut": "Zu"}}')
    (tmp_path / "a.json").write_text('{"x": "y"}')
    assert {r["key"]: r["value"] for r in api.locale_copy(spark, str(tmp_path)).collect()} == {"menu.open": "Open", "menu.shut": "Zu"}


def test_a_named_workspace_is_opened(tmp_path):
    class Fake:
        def __init__(self, root):
            self.root = root

    w = api.Workspaces(Fake)
    assert w.pick("/a/b/").root == "/a/b" and w.pick("file:///a/b") is w.pick("/a/b") and w.pick(file="/a/b/c.py").root == "/a/b"
    with pytest.raises(api.NotReady):
        api.Workspaces().pick("/a")
