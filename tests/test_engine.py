import os

import numpy as np
import pytest

from cairn.api import Engine, NotReady, Workspaces, to_json
from cairn.operators.vectors import Encoder, pool
from cairn.sources import workspace
from cairn.streaming.watch import debounce, watch


def make_loader():
    """A loader that is pickled by value."""

    def load():
        import numpy as np

        def run(texts):
            out = np.zeros((len(texts), 16))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    out[i, sum(map(ord, w)) % 16] += 1
            return out

        return run

    return load


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "ws"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text('# Retries uploads.\ndef retry_upload(path, times):\n    for i in range(times):\n        send_file(path)\n    return path\n\n\ndef send_file(path):\n    return "menu.open" if path else None\n')
    (root / "src/__init__.py").write_text("VALUE = 1\n")
    (root / "README.md").write_text("# Title\nuploads and patience\n")
    (root / "build").mkdir()
    (root / "build/x.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("build/\n*.log\n!keep.log\n")
    (root / "src/big.js").write_text("var a=1;" * 10_000)
    (root / "src/bad.py").write_bytes(b"\xff\xfe\x00x = 1")
    return str(root)


def test_life_cycle(spark, tree, tmp_path):
    e = Engine.open(spark, "file://" + tree, str(tmp_path / "cache"), encoder=Encoder(make_loader(), 16))
    with pytest.raises(NotReady):
        e.symbol_lookup("x")
    first = e.index()
    assert first["phase"] == "ready" and first["pending"] == 0
    files = {r["path"]: r for r in e.store.read("files").collect()}
    assert set(files) == {"src/a.py", "src/__init__.py", "README.md", "src/big.js"}  # hidden, ignored and undecodable files are not there
    assert files["src/big.js"]["embed_hash"] == files["src/big.js"]["hash"]
    assert e.store.read("symbols").where("path = 'src/big.js'").count() == 0
    assert e.index() == first  # a rescan is a no-op
    got = e.semantic_search("retry_upload")
    assert got["mode"] == "hybrid" and got["results"][0]["name"] == "retry_upload" and got["results"][0]["snippet"].startswith("def retry_upload")
    assert [r["name"] for r in e.find_callers("send_file").collect()] == ["retry_upload"]
    assert [r["name"] for r in e.code_search("retry").collect()] == ["retry_upload"] == [r["name"] for r in e.code_search("retry_upload").collect()]
    assert '"filePath"' in to_json(e.symbol_lookup("RETRY_UPLOAD")).first()["json"]

    os.remove(os.path.join(tree, "README.md"))
    with open(os.path.join(tree, "src/a.py"), "a") as f:
        f.write("\n\ndef third():\n    return retry_upload(1, 2)\n")
    e.index()
    for t in ("files", "symbols", "chunks", "embeddings", "postings", "lengths"):
        assert e.store.read(t).where("path = 'README.md'").count() == 0, t
    assert e.symbol_lookup("third").count() == 1 and e.semantic_search("patience", vec=None)["results"] is not None

    log = []
    with open(os.path.join(tree, "src/c.go"), "w") as f:
        f.write("package c\n\nfunc Fresh(x int) int {\n\treturn x\n}\n")
    with open(os.path.join(tree, "src/a.py"), "a") as f:
        f.write("def (broken\n")
    for _ in range(2):  # the second run has nothing new
        q = watch(spark, tree, e.store, str(tmp_path / "ck"), once=True, log=log)
        assert q.awaitTermination(120) and q.exception() is None
    assert e.symbol_lookup("Fresh").count() == 1
    assert e.symbol_lookup("third").count() == 1  # a file that does not parse keeps its old symbols
    os.remove(os.path.join(tree, "src/c.go"))
    q = watch(spark, tree, e.store, str(tmp_path / "ck"), once=True, log=log)
    assert q.awaitTermination(120) and e.symbol_lookup("Fresh").count() == 0


def test_ignore_rules():
    r = workspace.IgnoreRules("# c\n*.log\n!keep.log\n/top\nbuild/\na/**/z\nx?[0-9].txt\n")
    cases = {("a.log", False): True, ("d/keep.log", False): False, ("top", False): True, ("d/top", False): None, ("d/build", True): True, ("build", False): None, ("a/b/c/z", False): True, ("a/z", False): True, ("xy7.txt", False): True, ("xyz.txt", False): None}
    for (p, d), want in cases.items():
        assert r.verdict(p, d) is want, p
    for p in ("/w/.git/x.rs", "/w/node_modules/a.js", "/w/dist/a.js", "/w/target/a.rs", "/w/src/.hidden.rs"):
        assert workspace.is_watch_ignored(p), p
    assert not workspace.is_watch_ignored("/w/src/a.rs")
    assert workspace.is_indexable("a.rs") and workspace.is_indexable("a.md") and not workspace.is_indexable("a.png")


def test_minified(spark):
    rows = [("var a=1;" * 10_000,), ("x = 1;\n" * 20_000,), ("a" * 1000,), ("",)]
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame(rows, "c string").select(workspace.is_minified(F.col("c"))).collect()] == [True, False, False, False]


def test_places_and_workspaces(tmp_path):
    assert workspace.root_of_uri("file:///a%20b/c") == "/a b/c" and workspace.root_of_uri("http://x") is None and workspace.root_of_uri("/x") == "/x"
    where = workspace.index_location("/cache", "/a/my project")
    assert where.startswith("/cache/indexes/my_project-") and len(where.rsplit("-", 1)[1]) == 16

    class Fake:
        def __init__(self, root):
            self.root = root

    w = Workspaces()
    with pytest.raises(NotReady):
        w.pick()
    for r in ("/a", "/a/b"):
        w.add(Fake(r))
    assert w.pick().root == "/a" and w.pick(file="/a/b/x.rs").root == "/a/b" and w.pick("/a/b/").root == "/a/b"


def test_encoder(spark):
    load = make_loader()

    def failing():
        model = load()

        def run(texts):
            if any("boom" in t for t in texts):
                raise ValueError
            return model(texts)

        return run

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "boom")], "i int, embed_text string").coalesce(1)
    got = {r["i"]: r["embedding"] for r in Encoder(failing, 16, batch=1).encode(df).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] is None and got[3] is None
    assert pool(np.array([[[1.0, 0.0], [9.0, 9.0]]]), np.array([[1, 0]])).tolist() == [[1.0, 0.0]]


def test_model_checksums(tmp_path):
    import hashlib

    from cairn.operators.vectors import verify_model

    (tmp_path / "model.onnx").write_bytes(b"weights")
    good = hashlib.sha256(b"weights").hexdigest()
    verify_model(str(tmp_path), {"model.onnx": (good, 7)})
    for bad in ({"model.onnx": (good, 8)}, {"model.onnx": ("0" * 64, 7)}, {"tokenizer.json": (good, 7)}):
        with pytest.raises(ValueError):
            verify_model(str(tmp_path), bad)


def test_debounce(spark):
    import random

    rows = [("a", "2025-01-01 00:00:00.100", 1), ("a", "2025-01-01 00:00:01.200", 2), ("a", "2025-01-01 00:00:09", 3), ("b", "2025-01-01 00:00:01.700", 4), ("b", None, 5)]
    df = spark.createDataFrame(rows, "path string, s string, n int").selectExpr("path", "to_timestamp(s) as at", "n")
    assert sorted((r["path"], r["events"], r["n"]) for r in debounce(df, ["path"], "at").collect()) == [("a", 1, 3), ("a", 2, 2), ("b", 1, 4)]
    whole = df.selectExpr("*", "'root' as root")
    got = sorted((r["path"], str(r["batch"])[17:], r["n"]) for r in debounce(whole, ["path"], "at", watch=["root"]).collect())
    assert got == [("a", "00.100000", 2), ("a", "09", 3), ("b", "01.700000", 4)]  # b came after the first batch of the root

    rng = random.Random(3)
    events = [(rng.choice("xyz"), rng.randint(0, 60_000_000), i) for i in range(3000)]
    df = spark.createDataFrame(events, "k string, us long, n int").selectExpr("k", "timestamp_micros(us) as at", "n").repartition(3)
    want, start = {}, {}
    for k, t, n in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if k not in start or t >= start[k] + 1_500_000:
            start[k] = t
        want[k, start[k]] = (n, want.get((k, start[k]), (0, 0))[1] + 1)
    got = {(r["k"], r["us"]): (r["n"], r["events"]) for r in debounce(df, ["k"], "at").selectExpr("*", "unix_micros(batch) as us").collect()}
    assert got == want and debounce(df.limit(0), ["k"], "at").count() == 0


def test_phases(spark, tmp_path, monkeypatch):
    from cairn import api

    (tmp_path / "ws").mkdir()
    (tmp_path / "ws/a.md").write_text("# Uploads\nHow a failed upload is tried again later.\n")
    e = Engine.open(spark, str(tmp_path / "ws"), str(tmp_path / "cache"))
    assert e.status()["phase"] == "empty"
    e.start().join(120)
    assert e.status()["phase"] == "lexical_only" and e.semantic_search("upload")["mode"] == "lexical-only"

    def slow():
        import time

        time.sleep(30)

    e.encoder = Encoder(lambda: slow, 16)
    e.encoder.load = slow
    monkeypatch.setattr(api, "MODEL_WAIT", 0.2)
    assert e.semantic_search("upload")["mode"] == "lexical-only"
    monkeypatch.setattr(e.store, "apply", lambda *a, **k: 1 / 0)
    e.start().join(60)
    assert e.status()["phase"] == "failed" and "division" in e.status()["error"]


def test_model_registry(tmp_path):
    import hashlib

    from cairn.operators import vectors

    (tmp_path / "small").mkdir()
    (tmp_path / "small/m.onnx").write_bytes(b"weights")
    spec = vectors.ModelSpec(8, {"m.onnx": (hashlib.sha256(b"weights").hexdigest(), 7)}, "m.onnx", "query: ")
    made = vectors.model_encoder(str(tmp_path), "small", {"small": spec})
    assert made.dim == 8 and made.prefix == "query: "
    with pytest.raises(ValueError):
        vectors.model_encoder(str(tmp_path))
    assert all(s.dim == 384 and s.model in s.files for s in vectors.MODELS.values()) and vectors.ACTIVE_MODEL in vectors.MODELS


def test_offsets_are_numbers_of_kept_states(tmp_path):
    root, state = tmp_path / "ws", str(tmp_path / "state")
    root.mkdir()
    for k in range(5):
        (root / f"f{k}.py").write_text(f"x = {k}\n")
    make = lambda: workspace._StreamReader(str(root), 2, state)
    r = make()
    first = r.latestOffset()
    assert first == {"state": 1} == r.latestOffset() and [len(p.paths) for p in r.partitions(r.initialOffset(), first)] == [2, 2, 1]
    (root / "f1.py").write_text("x = 11\n")
    os.remove(root / "f2.py")
    second = make().latestOffset()
    replay = lambda: [(p.root != "", p.paths) for p in make().partitions(first, second)]
    assert second == {"state": 2} and replay() == [(True, ["f1.py"]), (False, ["f2.py"])] == replay()
    make().commit(second)
    assert os.listdir(state) == ["2.json.gz"] and make().latestOffset() == second
