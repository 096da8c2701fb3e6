"""Most similar vectors, by multiprobe p-stable hashing.

Every table hashes a unit vector with ``functions`` Gaussian projections, floor((a.v + b) / width). A vector
is stored in its own bucket and probes, in estimated success order, the buckets that differ in the
coordinates whose projections lie nearest to a border (query-directed probing). Rows that meet in a bucket are
sifted by the Hamming distance of a 63-bit sign sketch they carry, the survivors of all tables are merged, and
exact cosines are computed once per pair.

Only (bucket, fingerprint, sketch) is shuffled per bucket, never a vector. Exact copies of a vector share
their fingerprint and collapse before and after the shuffle, so a group of copies, however large, is one
entry; their links are membership in the fingerprint. A vector is known by two independent 64-bit hashes; the
first alone leads to candidates, both together to rows. A task holds at most HOT rows of a bucket; what a
bucket has more is handed on row by row and compared in tiles of bounded size by many tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

DIM, SKETCH = 64, 63
#: Rows of one bucket that a task holds.
HOT = 1 << 16


@dataclass(frozen=True)
class Index:
    """Parameters of the index; ``fit`` derives them from the number of vectors by a rule, not from the data."""

    dim: int = DIM
    tables: int = 5
    functions: int = 20
    width: float = 3.0
    probes: int = 7
    seed: int = 7
    hamming: int = 17

    def projections(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.normal(size=(self.dim, self.tables * self.functions)) / self.width
        b = rng.uniform(size=self.tables * self.functions)
        mix = rng.integers(1, 2**62, size=(self.tables, self.functions), dtype=np.int64) * 2 + 1
        return a, b, mix, rng.normal(size=(self.dim, SKETCH))

    @staticmethod
    def fit(n: int, min_cosine: float, *, dim: int = DIM, recall: float = 0.97, at: float | None = None, seed: int = 7) -> Index:
        """Functions so that unrelated vectors meet about 4 times per bucket, tables so that a pair with
        cosine ``at`` (default: a third of the way from min_cosine to 1) is met with probability ``recall``;
        width and probes so that the rows to shuffle, tables * (1 + probes), are fewest. All of this is
        estimated on random vectors, not on the data. The sketch may differ in as many bits as a pair with
        exactly min_cosine does, plus three deviations."""
        rng = np.random.default_rng(seed)
        at = min_cosine + (1 - min_cosine) / 3 if at is None else at
        v, g = rng.normal(size=(3000, dim)), rng.normal(size=(3000, dim))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        g -= (g * v).sum(1, keepdims=True) * v
        w = at * v + math.sqrt(1 - at * at) * g / np.linalg.norm(g, axis=1, keepdims=True)
        x, y, u = rng.normal(size=(3, 20000))
        u -= np.floor(u)
        best = None
        for width in (2.0, 3.0, 4.5):
            same = min(0.999, max(1e-6, float(np.mean(np.floor(x / width + u) == np.floor(y / width + u)))))
            functions = max(4, math.ceil(math.log(max(n, 16) / 4) / -math.log(same)))
            for probes in (0, 1, 2, 3, 4, 6, 8, 12):
                trial = Index(dim, 4, functions, width, probes, seed)
                (kv, _), (kw, _) = buckets(trial, v), buckets(trial, w)
                met = (kv == kw[:, :, :1]).any(2) | (kw == kv[:, :, :1]).any(2)
                p = min(0.999, max(0.005, float(met.mean())))
                tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))
                if best is None or tables * (1 + probes) < best[0]:
                    best = (tables * (1 + probes), tables, functions, width, probes)
        angle = math.acos(min_cosine) / math.pi
        return Index(dim, *best[1:], seed, math.floor(SKETCH * angle + 3 * math.sqrt(SKETCH * angle * (1 - angle))))


def buckets(index: Index, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(n, tables, 1 + probes)`` bucket keys, the own bucket first, and the sign sketches."""
    a, b, mix, planes = index.projections()
    n, m = len(v), index.functions
    f = (v @ a + b).reshape(n, index.tables, m)
    q = np.floor(f)
    frac = f - q
    q = q.astype(np.int64)
    near = np.minimum(frac, 1 - frac)
    step = np.where(frac < 0.5, -1, 1).astype(np.int64)
    k = min(6, m)
    at = np.argpartition(near, k - 1, axis=2)[:, :, :k]
    score = np.take_along_axis(near, at, 2) ** 2
    subsets = [s for r in (1, 2, 3) for s in itertools.combinations(range(k), r)]
    member = np.zeros((len(subsets), k))
    for i, s in enumerate(subsets):
        member[i, list(s)] = 1
    probes = min(index.probes, len(subsets))
    with np.errstate(over="ignore"):
        own = (q * mix).sum(2) + np.arange(index.tables, dtype=np.int64) * 0x9E3779B97F4A7
        change = np.take_along_axis(step * mix, at, 2)  # what one step of a coordinate adds to the key
        order = np.argpartition(score @ member.T, max(0, probes - 1), axis=2)[:, :, :probes]
        moved = change @ member.T.astype(np.int64)
        keys = np.concatenate([own[:, :, None], own[:, :, None] + np.take_along_axis(moved, order, 2)], axis=2)
    sketch = ((v @ planes) > 0) @ (np.int64(1) << np.arange(SKETCH, dtype=np.int64))
    return keys, sketch


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(df: DataFrame, vector: str, dim: int = DIM):
    """Vectors that take part: not NULL, ``dim`` numbers, all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0))


def _hash_rows(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy()
            v = _matrix(batch.column(1), index.dim)
            fp, first = np.unique(fp, return_index=True)  # copies within the batch
            v = v[first]
            norm = np.linalg.norm(v, axis=1)
            for lo in range(0, len(fp), 2048):
                part = slice(lo, lo + 2048)
                keys, sketch = buckets(index, v[part] / norm[part, None])
                n, t, p = keys.shape
                flag = np.zeros((n, t, p), dtype=np.int64)
                flag[:, :, 0] = 1  # 1: stored here, 0: a probe
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp[part], t * p)), pa.array((np.repeat(sketch, t * p) << 1) | flag.ravel())], names=["bucket", "fp", "sketch"])

    return run


def _meet(limit: int, hot: int | None = None):
    """``kind, a, b, c`` of sorted (bucket, fp, sketch): kind 0 are pairs (a, b) of fingerprints that meet in a
    bucket, stored with stored or probing, within the sketch distance; kind 1 the rows of buckets with more than
    ``hot`` rows, as they came, of which no pairs are made here."""

    def compare(b: np.ndarray, f: np.ndarray, s: np.ndarray):
        stored = (s & 1) == 1
        hb, hf, hs = b[stored], f[stored], s[stored] >> 1
        if not len(hb):
            return
        lo, hi = np.searchsorted(hb, b, "left"), np.searchsorted(hb, b, "right")
        count = hi - lo
        edges = np.unique(np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1_000_000, 1_000_000)))
        for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
            part = np.arange(x, y)
            c = count[part]
            right = np.repeat(part, c)
            left = np.repeat(lo[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            near = np.bitwise_count((hs[left] ^ (s[right] >> 1)).astype(np.uint64)) <= limit
            u, v = hf[left[near]], f[right[near]]
            different = u != v
            u, v = u[different], v[different]
            if len(u):
                yield np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_b = np.empty(0, np.int64)
        open_f, open_s, over = open_b, open_b, None

        def emit(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])

        def out(b, f, s):
            for x, y in compare(b, f, s):
                both = np.unique(np.stack([x, y], 1), axis=0)
                yield emit(0, both[:, 0], both[:, 1], np.zeros(len(both), np.int64))

        for batch in batches:
            b, f, s = (np.concatenate([o, batch.column(i).to_numpy()]) for i, o in enumerate((open_b, open_f, open_s)))
            if not len(b):
                continue
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]) | (f[1:] != f[:-1]) | (s[1:] != s[:-1])  # copies are neighbours
            b, f, s = b[new], f[new], s[new]
            if hot is not None:
                starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                sizes = np.diff(np.append(starts, len(b)))
                large = np.repeat((sizes > hot) | (b[starts] == over) if over is not None else sizes > hot, sizes)
                if large.any():
                    over = b[-1] if large[-1] else over
                    yield emit(1, b[large], f[large], s[large])
                    b, f, s = b[~large], f[~large], s[~large]
                    if not len(b):
                        open_b = open_f = open_s = np.empty(0, np.int64)
                        continue
            cut_at = int(np.searchsorted(b, b[-1], "left"))
            yield from out(b[:cut_at], f[:cut_at], s[:cut_at])
            open_b, open_f, open_s = b[cut_at:], f[cut_at:], s[cut_at:]
        yield from out(open_b, open_f, open_s)

    return run


def _tiles(rows: DataFrame, hot: int) -> DataFrame:
    """``bucket, fp, sketch`` of hot buckets, as buckets of their own for each pair of blocks. A block has about
    ``hot`` / 2 rows by the fingerprint's hash; a row goes to the tiles of its block with every other."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) * 2 / hot).cast("int").alias("_n"))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("_n")).cast("int")
    each = rows.join(sizes, "bucket").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return each.select(F.xxhash64("bucket", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("bucket"), "fp", "sketch")


def similar_pairs(df: DataFrame, *, group: str = "symbol_id", vector: str = "embedding", min_cosine: float = 0.9, index: Index | None = None) -> DataFrame:
    """``(<group>_a, <group>_b, cosine)``, a < b: pairs of different groups that have vectors with at least
    ``min_cosine``; the highest cosine of a pair counts.

    Unusable vectors (see :func:`usable`) are in no pair. Repeated rows, and several vectors of a group, are
    the same fingerprints and groups again; a NULL group is in no pair; other columns are ignored. Exact
    copies under many groups are listed as pairs here, because such a result is asked for only where groups
    have few partners; use :func:`links` for classes instead.
    """
    pairs, members = links(df, group=group, vector=vector, min_cosine=min_cosine, index=index)
    a, b = members.select(F.col("fp").alias("a"), F.col("g").alias("ga")), members.select(F.col("fp").alias("b"), F.col("g").alias("gb"))
    linked = pairs.join(a, "a").join(b, "b").where("ga != gb").select(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y"), "cosine")
    shared = members.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    some = members.join(shared, "fp", "left_semi")
    copies = some.alias("p").join(some.alias("q"), (F.col("p.fp") == F.col("q.fp")) & (F.col("p.g") < F.col("q.g"))).select(F.col("p.g").alias("x"), F.col("q.g").alias("y"), F.lit(1.0).alias("cosine"))
    return linked.unionByName(copies).groupBy("x", "y").agg(F.max("cosine").alias("cosine")).select(F.col("x").alias(f"{group}_a"), F.col("y").alias(f"{group}_b"), "cosine")


def links(df: DataFrame, *, group: str = "symbol_id", vector: str = "embedding", min_cosine: float = 0.9, index: Index | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: links ``(a, b, cosine)`` between the classes of distinct vectors, and the groups ``g``
    of every class ``fp``. A class is a struct of two hashes of the vector."""
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(vector).alias("v"))
    rows = usable(rows, "v", (index or Index()).dim).select("g", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    index = index or Index.fit(rows.count(), min_cosine)
    hashed = rows.select(F.col("h").alias("fp"), "v").mapInArrow(_hash_rows(index), "bucket long, fp long, sketch long")
    shape = "kind int, a long, b long, c long"
    in_order = lambda x: x.repartition("bucket").sortWithinPartitions("bucket", "fp", "sketch")
    met = cut(in_order(hashed).mapInArrow(_meet(index.hamming, hot), shape).distinct())
    over = met.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("fp"), F.col("c").alias("sketch"))
    near = met.where("kind = 0").select("a", "b")
    if over.take(1):
        near = cut(near.unionByName(in_order(_tiles(over, hot)).mapInArrow(_meet(index.hamming), shape).select("a", "b")).distinct())
    members = rows.select(F.struct("h", "h2").alias("fp"), "g").distinct()
    wanted = near.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    vectors = rows.select("h", "h2", "v").join(wanted, "h", "left_semi").dropDuplicates(["h", "h2"])
    side = lambda n: vectors.select(F.col("h").alias(n), F.col("h2").alias(f"{n}2"), F.col("v").alias(f"v{n}"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    dim = index.dim

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(4), dim), _matrix(batch.column(5), dim)
            cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            keep = pa.array(cosine >= min_cosine)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(keep) for i in range(4)], pa.array(cosine).filter(keep)], names=["a", "a2", "b", "b2", "cosine"])

    found = both.select("a", "a2", "b", "b2", "va", "vb").mapInArrow(exact, "a long, a2 long, b long, b2 long, cosine double")
    name = lambda n: F.struct(F.col(n).alias("h"), F.col(f"{n}2").alias("h2")).alias(n)
    return found.select(name("a"), name("b"), "cosine"), members


def brute_force(ids: np.ndarray, vectors: np.ndarray, min_cosine: float) -> set[tuple[int, int]]:
    """All pairs of different ids, for tests."""
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= min_cosine, 1))
    return {(min(a, b), max(a, b)) for a, b in zip(ids[i].tolist(), ids[j].tolist()) if a != b}


__all__ = ["Index", "brute_force", "buckets", "links", "similar_pairs", "usable"]
