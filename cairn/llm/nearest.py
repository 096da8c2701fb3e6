"""The k most similar vectors for a stated set of query vectors, by multiprobe p-stable hashing in blocks.

Vectors whose neighbours are hardly closer than chance need coarse buckets and many probes. Tables of few
p-stable functions cut the vectors into cells of some thousand rows. A query visits the occupied cells of
every table in the order of their estimated success, the distance between its projections and the cell, up
to the distance within which a neighbour as close as the k-th is expected to be lies with the wanted
probability; the number of tables is that for which the fewest rows are visited. Queries and vectors of a cell
meet sorted in one stream and are compared as matrices, exactly; the candidates of all cells and tables are
merged, and the best k remain.

Every occupied cell is its own bucket. Where there are more than MAX_CELLS the last function of each table is
left out, which joins cells, until there are not, so what the driver and the tasks hold of the index is bounded
and no row is left aside. A cell's queries and rows are cut into tiles of at most about QUERY_BLOCK by ROW_BLOCK,
so neither a hot cell nor many queries make a large group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.neighbours import DIM, _matrix, usable
from cairn.session import cut

#: Rows a cell should hold at least, cells that one more function makes of one, and the most cells of all tables.
CELL_ROWS, FANOUT, MAX_CELLS = 512, 3.6, 1 << 18
#: Queries and rows of a tile, and queries that are compared at a time.
QUERY_BLOCK, ROW_BLOCK, BLOCK = 1 << 16, 1 << 16, 1024
#: Share of the k nearest that the reach is laid out for.
RECALL = 0.98


def expected_cosine(n: int, k: int, dim: int) -> float:
    """Cosine that k of n random unit vectors are expected to reach: the (1 - k/n) quantile for that dimension."""
    x = np.linspace(-1, 1, 20001)
    density = np.clip(1 - x * x, 0, None) ** ((dim - 3) / 2)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(x[np.searchsorted(-above, -min(0.5, k / max(n, 2 * k)))])


@dataclass(frozen=True)
class Coarse:
    dim: int
    functions: int
    width: float
    reach: float
    tables: int = 1
    seed: int = 11

    def projections(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per table orthogonal directions and offsets; with fewer functions the first ones."""
        out = []
        for t in range(self.tables):
            rng = np.random.default_rng(self.seed + t)
            q, _ = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))
            out.append((q[:, : self.functions] * math.sqrt(self.dim) / self.width, rng.uniform(size=self.dim)[: self.functions]))
        return out

    @staticmethod
    def fit(n: int, k: int, queries: int = 0, *, dim: int = DIM, recall: float = RECALL, width: float = 2.0, seed: int = 11) -> Coarse:
        """Functions by the number of rows, and so that the copies of the queries, one for each cell, are about as
        many as the rows; tables and reach by random pairs as close as the k-th neighbour is expected, and by pairs
        that are unrelated: of 1, 2 and 4 tables those that visit the fewest rows."""
        cells = max(2.0, min(n / CELL_ROWS, n / max(1, queries)))
        functions = max(1, min(dim, math.floor(math.log(cells) / math.log(FANOUT))))
        c = expected_cosine(n, k, dim)
        rng = np.random.default_rng(seed)
        v, g = rng.normal(size=(20000, dim)), rng.normal(size=(20000, dim))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        g /= np.linalg.norm(g, axis=1, keepdims=True)
        h = g - (g * v).sum(1, keepdims=True) * v
        w = c * v + math.sqrt(1 - c * c) * h / np.linalg.norm(h, axis=1, keepdims=True)
        a, b = Coarse(dim, functions, width, 0.0, 1, seed).projections()[0]
        f = v @ a + b
        close, far = distance(f, np.floor(w @ a + b)), distance(f, np.floor(g @ a + b))
        best = None
        for tables in (1, 2, 4):
            reach = float(np.quantile(close, 1 - (1 - recall) ** (1 / tables)))
            cost = tables * float(np.mean(far <= reach))
            if best is None or cost < best[0]:
                best = (cost, tables, reach)
        return Coarse(dim, functions, width, best[2], best[1], seed)


def distance(f: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Squared distance of projections to cells, row by row."""
    return (np.maximum(0, np.maximum(cell - f, f - cell - 1)) ** 2).sum(-1)


def visited(f: np.ndarray, cells: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """``(query, cell)`` places within reach, the squared distance summed up function by function."""
    total = np.zeros((len(f), len(cells)))
    for j in range(f.shape[1]):
        x, lo = f[:, j, None], cells[None, :, j]
        total += np.maximum(0, np.maximum(lo - x, x - lo - 1)) ** 2
    return np.nonzero(total <= reach)


def _spread(g: np.ndarray, i: np.ndarray) -> np.ndarray:
    """A hash of group and item that does not follow their order."""
    with np.errstate(over="ignore"):
        x = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + i.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)


def nearest(df: DataFrame, queries: DataFrame, *, k: int = 10, group: str = "symbol_id", item: str = "chunk_index", vector: str = "embedding", index: Coarse | None = None) -> DataFrame:
    """``<group>, <item>, rank, neighbour_<group>, neighbour_<item>, cosine`` for every usable query vector.

    Neighbours are vectors of other groups; ties are ordered by their group and item. Repeated rows count
    once; unusable vectors are neither queries nor neighbours; fewer than k rows come out where fewer
    vectors of other groups exist. NULL groups take no part.
    """
    dim = index.dim if index else DIM
    spark = df.sparkSession
    clean = lambda x: usable(x.where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("i"), F.col(vector).alias("v")), "v", dim).dropDuplicates(["g", "i"])
    base, asked = clean(df), clean(queries)
    n_queries = asked.count()
    index = index or Coarse.fit(base.count(), k, n_queries, dim=dim)

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        v = _matrix(batch.column(2), dim)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def cells_of(ix: Coarse):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = ix.projections()
            for batch in batches:
                if batch.num_rows:
                    u = unit(batch)
                    for t, (a, b) in enumerate(tables):
                        at, n = np.unique(np.floor(u @ a + b).astype(np.int16), axis=0, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at.tolist(), pa.list_(pa.int16())), pa.array(n)], names=["t", "cell", "n"])

        return run

    occupied = cut(base.mapInArrow(cells_of(index), "t int, cell array<smallint>, n long").groupBy("t", "cell").agg(F.sum("n").alias("n")))
    while index.functions > 1 and occupied.count() > MAX_CELLS:
        index = replace(index, functions=index.functions - 1)
        occupied = cut(occupied.groupBy("t", F.slice("cell", 1, index.functions).alias("cell")).agg(F.sum("n").alias("n")))
    held = sorted((r["t"], tuple(r["cell"]), r["n"]) for r in occupied.collect())  # at most MAX_CELLS
    rows_of = np.array([n for _, _, n in held], dtype=np.int64)
    first = [next((j for j, x in enumerate(held) if x[0] == t), len(held)) for t in range(index.tables)] + [len(held)]
    tables = spark.sparkContext.broadcast([np.array([c for _, c, _ in held[lo:hi]], dtype=np.int16).reshape(hi - lo, index.functions) for lo, hi in zip(first, first[1:])])

    def probes(u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t, (a, b) in enumerate(index.projections()):
            cells, f = tables.value[t], u @ a + b
            step = max(1, (1 << 22) // max(1, len(cells)))
            for lo in range(0, len(f), step):
                at, c = visited(f[lo : lo + step], cells, index.reach)
                yield at + lo, c + first[t]

    def count_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = sum((np.bincount(c, minlength=first[-1]) for _, c in probes(unit(batch))), np.zeros(first[-1], np.int64))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["c", "n"])

    blocks, splits = np.ones(len(held), np.int64), np.maximum(1, -(-rows_of // ROW_BLOCK))
    if n_queries > QUERY_BLOCK:
        for r in asked.mapInArrow(count_probes, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # at most MAX_CELLS
            blocks[r["c"]] = -(-r["n"] // QUERY_BLOCK)
    tiles = spark.sparkContext.broadcast((blocks, splits, np.concatenate([[0], np.cumsum(blocks * splits)])))

    def rows(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, splits, start = tiles.value
            projections = index.projections()
            known = [] if probe else [{tuple(c): j + lo for j, c in enumerate(cells.tolist())} for cells, lo in zip(tables.value, first)]

            def send(part: pa.RecordBatch, at: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
                """Each row to all tiles of its cell that it has to meet."""
                h = _spread(part.column(0).to_numpy(), part.column(1).to_numpy())[at]
                times = splits[c] if probe else blocks[c]
                j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, c, h = np.repeat(at, times), np.repeat(c, times), np.repeat(h, times)
                own = (h % (blocks[c] if probe else splits[c]).astype(np.uint64)).astype(np.int64)
                bucket = start[c] + (own * splits[c] + j if probe else j * splits[c] + own)
                return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(at), 0 if probe else 1, np.int32)), *part.take(pa.array(at)).columns], names=["bucket", "kind", "g", "i", "v"])

            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    u = unit(part)
                    if probe:
                        for at, c in probes(u):
                            if len(at):
                                yield send(part, at, c)
                    else:
                        for (a, b), cells in zip(projections, known):
                            c = np.array([cells[x] for x in map(tuple, np.floor(u @ a + b).astype(np.int16).tolist())], dtype=np.int64)
                            yield send(part, np.arange(len(u)), c)

        return run

    shape = "bucket long, kind int, g long, i long, v array<float>"
    both = asked.mapInArrow(rows(True), shape).unionByName(base.mapInArrow(rows(False), shape))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, vecs, best = None, None, None, None

        def flush():
            if best is not None and len(ids):
                cosine, g, i = best
                q, r = np.nonzero(cosine > -2)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q, 0], ids[q, 1], g[q, r], i[q, r], cosine[q, r])], names=["g", "i", "ng", "ni", "cosine"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            key = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
            v = _matrix(batch.column(4), dim)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            edges = [0, *(1 + np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]))).tolist(), len(bucket)]
            for lo, hi in zip(edges, edges[1:]):
                if bucket[lo] != held:
                    yield from flush()
                    held, ids, vecs, best = bucket[lo], np.empty((0, 2), np.int64), np.empty((0, dim)), None
                if kind[lo] == 0:
                    ids, vecs = np.concatenate([ids, key[lo:hi]]), np.concatenate([vecs, v[lo:hi]])
                    continue
                if not len(ids):
                    continue
                if best is None:
                    best = (np.full((len(ids), k), -3.0), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64))
                for at in range(0, len(ids), BLOCK):
                    s = slice(at, at + BLOCK)
                    cosine = np.round(vecs[s] @ v[lo:hi].T, 9)  # equal vectors tie, however a block is multiplied
                    cosine[ids[s, 0][:, None] == key[lo:hi, 0][None, :]] = -3.0
                    take = min(k, hi - lo)
                    top = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
                    c = np.concatenate([best[0][s], np.take_along_axis(cosine, top, 1)], 1)
                    g = np.concatenate([best[1][s], key[lo:hi, 0][top]], 1)
                    i = np.concatenate([best[2][s], key[lo:hi, 1][top]], 1)
                    keep = np.lexsort((i, g, -c), axis=1)[:, :k]
                    for b, x in zip(best, (c, g, i)):
                        b[s] = np.take_along_axis(x, keep, 1)
        yield from flush()

    found = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(meet, "g long, i long, ng long, ni long, cosine double")
    if index.tables > 1:  # a pair may meet in several tables
        found = found.groupBy("g", "i", "ng", "ni").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("g", "i").orderBy(F.col("cosine").desc(), "ng", "ni")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "rank", F.col("ng").alias(f"neighbour_{group}"), F.col("ni").alias(f"neighbour_{item}"), "cosine")


def recall(found: DataFrame, exact: DataFrame, *, group: str = "symbol_id", item: str = "chunk_index") -> DataFrame:
    """One row: ``queries, recall, below`` (the share of queries of whose exact neighbours less than nine in ten
    were found) of :func:`nearest` against an exhaustive search. A tie at the k-th place counts as found where
    the cosine is as high."""
    worst = exact.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
    hits = found.join(worst.select(group, item, "least"), [group, item]).where(F.col("cosine") >= F.col("least") - 1e-9).groupBy(group, item).agg(F.count(F.lit(1)).alias("hit"))
    each = worst.join(hits, [group, item], "left").select((F.least(F.coalesce("hit", F.lit(0)), F.col("n")) / F.col("n")).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg(F.when(F.col("r") < 0.9, 1.0).otherwise(0.0)), 6).alias("below"))


def exhaustive(dim: int = DIM) -> Coarse:
    """An index of one function whose reach holds every cell: the exact search, in the same tiles."""
    return Coarse(dim, 1, 2.0, math.inf)
