"""Vector retrieval: brute force over all vectors, best chunk per symbol, top k."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.vector import clamp, dot

#: Query vectors that every task holds; more are cut into blocks of about so many. Up to MATRICES blocks are sent to
#: where the vectors lie.
MAX_QUERIES, MATRICES = 10_000, 16
#: Vectors that are multiplied at a time, most cosines of them, candidates that are held, and rows that are handed on at a time.
BLOCK, CELLS, KEPT, ROWS = 4096, 1 << 23, 1 << 20, 10_000
#: Decimals of a cosine; further ones depend on how a batch was multiplied, and equal vectors must tie.
DIGITS = 9
LINES = ["symbol_id", "chunk_index", "start_line", "end_line"]


class _Best:
    """The k best symbols of each query so far, by their best chunk. Column ``at`` of the batches holds the vectors,
    the columns before it the lines."""

    def __init__(self, sides: dict[int, tuple[np.ndarray, np.ndarray]], at: int, min_cosine: float, k: int):
        self.at, self.k = at, k
        self.sides = {dim: (ids, q, np.full(len(ids), float(min_cosine)), []) for dim, (ids, q) in sides.items()}

    def take(self, batch: pa.RecordBatch) -> None:
        sizes = pc.fill_null(pc.list_value_length(batch.column(self.at)), -1).to_numpy()
        for dim, (_, q, least, held) in self.sides.items():
            places = np.flatnonzero(sizes == dim)
            step = max(1, min(BLOCK, CELLS // max(1, len(q))))
            for lo in range(0, len(places), step):
                some = batch.take(pa.array(places[lo : lo + step]))
                v = some.column(self.at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                cosine = v @ q.T
                np.clip(cosine, 0.0, 1.0, out=cosine)
                i, j = np.nonzero(cosine >= least - 10.0**-DIGITS)  # NaN is never above
                c = np.round(cosine[i, j], DIGITS)
                near = c >= least[j]
                i, j, c = i[near], j[near], c[near]
                if len(i):
                    lines = [pc.fill_null(some.column(n), -1).to_numpy()[i] for n in range(self.at - 4, self.at)]
                    empty = [some.column(n).is_null().to_numpy(zero_copy_only=False)[i] for n in range(self.at - 4, self.at)]
                    held.append((j, c, np.array(lines), np.array(empty)))
                if sum(len(x[0]) for x in held) > max(KEPT, 4 * self.k * len(q)):
                    self._cut(least, held)

    def _cut(self, least: np.ndarray, held: list) -> None:
        """Keeps the best ones, and lets what does not reach a query's k-th cosine be skipped from now on."""
        if not held:
            return
        j, c, lines, empty = (np.concatenate([x[n] for x in held], axis=-1) for n in range(4))
        symbol, part, start = lines[:3]
        order = np.lexsort((part, start, -c, symbol, j))  # best chunk of each symbol
        order = order[np.concatenate([[True], (j[order][1:] != j[order][:-1]) | (symbol[order][1:] != symbol[order][:-1])])]
        order = order[np.lexsort((symbol[order], -c[order], j[order]))]
        begin = np.concatenate([[True], j[order][1:] != j[order][:-1]])
        place = np.arange(len(order)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
        last = order[place == self.k - 1]
        least[j[last]] = np.maximum(least[j[last]], c[last])
        order = order[place < self.k]
        held[:] = [(j[order], c[order], lines[:, order], empty[:, order])]

    def rows(self, query: str) -> Iterator[pa.RecordBatch]:
        for ids, _, least, held in self.sides.values():
            self._cut(least, held)
            for j, c, lines, empty in held:
                for lo in range(0, len(j), ROWS):
                    x = slice(lo, lo + ROWS)
                    columns = [pa.array(a[x], mask=b[x]) for a, b in zip(lines, empty)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j[x]]), *columns, pa.array(c[x])], names=[query, *LINES, "cosine"])


def _sides(rows: Iterable[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of query vectors, by their length."""
    by_dim: dict[int, tuple[list, list]] = {}
    for q, vec in rows:
        ids, vecs = by_dim.setdefault(len(vec), ([], []))
        ids.append(q)
        vecs.append(vec)
    return {d: (np.array(ids), np.array(vecs, dtype=np.float64)) for d, (ids, vecs) in by_dim.items()}


def vector_leg(vectors: DataFrame, queries: DataFrame, *, min_cosine: float = 0.40, k: int = 50, query: str = "query_id") -> DataFrame:
    """``query, symbol_id, chunk_index, start_line, end_line, cosine, rank``.

    Dot products are clamped to [0, 1]; vectors of another length, NULL or with NaN are skipped; the gate is
    inclusive. Of a symbol's chunks the best counts, on ties the one that starts first. ``queries`` holds
    ``query`` and ``vec``. Up to MAX_QUERIES of them go to every task as one matrix; of more, each block meets all
    vectors, which are read again for up to MATRICES blocks, and copied to the blocks if there are more. Each task keeps at most k rows per query, so what is shuffled grows neither
    with the gate nor with the number of vectors.
    """
    asked = queries.select(query, "vec").where("vec is not null")
    kind = dict(queries.dtypes)[query]
    shape = f"{query} {kind}, symbol_id long, chunk_index long, start_line long, end_line long, cosine double"
    stored = vectors.select(*LINES, "embedding")
    rows = asked.limit(MAX_QUERIES * MATRICES + 1).toArrow()
    if rows.num_rows <= MAX_QUERIES * MATRICES:

        def against(some: pa.Table) -> DataFrame:
            sides = vectors.sparkSession.sparkContext.broadcast(_sides(zip(*(c.to_pylist() for c in some.columns))))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = _Best(sides.value, 4, min_cosine, k)
                for batch in batches:
                    best.take(batch)
                yield from best.rows(query)

            return stored.mapInArrow(run, shape)

        scored = reduce(DataFrame.unionByName, [against(rows.slice(lo, MAX_QUERIES)) for lo in range(0, max(1, rows.num_rows), MAX_QUERIES)])
    else:
        blocks = -(-asked.count() // MAX_QUERIES)
        splits = max(1, vectors.sparkSession.sparkContext.defaultParallelism // blocks)
        tile = lambda block, split: (F.pmod(block, F.lit(blocks)) * splits + F.pmod(split, F.lit(splits))).alias("_tile")
        all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        none = [F.lit(None).cast("long").alias(c) for c in LINES]
        left = asked.withColumn("_s", all_of(splits)).select(tile(F.xxhash64(query), F.col("_s")), F.lit(0).alias("_kind"), query, F.col("vec").cast("array<double>").alias("vec"), *none, F.lit(None).cast("array<float>").alias("embedding"))
        right = stored.withColumn("_b", all_of(blocks)).select(tile(F.col("_b"), F.xxhash64("symbol_id", "chunk_index")), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias(query), F.lit(None).cast("array<double>").alias("vec"), *LINES, F.col("embedding").cast("array<float>").alias("embedding"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, got, best = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                t, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edges = [0, *(1 + np.flatnonzero((t[1:] != t[:-1]) | (what[1:] != what[:-1]))).tolist(), len(t)]
                for lo, hi in zip(edges, edges[1:]):
                    if t[lo] != held:
                        if best is not None:
                            yield from best.rows(query)
                        held, got, best = t[lo], [], None
                    part = batch.slice(lo, hi - lo)
                    if what[lo] == 0:
                        got += zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                    elif got:
                        best = _Best(_sides(got), 8, min_cosine, k) if best is None else best
                        best.take(part)
            if best is not None:
                yield from best.rows(query)

        scored = left.unionByName(right).repartition("_tile").sortWithinPartitions("_tile", "_kind").mapInArrow(meet, shape)
    one = Window.partitionBy(query, "symbol_id").orderBy(F.col("cosine").desc(), "start_line", "chunk_index")
    best = scored.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("cosine").desc(), "symbol_id"))).where(F.col("rank") <= k)
    return ranked.select(query, *LINES, "cosine", "rank")


def similarity(vectors: DataFrame, vec: list[float]) -> DataFrame:
    """Native form for one query vector: the clamped dot product as a column."""
    return vectors.withColumn("cosine", clamp(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vec]))))


class Encoder:
    """Turns texts into unit vectors. ``load`` returns a function from a list of texts to a matrix; it is
    called once per Python worker. ``prefix`` goes before queries only."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, prefix: str = "", batch: int = 16):
        self.load, self.dim, self.prefix, self.batch = load, dim, prefix, batch
        self._model = None

    def encode(self, df: DataFrame, text: str = "embed_text", out: str = "embedding") -> DataFrame:
        """NULL text has no vector; a text the model fails on gets NULL, so it stays pending."""
        load, batch = self.load, self.batch

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in parts:
                got: list = [None] * len(s)
                at = [i for i, t in enumerate(s) if t is not None]
                for lo in range(0, len(at), batch):
                    block = at[lo : lo + batch]
                    try:
                        v = np.asarray(model([s.iloc[i] for i in block]), dtype=np.float64)
                    except Exception:  # noqa: BLE001 - a failing batch stays pending
                        continue
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    for i, row in zip(block, v):
                        got[i] = row.astype(np.float32)
                yield pd.Series(got, index=s.index, dtype=object)

        return df.withColumn(out, run(F.col(text)))

    def encode_query(self, text: str) -> list[float]:
        if self._model is None:
            self._model = self.load()  # once per driver
        v = np.asarray(self._model([self.prefix + text]), dtype=np.float64)[0]
        return (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()


def verify_model(model_dir: str, expected: dict[str, tuple[str, int]]) -> None:
    """Raises ValueError unless every file of ``expected`` has the given SHA-256 and length."""
    for name, (digest, size) in expected.items():
        path = os.path.join(model_dir, name)
        if not os.path.isfile(path) or os.path.getsize(path) != size:
            raise ValueError(f"{name} is missing or has another length")
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != digest.lower():
                raise ValueError(f"{name} has another checksum")


@dataclass(frozen=True)
class ModelSpec:
    """A model's files with their SHA-256 and length, its dimension, and what goes before queries."""

    dim: int
    files: dict[str, tuple[str, int]]
    model: str = "model_quantized.onnx"
    query_prefix: str = ""


# Public models and the artifacts they are pinned to.
MODELS = {
    "all-MiniLM-L6-v2": ModelSpec(
        384,
        {
            "model_quantized.onnx": ("afdb6f1a0e45b715d0bb9b11772f032c399babd23bfc31fed1c170afc848bdb1", 22_972_370),
            "tokenizer.json": ("da0e79933b9ed51798a3ae27893d3c5fa4a201126cef75586296df9b4d2c62a0", 711_661),
            "config.json": ("7135149f7cffa1a573466c6e4d8423ed73b62fd2332c575bf738a0d033f70df7", 650),
        },
    ),
    "bge-small-en-v1.5": ModelSpec(
        384,
        {
            "model_quantized.onnx": ("6c9c6101a956d62dfb5e7190c538226c0c5bb9cb27b651234b6df063ee7dbfe4", 34_014_426),
            "tokenizer.json": ("d241a60d5e8f04cc1b2b3e9ef7a4921b27bf526d9f6050ab90f9267a1f9e5c66", 711_396),
            "config.json": ("fa73f90bf92c8cace1fbcb709626306f2bdbc9ea3e5b5f94b440df9b6aa56350", 683),
        },
        query_prefix="Represent this sentence for searching relevant passages: ",
    ),
}
ACTIVE_MODEL = "all-MiniLM-L6-v2"


def model_encoder(models: str, name: str = ACTIVE_MODEL, registry: dict[str, ModelSpec] = MODELS) -> Encoder:
    """The encoder of a registered model whose verified files lie in ``<models>/<name>``."""
    spec, place = registry[name], os.path.join(models, name)
    verify_model(place, spec.files)
    return Encoder(onnx_loader(place, model=spec.model), spec.dim, spec.query_prefix)


def onnx_loader(model_dir: str, max_tokens: int = 512, threads: int = 2, model: str = "model.onnx") -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Loads ``model`` and ``tokenizer.json`` of a directory; mean-pools token vectors under the mask."""

    def load():
        import onnxruntime as ort
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(f"{model_dir}/tokenizer.json")
        tokenizer.enable_truncation(max_tokens)
        tokenizer.enable_padding()
        options = ort.SessionOptions()
        options.intra_op_num_threads, options.inter_op_num_threads, options.enable_mem_pattern = threads, 1, False
        session = ort.InferenceSession(f"{model_dir}/{model}", options)
        names = {i.name for i in session.get_inputs()}

        def run(texts: list[str]) -> np.ndarray:
            enc = tokenizer.encode_batch(texts)
            feed = {"input_ids": np.array([e.ids for e in enc], np.int64), "attention_mask": np.array([e.attention_mask for e in enc], np.int64), "token_type_ids": np.array([e.type_ids for e in enc], np.int64)}
            tokens = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
            return pool(tokens, feed["attention_mask"])

        return run

    return load


def pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    m = (mask > 0)[:, :, None]
    return (tokens * m).sum(1) / np.maximum(m.sum(1), 1)
