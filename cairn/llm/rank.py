"""One ranking from several differently-scaled scores, by leximin order over percentiles.

Each score becomes its percentile within the group (query), so no scale or outlier decides alone. An item's
own percentiles are sorted ascending and the arrays compared lexicographically, best first: the item whose
weakest score is stronger comes first, so a weak score cannot be masked by a strong one. A score an item does
not have is no element of its array; arrays are padded with 1, the neutral element of the minimum.

Ranks are spread by sorting: rows, or the distinct values of a score with their counts, are put into ranges of the
whole order, which a sample of it lays out, and one small row per group and range carries what lies below. A
group that holds a third of all rows, and rows that tie down to their keys, are thus ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import broadcast_checked, cut


def running(df: DataFrame, group: list[str], order: list[Column], amount: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``amount`` over the rows of the group before the row, and ``_all``, the group's
    sum. ``df`` is sorted into ranges of (group, order), pinned by a checkpoint; ``order`` must be total."""
    by = [F.col(g) for g in group]
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id()).withColumn("_upto", F.col(amount).cast("long"))
    at = ranged.columns.index("_upto")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = 0
        for batch in batches:
            n = batch.column(at).to_numpy()
            total = carried + np.cumsum(n)
            carried = int(total[-1]) if len(n) else carried
            yield batch.set_column(at, "_upto", pa.array(total - n))

    pinned = cut(ranged.mapInArrow(add_up, ranged.schema))
    parts = pinned.groupBy(*group, "_part").agg(F.min("_upto").alias("_first"), F.sum(amount).alias("_n"))
    w = Window.partitionBy(*group)
    below = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "_part", "_first", below.alias("_below"), F.sum("_n").over(w).alias("_all"))
    return pinned.join(broadcast_checked(parts), [*group, "_part"]).withColumn(out, F.col("_below") + F.col("_upto") - F.col("_first")).drop("_part", "_upto", "_first", "_below")


def percentiles(df: DataFrame, group: str, key: str, scores: dict[str, Column]) -> DataFrame:
    """``(key, _p)``: a map from each score's name to its mid-rank percentile within the group, without those that
    are missing.

    Ties share the middle of their ranks; NaN and NULL are missing; a group of one, or one whose values are
    all equal, gets 0.5. Ranks are those of distinct values, counted map-side, so ties are one row.
    """
    clean = [F.when(~F.isnan(c.cast("double")), c.cast("double")) for c in scores.values()]
    long = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.posexplode(F.array(*clean)).alias("m", "v")).where(F.col("v").isNotNull())
    values = running(long.groupBy("g", "m", "v").agg(F.count(F.lit(1)).alias("n")), ["g", "m"], [F.col("v")], "n", "less")
    p = F.when(F.col("_all") > 1, (F.col("less") + (F.col("n") - 1) / 2) / (F.col("_all") - 1)).otherwise(F.lit(0.5))
    name = F.element_at(F.array(*[F.lit(n) for n in scores]), F.col("m") + 1)
    scored = long.join(values.select("g", "m", "v", p.alias("p")), ["g", "m", "v"])
    return scored.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(name, "p"))).alias("_p")).withColumnRenamed("k", key)


def leximin(df: DataFrame, group: str, key: str, scores: dict[str, Column], *, weights: dict[str, Column] | None = None, last: list[Column] | None = None, out: str = "position") -> DataFrame:
    """``df`` with ``vector`` (weighted percentiles, ascending) and ``out`` (1 is best within the group).

    A weight w turns a percentile p into p**w: 0 takes the score out, more than 1 makes it bind sooner. Equal
    vectors are ordered by ``last`` (descending) and then by ``key``, so positions are total. Rows with the
    same key are repeats and count once, rows without key are left out; rows whose group is NULL form one
    group; an item without any score
    has an empty vector and comes last. Columns of the input pass through; ``vector``, ``out`` and names
    starting with ``_`` are replaced.
    """
    df = df.drop("vector", out).where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    df = df.join(percentiles(df, "_g", key, scores), key, "left")
    weight = lambda n: (weights or {}).get(n, F.lit(1.0))
    values = [F.when(weight(n) > 0, F.pow(F.try_element_at("_p", F.lit(n)), weight(n))) for n in scores]
    df = df.withColumn("vector", F.sort_array(F.array_compact(F.array(*values)))).drop("_p")
    padded = F.concat("vector", F.array_repeat(F.lit(1.0), F.lit(len(scores)) - F.size("vector")))
    df = df.withColumn("_pad", F.when(F.size("vector") > 0, padded).otherwise(F.array_repeat(F.lit(-1.0), len(scores)))).withColumn("_one", F.lit(1))
    order = [F.col("_pad").desc(), *[c.desc_nulls_last() for c in last or []], F.col(key).asc()]
    return running(df, ["_g"], order, "_one", out).withColumn(out, (F.col(out) + 1).cast("long")).drop("_pad", "_one", "_g", "_all")


def fuse_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One order of each query's hits from cosine, bm25 (lower is better), score and boost.

    The arrays hold the percentiles of cosine, bm25 and score under the query's w_vector and w_bm25. The
    boost is an additive adjustment that most hits do not have: as an element it would be the minimum of
    every unboosted hit and mask the rest, so it orders hits with equal arrays. ``evidence`` tells which
    scores exist (hybrid, semantic, lexical or none), whatever match_type claims. Hits of unknown queries
    get weight 1.
    """
    weights = queries.dropDuplicates(["query_id"]).select("query_id", F.col("w_vector").alias("_wv"), F.col("w_bm25").alias("_wb"))
    h = hits.select("hit_id", "query_id", "symbol_id", "match_type", "score", "cosine", "bm25", "boost").join(weights, "query_id", "left")
    one = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(1.0))
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    scores = {"cosine": F.col("cosine"), "bm25": -F.col("bm25"), "score": F.col("score")}
    got = leximin(h, "query_id", "hit_id", scores, weights={"cosine": one(F.col("_wv")), "bm25": one(F.col("_wb"))}, last=[F.col("boost")])
    evidence = F.when(real("cosine") & real("bm25"), "hybrid").when(real("cosine"), "semantic").when(real("bm25"), "lexical").otherwise("none")
    return got.select("query_id", "hit_id", "symbol_id", "position", "vector", evidence.alias("evidence"))
