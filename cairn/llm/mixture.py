"""Mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks.

The mixture is as large as is asked, or as the sources allow: the source that runs out first, at its
``max_repeats``, sets the largest size. Blocks of equal tokens are dealt to sources by the highest quotients share / (2 s + 1), then each
source's blocks to its shards the same way, by their tokens. Within a shard records come in a seeded order:
whole passes first, then records until the shard's quota is reached. Shards are hash ranges of the record
key, as many per source as it has SHARD_RECORDS records, or more records each where the whole would be over
MAX_CELLS / 2 shards; so a source with most of the data is selected by many tasks, and one small row per
(source, shard) reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.encode import TOKENIZERS, count_udf
from cairn.session import broadcast_checked, cut

BLOCK_TOKENS, SEED = 256, 20250301
#: Records of a shard, at least.
SHARD_RECORDS = 512
#: Bound on (source, shard) rows that reach the driver; more targets with records than half of it are refused.
MAX_CELLS = 200_000


def sainte_lague(weights: dict, seats: int, capacity: dict | None = None) -> dict:
    """``seats`` dealt by the highest quotients weight / (2 s + 1); ``capacity`` stops a party. Ties go to
    the smaller key. Everybody's standard share is handed out first where no quotient can undercut it."""
    total = sum(w for w in weights.values() if w > 0)
    got = {k: 0 for k in weights}
    if total <= 0 or seats <= 0:
        return got
    cap = capacity or {}
    for k, w in weights.items():  # floor minus one is always won under Sainte-Lague's rounding
        if w > 0:
            got[k] = min(max(0, int(seats * w / total) - len(weights)), cap.get(k, seats))
    heap = [(-w / (2 * got[k] + 1), str(k), k) for k, w in weights.items() if w > 0 and got[k] < cap.get(k, seats)]
    heapq.heapify(heap)
    left = seats - sum(got.values())
    while left > 0 and heap:
        _, name, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < cap.get(k, seats):
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), name, k))
    return got


def plan(cells: list, targets: list, block_tokens: int, size_tokens: int | None = None) -> tuple[list, list]:
    """Quotas in tokens per (source, shard), and per source its target, reachable size and blocks."""
    size, shards = {}, {}
    for source, shard, tokens in cells:
        size[source] = size.get(source, 0) + tokens
        shards.setdefault(source, {})[shard] = tokens
    goal = {s: (share, max(0, int(rep))) for s, share, rep in targets if s is not None and share is not None and share > 0 and rep is not None}
    live = {s: g for s, g in goal.items() if size.get(s, 0) > 0 and g[1] > 0}
    if not live:
        return [], [(s, share, size.get(s, 0), rep, 0) for s, (share, rep) in goal.items()]
    scale = sum(share for share, _ in live.values())
    total = min(size[s] * rep / (share / scale) for s, (share, rep) in live.items())
    total = min(total, size_tokens) if size_tokens is not None else total
    block = max(1, min(block_tokens, int(total / (20 * len(live))) or 1))
    blocks = sainte_lague({s: share for s, (share, _) in live.items()}, int(total // block), {s: size[s] * rep // block for s, (_, rep) in live.items()})
    quotas = []
    for s, n in blocks.items():
        for shard, m in sainte_lague(shards[s], n, {k: t * live[s][1] // block + 1 for k, t in shards[s].items()}).items():
            quotas.append((s, shard, min(m * block, shards[s][shard] * live[s][1]), shards[s][shard]))
    return quotas, [(s, share, size.get(s, 0), rep, blocks.get(s, 0) * block) for s, (share, rep) in goal.items()]


def normal_source(c):
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", block_tokens: int = BLOCK_TOKENS, size_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(records, report)`` of the mixture.

    records: key, source (trimmed, lower case), tokens, copies (1 to max_repeats). report: per target source
    its target share, the share asked of the live sources, tokens available, tokens used and the share
    reached. ``size_tokens`` asks for a size; without it, or where the sources do not allow it, the mixture is
    as large as they do. Records without text, tokens or a targeted source take no part; a target without
    records is reported with share 0 and its weight falls to the others in proportion; repeated rows count
    once; empty tables give an empty mixture. More live targets than MAX_CELLS / 2 raise ValueError.
    """
    d = docs.select(F.col(key).alias("k"), normal_source(F.col(source)).alias("source"), F.col(text).alias("t")).where(F.col("source").isNotNull() & F.col("t").isNotNull() & F.col("k").isNotNull())
    sized = d.select("k", "source", count_udf(tokenizers, name)(F.col("t")).alias("tokens")).where("tokens > 0").dropDuplicates(["k"])
    sized = cut(sized)  # narrow rows; the texts are encoded once
    goals = cut(targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"]))
    counts = broadcast_checked(sized.groupBy("source").count().join(broadcast_checked(goals.select("source")), "source", "left_semi"), MAX_CELLS // 2)
    n, live = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    if live > MAX_CELLS // 2:
        raise ValueError(f"more than {MAX_CELLS // 2} sources with records are targeted")
    each = max(SHARD_RECORDS, -(-n * 2 // MAX_CELLS))  # at most MAX_CELLS / 2 shards and one more for each source
    sized = sized.join(counts.select("source", F.ceil(F.col("count") / each).alias("_shards")), "source")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("k", F.lit(seed)), F.col("_shards")).cast("int")).drop("_shards")
    cells = sized.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"))
    rows = cells.collect()  # at most MAX_CELLS
    wanted = goals.join(counts.select("source"), "source", "left_semi").collect()  # at most MAX_CELLS / 2
    quotas, report = plan(sorted((r["source"], r["shard"], r["tokens"]) for r in rows), sorted(tuple(r) for r in wanted), block_tokens, size_tokens)
    spark = docs.sparkSession
    quota = spark.createDataFrame(quotas, T.StructType.fromDDL("source string, shard int, quota long, size long"))
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64("k", F.lit(seed + 1)), "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (
        sized.join(F.broadcast(quota), ["source", "shard"])  # at most MAX_CELLS rows
        .withColumn("upto", F.sum("tokens").over(w))
        .withColumn("rest", F.col("quota") - F.floor(F.col("quota") / F.col("size")) * F.col("size"))
        .withColumn("copies", (F.floor(F.col("quota") / F.col("size")) + F.when(F.col("upto") - F.col("tokens") / 2 < F.col("rest"), 1).otherwise(0)).cast("int"))
        .where("copies > 0")
    )
    records = picked.select(F.col("k").alias(key), "source", "tokens", "copies")
    sizes = spark.createDataFrame([r[:1] + r[2:3] for r in report], T.StructType.fromDDL("source string, available_tokens long"))
    asked = goals.where((F.col("target_share") > 0) & F.col("max_repeats").isNotNull()).select("source", F.col("target_share").cast("double").alias("target_share"), F.greatest(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats")).join(sizes, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0).cast("long")))
    used = records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    total = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy())  # one row per target
    shares = asked.join(used, "source", "left").select("source", "target_share", "available_tokens", "max_repeats", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.when(total > 0, F.coalesce("used_tokens", F.lit(0)) / total).otherwise(0.0), 6).alias("reached_share"))
    return records, shares
