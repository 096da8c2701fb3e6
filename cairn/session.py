"""Session helpers: table access, the shared checkpoint folder and sized broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is ever broadcast, in rows of a counted (bounded) frame.
BROADCAST_ROWS = 200_000


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster without a shared
    home pass it with ``--py-files`` instead."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, path]) if path else root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``; a file or a directory of part files."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent in a local session, as in tests, a folder of our own is used; a cluster
    without the setting is refused, because a machine's own folder is not shared.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not set_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
    sc.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unchanged (a shuffle join then)."""
    if len(df.limit(limit + 1).select(F.lit(1).alias("one")).take(limit + 1)) <= limit:
        return F.broadcast(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before costly Python work, if its input has fewer splits than there are cores.

    Only small inputs, or files that can't be split, are moved; a large table has more splits than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dedupe(df: DataFrame, *keys: str) -> DataFrame:
    """Repeated rows (full copies with the same key) count once."""
    return df.dropDuplicates(list(keys))
