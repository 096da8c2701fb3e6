"""Live updates: file events, coalesced, applied to the store in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cairn.session import cut
from cairn.sources.workspace import WorkspaceSource
from cairn.store import Store, scan_records

DEBOUNCE = "1500 milliseconds"
EVENTS = "path string, status string, batch long"


def debounce(events: DataFrame, key: list[str], at: str, seconds: float = 1.5, *, watch: list[str] | None = None) -> DataFrame:
    """Events as a debounce hands them on: a batch begins with the first event after the last batch ended and takes
    all events of the next ``seconds``; of each key in a batch the last event stays.

    ``key, batch`` (the time of its first event), ``events`` (how many there were) and the last event's columns.
    Batches are those of each value of ``watch`` (default: of each key); one of them is read as a sorted stream
    in which only the current batch's beginning is kept, so it may be of any length. Events without a time are
    left out.
    """
    groups = key if watch is None else watch
    step = round(seconds * 1_000_000)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, t = batch.column(0), batch.column(1).to_numpy()
            other = pc.not_equal(owner.slice(1), owner.slice(0, len(owner) - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(1 + np.flatnonzero(other)).tolist(), len(t)]
            lengths, starts = [], []
            for lo, hi in zip(edges, edges[1:]):
                who, times = owner[lo].as_py(), t[lo:hi]
                at = 0
                while at < len(times):
                    if who != held or times[at] >= start + step:
                        held, start = who, int(times[at])
                    until = int(np.searchsorted(times, start + step))
                    lengths.append(until - at)
                    starts.append(start)
                    at = until
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(np.repeat(starts, lengths)), batch.column(3)], names=["_k", "_b", "_e"])

    rest = [c for c in events.columns if c not in key]
    some = events.where(F.col(at).isNotNull()).select(F.struct(*groups).alias("_w"), F.struct(*key).alias("_k"), F.unix_micros(F.col(at)).alias("_t"), F.struct(F.col(at), *[F.col(c) for c in rest if c != at]).alias("_e"))
    ordered = some.withColumn("_g", F.to_json("_w")).repartition("_g").sortWithinPartitions("_g", "_t").select("_g", "_t", "_k", "_e")
    fields = ordered.schema
    begun = ordered.mapInArrow(begin, StructType([fields["_k"], StructField("_b", LongType()), fields["_e"]]))
    last = begun.groupBy("_k", "_b").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("events"))
    return last.select("_k.*", F.timestamp_micros("_b").alias("batch"), "events", "_e.*")


def apply_batch(store: Store, i18n: Callable[[], DataFrame] | None = None, log: list | None = None):
    """The writer of a stream: deleted and unreadable paths go, others are indexed unless unchanged. A batch
    that is delivered again changes nothing. ``i18n`` is asked for the locale copy of the moment where a batch
    has anything to index."""

    def run(batch: DataFrame, number: int) -> None:
        last = cut(batch.groupBy("path").agg(F.max_by(F.struct("length", "mtime", "content"), "mtime").alias("f")).select("path", "f.*"))
        live, gone = last.where("length >= 0"), last.where("length < 0").select("path")
        done = store.apply(scan_records(live), gone=gone, i18n=i18n() if i18n is not None and live.take(1) else None)
        if log is not None:
            log.append({"batch": number, **done, "deleted": gone.count()})

    return run


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, *, once: bool = False, i18n: Callable[[], DataFrame] | None = None, log: list | None = None):
    """Starts the query that keeps ``store`` at the state of ``root``. The store lets in one writer at a time;
    micro-batches that arrive during a long one are coalesced into the next."""
    spark.dataSource.register(WorkspaceSource)
    stream = spark.readStream.format("cairn_workspace").option("path", root).option("state", f"{checkpoint}/tree").load()
    writer = stream.writeStream.foreachBatch(apply_batch(store, i18n, log)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
