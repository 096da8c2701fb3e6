"""Processing only new or changed records.

A run rereads its source from the *oldest transaction open at the last successful run* (its low
watermark), because a record that was committed while that run was reading may have been missed by it.
The reread overlaps what has been handled already; the overlap is removed by an anti-join of
``(key, version)`` pairs against a ledger of processed pairs. A run that fails commits nothing: neither
the watermark nor the ledger moves, so the next run covers its records again, exactly once.

* :func:`changed_since` - the batch of one run, against a ledger (production path);
* :class:`IncrementalLedger` - the ledger as snapshot directories behind an atomically replaced pointer;
* :func:`replay` - all runs of a history by the same steps (windows, latest versions, anti-join against the
  ledger that each run met) as one plan, without a driver loop.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import BROADCAST_ROWS

#: An unfinished transaction that began longer than this before a run is taken for dead, in seconds.
PATIENCE = 7 * 86_400
#: Copies of a time bin's windows where they are too many to be broadcast, so a hot bin is many groups.
SALTS = 16


def latest_versions(scans: DataFrame, key: str, version: str, at: str, carry: tuple[str, ...] = (), per: tuple[str, ...] = ()) -> DataFrame:
    """Latest non-null ``version`` per ``key`` (and ``per``); map-side combined, so a hot key costs one row per task.

    Ties on ``at`` take the larger version. Extra columns are dropped unless named in ``carry``.
    """
    best = F.max(F.struct(F.col(at).alias("at"), F.col(version).alias("version"), *[F.col(c).alias(f"c_{c}") for c in carry])).alias("best")
    return (
        scans.where(F.col(version).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(key), *per)
        .agg(best)
        .select(key, *per, F.col("best.version").alias(version), F.col("best.at").alias(at), *[F.col(f"best.c_{c}").alias(c) for c in carry])
    )


def changed_since(scans: DataFrame, ledger: DataFrame | None, low, high, *, key: str = "file_id", version: str = "hash", at: str = "ingested_at", carry: tuple[str, ...] = ()) -> DataFrame:
    """Records a run must handle: sightings with ``low <= at < high`` whose latest version is not in the ledger.

    ``low`` is the oldest transaction open at the last successful run (None: from the beginning);
    ``ledger`` holds one ``(key, version)`` pair per key, the last processed one (None: nothing yet).
    Rows whose version is NULL (unreadable) or whose time is NULL are no sightings. Repeated rows collapse.
    The filter on ``at`` reaches the Parquet scan, so old row groups are skipped.
    """
    window = scans.where(F.col(at) < F.lit(high))
    if low is not None:
        window = window.where(F.col(at) >= F.lit(low))
    batch = latest_versions(window, key, version, at, carry)
    if ledger is None:
        return batch
    return unprocessed(batch, ledger, [key, version])


def unprocessed(batch: DataFrame, ledger: DataFrame, pair: list[str]) -> DataFrame:
    """The rows of ``batch`` whose pair is not in the ledger; a pair with a NULL in it never is."""
    return batch.join(ledger.select(*pair), pair, "left_anti")


class IncrementalLedger:
    """Processed ``(key, version)`` pairs and the low watermark, kept under ``path``.

    A batch is written under ``path`` once and read from there, so the work and the commit see the same
    records even if the source shows more in the meantime. Every commit writes a new snapshot directory, then
    replaces the pointer file by one rename. A crash before the rename leaves the old state current; a crash
    after it leaves the new one. Rerunning a run that has committed yields an empty batch. Batches and
    snapshots that nothing points to are removed by the next commit.
    """

    def __init__(self, spark: SparkSession, path: str, *, key: str = "file_id", version: str = "hash", at: str = "ingested_at"):
        self.spark, self.path, self.key, self.version, self.at = spark, path.rstrip("/"), key, version, at
        jvm = spark.sparkContext._jvm
        self._p = lambda s: jvm.org.apache.hadoop.fs.Path(s)
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _state(self) -> dict:
        pointer = self._p(f"{self.path}/CURRENT")
        if not self._fs.exists(pointer):
            return {"snapshot": None, "low": None}
        stream = self._fs.open(pointer)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def ledger(self) -> DataFrame | None:
        s = self._state()["snapshot"]
        return self.spark.read.parquet(f"{self.path}/{s}") if s else None

    def low(self):
        return self._state()["low"]

    def batch(self, scans: DataFrame, high, carry: tuple[str, ...] = ()) -> DataFrame:
        """The records of a run that started at ``high`` (ISO text or datetime), materialised."""
        low = self.low()
        got = changed_since(scans, self.ledger(), F.to_timestamp(F.lit(low)) if low else None, F.to_timestamp(F.lit(str(high))), key=self.key, version=self.version, at=self.at, carry=carry)
        place = f"{self.path}/batch-{uuid.uuid4().hex}"
        got.write.parquet(place)
        return self.spark.read.schema(got.schema).parquet(place)

    def commit(self, batch: DataFrame, oldest_open) -> None:
        """Adds a handled batch; ``oldest_open`` is the oldest transaction open when the run read its source."""
        fresh, old = batch.select(self.key, self.version), self.ledger()
        if old is not None:
            fresh = old.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh)
        name = f"snapshot-{uuid.uuid4().hex}"
        fresh.write.parquet(f"{self.path}/{name}")
        before = self._state()["snapshot"]
        tmp = self._p(f"{self.path}/CURRENT.{name}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({"snapshot": name, "low": str(oldest_open)}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        mode = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        mode[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, self._p(f"{self.path}/CURRENT"), mode)
        keep = {name, before, *(f.rstrip("/").rsplit("/", 2)[-2] for f in batch.inputFiles())}
        for status in self._fs.listStatus(self._p(self.path)):
            if status.isDirectory() and status.getPath().getName() not in keep:
                self._fs.delete(status.getPath(), True)


def run_windows(runs: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """``seq, run_id, low, high`` of each succeeded run: it reads sightings with ``low <= at < high``.

    ``high`` is its start; ``low`` the start of the oldest transaction that was open when the last succeeded
    run began (NULL for the first run): one that had not finished by then, or has no end, is still said to be
    running, and began at most ``patience`` seconds before. Repeated rows, NULL starts and runs that did not
    succeed give no window; of runs that started at the same moment the one with the smallest id counts, the
    others would find nothing left to do. The control table is one sorted pass, whatever its length.
    """
    r = runs.where(F.col("started_at").isNotNull()).select("run_id", F.col("started_at").cast("timestamp").alias("s"), F.col("finished_at").cast("timestamp").alias("f"), F.lower(F.trim("status")).alias("status")).distinct()
    micros = F.unix_micros("s")
    recent = Window.partitionBy(F.lit(0)).orderBy(micros).rangeBetween(-patience * 1_000_000, 0)
    # an end that is missing counts as open only for what has not failed
    until = F.coalesce("f", F.when(F.col("status") == "running", F.lit("9999-12-31").cast("timestamp")).otherwise(F.col("s")))
    near = F.collect_list(F.struct(F.col("s").alias("s"), until.alias("until"))).over(recent)
    oldest = F.array_min(F.transform(F.filter(near, lambda x: x["until"] > F.col("s")), lambda x: x["s"]))
    done = r.withColumn("open", F.coalesce(oldest, F.col("s"))).where("status = 'succeeded'").groupBy("s").agg(F.min("run_id").alias("run_id"), F.min("open").alias("open"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("s")
    return done.select(F.row_number().over(in_order).alias("seq"), "run_id", F.lag("open").over(in_order).alias("low"), F.col("s").alias("high"))


def within_windows(scans: DataFrame, windows: DataFrame, at: str) -> DataFrame:
    """``scans`` once for every window that holds them, with ``seq`` and ``run``, the window's run_id.

    A range join by time bins: both sides meet on the bin, then the bounds are compared. Windows go to every
    task while their bins are at most BROADCAST_ROWS; beyond that the sightings of a bin are salted.
    """
    n, first, last = windows.select(F.unix_micros("high").alias("h")).agg(F.count("h"), F.min("h"), F.max("h")).first()
    bins = 4 * (n or 0) + 1
    width = max(1, ((last or 0) - (first or 0)) // bins)
    bin_of = lambda micros: F.greatest(F.lit(0), F.least(F.lit(bins), F.floor((micros - F.lit(first or 0)) / F.lit(width)))).cast("long")
    spans = windows.select("seq", F.col("run_id").alias("run"), "low", "high", F.explode(F.sequence(F.coalesce(bin_of(F.unix_micros("low")), F.lit(0).cast("long")), bin_of(F.unix_micros("high") - 1))).alias("_bin"))
    seen = scans.withColumn("_bin", bin_of(F.unix_micros(F.col(at).cast("timestamp"))))
    on = ["_bin"]
    few = (n or 0) * (bins + 1) <= BROADCAST_ROWS  # no window has more bins than there are; else they are counted
    if few or len(spans.limit(BROADCAST_ROWS + 1).select(F.lit(1).alias("one")).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    else:
        on, seen = ["_bin", "_salt"], seen.withColumn("_salt", F.pmod(F.xxhash64(at, *[c for c in scans.columns if c != at]), F.lit(SALTS)))
        spans = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return seen.join(spans, on).where((F.col(at) < F.col("high")) & (F.col("low").isNull() | (F.col(at) >= F.col("low")))).drop("low", "high", *on)


def replay(scans: DataFrame, runs: DataFrame, *, key: str = "file_id", version: str = "hash", at: str = "ingested_at", carry: tuple[str, ...] = (), patience: int = PATIENCE) -> DataFrame:
    """``run_id, key, version, at`` of every record that each succeeded run of a history had to handle.

    Each run rereads from the oldest transaction open at the last successful run (:func:`run_windows`) and
    takes the latest version of each key, combined map-side. The ledger a batch meets holds, per key, the pair
    of the key's batch before; it is derived from the batches by one window, each pair with the run that will
    meet it, and the batches are anti-joined against it on (key, version, run). Sightings during failed runs
    fall into the next succeeded run's window, those during a succeeded run into its successor's. Runs that
    did not succeed, empty tables and NULL versions yield no rows; a NULL key is a key like any other.
    """
    windows = run_windows(runs, patience)
    seen = scans.where(F.col(version).isNotNull() & F.col(at).isNotNull()).select(key, version, at, *carry)
    batches = latest_versions(within_windows(seen, windows, at), key, version, at, carry, per=("seq", "run")).withColumn("_key", F.struct(key))  # NULL keys are equal within it
    due = F.lead("seq").over(Window.partitionBy(key).orderBy("seq"))
    ledger = batches.withColumn("_due", due).where("_due is not null").select("_key", version, F.col("_due").alias("seq"))
    left = unprocessed(batches, ledger, ["_key", version, "seq"])
    return left.select(F.col("run").alias("run_id"), key, version, at, *carry)
