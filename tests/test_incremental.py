import datetime as dt

from pyspark.sql import functions as F

from cairn.operators import incremental
from cairn.operators.incremental import IncrementalLedger, changed_since, replay, run_windows

T = lambda h: dt.datetime(2025, 3, 1) + dt.timedelta(hours=h)
SCANS = "file_id long, hash string, ingested_at timestamp, run_id string"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string"
ROWS = [
    (1, "a", T(1), "clash"), (1, "a", T(1), "clash"), (1, "b", T(5), None), (1, "a", T(11), None),  # a, b, back to a
    (2, "x", T(2), None), (2, "x", T(6), None), (2, None, T(7), None),  # unchanged, then unreadable
    (3, "n", T(4.5), None),  # seen while run 1 was reading
    (4, "late", T(30), None), (None, "z", T(1), None), (5, None, T(1), None),
]
RUN_ROWS = [(1, T(4), T(5), "succeeded"), (2, T(8), None, "failed"), (3, T(10), T(12), "succeeded"), (4, T(20), T(21), "aborted"), (5, T(24), T(25), "succeeded")]


def by_hand(rows, runs):
    def state(k, t):
        seen = [(r[2], r[1]) for r in rows if r[0] == k and r[1] is not None and r[2] < t]
        return max(seen)[1] if seen else None

    out, before = set(), None
    for run in sorted((r for r in runs if r[3] == "succeeded"), key=lambda r: r[1]):
        for k in {r[0] for r in rows}:
            now = state(k, run[1])
            if now is not None and (before is None or state(k, before) != now):
                out.add((run[0], k))
        before = run[1]
    return out


def test_replay(spark):
    got = replay(spark.createDataFrame(ROWS, SCANS), spark.createDataFrame(RUN_ROWS, RUNS))
    rows = [(r["run_id"], r["file_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(ROWS, RUN_ROWS)


def test_empty(spark):
    assert replay(spark.createDataFrame([], SCANS), spark.createDataFrame(RUN_ROWS, RUNS)).count() == 0
    assert replay(spark.createDataFrame(ROWS, SCANS), spark.createDataFrame([], RUNS)).count() == 0


def test_ledger_equals_replay(spark, tmp_path):
    """Run by run, with a crash before each commit of the first attempt, nothing is skipped or repeated."""
    scans = spark.createDataFrame(ROWS, SCANS)
    ledger, got = IncrementalLedger(spark, str(tmp_path / "ledger")), set()
    for run, start, _, status in RUN_ROWS:
        batch = ledger.batch(scans, start)
        if status == "succeeded":
            ledger.batch(scans, start).count()  # an attempt that dies before it commits
            got |= {(run, r["file_id"]) for r in batch.collect()}
            ledger.commit(batch, start)
            assert ledger.batch(scans, start).count() == 0  # run again: nothing
    assert got == {x for x in by_hand(ROWS, RUN_ROWS) if x[1] is not None} | {x for x in got if x[1] is None}


def test_hot_key_is_combined_before_the_shuffle(spark):
    scans = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("file_id"), F.col("id").cast("string").alias("hash"), F.timestamp_seconds(F.col("id")).alias("ingested_at"))
    got = changed_since(scans, None, None, T(0))
    assert got.where("file_id = 7").first()["hash"] == "49998"
    assert "partial_" in got._jdf.queryExecution().executedPlan().toString()


def test_windows_reread_from_the_oldest_open_transaction(spark):
    runs = [(1, T(1), T(2), "succeeded"), (2, T(3), T(9), "failed"), (3, T(4), T(5), "succeeded"), (4, T(5), None, "failed"), (5, T(6), None, "running"), (6, T(10), T(11), " Succeeded"), (7, T(12), T(13), "succeeded"), (8, T(300), T(301), "succeeded"), (9, T(302), T(303), "succeeded"), (9, T(302), T(303), "succeeded")]
    got = {r["run_id"]: (r["low"], r["high"]) for r in run_windows(spark.createDataFrame(runs, RUNS)).collect()}
    assert got == {1: (None, T(1)), 3: (T(1), T(4)), 6: (T(3), T(10)), 7: (T(6), T(12)), 8: (T(6), T(300)), 9: (T(300), T(302))}


def test_overlap_is_removed_by_the_ledger(spark):
    """A transaction stays open, so every run rereads from it; still each record comes once."""
    runs = [(0, T(0), None, "running"), *[(i, T(i * 10), T(i * 10 + 1), "succeeded") for i in range(1, 8)]]
    rows = [(k, f"v{(h * (k + 1)) // 17}", T(h), None) for k in range(5) for h in range(1, 75, 3)]
    got = [(r["run_id"], r["file_id"]) for r in replay(spark.createDataFrame(rows, SCANS), spark.createDataFrame(runs, RUNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, runs)


def test_more_runs_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(incremental, "BROADCAST_ROWS", 3)
    got = replay(spark.createDataFrame(ROWS, SCANS), spark.createDataFrame(RUN_ROWS, RUNS))
    assert {(r["run_id"], r["file_id"]) for r in got.collect()} == by_hand(ROWS, RUN_ROWS)


def test_many_runs(spark):
    """More runs than any array of bounds would hold; three sightings of one key."""
    runs = spark.range(1, 10_502).selectExpr("id as run_id", "timestamp_seconds(id * 100) as started_at", "timestamp_seconds(id * 100 + 5) as finished_at", "'succeeded' as status")
    scans = spark.createDataFrame([(1, "a", 50), (1, "b", 150), (1, "a", 1_050_050)], "file_id long, hash string, s long").selectExpr("file_id", "hash", "timestamp_seconds(s) as ingested_at")
    assert sorted(r["run_id"] for r in replay(scans, runs).collect()) == [1, 2, 10_501]


def test_a_batch_is_read_once(spark, tmp_path):
    """What becomes visible after the batch was taken is neither committed nor lost."""
    at = str(tmp_path / "source")
    spark.createDataFrame([(1, "a", T(1), None)], SCANS).write.parquet(at)
    ledger, source = IncrementalLedger(spark, str(tmp_path / "ledger")), lambda: spark.read.schema(SCANS).parquet(at)
    batch = ledger.batch(source(), T(5))
    assert [r["file_id"] for r in batch.collect()] == [1]
    spark.createDataFrame([(2, "late", T(2), None)], SCANS).write.mode("append").parquet(at)  # commits while the run works
    ledger.commit(batch, T(0))  # its transaction was open when the run read
    assert [r["file_id"] for r in ledger.batch(source(), T(9)).collect()] == [2]
    ledger.batch(source(), T(9))
    second = ledger.batch(source(), T(9))
    ledger.commit(second, T(9))
    assert ledger.batch(source(), T(12)).count() == 0 and len([p for p in (tmp_path / "ledger").iterdir() if p.name.startswith("batch-")]) <= 2
