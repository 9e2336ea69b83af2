"""Rollups with retractions, and claims by several workers."""

import random
import threading

from pyspark.sql import functions as F

from sievework.operators import control, index, usage
from sievework.streaming import rollups

EVENT = "event_id string, kind string, ts timestamp_ntz, project_id string, pipeline_uid string, plugin string, status string, seq long, " + ", ".join(f"{c} {'double' if c == 'audio_seconds' else 'long'}" for c in usage.STEP_SUMS)


def deliveries(n, seed):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    out = []
    for _ in range(n):
        e = rng.randrange(200)
        at = datetime(2024, 1, 15) + timedelta(days=e % 90)
        out.append((f"e{e}", "step" if e % 3 else "job", at, f"p{e % 2}", "u", f"plug{rng.randrange(3)}", rng.choice(["succeeded", "failed"]), rng.randrange(10**9), *(float(rng.randrange(9)) if c == "audio_seconds" else rng.randrange(9) for c in usage.STEP_SUMS)))
    return out


def as_rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(r.asDict())) for r in df.collect())


def test_batches_equal_the_whole(spark, tmp_path):
    path, all_ = str(tmp_path), []
    for batch in range(4):
        rows = deliveries(150, batch)
        all_ += rows
        rollups.apply_batch(spark.createDataFrame(rows, EVENT), batch, path)
        whole = usage.daily(usage.dedup(spark.createDataFrame(all_, EVENT))).select(*usage.KEYS, "rows_count", *usage.MEASURES)
        assert as_rows(rollups.read_rollup(spark, path)) == as_rows(whole)
    months = rollups.read_rollup(spark, path, ["202402"])
    assert as_rows(months) == as_rows(whole.where("date_format(day, 'yyyyMM') = '202402'"))


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    first, second = (spark.createDataFrame(deliveries(100, s), EVENT) for s in (1, 2))
    rollups.apply_batch(first, 0, path)
    with monkeypatch.context() as m:  # it dies between its states and its events
        m.setattr(index, "write_index", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        try:
            rollups.apply_batch(second, 1, path)
        except KeyboardInterrupt:
            pass
    for _ in range(2):
        rollups.apply_batch(second, 1, path)
    whole = usage.daily(usage.dedup(first.unionByName(second))).select(*usage.KEYS, "rows_count", *usage.MEASURES)
    assert as_rows(rollups.read_rollup(spark, path)) == as_rows(whole)
    rollups.apply_batch(first.where("false"), 2, path)


def test_only_touched_months_are_read(spark, tmp_path):
    path = str(tmp_path)
    rollups.apply_batch(spark.createDataFrame(deliveries(300, 3), EVENT), 0, path)
    read = rollups.touched(spark, path, ["202403"])
    scans = [line for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert scans and all("month" in line.split("PartitionFilters")[1] and "202403" in line for line in scans)
    assert {r["month"] for r in read.select("month").distinct().collect()} == {"202403"}


def test_workers_never_share_an_event(spark, tmp_path):
    from datetime import datetime

    made = datetime(2024, 1, 1)
    outbox = spark.createDataFrame([(n, made, made, None) for n in range(60)], "id long, created_at timestamp_ntz, next_attempt_at timestamp_ntz, delivered_at timestamp_ntz").cache()
    now, got = F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz"), {}

    def work(owner):
        got[owner] = [r["id"] for r in control.claim(outbox, str(tmp_path / "c"), owner, now, 25, 60).collect()]

    threads = [threading.Thread(target=work, args=(o,)) for o in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    taken = [x for ids in got.values() for x in ids]
    assert len(taken) == len(set(taken)) == 60 and sorted(map(len, got.values())) == [10, 25, 25]
    assert control.claim(outbox, str(tmp_path / "c"), "d", now, 25, 60).count() == 0
    assert control.claim(outbox, str(tmp_path / "c"), "d", now + F.expr("INTERVAL 61 SECONDS"), 25, 60).count() == 25


def test_a_batch_is_one_sort_and_no_join(spark, tmp_path):
    """Of several deliveries of one event, on either side, the latest counts; old and new rows meet in one exchange."""
    rows = rollups.identified(spark.createDataFrame(deliveries(400, 5), EVENT))
    new, old = rows.where("seq % 3 = 0"), rows.where("seq % 3 <> 0")
    changed = rollups.changes(new, old)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    count = lambda df: {r["id"]: r["seq"] for r in df.groupBy("id").agg(F.max("seq").alias("seq")).collect()}
    before, after = count(old), count(rows)
    got = {s: {r["id"]: r["seq"] for r in changed.where(F.col("_sign") == s).collect()} for s in (1, -1)}
    assert got[1] == {k: v for k, v in after.items() if before.get(k) != v}
    assert got[-1] == {k: v for k, v in before.items() if after[k] != v}


def test_a_batch_that_died_before_its_events(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    first, second = (spark.createDataFrame(deliveries(100, s), EVENT) for s in (1, 2))
    rollups.apply_batch(first, 0, path)
    with monkeypatch.context() as m:
        m.setattr(index, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        try:
            rollups.apply_batch(second, 1, path)
        except KeyboardInterrupt:
            pass
    assert len(index.versions(spark, f"{path}/events")) == 1
    rollups.apply_batch(second, 1, path)
    rollups.apply_batch(second, 1, path)
    whole = usage.daily(usage.dedup(first.unionByName(second))).select(*usage.KEYS, "rows_count", *usage.MEASURES)
    assert as_rows(rollups.read_rollup(spark, path)) == as_rows(whole)
    assert len(index.versions(spark, f"{path}/events")) == 2  # the last replay had nothing to bring in
