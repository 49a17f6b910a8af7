"""mini_status: staleness at the ttl boundary, unparsable times, batch = stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkvox.streaming import monitor as MON

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def latest(spark, rows):
    return spark.createDataFrame(rows, "worker long, last_status string, updated_at timestamp_ntz")


def test_stale_boundary(spark):
    now = T0 + dt.timedelta(seconds=1000)
    rows = [(1, "running", now - dt.timedelta(seconds=299)), (2, "running", now - dt.timedelta(seconds=300)),
            (3, "running", now - dt.timedelta(seconds=301)), (4, "done", now - dt.timedelta(seconds=301))]
    got = {r.worker: r.status for r in MON.worker_stale_status(latest(spark, rows), F.lit(now)).collect()}
    assert got == {1: "running", 2: "running", 3: "error at worker", 4: "done"}
    strict = {r.worker: r.status for r in MON.worker_stale_status(latest(spark, rows), F.lit(now), strict_reference=True).collect()}
    assert strict[4] == "error at worker"
    run = MON.running_workers(MON.worker_stale_status(latest(spark, rows), F.lit(now))).first()
    assert run.n_running == 2 and run.can_start is False


def test_info_age(spark):
    now = T0
    info = spark.createDataFrame([(1, "2024-01-01 12:00:00"), (2, "2024-01-01 11:59:59"), (3, "not a time")],
                                 "id int, fetched_at string")
    got = {r.id: r.is_old for r in MON.status_info_age(info, F.lit(now)).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_latest_and_gaps_order(spark):
    ev = spark.createDataFrame(
        [(7, T0 + dt.timedelta(seconds=5), "running", "m2", 2), (7, T0, "ready", "m1", 1),
         (7, T0 + dt.timedelta(seconds=5), "done", "m3", 3)],          # same time: higher event_id wins
        "worker long, ts timestamp_ntz, status string, message string, event_id long",
    )
    r = MON.worker_latest_status(ev).first()
    assert (r.last_status, r.message, r.created_at) == ("done", "m3", T0)
    gaps = [(g.event_id, g.pulse_no, g.gap_seconds) for g in MON.pulse_gaps(ev).orderBy("pulse_no").collect()]
    assert gaps == [(1, 0, None), (2, 1, 5.0), (3, 2, 0.0)]


def test_pulse_gaps_hot_worker_across_slices(spark):
    # One worker holds most pulses; numbering must continue across slices.
    rows = [(1, T0 + dt.timedelta(seconds=i), "running", "m", i) for i in range(300)]
    rows += [(2, T0 + dt.timedelta(seconds=2 * i), "running", "m", 1000 + i) for i in range(5)]
    ev = spark.createDataFrame(rows, "worker long, ts timestamp_ntz, status string, message string, event_id long")
    got = {r.event_id: (r.pulse_no, r.gap_seconds) for r in MON.pulse_gaps(ev, n_slices=7).collect()}
    assert got[0] == (0, None) and got[299] == (299, 1.0)
    assert all(got[i] == (i, 1.0) for i in range(1, 300))
    assert got[1000] == (0, None) and got[1004] == (4, 2.0)


def test_stream_drops_late_pulses(spark, tmp_path):
    import os
    import time

    import pandas as pd

    src = tmp_path / "events"
    os.makedirs(src)
    H = dt.timedelta(hours=1)

    def write(name, rows):
        pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        pdf["ts"] = pdf["ts"].astype("datetime64[us]")
        pdf.to_parquet(src / name, index=False)

    # batch 0: a run at T0..T0+1h and a pulse at T0+10h (watermark -> T0+9h);
    # batch 1: a pulse at T0+20h (Spark filters late rows with the previous
    # batch's watermark, so it takes one more batch to apply); batch 2: a
    # late pulse at T0+2h, behind the watermark — dropped.
    write("a.parquet", [(1, T0, 1, "view", 0.0, "{}"), (2, T0 + H, 1, "view", 0.0, "{}"),
                        (3, T0 + 10 * H, 1, "view", 0.0, "{}")])
    time.sleep(1.1)
    write("b.parquet", [(5, T0 + 20 * H, 1, "view", 0.0, "{}")])
    time.sleep(1.1)
    write("c.parquet", [(4, T0 + 2 * H, 1, "view", 0.0, "{}")])
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    out = MON.pulse_sessions_stream(spark, str(src), schema, gap="6 hours", delay="1 hour", max_files_per_batch=1)
    got = sorted((r.session_start, r.session_end, r.n_pulses) for r in out.collect())
    assert got == [(T0, T0 + 7 * H, 2), (T0 + 10 * H, T0 + 16 * H, 1)]


def test_hot_worker_sends_few_events(spark):
    ev = spark.range(50_000, numPartitions=4).selectExpr(
        "1L AS worker", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "id AS ts_us", "id AS event_id", "'running' AS status")
    left = MON.last_per_batch(ev)
    assert left.count() <= 8 and left.agg(F.max("ts_us")).first()[0] == 49_999


def test_latest_status_changes_resolve(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [(1, T0, 1, "view"), (2, T0, 2, "signup")], [(3, T0 + dt.timedelta(hours=1), 1, "purchase")]
    for r in rows:
        spark.createDataFrame(r, "event_id long, ts timestamp_ntz, user_id long, event_type string").selectExpr(
            "*", "0.0D AS value", "'{}' AS props").coalesce(1).write.mode("append").parquet(src)
    out = MON.worker_latest_status_stream(spark, src, spark.read.parquet(src).schema)
    assert {r.worker: r.last_status for r in out.collect()} == {1: "done", 2: "ready"}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def add_file(spark, folder, rows):
    """Events (id, seconds after T0, worker, type) as one more file of a stream."""
    import time

    time.sleep(1.1)  # files are read in the order of their time
    spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), w, kind, 0.0, "{}") for i, s, w, kind in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def closed_pulses(spark, folder, last_s, delay_s, slice_s, dropped=()):
    """The batch form, restricted to slices that end before the watermark."""
    ev = MON.status_events(spark.read.schema(EVENTS).parquet(folder)).where(~F.col("event_id").isin(*dropped or (-1,)))
    first = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    end = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slice_s) + 1) * slice_s
    return sorted(map(tuple, MON.pulse_gaps(ev).where(end <= first + last_s - delay_s).collect()))


def test_pulse_gaps_of_a_stream(spark, tmp_path):
    """Late and disordered pulses in several micro-batches, one too late, a
    worker with most pulses, equal times, and a second run from the checkpoint."""
    src, at = str(tmp_path / "events"), str(tmp_path / "stream")
    rng = random.Random(2)

    def pulses(first_id, start, stop, n):
        return [(first_id + k, rng.randrange(start, stop), 1 if k % 3 else rng.randrange(2, 6), "view") for k in range(n)]

    add_file(spark, src, pulses(0, 0, 400, 60))
    add_file(spark, src, pulses(100, 300, 700, 60) + [(190, 650, 1, "view"), (191, 650, 1, "view")])  # from 300 on is not too late
    add_file(spark, src, pulses(200, 600, 900, 40))
    run = lambda: MON.pulse_gaps_stream(spark, src, EVENTS, "200 seconds", 60, folder=at, max_files_per_batch=1)
    newest = spark.read.parquet(src).agg(F.max("ts")).first()[0]
    last = int((newest - T0).total_seconds())
    one = sorted(map(tuple, run().collect()))
    assert one == closed_pulses(spark, src, last, 200, 60) and len(one) > 100
    assert {n for w, *_, n, _ in one if w == 1} == set(range(sum(w == 1 for w, *_ in one)))
    add_file(spark, src, pulses(300, 880, 1200, 40) + [(399, 10, 1, "view")])  # 399 is behind the watermark
    two = sorted(map(tuple, run().collect()))
    last = int((spark.read.parquet(src).agg(F.max("ts")).first()[0] - T0).total_seconds())
    assert two == closed_pulses(spark, src, last, 200, 60, dropped=(399,)) and set(one) < set(two)


def test_stale_workers_after_a_restart(spark, tmp_path):
    src, at = str(tmp_path / "events"), str(tmp_path / "stream")
    run = lambda: {(r.worker, r.last_status, (r.updated_at - T0).total_seconds()) for r in
                   MON.worker_stale_status_stream(spark, src, EVENTS, ttl=300, folder=at, max_files_per_batch=1).collect()}
    add_file(spark, src, [(1, 0, 1, "view"), (2, 0, 2, "view"), (3, 10, 3, "purchase"), (4, 100, 4, "view")])
    add_file(spark, src, [(5, 200, 2, "view"), (6, 300, 9, "signup")])
    assert run() == set()  # worker 1 is 300 seconds old, not older
    add_file(spark, src, [(7, 301, 9, "view")])
    assert run() == {(1, "running", 0)}
    add_file(spark, src, [(8, 390, 4, "error"), (9, 502, 9, "view")])  # 2 is stale by now; 3 and 4 are final
    assert run() == {(1, "running", 0), (2, "running", 200)}
    add_file(spark, src, [(10, 5000, 8, "view")])
    assert run() == {(1, "running", 0), (2, "running", 200), (9, "running", 502)}


def test_pulses_of_many_workers_share_calls(spark, tmp_path):
    """A thousand workers: rows are numbered per (group of workers, slice of time), not per worker."""
    src, at = str(tmp_path / "events"), str(tmp_path / "stream")
    add_file(spark, src, [(k, k % 500, k % 1000, "view") for k in range(4000)])
    got = sorted(map(tuple, MON.pulse_gaps_stream(spark, src, EVENTS, "100 seconds", 100, folder=at, worker_groups=3).collect()))
    assert got == closed_pulses(spark, src, 499, 100, 100) and len(got) > 2000
