"""Worker status monitoring (group H), batch and Structured Streaming.

Input is an event feed ``(worker, ts, status, message, event_id)``. Each
batch function also accepts a streaming DataFrame where Spark allows it;
the ``*_stream`` functions run the streaming form end to end with an
``availableNow`` trigger and a sink under the shared checkpoint folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkvox.functions import lexicon as L
from sparkvox.session import ensure_checkpoint_dir, scratch_path, ship_package

# Status per event type of the driver's ``events`` table.
EVENT_STATUS = {"signup": "ready", "view": "running", "click": "running",
                "purchase": "done", "error": "error at app"}


def status_events(events: DataFrame) -> DataFrame:
    """events → (worker, ts, status, message, event_id)."""
    status = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv]), F.col("event_type")),
        F.lit("not initiated"),
    )
    return events.select(
        F.col("user_id").alias("worker"), "ts", status.alias("status"),
        F.col("props").alias("message"), "event_id",
    )


def worker_latest_status(ev: DataFrame) -> DataFrame:
    """Last record per worker (latest ts, then highest event_id) and the
    first event time as ``created_at``. max_by is partially aggregated per
    task, so a worker with a huge share of events is not a hot task."""
    last = F.max_by(F.struct("status", "message", "ts"), F.struct("ts", "event_id"))
    return ev.groupBy("worker").agg(last.alias("last"), F.min("ts").alias("created_at")).select(
        "worker",
        F.col("last.status").alias("last_status"),
        F.col("last.message").alias("message"),
        "created_at",
        F.col("last.ts").alias("updated_at"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def worker_stale_status(latest: DataFrame, now: Column, ttl: float = L.STALE_AFTER_SECONDS,
                        strict_reference: bool = False) -> DataFrame:
    """A worker whose last update is older than ``ttl`` seconds is reported
    as ``error at worker`` — only while it is not in a final state, unless
    ``strict_reference`` (then every status goes stale)."""
    old = seconds_between(F.col("updated_at"), now) > ttl
    if not strict_reference:
        old = old & ~F.col("last_status").isin(L.FINAL_STATUSES)
    return latest.withColumn("status", F.when(old, F.lit(L.STALE_STATUS)).otherwise(F.col("last_status")))


def status_info_age(info: DataFrame, now: Column, ttl: float = L.INFO_TTL_SECONDS,
                    col: str = "fetched_at") -> DataFrame:
    """Is a fetched status copy older than ``ttl`` seconds? The copy's time
    is a ``yyyy-MM-dd HH:mm:ss`` string; an unparsable one counts as old."""
    parsed = F.try_to_timestamp(F.col(col), F.lit(L.TIME_FORMAT)).cast("timestamp_ntz")
    return info.withColumn("is_old", F.coalesce(seconds_between(parsed, now) > ttl, F.lit(True)))


def running_workers(status: DataFrame, max_n_workers: int = L.MAX_N_WORKERS) -> DataFrame:
    """Number of live workers (ready or running after staleness) and
    whether another may start."""
    n = F.count_if(F.col("status").isin("ready", "running"))
    return status.agg(n.alias("n_running")).withColumn("can_start", F.col("n_running") < max_n_workers)


def pulse_gaps(ev: DataFrame, n_slices: int | None = None) -> DataFrame:
    """Pulses per worker numbered from 0 in time order, with the gap in
    seconds since the previous pulse (NULL for the first).

    Skew-safe: a per-worker window would put a worker holding a large share
    of all pulses into one task. Instead the rows are range-partitioned on
    (worker, ts, event_id), so a hot worker spans many slices, and the slice
    layout is pinned by a reliable checkpoint (a re-run task sees the same
    slices). Rows are numbered within each (slice, worker); a small
    per-(slice, worker) summary — one row per slice a worker touches — gives
    each slice the number of earlier pulses of that worker and the time of
    the last one.
    """
    spark = ev.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        ev.select("worker", "event_id", "ts")
        .repartitionByRange(n, "worker", "ts", "event_id")
        .withColumn("slice", F.spark_partition_id())
        .checkpoint()
    )
    local_w = Window.partitionBy("slice", "worker").orderBy("ts", "event_id")
    local = ranged.select(
        "slice", "worker", "event_id", "ts",
        (F.row_number().over(local_w) - 1).alias("local_no"),
        F.lag("ts").over(local_w).alias("local_prev"),
    )
    per_slice = ranged.groupBy("slice", "worker").agg(
        F.count(F.lit(1)).alias("cnt"), F.max_by("ts", F.struct("ts", "event_id")).alias("last_ts")
    )
    across = Window.partitionBy("worker").orderBy("slice")  # rows: slices one worker spans
    offsets = per_slice.select(
        "slice", "worker",
        F.coalesce(F.sum("cnt").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lag("last_ts").over(across).alias("prev_slice_last"),
    )
    j = local.join(offsets, ["slice", "worker"])
    return j.select(
        "worker", "event_id", "ts",
        (F.col("before") + F.col("local_no")).cast("long").alias("pulse_no"),
        seconds_between(F.coalesce("local_prev", "prev_slice_last"), F.col("ts")).alias("gap_seconds"),
    )


def worker_board(status: DataFrame, cancel: Column) -> DataFrame:
    """Display table: name, last update (formatted), last status, a symbol
    for live workers, and the cancel mark."""
    alive = F.col("status").isin("ready", "running")
    return status.select(
        F.col("worker").cast("string").alias("name"),
        F.date_format("updated_at", L.TIME_FORMAT).alias("updated_at"),
        "last_status",
        F.when(alive, F.lit(L.ALIVE_SYMBOL)).otherwise(F.lit(L.NOT_ALIVE_SYMBOL)).alias("is_alive"),
        cancel.alias("cancel"),
    )


# ---------------------------------------------------------------------------
# Structured Streaming forms
# ---------------------------------------------------------------------------

def _file_stream(spark: SparkSession, source_path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet file stream; ``source_path`` is a folder, or a file whose
    folder is watched with a name filter. ``max_files`` caps files per
    micro-batch (files are taken oldest first)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(source_path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if not fs.getFileStatus(jpath).isDirectory():
        return reader.option("pathGlobFilter", jpath.getName()).parquet(jpath.getParent().toString())
    return reader.parquet(source_path)


def _run_available_now(query_writer, name: str) -> None:
    q = query_writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"{name} failed: {q.exception()}")


def worker_latest_status_stream(spark: SparkSession, source_path: str, schema) -> DataFrame:
    """Latest status per worker maintained by a streaming aggregation over a
    file source. Every micro-batch appends the workers that changed to a
    folder of its own (a batch that is run again replaces that folder), and
    the reader takes each worker's last change."""
    out = scratch_path(spark, "latest_status")
    ckpt = scratch_path(spark, "latest_status_ckpt")
    stream = _file_stream(spark, source_path, schema)
    latest = worker_latest_status(status_events(stream))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    _run_available_now(
        latest.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt),
        "worker_latest_status_stream",
    )
    fields = latest.columns
    changes = spark.read.schema(latest.schema.add("batch", "long")).parquet(out)
    return changes.groupBy("worker").agg(F.max_by(F.struct(*fields[1:]), "batch").alias("last")).select("worker", "last.*")


def pulse_sessions_stream(spark: SparkSession, source_path: str, schema, gap: str = "6 hours",
                          delay: str = "1 hour", max_files_per_batch: int | None = None) -> DataFrame:
    """Runs of uninterrupted pulses per worker as session windows: a gap of
    ``gap`` ends a run; events later than the watermark (max event time
    minus ``delay``) are dropped — Spark filters late rows with the
    watermark of the previous micro-batch. Append mode writes each closed
    session once to a Parquet sink."""
    out = scratch_path(spark, "pulse_sessions")
    ckpt = scratch_path(spark, "pulse_sessions_ckpt")
    ev = status_events(_file_stream(spark, source_path, schema, max_files_per_batch)).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    sessions = (
        ev.withWatermark("ts", delay)
        .groupBy("worker", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n_pulses"))
        .select(
            "worker",
            F.col("s.start").cast("timestamp_ntz").alias("session_start"),
            F.col("s.end").cast("timestamp_ntz").alias("session_end"),
            "n_pulses",
        )
    )
    # Pulses of a worker become sessions where they are read, so a worker with
    # most pulses shuffles sessions, not pulses.
    merge = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(merge, "false")
    spark.conf.set(merge, "true")
    try:
        _run_available_now(
            sessions.writeStream.outputMode("append").format("parquet")
            .option("path", out).option("checkpointLocation", ckpt),
            "pulse_sessions_stream",
        )
    finally:
        spark.conf.set(merge, before)
    return spark.read.schema("worker long, session_start timestamp_ntz, session_end timestamp_ntz, n_pulses long").parquet(out)


def last_per_batch(ev: DataFrame) -> DataFrame:
    """Of each worker, the last event of every Arrow batch: a stateless
    reduction before the shuffle, so a worker with most events sends a few."""
    def last(batches):
        for pdf in batches:
            yield pdf.sort_values(["ts_us", "event_id"]).drop_duplicates("worker", keep="last")

    return ev.mapInPandas(last, ev.schema)


class StaleWorkers(StatefulProcessor):
    """Per worker the latest (status, time, event id) and one event-time timer
    behind the time it lives without news. When the timer fires the worker is
    reported unless its last status is final, and its state goes."""

    def __init__(self, ttl: float):
        self._ttl_ms = int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "status string, ts_us long, event_id long")

    def _deadline(self, ts_us: int) -> int:
        return ts_us // 1000 + self._ttl_ms + 1  # a timer fires when the watermark reaches it, stale is later than the ttl

    def handleInputRows(self, key, rows, timerValues):
        best = self._last.get()
        known = best
        for pdf in rows:
            top = pdf.sort_values(["ts_us", "event_id"]).iloc[-1]
            found = (str(top["status"]), int(top["ts_us"]), int(top["event_id"]))
            if best is None or found[1:] > tuple(best[1:]):
                best = found
        if best is not None and best is not known:
            if known is not None:
                self._handle.deleteTimer(self._deadline(known[1]))
            self._last.update(tuple(best))
            self._handle.registerTimer(self._deadline(best[1]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, ts_us, _ = self._last.get()
        self._last.clear()
        if status not in L.FINAL_STATUSES:
            yield pd.DataFrame({"worker": [key[0]], "last_status": [status], "updated_us": [ts_us], "status": [L.STALE_STATUS]})

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of custom processors is kept in RocksDB, on disk, with changes logged to the checkpoint."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _to_files(out: DataFrame, folder: str, name: str) -> None:
    """Append a stream's rows to ``folder/name``; a later call goes on from its checkpoint."""
    _run_available_now(
        out.writeStream.outputMode("append").format("parquet")
        .option("path", os.path.join(folder, name)).option("checkpointLocation", os.path.join(folder, f"{name}_ckpt")), name)


def worker_stale_status_stream(spark: SparkSession, source_path: str, schema, ttl: float = L.STALE_AFTER_SECONDS,
                               delay: str = "0 seconds", folder: str | None = None,
                               max_files_per_batch: int | None = None) -> DataFrame:
    """Stale workers detected by a custom stateful stream (``StaleWorkers``): a
    worker is emitted as ``error at worker`` when the watermark passes its last
    event by ``ttl``. State per worker is one small row and a timer. With a
    ``folder`` (sink and checkpoint) a later call goes on where one ended."""
    ship_package(spark)
    folder = folder or scratch_path(spark, "stale_workers")
    ev = (
        status_events(_file_stream(spark, source_path, schema, max_files_per_batch))
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("ts_us", F.unix_micros("ts"))
        .select("worker", "ts", "ts_us", "event_id", "status")
    )
    fields = "worker long, last_status string, updated_us long, status string"
    with _rocksdb(spark):
        stale = last_per_batch(ev).withWatermark("ts", delay).groupBy("worker").transformWithStateInPandas(
            statefulProcessor=StaleWorkers(ttl), outputStructType=fields, outputMode="append", timeMode="eventTime")
        _to_files(stale, folder, "stale")
    res = spark.read.schema(fields).parquet(os.path.join(folder, "stale"))
    return res.select(
        "worker", "last_status",
        F.timestamp_micros("updated_us").cast("timestamp_ntz").alias("updated_at"),
        "status",
    )


PULSE = ("worker", "ts_us", "event_id")


class PulseSlices(StatefulProcessor):
    """Pulses of one (group of workers, slice of time) are kept until the
    watermark passes the slice's end, however late and in whatever order they
    come; then they are numbered per worker within the slice. A worker's last
    one carries its count. The pulses of a call are one entry of the state."""

    def __init__(self, slice_us: int):
        self._slice_us = slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pulses = handle.getListState("pulses", "worker array<long>, ts_us array<long>, event_id array<long>")

    def handleInputRows(self, key, rows, timerValues):
        end_ms = -(-(key[1] + 1) * self._slice_us // 1000)
        if end_ms > timerValues.getCurrentWatermarkInMs():  # a pulse of a closed slice is too late
            for pdf in rows:
                self._pulses.appendValue(tuple(
                    [None if pd.isna(x) else int(x) for x in pdf[c]] if pdf[c].hasnans else pdf[c].tolist() for c in PULSE))
            self._handle.registerTimer(end_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        parts = list(self._pulses.get())
        self._pulses.clear()
        columns = [pd.array([x for p in parts for x in p[k]], dtype="Int64") for k in range(len(PULSE))]
        pulses = pd.DataFrame(dict(zip(PULSE, columns, strict=True))).sort_values(list(PULSE), ignore_index=True, na_position="first")
        same = pulses.groupby("worker", dropna=False, sort=False)
        pulses["slice"] = key[1]
        pulses["local_no"] = same.cumcount()
        pulses["local_prev"] = same["ts_us"].shift()
        n = same["ts_us"].transform("size").astype("Int64")
        pulses["n"] = n.where(pulses["local_no"] == n - 1)
        for s in range(0, len(pulses), 10_000):
            yield pulses[s:s + 10_000][["worker", "slice", "event_id", "ts_us", "local_no", "local_prev", "n"]]

    def close(self) -> None:
        pass


class PulseCounter(StatefulProcessor):
    """Per worker the number of pulses of all closed slices and the time of the
    last one; a closed slice is told what came before it. Slices close in the
    order of time, those that close together are sorted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "n long, last_us long")

    def handleInputRows(self, key, rows, timerValues):
        closed = pd.concat(list(rows)).sort_values("slice")
        n, last = self._seen.get() or (0, None)
        before, previous = [], []
        for count, ts_us in zip(closed["n"].tolist(), closed["ts_us"].tolist(), strict=True):
            before.append(n)
            previous.append(last)
            n, last = n + int(count), int(ts_us)
        self._seen.update((n, last))
        yield pd.DataFrame({"worker": key[0], "slice": closed["slice"].tolist(), "before": before,
                            "previous": pd.array(previous, dtype="Int64")})

    def close(self) -> None:
        pass


def pulse_gaps_stream(spark: SparkSession, source_path: str, schema, delay: str = "1 hour", slice_seconds: int = 3600,
                      folder: str | None = None, max_files_per_batch: int | None = None, worker_groups: int = 16) -> DataFrame:
    """``pulse_gaps`` over a stream: numbers and gaps of the pulses of all time
    slices that the watermark (greatest event time less ``delay``) has passed.

    Two stateful streams. The first holds pulses per (group of workers, slice of
    ``slice_seconds``) until the slice closes and numbers them there, so a
    worker with most pulses is spread over its slices and the number of calls
    and timers depends on the time that passes only; pulses that come late
    but before the watermark are put in order, later ones are dropped. The
    second reads one row per closed slice and keeps each worker's counter. Both
    write to Parquet; the result joins a pulse with what came before its slice.
    With a ``folder`` a later call goes on from both checkpoints."""
    ship_package(spark)
    folder = folder or scratch_path(spark, "pulse_gaps")
    slice_us = slice_seconds * 1_000_000
    ev = status_events(_file_stream(spark, source_path, schema, max_files_per_batch)).select(
        "worker", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    ev = ev.withColumn("ts_us", F.unix_micros("ts")).withColumn("slice", F.floor(F.col("ts_us") / F.lit(slice_us)))
    part = F.when(F.col("worker").isNull(), -1).otherwise(F.pmod(F.xxhash64("worker"), F.lit(worker_groups)))
    ev = ev.withColumn("part", part.cast("long"))
    fields = "worker long, slice long, event_id long, ts_us long, local_no long, local_prev long, n long"
    offset_fields = "worker long, slice long, before long, previous long"
    with _rocksdb(spark):
        local = ev.withWatermark("ts", delay).groupBy("part", "slice").transformWithStateInPandas(
            statefulProcessor=PulseSlices(slice_us), outputStructType=fields, outputMode="append", timeMode="eventTime")
        _to_files(local, folder, "pulses")
        closed = spark.readStream.schema(fields).parquet(os.path.join(folder, "pulses")).where(F.col("n").isNotNull())
        offsets = closed.select("worker", "slice", "n", "ts_us").groupBy("worker").transformWithStateInPandas(
            statefulProcessor=PulseCounter(), outputStructType=offset_fields, outputMode="append", timeMode="none")
        _to_files(offsets, folder, "offsets")
    pulses = spark.read.schema(fields).parquet(os.path.join(folder, "pulses"))
    before = spark.read.schema(offset_fields).parquet(os.path.join(folder, "offsets"))
    previous = F.coalesce("local_prev", "previous")
    return pulses.join(before, ["worker", "slice"]).select(
        "worker", "event_id", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"),
        (F.col("before") + F.col("local_no")).alias("pulse_no"), ((F.col("ts_us") - previous) / 1e6).alias("gap_seconds"))
