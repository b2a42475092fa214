"""Streams of broker messages and readings.

Sources are file or Kafka streams with a fixed schema. Everything a query must remember
lives in its checkpoint, so a lost executor or a restart replays the same result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.operators import anomaly, baseline, ingest, intervals
from wattloom.sources import messages

MESSAGE_SCHEMA = "seq long, topic string, payload string"
PRODUCTION_SCHEMA = "machine_id string, window_start timestamp, qty_good_kg double, qty_rejected_kg double, quality string"
READING_SCHEMA = ("machine_id string, ts timestamp, seq long, voltage_v double, current_a double, power_kw double, reactive_power_kvar double, "
                  "power_factor double, energy_kwh double, vibration_mm_s double, temperature_c double, machine_state string, source string")


def read_files(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_ingest(stream: DataFrame, machines: DataFrame, accepted: str, dead: str, checkpoint: str):
    """Parsed readings of known machines to one folder, everything refused to another.

    Both are read from the batch's parsed messages, which are written below the checkpoint once and replaced by the next
    epoch's: parsed once, and no executor holds a batch, however large it is.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        found = messages.parse_messages(batch).drop("payload")
        found.write.mode("overwrite").parquet(f"{checkpoint}/parsed")
        parsed = batch.sparkSession.read.schema(found.schema).parquet(f"{checkpoint}/parsed")
        good = messages.good_telemetry(parsed)
        # the epoch names the folder, so a replayed batch overwrites itself
        messages.known_machines(good, machines).write.mode("overwrite").parquet(f"{accepted}/epoch={epoch}")
        refused = messages.dead_letter(parsed).select("seq", "topic", "reason").unionByName(
            messages.unknown_machines(good, machines).select("seq", F.lit(None).cast("string").alias("topic"), "reason"))
        refused.write.mode("overwrite").parquet(f"{dead}/epoch={epoch}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_dedup(stream: DataFrame, stored: DataFrame | None = None, delay: str = "1 day") -> DataFrame:
    """First arrival (smallest ``seq``) of each (machine, ts) that is not stored yet, given out once the watermark has passed it.

    Keys that are stored already are dropped before they take up state. The state is one row per open (machine, ts), so a
    machine with a third of all readings spreads over all tasks; it goes when the watermark passes. A copy that comes later
    than ``delay`` changes nothing. A *first* reading that comes later is not seen here: ``stream_validate`` with ``insert``
    compares with the stored keys of any age.
    """
    stream = stream.withWatermark("ts", delay)
    if stored is not None:
        stream = stream.join(stored.select(*ingest.KEY), ingest.KEY, "left_anti")
    rest = [c for c in stream.columns if c not in ingest.KEY]
    return stream.groupBy(*ingest.KEY).agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select(*ingest.KEY, "_r.*")


def _state_before(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """State rows the previous epoch left (none before the first).

    Two folders take turns: an epoch reads the one and overwrites the other, so a replayed epoch still finds its
    predecessor, and nothing piles up.
    """
    return None if epoch == 0 else spark.read.parquet(f"{path}/turn={(epoch - 1) % 2}")


def _write_state(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/turn={epoch % 2}")


def stored_keys(batch: DataFrame, out: str, epoch: int) -> DataFrame | None:
    """Keys that earlier epochs stored on the days this batch touches; other days' folders are not read.

    The days go through the driver: one short value per calendar day that has a reading in the batch.
    """
    if epoch == 0:
        return None
    days = [r[0] for r in batch.select(F.to_date("ts").alias("d")).distinct().collect()]
    keys = batch.sparkSession.read.schema("machine_id string, ts timestamp, epoch long, day date").parquet(out)
    return keys.where(F.col("day").isin(days) & (F.col("epoch") < epoch)).select(*ingest.KEY)


def stream_validate(stream: DataFrame, machines: DataFrame, out: str, state: str, checkpoint: str, *, now: str | None = None,
                    backfill: bool = False, spike_multiple: float = C.SPIKE_MULTIPLE, insert: bool = False):
    """Batch validation per micro-batch, seeded with each machine's last timestamp and highest counter.

    The micro-batch goes through the same chunked scans as a batch job, so a machine that fills it does not end up in one
    task, as it would with one keyed state per machine. ``backfill`` leaves out the stale rule, which a live stream applies.
    With ``insert``, redelivered readings are no-ops at any age: the first arrival within the batch is kept and compared with
    the keys stored so far; output folders are by day, then epoch, and only the days of the batch are read for that. State is
    one row per machine; a replayed epoch reads the same predecessor and overwrites its own folders.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _state_before(spark, state, epoch)
        at = now or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        rows = ingest.first_arrivals(batch, stored_keys(batch, out, epoch)) if insert else batch
        order = ingest.with_arrival_state(rows, before).persist()  # scanned once for rows and state
        done = ingest.verdicts(order, machines, now=at, backfill=backfill, spike_multiple=spike_multiple)
        # State first: a write to ``out`` drops whatever is cached of rows compared with the keys in ``out``.
        seen = order.groupBy("machine_id").agg(F.max("ts").alias("ts"), F.max(F.when(F.col("in_order"), F.col("energy_kwh"))).alias("energy_kwh"))
        if before is not None:
            seen = before.unionByName(seen).groupBy("machine_id").agg(F.max("ts").alias("ts"), F.max("energy_kwh").alias("energy_kwh"))
        _write_state(seen, state, epoch)
        if insert:
            (done.withColumns({"day": F.to_date("ts"), "epoch": F.lit(epoch).cast("long")}).repartition("day", ingest.arrival_chunk())
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "epoch").parquet(out))
        else:
            done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        order.unpersist()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_intervals(readings: DataFrame, production: DataFrame, machines: DataFrame, *, interval_s: int = C.ENERGY_INTERVAL_S,
                     delay: str = "2 hours", min_coverage_pct: float = C.MIN_COVERAGE_PCT) -> DataFrame:
    """Tumbling intervals with all columns of the batch job, emitted once the watermark of both streams has passed.

    Validated readings and production records are aggregated per (window, machine) in their own state stores and the
    closed windows meet in a full outer stream-stream join; a window in which neither stream had a row does not come up.
    Rows later than the delay stay in the stored tables as they arrived; a batch run over those picks them up.
    """
    def window(ts: str):
        return F.window(ts, f"{interval_s} seconds").alias("w")
    left = (readings.withWatermark("ts", delay).groupBy(window("ts"), "machine_id").agg(*intervals.reading_aggregates()))
    right = (production.where(F.col("quality") == "GOOD").withWatermark("window_start", delay)
             .groupBy(window("window_start"), "machine_id").agg(*intervals.production_aggregates()))
    df = left.join(right, ["w", "machine_id"], "full_outer").join(machines.select("machine_id", "machine_type", "rated_power_kw"), "machine_id")
    df = intervals.finish_intervals(df, interval_s, min_coverage_pct)
    return df.select("machine_id", "machine_type", "rated_power_kw", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     *intervals.INTERVAL_COLUMNS)


def stream_state_spans(stream: DataFrame, out: str, state: str, checkpoint: str):
    """Closed spans of equal state in arrival order; each machine's open span is carried to the next epoch."""
    def write(batch: DataFrame, epoch: int) -> None:
        before = _state_before(batch.sparkSession, state, epoch)
        rows = batch.select("machine_id", "seq", "ts", "machine_state", "source")
        if before is not None:
            held = before.select("machine_id", F.lit(-1).cast("long").alias("seq"), F.col("ts_start").alias("ts"), F.col("state").alias("machine_state"), "source")
            rows = rows.unionByName(held)
        spans = ingest.machine_state_spans(rows).persist()
        spans.where("ts_end is not null").drop("seq").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        _write_state(spans.where("ts_end is null"), state, epoch)
        spans.unpersist()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


_PROGRESS_SCHEMA = "machine_id string, k long, run_deviation long, run_idle long, trailing array<double>"


def stream_detect(stream: DataFrame, baselines: DataFrame, out: str, state: str, checkpoint: str, *, interval_s: int = C.ENERGY_INTERVAL_S):
    """Scores closed intervals as they come and keeps events up to date; nothing stored is read again but two small states.

    ``stream`` gives the intervals of ``stream_intervals``, each once and each machine's in order of time (several machines
    and any number of intervals an epoch); ``baselines`` the coefficients in force. Carried from epoch to epoch are one row
    a machine (last bucket, lengths of the running conditions, the trailing residuals) and one per event that may still
    grow, so the cost of an epoch does not depend on how many went before. A closed event is written once, into the folder
    of the epoch that closed it; events still open are the state itself. ``detected_events`` reads both. An interval at or
    before its machine's last one is not judged: it goes to ``late/``, for a batch run. A replayed epoch reads the same
    state and overwrites its own folders; its number is noted last, so ``last_epoch`` knows epochs that closed no event, too.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        progress, growing = f"{state}/progress", f"{state}/growing"
        before = _state_before(spark, progress, epoch)
        before = spark.createDataFrame([], _PROGRESS_SCHEMA) if before is None else before
        old = _state_before(spark, growing, epoch)
        k = F.floor(F.unix_seconds("window_start") / interval_s)
        held = before.select("machine_id", F.col("k").alias("_k_before"), F.col("run_deviation").alias("_run_deviation_before"),
                             F.col("run_idle").alias("_run_idle_before"), F.col("trailing").alias("_trailing_before"))
        rows = batch.withColumn("k", k).join(held, "machine_id", "left")
        late = F.col("k") <= F.col("_k_before")
        rows.where(late).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/late/epoch={epoch}")
        scored = baseline.score_intervals(rows.where(F.coalesce(~late, F.lit(True))), baselines).where("has_baseline")
        inputs = anomaly.with_rule_inputs(scored, carried=True).persist()  # for the flags and for the state
        trailing = F.max_by("_trailing", F.when(F.col("residual").isNotNull(), F.col("k")))
        now = inputs.groupBy("machine_id").agg(
            F.max("k").alias("k"), F.max_by("run_deviation", "k").alias("run_deviation"), F.max_by("run_idle", "k").alias("run_idle"),
            F.coalesce(trailing, F.first("_trailing_before")).alias("trailing"))
        after = before.join(now, "machine_id", "left_anti").unionByName(now).persist()
        parts = anomaly.flagged_parts(inputs)
        parts = parts if old is None else anomaly.joined_parts(parts.unionByName(old))
        ends = after.select("machine_id", F.col("k").alias("_last"))
        parts = parts.join(ends, "machine_id").persist()
        grows = F.col("k_last") == F.col("_last")
        anomaly.events_of(parts.where(~grows)).write.mode("overwrite").parquet(f"{out}/closed/epoch={epoch}")
        _write_state(parts.where(grows).drop("_last"), growing, epoch)
        _write_state(after, progress, epoch)
        _write_state(spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")), f"{state}/finished", epoch)
        for df in (parts, after, inputs):
            df.unpersist()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def last_epoch(spark: SparkSession, state: str) -> int:
    """The last epoch that ``stream_detect`` finished, whether or not it closed an event."""
    return spark.read.parquet(f"{state}/finished").agg(F.max("epoch")).first()[0]


def detected_events(spark: SparkSession, out: str, state: str, epoch: int) -> DataFrame:
    """All events as of the given (last finished) epoch: the closed ones and those that may still grow."""
    closed = spark.read.parquet(f"{out}/closed").where(F.col("epoch") <= epoch).drop("epoch")
    return closed.unionByName(anomaly.events_of(_state_before(spark, f"{state}/growing", epoch + 1)))


#: Most state partitions of a stream whose state does not grow with the readings.
SMALL_STATE = 8


def _start_small(spark: SparkSession, query):
    """Starts a stream with at most ``SMALL_STATE`` shuffle partitions; those of its first start stay in its checkpoint."""
    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(int(usual), SMALL_STATE)))
    try:
        return query.trigger(availableNow=True).start()  # the stream takes a copy of the settings here
    finally:
        spark.conf.set(name, usual)


def run_to_end(*queries, small=()) -> None:
    """Processes what is there and stops (``availableNow``); several streams run side by side.

    Every batch opens, writes and commits every partition of a stream's state, filled or not. ``small`` are the streams whose
    rows are summed up before the shuffle and whose state follows time and machines only (``stream_intervals``): at any
    reading rate a few partitions hold it, while the session's number, which goes with the input, would set their cost.
    """
    running = []
    try:
        running += [q.trigger(availableNow=True).start() for q in queries]
        running += [_start_small(SparkSession.active(), q) for q in small]
        for q in running:
            q.awaitTermination()
            if q.exception() is not None:
                raise q.exception()
    finally:
        for q in running:
            q.stop()
