"""Filtered reads and latest-row lookups over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.columns import local_time, minute_of_day
from wattloom.operators.baseline import FURNACE_FEATURES


def recent(df: DataFrame, ts: str, *, machine_id: str | None = None, start: str | None = None, end: str | None = None,
           limit: int = 1000) -> DataFrame:
    """Newest rows first, time bounds inclusive on both ends; a distributed top-k."""
    if limit < 1:
        raise ValueError("limit must be positive")
    if machine_id is not None:
        df = df.where(F.col("machine_id") == machine_id)
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df.orderBy(F.col(ts).desc(), "machine_id").limit(limit)


def latest_per_machine(df: DataFrame, ts: str) -> DataFrame:
    """Newest row per machine: a hash aggregate with map-side combine, no sort of a hot machine."""
    rest = [c for c in df.columns if c != "machine_id"]
    return df.groupBy("machine_id").agg(F.max_by(F.struct(*rest), ts).alias("_r")).select("machine_id", "_r.*")


def listing(df: DataFrame, newest: str, *, machine_id: str | None = None, start: str | None = None, end: str | None = None,
            **equals: str) -> DataFrame:
    """Filter by any columns and by ``newest`` in [start, end), newest first."""
    for col, value in {"machine_id": machine_id, **equals}.items():
        if value is not None:
            df = df.where(F.col(col) == value)
    if start is not None:
        df = df.where(F.col(newest) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(newest) < F.lit(end).cast("timestamp"))
    return df.orderBy(F.col(newest).desc())


def sites(machines: DataFrame, sensors: DataFrame, readings: DataFrame) -> DataFrame:
    """One row per site: its machines, their sensors and how many readings they sent."""
    n = readings.groupBy("machine_id").agg(F.count("*").alias("n_readings"), F.max("ts").alias("newest"))
    s = sensors.groupBy("machine_id").agg(F.count("*").alias("n_sensors"))
    df = machines.join(s, "machine_id", "left").join(n, "machine_id", "left")
    return df.groupBy("site_id").agg(F.count("*").alias("n_machines"), F.coalesce(F.sum("n_sensors"), F.lit(0)).alias("n_sensors"),
                                     F.coalesce(F.sum("n_readings"), F.lit(0)).alias("n_readings"), F.max("newest").alias("newest"))


def overlapping(df: DataFrame, start: str, end: str, ws: str = "window_start", we: str = "window_end") -> DataFrame:
    return df.where((F.col(ws) < F.lit(end).cast("timestamp")) & (F.col(we) > F.lit(start).cast("timestamp")))


def latest_run_per_machine(runs: DataFrame, start: str, end: str) -> DataFrame:
    return latest_per_machine(overlapping(runs, start, end, "horizon_start", "horizon_end"), "created_at")


def tariff_in_force(tariff: DataFrame, on: str) -> DataFrame:
    """All periods of the newest tariff valid on a date, per site."""
    valid = tariff.where(F.col("valid_from") <= F.lit(on).cast("date"))
    w = Window.partitionBy("site_id").orderBy(F.col("valid_from").desc())
    return valid.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def priced_by_period(tel: DataFrame, periods: DataFrame, site_id: str, tz: str) -> DataFrame:
    """A site's periods in force with the readings that fall into them (by local minute): how many, and their mean power."""
    start, end = F.col("start_min"), F.when(F.col("end_min") > F.col("start_min"), F.col("end_min")).otherwise(F.col("end_min") + 1440)
    minutes = periods.where(F.col("site_id") == site_id).withColumn("minute", F.explode(F.transform(F.sequence(start, end - 1), lambda m: m % 1440)))
    at = tel.select(minute_of_day(local_time("ts", tz)).alias("minute"), "power_kw").groupBy("minute").agg(F.count("*").alias("n"), F.sum("power_kw").alias("kw"), F.count("power_kw").alias("m"))
    per = ["site_id", "period_name", "start_min", "end_min", "energy_inr_per_kwh"]
    return minutes.join(at, "minute", "left").groupBy(*per).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("kw"), F.sum("m")).alias("mean_kw"))


def tariff_label(tariff: DataFrame) -> DataFrame:
    """Per site with periods: is its tariff the plant's own, or an assumption throughout?"""
    agg = tariff.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(F.col("source_class") != "ASSUMPTION").alias("real"))
    return agg.select("site_id", F.when(F.col("n") == 0, "absent").when(F.col("real") == 0, "ILLUSTRATIVE (ASSUMPTION)").otherwise("plant tariff").alias("tariff_label"))


def acceptable_baseline(baselines: DataFrame) -> DataFrame:
    """Newest baseline per machine, and only if that one is acceptable with the furnace features."""
    newest = latest_per_machine(baselines, "created_at")
    return newest.where((F.col("acceptance") == "ACCEPTABLE") & (F.array_join("features", ",") == ",".join(FURNACE_FEATURES)))


def acknowledge(events: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("dedup_key").distinct().withColumn("_hit", F.lit(True))
    return events.join(hit, "dedup_key", "left").withColumn(
        "status", F.when(F.col("_hit"), "ACKNOWLEDGED").otherwise(F.col("status"))).drop("_hit")
