"""Specific energy and window rollups. A value that cannot be computed carries a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom import config as C


def sec_status(energy: Column, good_kg: Column, has_record: Column, machine_type: Column, complete: Column,
               non_production: tuple[str, ...] = C.NON_PRODUCTION_TYPES) -> Column:
    return (F.when(machine_type.isin(*non_production), "NOT_APPLICABLE")
            .when(~complete, "INCOMPLETE_DATA")
            .when(~has_record | good_kg.isNull(), "MISSING_PRODUCTION")
            .when(energy.isNull(), "INCOMPLETE_DATA")
            .when(good_kg <= 0, "NO_PRODUCTION")
            .otherwise("OK"))


def compute_sec(df: DataFrame, energy: str = "energy_kwh") -> DataFrame:
    """Adds sec_status, sec_kwh_per_t and non_productive_kwh."""
    e, kg = F.col(energy), F.col("good_production_kg")
    df = df.withColumn("sec_status", sec_status(e, kg, F.col("has_production_record"), F.col("machine_type"), F.col("complete")))
    return df.withColumns({
        "sec_kwh_per_t": F.when(F.col("sec_status") == "OK", e / (kg / 1000.0)),
        "non_productive_kwh": F.when(F.col("sec_status") == "NO_PRODUCTION", F.greatest(e, F.lit(0.0)))})


def window_aggregate(scored: DataFrame, epsilon_kwh: float = C.EXPECTED_EPSILON_KWH) -> DataFrame:
    """Whole-window totals per machine; SEC is total energy over total good output."""
    done = F.col("complete")
    def over(c): return F.sum(F.when(done, F.col(c)))
    agg = scored.groupBy("machine_id", "machine_type").agg(
        F.count("*").alias("n_intervals"), F.count_if(done).alias("n_complete"),
        over("energy_kwh").alias("total_actual_kwh"), over("expected_kwh").alias("total_expected_kwh"),
        over("good_production_kg").alias("good_production_kg"),
        F.coalesce(over("non_productive_kwh"), F.lit(0.0)).alias("_np"))
    agg = agg.withColumns({"has_production_record": F.col("good_production_kg").isNotNull(), "complete": F.col("n_complete") > 0})
    agg = compute_sec(agg, "total_actual_kwh")
    exp, act = F.col("total_expected_kwh"), F.col("total_actual_kwh")
    return agg.select(
        "machine_id", "n_intervals", "n_complete", "total_actual_kwh", "total_expected_kwh",
        F.when(exp > epsilon_kwh, (act - exp) / exp * 100.0).alias("aggregate_deviation_pct"),
        F.col("good_production_kg").alias("total_good_production_kg"),
        F.col("sec_kwh_per_t").alias("window_sec_kwh_per_t"), F.col("sec_status").alias("window_sec_status"),
        F.col("_np").alias("non_productive_kwh"))


def machine_summary(tel: DataFrame, prod: DataFrame, events: DataFrame, machines: DataFrame, *, now: str, hours: float) -> DataFrame:
    """Trailing window per machine over all qualities, newest reading, output, SEC, open alerts."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(int(hours)))
    recent = F.col("ts") >= since
    q = F.col("quality")
    t = tel.groupBy("machine_id").agg(
        (F.max(F.when(recent, F.col("energy_kwh"))) - F.min(F.when(recent, F.col("energy_kwh")))).alias("energy_kwh"),
        F.count_if(recent).alias("telemetry_rows"),
        F.count_if(recent & (q == "GOOD")).alias("n_good"), F.count_if(recent & (q == "SUSPECT")).alias("n_suspect"),
        F.count_if(recent & (q == "BAD")).alias("n_bad"),
        F.max_by(F.struct("power_kw", "machine_state", "source", "ts"), "ts").alias("_l"))
    p = prod.where(F.col("window_start") >= since).groupBy("machine_id").agg(
        F.sum("qty_good_kg").alias("production_good_kg"), F.sum("qty_total_kg").alias("production_total_kg"))
    a = events.where(F.col("status") == "OPEN").groupBy("machine_id").agg(F.count("*").alias("open_alerts"))
    df = (machines.select("machine_id", "machine_type").join(t, "machine_id", "left").join(p, "machine_id", "left")
          .join(a, "machine_id", "left"))
    df = df.withColumns({"has_production_record": F.col("production_good_kg").isNotNull(), "complete": F.lit(True),
                         "energy_kwh": F.coalesce("energy_kwh", F.lit(0.0)),
                         "good_production_kg": F.coalesce("production_good_kg", F.lit(0.0))})
    return compute_sec(df).select(
        "machine_id", "machine_type", "energy_kwh", F.coalesce("telemetry_rows", F.lit(0)).alias("telemetry_rows"),
        F.col("_l.power_kw").alias("latest_power_kw"), F.col("_l.machine_state").alias("latest_state"),
        F.col("_l.source").alias("source"), F.col("_l.ts").alias("latest_ts"),
        F.col("good_production_kg").alias("production_good_kg"),
        F.coalesce("production_total_kg", F.lit(0.0)).alias("production_total_kg"),
        "n_good", "n_suspect", "n_bad", "sec_kwh_per_t", "sec_status", "non_productive_kwh",
        F.coalesce("open_alerts", F.lit(0)).alias("open_alerts"))


def quality_counts(summary: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(q).alias("key"), F.col(c).alias("value"))
                        for q, c in (("GOOD", "n_good"), ("SUSPECT", "n_suspect"), ("BAD", "n_bad"))])
    return summary.withColumn("quality_counts", F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)))


def fleet_summary(summary: DataFrame) -> DataFrame:
    e, kg = F.sum("energy_kwh"), F.sum("production_good_kg")
    return summary.agg(
        e.alias("energy_kwh"), kg.alias("production_good_kg"), F.when(kg > 0, e / kg * 1000.0).alias("fleet_sec_kwh_per_t"),
        F.sum("open_alerts").alias("open_alerts"), F.sum("latest_power_kw").alias("latest_power_kw"),
        F.count("latest_power_kw").alias("n_with_reading"),
        F.max(F.when(F.col("latest_power_kw").isNotNull(), F.col("latest_ts"))).alias("newest_ts"))


def display_means(scored: DataFrame) -> DataFrame:
    return scored.groupBy("machine_id").agg(
        F.avg("deviation_pct").alias("mean_deviation_pct"),
        F.avg(F.when(F.col("sec_status") == "OK", F.col("sec_kwh_per_t"))).alias("mean_hourly_sec"),
        F.count_if(~F.col("complete")).alias("n_incomplete"))
