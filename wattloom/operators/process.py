"""Daily process efficiency: what used energy without useful output, per local day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions import scan
from wattloom.functions.columns import hours_between, local_time, py_round, time_chunk
from wattloom.operators.intervals import HOUR_COLUMNS

REFERENCE_METRICS = ("idle_hours", "holding_per_heat_h", "non_productive_share", "start_count", "median_heat_gap_h", "heat_count")


def local_day(ts: str, tz: str = C.LOCAL_TZ) -> Column:
    return F.to_date(local_time(ts, tz))


def daily_hours_energy(intervals: DataFrame, tz: str = C.LOCAL_TZ) -> DataFrame:
    """State hours and energy of complete intervals per local day of the interval start.

    Interval hours carry four decimals, so their sum is snapped back to four.
    """
    idle_output = F.coalesce("good_production_kg", F.lit(0.0)) <= 0
    df = intervals.where("complete").groupBy("machine_id", local_day("window_start", tz).alias("day")).agg(
        *[py_round(F.sum(c), 4).alias(c) for c in HOUR_COLUMNS], F.sum("energy_kwh").alias("energy_kwh"),
        F.coalesce(F.sum(F.when(idle_output, F.col("energy_kwh"))), F.lit(0.0)).alias("non_productive_kwh"))
    return df.withColumn("non_productive_share", F.when(F.col("energy_kwh") > 0, F.col("non_productive_kwh") / F.col("energy_kwh")))


def state_samples(tel: DataFrame) -> DataFrame:
    return tel.where((F.col("quality") == "GOOD") & F.col("machine_state").isNotNull()).select("machine_id", "ts", "machine_state")


def state_transitions(samples: DataFrame, machines: DataFrame, tz: str = C.LOCAL_TZ, chunk_s: int = 3600) -> DataFrame:
    """Samples whose state differs from the one before (carried across days), with start flags."""
    df = scan.previous_row(samples.withColumn("_chunk", time_chunk("ts", chunk_s)), ["machine_id"], "_chunk", ["ts"],
                           ["machine_state"], "_prev").drop("_chunk")
    df = df.where(F.col("_prev").isNotNull() & (F.col("machine_state") != F.col("_prev.machine_state")))
    idle = lambda c: F.col(c).isin(*C.NON_PRODUCTIVE_STATES)
    df = df.join(machines.select("machine_id", "machine_type"), "machine_id")
    return df.select("machine_id", "ts", local_day("ts", tz).alias("day"), F.col("_prev.machine_state").alias("from_state"),
                     F.col("machine_state").alias("to_state"),
                     (~idle("machine_state") & idle("_prev.machine_state")).alias("is_start"),
                     ((F.col("machine_type") == "furnace") & (F.col("machine_state") == "heating")).alias("is_heat"))


def heat_gap_median(transitions: DataFrame) -> DataFrame:
    """Median gap between the heat starts of one local day (needs two)."""
    w = Window.partitionBy("machine_id", "day").orderBy("ts")
    heats = transitions.where("is_heat").withColumn("gap_h", hours_between(F.lag("ts").over(w), F.col("ts")))
    return heats.groupBy("machine_id", "day").agg(F.median("gap_h").alias("median_heat_gap_h")).where("median_heat_gap_h is not null")


def daily_metrics(intervals: DataFrame, tel: DataFrame, machines: DataFrame, tz: str = C.LOCAL_TZ) -> DataFrame:
    """One row per machine and local day that has a sample or a complete interval."""
    samples = state_samples(tel)
    days = samples.select("machine_id", local_day("ts", tz).alias("day")).distinct()
    tr = state_transitions(samples, machines, tz)
    counts = tr.groupBy("machine_id", "day").agg(F.count_if("is_start").alias("start_count"), F.count_if("is_heat").alias("heat_count"))
    key = ["machine_id", "day"]
    df = (daily_hours_energy(intervals, tz).join(days, key, "full").join(counts, key, "left").join(heat_gap_median(tr), key, "left")
          .join(machines.select("machine_id", "machine_type"), "machine_id"))
    df = df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in [*HOUR_COLUMNS, "non_productive_kwh"]})
    df = df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("start_count", "heat_count")})
    per_heat = F.when((F.col("machine_type") == "furnace") & (F.col("heat_count") > 0), F.col("hours_holding") / F.col("heat_count"))
    return df.withColumn("holding_per_heat_h", per_heat).withColumnsRenamed({"hours_idle": "idle_hours", "hours_holding": "holding_hours"})


def reference_medians(daily: DataFrame) -> DataFrame:
    """Median of each daily metric per machine over a reference window (one value per day)."""
    return daily.groupBy("machine_id").agg(*[F.median(c).alias(c) for c in REFERENCE_METRICS])


def process_findings(daily: DataFrame, reference: DataFrame, min_hold_h: float = C.PROCESS_MIN_HOLD_H) -> DataFrame:
    """Five metrics per day in long form with reference and an above-reference flag."""
    ref = reference.select("machine_id", *[F.col(c).alias(f"_r_{c}") for c in REFERENCE_METRICS])
    df = daily.join(ref, "machine_id", "left")
    furnace = F.col("machine_type") == "furnace"
    hold = F.when(furnace, F.col("holding_per_heat_h")).otherwise(F.col("holding_hours"))

    def shown(value, digits):
        value = value.cast("double")
        return value if digits is None else F.round(value + 1e-9, digits)

    def row(metric, value, digits, unit, reference):
        return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("raw"),
                        shown(value, digits).alias("value"),
                        unit.alias("unit"), reference.cast("double").alias("reference"))
    rows = F.array(
        row("idle_hours", F.col("idle_hours"), 3, F.lit("h"), F.col("_r_idle_hours")),
        row("holding_hours_per_heat", hold, 3, F.when(furnace, "h_per_heat").otherwise("h"), F.when(furnace, F.lit(min_hold_h))),
        row("non_productive_share", F.col("non_productive_share"), 4, F.lit("fraction"), F.col("_r_non_productive_share")),
        row("start_count", F.col("start_count"), None, F.lit("count"), F.col("_r_start_count")),
        row("median_heat_gap_h", F.col("median_heat_gap_h"), 3, F.lit("h"), F.col("_r_median_heat_gap_h")))
    return df.select("machine_id", "day", F.explode(rows).alias("f")).select(
        "machine_id", "day", "f.metric", "f.value", "f.unit", "f.reference",
        (F.col("f.raw") > F.col("f.reference")).alias("above_reference"))
