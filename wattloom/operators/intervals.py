"""Fixed-interval aggregation of readings and production.

Readings collapse to one row per (machine, bucket) in a single grouped aggregate with
map-side combine; everything later (windows per machine, joins) runs on those rows,
whose number depends on time and machines, not on the reading rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions.columns import bucket_index, bucket_start, compact, floor_div, hours_between, micros, py_round

HOUR_COLUMNS = [f"hours_{s}" for s in (*C.STATES, "unknown")]


def n_buckets(start: str, end: str, interval_s: int) -> int:
    import datetime as dt
    span = dt.datetime.fromisoformat(end) - dt.datetime.fromisoformat(start)
    return max(0, int(span.total_seconds() // interval_s))


def interval_grid(machines: DataFrame, start: str, end: str, interval_s: int) -> DataFrame:
    """One row per machine and whole bucket, even where nothing was measured."""
    n = n_buckets(start, end, interval_s)
    ks = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) if n else F.array().cast("array<bigint>")
    return (machines.select("machine_id", "machine_type", "rated_power_kw", F.explode(ks).alias("k"))
            .withColumns({"window_start": bucket_start("k", start, interval_s),
                          "window_end": bucket_start(F.col("k") + 1, start, interval_s)}))


def in_window(df: DataFrame, ts: str, start: str, end: str, interval_s: int) -> DataFrame:
    """Rows of [start, end) with their bucket ``k``; a trailing part bucket is left out."""
    at = F.col(ts)
    return (df.where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))
            .withColumn("k", bucket_index(ts, start, interval_s))
            .where(F.col("k") < n_buckets(start, end, interval_s)))


def _good(value: Column) -> Column:
    return F.when(F.col("quality") == "GOOD", value)


def _coverage(interval_s: int) -> Column:
    span = (micros("last_good") - micros("first_good")) / F.lit(1e6)
    pct = F.least(F.lit(100.0), span / F.lit(float(interval_s)) * 100.0)
    return F.coalesce(py_round(pct, 2), F.lit(0.0))


def _reasons(min_coverage_pct: float) -> list[Column]:
    return [
        F.when(F.col("n_bad") > 0, F.concat(F.lit("contains "), F.col("n_bad").cast("string"), F.lit(" BAD-quality row(s)"))),
        F.when(F.col("coverage_pct") < min_coverage_pct,
               F.concat(F.lit("coverage "), F.col("coverage_pct").cast("string"), F.lit(f"% below minimum {min_coverage_pct}%"))),
    ]


def reading_aggregates() -> list[Column]:
    """What a bucket keeps of its readings: counts, extremes and means that combine on the map side (and in a state store)."""
    state = F.coalesce("machine_state", F.lit("unknown"))
    per_state = [F.count_if((F.col("quality") == "GOOD") & (state == s)).alias(f"_n_{s}") for s in (*C.STATES, "unknown")]
    return [F.count_if(F.col("quality") == "GOOD").alias("n_good"),
            F.count_if(F.col("quality") == "BAD").alias("n_bad"),
            F.min(_good(F.col("ts"))).alias("first_good"), F.max(_good(F.col("ts"))).alias("last_good"),
            F.count(_good(F.col("energy_kwh"))).alias("_n_counter"),
            (F.max(_good(F.col("energy_kwh"))) - F.min(_good(F.col("energy_kwh")))).alias("_kwh"),
            F.max(_good(F.col("power_kw"))).alias("power_max_kw"),
            F.avg(_good(F.col("power_kw"))).alias("power_mean_kw"),
            F.avg(_good(F.col("power_factor"))).alias("pf_mean"), *per_state]


def production_aggregates() -> list[Column]:
    return [F.sum("qty_good_kg").alias("good_production_kg"), F.sum("qty_rejected_kg").alias("rejected_production_kg"),
            F.lit(True).alias("has_production_record")]


def bucket_readings(tel: DataFrame, start: str, end: str, interval_s: int) -> DataFrame:
    """The single aggregate over raw readings (one shuffle of partial rows)."""
    return in_window(tel, "ts", start, end, interval_s).groupBy("machine_id", "k").agg(*reading_aggregates())


def bucket_production(prod: DataFrame, start: str, end: str, interval_s: int) -> DataFrame:
    return (in_window(prod.where(F.col("quality") == "GOOD"), "window_start", start, end, interval_s)
            .groupBy("machine_id", "k").agg(*production_aggregates()))


def build_intervals(tel: DataFrame, prod: DataFrame, machines: DataFrame, *, start: str, end: str,
                    interval_s: int = C.ENERGY_INTERVAL_S, min_coverage_pct: float = C.MIN_COVERAGE_PCT) -> DataFrame:
    """Energy, state hours and production per machine and bucket, with completeness."""
    df = (interval_grid(machines, start, end, interval_s)
          .join(bucket_readings(tel, start, end, interval_s), ["machine_id", "k"], "left")
          .join(bucket_production(prod, start, end, interval_s), ["machine_id", "k"], "left"))
    return finish_intervals(df, interval_s, min_coverage_pct).select(
        "machine_id", "machine_type", "rated_power_kw", "k", "window_start", "window_end", *INTERVAL_COLUMNS)


INTERVAL_COLUMNS = ["complete", "incomplete_reasons", "energy_kwh", *HOUR_COLUMNS, "n_good", "n_bad", "coverage_pct", "good_production_kg",
                    "rejected_production_kg", "has_production_record", "power_max_kw", "power_mean_kw", "pf_mean"]


def finish_intervals(df: DataFrame, interval_s: int, min_coverage_pct: float = C.MIN_COVERAGE_PCT) -> DataFrame:
    """Columns of an interval from its bucket's aggregates (null where a side has no row)."""
    hours = {f"hours_{s}": F.when(F.col("n_good") > 0, py_round(F.col(f"_n_{s}") / F.col("n_good") * (interval_s / 3600.0), 4))
             .otherwise(0.0) for s in (*C.STATES, "unknown")}
    df = df.withColumns({"n_good": F.coalesce("n_good", F.lit(0).cast("long")), "n_bad": F.coalesce("n_bad", F.lit(0).cast("long")),
                         "has_production_record": F.coalesce("has_production_record", F.lit(False)),
                         "rejected_production_kg": F.coalesce("rejected_production_kg", F.lit(0.0)),
                         "energy_kwh": F.when(F.col("_n_counter") >= 2, F.col("_kwh"))})
    df = df.withColumns({"coverage_pct": _coverage(interval_s), **hours})
    missing = F.when(F.col("energy_kwh").isNull(), "cumulative energy counter unavailable (< 2 GOOD readings)")
    df = df.withColumn("incomplete_reasons", compact(*_reasons(min_coverage_pct), missing))
    return df.withColumn("complete", F.size("incomplete_reasons") == 0)


def hours_by_state(df: DataFrame) -> DataFrame:
    """Adds the map form of the wide hour columns (states seen only)."""
    entries = F.array(*[F.struct(F.lit(c.removeprefix("hours_")).alias("key"), F.col(c).alias("value")) for c in HOUR_COLUMNS])
    return df.withColumn("hours_by_state", F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)))


def dominant_state(df: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent state per key; a tie goes to the state seen first."""
    state = F.coalesce("machine_state", F.lit("unknown")).alias("machine_state")
    per = df.groupBy(*keys, state).agg(F.count("*").alias("_n"), F.min(micros("ts")).alias("_first"))
    return per.groupBy(*keys).agg(F.max_by("machine_state", F.struct("_n", -F.col("_first"))).alias("machine_state"))


def health_intervals(tel: DataFrame, machines: DataFrame, *, start: str, end: str,
                     interval_s: int = C.ENERGY_INTERVAL_S, min_coverage_pct: float = C.MIN_COVERAGE_PCT) -> DataFrame:
    """Signal means and dominant state per machine and bucket.

    Grouped by (machine, bucket, state) first; sums and counts then roll up to the
    bucket, so the dominant state needs no second pass over the readings.
    """
    state = F.coalesce("machine_state", F.lit("unknown"))
    sums = [a for s in C.HEALTH_SIGNALS for a in (F.sum(_good(F.col(s))).alias(f"_s_{s}"), F.count(_good(F.col(s))).alias(f"_c_{s}"))]
    per_state = (in_window(tel, "ts", start, end, interval_s).groupBy("machine_id", "k", state.alias("_state")).agg(
        F.count_if(F.col("quality") == "GOOD").alias("_good"), F.count_if(F.col("quality") == "BAD").alias("_bad"),
        F.min(_good(F.col("ts"))).alias("_first"), F.max(_good(F.col("ts"))).alias("_last"), *sums))
    means = [(F.sum(f"_s_{s}") / F.sum(f"_c_{s}")).alias(s) for s in C.HEALTH_SIGNALS]
    per = per_state.groupBy("machine_id", "k").agg(
        F.sum("_good").alias("n_rows"), F.sum("_bad").alias("n_bad"),
        F.min("_first").alias("first_good"), F.max("_last").alias("last_good"),
        F.max_by(F.when(F.col("_good") > 0, F.col("_state")),
                 F.when(F.col("_good") > 0, F.struct("_good", (-micros("_first")).alias("_f")))).alias("machine_state"), *means)
    df = interval_grid(machines, start, end, interval_s).join(per, ["machine_id", "k"], "left")
    df = df.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0).cast("long")), "n_bad": F.coalesce("n_bad", F.lit(0).cast("long"))})
    df = df.withColumn("coverage_pct", _coverage(interval_s))
    empty = F.when(F.col("n_rows") == 0, "no GOOD telemetry rows")
    df = df.withColumn("incomplete_reasons", compact(*_reasons(min_coverage_pct), empty))
    return (df.withColumn("complete", F.size("incomplete_reasons") == 0)
            .select("machine_id", "machine_type", "k", "window_start", "window_end", "machine_state", *C.HEALTH_SIGNALS,
                    "n_rows", "n_bad", "coverage_pct", "complete", "incomplete_reasons"))


def slot_states(tel: DataFrame, machines: DataFrame, *, start: str, end: str, slot_min: int = C.OPT_SLOT_MIN) -> DataFrame:
    """Dominant state per local slot of every machine; an empty slot is idle."""
    rows = in_window(tel.where((F.col("quality") == "GOOD") & F.col("machine_state").isNotNull()), "ts", start, end, slot_min * 60)
    return (interval_grid(machines, start, end, slot_min * 60)
            .join(dominant_state(rows, ["machine_id", "k"]), ["machine_id", "k"], "left")
            .select("machine_id", "k", "window_start", F.coalesce("machine_state", F.lit("idle")).alias("state")))


def state_median_power(tel: DataFrame, *, start: str, end: str, width: float = 1.0) -> DataFrame:
    """Median power per heat state, kept only for machines that showed all four."""
    from wattloom.functions.scan import exact_median
    at = F.col("ts")
    rows = tel.where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))
                     & (F.col("quality") == "GOOD") & F.col("machine_state").isNotNull())
    med = exact_median(rows, ["machine_id", "machine_state"], "power_kw", width, "median_kw")
    heat = F.col("machine_state").isin(*C.HEAT_STATES)
    whole = med.where(heat).groupBy("machine_id").agg(F.count("*").alias("_c")).where(F.col("_c") == len(C.HEAT_STATES))
    return med.where(heat).join(whole, "machine_id", "left_semi")


def meter_hours(meter: DataFrame) -> DataFrame:
    """Quarter-hour meter rows to hours: energy, apparent energy, PF, peak and state hours."""
    hour = F.date_trunc("hour", "dt")
    state = load_state(F.col("load_type"))
    df = meter.groupBy(hour.alias("window_start")).agg(
        F.sum("kwh").alias("energy_kwh"), F.sum("kvarh").alias("kvarh"), (F.max("kwh") / 0.25).alias("power_max_kw"),
        *[(F.count_if(state == s) * 0.25).alias(f"hours_{s}") for s in C.STATES], F.count("*").alias("n_quarters"))
    kvah = F.sqrt(F.col("energy_kwh") * F.col("energy_kwh") + F.col("kvarh") * F.col("kvarh"))
    return df.withColumn("kvah", kvah).withColumn("pf_mean", F.when(F.col("kvah") > 0, F.col("energy_kwh") / F.col("kvah")))


def load_state(load_type: Column) -> Column:
    return (F.when(load_type == "Light_Load", "idle").when(load_type == "Medium_Load", "holding")
            .when(load_type == "Maximum_Load", "running"))


__all__ = ["build_intervals", "bucket_production", "bucket_readings", "dominant_state", "floor_div", "health_intervals",
           "hours_between", "hours_by_state", "in_window", "interval_grid", "load_state", "meter_hours", "slot_states",
           "state_median_power"]
