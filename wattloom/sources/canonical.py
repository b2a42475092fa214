"""Canonical plant tables derived from the given event and line-item tables.

``events`` stands for the readings of three machines, ``lineitem`` for a quarter-hour
meter. The mapping is a set of column expressions plus one running counter, so it
scales with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import scan
from wattloom.functions.columns import floor_div, micros, time_chunk

START = "2024-01-01 00:00:00"
END = "2024-01-31 00:00:00"
TRAIN_END = "2024-01-19 00:00:00"
SITE = "site-1"
#: Bucket length of the plant tables, the same at every size. Shorter buckets than the
#: usual hour's are too thin here: three machines share the events of a month.
INTERVAL_S = 14400

MACHINES = [("furnace-01", SITE, "Induction Furnace 1", "furnace", 200.0),
            ("compressor-01", SITE, "Air Compressor 1", "compressor", 150.0),
            ("pump-01", SITE, "Cooling Pump 1", "pump", 120.0)]
SENSOR_CHANNELS = [("furnace-01", "kW"), ("furnace-01", "V"), ("furnace-01", "I"),
                   ("furnace-01", "temperature"), ("furnace-01", "vibration"),
                   ("compressor-01", "kW"), ("compressor-01", "I"), ("compressor-01", "vibration"),
                   ("pump-01", "kW"), ("pump-01", "I"), ("pump-01", "rpm")]
# The seeded time-of-use tariff (start and end as minutes of the day).
TARIFF = [(SITE, "off_peak_night", 0, 360, 6.0, None, "2024-01-01", "ASSUMPTION"),
          (SITE, "normal_day", 360, 1080, 7.5, None, "2024-01-01", "ASSUMPTION"),
          (SITE, "evening_peak", 1080, 1320, 10.5, None, "2024-01-01", "ASSUMPTION"),
          (SITE, "off_peak_late", 1320, 0, 6.0, None, "2024-01-01", "ASSUMPTION"),
          (SITE, "flat", 0, 0, 7.0, 200.0, "2023-01-01", "MEASURED")]
# Grid emission factors.
FACTORS = [("grid-v20", 0.727, "2023-04-01", "2024-03-31", "EXTERNAL_REFERENCE", "Confirm against the user guide"),
           ("grid-v21", 0.710, "2024-04-01", "2025-03-31", "EXTERNAL_REFERENCE", "confirm against the table")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(rows: list[tuple], columns: list[str]) -> str:
    """Inline table: Spark sees its size and broadcasts it by itself."""
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})"


def machines(spark: SparkSession) -> DataFrame:
    return spark.sql(_literal(MACHINES, ["machine_id", "site_id", "name", "machine_type", "rated_power_kw"]))


def sensors(spark: SparkSession) -> DataFrame:
    return (spark.sql(_literal(SENSOR_CHANNELS, ["machine_id", "channel"]))
            .select(F.concat_ws("-", "machine_id", F.lower("channel")).alias("sensor_id"), "machine_id", "channel"))


def tariff(spark: SparkSession) -> DataFrame:
    return spark.sql(_literal(TARIFF, ["site_id", "period_name", "start_min", "end_min", "energy_inr_per_kwh", "demand_inr_per_kw",
                                       "valid_from", "source_class"])).withColumn("valid_from", F.to_date("valid_from"))


def emission_factors(spark: SparkSession) -> DataFrame:
    df = spark.sql(_literal(FACTORS, ["factor_id", "value_kg_per_kwh", "effective_from", "effective_to", "source_class", "note"]))
    return df.withColumns({"effective_from": F.to_date("effective_from"), "effective_to": F.to_date("effective_to")})


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with its machine, state and hundredths of a kWh."""
    ev = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    user = F.col("user_id") % 3
    hundredths = F.round(F.col("value") * 100).cast("long")
    step = (F.dayofmonth(ts) == 30) & F.hour(ts).between(8, 11)
    better = (F.dayofmonth(ts) >= 24) & (F.col("event_type") != "click")  # a change that cuts energy, not output
    state = (F.when(F.col("event_id") % 83 == 0, F.lit(None).cast("string"))
             .when(F.dayofmonth(ts) % 7 == 0, "idle")
             .when(F.col("event_type") == "view", "heating")
             .when(F.col("event_type") == "click", "melting")
             .when(F.col("event_type") == "purchase", "holding")
             .otherwise("idle"))
    return ev.select(
        "event_id", ts.alias("ts"),
        F.when(user == 0, "furnace-01").when(user == 1, "compressor-01").otherwise("pump-01").alias("machine_id"),
        state.alias("machine_state"), "value",
        F.when(step, hundredths * 5).when(better, floor_div(hundredths * 3, 10)).otherwise(hundredths).alias("cents"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))


def readings(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Readings in arrival order (``seq``), with late arrivals and redelivered copies; ``_chunk`` is the hour by which they lie together."""
    b = base(spark, sf_dir).withColumn("_chunk", time_chunk("ts"))
    b = scan.running_sum(b, ["machine_id"], "_chunk", ["ts", "event_id"], "cents", "_counter")
    e = F.col("event_id")
    p = F.when(e % 211 == 0, -F.col("value")).otherwise(F.col("value"))
    q = F.col("k").cast("double")
    s = F.sqrt(p * p + q * q)
    worn = (F.dayofmonth("ts") % 6 == 0) & F.hour("ts").between(8, 19)
    wear = F.when(worn & (F.hour("ts") < 12), 2.5).when(worn, 2.0).otherwise(1.0)
    arrived = e * 10 + F.when(e % 50 == 0, 35).otherwise(0)
    return b.select(
        "machine_id", "ts", F.explode(F.when(e % 40 == 0, F.array(arrived, e * 10 + 107)).otherwise(F.array(arrived))).alias("seq"),
        (F.lit(400.0) + F.col("k") % 30).alias("voltage_v"),
        (F.col("value") * 1.5).alias("current_a"),
        p.alias("power_kw"), q.alias("reactive_power_kvar"),
        F.when(s > 0, p / s).alias("power_factor"),
        (F.col("_counter") / 100.0 / F.when(e % 997 == 0, 2).otherwise(1)).alias("energy_kwh"),
        ((F.lit(1.0) + F.pmod(F.col("cents"), F.lit(500)) / 100.0) * wear).alias("vibration_mm_s"),
        (F.lit(600.0) + F.col("k") * 10.0).alias("temperature_c"),
        "machine_state",
        F.when(e % 10 < 7, "SIMULATED").otherwise("MEASURED").alias("source"), *more)


def production(spark: SparkSession, sf_dir: str, interval_s: int) -> DataFrame:
    """Furnace output per bucket: the melted hundredths, 98 % good and 2 % rejected."""
    anchor = micros(F.lit(START).cast("timestamp"))
    step = interval_s * 1_000_000
    k = floor_div(micros("ts") - anchor, step)
    per = (base(spark, sf_dir).where((F.col("machine_id") == "furnace-01") & (F.col("ts") < F.lit(END).cast("timestamp")))
           .groupBy(k.alias("k"))
           .agg(F.sum(F.when(F.col("machine_state") == "melting", F.col("cents")).otherwise(0)).alias("cents"))
           .where(F.col("k") % 29 != 7))
    at = F.timestamp_micros(anchor + F.col("k") * F.lit(step).cast("long"))
    return per.select(
        F.lit("furnace-01").alias("machine_id"), at.alias("window_start"),
        F.timestamp_micros(micros(at) + F.lit(step).cast("long")).alias("window_end"),
        (F.col("cents") / 10.0).alias("qty_total_kg"),
        (F.col("cents") * 98 / 1000.0).alias("qty_good_kg"),
        (F.when(F.col("k") % 37 == 5, F.col("cents") * 100 + 1000).otherwise(F.col("cents") * 2) / 1000.0)
        .alias("qty_rejected_kg"),
        F.concat(F.lit("batch-"), F.col("k").cast("string")).alias("batch_id"),
        F.when(F.col("k") % 10 < 7, "SIMULATED").otherwise("MEASURED").alias("source"))


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour meter: line items summed per quarter and load type."""
    li = table(spark, sf_dir, "lineitem")
    quarter = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 96
    at = F.timestamp_micros(micros(F.col("l_shipdate").cast("timestamp")) + quarter * F.lit(900_000_000).cast("long"))
    load = (F.when(F.col("l_returnflag") == "A", "Light_Load").when(F.col("l_returnflag") == "N", "Medium_Load")
            .otherwise("Maximum_Load"))
    return (li.select(at.alias("dt"), load.alias("load_type"),
                      F.round(F.col("l_quantity")).cast("long").alias("_q"),
                      F.round(F.col("l_tax") * 100).cast("long").alias("_t"))
            .groupBy("dt", "load_type")
            .agg(F.sum("_q").cast("double").alias("kwh"), (F.sum(F.col("_q") * F.col("_t")) / 10.0).alias("kvarh")))
