"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METER_CSV = ("date string, `Usage_kWh` double, `Lagging_Current_Reactive.Power_kVarh` double, `WeekStatus` string, "
             "`NSM` double, `Load_Type` string")


def read_meter_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quarter-hour meter export: day-first local times, explicit schema (no inference pass)."""
    df = spark.read.schema(METER_CSV).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(F.to_timestamp("date", "dd/MM/yyyy HH:mm").alias("dt"), F.col("Usage_kWh").alias("kwh"),
                     F.col("`Lagging_Current_Reactive.Power_kVarh`").alias("kvarh"), F.col("WeekStatus").alias("week_status"),
                     F.col("NSM").cast("long").alias("nsm"), F.col("Load_Type").alias("load_type"))


def write_meter_csv(meter: DataFrame, path: str) -> None:
    weekend = F.dayofweek("dt").isin(1, 7)
    (meter.select(F.date_format("dt", "dd/MM/yyyy HH:mm").alias("date"), F.col("kwh").alias("Usage_kWh"),
                  F.col("kvarh").alias("Lagging_Current_Reactive.Power_kVarh"), F.when(weekend, "Weekend").otherwise("Weekday").alias("WeekStatus"),
                  (F.hour("dt") * 3600 + F.minute("dt") * 60).alias("NSM"), F.col("load_type").alias("Load_Type"))
     .write.mode("overwrite").option("header", True).csv(path))


def write_dataset(tel: DataFrame, prod: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Readings by day, sorted for machine and time range scans, and production next to them."""
    day = tel.withColumn("day", F.to_date("ts"))
    if fmt == "csv":
        day = day.withColumns({c: F.array_join(c, "; ") for c, t in day.dtypes if t == "array<string>"})
        prod = prod.withColumns({c: F.array_join(c, "; ") for c, t in prod.dtypes if t == "array<string>"})
    (day.sortWithinPartitions("day", "machine_id", "ts").write.mode("overwrite").option("header", True)
     .partitionBy("day").format(fmt).save(path))
    prod.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}_production")
