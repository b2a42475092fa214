"""Keyed writes without a transactional table format: the new table state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(new: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (append these)."""
    return new.join(target.select(*key), key, "left_anti")


def insert_counts(new: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    known = target.select(*key).distinct().withColumn("_known", F.lit(True))
    return new.join(known, key, "left").agg(F.count_if(F.col("_known").isNull()).alias("created"),
                                            F.count_if(F.col("_known").isNotNull()).alias("already_existing"))


def upsert_where(new: DataFrame, target: DataFrame, key: list[str], overwrite: Column) -> DataFrame:
    """Target after an upsert; an existing row is replaced only where ``overwrite`` holds on it."""
    rest = [c for c in target.columns if c not in key]
    old = target.select(*key, F.struct(*rest).alias("_old"), overwrite.alias("_may"))
    fresh = new.select(*key, F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in rest]).alias("_new"))
    row = F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & ~F.col("_may")), F.col("_old")).otherwise(F.col("_new"))
    return old.join(fresh, key, "full").select(*key, row.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def clear_window(df: DataFrame, machine_ids: list[str], ts: str, start: str, *, inclusive: bool, source: str | None = "SIMULATED") -> DataFrame:
    """What remains after the machines' rows from ``start`` on (of one source) are dropped."""
    at = F.lit(start).cast("timestamp")
    late = F.col(ts) >= at if inclusive else F.col(ts) > at
    drop = F.col("machine_id").isin(*machine_ids) & late
    if source is not None:
        drop = drop & (F.col("source") == source)
    return df.where(~drop)


def reopen_latest_state(spans: DataFrame, machine_ids: list[str], start: str) -> DataFrame:
    """Spans that began by ``start``; the newest of each machine is open again."""
    kept = clear_window(spans, machine_ids, "ts_start", start, inclusive=False, source=None)
    newest = kept.groupBy("machine_id").agg(F.max("ts_start").alias("_newest"))
    again = F.col("machine_id").isin(*machine_ids) & (F.col("ts_start") == F.col("_newest"))
    return kept.join(newest, "machine_id").withColumn("ts_end", F.when(~again, F.col("ts_end"))).drop("_newest")


def counter_at(tel: DataFrame, machine_ids: list[str], start: str) -> DataFrame:
    """The meter counter at or before ``start`` per machine."""
    rows = tel.where(F.col("machine_id").isin(*machine_ids) & (F.col("ts") <= F.lit(start).cast("timestamp")))
    return rows.groupBy("machine_id").agg(F.coalesce(F.max_by("energy_kwh", "ts"), F.lit(0.0)).alias("energy_kwh"))


def audit_ingest(validated: DataFrame, duplicates: DataFrame, received: DataFrame) -> DataFrame:
    """Audit rows of one batch: counts of the ingest and the range of the backfill."""
    q = F.col("quality")
    c = validated.agg(F.count_if(q == "GOOD").alias("accepted"), F.count_if(q == "SUSPECT").alias("suspect"), F.count_if(q == "BAD").alias("bad"))
    d = duplicates.agg(F.sum("duplicate").alias("duplicate"))
    r = received.agg(F.count("*").alias("row_count"), F.min("ts").alias("start"), F.max("ts").alias("end"),
                     F.count_distinct("machine_id").alias("n_machines"), F.min("machine_id").alias("first_machine"), F.max("machine_id").alias("last_machine"))
    ingest = c.crossJoin(d).select(F.lit("ingest").alias("action"), F.lit("telemetry").alias("entity"),
                                   F.to_json(F.struct("accepted", "suspect", "bad", "duplicate")).alias("detail"))
    backfill = r.select(F.lit("backfill").alias("action"), F.lit("telemetry").alias("entity"),
                        F.to_json(F.struct("n_machines", "first_machine", "last_machine", "row_count")).alias("detail"))
    return ingest.unionByName(backfill)


def audit_transitions(changes: DataFrame) -> DataFrame:
    """One audit row per status change (entity_id, from_status, to_status)."""
    return changes.select(F.lit("lifecycle.transition").alias("action"), F.lit("recommendation").alias("entity"), "entity_id",
                          F.to_json(F.struct(F.col("from_status").alias("from"), F.col("to_status").alias("to"))).alias("detail"))
