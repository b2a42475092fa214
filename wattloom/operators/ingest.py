"""Quality rules for incoming readings and production records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions import scan
from wattloom.functions.columns import compact, floor_div, micros

KEY = ["machine_id", "ts"]
SEQ_CHUNK = 100_000


def arrival_chunk(chunk: int = SEQ_CHUNK) -> Column:
    return floor_div(F.col("seq"), chunk)


def first_arrivals(batch: DataFrame, stored: DataFrame | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """First arrival of each (machine, ts); rows already stored are dropped.

    ``min_by`` combines on the map side, so a reading redelivered many times never
    gathers its copies in one task. ``within`` names columns that follow from the key:
    rows that already lie together by them (and the machine) are not shuffled again.
    """
    rest = [c for c in batch.columns if c not in (*KEY, *within)]
    first = batch.groupBy(*KEY, *within).agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select(*KEY, "_r.*")
    return first if stored is None else first.join(stored.select(*KEY), KEY, "left_anti")


def duplicate_count(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    per = batch.groupBy(*KEY).agg(F.count("*").alias("copies"))
    if stored is None:
        dup = F.col("copies") - 1
    else:
        known = stored.select(*KEY).distinct().withColumn("_known", F.lit(1))
        per = per.join(known, KEY, "left")
        dup = F.col("copies") - F.when(F.col("_known").isNull(), 1).otherwise(0)
    return per.groupBy("machine_id").agg(F.sum("copies").alias("received"), F.sum(dup).alias("duplicate"))


def impossible_reasons() -> list[Column]:
    pf = F.col("power_factor")
    return [
        F.when(F.col("voltage_v") < 0, "impossible: voltage_v < 0"),
        F.when(F.col("current_a") < 0, "impossible: current_a < 0"),
        F.when(F.col("power_kw") < 0, "impossible: power_kw < 0"),
        F.when(~pf.between(0.0, 1.0), "impossible: power_factor outside 0..1"),
    ]


def future_reason(now: str, skew_s: int = C.CLOCK_SKEW_S) -> Column:
    late = micros("ts") > micros(F.lit(now).cast("timestamp")) + skew_s * 1_000_000
    return F.when(late, f"BAD: ts in future beyond {skew_s}s clock-skew tolerance")


def stale_reason(now: str, stale_after_s: int = C.STALE_AFTER_S) -> Column:
    old = micros(F.lit(now).cast("timestamp")) - micros("ts") > F.lit(stale_after_s * 1_000_000).cast("long")
    return F.when(old, f"SUSPECT: stale ts older than {stale_after_s}s threshold")


def spike_reason(multiple: float = C.SPIKE_MULTIPLE) -> Column:
    rated = F.col("rated_power_kw")
    return F.when((rated > 0) & (F.col("power_kw") > rated * multiple),
                  f"SUSPECT: power spike above {multiple}x rated power")


ORDER_REASON = "SUSPECT: out-of-order ts vs last stored ts for machine"
COUNTER_REASON = "BAD: cumulative energy_kwh decreasing"


def with_arrival_state(df: DataFrame, stored: DataFrame | None = None, chunk: int = SEQ_CHUNK) -> DataFrame:
    """Adds ``last_ts`` / ``last_energy``: what the machine had seen before each arrival.

    Two ordered scans: the newest earlier timestamp, then the highest counter among
    the earlier in-order rows. ``stored`` seeds both with the latest stored reading.
    What a chunk inherits comes from its narrow columns; the whole rows are shuffled
    and sorted once, behind one row that holds it.
    """
    kind = {c: df.schema[c].dataType for c in ("ts", "energy_kwh")}
    df = df.withColumn("_chunk", arrival_chunk(chunk)).where(F.col("machine_id").isNotNull() & F.col("_chunk").isNotNull())
    earlier = Window.partitionBy("machine_id").orderBy("_chunk").rowsBetween(*scan.BEFORE)
    inside = Window.partitionBy("machine_id", "_chunk").orderBy("_real", "seq").rowsBetween(*scan.BEFORE)

    def seeded(carry: DataFrame, of: str) -> DataFrame:
        if stored is None:
            return carry
        seed = stored.groupBy("machine_id").agg((F.max("ts") if of == "ts" else F.max_by(of, "ts")).alias("_seed"))
        return carry.join(seed, "machine_id", "left").withColumn(of, F.greatest(of, F.col("_seed").cast(kind[of]))).drop("_seed")

    def scanned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("last_ts", F.max("ts").over(inside))
        return rows.withColumn("in_order", F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts")))
    tops = df.groupBy("machine_id", "_chunk").agg(F.max("ts").alias("ts"))
    carry = seeded(tops.withColumn("ts", F.max("ts").over(earlier)), "ts")
    narrow = scanned(scan.behind(df.select("machine_id", "_chunk", "seq", "ts", "energy_kwh"), carry))
    highest = narrow.groupBy("machine_id", "_chunk").agg(
        F.max(F.when(~F.col("_real"), F.col("ts"))).alias("ts"),
        F.max(F.when(F.col("_real") & F.col("in_order"), F.col("energy_kwh"))).alias("energy_kwh"))
    carry = seeded(highest.withColumn("energy_kwh", F.max("energy_kwh").over(earlier)), "energy_kwh")
    rows = scanned(scan.behind(df, carry))
    counter = F.when(~F.col("_real") | F.col("in_order"), F.col("energy_kwh"))
    return rows.withColumn("last_energy", F.max(counter).over(inside)).where("_real").drop("_chunk", "_real")


def out_of_order_reason() -> Column:
    return F.when(~F.col("in_order"), ORDER_REASON)


def counter_reason() -> Column:
    return F.when(F.col("in_order") & (F.col("energy_kwh") < F.col("last_energy")), COUNTER_REASON)


def validate_telemetry(df: DataFrame, machines: DataFrame, *, now: str, stored: DataFrame | None = None,
                       backfill: bool = False, stale_after_s: int = C.STALE_AFTER_S,
                       skew_s: int = C.CLOCK_SKEW_S, spike_multiple: float = C.SPIKE_MULTIPLE,
                       chunk: int = SEQ_CHUNK) -> DataFrame:
    """Every reading with ``quality`` and ``quality_reasons`` (bad reasons first)."""
    return verdicts(with_arrival_state(df, stored, chunk), machines, now=now, backfill=backfill, stale_after_s=stale_after_s,
                    skew_s=skew_s, spike_multiple=spike_multiple)


def verdicts(df: DataFrame, machines: DataFrame, *, now: str, backfill: bool = False, stale_after_s: int = C.STALE_AFTER_S,
             skew_s: int = C.CLOCK_SKEW_S, spike_multiple: float = C.SPIKE_MULTIPLE) -> DataFrame:
    """The rules row by row, over readings that already carry their arrival state."""
    df = df.join(machines.select("machine_id", "rated_power_kw"), "machine_id", "left")
    bad = compact(*impossible_reasons(), future_reason(now, skew_s), counter_reason())
    stale = [] if backfill else [stale_reason(now, stale_after_s)]
    suspect = compact(*stale, out_of_order_reason(), spike_reason(spike_multiple))
    quality = F.when(F.size("_bad") > 0, "BAD").when(F.size("_suspect") > 0, "SUSPECT").otherwise("GOOD")
    return (df.withColumns({"_bad": bad, "_suspect": suspect})
            .withColumns({"quality": quality, "quality_reasons": F.concat("_bad", "_suspect")})
            .drop("_bad", "_suspect", "rated_power_kw", "last_ts", "last_energy", "in_order"))


def validate_production(df: DataFrame) -> DataFrame:
    negative = [F.when(F.col(c) < 0, f"impossible: {c} < 0") for c in ("qty_total_kg", "qty_good_kg", "qty_rejected_kg")]
    over = F.col("qty_good_kg") + F.col("qty_rejected_kg") > F.col("qty_total_kg") + 1e-9
    reasons = compact(*negative, F.when(over, "impossible: qty_good_kg + qty_rejected_kg > qty_total_kg"))
    return (df.withColumn("quality_reasons", reasons)
            .withColumn("quality", F.when(F.size("quality_reasons") > 0, "BAD").otherwise("GOOD")))


def ingest_counts(validated: DataFrame, duplicates: DataFrame) -> DataFrame:
    """accepted / suspect / bad / duplicate per machine of one batch."""
    q = F.col("quality")
    per = validated.groupBy("machine_id").agg(
        F.count_if(q == "GOOD").alias("accepted"), F.count_if(q == "SUSPECT").alias("suspect"),
        F.count_if(q == "BAD").alias("bad"))
    return duplicates.select("machine_id", "duplicate").join(per, "machine_id", "left").na.fill(0)


def machine_state_spans(df: DataFrame, chunk: int = SEQ_CHUNK) -> DataFrame:
    """Spans of equal state in arrival order; the last one per machine stays open."""
    df = (df.where(F.col("machine_state").isNotNull())
          .select("machine_id", "seq", "ts", "machine_state", "source").withColumn("_chunk", arrival_chunk(chunk)))
    df = scan.previous_row(df, ["machine_id"], "_chunk", ["seq"], ["machine_state"], "_prev")
    starts = df.where(F.col("_prev").isNull() | (F.col("_prev.machine_state") != F.col("machine_state"))).drop("_prev")
    starts = scan.next_row(starts, ["machine_id"], "_chunk", ["seq"], ["ts"], "_next")
    return starts.select("machine_id", F.col("machine_state").alias("state"), F.col("ts").alias("ts_start"),
                         F.col("_next.ts").alias("ts_end"), "source", "seq")


def sensor_last_seen(df: DataFrame, sensors: DataFrame) -> DataFrame:
    """Newest non-duplicate reading of the machine, on each of its sensors."""
    newest = df.groupBy("machine_id").agg(F.max("ts").alias("last_seen_at"))
    return sensors.join(newest, "machine_id", "left")
