"""Registered queries: ingestion quality (every reading of the event table)."""

from pyspark.sql import functions as F

from wattloom.operators import ingest
from wattloom.plans.common import S, Plant, query

SPLIT = "2024-01-16 00:00:00"
NOW = "2024-01-30 12:00:00"


def _unique(p: Plant):
    return p.unique()


def _stored_and_batch(p: Plant):
    """The first half month plays the stored table, everything from the day before on the new batch."""
    r = p.readings()
    stored = ingest.first_arrivals(r.where(F.col("ts") < F.lit(SPLIT).cast("timestamp")))
    return stored, r.where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query("dedup_readings", """
SELECT machine_id, ts, seq, round(power_kw, 4) AS power_kw, round(energy_kwh, 4) AS energy_kwh, machine_state, source FROM (
 SELECT * FROM f_readings WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY machine_id, ts ORDER BY seq) = 1) b
WHERE NOT EXISTS (SELECT 1 FROM f_readings s WHERE s.ts < TIMESTAMP '2024-01-16' AND s.machine_id = b.machine_id AND s.ts = b.ts)
""")
def _(p):
    stored, batch = _stored_and_batch(p)
    return ingest.first_arrivals(batch, stored).select(
        "machine_id", "ts", "seq", "power_kw", "energy_kwh", "machine_state", "source")


@query("duplicate_count", """
SELECT machine_id, CAST(sum(copies) AS BIGINT) AS received, CAST(sum(copies - CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END) AS BIGINT) AS duplicate
FROM (SELECT machine_id, ts, count(*) AS copies FROM f_readings WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL) GROUP BY machine_id
""")
def _(p):
    stored, batch = _stored_and_batch(p)
    return ingest.duplicate_count(batch, stored)


@query("flag_impossible", """
SELECT machine_id, seq, array_to_string(list_filter([
  CASE WHEN voltage_v < 0 THEN 'impossible: voltage_v < 0' END, CASE WHEN current_a < 0 THEN 'impossible: current_a < 0' END,
  CASE WHEN power_kw < 0 THEN 'impossible: power_kw < 0' END,
  CASE WHEN power_factor < 0 OR power_factor > 1 THEN 'impossible: power_factor outside 0..1' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM f_unique WHERE reasons <> ''
""")
def _(p):
    return (_unique(p).select("machine_id", "seq", ingest.compact(*ingest.impossible_reasons()).alias("reasons"))
            .where(F.size("reasons") > 0))


@query("flag_future", f"""
SELECT machine_id, seq, ts, 'BAD: ts in future beyond 300s clock-skew tolerance' AS reason FROM f_unique
WHERE ts > TIMESTAMP '{NOW}' + INTERVAL 300 SECOND
""")
def _(p):
    return _unique(p).select("machine_id", "seq", "ts", ingest.future_reason(NOW).alias("reason")).where("reason is not null")


@query("flag_stale", f"""
SELECT machine_id, seq, ts, 'SUSPECT: stale ts older than 900s threshold' AS reason FROM f_unique
WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 900 SECOND
""")
def _(p):
    return _unique(p).select("machine_id", "seq", "ts", ingest.stale_reason(NOW).alias("reason")).where("reason is not null")


@query("flag_out_of_order", """
SELECT machine_id, seq, ts, last_ts FROM f_arrival WHERE ts <= last_ts
""")
def _(p):
    df = ingest.with_arrival_state(_unique(p))
    return df.where(~F.col("in_order")).select("machine_id", "seq", "ts", "last_ts")


@query("flag_counter_decreasing", """
SELECT machine_id, seq, ts, round(energy_kwh, 4) AS energy_kwh, round(last_energy, 4) AS last_energy FROM f_ordered
WHERE in_order AND energy_kwh < last_energy
""")
def _(p):
    df = ingest.with_arrival_state(_unique(p))
    return df.where(ingest.counter_reason().isNotNull()).select("machine_id", "seq", "ts", "energy_kwh", "last_energy")


@query("flag_spike", """
SELECT machine_id, seq, round(power_kw, 4) AS power_kw, rated_power_kw FROM f_unique JOIN f_machine USING (machine_id)
WHERE rated_power_kw > 0 AND power_kw > 1.5 * rated_power_kw
""")
def _(p):
    df = _unique(p).join(p.machines, "machine_id")
    return df.where(ingest.spike_reason().isNotNull()).select("machine_id", "seq", "power_kw", "rated_power_kw")


@query("validate_telemetry", """
SELECT machine_id, ts, seq, round(power_kw, 4) AS power_kw, round(energy_kwh, 4) AS energy_kwh, machine_state, quality,
 array_to_string(quality_reasons, '; ') AS quality_reasons FROM f_tel
""")
def _(p):
    return p.telemetry().select("machine_id", "ts", "seq", "power_kw", "energy_kwh", "machine_state", "quality", "quality_reasons")


@query("validate_telemetry_after_store", """
SELECT machine_id, seq, quality, array_to_string(quality_reasons, '; ') AS quality_reasons FROM (
 SELECT *, CASE WHEN len(bad) > 0 THEN 'BAD' WHEN len(suspect) > 0 THEN 'SUSPECT' ELSE 'GOOD' END AS quality, bad || suspect AS quality_reasons FROM (
 SELECT o.*, list_filter([
   CASE WHEN power_kw < 0 THEN 'impossible: power_kw < 0' END,
   CASE WHEN power_factor NOT BETWEEN 0 AND 1 THEN 'impossible: power_factor outside 0..1' END,
   CASE WHEN ts > TIMESTAMP '2024-01-30 12:05:00' THEN 'BAD: ts in future beyond 300s clock-skew tolerance' END,
   CASE WHEN in_order AND energy_kwh < last_energy THEN 'BAD: cumulative energy_kwh decreasing' END], lambda x: x IS NOT NULL) AS bad,
  list_filter([CASE WHEN ts < TIMESTAMP '2024-01-30 11:45:00' THEN 'SUSPECT: stale ts older than 900s threshold' END,
   CASE WHEN NOT in_order THEN 'SUSPECT: out-of-order ts vs last stored ts for machine' END,
   CASE WHEN power_kw > 1.5 * rated_power_kw THEN 'SUSPECT: power spike above 1.5x rated power' END], lambda x: x IS NOT NULL) AS suspect
 FROM (SELECT *, greatest(seed_kwh, max(CASE WHEN in_order THEN energy_kwh END)
    OVER (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS last_energy
  FROM (SELECT *, ts > last_ts AS in_order FROM (
   SELECT b.*, seed_kwh, greatest(seed_ts, max(b.ts) OVER (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS last_ts
   FROM f_unique b JOIN (SELECT machine_id, max(ts) AS seed_ts, max_by(energy_kwh, ts) AS seed_kwh FROM f_unique WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1) USING (machine_id)
   WHERE b.ts >= TIMESTAMP '2024-01-16'))) o JOIN f_machine USING (machine_id)))
""")
def _(p):
    stored, batch = _stored_and_batch(p)
    fresh = ingest.first_arrivals(batch, stored)
    return ingest.validate_telemetry(fresh, p.machines, now=NOW, stored=stored).select(
        "machine_id", "seq", "quality", "quality_reasons")


@query("validate_production", """
SELECT window_start, round(qty_total_kg, 4) AS qty_total_kg, round(qty_good_kg, 4) AS qty_good_kg, round(qty_rejected_kg, 4) AS qty_rejected_kg,
 quality, array_to_string(quality_reasons, '; ') AS quality_reasons FROM f_prod
""")
def _(p):
    return p.production().select("window_start", "qty_total_kg", "qty_good_kg", "qty_rejected_kg", "quality", "quality_reasons")


@query("ingest_counts", """
SELECT machine_id, count(*) FILTER (quality = 'GOOD') AS accepted, count(*) FILTER (quality = 'SUSPECT') AS suspect,
 count(*) FILTER (quality = 'BAD') AS bad, any_value(duplicate) AS duplicate
FROM f_tel JOIN (SELECT machine_id, count(*) - count(DISTINCT ts) AS duplicate FROM f_readings GROUP BY 1) USING (machine_id) GROUP BY machine_id
""")
def _(p):
    return ingest.ingest_counts(p.telemetry(), ingest.duplicate_count(p.readings()))


@query("machine_state_spans", """
SELECT machine_id, machine_state AS state, ts AS ts_start, lead(ts) OVER (PARTITION BY machine_id ORDER BY seq) AS ts_end, source FROM (
 SELECT *, lag(machine_state) OVER (PARTITION BY machine_id ORDER BY seq) AS prev FROM f_unique WHERE machine_state IS NOT NULL)
WHERE prev IS NULL OR prev <> machine_state
""")
def _(p):
    return ingest.machine_state_spans(_unique(p)).drop("seq")


@query("sensor_last_seen", """
SELECT sensor_id, machine_id, channel, last_seen_at FROM f_sensor LEFT JOIN (SELECT machine_id, max(ts) AS last_seen_at FROM f_unique GROUP BY 1) USING (machine_id)
""")
def _(p):
    return ingest.sensor_last_seen(_unique(p), p.sensors)


__all__ = ["S"]
