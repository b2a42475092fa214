"""Registered queries: the streaming forms, run over the whole reading table to its end."""

from pyspark.sql import functions as F

from wattloom.operators.intervals import HOUR_COLUMNS
from wattloom.plans import queries_sources as QX
from wattloom.plans.base_sql import STATES
from wattloom.plans.common import S, query
from wattloom.plans.queries_energy import EVENT_SQL, event_columns
from wattloom.streaming import ingest as T


def _folder(p, name):
    return f"{p.root}/stream_{name}"


@query("stream_ingest", "SELECT 'accepted' AS part, count(*) AS n FROM f_reason, LATERAL (SELECT unnest(range(0, CASE WHEN m = 90 THEN 2 ELSE 1 END))) WHERE reason IS NULL AND m <> 140 AND machine_id <> 'pump-01' "
       "UNION ALL SELECT reason, count(*) FROM f_reason WHERE reason IS NOT NULL GROUP BY 1 "
       "UNION ALL SELECT 'unknown machine_id', count(*) FROM f_reason, LATERAL (SELECT unnest(range(0, CASE WHEN m = 90 THEN 2 ELSE 1 END))) WHERE reason IS NULL AND m <> 140 AND machine_id = 'pump-01'")
def _(p):
    if "stream_messages" not in p.marks:
        QX.message_rows(p)  # the stream reads the stage's own files
        known = p.machines.where("machine_id <> 'pump-01'")
        T.run_to_end(T.stream_ingest(T.read_files(p.spark, f"{p.root}/messages", T.MESSAGE_SCHEMA), known, _folder(p, "accepted"), _folder(p, "dead"), _folder(p, "ckpt_ingest")))
        p.marks.add("stream_messages")  # only after success
    good, dead = p.spark.read.parquet(_folder(p, "accepted")), p.spark.read.parquet(_folder(p, "dead"))
    return good.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("part"), "n").unionByName(dead.groupBy(F.col("reason").alias("part")).agg(F.count("*").alias("n")))


VALIDATED_SCHEMA = f"{T.READING_SCHEMA}, quality string, quality_reasons array<string>"
INTERVAL_SCHEMA = ("machine_id string, machine_type string, rated_power_kw double, window_start timestamp, window_end timestamp, complete boolean, "
                   f"energy_kwh double, {', '.join(f'{c} double' for c in HOUR_COLUMNS)}, good_production_kg double, "
                   "has_production_record boolean, power_max_kw double, pf_mean double")
EPOCHS = 4
_STORED_DAYS = 3  # of the dedup query: that many first days count as stored before the stream began


def _landed(p):
    """All reading streams over one landing folder that grows while they run, so that each has several epochs.

    Readings land in ``EPOCHS`` parts by ``seq``, redelivered copies and late rows among them; after each part every stream
    is started from its checkpoint and runs to the end of what is there. The last part ends in a mark of an unknown
    machine, days later, which lets the watermark pass the last readings.
    """
    if "landed" in p.marks:
        return
    land, valid, made = _folder(p, "landing"), _folder(p, "validated_out"), _folder(p, "production")
    readings, prod = p.readings(), p.production().select(*_names(T.PRODUCTION_SCHEMA))
    span = readings.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    part = F.least(F.lit(EPOCHS - 1), F.floor((F.col("seq") - F.col("lo")) * EPOCHS / (F.col("hi") - F.col("lo") + 1)))
    hour = F.floor((F.unix_seconds("window_start") - F.unix_seconds("first")) * EPOCHS / (F.unix_seconds("last") - F.unix_seconds("first") + 1))
    stored_before = F.date_add(F.to_date("first"), _STORED_DAYS)
    stored = p.unique().crossJoin(span.select("first")).where(F.col("ts") < stored_before).select("machine_id", "ts")
    far = span.select(F.lit("end").alias("machine_id"), (F.col("hi") + 1).alias("seq"), (F.col("last") + F.expr("INTERVAL '3' DAY")).alias("ts"))
    for i in range(EPOCHS):
        rows = readings.crossJoin(span.select("lo", "hi")).where(part == i).select(*_names(T.READING_SCHEMA))
        records = prod.crossJoin(span.select("first", "last")).where(F.greatest(F.lit(0), F.least(F.lit(EPOCHS - 1), hour)) == i).select(*_names(T.PRODUCTION_SCHEMA))
        if i == EPOCHS - 1:
            rows = rows.unionByName(_marked(far, T.READING_SCHEMA))
            records = records.unionByName(_marked(far.select("machine_id", F.col("ts").alias("window_start"), F.lit("GOOD").alias("quality")), T.PRODUCTION_SCHEMA))
        rows.write.mode("append").parquet(land)
        records.write.mode("append").parquet(made)
        new = T.read_files(p.spark, land, T.READING_SCHEMA)
        T.run_to_end(_to_files(p, T.stream_dedup(new, stored), "dedup"),
                     T.stream_validate(new, p.machines, valid, _folder(p, "validate_state"), _folder(p, "ckpt_validate"), now=S.END, backfill=True, insert=True))
        judged = T.read_files(p.spark, valid, VALIDATED_SCHEMA)
        found = T.stream_intervals(judged, T.read_files(p.spark, made, T.PRODUCTION_SCHEMA), p.machines, interval_s=p.interval_s)
        T.run_to_end(T.stream_state_spans(judged, _folder(p, "spans_out"), _folder(p, "spans_state"), _folder(p, "ckpt_spans")), small=[_to_files(p, found, "intervals")])
        closed = T.read_files(p.spark, _folder(p, "out_intervals"), INTERVAL_SCHEMA)
        T.run_to_end(T.stream_detect(closed, p.baselines(), _folder(p, "events"), _folder(p, "detect_state"), _folder(p, "ckpt_detect"), interval_s=p.interval_s))
    p.marks.add("landed")


def _names(schema):
    return [c.split()[0] for c in schema.split(", ")]


def _marked(df, schema):
    """The mark's columns, all others null."""
    have = set(df.columns)
    return df.select(*[F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in schema.split(", "))])


def _to_files(p, df, name):
    return df.writeStream.outputMode("append").format("parquet").option("path", _folder(p, f"out_{name}")).option("checkpointLocation", _folder(p, f"ckpt_{name}"))


@query("stream_dedup", f"""
SELECT machine_id, ts, seq, round(power_kw, 4) AS power_kw, round(energy_kwh, 4) AS energy_kwh, machine_state, source FROM f_unique
WHERE ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL {_STORED_DAYS} DAY FROM f_unique)
""")
def _(p):
    _landed(p)
    return p.spark.read.parquet(_folder(p, "out_dedup")).where("machine_id <> 'end'").select("machine_id", "ts", "seq", "power_kw", "energy_kwh", "machine_state", "source")


@query("stream_validate", "SELECT machine_id, seq, quality, array_to_string(quality_reasons, '; ') AS quality_reasons FROM f_tel")
def _(p):
    _landed(p)
    return p.spark.read.parquet(_folder(p, "validated_out")).where("machine_id <> 'end'").select("machine_id", "seq", "quality", "quality_reasons")


@query("stream_intervals", f"""
SELECT machine_id, window_start, window_end, complete, array_to_string(incomplete_reasons, '; ') AS incomplete_reasons,
 round(energy_kwh, 4) AS energy_kwh, {", ".join(f"hours_{s}" for s in STATES)}, n_good, n_bad, coverage_pct, round(good_production_kg, 4) AS good_production_kg,
 round(rejected_production_kg, 4) AS rejected_production_kg, has_production_record, round(power_max_kw, 4) AS power_max_kw,
 round(power_mean_kw, 4) AS power_mean_kw, round(pf_mean, 4) AS pf_mean
FROM f_iv WHERE has_production_record OR (machine_id, k) IN (SELECT (machine_id, k) FROM f_perbucket)
""")
def _(p):
    _landed(p)
    return p.spark.read.parquet(_folder(p, "out_intervals")).drop("machine_type", "rated_power_kw")


@query("stream_state_spans", """
SELECT machine_id, machine_state AS state, ts AS ts_start, te AS ts_end FROM (SELECT machine_id, machine_state, ts, lead(ts) OVER (PARTITION BY machine_id ORDER BY seq) AS te FROM (
 SELECT *, lag(machine_state) OVER (PARTITION BY machine_id ORDER BY seq) AS prev FROM f_unique WHERE machine_state IS NOT NULL) WHERE prev IS NULL OR prev <> machine_state) WHERE te IS NOT NULL
""")
def _(p):
    _landed(p)
    return p.spark.read.parquet(_folder(p, "spans_out")).select("machine_id", "state", "ts_start", "ts_end")


@query("stream_detect", EVENT_SQL)
def _(p):
    _landed(p)
    out, state = _folder(p, "events"), _folder(p, "detect_state")
    return event_columns(T.detected_events(p.spark, out, state, T.last_epoch(p.spark, state)))
