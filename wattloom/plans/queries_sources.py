"""Registered queries: messages, registers, files, keyed writes and reads."""

from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.operators import ingest, intervals, reads
from wattloom.plans import queries_health as QH
from wattloom.plans.common import S, fragment, query
from wattloom.plans.queries_energy import meter
from wattloom.sources import files, messages, registers, store


# -- messages ------------------------------------------------------------------
def message_rows(p):
    """Payload text per reading; a few arrival numbers in each thousand are spoilt in different ways."""
    def build():
        m = F.pmod("seq", F.lit(1000))
        iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        one = F.concat(F.lit('{"ts":"'), iso, F.when(m == 40, "").otherwise("+00:00"), F.lit('","power_kw":'),
                       F.when(m == 20, '"12"').when(m == 80, "true").otherwise(F.col("power_kw").cast("string")),
                       F.lit(',"energy_kwh":'), F.col("energy_kwh").cast("string"),
                       F.when(m == 10, ',"foo":1').when(m == 30, ',"machine_id":"other"').otherwise(""),
                       F.when(m == 70, ',"machine_state":"boiling"').when(F.col("machine_state").isNull(), "")
                       .otherwise(F.concat(F.lit(',"machine_state":"'), F.col("machine_state"), F.lit('"'))),
                       F.when(m == 170, "").otherwise(F.concat(F.lit(',"source":"'), F.when(m == 60, "GUESSED").otherwise(F.col("source")), F.lit('"'))),
                       F.lit("}"))
        bad = F.lit('{"ts":"2024-01-01T00:00:00+00:00","source":"GUESSED"}')
        window = F.concat(F.lit('{"machine_id":"furnace-01","window_start":"'), iso, F.lit('+00:00","window_end":"'), iso,
                          F.lit('+00:00","source":"MEASURED","qty_total_kg":10,"qty_good_kg":9.5'))
        payload = (F.when(m == 35, "not json{").when(m == 90, F.concat(F.lit('{"records":['), one, F.lit(","), one, F.lit("]}")))
                   .when(m == 110, F.concat(F.lit('{"records":['), one, F.lit(","), bad, F.lit("]}")))
                   .when(m == 120, '{"power_kw":1}').when(m == 130, "[1,2]").when(m == 160, '{"ts":"yesterday"}')
                   .when(m == 140, F.concat(window, F.lit(',"qty_rejected_kg":0.5,"batch_id":"b"}'))).when(m == 150, F.concat(window, F.lit("}"))).otherwise(one))
        topic = (F.when(m == 100, "plant/site-1/x").when(m.isin(140, 150), "plant/site-1/production")
                 .otherwise(F.concat(F.lit("plant/site-1/"), F.col("machine_id"), F.lit("/telemetry"))))
        return p.readings().select("seq", topic.alias("topic"), payload.alias("payload"))
    return p.stage("messages", build)


def parsed(p):
    return messages.parse_messages(message_rows(p))


fragment("f_reason", """
SELECT *, CASE m WHEN 100 THEN 'unsupported topic' WHEN 35 THEN 'payload is not UTF-8 JSON'
 WHEN 130 THEN 'payload must be a JSON object or {''records'': [objects]}' WHEN 30 THEN 'payload machine_id does not match topic'
 WHEN 60 THEN 'unknown source class' WHEN 110 THEN 'unknown source class' WHEN 10 THEN 'unknown field(s)' WHEN 70 THEN 'unknown machine_state'
 WHEN 120 THEN 'ts missing or not a timestamp' WHEN 160 THEN 'ts is not ISO-8601' WHEN 40 THEN 'ts must be timezone-aware'
 WHEN 20 THEN 'power_kw must be a number' WHEN 80 THEN 'power_kw must be a number' WHEN 150 THEN 'production fields invalid' END AS reason
FROM (SELECT *, seq % 1000 AS m FROM f_readings)
""")


@query("route_topic", """
SELECT seq, CASE WHEN m = 100 THEN NULL WHEN m IN (140, 150) THEN 'production' ELSE 'telemetry' END AS kind,
 CASE WHEN m NOT IN (100, 140, 150) THEN machine_id END AS topic_machine FROM f_reason
""")
def _(p):
    return messages.route_topic(message_rows(p)).select("seq", "kind", "topic_machine")


@query("parse_messages", """
SELECT seq, machine_id, ts, round(power_kw, 4) AS power_kw, round(energy_kwh, 4) AS energy_kwh, machine_state,
 CASE WHEN m = 170 THEN 'MEASURED' ELSE source END AS source
FROM f_reason, LATERAL (SELECT unnest(range(0, CASE WHEN m = 90 THEN 2 ELSE 1 END))) WHERE reason IS NULL AND m <> 140
""")
def _(p):
    return messages.good_telemetry(parsed(p)).select("seq", "machine_id", "ts", "power_kw", "energy_kwh", "machine_state", "source")


@query("canonical_telemetry", "SELECT seq, reason FROM f_reason WHERE m NOT IN (35, 100, 130, 140, 150) AND (reason IS NOT NULL)")
def _(p):
    return parsed(p).where("kind = 'telemetry' and reason is not null and size(recs) > 0 and recs[0] is not null").select("seq", "reason")


@query("canonical_production", """
SELECT seq, 'furnace-01' AS machine_id, ts AS window_start, 10.0::DOUBLE AS qty_total_kg, 9.5::DOUBLE AS qty_good_kg, 0.5::DOUBLE AS qty_rejected_kg, 'b' AS batch_id
FROM f_reason WHERE m = 140
""")
def _(p):
    return messages.good_production(parsed(p)).select("seq", "machine_id", "window_start", "qty_total_kg", "qty_good_kg", "qty_rejected_kg", "batch_id")


@query("dead_letter_split", "SELECT seq, reason FROM f_reason WHERE reason IS NOT NULL")
def _(p):
    return messages.dead_letter(parsed(p)).select("seq", "reason")


@query("unknown_machine_reject", "SELECT seq, machine_id, 'unknown machine_id' AS reason FROM f_unique WHERE machine_id = 'pump-01'")
def _(p):
    known = p.machines.where("machine_id <> 'pump-01'")
    return messages.unknown_machines(ingest.first_arrivals(p.readings()), known).select("seq", "machine_id", "reason")


@query("known_machine_accept", "SELECT machine_id, count(*) AS n FROM f_unique WHERE machine_id <> 'pump-01' GROUP BY 1")
def _(p):
    known = p.machines.where("machine_id <> 'pump-01'")
    return messages.known_machines(ingest.first_arrivals(p.readings()), known).groupBy("machine_id").agg(F.count("*").alias("n"))


# -- registers -----------------------------------------------------------------
def register_rows(p):
    """Register words per reading: unsigned, signed, two-word and single-float fields."""
    b = S.base(p.spark, p.sf_dir)
    e, k = F.col("event_id"), F.col("k")
    watts = F.round(F.col("value") * 1000).cast("long") * F.when(e % 211 == 0, -1).otherwise(1)
    word = F.when(watts < 0, watts + 4294967296).otherwise(watts)
    wh = e * 1000 + F.col("cents") % 1000
    exp = F.floor(F.log2(F.col("k") + 0.5)).cast("int")
    bits = F.when(k == 0, 0).when(e % 130 == 0, 2139095040).otherwise((exp + 127) * 8388608 + (k - F.pow(F.lit(2), exp).cast("long")) * F.pow(F.lit(2), 23 - exp).cast("long"))
    regs = F.array(*[F.struct(F.lit(a).alias("address"), r.cast("long").alias("reg")) for a, r in enumerate([
        F.when(e % 90 == 0, 65535).otherwise(k * 10 + 4000), F.col("cents") % 60001, F.floor(word / 65536), word % 65536,
        F.when(e % 70 == 0, 1200).when(e % 71 == 0, 65000).otherwise(k * 10), wh % 65536, F.floor(wh / 65536), F.floor(bits / 65536), bits % 65536])])
    return (b.select(F.col("machine_id").alias("device"), e.alias("poll"), F.explode(regs).alias("r")).select("device", "poll", "r.*")
            .where(~((F.col("poll") % 110 == 0) & (F.col("address") == 1))))


fragment("f_regs", """
SELECT machine_id AS device, event_id AS poll, k, cents, round(value * 1000) * CASE WHEN event_id % 211 = 0 THEN -1 ELSE 1 END AS w,
 event_id * 1000 + cents % 1000 AS wh FROM f_base
""")


@query("decode_registers", """
SELECT device, poll, field, round(value, 4) AS value, issue FROM (
 SELECT device, poll, 'voltage_v' AS field, CASE WHEN poll % 90 <> 0 THEN (4000 + k * 10) * 0.1::DOUBLE END AS value, CASE WHEN poll % 90 = 0 THEN 'device reports ''not available''' END AS issue FROM f_regs
 UNION ALL SELECT device, poll, 'current_a', CASE WHEN poll % 110 <> 0 AND cents % 60001 * 0.01::DOUBLE <= 600 THEN (cents % 60001) * 0.01::DOUBLE END,
  CASE WHEN poll % 110 = 0 THEN 'register 1 not read' WHEN cents % 60001 * 0.01::DOUBLE > 600 THEN 'outside plausible range' END FROM f_regs
 UNION ALL SELECT device, poll, 'power_kw', w * 0.001::DOUBLE, NULL FROM f_regs
 UNION ALL SELECT device, poll, 'power_factor', CASE WHEN poll % 70 <> 0 AND poll % 71 <> 0 THEN k * 10 * 0.001::DOUBLE END, CASE WHEN poll % 70 = 0 OR poll % 71 = 0 THEN 'outside plausible range' END FROM f_regs
 UNION ALL SELECT device, poll, 'energy_kwh', CASE WHEN wh <= 4000000000 THEN wh * 0.001::DOUBLE END, CASE WHEN wh > 4000000000 THEN 'outside plausible range' END FROM f_regs
 UNION ALL SELECT device, poll, 'reactive_power_kvar', CASE WHEN k = 0 OR poll % 130 <> 0 THEN k::DOUBLE END, CASE WHEN k <> 0 AND poll % 130 = 0 THEN 'device reports ''not available''' END FROM f_regs)
""")
def _(p):
    return registers.decode_registers(register_rows(p))


# -- files ---------------------------------------------------------------------
@query("read_meter_csv", """
SELECT dt, load_type, kwh, round(kvarh, 4) AS kvarh, CASE WHEN dayofweek(dt) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS week_status,
 hour(dt) * 3600 + minute(dt) * 60 AS nsm FROM f_meter
""")
def _(p):
    path = f"{p.root}/meter_csv"
    files.write_meter_csv(meter(p), path)
    return files.read_meter_csv(p.spark, path)


@query("write_dataset", """
SELECT CAST(ts AS DATE) AS day, machine_id, count(*) AS n, max(seq) AS last_seq FROM f_tel GROUP BY 1, 2
""")
def _(p):
    path = f"{p.root}/dataset"
    files.write_dataset(p.telemetry(), p.production(), path)
    return p.spark.read.parquet(path).groupBy("day", "machine_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


# -- keyed writes ----------------------------------------------------------------
@query("insert_ignore", """
SELECT machine_id, rule_id, dedup_key FROM f_ev WHERE window_start >= TIMESTAMP '2024-01-16'
""")
def _(p):
    stored = p.events().where(F.col("window_start") < F.lit("2024-01-16").cast("timestamp"))
    return store.insert_ignore(p.events(), stored, ["dedup_key"]).select("machine_id", "rule_id", "dedup_key")


@query("insert_counts", """
SELECT count(*) FILTER (window_start >= TIMESTAMP '2024-01-16') AS created, count(*) FILTER (window_start < TIMESTAMP '2024-01-16') AS already_existing FROM f_ev
""")
def _(p):
    stored = p.events().where(F.col("window_start") < F.lit("2024-01-16").cast("timestamp"))
    return store.insert_counts(p.events(), stored, ["dedup_key"])


@query("upsert_where", """
SELECT window_start, CASE WHEN source = 'SIMULATED' AND k2 % 3 = 0 THEN round(qty_good_kg * 2, 4) ELSE round(qty_good_kg, 4) END AS qty_good_kg,
 CASE WHEN source = 'SIMULATED' AND k2 % 3 = 0 THEN 'DERIVED' ELSE source END AS source
FROM (SELECT *, CAST(epoch(window_start) AS BIGINT) // isec AS k2 FROM f_prod, f_params)
""")
def _(p):
    cols = ["machine_id", "window_start", "qty_good_kg", "source"]
    target = p.production().select(*cols)
    k = F.expr(f"unix_seconds(window_start) div {p.interval_s}")
    new = target.where(k % 3 == 0).withColumns({"qty_good_kg": F.col("qty_good_kg") * 2, "source": F.lit("DERIVED")})
    out = store.upsert_where(new, target, ["machine_id", "window_start"], F.col("source") == "SIMULATED")
    return out.select("window_start", "qty_good_kg", "source")


_CUT = "2024-01-20 06:00:00"


@query("replace_window", f"""
SELECT 'telemetry' AS part, machine_id, count(*) AS n, max(ts) AS newest FROM f_tel WHERE NOT (machine_id IN ('furnace-01', 'pump-01') AND ts > TIMESTAMP '{_CUT}' AND source = 'SIMULATED') GROUP BY machine_id
UNION ALL SELECT 'production', machine_id, count(*), max(window_start) FROM f_prod WHERE NOT (window_start >= TIMESTAMP '{_CUT}' AND source = 'SIMULATED') GROUP BY machine_id
UNION ALL SELECT 'anomaly', machine_id, count(*), max(window_end) FROM f_ev WHERE NOT (machine_id IN ('furnace-01', 'pump-01') AND window_end > TIMESTAMP '{_CUT}') GROUP BY machine_id
""")
def _(p):
    ms = ["furnace-01", "pump-01"]
    def part(name, df, ts):
        return df.groupBy("machine_id").agg(F.count("*").alias("n"), F.max(ts).alias("newest")).withColumn("part", F.lit(name))
    tel = store.clear_window(p.telemetry(), ms, "ts", _CUT, inclusive=False)
    prod = store.clear_window(p.production(), ms, "window_start", _CUT, inclusive=True)
    ev = store.clear_window(p.events(), ms, "window_end", _CUT, inclusive=False, source=None)
    return part("telemetry", tel, "ts").unionByName(part("production", prod, "window_start")).unionByName(part("anomaly", ev, "window_end"))


@query("reopen_latest_state", f"""
SELECT machine_id, state, ts_start, CASE WHEN machine_id IN ('furnace-01', 'pump-01') AND ts_start = max(ts_start) OVER (PARTITION BY machine_id) THEN NULL ELSE ts_end END AS ts_end
FROM (SELECT machine_id, machine_state AS state, ts AS ts_start, lead(ts) OVER (PARTITION BY machine_id ORDER BY seq) AS ts_end FROM (
 SELECT *, lag(machine_state) OVER (PARTITION BY machine_id ORDER BY seq) AS prev FROM f_unique WHERE machine_state IS NOT NULL) WHERE prev IS NULL OR prev <> machine_state)
WHERE NOT (machine_id IN ('furnace-01', 'pump-01') AND ts_start > TIMESTAMP '{_CUT}')
""")
def _(p):
    spans = ingest.machine_state_spans(ingest.first_arrivals(p.readings()))
    return store.reopen_latest_state(spans, ["furnace-01", "pump-01"], _CUT).select("machine_id", "state", "ts_start", "ts_end")


@query("counter_at", f"""
SELECT machine_id, round(max_by(energy_kwh, ts), 4) AS energy_kwh FROM f_tel WHERE machine_id IN ('furnace-01', 'pump-01') AND ts <= TIMESTAMP '{_CUT}' GROUP BY 1
""")
def _(p):
    return store.counter_at(p.telemetry(), ["furnace-01", "pump-01"], _CUT)


@query("audit_log", """
SELECT 'ingest' AS action, 'telemetry' AS entity, '{"accepted":' || count(*) FILTER (quality = 'GOOD') || ',"suspect":' || count(*) FILTER (quality = 'SUSPECT')
 || ',"bad":' || count(*) FILTER (quality = 'BAD') || ',"duplicate":' || any_value(d) || '}' AS detail
FROM f_tel, (SELECT (SELECT count(*) FROM f_readings) - (SELECT count(*) FROM f_unique) AS d)
UNION ALL SELECT 'backfill', 'telemetry', '{"n_machines":' || count(DISTINCT machine_id) || ',"first_machine":"' || min(machine_id) || '","last_machine":"' || max(machine_id) || '","row_count":' || count(*) || '}' FROM f_readings
""")
def _(p):
    return store.audit_ingest(p.telemetry(), ingest.duplicate_count(p.readings()), p.readings())


# -- reads -----------------------------------------------------------------------
@query("recent_telemetry", """
SELECT machine_id, ts, round(power_kw, 4) AS power_kw, quality FROM f_tel WHERE machine_id = 'furnace-01' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 1000
""")
def _(p):
    return reads.recent(p.telemetry(), "ts", machine_id="furnace-01", start="2024-01-10", end="2024-01-20").select("machine_id", "ts", "power_kw", "quality")


@query("recent_production", "SELECT machine_id, window_start, round(qty_good_kg, 4) AS qty_good_kg FROM f_prod ORDER BY window_start DESC LIMIT 48")
def _(p):
    return reads.recent(p.production(), "window_start", limit=48).select("machine_id", "window_start", "qty_good_kg")


@query("latest_per_machine", """
SELECT machine_id, ts, round(power_kw, 4) AS power_kw, round(energy_kwh, 4) AS energy_kwh, machine_state FROM f_tel QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC) = 1
""")
def _(p):
    return reads.latest_per_machine(p.telemetry(), "ts").select("machine_id", "ts", "power_kw", "energy_kwh", "machine_state")


@query("list_anomalies", "SELECT dedup_key, rule_id, window_start FROM f_ev WHERE machine_id = 'furnace-01' AND status = 'OPEN'")
def _(p):
    return reads.listing(p.events(), "window_start", machine_id="furnace-01", status="OPEN").select("dedup_key", "rule_id", "window_start")


@query("list_health", """
SELECT machine_id, window_start, status, health_score FROM f_health WHERE machine_id = 'pump-01' AND window_start >= TIMESTAMP '2024-01-05' AND window_start < TIMESTAMP '2024-01-25'
""")
def _(p):
    return reads.listing(QH.health_rows(p), "window_start", machine_id="pump-01", start="2024-01-05", end="2024-01-25",
                         model_id="statistical-v1").select("machine_id", "window_start", "status", "health_score")


@query("list_dimensions", """
SELECT m.machine_id, m.name, m.machine_type, m.site_id, count(t.ts) AS n_readings FROM f_machine m LEFT JOIN f_tel t USING (machine_id) GROUP BY ALL
""")
def _(p):
    n = p.telemetry().groupBy("machine_id").agg(F.count("*").alias("n_readings"))
    return p.machines.join(n, "machine_id", "left").select("machine_id", "name", "machine_type", "site_id", "n_readings").orderBy("machine_id")


@query("list_sites", """
SELECT site_id, count(DISTINCT m.machine_id) AS n_machines, (SELECT count(*) FROM f_sensor) AS n_sensors, count(t.ts) AS n_readings, max(t.ts) AS newest
FROM f_machine m LEFT JOIN f_tel t USING (machine_id) GROUP BY 1
""")
def _(p):
    return reads.sites(p.machines, p.sensors, p.telemetry())


@query("overlapping", """
SELECT dedup_key, window_start, window_end FROM f_ev WHERE window_start < TIMESTAMP '2024-01-23 12:00:00' AND window_end > TIMESTAMP '2024-01-21 03:00:00'
""")
def _(p):
    return reads.overlapping(p.events(), "2024-01-21 03:00:00", "2024-01-23 12:00:00").select("dedup_key", "window_start", "window_end")


@query("tariff_in_force", """
SELECT period_name, start_min, end_min, rate AS energy_inr_per_kwh, count(ts) AS n, round(avg(power_kw), 4) AS mean_kw FROM (
 SELECT *, rank() OVER (PARTITION BY site_id ORDER BY valid_from DESC) AS r FROM f_tariff WHERE valid_from <= (SELECT max(CAST(ts AS DATE)) FROM f_tel)) f
LEFT JOIN (SELECT ts, power_kw, hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE) AS lm FROM f_tel) t
 ON CASE WHEN start_min < end_min THEN lm >= start_min AND lm < end_min ELSE lm >= start_min OR lm < end_min END
WHERE r = 1 GROUP BY 1, 2, 3, 4
""")
def _(p):
    on = p.telemetry().agg(F.max("ts").cast("date").cast("string")).first()[0]
    return reads.priced_by_period(p.telemetry(), reads.tariff_in_force(p.tariff, on), S.SITE, C.LOCAL_TZ).drop("site_id")


@query("tariff_label", """
SELECT site_id, tariff_label, count(*) AS n_priced, round(sum(power_kw), 4) AS kw_sum FROM f_tel JOIN f_machine USING (machine_id) JOIN (
 SELECT site_id, CASE WHEN count(*) FILTER (source_class <> 'ASSUMPTION') = 0 THEN 'ILLUSTRATIVE (ASSUMPTION)' ELSE 'plant tariff' END AS tariff_label
 FROM f_tariff WHERE valid_from >= DATE '2024-01-01' GROUP BY 1) USING (site_id) GROUP BY 1, 2
""")
def _(p):
    on = p.telemetry().agg(F.max("ts").cast("date").cast("string")).first()[0]
    label = reads.tariff_label(reads.tariff_in_force(p.tariff, on))
    rows = p.telemetry().join(p.machines.select("machine_id", "site_id"), "machine_id")
    per = rows.groupBy("site_id").agg(F.count("*").alias("n_priced"), F.sum("power_kw").alias("kw_sum"))
    return per.join(label, "site_id")


@query("acceptable_baseline", "SELECT machine_id, round(b_prod, 4) AS b_prod, round(b_idle, 4) AS b_idle FROM f_bl WHERE machine_type = 'furnace'")
def _(p):
    older = p.baselines().withColumns({"created_at": F.lit("2023-01-01").cast("timestamp"), "acceptance": F.lit("NOT_ACCEPTABLE")})
    b = reads.acceptable_baseline(p.baselines().unionByName(older))
    return b.select("machine_id", F.col("coefficients")["good_production_kg"].alias("b_prod"), F.col("coefficients")["hours_idle"].alias("b_idle"))


@query("acknowledge_event", "SELECT dedup_key, CASE WHEN rule_id = 'L1_POWER' THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status FROM f_ev")
def _(p):
    return reads.acknowledge(p.events(), p.events().where("rule_id = 'L1_POWER'").select("dedup_key")).select("dedup_key", "status")


__all__ = ["intervals"]
