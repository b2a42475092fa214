"""Registered queries: daily process findings, machine health, energy x health insights, reads and lookups."""

from pyspark.sql import functions as F

from wattloom.operators import correlate, health, intervals, process
from wattloom.plans.common import S, fragment, query

# -- process efficiency -------------------------------------------------------
fragment("f_dayhours", """
SELECT machine_id, CAST(window_start + INTERVAL 330 MINUTE AS DATE) AS day, round_even(sum(hours_heating), 4) AS hours_heating, round_even(sum(hours_melting), 4) AS hours_melting,
 round_even(sum(hours_idle), 4) AS idle_hours, round_even(sum(hours_holding), 4) AS holding_hours, sum(energy_kwh) AS energy_kwh,
 coalesce(sum(energy_kwh) FILTER (coalesce(good_production_kg, 0) <= 0), 0) AS non_productive_kwh,
 CASE WHEN sum(energy_kwh) > 0 THEN coalesce(sum(energy_kwh) FILTER (coalesce(good_production_kg, 0) <= 0), 0) / sum(energy_kwh) END AS non_productive_share
FROM f_iv WHERE complete GROUP BY 1, 2
""")
fragment("f_trans", """
SELECT machine_id, ts, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, prev AS from_state, machine_state AS to_state,
 machine_state NOT IN ('idle','holding','stopped','shutdown','auxiliary') AND prev IN ('idle','holding','stopped','shutdown','auxiliary') AS is_start,
 machine_id = 'furnace-01' AND machine_state = 'heating' AS is_heat
FROM (SELECT machine_id, ts, machine_state, lag(machine_state) OVER (PARTITION BY machine_id ORDER BY ts) AS prev FROM f_tel
 WHERE quality = 'GOOD' AND machine_state IS NOT NULL) WHERE prev IS NOT NULL AND prev <> machine_state
""")
fragment("f_gaps", """
SELECT machine_id, day, median(gap) AS median_heat_gap_h FROM (SELECT machine_id, day,
 (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY machine_id, day ORDER BY ts))) / 3.6e9 AS gap FROM f_trans WHERE is_heat)
WHERE gap IS NOT NULL GROUP BY 1, 2
""")
fragment("f_daily", """
SELECT machine_id, machine_type, day, coalesce(idle_hours, 0) AS idle_hours, coalesce(holding_hours, 0) AS holding_hours, energy_kwh,
 coalesce(non_productive_kwh, 0) AS non_productive_kwh, non_productive_share, coalesce(start_count, 0) AS start_count, coalesce(heat_count, 0) AS heat_count,
 median_heat_gap_h, CASE WHEN machine_type = 'furnace' AND coalesce(heat_count, 0) > 0 THEN coalesce(holding_hours, 0) / heat_count END AS holding_per_heat_h
FROM (SELECT DISTINCT machine_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM f_tel WHERE quality = 'GOOD' AND machine_state IS NOT NULL) d
FULL JOIN f_dayhours USING (machine_id, day)
LEFT JOIN (SELECT machine_id, day, count(*) FILTER (is_start) AS start_count, count(*) FILTER (is_heat) AS heat_count FROM f_trans GROUP BY 1, 2) USING (machine_id, day)
LEFT JOIN f_gaps USING (machine_id, day) JOIN f_machine USING (machine_id)
""")
fragment("f_ref", """
SELECT machine_id, median(idle_hours) AS idle_hours, median(holding_per_heat_h) AS holding_per_heat_h, median(non_productive_share) AS non_productive_share,
 median(start_count) AS start_count, median(median_heat_gap_h) AS median_heat_gap_h, median(heat_count) AS heat_count
FROM f_daily WHERE day < DATE '2024-01-19' GROUP BY 1
""")
fragment("f_find", """
SELECT machine_id, day, metric, raw AS value, digits, unit, reference, raw > reference AS above_reference FROM (
 SELECT d.machine_id, d.day, 'idle_hours' AS metric, d.idle_hours AS raw, 3 AS digits, 'h' AS unit, r.idle_hours AS reference FROM f_daily d LEFT JOIN f_ref r USING (machine_id)
 UNION ALL SELECT machine_id, day, 'holding_hours_per_heat', CASE WHEN machine_type = 'furnace' THEN holding_per_heat_h ELSE holding_hours END, 3,
  CASE WHEN machine_type = 'furnace' THEN 'h_per_heat' ELSE 'h' END, CASE WHEN machine_type = 'furnace' THEN 0.25::DOUBLE END FROM f_daily
 UNION ALL SELECT d.machine_id, d.day, 'non_productive_share', d.non_productive_share, 4, 'fraction', r.non_productive_share FROM f_daily d LEFT JOIN f_ref r USING (machine_id)
 UNION ALL SELECT d.machine_id, d.day, 'start_count', d.start_count::DOUBLE, 9, 'count', r.start_count FROM f_daily d LEFT JOIN f_ref r USING (machine_id)
 UNION ALL SELECT d.machine_id, d.day, 'median_heat_gap_h', d.median_heat_gap_h, 3, 'h', r.median_heat_gap_h FROM f_daily d LEFT JOIN f_ref r USING (machine_id))
""")


def daily(p):
    return p.stage("daily", lambda: process.daily_metrics(p.intervals(), p.telemetry(), p.machines))


def reference(p):
    return process.reference_medians(daily(p).where(F.col("day") < F.lit("2024-01-19").cast("date")))


def findings(p):
    return p.stage("findings", lambda: process.process_findings(daily(p), reference(p)))


@query("daily_hours_energy", """
SELECT machine_id, day, round(hours_heating, 4) AS hours_heating, round(hours_melting, 4) AS hours_melting, round(idle_hours, 4) AS hours_idle,
 round(holding_hours, 4) AS hours_holding, round(energy_kwh, 4) AS energy_kwh, round(non_productive_kwh, 4) AS non_productive_kwh,
 round(non_productive_share, 4) AS non_productive_share FROM f_dayhours
""")
def _(p):
    return process.daily_hours_energy(p.intervals()).select(
        "machine_id", "day", "hours_heating", "hours_melting", "hours_idle", "hours_holding", "energy_kwh", "non_productive_kwh", "non_productive_share")


@query("state_transitions", "SELECT machine_id, ts, day, from_state, to_state, is_start, is_heat FROM f_trans")
def _(p):
    return process.state_transitions(process.state_samples(p.telemetry()), p.machines)


@query("heat_gap_median", "SELECT machine_id, day, round(median_heat_gap_h, 4) AS median_heat_gap_h FROM f_gaps")
def _(p):
    return process.heat_gap_median(process.state_transitions(process.state_samples(p.telemetry()), p.machines))


@query("daily_metrics", """
SELECT machine_id, day, round(idle_hours, 4) AS idle_hours, round(holding_hours, 4) AS holding_hours, round(energy_kwh, 4) AS energy_kwh,
 round(non_productive_kwh, 4) AS non_productive_kwh, round(non_productive_share, 4) AS non_productive_share, start_count, heat_count,
 round(median_heat_gap_h, 4) AS median_heat_gap_h, round(holding_per_heat_h, 4) AS holding_per_heat_h FROM f_daily
""")
def _(p):
    return daily(p).select("machine_id", "day", "idle_hours", "holding_hours", "energy_kwh", "non_productive_kwh", "non_productive_share",
                           "start_count", "heat_count", "median_heat_gap_h", "holding_per_heat_h")


@query("reference_medians", """
SELECT machine_id, round(idle_hours, 4) AS idle_hours, round(holding_per_heat_h, 4) AS holding_per_heat_h, round(non_productive_share, 4) AS non_productive_share,
 round(start_count, 4) AS start_count, round(median_heat_gap_h, 4) AS median_heat_gap_h, round(heat_count, 4) AS heat_count FROM f_ref
""")
def _(p):
    return reference(p)


@query("process_findings", """
SELECT machine_id, day, metric, CASE WHEN digits = 9 THEN value WHEN digits = 4 THEN round(value, 4) ELSE round(value + 1e-9, 3) END AS value, unit,
 round(reference, 4) AS reference, above_reference FROM f_find
""")
def _(p):
    return findings(p)


# -- health -------------------------------------------------------------------
fragment("f_hbucket", """
SELECT machine_id, k, count(*) FILTER (quality = 'GOOD') AS n_rows, count(*) FILTER (quality = 'BAD') AS n_bad,
 min(ts) FILTER (quality = 'GOOD') AS first_good, max(ts) FILTER (quality = 'GOOD') AS last_good,
 avg(vibration_mm_s) FILTER (quality = 'GOOD') AS vibration_mm_s, avg(temperature_c) FILTER (quality = 'GOOD') AS temperature_c,
 avg(current_a) FILTER (quality = 'GOOD') AS current_a FROM f_bucketed GROUP BY 1, 2
""")
fragment("f_hdom", """
SELECT machine_id, k, machine_state FROM (SELECT machine_id, k, coalesce(machine_state, 'unknown') AS machine_state, count(*) AS n, min(ts) AS first
 FROM f_bucketed WHERE quality = 'GOOD' GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY machine_id, k ORDER BY n DESC, first) = 1
""")
fragment("f_hiv", """
SELECT *, list_filter([CASE WHEN n_bad > 0 THEN 'contains ' || n_bad || ' BAD-quality row(s)' END,
  CASE WHEN coverage_pct < 80 THEN 'coverage ' || coverage_pct || '% below minimum 80.0%' END,
  CASE WHEN n_rows = 0 THEN 'no GOOD telemetry rows' END], lambda x: x IS NOT NULL) AS incomplete_reasons, len(incomplete_reasons) = 0 AS complete
FROM (SELECT g.machine_id, g.machine_type, k, window_start, window_end, machine_state, vibration_mm_s, temperature_c, current_a, coalesce(n_rows, 0) AS n_rows,
  coalesce(n_bad, 0) AS n_bad, coalesce(round_even(least(100.0::DOUBLE, (epoch_us(last_good) - epoch_us(first_good)) / 1e6 / isec * 100.0::DOUBLE), 2), 0.0::DOUBLE) AS coverage_pct
 FROM f_grid g LEFT JOIN f_hbucket USING (machine_id, k) LEFT JOIN f_hdom USING (machine_id, k))
""")
fragment("f_sig", """
SELECT machine_id, k, window_start, complete, coalesce(lower(nullif(trim(machine_state), '')), 'unknown') AS bucket, 0 AS pos, 'vibration_mm_s' AS signal, vibration_mm_s AS value FROM f_hiv WHERE vibration_mm_s IS NOT NULL
UNION ALL SELECT machine_id, k, window_start, complete, coalesce(lower(nullif(trim(machine_state), '')), 'unknown'), 1, 'temperature_c', temperature_c FROM f_hiv WHERE temperature_c IS NOT NULL
UNION ALL SELECT machine_id, k, window_start, complete, coalesce(lower(nullif(trim(machine_state), '')), 'unknown'), 2, 'current_a', current_a FROM f_hiv WHERE current_a IS NOT NULL
""")
fragment("f_href", """
SELECT machine_id, bucket, signal, median(value) AS median, mad(value) AS mad, count(*) AS n, n_intervals FROM f_sig
JOIN (SELECT machine_id, count(*) AS n_intervals FROM f_hiv WHERE complete AND window_start < TIMESTAMP '2024-01-19'
 AND (vibration_mm_s IS NOT NULL OR temperature_c IS NOT NULL OR current_a IS NOT NULL) GROUP BY 1) USING (machine_id)
WHERE complete AND window_start < TIMESTAMP '2024-01-19' GROUP BY machine_id, bucket, signal, n_intervals
""")
fragment("f_contrib", """
SELECT *, CASE WHEN rank = 1 AND total > 0 THEN round_even(1.0::DOUBLE - round_even(rest, 3), 3) ELSE w END AS weight FROM (
SELECT *, sum(CASE WHEN rank > 1 THEN w ELSE 0 END) OVER (PARTITION BY machine_id, k) AS rest FROM (
SELECT *, CASE WHEN total > 0 THEN round_even(abs(z) / total, 3) ELSE 0 END AS w,
 row_number() OVER (PARTITION BY machine_id, k ORDER BY abs(z) DESC, pos) AS rank FROM (
SELECT *, round_even(sum(abs(z)) OVER (PARTITION BY machine_id, k), 2) AS total FROM (
SELECT s.machine_id, s.k, s.window_start, s.bucket, s.pos, s.signal, s.value, r.median,
 round_even(0.6745 * (value - median) / greatest(mad, 0.1::DOUBLE * abs(median), 1e-6), 2) AS z,
 CASE WHEN median <> 0 THEN round_even((value - median) / abs(median) * 100, 1) END AS pct_change
FROM f_sig s JOIN f_href r ON s.machine_id = r.machine_id AND s.bucket = r.bucket AND s.signal = r.signal AND r.n >= 3))))
""")
fragment("f_health", """
SELECT *, round_even(100 * exp(-((anomaly_score / 6) ** 2)), 1) AS health_score,
 CASE WHEN anomaly_score >= 6 THEN 'CRITICAL' WHEN anomaly_score >= 4 THEN 'WARNING' ELSE 'NORMAL' END AS state FROM (
SELECT *, CASE WHEN status = 'OK' THEN round_even(a, 2) END AS anomaly_score FROM (
SELECT h.machine_id, h.k, window_start, window_end, h.bucket, a, CASE WHEN coalesce(n_intervals, 0) < 24 THEN 'INSUFFICIENT_HISTORY' WHEN NOT complete THEN 'UNAVAILABLE'
 WHEN known IS NULL THEN 'OUT_OF_DOMAIN' WHEN a IS NULL AND nosig THEN 'UNAVAILABLE' WHEN a IS NULL THEN 'OUT_OF_DOMAIN' ELSE 'OK' END AS status
FROM (SELECT *, coalesce(lower(nullif(trim(machine_state), '')), 'unknown') AS bucket, vibration_mm_s IS NULL AND temperature_c IS NULL AND current_a IS NULL AS nosig FROM f_hiv) h
LEFT JOIN (SELECT DISTINCT machine_id, bucket, TRUE AS known FROM f_href) USING (machine_id, bucket)
LEFT JOIN (SELECT DISTINCT machine_id, n_intervals FROM f_href) USING (machine_id)
LEFT JOIN (SELECT machine_id, k, max(abs(z)) AS a FROM f_contrib GROUP BY 1, 2) USING (machine_id, k)))
""")


def health_intervals(p):
    return p.stage("health_intervals", lambda: intervals.health_intervals(
        p.telemetry(), p.machines, start=S.START, end=S.END, interval_s=p.interval_s))


def health_reference(p):
    return p.stage("health_reference", lambda: health.fit_health_reference(
        health_intervals(p).where(F.col("window_start") < F.lit(S.TRAIN_END).cast("timestamp"))))


def health_rows(p):
    return p.stage("health_rows", lambda: health.score_health(health_intervals(p), health_reference(p)))


@query("health_intervals", """
SELECT machine_id, window_start, machine_state, round(vibration_mm_s, 4) AS vibration_mm_s, round(temperature_c, 4) AS temperature_c,
 round(current_a, 4) AS current_a, n_rows, n_bad, coverage_pct, complete, array_to_string(incomplete_reasons, '; ') AS incomplete_reasons FROM f_hiv
""")
def _(p):
    return health_intervals(p).select("machine_id", "window_start", "machine_state", "vibration_mm_s", "temperature_c", "current_a", "n_rows", "n_bad", "coverage_pct", "complete",
                                      "incomplete_reasons")


@query("state_bucket", "SELECT bucket, count(*) AS n FROM f_sig GROUP BY 1")
def _(p):
    return health.to_signals(health_intervals(p)).groupBy("bucket").agg(F.count("*").alias("n"))


@query("fit_health_reference", """
SELECT machine_id, bucket, signal, round(median, 4) AS median, round(mad, 4) AS mad, n, n_intervals FROM f_href
""")
def _(p):
    return health_reference(p)


@query("robust_z", """
SELECT s.machine_id, s.k, s.signal, round(0.6745 * (value - median) / greatest(mad, 0.1::DOUBLE * abs(median), 1e-6), 4) AS z
FROM f_sig s JOIN f_href r ON s.machine_id = r.machine_id AND s.bucket = r.bucket AND s.signal = r.signal
""")
def _(p):
    df = health.to_signals(health_intervals(p)).join(health_reference(p), ["machine_id", "bucket", "signal"])
    return df.select("machine_id", "k", "signal", health.robust_z(F.col("value"), F.col("median"), F.col("mad")).alias("z"))


@query("signal_contributions", """
SELECT machine_id, k, signal, round(z, 4) AS z, round(pct_change, 4) AS pct_change, weight, rank FROM f_contrib
""")
def _(p):
    return health.signal_contributions(health_intervals(p), health_reference(p)).select(
        "machine_id", "k", "signal", "z", "pct_change", "weight", "rank")


@query("health_status", "SELECT machine_id, k, status FROM f_health")
def _(p):
    return health_rows(p).select("machine_id", "k", "status")


@query("score_health", "SELECT machine_id, window_start, bucket, health_score, anomaly_score, state, status FROM f_health")
def _(p):
    return health_rows(p).select("machine_id", "window_start", "bucket", "health_score", "anomaly_score", "state", "status")


@query("health_reason", """
SELECT h.machine_id, h.window_start, h.status, CASE WHEN h.status = 'INSUFFICIENT_HISTORY' THEN 'reference has ' || coalesce(n.n_intervals, 0) || ' interval(s), need >= 24'
 WHEN NOT v.complete THEN 'incomplete interval (telemetry coverage below minimum)' WHEN b.known IS NULL THEN 'state bucket ''' || h.bucket || ''' not seen in reference'
 WHEN h.status = 'OUT_OF_DOMAIN' THEN 'state bucket ''' || h.bucket || ''' reference too thin'
 WHEN v.vibration_mm_s IS NULL AND v.temperature_c IS NULL AND v.current_a IS NULL THEN 'no health signals present in interval (vibration/temperature/current all null)'
 WHEN h.state = 'NORMAL' THEN 'max |z| ' || printf('%.1f', round_even(h.anomaly_score, 1)) || ' (' || c.s1 || ') within NORMAL range for ''' || h.bucket || ''' reference'
 ELSE h.state || ': ' || c.bits || ' vs ''' || h.bucket || ''' reference (health ' || printf('%.0f', round_even(h.health_score, 0)) || '/100)' END AS reason
FROM f_health h JOIN f_hiv v ON v.machine_id = h.machine_id AND v.k = h.k
LEFT JOIN (SELECT DISTINCT machine_id, bucket, TRUE AS known FROM f_href) b ON b.machine_id = h.machine_id AND b.bucket = h.bucket
LEFT JOIN (SELECT DISTINCT machine_id, n_intervals FROM f_href) n ON n.machine_id = h.machine_id
LEFT JOIN (SELECT machine_id, k, any_value(signal) FILTER (rank = 1) AS s1,
  string_agg(signal || ' z ' || printf('%+.1f', round_even(z, 1)) || CASE WHEN pct_change IS NULL THEN '' ELSE ' (' || printf('%+.1f', pct_change) || '%)' END, ', ' ORDER BY rank) FILTER (rank <= 2) AS bits
 FROM f_contrib GROUP BY 1, 2) c ON c.machine_id = h.machine_id AND c.k = h.k
""")
def _(p):
    return health_rows(p).select("machine_id", "window_start", "status", "reason")


@query("domain_guard", """
SELECT machine_id, window_start, 'rul-external' AS model_id, NULL::DOUBLE AS health_score, 'OUT_OF_DOMAIN' AS status, 'NORMAL' AS state FROM f_hiv
""")
def _(p):
    return health.domain_guard(health_intervals(p), "rul-external").select("machine_id", "window_start", "model_id", "health_score", "status", "state")


@query("score_summary", """
SELECT machine_id, 'statistical-v1' AS model_id, count(*) AS n_intervals, count(*) FILTER (state = 'WARNING') AS n_warning,
 count(*) FILTER (state = 'CRITICAL') AS n_critical FROM f_health GROUP BY 1
""")
def _(p):
    return health.score_summary(health_rows(p))


@query("latest_health", """
SELECT machine_id, window_start, health_score, anomaly_score, state, status FROM f_health
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY window_start DESC) = 1
""")
def _(p):
    return health.latest_health(health_rows(p))


@query("model_coverage", """
SELECT 'statistical-v1' AS model_id, count(DISTINCT machine_id) AS n_machines, min(machine_id) AS first_machine, max(machine_id) AS last_machine FROM f_href
""")
def _(p):
    return health.model_coverage(health_reference(p).withColumn("model_id", F.lit("statistical-v1")))


@query("model_covered_machines", """
SELECT DISTINCT 'statistical-v1' AS model_id, machine_id FROM f_href
""")
def _(p):
    return health.covered_machines(health_reference(p).withColumn("model_id", F.lit("statistical-v1")))


# -- energy x health ------------------------------------------------------------
fragment("f_pairs", """
SELECT e.machine_id, e.dedup_key, h.k, h.window_start AS h_start, h.window_end AS h_end, h.state, h.status,
 h.state IN ('WARNING', 'CRITICAL') AND h.status = 'OK' AS abnormal
FROM f_ev e JOIN f_health h ON e.machine_id = h.machine_id AND e.window_start < h.window_end AND e.window_end > h.window_start
""")
fragment("f_sigbest", """
SELECT p.dedup_key, c.signal, max(abs(c.z)) AS a, min(epoch_us(p.h_start) * 10 + c.rank) AS seen FROM f_pairs p JOIN f_contrib c USING (machine_id, k)
WHERE abnormal GROUP BY 1, 2
""")
fragment("f_sigtext", """
SELECT dedup_key, array_to_string(list(signal ORDER BY seen)[1:3], ', ') AS signals, array_to_string(list(signal ORDER BY a DESC, seen)[1:3], '; ') AS top_signals FROM f_sigbest GROUP BY 1
""")
fragment("f_coin", """
SELECT 'COINCIDENT' AS category, e.machine_id, least(any_value(e.window_start), min(h_start)) AS window_start, greatest(any_value(e.window_end), max(h_end)) AS window_end,
 any_value(e.rule_id) AS rule_id, any_value(e.severity) AS severity, any_value(e.deviation_pct) AS deviation_pct, e.dedup_key, count(*) AS n_intervals,
 array_to_string(list_sort(list(DISTINCT state)), '; ') AS states, any_value(signals) AS signals, any_value(top_signals) AS top_signals
FROM f_ev e JOIN f_pairs p ON e.dedup_key = p.dedup_key AND abnormal JOIN f_sigtext t ON t.dedup_key = e.dedup_key GROUP BY e.machine_id, e.dedup_key
""")
fragment("f_eonly", """
SELECT CASE WHEN coalesce(ok, 0) = 0 THEN 'ENERGY_ONLY_HEALTH_UNAVAILABLE' ELSE 'ENERGY_ONLY' END AS category, machine_id, window_start, window_end, rule_id, severity,
 deviation_pct, e.dedup_key, CASE WHEN coalesce(ok, 0) = 0 THEN coalesce(n, 0) ELSE 0 END AS n_intervals, CASE WHEN coalesce(ok, 0) = 0 THEN '' ELSE 'NORMAL' END AS states,
 NULL::VARCHAR AS signals, '' AS top_signals
FROM f_ev e LEFT JOIN (SELECT dedup_key, count(*) AS n, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (abnormal) AS abn FROM f_pairs GROUP BY 1) p ON p.dedup_key = e.dedup_key
WHERE coalesce(abn, 0) = 0
""")
fragment("f_hruns", """
SELECT *, sum(CASE WHEN prev IS NULL OR window_start > prev THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id ORDER BY window_start) AS run_id FROM (
SELECT *, lag(window_end) OVER (PARTITION BY machine_id ORDER BY window_start) AS prev FROM f_health h
WHERE state IN ('WARNING', 'CRITICAL') AND status = 'OK' AND NOT EXISTS (SELECT 1 FROM f_pairs p WHERE p.machine_id = h.machine_id AND p.k = h.k AND abnormal))
""")
fragment("f_hrunsig", """
SELECT machine_id, run_id, array_to_string(list(signal ORDER BY seen)[1:3], ', ') AS signals, array_to_string(list(signal ORDER BY a DESC, seen)[1:3], '; ') AS top_signals FROM (
SELECT r.machine_id, run_id, c.signal, max(abs(z)) AS a, min(epoch_us(r.window_start) * 10 + c.rank) AS seen FROM f_hruns r JOIN f_contrib c USING (machine_id, k) GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
fragment("f_honly", """
SELECT 'HEALTH_ONLY' AS category, machine_id, min(window_start) AS window_start, max(window_end) AS window_end, NULL::VARCHAR AS rule_id, NULL::VARCHAR AS severity,
 NULL::DOUBLE AS deviation_pct, NULL::VARCHAR AS dedup_key, count(*) AS n_intervals, array_to_string(list_sort(list(DISTINCT state)), '; ') AS states,
 any_value(signals) AS signals, any_value(top_signals) AS top_signals FROM f_hruns JOIN f_hrunsig USING (machine_id, run_id) GROUP BY machine_id, run_id
""")
fragment("f_ins", """
SELECT *, CASE category WHEN 'COINCIDENT' THEN 'Energy anomaly coincides with machine-health anomaly (' || signals || '). This is a correlation, not an established cause; inspection recommended.'
 WHEN 'ENERGY_ONLY_HEALTH_UNAVAILABLE' THEN 'Energy anomaly on ' || machine_id || ' with no matching machine-health record (' || n_intervals || ' overlapping interval(s) unavailable). Health data is missing, so a joint assessment is not possible; inspection recommended.'
 WHEN 'ENERGY_ONLY' THEN 'Energy anomaly on ' || machine_id || ' while machine-health signals stayed within their NORMAL range. No health anomaly overlaps this window; inspection recommended if the deviation persists.'
 ELSE 'Machine-health anomaly on ' || machine_id || ' (' || signals || ') with energy within its expected range. No energy anomaly overlaps this window; inspection recommended.' END AS text
FROM (SELECT * FROM f_coin UNION ALL SELECT * FROM f_eonly UNION ALL SELECT * FROM f_honly)
""")


def pairs(p):
    return correlate.overlap_pairs(p.events(), health_rows(p))


def insights(p):
    return p.stage("insights", lambda: correlate.correlate(p.events(), health_rows(p)))


def _names(df):
    return df.withColumn("top_signals", F.transform("top_signals", lambda t: t["signal"]))


_INS = """SELECT category, machine_id, window_start, window_end, rule_id, severity, round(deviation_pct, 4) AS deviation_pct, n_intervals, states, top_signals FROM """
_INS_COLS = ["category", "machine_id", "window_start", "window_end", "rule_id", "severity", "deviation_pct", "n_intervals", "states", "top_signals"]


@query("overlap_join", "SELECT machine_id, dedup_key, h_start, h_end, state, status FROM f_pairs")
def _(p):
    return pairs(p).select("machine_id", "dedup_key", "h_start", "h_end", "state", "status")


@query("coincident", _INS + "f_coin")
def _(p):
    return _names(correlate.coincident(p.events(), pairs(p))).select(*_INS_COLS)


@query("energy_only", _INS + "f_eonly")
def _(p):
    return _names(correlate.energy_only(p.events(), pairs(p))).select(*_INS_COLS)


@query("health_only", _INS + "f_honly")
def _(p):
    return _names(correlate.health_only(health_rows(p), pairs(p))).select(*_INS_COLS)


@query("health_evidence", """
SELECT dedup_key, signal, round(a, 4) AS abs_z FROM f_sigbest QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY a DESC, seen) <= 3
""")
def _(p):
    ev = correlate.health_evidence(pairs(p).where(correlate.is_abnormal()), ["dedup_key"])
    return ev.select("dedup_key", F.explode("top_signals").alias("t")).select("dedup_key", "t.signal", F.abs("t.z").alias("abs_z"))


@query("correlate", "SELECT category, machine_id, window_start, window_end, rule_id, n_intervals, states, top_signals, text FROM f_ins")
def _(p):
    return _names(insights(p)).select("category", "machine_id", "window_start", "window_end", "rule_id", "n_intervals", "states", "top_signals", "text")


@query("text_guard", """
SELECT category, machine_id, window_start, text FROM (SELECT category, machine_id, window_start, text || CASE day(window_start) % 3 WHEN 0 THEN ' Wear caused this.' WHEN 1 THEN ' Wear is not an established cause.' ELSE '' END AS text FROM f_ins)
WHERE regexp_matches(regexp_replace(lower(text), 'not an established cause', '', 'g'), '\\b(cause|caused|because|due to|results from)\\b')
""")
def _(p):
    day = F.dayofmonth("window_start") % 3  # a third of the texts gets a banned claim, a third the allowed denial
    more = F.when(day == 0, " Wear caused this.").when(day == 1, " Wear is not an established cause.").otherwise("")
    mixed = insights(p).withColumn("text", F.concat("text", more))
    return correlate.text_guard(mixed).select("category", "machine_id", "window_start", "text")
