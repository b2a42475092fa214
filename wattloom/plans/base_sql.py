"""SQL fragments (DuckDB dialect) that state the same derived tables independently."""

from wattloom.plans.common import fragment

fragment("f_params", """
SELECT 14400::BIGINT AS isec
""")
fragment("f_machine", """
SELECT * FROM (VALUES ('furnace-01','site-1','Induction Furnace 1','furnace',200.0::DOUBLE),
 ('compressor-01','site-1','Air Compressor 1','compressor',150.0::DOUBLE),
 ('pump-01','site-1','Cooling Pump 1','pump',120.0::DOUBLE)) t(machine_id, site_id, name, machine_type, rated_power_kw)
""")
fragment("f_tariff", """
SELECT site_id, period_name, start_min::BIGINT AS start_min, end_min::BIGINT AS end_min, rate, demand, valid_from::DATE AS valid_from, source_class
FROM (VALUES ('site-1','off_peak_night',0,360,6.0::DOUBLE,NULL::DOUBLE,'2024-01-01','ASSUMPTION'),
 ('site-1','normal_day',360,1080,7.5::DOUBLE,NULL,'2024-01-01','ASSUMPTION'),
 ('site-1','evening_peak',1080,1320,10.5::DOUBLE,NULL,'2024-01-01','ASSUMPTION'),
 ('site-1','off_peak_late',1320,0,6.0::DOUBLE,NULL,'2024-01-01','ASSUMPTION'),
 ('site-1','flat',0,0,7.0::DOUBLE,200.0::DOUBLE,'2023-01-01','MEASURED')) t(site_id, period_name, start_min, end_min, rate, demand, valid_from, source_class)
""")
fragment("f_factor", """
SELECT factor_id, value_kg_per_kwh, effective_from::DATE AS effective_from, effective_to::DATE AS effective_to, source_class, note
FROM (VALUES ('grid-v20', 0.727::DOUBLE, '2023-04-01', '2024-03-31', 'EXTERNAL_REFERENCE', 'Confirm against the user guide'),
 ('grid-v21', 0.710::DOUBLE, '2024-04-01', '2025-03-31', 'EXTERNAL_REFERENCE', 'confirm against the table'))
 t(factor_id, value_kg_per_kwh, effective_from, effective_to, source_class, note)
""")
fragment("f_sensor", """
SELECT machine_id || '-' || lower(channel) AS sensor_id, machine_id, channel FROM (VALUES ('furnace-01','kW'),('furnace-01','V'),
 ('furnace-01','I'),('furnace-01','temperature'),('furnace-01','vibration'),('compressor-01','kW'),('compressor-01','I'),
 ('compressor-01','vibration'),('pump-01','kW'),('pump-01','I'),('pump-01','rpm')) t(machine_id, channel)
""")
fragment("f_base", """
SELECT event_id, ts,
 CASE user_id % 3 WHEN 0 THEN 'furnace-01' WHEN 1 THEN 'compressor-01' ELSE 'pump-01' END AS machine_id,
 CASE WHEN event_id % 83 = 0 THEN NULL WHEN day(ts) % 7 = 0 THEN 'idle' WHEN event_type = 'view' THEN 'heating'
  WHEN event_type = 'click' THEN 'melting' WHEN event_type = 'purchase' THEN 'holding' ELSE 'idle' END AS machine_state,
 value, CASE WHEN day(ts) = 30 AND hour(ts) BETWEEN 8 AND 11 THEN 5 * CAST(round(value * 100) AS BIGINT) WHEN day(ts) >= 24 AND event_type <> 'click' THEN CAST(round(value * 100) AS BIGINT) * 3 // 10
  ELSE CAST(round(value * 100) AS BIGINT) END AS cents,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events
""")
fragment("f_counted", """
SELECT *, CAST(sum(cents) OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS BIGINT) AS counter FROM f_base
""")
fragment("f_first", """
SELECT machine_id, ts, event_id * 10 + CASE WHEN event_id % 50 = 0 THEN 35 ELSE 0 END AS seq,
 400.0::DOUBLE + k % 30 AS voltage_v, value * 1.5::DOUBLE AS current_a, p AS power_kw, q AS reactive_power_kvar,
 CASE WHEN sqrt(p * p + q * q) > 0 THEN p / sqrt(p * p + q * q) END AS power_factor,
 counter / 100.0::DOUBLE / CASE WHEN event_id % 997 = 0 THEN 2 ELSE 1 END AS energy_kwh,
 (1.0::DOUBLE + (cents % 500) / 100.0::DOUBLE) * CASE WHEN day(ts) % 6 = 0 AND hour(ts) BETWEEN 8 AND 11 THEN 2.5::DOUBLE WHEN day(ts) % 6 = 0 AND hour(ts) BETWEEN 12 AND 19 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS vibration_mm_s, 600.0::DOUBLE + k * 10.0::DOUBLE AS temperature_c,
 machine_state, CASE WHEN event_id % 10 < 7 THEN 'SIMULATED' ELSE 'MEASURED' END AS source, event_id
FROM (SELECT *, CASE WHEN event_id % 211 = 0 THEN -value ELSE value END AS p, k::DOUBLE AS q FROM f_counted)
""")
fragment("f_readings", """
SELECT * FROM f_first UNION ALL SELECT * REPLACE (event_id * 10 + 107 AS seq) FROM f_first WHERE event_id % 40 = 0
""")
fragment("f_unique", """
SELECT * FROM f_readings QUALIFY row_number() OVER (PARTITION BY machine_id, ts ORDER BY seq) = 1
""")
fragment("f_arrival", """
SELECT *, max(ts) OVER (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ts FROM f_unique
""")
fragment("f_ordered", """
SELECT *, max(CASE WHEN in_order THEN energy_kwh END)
  OVER (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_energy
FROM (SELECT *, last_ts IS NULL OR ts > last_ts AS in_order FROM f_arrival)
""")
fragment("f_verdict", """
SELECT o.*, m.rated_power_kw, list_filter([
  CASE WHEN voltage_v < 0 THEN 'impossible: voltage_v < 0' END, CASE WHEN current_a < 0 THEN 'impossible: current_a < 0' END,
  CASE WHEN power_kw < 0 THEN 'impossible: power_kw < 0' END,
  CASE WHEN power_factor NOT BETWEEN 0 AND 1 THEN 'impossible: power_factor outside 0..1' END,
  CASE WHEN ts > TIMESTAMP '2024-01-31' + INTERVAL 300 SECOND THEN 'BAD: ts in future beyond 300s clock-skew tolerance' END,
  CASE WHEN in_order AND energy_kwh < last_energy THEN 'BAD: cumulative energy_kwh decreasing' END], lambda x: x IS NOT NULL) AS bad,
 list_filter([CASE WHEN NOT in_order THEN 'SUSPECT: out-of-order ts vs last stored ts for machine' END,
  CASE WHEN rated_power_kw > 0 AND power_kw > 1.5 * rated_power_kw THEN 'SUSPECT: power spike above 1.5x rated power' END],
  lambda x: x IS NOT NULL) AS suspect
FROM f_ordered o JOIN f_machine m USING (machine_id)
""")
fragment("f_tel", """
SELECT * EXCLUDE (bad, suspect), CASE WHEN len(bad) > 0 THEN 'BAD' WHEN len(suspect) > 0 THEN 'SUSPECT' ELSE 'GOOD' END AS quality,
 bad || suspect AS quality_reasons FROM f_verdict
""")
fragment("f_prodraw", """
SELECT 'furnace-01' AS machine_id, TIMESTAMP '2024-01-01' + to_seconds(k * isec) AS window_start,
 TIMESTAMP '2024-01-01' + to_seconds((k + 1) * isec) AS window_end,
 cents / 10.0::DOUBLE AS qty_total_kg, cents * 98 / 1000.0::DOUBLE AS qty_good_kg,
 CASE WHEN k % 37 = 5 THEN cents * 100 + 1000 ELSE cents * 2 END / 1000.0::DOUBLE AS qty_rejected_kg,
 'batch-' || k AS batch_id, CASE WHEN k % 10 < 7 THEN 'SIMULATED' ELSE 'MEASURED' END AS source
FROM (SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / (isec * 1000000)) AS BIGINT) AS k, any_value(isec) AS isec,
  CAST(sum(CASE WHEN machine_state = 'melting' THEN cents ELSE 0 END) AS BIGINT) AS cents
 FROM f_base, f_params WHERE machine_id = 'furnace-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1) WHERE k % 29 <> 7
""")
fragment("f_prod", """
SELECT *, list_filter([CASE WHEN qty_total_kg < 0 THEN 'impossible: qty_total_kg < 0' END,
  CASE WHEN qty_good_kg < 0 THEN 'impossible: qty_good_kg < 0' END, CASE WHEN qty_rejected_kg < 0 THEN 'impossible: qty_rejected_kg < 0' END,
  CASE WHEN qty_good_kg + qty_rejected_kg > qty_total_kg + 1e-9 THEN 'impossible: qty_good_kg + qty_rejected_kg > qty_total_kg' END],
  lambda x: x IS NOT NULL) AS quality_reasons, CASE WHEN len(quality_reasons) > 0 THEN 'BAD' ELSE 'GOOD' END AS quality FROM f_prodraw
""")
fragment("f_grid", """
SELECT machine_id, machine_type, rated_power_kw, k, TIMESTAMP '2024-01-01' + to_seconds(k * isec) AS window_start,
 TIMESTAMP '2024-01-01' + to_seconds((k + 1) * isec) AS window_end, isec
FROM f_machine, f_params, LATERAL (SELECT unnest(range(0, 2592000 // isec)) AS k)
""")
fragment("f_bucketed", """
SELECT t.*, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // (isec * 1000000) AS BIGINT) AS k
FROM f_tel t, f_params WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'
""")


def _hours(states):
    return ",\n ".join(
        f"CASE WHEN n_good > 0 THEN round_even(s_{s} / n_good::DOUBLE * (isec / 3600.0::DOUBLE), 4) ELSE 0.0::DOUBLE END AS hours_{s}"
        for s in states)


STATES = ["heating", "melting", "holding", "idle", "running", "stopped", "shutdown", "auxiliary", "unknown"]
_counts = ", ".join(
    f"count(*) FILTER (quality = 'GOOD' AND coalesce(machine_state, 'unknown') = '{s}') AS s_{s}" for s in STATES)

fragment("f_perbucket", f"""
SELECT machine_id, k, count(*) FILTER (quality = 'GOOD') AS n_good, count(*) FILTER (quality = 'BAD') AS n_bad,
 min(ts) FILTER (quality = 'GOOD') AS first_good, max(ts) FILTER (quality = 'GOOD') AS last_good,
 count(energy_kwh) FILTER (quality = 'GOOD') AS n_counter,
 max(energy_kwh) FILTER (quality = 'GOOD') - min(energy_kwh) FILTER (quality = 'GOOD') AS kwh,
 max(power_kw) FILTER (quality = 'GOOD') AS power_max_kw, avg(power_kw) FILTER (quality = 'GOOD') AS power_mean_kw,
 avg(power_factor) FILTER (quality = 'GOOD') AS pf_mean, {_counts}
FROM f_bucketed GROUP BY machine_id, k
""")
fragment("f_prodbucket", """
SELECT machine_id, CAST((epoch_us(window_start) - epoch_us(TIMESTAMP '2024-01-01')) // (isec * 1000000) AS BIGINT) AS k,
 sum(qty_good_kg) AS good_production_kg, sum(qty_rejected_kg) AS rejected_production_kg, TRUE AS has_production_record
FROM f_prod, f_params WHERE quality = 'GOOD' AND window_start >= TIMESTAMP '2024-01-01' AND window_start < TIMESTAMP '2024-01-31' GROUP BY 1, 2
""")
fragment("f_ivraw", f"""
SELECT g.*, coalesce(n_good, 0) AS n_good, coalesce(n_bad, 0) AS n_bad, power_max_kw, power_mean_kw, pf_mean,
 CASE WHEN n_counter >= 2 THEN kwh END AS energy_kwh,
 coalesce(round_even(least(100.0::DOUBLE, (epoch_us(last_good) - epoch_us(first_good)) / 1e6 / isec * 100.0::DOUBLE), 2), 0.0::DOUBLE) AS coverage_pct,
 good_production_kg, coalesce(rejected_production_kg, 0.0::DOUBLE) AS rejected_production_kg,
 coalesce(has_production_record, FALSE) AS has_production_record,
 {_hours(STATES)}
FROM f_grid g LEFT JOIN f_perbucket USING (machine_id, k) LEFT JOIN f_prodbucket USING (machine_id, k)
""")
fragment("f_iv", """
SELECT *, list_filter([CASE WHEN n_bad > 0 THEN 'contains ' || n_bad || ' BAD-quality row(s)' END,
  CASE WHEN coverage_pct < 80 THEN 'coverage ' || coverage_pct || '% below minimum 80.0%' END,
  CASE WHEN energy_kwh IS NULL THEN 'cumulative energy counter unavailable (< 2 GOOD readings)' END], lambda x: x IS NOT NULL) AS incomplete_reasons,
 len(incomplete_reasons) = 0 AS complete FROM f_ivraw
""")
fragment("f_sec", """
SELECT *, CASE WHEN machine_type IN ('pump', 'compressor') THEN 'NOT_APPLICABLE' WHEN NOT complete THEN 'INCOMPLETE_DATA'
  WHEN NOT has_production_record OR good_production_kg IS NULL THEN 'MISSING_PRODUCTION' WHEN energy_kwh IS NULL THEN 'INCOMPLETE_DATA'
  WHEN good_production_kg <= 0 THEN 'NO_PRODUCTION' ELSE 'OK' END AS sec_status,
 CASE WHEN sec_status = 'OK' THEN energy_kwh / (good_production_kg / 1000.0) END AS sec_kwh_per_t,
 CASE WHEN sec_status = 'NO_PRODUCTION' THEN greatest(energy_kwh, 0.0::DOUBLE) END AS non_productive_kwh FROM f_iv
""")
fragment("f_bl", """
SELECT machine_id, machine_type, 1.0::DOUBLE AS intercept,
 CASE WHEN machine_type = 'furnace' THEN e * 0.25 / kg ELSE 0 END AS b_prod,
 e / h * CASE WHEN machine_type = 'furnace' THEN 0.9 ELSE 0.95 END AS b_heating,
 CASE WHEN machine_type = 'furnace' THEN 0 ELSE e / h END AS b_melting,
 e / h * CASE WHEN machine_type = 'furnace' THEN 0.8 ELSE 0.9 END AS b_holding,
 e / h * CASE WHEN machine_type = 'furnace' THEN 0.85 ELSE 0.92 END AS b_idle
FROM (SELECT machine_id, machine_type, sum(energy_kwh) AS e, sum(hours_heating + hours_melting + hours_holding + hours_idle) AS h,
  sum(coalesce(good_production_kg, 0)) AS kg FROM f_iv WHERE complete AND window_start < TIMESTAMP '2024-01-19' GROUP BY ALL)
""")
fragment("f_scored", """
SELECT *, energy_kwh - expected_kwh AS deviation_kwh,
 CASE WHEN expected_kwh > 0.5 THEN (energy_kwh - expected_kwh) / expected_kwh * 100.0 END AS deviation_pct,
 CASE WHEN NOT complete THEN 'INCOMPLETE_INTERVAL' WHEN expected_kwh IS NULL OR energy_kwh IS NULL THEN 'INSUFFICIENT_BASELINE_HISTORY'
  WHEN expected_kwh <= 0.5 THEN 'EXPECTED_NEAR_ZERO' ELSE 'OK' END AS deviation_status
FROM (SELECT s.*, CASE WHEN complete AND energy_kwh IS NOT NULL THEN intercept + b_prod * coalesce(good_production_kg, 0)
  + b_heating * hours_heating + b_melting * hours_melting + b_holding * hours_holding + b_idle * hours_idle END AS expected_kwh
 FROM f_sec s JOIN f_bl USING (machine_id))
""")
# -- anomaly flags ----------------------------------------------------------
fragment("f_cond", """
SELECT *, coalesce(complete AND deviation_pct > 15, FALSE) AS c_dev,
 (hours_idle + hours_holding) / nullif(hours_heating + hours_melting + hours_holding + hours_idle + hours_unknown, 0) AS share0,
 coalesce(share0, 0) AS share, complete AND coalesce(share0, 0) > 0.5 AND coalesce(good_production_kg, 0) <= 0 AS c_idle FROM f_scored
""")
fragment("f_runs", """
SELECT *, count(*) FILTER (c_dev) OVER (PARTITION BY machine_id, g_dev ORDER BY k) AS run_dev,
 count(*) FILTER (c_idle) OVER (PARTITION BY machine_id, g_idle ORDER BY k) AS run_idle
FROM (SELECT *, count(*) FILTER (NOT c_dev) OVER (PARTITION BY machine_id ORDER BY k) AS g_dev,
  count(*) FILTER (NOT c_idle) OVER (PARTITION BY machine_id ORDER BY k) AS g_idle FROM f_cond)
""")
fragment("f_residual", """
SELECT *, energy_kwh - expected_kwh AS residual FROM f_scored WHERE complete AND energy_kwh IS NOT NULL AND expected_kwh IS NOT NULL
""")
fragment("f_madz", """
SELECT *, CASE WHEN n < 3 OR mad <= 0 THEN 0.0::DOUBLE ELSE 0.6745 * (residual - med) / mad END AS z
FROM (SELECT *, median(residual) OVER w AS med, mad(residual) OVER w AS mad, count(*) OVER w AS n FROM f_residual
  WINDOW w AS (PARTITION BY machine_id ORDER BY k ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
""")
fragment("f_flags", """
SELECT machine_id, k, 'L1_DEVIATION' AS rule_id, 'deviation' AS metric, CASE WHEN deviation_pct > 30 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 deviation_pct AS score FROM f_runs WHERE c_dev AND run_dev >= 2
UNION ALL SELECT machine_id, k, 'L1_IDLE_WASTE', 'idle_energy', 'WARNING', share FROM f_runs WHERE c_idle AND run_idle >= 4
UNION ALL SELECT machine_id, k, 'L1_POWER', 'power', 'WARNING', power_max_kw / rated_power_kw FROM f_scored
 WHERE complete AND rated_power_kw > 0 AND power_max_kw > rated_power_kw * 1.1
UNION ALL SELECT machine_id, k, 'L1_POWER_FACTOR', 'pf', 'WARNING', pf_mean FROM f_scored WHERE complete AND pf_mean < 0.6
UNION ALL SELECT machine_id, k, 'L2_MAD_RESIDUAL', 'deviation', CASE WHEN z > 6 THEN 'CRITICAL' ELSE 'WARNING' END, z FROM f_madz
 WHERE z > 4 AND deviation_pct > 15
""")
fragment("f_merged", """
SELECT *, k - row_number() OVER (PARTITION BY machine_id, rule_id ORDER BY k) AS run_id FROM f_flags
""")
fragment("f_ev", """
SELECT *, machine_id || '|' || rule_id || '|' || strftime(window_start, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || strftime(window_end, '%Y-%m-%dT%H:%M:%S+00:00') AS dedup_key,
 'OPEN' AS status FROM (
SELECT f.machine_id, f.rule_id, f.metric, min(window_start) AS window_start, max(window_end) AS window_end,
 CASE WHEN f.rule_id LIKE 'L1%' THEN 'L1_rule' ELSE 'L2_statistical' END AS level, max(abs(f.score)) AS score,
 CASE WHEN bool_or(f.severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 coalesce(sum(expected_kwh), 0) AS expected_kwh, coalesce(sum(energy_kwh), 0) AS actual_kwh,
 CASE WHEN count(*) FILTER (expected_kwh IS NULL OR energy_kwh IS NULL) = 0 THEN coalesce(sum(energy_kwh), 0) - coalesce(sum(expected_kwh), 0) END AS deviation_kwh,
 coalesce(sum(deviation_pct), 0) / count(*) AS deviation_pct, count(*) AS n_intervals
FROM f_merged f JOIN f_scored s USING (machine_id, k) GROUP BY f.machine_id, f.rule_id, f.metric, run_id)
""")
