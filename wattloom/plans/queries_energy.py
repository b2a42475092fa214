"""Registered queries: intervals, specific energy, baseline scoring and anomalies."""

from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions import scan
from wattloom.operators import anomaly, baseline, intervals, sec
from wattloom.plans.common import S, query

_HOURS = ", ".join(f"hours_{s}" for s in ("heating", "melting", "holding", "idle", "unknown"))


@query("interval_grid", """
SELECT machine_id, k, window_start, window_end, coalesce(n, 0) AS n_readings FROM f_grid LEFT JOIN (SELECT machine_id, k, count(*) AS n FROM f_bucketed GROUP BY 1, 2) USING (machine_id, k)
""")
def _(p):
    n = intervals.in_window(p.telemetry(), "ts", S.START, S.END, p.interval_s).groupBy("machine_id", "k").agg(F.count("*").alias("n"))
    grid = intervals.interval_grid(p.machines, S.START, S.END, p.interval_s).join(n, ["machine_id", "k"], "left")
    return grid.select("machine_id", "k", "window_start", "window_end", F.coalesce("n", F.lit(0)).alias("n_readings"))


@query("bucket_index", """
SELECT machine_id, seq, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 06:00:00')) // 5400000000 AS BIGINT) AS k FROM f_unique
WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-20 17:10:00'
 AND ts < TIMESTAMP '2024-01-01 06:00:00' + INTERVAL (311 * 5400) SECOND
""")
def _(p):
    return intervals.in_window(p.telemetry(), "ts", "2024-01-01 06:00:00", "2024-01-20 17:10:00", 5400).select("machine_id", "seq", "k")


@query("build_intervals", f"""
SELECT machine_id, window_start, window_end, complete, array_to_string(incomplete_reasons, '; ') AS incomplete_reasons,
 round(energy_kwh, 4) AS energy_kwh, {_HOURS}, n_good, n_bad, coverage_pct, round(good_production_kg, 4) AS good_production_kg,
 round(rejected_production_kg, 4) AS rejected_production_kg, has_production_record, round(power_max_kw, 4) AS power_max_kw,
 round(power_mean_kw, 4) AS power_mean_kw, round(pf_mean, 4) AS pf_mean FROM f_iv
""")
def _(p):
    return p.intervals().select(
        "machine_id", "window_start", "window_end", "complete", "incomplete_reasons", "energy_kwh", "hours_heating", "hours_melting",
        "hours_holding", "hours_idle", "hours_unknown", "n_good", "n_bad", "coverage_pct", "good_production_kg",
        "rejected_production_kg", "has_production_record", "power_max_kw", "power_mean_kw", "pf_mean")


@query("interval_counts", "SELECT machine_id, k, n_good, n_bad FROM f_perbucket")
def _(p):
    return intervals.bucket_readings(p.telemetry(), S.START, S.END, p.interval_s).select("machine_id", "k", "n_good", "n_bad")


@query("interval_coverage", "SELECT machine_id, k, coverage_pct FROM f_iv")
def _(p):
    return p.intervals().select("machine_id", "k", "coverage_pct")


@query("interval_energy", "SELECT machine_id, k, round(energy_kwh, 4) AS energy_kwh FROM f_iv WHERE energy_kwh IS NOT NULL")
def _(p):
    return p.intervals().where("energy_kwh is not null").select("machine_id", "k", "energy_kwh")


@query("hours_by_state", """
SELECT machine_id, k, coalesce(machine_state, 'unknown') AS state,
 round_even(count(*)::DOUBLE / any_value(n_good) * (any_value(isec) / 3600.0::DOUBLE), 4) AS hours
FROM f_bucketed JOIN f_ivraw USING (machine_id, k) WHERE quality = 'GOOD' GROUP BY 1, 2, 3
""")
def _(p):
    df = intervals.hours_by_state(p.intervals())
    return df.select("machine_id", "k", F.explode("hours_by_state").alias("state", "hours"))


@query("interval_power", """
SELECT machine_id, k, round(power_max_kw, 4) AS power_max_kw, round(power_mean_kw, 4) AS power_mean_kw, round(pf_mean, 4) AS pf_mean FROM f_perbucket
""")
def _(p):
    return intervals.bucket_readings(p.telemetry(), S.START, S.END, p.interval_s).select(
        "machine_id", "k", "power_max_kw", "power_mean_kw", "pf_mean")


@query("interval_production", """
SELECT machine_id, k, round(good_production_kg, 4) AS good_production_kg, round(rejected_production_kg, 4) AS rejected_production_kg,
 has_production_record FROM f_prodbucket
""")
def _(p):
    return intervals.bucket_production(p.production(), S.START, S.END, p.interval_s)


@query("completeness", """
SELECT machine_id, k, array_to_string(incomplete_reasons, '; ') AS incomplete_reasons FROM f_iv WHERE NOT complete
""")
def _(p):
    return p.intervals().where("not complete").select("machine_id", "k", "incomplete_reasons")


@query("dominant_state", """
SELECT machine_id, k, machine_state FROM (SELECT machine_id, k, coalesce(machine_state, 'unknown') AS machine_state, count(*) AS n, min(ts) AS first
 FROM f_bucketed WHERE quality = 'GOOD' GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY machine_id, k ORDER BY n DESC, first) = 1
""")
def _(p):
    rows = intervals.in_window(p.telemetry().where("quality = 'GOOD'"), "ts", S.START, S.END, p.interval_s)
    return intervals.dominant_state(rows, ["machine_id", "k"])


@query("slot_states", "SELECT machine_id, k, window_start, state FROM f_slots")
def _(p):
    return intervals.slot_states(p.telemetry(), p.machines, start=S.START, end=S.END)


@query("state_median_power", """
SELECT machine_id, machine_state, count(*) AS n, round(median(power_kw), 4) AS median_kw FROM f_tel
WHERE quality = 'GOOD' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-19' AND machine_state IN ('heating','melting','holding','idle')
 AND power_kw IS NOT NULL GROUP BY 1, 2
""")
def _(p):
    return intervals.state_median_power(p.telemetry(), start=S.START, end=S.TRAIN_END)


@query("compute_sec", """
SELECT machine_id, k, sec_status, round(sec_kwh_per_t, 4) AS sec_kwh_per_t, round(non_productive_kwh, 4) AS non_productive_kwh FROM f_sec
""")
def _(p):
    return sec.compute_sec(p.intervals()).select("machine_id", "k", "sec_status", "sec_kwh_per_t", "non_productive_kwh")


@query("window_aggregate", """
SELECT machine_id, count(*) AS n_intervals, count(*) FILTER (complete) AS n_complete, round(sum(energy_kwh) FILTER (complete), 4) AS total_actual_kwh,
 round(sum(expected_kwh) FILTER (complete), 4) AS total_expected_kwh,
 round((sum(energy_kwh) FILTER (complete) - sum(expected_kwh) FILTER (complete)) / sum(expected_kwh) FILTER (complete) * 100, 4) AS aggregate_deviation_pct,
 round(sum(good_production_kg) FILTER (complete), 4) AS total_good_production_kg,
 CASE WHEN machine_type = 'furnace' THEN round(sum(energy_kwh) FILTER (complete) / (sum(good_production_kg) FILTER (complete) / 1000), 4) END AS window_sec_kwh_per_t,
 CASE WHEN machine_type = 'furnace' THEN 'OK' ELSE 'NOT_APPLICABLE' END AS window_sec_status,
 round(coalesce(sum(non_productive_kwh) FILTER (complete), 0), 4) AS non_productive_kwh
FROM f_scored GROUP BY machine_id, machine_type
""")
def _(p):
    return sec.window_aggregate(p.scored())


_SUMMARY_SQL = """
SELECT m.machine_id, machine_type, coalesce(e, 0) AS energy_kwh, coalesce(telemetry_rows, 0) AS telemetry_rows, l.power_kw AS latest_power_kw,
 l.machine_state AS latest_state, l.source AS source, l.ts AS latest_ts, coalesce(good, 0) AS production_good_kg, coalesce(total, 0) AS production_total_kg,
 n_good, n_suspect, n_bad,
 CASE WHEN machine_type <> 'furnace' THEN 'NOT_APPLICABLE' WHEN good IS NULL THEN 'MISSING_PRODUCTION' WHEN good <= 0 THEN 'NO_PRODUCTION' ELSE 'OK' END AS sec_status,
 CASE WHEN machine_type = 'furnace' AND good > 0 THEN coalesce(e, 0) / (good / 1000) END AS sec_kwh_per_t,
 CASE WHEN machine_type = 'furnace' AND good <= 0 THEN greatest(coalesce(e, 0), 0) END AS non_productive_kwh, coalesce(open_alerts, 0) AS open_alerts
FROM f_machine m LEFT JOIN (SELECT machine_id, max(energy_kwh) - min(energy_kwh) AS e, count(*) AS telemetry_rows,
  count(*) FILTER (quality = 'GOOD') AS n_good, count(*) FILTER (quality = 'SUSPECT') AS n_suspect, count(*) FILTER (quality = 'BAD') AS n_bad
  FROM f_tel WHERE ts >= TIMESTAMP '2024-01-28 12:00:00' GROUP BY 1) t USING (machine_id)
LEFT JOIN (SELECT * FROM f_tel QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC) = 1) l USING (machine_id)
LEFT JOIN (SELECT machine_id, sum(qty_good_kg) AS good, sum(qty_total_kg) AS total FROM f_prod WHERE window_start >= TIMESTAMP '2024-01-28 12:00:00' GROUP BY 1) p USING (machine_id)
LEFT JOIN (SELECT machine_id, count(*) AS open_alerts FROM f_ev WHERE status = 'OPEN' GROUP BY 1) a USING (machine_id)
"""
from wattloom.plans.common import fragment  # noqa: E402

fragment("f_summary", _SUMMARY_SQL)
fragment("f_slots", """
SELECT machine_id, k, TIMESTAMP '2024-01-01' + to_seconds(k * 900) AS window_start, coalesce(state, 'idle') AS state
FROM f_machine CROSS JOIN (SELECT unnest(range(0, 2880)) AS k) LEFT JOIN (
 SELECT machine_id, k, machine_state AS state FROM (
  SELECT machine_id, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 900000000 AS BIGINT) AS k, machine_state, count(*) AS n, min(ts) AS first
  FROM f_tel WHERE quality = 'GOOD' AND machine_state IS NOT NULL AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3)
 QUALIFY row_number() OVER (PARTITION BY machine_id, k ORDER BY n DESC, first) = 1) USING (machine_id, k)
""")


def summary(p):
    return sec.machine_summary(p.telemetry(), p.production(), p.events(), p.machines, now="2024-01-30 12:00:00", hours=48)


@query("machine_summary", """
SELECT * REPLACE (round(energy_kwh, 4) AS energy_kwh, round(latest_power_kw, 4) AS latest_power_kw, round(production_good_kg, 4) AS production_good_kg,
 round(production_total_kg, 4) AS production_total_kg, round(sec_kwh_per_t, 4) AS sec_kwh_per_t, round(non_productive_kwh, 4) AS non_productive_kwh) FROM f_summary
""")
def _(p):
    return summary(p)


@query("quality_counts", """
SELECT machine_id, quality, n FROM (SELECT machine_id, unnest(['GOOD','SUSPECT','BAD']) AS quality, unnest([n_good, n_suspect, n_bad]) AS n FROM f_summary) WHERE n > 0
""")
def _(p):
    return sec.quality_counts(summary(p)).select("machine_id", F.explode("quality_counts").alias("quality", "n"))


@query("fleet_summary", """
SELECT round(sum(energy_kwh), 4) AS energy_kwh, round(sum(production_good_kg), 4) AS production_good_kg,
 round(CASE WHEN sum(production_good_kg) > 0 THEN sum(energy_kwh) / sum(production_good_kg) * 1000 END, 4) AS fleet_sec_kwh_per_t,
 CAST(sum(open_alerts) AS BIGINT) AS open_alerts, round(sum(latest_power_kw), 4) AS latest_power_kw, count(latest_power_kw) AS n_with_reading,
 max(latest_ts) AS newest_ts FROM f_summary
""")
def _(p):
    return sec.fleet_summary(summary(p))


@query("display_means", """
SELECT machine_id, round(avg(deviation_pct), 4) AS mean_deviation_pct, round(avg(sec_kwh_per_t), 4) AS mean_hourly_sec,
 count(*) FILTER (NOT complete) AS n_incomplete FROM f_scored GROUP BY 1
""")
def _(p):
    return sec.display_means(p.scored())


# -- baseline -----------------------------------------------------------------
@query("features_for", """
SELECT machine_id, machine_type, CASE WHEN machine_type = 'furnace' THEN 'good_production_kg; hours_heating; hours_holding; hours_idle'
 ELSE 'hours_heating; hours_melting; hours_holding; hours_idle; hours_running; hours_stopped; hours_shutdown; hours_auxiliary' END AS features, n
FROM f_machine JOIN (SELECT machine_id, count(*) AS n FROM f_iv GROUP BY 1) USING (machine_id)
""")
def _(p):
    return p.intervals().groupBy("machine_id", "machine_type").agg(F.count("*").alias("n")).withColumn(
        "features", baseline.features_for(F.col("machine_type")))


from wattloom.plans.common import fragment as _fragment  # noqa: E402

_fragment("f_design", """
SELECT machine_id, machine_type, window_start, energy_kwh, coalesce(good_production_kg, 0) AS good_production_kg, hours_heating, hours_melting,
 hours_holding, hours_idle, n_rows, CASE WHEN machine_type = 'furnace' THEN 4 ELSE 8 END AS n_feat, CAST(floor(n_rows * 0.2) AS BIGINT) AS n_hold,
 n_hold >= 1 AND n_rows - n_hold >= greatest(2, n_feat + 1) AND rn > n_rows - n_hold AS is_holdout FROM (
 SELECT *, count(*) OVER (PARTITION BY machine_id) AS n_rows, row_number() OVER (PARTITION BY machine_id ORDER BY window_start) AS rn
 FROM f_iv WHERE complete AND energy_kwh IS NOT NULL AND window_start < TIMESTAMP '2024-01-19')
""")


def train_intervals(p):
    return p.intervals().where(F.col("window_start") < F.lit(S.TRAIN_END).cast("timestamp"))


@query("design_rows", """
SELECT machine_id, window_start, round(energy_kwh, 4) AS energy_kwh, round(good_production_kg, 4) AS good_production_kg, hours_heating, hours_melting,
 hours_holding, hours_idle FROM f_design
""")
def _(p):
    return baseline.design_rows(train_intervals(p)).select(
        "machine_id", "window_start", "energy_kwh", "good_production_kg", "hours_heating", "hours_melting", "hours_holding", "hours_idle")


@query("split_holdout", "SELECT machine_id, window_start, n_rows, is_holdout FROM f_design")
def _(p):
    return baseline.split_holdout(baseline.design_rows(train_intervals(p))).select("machine_id", "window_start", "n_rows", "is_holdout")


@query("gram_sums", """
SELECT machine_id, count(*) AS n_train, round(sum(good_production_kg * energy_kwh), 2) AS kg_energy, round(sum(hours_heating * hours_holding), 2) AS heating_holding,
 round(sum(good_production_kg), 2) AS kg FROM f_design WHERE NOT is_holdout GROUP BY 1
""")
def _(p):
    g = baseline.gram_sums(baseline.split_holdout(baseline.design_rows(train_intervals(p))))
    at = ["intercept", *baseline.FEATURES].index
    n = len(baseline.FEATURES) + 1
    return g.select("machine_id", "n_train", F.round(F.col("rhs")[at("good_production_kg")], 2).alias("kg_energy"),
                    F.round(F.col("gram")[at("hours_heating") * n + at("hours_holding")], 2).alias("heating_holding"),
                    F.round(F.col("gram")[at("good_production_kg")], 2).alias("kg"))


@query("fit_baseline")
def _(p):
    f = baseline.fit_baseline(train_intervals(p))
    return f.select("machine_id", "status", "n_train", "n_holdout", "intercept", F.to_json(F.transform_values("coefficients", lambda _, v: F.round(v, 4))).alias("coefficients"), "clipped",
                    "r2_train", "cv_rmse_pct_train", "nmbe_pct_train", "r2_holdout", "cv_rmse_pct_holdout", "nmbe_pct_holdout", "acceptance")


@query("clipped_features")
def _(p):
    f = baseline.fit_baseline(train_intervals(p))
    return f.select("machine_id", F.explode("clipped").alias("feature"))


_fragment("f_metrics", """
SELECT machine_id, is_holdout, count(*) AS n, CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2,
 CASE WHEN avg(y) > 0 THEN sqrt(sum((y - p) * (y - p)) / count(*)) / avg(y) * 100 END AS cv_rmse_pct,
 CASE WHEN avg(y) > 0 THEN sum(p - y) / (count(*) * avg(y)) * 100 END AS nmbe_pct
FROM (SELECT d.machine_id, is_holdout, energy_kwh AS y, intercept + b_prod * good_production_kg + b_heating * hours_heating
  + b_melting * hours_melting + b_holding * hours_holding + b_idle * hours_idle AS p FROM f_design d JOIN f_bl USING (machine_id)) GROUP BY 1, 2
""")


def metrics(p):
    return baseline.fit_metrics(baseline.split_holdout(baseline.design_rows(train_intervals(p))), p.baselines())


@query("fit_metrics", """
SELECT machine_id, is_holdout, n, round(r2, 4) AS r2, round(cv_rmse_pct, 4) AS cv_rmse_pct, round(nmbe_pct, 4) AS nmbe_pct FROM f_metrics
""")
def _(p):
    return metrics(p)


@query("g14_label", """
SELECT machine_id, coalesce(max(cv_rmse_pct) FILTER (is_holdout), max(cv_rmse_pct)) AS cv0, coalesce(max(nmbe_pct) FILTER (is_holdout), max(nmbe_pct)) AS nm0,
 CASE WHEN cv0 <= 30 AND abs(nm0) <= 10 THEN 'ACCEPTABLE' ELSE 'NOT_ACCEPTABLE' END AS acceptance FROM f_metrics GROUP BY 1
""".replace("AS cv0", "AS cv0").replace("SELECT machine_id, coalesce", "SELECT machine_id, acceptance FROM (SELECT machine_id, coalesce", 1).rstrip() + ")")
def _(p):
    return baseline.acceptance(metrics(p)).select("machine_id", "acceptance")


@query("predict", "SELECT machine_id, k, round(expected_kwh, 4) AS expected_kwh FROM f_scored WHERE expected_kwh IS NOT NULL")
def _(p):
    df = p.intervals().where("complete and energy_kwh is not null").join(
        p.baselines().select("machine_id", "coefficients", "intercept"), "machine_id")
    return baseline.predict(df).select("machine_id", "k", "expected_kwh")


@query("deviation", """
SELECT machine_id, k, round(deviation_kwh, 4) AS deviation_kwh, round(deviation_pct, 4) AS deviation_pct, deviation_status FROM f_scored WHERE complete
""")
def _(p):
    return p.scored().where("complete").select("machine_id", "k", "deviation_kwh", "deviation_pct", "deviation_status")


@query("score_intervals", """
SELECT machine_id, window_start, complete, round(energy_kwh, 4) AS actual_kwh, round(expected_kwh, 4) AS expected_kwh, round(deviation_kwh, 4) AS deviation_kwh,
 round(deviation_pct, 4) AS deviation_pct, deviation_status, sec_status, round(sec_kwh_per_t, 4) AS sec_kwh_per_t FROM f_scored
""")
def _(p):
    return p.scored().select("machine_id", "window_start", "complete", F.col("energy_kwh").alias("actual_kwh"), "expected_kwh",
                             "deviation_kwh", "deviation_pct", "deviation_status", "sec_status", "sec_kwh_per_t")


# -- anomalies ----------------------------------------------------------------
def _flag_sql(rule):
    return f"SELECT machine_id, k, rule_id, severity, round(score, 4) AS score FROM f_flags WHERE rule_id = '{rule}'"


def _flag(name, rule, fn):
    @query(name, _flag_sql(rule))
    def _(p):
        return fn(p.scored()).select("machine_id", "k", "rule_id", "severity", "score")


_flag("l1_deviation", "L1_DEVIATION", anomaly.l1_deviation)
_flag("l1_idle_waste", "L1_IDLE_WASTE", anomaly.l1_idle_waste)
_flag("l1_power", "L1_POWER", anomaly.l1_power)
_flag("l1_power_factor", "L1_POWER_FACTOR", anomaly.l1_power_factor)
_flag("l2_mad", "L2_MAD_RESIDUAL", anomaly.l2_mad)


@query("rolling_mad_z", "SELECT machine_id, k, round(residual, 4) AS residual, round(z, 4) AS z FROM f_madz")
def _(p):
    return anomaly.rolling_mad_z(p.scored()).select("machine_id", "k", "residual", "z")


@query("merge_flag_runs", """
SELECT machine_id, rule_id, min(k) AS first_k, max(k) AS last_k, count(*) AS n FROM f_merged GROUP BY machine_id, rule_id, run_id
""")
def _(p):
    return anomaly.merge_flag_runs(anomaly.all_flags(p.scored())).groupBy("machine_id", "rule_id", "run_id").agg(
        F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count("*").alias("n")).drop("run_id")


EVENT_SQL = """
SELECT machine_id, rule_id, metric, level, window_start, window_end, severity, round(score, 4) AS score, round(expected_kwh, 4) AS expected_kwh,
 round(actual_kwh, 4) AS actual_kwh, round(deviation_kwh, 4) AS deviation_kwh, round(deviation_pct, 4) AS deviation_pct, n_intervals, dedup_key FROM f_ev
"""


def event_columns(df):
    return df.select("machine_id", "rule_id", "metric", "level", "window_start", "window_end", "severity", "score", "expected_kwh",
                     "actual_kwh", "deviation_kwh", "deviation_pct", "n_intervals", "dedup_key")


@query("build_events", EVENT_SQL)
def _(p):
    return event_columns(anomaly.build_events(anomaly.all_flags(p.scored()), p.scored()))


@query("detect_events", EVENT_SQL)
def _(p):
    return event_columns(p.events())


@query("detect_events_fitted")
def _(p):
    fits = baseline.fit_baseline(train_intervals(p)).where("status = 'OK'")
    return event_columns(anomaly.detect_events(baseline.score_intervals(p.intervals(), fits), start=S.TRAIN_END, end=S.END))


@query("worst_open_per_machine", """
SELECT machine_id, rule_id, window_start, round(deviation_pct, 4) AS deviation_pct, severity FROM f_ev
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY coalesce(deviation_pct, 0) DESC, dedup_key DESC) = 1
""")
def _(p):
    return anomaly.worst_open_per_machine(p.events())


@query("rule_counts", "SELECT rule_id, count(*) AS n_events FROM f_ev GROUP BY 1")
def _(p):
    return anomaly.rule_counts(p.events())


@query("top_deviations", """
SELECT machine_id, rule_id, window_start, round(deviation_pct, 4) AS deviation_pct FROM f_ev ORDER BY abs(coalesce(deviation_pct, 0)) DESC, dedup_key LIMIT 5
""")
def _(p):
    return anomaly.top_deviations(p.events()).select("machine_id", "rule_id", "window_start", "deviation_pct")


@query("event_window_excess", """
SELECT machine_id, count(*) AS n_intervals, round(sum(energy_kwh - expected_kwh), 4) AS extra_kwh, round(sum(expected_kwh), 4) AS expected_kwh,
 round(sum(energy_kwh - expected_kwh) / sum(expected_kwh) * 100, 4) AS extra_pct
FROM f_scored s WHERE energy_kwh IS NOT NULL AND expected_kwh IS NOT NULL AND EXISTS (SELECT 1 FROM f_ev e WHERE e.machine_id = s.machine_id
 AND s.window_start >= e.window_start AND s.window_start < e.window_end) GROUP BY 1
""")
def _(p):
    return anomaly.event_window_excess(p.scored(), p.events())


# -- quarter-hour meter ---------------------------------------------------------
_fragment("f_meter", """
SELECT l_shipdate + to_minutes(15 * ((l_orderkey * 7 + l_linenumber) % 96)) AS dt,
 CASE l_returnflag WHEN 'A' THEN 'Light_Load' WHEN 'N' THEN 'Medium_Load' ELSE 'Maximum_Load' END AS load_type,
 sum(round(l_quantity)) AS kwh, sum(round(l_quantity) * round(l_tax * 100)) / 10.0 AS kvarh FROM lineitem GROUP BY 1, 2
""")
_fragment("f_meterhours", """
SELECT 'meter-01' AS machine_id, 'compressor' AS machine_type, 0.0::DOUBLE AS rated_power_kw, date_trunc('hour', dt) AS window_start, sum(kwh) AS energy_kwh, sum(kvarh) AS kvarh, max(kwh) / 0.25 AS power_max_kw,
 count(*) FILTER (load_type = 'Light_Load') * 0.25::DOUBLE AS hours_idle, count(*) FILTER (load_type = 'Medium_Load') * 0.25::DOUBLE AS hours_holding,
 count(*) FILTER (load_type = 'Maximum_Load') * 0.25::DOUBLE AS hours_running, count(*) AS n_quarters,
 sqrt(sum(kwh) * sum(kwh) + sum(kvarh) * sum(kvarh)) AS kvah, CASE WHEN kvah > 0 THEN sum(kwh) / kvah END AS pf_mean FROM f_meter GROUP BY 4
""")


def meter(p):
    return p.stage("meter", lambda: S.meter(p.spark, p.sf_dir))


def meter_hours(p):
    return p.stage("meter_hours", lambda: intervals.meter_hours(meter(p)))


@query("meter_hours", """
SELECT window_start, energy_kwh, round(kvarh, 4) AS kvarh, round(kvah, 4) AS kvah, round(pf_mean, 4) AS pf_mean, power_max_kw, hours_idle, hours_holding, hours_running, n_quarters FROM f_meterhours
""")
def _(p):
    return meter_hours(p).select("window_start", "energy_kwh", "kvarh", "kvah", "pf_mean", "power_max_kw", "hours_idle", "hours_holding",
                                 "hours_running", "n_quarters")


@query("load_state", """
SELECT load_type, CASE load_type WHEN 'Light_Load' THEN 'idle' WHEN 'Medium_Load' THEN 'holding' ELSE 'running' END AS state, count(*) AS n_quarters FROM f_meter GROUP BY 1, 2
""")
def _(p):
    return meter(p).groupBy("load_type", intervals.load_state(F.col("load_type")).alias("state")).agg(F.count("*").alias("n_quarters"))


def meter_intervals(p):
    df = meter_hours(p).withColumns({
        "machine_id": F.lit("meter-01"), "machine_type": F.lit("compressor"), "rated_power_kw": F.lit(0.0), "complete": F.lit(True),
        "good_production_kg": F.lit(None).cast("double"), "has_production_record": F.lit(False), "hours_unknown": F.lit(0.0)})
    return df


FIT_HOURS = 8 * 7 * 24


@query("fit_fixed_window")
def _(p):
    marked = baseline.first_hours(meter_intervals(p), FIT_HOURS)
    f = baseline.fit_baseline(marked.where("is_fit"))
    return f.select("machine_id", "status", "n_train", "n_holdout", "intercept", F.to_json(F.transform_values("coefficients", lambda _, v: F.round(v, 4))).alias("coefficients"),
                    "cv_rmse_pct_holdout", "nmbe_pct_holdout", "acceptance")


def meter_scored(p):
    """Hours after the fit window, scored with the fit; numbered across day chunks."""
    def build():
        marked = baseline.first_hours(meter_intervals(p), FIT_HOURS)
        fits = baseline.fit_baseline(marked.where("is_fit"))
        rest = marked.where("not is_fit").withColumns({"_one": F.lit(1).cast("long"), "_day": F.to_date("window_start")})
        rest = scan.running_sum(rest, ["machine_id"], "_day", ["window_start"], "_one", "k").drop("_one", "_day")
        return baseline.score_intervals(rest, fits)
    return p.stage("meter_scored", build)


@query("meter_events")
def _(p):
    scored = meter_scored(p)
    ev = anomaly.detect_events(scored, end_col="window_start")
    return ev.select("rule_id", "window_start", "window_end", "severity", "score", "deviation_pct", "n_intervals")


__all__ = ["C", "metrics", "summary", "train_intervals"]
