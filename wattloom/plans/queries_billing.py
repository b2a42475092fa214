"""Registered queries: bill, heats, power factor, carbon, finance."""

from pyspark.sql import functions as F

from wattloom.operators import billing as B
from wattloom.plans import queries_decide as QD
from wattloom.plans import queries_schedule as QS
from wattloom.plans.common import S, fragment, query
from wattloom.plans.queries_energy import meter

fragment("f_slice", """
SELECT *, CASE WHEN energy_kwh - pe >= 0 THEN energy_kwh - pe END AS dkwh, (epoch_us(ts) - epoch_us(prev_ts)) / 3.6e9 AS dh FROM (
 SELECT t.*, lag(ts) OVER w AS prev_ts, lag(energy_kwh) OVER w AS pe FROM f_tel t JOIN (SELECT machine_id, max(ts) AS newest FROM f_tel GROUP BY 1) USING (machine_id)
 WHERE ts >= newest - INTERVAL 24 HOUR WINDOW w AS (PARTITION BY machine_id ORDER BY ts)) WHERE prev_ts IS NOT NULL
""")
fragment("f_priced", """
SELECT s.*, m.rate FROM f_slice s LEFT JOIN f_min m ON m.minute = hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE)
""")
fragment("f_hslice", """
SELECT h.*, closed_at FROM (SELECT *, sum(CASE WHEN st = 'heating' AND last_nh <> 'heating' THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id ORDER BY ts) AS heat_id FROM (
 SELECT *, coalesce(last_value(nh IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS last_nh FROM (
 SELECT *, coalesce(machine_state, 'unknown') AS st, CASE WHEN coalesce(machine_state, 'unknown') <> 'holding' THEN coalesce(machine_state, 'unknown') END AS nh FROM f_priced))) h
LEFT JOIN (SELECT machine_id, heat_id, min(ts) AS closed_at FROM (
 SELECT machine_id, ts, st, sum(CASE WHEN st = 'heating' AND last_nh <> 'heating' THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id ORDER BY ts) AS heat_id FROM (
  SELECT *, coalesce(last_value(nh IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS last_nh FROM (
  SELECT *, coalesce(machine_state, 'unknown') AS st, CASE WHEN coalesce(machine_state, 'unknown') <> 'holding' THEN coalesce(machine_state, 'unknown') END AS nh FROM f_priced))) WHERE st = 'idle' GROUP BY 1, 2) c USING (machine_id, heat_id)
WHERE heat_id > 0 AND (closed_at IS NULL OR ts < closed_at) AND NOT (st = 'holding' AND last_nh = 'heating')
""")
fragment("f_hsess", """
SELECT machine_id, heat_id::BIGINT AS heat_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS slices, coalesce(sum(dkwh), 0) AS kwh, coalesce(sum(dkwh * rate), 0) AS inr,
 count(*) FILTER (st = 'melting') AS melt_slices, coalesce(sum(CASE WHEN st = 'holding' THEN dh * 60 END), 0) AS hold_min, max(CASE WHEN st <> 'heating' THEN temperature_c END) AS peak_c
FROM f_hslice GROUP BY 1, 2 HAVING count(*) FILTER (st = 'melting') > 0 AND max(closed_at) IS NOT NULL
""")
fragment("f_halloc", """
SELECT h.*, coalesce(kg, 0) AS kg, coalesce(good, 0) AS good_kg, coalesce(kg, 0) / 1000 AS tonnes, CASE WHEN kg > 0 THEN h.kwh / (kg / 1000) END AS sec_kwh_per_t FROM f_hsess h LEFT JOIN (
 SELECT machine_id, heat_id, sum(qty_total_kg * n / tot) AS kg, sum(qty_good_kg * n / tot) AS good FROM (
  SELECT *, sum(n) OVER (PARTITION BY machine_id, window_start) AS tot FROM (
   SELECT s.machine_id, s.heat_id::BIGINT AS heat_id, p.window_start, p.qty_total_kg, p.qty_good_kg, count(*)::DOUBLE AS n FROM f_hslice s JOIN f_hsess hs ON hs.machine_id = s.machine_id AND hs.heat_id = s.heat_id
   JOIN f_prod p ON p.machine_id = s.machine_id AND s.ts > p.window_start AND s.ts <= p.window_end WHERE s.st = 'melting' GROUP BY ALL)) GROUP BY 1, 2) USING (machine_id, heat_id)
""")


def slices(p):
    return p.stage("slices", lambda: B.slice_energy(p.telemetry()))


def priced(p):
    return p.stage("priced_slices", lambda: B.with_rate(slices(p), QS.in_force(p), S.SITE))


def heat_slices(p):
    return p.stage("heat_slices", lambda: B.heat_slices(priced(p)))


def heats(p):
    return p.stage("heat_sessions", lambda: B.allocate_production(heat_slices(p), B.heat_sessions(heat_slices(p)), p.production()))


@query("slice_energy", "SELECT machine_id, ts, round(dkwh, 4) AS dkwh, round(dh, 4) AS dh FROM f_slice")
def _(p):
    return slices(p).select("machine_id", "ts", "dkwh", "dh")


@query("state_runs_cost", """
SELECT machine_id, state, round(sum(dkwh), 4) AS kwh, round(sum(dkwh * rate), 4) AS inr, round(sum(dh), 4) AS hours, min(prev_ts) AS start_ts, max(ts) AS end_ts, state IN ('holding', 'idle') AS is_waste FROM (
 SELECT *, sum(c) OVER (PARTITION BY machine_id ORDER BY ts) AS run FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY machine_id ORDER BY ts) THEN 0 ELSE 1 END AS c
  FROM (SELECT *, coalesce(machine_state, 'unknown') AS state FROM f_priced WHERE dkwh IS NOT NULL))) GROUP BY machine_id, run, state
""")
def _(p):
    return B.state_runs_cost(priced(p)).drop("run_id")


@query("avg_rate", """
SELECT machine_id, round(sum(dkwh * rate) / nullif(sum(dkwh), 0), 4) AS avg_rate, count(*) AS n FROM f_priced WHERE dkwh IS NOT NULL AND rate IS NOT NULL GROUP BY 1
""")
def _(p):
    return B.weighted_rate(priced(p))


@query("tariff_mean_rate", """
SELECT machine_id, round(kwh, 4) AS kwh, round(r, 4) AS avg_rate, round(kwh * r, 4) AS flat_inr FROM (SELECT machine_id, sum(dkwh) AS kwh FROM f_priced WHERE dkwh IS NOT NULL GROUP BY 1),
 (SELECT sum(rate * (CASE end_min WHEN 0 THEN 1440 ELSE end_min END - start_min) / 60.0::DOUBLE) / 24 AS r FROM f_tariff WHERE valid_from = DATE '2024-01-01')
""")
def _(p):
    """Each machine's energy at its site's mean rate over the 24 hours, as a bill without times of use would have it."""
    kwh = priced(p).where("dkwh is not null").groupBy("machine_id").agg(F.sum("dkwh").alias("kwh"))
    rate = p.machines.select("machine_id", "site_id").join(B.avg_rate(QS.in_force(p)), "site_id")
    return kwh.join(rate, "machine_id").select("machine_id", "kwh", "avg_rate", (F.col("kwh") * F.col("avg_rate")).alias("flat_inr"))


@query("heat_sessions", """
SELECT machine_id, heat_id, start_ts, end_ts, slices, round(kwh, 4) AS kwh, round(inr, 4) AS inr, melt_slices, round(hold_min, 4) AS hold_min, peak_c FROM f_hsess
""")
def _(p):
    return B.heat_sessions(heat_slices(p))


@query("allocate_production", """
SELECT machine_id, heat_id, round(kg, 4) AS kg, round(good_kg, 4) AS good_kg, round(sec_kwh_per_t, 4) AS sec_kwh_per_t FROM f_halloc
""")
def _(p):
    return heats(p).select("machine_id", "heat_id", "kg", "good_kg", "sec_kwh_per_t")


@query("heat_benchmark", """
SELECT machine_id, count(*) AS n_heats, round(min(sec_kwh_per_t), 4) AS best, round(list_sort(list(sec_kwh_per_t) FILTER (sec_kwh_per_t IS NOT NULL))[count(sec_kwh_per_t) // 2 + 1], 4) AS median,
 round(max(sec_kwh_per_t), 4) AS worst, round(coalesce(sum(CASE WHEN sec_kwh_per_t IS NOT NULL THEN (sec_kwh_per_t - best0) * tonnes END), 0), 4) AS gap_kwh
FROM (SELECT *, min(sec_kwh_per_t) OVER (PARTITION BY machine_id) AS best0 FROM f_halloc) GROUP BY 1
""")
def _(p):
    return B.heat_benchmark(heats(p))


@query("superheat_loss", """
SELECT machine_id, heat_id, round(greatest(0, peak_c - 1550), 4) AS over_c, round(greatest(0, peak_c - 1550) * 0.33::DOUBLE * tonnes, 4) AS over_kwh FROM f_halloc
""")
def _(p):
    return B.superheat_loss(heats(p)).select("machine_id", "heat_id", "over_c", "over_kwh")


fragment("f_kvah", """
SELECT sum(dkwh) AS kwh, sum(sqrt(dkwh * dkwh + (reactive_power_kvar * dh) * (reactive_power_kvar * dh))) AS kvah FROM f_slice WHERE dkwh IS NOT NULL AND reactive_power_kvar IS NOT NULL
""")


@query("kvah_power_factor", "SELECT round(kwh, 4) AS kwh, round(kvah, 4) AS kvah, round(kwh / kvah, 4) AS power_factor, round(kvah - kwh, 4) AS billing_gap_kwh FROM f_kvah")
def _(p):
    return B.kvah_power_factor(slices(p))


@query("capacitor_need", """
SELECT machine_id, n, round(p, 4) AS p_kw, round(q, 4) AS q_kvar, round(greatest(0, q - p * tan(acos(0.95::DOUBLE))), 4) AS need_kvar, round(p / sqrt(p * p + q * q), 4) AS pf_low FROM (
 SELECT machine_id, count(*) AS n, avg(power_kw) AS p, avg(reactive_power_kvar) AS q FROM f_slice WHERE dkwh IS NOT NULL AND reactive_power_kvar IS NOT NULL AND power_factor < 0.9 GROUP BY 1)
""")
def _(p):
    return B.capacitor_need(slices(p))


@query("load_type_profile", """
SELECT load_type, n, round(p, 4) AS p_kw, round(q, 4) AS q_kvar, round(pf, 4) AS pf, round(CASE WHEN pf < 0.95 THEN p * (tan(acos(pf)) - tan(acos(0.95::DOUBLE))) ELSE 0 END, 4) AS need_kvar FROM (
 SELECT load_type, count(*) AS n, avg(kwh) / 0.25 AS p, avg(kvarh) / 0.25 AS q, (avg(kwh) / 0.25) / sqrt((avg(kwh) / 0.25) * (avg(kwh) / 0.25) + (avg(kvarh) / 0.25) * (avg(kvarh) / 0.25)) AS pf FROM f_meter GROUP BY 1)
""")
def _(p):
    return B.load_type_profile(meter(p))


@query("max_demand", """
SELECT 'site-1' AS site_id, round(mean_kva, 4) AS max_demand_kva, b5 AS ends_at FROM (
 SELECT b5, avg(kva) OVER w AS mean_kva, count(*) OVER w AS n FROM (SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 300000000) AS b5, sum(sqrt(power_kw * power_kw + reactive_power_kvar * reactive_power_kvar)) AS kva
  FROM f_slice WHERE dkwh IS NOT NULL AND reactive_power_kvar IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY b5 ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE n = 6 ORDER BY mean_kva DESC, b5 LIMIT 1
""")
def _(p):
    return B.max_demand(slices(p).join(p.machines.select("machine_id", "site_id"), "machine_id"))


fragment("f_last24", """
SELECT * FROM f_prod, (SELECT max(ts) AS upto FROM f_slice WHERE machine_id = 'furnace-01') WHERE window_start >= upto - INTERVAL 24 HOUR AND window_start < upto
""")


@query("scrap_energy", """
SELECT round(kwh, 4) AS kwh, round(t, 4) AS total_kg, round(r, 4) AS rejected_kg, round(g, 4) AS good_kg, round(r / t, 4) AS reject_share, round(kwh * r / t, 4) AS scrap_kwh FROM
 (SELECT sum(dkwh) AS kwh FROM f_slice WHERE machine_id = 'furnace-01'), (SELECT sum(qty_total_kg) AS t, sum(qty_rejected_kg) AS r, sum(qty_good_kg) AS g FROM f_last24)
""")
def _(p):
    return B.scrap_energy(slices(p), p.production(), "furnace-01")


fragment("f_carbon", """
SELECT kwh AS electricity_kwh, good AS good_t, 'grid-v21' AS factor_id, 0.71::DOUBLE AS grid_factor, kwh * 0.71::DOUBLE / 1000 AS tco2, kwh * 0.71::DOUBLE / 1000 / good AS tco2_per_t_good FROM
 (SELECT sum(dkwh) AS kwh FROM f_slice), (SELECT sum(qty_good_kg) / 1000 AS good FROM f_last24)
""")


@query("carbon_per_tonne", """
SELECT round(electricity_kwh, 4) AS electricity_kwh, round(good_t, 4) AS good_t, factor_id, grid_factor, round(tco2, 4) AS tco2, round(tco2_per_t_good, 4) AS tco2_per_t_good FROM f_carbon
""")
def _(p):
    return B.carbon_per_tonne(slices(p), p.production(), p.factors, "furnace-01")


@query("carbon_statement", """
SELECT field, round(value, 4) AS value FROM (SELECT unnest(['electricity_kwh', 'good_t', 'grid_factor', 'tco2', 'tco2_per_t_good']) AS field, unnest([electricity_kwh, good_t, grid_factor, tco2, tco2_per_t_good]) AS value FROM f_carbon)
""")
def _(p):
    return B.carbon_statement(B.carbon_per_tonne(slices(p), p.production(), p.factors, "furnace-01"))


@query("direct_emission_value", """
SELECT l_orderkey AS lot, l_linenumber::BIGINT AS line, round((2.5::DOUBLE - d) * 75, 4) AS value_per_t, round((2.5::DOUBLE - d) * 75 * l_quantity, 4) AS value FROM (
 SELECT *, CASE WHEN l_linenumber <> 7 THEN 1 + l_tax * 20 END AS d FROM lineitem)
""")
def _(p):
    li = p.table("lineitem")
    s = li.select(F.col("l_orderkey").alias("lot"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("tonnes"), F.lit(2.5).alias("default_t_per_t"),
                  F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 20 + 1).alias("direct_t_per_t"), F.lit(75.0).alias("price_per_t"))
    return B.direct_emission_value(s).select("lot", "line", "value_per_t", "value")


fragment("f_air", """
SELECT coalesce(sum(dkwh), 0) AS kwh, coalesce(sum(dh), 0) AS hours FROM f_slice c WHERE machine_id = 'compressor-01' AND dkwh IS NOT NULL AND date_trunc('minute', ts) IN (
 SELECT m FROM (SELECT date_trunc('minute', ts) AS m, arg_max(coalesce(machine_state, 'none'), ts) AS s FROM f_slice WHERE machine_id = 'furnace-01' GROUP BY 1) WHERE s IN ('idle', 'holding'))
""")


@query("air_waste", "SELECT round(kwh, 4) AS kwh, round(hours, 4) AS hours FROM f_air")
def _(p):
    return B.air_waste(slices(p), "furnace-01", "compressor-01")


@query("daily_brief", """
SELECT action, round(inr, 4) AS inr FROM (
 SELECT 'air' AS action, kwh * 7.5::DOUBLE AS inr FROM f_air
 UNION ALL SELECT 'hold', sum(dkwh * coalesce(rate, 7.5::DOUBLE)) FROM f_priced WHERE machine_id = 'furnace-01' AND machine_state = 'holding'
 UNION ALL SELECT 'heats', sum((sec_kwh_per_t - best0) * tonnes) * 7.5::DOUBLE FROM (SELECT *, min(sec_kwh_per_t) OVER () AS best0 FROM f_halloc WHERE machine_id = 'furnace-01') WHERE sec_kwh_per_t IS NOT NULL
 UNION ALL SELECT 'sched', cur_cost_inr - rec_cost_inr FROM (SELECT * FROM f_run WHERE machine_id = 'furnace-01' ORDER BY horizon_end DESC LIMIT 1)
 UNION ALL SELECT 'pf', (kvah - kwh) * 7.5::DOUBLE FROM f_kvah) WHERE inr > 0 ORDER BY inr DESC, action LIMIT 3
""")
def _(p):
    from wattloom.operators import reads
    rate = B.avg_rate(QS.in_force(p))
    def act(name, df, inr):
        return df.select(F.lit(name).alias("action"), inr.alias("inr"))
    furnace = F.col("machine_id") == "furnace-01"
    air = act("air", B.air_waste(slices(p), "furnace-01", "compressor-01").crossJoin(rate), F.col("kwh") * F.col("avg_rate"))
    held = priced(p).where(furnace & (F.col("machine_state") == "holding")).crossJoin(rate).agg(F.sum(F.col("dkwh") * F.coalesce("rate", "avg_rate")).alias("inr"))
    gap = act("heats", B.heat_benchmark(heats(p)).where(furnace).crossJoin(rate), F.col("gap_kwh") * F.col("avg_rate"))
    run = act("sched", reads.latest_per_machine(QD.run_table(p), "created_at").where(furnace), F.col("cur_cost_inr") - F.col("rec_cost_inr"))
    pf = act("pf", B.kvah_power_factor(slices(p)).crossJoin(rate), F.col("billing_gap_kwh") * F.col("avg_rate"))
    return B.daily_brief(air.unionByName(act("hold", held, F.col("inr"))).unionByName(gap).unionByName(run).unionByName(pf))


@query("non_working_light_load", """
SELECT round(i, 4) AS idle_kwh, round(t, 4) AS total_kwh, round(i / t * 100, 4) AS idle_share_pct FROM (SELECT sum(CASE WHEN load_type = 'Light_Load' AND (dayofweek(dt) IN (0, 6) OR hour(dt) < 9 OR hour(dt) >= 18) THEN kwh ELSE 0 END) AS i, sum(kwh) AS t FROM f_meter)
""")
def _(p):
    return B.non_working_light_load(meter(p))


@query("meter_power_factor", """
SELECT round(k, 4) AS kwh, round(a, 4) AS kvah, round(k / a, 4) AS power_factor, round(a - k, 4) AS gap_kwh, round((a - k) * 7.5, 4) AS gap_inr FROM (SELECT sum(kwh) AS k, sum(sqrt(kwh * kwh + kvarh * kvarh)) AS a FROM f_meter)
""")
def _(p):
    return B.meter_power_factor(meter(p))


# -- finance: one assumption row per customer, each looking at one intervention ---------
fragment("f_assume", """
SELECT 'iv-furnace-01-' || (8 + c_custkey % 19) AS intervention, c_custkey AS scenario, 60000.0::DOUBLE + c_custkey % 40 * 5000 AS hardware_inr, c_custkey % 20 * 250.0::DOUBLE AS subscription_inr_month,
 4.0::DOUBLE + c_custkey % 11 AS rate, 150.0::DOUBLE + c_custkey % 43 * 5 AS days, 1.0::DOUBLE + c_custkey % 6 AS furnaces, 0.71::DOUBLE AS factor, c_custkey % 13 * 5.0::DOUBLE AS share_pct,
 1.0::DOUBLE + c_custkey % 5 AS years, 1000000.0::DOUBLE + c_custkey % 141 * 100000 AS loan_inr, 1.0::DOUBLE + c_custkey % 14 AS bank_rate_pct, c_custkey % 3 = 0 AS is_medium FROM customer
""")
fragment("f_paid", """
SELECT *, ky * rate AS iy, CASE WHEN ky * rate / 12 - subscription_inr_month > 0 THEN hardware_inr / (ky * rate / 12 - subscription_inr_month) END AS months FROM (
 SELECT a.*, round(saving / cf * 100 + 1e-9, 3) AS saving_pct, round(cf + 1e-9, 3) / n_post * (86400.0::DOUBLE / 14400) * furnaces * days * round(saving / cf * 100 + 1e-9, 3) / 100 AS ky FROM f_verd JOIN f_assume a USING (intervention) WHERE outcome = 'VERIFIED')
""")


def assumptions(p):
    k = F.col("c_custkey")
    return p.table("customer").select(
        F.concat(F.lit("iv-furnace-01-"), (k % 19 + 8).cast("string")).alias("intervention"), k.alias("scenario"), (k % 40 * 5000 + 60000.0).alias("hardware_inr"),
        (k % 20 * 250.0).alias("subscription_inr_month"), (k % 11 + 4.0).alias("rate"), (k % 43 * 5 + 150.0).alias("days"), (k % 6 + 1.0).alias("furnaces"),
        F.lit(0.71).alias("factor"), (k % 13 * 5.0).alias("share_pct"), (k % 5 + 1.0).alias("years"), (k % 141 * 100000 + 1000000.0).alias("loan_inr"),
        (k % 14 + 1.0).alias("bank_rate_pct"), (k % 3 == 0).alias("is_medium"))


def paid(p):
    return B.payback(QD.verdicts(p), assumptions(p), p.interval_s)


@query("payback", """
SELECT intervention, scenario, round(ky, 4) AS kwh_year, round(iy, 4) AS inr_year, round(months, 4) AS payback_months, round(ky * factor / 1000, 4) AS co2_t_year FROM f_paid
""")
def _(p):
    return paid(p).select("intervention", "scenario", "kwh_year", "inr_year", "payback_months", "co2_t_year")


@query("roll_out", """
SELECT intervention, scenario, sites::BIGINT AS sites, round(ky * sites / 1000, 4) AS mwh_year, round(iy * sites / 1e7, 4) AS crore_year, round(ky * factor / 1000 * sites, 4) AS co2_t_year FROM f_paid, (SELECT unnest([1, 10, 100, 1000]) AS sites)
""")
def _(p):
    return B.roll_out(paid(p))


@query("shared_savings", """
SELECT intervention, scenario, round(iy * share_pct / 100, 4) AS to_provider_inr, round(iy - iy * share_pct / 100, 4) AS kept_inr,
 round(CASE WHEN iy * share_pct > 0 THEN hardware_inr / (iy * share_pct / 100 / 12) END, 4) AS recover_months, round(iy * share_pct / 100 * years, 4) AS contract_inr FROM f_paid
""")
def _(p):
    return B.shared_savings(paid(p))


@query("interest_subsidy", """
SELECT intervention, scenario, round(loan_inr * 0.75 * greatest(0, least(CASE WHEN is_medium THEN 3 ELSE 5 END, bank_rate_pct - 2)) / 100, 4) AS relief_inr, saving_pct >= 10 AS eligible FROM f_paid
""")
def _(p):
    return B.interest_subsidy(paid(p))


@query("saving_per_tonne", """
SELECT intervention, round(t, 4) AS tonnes, round(round(cf + 1e-9, 3) / t, 4) AS expected_kwh_per_t, round(round(act + 1e-9, 3) / t, 4) AS actual_kwh_per_t FROM (
 SELECT *, round(after + 1e-9, 3) * n_post / 1000 AS t FROM f_verd WHERE outcome IN ('VERIFIED', 'NOT_VERIFIED'))
""")
def _(p):
    v = QD.verdicts(p).where("outcome in ('VERIFIED', 'NOT_VERIFIED')")
    return B.saving_per_tonne(v, F.col("production_after_kg_h") * F.col("n_post") / 1000.0)
