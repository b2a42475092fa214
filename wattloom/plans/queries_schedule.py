"""Registered queries: schedules of every machine-day rebuilt from slot states."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.functions.columns import local_time, minute_of_day
from wattloom.operators import intervals, reads
from wattloom.operators import schedule as K
from wattloom.operators import schedule_limits as L
from wattloom.plans.common import S, fragment, query

FIRST_DAY, LAST_DAY = "2024-01-02", "2024-01-30"

fragment("f_ps", """
SELECT machine_id, CAST(lt AS DATE) AS day, CAST((hour(lt) * 60 + minute(lt)) // 15 AS BIGINT) AS slot, state, machine_id || '|' || CAST(CAST(lt AS DATE) AS VARCHAR) AS plan_id
FROM (SELECT *, window_start + INTERVAL 330 MINUTE AS lt FROM f_slots) WHERE CAST(lt AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-30'
""")
fragment("f_plan", "SELECT DISTINCT plan_id, machine_id, day FROM f_ps")
fragment("f_prun", """
SELECT plan_id, machine_id, day, state, min(slot) AS start_slot, count(*) AS len FROM (
 SELECT *, sum(c) OVER (PARTITION BY plan_id ORDER BY slot) AS run FROM (
  SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY plan_id ORDER BY slot) THEN 0 ELSE 1 END AS c FROM f_ps)) GROUP BY plan_id, machine_id, day, run, state
""")
fragment("f_heat0", """
SELECT plan_id, machine_id, day, row_number() OVER (PARTITION BY plan_id ORDER BY start_slot) - 1 AS heat_no, start_slot, len AS heating_slots, l1 AS melting_slots,
 CASE WHEN s2 = 'holding' THEN l2 ELSE 0 END AS holding_slots, 375.0::DOUBLE AS charge_kg FROM (
 SELECT *, lead(state, 1) OVER w AS s1, lead(len, 1) OVER w AS l1, lead(state, 2) OVER w AS s2, lead(len, 2) OVER w AS l2 FROM f_prun
 WINDOW w AS (PARTITION BY plan_id ORDER BY start_slot)) WHERE state = 'heating' AND s1 = 'melting'
""")
fragment("f_heat", """
SELECT *, CASE WHEN prev_end IS NOT NULL AND start_slot - prev_end > 8 THEN least(heating_slots, 1) ELSE 0 END AS reheat_slots FROM (
 SELECT *, lag(start_slot + heating_slots + melting_slots + holding_slots) OVER (PARTITION BY plan_id ORDER BY start_slot) AS prev_end FROM f_heat0)
""")
fragment("f_tpl", """
SELECT plan_id, machine_id, day, heat_no, charge_kg, greatest(0, heating_slots - reheat_slots) AS heating_slots, melting_slots, holding_slots AS min_hold_slots,
 holding_slots AS max_hold_slots FROM f_heat
""")
fragment("f_rec", """
SELECT plan_id, machine_id, day, heat_no, min(s0) OVER (PARTITION BY plan_id) + coalesce(sum(heating_slots + melting_slots + holding_slots)
  OVER (PARTITION BY plan_id ORDER BY heat_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_slot,
 heating_slots, melting_slots, holding_slots, charge_kg, 0 AS reheat_slots
FROM (SELECT t.*, min_hold_slots AS holding_slots, h.start_slot AS s0 FROM (SELECT * REPLACE (CASE WHEN day(day) % 5 = 0 THEN 380.0::DOUBLE ELSE charge_kg END AS charge_kg) FROM f_tpl) t
 JOIN f_heat h USING (plan_id, heat_no))
""")
fragment("f_aux", """
SELECT plan_id, 'pump job' AS name, day(day) * 3 % 90 AS start_slot, 6 AS duration_slots, 15.0::DOUBLE AS power_kw FROM f_plan WHERE machine_id = 'furnace-01'
""")
fragment("f_med", """
SELECT machine_id, machine_state AS state, median(power_kw) AS median_kw FROM f_tel WHERE quality = 'GOOD' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-19'
 AND machine_state IN ('heating','melting','holding','idle') GROUP BY 1, 2
""")
fragment("f_min", """
SELECT minute, arg_min(rate, start_min) AS rate, arg_min(period_name, start_min) AS period_name FROM f_tariff, (SELECT unnest(range(0, 1440)) AS minute)
WHERE valid_from = DATE '2024-01-01' AND CASE WHEN start_min <= end_min THEN minute >= start_min AND minute < end_min ELSE minute >= start_min OR minute < end_min END GROUP BY 1
""")


def _slot_sql(heats):
    return f"""
SELECT p.plan_id, p.machine_id, p.day, p.slot, coalesce(o.state, 'idle') AS state, coalesce(o.melt_kg, 0) AS melt_kg, coalesce(a.aux_kw, 0) AS aux_kw
FROM (SELECT plan_id, machine_id, day, unnest(range(0, 96)) AS slot FROM f_plan) p
LEFT JOIN (SELECT plan_id, slot, arg_max(state, start_slot) AS state, sum(CASE WHEN state = 'melting' THEN charge_kg / melting_slots END) AS melt_kg FROM (
  SELECT plan_id, start_slot, start_slot + i AS slot, charge_kg, melting_slots,
   CASE WHEN i < heating_slots THEN 'heating' WHEN i < heating_slots + melting_slots THEN 'melting' ELSE 'holding' END AS state
  FROM (SELECT *, unnest(range(0, heating_slots + melting_slots + holding_slots)) AS i FROM {heats})) GROUP BY 1, 2) o USING (plan_id, slot)
LEFT JOIN (SELECT plan_id, slot, sum(power_kw) AS aux_kw FROM (SELECT *, unnest(range(start_slot, start_slot + duration_slots)) AS slot FROM f_aux) GROUP BY 1, 2) a USING (plan_id, slot)
"""


def _eval_sql(slots, heats):
    return f"""
SELECT *, (n_heating - rh) * bh * 0.25::DOUBLE AS heating_kwh, rh * bh * 0.25::DOUBLE AS reheat_kwh FROM (
SELECT s.plan_id, s.machine_id, s.day, energy_kwh, peak_kw, CASE WHEN unpriced = 0 THEN cost END AS cost_inr, coalesce(production_kg, 0) AS production_kg,
 coalesce(n_heats, 0) AS n_heats, melting_kwh, holding_kwh, idle_kwh, intercept_kwh, aux_kwh, n_heating, bh, least(coalesce(reheat, 0), n_heating) AS rh FROM (
 SELECT plan_id, machine_id, day, sum(e) AS energy_kwh, CASE WHEN count(*) = count(kw) THEN max(kw) END AS peak_kw, sum(e * rate) AS cost, count(*) FILTER (rate IS NULL) AS unpriced,
  count(*) FILTER (state = 'heating') AS n_heating, sum(melt) AS melting_kwh, sum(CASE WHEN state = 'holding' THEN st ELSE 0 END) AS holding_kwh,
  sum(CASE WHEN state = 'idle' THEN st ELSE 0 END) AS idle_kwh, sum(ic) AS intercept_kwh, sum(aux_kw * 0.25::DOUBLE) AS aux_kwh, any_value(b_heating) AS bh FROM (
  SELECT x.*, rate, b_heating, b_prod * melt_kg AS melt, intercept * (0.25::DOUBLE / (isec / 3600.0::DOUBLE)) AS ic,
   CASE x.state WHEN 'heating' THEN b_heating WHEN 'holding' THEN b_holding WHEN 'melting' THEN 0 ELSE b_idle END * 0.25::DOUBLE AS st,
   ic + aux_kw * 0.25::DOUBLE + melt + st AS e, median_kw + aux_kw AS kw
  FROM {slots} x JOIN f_bl b ON b.machine_id = x.machine_id AND b.machine_type = 'furnace' LEFT JOIN f_med d ON d.machine_id = x.machine_id AND d.state = x.state
  LEFT JOIN f_min m ON m.minute = x.slot * 15 CROSS JOIN f_params) GROUP BY 1, 2, 3) s
 LEFT JOIN (SELECT plan_id, sum(charge_kg) AS production_kg, count(*) AS n_heats, sum(reheat_slots) AS reheat FROM {heats} GROUP BY 1) USING (plan_id))
"""


fragment("f_slotcur", _slot_sql("f_heat"))
fragment("f_slotrec", _slot_sql("f_rec"))
fragment("f_evcur", _eval_sql("f_slotcur", "f_heat"))
fragment("f_evrec", _eval_sql("f_slotrec", "f_rec"))


def slots(p):
    return p.stage("plan_slots", lambda: K.plan_slots(
        intervals.slot_states(p.telemetry(), p.machines, start=S.START, end=S.END), FIRST_DAY, LAST_DAY))


def plans(p):
    return slots(p).where("slot = 0").select(*K.PLAN)


def heats(p):
    return p.stage("plan_heats", lambda: K.assign_reheat(K.slots_to_heats(slots(p))))


def templates(p):
    return K.templates_from_heats(heats(p))


def candidate(p):
    """A second plan per machine-day: the same heats back to back from the first start."""
    def build():
        t = templates(p).join(heats(p).select("plan_id", "heat_no", F.col("start_slot").alias("_s0")), ["plan_id", "heat_no"])
        w = Window.partitionBy("plan_id").orderBy("heat_no")
        length = F.col("heating_slots") + F.col("melting_slots") + F.col("min_hold_slots")
        start = F.min("_s0").over(Window.partitionBy("plan_id")) + F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return t.select(*K.PLAN, "heat_no", start.cast("int").alias("start_slot"), "heating_slots", "melting_slots",
                        F.col("min_hold_slots").alias("holding_slots"),
                        F.when(F.dayofmonth("day") % 5 == 0, 380.0).otherwise(F.col("charge_kg")).alias("charge_kg"), F.lit(0).alias("reheat_slots"))
    return p.stage("plan_candidate", build)


def aux(p):
    return plans(p).where("machine_id = 'furnace-01'").select(
        "plan_id", F.lit("pump job").alias("name"), (F.dayofmonth("day") * 3 % 90).alias("start_slot"), F.lit(6).alias("duration_slots"), F.lit(15.0).alias("power_kw"))


def powers(p):
    return p.stage("state_powers", lambda: intervals.state_median_power(p.telemetry(), start=S.START, end=S.TRAIN_END))


def in_force(p):
    return reads.tariff_in_force(p.tariff, "2024-01-30")


def model(p):
    return reads.acceptable_baseline(p.baselines())


def evaluated(p, which):
    h = heats(p) if which == "cur" else candidate(p)
    return p.stage(f"evaluated_{which}", lambda: K.evaluate_schedule(
        K.schedule_slots(plans(p), h, aux(p)), h, model(p), powers(p), in_force(p), site_id=S.SITE, interval_s=p.interval_s))


_HEAT = "plan_id, heat_no, start_slot, heating_slots, melting_slots, holding_slots"
_HEAT_COLS = ["plan_id", "heat_no", "start_slot", "heating_slots", "melting_slots", "holding_slots"]


@query("slots_to_heats", f"SELECT {_HEAT} FROM f_heat0")
def _(p):
    return K.slots_to_heats(slots(p)).select(*_HEAT_COLS)


@query("assign_reheat", f"SELECT {_HEAT}, reheat_slots::BIGINT AS reheat_slots FROM f_heat")
def _(p):
    return heats(p).select(*_HEAT_COLS, "reheat_slots")


@query("assign_reheat_first_cold", """
SELECT plan_id, heat_no, CASE WHEN start_slot - coalesce(prev_end, 0) > 8 THEN least(heating_slots, 1) ELSE 0 END::BIGINT AS reheat_slots FROM f_heat
""")
def _(p):
    return K.assign_reheat(heats(p), first_cold=True).select("plan_id", "heat_no", "reheat_slots")


@query("templates_from_heats", "SELECT plan_id, heat_no, charge_kg, heating_slots, melting_slots, min_hold_slots, max_hold_slots FROM f_tpl")
def _(p):
    return templates(p).select("plan_id", "heat_no", "charge_kg", "heating_slots", "melting_slots", "min_hold_slots", "max_hold_slots")


@query("schedule_slots", "SELECT plan_id, slot, state, round(melt_kg, 4) AS melt_kg, aux_kw FROM f_slotrec")
def _(p):
    return K.schedule_slots(plans(p), candidate(p), aux(p)).select("plan_id", "slot", "state", "melt_kg", "aux_kw")


_EV = "plan_id, round(energy_kwh, 4) AS energy_kwh, round(peak_kw, 4) AS peak_kw, round(cost_inr, 4) AS cost_inr, production_kg, n_heats"


@query("evaluate_schedule", f"SELECT 'current' AS side, {_EV} FROM f_evcur UNION ALL SELECT 'recommended', {_EV} FROM f_evrec")
def _(p):
    cols = ["plan_id", "energy_kwh", "peak_kw", "cost_inr", "production_kg", "n_heats"]
    return evaluated(p, "cur").select(F.lit("current").alias("side"), *cols).unionByName(
        evaluated(p, "rec").select(F.lit("recommended").alias("side"), *cols))


_BR = ["heating_kwh", "melting_kwh", "holding_kwh", "idle_kwh", "reheat_kwh", "intercept_kwh", "aux_kwh"]


@query("energy_breakdown", "SELECT plan_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in _BR) + " FROM f_evcur")
def _(p):
    return evaluated(p, "cur").select("plan_id", *_BR)


@query("rate_at", """
SELECT t.machine_id, t.seq, m.period_name, m.rate FROM f_tel t JOIN f_min m ON m.minute = hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE)
""")
def _(p):
    rates = K.tariff_minutes(in_force(p))
    df = p.telemetry().select("machine_id", "seq", minute_of_day(local_time("ts", "Asia/Kolkata")).alias("minute"))
    return df.join(rates, "minute", "left").select("machine_id", "seq", "period_name", "rate")


# -- checks ---------------------------------------------------------------------
fragment("f_bad", """
SELECT plan_id, machine_id, day, heat_no, CASE WHEN heat_no = 1 THEN start_slot - 30 ELSE start_slot END AS start_slot, heating_slots, melting_slots,
 CASE WHEN heat_no % 3 = 2 THEN holding_slots + 1 ELSE holding_slots END AS holding_slots, charge_kg, reheat_slots FROM f_heat
""")
fragment("f_cons", """
SELECT plan_id, machine_id, 96 AS n_slots, coalesce(n, 0) + CASE WHEN day(day) % 6 = 0 THEN 1 ELSE 0 END AS n_heats, CASE WHEN day(day) % 4 = 0 THEN 40.0::DOUBLE END AS peak_cap_kw
FROM f_plan LEFT JOIN (SELECT plan_id, count(*) AS n FROM f_heat GROUP BY 1) USING (plan_id)
""")


def bad_heats(p):
    return heats(p).withColumns({"start_slot": F.when(F.col("heat_no") == 1, F.col("start_slot") - 30).otherwise(F.col("start_slot")),
                                 "holding_slots": F.when(F.col("heat_no") % 3 == 2, F.col("holding_slots") + 1).otherwise(F.col("holding_slots"))})


def constraints(p):
    n = heats(p).groupBy("plan_id").agg(F.count("*").alias("_n"))
    day = F.dayofmonth("day")
    return plans(p).join(n, "plan_id", "left").select(
        "plan_id", "machine_id", F.lit(96).alias("n_slots"), (F.coalesce("_n", F.lit(0)) + F.when(day % 6 == 0, 1).otherwise(0)).alias("n_heats"),
        F.lit(8).alias("cold_slots"), F.lit(1).alias("reheat_slots"), F.lit(False).alias("first_cold"), F.when(day % 4 == 0, 40.0).alias("peak_cap_kw"))


def _limits(p):
    pl = plans(p)
    windows = pl.select("plan_id", F.explode(F.array(F.struct(F.lit(0).alias("ws"), F.lit(50).alias("we")), F.struct(F.lit(50).alias("ws"), F.lit(96).alias("we")))).alias("w")).select("plan_id", "w.*")
    maintenance = pl.select("plan_id", F.lit(20).alias("ms"), F.lit(24).alias("me"))
    tasks = aux(p).select("plan_id", "name", F.when(F.col("start_slot") % 2 == 0, 6).otherwise(5).alias("duration_slots"), F.lit(10).alias("window_start_slot"),
                          F.when(F.col("start_slot") > 80, 14).otherwise(70).alias("window_end_slot"))
    return windows, maintenance, tasks


fragment("f_badx", """
SELECT b.*, row_number() OVER w - 1 AS pos, start_slot + heating_slots + melting_slots + holding_slots AS e,
 lag(start_slot + heating_slots + melting_slots + holding_slots) OVER w AS prev FROM f_bad b WINDOW w AS (PARTITION BY plan_id ORDER BY start_slot, heat_no)
""")
fragment("f_auxtask", """
SELECT plan_id, name, CASE WHEN start_slot % 2 = 0 THEN 6 ELSE 5 END AS t_dur, 10 AS ws, CASE WHEN start_slot > 80 THEN 14 ELSE 70 END AS we FROM f_aux
""")


@query("validate_schedules", """
SELECT plan_id, 'heat ' || x.pos AS item, v AS violation FROM (SELECT x.*, unnest(list_filter([
  CASE WHEN x.start_slot < 0 OR e > 96 THEN 'outside horizon' END, CASE WHEN x.melting_slots <> t.melting_slots THEN 'melting differs from template' END,
  CASE WHEN x.holding_slots < t.min_hold_slots OR x.holding_slots > t.max_hold_slots THEN 'holding out of bounds' END,
  CASE WHEN x.reheat_slots <> CASE WHEN prev IS NOT NULL AND x.start_slot - prev > 8 THEN 1 ELSE 0 END THEN 'reheat differs' END,
  CASE WHEN x.heating_slots <> t.heating_slots + CASE WHEN prev IS NOT NULL AND x.start_slot - prev > 8 THEN 1 ELSE 0 END THEN 'heating differs' END,
  CASE WHEN x.start_slot < prev THEN 'overlaps previous heat' END,
  CASE WHEN NOT ((x.start_slot >= 0 AND e <= 50) OR (x.start_slot >= 50 AND e <= 96)) THEN 'not inside one operating window' END,
  CASE WHEN x.start_slot < 24 AND 20 < e THEN 'overlaps maintenance' END], lambda y: y IS NOT NULL)) AS v
 FROM (SELECT *, count(*) OVER (PARTITION BY plan_id) AS cnt FROM f_badx) x JOIN f_cons c ON c.plan_id = x.plan_id
 LEFT JOIN f_tpl t ON t.plan_id = x.plan_id AND t.heat_no = CASE WHEN x.cnt = c.n_heats THEN x.pos ELSE 0 END) x
UNION ALL SELECT plan_id, 'plan', 'peak cap set but no state powers' FROM f_cons WHERE peak_cap_kw IS NOT NULL AND machine_id NOT IN (SELECT machine_id FROM f_med)
UNION ALL SELECT plan_id, 'plan', 'heat count differs' FROM f_cons WHERE n_heats <> (SELECT count(*) FROM f_bad b WHERE b.plan_id = f_cons.plan_id)
UNION ALL SELECT plan_id, 'aux pump job', v FROM (SELECT plan_id, unnest(list_filter([CASE WHEN duration_slots <> t_dur THEN 'duration differs' END,
  CASE WHEN NOT (ws <= start_slot AND start_slot + duration_slots <= we) THEN 'outside its window' END,
  CASE WHEN start_slot < 24 AND 20 < start_slot + duration_slots THEN 'overlaps maintenance' END], lambda y: y IS NOT NULL)) AS v FROM f_aux JOIN f_auxtask USING (plan_id, name))
UNION ALL SELECT DISTINCT plan_id, 'plan', 'peak cap exceeded' FROM (SELECT coalesce(b.plan_id, a.plan_id) AS plan_id, coalesce(b.slot, a.slot) AS slot, coalesce(kw, 0) + coalesce(akw, 0) AS load FROM (
  SELECT plan_id, slot, max(coalesce(median_kw, 0)) AS kw FROM (SELECT plan_id, machine_id, start_slot + i AS slot,
    CASE WHEN i < heating_slots THEN 'heating' WHEN i < heating_slots + melting_slots THEN 'melting' ELSE 'holding' END AS state
   FROM (SELECT *, unnest(range(0, heating_slots + melting_slots + holding_slots)) AS i FROM f_bad)) LEFT JOIN f_med USING (machine_id, state) GROUP BY 1, 2) b
  FULL JOIN (SELECT plan_id, unnest(range(start_slot, start_slot + duration_slots)) AS slot, power_kw AS akw FROM f_aux) a ON a.plan_id = b.plan_id AND a.slot = b.slot)
 JOIN f_cons USING (plan_id) WHERE load > peak_cap_kw + 1e-9 AND slot BETWEEN 0 AND 95
""")
def _(p):
    windows, maintenance, tasks = _limits(p)
    return K.validate_schedules(bad_heats(p), aux(p), constraints(p), templates(p), windows, maintenance, tasks, powers(p))


fragment("f_infeas", """
SELECT plan_id, array_to_string(list_filter([CASE WHEN need > 96 THEN 'operating-hours: total' END, CASE WHEN mx > 50 THEN 'operating-hours: longest window' END,
 CASE WHEN need > 92 THEN 'maintenance' END, CASE WHEN peak_cap_kw < top THEN 'peak-cap' END, CASE WHEN tight > 0 THEN 'aux-window' END], lambda y: y IS NOT NULL), '; ') AS groups
FROM (SELECT plan_id, machine_id, peak_cap_kw, coalesce(total, 0) AS need, mx, top, tight FROM f_cons
 LEFT JOIN (SELECT plan_id, sum(heating_slots + melting_slots + min_hold_slots) AS total, max(heating_slots + melting_slots + min_hold_slots) AS mx FROM f_tpl GROUP BY 1) USING (plan_id)
 LEFT JOIN (SELECT machine_id, max(median_kw) AS top FROM f_med WHERE state <> 'idle' GROUP BY 1) USING (machine_id)
 LEFT JOIN (SELECT plan_id, count(*) FILTER (we - ws < t_dur) AS tight FROM f_auxtask GROUP BY 1) USING (plan_id))
""")


def infeasible(p):
    windows, maintenance, tasks = _limits(p)
    return K.infeasible_groups(constraints(p), templates(p), windows, maintenance, tasks, powers(p))


@query("infeasible_groups", "SELECT plan_id, groups FROM f_infeas")
def _(p):
    return infeasible(p)


@query("comparability", """
SELECT c.plan_id, reason = 'same production and auxiliary tasks' AS comparable, reason AS comparability_reason FROM (
 SELECT c.plan_id, CASE WHEN c.production_kg = 0 THEN 'current production is zero' WHEN abs(r.production_kg - c.production_kg) / c.production_kg > 0.01 THEN 'production differs'
  WHEN abs(c.aux_kwh - r.aux_kwh) > 1e-6 THEN 'auxiliary tasks differ' ELSE 'same production and auxiliary tasks' END AS reason
 FROM f_evcur c JOIN f_evrec r USING (plan_id)) c
""")
def _(p):
    return K.comparability(evaluated(p, "cur"), evaluated(p, "rec"))


@query("shift_plan")
def _(p):
    return K.shift_plan(templates(p), model(p), in_force(p), site_id=S.SITE).select(*_HEAT_COLS, "reheat_slots")


@query("shift_status", """
SELECT plan_id, CASE WHEN n > 0 THEN 'SHIFTED' ELSE 'EMPTY' END AS status, n AS n_heats, n AS n_placed FROM (
 SELECT x.plan_id, coalesce(c, 0) AS n FROM (SELECT DISTINCT plan_id FROM f_slotcur WHERE machine_id IN (SELECT machine_id FROM f_bl WHERE machine_type = 'furnace')) x LEFT JOIN (SELECT plan_id, count(*) AS c FROM f_heat GROUP BY 1) h ON h.plan_id = x.plan_id)
""")
def _(p):
    shifted = p.stage("plan_shifted", lambda: K.shift_plan(templates(p), model(p), in_force(p), site_id=S.SITE))
    modelled = plans(p).join(model(p).select("machine_id"), "machine_id", "left_semi")
    return K.shift_status(modelled, heats(p), shifted)


@query("shift_plan_evaluated")
def _(p):
    shifted = p.stage("plan_shifted", lambda: K.shift_plan(templates(p), model(p), in_force(p), site_id=S.SITE))
    def priced(h):
        return K.evaluate_schedule(K.schedule_slots(plans(p), h, aux(p)), h, model(p), powers(p), in_force(p), site_id=S.SITE, interval_s=p.interval_s)
    cur, rec = priced(heats(p)), priced(shifted)
    status = K.shift_status(plans(p), heats(p), shifted)
    out = cur.select("plan_id", F.col("energy_kwh").alias("current_kwh"), F.col("cost_inr").alias("current_inr")).join(
        rec.select("plan_id", F.col("energy_kwh").alias("kwh"), F.col("cost_inr").alias("inr")), "plan_id").join(status, "plan_id")
    found = F.col("status") != "INFEASIBLE"  # an unplaced plan is not the cheap idle day
    return out.select("plan_id", "status", "current_kwh", "current_inr", F.when(found, F.col("kwh")).alias("shifted_kwh"), F.when(found, F.col("inr")).alias("shifted_inr"))


@query("plan_inputs_hash", """
SELECT plan_id, sha256('{"cold_slots":8,"first_cold":false,"machine_id":"' || machine_id || '","n_heats":' || n_heats || ',"n_slots":96,"peak_cap_kw":' || CASE WHEN peak_cap_kw IS NULL THEN 'null' ELSE '40.0' END || ',"reheat_slots":1}') AS inputs_hash
FROM f_cons
""")
def _(p):
    return K.plan_inputs_hash(constraints(p))


@query("plan_timeline", """
SELECT plan_id, 'Heat ' || (heat_no + 1) || ' ' || phase AS task, CAST(p0 * 15 AS BIGINT) AS start_min, CAST((p0 + n) * 15 AS BIGINT) AS finish_min FROM (
 SELECT plan_id, heat_no, 'heating' AS phase, start_slot AS p0, heating_slots AS n FROM f_heat
 UNION ALL SELECT plan_id, heat_no, 'melting', start_slot + heating_slots, melting_slots FROM f_heat
 UNION ALL SELECT plan_id, heat_no, 'holding', start_slot + heating_slots + melting_slots, holding_slots FROM f_heat) WHERE n > 0
UNION ALL SELECT plan_id, 'aux pump job', start_slot * 15, (start_slot + duration_slots) * 15 FROM f_aux
""")
def _(p):
    return K.plan_timeline(heats(p), aux(p))


@query("board_cost", """
SELECT plan_id, round(sum(kwh), 4) AS kwh, round(sum(kwh * rate), 4) AS inr, round(sum(CASE WHEN rate = 10.5 THEN kwh ELSE 0 END) / sum(kwh) * 100, 4) AS dear_pct FROM (
 SELECT plan_id, rated_power_kw * CASE WHEN i < heating_slots + reheat_slots THEN 0.85::DOUBLE WHEN i < heating_slots + reheat_slots + melting_slots THEN 0.95::DOUBLE ELSE 0.45::DOUBLE END * 15 / 60.0 AS kwh,
  (start_slot + i) * 15 % 1440 AS minute FROM (SELECT *, unnest(range(0, heating_slots + reheat_slots + melting_slots + holding_slots)) AS i FROM f_heat) JOIN f_machine USING (machine_id))
JOIN f_min USING (minute) GROUP BY 1
""")
def _(p):
    return K.board_cost(heats(p), p.machines, in_force(p), site_id=S.SITE)


@query("what_if_heats", """
SELECT plan_id, heat_no, hot, round(sum(kwh) + 50 * 0.33::DOUBLE * 0.375::DOUBLE, 4) AS kwh, round(sum(kwh * rate), 4) AS inr, round((sum(kwh) + 50 * 0.33::DOUBLE * 0.375::DOUBLE) / 0.375::DOUBLE, 4) AS sec_kwh_per_t FROM (
 SELECT plan_id, heat_no, hot, rated_power_kw * fr / 60.0 AS kwh, CAST(floor(t0 + m) AS BIGINT) % 1440 AS minute FROM (
  SELECT *, unnest(range(0, CAST(ceil(mins) AS BIGINT))) AS m FROM (
   SELECT plan_id, heat_no, hot, rated_power_kw, ph.fr AS fr, ph.mins AS mins, ph.t0 AS t0 FROM (SELECT *, unnest([
     {'fr': 0.85::DOUBLE, 'mins': 20.0::DOUBLE + 0.15::DOUBLE * cold, 't0': (start_slot * 15)::DOUBLE},
     {'fr': 0.95::DOUBLE, 'mins': 45.0::DOUBLE, 't0': start_slot * 15 + (20.0::DOUBLE + 0.15::DOUBLE * cold)},
     {'fr': 0.45::DOUBLE, 'mins': hold::DOUBLE, 't0': start_slot * 15 + (20.0::DOUBLE + 0.15::DOUBLE * cold) + 45},
     {'fr': CASE WHEN hot THEN 0.45::DOUBLE ELSE 0.08::DOUBLE END, 'mins': gap::DOUBLE, 't0': start_slot * 15 + (20.0::DOUBLE + 0.15::DOUBLE * cold) + 45 + hold}]) AS ph FROM (
     SELECT *, CASE WHEN hot THEN 0 ELSE gap END AS cold FROM (SELECT plan_id, heat_no, start_slot, rated_power_kw, holding_slots * 15 AS hold,
       (start_slot - coalesce(prev_end, start_slot)) * 15 AS gap, unnest([TRUE, FALSE]) AS hot FROM f_heat JOIN f_machine USING (machine_id)))))))
JOIN f_min USING (minute) GROUP BY 1, 2, 3
""")
def _(p):
    w = Window.partitionBy("plan_id").orderBy("start_slot")
    h = heats(p).withColumn("_prev", F.lag(K.end_slot()).over(w)).select(
        "plan_id", "heat_no", "machine_id", "charge_kg", (F.col("start_slot") * 15).alias("start_min"), (F.col("holding_slots") * 15).alias("hold_min"),
        ((F.col("start_slot") - F.coalesce("_prev", "start_slot")) * 15).alias("gap_min"))
    return K.what_if_heats(h, p.machines, in_force(p), site_id=S.SITE).drop("charge_kg")


@query("required_heats", """
SELECT plan_id, CAST(CASE WHEN kg IS NULL THEN n ELSE ceil(kg / 375.0 - 1e-9) END AS BIGINT) AS required_heats FROM (
 SELECT plan_id, coalesce(n, 0) AS n, kg FROM f_plan LEFT JOIN (SELECT plan_id, count(*) AS n FROM f_heat GROUP BY 1) USING (plan_id)
 LEFT JOIN (SELECT machine_id || '|' || CAST(CAST(window_start + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS plan_id, sum(qty_good_kg) AS kg FROM f_prod WHERE quality = 'GOOD' GROUP BY 1) USING (plan_id))
""")
def _(p):
    n = heats(p).groupBy("plan_id").agg(F.count("*").alias("n"))
    day = F.to_date(local_time("window_start", "Asia/Kolkata")).cast("string")
    kg = p.production().where("quality = 'GOOD'").groupBy(F.concat_ws("|", "machine_id", day).alias("plan_id")).agg(F.sum("qty_good_kg").alias("kg"))
    df = plans(p).join(n, "plan_id", "left").join(kg, "plan_id", "left")
    return df.select("plan_id", K.required_heats(F.col("kg"), F.coalesce("n", F.lit(0))).cast("long").alias("required_heats"))


# -- shifting within a plan's own limits ------------------------------------------
def limited(p):
    windows, maintenance, tasks = _limits(p)
    return p.stage("plans_limited", lambda: L.shift_within_limits(
        templates(p), constraints(p), windows, maintenance, tasks.withColumn("power_kw", F.lit(15.0)), powers(p), model(p), in_force(p), site_id=S.SITE,
        stage=lambda name, df: p.stage(name, lambda: df)))


fragment("f_limw", """
SELECT c.plan_id, i AS heat_no, coalesce(o.charge_kg, d.charge_kg) AS charge_kg, coalesce(o.heating_slots, d.heating_slots) AS h, coalesce(o.melting_slots, d.melting_slots) AS m,
 coalesce(o.min_hold_slots, d.min_hold_slots) AS o
FROM (SELECT *, unnest(range(0, n_heats)) AS i FROM f_cons) c LEFT JOIN (SELECT plan_id, count(*) AS n FROM f_tpl GROUP BY 1) k USING (plan_id)
LEFT JOIN f_tpl o ON o.plan_id = c.plan_id AND o.heat_no = i AND k.n = c.n_heats LEFT JOIN f_tpl d ON d.plan_id = c.plan_id AND d.heat_no = 0
""")
fragment("f_limp", """
SELECT c.*, b_prod, b_heating, b_holding, b_idle, kw_h, kw_m, kw_o, t.t_dur, t.ws, t.we,
 coalesce(greatest(kw_h, kw_m, kw_o) + CASE WHEN t_dur IS NULL THEN 0 ELSE 15 END > peak_cap_kw + 1e-9, FALSE) AS binds
FROM f_cons c JOIN f_bl b ON b.machine_id = c.machine_id AND b.machine_type = 'furnace'
LEFT JOIN (SELECT machine_id, coalesce(max(median_kw) FILTER (state = 'heating'), 0) AS kw_h, coalesce(max(median_kw) FILTER (state = 'melting'), 0) AS kw_m,
  coalesce(max(median_kw) FILTER (state = 'holding'), 0) AS kw_o FROM f_med GROUP BY 1) d ON d.machine_id = c.machine_id
LEFT JOIN f_auxtask t ON t.plan_id = c.plan_id
""")
fragment("f_limprice", "SELECT minute // 15 AS slot, 1.0::DOUBLE + 1.0::DOUBLE * rate AS price FROM f_min WHERE minute % 15 = 0")
fragment("f_limlab", """
SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY aux_cost, aux) AS best FROM (
 SELECT p.plan_id, s AS aux, (SELECT sum(CAST(round(price * 15.0::DOUBLE * 0.25::DOUBLE * 1000000) AS BIGINT)) FROM f_limprice WHERE slot >= s AND slot < s + t_dur) AS aux_cost
 FROM (SELECT *, unnest(range(ws, greatest(ws, least(we, 96) - t_dur + 1))) AS s FROM f_limp WHERE t_dur IS NOT NULL) p WHERE NOT (s < 24 AND 20 < s + t_dur)
 UNION ALL SELECT plan_id, -1, 0 FROM f_limp WHERE t_dur IS NULL)
""")
fragment("f_limslot", """
SELECT plan_id, aux, aux_cost, slot, sum(ch) OVER w AS ch, sum(co) OVER w AS co, sum(vh) OVER w AS vh, sum(vm) OVER w AS vm, sum(vo) OVER w AS vo FROM (
 SELECT p.plan_id, aux, aux_cost, slot, CAST(round(price * ((b_heating - b_idle) * 0.25::DOUBLE) * 1000000) AS BIGINT) AS ch, CAST(round(price * ((b_holding - b_idle) * 0.25::DOUBLE) * 1000000) AS BIGINT) AS co,
  CASE WHEN aux >= 0 AND slot >= aux AND slot < aux + t_dur THEN 15 ELSE 0 END AS kw,
  CASE WHEN kw_h + kw > peak_cap_kw + 1e-9 THEN 1 ELSE 0 END AS vh, CASE WHEN kw_m + kw > peak_cap_kw + 1e-9 THEN 1 ELSE 0 END AS vm, CASE WHEN kw_o + kw > peak_cap_kw + 1e-9 THEN 1 ELSE 0 END AS vo
 FROM f_limp p JOIN f_limlab l ON l.plan_id = p.plan_id AND (p.binds OR l.best = 1) CROSS JOIN f_limprice) WINDOW w AS (PARTITION BY plan_id, aux ORDER BY slot)
""")
fragment("f_limmelt", """
SELECT plan_id, heat_no, slot, sum(cm) OVER (PARTITION BY plan_id, heat_no ORDER BY slot) AS cm FROM (
 SELECT w.plan_id, heat_no, slot, CAST(round(price * (b_prod * charge_kg / greatest(m, 1) - b_idle * 0.25::DOUBLE) * 1000000) AS BIGINT) AS cm
 FROM f_limw w JOIN f_limp USING (plan_id) CROSS JOIN f_limprice)
""")
# Every place of every heat, with and without extra heating: cost of the slots it takes over idling.
fragment("f_limopt", """
SELECT x.plan_id, x.aux, x.heat_no, x.r, x.s, x.e,
 (b.ch - coalesce(a.ch, 0)) + (c.cm - coalesce(mm.cm, 0)) + (d.co - c2.co) AS cost
FROM (SELECT l.plan_id, l.aux, w.heat_no, r, s, s + w.h + r AS m0, s + w.h + r + w.m AS m1, s + w.h + r + w.m + w.o AS e
 FROM (SELECT DISTINCT plan_id, aux FROM f_limslot) l JOIN f_limw w USING (plan_id), (SELECT unnest([0, 1]) AS r), (SELECT unnest(range(0, 96)) AS s)) x
LEFT JOIN f_limslot a ON a.plan_id = x.plan_id AND a.aux = x.aux AND a.slot = s - 1
JOIN f_limslot b ON b.plan_id = x.plan_id AND b.aux = x.aux AND b.slot = m0 - 1
JOIN f_limslot c2 ON c2.plan_id = x.plan_id AND c2.aux = x.aux AND c2.slot = m1 - 1
JOIN f_limslot d ON d.plan_id = x.plan_id AND d.aux = x.aux AND d.slot = e - 1
JOIN f_limmelt c ON c.plan_id = x.plan_id AND c.heat_no = x.heat_no AND c.slot = m1 - 1
LEFT JOIN f_limmelt mm ON mm.plan_id = x.plan_id AND mm.heat_no = x.heat_no AND mm.slot = m0 - 1
WHERE e <= CASE WHEN s < 20 THEN 20 WHEN s < 24 THEN s WHEN s < 50 THEN 50 ELSE 96 END
 AND b.vh = coalesce(a.vh, 0) AND c2.vm = b.vm AND d.vo = c2.vo
""")
fragment("f_limdp", """
SELECT * FROM (WITH RECURSIVE dp(plan_id, aux, i, e, cost, path) AS (
 SELECT plan_id, aux, 0, e, min(cost), min([s, r]) FROM f_limopt WHERE heat_no = 0 AND r = 0 GROUP BY plan_id, aux, e
 UNION ALL
 SELECT x.plan_id, x.aux, x.i, x.e, min(x.cost), arg_min(x.path, {'c': x.cost, 'p': x.path}) FROM (
  SELECT dp.plan_id, dp.aux, dp.i + 1 AS i, o.e, dp.cost + o.cost AS cost, dp.path || [o.s, o.r] AS path
  FROM dp JOIN f_limopt o ON o.plan_id = dp.plan_id AND o.aux = dp.aux AND o.heat_no = dp.i + 1 AND o.s >= dp.e AND o.r = CASE WHEN o.s - dp.e > 8 THEN 1 ELSE 0 END) x
 GROUP BY x.plan_id, x.aux, x.i, x.e) SELECT * FROM dp)
""")
fragment("f_limbest", """
SELECT p.plan_id, p.machine_id, p.n_heats, z.z.c AS cost, z.z.a AS aux, z.z.p AS path FROM f_limp p LEFT JOIN (
 SELECT plan_id, min({'c': cost + aux_cost, 'a': aux, 'p': path}) AS z FROM (
  SELECT d.plan_id, d.aux, l.aux_cost, d.cost, d.path FROM f_limdp d JOIN f_cons c ON c.plan_id = d.plan_id AND d.i = c.n_heats - 1 JOIN f_limlab l ON l.plan_id = d.plan_id AND l.aux = d.aux
  UNION ALL SELECT DISTINCT s.plan_id, s.aux, s.aux_cost, 0, []::BIGINT[] FROM f_limslot s JOIN f_cons c ON c.plan_id = s.plan_id AND c.n_heats = 0) GROUP BY 1) z USING (plan_id)
""")


@query("shift_within_limits", """
SELECT plan_id, CASE WHEN cost IS NULL THEN 'INFEASIBLE' WHEN n_heats = 0 THEN 'EMPTY' ELSE 'SHIFTED' END AS status, round(cost / 1000000.0, 4) AS objective,
 array_to_string(list_transform(range(1, len(path) + 1, 2), lambda k: path[k] || '+' || path[k + 1]), ' ') AS starts, CASE WHEN aux >= 0 THEN aux END AS aux_start FROM f_limbest
""")
def _(p):
    starts = F.array_join(F.transform("heats", lambda h: F.concat(h["start_slot"].cast("string"), F.lit("+"), h["reheat_slots"].cast("string"))), " ")
    return limited(p).select("plan_id", "status", "objective", starts.alias("starts"), F.get("aux", F.lit(0))["start_slot"].alias("aux_start"))


@query("shift_within_limits_checked", """
SELECT plan_id, CASE WHEN cost IS NULL THEN 'INFEASIBLE' WHEN n_heats = 0 THEN 'EMPTY' ELSE 'SHIFTED' END AS status, CAST(0 AS BIGINT) AS n_violations FROM f_limbest
""")
def _(p):
    windows, maintenance, tasks = _limits(p)
    done = limited(p)
    good = done.where("status <> 'INFEASIBLE'").select("plan_id")
    wrong = K.validate_schedules(L.placed_heats(done), L.placed_aux(done), constraints(p).join(good, "plan_id", "left_semi"), L.wanted_templates(constraints(p), templates(p)), windows, maintenance, tasks, powers(p))
    return done.select("plan_id", "status").join(wrong.groupBy("plan_id").agg(F.count("*").alias("n_violations")), "plan_id", "left").na.fill(0, ["n_violations"])
