"""Heat schedules of many plans at once: rebuild, price, check, shift.

A plan is one machine-day (or one candidate for it) on a grid of slots. Windows and
groups are keyed by ``plan_id`` and hold at most one horizon of slots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions.columns import local_time, minute_of_day

COLD_SLOTS = max(1, int(round(C.OPT_COLD_THRESHOLD_H * 60 / C.OPT_SLOT_MIN)))
REHEAT_SLOTS = max(1, int(round(C.OPT_REHEAT_EXTRA_H * 60 / C.OPT_SLOT_MIN)))
N_SLOTS = C.OPT_HORIZON_H * 60 // C.OPT_SLOT_MIN
PLAN = ["plan_id", "machine_id", "day"]


def plan_slots(slots: DataFrame, first_day: str, last_day: str, tz: str = C.LOCAL_TZ, slot_min: int = C.OPT_SLOT_MIN) -> DataFrame:
    """Slot states cut into whole local days: plan_id, machine_id, day, slot, state."""
    lt = local_time("window_start", tz)
    df = slots.select("machine_id", F.to_date(lt).alias("day"), (minute_of_day(lt) / slot_min).cast("int").alias("slot"), "state")
    return df.where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).withColumn(
        "plan_id", F.concat_ws("|", "machine_id", F.col("day").cast("string")))


def slots_to_heats(slots: DataFrame, charge_kg: float = C.OPT_HEAT_CHARGE_KG) -> DataFrame:
    """Heats = a heating run followed at once by melting and then, if any, holding."""
    w = Window.partitionBy("plan_id").orderBy("slot")
    change = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1))
    runs = slots.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w))
    runs = runs.groupBy(*PLAN, "_run", "state").agg(F.min("slot").alias("start_slot"), F.count("*").cast("int").alias("len"))
    r = Window.partitionBy("plan_id").orderBy("_run")
    nxt = lambda c, i: F.lead(c, i).over(r)
    runs = runs.withColumns({"_s1": nxt("state", 1), "_l1": nxt("len", 1), "_s2": nxt("state", 2), "_l2": nxt("len", 2)})
    heats = runs.where((F.col("state") == "heating") & (F.col("_s1") == "melting"))
    return heats.select(
        *PLAN, (F.row_number().over(Window.partitionBy("plan_id").orderBy("start_slot")) - 1).alias("heat_no"), "start_slot",
        F.col("len").alias("heating_slots"), F.col("_l1").alias("melting_slots"),
        F.when(F.col("_s2") == "holding", F.col("_l2")).otherwise(0).alias("holding_slots"), F.lit(charge_kg).alias("charge_kg"))


def end_slot() -> Column:
    return F.col("start_slot") + F.col("heating_slots") + F.col("melting_slots") + F.col("holding_slots")


def _heat_gap(first_cold: bool, cold_slots: int) -> tuple[Column, Column]:
    prev = F.lag(end_slot()).over(Window.partitionBy("plan_id").orderBy("start_slot"))
    gap = F.col("start_slot") - F.coalesce(prev, F.lit(0))
    cold = (gap > cold_slots) & (prev.isNotNull() | F.lit(first_cold))
    return gap, cold


def assign_reheat(heats: DataFrame, cold_slots: int = COLD_SLOTS, extra_slots: int = REHEAT_SLOTS, first_cold: bool = False) -> DataFrame:
    """Splits observed heating into base and reheat after a cold gap; totals never change."""
    _, cold = _heat_gap(first_cold, cold_slots)
    return heats.withColumn("reheat_slots", F.when(cold, F.least("heating_slots", F.lit(extra_slots))).otherwise(0))


def templates_from_heats(heats: DataFrame) -> DataFrame:
    base = F.greatest(F.lit(0), F.col("heating_slots") - F.coalesce("reheat_slots", F.lit(0)))
    return heats.select(*PLAN, "heat_no", "charge_kg", base.alias("heating_slots"), "melting_slots",
                        F.col("holding_slots").alias("min_hold_slots"), F.col("holding_slots").alias("max_hold_slots"))


def _heat_slot_rows(heats: DataFrame) -> DataFrame:
    """One row per heat and occupied slot with its phase."""
    h, m = F.col("heating_slots"), F.col("melting_slots")
    n = h + m + F.col("holding_slots")
    rows = heats.where(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    phase = F.when(F.col("_i") < h, "heating").when(F.col("_i") < h + m, "melting").otherwise("holding")
    return rows.select("plan_id", "start_slot", (F.col("start_slot") + F.col("_i")).alias("slot"), phase.alias("state"), "charge_kg", "melting_slots")


def schedule_slots(plans: DataFrame, heats: DataFrame, aux: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Every slot of every plan: state (a later heat wins, idle otherwise), aux kW, melt kg."""
    occ = _heat_slot_rows(heats).groupBy("plan_id", "slot").agg(
        F.max_by("state", "start_slot").alias("state"),
        F.sum(F.when(F.col("state") == "melting", F.col("charge_kg") / F.col("melting_slots"))).alias("melt_kg"))
    a = aux.withColumn("slot", F.explode(F.sequence("start_slot", F.col("start_slot") + F.col("duration_slots") - 1)))
    a = a.groupBy("plan_id", "slot").agg(F.sum("power_kw").alias("aux_kw"))
    grid = plans.select(*PLAN).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))))
    return (grid.join(occ, ["plan_id", "slot"], "left").join(a, ["plan_id", "slot"], "left")
            .withColumns({"state": F.coalesce("state", F.lit("idle")), "melt_kg": F.coalesce("melt_kg", F.lit(0.0)),
                          "aux_kw": F.coalesce("aux_kw", F.lit(0.0))}))


def tariff_minutes(tariff: DataFrame) -> DataFrame:
    """One row per site and minute of day: the first period that covers it.

    A period with end <= start wraps past midnight. 1440 rows per site make the price
    lookup an equi join instead of a range predicate.
    """
    s, e, m = F.col("start_min"), F.col("end_min"), F.col("minute")
    df = tariff.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(1439))))
    covers = F.when(s <= e, (m >= s) & (m < e)).otherwise((m >= s) | (m < e))
    return df.where(covers).groupBy("site_id", "minute").agg(
        F.min_by(F.struct("period_name", "energy_inr_per_kwh"), "start_min").alias("p")).select(
        "site_id", "minute", "p.period_name", F.col("p.energy_inr_per_kwh").alias("rate"))


def evaluate_schedule(slots: DataFrame, heats: DataFrame, model: DataFrame, powers: DataFrame, tariff: DataFrame, *,
                      site_id: str, interval_s: int, slot_min: int = C.OPT_SLOT_MIN) -> DataFrame:
    """Energy, peak, cost and breakdown per plan. Cost is null where a slot has no price; peak and cost are null where a state has no known power."""
    slot_h = slot_min / 60.0
    c = lambda f: F.col("coefficients")[f]
    m = model.select("machine_id", c("good_production_kg").alias("b_prod"), c("hours_heating").alias("b_heat"),
                     c("hours_holding").alias("b_hold"), c("hours_idle").alias("b_idle"), F.col("intercept").alias("_i"))
    pw = powers.select("machine_id", F.col("machine_state").alias("state"), F.col("median_kw").alias("state_kw"))
    rates = tariff_minutes(tariff.where(F.col("site_id") == site_id)).select((F.col("minute") / slot_min).alias("_s"), "rate")
    rates = rates.where(F.col("_s") == F.floor("_s")).select(F.col("_s").cast("int").alias("slot"), "rate")
    df = slots.join(m, "machine_id").join(pw, ["machine_id", "state"], "left").join(rates, "slot", "left")
    per_slot = F.col("_i") * (slot_h / (interval_s / 3600.0))
    melt = F.col("b_prod") * F.col("melt_kg")
    st = F.col("state")
    state_kwh = (F.when(st == "heating", F.col("b_heat")).when(st == "holding", F.col("b_hold")).when(st == "melting", 0.0)
                 .otherwise(F.col("b_idle"))) * slot_h
    df = df.withColumns({"slot_kwh": per_slot + F.col("aux_kw") * slot_h + melt + state_kwh,
                         "slot_kw": F.col("state_kw") + F.col("aux_kw")})
    agg = df.groupBy(*PLAN).agg(
        F.sum("slot_kwh").alias("energy_kwh"), F.when(F.count_if(F.col("slot_kw").isNull()) == 0, F.max("slot_kw")).alias("peak_kw"),
        F.sum(F.col("slot_kwh") * F.col("rate")).alias("_cost"), F.count_if(F.col("rate").isNull()).alias("_unpriced"),
        F.count_if(st == "heating").alias("_n_heating"), F.sum(melt).alias("melting_kwh"),
        F.sum(F.when(st == "holding", state_kwh).otherwise(0.0)).alias("holding_kwh"),
        F.sum(F.when(st == "idle", state_kwh).otherwise(0.0)).alias("idle_kwh"),
        F.sum(per_slot).alias("intercept_kwh"), F.sum(F.col("aux_kw") * slot_h).alias("aux_kwh"), F.first("b_heat").alias("_bh"))
    per_plan = heats.groupBy("plan_id").agg(F.sum("charge_kg").alias("production_kg"), F.count("*").alias("n_heats"),
                                            F.sum(F.greatest(F.lit(0), "reheat_slots")).alias("_reheat"))
    demand = tariff.where(F.col("site_id") == site_id).agg(F.coalesce(F.max("demand_inr_per_kw"), F.lit(0.0)).alias("_demand"))
    out = agg.join(per_plan, "plan_id", "left").crossJoin(demand)
    reheat = F.least(F.coalesce("_reheat", F.lit(0)), F.col("_n_heating"))
    return out.select(
        *PLAN, "energy_kwh", "peak_kw",
        F.when(F.col("_unpriced") == 0, F.col("_cost") + F.col("peak_kw") * F.col("_demand")).alias("cost_inr"),
        F.coalesce("production_kg", F.lit(0.0)).alias("production_kg"), F.coalesce("n_heats", F.lit(0)).alias("n_heats"),
        ((F.col("_n_heating") - reheat) * F.col("_bh") * slot_h).alias("heating_kwh"), "melting_kwh", "holding_kwh", "idle_kwh",
        (reheat * F.col("_bh") * slot_h).alias("reheat_kwh"), "intercept_kwh", "aux_kwh")


def comparability(current: DataFrame, recommended: DataFrame, tol: float = C.COMPARABLE_PROD_TOL) -> DataFrame:
    """Same production within the tolerance and the same auxiliary energy."""
    cur = current.select("plan_id", F.col("production_kg").alias("_cp"), F.col("aux_kwh").alias("_ca"))
    rec = recommended.select("plan_id", F.col("production_kg").alias("_rp"), F.col("aux_kwh").alias("_ra"))
    diff = F.abs(F.col("_rp") - F.col("_cp")) / F.col("_cp")
    reason = (F.when(F.col("_cp") == 0, "current production is zero").when(diff > tol, "production differs")
              .when(F.abs(F.col("_ca") - F.col("_ra")) > 1e-6, "auxiliary tasks differ").otherwise("same production and auxiliary tasks"))
    return cur.join(rec, "plan_id").select("plan_id", (reason == "same production and auxiliary tasks").alias("comparable"),
                                           reason.alias("comparability_reason"))


def validate_schedules(heats: DataFrame, aux: DataFrame, constraints: DataFrame, templates: DataFrame, windows: DataFrame,
                       maintenance: DataFrame, aux_tasks: DataFrame, powers: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Violations (plan_id, item, violation) of every hard rule; an empty result is a valid set of plans.

    constraints: plan_id, machine_id, n_slots, n_heats, cold_slots, reheat_slots, first_cold, peak_cap_kw.
    Heats follow the templates of their places; where their number is not the required one,
    all of them follow the plan's default template (``defaults``, else its first).
    """
    w = Window.partitionBy("plan_id").orderBy("start_slot", "heat_no")
    h = (heats.join(constraints.drop("machine_id").withColumnRenamed("reheat_slots", "_extra"), "plan_id")
         .withColumns({"pos": F.row_number().over(w) - 1, "_end": end_slot(), "_prev": F.lag(end_slot()).over(w),
                       "_count": F.count("*").over(Window.partitionBy("plan_id"))}))
    defaults = templates.where("heat_no = 0") if defaults is None else defaults
    t = templates.unionByName(defaults.withColumn("heat_no", F.lit(-1).cast(templates.schema["heat_no"].dataType)), allowMissingColumns=True)
    t = t.select("plan_id", F.col("heat_no").alias("_template"), F.col("heating_slots").alias("t_heat"), F.col("melting_slots").alias("t_melt"),
                 "min_hold_slots", "max_hold_slots")
    h = h.withColumn("_template", F.when(F.col("_count") == F.col("n_heats"), F.col("pos")).otherwise(-1))
    h = h.join(t, ["plan_id", "_template"], "left")
    gap = F.col("start_slot") - F.coalesce("_prev", F.lit(0))
    cold = (gap > F.col("cold_slots")) & (F.col("_prev").isNotNull() | F.col("first_cold"))
    want = F.when(cold, F.col("_extra")).otherwise(0)
    item = F.concat(F.lit("heat "), F.col("pos").cast("string"))
    checks = F.array_compact(F.array(
        F.when((F.col("start_slot") < 0) | (F.col("_end") > F.col("n_slots")), "outside horizon"),
        F.when(F.col("melting_slots") != F.col("t_melt"), "melting differs from template"),
        F.when(~F.col("holding_slots").between(F.col("min_hold_slots"), F.col("max_hold_slots")), "holding out of bounds"),
        F.when(F.col("reheat_slots") != want, "reheat differs"),
        F.when(F.col("heating_slots") != F.col("t_heat") + want, "heating differs"),
        F.when(F.col("start_slot") < F.col("_prev"), "overlaps previous heat")))
    per_heat = h.select("plan_id", item.alias("item"), F.explode(checks).alias("violation"))
    inside = h.join(windows, "plan_id").where((F.col("ws") <= F.col("start_slot")) & (F.col("_end") <= F.col("we"))).select("plan_id", "pos").distinct()
    outside = h.join(inside, ["plan_id", "pos"], "left_anti").select("plan_id", item.alias("item"), F.lit("not inside one operating window").alias("violation"))
    during = h.join(maintenance, "plan_id").where((F.col("start_slot") < F.col("me")) & (F.col("ms") < F.col("_end"))).select(
        "plan_id", item.alias("item"), F.lit("overlaps maintenance").alias("violation"))
    counts = constraints.join(heats.groupBy("plan_id").agg(F.count("*").alias("_n")), "plan_id", "left")
    count = counts.where(F.coalesce("_n", F.lit(0)) != F.col("n_heats")).select("plan_id", F.lit("plan").alias("item"), F.lit("heat count differs").alias("violation"))
    a = aux.withColumn("_aend", F.col("start_slot") + F.col("duration_slots"))
    label = F.concat(F.lit("aux "), F.col("name")).alias("item")
    known = a.join(aux_tasks.select("plan_id", "name", F.col("duration_slots").alias("t_dur"), "window_start_slot", "window_end_slot"), ["plan_id", "name"], "left")
    aux_checks = F.when(F.col("t_dur").isNull(), F.array(F.lit("not in constraints"))).otherwise(F.array_compact(F.array(
        F.when(F.col("duration_slots") != F.col("t_dur"), "duration differs"),
        F.when(~((F.col("window_start_slot") <= F.col("start_slot")) & (F.col("_aend") <= F.col("window_end_slot"))), "outside its window"))))
    per_aux = known.select("plan_id", label, F.explode(aux_checks).alias("violation"))
    aux_during = known.where(F.col("t_dur").isNotNull()).join(maintenance, "plan_id").where(
        (F.col("start_slot") < F.col("me")) & (F.col("ms") < F.col("_aend"))).select("plan_id", label, F.lit("overlaps maintenance").alias("violation"))
    pw = powers.select("machine_id", F.col("machine_state").alias("state"), F.col("median_kw").alias("kw"))
    busy = (_heat_slot_rows(heats).join(constraints.select("plan_id", "machine_id", "n_slots", "peak_cap_kw"), "plan_id").join(pw, ["machine_id", "state"], "left")
            .groupBy("plan_id", "slot").agg(F.max(F.coalesce("kw", F.lit(0.0))).alias("kw")))
    extra = a.withColumn("slot", F.explode(F.sequence("start_slot", F.col("_aend") - 1))).groupBy("plan_id", "slot").agg(F.sum("power_kw").alias("akw"))
    total = busy.join(extra, ["plan_id", "slot"], "full").join(constraints.select("plan_id", "n_slots", "peak_cap_kw"), "plan_id")
    load = F.coalesce("kw", F.lit(0.0)) + F.coalesce("akw", F.lit(0.0))
    peak = (total.where((load > F.col("peak_cap_kw") + 1e-9) & (F.col("slot") >= 0) & (F.col("slot") < F.col("n_slots")))
            .select("plan_id").distinct().select("plan_id", F.lit("plan").alias("item"), F.lit("peak cap exceeded").alias("violation")))
    unknown = constraints.where("peak_cap_kw IS NOT NULL").join(powers.select("machine_id").distinct(), "machine_id", "left_anti").select(
        "plan_id", F.lit("plan").alias("item"), F.lit("peak cap set but no state powers").alias("violation"))
    out = per_heat
    for part in (outside, during, count, per_aux, aux_during, peak, unknown):
        out = out.unionByName(part)
    return out


def infeasible_groups(constraints: DataFrame, templates: DataFrame, windows: DataFrame, maintenance: DataFrame, aux_tasks: DataFrame,
                      powers: DataFrame) -> DataFrame:
    """Necessary conditions that fail per plan, in a fixed order (empty when none does)."""
    least = F.col("heating_slots") + F.col("melting_slots") + F.col("min_hold_slots")
    t = templates.groupBy("plan_id").agg(F.sum(least).alias("total_min"), F.max(least).alias("max_min"))
    width = F.greatest(F.lit(0), F.col("we") - F.col("ws"))
    o = windows.groupBy("plan_id").agg(F.sum(width).alias("operating"), F.max(F.col("we") - F.col("ws")).alias("longest"))
    cut = F.greatest(F.lit(0), F.least("me", "we") - F.greatest("ms", "ws"))
    b = windows.join(maintenance, "plan_id").groupBy("plan_id").agg(F.sum(cut).alias("blocked"))
    top = powers.where(F.col("machine_state").isin("heating", "melting", "holding")).groupBy("machine_id").agg(F.max("median_kw").alias("top_kw"))
    tight = aux_tasks.where(F.col("window_end_slot") - F.col("window_start_slot") < F.col("duration_slots")).groupBy("plan_id").agg(F.count("*").alias("tight"))
    df = constraints
    for part in (t, o, b, tight):
        df = df.join(part, "plan_id", "left")
    df = df.join(top, "machine_id", "left")
    need = F.coalesce("total_min", F.lit(0))
    groups = F.array_compact(F.array(
        F.when(need > F.col("operating"), "operating-hours: total"),
        F.when(F.col("max_min") > F.col("longest"), "operating-hours: longest window"),
        F.when(need > F.col("operating") - F.coalesce("blocked", F.lit(0)), "maintenance"),
        F.when(F.col("peak_cap_kw") < F.col("top_kw"), "peak-cap"), F.when(F.col("tight") > 0, "aux-window")))
    return df.select("plan_id", groups.alias("groups"))


def _shift_one(slot_price: np.ndarray, idle: float, heats: pd.DataFrame, prices: dict, allowed: np.ndarray, cold: int, extra: int,
               first_cold: bool) -> list[tuple]:
    """Exact placement of one plan's heats in order, by dynamic programming over end slots."""
    n = len(slot_price)
    run = {p: np.concatenate([[0.0], np.cumsum((kwh - idle) * slot_price)]) for p, kwh in prices.items() if p != "melt_kg"}
    flat = np.concatenate([[0.0], np.cumsum(slot_price)])
    blocked = np.concatenate([[0], np.cumsum(~allowed[:n])])
    best, back = np.full(n + 1, np.inf), []
    for i, h in enumerate(heats.itertuples(index=False)):
        nxt, came = np.full(n + 1, np.inf), {}
        melt = prices["melt_kg"] * h.charge_kg / max(h.melting_slots, 1)
        for s in range(n):
            if i == 0:
                is_cold = first_cold and s > cold
                options = [(0.0, -1, extra if is_cold else 0)]
            else:
                lo = max(0, s - cold)
                near, far = best[lo:s + 1], best[:lo]
                options = [(near.min(), lo + int(near.argmin()), 0)] if near.size else []
                if far.size:
                    options.append((far.min(), int(far.argmin()), extra))
            for cost, prev, reheat in options:
                if not np.isfinite(cost):
                    continue
                m0 = s + h.heating_slots + reheat
                m1 = m0 + h.melting_slots
                for hold in range(h.min_hold_slots, h.max_hold_slots + 1):
                    e = m1 + hold
                    if e > n or blocked[e] != blocked[s]:
                        continue
                    total = (cost + run["heating"][m0] - run["heating"][s] + (melt - idle) * (flat[m1] - flat[m0])
                             + run["holding"][e] - run["holding"][m1])
                    if total < nxt[e] - 1e-12:
                        nxt[e] = total
                        came[e] = (prev, s, reheat, hold)
        best = nxt
        back.append(came)
    if not len(heats) or not np.isfinite(best).any():
        return []
    e, rows = int(best.argmin()), []
    for i in range(len(heats) - 1, -1, -1):
        prev, s, reheat, hold = back[i][e]
        rows.append((i, s, reheat, hold))
        e = prev
    return rows[::-1]


def shift_plan(templates: DataFrame, model: DataFrame, tariff: DataFrame, *, site_id: str, n_slots: int = N_SLOTS, slot_min: int = C.OPT_SLOT_MIN,
               cold_slots: int = COLD_SLOTS, reheat_slots: int = REHEAT_SLOTS, first_cold: bool = False, w_energy: float = C.OPT_W_ENERGY_KWH,
               w_cost: float = C.OPT_W_COST_INR, operating: tuple[int, int] = (0, N_SLOTS), maintenance: tuple[int, int] | None = None) -> DataFrame:
    """Cheapest start and holding of every plan's heats, order kept.

    Plans are independent: one group per plan, a handful of heats and 96 slots each.
    """
    slot_h = slot_min / 60.0
    c = lambda f: F.col("coefficients")[f]
    m = model.select("machine_id", c("good_production_kg").alias("b_prod"), c("hours_heating").alias("b_heat"), c("hours_holding").alias("b_hold"),
                     c("hours_idle").alias("b_idle"))
    rates = tariff_minutes(tariff.where(F.col("site_id") == site_id)).where(F.col("minute") % slot_min == 0)
    day = rates.agg(F.transform(F.array_sort(F.collect_list(F.struct("minute", "rate"))), lambda r: r["rate"]).alias("rates"))  # 96 numbers
    rows = templates.join(m, "machine_id").crossJoin(F.broadcast(day))
    allowed = np.zeros(n_slots, dtype=bool)
    allowed[operating[0]:operating[1]] = True
    if maintenance is not None:
        allowed[maintenance[0]:maintenance[1]] = False

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("heat_no").reset_index(drop=True)
        f = pdf.iloc[0]
        price = w_energy + w_cost * np.resize(np.asarray(f.rates, dtype=float), n_slots)  # the day repeats
        kwh = {"heating": f.b_heat * slot_h, "holding": f.b_hold * slot_h, "melt_kg": f.b_prod}
        placed = _shift_one(price, f.b_idle * slot_h, pdf, kwh, allowed, cold_slots, reheat_slots, first_cold)
        out = [(f.plan_id, f.machine_id, f.day, i, s, int(pdf.heating_slots[i]) + r, int(pdf.melting_slots[i]), hold, float(pdf.charge_kg[i]), r)
               for i, s, r, hold in placed]
        return pd.DataFrame(out, columns=["plan_id", "machine_id", "day", "heat_no", "start_slot", "heating_slots", "melting_slots",
                                          "holding_slots", "charge_kg", "reheat_slots"])
    return rows.groupBy("plan_id").applyInPandas(
        solve, "plan_id string, machine_id string, day date, heat_no int, start_slot int, heating_slots int, melting_slots int, "
               "holding_slots int, charge_kg double, reheat_slots int")


def shift_status(plans: DataFrame, wanted: DataFrame, shifted: DataFrame) -> DataFrame:
    """One row per plan: SHIFTED, EMPTY (it has no heat), or INFEASIBLE where its heats could not all be placed."""
    want = wanted.groupBy("plan_id").agg(F.count("*").alias("n_heats"))
    got = shifted.groupBy("plan_id").agg(F.count("*").alias("n_placed"))
    df = plans.select("plan_id").join(want, "plan_id", "left").join(got, "plan_id", "left").na.fill(0, ["n_heats", "n_placed"])
    status = F.when(F.col("n_placed") < F.col("n_heats"), "INFEASIBLE").when(F.col("n_heats") == 0, "EMPTY").otherwise("SHIFTED")
    return df.select("plan_id", status.alias("status"), "n_heats", "n_placed")


def plan_inputs_hash(constraints: DataFrame) -> DataFrame:
    """Stable hash of a plan's inputs (columns in name order)."""
    cols = sorted(c for c in constraints.columns if c != "plan_id")
    return constraints.select("plan_id", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("inputs_hash"))


def plan_timeline(heats: DataFrame, aux: DataFrame, slot_min: int = C.OPT_SLOT_MIN) -> DataFrame:
    """Phase rows with start and finish minutes of the horizon; empty phases are left out."""
    h, m, o, s = F.col("heating_slots"), F.col("melting_slots"), F.col("holding_slots"), F.col("start_slot")
    phase = lambda name, at, n: F.struct(F.lit(name).alias("phase"), at.cast("int").alias("at"), n.cast("int").alias("n"))
    rows = heats.select("plan_id", "heat_no", F.explode(F.array(phase("heating", s, h), phase("melting", s + h, m), phase("holding", s + h + m, o))).alias("p"))
    task = F.concat(F.lit("Heat "), (F.col("heat_no") + 1).cast("string"), F.lit(" "), F.col("p.phase"))
    out = rows.where(F.col("p.n") > 0).select("plan_id", task.alias("task"), (F.col("p.at") * slot_min).alias("start_min"),
                                              ((F.col("p.at") + F.col("p.n")) * slot_min).alias("finish_min"))
    a = aux.select("plan_id", F.concat(F.lit("aux "), F.col("name")).alias("task"), (F.col("start_slot") * slot_min).alias("start_min"),
                   ((F.col("start_slot") + F.col("duration_slots")) * slot_min).alias("finish_min"))
    return out.unionByName(a)


def board_cost(heats: DataFrame, machines: DataFrame, tariff: DataFrame, *, site_id: str, slot_min: int = C.OPT_SLOT_MIN) -> DataFrame:
    """Quick estimate by state fraction of rated power; share of kWh in the dearest period."""
    total = heats.withColumn("heating_slots", F.col("heating_slots") + F.col("reheat_slots"))  # the board counts reheat on top
    rows = _heat_slot_rows(total).join(heats.select("plan_id", "machine_id").distinct(), "plan_id").join(
        machines.select("machine_id", "rated_power_kw"), "machine_id")
    frac = F.when(F.col("state") == "heating", C.STATE_POWER_FRACTION["heating"]).when(
        F.col("state") == "melting", C.STATE_POWER_FRACTION["melting"]).otherwise(C.STATE_POWER_FRACTION["holding"])
    t = tariff.where(F.col("site_id") == site_id)
    rates = tariff_minutes(t).select("minute", "rate")
    dear = t.agg(F.max("energy_inr_per_kwh").alias("dear"))
    kwh = F.col("rated_power_kw") * frac * slot_min / 60.0
    rows = rows.withColumns({"kwh": kwh, "minute": (F.col("slot") * slot_min) % 1440}).join(rates, "minute", "left").crossJoin(dear)
    agg = rows.groupBy("plan_id").agg(F.sum("kwh").alias("kwh"), F.sum(F.col("kwh") * F.coalesce("rate", F.lit(0.0))).alias("inr"),
                                      F.sum(F.when(F.col("rate") == F.col("dear"), F.col("kwh")).otherwise(0.0)).alias("_dear"))
    return agg.select("plan_id", "kwh", "inr", F.when(F.col("kwh") > 0, F.col("_dear") / F.col("kwh") * 100.0).otherwise(0.0).alias("dear_pct"))


def what_if_heats(heats: DataFrame, machines: DataFrame, tariff: DataFrame, *, site_id: str, tap_c: float = 1600.0) -> DataFrame:
    """One heat priced minute by minute, kept hot or left cold in the gap before it.

    heats: plan_id, heat_no, machine_id, charge_kg, start_min, hold_min, gap_min.
    """
    f = C.STATE_POWER_FRACTION
    both = heats.withColumn("hot", F.explode(F.array(F.lit(True), F.lit(False))))
    cold_min = F.when(F.col("hot"), 0).otherwise(F.col("gap_min"))
    phase = lambda i, mins, fr: F.struct(F.lit(i).alias("i"), mins.cast("double").alias("mins"), fr.cast("double").alias("fr"))
    phases = F.array(phase(0, F.lit(20.0) + 0.15 * cold_min, F.lit(f["heating"])),
                     phase(1, F.col("charge_kg") / C.OPT_MELT_RATE_KG_H * 60.0, F.lit(f["melting"])),
                     phase(2, F.col("hold_min"), F.lit(f["holding"])),
                     phase(3, F.col("gap_min"), F.when(F.col("hot"), f["holding"]).otherwise(f["idle"])))
    key = ["plan_id", "heat_no", "hot"]
    rows = both.join(machines.select("machine_id", "rated_power_kw"), "machine_id").select(*key, "charge_kg", "start_min", "rated_power_kw", F.posexplode(phases).alias("_p", "p"))
    before = F.coalesce(F.sum("p.mins").over(Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_t", F.col("start_min") + before).where(F.col("p.mins") > 0)
    rows = rows.withColumn("_m", F.explode(F.sequence(F.lit(0), (F.ceil("p.mins") - 1).cast("int"))))
    minute = (F.floor(F.col("_t") + F.col("_m")) % 1440).cast("int")
    rates = tariff_minutes(tariff.where(F.col("site_id") == site_id)).select("minute", "rate")
    kwh = F.col("rated_power_kw") * F.col("p.fr") / 60.0
    rows = rows.withColumns({"minute": minute, "kwh": kwh}).join(rates, "minute", "left")
    agg = rows.groupBy(*key, "charge_kg").agg(F.sum("kwh").alias("_kwh"), F.sum(F.col("kwh") * F.coalesce("rate", F.lit(0.0))).alias("inr"))
    tonnes = F.col("charge_kg") / 1000.0
    superheat = F.greatest(F.lit(0.0), F.lit(tap_c - C.HEAT_TARGET_C)) * C.SUPERHEAT_KWH_PER_T_PER_C * tonnes
    return agg.select(*key, (F.col("_kwh") + superheat).alias("kwh"), "inr", ((F.col("_kwh") + superheat) / tonnes).alias("sec_kwh_per_t"))


def required_heats(required_kg: Column, reconstructed: Column, charge_kg: float = C.OPT_HEAT_CHARGE_KG) -> Column:
    """Heats for a required output, else as many as were reconstructed."""
    return F.when(required_kg.isNull(), reconstructed).otherwise(F.greatest(F.lit(0), F.ceil(required_kg / charge_kg - 1e-9)))
