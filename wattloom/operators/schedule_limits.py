"""Shifting plans within limits of their own: operating windows, maintenance, auxiliary tasks and a peak cap.

A plan's heats keep their order; each lies in one operating window, clear of maintenance, and
its holding stays in its bounds. Auxiliary tasks lie in their windows, clear of maintenance.
Load (state power plus auxiliary power) never exceeds the plan's cap.

The cheapest placement is found by a min-plus dynamic programme: for each end slot the cheapest
way to place the heats so far. A heat that starts soon after the one before it comes from the
minimum over the last ``cold_slots`` ends, a later one from the prefix minimum before those, with
extra heating. The peak enters as a label: where the cap can bind, every choice of auxiliary
starts is a row of its own and blocks what it leaves no room for; where it cannot, each task
takes its cheapest start, as nothing else depends on it (this dominates all other labels).
Rows are (plan, label); a day of slots is an array, so a round is array work inside the JVM
and no round shuffles. Costs are whole millionths, so equal costs are equal: ties go to the
earliest auxiliary starts, then to the earliest heats.

Limits: labels of one plan are at most (slots)^(auxiliary tasks), and only where the cap binds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.operators import schedule as K

UNIT = 1_000_000
_PATH = "array<struct<s:int,r:int,hold:int>>"
_BEST = f"struct<cost:bigint,path:{_PATH}>"


def _prefix(values: Column) -> Column:
    """Sums of the first 0, 1, ... values."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _at(values: Column, k: Column) -> Column:
    return F.get(values, k.cast("int"))


def heats_wanted(constraints: DataFrame, templates: DataFrame) -> DataFrame:
    """(plan_id, heats): the templates in order if they are as many as required, else the first one as often as required."""
    t = templates.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("heat_no", "charge_kg", "heating_slots", "melting_slots", "min_hold_slots", "max_hold_slots"))).alias("_t"))
    have = F.coalesce(F.size("_t"), F.lit(0))
    first = F.transform(F.sequence(F.lit(1), F.greatest("n_heats", F.lit(1))), lambda k: F.get("_t", F.lit(0)))
    none = F.array().cast("array<struct<heat_no:int,charge_kg:double,heating_slots:int,melting_slots:int,min_hold_slots:int,max_hold_slots:int>>")
    wanted = F.when(F.col("n_heats") <= 0, none).when(have == F.col("n_heats"), F.col("_t")).when(have > 0, first)
    return constraints.join(t, "plan_id", "left").select("plan_id", wanted.alias("heats"))


def wanted_templates(constraints: DataFrame, templates: DataFrame) -> DataFrame:
    """The templates that ``heats_wanted`` follows, one row a heat, as ``schedule.validate_schedules`` takes them."""
    return heats_wanted(constraints, templates).select("plan_id", F.posexplode("heats").alias("heat_no", "h")).select(
        "plan_id", "heat_no", "h.charge_kg", "h.heating_slots", "h.melting_slots", "h.min_hold_slots", "h.max_hold_slots")


def latest_ends(constraints: DataFrame, windows: DataFrame, maintenance: DataFrame) -> DataFrame:
    """(plan_id, until): for each start slot the latest end of a job in one operating window and clear of maintenance."""
    w = windows.groupBy("plan_id").agg(F.collect_list(F.struct("ws", "we")).alias("_w"))
    m = maintenance.groupBy("plan_id").agg(F.collect_list(F.struct("ms", "me")).alias("_m"))
    df = constraints.select("plan_id", "n_slots").join(w, "plan_id", "left").join(m, "plan_id", "left")

    def until(s: Column) -> Column:
        opens = F.array_max(F.transform(F.filter("_w", lambda x: (x["ws"] <= s) & (s < x["we"])), lambda x: x["we"]))
        stop = F.coalesce(F.array_min(F.transform(F.filter("_m", lambda x: (x["me"] > s) & (x["me"] > x["ms"])), lambda x: x["ms"])), F.col("n_slots"))
        return F.greatest(s, F.least(F.coalesce(opens, s), stop, F.col("n_slots")))
    return df.select("plan_id", F.transform(F.sequence(F.lit(0), F.col("n_slots")), until).alias("until"))


def prepared(templates: DataFrame, constraints: DataFrame, windows: DataFrame, maintenance: DataFrame, aux_tasks: DataFrame, powers: DataFrame, model: DataFrame,
             tariff: DataFrame, *, site_id: str, slot_min: int, w_energy: float, w_cost: float) -> DataFrame:
    """One row a plan: prices, latest ends, wanted heats, state powers and each auxiliary task's possible starts with their costs."""
    slot_h = slot_min / 60.0
    c = lambda f: F.col("coefficients")[f]
    m = model.select("machine_id", c("good_production_kg").alias("b_prod"), c("hours_heating").alias("b_heat"), c("hours_holding").alias("b_hold"), c("hours_idle").alias("b_idle"))
    kw = lambda s: F.max(F.when(F.col("machine_state") == s, F.col("median_kw")))
    pw = powers.groupBy("machine_id").agg(F.coalesce(kw("heating"), F.lit(0.0)).alias("kw_h"), F.coalesce(kw("melting"), F.lit(0.0)).alias("kw_m"), F.coalesce(kw("holding"), F.lit(0.0)).alias("kw_o"))
    rates = K.tariff_minutes(tariff.where(F.col("site_id") == site_id)).where(F.col("minute") % slot_min == 0)
    day = rates.agg(F.transform(F.array_sort(F.collect_list(F.struct("minute", "rate"))), lambda r: r["rate"]).alias("_rates"))  # a day's slots
    tasks = aux_tasks.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("name", "duration_slots", "window_start_slot", "window_end_slot", "power_kw"))).alias("_tasks"))
    free = maintenance.groupBy("plan_id").agg(F.collect_list(F.struct("ms", "me")).alias("_down"))
    df = (constraints.join(m, "machine_id").join(pw, "machine_id", "left").join(heats_wanted(constraints, templates), "plan_id")
          .join(latest_ends(constraints, windows, maintenance), "plan_id").join(tasks, "plan_id", "left").join(free, "plan_id", "left").crossJoin(day))
    price = F.transform(F.sequence(F.lit(0), F.col("n_slots") - 1), lambda t: w_energy + w_cost * F.get("_rates", t % F.greatest(F.size("_rates"), F.lit(1))))
    df = df.withColumn("price", price).withColumn("_tasks", F.coalesce("_tasks", F.array().cast("array<struct<name:string,duration_slots:int,window_start_slot:int,window_end_slot:int,power_kw:double>>")))
    units = lambda kwh: F.transform("price", lambda x: F.round(x * kwh * UNIT).cast("long"))
    df = df.withColumns({"H": _prefix(units((F.col("b_heat") - F.col("b_idle")) * slot_h)), "O": _prefix(units((F.col("b_hold") - F.col("b_idle")) * slot_h))})
    # A melting slot's energy depends on the heat.
    melts = F.transform("heats", lambda h: _prefix(F.transform("price", lambda x: F.round(x * (F.col("b_prod") * h["charge_kg"] / F.greatest(h["melting_slots"], F.lit(1)) - F.col("b_idle") * slot_h) * UNIT).cast("long"))))

    def starts(t: Column) -> Column:
        first, last = F.greatest(t["window_start_slot"], F.lit(0)), F.least(t["window_end_slot"], F.col("n_slots")) - t["duration_slots"]
        every = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        clear = F.filter(every, lambda s: ~F.coalesce(F.exists("_down", lambda d: (s < d["me"]) & (d["ms"] < s + t["duration_slots"])), F.lit(False)))
        cost = lambda s: F.aggregate(F.slice("price", s + 1, t["duration_slots"]), F.lit(0).cast("long"), lambda a, x: a + F.round(x * t["power_kw"] * slot_h * UNIT).cast("long"))
        return F.transform(clear, lambda s: F.struct(cost(s).alias("cost"), s.cast("int").alias("s")))
    df = df.withColumn("melts", melts).withColumn("starts", F.transform("_tasks", starts))
    total = F.aggregate("_tasks", F.lit(0.0), lambda a, t: a + t["power_kw"])
    binds = F.coalesce(F.greatest("kw_h", "kw_m", "kw_o", F.lit(0.0)) + total > F.col("peak_cap_kw") + 1e-9, F.lit(False))
    return df.withColumn("binds", binds)


def labels(plans: DataFrame) -> DataFrame:
    """A row for each choice of auxiliary starts that counts: ``aux`` (starts), ``aux_cost``, ``load`` (kW a slot). A plan with a task that has no start keeps none."""
    cheapest = F.transform("starts", lambda xs: F.when(F.size(xs) > 0, F.array(F.array_min(xs))).otherwise(xs))
    kept = F.when(F.col("binds"), F.col("starts")).otherwise(cheapest)
    empty = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.array().cast("array<int>").alias("aux")))
    choices = F.aggregate(kept, empty, lambda acc, xs: F.flatten(F.transform(acc, lambda a: F.transform(xs, lambda x: F.struct((a["cost"] + x["cost"]).alias("cost"), F.concat(a["aux"], F.array(x["s"])).alias("aux"))))))
    df = plans.withColumn("_c", F.explode(choices)).withColumns({"aux": F.col("_c.aux"), "aux_cost": F.col("_c.cost")}).drop("_c")
    placed = F.zip_with("_tasks", "aux", lambda t, s: F.struct(s.alias("s"), (s + t["duration_slots"]).alias("e"), t["power_kw"].alias("kw")))
    load = lambda t: F.aggregate("_placed", F.lit(0.0), lambda a, x: a + F.when((x["s"] <= t) & (t < x["e"]), x["kw"]).otherwise(0.0))
    df = df.withColumn("_placed", placed).withColumn("load", F.transform(F.sequence(F.lit(0), F.col("n_slots") - 1), load)).drop("_placed")
    return df.where(F.col("peak_cap_kw").isNull() | (F.array_max("load") <= F.col("peak_cap_kw") + 1e-9))


def _placed(df: DataFrame) -> DataFrame:
    """Adds ``best``: the cheapest (cost, path) of all heats, null if they cannot be placed."""
    over = lambda kw: _prefix(F.transform("load", lambda x: F.when(F.col(kw) + x > F.col("peak_cap_kw") + 1e-9, 1).otherwise(0).cast("long")))
    df = df.withColumns({"vh": over("kw_h"), "vm": over("kw_m"), "vo": over("kw_o")})
    slots = F.sequence(F.lit(0), F.col("n_slots"))
    nothing = F.lit(None).cast(_BEST)
    fresh = F.struct(F.lit(0).cast("long").alias("cost"), F.array().cast(_PATH).alias("path"))
    # Before the first heat: it comes from anywhere without extra heating, or, where it starts cold, from slot 0.
    start = F.transform(slots, lambda e: F.when((e == 0) | ~F.col("first_cold"), fresh).otherwise(nothing))
    least = lambda xs: F.array_min(F.filter(xs, lambda x: x.isNotNull()))
    heats = F.transform("heats", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    flat = lambda a, lo, hi: _at(F.col(a), hi) - _at(F.col(a), lo)

    def place(acc: Column, x: Column) -> Column:
        h, i = x["h"], x["i"]
        cold = F.col("cold_slots")
        melts = _at(F.col("melts"), i)
        near = F.transform(slots, lambda s: F.when((i == 0) & ~F.col("first_cold"), fresh).otherwise(least(F.slice(acc, F.greatest(s - cold, F.lit(0)) + 1, F.least(cold, s) + 1))))
        far = F.transform(slots, lambda s: F.when((s > cold) & ((i > 0) | F.col("first_cold")), least(F.slice(acc, F.lit(1), F.greatest(s - cold, F.lit(0))))))

        def ending(e: Column, prefix: Column, before: Column, extra: Column) -> Column:
            def option(hold: Column) -> Column:
                m1 = e - hold
                m0 = m1 - h["melting_slots"]
                s = m0 - h["heating_slots"] - extra
                free = (s >= 0) & (e <= _at(F.col("until"), s)) & (flat("vh", s, m0) == 0) & (flat("vm", m0, m1) == 0) & (flat("vo", m1, e) == 0)
                cost = flat("H", s, m0) + _at(prefix, m1) - _at(prefix, m0) + flat("O", m1, e)
                step = F.struct(s.cast("int").alias("s"), extra.cast("int").alias("r"), hold.cast("int").alias("hold"))
                return F.when(free, _let(_at(before, s), lambda prev: F.when(
                    prev.isNotNull(), F.struct((prev["cost"] + cost).alias("cost"), F.concat(prev["path"], F.array(step)).alias("path")))))
            return F.transform(F.sequence(h["min_hold_slots"], h["max_hold_slots"]), option)
        ways = F.struct(near.alias("near"), far.alias("far"), melts.alias("melts"))
        return _let(ways, lambda w: F.transform(slots, lambda e: least(F.concat(
            ending(e, w["melts"], w["near"], F.lit(0)), ending(e, w["melts"], w["far"], F.col("reheat_slots"))))))
    done = F.aggregate(heats, start.cast(f"array<{_BEST}>"), lambda acc, x: place(acc, x).cast(f"array<{_BEST}>"))
    return df.withColumn("best", F.when(F.size("heats") == 0, fresh).otherwise(least(done)))


def shift_within_limits(templates: DataFrame, constraints: DataFrame, windows: DataFrame, maintenance: DataFrame, aux_tasks: DataFrame, powers: DataFrame, model: DataFrame,
                        tariff: DataFrame, *, site_id: str, slot_min: int = C.OPT_SLOT_MIN, w_energy: float = C.OPT_W_ENERGY_KWH, w_cost: float = C.OPT_W_COST_INR,
                        stage: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """One row a plan: status, groups (what makes it infeasible), objective (above an idle day, auxiliary tasks included), heats, aux.

    constraints: plan_id, machine_id, n_slots, n_heats, cold_slots, reheat_slots, first_cold, peak_cap_kw; windows: plan_id, ws, we; maintenance: plan_id, ms, me;
    aux_tasks: plan_id, name, duration_slots, window_start_slot, window_end_slot, power_kw. Plans of machines without a model are left out.
    A cap without any known state power, wanted heats without a template, or slots without a price make a plan infeasible. ``stage`` may write the three intermediate tables (name, rows) and read them back.
    """
    plans = stage("plan_limits", prepared(templates, constraints, windows, maintenance, aux_tasks, powers, model, tariff, site_id=site_id, slot_min=slot_min, w_energy=w_energy, w_cost=w_cost))
    known = F.col("heats").isNotNull() & (F.col("peak_cap_kw").isNull() | F.col("kw_h").isNotNull())
    # The exchange spreads a plan's labels, and keeps arrays made before it from being made anew for each slot.
    spread = stage("plan_labels", labels(plans.where(known)).repartition("plan_id", "aux"))
    found = stage("plan_placements", _placed(spread).select("plan_id", "aux", "aux_cost", "_tasks", "heats", "best")).where("best IS NOT NULL")
    pick = F.min(F.struct((F.col("best.cost") + F.col("aux_cost")).alias("cost"), "aux", F.col("best.path").alias("path"), "_tasks", F.col("heats").alias("wanted")))
    found = found.groupBy("plan_id").agg(pick.alias("p"))
    heats = F.zip_with("p.wanted", "p.path", lambda h, s: F.struct(s["s"].alias("start_slot"), (h["heating_slots"] + s["r"]).alias("heating_slots"), h["melting_slots"].alias("melting_slots"),
                                                                   s["hold"].alias("holding_slots"), h["charge_kg"].alias("charge_kg"), s["r"].alias("reheat_slots")))
    tasks = F.zip_with("p._tasks", "p.aux", lambda t, s: F.struct(t["name"].alias("name"), s.alias("start_slot"), t["duration_slots"].alias("duration_slots"), t["power_kw"].alias("power_kw")))
    why = K.infeasible_groups(constraints, templates, windows, maintenance, aux_tasks, powers)
    out = plans.select("plan_id", "machine_id", "n_heats").join(found, "plan_id", "left").join(why, "plan_id", "left")
    status = F.when(F.col("p").isNull(), "INFEASIBLE").when(F.col("n_heats") <= 0, "EMPTY").otherwise("SHIFTED")
    groups = F.when(F.col("p").isNull(), F.when(F.size("groups") > 0, F.col("groups")).otherwise(F.array(F.lit("combination of limits"))))
    return out.select("plan_id", "machine_id", status.alias("status"), groups.alias("groups"), (F.col("p.cost") / UNIT).alias("objective"), heats.alias("heats"), tasks.alias("aux"))


def placed_heats(shifted: DataFrame) -> DataFrame:
    """Rows of heats as ``schedule`` takes them, numbered from 0."""
    return shifted.select("plan_id", "machine_id", F.posexplode("heats").alias("heat_no", "h")).select("plan_id", "machine_id", "heat_no", "h.*")


def placed_aux(shifted: DataFrame) -> DataFrame:
    return shifted.select("plan_id", F.explode("aux").alias("a")).select("plan_id", "a.*")
