"""Bill, heats, power factor, carbon and finance from meter slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions import scan
from wattloom.functions.columns import hours_between, local_time, minute_of_day, time_chunk
from wattloom.operators.schedule import tariff_minutes

KEY = ["machine_id"]


def slice_energy(tel: DataFrame, hours: int = 24, chunk_s: int = 3600) -> DataFrame:
    """Last hours per machine: counter difference and hours to the previous reading, first row dropped."""
    newest = tel.groupBy("machine_id").agg(F.max("ts").alias("_newest"))
    rows = tel.join(newest, "machine_id").where(F.col("ts") >= F.col("_newest") - F.expr(f"interval {hours} hours")).drop("_newest")
    rows = scan.previous_row(rows.withColumn("_chunk", time_chunk("ts", chunk_s)), KEY, "_chunk", ["ts"], ["ts", "energy_kwh"], "_prev").drop("_chunk")
    rows = rows.where(F.col("_prev").isNotNull())
    d = F.col("energy_kwh") - F.col("_prev.energy_kwh")
    return rows.withColumns({"dkwh": F.when(d >= 0, d), "dh": hours_between(F.col("_prev.ts"), F.col("ts")), "prev_ts": F.col("_prev.ts")}).drop("_prev")


def with_rate(slices: DataFrame, tariff: DataFrame, site_id: str, tz: str = C.LOCAL_TZ) -> DataFrame:
    rates = tariff_minutes(tariff.where(F.col("site_id") == site_id)).select("minute", "rate")
    return slices.withColumn("minute", minute_of_day(local_time("ts", tz))).join(rates, "minute", "left").drop("minute")


def state_runs_cost(priced: DataFrame) -> DataFrame:
    """Stretches of equal state with energy, money and hours; holding and idle count as waste."""
    rows = priced.where(F.col("dkwh").isNotNull()).withColumns({"_state": F.coalesce("machine_state", F.lit("unknown")), "_chunk": time_chunk("ts")})
    rows = scan.islands(rows, KEY, "_chunk", ["ts"], F.col("_state"), "run_id")
    return rows.groupBy("machine_id", "run_id", F.col("_state").alias("state")).agg(
        F.sum("dkwh").alias("kwh"), F.sum(F.col("dkwh") * F.coalesce("rate", F.lit(0.0))).alias("inr"), F.sum("dh").alias("hours"),
        F.min("prev_ts").alias("start_ts"), F.max("ts").alias("end_ts")).withColumn("is_waste", F.col("state").isin("holding", "idle"))


def avg_rate(tariff: DataFrame) -> DataFrame:
    """Mean energy rate over the 24 hours, per site (an end of 0 means midnight)."""
    end = F.when(F.col("end_min") == 0, 1440).otherwise(F.col("end_min"))
    return tariff.groupBy("site_id").agg((F.sum(F.col("energy_inr_per_kwh") * (end - F.col("start_min")) / 60.0) / 24.0).alias("avg_rate"))


def weighted_rate(priced: DataFrame) -> DataFrame:
    """Mean rate that a machine's energy was priced at, weighted by that energy."""
    known = priced.where(F.col("dkwh").isNotNull() & F.col("rate").isNotNull())
    return known.groupBy("machine_id").agg(F.try_divide(F.sum(F.col("dkwh") * F.col("rate")), F.sum("dkwh")).alias("avg_rate"), F.count("*").alias("n"))


def heat_slices(priced: DataFrame) -> DataFrame:
    """Slices that belong to a heat, with ``heat_id``.

    Heating opens a heat unless the newest state other than holding is heating already;
    holding right after heating does not count; idle closes. Said as ordered scans: the
    newest earlier non-holding state, then a running count of openings.
    """
    state = F.coalesce("machine_state", F.lit("unknown"))
    rows = priced.withColumns({"_state": state, "_chunk": time_chunk("ts")}).withColumn("_nh", F.when(F.col("_state") != "holding", F.struct("ts", "_state")))
    rows = scan.previous_max(rows, KEY, "_chunk", ["ts"], "_nh", "_last")
    last = F.coalesce("_last._state", F.lit(""))
    rows = rows.withColumn("_open", ((F.col("_state") == "heating") & (last != "heating")).cast("long"))
    rows = scan.running_sum(rows, KEY, "_chunk", ["ts"], "_open", "heat_id").where(F.col("heat_id") > 0)
    idle = rows.where("_state = 'idle'").groupBy("machine_id", "heat_id").agg(F.min("ts").alias("closed_at"))
    rows = rows.join(idle, ["machine_id", "heat_id"], "left").where(F.col("closed_at").isNull() | (F.col("ts") < F.col("closed_at")))
    return rows.where(~((F.col("_state") == "holding") & (last == "heating"))).drop("_chunk", "_nh", "_last", "_open")


def heat_sessions(slices: DataFrame) -> DataFrame:
    """One row per closed heat that melted: energy, money, melt slices, hold minutes, peak temperature."""
    st = F.col("_state")
    h = slices.groupBy("machine_id", "heat_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("slices"), F.coalesce(F.sum("dkwh"), F.lit(0.0)).alias("kwh"),
        F.coalesce(F.sum(F.col("dkwh") * F.col("rate")), F.lit(0.0)).alias("inr"), F.count_if(st == "melting").alias("melt_slices"),
        F.coalesce(F.sum(F.when(st == "holding", F.col("dh") * 60.0)), F.lit(0.0)).alias("hold_min"),
        F.max(F.when(st != "heating", F.col("temperature_c"))).alias("peak_c"), F.max("closed_at").alias("closed_at"))
    return h.where((F.col("melt_slices") > 0) & F.col("closed_at").isNotNull()).drop("closed_at")


def allocate_production(slices: DataFrame, heats: DataFrame, production: DataFrame) -> DataFrame:
    """Each record's output shared out by the heats' melting slices in (start, end] of the record.

    Records are cut into hours so slices find them by an equi join.
    """
    melt = slices.where("_state = 'melting'").join(heats.select("machine_id", "heat_id"), ["machine_id", "heat_id"], "left_semi").select(
        "machine_id", "heat_id", "ts", F.date_trunc("hour", F.col("ts") - F.expr("interval 1 microsecond")).alias("_hour"))
    p = production.select("machine_id", "window_start", "window_end", "qty_total_kg", "qty_good_kg", "batch_id")
    hours = F.sequence(F.date_trunc("hour", "window_start"), F.date_trunc("hour", F.col("window_end") - F.expr("interval 1 microsecond")), F.expr("interval 1 hour"))
    p = p.withColumn("_hour", F.explode(hours))
    hit = melt.join(p, ["machine_id", "_hour"]).where((F.col("ts") > F.col("window_start")) & (F.col("ts") <= F.col("window_end")))
    rec = ["machine_id", "window_start", "window_end", "batch_id", "qty_total_kg", "qty_good_kg"]
    n = hit.groupBy(*rec, "heat_id").agg(F.count("*").alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(*rec))
    got = n.withColumn("_s", share).groupBy("machine_id", "heat_id").agg(F.sum(F.col("qty_total_kg") * F.col("_s")).alias("kg"), F.sum(F.col("qty_good_kg") * F.col("_s")).alias("good_kg"))
    df = heats.join(got, ["machine_id", "heat_id"], "left").na.fill(0.0, ["kg", "good_kg"])
    return df.withColumn("tonnes", F.col("kg") / 1000.0).withColumn("sec_kwh_per_t", F.when(F.col("tonnes") > 0, F.col("kwh") / F.col("tonnes")))


def superheat_loss(heats: DataFrame, target_c: float = C.HEAT_TARGET_C, kwh_per_t_per_c: float = C.SUPERHEAT_KWH_PER_T_PER_C) -> DataFrame:
    over = F.greatest(F.lit(0.0), F.coalesce("peak_c", F.lit(target_c)) - target_c)
    return heats.withColumns({"over_c": over, "over_kwh": over * kwh_per_t_per_c * F.col("tonnes")})


def heat_benchmark(heats: DataFrame) -> DataFrame:
    """Best, upper-median and worst SEC per machine, and the energy above the best heat."""
    w = Window.partitionBy("machine_id")
    df = heats.withColumn("_r", F.when(F.col("sec_kwh_per_t").isNotNull(), F.row_number().over(w.orderBy(F.col("sec_kwh_per_t").asc_nulls_last()))))
    df = df.withColumns({"_n": F.count("sec_kwh_per_t").over(w), "_best": F.min("sec_kwh_per_t").over(w)})
    gap = F.greatest(F.lit(0.0), F.col("sec_kwh_per_t") - F.col("_best")) * F.col("tonnes")
    return df.groupBy("machine_id").agg(
        F.count("*").alias("n_heats"), F.min("sec_kwh_per_t").alias("best"), F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("sec_kwh_per_t"))).alias("median"),
        F.max("sec_kwh_per_t").alias("worst"), F.coalesce(F.sum(F.when(F.col("sec_kwh_per_t").isNotNull(), gap)), F.lit(0.0)).alias("gap_kwh"))


def _metered(slices: DataFrame) -> DataFrame:
    return slices.where(F.col("dkwh").isNotNull() & F.col("reactive_power_kvar").isNotNull())


def kvah_power_factor(slices: DataFrame) -> DataFrame:
    q = F.col("reactive_power_kvar") * F.col("dh")
    df = _metered(slices).agg(F.sum("dkwh").alias("kwh"), F.sum(F.sqrt(F.col("dkwh") * F.col("dkwh") + q * q)).alias("kvah"))
    return df.withColumns({"power_factor": F.when(F.col("kvah") > 0, F.col("kwh") / F.col("kvah")), "billing_gap_kwh": F.col("kvah") - F.col("kwh")})


def capacitor_need(slices: DataFrame, below: float = 0.9, target: float = 0.95) -> DataFrame:
    """Reactive power to add per machine so that its low-PF readings reach the target."""
    m = _metered(slices).where(F.col("power_factor") < below).groupBy("machine_id").agg(
        F.avg("power_kw").alias("p_kw"), F.avg("reactive_power_kvar").alias("q_kvar"), F.count("*").alias("n"))
    need = F.greatest(F.lit(0.0), F.col("q_kvar") - F.col("p_kw") * F.tan(F.acos(F.lit(target))))
    return m.withColumns({"need_kvar": need, "pf_low": F.try_divide(F.col("p_kw"), F.sqrt(F.col("p_kw") * F.col("p_kw") + F.col("q_kvar") * F.col("q_kvar")))})


def load_type_profile(meter: DataFrame, target: float = 0.95) -> DataFrame:
    """Quarters, mean power, PF and capacitor need per load type."""
    m = meter.groupBy("load_type").agg(F.count("*").alias("n"), (F.avg("kwh") / 0.25).alias("p_kw"), (F.avg("kvarh") / 0.25).alias("q_kvar"))
    m = m.withColumn("pf", F.try_divide(F.col("p_kw"), F.sqrt(F.col("p_kw") * F.col("p_kw") + F.col("q_kvar") * F.col("q_kvar"))))
    need = F.greatest(F.lit(0.0), F.col("p_kw") * (F.tan(F.acos("pf")) - F.tan(F.acos(F.lit(target)))))
    return m.withColumn("need_kvar", F.when((F.col("p_kw") > 0) & (F.col("pf") > 0) & (F.col("pf") < target), need).otherwise(0.0))


def max_demand(slices: DataFrame, buckets: int = 6) -> DataFrame:
    """Highest mean of six consecutive present 5-minute sums of apparent power (site total).

    Readings collapse to 5-minute sums first; the window then sees one row per bucket.
    """
    bucket = F.timestamp_micros(F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(300_000_000)))
    kva = F.sqrt(F.col("power_kw") * F.col("power_kw") + F.col("reactive_power_kvar") * F.col("reactive_power_kvar"))
    per = _metered(slices).groupBy("site_id", bucket.alias("at")).agg(F.sum(kva).alias("kva"))
    w = Window.partitionBy("site_id").orderBy("at")
    run = w.rowsBetween(-(buckets - 1), 0)
    per = per.withColumns({"mean_kva": F.avg("kva").over(run), "_n": F.count("*").over(run)}).where(F.col("_n") == buckets)
    return per.groupBy("site_id").agg(F.max_by(F.struct("mean_kva", "at"), F.struct("mean_kva", -F.unix_micros("at"))).alias("_m")).select(
        "site_id", F.col("_m.mean_kva").alias("max_demand_kva"), F.col("_m.at").alias("ends_at"))


def same_day(slices: DataFrame, production: DataFrame, machine_id: str, hours: int = 24) -> DataFrame:
    """A machine's records that begin in the hours its slices cover (up to its newest reading).

    The published pages take the newest 24 records, which is the same where records are hourly.
    """
    to = slices.where(F.col("machine_id") == machine_id).agg(F.max("ts").alias("_to"))  # one row
    rows = production.where(F.col("machine_id") == machine_id).crossJoin(to)
    return rows.where((F.col("window_start") >= F.col("_to") - F.expr(f"interval {hours} hours")) & (F.col("window_start") < F.col("_to"))).drop("_to")


def scrap_energy(slices: DataFrame, production: DataFrame, machine_id: str) -> DataFrame:
    """Furnace energy of the day that went into that day's rejected output."""
    p = same_day(slices, production, machine_id).agg(
        F.sum("qty_total_kg").alias("total_kg"), F.sum("qty_rejected_kg").alias("rejected_kg"), F.sum("qty_good_kg").alias("good_kg"))
    e = slices.where(F.col("machine_id") == machine_id).agg(F.coalesce(F.sum("dkwh"), F.lit(0.0)).alias("kwh"))
    share = F.when(F.col("total_kg") > 0, F.col("rejected_kg") / F.col("total_kg"))
    return e.crossJoin(p).withColumn("reject_share", share).withColumn("scrap_kwh", F.col("kwh") * F.col("reject_share"))


def carbon_per_tonne(slices: DataFrame, production: DataFrame, factors: DataFrame, machine_id: str) -> DataFrame:
    """Plant electricity of the day x the newest factor over that day's good tonnes."""
    p = same_day(slices, production, machine_id).agg((F.sum("qty_good_kg") / 1000.0).alias("good_t"))
    f = factors.agg(F.max_by(F.struct("factor_id", "value_kg_per_kwh"), "effective_from").alias("_f"))
    e = slices.agg(F.coalesce(F.sum("dkwh"), F.lit(0.0)).alias("electricity_kwh"))
    df = e.crossJoin(p).crossJoin(f).withColumn("tco2", F.col("electricity_kwh") * F.col("_f.value_kg_per_kwh") / 1000.0)
    return df.select("electricity_kwh", "good_t", F.col("_f.factor_id").alias("factor_id"), F.col("_f.value_kg_per_kwh").alias("grid_factor"), "tco2",
                     F.when(F.col("good_t") > 0, F.col("tco2") / F.col("good_t")).alias("tco2_per_t_good"))


def carbon_statement(carbon: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in ("electricity_kwh", "good_t", "grid_factor", "tco2", "tco2_per_t_good")])
    return carbon.select(F.explode(rows).alias("r")).select("r.*")


def direct_emission_value(shipments: DataFrame) -> DataFrame:
    """What measured direct emissions are worth per lot: (default - direct) x price x tonnes."""
    per_t = (F.col("default_t_per_t") - F.col("direct_t_per_t")) * F.col("price_per_t")
    return shipments.withColumns({"value_per_t": per_t, "value": per_t * F.col("tonnes")})


def air_waste(slices: DataFrame, furnace: str, compressor: str) -> DataFrame:
    """Compressor energy in minutes in which the furnace was idle or holding."""
    minute = F.date_trunc("minute", "ts")
    f = slices.where(F.col("machine_id") == furnace).groupBy(minute.alias("_m")).agg(F.max_by(F.struct("machine_state"), "ts").alias("_s"))
    c = slices.where((F.col("machine_id") == compressor) & F.col("dkwh").isNotNull()).withColumn("_m", minute)
    hit = c.join(f.where(F.col("_s.machine_state").isin("idle", "holding")), "_m", "left_semi")
    return hit.agg(F.coalesce(F.sum("dkwh"), F.lit(0.0)).alias("kwh"), F.coalesce(F.sum("dh"), F.lit(0.0)).alias("hours"))


def daily_brief(actions: DataFrame, n: int = 3) -> DataFrame:
    """The largest candidate actions by money; actions without energy are left out."""
    return actions.where(F.col("inr") > 0).orderBy(F.col("inr").desc(), "action").limit(n)


def non_working_light_load(meter: DataFrame) -> DataFrame:
    """Light-load energy at weekends or outside 09:00-18:00, and its share of the total."""
    off = F.dayofweek("dt").isin(1, 7) | (F.hour("dt") < 9) | (F.hour("dt") >= 18)
    df = meter.agg(F.sum(F.when((F.col("load_type") == "Light_Load") & off, F.col("kwh")).otherwise(0.0)).alias("idle_kwh"), F.sum("kwh").alias("total_kwh"))
    return df.withColumn("idle_share_pct", F.when(F.col("total_kwh") > 0, F.col("idle_kwh") / F.col("total_kwh") * 100.0))


def meter_power_factor(meter: DataFrame, rate: float = 7.5) -> DataFrame:
    """Apparent energy per quarter, PF and the cost of billing on kVAh."""
    df = meter.agg(F.sum("kwh").alias("kwh"), F.sum(F.sqrt(F.col("kwh") * F.col("kwh") + F.col("kvarh") * F.col("kvarh"))).alias("kvah"))
    return df.withColumns({"power_factor": F.try_divide("kwh", "kvah"), "gap_kwh": F.col("kvah") - F.col("kwh"), "gap_inr": (F.col("kvah") - F.col("kwh")) * rate})


def payback(verified: DataFrame, assumptions: DataFrame, interval_s: int = C.ENERGY_INTERVAL_S) -> DataFrame:
    """Yearly energy, money and CO2 and months to pay back, per verified change and assumption row.

    ``n_post`` counts intervals of ``interval_s`` seconds.

    assumptions: intervention, scenario, hardware_inr, subscription_inr_month, rate, days, furnaces, factor.
    """
    df = verified.where(F.col("outcome") == "VERIFIED").join(assumptions, "intervention")
    kwh_day = F.try_divide("counterfactual_kwh", "n_post") * (86400.0 / interval_s)
    df = df.withColumn("kwh_year", kwh_day * F.col("furnaces") * F.col("days") * F.col("saving_pct") / 100.0)
    df = df.withColumn("inr_year", F.col("kwh_year") * F.col("rate"))
    net = F.col("inr_year") / 12.0 - F.col("subscription_inr_month")
    return df.withColumns({"payback_months": F.when(net > 0, F.col("hardware_inr") / net), "co2_t_year": F.col("kwh_year") * F.col("factor") / 1000.0})


def roll_out(paid: DataFrame) -> DataFrame:
    """The same change at 1, 10, 100 and 1000 sites."""
    df = paid.withColumn("sites", F.explode(F.array(*[F.lit(n) for n in (1, 10, 100, 1000)])))
    return df.select("intervention", "scenario", "sites", (F.col("kwh_year") * F.col("sites") / 1000.0).alias("mwh_year"),
                     (F.col("inr_year") * F.col("sites") / 1e7).alias("crore_year"), (F.col("co2_t_year") * F.col("sites")).alias("co2_t_year"))


def shared_savings(paid: DataFrame) -> DataFrame:
    """Savings split between plant and provider; months until the kit is recovered."""
    to = F.col("inr_year") * F.col("share_pct") / 100.0
    return paid.select("intervention", "scenario", to.alias("to_provider_inr"), (F.col("inr_year") - to).alias("kept_inr"),
                       F.when(to > 0, F.col("hardware_inr") / (to / 12.0)).alias("recover_months"), (to * F.col("years")).alias("contract_inr"))


def interest_subsidy(paid: DataFrame) -> DataFrame:
    """First-year interest relief: 5 % (3 % for medium size) on 75 % of the loan, lending rate never below 2 %."""
    sub = F.when(F.col("is_medium"), 3.0).otherwise(5.0)
    rate = F.greatest(F.lit(0.0), F.least(sub, F.col("bank_rate_pct") - 2.0))
    return paid.select("intervention", "scenario", (F.col("loan_inr") * 0.75 * rate / 100.0).alias("relief_inr"), (F.col("saving_pct") >= 10.0).alias("eligible"))


def saving_per_tonne(verified: DataFrame, tonnes: Column) -> DataFrame:
    return verified.withColumn("tonnes", tonnes).where(F.col("tonnes") > 0).select(
        "intervention", "tonnes", (F.col("counterfactual_kwh") / F.col("tonnes")).alias("expected_kwh_per_t"), (F.col("actual_kwh") / F.col("tonnes")).alias("actual_kwh_per_t"))
