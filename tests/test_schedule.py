import datetime as dt
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators import schedule as K

DAY = dt.date(2026, 9, 20)
HEAT = "plan_id string, machine_id string, day date, heat_no int, start_slot int, heating_slots int, melting_slots int, holding_slots int, charge_kg double, reheat_slots int"
TPL = "plan_id string, machine_id string, day date, heat_no int, charge_kg double, heating_slots int, melting_slots int, min_hold_slots int, max_hold_slots int"


def _plans(spark):
    return spark.createDataFrame([("p", "f", DAY)], "plan_id string, machine_id string, day date")


def _model(spark, intercept=6.0):
    coefs = {"good_production_kg": 0.5, "hours_heating": 10.0, "hours_holding": 5.0, "hours_idle": 2.0}
    return spark.createDataFrame([("f", coefs, intercept)], "machine_id string, coefficients map<string,double>, intercept double")


def _powers(spark):
    return spark.createDataFrame([("f", s, p) for s, p in (("heating", 50.0), ("melting", 80.0), ("holding", 30.0), ("idle", 5.0))],
                                 "machine_id string, machine_state string, median_kw double")


def _tariff(spark, rows):
    return spark.createDataFrame([("s", n, a, b, r, None, "ASSUMPTION") for n, a, b, r in rows],
                                 "site_id string, period_name string, start_min int, end_min int, energy_inr_per_kwh double, demand_inr_per_kw double, source_class string")


def _aux(spark, rows=()):
    return spark.createDataFrame(list(rows), "plan_id string, name string, start_slot int, duration_slots int, power_kw double")


def test_evaluate_by_hand(spark):
    heats = spark.createDataFrame([("p", "f", DAY, 0, 0, 1, 2, 1, 100.0, 0)], HEAT)
    tariff = _tariff(spark, [("cheap", 0, 120, 10.0), ("rest", 120, 0, 5.0)])
    slots = K.schedule_slots(_plans(spark), heats, _aux(spark), n_slots=6)
    assert [r.state for r in slots.orderBy("slot").collect()] == ["heating", "melting", "melting", "holding", "idle", "idle"]
    ev = lambda t: K.evaluate_schedule(slots, heats, _model(spark), _powers(spark), t, site_id="s", interval_s=6 * 3600, slot_min=60).first()
    r = ev(tariff)
    assert (r.energy_kwh, r.peak_kw, r.cost_inr, r.production_kg, r.n_heats) == pytest.approx((75.0, 80.0, 560.0, 100.0, 1))
    assert r.heating_kwh + r.melting_kwh + r.holding_kwh + r.idle_kwh + r.reheat_kwh + r.intercept_kwh + r.aux_kwh == pytest.approx(r.energy_kwh)
    assert ev(tariff.where(F.lit(False))).cost_inr is None and ev(_tariff(spark, [("part", 0, 120, 10.0)])).cost_inr is None


def test_tariff_minutes_wrap_and_bounds(spark):
    got = {r.minute: r.rate for r in K.tariff_minutes(_tariff(spark, [("off", 1320, 360, 6.0), ("day", 360, 1080, 8.0), ("peak", 1080, 1320, 10.0)])).collect()}
    assert len(got) == 1440 and (got[1080], got[360], got[1320], got[1079], got[0]) == (10.0, 8.0, 6.0, 8.0, 6.0)


def test_heats_from_slots_and_reheat(spark):
    text = "iihhmmoohhihmoi" + "i" * 9 + "hhm"
    names = {"i": "idle", "h": "heating", "m": "melting", "o": "holding"}
    slots = spark.createDataFrame([("p", "f", DAY, i, names[c]) for i, c in enumerate(text)], "plan_id string, machine_id string, day date, slot int, state string")
    heats = K.assign_reheat(K.slots_to_heats(slots))
    got = [(r.start_slot, r.heating_slots, r.melting_slots, r.holding_slots, r.reheat_slots) for r in heats.orderBy("start_slot").collect()]
    assert got == [(2, 2, 2, 2, 0), (11, 1, 1, 1, 0), (24, 2, 1, 0, 1)]
    base = [r.heating_slots for r in K.templates_from_heats(heats).orderBy("heat_no").collect()]
    assert base == [2, 1, 1]


def _cost(starts, tpl, rates, holds, cold, extra):
    """Objective of one placement, slot by slot; None when it breaks a rule."""
    n, end, total = len(rates), 0, 0.0
    busy = {}
    for i, (s, h, hold) in enumerate(zip(starts, tpl, holds)):
        re = extra if i and s - end > cold else 0
        if i and s < end:
            return None
        t = s
        for count, kwh in ((h[0] + re, 2.5), (h[1], 50.0 / h[1]), (hold, 1.25)):
            for _ in range(count):
                busy[t] = kwh
                t += 1
        end = t
    if end > n:
        return None
    for t in range(n):
        total += busy.get(t, 0.5) * (1.0 + rates[t])
    return total


def test_shift_equals_brute_force(spark):
    rng = random.Random(7)
    n, rows, want = 14, [], {}
    tariff = [("a", 0, 60, 9.0), ("b", 60, 120, 4.0), ("c", 120, 0, 7.0)]
    rates = [9.0] * 4 + [4.0] * 4 + [7.0] * (n - 8)
    for p in range(12):
        tpl = [(rng.randint(1, 2), rng.randint(1, 2), lo, lo + rng.randint(0, 1)) for lo in (rng.randint(0, 1), rng.randint(0, 1))]
        rows += [(f"p{p}", "f", DAY, i, 100.0, *t) for i, t in enumerate(tpl)]
        want[f"p{p}"] = min(c for st in itertools.product(range(n), repeat=2) for ho in itertools.product(*[range(t[2], t[3] + 1) for t in tpl])
                            if (c := _cost(st, tpl, rates, ho, 3, 1)) is not None)
    got = K.shift_plan(spark.createDataFrame(rows, TPL), _model(spark, 0.0), _tariff(spark, tariff), site_id="s", n_slots=n, cold_slots=3, operating=(0, n)).toPandas()
    # the day's prices cover 96 slots; only the first n are open
    for p, g in got.groupby("plan_id"):
        g = g.sort_values("heat_no")
        tpl = [(h - r, m) for h, m, r in zip(g.heating_slots, g.melting_slots, g.reheat_slots)]
        assert _cost(list(g.start_slot), tpl, rates, list(g.holding_slots), 3, 1) == pytest.approx(want[p])
    assert isinstance(got, pd.DataFrame) and got.plan_id.nunique() == 12


def test_violations_are_found(spark):
    heats = spark.createDataFrame([("p", "f", DAY, 0, 0, 1, 2, 1, 100.0, 0), ("p", "f", DAY, 1, 2, 1, 2, 5, 100.0, 0)], HEAT)
    tpl = spark.createDataFrame([("p", "f", DAY, i, 100.0, 1, 2, 1, 2) for i in range(2)], TPL)
    cons = spark.createDataFrame([("p", "f", 24, 3, 8, 1, False, 200.0)], "plan_id string, machine_id string, n_slots int, n_heats int, cold_slots int, reheat_slots int, first_cold boolean, peak_cap_kw double")
    windows = spark.createDataFrame([("p", 0, 24)], "plan_id string, ws int, we int")
    maintenance = spark.createDataFrame([("p", 3, 4)], "plan_id string, ms int, me int")
    tasks = spark.createDataFrame([], "plan_id string, name string, duration_slots int, window_start_slot int, window_end_slot int")
    v = {(r.item, r.violation) for r in K.validate_schedules(heats, _aux(spark, [("p", "pump", 1, 2, 150.0)]), cons, tpl, windows, maintenance, tasks, _powers(spark)).collect()}
    assert v == {("heat 1", "holding out of bounds"), ("heat 1", "overlaps previous heat"), ("heat 0", "overlaps maintenance"), ("heat 1", "overlaps maintenance"),
                 ("plan", "heat count differs"), ("aux pump", "not in constraints"), ("plan", "peak cap exceeded")}
