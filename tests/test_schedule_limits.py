"""Shifting within a plan's own limits, against every placement by brute force and against the checks."""

import itertools
import random

import pytest

from test_schedule import DAY, TPL, _model, _powers, _tariff
from wattloom.operators import schedule as K
from wattloom.operators import schedule_limits as L

CONS = "plan_id string, machine_id string, n_slots int, n_heats int, cold_slots int, reheat_slots int, first_cold boolean, peak_cap_kw double"
TASK = "plan_id string, name string, duration_slots int, window_start_slot int, window_end_slot int, power_kw double"
N = 16
KW = {"h": 50.0, "m": 80.0, "o": 30.0}


def brute(plan, rates):
    """Smallest objective over all placements, or None."""
    price = [0.3 + 1.0 * rates[t % len(rates)] for t in range(N)]
    unit = lambda x: round(x * 1e6)
    free = lambda s, e: not any(s < me and ms < e for ms, me in plan["down"])
    best = None
    tasks = [[s for s in range(max(ws, 0), min(we, N) - d + 1) if free(s, s + d)] for _, d, ws, we, _ in plan["tasks"]]
    for aux in itertools.product(*tasks):
        load, cost0 = [0.0] * N, 0
        for s, (_, d, _, _, kw) in zip(aux, plan["tasks"], strict=True):
            for t in range(s, s + d):
                load[t] += kw
                cost0 += unit(price[t] * kw)
        if plan["cap"] is not None and max(load) > plan["cap"]:
            continue

        def go(i, end, cost):
            nonlocal best
            if i == len(plan["heats"]):
                best = cost if best is None else min(best, cost)
                return
            kg, heat, melt, lo, hi = plan["heats"][i]
            for s in range(end if i else 0, N):
                r = plan["reheat"] if s - end > plan["cold"] and (i or plan["first_cold"]) else 0
                for hold in range(lo, hi + 1):
                    e = s + heat + r + melt + hold
                    if not any(ws <= s and e <= we for ws, we in plan["windows"]) or not free(s, e) or e > N:
                        continue
                    states = "h" * (heat + r) + "m" * melt + "o" * hold
                    if plan["cap"] is not None and any(KW[x] + load[s + k] > plan["cap"] for k, x in enumerate(states)):
                        continue
                    kwh = {"h": 10.0 - 2.0, "m": 0.5 * kg / max(melt, 1) - 2.0, "o": 5.0 - 2.0}
                    go(i + 1, e, cost + sum(unit(price[s + k] * kwh[x]) for k, x in enumerate(states)))
        go(0, 0, cost0)
    return None if best is None else best / 1e6


def random_plans(r):
    for k in range(14):
        heats = [(r.choice([60.0, 100.0]), r.randint(1, 2), r.randint(1, 2), lo := r.randint(0, 1), lo + r.randint(0, 1)) for _ in range(r.randint(0, 3))]
        tasks = [(f"t{j}", r.randint(1, 3), ws := r.randint(0, 8), ws + r.randint(2, 8), r.choice([15.0, 40.0])) for j in range(r.choice([0, 1, 1, 2]))]
        yield {"id": f"p{k:02}", "heats": heats, "tasks": tasks, "cap": r.choice([None, 85.0, 100.0, 70.0]), "windows": r.choice([[(0, N)], [(0, 7), (7, N)], [(2, 9), (6, 15)]]),
               "down": r.choice([[], [(5, 7)], [(3, 4), (11, 12)]]), "cold": r.randint(1, 4), "reheat": r.randint(0, 2), "first_cold": r.random() < 0.5}


@pytest.fixture(scope="module")
def shifted(spark):
    plans = list(random_plans(random.Random(21)))
    rates = [5.0, 9.0, 4.0, 12.0, 7.0, 3.0]
    tariff = _tariff(spark, [(f"r{k}", 240 * k, 240 * (k + 1) % 1440, x) for k, x in enumerate(rates)])
    cons = spark.createDataFrame([(p["id"], "f", N, len(p["heats"]), p["cold"], p["reheat"], p["first_cold"], p["cap"]) for p in plans], CONS)
    tpl = spark.createDataFrame([(p["id"], "f", DAY, i, kg, h, m, lo, hi) for p in plans for i, (kg, h, m, lo, hi) in enumerate(p["heats"])], TPL)
    windows = spark.createDataFrame([(p["id"], a, b) for p in plans for a, b in p["windows"]], "plan_id string, ws int, we int")
    down = spark.createDataFrame([(p["id"], a, b) for p in plans for a, b in p["down"]], "plan_id string, ms int, me int")
    tasks = spark.createDataFrame([(p["id"], *t) for p in plans for t in p["tasks"]], TASK)
    powers = _powers(spark).where("machine_state <> 'idle'")
    inputs = (tpl, cons, windows, down, tasks, powers)
    out = L.shift_within_limits(*inputs, _model(spark), tariff, site_id="s", slot_min=60, w_energy=0.3, w_cost=1.0).cache()
    # 24 hourly rates, of which the first N count.
    return plans, [rates[h // 4] for h in range(24)], inputs, out


def test_objective_equals_brute_force(shifted):
    plans, rates, _, out = shifted
    got = {x.plan_id: x for x in out.collect()}
    assert len(got) == len(plans)
    want = {p["id"]: brute(p, rates) for p in plans}
    for p in plans:
        x, w = got[p["id"]], want[p["id"]]
        assert x.objective == (None if w is None else pytest.approx(w, abs=1e-6)), p
        assert x.status == ("INFEASIBLE" if w is None else "SHIFTED" if p["heats"] else "EMPTY") and (x.groups is not None) == (w is None)
    assert 2 < sum(w is None for w in want.values()) < len(plans) - 4


def test_no_check_finds_anything_in_a_shifted_plan(shifted):
    _, _, (tpl, cons, windows, down, tasks, powers), out = shifted
    good = out.where("status <> 'INFEASIBLE'").select("plan_id")
    semi = lambda df: df.join(good, "plan_id", "left_semi")
    heats, aux = L.placed_heats(out), L.placed_aux(out)
    assert heats.count() > 5 and aux.count() > 3
    assert K.validate_schedules(heats, aux, semi(cons), tpl, windows, down, tasks, powers).collect() == []


def test_odd_limits(spark):
    tariff = _tariff(spark, [("day", 0, 720, 5.0), ("night", 720, 0, 5.0)])
    cons = [("none", "f", N, 1, 2, 1, False, None), ("more", "f", N, 2, 2, 1, False, None), ("unknown", "g", N, 1, 2, 1, False, 50.0), ("shut", "f", N, 1, 2, 1, False, None), ("tight", "f", N, 0, 2, 1, False, None)]
    tpl = [(p, m, DAY, 0, 100.0, 1, 1, 0, 0) for p, m in (("more", "f"), ("unknown", "g"), ("shut", "f"))]
    windows = [(p, 0, N) for p in ("none", "more", "unknown", "tight")]
    model = _model(spark).unionByName(_model(spark).selectExpr("'g' AS machine_id", "coefficients", "intercept"))
    out = L.shift_within_limits(spark.createDataFrame(tpl, TPL), spark.createDataFrame(cons, CONS), spark.createDataFrame(windows, "plan_id string, ws int, we int"),
                                spark.createDataFrame([], "plan_id string, ms int, me int"), spark.createDataFrame([("tight", "t", 5, 0, 4, 1.0)], TASK), _powers(spark), model, tariff, site_id="s", slot_min=60)
    got = {x.plan_id: (x.status, x.groups, [h.start_slot for h in x.heats or []]) for x in out.collect()}
    assert got["more"][0] == "SHIFTED" and len(got["more"][2]) == 2  # both by the first template
    assert {p: got[p][0] for p in ("none", "unknown", "shut", "tight")} == dict.fromkeys(("none", "unknown", "shut", "tight"), "INFEASIBLE")
    assert got["tight"][1] == ["aux-window"] and all(got[p][1] for p in ("none", "unknown", "shut"))
