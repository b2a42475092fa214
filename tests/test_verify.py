import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import recommend as R
from wattloom.operators import verify as V
from wattloom.sources import canonical

T0 = dt.datetime(2026, 1, 1)
IV = "machine_id string, window_start timestamp, window_end timestamp, complete boolean, energy_kwh double, good_production_kg double"


def test_student_t_matches_tables():
    assert V.student_t(0.95, 10) == pytest.approx(1.8124611, abs=1e-6)
    assert V.student_t(0.975, 30) == pytest.approx(2.0422725, abs=1e-6)
    assert V.student_t(0.95, 164) == pytest.approx(1.6541979, abs=1e-6)


def test_uncertainty_by_hand(spark):
    df = spark.createDataFrame([(0.10, 168, 168.0, 72, 6000.0), (0.10, 168, 84.0, 72, 6000.0)], "cv double, n long, n_eff double, m long, counterfactual_kwh double")
    a, b = [r.uncertainty_kwh for r in V.savings_uncertainty(df).orderBy(F.desc("n_eff")).collect()]
    assert a == pytest.approx(1.6541979 * 1.26 * 0.10 * np.sqrt((1 + 2 / 168) / 72) * 6000.0, rel=1e-6) and b > a


def _plant(spark, shift=0.0, scale=1.0, post=74):
    rng = np.random.default_rng(0)
    kg = rng.uniform(100, 200, 170 + post + 1)
    rows = []
    for k in range(170 + post):
        later = k >= 170
        p = kg[k] * (scale if later else 1.0)
        e = 50 + 2.0 * kg[k] + 1.0 * kg[k + 1] + rng.normal(0, 5.0) - (shift if later else 0.0)
        rows.append(("m", T0 + dt.timedelta(hours=k), T0 + dt.timedelta(hours=k + 1), True, float(e), float(p)))
    cut, end = T0 + dt.timedelta(hours=170), T0 + dt.timedelta(hours=170 + post)
    inter = spark.createDataFrame([("i", "m", cut, T0, cut, cut, end)], "intervention string, machine_id string, applied_at timestamp, baseline_start timestamp, "
                                  "baseline_end timestamp, measurement_start timestamp, measurement_end timestamp")
    return V.verify_savings(inter, spark.createDataFrame(rows, IV)).first()


def test_every_verdict(spark):
    assert _plant(spark).result_class == "NO_EFFECT"
    good = _plant(spark, shift=30.0)
    assert (good.result_class, good.outcome) == ("SUCCESS", "VERIFIED") and good.saving_kwh > good.uncertainty_kwh > 0
    assert _plant(spark, shift=-30.0).result_class == "WORSE"
    moved = _plant(spark, scale=1.6)
    assert moved.outcome == "NOT_COMPARABLE" and moved.saving_kwh is None
    assert _plant(spark, post=12).outcome == "INSUFFICIENT_DATA"


def test_design_needs_neighbours(spark):
    rows = [("i", "baseline", "m", T0 + dt.timedelta(hours=k), k != 2, 1.0, None if k == 3 else 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "intervention string, period string, machine_id string, window_start timestamp, complete boolean, energy_kwh double, good_production_kg double")
    assert [r.usable for r in V.verify_design(df).orderBy("window_start").collect()] == [None, True, False, False, None]


def test_factor_choice(spark):
    days = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2024, 1, 1),), (dt.date(2026, 1, 1),)], "on_date date")
    got = {r.on_date.year: (r.factor_status, r.factor_id) for r in V.select_factor(days, "on_date", canonical.emission_factors(spark)).collect()}
    assert got == {2023: ("UNAVAILABLE", None), 2024: ("EFFECTIVE", "grid-v20"), 2026: ("LATEST_AVAILABLE", "grid-v21")}


def test_lifecycle_equals_step_by_step(spark):
    rng = random.Random(2)
    targets = ["APPROVED", "REJECTED", "APPLIED", "MEASURED", *V.OUTCOMES, "NONSENSE"]
    log = [(rng.choice("abcdefgh"), i, rng.choice(targets)) for i in range(400)]
    follow = {"PENDING_REVIEW": ("APPROVED", "REJECTED"), "APPROVED": ("APPLIED",), "APPLIED": ("MEASURED",), "MEASURED": V.OUTCOMES}
    now, want = {}, {}
    for e, i, t in log:
        ok = t in follow.get(now.get(e, "PENDING_REVIEW"), ())
        want[i] = ok
        if ok:
            now[e] = t
    df = V.lifecycle_fold(spark.createDataFrame(log, "entity string, seq long, target string"))
    assert {r.seq: r.legal for r in df.collect()} == want
    assert {r.entity: r.status for r in V.lifecycle_state(df).collect()} == {e: now.get(e, "PENDING_REVIEW") for e in "abcdefgh"}


def test_applying_equals_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    recs = {f"r{i}": rng.choice(["APPROVED", "APPROVED", "REJECTED"]) for i in range(12)}
    reqs = [(i, rng.choice([*recs, "r99"]), f"k{rng.randrange(18)}", T0 + dt.timedelta(days=i), None, T0 + dt.timedelta(days=i + 1) if rng.random() < 0.15 else None) for i in range(120)]
    keys, applied, want = {}, set(), {}
    for i, r, k, at, _, be in reqs:
        if k in keys:
            want[i] = "replay" if keys[k] == r else "idempotency_key already used for a different recommendation"
        elif r not in recs:
            want[i] = "unknown recommendation"
        elif recs[r] != "APPROVED":
            want[i] = "not approved"
        elif be is not None:
            # a later baseline end is refused whatever the status of the recommendation
            want[i] = "baseline window must end at or before applied_at"
        elif r in applied:
            want[i] = "already applied"
        else:
            keys[k] = r
            applied.add(r)
            want[i] = "applied"
    q = spark.createDataFrame(reqs, "seq long, recommendation string, idempotency_key string, applied_at timestamp, baseline_start timestamp, baseline_end timestamp")
    table = spark.createDataFrame([(r, "m", s) for r, s in recs.items()], "recommendation string, machine_id string, status string")

    def cut(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")
    assert {r.seq: r.result for r in V.apply_interventions(q, table, cut).collect()} == want


RUN = ("run_id string, machine_id string, horizon_start timestamp, horizon_end timestamp, status string, explanation string, stored_comparable boolean, stored_reason string, "
       + ", ".join(f"{s}_{c} double" for c in ("energy_kwh", "peak_kw", "cost_inr", "production_kg", "holding_kwh", "idle_kwh", "reheat_kwh", "aux_kwh") for s in ("cur", "rec")))


def _run(spark, status="OPTIMAL", rec_kg=2250.0):
    pairs = [(700.0, 630.0), (140.0, 135.0), (6000.0, 5000.0), (2250.0, rec_kg), (60.0, 30.0), (40.0, 20.0), (0.0, 0.0), (0.0, 0.0)]
    return spark.createDataFrame([("run-1", "furnace-01", T0, T0 + dt.timedelta(days=1), status, status, None, None, *[v for p in pairs for v in p])], RUN)


def test_schedule_recommendations(spark):
    findings = spark.createDataFrame([], "machine_id string, day date, metric string, above_reference boolean")
    r = R.rec_reschedule(_run(spark)).first()
    assert (r.projected_kwh_delta, r.projected_peak_kw_delta, r.projected_cost_inr_delta, r.confidence) == (-70.0, -5.0, -1000.0, "HIGH")
    assert R.rec_sequence(_run(spark, "FEASIBLE"), findings).first().projected_kwh_delta == -50.0
    other = R.rec_reschedule(_run(spark, rec_kg=2400.0)).first()
    assert other.projected_kwh_delta is None and other.reason.startswith("NOT COMPARABLE")
    assert R.rec_noplan(_run(spark, "INFEASIBLE")).count() == 1 and R.rec_reschedule(_run(spark, "INFEASIBLE")).count() == 0


def test_critical_inspection_conflicts_with_a_plan(spark):
    ins = spark.createDataFrame([("HEALTH_ONLY", "furnace-01", T0, T0 + dt.timedelta(hours=6), ["CRITICAL"], [("vibration_mm_s", 8.0)])],
                                "category string, machine_id string, window_start timestamp, window_end timestamp, states array<string>, top_signals array<struct<signal:string,z:double>>")
    recs = R.rec_inspect(ins).unionByName(R.rec_reschedule(_run(spark)))
    got = {r.rule_id: r for r in R.mark_conflicts(recs).collect()}
    assert {r.status for r in got.values()} == {"CONFLICT"} and got["R-INSPECT"].conflict_with == [got["R-RESCHEDULE"].dedup_key]
    calm = R.rec_inspect(ins.withColumn("states", F.array(F.lit("WARNING")))).unionByName(R.rec_reschedule(_run(spark)))
    assert {r.status for r in R.mark_conflicts(calm).collect()} == {"PENDING_REVIEW"}


def test_evidence_names_every_source_and_keys_do_not_depend_on_order(spark):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    ev = [(f"f|L1_IDLE_WASTE|{i}", "f", "L1_IDLE_WASTE", hour(i), hour(i + 1), "WARNING", "OPEN", 10.0 + i) for i in range(5)] + [("g|x", "g", "L1_POWER", hour(0), hour(1), "WARNING", "OPEN", 1.0)]
    cols = "dedup_key string, machine_id string, rule_id string, window_start timestamp, window_end timestamp, severity string, status string, deviation_pct double"
    found = spark.createDataFrame([("f", T0.date(), "idle_hours", 3.0, 1.0, True), ("f", T0.date(), "start_count", 9.0, 1.0, True), ("f", T0.date(), "idle_hours", 0.5, 1.0, False)],
                                  "machine_id string, day date, metric string, value double, reference double, above_reference boolean")
    ins = spark.createDataFrame([("COINCIDENT", "g", hour(0), hour(2), "L1_POWER", "WARNING", 1.0, ["CRITICAL"], [("temperature_c", 7.0, 55.0)]),
                                 ("ENERGY_ONLY", "g", hour(5), hour(6), "L1_POWER", None, None, ["NORMAL"], [])],
                                "category string, machine_id string, window_start timestamp, window_end timestamp, rule_id string, severity string, deviation_pct double, "
                                "states array<string>, top_signals array<struct<signal:string,z:double,median:double>>")
    runs = _run(spark).unionByName(_run(spark, "INFEASIBLE").withColumns({"run_id": F.lit("run-2"), "explanation": F.lit("peak-cap")}))
    events = spark.createDataFrame(ev, cols)
    recs = R.candidates(events, ins, found, runs).persist()
    turned = R.rec_idle(spark.createDataFrame(ev[::-1], cols), found).first()
    idle = recs.where("rule_id = 'R-IDLE'").first()
    assert turned.dedup_key == idle.dedup_key != R.rec_idle(spark.createDataFrame(ev[1:], cols), found).first().dedup_key
    assert idle.proposed_action.count("f") and "{m}" not in idle.proposed_action and idle.effect_class is None and idle.source_module == "recommend:R-IDLE"
    rows = R.evidence(recs, events, found, ins, runs).collect()
    got = {}
    for r in rows:
        got.setdefault(r.rule_id, set()).add((r.kind, r.ref, r.measure, r.value, r.reference))
    assert got["R-IDLE"] == {("anomaly", k[0], "deviation_pct", k[7], None) for k in ev[:5]} | {("finding", f"{T0.date()}:idle_hours", "idle_hours", 3.0, 1.0)}
    assert got["R-INSPECT"] == {("insight", "COINCIDENT", "deviation_pct", 1.0, None), ("signal", "temperature_c", "robust_z", 7.0, 55.0)}
    assert got["R-PROCESS"] == {("insight", "ENERGY_ONLY", "deviation_pct", None, None)}
    assert ("run", "run-1", "energy_kwh", 630.0, 700.0) in got["R-RESCHEDULE"] and ("run", "run-1", "gap_kwh", 50.0, 100.0) in got["R-SEQUENCE"]
    assert got["R-NOPLAN"] == {("limit", "run-2", "peak-cap", None, None)} and {r[1] for r in got["R-PRIORITISE"]} == {"f", "g"}
    empty = R.evidence(recs.limit(0), events.limit(0), found.limit(0), ins.limit(0), runs.limit(0))
    assert empty.count() == 0 and empty.columns == R.evidence(recs, events, found, ins, runs).columns
    recs.unpersist()
