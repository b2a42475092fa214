import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import anomaly, baseline, intervals, sec
from wattloom.operators.intervals import HOUR_COLUMNS

T0 = dt.datetime(2026, 9, 13, 6, 30)
TEL = "machine_id string, ts timestamp, quality string, energy_kwh double, machine_state string, power_kw double, power_factor double"
PROD = "machine_id string, window_start timestamp, quality string, qty_good_kg double, qty_rejected_kg double"


def _interval(spark, rows=None, end="2026-09-13 07:30:00"):
    rows = rows or [("m", T0 + dt.timedelta(minutes=5 * i), "GOOD", 2.0 * i, "running", 10.0, 0.85) for i in range(12)]
    tel = spark.createDataFrame(rows, TEL)
    prod = spark.createDataFrame([("m", T0, "GOOD", 100.0, 2.0)], PROD)
    machines = spark.createDataFrame([("m", "furnace", 200.0)], "machine_id string, machine_type string, rated_power_kw double")
    return intervals.build_intervals(tel, prod, machines, start="2026-09-13 06:30:00", end=end)


def _twelve():
    return [["m", T0 + dt.timedelta(minutes=5 * i), "GOOD", 2.0 * i, "running", 10.0, 0.85] for i in range(12)]


def test_interval_energy_hours_and_production(spark):
    r = _interval(spark).first()
    assert r.complete and r.energy_kwh == 22.0 and r.hours_running == 1.0 and r.good_production_kg == 100.0 and r.rejected_production_kg == 2.0
    assert r.n_good == 12 and r.coverage_pct == pytest.approx(91.67)


def test_bad_row_thin_coverage_and_suspect_row(spark):
    rows = _twelve()
    rows[3][2] = "BAD"
    r = _interval(spark, rows).first()
    assert not r.complete and r.incomplete_reasons == ["contains 1 BAD-quality row(s)"]
    r = _interval(spark, _twelve()[:2]).first()
    assert not r.complete and r.incomplete_reasons[0].startswith("coverage")
    rows = _twelve()
    rows[0][2] = "SUSPECT"
    r = _interval(spark, rows).first()
    assert r.complete and r.n_good == 11


def test_empty_bucket_exists_and_part_bucket_does_not(spark):
    got = _interval(spark, end="2026-09-13 09:00:00").orderBy("k").collect()
    assert [r.complete for r in got] == [True, False] and got[1].n_good == 0


def test_dominant_state_tie_goes_to_first_seen(spark):
    rows = [("m", T0 + dt.timedelta(minutes=i), s) for i, s in enumerate(["b", "a", "a", "b"])]
    df = spark.createDataFrame(rows, "machine_id string, ts timestamp, machine_state string")
    assert intervals.dominant_state(df, ["machine_id"]).first().machine_state == "b"


@pytest.mark.parametrize("row, status, value", [
    ((100.0, 500.0, True, "furnace", True), "OK", 200.0), ((100.0, 0.0, True, "furnace", True), "NO_PRODUCTION", None),
    ((100.0, None, False, "furnace", True), "MISSING_PRODUCTION", None), ((100.0, 5.0, True, "furnace", False), "INCOMPLETE_DATA", None),
    ((None, 5.0, True, "furnace", True), "INCOMPLETE_DATA", None), ((100.0, 5.0, True, "pump", False), "NOT_APPLICABLE", None)])
def test_sec_ladder(spark, row, status, value):
    df = spark.createDataFrame([row], "energy_kwh double, good_production_kg double, has_production_record boolean, machine_type string, complete boolean")
    r = sec.compute_sec(df).first()
    assert (r.sec_status, r.sec_kwh_per_t) == (status, value)


def _baseline_rows(spark, n=40):
    rows = []
    for k in range(n):
        h, kg = 0.5 + 0.5 * ((37 * k % 10) / 10), float(53 * k % 200) + 10
        rows.append(("m", "motor", T0 + dt.timedelta(hours=k), True, 10 + 100 * h + 0.5 * kg, kg, h))
    df = spark.createDataFrame(rows, "machine_id string, machine_type string, window_start timestamp, complete boolean, energy_kwh double, good_production_kg double, hours_running double")
    return df.withColumns({c: F.lit(0.0) for c in HOUR_COLUMNS if c != "hours_running"})


def test_fit_recovers_known_coefficients(spark):
    r = baseline.fit_baseline(_baseline_rows(spark)).first()
    assert r.status == "OK" and r.intercept == pytest.approx(10.0, abs=1e-6)
    assert r.coefficients["hours_running"] == pytest.approx(100.0) and r.coefficients["good_production_kg"] == pytest.approx(0.5)
    assert r.r2_train == pytest.approx(1.0) and r.acceptance == "ACCEPTABLE"
    # 8 holdout rows would leave 32 >= 10 training rows
    assert (r.n_train, r.n_holdout) == (32, 8)


def test_short_history_gives_no_numbers(spark):
    r = baseline.fit_baseline(_baseline_rows(spark, 23)).first()
    assert r.status == "INSUFFICIENT_BASELINE_HISTORY" and r.intercept is None


def test_nnls_equals_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.normal(size=(30, 5)), rng.normal(size=30)
        if rng.random() < 0.3:
            a[:, 4] = a[:, 0]  # collinear
        best = np.linalg.norm(b)
        for k in range(1, 6):
            for cols in itertools.combinations(range(5), k):
                x = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
                if (x >= -1e-12).all():
                    best = min(best, np.linalg.norm(a[:, cols] @ x - b))
        x = baseline.nnls(a.T @ a, a.T @ b)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) == pytest.approx(best, abs=1e-7)


def _scored(spark, rows):
    """rows: (complete, dev %, actual, expected)"""
    data = [("m", i, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + 1), 200.0, *r, True, 100.0, 50.0, 0.9) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "machine_id string, k long, window_start timestamp, window_end timestamp, rated_power_kw double, complete boolean, deviation_pct double, "
                                     "energy_kwh double, expected_kwh double, has_baseline boolean, good_production_kg double, power_max_kw double, pf_mean double")
    return df.withColumns({c: F.lit(1.0 if c == "hours_melting" else 0.0) for c in HOUR_COLUMNS})


def test_rolling_z(spark):
    z = lambda xs: [r.z for r in anomaly.rolling_mad_z(_scored(spark, [(True, 0.0, x, 0.0) for x in xs]), 8).orderBy("k").collect()]
    got = z([1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0, 20.0])
    assert got[-1] > 4 and max(got[:-1]) < 4
    assert z([3.0] * 5) == [0.0] * 5 and z([1.0, 9.0]) == [0.0, 0.0]


def test_deviation_needs_consecutive_complete_rows(spark):
    def flags(devs, complete=True):
        return [(r.k, r.severity) for r in anomaly.l1_deviation(_scored(spark, [(complete, d, 120.0, 100.0) for d in devs])).orderBy("k").collect()]
    assert flags([0.0, 20.0, 0.0]) == []
    assert flags([20.0, 20.0, 0.0]) == [(1, "WARNING")]
    assert flags([35.0, 35.0]) == [(1, "CRITICAL")]
    assert flags([35.0, 35.0], complete=False) == []
    got = anomaly.l1_deviation(_scored(spark, [(True, 20.0, 1.0, 1.0), (False, 20.0, 1.0, 1.0), (True, 20.0, 1.0, 1.0)])).collect()
    assert got == []


def test_event_percentage_divides_by_all_rows(spark):
    s = _scored(spark, [(True, 20.0, 120.0, 100.0), (True, 40.0, 140.0, 100.0), (True, 16.0, 116.0, 100.0), (True, 0.0, 100.0, 100.0)])
    e = anomaly.build_events(anomaly.l1_deviation(s), s).first()
    assert (e.actual_kwh, e.expected_kwh, e.deviation_pct, e.severity, e.n_intervals) == (256.0, 200.0, 28.0, "CRITICAL", 2)
    assert e.dedup_key == "m|L1_DEVIATION|2026-09-13T07:30:00+00:00|2026-09-13T09:30:00+00:00"
    assert e.evidence.startswith("L1_DEVIATION: Energy 40.0% above expected baseline")
