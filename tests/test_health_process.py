import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.operators import correlate, health, process
from wattloom.operators.intervals import HOUR_COLUMNS

T0 = dt.datetime(2026, 9, 1)
IV = ("machine_id string, machine_type string, k long, window_start timestamp, window_end timestamp, machine_state string, vibration_mm_s double, "
      "temperature_c double, current_a double, complete boolean")


def _health(spark, rows):
    data = [("m", "furnace", i, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + 1), *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, IV)


def test_robust_z_values(spark):
    df = spark.createDataFrame([(12.0, 10.0, 2.0)], "v double, m double, d double")
    c = [F.col(x) for x in ("v", "m", "d")]
    r = df.select(health.robust_z(*c, 0.0, 1e-9).alias("a"), health.robust_z(F.lit(10.5), F.lit(10.0), F.lit(0.0), 0.05, 1e-6).alias("b")).first()
    assert r.a == pytest.approx(0.6745) and r.b < 1


def test_status_ladder_and_score(spark):
    normal = [("melting", 3.0 + 0.1 * (i % 3), 1550.0 + i % 5, 300.0, True) for i in range(30)]
    ref = health.fit_health_reference(_health(spark, normal))
    rows = _health(spark, [("melting", 3.1, 1551.0, 300.0, True), ("melting", 8.0, 1551.0, 300.0, True), ("melting", 3.1, 1550.0, 300.0, False),
                           ("holding", 3.1, 1550.0, 300.0, True), ("melting", None, None, None, True)])
    got = {r.k: r for r in health.score_health(rows, ref).collect()}
    assert [got[k].status for k in range(5)] == ["OK", "OK", "UNAVAILABLE", "OUT_OF_DOMAIN", "UNAVAILABLE"]
    assert got[0].state == "NORMAL" and got[0].health_score > 90 and got[1].state == "CRITICAL" and got[1].contributions[0].signal == "vibration_mm_s"
    assert sum(c.weight for c in got[1].contributions) == pytest.approx(1.0)
    assert "health" in got[1].reason and got[3].reason == "state bucket 'holding' not seen in reference"
    few = health.fit_health_reference(_health(spark, normal[:10]))
    assert health.score_health(rows, few).select("status").distinct().collect()[0].status == "INSUFFICIENT_HISTORY"


EV = "machine_id string, dedup_key string, window_start timestamp, window_end timestamp, rule_id string, severity string, deviation_pct double, n_intervals long, status string"
HR = ("machine_id string, window_start timestamp, window_end timestamp, state string, status string, "
      "contributions array<struct<rank:int,signal:string,z:double,pct_change:double,median:double,value:double,weight:double>>")


def _event(spark, start=0, end=2):
    return spark.createDataFrame([("m", "e", T0 + dt.timedelta(hours=start), T0 + dt.timedelta(hours=end), "L1_DEVIATION", "WARNING", 20.0, 2, "OPEN")], EV)


def _row(spark, hours, state="CRITICAL", status="OK"):
    c = [(1, "vibration_mm_s", 7.0, 150.0, 2.0, 5.0, 1.0)]
    return spark.createDataFrame([("m", T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + 1), state, status, c) for h in hours], HR)


def test_overlap_gives_one_coincident_insight(spark):
    got = correlate.correlate(_event(spark), _row(spark, [1])).collect()
    assert [(r.category, r.signals) for r in got] == [("COINCIDENT", "vibration_mm_s")]
    assert got[0].text == ("Energy anomaly coincides with machine-health anomaly (vibration_mm_s). This is a correlation, not an established cause; "
                           "inspection recommended.")


def test_the_other_categories(spark):
    cat = lambda e, h: sorted(r.category for r in correlate.correlate(e, h).collect())
    assert cat(_event(spark), _row(spark, [1], "NORMAL")) == ["ENERGY_ONLY"]
    assert cat(_event(spark), _row(spark, [1], "NORMAL", "UNAVAILABLE")) == ["ENERGY_ONLY_HEALTH_UNAVAILABLE"]
    assert cat(_event(spark), _row(spark, [2])) == ["ENERGY_ONLY_HEALTH_UNAVAILABLE", "HEALTH_ONLY"]  # touching is not overlapping
    rows = correlate.correlate(_event(spark), _row(spark, [5, 6, 9])).where("category = 'HEALTH_ONLY'").orderBy("window_start").collect()
    assert [r.n_intervals for r in rows] == [2, 1]


def test_texts_stay_non_causal(spark):
    df = correlate.correlate(_event(spark), _row(spark, [1, 6]))
    assert correlate.text_guard(df).count() == 0 and correlate.text_guard(df, "next_step").count() == 0
    bad = spark.createDataFrame([("high because of wear",), ("causeway",)], "text string")
    assert [r.text for r in correlate.text_guard(bad).collect()] == ["high because of wear"]


def test_reference_medians(spark):
    cols = "machine_id string, idle_hours double, holding_per_heat_h double, non_productive_share double, start_count long, median_heat_gap_h double, heat_count long"
    ref = process.reference_medians(spark.createDataFrame([("m", 2.0, 0.4, 0.10, 9, 2.2, 4), ("m", 2.4, 0.5, 0.12, 10, 2.0, 5)], cols)).first()
    assert (ref.idle_hours, ref.holding_per_heat_h, ref.non_productive_share, ref.start_count, ref.median_heat_gap_h) == pytest.approx((2.2, 0.45, 0.11, 9.5, 2.1))


def test_daily_metrics_split_days_locally(spark):
    machines = spark.createDataFrame([("m", "furnace")], "machine_id string, machine_type string")
    states = ["idle", "heating", "melting", "holding", "heating", "melting"]
    start = dt.datetime(2026, 9, 1, 17, 30)  # 23:00 local
    tel = spark.createDataFrame([("m", start + dt.timedelta(minutes=20 * i), s, "GOOD") for i, s in enumerate(states)], "machine_id string, ts timestamp, machine_state string, quality string")
    iv = spark.createDataFrame([("m", start + dt.timedelta(hours=h), True, 5.0, 0.0, 0.6) for h in range(6)],
                               "machine_id string, window_start timestamp, complete boolean, energy_kwh double, good_production_kg double, hours_idle double")
    iv = iv.withColumns({c: F.lit(0.0) for c in HOUR_COLUMNS if c != "hours_idle"})
    got = {str(r.day): r for r in process.daily_metrics(iv, tel, machines).collect()}
    a, b = got["2026-09-01"], got["2026-09-02"]
    assert (a.heat_count, a.start_count, a.non_productive_kwh) == (1, 1, 5.0) and b.idle_hours == pytest.approx(3.0)
    assert (b.heat_count, b.start_count, b.non_productive_share, b.median_heat_gap_h) == (1, 1, 1.0, None)


def test_every_machine_with_a_reference_is_listed(spark):
    rows = [("m1", x) for x in ("pump-01", "furnace-01", "compressor-01", "furnace-01")] + [("m2", "pump-01")]
    got = health.covered_machines(spark.createDataFrame(rows, "model_id string, machine_id string")).collect()
    assert sorted(map(tuple, got)) == [("m1", "compressor-01"), ("m1", "furnace-01"), ("m1", "pump-01"), ("m2", "pump-01")]
