import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattloom.operators import ingest
from wattloom.sources import messages, registers, store

NOW = "2026-09-27 12:00:00"
T0 = dt.datetime(2026, 9, 27, 11, 59)
SCHEMA = ("machine_id string, ts timestamp, seq long, voltage_v double, current_a double, power_kw double, power_factor double, "
          "energy_kwh double, machine_state string, source string")


def _rows(spark, rows):
    base = {"machine_id": "m", "ts": T0, "seq": 1, "voltage_v": 415.0, "current_a": 100.0, "power_kw": 50.0, "power_factor": 0.85,
            "energy_kwh": None, "machine_state": "running", "source": "MEASURED"}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SCHEMA)


def _machines(spark):
    return spark.createDataFrame([("m", 60.0), ("n", 0.0)], "machine_id string, rated_power_kw double")


@pytest.mark.parametrize("change, quality", [
    ({}, "GOOD"), ({"power_kw": -5.0}, "BAD"), ({"current_a": -1.0}, "BAD"), ({"voltage_v": -1.0}, "BAD"), ({"power_factor": -0.1}, "BAD"),
    ({"power_factor": 1.5}, "BAD"), ({"ts": T0 + dt.timedelta(seconds=361)}, "BAD"), ({"ts": T0 - dt.timedelta(seconds=841)}, "SUSPECT"),
    ({"power_kw": 90.1}, "SUSPECT"), ({"power_kw": 90.0}, "GOOD"), ({"machine_id": "n", "power_kw": 900.0}, "GOOD")])
def test_single_reading_rules(spark, change, quality):
    df = ingest.validate_telemetry(_rows(spark, [change]), _machines(spark), now=NOW)
    assert df.first().quality == quality


def test_late_lower_counter_is_suspect_but_a_falling_one_is_bad(spark):
    s = dt.timedelta(seconds=1)
    rows = [{"seq": 1, "ts": T0, "energy_kwh": 10.0}, {"seq": 2, "ts": T0 + s, "energy_kwh": 9.0}, {"seq": 3, "ts": T0 - s, "energy_kwh": 8.0},
            {"seq": 4, "ts": T0 + 2 * s, "energy_kwh": 11.0}]
    got = {r.seq: r.quality for r in ingest.validate_telemetry(_rows(spark, rows), _machines(spark), now=NOW, chunk=2).collect()}
    assert got == {1: "GOOD", 2: "BAD", 3: "SUSPECT", 4: "GOOD"}


def test_stored_rows_seed_the_checks_and_win_over_copies(spark):
    stored = _rows(spark, [{"ts": T0, "energy_kwh": 100.0}])
    batch = _rows(spark, [{"seq": 5, "ts": T0}, {"seq": 6, "ts": T0 + dt.timedelta(seconds=1), "energy_kwh": 99.0}, {"seq": 7, "ts": T0 + dt.timedelta(seconds=1)}])
    fresh = ingest.first_arrivals(batch, stored)
    assert [r.seq for r in fresh.collect()] == [6]
    assert ingest.validate_telemetry(fresh, _machines(spark), now=NOW, stored=stored).first().quality == "BAD"
    assert ingest.duplicate_count(batch, stored).first().duplicate == 2


def test_production_rules(spark):
    rows = [(10.0, 9.0, 1.0), (10.0, 9.0, 1.5), (-1.0, 0.0, 0.0)]
    df = ingest.validate_production(spark.createDataFrame(rows, "qty_total_kg double, qty_good_kg double, qty_rejected_kg double"))
    assert [r.quality for r in df.collect()] == ["GOOD", "BAD", "BAD"]


def test_state_spans_leave_the_last_open(spark):
    m = dt.timedelta(minutes=1)
    rows = [{"seq": i, "ts": T0 + i * m, "machine_state": s} for i, s in enumerate(["idle", "idle", None, "running", "idle"])]
    got = [(r.state, r.ts_end) for r in ingest.machine_state_spans(_rows(spark, rows), chunk=2).orderBy("seq").collect()]
    assert got == [("idle", T0 + 3 * m), ("running", T0 + 4 * m), ("idle", None)]


@pytest.mark.parametrize("payload, reason", [
    ('{"ts":"2026-09-27T12:00:00+05:30","power_kw":5}', None), ('{"ts":"2026-09-27T12:00:00","power_kw":5}', "ts must be timezone-aware"),
    ('{"ts":"2026-09-27T12:00:00Z","power_kw":true}', "power_kw must be a number"), ('{"ts":"2026-09-27T12:00:00Z","rpm":"5"}', "rpm must be a number"),
    ('{"ts":"2026-09-27T12:00:00Z","power_kw":null}', None), ('{"ts":5}', "ts missing or not a timestamp"), ("{", "payload is not UTF-8 JSON"),
    ('"x"', "payload must be a JSON object or {'records': [objects]}"), ('{"records":5}', "payload must be a JSON object or {'records': [objects]}"),
    ('{"records":[{"ts":"2026-09-27T12:00:00Z"},{"ts":"2026-09-27T12:00:00Z","nope":1}]}', "unknown field(s)"),
    ('{"ts":"2026-09-27T12:00:00Z","machine_id":"x"}', "payload machine_id does not match topic")])
def test_message_checks(spark, payload, reason):
    df = spark.createDataFrame([("plant/s/m/telemetry", payload)], "topic string, payload string")
    assert messages.parse_messages(df).first().reason == reason


def test_list_of_records_becomes_rows(spark):
    p = '{"records":[{"ts":"2026-09-27T12:00:00Z","power_kw":1.5},{"ts":"2026-09-27T12:05:00Z","source":"SIMULATED"}]}'
    df = spark.createDataFrame([("plant/s/m/telemetry", p)], "topic string, payload string")
    got = messages.good_telemetry(messages.parse_messages(df)).orderBy("ts").collect()
    assert [(r.power_kw, r.source) for r in got] == [(1.5, "MEASURED"), (None, "SIMULATED")]


def test_registers_word_and_byte_orders(spark):
    R = registers.Register
    specs = (R("a", 0, "float32"), R("b", 2, "float32", word_order="little"), R("c", 4, "float32", byte_order="little"), R("d", 6, "int32"),
             R("e", 8, "uint16", 0.1), R("f", 9, "int16", 0.001, minimum=0, maximum=1), R("g", 10, "uint32", 0.001, word_order="little"), R("h", 30, "uint16"))
    regs = [0x42F6, 0xE979, 0xE979, 0x42F6, 0xF642, 0x79E9, 0xFFFF, 0xFFFE, 4150, 1200, 0x5678, 0x1234]
    df = spark.createDataFrame([("d", 1, i, r) for i, r in enumerate(regs)], "device string, poll long, address int, reg long")
    got = {r.field: (r.value, r.issue) for r in registers.decode_registers(df, specs).collect()}
    assert all(got[f][0] == pytest.approx(123.456, abs=1e-5) for f in "abc")
    assert got["d"][0] == -2.0 and got["e"][0] == 415.0 and got["g"][0] == pytest.approx(305419.896)
    assert got["f"] == (None, "outside plausible range") and got["h"] == (None, "register 30 not read")


def test_keyed_writes(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    old = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert [r.k for r in store.insert_ignore(new, old, ["k"]).collect()] == ["a"]
    again = store.insert_counts(new, old.unionByName(new), ["k"]).first()
    assert (again.created, again.already_existing) == (0, 2)
    got = {r.k: r.v for r in store.upsert_where(new, old, ["k"], F.col("v") < 5).collect()}
    assert got == {"a": 1, "b": 9, "c": 3}
