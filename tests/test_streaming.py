import datetime as dt

from pyspark.sql import functions as F

from wattloom.operators import ingest, intervals
from wattloom.sources import canonical
from wattloom.streaming import ingest as T

T0 = dt.datetime(2024, 1, 1)
COLS = [c.split()[0] for c in T.READING_SCHEMA.split(", ")]


def _land(spark, path, rows):
    """rows: (machine, minute, seq, energy, state); one file."""
    data = [{"machine_id": m, "ts": T0 + dt.timedelta(minutes=t), "seq": q, "energy_kwh": e, "machine_state": s, "power_kw": 5.0, "source": "MEASURED"} for m, t, q, e, s in rows]
    spark.createDataFrame([tuple(d.get(c) for c in COLS) for d in data], T.READING_SCHEMA).coalesce(1).write.mode("append").parquet(path)


PARTS = [[("m", 0, 1, 10.0, "idle"), ("m", 5, 3, 11.0, "idle"), ("m", 5, 2, 10.5, "idle"), ("n", 0, 4, 1.0, None)],
         [("m", 0, 6, 99.0, "x"), ("m", 10, 5, 10.2, "melting"), ("m", 3, 7, 10.2, "idle")],  # an old copy, a falling counter, a late first reading
         [("n", 0, 9, 7.0, "x"), ("n", 1500, 8, 2.0, "idle")],
         [("m", 2, 10, 3.0, "idle"), ("m", 1501, 11, 12.0, "idle"), ("m", 1501, 12, 13.0, "idle")],  # two days late, and a copy within one part
         [("m", 1501, 14, 13.0, "idle"), ("n", 1500, 13, 5.0, "x")]]  # nothing new


def test_validation_inserts_first_arrivals_over_epochs(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    machines = spark.createDataFrame([("m", 100.0), ("n", 1.0)], "machine_id string, rated_power_kw double")
    seen = []
    for part in PARTS:  # the stream stops and starts again from its checkpoint between parts
        _land(spark, src, part)
        seen += part
        T.run_to_end(T.stream_validate(T.read_files(spark, src, T.READING_SCHEMA), machines, out, f"{tmp_path}/s", f"{tmp_path}/c", now=canonical.END, backfill=True, insert=True))
    stored, top, kwh, want = set(), {}, {}, {}
    for part in PARTS:  # one by one in order of arrival
        for m, t, q, e, _ in sorted(part, key=lambda r: r[2]):
            if (m, t) in stored:
                continue
            stored.add((m, t))
            in_order = m not in top or t > top[m]
            bad = in_order and e < kwh.get(m, e)
            reasons = [ingest.COUNTER_REASON] * bad + [ingest.ORDER_REASON] * (not in_order) + ["SUSPECT: power spike above 1.5x rated power"] * (m == "n")
            want[q] = ("BAD" if bad else "SUSPECT" if reasons else "GOOD", reasons)
            if in_order:
                top[m], kwh[m] = t, max(e, kwh.get(m, e))
    got = {r.seq: (r.quality, r.quality_reasons) for r in spark.read.parquet(out).collect()}
    assert got == want and {q for q, (v, _) in want.items() if v == "BAD"} == {5}
    assert spark.read.parquet(out).agg(F.max("epoch")).first()[0] == 3  # the last part stored nothing
    assert sorted(f.name for f in (tmp_path / "s").iterdir()) == ["turn=0", "turn=1"]


def test_validation_scans_a_batch_once(spark, tmp_path, monkeypatch):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    machines = spark.createDataFrame([("m", 100.0)], "machine_id string, rated_power_kw double")
    written, keep = [], T._write_state
    monkeypatch.setattr(T, "_write_state", lambda df, path, epoch: written.append((epoch, sum("epoch=" + str(epoch) == p.name for p in (tmp_path / "out").glob("day=*/*")))) or keep(df, path, epoch))
    for part in PARTS[:3]:
        _land(spark, src, part)
        T.run_to_end(T.stream_validate(T.read_files(spark, src, T.READING_SCHEMA), machines, out, f"{tmp_path}/s", f"{tmp_path}/c", now=canonical.END, backfill=True, insert=True))
    assert written == [(0, 0), (1, 0), (2, 0)]  # nothing of the epoch lies in ``out`` yet, so the scanned rows are still cached


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    out, keys = f"{tmp_path}/out", "machine_id string, ts timestamp"
    rows = spark.createDataFrame([("m", T0), ("m", T0 + dt.timedelta(days=1)), ("m", T0 + dt.timedelta(days=9))], keys)
    for epoch, n in ((0, 1), (1, 2), (2, 3)):
        rows.where(F.dayofmonth("ts") == (1, 2, 10)[n - 1]).withColumns({"day": F.to_date("ts"), "epoch": F.lit(epoch).cast("long")}).write.mode("append").partitionBy("day", "epoch").parquet(out)
    assert T.stored_keys(rows, out, 0) is None
    assert T.stored_keys(rows, out, 2).count() == 2  # what the replayed epoch itself had written is not known to it
    plan = T.stored_keys(rows.limit(1), out, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_dedup_keeps_the_first_arrival_not_stored(spark, tmp_path):
    src, stored = f"{tmp_path}/in", spark.createDataFrame([("n", T0)], "machine_id string, ts timestamp")
    for part in [*PARTS, [("end", 9000, 99, None, None)]]:
        _land(spark, src, part)
        T.run_to_end(T.stream_dedup(T.read_files(spark, src, T.READING_SCHEMA), stored, "2 days").writeStream.outputMode("append").format("parquet")
                     .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c"))
    rows = [r for part in PARTS for r in part]
    first = {}
    for m, t, q, *_ in rows:
        if (m, t) != ("n", 0):
            first[m, t] = min(q, first.get((m, t), q))
    got = spark.read.parquet(f"{tmp_path}/out").where("machine_id <> 'end'").collect()
    assert sorted(r.seq for r in got) == sorted(first.values()) and {r.energy_kwh for r in got if r.seq == 2} == {10.5}


def test_stream_intervals_have_the_batch_columns(spark, tmp_path):
    tel = "machine_id string, ts timestamp, quality string, energy_kwh double, power_kw double, power_factor double, machine_state string"
    row = lambda m, t, e, s="idle", q="GOOD": (m, T0 + dt.timedelta(minutes=t), q, e, 4.0, 0.9, s)
    rows = [row("f", 1, 10.0), row("f", 59, 12.0, "melting"), row("f", 30, 99.0, q="BAD"), row("f", 61, None, None), row("g", 5, 1.0)]
    made = [("f", T0, 50.0, 1.0, "GOOD"), ("f", T0 + dt.timedelta(hours=3), 7.0, 0.0, "GOOD"), ("g", T0, 9.0, 0.0, "BAD")]
    end = T0 + dt.timedelta(days=2)
    machines = spark.createDataFrame([("f", "furnace", 200.0), ("g", "pump", 100.0)], "machine_id string, machine_type string, rated_power_kw double")
    for k, part in enumerate([rows[:3], rows[3:], [("end", end, "GOOD", None, None, None, None)]]):
        spark.createDataFrame(part, tel).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
        spark.createDataFrame([made, [], [("end", end, 0.0, 0.0, "GOOD")]][k], T.PRODUCTION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        T.run_to_end(T.stream_intervals(T.read_files(spark, f"{tmp_path}/r", tel), T.read_files(spark, f"{tmp_path}/p", T.PRODUCTION_SCHEMA), machines)
                     .writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c"))
    batch = intervals.build_intervals(spark.createDataFrame(rows, tel), spark.createDataFrame(made, T.PRODUCTION_SCHEMA), machines,
                                      start="2024-01-01 00:00:00", end="2024-01-01 05:00:00")
    want = batch.where("has_production_record OR n_good + n_bad > 0")
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.drop("k").columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("k").collect())) and got.count() == 4


def _scored_intervals(n):
    """(machine, k, complete, energy, hours_idle, good kg, power, pf) with long runs, gaps and odd rows; a plain rule, no random numbers."""
    rows = []
    for m in range(3):
        for k in range(n):
            if (k * 7 + m) % 19 == 0:
                continue  # nothing came up in this window
            hot = 3 * m + 8 < k % 40 < 26 or (k * 13 + m) % 17 == 0
            energy = 10.0 + ((k * k + m) % 7) * 0.3 + (9.0 if hot else 0.0)
            rows.append((f"m{m}", k, (k + m) % 11 != 0, None if (k + 2 * m) % 23 == 0 else energy, 1.0 if k % 30 > 20 else 0.2,
                         0.0 if k % 30 > 18 else 5.0, 140.0 if k % 13 == 5 else 50.0, 0.5 if k % 29 < 3 else 0.9))
    return rows


def test_detection_over_epochs_equals_the_batch(spark, tmp_path):
    from wattloom.operators import anomaly, baseline
    from wattloom.operators.intervals import HOUR_COLUMNS
    n, src = 160, f"{tmp_path}/in"
    hours = [c for c in HOUR_COLUMNS if c not in ("hours_idle", "hours_running")]
    raw = spark.createDataFrame(_scored_intervals(n), "machine_id string, k long, complete boolean, energy_kwh double, hours_idle double, good_production_kg double, power_max_kw double, pf_mean double")
    at = F.lit(T0) + F.make_interval(hours=F.col("k").cast("int"))
    rows = raw.withColumns({"machine_type": F.lit("furnace"), "rated_power_kw": F.lit(100.0), "window_start": at, "window_end": at + F.expr("INTERVAL '1' HOUR"),
                            "hours_running": 1.0 - F.col("hours_idle"), "has_production_record": F.lit(True), **{c: F.lit(0.0) for c in hours}}).persist()
    base = spark.createDataFrame([("m0", {"hours_idle": 1.0}, 10.0), ("m1", {"hours_idle": 1.0}, 10.0)], "machine_id string, coefficients map<string,double>, intercept double")
    # one interval, then many, an epoch without rows of m1, a long one, and rows that were judged before
    parts = ["k < 1", "k >= 1 AND k < 60", "k >= 60 AND k < 62 AND machine_id <> 'm1'", "k >= 62 AND k < 63 OR k >= 60 AND k < 63 AND machine_id = 'm1'",
             "k >= 63", "k = 100 AND machine_id = 'm0'"]
    for part in parts:
        rows.where(part).drop("k").coalesce(1).write.mode("append").parquet(src)
        stream = T.read_files(spark, src, rows.drop("k").schema)
        T.run_to_end(T.stream_detect(stream, base, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/c"))
    dense = spark.range(n).select(F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("machine_id"), F.col("id").alias("k")).join(rows, ["machine_id", "k"], "left")
    batch = anomaly.detect_events(baseline.score_intervals(dense.withColumn("complete", F.coalesce("complete", F.lit(False))), base))
    got = T.detected_events(spark, f"{tmp_path}/out", f"{tmp_path}/state", len(parts) - 1)
    keys = ["dedup_key", "evidence", "severity", "n_intervals", "window_end"]

    def texts(df):
        return sorted(str((*[r[c] for c in keys], *[None if r[c] is None else round(r[c], 6) for c in ("score", "expected_kwh", "actual_kwh", "deviation_kwh", "deviation_pct")])) for r in df.collect())
    assert texts(got) == texts(batch) and {r.rule_id for r in got.collect()} == {"L1_DEVIATION", "L1_IDLE_WASTE", "L1_POWER", "L1_POWER_FACTOR", "L2_MAD_RESIDUAL"}
    assert spark.read.parquet(f"{tmp_path}/out/late").count() == 1
    state = spark.read.parquet(f"{tmp_path}/state/progress/turn=1")
    assert state.count() == 2 and state.agg(F.max(F.size("trailing"))).first()[0] == 24
    rows.unpersist()


def _detected(spark, path, ranges, coefficients, hot=range(0)):
    """Events after one epoch for each range of hours of one machine; the given hours use four times the energy expected."""
    from wattloom.operators.intervals import HOUR_COLUMNS
    schema = ("machine_id string, machine_type string, rated_power_kw double, window_start timestamp, window_end timestamp, complete boolean, energy_kwh double, "
              f"{', '.join(f'{c} double' for c in HOUR_COLUMNS)}, good_production_kg double, has_production_record boolean, power_max_kw double, pf_mean double")
    base = spark.createDataFrame(coefficients, "machine_id string, coefficients map<string,double>, intercept double")
    for ks in ranges:
        rows = [("m", "furnace", 100.0, T0 + dt.timedelta(hours=k), T0 + dt.timedelta(hours=k + 1), True, 40.0 if k in hot else 10.0,
                 *[1.0 if c == "hours_melting" else 0.0 for c in HOUR_COLUMNS], 5.0, True, 50.0, 0.9) for k in ks]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        T.run_to_end(T.stream_detect(T.read_files(spark, f"{path}/in", schema), base, f"{path}/out", f"{path}/state", f"{path}/c"))
    last = T.last_epoch(spark, f"{path}/state")
    return last, T.detected_events(spark, f"{path}/out", f"{path}/state", last).collect()


def test_epochs_that_close_no_event_count(spark, tmp_path):
    # no baseline, so no event at all
    assert _detected(spark, tmp_path / "a", [range(3), range(3, 6)], [("other", {"hours_idle": 1.0}, 10.0)]) == (1, [])
    # one event closes in the first epoch; another begins in the second and grows in the third, which close none
    last, got = _detected(spark, tmp_path / "b", [range(0, 12), range(12, 16), range(16, 18)], [("m", {"hours_idle": 1.0}, 10.0)], hot={*range(4, 8), *range(13, 18)})
    ends = {(r.rule_id, r.window_end) for r in got}
    assert last == 2 and spark.read.parquet(str(tmp_path / "b/out/closed")).agg(F.max("epoch")).first()[0] == 0
    assert ("L1_DEVIATION", T0 + dt.timedelta(hours=18)) in ends and ("L1_DEVIATION", T0 + dt.timedelta(hours=8)) in ends


def test_state_that_does_not_grow_has_few_partitions(spark, tmp_path):
    tel = "machine_id string, ts timestamp, quality string, energy_kwh double, power_kw double, power_factor double, machine_state string"
    machines = spark.createDataFrame([("f", "furnace", 200.0)], "machine_id string, machine_type string, rated_power_kw double")
    spark.createDataFrame([("f", T0, "GOOD", 1.0, 4.0, 0.9, "idle")], tel).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([("f", T0, 50.0, 1.0, "GOOD")], T.PRODUCTION_SCHEMA).write.parquet(f"{tmp_path}/p")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        found = T.stream_intervals(T.read_files(spark, f"{tmp_path}/r", tel), T.read_files(spark, f"{tmp_path}/p", T.PRODUCTION_SCHEMA), machines)
        T.run_to_end(small=[found.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")])
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert {len([d for d in op.iterdir() if d.name.isdigit()]) for op in (tmp_path / "c/state").iterdir()} == {T.SMALL_STATE}


def test_ingest_parses_a_batch_once_and_holds_none_in_memory(spark, tmp_path, monkeypatch):
    one = '{"ts":"2024-01-01T00:00:00+00:00","power_kw":%d}'
    tel = "plant/s/%s/telemetry"
    parts = [[(1, tel % "m", one % 1), (2, tel % "x", one % 2), (3, tel % "m", "not json{"), (4, "plant/s/x", one % 4)],
             [(5, tel % "m", "[1,2]")],  # nothing to accept
             [(6, tel % "m", '{"records":[%s,%s]}' % (one % 6, one % 7)), (7, tel % "x", '{"ts":"yesterday"}'),
              (8, "plant/s/production", '{"machine_id":"m","window_start":"2024-01-01T00:00:00Z","window_end":"2024-01-01T01:00:00Z","qty_total_kg":1,"qty_good_kg":1,"qty_rejected_kg":0}')]]
    machines, plans, keep = spark.createDataFrame([("m",)], "machine_id string"), [], T.messages.good_telemetry
    monkeypatch.setattr(T.messages, "good_telemetry", lambda df: plans.append(df._jdf.queryExecution().withCachedData().toString()) or keep(df))

    def run():
        T.run_to_end(T.stream_ingest(T.read_files(spark, f"{tmp_path}/in", T.MESSAGE_SCHEMA), machines, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/c"))
        good, dead = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/dead")
        return (sorted((r.epoch, r.seq, r.machine_id, r.ts, r.power_kw, r.source) for r in good.collect()), sorted((r.epoch, r.seq, r.topic or "", r.reason) for r in dead.collect()))
    for part in parts:
        spark.createDataFrame(part, T.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run()
    assert got[0] == [(e, q, "m", T0, kw, "MEASURED") for e, q, kw in ((0, 1, 1.0), (2, 6, 6.0), (2, 6, 7.0))]
    assert got[1] == [(0, 2, "", "unknown machine_id"), (0, 3, tel % "m", "payload is not UTF-8 JSON"), (0, 4, "plant/s/x", "unsupported topic"),
                      (1, 5, tel % "m", "payload must be a JSON object or {'records': [objects]}"), (2, 7, tel % "x", "ts is not ISO-8601")]
    for f in (tmp_path / "c/commits").glob("*2*"):  # as if the last epoch had stopped before its end
        f.unlink()
    assert run() == got and len(plans) == 4
    assert not [p for p in plans if "InMemoryRelation" in p or "parse_json" in p.lower()]
