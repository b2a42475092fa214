import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wattloom.operators import ingest, reads, schedule
from wattloom.plans import common
from wattloom.sources import canonical
from wattloom.streaming import ingest as T

SF = "/root/testdata/sf0.001"
SAMPLE = ["validate_telemetry", "build_intervals", "detect_events", "daily_metrics", "score_health", "correlate", "evaluate_schedule", "generate_recommendations",
          "verify_savings", "heat_sessions", "read_meter_csv"]


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_gives_events(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "dedup_key" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(rel.columns)
    want = sorted(str([row[rel.columns.index(c)] for c in cols]) for row in rel.fetchall())
    got = sorted(str([row[c] for c in cols]) for row in entry.queries()[name](spark, SF).collect())
    assert got == want


def test_changed_inputs_make_new_stages(spark, tmp_path):
    for t in common.INPUTS:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(40).write.parquet(f"{tmp_path}/{t}.parquet")
    first = common.plant(spark, str(tmp_path))
    assert common.plant(spark, str(tmp_path)) is first
    spark.read.parquet(f"{SF}/events.parquet").limit(5).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert common.plant(spark, str(tmp_path)) is not first


def test_no_size_steers_the_interval(spark):
    assert common.plant(spark, SF).interval_s == common.plant(spark, "/root/testdata/sf0.01").interval_s == canonical.INTERVAL_S


def test_limits_are_not_cut(spark):
    df = spark.range(12000).selectExpr("'m' AS machine_id", "timestamp_seconds(id) AS ts")
    assert reads.recent(df, "ts", limit=11000).count() == 11000 and reads.recent(df, "ts").count() == 1000
    with pytest.raises(ValueError):
        reads.recent(df, "ts", limit=0)


def test_plans_without_a_state_power_have_no_price(spark):
    from test_schedule import _model, _powers, _tariff
    slots = spark.createDataFrame([("p", "f", None, 0, "idle", 0.0, 0.0)], "plan_id string, machine_id string, day date, slot int, state string, aux_kw double, melt_kg double")
    heats = spark.createDataFrame([], "plan_id string, charge_kg double, reheat_slots int")
    tariff = _tariff(spark, [("all", 0, 1440, 5.0)])
    run = lambda pw: schedule.evaluate_schedule(slots, heats, _model(spark), pw, tariff, site_id="s", interval_s=3600).first()
    none = run(_powers(spark).where("machine_state <> 'idle'"))
    assert none.peak_kw is None and none.cost_inr is None and none.energy_kwh is not None


def test_unplaced_plans_are_told(spark):
    plans = spark.createDataFrame([("a",), ("b",), ("c",)], "plan_id string")
    heat = lambda ids: spark.createDataFrame([(i,) for i in ids], "plan_id string")
    got = {r.plan_id: r.status for r in schedule.shift_status(plans, heat("aab"), heat("aa")).collect()}
    assert got == {"a": "SHIFTED", "b": "INFEASIBLE", "c": "EMPTY"}


def test_stages_go_to_the_session_folder(spark):
    p = common.plant(spark, SF)
    assert p.root.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_streams_in_several_batches_equal_the_batch(spark, tmp_path):
    machines = canonical.machines(spark)
    unique = ingest.first_arrivals(canonical.readings(spark, SF))
    cols = [c.split()[0] for c in T.READING_SCHEMA.split(", ")]
    top = unique.agg(F.max("seq")).first()[0]
    src = f"{tmp_path}/in"
    for i in range(3):  # one file per append, so the order of files is the order of arrival
        part = unique.where((F.col("seq") > top * i / 3 - (1 if i == 0 else 0)) & (F.col("seq") <= top * (i + 1) / 3)).select(*cols)
        part.coalesce(1).write.mode("append").parquet(src)
    stream = lambda: T.read_files(spark, src, T.READING_SCHEMA, max_files=1)
    T.run_to_end(T.stream_validate(stream(), machines, f"{tmp_path}/v", f"{tmp_path}/vs", f"{tmp_path}/vc", now=canonical.END, backfill=True))
    want = ingest.validate_telemetry(unique, machines, now=canonical.END, backfill=True)
    key = lambda df: sorted((r.seq, r.quality, tuple(r.quality_reasons)) for r in df.select("seq", "quality", "quality_reasons").collect())
    assert key(spark.read.parquet(f"{tmp_path}/v")) == key(want)
    T.run_to_end(T.stream_validate(stream(), machines, f"{tmp_path}/live", f"{tmp_path}/ls", f"{tmp_path}/lc", now=canonical.END))  # a live stream tells stale rows
    assert key(spark.read.parquet(f"{tmp_path}/live")) == key(ingest.validate_telemetry(unique, machines, now=canonical.END, backfill=False)) != key(want)
    assert spark.read.parquet(f"{tmp_path}/v").select("epoch").distinct().count() == 3
    T.run_to_end(T.stream_state_spans(stream(), f"{tmp_path}/s", f"{tmp_path}/ss", f"{tmp_path}/sc"))
    spans = lambda df: sorted((r.machine_id, r.state, r.ts_start, r.ts_end) for r in df.where("ts_end is not null").collect())
    assert spans(spark.read.parquet(f"{tmp_path}/s")) == spans(ingest.machine_state_spans(unique))
