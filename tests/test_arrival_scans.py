import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattloom.functions import scan
from wattloom.operators import ingest
from wattloom.plans import common
from wattloom.sources import canonical

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def _nodes(df, *starts):
    """How often operators of these names stand in the plan, whatever adaptive execution makes of it."""
    lines = [x.lstrip(" +-:*(0123456789)") for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    return sum(x.startswith(starts) for x in lines)


def _arrivals(spark, n=900, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(["m", "m", "n"]), T0 + dt.timedelta(seconds=rng.randrange(4 * n) if rng.random() < 0.2 else 4 * i), i,
             None if rng.random() < 0.1 else float(rng.randrange(50) + i)) for i in range(n)]
    return rows, spark.createDataFrame(random.Random(1).sample(rows, n), "machine_id string, ts timestamp, seq long, energy_kwh double")


def _plain(rows, seed):
    top, high, out = {}, {}, {}
    for m, (ts, kwh) in seed.items():
        top[m], high[m] = ts, kwh
    for m, ts, seq, kwh in sorted(rows, key=lambda r: r[2]):
        in_order = top.get(m) is None or ts > top[m]
        out[seq] = (top.get(m), in_order, high.get(m))
        top[m] = max(ts, top.get(m) or ts)
        if in_order and kwh is not None:
            high[m] = max(kwh, high.get(m) or kwh)
    return out


@pytest.mark.parametrize("seed", [{}, {"m": (T0 + dt.timedelta(seconds=333), 120.0)}])
def test_arrival_state_is_that_of_a_plain_scan_and_needs_no_join_of_the_rows(spark, seed):
    rows, df = _arrivals(spark)
    stored = spark.createDataFrame([(m, ts, kwh) for m, (ts, kwh) in seed.items()], "machine_id string, ts timestamp, energy_kwh double") if seed else None
    df = df.unionByName(spark.createDataFrame([(None, T0, 5, 1.0), ("m", T0, None, 1.0)], df.schema))  # neither machine nor place: left out
    out = ingest.with_arrival_state(df, stored, chunk=70)
    assert out.columns == ["machine_id", "ts", "seq", "energy_kwh", "last_ts", "in_order", "last_energy"]
    got = {r.seq: (r.last_ts, r.in_order, r.last_energy) for r in out.collect()}
    assert got == _plain(rows, seed)
    assert seed or _nodes(ingest.with_arrival_state(df, chunk=70), "SortMergeJoin", "BroadcastHashJoin") == 0


def test_a_scan_sorts_its_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("seq"), (F.col("id") % 7).alias("chunk"), F.col("id").alias("v"))
        for out in (scan.running_sum(df, ["key"], "chunk", ["seq"], "v", "o"), scan.previous_max(df, ["key"], "chunk", ["seq"], "v", "o")):
            assert _nodes(out, "Sort [") == 3  # the rows; the chunks for their window and for the join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_arrivals_are_the_same_with_and_without_stored_readings(spark):
    near = ingest.first_arrivals(canonical.readings(spark, SF, "_chunk"), within=("_chunk",))
    far = ingest.first_arrivals(canonical.readings(spark, SF))
    assert near.columns == far.columns and near.exceptAll(far).isEmpty() and far.exceptAll(near).isEmpty()
    assert _nodes(near, "Exchange hashpartitioning(machine_id") < _nodes(far, "Exchange hashpartitioning(machine_id")
    common.forget_plants()
    p = common.plant(spark, SF)
    p.unique()
    assert "readings" not in p._stages  # one writing of the rows less
    assert p.unique().exceptAll(far).isEmpty()
    common.forget_plants()
