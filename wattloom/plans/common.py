"""Shared pieces of the registered queries: result shape, stage tables, SQL fragments."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import config as C
from wattloom.operators import anomaly, baseline, intervals
from wattloom.sources import canonical as S

DIGITS = 4
# Values with few decimals (means of prices, say) often end exactly half way at the last
# printed digit, where the order of a float sum decides. Both sides add the same nudge.
NUDGE = 1e-7


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Stable result types: longs, rounded doubles, zone-less timestamps, text for arrays."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = F.round(c.cast("double") + NUDGE, digits)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "; ")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: the session's checkpoint folder.

    A machine-local folder is only used when Spark itself runs on one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":  # not local-cluster
        return tempfile.mkdtemp(prefix="wattloom-stages-")
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


class Plant:
    """The plant's derived tables over one data folder.

    A stage that several others build on is written once as Parquet (columnar, survives
    lost executors, cuts lineage) and read back; the rest stay lazy plans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.interval_s = S.INTERVAL_S
        self.root = f"{stage_root(spark)}/wattloom-{uuid.uuid4().hex}"
        self._stages: dict[str, DataFrame] = {}
        self.marks: set[str] = set()  # streams that already ran to their end
        self.state: tuple = ()  # of the input tables when the plant was made

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._stages:
            path = f"{self.root}/{name}"
            df = build()
            df.write.mode("overwrite").parquet(path)
            self._stages[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._stages[name]

    # -- inputs ---------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return S.table(self.spark, self.sf_dir, name)

    @property
    def machines(self) -> DataFrame:
        return S.machines(self.spark)

    @property
    def sensors(self) -> DataFrame:
        return S.sensors(self.spark)

    @property
    def tariff(self) -> DataFrame:
        return S.tariff(self.spark)

    @property
    def factors(self) -> DataFrame:
        return S.emission_factors(self.spark)

    def readings(self) -> DataFrame:
        return self.stage("readings", lambda: S.readings(self.spark, self.sf_dir))

    # -- derived --------------------------------------------------------
    def telemetry(self) -> DataFrame:
        from wattloom.operators import ingest
        return self.stage("telemetry", lambda: ingest.validate_telemetry(self.unique(), self.machines, now=S.END, backfill=True))

    def unique(self) -> DataFrame:
        """First arrivals, written once: both ordered scans of the validation read it again.

        Readings not yet written are made here and lie together by machine and hour, so equal keys need no shuffle of their own.
        """
        from wattloom.operators import ingest
        if "readings" in self._stages:
            return self.stage("unique", lambda: ingest.first_arrivals(self.readings()))
        return self.stage("unique", lambda: ingest.first_arrivals(S.readings(self.spark, self.sf_dir, "_chunk"), within=("_chunk",)))

    def production(self) -> DataFrame:
        from wattloom.operators import ingest
        return self.stage("production", lambda: ingest.validate_production(
            S.production(self.spark, self.sf_dir, self.interval_s)))

    def intervals(self) -> DataFrame:
        return self.stage("intervals", lambda: intervals.build_intervals(
            self.telemetry(), self.production(), self.machines, start=S.START, end=S.END, interval_s=self.interval_s))

    def baselines(self) -> DataFrame:
        return self.stage("baselines", lambda: stored_baselines(self.intervals()))

    def scored(self) -> DataFrame:
        return self.stage("scored", lambda: baseline.score_intervals(self.intervals(), self.baselines()))

    def events(self) -> DataFrame:
        return self.stage("events", lambda: anomaly.detect_events(self.scored()))


def stored_baselines(iv: DataFrame) -> DataFrame:
    """Baseline rows as found in the store: plain rates over the training days.

    Stands in for the fitted table where a query is compared with SQL (the fit itself
    is a query of its own): energy per kg and per hour from training totals.
    """
    train = iv.where(F.col("complete") & (F.col("window_start") < F.lit(S.TRAIN_END).cast("timestamp")))
    hours = F.sum(F.col("hours_heating") + F.col("hours_melting") + F.col("hours_holding") + F.col("hours_idle"))
    kg = F.sum(F.coalesce("good_production_kg", F.lit(0.0)))
    t = train.groupBy("machine_id", "machine_type").agg(F.sum("energy_kwh").alias("e"), hours.alias("h"), kg.alias("kg"))
    furnace = F.col("machine_type") == "furnace"
    per_h = F.try_divide("e", "h")
    coefs = F.when(furnace, F.create_map(
        F.lit("good_production_kg"), F.try_divide(F.col("e") * 0.25, F.col("kg")), F.lit("hours_heating"), per_h * 0.9,
        F.lit("hours_holding"), per_h * 0.8, F.lit("hours_idle"), per_h * 0.85)).otherwise(F.create_map(
            F.lit("hours_heating"), per_h * 0.95, F.lit("hours_melting"), per_h,
            F.lit("hours_holding"), per_h * 0.9, F.lit("hours_idle"), per_h * 0.92))
    return t.select("machine_id", "machine_type", baseline.features_for(F.col("machine_type")).alias("features"),
                    coefs.alias("coefficients"), F.lit(1.0).alias("intercept"),
                    F.lit(S.START).cast("timestamp").alias("train_start"), F.lit(S.TRAIN_END).cast("timestamp").alias("train_end"),
                    F.lit("ACCEPTABLE").alias("acceptance"), F.lit(S.TRAIN_END).cast("timestamp").alias("created_at"))


_PLANTS: dict[tuple[str, str], Plant] = {}
INPUTS = ("events", "lineitem", "customer")


def prepare(spark: SparkSession) -> None:
    """UTC times; on one machine also as many shuffle partitions as cores where the default stands."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))


def _state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Change time, size and number of files of a table, from the store's own listing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return (0, 0, 0)
    size = fs.getContentSummary(at)
    return fs.getFileStatus(at).getModificationTime(), size.getLength(), size.getFileCount()


def plant(spark: SparkSession, sf_dir: str) -> Plant:
    """The plant over a folder; a changed input table gives a new one, so no stage answers for old files."""
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    state = tuple(_state_of(spark, f"{sf_dir}/{t}.parquet") for t in INPUTS)
    if key not in _PLANTS or _PLANTS[key].state != state:
        _PLANTS[key] = Plant(spark, sf_dir)
        _PLANTS[key].state = state
    return _PLANTS[key]


def forget_plants() -> None:
    """Drops memoised stages, so that a timing covers the whole job."""
    _PLANTS.clear()


# -- registry ---------------------------------------------------------------
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    """Names a SQL sub-select that other SQL may use as a table."""
    FRAGMENTS[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [n for n in FRAGMENTS if n in words]


def compose(sql: str) -> str:
    """Prefixes the WITH list of every fragment the statement uses."""
    order: list[str] = []

    def visit(name: str, trail: tuple[str, ...]):
        if name in order or name in trail:
            return
        for dep in _needs(FRAGMENTS[name]):
            if dep != name:
                visit(dep, (*trail, name))
        order.append(name)
    for n in _needs(sql):
        visit(n, ())
    if not order:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in order) + "\n" + sql.strip()


def query(name: str, sql: str | None = None):
    """Registers a builder ``(Plant) -> DataFrame`` and, if there is one, its SQL."""
    def wrap(build: Callable[[Plant], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(build(plant(spark, sf_dir)))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build
    return wrap


def _nudged(sql: str) -> str:
    """``round(x, 4)`` as ``round(x + 1e-7, 4) + 0.0`` (no half-way ties, no negative zero)."""
    out, at = [], 0
    for m in re.finditer(r"(?<![a-z_])round\(", sql):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        body = sql[m.end():i - 1]
        if body.endswith(", 4"):
            out.append(f"{sql[at:m.start()]}(round({body[:-3]} + 1e-7, 4) + 0.0)")
            at = i
    return "".join([*out, sql[at:]])


def oracle_statements() -> dict[str, str]:
    return {k: _nudged(compose(v)) for k, v in ORACLE.items()}


__all__ = ["C", "F", "FRAGMENTS", "ORACLE", "Plant", "QUERIES", "S", "compose", "forget_plants", "fragment",
           "oracle_statements", "plant", "present", "query", "stage_root", "stored_baselines"]
