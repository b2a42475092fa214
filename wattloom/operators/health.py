"""Machine health: robust reference per state and signal, scores with contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions.columns import py_round

IV_KEY = ["machine_id", "k"]


def state_bucket(state: Column) -> Column:
    return F.when(state.isNull() | (F.trim(state) == ""), "unknown").otherwise(F.lower(state))


def to_signals(intervals: DataFrame) -> DataFrame:
    """One row per interval and present signal, with the state bucket and the signal's rank."""
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("signal"), F.col(s).alias("value"))
                      for i, s in enumerate(C.HEALTH_SIGNALS)])
    return (intervals.select("machine_id", "k", "complete", state_bucket(F.col("machine_state")).alias("bucket"), F.explode(pairs).alias("s"))
            .select("machine_id", "k", "complete", "bucket", "s.*").where(F.col("value").isNotNull()))


def fit_health_reference(intervals: DataFrame) -> DataFrame:
    """Median, MAD and n per (machine, bucket, signal) over complete intervals, plus n_intervals."""
    rows = to_signals(intervals.where("complete"))
    med = rows.groupBy("machine_id", "bucket", "signal").agg(F.median("value").alias("median"), F.count("*").alias("n"))
    mad = (rows.join(med, ["machine_id", "bucket", "signal"]).groupBy("machine_id", "bucket", "signal", "median", "n")
           .agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad")))
    any_signal = F.coalesce(*[F.col(s) for s in C.HEALTH_SIGNALS]).isNotNull()
    n = intervals.where(F.col("complete") & any_signal).groupBy("machine_id").agg(F.count("*").alias("n_intervals"))
    return mad.join(n, "machine_id")


def robust_z(value: Column, med: Column, mad: Column, floor_frac: float = C.HEALTH_MAD_FLOOR_FRAC,
             epsilon: float = C.HEALTH_MAD_EPSILON) -> Column:
    return (value - med) * 0.6745 / F.greatest(mad, F.abs(med) * floor_frac, F.lit(epsilon))


def signal_contributions(intervals: DataFrame, reference: DataFrame, min_rows: int = C.HEALTH_MIN_BUCKET_ROWS) -> DataFrame:
    """Per interval and usable signal: z, percent change and share of the total |z|."""
    ref = reference.where(F.col("n") >= min_rows).select("machine_id", "bucket", "signal", "median", "mad")
    df = to_signals(intervals).join(ref, ["machine_id", "bucket", "signal"])
    df = df.withColumns({
        "z": py_round(robust_z(F.col("value"), F.col("median"), F.col("mad")), 2),
        "pct_change": F.when(F.col("median") != 0, py_round((F.col("value") - F.col("median")) / F.abs("median") * 100.0, 1))})
    total = py_round(F.sum(F.abs("z")).over(Window.partitionBy(*IV_KEY)), 2)
    df = df.withColumn("_w", F.when(total > 0, py_round(F.abs("z") / total, 3)).otherwise(0.0)).withColumn("_total", total)
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*IV_KEY).orderBy(F.abs("z").desc(), "pos")))
    rest = F.sum(F.when(F.col("rank") > 1, F.col("_w")).otherwise(0.0)).over(Window.partitionBy(*IV_KEY))
    top = (F.col("rank") == 1) & (F.col("_total") > 0)
    return df.withColumn("weight", F.when(top, py_round(F.lit(1.0) - py_round(rest, 3), 3)).otherwise(F.col("_w"))).select(
        *IV_KEY, "bucket", "signal", "value", "median", "z", "pct_change", "weight", "rank")


def score_health(intervals: DataFrame, reference: DataFrame, *, model_id: str = C.HEALTH_MODEL_ID,
                 min_ref: int = C.HEALTH_MIN_REF_INTERVALS, min_rows: int = C.HEALTH_MIN_BUCKET_ROWS,
                 warn_z: float = C.HEALTH_WARN_Z, crit_z: float = C.HEALTH_CRIT_Z) -> DataFrame:
    """Score, state and status per interval; contributions as an array, largest |z| first."""
    c = signal_contributions(intervals, reference, min_rows)
    item = F.struct("rank", "signal", "z", "pct_change", "median", "value", "weight")
    per = c.groupBy(*IV_KEY).agg(F.max(F.abs("z")).alias("_a"), F.sort_array(F.collect_list(item)).alias("contributions"))
    known = reference.select("machine_id", "bucket").distinct().withColumn("_known", F.lit(True))
    refs = reference.select("machine_id", "n_intervals").distinct()
    df = (intervals.withColumn("bucket", state_bucket(F.col("machine_state"))).join(per, IV_KEY, "left")
          .join(known, ["machine_id", "bucket"], "left").join(refs, "machine_id", "left"))
    present = F.coalesce(*[F.col(s) for s in C.HEALTH_SIGNALS]).isNotNull()
    status = (F.when(F.coalesce("n_intervals", F.lit(0)) < min_ref, "INSUFFICIENT_HISTORY")
              .when(~F.col("complete"), "UNAVAILABLE").when(F.col("_known").isNull(), "OUT_OF_DOMAIN")
              .when(F.col("_a").isNull() & ~present, "UNAVAILABLE").when(F.col("_a").isNull(), "OUT_OF_DOMAIN").otherwise("OK"))
    ok = F.col("status") == "OK"
    df = df.withColumn("status", status)
    df = df.withColumn("anomaly_score", F.when(ok, py_round("_a", 2)))
    df = df.withColumns({
        "health_score": py_round(F.exp(-F.pow(F.col("anomaly_score") / crit_z, 2)) * 100.0, 1),
        "state": F.when(F.col("anomaly_score") >= crit_z, "CRITICAL").when(F.col("anomaly_score") >= warn_z, "WARNING").otherwise("NORMAL"),
        "model_id": F.lit(model_id)})
    no_rows = F.array().cast("array<struct<rank:int,signal:string,z:double,pct_change:double,median:double,value:double,weight:double>>")
    df = df.withColumn("contributions", F.coalesce("contributions", no_rows))
    return health_reason(df, min_ref).select(
        "machine_id", "machine_type", "k", "window_start", "window_end", "model_id", "bucket", "health_score", "anomaly_score", "state",
        "status", "reason", "contributions")


def health_reason(df: DataFrame, min_ref: int = C.HEALTH_MIN_REF_INTERVALS) -> DataFrame:
    """Plain-text reason from the status and the two largest contributions."""
    def bit(i):
        c = F.get("contributions", i)
        pct = F.when(c["pct_change"].isNotNull(), F.format_string(" (%+.1f%%)", c["pct_change"])).otherwise("")
        return F.when(c.isNotNull(), F.concat(c["signal"], F.lit(" z "), F.format_string("%+.1f", py_round(c["z"], 1)), pct))
    top = F.get("contributions", 0)["signal"]
    n = F.coalesce("n_intervals", F.lit(0)).cast("string")
    present = F.coalesce(*[F.col(s) for s in C.HEALTH_SIGNALS]).isNotNull()
    text = (F.when(F.col("status") == "INSUFFICIENT_HISTORY", F.concat(F.lit("reference has "), n, F.lit(f" interval(s), need >= {min_ref}")))
            .when(~F.col("complete"), "incomplete interval (telemetry coverage below minimum)")
            .when(F.col("_known").isNull(), F.concat(F.lit("state bucket '"), "bucket", F.lit("' not seen in reference")))
            .when(F.col("status") == "OUT_OF_DOMAIN", F.concat(F.lit("state bucket '"), "bucket", F.lit("' reference too thin")))
            .when(~present, "no health signals present in interval (vibration/temperature/current all null)")
            .when(F.col("state") == "NORMAL", F.concat(F.lit("max |z| "), F.format_string("%.1f", py_round("anomaly_score", 1)), F.lit(" ("), top,
                                                      F.lit(") within NORMAL range for '"), "bucket", F.lit("' reference")))
            .otherwise(F.concat("state", F.lit(": "), F.concat_ws(", ", bit(0), bit(1)), F.lit(" vs '"), "bucket", F.lit("' reference (health "),
                                F.format_string("%.0f", py_round("health_score", 0)), F.lit("/100)"))))
    return df.withColumn("reason", text)


def domain_guard(intervals: DataFrame, model_id: str, native: tuple[str, ...] = C.HEALTH_MODELS) -> DataFrame:
    """Rows of a model that was not made for these machines: OUT_OF_DOMAIN, never a score."""
    if model_id in native:
        raise ValueError(f"{model_id} scores these machines itself")
    return intervals.select(
        "machine_id", "window_start", "window_end", F.lit(model_id).alias("model_id"), F.lit(None).cast("double").alias("health_score"),
        F.lit(None).cast("double").alias("anomaly_score"), F.lit("NORMAL").alias("state"), F.lit("OUT_OF_DOMAIN").alias("status"))


def score_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("machine_id", "model_id").agg(
        F.count("*").alias("n_intervals"), F.count_if(F.col("state") == "WARNING").alias("n_warning"),
        F.count_if(F.col("state") == "CRITICAL").alias("n_critical"))


def latest_health(rows: DataFrame) -> DataFrame:
    return rows.groupBy("machine_id").agg(
        F.max_by(F.struct("window_start", "health_score", "anomaly_score", "state", "status"), "window_start").alias("_r")).select("machine_id", "_r.*")


def model_coverage(reference: DataFrame) -> DataFrame:
    """Machines that have a reference, per model: how many, the first and the last."""
    return reference.groupBy("model_id").agg(F.count_distinct("machine_id").alias("n_machines"), F.min("machine_id").alias("first_machine"),
                                             F.max("machine_id").alias("last_machine"))


def covered_machines(reference: DataFrame) -> DataFrame:
    """Every machine that has a reference, per model, one a row."""
    return reference.select("model_id", "machine_id").distinct()
