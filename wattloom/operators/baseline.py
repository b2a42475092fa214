"""Expected energy: non-negative least squares on production and state hours.

Spark sums the products (the Gram matrix) per machine; only those few numbers per
machine reach Python, where a small active-set solver finds the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import config as C
from wattloom.functions import scan

FEATURES = ["good_production_kg", *[f"hours_{s}" for s in C.STATES]]
FURNACE_FEATURES = ["good_production_kg", "hours_heating", "hours_holding", "hours_idle"]
STATE_FEATURES = [f"hours_{s}" for s in C.STATES]


def features_for(machine_type: Column, non_production: tuple[str, ...] = C.NON_PRODUCTION_TYPES) -> Column:
    """Ordered feature names for a machine type."""
    names = lambda fs: F.array(*[F.lit(f) for f in fs])
    return (F.when(machine_type == "furnace", names(FURNACE_FEATURES))
            .when(machine_type.isin(*non_production), names(STATE_FEATURES))
            .otherwise(names([*STATE_FEATURES, "good_production_kg"])))


def design_rows(intervals: DataFrame) -> DataFrame:
    """Complete rows with energy; a missing feature counts as 0."""
    df = intervals.where(F.col("complete") & F.col("energy_kwh").isNotNull())
    return df.select("machine_id", "machine_type", "window_start", "energy_kwh",
                     *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES])


def split_holdout(design: DataFrame, fraction: float = C.BASELINE_HOLDOUT_FRACTION) -> DataFrame:
    """Marks the time-ordered tail per machine as holdout when enough rows remain to fit."""
    per = Window.partitionBy("machine_id")
    n = F.count("*").over(per)
    hold = F.floor(F.col("n_rows") * fraction)
    usable = (hold >= 1) & (F.col("n_rows") - hold >= F.greatest(F.lit(2), F.size(features_for(F.col("machine_type"))) + 1))
    return (design.withColumns({"n_rows": n, "_rn": F.row_number().over(per.orderBy("window_start"))})
            .withColumn("is_holdout", usable & (F.col("_rn") > F.col("n_rows") - hold)).drop("_rn"))


def gram_sums(split: DataFrame) -> DataFrame:
    """Per machine the sums of products of [1, features] and the target over training rows."""
    train = split.where(~F.col("is_holdout"))
    cols = [F.lit(1.0), *[F.col(f) for f in FEATURES]]
    n = len(cols)
    gram = F.array(*[F.sum(cols[i] * cols[j]) for i in range(n) for j in range(n)])
    rhs = F.array(*[F.sum(c * F.col("energy_kwh")) for c in cols])
    return train.groupBy("machine_id", "machine_type", "n_rows").agg(
        gram.alias("gram"), rhs.alias("rhs"), F.count("*").alias("n_train")
    ).withColumn("features", features_for(F.col("machine_type")))


def nnls(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """min |Ax-b| with x >= 0, given AᵀA and Aᵀb (active-set method on scaled columns)."""
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    scale[scale == 0.0] = 1.0
    g, b = gram / np.outer(scale, scale), rhs / scale
    n, tol = len(b), 1e-10 * max(1.0, float(np.abs(b).max(initial=0.0)))
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(10 * n):
        pull = np.where(free, -np.inf, b - g @ x)
        j = int(np.argmax(pull))
        if pull[j] <= tol:
            break
        free[j] = True
        while True:
            trial = np.zeros(n)
            idx = np.flatnonzero(free)
            trial[idx] = np.linalg.lstsq(g[np.ix_(idx, idx)], b[idx], rcond=1e-12)[0]
            low = free & (trial <= 0.0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            free &= ~(low & (x <= 1e-12))
            x[~free] = 0.0
            if not free.any():
                break
    return x / scale


_FIT_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()), T.StructField("machine_type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("coefficients", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("intercept", T.DoubleType()), T.StructField("clipped", T.ArrayType(T.StringType())),
    T.StructField("n_rows", T.LongType()), T.StructField("n_train", T.LongType())])


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    size = len(FEATURES) + 1
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            feats = list(r.features)
            keep = [0, *[FEATURES.index(f) + 1 for f in feats]]
            gram = np.asarray(r.gram, dtype=float).reshape(size, size)
            x = nnls(gram[np.ix_(keep, keep)], np.asarray(r.rhs, dtype=float)[keep])
            coefs = {f: float(c) for f, c in zip(feats, x[1:])}
            active = gram[0, keep[1:]] != 0
            rows.append((r.machine_id, r.machine_type, feats, coefs, float(x[0]),
                         [f for f, a in zip(feats, active) if a and coefs[f] <= 0], r.n_rows, r.n_train))
        yield pd.DataFrame(rows, columns=_FIT_SCHEMA.names)


def fit_metrics(split: DataFrame, fits: DataFrame) -> DataFrame:
    """R², CV(RMSE) % (n in the denominator) and NMBE % per machine and split."""
    df = predict(split.join(fits.select("machine_id", "coefficients", "intercept"), "machine_id"), "predicted")
    y, e = F.col("energy_kwh"), F.col("energy_kwh") - F.col("predicted")
    stats = df.groupBy("machine_id", "is_holdout").agg(
        F.count("*").alias("n"), F.avg(y).alias("_mean"), F.sum(e * e).alias("_sse"), F.sum(-e).alias("_bias"),
        F.var_pop(y).alias("_var"))
    sst = F.col("_var") * F.col("n")
    usable = F.col("_mean") > 0
    return stats.select(
        "machine_id", "is_holdout", "n", F.when(sst > 0, 1.0 - F.col("_sse") / sst).alias("r2"),
        F.when(usable, F.sqrt(F.col("_sse") / F.col("n")) / F.col("_mean") * 100.0).alias("cv_rmse_pct"),
        F.when(usable, F.col("_bias") / (F.col("n") * F.col("_mean")) * 100.0).alias("nmbe_pct"))


def g14_label(cv: Column, nmbe: Column, cv_max: float = C.G14_CV_MAX_PCT, nmbe_max: float = C.G14_NMBE_MAX_PCT) -> Column:
    return F.when((cv <= cv_max) & (F.abs(nmbe) <= nmbe_max), "ACCEPTABLE").otherwise("NOT_ACCEPTABLE")


def acceptance(metrics: DataFrame) -> DataFrame:
    """One row per machine: both splits side by side; the label prefers the holdout."""
    def pick(hold, c): return F.max(F.when(F.col("is_holdout") == hold, F.col(c)))
    wide = metrics.groupBy("machine_id").agg(
        *[pick(False, c).alias(f"{c}_train") for c in ("r2", "cv_rmse_pct", "nmbe_pct")],
        *[pick(True, c).alias(f"{c}_holdout") for c in ("r2", "cv_rmse_pct", "nmbe_pct")],
        F.coalesce(pick(True, "n"), F.lit(0)).alias("n_holdout"))
    held = F.col("n_holdout") > 0
    return wide.withColumn("acceptance", g14_label(
        F.when(held, F.col("cv_rmse_pct_holdout")).otherwise(F.col("cv_rmse_pct_train")),
        F.when(held, F.col("nmbe_pct_holdout")).otherwise(F.col("nmbe_pct_train"))))


def fit_baseline(intervals: DataFrame, *, min_intervals: int = C.MIN_BASELINE_INTERVALS,
                 holdout_fraction: float = C.BASELINE_HOLDOUT_FRACTION) -> DataFrame:
    """One row per machine: coefficients, intercept, fit metrics and acceptance."""
    split = split_holdout(design_rows(intervals), holdout_fraction)
    fits = gram_sums(split.where(F.col("n_rows") >= min_intervals)).mapInPandas(_solve, _FIT_SCHEMA)
    fitted = fits.join(acceptance(fit_metrics(split, fits)), "machine_id").withColumn("status", F.lit("OK"))
    counts = intervals.groupBy("machine_id", "machine_type").agg(
        F.count_if(F.col("complete") & F.col("energy_kwh").isNotNull()).alias("n_rows"))
    short = counts.where(F.col("n_rows") < min_intervals).select(
        "machine_id", "machine_type", features_for(F.col("machine_type")).alias("features"), "n_rows",
        F.col("n_rows").alias("n_train"), F.lit("INSUFFICIENT_BASELINE_HISTORY").alias("status"))
    return fitted.unionByName(short, allowMissingColumns=True)


def predict(df: DataFrame, out: str = "expected_kwh") -> DataFrame:
    """intercept + sum of coefficient x feature (``coefficients`` / ``intercept`` columns given)."""
    total = F.col("intercept")
    for f in FEATURES:
        total = total + F.coalesce(F.col("coefficients")[f], F.lit(0.0)) * F.coalesce(F.col(f), F.lit(0.0))
    return df.withColumn(out, total)


def deviation(df: DataFrame, epsilon_kwh: float = C.EXPECTED_EPSILON_KWH) -> DataFrame:
    """Adds deviation_kwh / deviation_pct / deviation_status; near-zero expectation has no percentage."""
    e, a = F.col("expected_kwh"), F.col("energy_kwh")
    return df.withColumns({
        "deviation_kwh": a - e,
        "deviation_pct": F.when(e > epsilon_kwh, (a - e) / e * 100.0),
        "deviation_status": F.when(e.isNull() | a.isNull(), "INSUFFICIENT_BASELINE_HISTORY")
        .when(e <= epsilon_kwh, "EXPECTED_NEAR_ZERO").otherwise("OK")})


def score_intervals(intervals: DataFrame, baselines: DataFrame, epsilon_kwh: float = C.EXPECTED_EPSILON_KWH) -> DataFrame:
    """Intervals with expected energy, deviation and specific energy."""
    from wattloom.operators.sec import compute_sec
    b = baselines.select("machine_id", "coefficients", "intercept", F.lit(True).alias("has_baseline"))
    df = predict(intervals.join(b, "machine_id", "left"), "_expected")
    df = df.withColumn("expected_kwh", F.when(F.col("complete") & F.col("energy_kwh").isNotNull(), F.col("_expected")))
    df = deviation(df, epsilon_kwh).withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False)))
    df = df.withColumn("deviation_status", F.when(F.col("has_baseline") & ~F.col("complete"), "INCOMPLETE_INTERVAL")
                       .otherwise(F.col("deviation_status")))
    return compute_sec(df.drop("_expected", "coefficients", "intercept"))


def first_hours(hours: DataFrame, n: int) -> DataFrame:
    """Marks the first ``n`` hours of a meter series as the fit window; counted by days, so no task holds a series."""
    rows = hours.withColumns({"_one": F.lit(1).cast("long"), "_day": F.to_date("window_start")})
    rows = scan.running_sum(rows, ["machine_id"], "_day", ["window_start"], "_one", "_nth")
    return rows.withColumn("is_fit", F.col("_nth") <= n).drop("_one", "_day", "_nth")
