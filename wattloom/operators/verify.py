"""Interventions and verified savings: counterfactual, uncertainty, cost and CO2, all at once.

Only production drives the counterfactual (hours t-1, t, t+1): state hours would carry
the very change that is to be measured.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import config as C
from wattloom.functions.columns import local_time, minute_of_day, py_round
from wattloom.operators.baseline import g14_label
from wattloom.operators.schedule import tariff_minutes

# The allowed status changes, in order of the stages they end in.
OUTCOMES = ("VERIFIED", "NOT_VERIFIED", "NOT_COMPARABLE", "INSUFFICIENT_DATA")
STAGES = (("APPROVED", "REJECTED"), ("APPLIED",), ("MEASURED",), OUTCOMES)


def shown(value: Column, digits: int) -> Column:
    """Rounded sum; the nudge keeps exact half-way values from depending on the order of addition."""
    return F.round(value + 1e-9, digits)


def lifecycle_fold(log: DataFrame) -> DataFrame:
    """Marks each requested status change (entity, seq, target) as legal or not.

    Every legal change moves one stage on, so the legal ones are: the first decision,
    then the first APPLIED after it, and so on. Each stage is one grouped minimum with
    map-side combine; an entity with a very long log is never gathered.
    """
    at = None
    steps = []
    for i, targets in enumerate(STAGES):
        rows = log.where(F.col("target").isin(*targets))
        if at is not None:
            rows = rows.join(at.where(F.col("_t") != "REJECTED"), "entity").where(F.col("seq") > F.col("_s"))
        at = rows.groupBy("entity").agg(F.min(F.struct("seq", "target")).alias("_x")).select(
            "entity", F.col("_x.seq").alias("_s"), F.col("_x.target").alias("_t"))
        steps.append(at.select("entity", F.col("_s").alias("seq"), F.lit(i + 1).alias("stage")))
    legal = steps[0]
    for s in steps[1:]:
        legal = legal.unionByName(s)
    return log.join(legal, ["entity", "seq"], "left").withColumn("legal", F.col("stage").isNotNull())


def lifecycle_state(folded: DataFrame) -> DataFrame:
    """Current status per entity and how many requests were refused."""
    return folded.groupBy("entity").agg(
        F.coalesce(F.max_by("target", "stage"), F.lit("PENDING_REVIEW")).alias("status"), F.count_if(~F.col("legal")).alias("n_illegal"))


def check_requests(requests: DataFrame, recs: DataFrame, baseline_days: int = C.VERIFY_BASELINE_DAYS) -> DataFrame:
    """Default windows and the checks that do not depend on other requests."""
    end = F.coalesce("baseline_end", "applied_at")
    df = requests.withColumn("baseline_end", end).withColumn(
        "baseline_start", F.coalesce("baseline_start", F.col("baseline_end") - F.expr(f"interval {baseline_days} days")))
    df = df.join(recs.select("recommendation", "machine_id", "status"), "recommendation", "left")
    window = (F.col("baseline_start") < F.col("baseline_end")) & (F.col("baseline_end") <= F.col("applied_at"))
    return df.withColumn("refusal", F.when(F.col("status").isNull(), "unknown recommendation").when(F.col("status") != "APPROVED", "not approved")
                         .when(~window, "baseline window must end at or before applied_at"))


def apply_interventions(requests: DataFrame, recs: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Result of every request (seq order): applied, replay, or why it was refused.

    A request is applied when it is the first usable one for both its recommendation and
    its idempotency key. Rounds take all requests that are first on both sides and drop
    what they decide, which equals going through them one by one. ``cut`` stores a round.
    """
    checked = cut(check_requests(requests, recs), "checked")
    left, won, i = checked.where(F.col("refusal").isNull()).select("seq", "recommendation", "idempotency_key"), None, 0
    while True:
        left = cut(left, f"open_{i}")
        if left.isEmpty():
            break
        by_rec = left.groupBy("recommendation").agg(F.min("seq").alias("seq"))
        by_key = left.groupBy("idempotency_key").agg(F.min("seq").alias("seq"))
        first = left.join(by_rec, ["recommendation", "seq"], "left_semi").join(by_key, ["idempotency_key", "seq"], "left_semi")
        first = cut(first, f"first_{i}")
        won = first if won is None else won.unionByName(first)
        left = left.join(first.select("recommendation"), "recommendation", "left_anti").join(first.select("idempotency_key"), "idempotency_key", "left_anti")
        i += 1
    won = checked.limit(0).select("seq", "recommendation", "idempotency_key") if won is None else won
    by_key = won.select("idempotency_key", F.col("recommendation").alias("_krec"), F.col("seq").alias("_kseq"))
    by_rec = won.select("recommendation", F.col("seq").alias("_rseq"))
    df = checked.join(by_key, "idempotency_key", "left").join(by_rec, "recommendation", "left")
    earlier = F.col("_kseq") < F.col("seq")
    result = (F.when(F.col("_kseq") == F.col("seq"), "applied")
              .when(earlier & (F.col("_krec") == F.col("recommendation")), "replay")
              .when(earlier, "idempotency_key already used for a different recommendation")
              .when(F.col("refusal").isNotNull(), F.col("refusal"))
              .when(F.col("_rseq") < F.col("seq"), "already applied"))
    return df.select("seq", "recommendation", "idempotency_key", "machine_id", "applied_at", "baseline_start", "baseline_end", result.alias("result"))


# -- design ---------------------------------------------------------------------
ROW = ["intervention", "period"]


def intervention_rows(interventions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Intervals of every intervention's baseline and measurement window.

    Windows are cut into days, so the match is an equi join on (machine, day). Window
    bounds lie on the interval grid.
    """
    periods = F.array(F.struct(F.lit("baseline").alias("period"), F.col("baseline_start").alias("ws"), F.col("baseline_end").alias("we")),
                      F.struct(F.lit("post").alias("period"), F.col("measurement_start").alias("ws"), F.col("measurement_end").alias("we")))
    w = interventions.select("intervention", "machine_id", F.explode(periods).alias("p")).select("intervention", "machine_id", "p.*")
    w = w.withColumn("_day", F.explode(F.sequence(F.to_date("ws"), F.to_date(F.col("we") - F.expr("interval 1 microsecond")))))
    iv = intervals.select("machine_id", "window_start", "window_end", "complete", "energy_kwh", "good_production_kg").withColumn("_day", F.to_date("window_start"))
    return w.join(iv, ["machine_id", "_day"]).where((F.col("window_start") >= F.col("ws")) & (F.col("window_end") <= F.col("we"))).drop("_day", "ws", "we")


def verify_design(rows: DataFrame) -> DataFrame:
    """Rows with their neighbours' production and a usable mark; edges carry no mark."""
    w = Window.partitionBy(*ROW).orderBy("window_start")
    df = rows.withColumns({"prev_kg": F.lag("good_production_kg").over(w), "next_kg": F.lead("good_production_kg").over(w),
                           "_edge": F.lag("window_start").over(w).isNull() | F.lead("window_start").over(w).isNull()})
    usable = (F.col("complete") & F.col("energy_kwh").isNotNull() & F.col("prev_kg").isNotNull() & F.col("good_production_kg").isNotNull()
              & F.col("next_kg").isNotNull())
    return df.withColumn("usable", F.when(~F.col("_edge"), usable)).drop("_edge")


_X = ["_one", "prev_kg", "good_production_kg", "next_kg"]
_BETA = T.StructType([T.StructField("intervention", T.StringType()), T.StructField("beta", T.ArrayType(T.DoubleType()))])


def _ols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        beta = [np.linalg.lstsq(np.asarray(g, dtype=float).reshape(4, 4), np.asarray(b, dtype=float), rcond=1e-12)[0].tolist()
                for g, b in zip(pdf.gram, pdf.rhs)]
        yield pd.DataFrame({"intervention": pdf.intervention, "beta": beta})


def fit_counterfactual(design: DataFrame) -> DataFrame:
    """Least-squares coefficients [1, previous, current, next production] per intervention."""
    base = design.where((F.col("period") == "baseline") & F.col("usable")).withColumn("_one", F.lit(1.0))
    gram = F.array(*[F.sum(F.col(a) * F.col(b)) for a in _X for b in _X])
    rhs = F.array(*[F.sum(F.col(a) * F.col("energy_kwh")) for a in _X])
    return base.groupBy("intervention").agg(gram.alias("gram"), rhs.alias("rhs")).mapInPandas(_ols, _BETA)


def with_prediction(design: DataFrame, fits: DataFrame) -> DataFrame:
    b = F.col("beta")
    pred = b[0] + b[1] * F.col("prev_kg") + b[2] * F.col("good_production_kg") + b[3] * F.col("next_kg")
    return design.where("usable").join(fits, "intervention").withColumn("predicted", pred).drop("beta")


def residual_stats(predicted: DataFrame, p: int = 4) -> DataFrame:
    """CV, NMBE (both with n-p) and lag-1 autocorrelation of the baseline residuals."""
    base = predicted.where(F.col("period") == "baseline").withColumn("_e", F.col("energy_kwh") - F.col("predicted"))
    w = Window.partitionBy("intervention").orderBy("window_start")
    s = base.withColumn("_l", F.lag("_e").over(w)).groupBy("intervention").agg(
        F.count("*").alias("n"), F.avg("energy_kwh").alias("_mean"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.sum("_e").alias("_se"),
        F.stddev_pop("_e").alias("_sd"),
        F.try_divide(F.covar_pop("_l", "_e"), F.stddev_pop("_l") * F.stddev_pop(F.when(F.col("_l").isNotNull(), F.col("_e")))).alias("_rho"))
    dof = F.greatest(F.lit(1), F.col("n") - p)
    rho = F.when((F.col("n") < 3) | (F.col("_sd") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce("_rho", F.lit(0.0))))
    s = s.withColumns({"cv": F.try_divide(F.sqrt(F.col("_sse") / dof), F.col("_mean")), "nmbe_pct": F.try_divide(F.col("_se"), dof * F.col("_mean")) * 100.0, "rho": rho})
    return s.select("intervention", "n", "cv", "nmbe_pct", "rho",
                    F.when(F.col("rho") < 1, F.col("n") * (F.lit(1.0) - F.col("rho")) / (F.lit(1.0) + F.col("rho"))).otherwise(1.0).alias("n_eff"))


def student_t(prob: float, dof: int) -> float:
    """Quantile of Student's t for prob > 0.5 (bisection on the incomplete beta function)."""
    def upper(t: float) -> float:
        x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
        front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if 0 < x < 1 else 0.0
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            x, a, b = 1 - x, b, a
        c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
        f = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1 + num * d)
                c = 1 + num / c
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        beta = front * f / a
        return 0.5 * (1 - beta if flip else beta)
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper(mid) > 1 - prob else (lo, mid)
    return (lo + hi) / 2


def t_quantile(confidence: float) -> Callable[[Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def quantile(dof: pd.Series) -> pd.Series:
        known = {d: student_t(1 - (1 - confidence) / 2, int(d)) for d in dof.dropna().unique()}
        return dof.map(known).astype(float)
    return quantile


def savings_uncertainty(df: DataFrame, confidence: float = C.VERIFY_CONFIDENCE, p: int = 4) -> DataFrame:
    """Adds uncertainty_kwh from cv, n, n_eff, m and the counterfactual total."""
    n, m = F.col("n"), F.col("m")
    t = t_quantile(confidence)(F.greatest(F.lit(1), n - p).cast("double"))
    return df.withColumn("uncertainty_kwh", t * 1.26 * F.col("cv") * F.sqrt((n / F.col("n_eff")) * (F.lit(2.0) / n + 1.0) * (F.lit(1.0) / m)) * F.col("counterfactual_kwh"))


def data_gates(design: DataFrame, interventions: DataFrame, min_baseline: int = C.VERIFY_MIN_BASELINE_POINTS, min_post: int = C.VERIFY_MIN_POST_POINTS,
               min_frac: float = C.VERIFY_MIN_COMPLETE_FRAC) -> DataFrame:
    """Usable hours and share on both sides, and whether they suffice."""
    def side(name): return F.col("period") == name
    g = design.groupBy("intervention").agg(
        F.count_if(side("baseline") & F.col("usable")).alias("n_baseline"), F.count_if(side("post") & F.col("usable")).alias("n_post"),
        F.greatest(F.lit(0), F.count_if(side("baseline")) - 2).alias("_nb"), F.greatest(F.lit(0), F.count_if(side("post")) - 2).alias("_np"))
    g = interventions.select("intervention", "machine_id").join(g, "intervention", "left").na.fill(0)
    frac = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    g = g.withColumns({"_fb": frac("n_baseline", "_nb"), "_fp": frac("n_post", "_np")})
    ok = (F.col("n_baseline") >= min_baseline) & (F.col("_fb") >= min_frac) & (F.col("n_post") >= min_post) & (F.col("_fp") >= min_frac)
    return g.select("intervention", "machine_id", "n_baseline", "n_post", py_round("_fb", 3).alias("baseline_complete_frac"),
                    py_round("_fp", 3).alias("post_complete_frac"), ok.alias("enough_data"))


def comparability_gates(design: DataFrame, tol_pct: float = C.VERIFY_PROD_TOL_PCT, max_extrapolated: float = C.VERIFY_MAX_EXTRAPOLATED_FRAC) -> DataFrame:
    """Mean production before/after and the share of hours beyond 1.05 x the baseline maximum."""
    u = design.where("usable")
    base = u.where("period = 'baseline'").groupBy("intervention").agg(F.avg("good_production_kg").alias("before"), F.max("good_production_kg").alias("_max"))
    post = u.where("period = 'post'").join(base.select("intervention", "_max"), "intervention").groupBy("intervention").agg(
        F.avg("good_production_kg").alias("after"), F.avg((F.col("good_production_kg") > F.col("_max") * 1.05).cast("double")).alias("extrapolated_frac"))
    df = base.join(post, "intervention")
    change = F.try_divide(F.abs(F.col("after") - F.col("before")), F.col("before")) * 100.0
    shifted = (F.col("before") > 0) & F.coalesce(change > tol_pct, F.lit(False))
    return df.select("intervention", F.col("before").alias("production_before_kg_h"), F.col("after").alias("production_after_kg_h"), "extrapolated_frac",
                     (~(shifted | (F.col("extrapolated_frac") > max_extrapolated))).alias("comparable"))


def _number(value: Column, pattern: str = "%.1f") -> Column:
    return F.format_string(pattern, F.round(value + 1e-9, 1))


def comparability_reasons(tol_pct: float, max_extrapolated: float) -> Column:
    """Why the columns of ``comparability_gates`` are not comparable (empty where they are)."""
    before, after = F.col("production_before_kg_h"), F.col("production_after_kg_h")
    change = F.try_divide(after - before, before) * 100.0
    return F.array_compact(F.array(
        F.when((before > 0) & (F.abs(change) > tol_pct), F.concat(F.lit("mean production changed by "), _number(change, "%+.1f"), F.lit(f" %, more than {tol_pct:.1f} %"))),
        F.when(F.col("extrapolated_frac") > max_extrapolated, F.concat(_number(F.col("extrapolated_frac") * 100.0), F.lit(
            " % of the measurement lies above the baseline's production, where the model would extrapolate")))))


def verify_savings(interventions: DataFrame, intervals: DataFrame, *, confidence: float = C.VERIFY_CONFIDENCE, min_baseline: int = C.VERIFY_MIN_BASELINE_POINTS,
                   min_post: int = C.VERIFY_MIN_POST_POINTS, min_frac: float = C.VERIFY_MIN_COMPLETE_FRAC, tol_pct: float = C.VERIFY_PROD_TOL_PCT,
                   max_extrapolated: float = C.VERIFY_MAX_EXTRAPOLATED_FRAC, cv_max: float = C.G14_CV_MAX_PCT, nmbe_max: float = C.G14_NMBE_MAX_PCT,
                   design: DataFrame | None = None, fits: DataFrame | None = None) -> DataFrame:
    """One verdict per intervention: saving with its band, or the reason there is none, and the model behind it.

    ``design`` and ``fits`` take tables of ``verify_design`` and ``fit_counterfactual`` that are written already; each is
    read several times. ``comparable`` and its reasons are null where the data or the model end the test before.
    """
    design = verify_design(intervention_rows(interventions, intervals)) if design is None else design
    fits = fit_counterfactual(design) if fits is None else fits
    pred = with_prediction(design, fits)
    stats = residual_stats(pred).withColumn("g14", g14_label(F.col("cv") * 100.0, F.col("nmbe_pct"), cv_max, nmbe_max))
    post = pred.where("period = 'post'").groupBy("intervention").agg(
        F.count("*").alias("m"), F.sum("predicted").alias("counterfactual_kwh"), F.sum("energy_kwh").alias("actual_kwh"))
    df = (data_gates(design, interventions, min_baseline, min_post, min_frac).join(stats, "intervention", "left")
          .join(comparability_gates(design, tol_pct, max_extrapolated), "intervention", "left").join(post, "intervention", "left").join(fits, "intervention", "left"))
    df = savings_uncertainty(df, confidence).withColumn("saving_kwh", F.col("counterfactual_kwh") - F.col("actual_kwh"))
    u, s = F.col("uncertainty_kwh"), F.col("saving_kwh")
    fitted = F.coalesce("g14", F.lit("")) == "ACCEPTABLE"
    verdict = (F.when(~F.col("enough_data") | ~fitted, "INSUFFICIENT_DATA").when(~F.col("comparable"), "NOT_COMPARABLE")
               .when((s > u) & (s > 0), "SUCCESS").when(s < -u, "WORSE").otherwise("NO_EFFECT"))
    df = df.withColumns({"result_class": verdict, "_reasons": comparability_reasons(tol_pct, max_extrapolated)})
    tested = F.col("enough_data") & fitted
    has = F.col("result_class").isin("SUCCESS", "WORSE", "NO_EFFECT")
    keep = lambda c, d: F.when(has, shown(F.col(c), d))
    pct = F.try_divide(s, F.col("counterfactual_kwh")) * 100.0

    def short(side, what, least):
        return F.concat(F.lit(f"{what} has "), F.col(f"n_{side}").cast("string"), F.lit(" usable intervals ("), _number(F.col(f"{side}_complete_frac") * 100.0),
                        F.lit(f" % complete); {least} and {min_frac * 100:.1f} % are needed."))
    band = F.concat(_number(u), F.lit(f" kWh at {confidence * 100:.1f} % confidence."))
    enough_before = (F.col("n_baseline") >= min_baseline) & (F.col("baseline_complete_frac") >= min_frac)
    why = (F.when(~F.col("enough_data") & ~enough_before, short("baseline", "The baseline", min_baseline))
           .when(~F.col("enough_data"), short("post", "The measurement", min_post))
           .when(~fitted, F.concat(F.lit("The baseline model is not good enough for a counterfactual: CV(RMSE) "), F.coalesce(_number(F.col("cv") * 100.0), F.lit("undefined")),
                                   F.lit(" %, NMBE "), F.coalesce(_number(F.col("nmbe_pct")), F.lit("undefined")), F.lit(" %.")))
           .when(F.col("result_class") == "NOT_COMPARABLE", F.concat(F.lit("Conditions differ: "), F.array_join("_reasons", "; "), F.lit(". No saving is reported.")))
           .when(F.col("result_class") == "SUCCESS", F.concat(_number(s), F.lit(" kWh ("), _number(pct), F.lit(" %) below the counterfactual, more than its uncertainty of "), band))
           .when(F.col("result_class") == "WORSE", F.concat(_number(-s), F.lit(" kWh ("), _number(-pct), F.lit(" %) above the counterfactual, more than its uncertainty of "), band))
           .otherwise(F.concat(_number(s, "%+.1f"), F.lit(" kWh against the counterfactual, within its uncertainty of "), band)))
    return df.select(
        "intervention", "machine_id", "result_class",
        F.when(F.col("result_class") == "SUCCESS", "VERIFIED").when(has, "NOT_VERIFIED").otherwise(F.col("result_class")).alias("outcome"),
        why.alias("explanation"), "n_baseline", "n_post", "baseline_complete_frac", "post_complete_frac",
        keep("counterfactual_kwh", 3).alias("counterfactual_kwh"), keep("actual_kwh", 3).alias("actual_kwh"), keep("saving_kwh", 3).alias("saving_kwh"),
        F.when(has, shown(pct, 3)).alias("saving_pct"), keep("uncertainty_kwh", 3).alias("uncertainty_kwh"), F.when(has, F.lit(confidence)).alias("confidence"),
        shown(F.col("production_before_kg_h"), 3).alias("production_before_kg_h"), shown(F.col("production_after_kg_h"), 3).alias("production_after_kg_h"),
        F.when(tested, F.col("comparable")).alias("comparable"), F.when(tested, F.col("_reasons")).alias("comparability_reasons"),
        F.when(F.col("enough_data"), F.struct(
            F.transform("beta", lambda b: shown(b, 6)).alias("coefficients"), shown(F.col("cv") * 100.0, 3).alias("cv_rmse_pct"), shown(F.col("nmbe_pct"), 3).alias("nmbe_pct"),
            "g14", shown(F.col("rho"), 4).alias("lag1_autocorr"), shown(F.col("n_eff"), 1).alias("n_effective"))).alias("model"))


# -- impact -----------------------------------------------------------------------
def hourly_impact(predicted: DataFrame) -> DataFrame:
    return predicted.where("period = 'post'").select("intervention", "machine_id", "window_start", F.col("predicted").alias("counterfactual_kwh"),
                                                     F.col("energy_kwh").alias("actual_kwh"))


def cost_impact(hourly: DataFrame, tariff: DataFrame, *, site_id: str, tz: str = C.LOCAL_TZ) -> DataFrame:
    """Sum of (counterfactual - actual) x rate of the local hour; null when any hour has no price."""
    t = tariff.where(F.col("site_id") == site_id)
    rates = tariff_minutes(t).select("minute", "rate")
    df = hourly.withColumn("minute", minute_of_day(local_time("window_start", tz))).join(rates, "minute", "left")
    agg = df.groupBy("intervention").agg(
        F.count_if(F.col("rate").isNull()).alias("_gaps"), F.sum(F.col("counterfactual_kwh") * F.col("rate")).alias("_cf"),
        F.sum(F.col("actual_kwh") * F.col("rate")).alias("_act"))
    label = t.agg(F.when(F.count_if(F.col("source_class") != "ASSUMPTION") == 0, "ILLUSTRATIVE (ASSUMPTION) tariff, not the plant's bill")
                  .otherwise("plant tariff").alias("tariff_label"))
    ok = F.col("_gaps") == 0
    return agg.crossJoin(label).select(
        "intervention", F.when(ok, "OK").otherwise("UNAVAILABLE").alias("status"), F.when(ok, shown(F.col("_cf") - F.col("_act"), 2)).alias("value_inr"),
        F.when(ok, shown(F.col("_cf"), 2)).alias("counterfactual_cost_inr"), F.when(ok, shown(F.col("_act"), 2)).alias("actual_cost_inr"), "tariff_label")


def select_factor(df: DataFrame, on: str, factors: DataFrame) -> DataFrame:
    """Adds the factor in force on a date: a covering one, else the latest that had started.

    The factor table (a row per grid and fiscal year) becomes one row, from which each row picks its own: nothing is
    shuffled and no range is joined.
    """
    cols = ["factor_id", "value_kg_per_kwh", "source_class", "note"]
    table = factors.agg(F.collect_list(F.struct("effective_from", "effective_to", *cols)).alias("_all"))
    day = F.col(on)

    def ranked(f):
        covers = f["effective_to"].isNull() | (day <= f["effective_to"])
        return F.struct(covers.alias("covers"), f["effective_from"].alias("since"), *[f[c].alias(c) for c in cols])
    started = F.transform(F.filter("_all", lambda f: f["effective_from"] <= day), ranked)
    out = df.crossJoin(table).withColumn("_f", F.array_max(started)).drop("_all")
    status = F.when(F.col("_f").isNull(), "UNAVAILABLE").when(F.col("_f.covers"), "EFFECTIVE").otherwise("LATEST_AVAILABLE")
    return out.withColumns({"factor_status": status, "factor_id": F.col("_f.factor_id"), "value_kg_per_kwh": F.col("_f.value_kg_per_kwh"),
                            "factor_source_class": F.col("_f.source_class"), "factor_note": F.col("_f.note")}).drop("_f")


def co2_impact(df: DataFrame) -> DataFrame:
    """CO2 of a saving with its factor; provisional while the factor awaits confirmation."""
    waiting = (F.col("factor_source_class") != "MEASURED") & F.lower("factor_note").contains("confirm")
    return df.withColumns({"co2_kg": shown(F.col("saving_kwh") * F.col("value_kg_per_kwh"), 3), "provisional": waiting})


def impact_gate(df: DataFrame, value_cols: list[str]) -> DataFrame:
    """Only a VERIFIED saving becomes money or CO2."""
    ok = (F.col("outcome") == "VERIFIED") & F.col("saving_kwh").isNotNull()
    return df.withColumn("impact_status", F.when(ok, "OK").otherwise("NOT_APPLICABLE")).withColumns({c: F.when(ok, F.col(c)) for c in value_cols})


# -- paired trials ------------------------------------------------------------------
def true_saving_pairs(energy: DataFrame, starts: DataFrame) -> DataFrame:
    """Control minus treated energy per (scenario, seed); equality of the pre-period and of heat starts.

    energy: scenario, seed, arm, period, energy_kwh. starts: scenario, seed, arm, ts.
    """
    key = ["scenario", "seed"]
    def total(arm, period): return F.coalesce(F.sum(F.when((F.col("arm") == arm) & (F.col("period") == period), F.col("energy_kwh"))), F.lit(0.0))
    e = energy.groupBy(*key).agg((total("control", "pre") - total("treated", "pre")).alias("_pre"), (total("control", "post") - total("treated", "post")).alias("true_saving_kwh"))
    per_ts = starts.groupBy(*key, "ts").agg(F.count_if(F.col("arm") == "control").alias("_c"), F.count_if(F.col("arm") == "treated").alias("_t"))
    odd = per_ts.groupBy(*key).agg(F.count_if(F.col("_c") != F.col("_t")).alias("_odd"))
    return e.join(odd, key, "left").select(*key, shown(F.col("true_saving_kwh"), 3).alias("true_saving_kwh"), (F.abs("_pre") < 1e-6).alias("pre_equal"),
                                           (F.coalesce("_odd", F.lit(0)) == 0).alias("paired"))


def verification_scorecard(runs: DataFrame) -> DataFrame:
    """Outcome counts, false-claim rate and coverage of the band per scenario, all and paired."""
    rep, true, u = F.col("reported_saving_kwh"), F.col("true_saving_kwh"), F.col("uncertainty_kwh")
    neg, ver, comp, paired = true <= 0, F.col("outcome") == "VERIFIED", rep.isNotNull(), F.col("paired")
    covered = F.abs(true - rep) <= u
    ratio = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b))
    return runs.groupBy("scenario").agg(
        F.count("*").alias("n"), F.count_if(paired).alias("n_paired"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in OUTCOMES],
        *[F.count_if(F.col("result_class") == c).alias(f"class_{c.lower()}") for c in ("SUCCESS", "NO_EFFECT", "WORSE")],
        F.count_if(neg).alias("n_true_le0"), F.count_if(neg & ver).alias("n_verified_when_nonpositive"),
        ratio(ver, neg).alias("false_claim_rate"), ratio(ver, neg & paired).alias("false_claim_rate_paired"),
        (F.count_if(ver) / F.count("*")).alias("detection_rate"), ratio(covered, comp).alias("coverage"), ratio(covered, comp & paired).alias("coverage_paired"),
        F.count_if(comp).alias("n_comparable"), F.avg(true).alias("mean_true_kwh"), F.avg(rep).alias("mean_reported_kwh"),
        F.avg(F.abs(rep - true)).alias("mean_abs_error_kwh"))
