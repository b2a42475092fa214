"""Energy anomalies on scored intervals: threshold rules, rolling robust z, merged events.

All windows run on interval rows (one per machine and bucket), never on readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions.columns import py_round
from wattloom.operators.intervals import HOUR_COLUMNS

FLAG_COLUMNS = ["machine_id", "k", "rule_id", "metric", "severity", "score", "evidence"]


def _timeline():
    return Window.partitionBy("machine_id").orderBy("k")


def consecutive(df: DataFrame, cond: Column, out: str, carried: bool = False) -> DataFrame:
    """``out`` = how many rows in a row, up to this one, satisfy ``cond`` (0 when it does not).

    With ``carried`` the rows go on from earlier ones: ``_k_before`` is the machine's last bucket and ``_{out}_before`` the
    count there (null: none). Such rows may skip buckets in which nothing happened; a skipped bucket ends a run.
    """
    df = df.withColumn("_c", F.coalesce(cond, F.lit(False)))
    stop = F.when(~F.col("_c"), 1)
    if carried:
        stop = stop.when(F.coalesce(F.lag("k").over(_timeline()), "_k_before") != F.col("k") - 1, 1)
    df = df.withColumn("_stop", stop.otherwise(0)).withColumn("_g", F.sum("_stop").over(_timeline()))
    run = F.sum(F.col("_c").cast("long")).over(Window.partitionBy("machine_id", "_g").orderBy("k"))
    if carried:
        run = run + F.when(F.col("_g") == 0, F.coalesce(F.col(f"_{out}_before"), F.lit(0))).otherwise(0)
    return df.withColumn(out, run).drop("_c", "_stop", "_g")


def _fmt(pattern: str, digits: int, value: Column) -> Column:
    return F.format_string(pattern, py_round(value, digits))


def _flag(hit: Column, rule: str, metric: str, severity: Column, score: Column, evidence: Column) -> Column:
    """The rule's flag where ``hit`` holds, else null."""
    return F.when(hit, F.struct(F.lit(rule).alias("rule_id"), F.lit(metric).alias("metric"), severity.alias("severity"),
                                score.cast("double").alias("score"), evidence.alias("evidence")))


def _flags(df: DataFrame, *flags: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per flag raised; ``keep`` names further columns of ``df`` to carry."""
    df = df.select("machine_id", "k", *keep, F.explode(F.array_compact(F.array(*flags))).alias("_f"))
    return df.select(*FLAG_COLUMNS[:2], *[F.col(f"_f.{c}") for c in FLAG_COLUMNS[2:]], *keep)


def _deviation_condition(warn: float) -> Column:
    return F.col("complete") & (F.col("deviation_pct") > warn)


def _deviation_flag(crit: float, n: int) -> Column:
    dev, run = F.col("deviation_pct"), F.col("run_deviation")
    text = F.concat(F.lit("Energy "), _fmt("%.1f", 1, dev), F.lit("% above expected baseline for the production achieved for "),
                    run.cast("string"), F.lit(" consecutive interval(s)."))
    return _flag(run >= n, "L1_DEVIATION", "deviation", F.when(dev > crit, "CRITICAL").otherwise("WARNING"), dev, text)


def l1_deviation(scored: DataFrame, warn: float = C.DEVIATION_WARN_PCT, crit: float = C.DEVIATION_CRIT_PCT,
                 n: int = C.DEVIATION_CONSECUTIVE_N) -> DataFrame:
    return _flags(consecutive(scored, _deviation_condition(warn), "run_deviation"), _deviation_flag(crit, n))


def idle_share() -> Column:
    total = sum((F.col(c) for c in HOUR_COLUMNS), F.lit(0.0))
    return F.when(total > 0, (F.col("hours_idle") + F.col("hours_holding")) / total).otherwise(0.0)


def _idle_condition(share: float) -> Column:
    return F.col("complete") & (idle_share() > share) & (F.coalesce("good_production_kg", F.lit(0.0)) <= 0)


def _idle_flag(n: int) -> Column:
    text = F.concat(F.lit("Idle/holding share "), _fmt("%.0f", 0, idle_share() * 100),
                    F.lit("% with zero good production for "), F.col("run_idle").cast("string"),
                    F.lit(" consecutive interval(s): energy spent with no useful output."))
    return _flag(F.col("run_idle") >= n, "L1_IDLE_WASTE", "idle_energy", F.lit("WARNING"), idle_share(), text)


def l1_idle_waste(scored: DataFrame, share: float = C.IDLE_SHARE_THRESHOLD, n: int = C.IDLE_CONSECUTIVE_N) -> DataFrame:
    return _flags(consecutive(scored, _idle_condition(share), "run_idle"), _idle_flag(n))


def _power_flag(multiple: float) -> Column:
    p, rated = F.col("power_max_kw"), F.col("rated_power_kw")
    text = F.concat(F.lit("Peak power "), _fmt("%.1f", 1, p), F.lit(" kW above rated "), _fmt("%.1f", 1, rated), F.lit(f" kW x {multiple}."))
    return _flag(F.col("complete") & (rated > 0) & (p > rated * multiple), "L1_POWER", "power", F.lit("WARNING"), p / rated, text)


def l1_power(scored: DataFrame, multiple: float = C.RATED_POWER_MULTIPLE) -> DataFrame:
    return _flags(scored, _power_flag(multiple))


def _power_factor_flag(minimum: float) -> Column:
    text = F.concat(F.lit("Mean power factor "), _fmt("%.2f", 2, F.col("pf_mean")), F.lit(f" below threshold {minimum}."))
    return _flag(F.col("complete") & (F.col("pf_mean") < minimum), "L1_POWER_FACTOR", "pf", F.lit("WARNING"), F.col("pf_mean"), text)


def l1_power_factor(scored: DataFrame, minimum: float = C.PF_MIN_THRESHOLD) -> DataFrame:
    return _flags(scored, _power_factor_flag(minimum))


def _once(value: Column, use) -> Column:
    """Applies ``use`` to a value that is computed once per row (bound as a lambda variable)."""
    return F.get(F.transform(F.array(value), use), 0)


def _middle(values: Column) -> Column:
    """Median of an array (mean of the two middle values)."""
    def pick(s):
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return _once(F.sort_array(values), pick)


def with_residual_z(scored: DataFrame, window: int, carried: bool = False) -> DataFrame:
    """Adds ``residual`` and ``z`` (null on rows without a residual) and ``_trailing``, the last ``window`` residuals.

    With ``carried``, ``_trailing_before`` holds the residuals of earlier rows (null: none).
    """
    usable = F.col("complete") & F.col("energy_kwh").isNotNull() & F.col("expected_kwh").isNotNull()
    df = scored.withColumn("residual", F.when(usable, F.col("energy_kwh") - F.col("expected_kwh")))
    # usable rows in a partition of their own: the last ``window`` of them, not of all rows
    w = Window.partitionBy("machine_id", F.col("residual").isNotNull()).orderBy("k").rowsBetween(-(window - 1), 0)
    df = df.withColumn("_trailing", F.collect_list("residual").over(w))
    if carried:
        both = F.concat(F.coalesce("_trailing_before", F.array().cast("array<double>")), F.col("_trailing"))
        df = df.withColumn("_trailing", both).withColumn("_trailing", F.slice("_trailing", F.greatest(F.size("_trailing") - window + 1, F.lit(1)), window))

    def z_for(med):
        spread = _middle(F.transform(F.col("_trailing"), lambda v: F.abs(v - med)))
        return _once(spread, lambda mad: F.when((F.size("_trailing") < 3) | (mad <= 0), 0.0).otherwise(
            (F.col("residual") - med) * 0.6745 / mad))
    return df.withColumn("z", F.when(F.col("residual").isNotNull(), _once(_middle(F.col("_trailing")), z_for)))


def rolling_mad_z(scored: DataFrame, window: int = C.MAD_WINDOW) -> DataFrame:
    """Robust z of the residual over the trailing ``window`` usable rows, this one included."""
    return with_residual_z(scored, window).where(F.col("residual").isNotNull()).drop("_trailing")


def _mad_flag(threshold: float, window: int, min_deviation_pct: float) -> Column:
    text = F.concat(F.lit("Robust z-score "), _fmt("%+.1f", 1, F.col("z")),
                    F.lit(f" on residual (actual - expected) vs trailing {window}-interval window; energy above expected "
                          "baseline for the production achieved ("), _fmt("%+.1f", 1, F.col("deviation_pct")), F.lit("%)."))
    return _flag((F.col("z") > threshold) & (F.col("deviation_pct") > min_deviation_pct), "L2_MAD_RESIDUAL", "deviation",
                 F.when(F.col("z") > threshold * 1.5, "CRITICAL").otherwise("WARNING"), F.col("z"), text)


def l2_mad(scored: DataFrame, threshold: float = C.MAD_THRESHOLD, window: int = C.MAD_WINDOW,
           min_deviation_pct: float = C.DEVIATION_WARN_PCT) -> DataFrame:
    return _flags(with_residual_z(scored, window), _mad_flag(threshold, window, min_deviation_pct))


def with_rule_inputs(scored: DataFrame, carried: bool = False) -> DataFrame:
    """Run lengths, residual and robust z of every interval: what the rules look at, in windows of one shuffle by machine."""
    df = consecutive(scored, _deviation_condition(C.DEVIATION_WARN_PCT), "run_deviation", carried)
    df = consecutive(df, _idle_condition(C.IDLE_SHARE_THRESHOLD), "run_idle", carried)
    return with_residual_z(df, C.MAD_WINDOW, carried)


def raised(inputs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flags of all rules on rows with the rules' inputs, in one pass."""
    return _flags(inputs, _deviation_flag(C.DEVIATION_CRIT_PCT, C.DEVIATION_CONSECUTIVE_N), _idle_flag(C.IDLE_CONSECUTIVE_N),
                  _power_flag(C.RATED_POWER_MULTIPLE), _power_factor_flag(C.PF_MIN_THRESHOLD),
                  _mad_flag(C.MAD_THRESHOLD, C.MAD_WINDOW, C.DEVIATION_WARN_PCT), keep=keep)


def all_flags(scored: DataFrame) -> DataFrame:
    return raised(with_rule_inputs(scored))


def merge_flag_runs(flags: DataFrame) -> DataFrame:
    """Numbers the runs of one rule over consecutive buckets of a machine, and the rows in them."""
    w = Window.partitionBy("machine_id", "rule_id").orderBy("k")
    runs = flags.withColumn("run_id", F.col("k") - F.row_number().over(w))
    return runs.withColumn("pos", F.row_number().over(Window.partitionBy("machine_id", "rule_id", "run_id").orderBy("k")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


_CARRIED = ("window_start", "_end", "expected_kwh", "energy_kwh", "deviation_pct")  # of the interval, with each flag
EVENT_PART_SCHEMA = ("machine_id string, rule_id string, metric string, k_first long, k_last long, window_start timestamp, window_end timestamp, "
                     "score double, crit int, expected_kwh double, actual_kwh double, gaps long, dev double, n_intervals long, first string, second string")


def event_parts(rows: DataFrame) -> DataFrame:
    """One row per run of flags (with the interval's columns) over consecutive buckets: sums that two parts can add up."""
    def text(pos): return F.max(F.when(F.col("pos") == pos, F.col("evidence")))
    ev = merge_flag_runs(rows).groupBy("machine_id", "rule_id", "metric", "run_id").agg(
        F.min("k").alias("k_first"), F.max("k").alias("k_last"), F.min("window_start").alias("window_start"), F.max("_end").alias("window_end"),
        F.max(F.abs("score")).alias("score"), F.max((F.col("severity") == "CRITICAL").cast("int")).alias("crit"),
        F.coalesce(F.sum("expected_kwh"), F.lit(0.0)).alias("expected_kwh"),
        F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("actual_kwh"),
        F.count_if(F.col("expected_kwh").isNull() | F.col("energy_kwh").isNull()).alias("gaps"),
        F.coalesce(F.sum("deviation_pct"), F.lit(0.0)).alias("dev"), F.count("*").alias("n_intervals"),
        text(1).alias("first"), text(2).alias("second"))
    return ev.drop("run_id")


def joined_parts(parts: DataFrame) -> DataFrame:
    """Parts that follow each other without a gap become one; each event is at most an old part and a new one."""
    w = Window.partitionBy("machine_id", "rule_id", "metric").orderBy("k_first")
    new = F.when(F.lag("k_last").over(w) == F.col("k_first") - 1, 0).otherwise(1)
    parts = parts.withColumn("_new", new).withColumn("_e", F.sum("_new").over(w))
    top, total = (lambda c: F.max(c).alias(c)), (lambda c: F.sum(c).alias(c))
    second = F.coalesce(F.min_by("second", "k_first"), F.when(F.count("*") > 1, F.max_by("first", "k_first"))).alias("second")
    return parts.groupBy("machine_id", "rule_id", "metric", "_e").agg(
        F.min("k_first").alias("k_first"), top("k_last"), F.min("window_start").alias("window_start"), top("window_end"), top("score"), top("crit"),
        total("expected_kwh"), total("actual_kwh"), total("gaps"), total("dev"), total("n_intervals"), F.min_by("first", "k_first").alias("first"), second).drop("_e")


def events_of(parts: DataFrame) -> DataFrame:
    """Events as they are stored, from their added-up parts."""
    more = F.when(F.col("n_intervals") > 2, F.concat(F.lit(" (+"), (F.col("n_intervals") - 2).cast("string"), F.lit(" more interval(s))"))).otherwise("")
    first_two = F.concat_ws(" ", "first", "second")
    return parts.select(
        "machine_id", "window_start", "window_end", "metric", "rule_id",
        F.when(F.col("rule_id").startswith("L1_"), "L1_rule").otherwise("L2_statistical").alias("level"), "score",
        F.when(F.col("crit") == 1, "CRITICAL").otherwise("WARNING").alias("severity"),
        "expected_kwh", "actual_kwh",
        F.when(F.col("gaps") == 0, F.col("actual_kwh") - F.col("expected_kwh")).alias("deviation_kwh"),
        (F.col("dev") / F.col("n_intervals")).alias("deviation_pct"), "n_intervals",
        F.concat(F.col("rule_id"), F.lit(": "), first_two, more).alias("evidence"),
        F.lit("OPEN").alias("status"), F.lit("DERIVED").alias("source"),
        F.concat_ws("|", "machine_id", "rule_id", iso(F.col("window_start")), iso(F.col("window_end"))).alias("dedup_key"))


def build_events(flags: DataFrame, scored: DataFrame, end_col: str = "window_end") -> DataFrame:
    """One event per run of flags, with the summed expectation and consumption."""
    rows = flags.join(scored.withColumn("_end", F.col(end_col)).select("machine_id", "k", *_CARRIED), ["machine_id", "k"])
    return events_of(event_parts(rows))


def flagged_parts(inputs: DataFrame, end_col: str = "window_end") -> DataFrame:
    """Event parts straight from rows with the rules' inputs: each flag carries what its event sums, so nothing is joined."""
    return event_parts(raised(inputs.withColumn("_end", F.col(end_col)), keep=_CARRIED))


def detect_events(scored: DataFrame, *, start: str | None = None, end: str | None = None, end_col: str = "window_end") -> DataFrame:
    """Events of all machines that have a baseline, inside [start, end)."""
    df = scored.where(F.col("has_baseline"))
    if start is not None:
        df = df.where(F.col("window_start") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("window_start") < F.lit(end).cast("timestamp"))
    return events_of(flagged_parts(with_rule_inputs(df), end_col))


def worst_open_per_machine(events: DataFrame) -> DataFrame:
    return (events.where(F.col("status") == "OPEN").groupBy("machine_id")
            .agg(F.max_by(F.struct("rule_id", "window_start", "deviation_pct", "severity"),
                          F.struct(F.coalesce("deviation_pct", F.lit(0.0)), "dedup_key")).alias("_e"))
            .select("machine_id", "_e.*"))


def rule_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("rule_id").agg(F.count("*").alias("n_events"))


def top_deviations(events: DataFrame, n: int = 5) -> DataFrame:
    return events.orderBy(F.abs(F.coalesce("deviation_pct", F.lit(0.0))).desc(), "dedup_key").limit(n)


def event_window_excess(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Energy above expectation inside flagged windows, each interval counted once.

    Events are cut into the buckets they cover, so the match is an equi join.
    """
    bounds = events.select("machine_id", F.col("window_start").alias("_ws"), F.col("window_end").alias("_we"))
    hour = F.explode(F.sequence(F.date_trunc("hour", "_ws"), F.date_trunc("hour", F.col("_we") - F.expr("interval 1 microsecond")),
                                F.expr("interval 1 hour")))
    cover = bounds.select("machine_id", "_ws", "_we", hour.alias("_hour"))
    rows = scored.where(F.col("energy_kwh").isNotNull() & F.col("expected_kwh").isNotNull()).select(
        "machine_id", "k", "window_start", "energy_kwh", "expected_kwh", F.date_trunc("hour", "window_start").alias("_hour"))
    inside = rows.join(cover, (rows.machine_id == cover.machine_id) & (rows._hour == cover._hour)
                       & (rows.window_start >= cover._ws) & (rows.window_start < cover._we), "left_semi")
    return inside.groupBy("machine_id").agg(
        F.count("*").alias("n_intervals"), F.sum(F.col("energy_kwh") - F.col("expected_kwh")).alias("extra_kwh"),
        F.sum("expected_kwh").alias("expected_kwh")).withColumn(
        "extra_pct", F.when(F.col("expected_kwh") != 0, F.col("extra_kwh") / F.col("expected_kwh") * 100.0))
