"""Energy events against machine-health intervals by time overlap.

Wording stays non-causal: two things coincide, an inspection is recommended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases no generated text may contain, and the one allowed sentence part.
BANNED_PHRASES = ("cause", "caused", "because", "due to", "results from")
ALLOWED_PHRASE = "not an established cause"
SAVINGS_PHRASES = ("saves", "saved", "saving", "savings", "achieved", "will save", "reduces cost by", "reduces", "reduce")

ABNORMAL = ("WARNING", "CRITICAL")


def hour_buckets(start: Column, end: Column) -> Column:
    """Hours touched by [start, end): the equi-join key of an overlap join."""
    last = F.date_trunc("hour", end - F.expr("interval 1 microsecond"))
    return F.explode(F.sequence(F.date_trunc("hour", start), last, F.expr("interval 1 hour")))


def overlap_pairs(events: DataFrame, health: DataFrame) -> DataFrame:
    """(dedup_key, health window) for every half-open overlap on the same machine.

    Both sides are cut into hours, so the join has a hashable key even when one machine
    dominates. A pair is taken only in the first hour the two share, so none repeats.
    """
    e = events.select("machine_id", "dedup_key", F.col("window_start").alias("e_start"), F.col("window_end").alias("e_end"))
    e = e.withColumn("hour", hour_buckets(F.col("e_start"), F.col("e_end")))
    h = health.select("machine_id", F.col("window_start").alias("h_start"), F.col("window_end").alias("h_end"), "state", "status", "contributions")
    h = h.withColumn("hour", hour_buckets(F.col("h_start"), F.col("h_end")))
    first = F.greatest(F.date_trunc("hour", "e_start"), F.date_trunc("hour", "h_start"))
    return (e.join(h, ["machine_id", "hour"])
            .where((F.col("e_start") < F.col("h_end")) & (F.col("e_end") > F.col("h_start")) & (F.col("hour") == first)).drop("hour"))


def is_abnormal() -> Column:
    return F.col("state").isin(*ABNORMAL) & (F.col("status") == "OK")


def _evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: states seen, and per signal the contribution with the largest |z|, top three."""
    c = rows.select(*keys, "h_start", F.explode("contributions").alias("c"))
    # reference order: first contribution reaching the maximum wins, rows in time order
    best = c.groupBy(*keys, F.col("c.signal").alias("signal")).agg(
        F.max_by(F.struct("c.z", "c.pct_change", "c.median", "c.value"),
                 F.struct(F.abs("c.z"), -F.unix_micros("h_start"))).alias("b"),
        F.min(F.struct(F.col("h_start"), F.col("c.rank"))).alias("seen"))
    item = F.struct((-F.abs("b.z")).alias("o"), F.col("seen"), "signal", F.col("b.z").alias("z"), F.col("b.pct_change").alias("pct_change"),
                    F.col("b.median").alias("median"), F.col("b.value").alias("value"))
    top = best.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(item)), 1, 3).alias("_top"),
                                  F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seen", "signal"))), lambda s: s["signal"]), 1, 3).alias("_names"))
    states = rows.groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.array_sort(F.collect_set("state")).alias("states"),
                                     F.min("h_start").alias("h_first"), F.max("h_end").alias("h_last"))
    return states.join(top, keys, "left").select(
        *keys, "n_intervals", "states", "h_first", "h_last",
        F.transform("_top", lambda t: F.struct(t["signal"].alias("signal"), t["z"].alias("z"), t["pct_change"].alias("pct_change"),
                                               t["median"].alias("median"), t["value"].alias("value"))).alias("top_signals"),
        F.coalesce(F.when(F.size("_names") > 0, F.array_join("_names", ", ")), F.lit("health signals")).alias("signals"))


health_evidence = _evidence

INSIGHT = ["category", "machine_id", "window_start", "window_end", "rule_id", "severity", "deviation_pct", "dedup_key",
           "n_intervals", "states", "top_signals", "signals"]


def coincident(events: DataFrame, pairs: DataFrame) -> DataFrame:
    ev = _evidence(pairs.where(is_abnormal()), ["dedup_key"])
    return events.join(ev, "dedup_key").select(
        F.lit("COINCIDENT").alias("category"), "machine_id", F.least("window_start", "h_first").alias("window_start"),
        F.greatest("window_end", "h_last").alias("window_end"), "rule_id", "severity", "deviation_pct", "dedup_key",
        ev.n_intervals, "states", "top_signals", "signals")


def energy_only(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events without abnormal overlap: health normal, or no usable health row at all."""
    per = pairs.groupBy("dedup_key").agg(
        F.count("*").alias("_n"), F.count_if(F.col("status") == "OK").alias("_ok"), F.count_if(is_abnormal()).alias("_abn"))
    df = events.drop("n_intervals").join(per, "dedup_key", "left").where(F.coalesce("_abn", F.lit(0)) == 0)
    missing = F.coalesce("_ok", F.lit(0)) == 0
    empty = F.array().cast("array<struct<signal:string,z:double,pct_change:double,median:double,value:double>>")
    return df.select(
        F.when(missing, "ENERGY_ONLY_HEALTH_UNAVAILABLE").otherwise("ENERGY_ONLY").alias("category"), "machine_id", "window_start",
        "window_end", "rule_id", "severity", "deviation_pct", "dedup_key",
        F.when(missing, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).alias("n_intervals"),
        F.when(missing, F.array().cast("array<string>")).otherwise(F.array(F.lit("NORMAL"))).alias("states"), empty.alias("top_signals"),
        F.lit(None).cast("string").alias("signals"))


def health_only(health: DataFrame, pairs: DataFrame) -> DataFrame:
    """Abnormal rows no event touches, merged while they follow on from the previous row."""
    abn = health.where(is_abnormal()).select("machine_id", F.col("window_start").alias("h_start"), F.col("window_end").alias("h_end"),
                                             "state", "status", "contributions")
    matched = pairs.where(is_abnormal()).select("machine_id", "h_start", "h_end").distinct()
    w = Window.partitionBy("machine_id").orderBy("h_start", "h_end")
    rows = abn.join(matched, ["machine_id", "h_start", "h_end"], "left_anti")
    rows = rows.withColumn("_new", (F.lag("h_end").over(w).isNull() | (F.col("h_start") > F.lag("h_end").over(w))).cast("long"))
    rows = rows.withColumn("run_id", F.sum("_new").over(w)).drop("_new")
    ev = _evidence(rows, ["machine_id", "run_id"])
    none = F.lit(None)
    return ev.select(F.lit("HEALTH_ONLY").alias("category"), "machine_id", F.col("h_first").alias("window_start"), F.col("h_last").alias("window_end"),
                     none.cast("string").alias("rule_id"), none.cast("string").alias("severity"), none.cast("double").alias("deviation_pct"),
                     none.cast("string").alias("dedup_key"), "n_intervals", "states", "top_signals", "signals")


def correlate(events: DataFrame, health: DataFrame) -> DataFrame:
    """All insights with their text and next step."""
    pairs = overlap_pairs(events, health)
    df = coincident(events, pairs).unionByName(energy_only(events, pairs)).unionByName(health_only(health, pairs))
    return with_texts(df)


def with_texts(df: DataFrame) -> DataFrame:
    m, n = F.col("machine_id"), F.col("n_intervals").cast("string")
    sig = F.col("signals")
    cat = F.col("category")
    text = (F.when(cat == "COINCIDENT", F.concat(
        F.lit("Energy anomaly coincides with machine-health anomaly ("), sig,
        F.lit("). This is a correlation, not an established cause; inspection recommended.")))
        .when(cat == "ENERGY_ONLY_HEALTH_UNAVAILABLE", F.concat(
            F.lit("Energy anomaly on "), m, F.lit(" with no matching machine-health record ("), n,
            F.lit(" overlapping interval(s) unavailable). Health data is missing, so a joint assessment is not possible; inspection recommended.")))
        .when(cat == "ENERGY_ONLY", F.concat(
            F.lit("Energy anomaly on "), m, F.lit(" while machine-health signals stayed within their NORMAL range. No health anomaly overlaps "
                                                  "this window; inspection recommended if the deviation persists.")))
        .otherwise(F.concat(F.lit("Machine-health anomaly on "), m, F.lit(" ("), sig,
                            F.lit(") with energy within its expected range. No energy anomaly overlaps this window; inspection recommended."))))
    step = (F.when(cat == "COINCIDENT", F.concat(F.lit("Inspect "), m, F.lit(" for wear, fouling or sensor drift before scheduling maintenance.")))
            .when(cat == "ENERGY_ONLY_HEALTH_UNAVAILABLE", F.concat(F.lit("Check the health sensors on "), m, F.lit(", then inspect the machine.")))
            .when(cat == "ENERGY_ONLY", F.concat(F.lit("Review process and scheduling around "), m, F.lit(" (idle time, load changes).")))
            .otherwise(F.concat(F.lit("Inspect "), m, F.lit(" for early wear; energy use is normal so no process change is indicated."))))
    return df.withColumns({"text": text, "next_step": step})


def text_guard(df: DataFrame, text: str = "text", banned: tuple[str, ...] = BANNED_PHRASES, allowed: str = ALLOWED_PHRASE) -> DataFrame:
    """Rows whose text holds a banned phrase as whole words (the allowed part is taken out first)."""
    cleaned = F.regexp_replace(F.lower(F.col(text)), allowed, "")
    return df.where(cleaned.rlike(r"\b(" + "|".join(banned) + r")\b"))
