"""Rule-based recommendations for people to decide on; nothing is executed.

Every rule is a set operation over all machines. Wording stays projected: no text
claims an achieved effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom import config as C
from wattloom.functions.columns import py_round
from wattloom.operators.anomaly import iso

IDLE_METRICS = ("idle_hours", "non_productive_share", "holding_hours_per_heat")
GAP_METRICS = ("holding_hours_per_heat", "median_heat_gap_h")
OPTIMIZER_RULES = ("R-RESCHEDULE", "R-SEQUENCE")
COLUMNS = ["machine_id", "rule_id", "window_start", "window_end", "severity", "title", "reason", "confidence", "confidence_reason",
           "source_class", "projected_kwh_delta", "projected_peak_kw_delta", "projected_cost_inr_delta", "effect_class", "proposed_action",
           "constraints_considered", "assumptions", "source_module", "dedup_key"]
DAY_US = "interval 1 day"


def severity_rank(sev: Column) -> Column:
    return F.when(F.upper(sev) == "CRITICAL", 3).when(F.upper(sev) == "WARNING", 2).otherwise(1)


def dedup(rule: str, extra: Column, ws: Column | None = None, we: Column | None = None) -> Column:
    part = lambda c: F.coalesce(iso(c), F.lit("")) if c is not None else F.lit("")
    return F.concat_ws("|", F.lit(rule), F.col("machine_id"), part(ws), part(we), extra)


# What a rule asks people to do ({m}: the machine), the limits it kept in view and what it takes for granted.
_REVIEW = "a person decides; nothing is carried out by itself"
_ALTERNATIVES = "effects are views of one plan and do not add up over rows"
CONTENT = {
    "R-IDLE": ("Go through the operating plan of {m}; switch off or reassign idle and holding time without a planned pour. The effect is not quantified.",
               ("operating windows: the production plan must still be met",), ("the idle time was not needed",)),
    "R-INSPECT": ("Inspect {m} for wear, fouling or drifting sensors and compare its health signals with energy before planning maintenance.",
                  ("the inspection must fit operations",), ("the sensors report correctly",)),
    "R-PROCESS": ("Review load, idle time and scheduling of {m}; inspect it if energy stays above expectation. The effect is not quantified.",
                  ("production plan of the window",), ("the baseline still stands for normal operation",)),
    "R-RESCHEDULE": ("Move the flexible heats of {m} as the run shows, after review; figures are projections.",
                     ("limits of the plan as checked for the run",), ("tariff as recorded; an estimate until the plant confirms it", "baseline coefficients still fit the furnace", _ALTERNATIVES)),
    "R-SEQUENCE": ("Close the gaps between heats of {m} as the run shows, after review; figures are projections.",
                   ("limits of the plan as checked for the run",), ("the least holding time for pouring is kept", _ALTERNATIVES)),
    "R-NOPLAN": ("Relax one of the limits named for {m} with operations and run again; an infeasible plan has no figures.",
                 ("limits of the plan as checked for the run",), ("limits as recorded",)),
    "R-PRIORITISE": ("Inspect {m} first and go down the ranking. The effect is not quantified.",
                     ("people available for maintenance",), ("severity follows the priorities of operations",)),
}


def _finish(df: DataFrame, rule: str) -> DataFrame:
    """Common columns of a rule's rows; figures are a projection only where the row's source is one."""
    for c, t in (("projected_kwh_delta", "double"), ("projected_peak_kw_delta", "double"), ("projected_cost_inr_delta", "double")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    action, limits, assumed = CONTENT[rule]
    texts = lambda xs: F.array(*[F.lit(x) for x in xs])
    return df.withColumns({
        "rule_id": F.lit(rule), "effect_class": F.when(F.col("source_class") == "PROJECTED", "PROJECTED"),
        "proposed_action": F.replace(F.lit(action), F.lit("{m}"), F.col("machine_id")), "constraints_considered": texts((*limits, _REVIEW)),
        "assumptions": texts(assumed), "source_module": F.lit(f"recommend:{rule}")}).select(*COLUMNS)


def _digest(ref: Column, name: str) -> list[Column]:
    """Sum, xor and count of the references' hashes: names a bag of any size in fixed space and whatever the order."""
    h = F.conv(F.substring(F.md5(ref), 1, 15), 16, 10).cast("long")
    return [F.count("*").alias(f"n_{name}"), F.sum(h.cast("decimal(20,0)")).alias(f"_sum_{name}"), F.bit_xor(h).alias(f"_xor_{name}")]


def _digest_text(name: str) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in (f"n_{name}", f"_sum_{name}", f"_xor_{name}")])


def _idle_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("rule_id") == "L1_IDLE_WASTE")


def _above(findings: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    return findings.where(F.col("metric").isin(*metrics) & F.col("above_reference"))


def _found() -> Column:
    return F.concat_ws(":", F.col("day").cast("string"), F.col("metric"))


def rec_idle(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Idle-waste events and above-reference idle findings of a machine, joined to one row.

    The key names both sets by digests; ``evidence`` lists what is in them.
    """
    e = _idle_events(events).groupBy("machine_id").agg(
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
        F.max(severity_rank(F.col("severity"))).alias("_rank"), *_digest(F.col("dedup_key"), "events"))
    f = _above(findings, IDLE_METRICS).groupBy("machine_id").agg(*_digest(_found(), "findings"))
    df = e.join(f, "machine_id", "full").na.fill(0, ["n_events", "n_findings"])
    both, crit, two = (F.col("n_events") > 0) & (F.col("n_findings") > 0), (F.col("n_events") > 0) & (F.col("_rank") >= 3), F.col("n_findings") >= 2
    df = df.withColumns({
        "severity": F.when(F.col("_rank") >= 3, "CRITICAL").otherwise("WARNING"),
        "title": F.concat(F.lit("Avoid unnecessary idle/holding operation on "), "machine_id"),
        "reason": F.concat(F.lit("Energised without useful production. Open idle-waste anomalies: "), F.col("n_events").cast("string"),
                           F.lit(". Findings above reference: "), F.col("n_findings").cast("string"), F.lit(".")),
        "confidence": F.when(both, "HIGH").when(crit | two, "MEDIUM").otherwise("LOW"),
        "confidence_reason": F.when(both, "anomaly event + process finding agree").when(crit, "single CRITICAL idle-waste anomaly")
        .when(two, "two process findings above reference").otherwise("single source above reference"),
        "source_class": F.lit("DERIVED"),
        "dedup_key": dedup("R-IDLE", F.concat_ws("+", _digest_text("events"), _digest_text("findings")), F.col("window_start"), F.col("window_end"))})
    return _finish(df, "R-IDLE")


def _inspect_key() -> Column:
    top = F.when(F.size("top_signals") > 0, F.array_join(F.transform("top_signals", lambda t: t["signal"]), ", ")).otherwise("health signals")
    return dedup("R-INSPECT", F.concat("category", F.lit("+"), top), F.col("window_start"), F.col("window_end"))


def _process_key() -> Column:
    return dedup("R-PROCESS", F.col("category"), F.col("window_start"), F.col("window_end"))


def _run_key(rule: str) -> Column:
    return dedup(rule, F.col("run_id"), F.col("horizon_start"), F.col("horizon_end"))


def rec_inspect(insights: DataFrame) -> DataFrame:
    df = insights.where(F.col("category").isin("HEALTH_ONLY", "COINCIDENT"))
    crit = F.array_contains("states", "CRITICAL")
    top = F.when(F.size("top_signals") > 0, F.array_join(F.transform("top_signals", lambda t: t["signal"]), ", ")).otherwise("health signals")
    both = F.col("category") == "COINCIDENT"
    return _finish(df.withColumn("_top", top).withColumns({
        "severity": F.when(crit, "CRITICAL").otherwise("WARNING"),
        "title": F.concat(F.lit("Inspect "), F.col("machine_id"), F.lit(" ("), F.col("_top"), F.lit(")")),
        "reason": F.when(both, F.concat(F.lit("Energy anomaly coincides with machine-health anomaly ("), F.col("_top"),
                                        F.lit("). This is a correlation, not an established cause; inspection recommended.")))
        .otherwise(F.concat(F.lit("Machine-health anomaly on "), F.col("machine_id"), F.lit(" ("), F.col("_top"),
                            F.lit(") with energy within its expected range. No energy anomaly overlaps this window; inspection recommended."))),
        "confidence": F.when(both & crit, "HIGH").otherwise("MEDIUM"),
        "confidence_reason": F.when(both, "energy + health anomalies coincide").otherwise("health anomaly alone, energy normal"),
        "source_class": F.lit("DERIVED"),
        "dedup_key": _inspect_key()}), "R-INSPECT")


def rec_process(insights: DataFrame) -> DataFrame:
    df = insights.where(F.col("category").startswith("ENERGY_ONLY"))
    sev = F.upper(F.coalesce("severity", F.lit("WARNING")))
    sev = F.when(sev.isin("WARNING", "CRITICAL"), sev).otherwise("WARNING")
    missing = F.col("category") == "ENERGY_ONLY_HEALTH_UNAVAILABLE"
    crit = sev == "CRITICAL"
    return _finish(df.withColumns({
        "title": F.concat(F.lit("Review process and scheduling around "), "machine_id"),
        "reason": F.concat(F.lit("Energy above expected baseline for the production recorded with no overlapping machine-health anomaly. "),
                           F.when(missing, "Health data is missing, so a joint assessment is not possible.").otherwise("Health signals stayed within NORMAL range.")),
        "confidence": F.when(crit, "MEDIUM").otherwise("LOW"),
        "confidence_reason": F.when(crit, "sustained energy deviation above expected").otherwise("single energy deviation, health unavailable or normal"),
        "source_class": F.lit("DERIVED"), "dedup_key": _process_key(), "severity": sev}), "R-PROCESS")


def check_run_comparability(runs: DataFrame, tol: float = C.COMPARABLE_PROD_TOL) -> DataFrame:
    """Adds comparable and its reason: the stored flag if there is one, else from the metrics."""
    cp, rp = F.col("cur_production_kg"), F.col("rec_production_kg")
    aux = F.abs(F.coalesce("cur_aux_kwh", F.lit(0.0)) - F.coalesce("rec_aux_kwh", F.lit(0.0)))
    same = "same production and auxiliary tasks"
    computed = (F.when(cp.isNull() | rp.isNull(), "production data missing").when(cp == 0, "current production is zero")
                .when(F.abs(rp - cp) / cp > tol, "production differs").when(aux > 1e-6, "auxiliary tasks differ").otherwise(same))
    stored = F.col("stored_comparable")
    return runs.withColumn("comparability_reason", F.when(stored.isNotNull(), F.coalesce("stored_reason", F.lit(same))).otherwise(computed)).withColumn(
        "comparable", F.coalesce(stored, F.col("comparability_reason") == same))


def _gap(side: str) -> Column:
    return F.col(f"{side}_holding_kwh") + F.col(f"{side}_idle_kwh") + F.col(f"{side}_reheat_kwh")


def _solved(runs: DataFrame) -> DataFrame:
    df = check_run_comparability(runs.where(F.col("status").isin("OPTIMAL", "FEASIBLE") & F.col("cur_energy_kwh").isNotNull() & F.col("rec_energy_kwh").isNotNull()))
    optimal = F.col("status") == "OPTIMAL"
    per_t = lambda s: F.when(F.col(f"{s}_production_kg") > 0, py_round(F.col(f"{s}_energy_kwh") / F.col(f"{s}_production_kg") * 1000, 1))
    return df.withColumns({
        "confidence": F.when(optimal, "HIGH").otherwise("MEDIUM"),
        "_proof": F.when(optimal, "solver proved optimality").otherwise("solver returned a feasible (unproven) plan"),
        "cur_kwh_per_t": per_t("cur"), "rec_kwh_per_t": per_t("rec"), "cur_gap_kwh": _gap("cur"), "rec_gap_kwh": _gap("rec"),
        "window_start": F.col("horizon_start"), "window_end": F.col("horizon_end")})


def rec_reschedule(runs: DataFrame) -> DataFrame:
    df = _solved(runs)
    delta = lambda c, d: F.when(F.col("comparable"), py_round(F.col(f"rec_{c}") - F.col(f"cur_{c}"), d))
    df = df.where(F.coalesce(F.col("rec_cost_inr") < F.col("cur_cost_inr"), F.lit(False)) | (F.col("rec_energy_kwh") < F.col("cur_energy_kwh")))
    kwh = F.concat(F.lit("Projected schedule uses "), F.format_string("%.0f", F.bround("rec_energy_kwh", 0)), F.lit(" kWh vs current "),
                   F.format_string("%.0f", F.bround("cur_energy_kwh", 0)), F.lit(" kWh"))
    return _finish(df.withColumns({
        "severity": F.lit("WARNING"),
        "title": F.concat(F.lit("Reschedule flexible heats on "), F.col("machine_id"), F.lit(" to lower-tariff periods")),
        "reason": F.when(F.col("comparable"), F.concat(kwh, F.lit(" for the same production."))).otherwise(
            F.concat(F.lit("NOT COMPARABLE: "), F.col("comparability_reason"), F.lit(". "), kwh, F.lit(". Effect not quantified."))),
        "confidence_reason": F.col("_proof"), "source_class": F.lit("PROJECTED"),
        "projected_kwh_delta": delta("energy_kwh", 3), "projected_peak_kw_delta": delta("peak_kw", 3), "projected_cost_inr_delta": delta("cost_inr", 2),
        "dedup_key": _run_key("R-RESCHEDULE")}), "R-RESCHEDULE")


def rec_sequence(runs: DataFrame, findings: DataFrame) -> DataFrame:
    above = _above(findings, GAP_METRICS).select("machine_id").distinct().withColumn("_above", F.lit(True))
    df = _solved(runs).join(above, "machine_id", "left").withColumn("_delta", F.col("rec_gap_kwh") - F.col("cur_gap_kwh"))
    df = df.where((F.col("_delta") < 0) | (F.col("_delta").isNull() & F.coalesce("_above", F.lit(False))))
    counted = F.col("comparable") & F.col("_delta").isNotNull()
    return _finish(df.withColumns({
        "severity": F.lit("WARNING"),
        "title": F.concat(F.lit("Adjust heat sequence on "), F.col("machine_id"), F.lit(" to cut holding/idle/reheat gaps")),
        "reason": F.when(counted, "Projected holding, idle and reheat energy below the current plan.")
        .when(F.col("comparable"), "Process finding above reference.")
        .otherwise(F.concat(F.lit("NOT COMPARABLE: "), F.col("comparability_reason"), F.lit(". Effect not quantified."))),
        "confidence_reason": F.when(F.col("_delta").isNotNull(), F.col("_proof")).otherwise("process finding above reference, no projected quantity"),
        "source_class": F.when(F.col("_delta").isNotNull(), "PROJECTED").otherwise("DERIVED"),
        "projected_kwh_delta": F.when(counted, py_round("_delta", 3)),
        "dedup_key": _run_key("R-SEQUENCE")}), "R-SEQUENCE")


def rec_noplan(runs: DataFrame) -> DataFrame:
    df = runs.where(F.col("status") == "INFEASIBLE")
    return _finish(df.withColumns({
        "severity": F.lit("WARNING"), "window_start": F.col("horizon_start"), "window_end": F.col("horizon_end"),
        "title": F.concat(F.lit("No feasible rescheduling plan for "), "machine_id"),
        "reason": F.concat(F.lit("Optimizer reports INFEASIBLE for run "), F.col("run_id"), F.lit(": "), F.coalesce("explanation", F.lit("no explanation recorded")), F.lit(".")),
        "confidence": F.lit("MEDIUM"), "confidence_reason": F.lit("solver explanation names the conflicting group"), "source_class": F.lit("DERIVED"),
        "dedup_key": _run_key("R-NOPLAN")}), "R-NOPLAN")


def severity_ranking(events: DataFrame, insights: DataFrame) -> DataFrame:
    """Best severity rank per machine with an open event or an insight."""
    e = events.where(F.col("status") == "OPEN").select("machine_id", severity_rank(F.col("severity")).alias("rank"))
    i = insights.select("machine_id", F.when(F.array_contains("states", "CRITICAL"), 3).when(F.array_contains("states", "WARNING"), 2).otherwise(0).alias("rank"))
    return e.unionByName(i).groupBy("machine_id").agg(F.max("rank").alias("rank"))


def rec_prioritise(events: DataFrame, insights: DataFrame) -> DataFrame:
    """One row for the machine to look at first, when there are at least two to choose from."""
    top = severity_ranking(events, insights).agg(
        F.count("*").alias("n"), F.min_by(F.struct("machine_id", "rank"), F.struct(-F.col("rank"), F.col("machine_id"))).alias("t"))
    df = top.where(F.col("n") >= 2).select(F.col("t.machine_id").alias("machine_id"), F.col("t.rank").alias("rank"), "n")
    none = F.lit(None).cast("timestamp")
    return _finish(df.withColumns({
        "window_start": none, "window_end": none, "severity": F.lit("WARNING"),
        "title": F.concat(F.lit("Prioritise inspection of "), "machine_id"),
        "reason": F.concat(F.col("n").cast("string"), F.lit(" machines show open anomalies or health insights; "), F.col("machine_id"), F.lit(" ranks first.")),
        "confidence": F.lit("MEDIUM"), "confidence_reason": F.lit("severity ranking across machines"), "source_class": F.lit("DERIVED"),
        "dedup_key": dedup("R-PRIORITISE", F.concat(F.col("machine_id"), F.lit(" (rank "), F.col("rank").cast("string"), F.lit(")")))}), "R-PRIORITISE")


def conflict_pairs(recs: DataFrame) -> DataFrame:
    """(schedule rec, critical inspection) on one machine with overlapping windows.

    Matched on (machine, day) so a machine with many rows still spreads; a pair counts
    only on the first day both touch. Rows without a window overlap every window.
    """
    def days(df):
        known = F.col("window_start").isNotNull() & F.col("window_end").isNotNull()
        seq = F.sequence(F.date_trunc("day", "window_start"), F.date_trunc("day", F.col("window_end") - F.expr("interval 1 microsecond")), F.expr(DAY_US))
        return df.where(known).withColumn("_day", F.explode(seq)), df.where(~known)
    opt = recs.where(F.col("rule_id").isin(*OPTIMIZER_RULES)).select("machine_id", F.col("dedup_key").alias("opt_key"), "window_start", "window_end")
    ins = recs.where((F.col("rule_id") == "R-INSPECT") & (F.col("severity") == "CRITICAL")).select("machine_id", F.col("dedup_key").alias("insp_key"), "window_start", "window_end")
    (od, ou), (idd, iu) = days(opt), days(ins)
    i2 = idd.withColumnsRenamed({"window_start": "_is", "window_end": "_ie"})
    first = F.greatest(F.date_trunc("day", "window_start"), F.date_trunc("day", "_is"))
    dated = od.join(i2, ["machine_id", "_day"]).where((F.col("window_start") < F.col("_ie")) & (F.col("window_end") > F.col("_is")) & (F.col("_day") == first))
    keys = ["machine_id", "opt_key", "insp_key"]
    open_opt = ou.select("machine_id", "opt_key").join(ins.select("machine_id", "insp_key"), "machine_id")
    open_ins = opt.where("window_start is not null and window_end is not null").select("machine_id", "opt_key").join(iu.select("machine_id", "insp_key"), "machine_id")
    return dated.select(*keys).unionByName(open_opt.select(*keys)).unionByName(open_ins.select(*keys))


def mark_conflicts(recs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Adds status, conflict_with and verification_status to a set of recommendations."""
    pairs = conflict_pairs(recs) if pairs is None else pairs
    each = pairs.select(F.col("opt_key").alias("dedup_key"), F.col("insp_key").alias("_other")).unionByName(
        pairs.select(F.col("insp_key").alias("dedup_key"), F.col("opt_key").alias("_other")))
    with_ = each.groupBy("dedup_key").agg(F.array_sort(F.collect_set("_other")).alias("conflict_with"))
    df = recs.join(with_, "dedup_key", "left")
    note = F.concat(F.lit("Equipment condition on "), F.col("machine_id"), F.lit(" is uncertain while a rescheduling action is proposed. Both rows are kept; "
                    "review the inspection outcome before accepting the rescheduling plan."))
    return df.withColumns({
        "status": F.when(F.col("conflict_with").isNotNull(), "CONFLICT").otherwise("PENDING_REVIEW"),
        "conflict_note": F.when(F.col("conflict_with").isNotNull(), note).otherwise(""),
        "conflict_with": F.coalesce("conflict_with", F.array().cast("array<string>")), "verification_status": F.lit("NOT_VERIFIED")})


def candidates(events: DataFrame, insights: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    out = rec_idle(events, findings)
    for part in (rec_inspect(insights), rec_process(insights), rec_reschedule(runs), rec_sequence(runs, findings), rec_noplan(runs),
                 rec_prioritise(events, insights)):
        out = out.unionByName(part)
    return out


def generate_recommendations(events: DataFrame, insights: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """All rules, conflicts marked, one row per dedup key (the more severe one where two share it)."""
    return mark_conflicts(one_per_key(candidates(events, insights, findings, runs)))


def one_per_key(found: DataFrame) -> DataFrame:
    rest = [c for c in found.columns if c != "dedup_key"]
    return found.groupBy("dedup_key").agg(F.min_by(F.struct(*rest), F.struct(-severity_rank(F.col("severity")), F.col("confidence"), F.col("reason"))).alias("_r")).select("dedup_key", "_r.*")


RUN_MEASURES = {"R-RESCHEDULE": ("energy_kwh", "cost_inr", "peak_kw", "kwh_per_t"), "R-SEQUENCE": ("gap_kwh", "holding_kwh", "idle_kwh", "reheat_kwh")}


def evidence(recs: DataFrame, events: DataFrame, findings: DataFrame, insights: DataFrame, runs: DataFrame) -> DataFrame:
    """What each recommendation rests on: one row per (recommendation, source row, measure), never an array of them.

    ``kind`` is anomaly, finding, insight, signal, run, limit or rank; ``ref`` names the source row; ``value`` stands beside
    ``reference`` (a finding's reference, a signal's median, the current plan beside the proposed one). Null measures have no row,
    but an insight always has one.
    """
    none = F.lit(None).cast("double")

    def edges(df, key, kind, ref, measure, value, reference=none):
        return df.select(key.alias("dedup_key"), F.lit(kind).alias("kind"), ref.alias("ref"), measure.alias("measure"),
                         value.cast("double").alias("value"), reference.cast("double").alias("reference"))

    def of(rule): return recs.where(F.col("rule_id") == rule).select("machine_id", F.col("dedup_key").alias("_key"))
    key, dev = F.col("_key"), F.lit("deviation_pct")
    idle = of("R-IDLE")
    out = [edges(_idle_events(events).join(idle, "machine_id"), key, "anomaly", F.col("dedup_key"), dev, F.col("deviation_pct")),
           edges(_above(findings, IDLE_METRICS).join(idle, "machine_id"), key, "finding", _found(), F.col("metric"), F.col("value"), F.col("reference")),
           edges(insights, F.when(F.col("category").startswith("ENERGY_ONLY"), _process_key()).otherwise(_inspect_key()), "insight", F.col("category"), dev, F.col("deviation_pct")),
           edges(insights.withColumn("_k", _inspect_key()).select("_k", F.explode("top_signals").alias("t")), F.col("_k"), "signal", F.col("t.signal"), F.lit("robust_z"), F.col("t.z"), F.col("t.median"))]
    solved = _solved(runs)
    for rule, measures in RUN_MEASURES.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"rec_{m}").cast("double").alias("v"), F.col(f"cur_{m}").cast("double").alias("r")) for m in measures]))
        rows = solved.select(_run_key(rule).alias("_k"), "run_id", pairs.alias("x")).where("x.v IS NOT NULL OR x.r IS NOT NULL")
        out.append(edges(rows, F.col("_k"), "run", F.col("run_id"), F.col("x.m"), F.col("x.v"), F.col("x.r")))
    out.append(edges(runs.where("status = 'INFEASIBLE'"), _run_key("R-NOPLAN"), "limit", F.col("run_id"), F.coalesce("explanation", F.lit("no explanation recorded")), none))
    first = of("R-PRIORITISE").select("_key")  # one row at most
    out.append(edges(severity_ranking(events, insights).crossJoin(first), key, "rank", F.col("machine_id"), F.lit("rank"), F.col("rank")))
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    return union.join(recs.select("dedup_key", "machine_id", "rule_id"), "dedup_key").distinct()


def merge_generation(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored table after a generation: new keys added; undecided stored rows pick up a conflict."""
    fresh = new.join(stored.select("dedup_key"), "dedup_key", "left_anti")
    hit = new.where(F.size("conflict_with") > 0).select("dedup_key", F.col("conflict_with").alias("_cw"), F.col("conflict_note").alias("_cn"))
    may = F.col("_cw").isNotNull() & F.col("status").isin("PENDING_REVIEW", "CONFLICT")
    kept = stored.join(hit, "dedup_key", "left").withColumns({
        "conflict_with": F.when(may, F.col("_cw")).otherwise(F.col("conflict_with")),
        "conflict_note": F.when(may, F.col("_cn")).otherwise(F.col("conflict_note")),
        "status": F.when(may, "CONFLICT").otherwise(F.col("status"))}).drop("_cw", "_cn")
    return kept.unionByName(fresh)


def decide(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of each decision (dedup_key, decision): applied, or why it was refused."""
    d = decisions.join(recs.select("dedup_key", "status"), "dedup_key", "left")
    allowed = F.col("status").isin("PENDING_REVIEW", "CONFLICT") & F.col("decision").isin("APPROVED", "REJECTED")
    result = F.when(F.col("status").isNull(), "unknown recommendation").when(allowed, "decided").otherwise("already decided or past review")
    return d.select("dedup_key", F.col("status").alias("from_status"), "decision", result.alias("result"),
                    F.when(allowed, F.col("decision")).otherwise(F.col("status")).alias("to_status"))

