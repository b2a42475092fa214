"""Registered queries: recommendations, lifecycle, interventions and verified savings."""

from pyspark.sql import functions as F

from wattloom.functions.columns import local_time
from wattloom.operators import process, reads
from wattloom.operators import recommend as R
from wattloom.operators import verify as V
from wattloom.plans import queries_health as QH
from wattloom.plans import queries_schedule as QS
from wattloom.plans.common import S, fragment, query

_SIDE = ["energy_kwh", "peak_kw", "cost_inr", "production_kg", "holding_kwh", "idle_kwh", "reheat_kwh", "aux_kwh"]

fragment("f_run", """
SELECT c.plan_id AS run_id, c.machine_id, c.day - INTERVAL 330 MINUTE AS horizon_start, c.day + INTERVAL 1110 MINUTE AS horizon_end,
 CASE WHEN groups <> '' THEN 'INFEASIBLE' ELSE 'FEASIBLE' END AS status, nullif(groups, '') AS explanation,
 """ + ", ".join(f"c.{s} AS cur_{s}, CASE WHEN coalesce(groups, '') = '' THEN r.{s} END AS rec_{s}" for s in _SIDE) + """
FROM f_evcur c JOIN f_evrec r USING (plan_id) LEFT JOIN f_infeas USING (plan_id)
""")
fragment("f_runc", """
SELECT *, CASE WHEN rec_production_kg IS NULL THEN 'production data missing' WHEN cur_production_kg = 0 THEN 'current production is zero'
 WHEN abs(rec_production_kg - cur_production_kg) / cur_production_kg > 0.01 THEN 'production differs' WHEN abs(cur_aux_kwh - rec_aux_kwh) > 1e-6 THEN 'auxiliary tasks differ'
 ELSE 'same production and auxiliary tasks' END AS creason, creason = 'same production and auxiliary tasks' AS comparable FROM f_run
""")


def runs(p):
    """One run per furnace-day: the observed day against the back-to-back plan, which proves nothing (FEASIBLE).

    A day whose limits cannot be met has no plan (INFEASIBLE), explained by the groups of limits that fail.
    """
    cur = QS.evaluated(p, "cur").select(*QS.K.PLAN, *[F.col(c).alias(f"cur_{c}") for c in _SIDE])
    rec = QS.evaluated(p, "rec").select("plan_id", *[F.col(c).alias(f"rec_{c}") for c in _SIDE])
    failing = QS.infeasible(p).select("plan_id", F.nullif(F.array_join("groups", "; "), F.lit("")).alias("explanation"))
    df = cur.join(rec, "plan_id").join(failing, "plan_id", "left")
    met = F.col("explanation").isNull()
    df = df.withColumns({f"rec_{c}": F.when(met, F.col(f"rec_{c}")) for c in _SIDE})
    start = F.to_utc_timestamp(F.col("day").cast("timestamp"), "Asia/Kolkata")
    return df.select(F.col("plan_id").alias("run_id"), "machine_id", start.alias("horizon_start"), (start + F.expr("interval 1 day")).alias("horizon_end"),
                     F.when(met, "FEASIBLE").otherwise("INFEASIBLE").alias("status"), "explanation", F.lit(None).cast("boolean").alias("stored_comparable"),
                     F.lit(None).cast("string").alias("stored_reason"), (start + F.expr("interval 1 day")).alias("created_at"),
                     *[f"{s}_{c}" for c in _SIDE for s in ("cur", "rec")])


fragment("f_ridle", """
SELECT coalesce(e.machine_id, f.machine_id) AS machine_id, 'R-IDLE' AS rule_id, window_start, window_end, CASE WHEN rk >= 3 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 CASE WHEN ne > 0 AND nf > 0 THEN 'HIGH' WHEN (ne > 0 AND rk >= 3) OR nf >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, NULL::DOUBLE AS projected_kwh_delta, NULL::DOUBLE AS projected_cost_inr_delta,
 'R-IDLE|' || coalesce(e.machine_id, f.machine_id) || '|' || coalesce(strftime(window_start, '%Y-%m-%dT%H:%M:%S+00:00'), '') || '|' || coalesce(strftime(window_end, '%Y-%m-%dT%H:%M:%S+00:00'), '')
 || '|' || coalesce(ids, '0:0:0') || '+' || coalesce(found, '0:0:0') AS dedup_key
FROM (SELECT machine_id, count(*) AS ne, min(window_start) AS window_start, max(window_end) AS window_end, max(CASE severity WHEN 'CRITICAL' THEN 3 ELSE 2 END) AS rk,
  count(*) || ':' || sum(('0x' || substr(md5(dedup_key), 1, 15))::BIGINT) || ':' || bit_xor(('0x' || substr(md5(dedup_key), 1, 15))::BIGINT) AS ids FROM f_ev WHERE rule_id = 'L1_IDLE_WASTE' GROUP BY 1) e
FULL JOIN (SELECT machine_id, count(*) AS nf, count(*) || ':' || sum(('0x' || substr(md5(CAST(day AS VARCHAR) || ':' || metric), 1, 15))::BIGINT) || ':' || bit_xor(('0x' || substr(md5(CAST(day AS VARCHAR) || ':' || metric), 1, 15))::BIGINT) AS found
 FROM f_find WHERE above_reference AND metric IN ('idle_hours', 'non_productive_share', 'holding_hours_per_heat') GROUP BY 1) f ON f.machine_id = e.machine_id
""")
_KEY = "machine_id || '|' || strftime(window_start, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || strftime(window_end, '%Y-%m-%dT%H:%M:%S+00:00') || '|'"
fragment("f_rinsp", f"""
SELECT machine_id, 'R-INSPECT' AS rule_id, window_start, window_end, CASE WHEN contains(states, 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 CASE WHEN category = 'COINCIDENT' AND contains(states, 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, NULL::DOUBLE AS projected_kwh_delta, NULL::DOUBLE AS projected_cost_inr_delta,
 'R-INSPECT|' || {_KEY} || category || '+' || replace(top_signals, '; ', ', ') AS dedup_key FROM f_ins WHERE category IN ('HEALTH_ONLY', 'COINCIDENT')
""")
fragment("f_rproc", f"""
SELECT machine_id, 'R-PROCESS' AS rule_id, window_start, window_end, severity, CASE WHEN severity = 'CRITICAL' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, NULL::DOUBLE AS projected_kwh_delta,
 NULL::DOUBLE AS projected_cost_inr_delta, 'R-PROCESS|' || {_KEY} || category AS dedup_key FROM f_ins WHERE category LIKE 'ENERGY_ONLY%'
""")
_RUN = "SELECT machine_id, '{rule}' AS rule_id, horizon_start AS window_start, horizon_end AS window_end, 'WARNING' AS severity, {conf} AS confidence, {kwh} AS projected_kwh_delta, {inr} AS projected_cost_inr_delta, '{rule}|' || machine_id || '|' || strftime(horizon_start, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || strftime(horizon_end, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || run_id AS dedup_key FROM f_runc WHERE "
_CONF = "CASE status WHEN 'OPTIMAL' THEN 'HIGH' ELSE 'MEDIUM' END"
fragment("f_rresch", _RUN.format(rule="R-RESCHEDULE", conf=_CONF, kwh="CASE WHEN comparable THEN round_even(rec_energy_kwh - cur_energy_kwh, 3) END",
                                 inr="CASE WHEN comparable THEN round_even(rec_cost_inr - cur_cost_inr, 2) END")
         + "status <> 'INFEASIBLE' AND (rec_cost_inr < cur_cost_inr OR rec_energy_kwh < cur_energy_kwh)")
_GAP = "(rec_holding_kwh + rec_idle_kwh + rec_reheat_kwh) - (cur_holding_kwh + cur_idle_kwh + cur_reheat_kwh)"
fragment("f_rseq", _RUN.format(rule="R-SEQUENCE", conf=_CONF, kwh=f"CASE WHEN comparable THEN round_even({_GAP}, 3) END", inr="NULL::DOUBLE")
         + f"status <> 'INFEASIBLE' AND {_GAP} < 0")
fragment("f_rnop", _RUN.format(rule="R-NOPLAN", conf="'MEDIUM'", kwh="NULL::DOUBLE", inr="NULL::DOUBLE") + "status = 'INFEASIBLE'")
fragment("f_rank", """
SELECT machine_id, max(r) AS rank FROM (SELECT machine_id, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END AS r FROM f_ev
 UNION ALL SELECT machine_id, CASE WHEN contains(states, 'CRITICAL') THEN 3 WHEN contains(states, 'WARNING') THEN 2 ELSE 0 END FROM f_ins) GROUP BY 1
""")
fragment("f_rprio", """
SELECT machine_id, 'R-PRIORITISE' AS rule_id, NULL::TIMESTAMP AS window_start, NULL::TIMESTAMP AS window_end, 'WARNING' AS severity, 'MEDIUM' AS confidence, NULL::DOUBLE AS projected_kwh_delta,
 NULL::DOUBLE AS projected_cost_inr_delta, 'R-PRIORITISE|' || machine_id || '|||' || machine_id || ' (rank ' || rank || ')' AS dedup_key FROM f_rank WHERE (SELECT count(*) FROM f_rank) >= 2
QUALIFY row_number() OVER (ORDER BY rank DESC, machine_id) = 1
""")
fragment("f_recs", """
SELECT DISTINCT ON (dedup_key) * FROM (SELECT * FROM f_ridle UNION ALL SELECT * FROM f_rinsp UNION ALL SELECT * FROM f_rproc UNION ALL SELECT * FROM f_rresch
 UNION ALL SELECT * FROM f_rseq UNION ALL SELECT * FROM f_rnop UNION ALL SELECT * FROM f_rprio) ORDER BY dedup_key, severity, confidence
""")
fragment("f_conf", """
SELECT o.machine_id, o.dedup_key AS opt_key, i.dedup_key AS insp_key FROM f_recs o JOIN f_recs i ON o.machine_id = i.machine_id AND o.rule_id IN ('R-RESCHEDULE', 'R-SEQUENCE')
 AND i.rule_id = 'R-INSPECT' AND i.severity = 'CRITICAL' AND (o.window_start IS NULL OR i.window_start IS NULL OR (o.window_start < i.window_end AND o.window_end > i.window_start))
""")
fragment("f_recsx", """
SELECT r.*, CASE WHEN cw IS NOT NULL THEN 'CONFLICT' ELSE 'PENDING_REVIEW' END AS status, coalesce(cw, '') AS conflict_with FROM f_recs r LEFT JOIN (
 SELECT k, array_to_string(list_sort(list(DISTINCT other)), '; ') AS cw FROM (SELECT opt_key AS k, insp_key AS other FROM f_conf UNION ALL SELECT insp_key, opt_key FROM f_conf) GROUP BY 1) c ON c.k = r.dedup_key
""")

_REC = ["machine_id", "rule_id", "window_start", "window_end", "severity", "confidence", "projected_kwh_delta", "projected_cost_inr_delta", "dedup_key"]
_REC_SQL = ("SELECT machine_id, rule_id, window_start, window_end, severity, confidence, round(projected_kwh_delta, 4) AS projected_kwh_delta, "
            "round(projected_cost_inr_delta, 4) AS projected_cost_inr_delta, dedup_key FROM ")


def recommendations(p):
    return p.stage("recommendations", lambda: R.mark_conflicts(candidates(p)))


def candidates(p):
    """One row per key, written once: the search for conflicts reads it six times."""
    return p.stage("candidates", lambda: R.one_per_key(R.candidates(p.events(), QH.insights(p), QH.findings(p), run_table(p))))


def run_table(p):
    return p.stage("runs", lambda: runs(p))


@query("rec_idle", _REC_SQL + "f_ridle")
def _(p):
    return R.rec_idle(p.events(), QH.findings(p)).select(*_REC)


@query("rec_inspect", _REC_SQL + "f_rinsp")
def _(p):
    return R.rec_inspect(QH.insights(p)).select(*_REC)


@query("rec_process", _REC_SQL + "f_rproc")
def _(p):
    return R.rec_process(QH.insights(p)).select(*_REC)


@query("rec_reschedule", _REC_SQL + "f_rresch")
def _(p):
    return R.rec_reschedule(run_table(p)).select(*_REC)


@query("rec_sequence", _REC_SQL + "f_rseq")
def _(p):
    return R.rec_sequence(run_table(p), QH.findings(p)).select(*_REC)


@query("rec_noplan", _REC_SQL + "f_rnop")
def _(p):
    return R.rec_noplan(run_table(p)).select(*_REC)


@query("severity_ranking", "SELECT machine_id, rank::BIGINT AS rank FROM f_rank")
def _(p):
    return R.severity_ranking(p.events(), QH.insights(p))


@query("rec_prioritise", _REC_SQL + "f_rprio")
def _(p):
    return R.rec_prioritise(p.events(), QH.insights(p)).select(*_REC)


@query("mark_conflicts", "SELECT dedup_key, status, conflict_with FROM f_recsx WHERE status = 'CONFLICT'")
def _(p):
    return R.mark_conflicts(candidates(p)).where("status = 'CONFLICT'").select("dedup_key", "status", "conflict_with")


@query("check_run_comparability", "SELECT run_id, comparable, creason AS comparability_reason FROM f_runc")
def _(p):
    return R.check_run_comparability(run_table(p)).select("run_id", "comparable", "comparability_reason")


@query("generate_recommendations", _REC_SQL.replace("dedup_key FROM", "dedup_key, status FROM") + "f_recsx")
def _(p):
    return recommendations(p).select(*_REC, "status")


@query("recommendation_content", "SELECT dedup_key, CASE rule_id " + " ".join(
    f"WHEN '{rule}' THEN replace('{action}', '{{m}}', machine_id)" for rule, (action, _, _) in R.CONTENT.items()) + " END AS proposed_action, CASE rule_id " + " ".join(
    f"WHEN '{rule}' THEN '{'; '.join(xs)}'" for rule, (_, _, xs) in R.CONTENT.items()) + " END AS assumptions, "
    "CASE WHEN rule_id IN ('R-RESCHEDULE', 'R-SEQUENCE') THEN 'PROJECTED' END AS effect_class, 'recommend:' || rule_id AS source_module FROM f_recsx")
def _(p):
    return recommendations(p).select("dedup_key", "proposed_action", "assumptions", "effect_class", "source_module")


_PAIR = " UNION ALL ".join(f"SELECT '{rule}|' || machine_id || '|' || strftime(horizon_start, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || strftime(horizon_end, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || run_id AS k, 'run' AS kind, "
                           f"run_id AS ref, '{m}' AS measure, {value.format('rec')} AS value, {value.format('cur')} AS reference FROM f_runc WHERE status <> 'INFEASIBLE'"
                           for rule, ms in R.RUN_MEASURES.items() for m in ms
                           for value in [{"kwh_per_t": "CASE WHEN {0}_production_kg > 0 THEN round_even({0}_energy_kwh / {0}_production_kg * 1000, 1) END",
                                          "gap_kwh": "({0}_holding_kwh + {0}_idle_kwh + {0}_reheat_kwh)"}.get(m, "{0}_" + m)])


@query("recommendation_evidence", f"""
SELECT DISTINCT k AS dedup_key, machine_id, rule_id, kind, ref, measure, round(value, 4) AS value, round(reference, 4) AS reference FROM f_recs JOIN (
 SELECT i.dedup_key AS k, 'anomaly' AS kind, e.dedup_key AS ref, 'deviation_pct' AS measure, deviation_pct AS value, NULL::DOUBLE AS reference FROM f_ridle i JOIN f_ev e ON i.machine_id = e.machine_id AND e.rule_id = 'L1_IDLE_WASTE'
 UNION ALL SELECT i.dedup_key, 'finding', CAST(day AS VARCHAR) || ':' || metric, metric, round(value + 1e-9, digits), reference FROM f_ridle i JOIN f_find f ON i.machine_id = f.machine_id AND above_reference
  AND metric IN ('idle_hours', 'non_productive_share', 'holding_hours_per_heat')
 UNION ALL SELECT CASE WHEN category LIKE 'ENERGY_ONLY%' THEN 'R-PROCESS|' || {_KEY} || category ELSE 'R-INSPECT|' || {_KEY} || category || '+' || replace(top_signals, '; ', ', ') END, 'insight', category, 'deviation_pct', deviation_pct, NULL FROM f_ins
 UNION ALL SELECT 'R-INSPECT|' || {_KEY} || category || '+' || replace(top_signals, '; ', ', '), 'signal', unnest(string_split(top_signals, '; ')), 'robust_z', NULL, NULL FROM f_ins WHERE category NOT LIKE 'ENERGY_ONLY%' AND top_signals <> ''
 UNION ALL SELECT * FROM ({_PAIR}) WHERE value IS NOT NULL OR reference IS NOT NULL
 UNION ALL SELECT dedup_key, 'limit', run_id, explanation, NULL, NULL FROM f_rnop JOIN f_run ON f_rnop.machine_id = f_run.machine_id AND f_rnop.window_start = horizon_start
 UNION ALL SELECT dedup_key, 'rank', k.machine_id, 'rank', k.rank, NULL FROM f_rprio, f_rank k) ON k = dedup_key
""")
def _(p):
    df = R.evidence(recommendations(p), p.events(), QH.findings(p), QH.insights(p), run_table(p))
    # a signal's figures are those of health_evidence and compared there
    return df.withColumns({c: F.when(F.col("kind") != "signal", F.col(c)) for c in ("value", "reference")}).distinct()


@query("merge_generation", """
SELECT dedup_key, CASE WHEN conflict_with <> '' THEN CASE WHEN h % 4 = 0 THEN 'APPROVED' ELSE 'CONFLICT' END WHEN h % 4 = 0 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status FROM (
 SELECT *, length(dedup_key) AS h FROM f_recsx)
""")
def _(p):
    new = recommendations(p)
    h = F.length("dedup_key") % 4
    none = F.array().cast("array<string>")
    stored = new.where(h < 2).withColumns({"status": F.when(h == 0, "APPROVED").otherwise("PENDING_REVIEW"), "conflict_with": none, "conflict_note": F.lit("")})
    return R.merge_generation(new, stored).select("dedup_key", "status")


@query("list_recommendations", "SELECT dedup_key, rule_id, status FROM f_recsx WHERE machine_id = 'furnace-01' AND status = 'PENDING_REVIEW'")
def _(p):
    return reads.listing(recommendations(p), "window_start", machine_id="furnace-01", status="PENDING_REVIEW").select("dedup_key", "rule_id", "status")


@query("latest_run_per_machine", """
SELECT machine_id, run_id, status, horizon_start FROM f_run WHERE horizon_start < TIMESTAMP '2024-01-20' AND horizon_end > TIMESTAMP '2024-01-10'
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY horizon_end DESC) = 1
""")
def _(p):
    return reads.latest_run_per_machine(run_table(p), "2024-01-10", "2024-01-20").select("machine_id", "run_id", "status", "horizon_start")


@query("decide", """
SELECT dedup_key, from_status, decision, CASE WHEN from_status IS NULL THEN 'unknown recommendation' WHEN from_status IN ('PENDING_REVIEW', 'CONFLICT') AND decision IN ('APPROVED', 'REJECTED') THEN 'decided'
 ELSE 'already decided or past review' END AS result FROM (
 SELECT dedup_key, CASE length(dedup_key) % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'APPLIED' END AS decision, status AS from_status FROM f_recsx
 UNION ALL SELECT dedup_key || '?', 'APPROVED', NULL FROM f_recsx)
""")
def _(p):
    r = recommendations(p)
    h = F.length("dedup_key") % 3
    d = r.select("dedup_key", F.when(h == 0, "APPROVED").when(h == 1, "REJECTED").otherwise("APPLIED").alias("decision"))
    d = d.unionByName(r.select(F.concat("dedup_key", F.lit("?")).alias("dedup_key"), F.lit("APPROVED").alias("decision")))
    return R.decide(r, d).select("dedup_key", "from_status", "decision", "result")


# -- lifecycle ----------------------------------------------------------------------
fragment("f_log", """
SELECT 'rec-' || (user_id % 97) AS entity, event_id AS seq, ['APPROVED', 'REJECTED', 'APPLIED', 'MEASURED', 'VERIFIED', 'NOT_VERIFIED', 'APPROVED'][CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 + 1] AS target FROM events
""")
fragment("f_st1", "SELECT entity, min(seq) AS s, arg_min(target, seq) AS t FROM f_log WHERE target IN ('APPROVED', 'REJECTED') GROUP BY 1")
fragment("f_st2", "SELECT l.entity, min(l.seq) AS s FROM f_log l JOIN f_st1 a ON a.entity = l.entity AND a.t = 'APPROVED' AND l.seq > a.s WHERE l.target = 'APPLIED' GROUP BY 1")
fragment("f_st3", "SELECT l.entity, min(l.seq) AS s FROM f_log l JOIN f_st2 a ON a.entity = l.entity AND l.seq > a.s WHERE l.target = 'MEASURED' GROUP BY 1")
fragment("f_st4", "SELECT l.entity, min(l.seq) AS s FROM f_log l JOIN f_st3 a ON a.entity = l.entity AND l.seq > a.s WHERE l.target IN ('VERIFIED', 'NOT_VERIFIED') GROUP BY 1")
fragment("f_fold", """
SELECT l.*, stage, stage IS NOT NULL AS legal FROM f_log l LEFT JOIN (SELECT entity, s AS seq, 1 AS stage FROM f_st1 UNION ALL SELECT entity, s, 2 FROM f_st2
 UNION ALL SELECT entity, s, 3 FROM f_st3 UNION ALL SELECT entity, s, 4 FROM f_st4) x USING (entity, seq)
""")


def status_log(p):
    names = F.array(*[F.lit(x) for x in ("APPROVED", "REJECTED", "APPLIED", "MEASURED", "VERIFIED", "NOT_VERIFIED", "APPROVED")])
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 7
    return p.table("events").select(F.concat(F.lit("rec-"), (F.col("user_id") % 97).cast("string")).alias("entity"), F.col("event_id").alias("seq"),
                                    F.get(names, k.cast("int")).alias("target"))


@query("lifecycle_fold", "SELECT entity, seq, target, legal FROM f_fold")
def _(p):
    return V.lifecycle_fold(status_log(p)).select("entity", "seq", "target", "legal")


@query("lifecycle_state", "SELECT entity, arg_max(target, stage) FILTER (stage IS NOT NULL) AS status, count(*) FILTER (NOT legal) AS n_illegal FROM f_fold GROUP BY 1")
def _(p):
    return V.lifecycle_state(V.lifecycle_fold(status_log(p)))


@query("audit_transitions", """
SELECT entity AS entity_id, 'lifecycle.transition' AS action, '{"from":"' || f || '","to":"' || target || '"}' AS detail FROM (
 SELECT entity, target, coalesce(lag(target) OVER (PARTITION BY entity ORDER BY stage), 'PENDING_REVIEW') AS f FROM f_fold WHERE legal)
""")
def _(p):
    from pyspark.sql import Window

    from wattloom.sources import store
    legal = V.lifecycle_fold(status_log(p)).where("legal")
    w = Window.partitionBy("entity").orderBy("stage")
    df = legal.select(F.col("entity").alias("entity_id"), F.coalesce(F.lag("target").over(w), F.lit("PENDING_REVIEW")).alias("from_status"), F.col("target").alias("to_status"))
    return store.audit_transitions(df).select("entity_id", "action", "detail")


def requests(p):
    e = F.col("event_id")
    ev = p.table("events").where(F.col("event_type") == "purchase")
    at = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return ev.select(e.alias("seq"), F.concat(F.lit("rec-"), (F.col("user_id") % 97).cast("string")).alias("recommendation"),
                     F.concat(F.lit("key-"), ((e * 7 + F.col("user_id")) % 131).cast("string")).alias("idempotency_key"), at.alias("applied_at"),
                     F.when(e % 9 == 0, at - F.expr("interval 1 day")).alias("baseline_start"), F.when(e % 9 == 0, at - F.expr("interval 2 day")).alias("baseline_end"))


def approved(p):
    ids = p.table("events").select((F.col("user_id") % 97).alias("i")).distinct()
    return ids.where("i % 10 <> 3").select(F.concat(F.lit("rec-"), F.col("i").cast("string")).alias("recommendation"), F.lit("furnace-01").alias("machine_id"),
                                           F.when(F.col("i") % 5 == 1, "PENDING_REVIEW").otherwise("APPROVED").alias("status"))


@query("apply_interventions", """
WITH RECURSIVE chk AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM (
 SELECT event_id AS seq, 'rec-' || (user_id % 97) AS recommendation, 'key-' || ((event_id * 7 + user_id) % 131) AS idempotency_key,
  CASE WHEN user_id % 97 % 10 = 3 THEN 'unknown recommendation' WHEN user_id % 97 % 5 = 1 THEN 'not approved' WHEN event_id % 9 = 0 THEN 'baseline window must end at or before applied_at' END AS refusal
 FROM events WHERE event_type = 'purchase')),
fold AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS recs, []::VARCHAR[] AS keys UNION ALL
 SELECT c.n, CASE WHEN ok THEN list_append(recs, recommendation) ELSE recs END, CASE WHEN ok THEN list_append(keys, idempotency_key) ELSE keys END FROM (
  SELECT c.n, recs, keys, recommendation, idempotency_key, refusal IS NULL AND NOT list_contains(recs, recommendation) AND NOT list_contains(keys, idempotency_key) AS ok
  FROM fold f JOIN chk c ON c.n = f.n + 1) c),
won AS (SELECT c.* FROM chk c JOIN fold f ON f.n = c.n JOIN fold b ON b.n = c.n - 1 WHERE len(f.recs) > len(b.recs))
SELECT c.seq, c.recommendation, c.idempotency_key, CASE WHEN k.seq = c.seq THEN 'applied' WHEN k.seq < c.seq AND k.recommendation = c.recommendation THEN 'replay'
 WHEN k.seq < c.seq THEN 'idempotency_key already used for a different recommendation' WHEN c.refusal IS NOT NULL THEN c.refusal WHEN r.seq < c.seq THEN 'already applied' END AS result
FROM chk c LEFT JOIN won k ON k.idempotency_key = c.idempotency_key LEFT JOIN won r ON r.recommendation = c.recommendation
""")
def _(p):
    return V.apply_interventions(requests(p), approved(p), lambda df, name: p.stage(f"apply_{name}", lambda: df)).select(
        "seq", "recommendation", "idempotency_key", "result")


# -- verification ---------------------------------------------------------------------
# Looser gates than the defaults, so that the given buckets reach every verdict.
GATES = dict(min_baseline=20, min_post=8, min_frac=0.25, tol_pct=25.0, max_extrapolated=0.10, cv_max=60.0)

fragment("f_intv", """
SELECT 'iv-' || machine_id || '-' || day(d) AS intervention, machine_id, d AS applied_at, d - INTERVAL 7 DAY AS baseline_start, d AS baseline_end, d AS measurement_start,
 d + INTERVAL 4 DAY AS measurement_end FROM (SELECT DISTINCT machine_id, CAST(window_start AS DATE)::TIMESTAMP AS d FROM f_iv) WHERE d BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-26'
""")
fragment("f_ivrows", """
SELECT v.intervention, v.machine_id, period, window_start, complete, energy_kwh, good_production_kg FROM (
 SELECT intervention, machine_id, 'baseline' AS period, baseline_start AS ws, baseline_end AS we FROM f_intv UNION ALL SELECT intervention, machine_id, 'post', measurement_start, measurement_end FROM f_intv) v
JOIN f_iv i ON i.machine_id = v.machine_id AND i.window_start >= ws AND i.window_end <= we
""")
fragment("f_vdes", """
SELECT *, CASE WHEN pw IS NOT NULL AND nw IS NOT NULL THEN complete AND energy_kwh IS NOT NULL AND prev_kg IS NOT NULL AND good_production_kg IS NOT NULL AND next_kg IS NOT NULL END AS usable FROM (
 SELECT *, lag(good_production_kg) OVER w AS prev_kg, lead(good_production_kg) OVER w AS next_kg, lag(window_start) OVER w AS pw, lead(window_start) OVER w AS nw FROM f_ivrows
 WINDOW w AS (PARTITION BY intervention, period ORDER BY window_start))
""")


def _gauss() -> str:
    """4x4 normal equations solved step by step (one sub-select per pivot)."""
    x = ["1.0::DOUBLE", "prev_kg", "good_production_kg", "next_kg"]
    cells = [f"sum({x[i]} * {x[j]}) AS a{i}{j}" for i in range(4) for j in range(4)] + [f"sum({x[i]} * energy_kwh) AS a{i}4" for i in range(4)]
    sql = f"SELECT intervention, {', '.join(cells)} FROM f_vdes WHERE usable AND period = 'baseline' GROUP BY 1"
    for k in range(4):
        out = []
        for i in range(4):
            for j in range(5):
                if i == k:
                    out.append(f"a{i}{j} / a{k}{k} AS a{i}{j}")
                else:
                    out.append(f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}")
        sql = f"SELECT intervention, {', '.join(out)} FROM ({sql})"
    return f"SELECT intervention, a04 AS b0, a14 AS b1, a24 AS b2, a34 AS b3 FROM ({sql})"


fragment("f_beta", _gauss())
fragment("f_pred", """
SELECT d.*, b0 + b1 * prev_kg + b2 * good_production_kg + b3 * next_kg AS predicted FROM f_vdes d JOIN f_beta USING (intervention) WHERE usable
""")
fragment("f_resid", """
SELECT *, CASE WHEN rho < 1 THEN n * (1 - rho) / (1 + rho) ELSE 1 END AS n_eff FROM (
SELECT intervention, count(*) AS n, sqrt(sum(e * e) / greatest(1, count(*) - 4)) / avg(energy_kwh) AS cv, sum(e) / (greatest(1, count(*) - 4) * avg(energy_kwh)) * 100 AS nmbe_pct,
 CASE WHEN count(*) < 3 THEN 0 ELSE greatest(0, coalesce(corr(l, e), 0)) END AS rho
FROM (SELECT *, lag(e) OVER (PARTITION BY intervention ORDER BY window_start) AS l FROM (SELECT *, energy_kwh - predicted AS e FROM f_pred WHERE period = 'baseline')) GROUP BY 1)
""")
# Student-t quantile at 0.95: bisection on the closed finite series of the distribution for integer degrees of freedom.
fragment("f_tq", """
SELECT dof, (lo + hi) / 2 AS t FROM (
 WITH RECURSIVE s(dof, lo, hi, step) AS (
  SELECT DISTINCT greatest(1, n - 4) AS dof, 0.0::DOUBLE, 700.0::DOUBLE, 0 FROM f_resid
  UNION ALL SELECT dof, CASE WHEN a < 0.9 THEN m ELSE lo END, CASE WHEN a < 0.9 THEN hi ELSE m END, step + 1 FROM (
   SELECT *, CASE WHEN dof = 1 THEN 2 / pi() * th
     WHEN dof % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * list_sum(list_transform(range(0, (dof - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j))))
     ELSE sin(th) * list_sum(list_transform(range(0, dof // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(th), 2 * j))) END AS a
   FROM (SELECT *, (lo + hi) / 2 AS m, atan((lo + hi) / 2 / sqrt(dof)) AS th FROM s WHERE step < 60)))
 SELECT * FROM s WHERE step = 60)
""")
fragment("f_gate", """
SELECT v.intervention, v.machine_id, coalesce(nb, 0) AS n_baseline, coalesce(np, 0) AS n_post, coalesce(nb / nullif(tb - 2, 0)::DOUBLE, 0) AS fb, coalesce(np / nullif(tp - 2, 0)::DOUBLE, 0) AS fp,
 coalesce(nb, 0) >= 20 AND fb >= 0.25 AND coalesce(np, 0) >= 8 AND fp >= 0.25 AS enough
FROM f_intv v LEFT JOIN (SELECT intervention, count(*) FILTER (period = 'baseline' AND usable) AS nb, count(*) FILTER (period = 'post' AND usable) AS np,
 count(*) FILTER (period = 'baseline') AS tb, count(*) FILTER (period = 'post') AS tp FROM f_vdes GROUP BY 1) USING (intervention)
""")
fragment("f_cgate", """
SELECT b.intervention, b.before, a.after, a.out_frac, NOT ((before > 0 AND abs(after - before) / before * 100 > 25) OR out_frac > 0.10) AS comparable FROM (
 SELECT intervention, avg(good_production_kg) AS before, max(good_production_kg) AS mx FROM f_vdes WHERE usable AND period = 'baseline' GROUP BY 1) b
JOIN (SELECT d.intervention, avg(good_production_kg) AS after, avg(CASE WHEN good_production_kg > mx * 1.05 THEN 1.0::DOUBLE ELSE 0 END) AS out_frac FROM f_vdes d
 JOIN (SELECT intervention, max(good_production_kg) AS mx FROM f_vdes WHERE usable AND period = 'baseline' GROUP BY 1) USING (intervention) WHERE usable AND period = 'post' GROUP BY 1) a USING (intervention)
""")
fragment("f_unc", """
SELECT *, t * 1.26 * cv * sqrt((n / n_eff) * (1 + 2.0::DOUBLE / n) * (1.0::DOUBLE / m)) * cf AS u FROM (
 SELECT r.*, t, m, cf, act FROM f_resid r JOIN f_tq q ON q.dof = greatest(1, n - 4)
 JOIN (SELECT intervention, count(*) AS m, sum(predicted) AS cf, sum(energy_kwh) AS act FROM f_pred WHERE period = 'post' GROUP BY 1) USING (intervention))
""")
fragment("f_verd", """
SELECT *, CASE result_class WHEN 'SUCCESS' THEN 'VERIFIED' WHEN 'WORSE' THEN 'NOT_VERIFIED' WHEN 'NO_EFFECT' THEN 'NOT_VERIFIED' ELSE result_class END AS outcome FROM (
SELECT g.*, cf, act, cf - act AS saving, u, before, after, CASE WHEN NOT enough OR NOT coalesce(cv * 100 <= 60 AND abs(nmbe_pct) <= 10, FALSE) THEN 'INSUFFICIENT_DATA' WHEN NOT comparable THEN 'NOT_COMPARABLE'
 WHEN cf - act > u AND cf - act > 0 THEN 'SUCCESS' WHEN cf - act < -u THEN 'WORSE' ELSE 'NO_EFFECT' END AS result_class
FROM f_gate g LEFT JOIN f_unc USING (intervention) LEFT JOIN f_cgate USING (intervention))
""")


def interventions(p):
    day = F.date_trunc("day", "window_start")
    d = p.intervals().select("machine_id", day.alias("applied_at")).distinct().where(F.col("applied_at").between(F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-26").cast("timestamp")))
    at = F.col("applied_at")
    return d.select(F.concat_ws("-", F.lit("iv"), "machine_id", F.dayofmonth(at).cast("string")).alias("intervention"), "machine_id", "applied_at",
                    (at - F.expr("interval 7 days")).alias("baseline_start"), at.alias("baseline_end"), at.alias("measurement_start"),
                    (at + F.expr("interval 4 days")).alias("measurement_end"))


def design(p):
    return p.stage("verify_design", lambda: V.verify_design(V.intervention_rows(interventions(p), p.intervals())))


def fits(p):
    return p.stage("verify_fits", lambda: V.fit_counterfactual(design(p)))


def predicted(p):
    return p.stage("verify_predicted", lambda: V.with_prediction(design(p), fits(p)))


def verdicts(p):
    return p.stage("verdicts", lambda: V.verify_savings(interventions(p), p.intervals(), design=design(p), fits=fits(p), **GATES))


@query("verify_design", """
SELECT intervention, period, window_start, round(prev_kg, 4) AS prev_kg, round(good_production_kg, 4) AS good_production_kg, round(next_kg, 4) AS next_kg, usable FROM f_vdes
""")
def _(p):
    return design(p).select("intervention", "period", "window_start", "prev_kg", "good_production_kg", "next_kg", "usable")


@query("fit_counterfactual", """
SELECT intervention, round(b0, 3) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(b3, 4) AS b3 FROM f_beta
""")
def _(p):
    b = F.col("beta")
    return V.fit_counterfactual(design(p)).select("intervention", F.round(b[0], 3).alias("b0"), b[1].alias("b1"), b[2].alias("b2"), b[3].alias("b3"))


@query("residual_stats", """
SELECT intervention, n, round(cv, 4) AS cv, round(nmbe_pct, 4) AS nmbe_pct, round(rho, 4) AS rho, round(n_eff, 4) AS n_eff FROM f_resid
""")
def _(p):
    return V.residual_stats(predicted(p))


@query("savings_uncertainty", """
SELECT intervention, n, m, round(cf, 4) AS counterfactual_kwh, round(u, 4) AS uncertainty_kwh FROM f_unc
""")
def _(p):
    post = predicted(p).where("period = 'post'").groupBy("intervention").agg(F.count("*").alias("m"), F.sum("predicted").alias("counterfactual_kwh"))
    return V.savings_uncertainty(V.residual_stats(predicted(p)).join(post, "intervention")).select("intervention", "n", "m", "counterfactual_kwh", "uncertainty_kwh")


@query("data_gates", """
SELECT intervention, n_baseline, n_post, round_even(fb, 3) AS baseline_complete_frac, round_even(fp, 3) AS post_complete_frac, enough AS enough_data FROM f_gate
""")
def _(p):
    return V.data_gates(design(p), interventions(p), 20, 8, 0.25).drop("machine_id")


@query("comparability_gates", """
SELECT intervention, round(before, 4) AS production_before_kg_h, round(after, 4) AS production_after_kg_h, round(out_frac, 4) AS extrapolated_frac, comparable FROM f_cgate
""")
def _(p):
    return V.comparability_gates(design(p), 25.0, 0.10)


@query("verify_savings", """
SELECT intervention, machine_id, result_class, outcome, n_baseline, n_post,
 CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN round(cf + 1e-9, 3) END AS counterfactual_kwh, CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN round(act + 1e-9, 3) END AS actual_kwh,
 CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN round(saving + 1e-9, 3) END AS saving_kwh, CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN round(u + 1e-9, 3) END AS uncertainty_kwh FROM f_verd
""")
def _(p):
    return verdicts(p).select("intervention", "machine_id", "result_class", "outcome", "n_baseline", "n_post", "counterfactual_kwh", "actual_kwh", "saving_kwh", "uncertainty_kwh")


_N = "printf('%.1f', round({} + 1e-9, 1))"
fragment("f_verdx", f"""
SELECT *, list_filter([CASE WHEN before > 0 AND abs(after - before) / before * 100 > 25 THEN 'mean production changed by ' || printf('%+.1f', round((after - before) / before * 100 + 1e-9, 1)) || ' %, more than 25.0 %' END,
  CASE WHEN out_frac > 0.10 THEN {_N.format('out_frac * 100')} || ' % of the measurement lies above the baseline''s production, where the model would extrapolate' END], lambda y: y IS NOT NULL) AS reasons,
 coalesce(cv * 100 <= 60 AND abs(nmbe_pct) <= 10, FALSE) AS fitted
FROM f_verd LEFT JOIN (SELECT intervention, out_frac, comparable FROM f_cgate) USING (intervention) LEFT JOIN (SELECT intervention, cv, nmbe_pct, rho, n_eff FROM f_resid) USING (intervention)
""")


@query("verification_explained", f"""
SELECT intervention, CASE WHEN enough AND fitted THEN comparable END AS comparable, CASE WHEN enough AND fitted THEN array_to_string(reasons, '; ') END AS comparability_reasons,
 CASE WHEN NOT enough AND NOT (n_baseline >= 20 AND round_even(fb, 3) >= 0.25) THEN 'The baseline has ' || n_baseline || ' usable intervals (' || {_N.format('round_even(fb, 3) * 100')} || ' % complete); 20 and 25.0 % are needed.'
  WHEN NOT enough THEN 'The measurement has ' || n_post || ' usable intervals (' || {_N.format('round_even(fp, 3) * 100')} || ' % complete); 8 and 25.0 % are needed.'
  WHEN NOT fitted THEN 'The baseline model is not good enough for a counterfactual: CV(RMSE) ' || coalesce({_N.format('cv * 100')}, 'undefined') || ' %, NMBE ' || coalesce({_N.format('nmbe_pct')}, 'undefined') || ' %.'
  WHEN result_class = 'NOT_COMPARABLE' THEN 'Conditions differ: ' || array_to_string(reasons, '; ') || '. No saving is reported.'
  WHEN result_class = 'SUCCESS' THEN {_N.format('saving')} || ' kWh (' || {_N.format('saving / cf * 100')} || ' %) below the counterfactual, more than its uncertainty of ' || {_N.format('u')} || ' kWh at 90.0 % confidence.'
  WHEN result_class = 'WORSE' THEN {_N.format('-saving')} || ' kWh (' || {_N.format('-saving / cf * 100')} || ' %) above the counterfactual, more than its uncertainty of ' || {_N.format('u')} || ' kWh at 90.0 % confidence.'
  ELSE printf('%+.1f', round(saving + 1e-9, 1)) || ' kWh against the counterfactual, within its uncertainty of ' || {_N.format('u')} || ' kWh at 90.0 % confidence.' END AS explanation,
 CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN 0.9::DOUBLE END AS confidence, CASE WHEN enough THEN round(cv * 100 + 1e-9, 3) END AS cv_rmse_pct, CASE WHEN enough THEN round(nmbe_pct + 1e-9, 3) END AS nmbe_pct,
 CASE WHEN enough THEN CASE WHEN fitted THEN 'ACCEPTABLE' ELSE 'NOT_ACCEPTABLE' END END AS g14, CASE WHEN enough THEN round(rho, 4) END AS lag1_autocorr, CASE WHEN enough THEN round(n_eff + 1e-9, 1) END AS n_effective
FROM f_verdx
""")
def _(p):
    return verdicts(p).select("intervention", "comparable", "comparability_reasons", "explanation", "confidence", *[f"model.{c}" for c in ("cv_rmse_pct", "nmbe_pct", "g14", "lag1_autocorr", "n_effective")])


@query("list_verification", "SELECT intervention, outcome FROM f_verd WHERE outcome = 'NOT_VERIFIED'")
def _(p):
    return verdicts(p).where("outcome = 'NOT_VERIFIED'").select("intervention", "outcome")


@query("cost_impact", """
SELECT intervention, 'OK' AS status, round(sum((predicted - energy_kwh) * rate) + 1e-9, 2) AS value_inr, round(sum(predicted * rate) + 1e-9, 2) AS counterfactual_cost_inr,
 round(sum(energy_kwh * rate) + 1e-9, 2) AS actual_cost_inr, 'ILLUSTRATIVE (ASSUMPTION) tariff, not the plant''s bill' AS tariff_label
FROM f_pred JOIN f_min ON minute = hour(window_start + INTERVAL 330 MINUTE) * 60 + minute(window_start + INTERVAL 330 MINUTE) WHERE period = 'post' GROUP BY 1
""")
def _(p):
    return V.cost_impact(V.hourly_impact(predicted(p)), QS.in_force(p), site_id=S.SITE)


def impact_days(p):
    on = F.to_date(local_time("measurement_end", "Asia/Kolkata"))
    i = interventions(p).select("intervention", on.alias("on_date"))
    years = F.explode(F.array(F.lit(-12), F.lit(0), F.lit(10)))
    return verdicts(p).join(i, "intervention").withColumn("shift", years).withColumn("on_date", F.add_months("on_date", F.col("shift")))


fragment("f_factday", """
SELECT intervention, outcome, saving, s AS shift, CAST(CAST(measurement_end + INTERVAL 330 MINUTE AS DATE) + to_months(CAST(s AS INTEGER)) AS DATE) AS on_date FROM f_verd JOIN f_intv USING (intervention), (SELECT unnest([-12, 0, 10]) AS s)
""")
fragment("f_factpick", """
SELECT d.*, factor_id, value_kg_per_kwh, note, source_class, CASE WHEN factor_id IS NULL THEN 'UNAVAILABLE' WHEN on_date <= effective_to THEN 'EFFECTIVE' ELSE 'LATEST_AVAILABLE' END AS factor_status
FROM f_factday d LEFT JOIN f_factor f ON f.effective_from <= d.on_date
QUALIFY row_number() OVER (PARTITION BY intervention, shift ORDER BY (on_date <= effective_to) DESC, effective_from DESC) = 1
""")


@query("select_factor", "SELECT intervention, on_date, factor_status, factor_id FROM f_factpick")
def _(p):
    return V.select_factor(impact_days(p), "on_date", p.factors).select("intervention", "on_date", "factor_status", "factor_id")


@query("list_factors", """
SELECT f.factor_id, value_kg_per_kwh, source_class, count(k) AS n_intervals, round(coalesce(sum(energy_kwh), 0), 4) AS energy_kwh FROM f_factor f
LEFT JOIN f_iv ON CAST(window_start + INTERVAL 330 MINUTE AS DATE) BETWEEN effective_from AND effective_to AND complete GROUP BY ALL
""")
def _(p):
    """Emission factors with the energy that falls under each."""
    rows = p.intervals().where("complete").withColumn("on_date", F.to_date(local_time("window_start", "Asia/Kolkata")))
    used = V.select_factor(rows, "on_date", p.factors).where("factor_status = 'EFFECTIVE'").groupBy("factor_id").agg(
        F.count("*").alias("n_intervals"), F.sum("energy_kwh").alias("energy_kwh"))
    return p.factors.join(used, "factor_id", "left").na.fill(0, ["n_intervals"]).na.fill(0.0, ["energy_kwh"]).select(
        "factor_id", "value_kg_per_kwh", "source_class", "n_intervals", "energy_kwh")


@query("list_interventions", """
SELECT intervention, machine_id, applied_at, baseline_start, baseline_end, measurement_start, measurement_end, outcome AS status
FROM f_verd JOIN (SELECT * EXCLUDE (machine_id) FROM f_intv) USING (intervention) WHERE outcome = 'NOT_COMPARABLE' AND applied_at >= TIMESTAMP '2024-01-10'
""")
def _(p):
    told = interventions(p).join(verdicts(p).select("intervention", F.col("outcome").alias("status")), "intervention")
    return reads.listing(told, "applied_at", start="2024-01-10", status="NOT_COMPARABLE").select(
        "intervention", "machine_id", "applied_at", "baseline_start", "baseline_end", "measurement_start", "measurement_end", "status")


@query("co2_impact", """
SELECT intervention, on_date, factor_status, CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN round(round(saving + 1e-9, 3) * value_kg_per_kwh + 1e-9, 3) END AS co2_kg,
 contains(lower(note), 'confirm') AS provisional FROM f_factpick
""")
def _(p):
    return V.co2_impact(V.select_factor(impact_days(p), "on_date", p.factors)).select("intervention", "on_date", "factor_status", "co2_kg", "provisional")


@query("impact_gate", """
SELECT intervention, on_date, CASE WHEN outcome = 'VERIFIED' THEN 'OK' ELSE 'NOT_APPLICABLE' END AS impact_status,
 CASE WHEN outcome = 'VERIFIED' THEN round(round(saving + 1e-9, 3) * value_kg_per_kwh + 1e-9, 3) END AS co2_kg FROM f_factpick
""")
def _(p):
    df = V.co2_impact(V.select_factor(impact_days(p), "on_date", p.factors))
    return V.impact_gate(df, ["co2_kg"]).select("intervention", "on_date", "impact_status", "co2_kg")


# -- paired trials ----------------------------------------------------------------------
# The treated arm of an intervention is its machine's four days before and after; the control arm is the same machine
# one week earlier. Reported savings, bands and outcomes are the verdicts of verify_savings.
fragment("f_trial", """
SELECT v.machine_id AS scenario, intervention AS seed, arm, CASE WHEN ws < applied_at THEN 'pre' ELSE 'post' END AS period, coalesce(energy_kwh, 0) AS energy_kwh FROM f_intv v JOIN (
 SELECT machine_id, window_start AS ws, window_end AS we, energy_kwh, 'treated' AS arm FROM f_iv
 UNION ALL SELECT machine_id, window_start + INTERVAL 7 DAY, window_end + INTERVAL 7 DAY, energy_kwh, 'control' FROM f_iv) i
ON i.machine_id = v.machine_id AND ((ws >= applied_at - INTERVAL 4 DAY AND we <= applied_at) OR (ws >= applied_at AND we <= applied_at + INTERVAL 4 DAY))
""")
fragment("f_oddstart", """
SELECT seed, count(*) FILTER (c <> t) AS odd FROM (SELECT intervention AS seed, s.ts, count(*) FILTER (arm = 'control') AS c, count(*) FILTER (arm = 'treated') AS t FROM f_intv v JOIN (
 SELECT machine_id, ts, 'treated' AS arm FROM f_trans WHERE to_state = 'heating' UNION ALL SELECT machine_id, ts + INTERVAL 7 DAY, 'control' FROM f_trans WHERE to_state = 'heating') s
 ON s.machine_id = v.machine_id AND s.ts >= applied_at - INTERVAL 4 DAY AND s.ts < applied_at + INTERVAL 4 DAY GROUP BY 1, 2) GROUP BY 1
""")
fragment("f_true", """
SELECT scenario, seed, round(coalesce(sum(energy_kwh) FILTER (arm = 'control' AND period = 'post'), 0) - coalesce(sum(energy_kwh) FILTER (arm = 'treated' AND period = 'post'), 0) + 1e-9, 3) AS true_saving_kwh,
 abs(coalesce(sum(energy_kwh) FILTER (arm = 'control' AND period = 'pre'), 0) - coalesce(sum(energy_kwh) FILTER (arm = 'treated' AND period = 'pre'), 0)) < 1e-6 AS pre_equal,
 coalesce(any_value(odd), 0) = 0 AS paired FROM f_trial LEFT JOIN f_oddstart USING (seed) GROUP BY 1, 2
""")


def trials(p):
    """Both arms of every intervention, one row per pair."""
    at, week, span = F.col("applied_at"), F.expr("interval 7 days"), F.expr("interval 4 days")
    spans = interventions(p).select("intervention", "machine_id", (at - span).alias("baseline_start"), at.alias("baseline_end"), at.alias("measurement_start"), (at + span).alias("measurement_end"))

    def energy(arm, iv):
        rows = V.intervention_rows(spans, iv)
        return rows.select(F.col("machine_id").alias("scenario"), F.col("intervention").alias("seed"), F.lit(arm).alias("arm"),
                           F.when(F.col("period") == "post", "post").otherwise("pre").alias("period"), F.coalesce("energy_kwh", F.lit(0.0)).alias("energy_kwh"))
    iv = p.intervals()
    earlier = iv.withColumns({c: F.col(c) + week for c in ("window_start", "window_end")})
    heats = process.state_transitions(process.state_samples(p.telemetry()), p.machines).where("to_state = 'heating'").select("machine_id", "ts")
    days = spans.withColumn("_day", F.explode(F.sequence(F.to_date("baseline_start"), F.to_date(F.col("measurement_end") - F.expr("interval 1 microsecond")))))

    def starts(arm, shift):
        s = heats.withColumn("ts", F.col("ts") + shift).withColumn("_day", F.to_date("ts")).join(days, ["machine_id", "_day"])
        inside = (F.col("ts") >= F.col("baseline_start")) & (F.col("ts") < F.col("measurement_end"))
        return s.where(inside).select(F.col("machine_id").alias("scenario"), F.col("intervention").alias("seed"), F.lit(arm).alias("arm"), "ts")
    return V.true_saving_pairs(energy("treated", iv).unionByName(energy("control", earlier)),
                               starts("treated", F.expr("interval 0 days")).unionByName(starts("control", week)))


@query("true_saving_pairs", "SELECT scenario, seed, true_saving_kwh, pre_equal, paired FROM f_true")
def _(p):
    return trials(p)


@query("verification_scorecard", """
SELECT scenario, count(*) AS n, count(*) FILTER (paired) AS n_paired, count(*) FILTER (outcome = 'VERIFIED') AS n_verified, count(*) FILTER (outcome = 'NOT_VERIFIED') AS n_not_verified,
 count(*) FILTER (outcome = 'NOT_COMPARABLE') AS n_not_comparable, count(*) FILTER (outcome = 'INSUFFICIENT_DATA') AS n_insufficient_data, count(*) FILTER (true_saving_kwh <= 0) AS n_true_le0,
 round(count(*) FILTER (true_saving_kwh <= 0 AND outcome = 'VERIFIED') / nullif(count(*) FILTER (true_saving_kwh <= 0), 0)::DOUBLE, 4) AS false_claim_rate,
 round(count(*) FILTER (outcome = 'VERIFIED') / count(*)::DOUBLE, 4) AS detection_rate, round(count(*) FILTER (abs(true_saving_kwh - rep) <= u) / nullif(count(rep), 0)::DOUBLE, 4) AS coverage,
 round(count(*) FILTER (paired AND abs(true_saving_kwh - rep) <= u) / nullif(count(rep) FILTER (paired), 0)::DOUBLE, 4) AS coverage_paired, round(avg(true_saving_kwh), 4) AS mean_true_kwh,
 round(avg(rep), 4) AS mean_reported_kwh, round(avg(abs(rep - true_saving_kwh)), 4) AS mean_abs_error_kwh
FROM (SELECT t.*, outcome, CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN round(saving + 1e-9, 3) END AS rep, CASE WHEN outcome IN ('VERIFIED', 'NOT_VERIFIED') THEN round(u + 1e-9, 3) END AS u
 FROM f_true t JOIN f_verd v ON v.intervention = t.seed) GROUP BY 1
""")
def _(p):
    told = verdicts(p).select(F.col("intervention").alias("seed"), F.col("saving_kwh").alias("reported_saving_kwh"), "uncertainty_kwh", "outcome", "result_class")
    return V.verification_scorecard(trials(p).join(told, "seed")).select(
        "scenario", "n", "n_paired", *[f"n_{o.lower()}" for o in ("VERIFIED", "NOT_VERIFIED", "NOT_COMPARABLE", "INSUFFICIENT_DATA")], "n_true_le0", "false_claim_rate",
        "detection_rate", "coverage", "coverage_paired", "mean_true_kwh", "mean_reported_kwh", "mean_abs_error_kwh")
