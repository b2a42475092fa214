"""Broker messages (topic + JSON payload) to canonical records or dead letter.

The payload is parsed once into a variant; checks look at the JSON types, so a number
sent as text or a boolean is told apart from a number. A message with any malformed
record goes to dead letter as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom import config as C

TOPIC_ROOT = "plant"
# Fixed value: date and time, then optionally an offset.
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
OFFSET = r"(Z|[+-]\d{2}:\d{2})$"


def route_topic(df: DataFrame, root: str = TOPIC_ROOT) -> DataFrame:
    """Adds kind (telemetry / production, null when unsupported), site_id and topic_machine."""
    t = F.split("topic", "/")
    n, first = F.size(t), F.get(t, 0) == root
    tel = first & (n == 4) & (F.get(t, 3) == "telemetry")
    prod = first & (n == 3) & (F.get(t, 2) == "production")
    return df.withColumns({
        "kind": F.when(tel, "telemetry").when(prod, "production"),
        "site_id": F.when(tel | prod, F.get(t, 1)), "topic_machine": F.when(tel, F.get(t, 2))})


# A record is a map of field name to the field's JSON text: the first character tells the
# type ('"' string, digit or '-' number, 't'/'f' boolean, 'n' null), which is far cheaper
# than asking for the variant's schema again and again.


def _text(v: Column) -> Column:
    """Value of a JSON string (null for any other type)."""
    plain = F.substring(v, F.lit(2), F.length(v) - 2)
    unescaped = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    return F.when(v.startswith('"'), F.when(v.contains("\\"), unescaped).otherwise(plain))


def _absent(v: Column) -> Column:
    return v.isNull() | (v == "null")


def _number_reason(rec: Column, field: str) -> Column:
    v = rec[field]
    infinite = F.abs(v.try_cast("double")) == float("inf")
    return (F.when(_absent(v), F.lit(None).cast("string")).when(~v.rlike("^-?[0-9]"), f"{field} must be a number")
            .when(infinite, f"{field} is not finite"))


def _ts_reason(rec: Column, field: str) -> Column:
    s = _text(rec[field])
    return (F.when(s.isNull(), f"{field} missing or not a timestamp")
            .when(~s.rlike(ISO) | s.try_cast("timestamp").isNull(), f"{field} is not ISO-8601")
            .when(~s.rlike(ISO + OFFSET), f"{field} must be timezone-aware"))


def _source(rec: Column) -> Column:
    return F.when(_absent(rec["source"]), "MEASURED").otherwise(F.coalesce(_text(rec["source"]), F.lit("?")))


def _unknown_fields(rec: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(rec), F.array(*[F.lit(k) for k in known]))) > 0


def canonical_telemetry_reason(rec: Column, machine: Column | None = None) -> Column:
    """First reason a reading is malformed, else null. ``rec`` maps names to JSON text."""
    named = _text(rec["machine_id"])
    checks = [] if machine is None else [
        F.when(~_absent(rec["machine_id"]) & ~named.eqNullSafe(machine), "payload machine_id does not match topic")]
    mid = named if machine is None else machine
    known = ("machine_id", "ts", "source", "machine_state", *C.TELEMETRY_FIELDS)
    state = rec["machine_state"]
    return F.coalesce(
        *checks,
        F.when(F.coalesce(mid, F.lit("")) == "", "machine_id missing"),
        F.when(~_source(rec).isin(*C.SOURCES), "unknown source class"),
        F.when(_unknown_fields(rec, known), "unknown field(s)"),
        F.when(~_absent(state) & ~F.coalesce(_text(state), F.lit("?")).isin(*C.STATES), "unknown machine_state"),
        _ts_reason(rec, "ts"), *[_number_reason(rec, f) for f in C.TELEMETRY_FIELDS])


def canonical_production_reason(rec: Column) -> Column:
    needed = ("qty_total_kg", "qty_good_kg", "qty_rejected_kg")
    known = ("machine_id", "window_start", "window_end", "source", "batch_id", *C.PRODUCTION_FIELDS)
    absent = F.size(F.array_except(F.array(*[F.lit(k) for k in needed]), F.map_keys(rec))) > 0
    return F.coalesce(
        F.when(F.coalesce(_text(rec["machine_id"]), F.lit("")) == "", "machine_id missing"),
        F.when(~_source(rec).isin(*C.SOURCES), "unknown source class"),
        F.when(absent | _unknown_fields(rec, known), "production fields invalid"),
        _ts_reason(rec, "window_start"), _ts_reason(rec, "window_end"), *[_number_reason(rec, f) for f in C.PRODUCTION_FIELDS])


_NOT_OBJECT = "payload must be a JSON object or {'records': [objects]}"


def _record(v: Column) -> Column:
    fields = F.transform_values(v.cast("map<string,variant>"), lambda k, x: F.to_json(x))
    return F.when(F.to_json(v).startswith("{"), fields)


def _message_reason(first_bad: Column, not_objects: Column) -> Column:
    return (F.when(F.col("kind").isNull(), "unsupported topic").when(F.col("_v").isNull(), "payload is not UTF-8 JSON")
            .when(not_objects, _NOT_OBJECT).otherwise(first_bad))


def parse_messages(df: DataFrame, root: str = TOPIC_ROOT) -> DataFrame:
    """Adds ``recs`` (array of maps) and ``reason`` (null when the whole message is good).

    Messages with one reading, the usual case, are checked with plain column expressions
    (compiled); only those that mention a record list go through array functions.
    """
    df = route_topic(df, root)
    listed = F.coalesce(F.col("payload").contains('"records"'), F.lit(False))
    telemetry = F.col("kind") == "telemetry"

    # explode of a one-element array: the parsed value becomes a column of its own, so the
    # many checks below read it instead of each parsing the text again
    one = df.where(~listed).withColumn("_v", F.explode(F.array(F.try_parse_json("payload"))))
    one = one.withColumn("_rec", F.explode(F.array(_record(F.col("_v")))))
    checked = F.when(telemetry, canonical_telemetry_reason(F.col("_rec"), F.col("topic_machine"))).otherwise(canonical_production_reason(F.col("_rec")))
    one = one.withColumns({"recs": F.array("_rec"), "reason": _message_reason(checked, F.col("_rec").isNull())}).drop("_rec", "_v")

    many = df.where(listed).withColumn("_v", F.explode(F.array(F.try_parse_json("payload"))))
    inner = F.try_variant_get("_v", "$.records", "variant")
    wrapped = F.to_json("_v").startswith("{") & inner.isNotNull()
    items = F.when(wrapped, F.try_variant_get("_v", "$.records", "array<variant>")).otherwise(F.array("_v"))
    many = many.withColumn("recs", F.transform(items, _record))
    each = F.when(telemetry, F.transform("recs", lambda r: canonical_telemetry_reason(r, F.col("topic_machine")))
                  ).otherwise(F.transform("recs", canonical_production_reason))
    bad = F.get(F.filter(each, lambda x: x.isNotNull()), 0)
    many = many.withColumn("reason", _message_reason(bad, F.col("recs").isNull() | F.exists("recs", lambda r: r.isNull()))).drop("_v")
    return one.unionByName(many)


def good_telemetry(parsed: DataFrame) -> DataFrame:
    """One row per canonical reading."""
    df = parsed.where(F.col("reason").isNull() & (F.col("kind") == "telemetry"))
    keep = [c for c in parsed.columns if c not in ("recs", "reason", "payload", "topic", "kind", "site_id", "topic_machine")]
    df = df.select(*keep, "site_id", F.col("topic_machine").alias("machine_id"), F.explode("recs").alias("r"))
    num = [F.col("r")[f].try_cast("double").alias(f) for f in C.TELEMETRY_FIELDS]
    return df.select(*keep, "site_id", "machine_id", _text(F.col("r")["ts"]).cast("timestamp").alias("ts"), *num,
                     _text(F.col("r")["machine_state"]).alias("machine_state"), _source(F.col("r")).alias("source"))


def good_production(parsed: DataFrame) -> DataFrame:
    df = parsed.where(F.col("reason").isNull() & (F.col("kind") == "production"))
    keep = [c for c in parsed.columns if c not in ("recs", "reason", "payload", "topic", "kind", "site_id", "topic_machine")]
    df = df.select(*keep, "site_id", F.explode("recs").alias("r"))
    num = [F.col("r")[f].try_cast("double").alias(f) for f in C.PRODUCTION_FIELDS]
    return df.select(*keep, "site_id", _text(F.col("r")["machine_id"]).alias("machine_id"),
                     _text(F.col("r")["window_start"]).cast("timestamp").alias("window_start"),
                     _text(F.col("r")["window_end"]).cast("timestamp").alias("window_end"), *num,
                     F.coalesce(_text(F.col("r")["batch_id"]), F.lit("")).alias("batch_id"), _source(F.col("r")).alias("source"))


def dead_letter(parsed: DataFrame) -> DataFrame:
    keep = [c for c in parsed.columns if c not in ("recs", "kind", "site_id", "topic_machine")]
    return parsed.where(F.col("reason").isNotNull()).select(*keep)


def known_machines(records: DataFrame, machines: DataFrame) -> DataFrame:
    return records.join(machines.select("machine_id"), "machine_id", "left_semi")


def unknown_machines(records: DataFrame, machines: DataFrame) -> DataFrame:
    """Records whose machine is not on file: kept as dead letter, the rest is accepted."""
    return records.join(machines.select("machine_id"), "machine_id", "left_anti").withColumn("reason", F.lit("unknown machine_id"))
