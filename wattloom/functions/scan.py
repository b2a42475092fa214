"""Ordered scans over a key that may hold a large share of all rows.

A plain ``Window.partitionBy(machine)`` puts every row of a machine into one task.
Here a key's rows are cut into chunks along the order (a time slice, a block of
sequence numbers). Each chunk is summarised first (partial aggregation does that on
the map side); a window over the *summaries* gives what every chunk inherits from the
ones before it; the rows then only need a window inside (key, chunk). That window and
the join hash on the same columns, so the rows are shuffled once; the window comes
first, since its order also serves the join, and the rows are sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def _over_chunks(keys: list[str], chunk: str):
    return Window.partitionBy(*keys).orderBy(chunk)


def _inside(keys: list[str], chunk: str, order: list[str]):
    return Window.partitionBy(*keys, chunk).orderBy(*order)


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the key's rows up to and including this one."""
    part = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_part"))
    carry = part.select(
        *keys, chunk,
        F.coalesce(F.sum("_part").over(_over_chunks(keys, chunk).rowsBetween(*BEFORE)), F.lit(0)).alias("_carry"))
    local = F.coalesce(F.sum(value).over(_inside(keys, chunk, order).rowsBetween(*UP_TO)), F.lit(0))
    return df.withColumn("_local", local).join(carry, [*keys, chunk]).withColumn(out, F.col("_carry") + F.col("_local")).drop("_carry", "_local")


def previous_max(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                 value: str, out: str) -> DataFrame:
    """``out`` = max of ``value`` over the key's earlier rows (null when there is none)."""
    part = df.groupBy(*keys, chunk).agg(F.max(value).alias("_part"))
    carry = part.select(
        *keys, chunk, F.max("_part").over(_over_chunks(keys, chunk).rowsBetween(*BEFORE)).alias("_carry"))
    local = F.max(value).over(_inside(keys, chunk, order).rowsBetween(*BEFORE))
    return df.withColumn("_local", local).join(carry, [*keys, chunk]).withColumn(out, F.greatest("_carry", "_local")).drop("_carry", "_local")


def previous_row(df: DataFrame, keys: list[str], chunk: str, order: list[str],
                 cols: list[str], out: str) -> DataFrame:
    """``out`` = struct of ``cols`` of the row just before (null for the key's first row)."""
    last = df.groupBy(*keys, chunk).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    carry = last.select(*keys, chunk, F.lag("_last").over(_over_chunks(keys, chunk)).alias("_carry"))
    local = F.lag(F.struct(*cols)).over(_inside(keys, chunk, order))
    return df.withColumn("_local", local).join(carry, [*keys, chunk]).withColumn(out, F.coalesce("_local", "_carry")).drop("_carry", "_local")


def next_row(df: DataFrame, keys: list[str], chunk: str, order: list[str],
             cols: list[str], out: str) -> DataFrame:
    """``out`` = struct of ``cols`` of the row just after (null for the key's last row)."""
    first = df.groupBy(*keys, chunk).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
    carry = first.select(*keys, chunk, F.lead("_first").over(_over_chunks(keys, chunk)).alias("_carry"))
    local = F.lead(F.struct(*cols)).over(_inside(keys, chunk, order))
    return df.withColumn("_local", local).join(carry, [*keys, chunk]).withColumn(out, F.coalesce("_local", "_carry")).drop("_carry", "_local")


def behind(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """``rows`` (``_real``) and the rows of ``carry`` (not ``_real``), which windows ordered by ``_real`` first put in front of their chunk.

    A second window on the same order can so use what the first found, without a join between them.
    """
    return rows.withColumn("_real", F.lit(True)).unionByName(carry.withColumn("_real", F.lit(False)), allowMissingColumns=True)


def exact_median(df: DataFrame, keys: list[str], value: str, width: float, out: str = "median") -> DataFrame:
    """Exact median per key (mean of the two middle values when the count is even).

    Equal values are counted first, then ranked through value ranges of ``width``;
    the row sort is per (key, range), so a key with a third of all rows still spreads.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
              .withColumn("_range", F.floor(F.col(value) / width)))
    ranked = running_sum(counts, keys, "_range", [value], "_c", "_upto")
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    lower, upper = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    below = F.col("_upto") - F.col("_c")
    hit_low = (below < lower) & (F.col("_upto") >= lower)
    hit_high = (below < upper) & (F.col("_upto") >= upper)
    return (ranked.join(totals, keys).where(hit_low | hit_high)
            .groupBy(*keys, "_n")
            .agg(((F.max(F.when(hit_low, F.col(value))) + F.max(F.when(hit_high, F.col(value)))) / 2).alias(out))
            .withColumnRenamed("_n", "n"))


def islands(df: DataFrame, keys: list[str], chunk: str, order: list[str],
            label: Column, out: str) -> DataFrame:
    """``out`` numbers the runs of equal ``label`` along the order."""
    df = previous_row(df.withColumn("_label", label), keys, chunk, order, ["_label"], "_prev")
    changed = F.col("_prev").isNull() | ~F.col("_label").eqNullSafe(F.col("_prev._label"))
    df = df.withColumn("_change", changed.cast("long"))
    return running_sum(df, keys, chunk, order, "_change", out).drop("_label", "_prev", "_change")
