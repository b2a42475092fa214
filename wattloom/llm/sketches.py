"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's word
shingles. The sketch of a union is the ``k`` smallest of both arrays, so parts may be
sketched apart and merged.

Words are runs without white space, lower-cased; texts with fewer words than a shingle have
the whole sequence as their one shingle.

Defined cases: null text is empty; no word gives an empty sketch; two empty sketches are
alike (1), an empty and another are not (0). Rows that agree in id and text are one document
listed several times and get the same result; documents with one id are ordered by a digest
of their text; null ids come first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import digest_key, fresh, staged

K = 128
SHINGLE = 5


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``: array<long>, the sketch of ``text_col``."""
    w, h, all_ = fresh(df, "words_", "hashes_", "shingles_")
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), "")
    df = df.withColumn(w, words).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    at = lambda i: F.xxhash64(*(F.col(h)[i + j] for j in range(shingle)))
    many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), at)
    few = F.array(F.xxhash64(F.concat_ws(" ", w)))
    df = df.withColumn(all_, F.when(F.size(h) >= shingle, many).when(F.size(h) > 0, few).otherwise(F.array().cast("array<long>")))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(all_)), 1, k)).drop(w, h, all_)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, keys: list[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One merged sketch per key. Large groups are cut by salt and pre-merged; at most salts x k hashes meet."""
    s, h, r = fresh(df, "salt_", "hash_", "rank_")
    rows = df.select(*keys, F.explode(sketch).alias(h)).distinct().withColumn(s, F.pmod(F.hash(h), F.lit(salts)))
    small = rows.withColumn(r, F.row_number().over(Window.partitionBy(*keys, s).orderBy(h))).where(F.col(r) <= k)
    return small.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(h)), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both."""
    both = merged(a, b, k)
    hits = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(hits / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    unit = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / unit)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Sketch as hex digits, 16 a hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, n, prev_key, prev_n): each document's length and the one before it in ascending order, around the end.

    Documents are dealt out by ranges of their id; only the first and last of each range
    meet in one task, as many as there are ranges.
    """
    size = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    ids = docs.select(F.col(id_col).alias("id"), digest_key(F.col(id_col), F.col(text_col)).alias("key"), size.alias("n")).distinct()
    ids = staged(ids.repartitionByRange("id", "key").withColumn("range", F.spark_partition_id()), "order")
    edge = F.struct("id", "key", "n")
    ends = ids.groupBy("range").agg(F.max(edge).alias("last"))
    around = Window.orderBy("range")
    whole = Window.partitionBy()
    before = ends.select("range", F.coalesce(F.lag("last").over(around), F.max_by("last", "range").over(whole)).alias("before"))
    inside = Window.partitionBy("range").orderBy("id", "key")
    rows = ids.select("range", "key", "n", F.lag("key").over(inside).alias("k"), F.lag("n").over(inside).alias("m")).join(before, "range")
    return rows.select("key", "n", F.coalesce("k", "before.key").alias("prev_key"), F.coalesce("m", "before.n").alias("prev_n"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Every document with an edited text and the next document's sketch.

    id, n_chars, edited, sketch, edited_sketch, next_sketch: the edited text has its last
    quarter (floor of n_chars / 4) replaced by as much of the next document's beginning.
    """
    # Texts move once, to their key; what moves on is a prefix and a sketch, to the document before.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest_key(F.col(id_col), F.col(text_col)).alias("key"))
    # Both uses of these rows need the same columns and no row limit, so that one shuffle serves both.
    rows = rows.withColumn("first", F.lag(F.lit(1)).over(Window.partitionBy("key").orderBy("id")).isNull())
    rows = rows.join(neighbours(docs, id_col, text_col), "key")
    given = with_sketch(rows.where("first").select(F.col("prev_key").alias("key"), "text", "prev_n"), "text", "next_sketch", k, shingle)
    given = given.select("key", "next_sketch", F.expr("substring(text, 1, prev_n div 4)").alias("prefix"))
    both = rows.join(given, "key").select("id", "n", "text", "next_sketch", F.expr("concat(substring(text, 1, n - n div 4), prefix)").alias("edited"))
    both = with_sketch(with_sketch(both, "text", "sketch", k, shingle), "edited", "edited_sketch", k, shingle)
    return both.select("id", F.col("n").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch", "next_sketch")
