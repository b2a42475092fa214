"""Line dedup by winnowing, with DataFrame functions only.

A *window* is ``run`` consecutive lines, or a single line of ``long_words`` words or more
(so that long one-line passages count too). With ``passages``, also any fewer than ``run``
consecutive lines that have ``long_words`` words together, words being split at any white
space: then a run of equal lines is a repeat when it has ``run`` lines or ``long_words`` words,
however it is laid out. A window that occurs again, later in the order
of (id, text digest, line), is a repeat, and every line that repeats cover is deleted; the
first occurrence stays. Overlapping repeats add up to whole repeated runs.

How: the smallest line hash of each window (rightmost of equals) is a fingerprint, so equal
windows always select the same line as their anchor. Anchors are far fewer than windows
and carry one number; only where an anchor's hash occurs at two places or more are the
windows around it, to the left and to the right, compared by a 128-bit digest, each with
the first place of its kind. A line that a third of all documents share is thus counted by
partial sums, and no two of its places are paired.

Defined cases: null text stays null (it has one empty line); windows of blank lines alone
never count; rows that agree in id and text are one document listed several times, and stay
or lose lines together; null ids come first; other columns are kept as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import digest_key, fresh, staged

RUN = 3
LONG_WORDS = 50


def windows(docs: DataFrame, id_col: str, text_col: str, run: int = RUN, long_words: int = LONG_WORDS, passages: bool = False) -> DataFrame:
    """(key, id, at, lines, anchor, place, content): all windows of all documents.

    at: first line; lines: how many; anchor: the window's smallest line hash and ``place``
    the line it is on; content: digest of the window.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest_key(F.col(id_col), F.col(text_col)).alias("key"))
    rows = rows.select("id", "key", F.split("text", "\n").alias("line"))
    rows = rows.withColumn("hash", F.transform("line", lambda x: F.xxhash64(x)))

    def window(at: Column, n: int) -> Column:
        """Lines at .. at + n - 1 (``at`` counts from 0)."""
        some = F.slice("hash", at + 1, n)
        least = F.array_min(some)
        place = at + n - F.array_position(F.reverse(some), least).cast("int")
        return F.struct(at.alias("at"), F.lit(n).alias("lines"), least.alias("anchor"), place.alias("place"), F.array_join(F.slice("line", at + 1, n), "\n").alias("content"))

    def single(line: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(1).alias("lines"), F.element_at(F.col("hash"), at + 1).alias("anchor"), at.alias("place"), line.alias("content"))
    none = F.array().cast("array<struct<at:int,lines:int,anchor:bigint,place:int,content:string>>")
    runs = F.when(F.size("line") >= run, F.transform(F.sequence(F.lit(0), F.size("line") - run), lambda at: window(at, run))).otherwise(none)
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    long_ = F.filter(F.transform("line", single), lambda s: words(s["content"]) >= long_words)
    if passages:
        rows = rows.withColumn("words", F.transform("line", lambda x: F.regexp_count(x, F.lit(r"(?U)\S+"))))

        def passage(n: int) -> Column:
            long_at = F.filter(F.sequence(F.lit(0), F.size("line") - n), lambda at: F.aggregate(F.slice("words", at + 1, n), F.lit(0), lambda a, b: a + b) >= long_words)
            return F.when(F.size("line") >= n, F.transform(long_at, lambda at: window(at, n))).otherwise(none)
        long_ = F.concat(none, *(passage(n) for n in range(1, run)))
    out = rows.select("id", "key", F.explode(F.concat(runs, long_) if run > 1 else F.transform("line", single)).alias("w")).select("id", "key", "w.*")
    out = out.where(F.trim(F.replace("content", F.lit("\n"), F.lit(""))) != "")
    return out.withColumn("content", F.unhex(F.md5("content")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS, passages: bool = False) -> DataFrame:
    """(key, at, lines): windows that occurred before; ``key`` is the document's ``digest_key``."""
    all_ = staged(windows(docs, id_col, text_col, run, long_words, passages), "windows")
    where = F.struct("key", "place")
    anchors = all_.groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("anchor")
    # Written tables, so that the joins below can split the rows of a hot line.
    found = all_.join(staged(anchors, "anchors"), "anchor", "left_semi").select("content", "id", "key", "at", "lines")
    found = staged(found, "candidates")
    order = F.struct("id", "key", "at")
    firsts = found.groupBy("content").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("content", "first")
    later = found.join(staged(firsts, "firsts"), "content").where(order > F.col("first"))
    return later.select("key", "at", "lines")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS,
          passages: bool = False, lines_name: str | None = None, removed_name: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines deleted from ``text_col``; optionally the numbers of lines and of deleted lines.

    New columns must not clash with existing ones.
    """
    key, gone, line = fresh(docs, "key_", "gone_", "line_")
    cover = repeats(docs, id_col, text_col, run, long_words, passages).select("key", F.explode(F.sequence("at", F.col("at") + F.col("lines") - 1)).alias("i"))
    lost = cover.groupBy("key").agg(F.collect_set("i").alias("i"))  # lines of one document
    rows = docs.withColumn(key, digest_key(F.col(id_col), F.col(text_col)))
    rows = rows.join(lost.select(F.col("key").alias(key), F.col("i").alias(gone)), key, "left").withColumn(line, F.split(text_col, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(F.col(line), i + 1)), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if lines_name:
        columns.append(F.greatest(F.size(line), F.lit(1)).cast("long").alias(lines_name))
    if removed_name:
        columns.append(F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(removed_name))
    return rows.select(*columns)
