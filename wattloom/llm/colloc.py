"""Collocations from sorted count streams: left, right and extension counts by merge joins.

Texts are split at punctuation and line ends into pieces, pieces at blanks and tabs into
words; ASCII letters are case folded. Everything is counted per language. A candidate is a
phrase of two or three words that occurs ``least`` times or more, overlaps included, within
pieces. Cutting it after k words gives l = f(first part), r = f(rest) and the score
floor(10^6 a^2 / (l r)), a = f(phrase); its lowest-scoring cut counts.

How: tasks count runs of text exactly in word numbers and emit (lang, phrase, count); Spark
adds these up. A part of a phrase is at least as frequent as the phrase, so the streams keep
only phrases that occur ``least`` times: one in *prefix order* (lang, first words) and one in
*suffix order* (lang, last words). Merge joins step through two sorted streams in lockstep:
first parts meet phrases in prefix order, rests in suffix order, and a two-word phrase meets
its one-word extensions in both. No hash table of counts is built; Spark splits the rows of
a word with very many extensions over tasks.

Three-word phrases are counted in a second pass, only where both two-word parts may be
frequent. That is asked of a bitmap of fixed size (``BITS`` bits, 8 MB), which may say yes
too often but never no to a frequent one, so counts stay exact at every size.

Defined cases: null text is empty; null language is ``und``; repeated rows count each time;
an empty table gives no rows; extra columns are ignored; a word may be of any length; text
is cut only between words and pieces, so a long text is counted as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import pieces, staged

LEAST = 10
COVER = 50  # percent of a phrase's occurrences within one longer candidate that drop it
BITS = 26
PENDING = 1_000_000  # n-grams that a task holds before it counts them
BLOCK = 1 << 20
UND = "und"

_FOLD = bytes(b"\n"[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else b" "[0] if chr(b) in " \t" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_CUT = re.compile(rb"[ \n]")


class _Words:
    """Numbers for words, in the order of their first use; 0 ends a piece."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {b"\n": 0}

    def __call__(self, data: bytes) -> Iterator[np.ndarray]:
        """The word numbers of a folded text, a bounded block at a time, with a 0 after each piece."""
        at, ids = 0, self.ids
        while at < len(data):
            to = at + BLOCK
            if to < len(data):
                m = _CUT.search(data, to)
                to = m.start() if m else len(data)
            yield np.array([ids.setdefault(w, len(ids)) for w in data[at:to].replace(b"\n", b" \n ").split(b" ") if w], np.int64)
            at = to

    def column(self) -> pa.Array:
        return pa.array(list(self.ids), pa.binary())


def _runs(batches: Iterator[pa.RecordBatch], words: _Words, overlap: int) -> Iterator[list[tuple[str, np.ndarray, int]]]:
    """For each piece of a batch: (lang, word numbers, how many repeated ones they start with).

    A text's later blocks start with the last ``overlap`` words before them. Between two pieces the caller may call ``words.clear()``.
    """
    for part, texts in pieces(batches, "t"):
        together: dict[str, list[np.ndarray]] = {}
        found = []
        for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
            tail = np.zeros(0, np.int64)
            for block in words(text.encode("utf-8", "surrogatepass").translate(_FOLD)):
                if len(tail):
                    block = np.concatenate([tail, block])
                    found.append((lang, block, len(tail)))
                else:
                    together.setdefault(lang, []).extend((block, np.zeros(1, np.int64)))
                tail = block[max(0, len(block) - overlap):]
        yield found + [(lang, np.concatenate(x), 0) for lang, x in together.items()]


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _joined(words: pa.Array, *ids: np.ndarray) -> pa.Array:
    """Phrases, space-joined, from word numbers."""
    out = words.take(pa.array(ids[0]))
    for more in ids[1:]:
        out = pc.binary_join_element_wise(out, words.take(pa.array(more)), pa.scalar(b" ", pa.binary()))
    return out.cast(pa.string())


FIELDS = "lang string, size int, phrase string, f long"


def _rows(lang: str, size: int, phrases: pa.Array, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(f), 100_000):
        n = min(100_000, len(f) - lo)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), phrases.slice(lo, n), pa.array(f[lo:lo + n])],
                                         names=["lang", "size", "phrase", "f"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of two-word phrases of a part of the texts."""
    words, held, size = _Words(), {}, 0

    def emit() -> Iterator[pa.RecordBatch]:
        column = words.column()
        for lang, (ones, twos, counts) in held.items():
            f = np.bincount(np.concatenate(ones))
            there = np.nonzero(f)[0]
            yield from _rows(lang, 1, _joined(column, there), f[there])
            if twos:
                pair, f = _counted(twos, counts)
                yield from _rows(lang, 2, _joined(column, pair >> 32, pair & 0xFFFFFFFF), f)
    for piece in _runs(batches, words, 1):
        for lang, run, known in piece:
            ones, twos, counts = held.setdefault(lang, ([], [], []))
            ones.append(run[known:][run[known:] > 0])
            good = (run[:-1] > 0) & (run[1:] > 0)
            pair, n = np.unique(run[:-1][good] << 32 | run[1:][good], return_counts=True)
            twos.append(pair)
            counts.append(n.astype(np.int64))
            size += len(pair) + len(run) // 2
        if size >= PENDING:
            yield from emit()
            held, size = {}, 0
            words.clear()
    yield from emit()


def _long(bitmap: np.ndarray):
    """Counts of three-word phrases both of whose two-word parts are in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = _Words(), {}, 0

        def emit() -> Iterator[pa.RecordBatch]:
            column = words.column()
            for lang, runs in held.items():
                ids = np.concatenate(runs)
                good = (ids[:-1] > 0) & (ids[1:] > 0)
                pair, at = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
                seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)
                phrases = _joined(column, pair >> 32, pair & 0xFFFFFFFF).cast(pa.binary()).to_pylist()
                bit = np.array([xxhash.xxh64_intdigest(p, seed=seed) & (1 << BITS) - 1 for p in phrases], np.int64)
                maybe = good & (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)[at]
                start = np.nonzero(maybe[:-1] & maybe[1:])[0]
                if len(start):
                    three, n = np.unique(at[start] * np.int64(len(column)) + ids[start + 2], return_counts=True)
                    first = pair[three // len(column)]
                    yield from _rows(lang, 3, _joined(column, first >> 32, first & 0xFFFFFFFF, three % len(column)), n.astype(np.int64))
        for piece in _runs(batches, words, 2):
            for lang, ids, _ in piece:
                held.setdefault(lang, []).extend((ids, np.zeros(1, np.int64)))
                size += len(ids)
            if size >= PENDING:
                yield from emit()
                held, size = {}, 0
                words.clear()
        yield from emit()
    return run


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases' hashes; 2048 rows of 4096 bytes at most, whatever the table's size."""
    spot = F.xxhash64("lang", "phrase").bitwiseAND((1 << BITS) - 1)
    rows = phrases.select(spot.alias("p")).groupBy(F.expr("p div 32768").alias("b")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bits")).collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows:
        out[r["b"] * 4096:(r["b"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases (lang, size, phrase, f) of one to three words that occur ``least`` times or more, and words (lang, n) in all)."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UND)).alias("lang"), F.col(text_col).alias("t"))
    short = staged(texts.mapInArrow(_short, FIELDS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")), "short_counts")
    frequent = staged(short.where(F.col("f") >= least), "short_stream")
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(frequent.where("size = 2")))

    def three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _long(shared.value)(batches)
    long = texts.mapInArrow(three, FIELDS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return frequent.unionByName(staged(long, "long_stream")), short.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))


def _cut(l: str, r: str, k: int) -> Column:
    """A cut's (score, k, l, r), in exact decimals: counts below 10^15, products below 10^37."""
    score = F.expr(f"cast(f as decimal(15,0)) * cast(f as decimal(15,0)) * 1000000 div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score): all candidates that no longer candidate covers."""
    stream, totals = counts(docs, least, lang_col, text_col)
    stream = stream.withColumn("w", F.split("phrase", " "))
    two, three = stream.where("size = 2"), stream.where("size = 3")
    # Prefix order: the first one or two words; suffix order: the last ones.
    heads = stream.where("size < 3").select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = stream.where("size < 3").select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))

    def cut(rows: DataFrame, k: int) -> DataFrame:
        rest = F.expr(f"array_join(slice(w, {k + 1}, size - {k}), ' ')")
        parts = rows.withColumns({"head": F.array_join(F.slice("w", 1, k), " "), "tail": rest})
        parts = parts.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"])
        return parts.select("lang", "size", "phrase", "f", _cut("l", "r", k).alias("cut"))
    cuts = cut(two, 1).unionByName(cut(three, 1)).unionByName(cut(three, 2))
    lowest = cuts.groupBy("lang", "size", "phrase").agg(F.first("f").alias("f"), F.min(F.struct("cut.score", "cut.k", "cut.l", "cut.r")).alias("cut"))
    # Extension counts: a two-word phrase against the three-word ones that begin and end with it.
    grown = three.select("lang", F.expr("array_join(slice(w, 1, 2), ' ')").alias("phrase"), "f").unionByName(
        three.select("lang", F.expr("array_join(slice(w, 2, 2), ' ')").alias("phrase"), "f"))
    longest = grown.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longest.hint("merge"), ["lang", "phrase"], "left").where(
        (F.col("size") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f")))
    return kept.join(totals, "lang").select("lang", "phrase", "size", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language (from 1): by score, then frequency, both falling, then phrase.

    Rows are first counted by steps of the score's logarithm; only those of steps that the
    first ``top`` reach are sorted, so a language's rows do not all meet in one task.
    """
    found = staged(found.withColumn("step", F.floor(16 * F.log2(F.col("score") + 1.0))), "candidates")
    steps = found.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("here"))
    above = F.sum("here").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    reached = steps.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top).select("lang", "step")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.join(reached, ["lang", "step"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
