"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and +1, seeded by its code point. A letter n-gram
is bound by multiplying its letters' vectors, each rotated by its distance from the end.
A document bundles (adds) the vectors of all its n-grams; a language prototype bundles the
documents of its training rows, each scaled to length one. The prediction is the prototype
with the largest cosine.

Only letters count (case folded); any run of other characters is one gap symbol.

Defined cases: null, empty or letterless text gives ``und`` and score 0; of equal cosines
the first language in code-point order wins; without any training row all is ``und``;
training rows with null language, text or id are not learned from; repeated rows get equal
results (and count each in training); extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import pieces

DIMENSIONS = 1024
GRAM = 3
LETTER = regex.compile(r"\p{L}")
GAP = 0  # symbol of everything between words
PIECE = 1 << 18  # symbols encoded at once


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else GAP."""
    points = np.arange(sys.maxunicode + 1)
    letter = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in points), bool, len(points))
    return np.where(letter, points, GAP).astype(np.uint32)


@lru_cache(maxsize=4096)
def letter_vector(symbol: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([symbol, 20240101]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def symbols_of(text: str) -> np.ndarray:
    """Letters of a text with one gap for each run of others, and a gap at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[GAP], letter_table()[points], [GAP]])
    return s[np.concatenate([[True], (s[1:] != GAP) | (s[:-1] != GAP)])]


class Encoder:
    """Bundles the n-gram vectors of a batch of documents by one matrix product."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.known: dict[tuple, np.ndarray] = {}

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams (one row of symbols each)."""
        out = None
        for k in range(self.gram):
            symbols, which = np.unique(grams[:, k], return_inverse=True)
            rotated = np.stack([np.roll(letter_vector(int(s), self.dimensions), self.gram - 1 - k) for s in symbols])[which]
            out = rotated if out is None else out * rotated
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(documents x dimensions) sums, and the number of n-grams with a letter in the middle of each document."""
        total, letters = np.zeros((len(texts), self.dimensions), np.float32), np.zeros(len(texts), np.int64)
        parts = [(k, s) for k, t in enumerate(texts) for s in self._cut(t)]
        at = 0
        while at < len(parts):
            size, to = 0, at
            while to < len(parts) and (to == at or size + len(parts[to][1]) <= PIECE):
                size, to = size + len(parts[to][1]), to + 1
            self._add(parts[at:to], total, letters)
            at = to
        return total, letters

    def _cut(self, text: str) -> Iterator[np.ndarray]:
        """A long text in pieces that overlap by a gram less one symbol."""
        s = symbols_of(text)
        step = PIECE - self.gram + 1
        for at in range(0, max(1, len(s) - self.gram + 1), step):
            yield s[at:at + PIECE]

    def _add(self, parts: list[tuple[int, np.ndarray]], total: np.ndarray, letters: np.ndarray) -> None:
        rows = np.unique([k for k, _ in parts], return_inverse=True)
        s = np.concatenate([p for _, p in parts])
        n = len(s) - self.gram + 1
        if n < 1:
            return
        row = np.repeat(rows[1], [len(p) for _, p in parts])
        part = np.repeat(np.arange(len(parts)), [len(p) for _, p in parts])
        good = (part[:n] == part[self.gram - 1:]) & (s[1:n + 1] != GAP)  # within one text, around a letter
        there = np.zeros(sys.maxunicode + 1, bool)
        there[s] = True
        alphabet = np.flatnonzero(there)
        place = np.zeros(sys.maxunicode + 1, np.int32)
        place[alphabet] = np.arange(len(alphabet))
        code, size = place[s], len(alphabet)
        key = np.zeros(n, np.int64)
        for k in range(self.gram):
            key = key * size + code[k:k + n]
        key, row = key[good], row[:n][good]
        if not len(key):
            return
        if size ** self.gram <= 1 << 23:
            there = np.zeros(size ** self.gram, bool)
            there[key] = True
            kinds = np.flatnonzero(there)
            place = np.zeros(size ** self.gram, np.int32)
            place[kinds] = np.arange(len(kinds))
            which = place[key]
        else:
            kinds, which = np.unique(key, return_inverse=True)
        docs = rows[0]
        width = max(1 << 10, (1 << 21) // len(docs))
        for lo in range(0, len(kinds), width):  # a bounded number of n-grams at once
            hi = min(lo + width, len(kinds))
            if hi - lo == len(kinds):
                w, r = which, row
            else:
                inside = (which >= lo) & (which < hi)
                w, r = which[inside], row[inside]
            counts = np.bincount(r * (hi - lo) + (w - lo), minlength=len(docs) * (hi - lo)).reshape(len(docs), hi - lo).astype(np.float32)
            digits = kinds[lo:hi]
            grams = np.stack([alphabet[digits // size ** (self.gram - 1 - k) % size] for k in range(self.gram)], axis=1)
            total[docs] += counts @ self.bound(grams).astype(np.float32)
        letters[docs] += np.bincount(row, minlength=len(docs))


def _vectors(texts: list[str], dimensions: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length one, and which of them have a letter."""
    v, n = Encoder(dimensions, gram).encode(texts)
    length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    # Marks count within n-grams, but a text of marks alone (as after emoji) has no letter.
    has = (n > 0) & (length > 0) & np.array([LETTER.search(t) is not None for t in texts], bool)
    return v / np.where(has, length, 1)[:, None], has


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """Prototypes: one row (lang, profile array<double>) a language, from all labelled rows that ``where`` admits.

    A task adds up its documents and gives one row for each language and dimension; these
    partial sums are what is shuffled. The result has as many rows as there are languages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in pieces(batches, "t"):
            v, has = _vectors(texts, dimensions, gram)
            langs = np.array(part.column("l").to_pylist())
            for lang in np.unique(langs[has]):
                sums[lang] = sums.get(lang, 0.0) + v[has & (langs == lang)].sum(0, dtype=np.float64)
        for lang, s in sums.items():
            # Integer sums do not depend on the order of addition.
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)),
                                              pa.array(np.rint(s * (1 << 24)).astype(np.int64))], names=["lang", "d", "v"])
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False))))
    sums = rows.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).mapInArrow(run, "lang string, d int, v long")
    per = sums.groupBy("lang", "d").agg(F.sum(F.col("v").cast("double")).alias("v"))
    return per.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("profile"))  # a fixed number a language


def predict(docs: DataFrame, prototypes: list[tuple[str, list[float]]], id_cols: list[str], text_col: str = "text",
            gram: int = GRAM, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``id_cols``, the predicted language and the cosine (0 to 1) with its prototype.

    ``prototypes`` are the collected rows of ``fit``: a few vectors, their number is that of
    languages, not of rows.
    """
    names = [n for n, _ in sorted(prototypes)]
    dimensions = len(prototypes[0][1]) if prototypes else DIMENSIONS
    matrix = np.array([p for _, p in sorted(prototypes)], np.float64).reshape(len(names), dimensions)
    length = np.sqrt((matrix ** 2).sum(1, keepdims=True))
    matrix = (matrix / np.where(length > 0, length, 1)).astype(np.float32)
    fields = [T.StructField(c, docs.schema[c].dataType) for c in id_cols]
    schema = T.StructType([*fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    inner = [f"c{k}" for k in range(len(id_cols))]
    text = inner[id_cols.index(text_col)] if text_col in id_cols else "t"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text):
            v, has = _vectors(texts, dimensions, gram)
            if names:
                cos = v @ matrix.T
                best = cos.argmax(1)
                lang = [names[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                score = np.where(has, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in inner), pa.array(lang, pa.string()), pa.array(np.round(score, 6))], names=schema.names)
    chosen = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(id_cols, inner, strict=True)), *([F.col(text_col).alias("t")] if text == "t" else []))
    return chosen.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents that nothing is learned from (crc32 of the id as text, modulo 3, is 1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_cols: list[str] | None = None, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fits on the labelled rows that ``learn`` admits and predicts for all rows."""
    prototypes = [(r["lang"], list(r["profile"])) for r in fit(docs, text_col, lang_col, learn).collect()]
    return predict(docs, prototypes, id_cols or ["doc_id"], text_col, **options)
