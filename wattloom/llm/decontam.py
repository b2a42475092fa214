"""Benchmark decontamination by the q-gram lemma on diagonal bands.

Texts are lower-cased and white space is collapsed. A benchmark item is cut into windows of
``window`` characters (a shorter item is one window) that overlap by half, the last at its end. A document holds a
window if some substring of it is within the window's edit budget (a tenth of its length).

If an alignment has at most k edits, at least m - q + 1 - k q of the window's q-grams occur
in the document, all of them on the 2k + 1 diagonals around the alignment. Diagonals are
counted in bands of 4k + 2 that overlap by half, so one band holds them all. Bands that
reach the bound are verified by an alignment over the band's diagonals; nothing else is.

The benchmark is a stated query set: it is read in blocks of bounded size, and each block
passes over all documents where they lie, without a shuffle.

Defined cases: null or empty document or item matches nothing; items shorter than a q-gram
after normalization are too short to tell and match nothing; repeated document rows get
equal results; extra columns are ignored (or kept, by ``clean``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import pieces

Q = 8
WINDOW = 64
BUDGET = 0.1
BLOCK = 20_000  # windows of one pass over the documents
SLICE = 500_000  # characters of a document looked at together
MOST = 2_000_000  # q-gram hits that are expanded together
FILTER_BITS = 21
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
OUTSIDE = (1 << 32) - 1  # no code point


def normalized(text: str) -> str:
    """Lower case, ASCII white space collapsed."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(length: int, q: int = Q, share: float = BUDGET) -> int:
    """Edits allowed: a share of the length, and never so many that the lemma asks for no q-gram."""
    return min(int(length * share), (length - q) // q)


def windows_of(text: str, q: int = Q, window: int = WINDOW) -> list[str]:
    data = normalized(text)
    if len(data) < q:
        return []
    last = max(0, len(data) - window)
    return [data[a:a + window] for a in sorted({*range(0, last, window // 2), last})]


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each position on; one for each position but the last q - 1.

    Different q-grams with one hash count as one: that can add bands to verify, never take one away.
    """
    wide = data.astype(np.uint64)
    out = np.zeros(max(0, len(data) - q + 1), np.uint64)
    for k in range(q):
        out = out * ODD + wide[k:k + len(out)]
    return out


class Index:
    """The q-grams of a block of windows."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, window: int = WINDOW, share: float = BUDGET):
        self.q, self.ids, self.windows, owner = q, [], [], []
        for item, text in items:
            parts = windows_of(text or "", q, window)
            if parts:
                owner += [len(self.ids)] * len(parts)
                self.ids.append(item)
                self.windows += parts
        self.owner = np.array(owner, np.int64)
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.k = np.array([budget(len(w), q, share) for w in self.windows], np.int64)
        self.least = self.length - q + 1 - self.k * q
        self.of = np.bincount(self.owner, minlength=len(self.ids))
        if not self.windows:
            return
        codes = [grams(points(w), q) for w in self.windows]
        code = np.concatenate(codes)
        win = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        off = np.concatenate([np.arange(len(c)) for c in codes])
        order = np.argsort(code, kind="stable")
        self.code, first = np.unique(code[order], return_index=True)
        self.first = np.concatenate([first, [len(code)]])
        self.win, self.off = win[order], off[order]
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[self._slot(self.code)] = True
        self.span = int((self.length + 2 * self.k).max())  # an alignment's q-grams lie within so many characters
        self.fewest = int(self.least.min())

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * MIX) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, window, edits): the best alignment of each window that a text holds."""
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        if self.windows:
            held, size = [], 0
            step = SLICE - 2 * self.span
            for k, t in enumerate(texts):
                data = points(normalized(t))
                for at in range(0, max(1, len(data) - 2 * self.span), step):
                    part = data[at:at + SLICE]
                    held.append((k, part))
                    size += len(part)
                    if size >= SLICE:
                        found.append(self._search(held))
                        held, size = [], 0
            if held:
                found.append(self._search(held))
        doc, win, edits = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((edits, win, doc))
        doc, win, edits = doc[order], win[order], edits[order]
        best = np.ones(len(doc), bool)
        best[1:] = (doc[1:] != doc[:-1]) | (win[1:] != win[:-1])
        return doc[best], win[best], edits[best]

    def _halves(self, held: list[tuple[int, np.ndarray]]) -> list[list[tuple[int, np.ndarray]]]:
        """Two parts of what is searched; halves of one text overlap by two spans, so each alignment lies in one of them whole."""
        if len(held) > 1:
            return [held[:len(held) // 2], held[len(held) // 2:]]
        (k, part), = held
        middle = len(part) // 2
        return [[(k, part[:middle + self.span])], [(k, part[middle - self.span:])]]

    def _search(self, held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = np.full(self.q, OUTSIDE, np.uint32)
        data = np.concatenate([x for _, p in held for x in (p, gap)])
        sizes = np.array([len(p) for _, p in held], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + self.q)[:-1]])
        none = np.zeros(0, np.int64)
        code = grams(data, self.q)
        there = self.table[self._slot(code)]
        at = np.flatnonzero(there)
        # Only where as many hits as the smallest bound lie within one alignment's span.
        near = np.searchsorted(at, at + self.span) - np.arange(len(at)) >= self.fewest
        reach = np.zeros(len(data) + self.span + 1, np.int32)
        reach[at[near]] += 1  # positions are different
        reach[at[near] + self.span] -= 1
        at = at[np.cumsum(reach)[at] > 0]
        place = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        same = self.code[place] == code[at]
        at, place = at[same], place[same]
        many = self.first[place + 1] - self.first[place]
        if many.sum() > MOST and (len(held) > 1 or sizes[0] > 8 * self.span):
            return tuple(np.concatenate(x) for x in zip(*map(self._search, self._halves(held)), strict=True))
        n_band = int(sizes.max() + 2 * self.length.max()) + 4
        # What is left has few places: its bands are counted by parts of the hits and added up.
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // MOST)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, here, n = at[a:b], place[a:b], many[a:b]
            which = np.repeat(self.first[here] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x = np.repeat(part, n)
            win, off = self.win[which], self.off[which]
            doc = np.searchsorted(starts, x, side="right") - 1
            half = 2 * self.k[win] + 1
            shift = (self.length.max() // half + 2) * half
            found = (doc * len(self.windows) + win) * n_band + (x - starts[doc] - off + shift) // half
            found, hits = np.unique(np.concatenate([found, found - 1]), return_counts=True)
            if len(key):
                found, which = np.unique(np.concatenate([key, found]), return_inverse=True)
                hits = np.bincount(which, np.concatenate([count, hits])).astype(np.int64)
            key, count = found, hits
        band, rest = key % n_band, key // n_band
        win, doc = rest % len(self.windows), rest // len(self.windows)
        keep = count >= self.least[win]
        band, win, doc = band[keep], win[keep], doc[keep]
        if not len(band):
            return none, none, none
        half = 2 * self.k[win] + 1
        low = band * half - (self.length.max() // half + 2) * half  # first diagonal, from the text's start
        edits = np.full(len(band), 1 << 20)
        for m in np.unique(self.length[win]):
            rows = np.flatnonzero(self.length[win] == m)
            for a in range(0, len(rows), 2000):
                some = rows[a:a + 2000]
                edits[some] = self._align(data, starts[doc[some]], sizes[doc[some]], low[some], win[some], int(m))
        ok = edits <= self.k[win]
        return np.array([k for k, _ in held], np.int64)[doc[ok]], win[ok], edits[ok]

    def _align(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, low: np.ndarray, win: np.ndarray, m: int) -> np.ndarray:
        """Fewest edits between each window and a substring, on the band's diagonals from ``low`` on."""
        k = int(self.k[win[0]])  # a function of the length
        width = 2 * (2 * k + 1)
        at = low[:, None] + np.arange(m + width)
        inside = (at >= 0) & (at < size[:, None])
        text = np.where(inside, data[np.clip(start[:, None] + at, 0, len(data) - 1)], OUTSIDE)
        words, which = np.unique(win, return_inverse=True)
        pattern = np.stack([points(self.windows[w]) for w in words])[which]
        step = np.arange(width, dtype=np.int32)
        row = np.zeros((len(win), width), np.int32)
        for i in range(m):
            cost = row + (text[:, i:i + width] != pattern[:, i:i + 1])  # equal or replaced
            cost[:, :-1] = np.minimum(cost[:, :-1], row[:, 1:] + 1)  # a pattern character left out
            row = np.minimum.accumulate(cost - step, axis=1) + step  # text characters put in
        return row.min(1)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int = BLOCK) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most about ``size`` windows; the driver holds what is sent with the blocks' plans."""
    held, n = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").toLocalIterator():
        held.append((r["i"], r["t"]))
        n += len(r["t"]) // (WINDOW // 2) + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", size: int = BLOCK, **options) -> DataFrame:
    """(id, item, edits, windows, of): per document and item it holds any window of: the fewest
    edits of a window, how many of the item's windows it holds, and of how many."""
    doc_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", doc_type), T.StructField("item", item_type), T.StructField("edits", T.LongType()),
                           T.StructField("windows", T.LongType()), T.StructField("of", T.LongType())])
    chosen = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def searcher(block: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type
            index = Index(block, **options)
            for part, texts in pieces(batches, "t"):
                doc, win, edits = index.search(texts)
                if not len(doc):
                    continue
                pair, which = np.unique(doc * len(index.ids) + index.owner[win], return_inverse=True)
                least = np.full(len(pair), 1 << 30)
                np.minimum.at(least, which, edits)
                item = pair % len(index.ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("i").take(pa.array(pair // len(index.ids))), pa.array([index.ids[i] for i in item], to_arrow_type(item_type)),
                     pa.array(least), pa.array(np.bincount(which)), pa.array(index.of[item])], names=schema.names)
        return run
    out = None
    for block in blocks(benchmark, item_col, item_text_col, size):
        found = chosen.mapInArrow(searcher(block), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = BLOCK, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item. One pass per block, no shuffle."""
    schema, where = docs.schema, docs.columns.index(text_col)

    def filterer(block: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block, **options)
            names = [f"c{k}" for k in range(len(schema.fields))]
            for batch in batches:
                batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
                for part, texts in pieces(iter([batch]), names[where]):
                    keep = np.ones(len(texts), bool)
                    keep[index.search(texts)[0]] = False
                    yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep)).columns, names=schema.names)
        return run
    for block in blocks(benchmark, item_col, item_text_col, size):
        docs = docs.mapInArrow(filterer(block), schema)
    return docs
