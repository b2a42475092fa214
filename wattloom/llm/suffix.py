"""Repeated byte strings by suffix order and longest previous factors.

A position *repeats* if the ``length`` (400) bytes from it on also start at another
position, in the same document or another; strings never cross documents. Either every
repeating string goes (all copies), or only those with an earlier copy, so that the first
stays; earlier means a smaller (id, text hash, position).

Deciding this needs the suffixes of all texts in order, which no task can hold. So they are
cut into groups that can be sorted alone: of the ``fragment``-byte hashes within a string
the smallest (rightmost of equals) is its anchor, and equal strings have equal anchors at
equal distances. Neighbouring positions with one anchor form a *segment*.

* An anchor that occurs once: nothing around it repeats.
* All its segments equal: everything in them repeats, no bytes are looked at.
* Else one segment of each kind goes to its anchor's group. There, a suffix array (prefix
  doubling, cut off at ``length``) brings equal strings side by side, in text order; a
  suffix whose neighbour before it in suffix order lies earlier and agrees in ``length``
  bytes has a longest previous factor of at least that, and likewise with the one after it.
* An anchor with very many kinds of segments is not sorted in one task: its strings are
  counted by two independent 64-bit hashes, which split and combine over all tasks.

Defined cases: null text is empty; texts shorter than ``length`` never repeat; rows that
agree in id and text are separate occurrences, so with all copies removed both lose their
strings, and with the first kept they count as one document; null ids come first; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import pieces, staged

LENGTH = 400
FRAGMENT = 200
CROWD = 512  # kinds of segments of one anchor that a task sorts together
MANY = 10_000  # rows of one key that a task joins
PLACE = np.uint64((1 << 24) - 1)
SLICE = 4_000_000  # bytes whose hashes are made together (below 2^24)
GROUP = 2_000_000  # bytes sorted together
U = np.uint64


@lru_cache(maxsize=2)
def powers(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value, and the powers of a random odd base and of its inverse, modulo 2^64."""
    rng = np.random.default_rng([which, 400])
    base = int(rng.integers(1 << 62, 1 << 63)) | 1
    up, down = (np.full(SLICE + LENGTH * 4, b, U) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1), np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Rolling:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        table, up, self.down = powers(which)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(table[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by minima from both ends of blocks."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    block = padded.reshape(blocks, w)
    forward = np.minimum.accumulate(block, axis=1).ravel()
    backward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1:w - 1 + n])


def cut(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Slices of texts put together: bytes, (text number, offset) of each slice, starts, sizes."""
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def done():
        sizes = np.array([len(p) for _, _, p in held], np.int64)
        return np.frombuffer(b"".join([p for _, _, p in held]), np.uint8), [(k, o) for k, o, _ in held], np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes
    for k, t in enumerate(texts):
        step = SLICE // 2
        for at in range(0, max(1, len(t) - length + 1), step):
            part = t[at:at + step + length - 1]
            if len(part) < length:
                continue
            if held and total + len(part) > SLICE:
                yield done()
                held, total = [], 0
            held.append((k, at, part))
            total += len(part)
    if held:
        yield done()


def segments(texts: list[bytes], length: int = LENGTH, fragment: int = FRAGMENT) -> tuple[np.ndarray, ...]:
    """text, lo, n, place, anchor, content: ``n`` positions from ``lo`` on share the anchor at ``place``."""
    out = []
    for data, owner, starts, sizes in cut(texts, length):
        rolling = Rolling(data)
        gram = rolling.all(fragment)
        packed = (gram & ~PLACE) | (PLACE - np.arange(len(gram), dtype=U))
        place = (PLACE - (sliding_min(packed, length - fragment + 1) & PLACE)).astype(np.int64)
        edge = np.zeros(len(data) + 1, np.int64)
        edge[starts] += 1
        np.add.at(edge, starts + sizes - length + 1, -1)
        s = np.flatnonzero(np.cumsum(edge)[:len(place)])
        p = place[s]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
        first = np.flatnonzero(new)
        lo, n, p = s[first], np.diff(np.concatenate([first, [len(s)]])), p[first]
        part = np.searchsorted(starts, lo, side="right") - 1
        content = mixed(rolling.of(lo, lo + n - 1 + length) + U(31) * (p - lo).astype(U) + U(1009) * n.astype(U))
        who, offset = np.array(owner, np.int64)[part].T
        base = offset - starts[part]
        out.append((who, lo + base, n, p + base, gram[p].view(np.int64), content.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``starts`` by their suffixes cut off at ``length`` bytes and then by place, rank: equal strings have equal ranks).

    Prefix doubling: ranks of 2k bytes from pairs of ranks of k bytes.
    """
    n = len(data)
    at = np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    rank = np.zeros(n, U)
    size = min(8, 1 << (length.bit_length() - 1))
    for k in range(size):
        rank = rank << U(8) | padded[k:k + n]
    rank = np.unique(rank, return_inverse=True)[1]

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(U) << U(32) | b.astype(U), return_inverse=True)[1]
    while size * 2 <= length:
        rank, size = pair(rank, rank[np.minimum(at + size, n - 1)]), size * 2
    own = rank[starts] if size == length else pair(rank[starts], rank[starts + length - size])
    return np.argsort(own, kind="stable"), own


def factors(order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes given in text order: is the longest previous (next) factor as long as the order's cut-off?

    Among suffixes that agree up to the cut-off the order is that of the text, so the
    previous smaller place in suffix order is the neighbour before, and the next larger one
    the neighbour after; further away the common prefix only gets shorter.
    """
    same = rank[order[1:]] == rank[order[:-1]]
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order[1:][same]] = True
    later[order[:-1][same]] = True
    return earlier, later


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_groups(length: int, keep_first: bool, names: list[str]):
    """Sorted segments of whole groups -> ranges of repeating positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch | None:
            blobs = table.column("data").combine_chunks()
            data = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8)
            n = table.column("n").to_numpy()
            size = n + length - 1
            base = np.cumsum(size) - size
            starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
            earlier, later = factors(*suffix_order(data, starts, length))
            hit = earlier if keep_first else earlier | later
            owner = np.repeat(np.arange(len(n)), n)
            # Runs may not go on from one segment into the next: put a gap between them.
            spaced = np.zeros(len(hit) + len(n), bool)
            spaced[np.arange(len(hit)) + owner] = hit
            a, b = _runs(spaced)
            if not len(a):
                return None
            seg = np.searchsorted(np.cumsum(n + 1), a, side="right")
            first = a - (np.cumsum(n + 1) - (n + 1))[seg]
            lo = table.column("lo").to_numpy()[seg] + first
            rows = table.take(pa.array(seg))
            return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() for c in names] + [pa.array(lo), pa.array(lo + (b - a))], names=[*names, "lo", "hi"])
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            weight = np.cumsum(batch.column("n").to_numpy() + length - 1)
            change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if held and held[-1].column("anchor")[held[-1].num_rows - 1].as_py() != anchor[0]:
                change = np.concatenate([[0], change])
            at = 0
            for c in change.tolist():
                if size + (weight[c - 1] if c else 0) - (weight[at - 1] if at else 0) >= GROUP:
                    if c > at:
                        held.append(batch.slice(at, c - at))
                    if held and (got := done(pa.Table.from_batches(held))) is not None:
                        yield got
                    held, size, at = [], 0, c
            held.append(batch.slice(at))
            size += int(weight[-1] - (weight[at - 1] if at else 0))
        if held and (got := done(pa.Table.from_batches(held))) is not None:
            yield got
    return run


def joined(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with keys (one row each) and the count ``c`` of their rows: a key of over MANY rows is dealt to a task for each MANY of them.

    Only such keys are broadcast, at most one for MANY rows.
    """
    parts = F.ceil(F.col("c") / MANY).cast("long")
    often = keys.where(F.col("c") > MANY).select(*on, parts.alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("id", "x", "lo"), F.col("parts")), F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(often), on, "left").withColumn("part", part).drop("parts")
    keys = keys.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1))).drop("c")
    return rows.join(keys, [*on, "part"]).drop("part")


def ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True,
           fragment: int = FRAGMENT, crowd: int = CROWD) -> DataFrame:
    """(id, x, lo, hi): positions lo .. hi - 1 of the text (with ``xxhash64`` x) repeat and are to go."""
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), text.alias("t"))
    me = [T.StructField("id", kind), T.StructField("x", T.LongType())]
    L, I = T.LongType(), T.IntegerType()  # noqa: E741
    schema = T.StructType([*me, T.StructField("lo", L), T.StructField("n", I), T.StructField("anchor", L), T.StructField("content", L)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "t", SLICE):
            who, lo, n, _, anchor, content = segments([t.encode("utf-8") for t in texts], length, fragment)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("x").take(take), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content)], names=schema.names)
    all_ = staged((rows.distinct() if keep_first else rows).mapInArrow(scan, schema), "segments")
    seen = all_.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("content").alias("a"), F.max("content").alias("b")).where("c > 1")
    found = staged(joined(all_, staged(seen.select("anchor", "c", (F.col("a") == F.col("b")).alias("uniform")), "anchors"), ["anchor"]), "candidates")

    me_first = F.struct("id", "x", "lo")
    # The first of each kind of segment.
    kinds = staged(found.groupBy("anchor", "content").agg(F.min(F.struct("id", "x", "lo", "n", "uniform")).alias("f"), F.count(F.lit(1)).alias("copies")), "kinds")
    # Segments that have an equal one elsewhere repeat as a whole.
    copies = kinds.where("copies > 1").select("anchor", "content", F.col("copies").alias("c"), F.struct("f.id", "f.x", "f.lo").alias("first"))
    whole = joined(found, staged(copies, "copied"), ["anchor", "content"])
    if keep_first:
        whole = whole.where(me_first > F.col("first"))
    whole = whole.select("id", "x", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    # Of the others, one of each kind is compared with the other kinds of its anchor.
    several = kinds.where("NOT f.uniform").select("anchor", "f.id", "f.x", "f.lo", "f.n", "copies")
    crowds = staged(several.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > crowd).select("anchor", F.lit(True).alias("crowded")), "crowds")
    wanted = several.join(F.broadcast(crowds), "anchor", "left").select("id", "x", F.struct("anchor", "lo", "n", "copies", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("s"))
    wanted = wanted.groupBy("id", "x").agg(F.collect_list("s").alias("s"))  # segments of one text
    cut_schema = T.StructType([*me, T.StructField("lo", L), T.StructField("n", I), T.StructField("anchor", L), T.StructField("copies", L),
                               T.StructField("data", T.BinaryType()), T.StructField("h1", L), T.StructField("h2", L)])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "t", SLICE):
            for k, t in enumerate(texts):
                data = t.encode("utf-8")
                out: list[tuple] = []
                for s in part.column("s")[k].as_py():
                    piece = data[s["lo"]:s["lo"] + s["n"] + length - 1]
                    if s["crowded"]:
                        raw = np.frombuffer(piece, np.uint8)
                        h1, h2 = (Rolling(raw, w).all(length).view(np.int64).tolist() for w in (0, 1))
                        out += [(s["lo"] + i, 1, s["anchor"], s["copies"], None, h1[i], h2[i]) for i in range(s["n"])]
                    else:
                        out.append((s["lo"], s["n"], s["anchor"], s["copies"], piece, None, None))
                if out:
                    cols = [pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
                    take = pa.array([k] * len(out))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("x").take(take), *cols], names=cut_schema.names)
    given = (rows.dropDuplicates(["id", "x"]) if keep_first else rows).alias("r").join(
        wanted.alias("w"), F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.x") == F.col("w.x"))).select("r.id", "r.x", "r.t", "w.s")
    cuts = staged(given.mapInArrow(extract, cut_schema), "cuts")
    group_schema = T.StructType([*me, T.StructField("copies", L), T.StructField("lo", L), T.StructField("hi", L)])
    groups = cuts.where("data IS NOT NULL").drop("h1", "h2").repartition("anchor").sortWithinPartitions("anchor", "id", "x", "lo")
    near = groups.mapInArrow(_sorted_groups(length, keep_first, ["id", "x", "copies"]), group_schema)
    crowd_rows = cuts.where("data IS NULL").select("h1", "h2", "id", "x", "lo", "copies")
    counted = staged(crowd_rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(me_first).alias("first")).where("c > 1"), "counted")
    far = joined(crowd_rows, counted, ["h1", "h2"])
    if keep_first:
        far = far.where(me_first > F.col("first"))
    near = near.unionByName(far.select("id", "x", "copies", "lo", (F.col("lo") + 1).alias("hi")))
    return whole.unionByName(near.select("id", "x", "lo", "hi"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True, **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, kept_text) of every row: the bytes that no removed string covers.

    ``kept`` may end or begin within a character, as strings are of bytes; ``kept_text`` leaves such parts of characters out.
    """
    kind = docs.schema[id_col].dataType
    found = ranges(docs, id_col, text_col, length, keep_first, **options)
    found = staged(found.groupBy("id", "x").agg(F.collect_list(F.struct("lo", "hi")).alias("r")), "ranges")  # of one text
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), text.alias("t")).alias("d")
    rows = rows.join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.x") == F.col("f.x")), "left").select("d.id", "d.t", "f.r")
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "t"):
            out = []
            for k, t in enumerate(texts):
                data = t.encode("utf-8")
                r = part.column("r")[k]
                if not r.is_valid or not len(r):
                    out.append((len(data), 0, 0, data, t))
                    continue
                lo = np.array(r.values.field("lo"), np.int64)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, np.array(r.values.field("hi"), np.int64) + length - 1, -1)
                gone = np.cumsum(edge)[:len(data)] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), len(_runs(gone)[0]), kept, kept.decode("utf-8", "ignore")))
            cols = [pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *cols], names=schema.names)
    return rows.mapInArrow(run, schema)
