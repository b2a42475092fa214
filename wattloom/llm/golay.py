"""SimHash near-duplicates with Golay-code keys.

The [23,12,7] Golay code is perfect: each 23-bit word lies within three bits of exactly one
of its 4096 codewords. The keys of a word are the codewords of the word and of its 23
one-bit neighbours (one or six different ones), so words that differ in at most two bits
share a key: a word half way between them decodes to it.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Four differing bits fall
on them in one of two ways. Either a segment is equal and another differs in two bits at
most: keys (equal segment, key of the other). Or no segment is equal, then two of them
differ in exactly one bit: the codewords of both in one fingerprint are among the keys of
the other. Rows with equal keys are compared in full, so a link is never missed nor invented.

A key shared by very many different fingerprints is not compared pair by pair: its members
are linked exactly through all words within two bits of them, since two fingerprints are
within four bits if and only if such balls meet.

Defined cases: null text is empty; text without words has fingerprint zero, linked like any
other; repeated rows and equal texts share fingerprint and component; null ids sort first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import pieces, staged
from wattloom.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # shift, bits
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
CROWD = 1000  # more different fingerprints of one key are linked through balls
BLOCK = 1 << 20
ENDS = re.compile(rb"[\x20\x09-\x0d]")


# -- fingerprints -----------------------------------------------------------
def _blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded block at a time."""
    at = 0
    while at < len(data):
        to = at + BLOCK
        if to < len(data):
            m = ENDS.search(data, to)
            to = m.start() if m else len(data)
        yield data[at:to].split()
        at = to


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    digest = partial(xxhash.xxh64_intdigest, seed=42)

    def add(hashes: list[int]) -> None:
        nonlocal total
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[:] += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    for words in _blocks(text.encode("utf-8").lower()):
        words = tail + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
            add([digest(joined[a:b]) for a, b in zip(starts, stops[shingle - 1:], strict=False)])
            tail = words[len(words) - shingle + 1:]
        else:
            tail = words
    if not total and tail:
        add([digest(b" ".join(tail))])
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long: the 64 bits as a signed number) of every row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "t"):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(fp)], names=["id", "fp"])
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


# -- keys -------------------------------------------------------------------
@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """23-bit word -> index of the codeword within three bits."""
    index = np.arange(4096, dtype=np.int64)
    rest = index << 11
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ (GENERATOR << (k - 11)), rest)
    words = index << 11 | rest
    errors = [sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)]
    table = np.empty(1 << 23, np.uint16)
    for e in errors:
        table[words ^ e] = index
    return table


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x 6 keys, how many of them count); the first is the word's own codeword."""
    table = decoder()
    own = table[words].astype(np.int64)
    near = np.sort(table[words[:, None] ^ (1 << np.arange(23))].astype(np.int64), axis=1)
    new = near != own[:, None]
    new[:, 1:] &= near[:, 1:] != near[:, :-1]
    keys, count = np.repeat(own[:, None], 6, axis=1), new.sum(1) + 1
    row, col = np.nonzero(new)
    at = np.arange(len(row)) - np.concatenate([[0], np.cumsum(new.sum(1))])[row] + 1
    keys[row, at] = near[row, col]
    return keys, count


def keyed(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key rows of fingerprints: key, role (0 for both or held, 1 for sought), fingerprint."""
    u = fps.view(np.uint64)
    words = [((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    keys = [segment_keys(w) for w in words]
    valid = [np.arange(6) < c[:, None] for _, c in keys]
    out, tag = [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, col = np.nonzero(valid[j])
                out.append((tag << 40 | words[i][row] << 12 | keys[j][0][row, col], np.zeros(len(row), np.int8), fps[row]))
                tag += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        out.append((tag << 40 | keys[i][0][:, 0] << 12 | keys[j][0][:, 0], np.zeros(len(fps), np.int8), fps))
        row, a, b = np.nonzero(valid[i][:, :, None] & valid[j][:, None, :])
        out.append((tag << 40 | keys[i][0][row, a] << 12 | keys[j][0][row, b], np.ones(len(row), np.int8), fps[row]))
        tag += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in keyed(fps[at:at + 2000])], names=["key", "role", "fp"])


# -- links ------------------------------------------------------------------
def _pairs(key: np.ndarray, role: np.ndarray, fp: np.ndarray, distance: int, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links within the complete key groups of sorted rows; members of crowded groups as (fp, fp)."""
    start = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(start)
    size = np.diff(np.concatenate([first, [len(key)]]))
    group = np.cumsum(start) - 1
    rank = np.arange(len(key)) - first[group]
    held = np.add.reduceat((role == 0).astype(np.int64), first)
    sought = key >> 40 >= 6
    partners = np.where(sought, np.where(role == 1, held[group], 0), rank)
    crowded = size[group] > crowd
    if crowded.any():
        members = np.unique(fp[crowded])
        yield members, members
        partners[crowded] = 0
    rows = np.flatnonzero(partners)
    while len(rows):
        n = int(np.searchsorted(np.cumsum(partners[rows]), 2_000_000)) + 1
        part, rows = rows[:n], rows[n:]
        many = partners[part]
        a = np.repeat(part, many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + first[group[a]]
        near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= distance
        x, y = fp[a[near]], fp[b[near]]
        differ = x != y
        yield np.minimum(x, y)[differ], np.maximum(x, y)[differ]


def _stream(batches: Iterator[pa.RecordBatch], distance: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by key, role and fingerprint; holds one batch and one group of at most ``crowd`` rows."""
    names, kinds = ("key", "role", "fp"), (np.int64, np.int8, np.int64)
    empty = tuple(np.zeros(0, k) for k in kinds)
    carry, full = empty, None  # full: a crowded key whose rows are passed on as they come

    def told(found: Iterator) -> Iterator[pa.RecordBatch]:
        for a, b in found:
            if len(a):
                links = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])
    for batch in batches:
        rows = tuple(np.concatenate([c, batch.column(n).to_numpy(zero_copy_only=False)]) for c, n in zip(carry, names, strict=True))
        carry = empty
        if not len(rows[0]):
            continue
        if full is not None:
            more = rows[0] == full
            if more.any():
                yield from told([(rows[2][more], rows[2][more])])
                rows = tuple(r[~more] for r in rows)
            if not len(rows[0]):
                continue
            full = None
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if len(rows[0]) - last > crowd:
            full, last = rows[0][-1], len(rows[0])
        carry = tuple(r[last:] for r in rows)
        if last:
            yield from told(_pairs(*(r[:last] for r in rows), distance, crowd))
    if len(carry[0]):
        yield from told(_pairs(*carry, distance, crowd))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 200):
            some = fps[at:at + 200]
            yield pa.RecordBatch.from_arrays([pa.array((some.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(some, len(masks)))], names=["z", "fp"])


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that connect exactly those of the different fingerprints ``fp`` that chains of
    at most ``distance`` (4 or less) differing bits connect. Within a crowd some links are stars through a common member."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the keys cover up to four differing bits")
    rows = fps.select("fp").mapInArrow(_key_rows, "key long, role tinyint, fp long").repartition("key").sortWithinPartitions("key", "role", "fp")
    found = staged(rows.mapInArrow(lambda batches: _stream(batches, distance, crowd), "a long, b long"), "links")
    if distance < DISTANCE:  # balls are made for the full distance
        if not found.where("a = b").isEmpty():
            raise ValueError("crowded keys need the full distance")
        return found
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    balls = crowded.mapInArrow(_balls, "z long, fp long")  # different fingerprints: at most 2081 meet at a word
    stars = balls.withColumn("m", F.min("fp").over(Window.partitionBy("z"))).where("m <> fp").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()
    return found.where("a <> b").unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(id, fp, component): per row its fingerprint and the smallest id that links reach."""
    marked = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    firsts = staged(marked.groupBy("fp").agg(F.min(F.struct("id")).alias("first")), "firsts")
    roots = components(links(firsts, distance, crowd))
    linked = firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    grouped = linked.join(smallest, "root").select("fp", "smallest")
    known = staged(firsts.join(grouped, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("c")), "components")
    return marked.join(known, "fp").select("id", "fp", F.col("c.id").alias("component"))
