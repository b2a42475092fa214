"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

Two vectors link if they have the same label and a cosine of ``least`` or more. A unit vector
x is rotated at random and coded by the signs of its coordinates, b (one bit each); stored
beside the code is o = <b, x>, how much of x the code holds. For another rotated vector y,
<b, y> / o estimates <x, y> without bias, and its error is within
``SURE`` sqrt(1 - o^2) / (o sqrt(d - 1)) but for about one pair in 10^4. A pair whose estimate
plus that bound stays below ``least`` is dropped; only the others are computed exactly, and
no pair is linked without that. The other side of an estimate is stored in four bits a
coordinate, rounded at random, so that its error has mean zero too and a bound of its own.

* Equal vectors are one class with a count.
* Classes meet in tables of sign keys of further rotations. A key has so many bits that a bucket
  holds ``BUCKET`` classes of the largest label on average, and there are so many tables
  that a pair at the least cosine meets with probability ``RECALL``; closer ones surely nearly.
* A bucket's first class is compared with the others by exact cosine, and those within half
  the angle join its *ball*. Two members of a ball link by the triangle inequality. So a
  group of very many near copies is counted by its size, without a pair of them being looked at.
* The rest, members of different balls in one bucket, is estimated block against block in
  numpy; rows of a bucket's largest ball meet only the others. Rows leave a task only for
  pairs that need the exact cosine.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, or
whose label is null, links with nothing and is a component of its own; vectors of different
length never link; rows repeated with one id are vectors each, which link with each other;
ties are links (>=); a null id never names a component unless all its members' ids are null;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import staged
from wattloom.llm.components import components

LEAST = 0.93
SURE = 4.0  # standard deviations of an estimate's bound
RECALL = 0.995
BUCKET = 64
BLOCK = 2048
SEED = 20260512


@lru_cache(maxsize=64)
def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, k]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _groups(values: list[bytes], kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) of the vectors of each length."""
    size = np.array([len(v) for v in values])
    for n in np.unique(size):
        at = np.nonzero(size == n)[0]
        yield at, np.frombuffer(b"".join(values[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square under- or overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, np.dtype]:
    """(id, label, digest, v) of every row: digest of label and vector, null for a vector that cannot link; v: its bytes."""
    element = rows.schema[vector_col].dataType.elementType
    kind = np.dtype("<f4") if isinstance(element, T.FloatType) else np.dtype("<f8")
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("digest", T.BinaryType()), T.StructField("v", T.BinaryType()),
                           T.StructField("g", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, data, group = [], [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = None
                if label is not None and v and None not in v:
                    x = np.array(v, kind) + kind.type(0)  # no negative zeros
                    x = x if np.isfinite(x).all() and x.any() else None
                key = None if x is None else f"{len(x)}:{label}".encode()
                digests.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16, key=hashlib.blake2b(key, digest_size=16).digest()).digest())
                data.append(None if x is None else x.tobytes())
                group.append(None if x is None else int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(digests, pa.binary()), pa.array(data, pa.binary()), pa.array(group, pa.int64())], names=schema.names)
    picked = rows.select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(T.ArrayType(T.FloatType() if kind.itemsize == 4 else T.DoubleType())).alias("v"))
    return picked.mapInArrow(run, schema), kind


def tables(largest: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of tables) for a label of ``largest`` classes."""
    same = 1 - math.acos(least) / math.pi
    bits = min(40, max(2, round(math.log2(max(1, largest) / BUCKET))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same ** bits))


CODES = "c long, g long, s long, code binary, o float, q binary, low float, step float, keys array<long>"


def codes(classes: DataFrame, kind: np.dtype, bits: int, count: int) -> DataFrame:
    """Codes of classes: s: 64 signs for ball tests; code, o: signs of a rotation and the correction factor; q, low, step: its coordinates in four bits; keys: one a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, c = batch.column("v").to_pylist(), batch.column("c").to_numpy()
            for at, raw in _groups(values, kind) if values else ():
                x, d = _unit(raw), raw.shape[1]
                r = x @ rotation(d, 0)
                o = np.abs(r).sum(1) / math.sqrt(d)
                low, high = r.min(1), r.max(1)
                step = np.maximum((high - low) / 15, 1e-12)
                spread = np.random.default_rng([SEED, d]).random(d)  # unbiased over the rotation; the same for equal vectors
                q = np.clip(np.floor((r - low[:, None]) / step[:, None] + spread), 0, 15).astype(np.uint8)
                q = np.pad(q, ((0, 0), (0, d % 2)))
                packed, code = q[:, ::2] << 4 | q[:, 1::2], np.packbits(r > 0, axis=1)
                signs = np.concatenate([x @ rotation(d, k) > 0 for k in range(1, 1 + math.ceil((64 + bits * count) / d))], axis=1)
                s = np.packbits(signs[:, :64], axis=1).view(">i8").astype(np.int64)[:, 0]
                keys = signs[:, 64:64 + bits * count].reshape(len(at), count, bits) @ (1 << np.arange(bits, dtype=np.int64))
                offsets = pa.array(np.arange(len(at) + 1) * count, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(c[at]), batch.column("g").take(pa.array(at)), pa.array(s), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(o.astype(np.float32)),
                    pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(low.astype(np.float32)), pa.array(step.astype(np.float32)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], names=["c", "g", "s", "code", "o", "q", "low", "step", "keys"])
    return classes.select("c", "g", "v").mapInArrow(run, CODES)


def exact(pairs: DataFrame, classes: DataFrame, kind: np.dtype, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose cosine in double precision is ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = np.zeros(len(xs), bool)
            for at, x in _groups(xs, kind) if xs else ():
                y = np.frombuffer(b"".join(ys[i] for i in at), kind).reshape(x.shape).astype(np.float64)
                good[at] = (_unit(x) * _unit(y)).sum(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))
    known = classes.select("c", "v")
    both = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    return both.mapInArrow(run, "a long, b long")


def estimate(code: np.ndarray, o: np.ndarray, q: np.ndarray, low: np.ndarray, step: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """(unbiased estimates of the inner products, their bounds) of coded vectors (rows) with quantised ones (columns).

    ``code``: signs as -1 and 1; ``q``: four-bit coordinates.
    """
    d = code.shape[1]
    product = code @ q.T * step + code.sum(1, keepdims=True) * low
    error = np.sqrt(np.maximum(0, 1 - o * o)) / (o * math.sqrt(max(1, d - 1)))
    return product / (math.sqrt(d) * o[:, None]), sure * (error[:, None] + step / (2 * o[:, None]))


def _tiles(least: float):
    """Pairs within tiles that need the exact cosine. Rows come sorted by tile; side 0 meets side 1, side 2 meets itself."""
    names = ["c", "ball", "side", "code", "o", "q", "low", "step"]

    def pairs(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        side, c, ball = np.array(rows["side"]), np.array(rows["c"]), np.array(rows["ball"])
        size = np.array([len(x) for x in rows["q"]])
        for n in np.unique(size):  # one length, but for colliding hashes
            one = size == n
            left, right = np.nonzero(one & (side != 1))[0], np.nonzero(one & (side != 0))[0]
            if not len(left) or not len(right):
                continue
            packed = np.frombuffer(b"".join(rows["q"][i] for i in right), np.uint8).reshape(len(right), -1)
            q = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(right), -1).astype(np.float32)
            signs = np.unpackbits(np.frombuffer(b"".join(rows["code"][i] for i in left), np.uint8).reshape(len(left), -1), axis=1)
            d = min(q.shape[1], signs.shape[1])
            real = lambda name, at: np.array(rows[name], np.float32)[at]
            low, step = real("low", right), real("step", right)
            for lo in range(0, len(left), 512):
                part = left[lo:lo + 512]
                guess, bound = estimate(signs[lo:lo + 512, :d].astype(np.float32) * 2 - 1, real("o", part), q[:, :d], low, step)
                keep = (guess + bound >= least) & (ball[part][:, None] != ball[right]) & ((side[part] != 2)[:, None] | (c[part][:, None] < c[right]))
                i, j = np.nonzero(keep)
                a, b = c[part[i]], c[right[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = {n: [] for n in names}, None
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            columns = {n: batch.column(n).to_pylist() for n in names}
            cuts = [0, *(np.nonzero(np.diff(tile))[0] + 1).tolist(), len(tile)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if tile[lo] != last and held["c"]:
                        yield from pairs(held)
                        held = {n: [] for n in names}
                    last = tile[lo]
                    for n in names:
                        held[n] += columns[n][lo:hi]
        if held["c"]:
            yield from pairs(held)
    return run


def near_duplicates(rows: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component) of every row: number of other vectors linked, smallest id that links reach."""
    marked, kind = vectors(rows, id_col, vector_col, label_col)
    marked = staged(marked, "vectors")
    valid = marked.where("digest IS NOT NULL")
    classes = valid.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.first("g").alias("g"), F.first("v").alias("v"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("g").count().agg(F.max("count")).first()[0] or 1
    bits, count = tables(largest, least)
    coded = staged(codes(classes, kind, bits, count), "codes")
    member = staged(coded.select("c", "s", "g", F.posexplode("keys").alias("t", "key")).select("c", "s", F.xxhash64("g", "t", "key").alias("bucket")), "members")

    # Balls: classes within half the angle of the first class of one of their buckets.
    angle = math.acos(least) / 2
    slack = 64 * angle / math.pi + 5 * math.sqrt(64 * angle / math.pi * (1 - angle / math.pi))
    heads = member.groupBy("bucket").agg(F.min(F.struct("c", "s")).alias("m"), F.max("c").alias("x")).where("m.c <> x").select("bucket", F.col("m.c").alias("b"), F.col("m.s").alias("bs"))
    stars = member.join(staged(heads, "heads"), "bucket").where((F.col("c") > F.col("b")) & (F.bit_count(F.col("s").bitwiseXOR(F.col("bs"))) <= slack))
    stars = exact(staged(stars.select(F.col("c").alias("a"), "b").distinct(), "star_pairs"), classes, kind, math.cos(angle) + 1e-9)
    balls = staged(stars.groupBy("a").agg(F.min("b").alias("ball")).select(F.col("a").alias("c"), "ball"), "balls")
    placed = staged(classes.select("c", "n", "first", "digest").join(balls, "c", "left").withColumn("ball", F.coalesce("ball", "c")), "placed")

    # Buckets with several balls, cut into blocks; the largest ball's rows meet only the others.
    where = staged(member.select("bucket", "c").join(placed.select("c", "ball"), "c"), "placed_members")
    shares = where.groupBy("bucket", "ball").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.sum("k").alias("k"), F.max(F.struct("k", "ball")).alias("top")).where("k > top.k")
    shares = staged(shares.select("bucket", F.col("top.ball").alias("major"), F.ceil((F.col("k") - F.col("top.k")) / BLOCK).cast("int").alias("minors"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("majors")), "mixed_buckets")
    # A largest ball of one row is treated like the others, so that most buckets are one tile.
    rest = where.join(shares, "bucket").withColumn("is_major", F.col("ball") == F.col("major"))
    own = F.pmod(F.xxhash64("c"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    tile = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    others = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda x: tile(F.least(x, "own"), F.greatest(x, "own"), F.when(x == F.col("own"), 2).when(F.col("own") < x, 0).otherwise(1)))
    facing = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda x: tile(F.col("own"), -1 - x, F.lit(0)))
    faced = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda x: tile(x, -1 - F.col("own"), F.lit(1)))
    rest = rest.withColumn("own", own).select("bucket", "c", "ball", F.explode(F.when(F.col("is_major"), faced).otherwise(F.concat(others, facing))).alias("x"))
    rest = rest.select(F.xxhash64("bucket", "x.i", "x.j").alias("tile"), "c", "ball", "x.side").join(coded.select("c", "code", "o", "q", "low", "step"), "c")
    found = rest.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(least), "a long, b long").distinct()
    links = staged(exact(staged(found, "candidates"), classes, kind, least), "links")

    mass = placed.groupBy("ball").agg(F.sum("n").alias("mass"), F.min("c").alias("least"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outer = ends.join(placed.select(F.col("c").alias("b"), "n"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("outer"))
    counted = staged(placed.join(mass, "ball").join(outer, "c", "left").select("c", "digest", "first", "least", (F.col("mass") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links")), "counted")
    roots = components(links.unionByName(counted.where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b"))))
    rooted = staged(counted.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("digest", "n_links", "component")
    out = valid.select("id", "digest").join(named, "digest").select("id", "n_links", "component")
    return out.unionByName(marked.where("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
