"""Near-duplicates by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints that may differ in four bits cannot see such pairs (0.8 is about ten of 64 bits),
so candidates come from MinHash bands: 200 minima of a set, 40 keys of five minima each. A
pair at similarity s shares no key with probability (1 - s^5)^40, which is 1.3e-7 at 0.8 and
less above. Every link is verified on the whole sets, so none is invented.

SimHash comes first: fingerprints of ``golay`` within four bits, by its keys, each verified like any
link. It joins most copies; the bands are for those that differ in more bits.

Only different sets are compared. Within a key all members are first compared with the
smallest, so a large group of copies of one text costs one comparison each, not one a pair.
Where a key still holds members of different components, its sets go through an exact prefix
filter: with all shingles in one order, rarest among these sets first, two sets of n <= m
shingles and a similarity of 0.8 or more share one of the first n - ceil(8 n / 9) + 1 of the
smaller and the first m - ceil(4 m / 5) + 1 of the larger, and what follows it in both must
be long enough. Texts that share a base but differ in more than that meet at no shingle, as
their own ones are rarer than the base's. Those that do meet are first compared with the one of
fewest rarer shingles; of the others, pairs in one component are not compared. The order is exact for any counts, so these are kept in a table of fixed size.

Defined cases: words are split at ASCII white space and ASCII letters are case folded, as in
``golay``; a text of fewer than five words has one shingle of all of them; texts without
words are alike; null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm import golay
from wattloom.llm.common import pieces, staged
from wattloom.llm.components import components
from wattloom.llm.golay import _blocks

SHINGLE = 5
BANDS, MINIMA = 40, 5
SLOTS = 1 << 20  # counts of shingles that set their order
_random = np.random.default_rng(20240105)
MASK = _random.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32)
ODD = _random.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32) | np.uint32(1)
MIX = _random.integers(0, 1 << 63, (BANDS, MINIMA), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BAND = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's word shingles."""
    found, tail, digest = [np.zeros(0, np.uint64)], [], xxhash.xxh64_intdigest
    for words in _blocks(text.encode("utf-8").lower()):
        words = tail + words
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
            found.append(np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, stops[size - 1:], strict=False)], np.uint64)))
            tail = words[len(words) - size + 1:]
        else:
            tail = words
    if len(found) == 1 and tail:
        found.append(np.array([digest(b" ".join(tail))], np.uint64))
    return np.unique(np.concatenate(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(MASK), (1 << 32) - 1, np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, ((x[at:at + 512, None] ^ MASK) * ODD).min(0))
    return ((least.reshape(BANDS, MINIMA).astype(np.uint64) * MIX).sum(1, dtype=np.uint64) ^ BAND).view(np.int64)


def signatures(docs: DataFrame, key_col: str, id_col: str, text_col: str) -> DataFrame:
    """(key, id, set: digest of the shingle set, n: its size, fp: SimHash fingerprint, bands: its keys) of every row."""
    schema = T.StructType([T.StructField("key", docs.schema[key_col].dataType), T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("set", T.LongType()), T.StructField("n", T.IntegerType()),
                           T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "t"):
            sets, n, bands = [], [], []
            for t in texts:
                s = shingles(t)
                sets.append(xxhash.xxh64_intdigest(s.tobytes()))
                n.append(len(s))
                bands.append(band_keys(s))
            offsets = pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32())
            fps = np.array([golay.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            columns = [part.column("k"), part.column("i"), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fps),
                       pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bands)))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return docs.select(F.col(key_col).alias("k"), F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def simhash_pairs(kinds: DataFrame) -> DataFrame:
    """(a, b): sets of (set, n, fp) whose fingerprints are equal or within four bits, and whose sizes fit.

    Every set meets the smallest of its fingerprint, and that the smallest of the fingerprint's smallest neighbour: as many
    pairs as sets. What other pairs would add is left to the bands.
    """
    heads = staged(kinds.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("h"), F.count(F.lit(1)).alias("sets")).select("fp", "h.*", "sets"), "fingerprints")
    head = heads.select("fp", F.col("set").alias("a"), F.col("n").alias("m"), "sets")
    same = kinds.select("fp", F.col("set").alias("b"), "n").join(head.where("sets > 1"), "fp").where("a <> b")
    near = staged(golay.links(heads.select("fp")).groupBy(F.greatest("a", "b").alias("v")).agg(F.min(F.least("a", "b")).alias("fp")), "near_fingerprints")
    near = near.join(heads.select(F.col("fp").alias("v"), F.col("set").alias("b"), "n"), "v").join(head, "fp")
    return same.select("a", "b", "n", "m").unionByName(near.select("a", "b", "n", "m")).where("5 * least(n, m) >= 4 * greatest(n, m)").select("a", "b")


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches, "t"):
        found = [shingles(t) for t in texts]
        offsets = pa.array(np.cumsum([0, *(len(s) for s in found)]), pa.int32())
        hashes = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column("set"), hashes], names=["set", "hashes"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more (in whole numbers: 9 x common >= 4 x both sizes)."""
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): how many shingles of a part's sets fall into each slot of the table of counts."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        hashes = batch.column("hashes")
        values = hashes.values.slice(hashes.offsets[0].as_py(), hashes.offsets[-1].as_py() - hashes.offsets[0].as_py()) if len(hashes) else hashes.values
        total += np.bincount(values.to_numpy() & (SLOTS - 1), minlength=SLOTS)
    there = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["slot", "n"])


def prefixes(sets: DataFrame) -> DataFrame:
    """(h, set, n, at, lesser) for the sets (set, root, hashes): the first n - ceil(4 n / 5) + 1 shingles of each, rarest first.

    at: place from 0; lesser: within the first n - ceil(8 n / 9) + 1, as the smaller set of a pair needs.
    """
    counts = np.zeros(SLOTS, np.int64)
    found = sets.select("hashes").mapInArrow(_slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, root, hashes in zip(batch.column("set").to_pylist(), batch.column("root").to_pylist(), batch.column("hashes"), strict=True):
                h = hashes.values.to_numpy()
                n, most, least = len(h), len(h) + (-4 * len(h) // 5) + 1, len(h) + (-8 * len(h) // 9) + 1
                first = h[np.lexsort((h, shared.value[h & (SLOTS - 1)]))[:most]]
                size = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(size, key)), pa.array(np.full(size, root)), pa.array(np.full(size, n, np.int32)),
                                                  pa.array(np.arange(size, dtype=np.int32)), pa.array(np.arange(size) < least)], names=["h", "set", "root", "n", "at", "lesser"])
    return sets.select("set", "root", "hashes").mapInArrow(run, "h long, set long, root long, n int, at int, lesser boolean")


def central_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): the sets of each shingle of ``prefixes`` with the one that has the fewest rarer shingles, where roots differ and lengths and places fit.

    That one is nearest to what the shingle's sets have in common, so few of those that can be linked at all are not linked to it.
    """
    middle = staged(rows.groupBy("h").agg(F.min(F.struct("at", "set", "n", "root")).alias("c")).select("h", F.col("c.at").alias("j"), F.col("c.set").alias("b"), F.col("c.n").alias("m"), F.col("c.root").alias("q")), "central")
    enough = F.ceil(4 * (F.col("n") + F.col("m")) / 9)
    fits = (F.col("root") != F.col("q")) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")) & (F.col("at") + enough <= F.col("n")) & (F.col("j") + enough <= F.col("m"))
    return rows.join(middle, "h").where(fits).select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b")).distinct()


def unlinked_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of sets of ``prefixes`` with different roots that may be similar; none that is similar is left out."""
    # Sets of a shingle's most frequent root meet only those of other roots.
    shares = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("top"))
    rows = staged(rows.join(staged(shares.where("roots > 1").select("h", F.col("top.root").alias("major")), "shared_shingles"), "h"), "meeting")
    least, most = rows.where("lesser").toDF("h", "a", "p", "n", "i", "lesser", "major"), rows.toDF("h", "b", "q", "m", "j", "lesser2", "major2")
    enough = F.ceil(4 * (F.col("n") + F.col("m")) / 9)
    fits = (F.struct("n", "a") < F.struct("m", "b")) & (F.col("p") != F.col("q")) & (5 * F.col("n") >= 4 * F.col("m")) & (F.col("i") + enough <= F.col("n")) & (F.col("j") + enough <= F.col("m"))
    met = least.where("p <> major").join(most, "h").where(fits).select("a", "b").unionByName(
        least.where("p = major").join(most.where("q <> major2"), "h").where(fits).select("a", "b"))
    return met.distinct()


def first_of_each(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key): of every group that chains of near-duplicates connect, the row with the smallest (id, key).

    ``key_col`` identifies a row's id and text.
    """
    marked = staged(signatures(docs, key_col, id_col, text_col), "signatures")
    kinds = staged(marked.groupBy("set").agg(F.min(F.struct("id", "key", "fp")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    close = staged(simhash_pairs(kinds.select("set", "n", F.col("first.fp").alias("fp"))), "simhash_pairs")
    rows = kinds.select("set", "n", F.explode("bands").alias("band"))
    # Written tables, so that the joins below can split the rows of a hot band.
    least = staged(rows.groupBy("band").agg(F.min(F.struct("set", "n")).alias("m"), F.max("set").alias("x")).where("m.set <> x").select("band", F.col("m.set").alias("m"), F.col("m.n").alias("size")), "least")
    members = staged(rows.join(least, "band"), "members")
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("t")).dropDuplicates(["key"])
    met = members.select("set").unionByName(close.select(F.explode(F.array("a", "b")).alias("set")))
    wanted = met.distinct().join(kinds.select("set", F.col("first.key").alias("key")), "set")
    sets = staged(texts.join(wanted, "key").select("set", "t").mapInArrow(_whole_sets, "set long, hashes array<long>"), "whole_sets")

    stars = members.where("set <> m AND 5 * least(n, size) >= 4 * greatest(n, size)").select(F.col("m").alias("a"), F.col("set").alias("b"))
    linked = staged(similar(stars.unionByName(close).distinct(), sets), "links")
    roots = staged(components(linked), "roots")
    placed = members.where("set <> m").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    placed = staged(placed.select("band", "set", "root"), "placed")  # all pairs with the smallest are decided
    mixed = placed.groupBy("band").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("band")
    left = staged(placed.join(staged(mixed, "mixed_bands"), "band", "left_semi").select("set", "root").distinct(), "undecided")
    rows = staged(prefixes(staged(sets.join(left, "set"), "undecided_sets")), "prefixes")
    central = staged(similar(staged(central_pairs(rows), "central_pairs"), sets), "central_links")
    if not central.isEmpty():
        linked = linked.unionByName(central)
        roots = staged(components(linked), "roots")
        rows = staged(rows.drop("root").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set")), "placed_prefixes")
    others = staged(unlinked_pairs(rows.select("h", "set", "root", "n", "at", "lesser")), "other_pairs")
    found = staged(similar(others, sets), "other_links")
    if not found.isEmpty():
        roots = staged(components(linked.unionByName(found)), "roots")
    known = kinds.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select(F.coalesce("root", "set").alias("root"), "first")
    return known.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
