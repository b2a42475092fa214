"""Directly addressable codes for token ids.

An id is cut into chunks of ``bits`` bits, low chunk first. Level 0 holds the first chunk
of every id; level k+1 holds the next chunk of those ids of level k whose continuation bit
is set. A rank directory (ones before every block of the bitmap) leads from an id to its
place on the next level, so any token is read by a few lookups, without decoding a block.

Files: Parquet rows, each one self-contained segment (``blob``) of whole documents, or of
a piece of one too long for a segment, in ascending id order. Segments are bounded, so
neither writer nor reader ever holds a partition's ids.

Defined cases: null text is empty (its document holds the end id alone); null ids come
first; documents with one id are ordered by a hash of their text; repeated rows are documents of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wattloom.llm import bpe
from wattloom.llm.common import pieces

MAGIC = b"DAC1"
BLOCK = 512  # bits of a bitmap for one entry of the rank directory
SEGMENT = 1 << 18  # ids of a segment at most
CACHE = 400_000  # chunks and words that a worker keeps, twice over
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """Ids (non-negative, below 2^63) as one block of directly addressable codes."""
    out, rest, levels = [], ids.astype(np.uint64), 0
    kind = np.uint8 if bits <= 8 else np.uint16
    while levels == 0 or len(rest):
        chunk = (rest & np.uint64((1 << bits) - 1)).astype(kind)
        more = rest >> np.uint64(bits)
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * (BLOCK // 8), np.uint8)
        padded[:len(bitmap)] = bitmap
        per_block = ONES[padded].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        rank = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        out += [struct.pack("<Q", len(rest)), chunk.astype(chunk.dtype.newbyteorder("<")).tobytes(), padded.tobytes(), rank.tobytes()]
        rest, levels = more[goes_on], levels + 1
    return b"".join([MAGIC, struct.pack("<BB", bits, levels), *out])


class Dac:
    """Reader over one block; nothing is decoded until asked for."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.bits, n_levels = struct.unpack_from("<BB", blob, 4)
        kind, at, self.levels = np.dtype("<u1" if self.bits <= 8 else "<u2"), 6, []
        for _ in range(n_levels):
            n, = struct.unpack_from("<Q", blob, at)
            blocks = -(-n // BLOCK)
            chunk = np.frombuffer(blob, kind, n, at + 8)
            at += 8 + n * kind.itemsize
            bitmap = np.frombuffer(blob, np.uint8, blocks * (BLOCK // 8), at)
            at += len(bitmap)
            rank = np.frombuffer(blob, "<u4", blocks + 1, at)
            at += 4 * len(rank)
            self.levels.append((chunk, bitmap, rank))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, by continuation bits and rank directories alone."""
        at, out = np.asarray(positions, np.int64).copy(), np.zeros(len(positions), np.uint64)
        live = np.arange(len(at))
        for k, (chunk, bitmap, rank) in enumerate(self.levels):
            if not len(live):
                break
            p = at[live]
            out[live] |= chunk[p].astype(np.uint64) << np.uint64(k * self.bits)
            on = (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            live, p = live[on], p[on]
            block, inside = p // BLOCK, p % BLOCK
            words = bitmap.reshape(-1, BLOCK // 8)[block]
            whole = np.arange(BLOCK // 8) < (inside >> 3)[:, None]
            before = np.where(whole, ONES[words], 0).sum(1, dtype=np.int64) if len(p) else np.zeros(0, np.int64)
            last = words[np.arange(len(p)), inside >> 3] & ((1 << (inside & 7)) - 1).astype(np.uint8)
            at[live] = rank[block] + before + ONES[last]
        return out

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        out = self.levels[0][0].astype(np.uint64)
        where = np.arange(len(out))
        for k in range(1, len(self.levels)):
            bitmap = self.levels[k - 1][1]
            on = np.unpackbits(bitmap, bitorder="little")[:len(where)].astype(bool)
            where = where[on]
            out[where] |= self.levels[k][0].astype(np.uint64) << np.uint64(k * self.bits)
        return out


_LIBRARY: dict[str, bpe.ChunkCache] = {}
PLAIN = bpe.regex.compile(r"[!-~À-įı-ſ]+")
STOPS = frozenset(",.;:!?")


def library_cache(path: str) -> bpe.ChunkCache:
    """Chunks encoded by the tokenizers library; a word that many chunks share is encoded once.

    Words of plain Latin text are split here and given to the library's model as they are
    after its normalizer and pre-tokenizer; all else goes through the whole library.
    """
    if path not in _LIBRARY:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        model, letters = Tokenizer(tok.model), bpe.byte_letters()
        words: dict[str, bytes] = {}
        old: dict[str, bytes] = {}

        def spelt(word: str) -> str:
            return "".join([letters[b] for b in word.encode("utf-8")])

        def learn(parts: set[str], by: Tokenizer, how) -> None:
            new = [p for p in parts if p not in words]
            words.update((p, old[p]) for p in new if p in old)
            new = [p for p in new if p not in words]
            if new:
                done = by.encode([how(p) for p in new], is_pretokenized=True, add_special_tokens=False)
                ids = np.array(done.ids, "<u4").tobytes()
                ends = (4 * np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(new) + 1))).tolist()
                words.update((p, ids[i:j]) for p, i, j in zip(new, ends, ends[1:], strict=False))

        def split(chunk: str) -> tuple[str, ...] | list[str]:
            if not (chunk.isascii() or PLAIN.fullmatch(chunk)) or "<|" in chunk:
                return ()
            if chunk.isalpha():
                return (chunk.lower(),)
            if chunk[-1] in STOPS and chunk[:-1].isalpha():
                return chunk[:-1].lower(), chunk[-1]
            return bpe.WORDS.findall(chunk.lower())

        def encode(chunks: list[str]) -> list[bytes]:
            if len(words) > CACHE:  # two generations, as for chunks
                old.clear()
                old.update(words)
                words.clear()
            parts = [split(c) for c in chunks]
            learn({w for s in parts for w in s}, model, spelt)
            learn({c for c, s in zip(chunks, parts, strict=True) if not s}, tok, lambda c: c)
            return [b"".join([words[w] for w in s]) if s else words[c] for c, s in zip(chunks, parts, strict=True)]
        _LIBRARY[path] = bpe.ChunkCache(encode, CACHE)
    return _LIBRARY[path]


def segments(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", bits: int = 8, size: int = SEGMENT) -> DataFrame:
    """Segments in ascending id order: tokens of each document, then ``end_id``.

    part, segment: order of the segments. ids, ordinals, lengths: the documents (or pieces)
    within one segment; ``first`` and ``last`` tell whether the segment begins and ends a document;
    ``inside``: ids before it in its part.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("segment", T.LongType()), T.StructField("n", T.LongType()), T.StructField("inside", T.LongType()),
                           T.StructField("ids", T.ArrayType(kind)), T.StructField("ordinals", T.ArrayType(T.LongType())),
                           T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("first", T.BooleanType()),
                           T.StructField("last", T.BooleanType()), T.StructField("blob", T.BinaryType())])
    kinds = [f.dataType for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        arrow = [to_arrow_type(k) for k in kinds]
        end, cache = np.array([end_id], "<u4").tobytes(), library_cache(path)
        held: list[tuple] = []  # (id, ordinal, bytes)
        number = ordinal = room = inside = 0
        begins = True

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal number, room, begins, held, inside
            ids = np.frombuffer(b"".join(h[2] for h in held), "<u4")
            row = [part, number, len(ids), inside, [h[0] for h in held], [h[1] for h in held], [len(h[2]) // 4 for h in held], begins, last, pack(ids, bits)]
            number, room, begins, held, inside = number + 1, 0, last, [], inside + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, arrow, strict=True)], names=schema.names)

        part = 0
        for batch, texts in pieces(batches, "t"):
            part = batch.column("p")[0].as_py()
            split = [bpe.chunks_of(bpe.folded(t)) for t in texts]
            known = cache.fill(split).__getitem__
            for doc, words in zip(batch.column("i").to_pylist(), split, strict=True):
                ids = b"".join([*map(known, words), end])
                if held and room + len(ids) // 4 > size:
                    yield flush(True)
                while ids:
                    take = min(len(ids) // 4, size - room)
                    held.append((doc, ordinal, ids[:4 * take]))
                    ids, room = ids[4 * take:], room + take
                    if room == size:
                        yield flush(not ids)
                ordinal += 1
        if held:
            yield flush(True)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h").drop("h")  # bounds are sampled to the driver, so no texts among them
    return ordered.withColumn("p", F.spark_partition_id()).mapInArrow(run, schema)


def write(docs: DataFrame, folder: str, path: str, **options) -> None:
    """Writes the ids of all documents as segment files under ``folder``."""
    segments(docs, path, **options).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of a folder with ``start``: the number of ids before each of them."""
    rows = spark.read.parquet(folder)
    # One row per part file: bounded by the writer's number of tasks, not by the rows.
    parts = rows.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").select(*rows.columns, (F.col("before") + F.col("inside")).alias("start"))


def combine_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the second one's length."""
    def times(matrix: list[int], vector: int) -> int:
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector, k = vector >> 1, k + 1
        return out
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, row) for row in step]  # to a zero byte
    while length:
        if length & 1:
            first = times(step, first)
        step, length = [times(step, row) for row in step], length >> 1
    return first ^ second


def documents(segments: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Per document, decoded from the segments: id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids).

    Only documents that run over several segments meet in a shuffle.
    """
    kind = segments.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField(id_name, kind),
                           T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("whole", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("part", "ordinals", "lengths", "start", "first", "last")}
                data = memoryview(Dac(batch.column("blob")[k].as_py()).decode().astype("<u4").tobytes())
                lengths = np.array(row["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                starts, n = ends - lengths, len(lengths)
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                whole = np.ones(n, bool)
                if n and not row["first"].as_py():
                    whole[0] = False
                if n and not row["last"].as_py():
                    whole[-1] = False
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array(row["ordinals"].as_py(), pa.int64()), batch.column("ids")[k].values,
                     pa.array(starts + row["start"].as_py()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(whole)], names=schema.names)

    found = segments.where("first AND last").mapInArrow(run, schema)
    pieces_ = segments.where("NOT (first AND last)").mapInArrow(run, schema)
    join = F.udf(lambda rows: _joined(rows), "long")
    long = (pieces_.where(~F.col("whole")).groupBy("part", "ordinal")
            .agg(F.first(id_name).alias(id_name), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
                 F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("rows"))  # a document's segments
            .select(id_name, "start", "n_tokens", join("rows").alias("ids_crc32")))
    whole = found.unionByName(pieces_.where("whole"))
    return whole.select(id_name, "start", "n_tokens", "ids_crc32").unionByName(long)


def _joined(rows: list) -> int:
    crc = 0
    for r in rows:
        crc = combine_crc(crc, r["ids_crc32"], 4 * r["n_tokens"])
    return crc


def tokens_at(segments: DataFrame, positions: DataFrame, column: str = "position", size: int = SEGMENT) -> DataFrame:
    """Random access: (position, id) for every distinct position below the number of ids."""
    cell = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))).alias("cell")
    want = positions.select(F.col(column).cast("long").alias("position")).where("position >= 0").distinct()
    place = segments.select("part", "segment", "start", "n", cell).join(want.withColumn("cell", F.floor(F.col("position") / size)), "cell")
    place = place.where("position >= start AND position < start + n").groupBy("part", "segment").agg(F.collect_set("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p = np.array(batch.column("positions")[k].as_py(), np.int64)
                ids = Dac(batch.column("blob")[k].as_py()).get(p - batch.column("start")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(ids.astype(np.int64))], names=["position", "id"])
    return segments.join(place, ["part", "segment"]).select("blob", "start", "positions").mapInArrow(run, "position long, id long")
