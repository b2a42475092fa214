"""WARC records as a chunked table.

An archive is a table of (archive, record, chunk, last, data): the ``data`` of a record's
chunks, in order, are the bytes of one WARC/1.1 record, and all records of an archive in
order are a WARC file. A payload over ``chunk_bytes`` streams as several rows
(the first also holds the header); SHA-1 is
carried from piece to piece, so neither writer nor reader builds a whole record.

Of records with equal payloads (length and SHA-1) of at least ``least`` bytes, that with
the smallest id is a response, the others are revisits that name it; smaller payloads are
always responses.

Defined cases: null payload is empty; null ids come first and sort as the smallest; rows
that agree in id and payload are one page listed several times: each gets its own record
of the same kind; equal payloads under one id in different urls likewise. Extra columns
are ignored. A null url is written as an empty target.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import pieces

CHUNK = 256 * 1024
STEP = 64 * 1024  # characters turned into bytes at once
DATE = "2024-01-01T00:00:00Z"


def stream(text: str) -> Iterator[bytes]:
    for at in range(0, len(text), STEP):
        yield text[at:at + STEP].encode("utf-8", "surrogatepass")


def measure(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest in base32, hex) of every row."""
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                           T.StructField("hex", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "t"):
            size, digest, plain = [], [], []
            for t in texts:
                n, sha = 0, hashlib.sha1()
                for data in stream(t):
                    n += len(data)
                    sha.update(data)
                size.append(n)
                digest.append(base64.b32encode(sha.digest()).decode())
                plain.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(plain, pa.string())], names=schema.names)
    return pages.select(F.col(id_col).alias("i"), F.col(payload_col).alias("t")).mapInArrow(run, schema)


def plan(measured: DataFrame, least: int = 0) -> DataFrame:
    """One row per id and payload: record_type and refers_to.

    The smallest id of each payload is found with map-side combine, so a payload that a
    third of the pages share does not gather; only revisits are kept for the join with it.
    """
    big = F.col("payload_bytes") >= least
    # Null ids sort first in a struct; the flag tells a null id from no id.
    firsts = measured.where(big).groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    m = measured.distinct().join(firsts, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return m.select("id", "payload_bytes", "payload_digest", "hex", F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("first.id")).alias("refers_to"))


def header(record_id: str, kind: str, url: str, digest: str, size: int, refers_to: str | None) -> bytes:
    length = size if kind == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {length}", "", ""]).encode("utf-8", "surrogatepass")


def records(pages: DataFrame, planned: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table of all pages."""
    schema = "archive int, record long, chunk int, last boolean, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = -1
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)],
                                             names=["archive", "record", "chunk", "last", "data"])
            rows, held = [], 0
            return out
        for part, texts in pieces(batches, "t"):
            meta = part.drop_columns(["t"]).to_pylist()
            for m, text in zip(meta, texts, strict=True):
                number += 1
                clean = (m["u"] or "").replace("\r", "%0D").replace("\n", "%0A")
                name = "null" if m["i"] is None else str(m["i"])
                refers = None if m["k"] == "response" else "null" if m["r"] is None else str(m["r"])
                buffer, chunk = bytearray(header(name, m["k"], clean, m["d"], m["n"], refers)), 0
                room = len(buffer) + chunk_bytes  # the header is never cut
                for data in stream(text) if m["k"] == "response" else ():
                    buffer += data
                    while len(buffer) > room:
                        rows.append((m["p"], number, chunk, False, bytes(buffer[:room])))
                        del buffer[:room]
                        chunk, held, room = chunk + 1, held + room, chunk_bytes
                        if held > 4_000_000:
                            yield flush()
                rows.append((m["p"], number, chunk, True, bytes(buffer + b"\r\n\r\n")))
                held += len(buffer)
                if held > 4_000_000:
                    yield flush()
        if rows:
            yield flush()
    sha = F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    p = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(payload_col).alias("t"), sha.alias("h"))
    q = planned.select(F.col("id").alias("j"), "hex", F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"),
                       F.col("record_type").alias("k"), F.col("refers_to").alias("r"))
    joined = p.join(q, p["i"].eqNullSafe(q["j"]) & (p["h"] == q["hex"]))
    return joined.select("i", "u", "t", "d", "n", "k", "r", F.spark_partition_id().alias("p")).mapInArrow(run, schema)


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields of a record and where its content begins."""
    end = data.index(b"\r\n\r\n") + 4
    lines = data[:end - 4].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    return {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}, end


FIELDS = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, archive int, record long, chunks int"


def read(table: DataFrame) -> DataFrame:
    """One row per record, from the archives' bytes: payload length and digest are computed anew for responses.

    Records of one chunk are read where they lie. The chunks of the others are brought
    together in order and streamed, one chunk in memory at a time. A record whose bytes do
    not agree with its own header fails the job.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c) for c in ("archive", "record", "chunk", "last", "data")]
            for k in range(batch.num_rows):
                archive, record, chunk, last, data = (c[k].as_py() for c in cols)
                at = 0
                if chunk == 0:
                    fields, at = parse_header(data)
                    state = {"key": (archive, record), "next": 0, "fields": fields, "sha": hashlib.sha1(), "left": int(fields["Content-Length"])}
                if state["key"] != (archive, record) or state["next"] != chunk:
                    raise ValueError(f"chunk {chunk} of record {record} is out of place")
                body = memoryview(data)[at:at + state["left"]] if state["left"] else memoryview(b"")
                state["sha"].update(body)
                state["left"] -= len(body)
                state["next"] += 1
                if last:
                    out.append(_record(state, archive, record))
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "record", "chunks"])
    single = F.col("last") & (F.col("chunk") == 0)
    long = table.where(~single).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return table.where(single).mapInArrow(run, FIELDS).unionByName(long.mapInArrow(run, FIELDS))


def _record(state: dict, archive: int, record: int) -> tuple:
    fields, left = state["fields"], state["left"]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    if left or fields["WARC-Type"] == "response" and (size != int(fields["Content-Length"]) or base64.b32encode(state["sha"].digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not agree with its header")
    bare = lambda v: None if v is None or v == "<urn:page:null>" else v.removeprefix("<urn:page:").removesuffix(">")
    return (bare(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], bare(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], archive, record, state["next"])
