"""WARC archives: a writer that marks repeated payloads as revisits, and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte ranges; a task looks in
its range for the gzip magic, takes a place for a member when its first bytes inflate to a WARC
header, owns the records that start inside its range, and follows the last one past the range's end.

Defined results: a null html is an empty payload; a null url is written as an empty target; rows
with a null page_id are records like others; repeated rows of one page_id give one record each, and where
the largest page_id of a payload repeats, each of its rows is a response; an empty table gives archives without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import scratch_path

#: Payloads under this many bytes are always written in full.
REVISIT_BYTES = 1000
SPLIT_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_HEAD = 512
_STEP = 1 << 20


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and its path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` as (page_id, url, html, payload_digest, payload_bytes, refers_to): null for responses.

    The digest is computed where the row is read; only (digest, page_id) travel to find the largest
    page_id of each large payload, and only digests of two rows or more come back.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    shared = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, F.col("payload_digest") == F.col("digest"), "left").select("page_id", "url", "html", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to, level: int = 1) -> bytes:
    """One gzip member holding a response record, or a revisit without payload."""
    revisit = refers_to is not None
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(body + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write one archive per partition below ``folder``; returns (path, bytes, records) once all are there.

    A task writes under a name of its own and renames at the end, so a repeated or lost attempt
    leaves at most an unfinished file, which readers don't list.
    """

    def run(batches):
        from pyspark import TaskContext

        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        temporary, final = f"{at}/.{part}-{uuid.uuid4().hex}", f"{at}/part-{part:06d}.warc.gz"
        n = 0
        with store.open_output_stream(temporary, buffer_size=1 << 20) as out:
            for b in batches:
                for start in range(0, b.num_rows, 256):
                    for r in b.slice(start, 256).to_pylist():
                        out.write(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["payload_digest"], r["refers_to"]))
                        n += 1
        size = store.get_file_info(temporary).size
        store.move(temporary, final)
        yield pa.RecordBatch.from_pydict({"path": [final], "bytes": [size], "records": [n]})

    store, at = open_store(folder)
    store.create_dir(at, recursive=True)  # also where there is no partition to write
    written = revisits(pages, least).mapInArrow(run, "path string, bytes long, records long")
    return written.sparkSession.createDataFrame(written.collect(), written.schema)  # a row per archive


def _head_at(data: bytes) -> bool:
    """Whether a gzip member begins here whose text is a WARC header, as far as it is there: version line, then fields."""
    try:
        head = zlib.decompressobj(31).decompress(data, 4096)
    except zlib.error:
        return False
    lines, complete = head.split(b"\r\n"), b"\r\n\r\n" in head
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return False
    fields = lines[1 : lines.index(b"", 1)] if complete else lines[1:-1]
    return all(re.match(rb"[A-Za-z0-9-]+:", x) for x in fields) and (not complete or any(x.lower().startswith(b"content-length:") for x in fields))


def members(file, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated member) of every record that starts in [start, stop).

    Inside a member that is being followed the magic cannot mislead; only the first one of a range
    has to be found, and there a place counts when what follows inflates to a WARC header.
    """
    at = start
    while at < stop:
        # to the next valid member start
        file.seek(at)
        data = file.read(min(_STEP, size - at))
        place = data.find(_MAGIC)
        while place >= 0:
            if len(data) - place < _HEAD and at + len(data) < size:
                break
            if _head_at(data[place : place + _HEAD]):
                break
            place = data.find(_MAGIC, place + 1)
        if place < 0:
            if at + len(data) >= size:
                return
            at += max(1, len(data) - 2)
            continue
        if place and len(data) - place < _HEAD and at + len(data) < size:
            at += place
            continue
        at += place
        data = data[place:]
        # then member after member, as each one's end is the next one's start
        position = at + len(data)
        while at < stop:
            if not data:
                file.seek(at)
                data = file.read(min(_STEP, size - at))
                position = at + len(data)
            if not data.startswith(_MAGIC[: len(data)]):
                break
            inflate = zlib.decompressobj(31)
            out = io.BytesIO()
            try:
                out.write(inflate.decompress(data))
                while not inflate.eof:
                    more = file.read(min(_STEP, size - position))
                    if not more:
                        break
                    position += len(more)
                    out.write(inflate.decompress(more))
                    data = more
            except zlib.error:
                at += 1
                break
            if not inflate.eof:
                return  # a truncated last member
            yield at, out.getvalue()
            data = inflate.unused_data
            at = position - len(data)
            if len(data) < len(_MAGIC):
                data = b""


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields.get("content-length", 0))]


_READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, path string, offset long"


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of all archives below ``folder``, read in byte ranges of ``split_bytes``."""
    store, at = open_store(folder)
    found = [x for x in store.get_file_info(pafs.FileSelector(at, recursive=True)) if x.path.endswith(".warc.gz")]
    # a row per archive from the driver; the ranges are made, and dealt out in turn, by Spark
    files = spark.createDataFrame([(x.path, x.size) for x in found if x.size], "path string, size long")
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "size")
    table = cut.withColumn("stop", F.least(F.col("start") + split_bytes, F.col("size")))
    ranges = sum(-(-x.size // split_bytes) for x in found)
    table = table.repartition(max(1, min(ranges, 64 * spark.sparkContext.defaultParallelism)))
    scheme = folder

    def id_of(urn: str | None):
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches):
        store, _ = open_store(scheme)
        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                with store.open_input_file(r["path"]) as file:
                    for offset, member in members(file, r["start"], r["stop"], r["size"]):
                        h, body = parse(member)
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = h["warc-type"]
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"damaged record at {r['path']}:{offset}")
                        n = len(body) if kind == "response" else int(h["x-payload-length"])
                        rows.append({"page_id": id_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": id_of(h.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": n, "payload": body if payload else None, "path": r["path"], "offset": offset})
                        held += len(body) if payload else 64
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return table.mapInArrow(run, _READ)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])


def op5(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to FROM m
"""
