"""WARC archives: writing, normalising a monolithic gzip stream, and reading back through the index.

An archive that was compressed as one gzip stream cannot be read from the middle. The normaliser inflates it once, front to
back, and rewrites every record as a gzip member of its own, next to an index of offsets (one JSON line per record) that any
reader can seek by. Records are streamed: memory holds one record and one block of input.

Files go to the shared folder through pyarrow's file systems. A task writes under a name of its own attempt and renames at
the end, and what it writes depends on its rows alone, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, materialize, ship, table

#: Payloads below this size are always written in full.
SMALLEST = 1000
BLOCK = 1 << 20
#: Bytes of payloads that a reader holds before it passes them on.
HELD = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def file_system(path: str):
    """(file system, path in it) of a URI or local path; Hadoop's short form file:/x is a URI too."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def sha1_32(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A WARC/1.1 record. A revisit has no payload of its own; its headers keep the payload's size and digest."""
    body = b"" if kind == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    key = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{kind}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{key}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
        f"WARC-Target-URI: {json.dumps(url or '', ensure_ascii=True)[1:-1]}", f"WARC-Payload-Digest: {sha1_32(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def inflated(source) -> Iterator[bytes]:
    """Blocks of a gzip file of one or more members, inflated once; a member without its end raises ValueError."""
    unzip, begun = zlib.decompressobj(31), False
    while block := source.read(BLOCK):
        while block:
            begun = True
            yield unzip.decompress(block)
            block = unzip.unused_data
            if unzip.eof:
                unzip, begun = zlib.decompressobj(31), False
            elif not block:
                break
    if begun:
        raise ValueError("the gzip stream is cut off")


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, content, whole record) of each record of an inflated stream; a truncated last record raises ValueError."""
    held = bytearray()
    blocks = iter(blocks)

    def more() -> bool:
        for block in blocks:
            if block:
                held.extend(block)
                return True
        return False

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record's header is cut off")
                return
        first, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = end + 4 + int(headers["content-length"])
        while len(held) < size + 4:
            if not more():
                raise ValueError("a record's content is cut off")
        yield headers, bytes(held[end + 4 : size]), bytes(held[: size + 4])
        del held[: size + 4]


def member(data: bytes) -> bytes:
    """The data as one gzip member; the same data gives the same bytes."""
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipped.compress(data) + zipped.flush()


def normalise(source, archive, index, name: str) -> int:
    """Rewrites an archive with a member per record and writes its index; returns the number of records."""
    at = count = 0
    for headers, _, whole in records(inflated(source)):
        zipped = member(whole)
        archive.write(zipped)
        line = {"filename": name, "offset": at, "length": len(zipped), "type": headers.get("warc-type"), "url": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest"), "id": headers.get("warc-record-id")}
        index.write(json.dumps(line).encode() + b"\n")
        at += len(zipped)
        count += 1
    return count


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, record_type, refers_to.

    Of equal payloads of at least SMALLEST bytes, the one with the largest page_id is the response; a row that repeats the
    response's page_id and payload is a response too. Null html is an empty payload, a null page_id is never referred to.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.filter((F.length("payload") >= SMALLEST) & F.col("page_id").isNotNull()).select("page_id", F.sha2("payload", 256).alias("d"))
    groups = keyed.groupBy("d").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to")
    again = keyed.join(groups, "d").filter("page_id <> refers_to").select(F.col("page_id").alias("_page"), F.col("d").alias("_d"), "refers_to").distinct()
    # page ids are spread evenly, so joining on them and not on the digest keeps groups of copies apart
    out = rows.join(again, (rows["page_id"] == again["_page"]) & (F.when(F.length("payload") >= SMALLEST, F.sha2("payload", 256)) == again["_d"]), "left")
    return out.select("page_id", "url", "payload", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each partition as an archive of one gzip stream; returns path and records."""
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        store, top = file_system(folder)
        store.create_dir(top, recursive=True)
        final = f"{top}/part-{context.partitionId():06d}.warc.gz"
        own = f"{final}.{context.taskAttemptId()}"
        zipped, count = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                for x in zip(*[batch.column(k) for k in range(5)], strict=True):
                    page_id, url, payload, kind, refers_to = (v.as_py() for v in x)
                    out.write(zipped.compress(record(kind, page_id, url, payload, refers_to)))
                    count += 1
            out.write(zipped.flush())
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{context.partitionId():06d}"]), pa.array([count])], names=["name", "records"])

    return rows.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "name string, records long")


def normalise_archives(files: DataFrame, folder: str, target: str) -> DataFrame:
    """Normalises each archive (name) of a folder into another; returns name and records."""
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, top = file_system(folder)
        to, there = file_system(target)
        to.create_dir(there, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                archive, index = f"{there}/{name}.warc.gz", f"{there}/{name}.idx"
                with store.open_input_stream(f"{top}/{name}.warc.gz", compression=None) as source, to.open_output_stream(f"{archive}.{attempt}", compression=None) as a, to.open_output_stream(f"{index}.{attempt}") as b:
                    count = normalise(source, a, b, f"{name}.warc.gz")
                to.move(f"{archive}.{attempt}", archive)
                to.move(f"{index}.{attempt}", index)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["name", "records"])

    return files.select("name").mapInArrow(run, "name string, records long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder: filename, offset, length, type, url, digest, id."""
    return spark.read.schema("filename string, offset long, length long, type string, url string, digest string, id string").json(f"{folder}/*.idx")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of the indexed records, each read at its offset."""
    ship(index.sparkSession)
    schema = T.StructType.fromDDL("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

        store, top = file_system(folder)
        name, source = None, None
        for batch in batches:
            out, held = [], 0
            for own, offset, length in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if own != name:
                    if source:
                        source.close()
                    name, source = own, store.open_input_file(f"{top}/{own}")
                source.seek(offset)
                headers, content, _ = next(records([zlib.decompress(source.read(length), 31)]))
                payload = content.partition(b"\r\n\r\n")[2]
                kind = headers["warc-type"]
                if kind == "response" and sha1_32(payload) != headers["warc-payload-digest"]:
                    raise ValueError(f"{own} at {offset}: the payload does not match its digest")
                digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                page, back = headers.get("x-page-id"), headers.get("x-refers-to")
                url = json.loads(f'"{headers["warc-target-uri"]}"')
                out.append((page and int(page), url, payload, int(headers["x-payload-length"]), digest, kind, back and int(back)))
                held += len(payload)
                if held > HELD or len(out) == 1024:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)
        if source:
            source.close()

    return index.select("filename", "offset", "length").mapInArrow(run, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages as monolithic archives, normalises them and reads them back through the index; an empty table gives an empty result."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    written = materialize(write_archives(decided(pages), f"{folder}/whole"), "archives")
    many = max(1, written.count())
    done = materialize(normalise_archives(written.repartition(many), f"{folder}/whole", f"{folder}/records"), "normalised")
    if not done.limit(1).count():
        return spark.createDataFrame([], "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_records(read_index(spark, f"{folder}/records"), f"{folder}/records")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).drop("payload", "url")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {SMALLEST} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {SMALLEST} AND page_id < top THEN top END AS refers_to
FROM g
"""
