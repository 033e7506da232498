"""WARC archives: writing, the monolithic-gzip normaliser with its sidecar offset index, and indexed reading."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.hits import digest_slot, filled, key_bits
from kinfold.llm.scratch import bounded_batches, filesystem, normal_uri, scratch_path

CHUNK = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Smaller payloads are always stored in full.
LEAST_REVISIT = 1000

FILES = "archive string"
INDEX_FIELDS = "archive string, offset bigint, length bigint, record_type string, page_id bigint"


def _label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One record.  A revisit has no payload of its own: it carries the payload's digest and length, and the record
    that holds it.  Characters that would break a header line are percent-encoded."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {_label(digest)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    body = HTTP + payload
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = HTTP
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def inflated(raw: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, inflated once in order, a chunk at a time."""
    stream = zlib.decompressobj(31)
    while data := raw.read(CHUNK):
        while data:
            yield stream.decompress(data, CHUNK)
            data = stream.unconsumed_tail
            if stream.eof:
                data = stream.unused_data + data
                stream = zlib.decompressobj(31)
                data = data.lstrip(b"\0") if not data.strip(b"\0") else data


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """``(headers, block, whole record)`` of each record of an inflated stream; memory holds one record."""
    held = bytearray()
    more = True

    def fill() -> bool:
        nonlocal more
        nxt = next(chunks, None)
        more = nxt is not None
        held.extend(nxt or b"")
        return more

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        first, size = end + 4, int(head["content-length"])
        while len(held) < first + size + 4:
            if not fill():
                raise ValueError("the archive ends within a record")
        whole = bytes(held[: first + size + 4])
        del held[: first + size + 4]
        yield head, whole[first : first + size], whole


def _page(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _put(uri: str, write) -> None:  # noqa: ANN001
    """Write a file under a name of this attempt, then rename it: a task that runs again leaves one whole file."""
    store, path = filesystem(uri)
    task = TaskContext.get()
    tmp = f"{path}.attempt-{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(tmp) as out:
        write(out)
    store.move(tmp, path)


def _write_monolithic(folder: str, date: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"

        def rows(out) -> None:  # noqa: ANN001
            press = zlib.compressobj(1, zlib.DEFLATED, 31)
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode()
                    out.write(press.compress(record(page_id, url, payload, hashlib.sha1(payload).digest(), refers, date)))
                batch = next(batches, None)
            out.write(press.flush())

        _put(uri, rows)
        yield pa.RecordBatch.from_pydict({"archive": [uri]})

    return write


def _normalise(folder: str, drop: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = filesystem(uri)
                to = f"{folder}/{uri.rsplit('/', 1)[1]}"
                index: list[str] = []

                def rows(out, store=store, path=path, index=index) -> None:  # noqa: ANN001
                    at = 0
                    with store.open_input_stream(path, compression=None) as raw:
                        for head, _, whole in records(inflated(raw)):
                            press = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = press.compress(whole) + press.flush()
                            out.write(member)
                            index.append(json.dumps([at, len(member), head["warc-type"], _page(head.get("warc-record-id"))]))
                            at += len(member)

                _put(to, rows)
                _put(f"{to}.idx", lambda out, index=index: out.write("".join(f"{x}\n" for x in index).encode()))
                if drop:
                    store.delete_file(path)
                yield pa.RecordBatch.from_pydict({"archive": [to]})

    return run


def _read_indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = filesystem(uri)
            with store.open_input_stream(f"{path}.idx", compression=None) as f:
                index = [json.loads(x) for x in f.read().decode().splitlines()]
            out: list[tuple] = []
            held = 0
            with store.open_input_file(path) as f:
                for offset, length, kind, page in index:
                    f.seek(offset)
                    head, block, _ = next(records(iter([zlib.decompress(f.read(length), 31)])))
                    if (head["warc-type"], _page(head["warc-record-id"])) != (kind, page):
                        raise ValueError(f"{uri}: the index does not fit the record at {offset}")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                    if payload is not None and (hashlib.sha1(payload).digest() != digest or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"{uri}: the payload at {offset} does not have its digest or length")
                    out.append((page, int(head["x-payload-length"]), digest.hex(), kind, _page(head.get("warc-refers-to")), head.get("warc-target-uri"), payload, uri, offset))
                    held += len(payload or b"")
                    if held > 8 * CHUNK:
                        yield _rows(out)
                        out, held = [], 0
            if out:
                yield _rows(out)


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])
READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, offset long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)


def _sha1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [(t or "").encode() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "digest": pa.array([hashlib.sha1(x).digest() for x in bodies], pa.binary()), "n": pa.array(map(len, bodies), pa.int64())})


def _marked(bits):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [(t or "").encode() for t in b.column(2).to_pylist()]
            digests = [hashlib.sha1(x).digest() for x in bodies]
            shared = [len(x) >= LEAST_REVISIT and filled(bits, d) for x, d in zip(bodies, digests, strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "html": b.column(2), "digest": pa.array([d if s else None for d, s in zip(digests, shared, strict=True)], pa.binary())})

    return scan


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: of rows with equal payloads of at least ``LEAST_REVISIT`` bytes all but
    the largest page_id refer to it.  A fixed-size bitmap of shared digests lets rows that have none pass where
    they are read; only the others are joined."""
    digests = pages.select("page_id", "html").mapInArrow(_sha1, "page_id long, digest binary, n long")
    shared = digests.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "holder")
    marked = pages.mapInArrow(_marked(key_bits(shared, digest_slot("digest"))), "page_id long, url string, html string, digest binary")
    alone = marked.where("digest IS NULL").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    rest = marked.where("digest IS NOT NULL").join(shared, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    return alone.unionByName(rest.select("page_id", "url", "html", refers.alias("refers_to")))


def write_monolithic(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html, refers_to`` as one gzip stream per partition; the files' paths."""
    bounded_batches(rows.sparkSession)
    store, path = filesystem(folder)
    store.create_dir(path)
    return rows.mapInArrow(_write_monolithic(folder, date), FILES)


def normalise(archives: DataFrame, folder: str, *, drop_source: bool = False) -> DataFrame:
    """Inflate each archive (one gzip stream, or any members) once, rewrite every record as its own member, and write
    the sidecar index ``<name>.idx`` (offset, length, type, page).  One task per archive."""
    spark = archives.sparkSession
    store, path = filesystem(folder)
    store.create_dir(path)
    return archives.mapInArrow(_normalise(folder, drop_source), FILES)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, each read through its index entry and checked against its digest."""
    return archives.mapInArrow(_read_indexed, READ_DDL)


def warc_round_trip(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row, normalise, read back: one row per row of ``pages`` with the fields of the records.

    A null html is an empty payload, a null page_id a record without one; rows that share a page_id keep a record
    each.  Nothing but paths crosses the driver; archives live in the shared folder.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    root = normal_uri(scratch_path(spark, "warc"))
    rows = with_revisits(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    whole = write_monolithic(rows, f"{root}/monolithic")
    paths = [r.archive for r in whole.collect()]  # one per partition
    listed = spark.createDataFrame([(p,) for p in paths], FILES).repartition(max(1, len(paths))) if paths else spark.createDataFrame([], FILES)
    done = normalise(listed, f"{root}/records", drop_source=False)
    paths = [r.archive for r in done.collect()]
    store, path = filesystem(f"{root}/monolithic")
    store.delete_dir(path)
    listed = spark.createDataFrame([(p,) for p in paths], FILES).repartition(max(1, len(paths))) if paths else spark.createDataFrame([], FILES)
    return read_archives(listed)


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM g
"""
