"""WARC 1.1 archives: one gzip member for each record, written and read sequentially.

Archives are rows (archive, content) of some megabytes, so that Spark's own writers and readers carry them to any store; to_files()
and from_files() turn them into .warc.gz files and back. The reader decompresses step by step, frames a record by its
Content-Length, and checks block and payload digests.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depmatrix.llm.shared import split_join, written

DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "archive string, content binary"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    pass


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, size: int | None = None
) -> bytes:
    """One gzip member. A revisit holds the HTTP header only, whose Content-Length tells the payload's size."""
    size = len(payload) if size is None else size
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        + (b"" if revisit else payload)
    )
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {name(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class _Members:
    """Bytes of one gzip member after the other, decompressed only as far as asked for."""

    def __init__(self, chunks: Iterable[bytes], step: int = 1 << 16):
        self._pieces = (c[i : i + step] for c in chunks for i in range(0, len(c), step))
        self._raw, self._out, self._gz = b"", bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        """Another member begins."""
        while not self._raw:
            if (piece := next(self._pieces, None)) is None:
                return False
            self._raw = piece
        return True

    def _pull(self) -> bool:
        if self._gz.eof:
            return False
        raw = self._gz.unconsumed_tail or self._raw or next(self._pieces, b"")
        if not raw:
            raise WarcError("the archive ends within a member")
        if raw is self._raw:
            self._raw = b""
        try:
            self._out += self._gz.decompress(raw, 1 << 16)
        except zlib.error as e:
            raise WarcError(f"damaged gzip member: {e}") from None
        if self._gz.eof:
            self._raw = self._gz.unused_data + self._raw
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self._out.find(mark)) < 0:
            if not self._pull():
                raise WarcError("no end of the header")
        got = bytes(self._out[: at + len(mark)])
        del self._out[: at + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        while len(self._out) < n:
            if not self._pull():
                raise WarcError("the record is shorter than its Content-Length")
        got = bytes(self._out[:n])
        del self._out[:n]
        return got

    def end(self) -> None:
        while self._pull():
            pass
        if self._out:
            raise WarcError("a member holds more than its record")
        self._gz = zlib.decompressobj(31)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:] if x)}


def read_records(chunks: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive, which may come in pieces. Raises WarcError on wrong framing or digests."""
    members = _Members(chunks)
    while members.more():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("not a WARC record")
        fields = _fields(head)
        block = members.take(int(fields["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise WarcError("no end of the record")
        members.end()
        if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
            raise WarcError("block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, revisit = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
        size = int(_fields(http)["content-length"])
        if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
            raise WarcError("payload digest differs")
        number = lambda k: int(fields[k]) if fields.get(k, "None") != "None" else None  # noqa: B023, E731
        yield {
            "page_id": number("x-page-id"),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "refers_to": number("x-refers-to-page-id"),
            "payload_bytes": size,
            "payload_digest": digest,
            "payload": None if revisit else payload,
        }


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to, revisit). Rows with equal payloads of at least `least` bytes refer to their smallest page_id.

    Only digests and ids are grouped. Payloads that occur once or are below `least` meet no hot key: what is joined to the pages is one row for each repeated
    payload, broadcast up to a fixed number of rows and split by frequency beyond."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(html).cast("long")
    said = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("payload")).filter(F.octet_length("payload") >= least)
    copies = (
        said.select("page_id", F.unhex(F.sha2("payload", 256)).alias("_digest"))
        .groupBy("_digest")
        .agg(F.min("page_id").alias("least_id"), F.count("*").alias("n"))
    )
    copies = written(copies.filter("n > 1 and least_id is not null"))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("payload"),
        F.sha2(html, 256).alias("digest"),
        size.alias("size"),
    )
    # short payloads have no key, so that all the empty pages aren't one
    keyed = own.withColumn(
        "key",
        F.when(F.col("size") >= least, F.unhex("digest")).otherwise(
            F.unhex(F.sha2(F.concat(F.lit("short"), F.coalesce("page_id", F.lit(0)).cast("string")), 256))
        ),
    )
    joined = split_join(keyed, copies, [("key", "_digest")], "n", "left")
    revisit = F.col("least_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least_id"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "digest",
        "size",
        F.when(revisit, F.col("least_id")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def archives(pages: DataFrame, archive_bytes: int = 4 << 20, least: int = 100) -> DataFrame:
    """(archive, content): .warc.gz archives of all rows of pages (page_id, url, html), each of about archive_bytes.

    Null html: an empty payload. Null url or page_id: the record lacks that field. Repeated rows: a record each; those with the smallest
    page_id of equal payloads are all responses. Empty table: no archives. Extra columns are not looked at. Archives are named by run, task and number, so equal
    contents have different names. A task that is run again names its archives alike; write the result as a table before it is used twice."""
    run_id = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), count()

        def row(parts: list[bytes]) -> pa.RecordBatch:
            name = f"{run_id}-{task:06d}-{next(made):06d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

        parts, held = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                parts.append(record(x["page_id"], x["url"], x["payload"] or b"", x["digest"], x["refers_to"], x["revisit"], x["size"]))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield row(parts)
                    parts, held = [], 0
        if parts:
            yield row(parts)

    return with_revisits(pages, least).mapInArrow(run, ARCHIVES)


def records(archived: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of (archive, content) rows, in the columns of RECORDS; a revisit's payload is null."""
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        to = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for x in read_records([content.as_py()]):
                    held += len(x["payload"] or b"")
                    if not with_payload:
                        del x["payload"]
                    rows.append(x)
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, to)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, to)

    return archived.select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes the archives to the shared folder and reads the records back."""
    return records(written(archives(pages)), with_payload)


def to_files(archived: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file into a folder that all executors have mounted; returns (archive, bytes).

    The archives become a table first, so that names and contents are settled and a retried task writes the same files again. Raises if two have one name."""
    archived = written(archived)
    twice = archived.groupBy("archive").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"{twice['count']} archives are named {twice['archive']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                part = os.path.join(folder, f".{x['archive']}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(x["content"])
                os.replace(part, os.path.join(folder, x["archive"]))
                yield pa.RecordBatch.from_pydict({"archive": pa.array([x["archive"]]), "bytes": pa.array([len(x["content"])], pa.int64())})

    return archived.select("archive", "content").mapInArrow(run, "archive string, bytes long")


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, content) of the *.warc.gz files of a folder in any store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
