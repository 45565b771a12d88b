"""Dictionary-compressed WARC archives, written and read in parallel.

An archive starts with a skippable Zstandard frame (the magic number that WARC readers expect)
that embeds a dictionary trained on a sample of the archived records; every record that follows
is a frame of its own, compressed with the dictionary. Records with equal payloads of at least
``REVISIT_BYTES`` are written once as response, by the row with the largest id; the others
become revisit records, which refer to it and hold no payload.

The dictionary is trained on at most ``SAMPLE_RECORDS`` records of at most ``SAMPLE_BYTES`` each, those with
the smallest hashes of their id; a corpus without enough records gets archives without dictionary.
An archive is closed at about ``ARCHIVE_BYTES``. A task writes archives under names of its own attempt, and only those of
attempts that ended well are in the manifest, so a lost executor leaves nothing that is read.

Nulls and odd input: a null html is an empty payload; rows with a null id are archived, never as the
response of a group that has an id; rows that repeat both id and payload are all responses; an
empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.llm.common import map_arrow
from foretally.llm.fitting import bounded_sample
from foretally.workspace import attach, run_folder, settle

REVISIT_BYTES = 1000
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
# The frame that embeds a dictionary, and the profile of a revisit record.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMESPACE = uuid.UUID("5c1d6f2e-6a5b-4d0e-9d0b-1f6f9d2c7a34")
_BREAK = b"\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def record_bytes(page_id, url, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    """One record; a revisit if ``refers_to`` names its response."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Payload-Length: {length}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return _BREAK.join(line.encode() for line in head) + _BREAK * 2 + payload + _BREAK * 2


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload) of each record of an uncompressed stream."""
    buffer, at = b"", 0

    def fill(wanted: int) -> bool:
        nonlocal buffer, at
        parts, held = [buffer[at:]], len(buffer) - at
        while held < wanted and (more := stream.read(max(1 << 20, wanted - held))):
            parts.append(more)
            held += len(more)
        buffer, at = b"".join(parts), 0
        return held >= wanted

    while True:
        while (end := buffer.find(_BREAK * 2, at)) < 0:
            held = len(buffer) - at
            if not fill(held + 1):
                if held:
                    raise ValueError("an archive ends inside a record")
                return
        lines = buffer[at:end].decode().split("\r\n")
        header = dict(line.split(": ", 1) for line in lines[1:])
        at, length = end + 4, int(header["Content-Length"])
        if len(buffer) - at < length + 4 and not fill(length + 4):
            raise ValueError("an archive ends inside a record")
        yield header, buffer[at : at + length]
        at += length + 4


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of these records; empty if there are too few to train one."""
    total = sum(map(len, records))
    if len(records) < 16 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def payload_rows(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """(page_id, url, payload, bytes, digest)."""
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).alias("url"),
        F.encode(F.coalesce(F.col(html_column), F.lit("")), "UTF-8").alias("payload"),
    )
    return rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})


def with_decisions(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` with refers_to.

    Only digests are grouped. Those that repeat are written and counted: while they are few enough to broadcast no
    payload moves, beyond that payloads move once, on their digest.
    """
    groups = rows.where(F.col("bytes") >= least_bytes).select("digest", "page_id").groupBy("digest")
    copies = groups.agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep")
    repeated = settle(copies, "repeated-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return attach(rows, repeated, ["digest"], repeated.count(), "left").withColumn("refers_to", refers).drop("keep")


def sample_records(rows: DataFrame) -> list[bytes]:
    """Records of a bounded sample of rows, each payload once."""
    sample = bounded_sample(rows, SAMPLE_RECORDS, "page_id", "digest", keep=F.octet_length("payload") <= SAMPLE_BYTES).collect()
    once = {r.digest: r for r in sample}
    return [record_bytes(r.page_id, r.url, bytes(r.payload), r.digest, r.bytes, None) for r in once.values()]


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Archives of all pages below ``folder`` (a uri that pyarrow's file systems reach); their manifest."""
    rows = payload_rows(pages, id_column, url_column, html_column)
    decided = with_decisions(rows, least_bytes)
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(sample_records(rows)))  # at most DICTIONARY_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        system, path = pafs.FileSystem.from_uri(stem)
        embedded = dictionary.value
        trained = zstandard.ZstdCompressionDict(embedded) if embedded else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        out, number, records, size = None, 0, 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            out.close()
            done.append((f"{stem}-{number}.warc.zst", records, size))

        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "bytes", "refers_to")]):
                page_id, url, payload, digest, length, refers_to = (cell.as_py() for cell in row)
                if out is None:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, records, size = system.open_output_stream(f"{path}-{number}.warc.zst", compression=None), 0, 0
                    if embedded:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(embedded)) + embedded)
                frame = packer.compress(record_bytes(page_id, url, payload, digest, length, refers_to))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["archive", "records", "bytes"])

    return settle(map_arrow(decided, write, "archive string, records long, bytes long"), "manifest")


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload) of each record; the dictionary comes from the archive itself."""
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as source:
        head = source.read(8)
        trained = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
            trained = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0]))
            head = b""
        reader = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(_Joined(head, source), read_across_frames=True)
        yield from parse_records(reader)


class _Joined:
    """Bytes already read, then the rest of their source."""

    def __init__(self, head: bytes, source):
        self.head, self.source = head, source

    def read(self, size: int = -1) -> bytes:
        if self.head:
            head, self.head = self.head, b""
            return head
        return self.source.read(size)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row a record, in parallel by archive: its header's fields and its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "record_type", "payload_bytes", "header_digest", "refers_to", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for header, payload in read_archive(uri):
                    digest = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    page, refers = header["WARC-Page-ID"], header.get("WARC-Refers-To-Page")
                    rows.append(
                        (
                            int(page) if page else None,
                            header.get("WARC-Target-URI"),
                            header["WARC-Type"],
                            int(header["WARC-Payload-Length"]),
                            digest,
                            int(refers) if refers else None,
                            payload,
                        )
                    )
                    held += len(payload) + 500
                    if held >= 4 << 20:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, header_digest string, refers_to long, payload binary"
    spread = manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "archive")
    return map_arrow(spread, read, schema)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's uri with the scheme that Spark itself would take: that of the default file system if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/*", "file:///", uri)


def round_trip(pages: DataFrame, spark: SparkSession, **columns) -> DataFrame:
    """Write ``pages`` to new archives in the application's folder and read them back; ``release`` deletes them.

    Length and digest of a response come from the payload that was read; those of a revisit from its header.
    """
    folder = qualified(spark, f"{run_folder(spark)}/warc-{uuid.uuid4().hex}")
    records = read_archives(write_archives(pages, folder, **columns))
    own = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
