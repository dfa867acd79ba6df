"""WARC archives with records compressed one by one under a dictionary that the archive itself carries.

An archive is a .warc.zst file: a skippable frame with a Zstandard dictionary, then one frame for each record. The
dictionary is built from a sample of the payloads that are archived. Tasks write the files straight to the shared
folder, under a name of their own attempt, and report them in a manifest; files of failed attempts are in no manifest.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm.common import new_folder, stored

#: Frame number of the embedded dictionary (fixed value of the WARC-zstd format) and the revisit profile (of WARC 1.1).
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary's size, the payloads it is built from and how much of each; bounds of the sample, not of the archive.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 400, 16_384
#: An archive that has reached this size is closed and another one begun.
ARCHIVE_BYTES = 256 << 20
#: Equal payloads shorter than this are all stored.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"


def build_dictionary(payloads: list[bytes]) -> bytes:
    """A Zstandard dictionary from some payloads; their raw content if they are too few to train on."""
    samples = [p[:SAMPLE_BYTES] for p in payloads if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def record(page: str, url: str | None, payload: bytes, size: int, digest: bytes, refers_to: str | None) -> bytes:
    """A response, or, if it refers to another page, a revisit without payload. digest: SHA-1 of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """A record's fields, its payload and the payload's size by the HTTP header."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, payload, int(http.rpartition(b"Content-Length: ")[2])


class _Archive:
    """One file being written: the dictionary first, then records."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.path, self.size, self.records = f"{root}/{name}.warc.zst", 0, 0
        self.out = self.files.open_output_stream(self.path, compression=None)  # by its name, the whole file would be compressed again
        self.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self.write(self.zstd.compress(data))
        self.records += 1


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Writes a record per row of pages below folder; the manifest: (file, n_records, n_bytes), a stored table.

    Of the records with equal payloads of REVISIT_BYTES or more, those with the largest id are responses and the others
    revisits of it; rows that repeat this id are responses too, rows without an id revisits (responses if none of the
    payload's rows has one). A null text is an empty payload, a null url leaves the field out. An empty table writes no
    archive. Payloads of any length are written whole; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.filter("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"), "equal-payloads")
    sample = [bytes(r[0]) for r in rows.select(F.substring("payload", 1, SAMPLE_BYTES)).limit(SAMPLE_ROWS).collect()]
    dictionary = pages.sparkSession.sparkContext.broadcast(build_dictionary(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, n = TaskContext.get(), None, 0
        made: list[tuple[str, int, int]] = []

        def close() -> None:
            archive.out.close()
            made.append((archive.path, archive.records, archive.size))

        for batch in batches:
            for page, url, payload, size, digest, first in zip(*batch.columns, strict=True):
                if archive is None or archive.size >= ARCHIVE_BYTES:
                    if archive:
                        close()
                    archive, n = _Archive(folder, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{n}", dictionary.value), n + 1
                archive.add(record(str(page.as_py()), url.as_py(), payload.as_py() or b"", size.as_py(), bytes.fromhex(digest.as_py()), first.as_py()))
        if archive:
            close()
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in made], "n_records": [x[1] for x in made], "n_bytes": [x[2] for x in made]}, pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    joined = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("first")))
    plan = joined.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.col("size").cast("long"), "digest", F.when(revisit, F.col("first").cast("string")).alias("first"))
    return stored(plan.mapInArrow(run, "file string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """One row for each record of the manifest's archives: page_id, url, payload_bytes, payload_digest (hex SHA-1),
    record_type, refers_to and, with payloads, the payload (null of revisits).

    Size and digest of a response are those of the payload that was read; of a revisit they are the record's fields.
    Files are read as streams: what a task holds is one record, however large the archive.
    """

    def records(path: str) -> Iterator[bytes]:
        files, _ = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(path, compression=None) as stream:
            magic, length = struct.unpack("<II", stream.read(8))
            dictionary = stream.read(length)
            if magic != SKIPPABLE:
                raise ValueError(f"{path} doesn't begin with a dictionary")
            zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            data = b""
            while data := data or stream.read(1 << 20):
                frame, parts = zstd.decompressobj(), []
                while not frame.eof:
                    data = data or stream.read(1 << 20)
                    if not data:
                        raise ValueError(f"{path} ends within a record")
                    parts.append(frame.decompress(data))
                    data = frame.unused_data if frame.eof else b""
                yield b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers", *(["payload"] if payloads else [])]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if payloads else [])]
        schema = pa.schema(list(zip(names, types, strict=True)))

        def rows(columns: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[list] = [[] for _ in names]
                held = 0
                for data in records(path):
                    fields, payload, size = parse(data)
                    full = fields["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if full else base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    values = [fields["WARC-Record-ID"][10:-1], fields.get("WARC-Target-URI"), len(payload) if full else size, digest, fields["WARC-Type"], fields.get("WARC-Refers-To", "<urn:page:None>")[10:-1], payload if full else None]
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
                    held += len(payload) if payloads else 256
                    if held > 8 << 20:
                        yield rows(out)
                        out, held = [[] for _ in names], 0
                yield rows(out)

    kinds = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string" + (", payload binary" if payloads else "")
    spread = manifest.select("file").repartition(max(1, min(manifest.count(), 10_000)), "file")
    read = spread.mapInArrow(run, kinds)
    back = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(id_type)
    return read.select(back("page").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", back("refers").alias("refers_to"), *(["payload"] if payloads else []))


def archived(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages written to archives in a new shared folder and read back."""
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(pages, folder), folder, pages.schema["page_id"].dataType.simpleString(), payloads)
