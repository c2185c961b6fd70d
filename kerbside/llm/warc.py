"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive is a leading skippable frame that holds a dictionary built from the archive's records, and then
one Zstandard frame for each record, so that any record can be read alone. Records with equal payloads
are written once: the one with the smallest id is the response, the others are revisits that refer to it.

Archives are files in a folder that all executors and the driver share (any URI that pyarrow opens). A
task sorts its rows, so a task that runs again writes the same bytes under the same names, and a file
appears under its name only when it is complete.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic number of the skippable frame with the dictionary (WARC-zstd).
SKIPPABLE = 0x184D2A5D
#: Bytes of records in an archive before the next is begun, of records a dictionary is built from, and of a dictionary.
ARCHIVE, SAMPLE, DICTIONARY = 32 << 20, 2 << 20, 64 << 10
#: No fetch time is given with the pages; archives carry this one unless told otherwise.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_REVISIT = 100


def record_uri(page_id: int | None) -> str:
    return f"<urn:kerbside:page:{'null' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. With ``refers_to`` it is a revisit: HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {target}"] if target else []), f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from the first ``SAMPLE`` bytes of records; empty if there is too little to build one from."""
    import zstandard

    sample, size = [], 0
    for record in records:
        sample.append(record)
        size += len(record)
        if size >= SAMPLE:
            break
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, size // 8)), sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def compress_archive(records: list[bytes], level: int = 3) -> bytes:
    """A whole archive: the dictionary's frame, then a frame for each record."""
    import zstandard

    dictionary = build_dictionary(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary + b"".join(map(compressor.compress, records))


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of a whole archive, one by one."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary's frame")
    dictionary, at = content[8 : 8 + size], 8 + size
    whole = memoryview(content)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(content):
        frame = reader.decompressobj()
        parts, step = [], 1 << 16
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the archive breaks off in a record")
            parts.append(frame.decompress(whole[at : at + step]))
            at += step
        at = min(at, len(content)) - len(frame.unused_data)
        yield b"".join(parts)


def _id(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def parse_record(record: bytes) -> dict:
    """What a record says, with payload digests and lengths taken from the bytes themselves for responses."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "revisit":
        size = next(int(line[16:]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length: "))
        found = {"payload_bytes": size, "payload_digest": fields["warc-payload-digest"].partition(":")[2], "payload": None}
    else:
        found = {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}
        if fields["warc-payload-digest"] != f"sha256:{found['payload_digest']}":
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return found | {"page_id": _id(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": _id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None}


def plan_records(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, n_bytes, refers_to`` (null: a response) for every page.

    Only digests are grouped, with partial sums, and joined back; Spark may split a digest that many pages
    share. Payloads under 100 bytes, and pages without an id in a group that has none, are responses. Rows
    that repeat the smallest id of a payload are all responses.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("n_bytes"))
    shared = rows.where(F.col("n_bytes") >= SMALLEST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", "n_bytes", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, html_col: str = "html", date: str = DATE, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write every page into archives ``*.warc.zst`` below ``folder`` (a URI); ``archive, records, bytes`` of each, lazily.

    The folder itself is made at once, so an empty table leaves an empty folder that :func:`read_archives` can
    read. Rows that repeat are records that repeat. A record is held in memory whole: pages stay below the
    2 GB that a Spark string can have, less what a task's memory allows.
    """
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            name = f"part-{task.partitionId():05d}-{number:05d}.warc.zst"
            content = compress_archive(held)
            draft = f"{base}/.{name}.{task.taskAttemptId()}"
            with files.open_output_stream(draft) as out:
                out.write(content)
            if files.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                files.move(draft, f"{base}/{name}")
            else:  # an earlier attempt's, with the same bytes
                files.delete_file(draft)
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([len(content)], pa.int64())], names=["archive", "records", "bytes"])
            held, size, number = [], 0, number + 1
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                record = warc_record(*(batch.column(c)[k].as_py() for c in range(6)), date)
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    rows = plan_records(pages, html_col).sortWithinPartitions("digest", "page_id", "url")
    return rows.mapInArrow(write, "archive string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record below ``folder``; no archive, no rows."""
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for record in read_archive(content.as_py()):
                    rows.append(parse_record(record))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return archives.select("content").mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
