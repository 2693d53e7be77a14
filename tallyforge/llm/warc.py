"""Writer of Zstandard-compressed WARC files with a dictionary, and a reader.

A file begins with a skippable frame (magic number 0x184D2A5D) that holds the
dictionary; every record is a frame of its own, compressed with it, so a record
can be read alone from the dictionary and its place.  Each file's dictionary is
trained on all records of that file.  A file is closed at ``file_bytes`` of
records; a task writes as many as it needs and nothing is shuffled.

Files appear under their final names only when complete, and their names and
contents depend on the input and the date alone, so a task that runs again leaves the same.

Defined results
* null body: no record; its index row has null file, offset and lengths
* empty body: a record with an empty block; null URL: the target is ``urn:record:`` and the id
* spaces and control characters in a URL are percent-encoded; repeated rows are records of their own, each with an id of its own
* ids are whole numbers; others raise ValueError
* too few or too small records to train on: no dictionary frame, plain frames
* a record larger than ``file_bytes`` has a file of its own; an empty table writes no file
* extra columns are ignored
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, integer_id

DICTIONARY_FRAME = 0x184D2A5D
FILE_BYTES = 64 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 6
INDEX = "page_id long, url string, file string, offset long, length long, record_bytes long, payload_sha1 string"


def _target(url: str | None, key: int | None) -> str:
    if url is None:
        return f"urn:record:{key}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(key: int | None, url: str | None, body: bytes, date: str, place: str) -> bytes:
    """One WARC/1.1 resource record; ``place`` (file and number in it) makes its id one of its own, also among equal rows."""
    target = _target(url, key)
    digest = hashlib.sha1(body).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{place} {key} {target} {digest}")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary from all the records, or None where there is too little to learn from."""
    if len(records) < 8 or sum(map(len, records)) < 8 * 1024:
        return None
    try:
        # Left at their defaults, split_point would keep the last quarter out and accel count only some of the substrings.
        return zstandard.train_dictionary(min(size, sum(map(len, records)) // 8), records, k=512, d=8, f=20, split_point=1.0, accel=1, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return None


def file_bytes_of(records: list[bytes]) -> tuple[list[bytes], int]:
    """(frames of the records, length of what precedes them): the dictionary frame, if any, is the first entry with that length."""
    raw = train(records)
    lead = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw if raw else b""
    data = zstandard.ZstdCompressionDict(raw) if raw else None
    if data:
        data.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)
    return [lead, *map(packer.compress, records)], len(lead)


def _writer(uri: str, limit: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        task, files = TaskContext.get().partitionId(), 0
        names = ["page_id", "url", "file", "offset", "length", "record_bytes", "payload_sha1"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def named() -> str:
            return f"part-{task:06d}-{files:04d}.warc.zst"

        def close(held: list[tuple[int | None, str | None, bytes, str]]) -> pa.RecordBatch:
            nonlocal files
            name = named()
            files += 1
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f"{uri}/{name}")}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()
            frames, at = file_bytes_of([info, *(r[2] for r in held)])
            partial = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(partial) as out:
                for frame in frames:
                    out.write(frame)
            fs.move(partial, f"{root}/{name}")
            at += len(frames[1])
            rows = []
            for (key, url, body, digest), frame in zip(held, frames[2:]):
                rows.append((key, url, name, at, len(frame), len(body), digest))
                at += len(frame)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        fs.create_dir(root, recursive=True)
        held, size = [], 0
        for batch in batches:
            bodies = batch.column(2)
            for i, (key, url) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                body = bodies[i].as_py()
                if body is None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, url, None, None, None, None, None), types)], names=names)
                    continue
                body = body.encode() if isinstance(body, str) else body
                made = record(key, url, body, date, f"{uri}/{named()} {len(held)}")
                if held and size + len(made) > limit:
                    yield close(held)
                    held, size = [], 0
                    made = record(key, url, body, date, f"{uri}/{named()} 0")
                held.append((key, url, made, hashlib.sha1(body).hexdigest()))
                size += len(made)
        if held:
            yield close(held)

    return run


def write_warc(df: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """Writes the rows as WARC files under ``uri`` and returns the index, one row for each row of ``df``.

    The files are written once, here; the index is a table beside them.  ``date`` is
    the WARC-Date of all records, this moment by the driver's clock if it isn't given.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    given = df.select(integer_id(df, id_col), F.col(f"`{url_col}`").cast("string"), F.col(f"`{body_col}`"))
    index = f"{uri}/index"
    arrow_map(given, _writer(uri, file_bytes, date), INDEX).write.parquet(index)
    return df.sparkSession.read.schema(INDEX).parquet(index)


def records_in(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, record) of each record of a file."""
    at, dictionary = 0, None
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_FRAME and at == 0:
                raw = data[8 : 8 + size]
                if raw[:4] == b"\x28\xb5\x2f\xfd":
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = reader.decompress(data[at:])
        yield at, out
        at = len(data) - len(reader.unused_data)


def parse(record_bytes: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = record_bytes.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for at, made in records_in(content):
                fields, block = parse(made)
                if fields["WARC-Type"] == "resource":
                    rows.append((path.rsplit("/", 1)[-1], at, fields["WARC-Target-URI"], block))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["file", "offset", "url", "body"])


def read_warc(spark: SparkSession, uri: str) -> DataFrame:
    """(file, offset, url, body) of every resource record under ``uri``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(uri).select("path", "content")
    return files.mapInArrow(_reader, "file string, offset long, url string, body binary")
