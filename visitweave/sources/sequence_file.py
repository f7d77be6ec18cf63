"""SequenceFiles of text pairs as a batch data source and sink.

A file is a header and records with a 16-byte mark, drawn once per file, between some of them.
A split owns what follows the marks that begin in its range of bytes, so files of any size are
read by many tasks, each record once.  Pairs travel in whole Arrow batches.

    spark.read.format("text-pairs").load(path)              # key string, value string
    pairs.write.format("text-pairs").mode("append").save(path)

Plain, record-compressed and block-compressed files are read (zlib and gzip); files are written plain.
A folder is read with its sub-folders, but for names that begin with ``_`` or ``.``.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "text-pairs"
SPLIT_BYTES = 64 << 20
#: Rows and bytes after which a batch is handed over.
BATCH_ROWS, BATCH_BYTES = 4_096, 4 << 20
#: Bytes after which the sink writes a mark.
MARK_EVERY = 100_000
# Fixed values of the file format.
MAGIC = b"SEQ"
VERSION = 6
TEXT = b"org.apache.hadoop.io.Text"
ESCAPE = b"\xff\xff\xff\xff"
MARK_BYTES = 16
CODECS = (b"org.apache.hadoop.io.compress.DefaultCodec", b"org.apache.hadoop.io.compress.DeflateCodec",
          b"org.apache.hadoop.io.compress.GzipCodec")


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or URI."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class Header(NamedTuple):
    mark: bytes
    compressed: bool
    blocks: bool
    size: int


def read_vint(source) -> int:
    """A number of one to nine bytes; the first says how many follow, or is the number itself."""
    first = source.read(1)[0]
    first -= (first > 127) << 8
    if first >= -112:
        return first
    below = first < -120
    value = int.from_bytes(source.read(-first - (120 if below else 112)), "big")
    return ~value if below else value


def write_vint(n: int) -> bytes:
    """The same for a length."""
    if n <= 127:
        return bytes([n])
    body = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([256 - 112 - len(body)]) + body


def read_header(source) -> Header:
    name = lambda: source.read(read_vint(source))
    start = source.read(4)
    if start[:3] != MAGIC or start[3] != VERSION:
        raise ValueError("not a SequenceFile of version 6")
    if (name(), name()) != (TEXT, TEXT):
        raise ValueError("keys and values must be texts")
    compressed, blocks = (flag > 0 for flag in source.read(2))
    if compressed and (codec := name()) not in CODECS:
        raise ValueError(f"unknown codec {codec.decode()}")
    for _ in range(2 * int.from_bytes(source.read(4), "big")):
        name()
    return Header(source.read(MARK_BYTES), compressed, blocks, source.tell())


def next_mark(source, start: int, mark: bytes) -> int:
    """Where the first mark at or after ``start`` begins, -1 if there is none."""
    sought, kept, at = ESCAPE + mark, b"", start
    source.seek(start)
    while chunk := source.read(1 << 20):
        window = kept + chunk
        found = window.find(sought)
        if found >= 0:
            return at + found
        kept = window[-len(sought) + 1:]
        at += len(window) - len(kept)
    return -1


def _text(body: bytes) -> bytes:
    """The bytes of a serialised text."""
    source = io.BytesIO(body)
    n = read_vint(source)
    return body[source.tell():source.tell() + n]


def _inflate(body: bytes) -> bytes:
    """All members of a zlib or gzip stream."""
    out = []
    while body:
        one = zlib.decompressobj(47)
        out.append(one.decompress(body) + one.flush())
        body = one.unused_data
    return b"".join(out)


def _block(source) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a compressed block: lengths of keys, keys, lengths of values, values."""
    number = read_vint(source)
    lengths, bodies = [], []
    for _ in range(2):
        for kind in (lengths, bodies):
            kind.append(io.BytesIO(_inflate(source.read(read_vint(source)))))
    for _ in range(number):
        key, value = (_text(body.read(read_vint(length))) for length, body in zip(lengths, bodies))
        yield key, value


def pairs(source, header: Header, start: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """Key and value of the records that belong to the bytes from ``start`` to ``end``."""
    at = header.size if start == 0 else next_mark(source, max(start, header.size), header.mark)
    if at < 0 or (at >= end and start):
        return
    source.seek(at)
    while len(head := source.read(4)) == 4:
        if head == ESCAPE:
            if at >= end:
                return
            if source.read(MARK_BYTES) != header.mark:
                raise ValueError(f"a mark is damaged at {at}")
            at += 4 + MARK_BYTES
            if header.blocks:
                yield from _block(source)
                at = source.tell()
            continue
        size, key_size = int.from_bytes(head, "big"), int.from_bytes(source.read(4), "big")
        body = source.read(size)
        if len(body) < size:
            raise ValueError(f"a record breaks off at {at}")
        value = body[key_size:]
        yield _text(body[:key_size]), _text(_inflate(value) if header.compressed else value)
        at += 8 + size


def _column(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:      # bytes that are no text become replacement characters
        return pa.array([x.decode("utf-8", "replace") for x in values], pa.string())


def batches(rows: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([_column([x[i] for x in held]) for i in (0, 1)], ["key", "value"])
    for row in rows:
        held.append(row)
        size += len(row[0]) + len(row[1])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class Split(InputPartition):
    """Bytes of a file."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class PairReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        system, place = locate(self.path)
        found = system.get_file_info(place)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
        inside = lambda f: not any(x[:1] in "_." for x in f.path[len(place):].split("/") if x)
        return [Split(f.path, start, min(start + self.split_bytes, f.size)) for f in sorted(files, key=lambda f: f.path)
                if f.is_file and f.size and (f is found or inside(f)) for start in range(0, f.size, self.split_bytes)]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:       # Spark's one split of a source without any
            return
        path, start, end = partition.value
        with locate(self.path)[0].open_input_file(path) as file:
            source = io.BufferedReader(file, 1 << 20)
            yield from batches(pairs(source, read_header(source), start, end))


class Written(WriterCommitMessage):
    """Where a task left its file."""

    def __init__(self, hidden: str, final: str):
        self.hidden, self.final = hidden, final


class PairWriter(DataSourceArrowWriter):
    """One file a task, hidden until the job commits."""

    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("the folder is only added to: use mode('append') and a new folder")
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = locate(self.path)
        name = uuid.uuid4().hex
        hidden, final = f"{folder}/_{name}", f"{folder}/part-{name}.seq"
        system.create_dir(folder, recursive=True)
        mark = uuid.uuid4().bytes
        class_name = write_vint(len(TEXT)) + TEXT
        with system.open_output_stream(hidden) as out:
            out.write(MAGIC + bytes([VERSION]) + class_name * 2 + b"\0\0" + bytes(4) + mark)
            since = 0
            for batch in iterator:
                for pair in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                    key, value = (write_vint(len(x)) + x for x in ((x or "").encode() for x in pair))
                    if since >= MARK_EVERY:
                        out.write(ESCAPE + mark)
                        since = 0
                    record = (len(key) + len(value)).to_bytes(4, "big") + len(key).to_bytes(4, "big") + key + value
                    out.write(record)
                    since += len(record)
        return Written(hidden, final)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = locate(self.path)
        for message in filter(None, messages):
            system.move(message.hidden, message.final)

    def abort(self, messages: list[Written | None]) -> None:
        """Hidden files are never read, so a failed job leaves no rows."""


class TextPairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> PairReader:
        return PairReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> PairWriter:
        return PairWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(TextPairs)
