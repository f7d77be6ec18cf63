"""Token ids in files of bit or byte planes.

Ids are cut into blocks of a fixed size.  A block's 32-bit ids are transposed, so that their
first bytes (or bits) lie together, then their second ones, and so on; each plane is compressed
with zstandard.  A file ends with the documents' ids and lengths, laid out likewise, an index
of all chunks, and the place of both, so a reader can go to any chunk.

Documents are dealt to tasks by ranges of doc_id and lie in ascending order; a task starts a new file
when one is full.  So the files in order hold one sequence of ids.

Defined results: a null text counts as empty and still has its end id; rows that share a doc_id
are ordered by a hash of their text; an empty table gives no file and an empty result; further
columns are left alone.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitweave.llm.common import (
    MOST_RANGES, RANGE_BYTES, durable, fresh_path, range_numbers, ranges_for, small_batches, table)
from visitweave.llm.files import create, new_file, open_file
from visitweave.llm.registry import query
from visitweave.llm.token_ids import encoder, public_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 16
#: Ids after which a file ends (256 MB before compression).
FILE_IDS = 1 << 26
LEVEL = 3
MAGIC = b"IDPLANE1"
BYTES, BITS = 0, 1
_TAIL = struct.Struct("<QQQQ8s")        # place of the documents, their number, place of the index, its chunks
_CHUNK = struct.Struct("<QII")          # place, ids, kind; then a size per plane


def to_planes(values: np.ndarray, kind: int) -> list[bytes]:
    """Planes of an array of unsigned 32- or 64-bit numbers, lowest first."""
    width = values.dtype.itemsize
    if kind == BYTES:
        return [x.tobytes() for x in values.view(np.uint8).reshape(-1, width).T]
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, width), axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: int, dtype: str) -> np.ndarray:
    """The array that ``to_planes`` took apart."""
    rows = np.stack([np.frombuffer(x, np.uint8) for x in planes])
    if kind == BITS:
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).reshape(-1).view(dtype)


class PlaneWriter:
    """Writes one file; at most a block of ids is held."""

    def __init__(self, out, kind: int = BYTES, block: int = BLOCK_IDS):
        self._out, self._kind, self._block = out, kind, block
        self._pack, self._held, self._n_held = zstandard.ZstdCompressor(level=LEVEL), [], 0
        self._index, self._docs, self._sizes = [], [], []
        self._at = out.write(MAGIC)

    def _write_planes(self, values: np.ndarray) -> None:
        planes = [self._pack.compress(x) for x in to_planes(values, self._kind)]
        self._index.append(_CHUNK.pack(self._at, len(values), self._kind)
                           + struct.pack(f"<B{len(planes)}I", len(planes), *map(len, planes)))
        self._at += self._out.write(b"".join(planes))

    def _flush(self, least: int) -> None:
        while self._n_held >= least and self._n_held:
            held = np.frombuffer(b"".join(self._held), "<u4")
            self._write_planes(held[:self._block])
            rest = held[self._block:]
            self._held, self._n_held = [rest.tobytes()], len(rest)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids, as little-endian unsigned 32-bit numbers."""
        self._docs.append(doc_id)
        self._sizes.append(len(ids) // 4)
        self._held.append(ids)
        self._n_held += len(ids) // 4
        if self._n_held >= self._block:
            self._flush(self._block)

    def close(self) -> None:
        self._flush(1)
        chunks, docs_at = len(self._index), self._at
        known = np.array([x is not None for x in self._docs], np.uint32)
        self._write_planes(np.array([x or 0 for x in self._docs], np.int64).view(np.uint64))
        self._write_planes(np.array(self._sizes, np.uint64))
        self._write_planes(known)
        index = b"".join(self._index)
        self._out.write(index)
        self._out.write(_TAIL.pack(docs_at, len(self._docs), self._at, chunks, MAGIC))
        self._out.close()


class PlaneReader:
    """Reads one file, by chunk."""

    def __init__(self, source):
        self._source, self._unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        _, self.n_docs, index_at, self.chunks, magic = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of planes")
        index, self._index, at = self._read(index_at, size - _TAIL.size - index_at), [], 0
        while at < len(index):
            place, n, kind = _CHUNK.unpack_from(index, at)
            planes = index[at + _CHUNK.size]
            sizes = struct.unpack_from(f"<{planes}I", index, at + _CHUNK.size + 1)
            self._index.append((place, n, kind, sizes))
            at += _CHUNK.size + 1 + 4 * planes

    def _read(self, at: int, size: int) -> bytes:
        self._source.seek(at)
        return self._source.read(size)

    def _values(self, number: int, dtype: str) -> np.ndarray:
        place, n, kind, sizes = self._index[number]
        if not n:
            return np.empty(0, dtype)
        data, planes, at = self._read(place, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self._unpack.decompress(data[at:at + size]))
            at += size
        return from_planes(planes, n, kind, dtype)

    def chunk(self, number: int) -> np.ndarray:
        """Ids of one chunk."""
        return self._values(number, "<u4")

    def documents(self):
        """``(doc_id, number of ids)`` of the file's documents in order."""
        ids, sizes, known = (self._values(self.chunks + i, t) for i, t in enumerate(("<i8", "<u8", "<u4")))
        return [(int(i) if k else None, int(n)) for i, n, k in zip(ids, sizes, known)]

    def digests(self):
        """``(doc_id, number of ids, crc32 of the ids)`` of every document, one chunk at a time."""
        numbers, held = iter(range(self.chunks)), b""
        for doc_id, n in self.documents():
            left, crc = 4 * n, 0
            while left:
                held = held or self.chunk(next(numbers)).tobytes()
                part, held = held[:left], held[left:]
                crc, left = crc32(part, crc), left - len(part)
            yield doc_id, n, crc


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, kind: int = BYTES,
              block: int = BLOCK_IDS, range_bytes: int = RANGE_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` to files; returns the stored manifest ``(_range, _file, path, n_docs, n_ids)``.

    A range holds about ``range_bytes`` of text (more if there were too many ranges), a file at most
    ``file_ids`` ids and the last document's rest.
    """
    path = path or public_path(TOKENIZER)
    small_batches(docs.sparkSession)
    parts = ranges_for(docs, range_bytes)
    dealt = range_numbers(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", parts)
    rows = (dealt.repartitionById(parts + 1, F.col("_range"))
            .sortWithinPartitions("_range", F.asc_nulls_last("doc_id"), F.xxhash64("text")))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encode, writer, at = encoder(path), None, None
        for batch in batches:
            done = []
            coded = encode(batch.column(1).to_pylist())
            for doc_id, number, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), coded):
                if at is None or number != at[0] or at[4] >= file_ids:
                    if writer:
                        writer.close()
                        done.append(at)
                    at = [number, at[1] + 1 if at and at[0] == number else 0, new_file(folder, ".planes"), 0, 0]
                    writer = PlaneWriter(create(at[2]), kind, block)
                writer.add(doc_id, ids + end)
                at[3], at[4] = at[3] + 1, at[4] + len(ids) // 4 + 1
            yield _manifest(done)
        if writer:
            writer.close()
            yield _manifest([at])
    return durable(rows.mapInArrow(write, "_range int, _file int, path string, n_docs long, n_ids long"))


def _manifest(files: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    columns = zip(*files) if files else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)],
                                      ["_range", "_file", "path", "n_docs", "n_ids"])


def read_ids(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    # One row per range, of which there are a few thousand at most; then the files of each range by themselves.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_range").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    ranges = manifest.groupBy("_range").agg(F.sum("n_ids").alias("_ids"), F.count(F.lit(1)).alias("_files")).select(
        "_range", before("_ids", earlier).alias("_ids"), before("_files", earlier).alias("_files"))
    starts = manifest.join(ranges, "_range").select(
        (F.col("_files") + F.col("_file")).alias("_number"), "path", (F.col("_ids") + before("n_ids", within)).alias("first"))
    tasks = max(1, min(MOST_RANGES, manifest.count()))

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with open_file(name) as source:
                    rows, start = [], first
                    for doc_id, n, crc in PlaneReader(source).digests():
                        rows.append((doc_id, start, n, crc))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])
    return starts.repartitionById(tasks, (F.col("_number") % tasks).cast("int")).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op7_id_planes")
def op7_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to files of byte planes and read them back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_ids(write_ids(docs, fresh_path(spark, "planes")))
