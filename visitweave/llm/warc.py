"""WARC archives: written by tasks, read back by verifying chains of record boundaries.

Every task that reads a byte range of an archive looks for the mark that starts a record,
tries to read a record at each place that has it, and emits the place with that of the record's
successor and with the first place beyond the range that the chain of successors comes to.  A
mark inside a payload gives such a candidate too.  Pointer jumping from the start of each file
along those exits finds where the true chain enters each range; only the candidates on the
chain from there are records.

Defined results: a null html counts as empty and is a payload like others; rows that share a
page_id with the first of their payload are responses; line breaks in a URL become blanks and a
null URL is left out; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from base64 import b32encode
from hashlib import sha1
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitweave.llm.common import durable, fresh_path, small_batches, table
from visitweave.llm.files import create, new_file, open_file
from visitweave.llm.registry import query

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 32 << 20
#: A task looks for records that start in so many bytes.
SPLIT_BYTES = 2 << 20
#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT_BYTES = 0
# What marks the start of a record, plain and compressed, and the revisit profile.
PLAIN_MARK, GZIP_MARK = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: The end of a record's head is looked for in steps of so many bytes.
HEAD_STEP = 1 << 16
CANDIDATE = ("path string, start long, at long, next long, exit long, page_id long, payload_bytes long,"
             " payload_digest string, record_type string, refers_to long")
STEP = 1 << 18


def record(kind: str, fields: list[tuple[str, str]], block: bytes, compress: bool) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    whole = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return whole
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def page_record(page_id: int, url: str | None, payload: bytes, digest: str, first: int, compress: bool) -> bytes:
    """A response, or a revisit of the page ``first`` if that is another one."""
    fields = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first == page_id:
        return record("response", fields, block + payload, compress)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
    return record("revisit", fields, block, compress)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES, compress: bool = True,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)``; returns the stored manifest ``(path, bytes, records)``."""
    small_batches(pages.sparkSession)
    whole = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    named = whole.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = named.groupBy("sha").agg(F.min("page_id").alias("first")).withColumnRenamed("sha", "_sha")
    rows = named.join(firsts, named["sha"] == firsts["_sha"]).select(
        "page_id", "url", "html", "sha",
        F.when(F.octet_length("html") >= least, F.col("first")).otherwise(F.col("page_id")).alias("first"))
    suffix = ".warc.gz" if compress else ".warc"

    def write(batches):
        path, out, size, n = None, None, 0, 0
        done = []
        for batch in batches:
            for page_id, url, html, sha, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = new_file(folder, suffix)
                    out = create(path)
                    info = record("warcinfo", [("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                                  b"format: WARC File Format 1.1\r\n", compress)
                    out.write(info)
                    size, n = len(info), 1
                data = page_record(page_id, url, html.encode("utf-8", "surrogatepass"),
                                   b32encode(bytes.fromhex(sha)).decode(), first, compress)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "bytes", "records"])
    return durable(rows.mapInArrow(write, "path string, bytes long, records long"))


class Record(NamedTuple):
    end: int
    kind: str
    page_id: int | None
    payload_bytes: int | None
    digest: str | None
    refers_to: int | None


class _Bytes:
    """A window onto a file that grows as records need it."""

    def __init__(self, source, start: int, size: int):
        self.source, self.start = source, start
        source.seek(start)
        self.data = source.read(size)

    def at(self, offset: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``offset``."""
        have = self.start + len(self.data)
        if offset + size > have:
            self.source.seek(have)
            self.data += self.source.read(max(STEP, offset + size - have))
        return self.data[offset - self.start:offset - self.start + size]


def _page_number(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _fields(head: bytes) -> dict[str, str] | None:
    """Named fields of a record's head, or ``None`` if it isn't one."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [x.split(":", 1) for x in lines[1:]]
    if not re.fullmatch(r"WARC/1\.\d", lines[0]) or any(len(x) != 2 for x in pairs):
        return None
    found = {k.strip().lower(): v.strip() for k, v in pairs}
    return found if re.fullmatch(r"\d+", found.get("content-length", "")) and "warc-type" in found else None


def _content(fields: dict[str, str], block: bytes, end: int) -> Record:
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    page_id, refers = _page_number(fields.get("warc-record-id")), _page_number(fields.get("warc-refers-to"))
    head, _, payload = block.partition(b"\r\n\r\n")
    if kind == "response":
        return Record(end, kind, page_id, len(payload), b32encode(sha1(payload).digest()).decode(), None)
    stated = re.search(rb"(?im)^content-length: *(\d+)", head)
    return Record(end, kind, page_id, int(stated[1]) if stated else None, digest, refers)


def _plain_record(window: _Bytes, offset: int) -> Record | None:
    size, end = HEAD_STEP, -1
    while True:
        seen = window.at(offset, size)
        end = seen.find(b"\r\n\r\n", max(0, end))
        # The rest of a payload that only begins like a record need not be read.
        if end >= 0 or len(seen) < size or not re.match(rb"WARC/1\.\d\r\n[^\r\n:]+:", seen):
            break
        end, size = size - 3, 2 * size
    head = seen[:max(0, end)]
    fields = _fields(head) if end >= 0 else None
    if fields is None:
        return None
    size = int(fields["content-length"])
    begin = offset + len(head) + 4
    block = window.at(begin, size + 4)
    if len(block) < size + 4 or block[size:] != b"\r\n\r\n":
        return None
    return _content(fields, block[:size], begin + size + 4)


def _gzip_record(window: _Bytes, offset: int) -> Record | None:
    unpack, at, out = zlib.decompressobj(31), offset, []
    try:
        while not unpack.eof:
            data = window.at(at, STEP)
            if not data:
                return None
            out.append(unpack.decompress(data))
            at += len(data)
            if out and not out[0].startswith(PLAIN_MARK[:max(1, len(out[0]))]):
                return None
    except zlib.error:
        return None
    whole, end = b"".join(out), at - len(unpack.unused_data)
    head, gap, rest = whole.partition(b"\r\n\r\n")
    fields = _fields(head) if gap else None
    if fields is None or len(rest) != int(fields["content-length"]) + 4:
        return None
    return _content(fields, rest[:-4], end)


def candidates_in(source, start: int, end: int, compressed: bool):
    """``(offset, record)`` for every place in ``start`` to ``end`` that looks like a record."""
    mark, read = (GZIP_MARK, _gzip_record) if compressed else (PLAIN_MARK, _plain_record)
    window = _Bytes(source, start, end - start + len(mark) - 1)
    at = window.data.find(mark)
    while 0 <= at < end - start:
        found = read(window, start + at)
        if found is not None:
            yield start + at, found
        at = window.data.find(mark, at + 1)


def candidates(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Candidate records of all archives with the place of their successor, stored."""
    small_batches(manifest.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = manifest.select("path", "bytes", F.explode(starts).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def scan(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path) as source:
                    found = list(candidates_in(source, start, min(size, start + split_bytes), path.endswith(".gz")))
                exits: dict[int, int] = {}
                for at, x in reversed(found):
                    exits[at] = exits.get(x.end, x.end)
                rows = [(path, start, at, x.end, exits[at], x.page_id, x.payload_bytes, x.digest, x.kind, x.refers_to)
                        for at, x in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
    names = CANDIDATE.replace(" long", "").replace(" string", "").split(", ")
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in CANDIDATE.split(", ")]
    return durable(splits.repartition(min(int(n), 4096), "path", "start").mapInArrow(scan, CANDIDATE))


def entries(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, at)`` of the places where the chain from the start of a file enters a range.

    Only places that are the start or the exit of some chain take part.  Each round every
    reached place marks the one its pointer leads to, and every pointer doubles its length, so
    a file of n ranges takes about log2(n) rounds.  A file whose end is not reached is broken,
    which is an error.
    """
    met = found.select("path", F.col("exit").alias("at")).union(manifest.select("path", F.lit(0).cast("long"))).distinct()
    ends = manifest.select("path", F.col("bytes").alias("at"), F.lit(None).cast("long").alias("to"))
    state = durable(found.select("path", "at", F.col("exit").alias("to")).join(met, ["path", "at"], "left_semi")
                    .union(ends).withColumn("seen", F.col("at") == 0))
    before, now = -1, state.filter("seen").count()
    while now > before:
        # Places that are seen lie on one chain of a file, so a mark comes once.
        marks = state.filter("seen and to is not null").select("path", F.col("to").alias("at"), F.lit(True).alias("mark"))
        further = state.select("path", F.col("at").alias("to"), F.col("to").alias("further"))
        state = durable(state.join(marks, ["path", "at"], "left").join(further, ["path", "to"], "left").select(
            "path", "at", F.col("further").alias("to"), (F.col("seen") | F.coalesce("mark", F.lit(False))).alias("seen")))
        before, now = now, state.filter("seen").count()
    whole = state.filter("seen").select("path", "at")
    lost = manifest.select("path", F.col("bytes").alias("at")).join(whole, ["path", "at"], "left_anti")
    if not lost.isEmpty():
        raise ValueError("an archive breaks off: its end is not reached from its start")
    return whole


def retained(found: DataFrame, entered: DataFrame) -> DataFrame:
    """The candidates on the chain from the entry of their range; a range's records are a bounded group."""
    marked = found.join(entered.withColumn("entry", F.lit(True)), ["path", "at"], "left").select(
        *found.columns, F.coalesce("entry", F.lit(False)).alias("entry"))

    def walk(pdf):
        following = dict(zip(pdf["at"], pdf["next"]))
        on = set()
        for at in pdf.loc[pdf["entry"], "at"]:
            while at in following and at not in on:
                on.add(at)
                at = following[at]
        return pdf[pdf["at"].isin(on)].drop(columns="entry").astype(object).where(lambda x: x.notna(), None)
    return marked.groupBy("path", "start").applyInPandas(walk, CANDIDATE)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Responses and revisits of all archives."""
    found = candidates(manifest, split_bytes)
    return retained(found, entries(found, manifest)).filter(F.col("record_type").isin("response", "revisit")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_warc_chains")
def op10_warc_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read the records back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(pages, fresh_path(spark, "warc")))
