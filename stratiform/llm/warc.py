"""WARC archives: one gzip member per record, written and read sequentially.

Writing: a record whose payload (of ``REVISIT_MIN_BYTES`` or more) equals that of a smaller page id
becomes a revisit without a block. The choice needs only (digest, id) pairs; payloads move once, to
their archive. Reading: members are inflated step by step, framed by Content-Length, and each
payload's SHA-256 is compared with its header; a mismatch or a cut file raises ``WarcError``.

Defined cases: a null payload is empty; a null id is written as no id and never the target of a
revisit while another id exists; rows with the id of the response are responses too, so repeated
rows agree; line breaks in a URI become spaces; other columns are ignored; no rows, no archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, scratch

REVISIT_MIN_BYTES = 100
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 1 << 30
_STEP = 1 << 16
#: Shares of a group of equal payloads, so that one very common payload is joined by many tasks.
_SALTS = 16

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """A record that is cut, mis-framed or fails its digest."""


# ---- choosing revisits -------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, digest) -> record_type, refers_to for rows with payloads that occur under several ids."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    seen = pages.select(F.col(id_col).alias("_id"), F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("_n")).where(F.col("_n") >= REVISIT_MIN_BYTES)
    first = seen.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    first = scratch.materialise(first, "warc-first").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = seen.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(_SALTS)).cast("int"))
    again = salted.join(first, ["_digest", "_salt"]).where(F.col("_id") != F.col("_first"))
    return again.select("_id", "_digest", F.col("_first").alias("_refers_to")).distinct()


# ---- writing -----------------------------------------------------------------------------------


def _record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    block = b"" if refers_to is not None else payload
    clean = " ".join((uri or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {clean}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into gzip archives under ``folder`` (a URI that all executors share).

    Returns the manifest (path, records, bytes), itself a table of the shared folder: it names the
    files of committed tasks only.
    """
    again = mark_revisits(pages, id_col, payload_col)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(uri_col).cast("string").alias("_uri"), payload.alias("_payload"), F.sha2(payload, 256).alias("_digest"))
    rows = rows.join(again, ["_id", "_digest"], "left").select("_id", "_uri", "_payload", "_digest", "_refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done = TaskContext.get().partitionId(), []
        todo = ((None if pd.isna(i) else int(i), None if pd.isna(u) else u, bytes(p), d, None if pd.isna(r) else int(r)) for b in batches for i, u, p, d, r in zip(b._id, b._uri, b._payload, b._digest, b._refers_to))
        row = next(todo, None)
        while row is not None:
            records = size = 0
            with files.new_file(folder, f"part-{part:05d}", ".warc.gz") as (path, out):
                while row is not None and size < ARCHIVE_BYTES:
                    size += out.write(member := _member(_record(*row, date))) or len(member)
                    records += 1
                    row = next(todo, None)
            done.append((path, records, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return scratch.materialise(rows.mapInPandas(write, MANIFEST), "warc-manifest")


# ---- reading -----------------------------------------------------------------------------------


class _Inflated:
    """Bytes of the gzip members of a stream, with the ends of members visible."""

    def __init__(self, raw):
        self.raw, self.left = raw, b""

    def open(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if not self.left:
            self.left = self.raw.read(_STEP)
        self.z, self.out = zlib.decompressobj(31), b""
        return bool(self.left)

    def more(self) -> bool:
        """Inflate one step; False once the member has ended."""
        if self.z.eof:
            return False
        if not (chunk := self.z.unconsumed_tail or self.left or self.raw.read(_STEP)):
            raise WarcError("the file ends inside a record")
        self.left = self.left if self.z.unconsumed_tail else b""
        try:
            self.out += self.z.decompress(chunk, _STEP)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        if self.z.eof:
            self.left = self.z.unused_data
        return True

    def take(self, most: int) -> bytes:
        while not self.out and self.more():
            pass
        got, self.out = self.out[:most], self.out[most:]
        return got

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if len(self.out) > most or not self.more():
                raise WarcError("a record's header has no end")
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got


def read_records(raw, with_payload: bool = False) -> Iterator[tuple]:
    """Records of an archive in order, as tuples of ``RECORD``; without payloads memory is constant."""
    src = _Inflated(raw)
    while src.open():
        lines = src.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("a record does not begin with a WARC version")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left, sha, kept = int(head["content-length"]), hashlib.sha256(), []
        while left:
            if not (got := src.take(left)):
                raise WarcError("a block is shorter than its Content-Length")
            left -= len(got)
            sha.update(got)
            if with_payload:
                kept.append(got)
        after = b""
        while len(after) < 5 and (got := src.take(5 - len(after))):
            after += got
        if after != b"\r\n\r\n":
            raise WarcError("a block does not end where its Content-Length says")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (sha.hexdigest() != digest or int(head["content-length"]) != int(head["x-payload-length"])):
            raise WarcError(f"digest mismatch in the record of page {head.get('x-page-id')}")
        number = lambda k: int(head[k]) if k in head else None
        yield number("x-page-id"), head.get("warc-target-uri") or None, kind, number("x-refers-to-page-id"), int(head["x-payload-length"]), digest, b"".join(kept) if with_payload and kind == "response" else None


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the archives that ``manifest`` names, one sequential reader per file."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count())  # a row per file

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for path, records in zip(b.path, b.records):
                n, held, size = 0, [], 0
                with files.open_stream(path) as raw:
                    for r in read_records(raw, with_payload):
                        n += 1
                        held.append(r)
                        size += 200 + len(r[-1] or b"")
                        if size > 1 << 24:
                            yield _frame(held, names)
                            held, size = [], 0
                if n != records:
                    raise WarcError(f"{path} holds {n} records, the manifest says {records}")
                if held:
                    yield _frame(held, names)

    return manifest.select("path", "records").repartition(tasks, "path").mapInPandas(read, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.assign(page_id=out.page_id.astype("Int64"), refers_to=out.refers_to.astype("Int64"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, payloads verified."""
    manifest = write_archives(pages, scratch.new_path(spark, "warc"))
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
