"""WARC archives and revisit resolution.

``write`` makes archives of gzip members, one record each. ``resolve`` shuffles
the records' headers by payload digest, finds each digest's original, joins the
others to it, and writes new archives with fresh headers in which these are
revisit records without a payload. Payloads never pass a shuffle: the new archives
are written from the old ones, block by block. ``read`` parses archives back.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are always kept.
LEAST_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task begins a new archive, and those of an archive that
#: one task rewrites.
ARCHIVE_BYTES = BLOCK_BYTES = 64 << 20
LEVEL = 6


def _clean(value: str) -> str:
    """A header value without line ends; these are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _urn(page_id: int | None, key: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}#{key}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: tuple[int | None, str] | None, size: int, digest: str, date: str = DATE, key: str = "") -> bytes:
    """One record. The block is an HTTP response; a revisit's has headers only, and
    size and digest are those of the full payload. key tells records of one page_id
    (or of none) apart; refers_to is the original's page_id and key."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: {_urn(page_id, key)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(*refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> tuple[int | None, str]:
    """Page_id and key of a record id."""
    number, _, key = urn.removeprefix("<urn:page:").removesuffix(">").partition("#")
    return (int(number) if number else None), key


def parse(data: bytes) -> dict:
    """Fields of a record: page_id, key, url, record_type, refers_to, payload_bytes,
    payload_digest (hex) and payload (None for a revisit). A response's size and
    digest are made from its payload; raises if its headers say otherwise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page, key = _page(fields["WARC-Record-ID"])
    response = fields["WARC-Type"] == "response"
    if response and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its headers say")
    return {
        "page_id": page, "key": key, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"])[0] if "WARC-Refers-To" in fields else None, "payload_bytes": size,
        "payload_digest": digest, "payload": payload if response else None,
    }


def members(file, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members that begin in [start, stop)."""
    file.seek(start)
    at, pending = start, b""
    while stop is None or at < stop:
        z, out, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not pending:
                pending = file.read(1 << 20)
                if not pending:
                    if used:
                        raise ValueError("an archive ends within a record")
                    return
            out.append(z.decompress(pending))
            used += len(pending) - len(z.unused_data)
            pending = z.unused_data
        yield at, used, b"".join(out)
        at += used


class Archives:
    """Writes records to archives of a bounded size, named by task attempt."""

    def __init__(self, out_dir: str):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.stem, self.n, self.out, self.at, self.uri = f"{out_dir}/part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, 0, ""

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.uri, self.at, self.n = f"{self.stem}-{self.n}.warc.gz", 0, self.n + 1
            self.out = common.open_output(self.uri)
        member = _member(data)
        self.out.write(member)
        place = self.uri, self.at, len(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


HEADERS = "page_id long, key string, payload_bytes long, payload_digest string, file string, offset long, length long"


def write(pages: DataFrame, out_dir: str) -> DataFrame:
    """A response record for each row of pages (page_id, url, html) in new archives;
    returns the records' headers and places. Null html is an empty payload; a null
    page_id or url is left out of the header. Repeated rows are records of their
    own, with keys of partition and row; other columns are ignored; a payload of any
    length is one record; a page_id that is no number raises; an empty table writes
    no archive."""
    common.bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archives, part, n = Archives(out_dir), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in HEADERS.split(", ")}
            for page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.bytes_of(batch.column(2)), strict=True):
                digest = hashlib.sha1(payload).hexdigest()
                key, n = f"{part}-{n}", n + 1
                place = archives.add(record(page, url, payload, "response", None, len(payload), digest, key=key))
                for c, v in zip(out, (page, key, len(payload), digest, *place), strict=True):
                    out[c].append(v)
            yield _batch(out, HEADERS)
        archives.close()

    return common.stored(rows.mapInArrow(common.given_back(run), HEADERS), "warc-headers")


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], _ARROW[k]) for n, k in kinds], names=[n for n, _ in kinds])


def decide(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """file, offset, is_revisit, refers_to, refers_key for each header. Of the records with one
    digest and at least least_bytes, the one with the largest page_id (null is
    least; among repeats of a page_id, the last by file and offset) is the
    original; all others, also of its own page_id, are revisits of it. Digests are counted before they are joined, so that a digest with a
    third of all records is one row on one side and splits on the other."""
    order = F.struct("page_id", "file", "offset", "key")
    origin = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(order).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "o")
    joined = headers.filter(F.col("payload_bytes") >= least_bytes).join(origin, "payload_digest")
    revisits = joined.filter((F.col("file") != F.col("o.file")) | (F.col("offset") != F.col("o.offset"))).select("file", "offset", F.lit(True).alias("is_revisit"), F.col("o.page_id").alias("refers_to"), F.col("o.key").alias("refers_key"))
    return headers.select("file", "offset").join(revisits, ["file", "offset"], "left").select("file", "offset", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), "refers_to", "refers_key")


def resolve(headers: DataFrame, out_dir: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """Writes deduplicated archives of the records of headers; returns their
    files: file, n_records. A task reads blocks of an old archive in order, and holds
    one record at a time.

    Records keep their page_id (null too), key and url; empty payloads are under
    least_bytes and stay; which of equal payloads is the original is said in
    decide(). No headers give no files."""
    spark = headers.sparkSession
    common.bounded_batches(spark)
    decided = decide(headers, least_bytes).withColumn("block", F.floor(F.col("offset") / BLOCK_BYTES))
    dealt = decided.repartition(common.parallelism(spark), "file", "block").sortWithinPartitions("file", "offset")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, files = Archives(out_dir), {}
        source, uri, seen = None, None, None
        for batch in batches:
            for file, offset, again, refers, key in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if file != uri:
                    if source is not None:
                        source.close()
                    source, uri = common.open_input(file), file
                    seen, at = members(source, offset), offset
                elif at != offset:
                    seen = members(source, offset)
                _, used, data = next(seen)
                at = offset + used
                old = parse(data)
                kind = "revisit" if again else "response"
                place = archives.add(record(old["page_id"], old["url"], old["payload"], kind, (refers, key) if again else None, old["payload_bytes"], old["payload_digest"], date, old["key"]))
                files[place[0]] = files.get(place[0], 0) + 1
        archives.close()
        if files:
            yield _batch({"file": list(files), "n_records": list(files.values())}, "file string, n_records long")

    return common.stored(dealt.select("file", "offset", "is_revisit", "refers_to", "refers_key").mapInArrow(common.given_back(run), "file string, n_records long"), "warc-files")


READ_ROWS = 1 << 16
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Records of archives (file): see RECORDS, a row for each record, repeats too. Size
    and digest of a response are those of the payload that was read (see parse); a
    revisit's are its headers'. A null page_id is carried. No files give no rows.
    Rows are sent READ_ROWS at a time; of the archive one record is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                out: dict[str, list] = {n: [] for n in names}
                with common.open_input(uri) as file:
                    for _, _, data in members(file):
                        found = parse(data)
                        for n in names:
                            out[n].append(found[n])
                        if len(out["page_id"]) == READ_ROWS:
                            yield _batch(out, RECORDS)
                            out = {n: [] for n in names}
                yield _batch(out, RECORDS)

    return files.select("file").repartition(common.parallelism(spark)).mapInArrow(common.given_back(run), RECORDS)
