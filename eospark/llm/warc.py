"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

A record is a header block, an empty line, the payload and two line ends. Spark's text writer ends rows with those two
line ends, so archives are written by Spark itself, in parallel and with its commit protocol. Records are read by their
Content-Length, hence payloads may hold anything, line ends and header look-alikes included.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eospark.functions.storage import new_path, staged

END = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Archives are read file by file. Records are dealt to files by their payload's size: up to so many bytes, so many records
#: to a file, so that a file unpacks to 128 MB at most, or holds a lone record.
SIZES = ((1 << 16, 2000), (1 << 20, 128), (1 << 24, 8), (1 << 62, 1))
_CHUNK = 1 << 20
RECORD = "id string, type string, url string, digest string, bytes bigint, refers_to string, refers_url string, payload binary"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_ID = "urn:x-page:"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives hold it after ``sha1:``."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _safe(url: str) -> str:
    """A header value in one line: control and other than ASCII characters are percent-encoded, the rest stays."""
    return quote(url, safe="".join(map(chr, range(33, 127))))


def now() -> str:
    """The time as archives hold it; taken once, on the driver, so that a task run again writes the same."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(rec: dict, date: str) -> bytes:
    """A record with fresh headers. A revisit has no payload of its own and names the response it repeats."""
    revisit = rec["type"] == "revisit"
    body = b"" if revisit else rec["payload"] or b""
    lines = [VERSION, f"WARC-Type: {rec['type']}", f"WARC-Record-ID: <{_ID}{rec['id']}>", f"WARC-Date: {date}"]
    if rec["url"] is not None:
        lines.append(f"WARC-Target-URI: {_safe(rec['url'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{rec['digest']}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{_ID}{rec['refers_to']}>")
        if rec["refers_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_safe(rec['refers_url'])}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body


_FIELD = re.compile(rb"(?:^|\r\n)(WARC-Type|WARC-Record-ID|WARC-Target-URI|WARC-Payload-Digest|WARC-Refers-To|WARC-Refers-To-Target-URI|Content-Length): ([^\r\n]*)")


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive, in order; never more than a record and a chunk are held."""
    held, more = bytearray(), iter(chunks)

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(more, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while fill(1):
        if not fill(5) or held[:5] != b"WARC/":
            raise ValueError("no record where one should begin")
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a record without an end of headers")
        head = {k.decode(): v.decode() for k, v in _FIELD.findall(bytes(held[:end]))}
        stop = end + 4 + int(head["Content-Length"])
        if not fill(stop + 4):
            raise ValueError("a record is cut short")
        yield head, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Records, all of type response: ``id`` is the key as text; a null payload is empty, a null key is ``null``."""
    src = pages.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    none = F.lit(None).cast("string")
    return src.select(
        "id", F.lit("response").alias("type"), "url", none.alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"),
        none.alias("refers_to"), none.alias("refers_url"), "payload",
    )


def _write(values: DataFrame, path: str, records_per_file: int) -> None:
    writer = values.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def write_archives(records: DataFrame, path: str) -> None:
    """Write records as compressed archives under ``path``, in a folder for each of ``SIZES``; a missing digest is computed.

    A payload can have up to two gigabytes, as any value in Spark.
    """
    date = now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                out, held = [], 0
                for i in range(at, min(at + 200, whole.num_rows)):
                    rec = whole.slice(i, 1).to_pylist()[0]
                    rec["digest"] = rec["digest"] or payload_digest(rec["payload"] or b"")
                    out.append(record(rec, date))
                    held += len(out[-1])
                    if held > 16 * _CHUNK:
                        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
                if out:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    kind = sum(((size > most).cast("int") for most, _ in SIZES), F.lit(0))
    for k in sorted(r[0] for r in records.select(kind).distinct().collect()) or [0]:
        _write(records.where(kind == k).select(*_NAMES).mapInArrow(run, "value binary"), f"{path}/{k}", SIZES[k][1])


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), "content")


def _unpacked(content: pa.Scalar) -> Iterator[bytes]:
    """What a compressed file holds, in chunks."""
    buffer = content.as_buffer()
    left = memoryview(buffer) if buffer is not None else memoryview(b"")
    unpack = zlib.decompressobj(31)
    while len(left) or unpack.unconsumed_tail:
        part = unpack.unconsumed_tail
        if not part:
            part, left = left[:_CHUNK], left[_CHUNK:]
        out = unpack.decompress(part, 4 * _CHUNK)
        if out:
            yield out
        if unpack.eof:
            rest = unpack.unused_data
            left = memoryview(rest + bytes(left)) if rest else left
            unpack = zlib.decompressobj(31)


def _own(head: dict[str, str], name: str) -> str | None:
    return head[name].strip("<>").removeprefix(_ID) if name in head else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, with the ``file`` they are in and their ``place`` there.

    A file is read by one task, record by record. Without payloads only headers leave the task.
    """
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32()]

    def made(file: str, rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.record_batch([*cols, pa.array([file] * len(rows))], [*_NAMES, "place", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for place, (head, payload) in enumerate(parse(_unpacked(content))):
                    kept = payload if with_payload else None
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = _own(head, "WARC-Refers-To"), head.get("WARC-Refers-To-Target-URI")
                    rows.append((_own(head, "WARC-Record-ID"), head["WARC-Type"], head.get("WARC-Target-URI"), digest, len(payload), *refers, kept, place))
                    if len(rows) == 500 or with_payload and len(payload) > _CHUNK:
                        yield made(file, rows)
                        rows = []
                if rows:
                    yield made(file, rows)

    return _files(spark, path).mapInArrow(run, f"{RECORD}, place int, file string")


def rewrite_archives(spark: SparkSession, source: str, resolved: DataFrame, path: str) -> None:
    """Write the archives under ``source`` again, with fresh headers and without the payloads of revisit records.

    Each archive meets the list of its own revisits, so what moves are compressed archives and not records. Archives of
    one of ``SIZES`` become archives of the same.
    """
    seen = resolved.where("type = 'revisit'").groupBy("file").agg(F.collect_list(F.struct("place", "refers_to", "refers_url")).alias("seen"))
    date = now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, seen in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                again = {s["place"]: s for s in seen or []}
                out: list[bytes] = []
                held = 0
                for place, (head, payload) in enumerate(parse(_unpacked(content))):
                    rec = {"id": _own(head, "WARC-Record-ID"), "type": head["WARC-Type"], "url": head.get("WARC-Target-URI"), "payload": payload}
                    rec |= {"digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": _own(head, "WARC-Refers-To")}
                    rec["refers_url"] = head.get("WARC-Refers-To-Target-URI")
                    if place in again:
                        rec |= again[place] | {"type": "revisit"}
                    out.append(record(rec, date))
                    held += len(out[-1])
                    if len(out) == 200 or held > 16 * _CHUNK:
                        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
                if out:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    folder = F.regexp_extract("file", "/([0-9])/[^/]*$", 1)
    for k in sorted(r[0] for r in _files(spark, source).select(folder).distinct().collect()):
        files = _files(spark, f"{source}/{k}").join(seen, "file", "left").select("content", "seen")
        _write(files.mapInArrow(run, "value binary"), f"{path}/{k}", SIZES[int(k)][1])


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``file, place, id, type, digest, bytes, refers_to, refers_url``: of the records with one digest and length, that with the
    smallest id (as a number where it is one) is the response, the others revisit it. Payloads shorter than ``min_bytes``
    stay responses. Records that repeat the smallest id stay responses too. Only headers are shuffled.
    """
    number = F.coalesce(F.expr("try_cast(id as bigint)"), F.lit((1 << 63) - 1))
    h = headers.select("file", "place", "id", "url", "digest", "bytes").withColumn("k", F.struct(number.alias("n"), F.col("id").alias("id"), F.col("url").alias("url")))
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot digest.
    first = staged(h.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("k").alias("first")), "first")
    out = h.join(first, ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & (F.col("first.id") != F.col("id"))
    return out.select(
        "file", "place", "id", F.when(again, "revisit").otherwise("response").alias("type"), "url", "digest", "bytes",
        F.when(again, F.col("first.id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"),
    )


def full_headers(headers: DataFrame) -> DataFrame:
    """Headers with ``bytes`` of the full payload: revisit records take it from the response they refer to."""
    heads = headers.select("id", "type", "digest", "bytes", "refers_to")
    originals = heads.where("type = 'response'").groupBy(F.col("id").alias("_id"), F.col("digest").alias("_d")).agg(F.max("bytes").alias("_bytes"))
    originals = staged(originals, "originals")
    joined = heads.join(originals, (F.col("refers_to") == F.col("_id")) & (F.col("digest") == F.col("_d")), "left")
    return joined.select("id", "type", "digest", F.coalesce("_bytes", "bytes").alias("bytes"), "refers_to")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> str:
    """Write ``pages`` as archives, resolve repeated payloads from the headers, and write deduplicated archives.

    Both sets of archives are under ``path``, in ``raw`` and ``deduplicated``; the latter's path is returned. Nulls and
    repeated rows: see ``from_pages`` and ``resolve``; long payloads: see ``SIZES``; an empty table gives archives without
    records. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    write_archives(from_pages(pages, id_col, url_col, payload_col), f"{path}/raw")
    resolved = resolve(staged(read_archives(spark, f"{path}/raw", with_payload=False).drop("payload"), "headers"), min_bytes)
    rewrite_archives(spark, f"{path}/raw", resolved, f"{path}/deduplicated")
    return f"{path}/deduplicated"


def archived(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """``archive`` and then the headers that its result holds, read back: ``id, type, digest, bytes, refers_to``."""
    spark = pages.sparkSession
    out = archive(pages, path or new_path(spark, "warc"), **columns)
    return full_headers(staged(read_archives(spark, out, with_payload=False).drop("payload"), "headers"))
