"""WARC archives: a writer with payload-digest revisits, and a splittable reader.

Archives are gzip files with a member per record. The reader cuts them into byte ranges; a task scans
its range for gzip magic, validates a candidate by inflating it until a WARC header is seen, follows
members from there, and owns the records that start inside the range, wherever they end.

Archives are read and written through pyarrow's file systems, by the URI of the folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.shared import scratch, small_batches, table

SPLIT = 16 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD, _STEP = 1 << 14, 1 << 20


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, ident: str, url: str, body: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One gzip member. A revisit has the HTTP header of the response, whose length it gives, only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if kind == "revisit" else http + body
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{ident}>"), ("WARC-Target-URI", url), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    if kind == "revisit":
        lines += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines.append(("Content-Length", str(len(block))))
    head = VERSION + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode() + b"\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(head + block + b"\r\n\r\n") + gz.flush()


def digest_of(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def write(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, html, and url if there is one) and returns the (path, size) of archives.

    Of pages with equal payloads of at least `least` bytes, that of the largest page_id is a response
    and the others revisit it; null ids revisit any other. Rows of one id and payload are written each,
    all as that id is. A null html is empty, a null url `about:blank`. The returned table is written
    before it is returned: archives of failed tasks are in no table and so are never read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "warc")
    url = F.coalesce(F.col("url").cast("string"), F.lit("about:blank")) if "url" in pages.columns else F.lit("about:blank")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    alike = rows.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    # only payloads that recur; written, so that the join knows how large they are
    alike = table(alike.where("n > 1 and keep is not null").select("sha1", "keep"), "payloads")
    rows = rows.join(alike, "sha1", "left").withColumn("to", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    rows = rows.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page_id"), "url", "html", F.col("to").cast("string").alias("to"))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = file_system(folder)
        path, out, size = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page, u, html, to in zip(b["page_id"], b["url"], b["html"], b["to"]):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(path, compression=None)
                body = html.encode("utf-8", "surrogatepass")
                data = record("response" if to is None else "revisit", page, u, body, digest_of(body), to, date)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "size": [size]})

    return table(rows.mapInPandas(save, "path string, size long"), "archives")


def headers(block: bytes) -> tuple[dict[str, str], int]:
    """Fields by lower-case name, and where the block's body starts."""
    end = block.find(b"\r\n\r\n")
    fields = {}
    for line in block[:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return fields, end + 4


def _valid(head: bytes | None) -> bool:
    return bool(head) and head.startswith(b"WARC/1.") and b"\r\n\r\n" in head and "content-length" in headers(head)[0]


class _Window:
    """Bytes of a file from any place on; one read of them is held at a time."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def rest(self, place: int, most: int) -> bytes:
        """At most so many of the bytes from place on, none at the end of the file only."""
        if not self.at <= place < self.at + len(self.data) and place < self.size:
            self.source.seek(place)
            self.at, self.data = place, self.source.read(max(_STEP, most))
        k = place - self.at
        return self.data[k : k + most] if k >= 0 else b""

    def find(self, start: int, end: int) -> int:
        """The first place of MAGIC in [start, end), or -1."""
        keep = len(MAGIC) - 1
        tail, at = b"", start
        while at < min(end + keep, self.size):
            part = self.rest(at, _STEP)
            k = (tail + part).find(MAGIC)
            if k >= 0:
                found = at - len(tail) + k
                return found if found < end else -1
            tail, at = (tail + part)[-keep:] if keep else b"", at + len(part)
        return -1

    def inflated(self, place: int) -> Iterator[tuple[bytes, int]]:
        """Pieces of the gzip member at place, and with the last one where it ends; else no end comes (-1)."""
        gz, at, step = zlib.decompressobj(31), place, _HEAD
        while not gz.eof:
            part = self.rest(at, step)
            if not part:
                return
            try:
                more = gz.decompress(part)
            except zlib.error:
                return
            at += len(part) - len(gz.unused_data)
            yield more, at if gz.eof else -1
            step = min(2 * step, _STEP)

    def starts_record(self, place: int) -> bool:
        """Whether a member at place inflates to a WARC header, however long that header is."""
        out = b""
        for part, _ in self.inflated(place):
            out += part
            if not b"WARC/1.".startswith(out[:7]):
                return False
            if b"\r\n\r\n" in out:
                return _valid(out)
        return False


def records(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records of a gzip archive that start in [start, end).

    A member is inflated as it is read, whatever its length; behind it nothing is held.
    """
    win, place, trusted = _Window(source, size), start, False
    while place < end:
        if not trusted:
            place = win.find(place, end)
            if place < 0:
                return
            if not win.starts_record(place):
                place += 1
                continue
        out, after = [], -1
        for part, after in win.inflated(place):
            out.append(part)
        whole = b"".join(out)
        if after < 0 or not _valid(whole):
            place, trusted = place + 1, False
            continue
        yield place, whole
        place, trusted = after, True


def parse(data: bytes) -> tuple[str, int, str, str, str | None]:
    """(page id, payload bytes, payload digest, type, page id referred to) of a record.

    A response's bytes and digest are those of the payload as read, a revisit's those of its headers.
    """
    fields, at = headers(data)
    block = data[at : at + int(fields["content-length"])]
    http, body_at = headers(block)
    ident = lambda x: x.strip("<>").removeprefix("urn:x-page:")
    kind, to = fields.get("warc-type", ""), fields.get("warc-refers-to")
    if kind == "revisit":
        return ident(fields["warc-record-id"]), int(http.get("content-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:"), kind, to and ident(to)
    body = block[body_at:]
    return ident(fields["warc-record-id"]), len(body), digest_of(body), kind, None


def read(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, place, page_id, payload_bytes, payload_digest, record_type, refers_to) of archives (path, size)."""
    parts = archives.where("size > 0").select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {int(split)}L)")).alias("start"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, start in zip(b["path"], b["size"], b["start"]):
                files, name = file_system(path)
                with files.open_input_file(name) as source:
                    rows = [(path, place, *parse(data)) for place, data in records(source, int(start), min(int(start) + split, int(size)), int(size))]
                yield pd.DataFrame(rows, columns=["path", "place", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "path string, place long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    # rows of some hundred bytes stand for whole splits, so that a task gets one or few of them, whatever their size says
    parts = table(parts, "splits")
    got = parts.repartitionByRange(max(1, parts.count()), "path", "start").mapInPandas(scan, schema)
    number = lambda c: F.col(c).try_cast("long").alias(c)
    return got.select("path", "place", number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """A row per row of pages, as its record is read back."""
    return read(write(pages, least=least)).drop("path", "place")


def sql(name: str = "pages", least: int = 0) -> str:
    """DuckDB SQL for round_trip of a table."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {0}) & 31), 1)"
    four = " || ".join(digit.format(k) for k in (15, 10, 5, 0))
    eight = " || ".join(f"list_transform([cast('0x' || substr(h, {1 + 5 * k}, 5) as bigint)], lambda v: {four})[1]" for k in range(8))
    return f"""
        with p as (select page_id, coalesce(html, '') html from {name}),
        q as (select page_id, strlen(html) n, sha1(html) h, max(page_id) over (partition by html) top from p)
        select page_id, n payload_bytes, {eight} payload_digest,
               case when n < {least} or page_id is not distinct from top then 'response' else 'revisit' end record_type,
               case when n >= {least} and page_id is distinct from top then top end refers_to
        from q"""
