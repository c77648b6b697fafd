"""File sources: content types, PDF and ZIP entries, and HTML listings."""

from __future__ import annotations

import hashlib
import io
import multiprocessing
import os
import re
import resource
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_type(content: Column) -> Column:
    """pdf, zip, html or outro, by the first bytes."""
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    return F.when(head.startswith("%PDF-"), "pdf").when(head.startswith("PK"), "zip").when(F.lower(F.ltrim(head)).rlike("^(<!doctype html|<html)"), "html").otherwise("outro")


def http_class(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status.isin(429, 503), "espera").when(status.between(500, 599), "servidor").when(status.isin(401, 403), "bloqueado").otherwise("falha")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content, kind, sha256) of every file below path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", "length", "content", content_type(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))


def zip_entries(archives: DataFrame, most: int = 200, most_bytes: int = 200 << 20) -> DataFrame:
    """(path, entry, content, truncated) of PDF entries of ZIP archives, up to a count and a total size each.

    truncated: the archive has more than that; one without room for any entry is a row without entry.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows, total, more = [], 0, False
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if info.is_dir() or not info.filename.lower().endswith(".pdf"):
                                continue
                            total += info.file_size
                            if len(rows) >= most or total > most_bytes:
                                more = True
                                break
                            data = z.read(info)
                            if data[:5] == b"%PDF-":
                                rows.append((path, info.filename, data))
                except (zipfile.BadZipFile, zlib.error, EOFError):
                    continue
                if more and not rows:
                    rows.append((path, None, None))
                yield pd.DataFrame(rows, columns=["path", "entry", "content"]).assign(truncated=more)

    return archives.where("kind = 'zip'").select("path", "content").mapInPandas(run, "path string, entry string, content binary, truncated boolean")


class Aside:
    """Runs a function in a child process, which is killed if a call takes too long or more memory than it may, and replaced.

    A call that is stuck in native code ends too, as no cooperation is asked of it. A child serves many calls.
    """

    def __init__(self, function: Callable, seconds: float, memory: int | None = None):
        self.function, self.seconds, self.memory = function, seconds, memory
        self.child, self.pipe = None, None

    def _serve(self, pipe) -> None:
        if self.memory:
            resource.setrlimit(resource.RLIMIT_AS, (self.memory, self.memory))
        while True:
            try:
                content = pipe.recv_bytes()
            except EOFError:
                os._exit(0)
            try:
                pipe.send((True, self.function(content)))
            except Exception as e:  # noqa: BLE001  the caller gets what the child can't raise
                pipe.send((False, f"{type(e).__name__}: {e}"))

    def __call__(self, content: bytes) -> tuple[bool, object]:
        """(True, result), or (False, why there is none)."""
        if self.child is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, theirs = fork.Pipe()
            self.child = fork.Process(target=self._serve, args=(theirs,), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send_bytes(content)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            why = "out of time"
        except (EOFError, OSError):
            why = "died"
        self.close()
        return False, why

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*Tj|\[((?:\\.|[^\]])*)\]\s*TJ|(T\*|Td|TD|ET)")
_PART = re.compile(rb"\(((?:\\.|[^\\()])*)\)")
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
# Escapes of PDF strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, x)

    return _ESCAPE.sub(one, raw).decode("latin-1")


def pdf_text(content: bytes) -> tuple[str, int]:
    """Text shown by a PDF's plain or deflated content streams, and its number of pages."""
    out = []
    for m in _STREAM.finditer(content):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"Tj" not in body and b"TJ" not in body:
            continue
        for s in _SHOWN.finditer(body):
            if s[1] is not None:
                out.append(_plain(s[1]))
            elif s[2] is not None:
                out.append("".join(_plain(p) for p in _PART.findall(s[2])))
            else:
                out.append("\n")
    text = re.sub(r"\n+", "\n", "".join(out)).strip()
    return text, len(re.findall(rb"/Type\s*/Page\b(?!s)", content))


def pdf_texts(documents: DataFrame, seconds: float = 20.0, read=pdf_text, memory: int | None = None) -> DataFrame:
    """#7, #8: (path, sha256, texto, paginas, chars_por_pagina, erro) of PDF files; unreadable ones have no text.

    Files are read in a child process of the task. One that breaks it, or takes more seconds or bytes of memory than
    it may, is a row with the reason, not a failed or stuck task; the child is killed and the next file gets a new one.
    read makes (text, pages) of a file's bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aside = Aside(read, seconds, memory)
        try:
            for b in batches:
                rows = []
                for path, content in zip(b["path"], b["content"]):
                    done, got = aside(bytes(content))
                    text, pages = got if done else ("", 0)
                    rows.append((path, hashlib.sha256(bytes(content)).hexdigest(), text, pages, len(text) / max(1, pages), None if done else got))
                yield pd.DataFrame(rows, columns=["path", "sha256", "texto", "paginas", "chars_por_pagina", "erro"])
        finally:
            aside.close()

    return documents.select("path", "content").mapInPandas(run, "path string, sha256 string, texto string, paginas int, chars_por_pagina double, erro string")


def listing(pages: DataFrame) -> DataFrame:
    """#12: (url, pos, href, titulo, tipo) of the links of HTML listings, in order.

    Irregular markup goes through the standard library's parser.
    """
    from html.parser import HTMLParser

    class Links(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.href, self.text = [], None, []

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.href, self.text = dict(attrs).get("href"), []

        def handle_data(self, data):
            if self.href is not None:
                self.text.append(data)

        def handle_endtag(self, tag):
            if tag == "a" and self.href is not None:
                self.found.append((self.href, " ".join("".join(self.text).split())))
                self.href = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for url, html in zip(b["url"], b["html"]):
                p = Links()
                p.feed(html or "")
                yield pd.DataFrame([(url, k, h, t) for k, (h, t) in enumerate(p.found)], columns=["url", "pos", "href", "titulo"])

    rows = pages.select("url", "html").mapInPandas(run, "url string, pos int, href string, titulo string")
    low = F.lower(F.coalesce("titulo", F.lit("")))
    kind = F.when(low.contains("ata"), "ata").when(low.contains("pauta"), "pauta").when(low.contains("voto"), "voto").when(low.contains("delibera"), "deliberacao").when(F.lower("href").endswith(".pdf"), "documento").otherwise("outro")
    return rows.withColumn("tipo", kind)
