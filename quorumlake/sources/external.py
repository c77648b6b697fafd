"""What lies outside: pages to fetch and images to read, through functions that the caller gives.

An engine has no network of its own. `get` and `ocr` are plain functions of one request or file; rows go
in, rows come out, and what fails is a row with its reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Answers that are asked for again.
AGAIN = (429, 500, 502, 503, 504)


def fetched(urls: DataFrame, get: Callable[[str], tuple[int, bytes, float | None]], per_host: int = 2, tries: int = 3, wait: float = 0.5, longest: float = 10.0, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """#16: (url, status, content, tries) of urls (url).

    get returns status, bytes and the seconds that Retry-After asks for. A host's requests are dealt to
    per_host slots, each of which one task goes through in turn, so that no host sees more at a time.
    Waits double from `wait`, or are what the host asks for, up to `longest`. A status of 0 is an error.
    """
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    dealt = urls.select("url").distinct().withColumn("host", host).withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(per_host)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                for n in range(1, tries + 1):
                    try:
                        status, content, after = get(url)
                    except OSError:
                        status, content, after = 0, b"", None
                    if n == tries or (status and status not in AGAIN):
                        break
                    pause(min(longest, wait * 2 ** (n - 1) if after is None else after))
                rows.append((url, status, content, n))
            yield pd.DataFrame(rows, columns=["url", "status", "content", "tries"])

    return dealt.repartition("host", "slot").mapInPandas(run, "url string, status int, content binary, tries int")


def with_ocr(texts: DataFrame, ocr: Callable[[bytes], str], least: float = 40.0) -> DataFrame:
    """#9: texts (path, content, texto, chars_por_pagina) where files with under `least` characters a page
    get the text of ocr, and `origem` says which; an ocr that fails leaves the text as it was."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                return ocr(bytes(data))
            except (OSError, ValueError):
                return None

        return content.map(one)

    poor = texts.where(F.coalesce("chars_por_pagina", F.lit(0.0)) < least)
    poor = poor.withColumn("lido", read("content"))
    poor = poor.withColumn("origem", F.when(F.col("lido").isNotNull(), "ocr").otherwise("pdf")).withColumn("texto", F.coalesce("lido", "texto")).drop("lido")
    return poor.unionByName(texts.where(F.coalesce("chars_por_pagina", F.lit(0.0)) >= least).withColumn("origem", F.lit("pdf")))
