"""Numbered markers in a shared folder: small JSON documents of which each number is written once, by whoever is first."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Markers:
    """A folder of documents 0, 1, 2, ...: reading gives the last one, and of two writers of a number one wins.

    A document is written aside and then renamed, which fails where the name is taken, so that no one reads half of
    one. Old documents are kept for those who still read by them, KEPT at least.
    """

    KEPT = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        p, fs = self._at("")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        p, fs = self._at(f"{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The last number and its document; -1 and nothing if there is none."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (-1, {})

    def put(self, number: int, document: dict) -> bool:
        """Whether this document became that number; False if another one is."""
        draft, fs = self._at(f"draft-{uuid.uuid4().hex}")
        final, _ = self._at(f"{number:012d}.json")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        finally:
            out.close()
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise e
        for n in self.numbers()[: -self.KEPT]:
            fs.delete(self._at(f"{n:012d}.json")[0], False)
        return True
