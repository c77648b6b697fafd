"""Shared-folder tables, Arrow batch limits and text helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch; with whole texts, a batch stays at some MB.
ARROW_ROWS = 1000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quorumlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quorumlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that are still to be read must be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "none")).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a file, about, where the number of rows is known beforehand.
FILE_ROWS = 250_000


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage.

    rows, if known as an upper bound, sets the number of files, so that small tables are one file.
    """
    path = scratch(df.sparkSession, name)
    df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that table() wrote and that nothing reads any more."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """At most ARROW_ROWS rows an Arrow batch in this session; plans are lazy, so it can't be set back here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], stem: str) -> str:
    """A column name that clashes with none of columns, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def text_hash(column: str = "text"):
    return F.xxhash64(F.col(column))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, four bits at a time."""
    table = "list_transform(range(16), lambda i: list_reduce(range(4), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i))"
    digits = f"hex(encode({text}))"
    nibbles = f"list_transform(range(length({digits})), lambda i: instr('0123456789ABCDEF', {digits}[xor(i, 1) + 1]) - 1)"
    return f"xor(list_reduce({nibbles}, lambda c, b: xor(c >> 4, {table}[(xor(c, b) & 15) + 1]), 4294967295), 4294967295)"
