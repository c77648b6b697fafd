"""Table sources and sinks: typed scans, upserts and semicolon CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """#1, #2: a whole table with projection and filter pushed down; nothing is cut off silently."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def replace_view(spark: SparkSession, rows: list | DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """#4: a small array, or rows that are a table already, as a view; what it held before is gone."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df


def update_by_id(df: DataFrame, key: str, ids: DataFrame, **values) -> DataFrame:
    """#5, #24: rows whose key is in ids take the values."""
    hit = df.join(ids.select(key).distinct().withColumn("hit__", F.lit(True)), key, "left")
    out = hit.select(*[F.when(F.col("hit__"), F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
    return out


def upsert(held: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """#21: rows of new replace those of held with their key. Of several new rows of a key the first by
    order counts; columns that a side lacks are null there and never overwrite."""
    if order:
        new = new.withColumn("n__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n__ = 1").drop("n__")
    else:
        new = new.dropDuplicates(key)
    rest = [c for c in held.columns if c not in key]
    j = held.alias("h").join(new.alias("n"), key, "full")
    return j.select(*key, *[(F.coalesce(F.col(f"n.{c}"), F.col(f"h.{c}")) if c in new.columns else F.col(f"h.{c}")).alias(c) for c in rest])


def insert_missing(held: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """#23: ON CONFLICT DO NOTHING of the first new row of each key."""
    first = new.withColumn("n__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n__ = 1").drop("n__")
    return held.unionByName(first.join(held.select(*key), key, "left_anti"), allowMissingColumns=True)


def touched(df: DataFrame) -> DataFrame:
    """#27."""
    return df.withColumn("updated_at", F.current_timestamp())


def csv_cell(c: Column) -> Column:
    """A quoted cell; what a spreadsheet would take for a formula gets an apostrophe."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike("^[=+@\\-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """#18: a column `linha` of semicolon-separated quoted cells of the labelled columns."""
    return df.select(F.concat_ws(";", *[csv_cell(F.col(c)) for c in labels]).alias("linha"))


def write_csv(df: DataFrame, path: str, labels: dict[str, str]) -> None:
    """#17, #19: semicolon CSV with labelled columns, quoted, CRLF, for spreadsheets; part files each
    with a header. It writes all rows; a limit is the caller's to state."""
    out = df.select(*[F.col(c).cast("string").alias(label) for c, label in labels.items()])
    out.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").csv(path)
