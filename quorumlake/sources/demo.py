"""A synthetic source, for tests and demonstrations (#6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decisions(spark: SparkSession, rows: int | DataFrame = 1000, seed: int = 1) -> DataFrame:
    """Decisions whose fields are drawn by hashes of their id and the seed: any part can be made again. rows is how many, or their ids (id)."""
    digest = lambda salt: F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(salt)).cast("binary"))
    draw = lambda n, salt: F.conv(F.substring(digest(salt), 1, 8), 16, 10).cast("long") % n
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (draw(len(values), salt) + 1).cast("int"))
    return (rows if isinstance(rows, DataFrame) else spark.range(rows)).select(
        "id", (draw(3, "a") + 1).alias("agencia_id"), pick(("deliberacao", "ata", "pauta"), "t").alias("tipo_documento"), F.when(draw(3, "p") == 0, F.col("id") - 1).alias("documento_pai_id"),
        F.date_add(F.to_date(F.lit("2026-01-01")), draw(365, "d").cast("int")).alias("data_reuniao"), pick(("Deferido", "Indeferido", "Retirado de Pauta"), "r").alias("resultado"),
        F.lit(None).cast("string").alias("juizo"), F.lit(None).cast("boolean").alias("import_counts_as_final"), pick(("multa", "tarifa", "obras"), "m").alias("microtema"),
    )


def next_page(html, base: str = "") -> F.Column:
    """#15: the address of a listing's next page, by rel, class or label; null on the last."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (
        r"""(?i)<a[^>]*rel=["']next["'][^>]*href=["']([^"']+)""", r"""(?i)<a[^>]*href=["']([^"']+)["'][^>]*rel=["']next["']""", r"""(?i)<a[^>]*href=["']([^"']+)["'][^>]*>\s*(?:Próxim[ao]|Seguinte|&raquo;|»)""",
    )])
    return F.when(found.startswith("http") | F.lit(not base), found).otherwise(F.concat(F.lit(base), found))
