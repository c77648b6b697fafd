import datetime

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import predicates as P

ROWS = [
    # id, tipo, pai, resultado, juizo, conta, microtema
    (1, "deliberacao", None, "Deferido", None, None, None),
    (2, "deliberacao", None, "Indeferido", None, True, "multa"),
    (3, "deliberacao", None, "Retirado de Pauta", None, None, "multa"),
    (4, "deliberacao", None, "Deferido", "admissibilidade", None, None),
    (5, "deliberacao", None, None, "admissibilidade", None, None),
    (6, "deliberacao", None, None, None, None, "multa"),
    (7, "ata", None, "Deferido", None, None, None),
    (8, "ata", 7, "Deferido", None, None, None),
    (9, "ata", 7, None, None, None, None),
    (10, "pauta", None, "Deferido", None, None, None),
    (11, None, None, "Deferido", None, None, None),
    (12, "portaria", None, "", None, False, None),
    (13, "resolucao", None, "", None, None, None),
]
SCHEMA = "id int, tipo_documento string, documento_pai_id int, resultado string, juizo string, import_counts_as_final boolean, microtema string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_id(df, column):
    return {r["id"]: r["x"] for r in df.select("id", column.alias("x")).collect()}


def test_final(rows):
    final = by_id(rows, P.is_final())
    assert {k for k, v in final.items() if v} == {1, 2, 3, 4, 5, 6, 8, 13}
    assert None not in final.values()


def test_discards(rows):
    why = by_id(rows, P.discard_reason())
    assert (why[7], why[9], why[10], why[11], why[12]) == ("ata_envelope", "sem_resultado_extraido", "tipo_nao_final", "outro", "outro")
    assert why[1] is None


def test_states(rows):
    s = by_id(rows, P.status())
    assert [s[k] for k in (1, 3, 4, 5, 6, 13)] == ["decidido", "retirado", "admissibilidade", "admissibilidade", "sem_resultado", "sem_resultado"]


def test_positive_and_sanction(rows):
    assert {k for k, v in by_id(rows, P.is_positive()).items() if v} == {1, 4, 7, 8, 10, 11}
    assert {k for k, v in by_id(rows, P.is_sanction()).items() if v} == {2, 3, 6}


@pytest.mark.parametrize(
    "votes, want",
    [([], None), ([("Ausente", False)], None), ([("Favoravel", False), ("Ausente", True)], True), ([("Favoravel", False), ("Desfavoravel", True)], False), ([(None, None)], True)],
)
def test_consensus(spark, votes, want):
    df = spark.createDataFrame([(1, None, None, None)] if not votes else [(1, k, t, d) for k, (t, d) in enumerate(votes)], "g int, v int, tipo string, div boolean")
    assert df.groupBy("g").agg(P.consensus(F.col("v"), F.col("div"), F.col("tipo")).alias("c")).first()["c"] is want


def test_divergence(spark):
    cases = [
        ("Ausente", "Deferido", False), ("Abstencao", None, True), ("Desfavoravel", "Deferido", True), ("Favoravel", "Deferido", False), ("Favoravel", "Indeferido", True),
        ("Desfavoravel", "Indeferido", False), ("Desfavoravel", None, True), ("Favoravel", "Retirado de Pauta", False),
    ]
    df = spark.createDataFrame(cases, "tipo_voto string, resultado string, want boolean").withColumn("got", P.is_divergent())
    assert df.where("got <> want or got is null").count() == 0
    assert df.withColumn("u", P.is_divergent(unanime=F.lit(True))).where("u").count() == 0


def test_nominal(spark):
    cases = [("nominal", False, True), ("revisao_humana", False, True), (None, True, True), (None, None, False), ("inferido_decisao", True, False)]
    df = spark.createDataFrame(cases, "proveniencia string, is_nominal boolean, want boolean").withColumn("got", P.is_nominal())
    assert df.where("got <> want").count() == 0


def test_year_keeps_undated(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2025, 1, 1), None), (2, None, d(2026, 2, 1)), (3, None, None), (4, d(2026, 1, 1), d(2025, 1, 1))], "id int, data_reuniao date, data_publicacao date")
    assert {r["id"] for r in df.where(P.in_year(2026)).collect()} == {2, 3, 4}


def test_rates_are_null_without_a_base(spark):
    row = spark.range(1).select(P.rate(F.lit(0), F.lit(0)).alias("a"), P.rate(F.lit(1), F.lit(4)).alias("b")).first()
    assert row["a"] is None and row["b"] == 25.0
