import pytest
from pyspark.sql import functions as F

from quorumlake.functions import extract as X


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Retirado de pauta, contra decisão que indeferiu", "Retirado de Pauta"), ("DECIDE indeferir o pedido", "Indeferido"), ("não prover o recurso", "Indeferido"), ("dar parcial provimento", "Parcialmente Deferido"),
        ("deferimento do pleito", "Deferido"), ("homologar o resultado", "Ratificado"), ("aprova a minuta", "Aprovado"), ("autoriza", "Autorizado"), ("determina o arquivamento", None), ("determinar", "Determinado"), (None, None),
    ],
)
def test_result(spark, text, want):
    assert one(spark, X.result, text) == want


@pytest.mark.parametrize("text, want", [("aprovado por  unanimidade", True), ("não houve unanimidade dos votos", False), ("não obstante a decisão por unanimidade", True), ("sem unanimidade; por unanimidade não", False), (None, False)])
def test_unanimity(spark, text, want):
    assert one(spark, X.unanimous, text) is want


def test_judgement_and_series(spark):
    assert one(spark, X.judgement, "decide não conhecer do recurso") == "admissibilidade"
    assert one(spark, X.judgement, "não conhecer e, no mérito, negar provimento") is None
    assert one(spark, X.series, "264ª Reunião Deliberativa Eletrônica") == "eletronica"
    assert one(spark, X.series, "Reunião de Diretoria") == "ordinaria" and one(spark, X.series, "Ata") is None


@pytest.mark.parametrize(
    "name, body, want",
    [("Voto DFQ 043-2026.pdf", "", "voto_individual"), ("x.pdf", "\n\nPAUTA da 3ª reunião", "pauta"), ("x.pdf", "ATA da reunião\nretirado de pauta", "ata"), ("x.pdf", "Deliberação nº 3", "deliberacao"), ("r.pdf", "RESOLUÇÃO nº 3", "resolucao"), (None, None, "deliberacao")],
)
def test_types(spark, name, body, want):
    assert one(spark, X.document_type, name, body) == want


def test_names(spark):
    assert one(spark, X.role_only, "Diretor-Geral") and not one(spark, X.role_only, "Diretor João")
    assert one(spark, X.strict_name, "Tasso Mendonça Jr") and not one(spark, X.strict_name, "Diretoria Colegiada") and not one(spark, X.strict_name, "voto por")
    text = "Impedido de votar o Diretor Caio Mário Seabra. Vencido o Diretor José de Souza Neto, nos termos."
    assert one(spark, X.recused, text) == ["Caio Mário Seabra."] or one(spark, X.recused, text) == ["Caio Mário Seabra"]
    assert one(spark, X.dissenting, text) == ["José de Souza Neto"]
    assert one(spark, X.recused, "não havia impedimento; impedido ninguém") == []
    assert one(spark, X.present, "presentes o Diretor Ana Lima Souza e a Diretora Rita Dias") == ["Ana Lima Souza", "Rita Dias"]


def test_small_fields(spark):
    assert one(spark, X.protocol, "SEI 48051.001234/2026-11 / pg. 2") == "48051.001234/2026-11"
    assert one(spark, X.repair_ligatures, "cole?vo e respec_vo") == "coletivo e respectivo"
    assert one(spark, X.broken_ligatures, "cole?vo") == 1
    broken = "subs7tuir Par,cipa ins!tuto re?rado Delibera,va obje?vo norma7vo administra?vo transmi?da polí?ca adi?vo compar?lhamento rela?vo des?nado inves?mento mo?va cole?vo respec?vo compe7?vo"
    fixed = "substituir Participa instituto retirado Deliberativa objetivo normativo administrativo transmitida política aditivo compartilhamento relativo destinado investimento motiva coletivo respectivo competivo"
    assert one(spark, X.repair_ligatures, broken) == fixed and one(spark, X.broken_ligatures, broken) == 19 and one(spark, X.broken_ligatures, fixed) == 0
    assert one(spark, X.repair_ligatures, "exposto,voto") == "exposto,voto"
    assert one(spark, lambda c: X.relevance(c, 1), "Custo-benefício e Decreto 10.411") == 67
    assert one(spark, lambda c: X.relevance(c, 2), "Consulta Pública e audiência pública") == 67
    df = spark.createDataFrame([("1", None, ["x"])], "numero_deliberacao string, processo string, signatarios array<string>")
    assert df.select(X.confidence(df.columns)).first()[0] == 0.26
    assert sum(X.CONFIDENCE.values()) == pytest.approx(1)


def test_item_votes(spark):
    from quorumlake.functions import item_votes as V

    def votes(text, general=None):
        r = one(spark, V.item_votes, text, general)
        return {d: list(r[d]) for d in (*V.DIRECTIONS, "impedido") if r[d]} | {k: r[k] for k in ("voto_qualidade_por", "aviso") if r[k]}

    assert votes("Ana Lima Souza – Favorável.\nRui Sá Reis – Contrário.") == {"favor": ["Ana Lima Souza"], "contra": ["Rui Sá Reis"]}
    assert votes("Votaram a favor os Diretores Caio Braga, Rita Dias e Otto Luz; votaram contra Eva Reis e Ata da Pauta") == {"favor": ["Caio Braga", "Rita Dias", "Otto Luz"], "contra": ["Eva Reis"]}
    assert votes("Caio Braga – Favorável. O Diretor Caio Braga votou contrariamente. O Diretor Caio Braga se absteve.") == {"abstencao": ["Caio Braga"]}
    assert votes("Voto do Revisor, Diretor Caio Braga, aprovado por maioria, vencido o Diretor Caio Braga.") == {"aviso": True}
    assert votes("aprovado, com voto contrário do Diretor-Geral, relator original", "Ana Lima") == {"contra": ["Ana Lima"]}
    assert votes("com divergência apresentada pelo Diretor-Geral em relação ao tema", None) == {"aviso": True}
    assert votes("voto de qualidade proferido pelo Diretor Otto Luz. O Diretor Rui Reis, este não participou da votação.\nRui Reis – Favorável.") == {"favor": ["Otto Luz"], "impedido": ["Rui Reis"], "voto_qualidade_por": "Otto Luz", "aviso": True}
    assert votes("O Diretor Rui Reis acompanhou a manifestação técnica e divergiu da área técnica") == {"aviso": True}
    assert votes("não havia impedimento a que o Diretor Rui Reis não votou") == {} and votes(None) == {}
    assert one(spark, V.chair, "reunião presidida pelo Diretor-Geral, Ana Lima e demais") == "Ana Lima" and one(spark, V.chair, "nada") is None


def test_prevailing_vote(spark):
    from quorumlake.operators import readings as R

    text = "VOTO DO RELATOR: nega.\nVOTO DO PRIMEIRO REVISOR, Rui: acolhe.\nVoto da Segunda Revisora: retira.\nDELIBERAÇÃO: x"
    said = lambda d: one(spark, R.prevailing, text, d)
    assert said("Voto do Relator aprovado").strip() == "nega." and said(None).strip() == "nega."
    assert said("voto do Primeiro Revisor aprovado").strip() == "acolhe." and said("Voto do revisor aprovado").strip() == "retira." and said("Voto do quarto revisor").strip() == "retira."
    assert one(spark, R.prevailing, "Decisão: aprovado", "voto do revisor") is None and one(spark, R.prevailing, None, None) is None


def test_names_of_files(spark):
    from quorumlake.functions import charset

    def read(raw):
        return spark.createDataFrame([(bytearray(raw),)], "b binary").select(charset.decoded(F.col("b")).alias("d")).first()["d"]

    for name in ("Decisão nº 3.pdf", "Ação & 100% +1.pdf", "ata.pdf"):
        for page in ("utf-8", "cp1252", "cp850", "latin-1"):
            assert read(name.encode(page))["nome"] == name, (name, page)
        assert read(name.encode().decode("latin-1").encode())["nome"] == name
    assert read("Ata ordin%C3%A1ria%202.pdf".encode())["nome"] == "Ata ordinária 2.pdf" and read(b"Ata ordin%E1ria.pdf")["nome"] == "Ata ordinária.pdf"
    assert read("DELIBERAÇÃO".encode("latin-1"))["codificacao"] == "latin-1" and read(b"")["nota"] == 0.0
    assert spark.sql("select cast(null as binary) b").select(charset.decoded(F.col("b")).alias("d")).first()["d"] is None


def test_repair_asks_sources_in_turn(spark):
    """A row that one source repairs isn't asked of the next: its later source would say otherwise."""
    from quorumlake.operators import readings as R

    child = "id long, pai_id long, item_numero string, numero_deliberacao string, resultado string, resumo_pleito string"
    rows = [(1, 9, "1.1", None, None, None), (2, 9, "1.2", None, "", "Processo re%rado de pauta"), (3, 9, "1.3", "PAUTA-3", None, None), (4, 9, "1.4", None, "Deferido", None), (5, 9, "1.5", None, None, "nada"), (6, None, None, None, None, None)]
    stored = [(9, "1.1", "Deferido", "x"), (9, "1.2", None, None), (9, "1.3", "Deferido", None)]
    again = [(9, f"1.{k}", "Indeferido", "y") for k in range(1, 6)] + [(9, "1.5", "Aprovado", "z")]
    item = "pai_id long, item_numero string, resultado string, decisao string"
    got = R.repair_items(spark.createDataFrame(rows, child), spark.createDataFrame(stored, item), spark.createDataFrame(again, item)).collect()
    assert {r["id"]: (r["resultado"], r["degrau"], r["resumo_pleito"]) for r in got} == {1: ("Deferido", "array", "x"), 2: ("Retirado de Pauta", "ligadura", "Processo re%rado de pauta"), 5: ("Indeferido", "resplit", "nada")}


def test_one_false_date_shuts_a_listing(spark):
    from quorumlake.operators import readings as R

    row = "fonte string, numero string, data string"
    listing = spark.createDataFrame([("a", "1.024ª", "d1"), ("a", "2ª", "d2"), ("b", "1", "d1"), ("b", "2", "d9"), ("c", "1", "d1"), ("e", "3", "d1"), ("e", "3ª", "d2"), ("e", "4", "d4")], row)
    checked = spark.createDataFrame([("a", "1024", "d1"), ("b", "1", "d1"), ("b", "2", "d2"), ("d", "1", "d1"), ("e", "4", "d4")], row)
    assert {r["fonte"]: r["motivo"] for r in R.listing_gate(listing, checked).collect()} == {"a": "aprovado", "b": "divergencia", "c": "sem_ata_para_conferir", "d": "listagem_vazia", "e": "aprovado"}
    got = R.dates_by_listing(listing.select("fonte", "numero"), listing, checked).collect()
    assert {(r["fonte"], r["numero"]): r["data_listagem"] for r in got if r["data_listagem"]} == {("a", "1.024ª"): "d1", ("a", "2ª"): "d2", ("e", "4"): "d4"}


def test_fields_of_a_document(spark):
    from quorumlake.functions import fields

    text = (
        "DELIBERAÇÃO ARTESP Nº 66, DE 22 DE MARÇO DE 2026\n1.024ª Reunião Extraordinária\nPROCESSOS Nº: 50500.1/2026; 7\nRequerente: Rodovias  do Tiete S.A., que solicita autorização\n"
        "Ementa: reajuste de tarifa básica\nTrata-se de pedido de reajuste da tarifa básica de pedágio.\n\nAna Lima Souza - Diretora-Geral\nRUI SÁ REIS\nDiretor\nDocumento assinado eletronicamente por Eva Dias Melo - Diretora"
    )
    df = spark.createDataFrame([(text,), (None,), ("",)], "c string")
    got, null, empty = df.select(*[v.alias(k) for k, v in fields.fields(F.col("c")).items()]).collect()
    assert got["numero_deliberacao"] == "66" and got["numero_reuniao"] == "1.024" and got["tipo_reuniao"] == "Extraordinaria" and str(got["data_reuniao"]) == "2026-03-22"
    assert got["processo"] == "50500.1/2026" and got["interessado"] == "Rodovias do Tiete S.A." and got["assunto"] == "reajuste de tarifa básica" and got["relator"] is None
    assert got["resumo_pleito"].startswith("Trata-se de pedido") and got["signatarios"] == ["Ana Lima Souza", "RUI SÁ REIS"] and not got["pauta_interna"]
    for r in (null, empty):
        assert r["signatarios"] == [] and r["pauta_interna"] and all(r[c] is None for c in ("numero_deliberacao", "data_reuniao", "processo", "interessado", "assunto", "resumo_pleito"))
    assert str(one(spark, fields.day, "citada em 14 de novembro de 1996; realizada em 3 de maio de 2025")) == "2025-05-03" and one(spark, fields.day, "32 de maio de 2025") is None
    assert one(spark, fields.on_record, "já havia sido proferido o voto do relator original, Diretor Caio Mário Seabra, acompanhado pelo então Diretor Rui Sá Reis") == ["Caio Mário Seabra", "Rui Sá Reis"]
    w = one(spark, fields.withdrawal, "Processo retirado de pauta pelo Diretor Caio Mário Seabra, nos termos do art. 55 do Regimento Interno")
    assert (w["autor"], w["fundamento"]) == ("Caio Mário Seabra", "art. 55 do Regimento Interno") and one(spark, fields.withdrawal, "aprovado") is None


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_decoded_once(spark):
    """Each step stands once in the plan; a copy in each place that uses it made a row take over a millisecond."""
    from quorumlake.functions import charset

    raws = ["Órgão 7.pdf".encode(), b"%C3%93rg%C3%A3o%207%zz%.pdf", "Órgão".encode("cp850"), "Órgão".encode().decode("latin-1").encode(), b"%d3rg%E3o", b"", b"%", b"a%\n%41%", None]
    df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(raws)], "k int, b binary")
    out = df.select("k", charset.decoded(F.col("b")).alias("d")).select("k", "d.nome", "d.codificacao")
    assert plan_of(out).count("unhex(") == 1
    assert [tuple(r)[1:] for r in sorted(out.collect())] == [
        ("Órgão 7.pdf", "utf-8"), ("Órgão 7%zz%.pdf", "utf-8"), ("Órgão", "cp850"), ("Órgão", "utf-8 duas vezes"), ("Órgão", "latin-1"), ("", "utf-8"), ("%", "utf-8"), ("a%\nA%", "utf-8"), (None, None),
    ]


def test_blocks_of_votes_are_read_once(spark):
    from quorumlake.operators import readings as R

    df = spark.createDataFrame([("VOTO DO RELATOR: nega.\nVOTO DO REVISOR: dar provimento\n", "Voto do revisor aprovado")], "a string, d string")
    out = df.select(R.prevailing(F.col("a"), F.col("d")).alias("p"))
    assert plan_of(out).count("regexp_extract_all(") == 1 and out.first()["p"].strip() == "dar provimento"
    words = df.select(R.item_result(F.col("a"), X.unanimous(F.col("a"))).alias("r"))
    assert plan_of(words).count("translate(") <= 3 and words.first()["r"] == "Deferido"


def test_items_are_searched_once(spark):
    """Recusals and casting votes stand once in the plan, and parts of a text give what the whole one did."""
    from quorumlake.functions import item_votes as V

    text = "Caio Braga – Contrário; O Diretor Rui Reis. divergiu do Relator, Eva Dias\nacompanhou o voto do\nRelator. Ausente: o Diretor Otto Luz. Ana Lima absteve-se"
    out = spark.createDataFrame([(text,)], "t string").select(V.item_votes(F.col("t")).alias("v"))
    plan = plan_of(out)
    assert plan.count("encontrava-se") == 1 and plan.count("voto\\s+de\\s+qualidade)[^.]") == 1
    r = out.first()["v"]
    assert [list(r[d]) for d in (*V.DIRECTIONS, "impedido")] == [["Eva Dias"], ["Caio Braga", "Rui Reis"], ["Ana Lima"], ["Otto Luz"], []]
