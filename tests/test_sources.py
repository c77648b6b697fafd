import datetime
import io
import zipfile
import zlib

from pyspark.sql import functions as F

from quorumlake.operators import events, ordering, quality, votes
from quorumlake.sources import files, items, tables
from quorumlake.streaming import ingest


def pdf(text: str) -> bytes:
    body = zlib.compress(b"BT (" + text.encode("latin-1") + b") Tj ET")
    return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\nstream\n" + body + b"\nendstream\n%%EOF"


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(r"Delibera\347\343o \(1\)"))
    (tmp_path / "b.html").write_bytes(b"<!DOCTYPE html><html></html>")
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x/voto.pdf", pdf("voto"))
        z.writestr("leia.txt", "no")
    (tmp_path / "c.zip").write_bytes(raw.getvalue())
    (tmp_path / "d.zip").write_bytes(b"PK broken")
    found = files.files(spark, f"file://{tmp_path}")
    assert {r["path"].rsplit("/", 1)[1]: r["kind"] for r in found.collect()} == {"a.pdf": "pdf", "b.html": "html", "broken.pdf": "pdf", "c.zip": "zip", "d.zip": "zip"}
    texts = {r["path"].rsplit("/", 1)[1]: (r["texto"], r["paginas"]) for r in files.pdf_texts(found.where("kind = 'pdf'")).collect()}
    assert texts == {"a.pdf": ("Deliberação (1)", 1), "broken.pdf": ("", 0)}
    assert [(r["entry"], r["truncated"]) for r in files.zip_entries(found).collect()] == [("x/voto.pdf", False)]
    assert [(r["entry"], r["truncated"]) for r in files.zip_entries(found, most=0).collect()] == [(None, True)]

    def slow(content):
        import time

        time.sleep(30)
        return "never", 1

    late = files.pdf_texts(found.where("kind = 'pdf'"), seconds=0.2, read=slow).collect()
    assert len(late) == 2 and all(r["texto"] == "" and r["paginas"] == 0 and r["erro"] == "out of time" for r in late)


def test_a_reader_that_is_stuck_in_native_code_is_killed(spark):
    """One call into the regex engine that never comes back, one that ends the process, one that takes too much memory: each is a row, and the next files are read."""
    rows = [("a", b"good"), ("b", b"stuck"), ("c", b"good"), ("d", b"gone"), ("e", b"large"), ("f", b"bad"), ("g", b"good")]

    def read(content):
        import os
        import re

        if content == b"stuck":
            re.match(r"(a+)+$", "a" * 200 + "b")
        if content == b"gone":
            os._exit(3)
        if content == b"large":
            return "x" * (16 << 30), 1
        if content == b"bad":
            raise ValueError("no PDF")
        return content.decode(), 1

    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").coalesce(1)
    got = {r["path"]: (r["texto"], r["erro"] and r["erro"].split(":")[0]) for r in files.pdf_texts(df, 0.5, read, memory=8 << 30).collect()}
    assert got == {"a": ("good", None), "b": ("", "out of time"), "c": ("good", None), "d": ("", "died"), "e": ("", "MemoryError"), "f": ("", "ValueError"), "g": ("good", None)}


def test_fetching_and_reading_images(spark):
    from quorumlake.sources import external

    def get(url):
        if "down" in url:
            raise OSError("no route")
        return (503, b"", 0.0) if "busy" in url else (404, b"", None) if "none" in url else (200, url.encode(), None)

    urls = spark.createDataFrame([(u,) for u in ("http://a/1", "http://a/busy", "http://b/none", "http://b/down", "http://a/1", "no host")], "url string")
    got = {r["url"]: (r["status"], bytes(r["content"]), r["tries"]) for r in external.fetched(urls, get, pause=lambda s: None).collect()}
    assert got == {"http://a/1": (200, b"http://a/1", 1), "http://a/busy": (503, b"", 3), "http://b/none": (404, b"", 1), "http://b/down": (0, b"", 3), "no host": (200, b"no host", 1)}

    def ocr(data):
        if data == b"bad":
            raise ValueError
        return "read " + data.decode()

    texts = spark.createDataFrame([("a", b"x", "", 0.0), ("b", b"bad", "", None), ("c", b"y", "long", 400.0)], "path string, content binary, texto string, chars_por_pagina double")
    got = {r["path"]: (r["texto"], r["origem"]) for r in external.with_ocr(texts, ocr).collect()}
    assert got == {"a": ("read x", "ocr"), "b": ("", "pdf"), "c": ("long", "pdf")}


def test_listing(spark):
    page = "<ul><li><a href='/a.pdf'>Ata <b>da 3ª</b></a><li><a href=\"/x\">Pauta</a><a>none</a></ul>"
    df = spark.createDataFrame([("u", page), ("v", None)], "url string, html string")
    assert [(r["pos"], r["href"], r["titulo"], r["tipo"]) for r in files.listing(df).orderBy("pos").collect()] == [(0, "/a.pdf", "Ata da 3ª", "ata"), (1, "/x", "Pauta", "pauta")]


def test_items_of_minutes():
    text = """ATA DA REUNIÃO
Processo: 1.1/2020 before any item
I- Processo: 123.4/2020; Interessado: Via Sul Ltda.
Assunto: Revisão
Decisão: deferido por unanimidade.
MATÉRIAS
2.1 Assunto: Multas
Deliberação: aprovar
2.1.1. Processo nº 50500.1/2020
Interessada: A
2.1.2) - Processos nº: 50500.2/2020
Decisão: pedido de vista
3. Diretor Geral
not an item
4.1
Interessado: B
4.1
Interessado: B
Decisão: indeferir
5.2 Relator: only a rapporteur
6.1 Prose that goes on
Encerramento
II - Processo: 9.9 """
    got = [(i["item_numero"], i["processo"], i["interessado"], i["assunto"], i["decisao"], i["resultado"]) for i in items.split_items(text)]
    assert got == [
        ("I", "123.4/2020", "Via Sul Ltda", "Revisão", "deferido por unanimidade", "Deferido"),
        ("2.1.1", "50500.1/2020", "A", "Multas", "aprovar", "Aprovado"),
        ("2.1.2", "50500.2/2020", None, "Multas", "pedido de vista", "Retirado de Pauta"),
        ("4.1", None, "B", None, "indeferir", "Indeferido"),
        ("II", "9.9", None, None, None, None),
    ]
    assert items.split_items(None) == items.split_items("") == []


def test_items_table(spark):
    df = spark.createDataFrame([("f", "I- Processo: 123.4/2020\nDecisão: deferido"), ("g", None)], "file string, text string")
    assert [(r["file"], r["resultado"]) for r in items.items(df).collect()] == [("f", "Deferido")]


def test_upserts(spark):
    held = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, x string")
    got = sorted(map(tuple, tables.upsert(held, new, ["k"], [F.desc("x")]).collect()))
    assert got == [(1, "a", 1), (2, "c", None), (3, "e", None)]
    assert sorted(map(tuple, tables.insert_missing(held, new, ["k"], ["x"]).collect())) == [(1, "a", 1), (2, "b", None), (3, "d", None)]
    assert sorted(map(tuple, tables.update_by_id(held, "k", new, y=7).collect())) == [(1, "a", 1), (2, "b", 7)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'a "b"'), (None, "x;y")], "a string, b string")
    assert [r["linha"] for r in tables.csv_lines(df, {"a": "A", "b": "B"}).collect()] == ["\"'=1+1\";\"a \"\"b\"\"\"", '"";"x;y"']
    tables.write_csv(df, f"file://{tmp_path}/out", {"b": "Título"})
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert text.startswith('"Título"\r\n') and '"x;y"\r\n' in text


def test_protected_upsert(spark):
    schema = "deliberacao_id int, diretor_id int, tipo_voto string, nominal boolean"
    held = spark.createDataFrame([(1, 1, "Desfavoravel", True), (1, 2, "Favoravel", False)], schema)
    new = spark.createDataFrame([(1, 1, "Favoravel", False), (1, 2, "Abstencao", True), (1, 3, "Favoravel", False)], schema)
    assert sorted(map(tuple, votes.upsert_votes(held, new).collect())) == [(1, 1, "Desfavoravel", True), (1, 2, "Abstencao", True), (1, 3, "Favoravel", False)]


def test_vote_precedence(spark):
    decisions = spark.createDataFrame([(1, "Deferido", True, True), (2, "Indeferido", False, True), (3, "Retirado de Pauta", False, True)], "deliberacao_id int, resultado string, unanimidade boolean, inferir boolean")
    named = spark.createDataFrame(
        [(1, 10, "favor", 0.9), (1, 10, "impedido", 0.9), (1, 11, "contra", 0.7), (1, 12, "favor", 0.7), (2, 10, "favor", 1.0), (2, 11, "abstencao", 0.95)], "deliberacao_id int, diretor_id int, lista string, score double"
    )
    board = spark.createDataFrame([(d, k) for d in (1, 2, 3) for k in (10, 11, 12, 13)], "deliberacao_id int, diretor_id int")
    got = {(r["deliberacao_id"], r["diretor_id"]): r for r in votes.build_votes(decisions, named, board).collect()}
    assert set(got) == {(1, 10), (1, 12), (1, 13), (2, 10), (2, 11), (2, 12), (2, 13)}
    assert (got[1, 10]["tipo_voto"], got[1, 10]["motivo_nao_voto"]) == ("Ausente", "impedimento")
    assert got[1, 12]["proveniencia"] == "inferido_unanimidade" and not got[1, 12]["is_nominal"]
    assert got[2, 10]["is_divergente"] and got[2, 11]["is_divergente"]
    assert got[2, 13]["tipo_voto"] == "Desfavoravel" and not got[2, 13]["is_divergente"]


def test_text_rules(spark):
    rows = spark.createDataFrame(
        [
            (1, "não conhecer do recurso", "X", "Indeferido", None), (2, "voto de qualidade e voto de qualidade", None, None, None), (3, "a empresa Outra Ltda. requer", "Via Sul Rodovias", "Deferido", None),
            (4, "beneﬁcio", None, None, None), (5, None, None, None, None),
        ],
        "id int, texto string, interessado string, resultado string, juizo string",
    )
    got = {(r["id"], r["codigo"][:3]) for r in quality.text_findings(rows).collect()}
    assert got == {(1, "C11"), (2, "C08"), (3, "C09"), (4, "C13")}


def test_capacity_and_dates(spark):
    row = spark.range(1).select(
        votes.nominal_capacity(F.lit("antt"), F.lit("ata")).alias("a"), votes.nominal_capacity(F.lit("ZZ"), F.lit(None)).alias("b"),
        votes.plausible_date(F.lit("ANM"), F.to_date(F.lit("2016-05-01")), 2026).alias("c"), votes.plausible_date(F.lit(None).cast("string"), F.to_date(F.lit("2016-05-01")), 2026).alias("d"),
    ).first()
    assert tuple(row) == ("nenhum", "parcial", False, True)


def test_rotation():
    assert [ordering.rotating_window(25, 10, m) for m in (0, 1, 2, 3, -1)] == [(0, 10), (10, 20), (20, 25), (0, 10), (20, 25)]
    assert ordering.rotating_window(0, 10, 3) == (0, 0)


def test_mute_source(spark):
    days = [datetime.date(2026, 1, d) for d in range(1, 8)]
    runs = spark.createDataFrame([("s", d, n) for d, n in zip(days, (20, 22, 21, 0, 0, 0, 30))], "site string, dia date, n long")
    got = [r["sinal"] for r in events.signals(runs).orderBy("dia").collect()]
    assert got[3] == "queda_de_volume" and got[5] == "fonte_muda" and got[6] is None


def test_ingest_is_idempotent(spark, tmp_path):
    ts = datetime.datetime
    schema = "site string, hash string, ts timestamp"
    landing, seen = f"file://{tmp_path}/in", []
    spark.createDataFrame([("s", "a", ts(2026, 1, 1)), ("s", "b", ts(2026, 1, 2))], schema).coalesce(1).write.parquet(landing)
    store = ingest.ItemStore(spark, f"file://{tmp_path}/items")

    def poll():
        q = ingest.run_ingest(ingest.source(spark, landing, schema), store, f"file://{tmp_path}/check", lambda new, k: seen.append(sorted(r["hash"] for r in new.collect())))
        q.awaitTermination()

    poll()
    spark.createDataFrame([("s", "b", ts(2026, 1, 5)), ("s", "c", ts(2026, 1, 4))], schema).coalesce(1).write.mode("append").parquet(landing)
    poll()
    poll()
    assert seen == [["a", "b"], ["c"]]
    got = {r["hash"]: (r["first_seen_at"].day, r["last_seen_at"].day) for r in store.read().collect()}
    assert got == {"a": (1, 1), "b": (2, 5), "c": (4, 4)}
    store.apply(spark.createDataFrame([("s", "b", ts(2026, 1, 5)), ("s", "c", ts(2026, 1, 4))], schema), 1)
    assert {r["hash"] for r in store.read().collect()} == {"a", "b", "c"}


def test_reaper(spark):
    ts = datetime.datetime
    log = spark.createDataFrame(
        [(1, "queued", ts(2026, 1, 1, 0)), (1, "processing", ts(2026, 1, 1, 1)), (2, "processing", ts(2026, 1, 1, 5, 50)), *[(3, "processing", ts(2026, 1, 1, h)) for h in (1, 2, 3)], (4, "confirmed", ts(2026, 1, 1))],
        "job_id int, status string, ts timestamp",
    )
    got = {r["job_id"]: r["desfecho"] for r in ingest.queue_state(log, F.to_timestamp(F.lit("2026-01-01 06:00:00"))).collect()}
    assert got == {1: "pending", 2: "processing", 3: "failed", 4: "confirmed"}


def test_streams_compile(spark, tmp_path):
    df = ingest.source(spark, f"file://{tmp_path}", "site string, hash string, ts timestamp")
    for x in (ingest.distinct_items(df), ingest.windowed_counts(df)):
        assert x.isStreaming


def test_demo_and_next_page(spark):
    from quorumlake.functions import predicates as P
    from quorumlake.sources import demo

    df = demo.decisions(spark, 200)
    assert df.count() == 200 and 0 < df.where(P.is_final()).count() < 200
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, demo.decisions(spark, 200).collect()), key=repr)
    pages = spark.createDataFrame([('<a href="/p2" rel="next">x</a>',), ("<a class='b' href='http://h/p3'> Próxima</a>",), ("<a href='/x'>Ata</a>",)], "html string")
    assert [r[0] for r in pages.select(demo.next_page(F.col("html"), "http://h")).collect()] == ["http://h/p2", "http://h/p3", None]


def test_filters_ignore_what_is_malformed():
    from quorumlake.operators.audit import Filters

    f = Filters.parse({"agencia_id": "1 or 1", "microtema": "a'b", "date_from": "hoje", "date_to": "2026-01-01", "numero_reuniao": "1" * 30, "origem": "x"})
    assert f == Filters(last="2026-01-01", number="1" * 10)
