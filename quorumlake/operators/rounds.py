"""Rounds of work under a budget, corrected data, status snapshots, and the table sinks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators import votes
from quorumlake.operators.analytics import final
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star, shared_folder
from quorumlake.sources import demo, tables

#: Seconds that a lane has in a round, and what is kept back for the step that ends it.
BUDGET, RESERVE = 66, 6


def remaining(spent: Column, budget: float = BUDGET, reserve: float = RESERVE) -> Column:
    """#161: what is left of a budget after a reserve, never below zero."""
    return F.greatest(F.lit(float(budget - reserve)) - spent, F.lit(0.0))


def admit(rows: DataFrame, lane: list[str], order: list, cost: str, budget: float = BUDGET, reserve: float = RESERVE) -> DataFrame:
    """#159, #161: rows with `gasto` (seconds of the lane's rows up to it) and `admitida`: it still ends in the budget.

    A lane is a window partition, so many lanes go at once; a row that doesn't fit ends its lane's round,
    and the next round resumes there.
    """
    w = Window.partitionBy(*lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = rows.withColumn("gasto", F.sum(cost).over(w))
    return spent.withColumn("admitida", F.col("gasto") <= budget - reserve)


_COST = "cast(1 + event_id % 9 as bigint)"


@query("admissao_por_orcamento", f"select event_id, gasto, gasto <= {BUDGET - RESERVE} admitida from (select event_id, cast(sum({_COST}) over (partition by user_id order by ts, event_id) as bigint) gasto from events)", tables=False)
def admission(s: Star) -> DataFrame:
    """#159, #161: events as the steps of their user's round, oldest first."""
    rows = s.table("events").select("event_id", "user_id", "ts", (1 + F.col("event_id") % 9).alias("custo"))
    return admit(rows, ["user_id"], ["ts", "event_id"], "custo").select("event_id", "gasto", "admitida")


@query(
    "vagas_com_prazo",
    f"""select event_id, vaga, inicio, inicio + custo <= {BUDGET - RESERVE} no_prazo from (select *, cast(coalesce(sum(custo) over (partition by user_id, vaga order by k rows between unbounded preceding and 1 preceding), 0) as bigint) inicio
       from (select event_id, user_id, k, k % 3 vaga, custo from (select event_id, user_id, {_COST} custo, row_number() over (partition by user_id order by ts, event_id) - 1 k from events)))""",
    tables=False,
)
def slots(s: Star, slots: int = 3) -> DataFrame:
    """#160: each host's requests dealt to a few slots in turn; a request starts when its slot's earlier
    ones end and is asked only if it ends before the deadline."""
    e = s.table("events").select("event_id", "user_id", "ts", (1 + F.col("event_id") % 9).alias("custo"))
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    e = e.withColumn("k", k).withColumn("vaga", F.col("k") % slots)
    w = Window.partitionBy("user_id", "vaga").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("custo").over(w), F.lit(0))
    return e.select("event_id", "vaga", start.alias("inicio"), "custo").select("event_id", "vaga", "inicio", (F.col("custo") <= remaining(F.col("inicio"))).alias("no_prazo"))


def meetings(decisions: DataFrame) -> DataFrame:
    """A row per agency, series and number: items, first and last day, items decided."""
    key = ["agencia_id", F.coalesce("serie", F.lit("")).alias("serie"), "numero_reuniao"]
    return decisions.where("numero_reuniao is not null").groupBy(*key).agg(
        F.count("*").alias("itens"), F.min("data_reuniao").alias("primeiro"), F.max("data_reuniao").alias("ultimo"), F.count("resultado").alias("decididos")
    )


def corrected(decisions: DataFrame, rollup: DataFrame, fixes: DataFrame) -> DataFrame:
    """#162: rollup (of meetings) after fixes (id, data_reuniao, numero_reuniao) to decisions.

    Only meetings that a fix leaves or enters are counted again; the others keep their row.
    """
    new = fixes.select("id", F.col("data_reuniao").alias("dia_novo"), F.col("numero_reuniao").alias("numero_novo"))
    j = decisions.join(new, "id", "left").withColumn("mudou", F.col("numero_novo").isNotNull())
    after = j.withColumn("numero_depois", F.coalesce("numero_novo", "numero_reuniao")).withColumn("dia_depois", F.coalesce("dia_novo", "data_reuniao"))
    serie = F.coalesce("serie", F.lit("")).alias("serie")
    moved = after.where("mudou")
    key = ["agencia_id", "serie", "numero_reuniao"]
    touched = moved.select("agencia_id", serie, "numero_reuniao").unionByName(moved.select("agencia_id", serie, F.col("numero_depois").alias("numero_reuniao"))).where("numero_reuniao is not null").distinct()
    now = after.select("agencia_id", serie, F.col("numero_depois").alias("numero_reuniao"), F.col("dia_depois").alias("data_reuniao"), "resultado")
    again = meetings(now.join(touched, key, "left_semi"))
    return rollup.join(touched, key, "left_anti").unionByName(again)


@query(
    "dados_corrigidos",
    """, d as (select agencia_id, coalesce(serie, '') serie, case when id % 97 = 0 then cast(1 + id % 40 as varchar) else numero_reuniao end numero_reuniao,
         case when id % 97 = 0 then data_publicacao else null end novo, data_reuniao, resultado from deliberacoes)
       select agencia_id, serie, numero_reuniao, count(*) itens, min(coalesce(novo, data_reuniao)) primeiro, max(coalesce(novo, data_reuniao)) ultimo, count(resultado) decididos from d where numero_reuniao is not null group by 1, 2, 3""",
)
def late_data(s: Star) -> DataFrame:
    """#162: numbers and dates of some decisions come late; the result is that of counting all anew."""
    d = s.deliberacoes
    fixes = d.where("id % 97 = 0").select("id", F.col("data_publicacao").alias("data_reuniao"), (1 + F.col("id") % 40).cast("string").alias("numero_reuniao"))
    return corrected(d, meetings(d), fixes)


def reorder(rows: DataFrame, lane: list[str], key: str, moves: DataFrame) -> DataFrame:
    """#128: rows (lane, key, posicao) after moves (lane, key, para): a moved row stands right before
    where the row of that position was, and positions close up. Of two moves to a place the lesser key
    comes first."""
    j = rows.join(moves, [*lane, key], "left")
    at = F.coalesce(F.col("para"), F.col("posicao"))
    w = Window.partitionBy(*lane).orderBy(at, F.when(F.col("para").isNotNull(), 0).otherwise(1), key)
    return j.select(*lane, key, F.row_number().over(w).cast("long").alias("posicao"))


@query(
    "fila_reordenada",
    """select user_id, event_id, row_number() over (partition by user_id order by case when event_id % 11 = 0 then 2 else posicao end, case when event_id % 11 = 0 then 0 else 1 end, event_id) posicao
       from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) posicao from events)""",
    tables=False,
)
def reordered_queue(s: Star) -> DataFrame:
    """#128: in each user's queue some rows are moved to the second place by hand."""
    e = s.table("events")
    rows = e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("posicao"))
    return reorder(rows, ["user_id"], "event_id", e.where("event_id % 11 = 0").select("user_id", "event_id", F.lit(2).alias("para")))


@query("situacao_dos_jobs", "select user_id, arg_max(event_type, (ts, event_id)) situacao, count(*) passos from events group by 1", tables=False)
def job_status(s: Star) -> DataFrame:
    """#165: the latest status of every job as a stream's complete output, read when it has run to its end."""
    folder = shared_folder(s.spark, "status")
    stream = s.spark.readStream.schema(s.table("events").schema).parquet(f"{s.sf_dir}/events.parque[t]")
    latest = stream.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"), F.count("*").alias("passos"))
    out: list[str] = []

    def snapshot(rows: DataFrame, batch: int) -> None:
        out.append(f"{folder}/snapshot-{batch}-{uuid.uuid4().hex}")
        rows.select("user_id", F.col("m.event_type").alias("situacao"), "passos").write.parquet(out[-1])

    latest.writeStream.outputMode("complete").foreachBatch(snapshot).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.parquet(out[-1])


def bulletin(rows: DataFrame, title: str, columns: dict[str, str]) -> DataFrame:
    """#20: (ordem, linha) of a Markdown table: a heading, a header and a line per row; no row meets another."""
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    head = rows.sparkSession.createDataFrame([(-3, f"# {title}"), (-2, bar(columns.values())), (-1, bar("---" for _ in columns))], "ordem long, linha string")
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("–")), F.lit("|"), F.lit("\\|"))
    return head.unionByName(rows.select("ordem", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("linha")))


@query(
    "boletim",
    """select cast(-3 as bigint) ordem, '# Boletim' linha union all select -2, '| Agência | Itens | Decididos |' union all select -1, '| --- | --- | --- |'
       union all select a.id, '| ' || a.sigla || ' | ' || count(f.id) || ' | ' || count(f.resultado) || ' |' from agencias a left join f on f.agencia_id = a.id group by a.id, a.sigla""",
)
def report(s: Star) -> DataFrame:
    """#20: a bulletin of all agencies as lines of Markdown."""
    n = final(s).groupBy("agencia_id").agg(F.count("*").alias("itens"), F.count("resultado").alias("decididos"))
    rows = s.agencias.select(F.col("id").alias("ordem"), "sigla").join(n.withColumnRenamed("agencia_id", "ordem"), "ordem", "left").fillna(0, ["itens", "decididos"])
    return bulletin(rows, "Boletim", {"sigla": "Agência", "itens": "Itens", "decididos": "Decididos"})


def escaped(c: Column) -> Column:
    """Text that HTML and XML show as it is."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return out


def html_report(rows: DataFrame, title: str, columns: dict[str, str]) -> DataFrame:
    """#20: (ordem, linha) of an HTML page with a table: a line per row between a head and an end; no row meets another."""
    from html import escape

    spark, last = rows.sparkSession, (1 << 62)
    head = f'<!doctype html><html lang="pt-BR"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>'
    names = "<tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns.values()) + "</tr>"
    frame = spark.createDataFrame([(-2, head), (-1, names), (last, "</table></body></html>")], "ordem long, linha string")
    cells = [F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns]
    return frame.unionByName(rows.select("ordem", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("linha")))


def svg_bars(rows: DataFrame, label: str, value: str, most: Column, width: int = 600, height: int = 20) -> DataFrame:
    """#20: (ordem, linha) of an SVG bar chart: a bar a row at its place, as long as its share of most."""
    long = F.coalesce(F.floor(F.try_divide(F.col(value) * width, most)), F.lit(0)).cast("string")
    y = (F.col("ordem") * height).cast("string")
    bar = F.concat(
        F.lit('<rect x="200" y="'), y, F.lit('" width="'), long, F.lit(f'" height="{height - 4}"/><text x="0" y="'), (F.col("ordem") * height + height - 6).cast("string"), F.lit('">'), escaped(F.col(label)),
        F.lit(" ("), F.col(value).cast("string"), F.lit(")</text>"),
    )
    return rows.select("ordem", bar.alias("linha"))


_PER_AGENCY = "select a.id ordem, case when a.id % 3 = 0 then a.sigla || ' <&> \"x\"' else a.sigla end sigla, count(f.id) itens, count(f.resultado) decididos from agencias a left join f on f.agencia_id = a.id group by a.id, a.sigla"
_ESCAPED = "replace(replace(replace(replace(sigla, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _per_agency(s: Star) -> DataFrame:
    n = final(s).groupBy(F.col("agencia_id").alias("ordem")).agg(F.count("*").alias("itens"), F.count("resultado").alias("decididos"))
    name = F.when(F.col("id") % 3 == 0, F.concat("sigla", F.lit(' <&> "x"'))).otherwise(F.col("sigla"))
    return s.agencias.select(F.col("id").alias("ordem"), name.alias("sigla")).join(n, "ordem", "left").fillna(0, ["itens", "decididos"])


@query(
    "relatorio_html",
    f""", t as ({_PER_AGENCY}) select cast(-2 as bigint) ordem, '<!doctype html><html lang="pt-BR"><head><meta charset="utf-8"><title>Agências &amp; itens</title></head><body><h1>Agências &amp; itens</h1><table>' linha
        union all select -1, '<tr><th>Agência</th><th>Itens</th><th>Decididos</th></tr>' union all select 4611686018427387904, '</table></body></html>'
        union all select ordem, '<tr><td>' || {_ESCAPED} || '</td><td>' || itens || '</td><td>' || decididos || '</td></tr>' from t""",
)
def html_of_agencies(s: Star) -> DataFrame:
    """#20: the bulletin as an HTML page."""
    return html_report(_per_agency(s), "Agências & itens", {"sigla": "Agência", "itens": "Itens", "decididos": "Decididos"})


@query(
    "grafico_svg",
    f""", t as ({_PER_AGENCY}) select ordem, '<rect x="200" y="' || ordem * 20 || '" width="' || coalesce(itens * 600 // nullif((select max(itens) from t), 0), 0) || '" height="16"/><text x="0" y="' || (ordem * 20 + 14) || '">' || {_ESCAPED} || ' (' || itens || ')</text>' linha from t""",
)
def chart_of_agencies(s: Star) -> DataFrame:
    """#20: bars of the items of agencies against the greatest; a row an agency by then."""
    rows = _per_agency(s).withColumn("maior", F.max("itens").over(Window.partitionBy(F.lit(0))))
    return svg_bars(rows, "sigla", "itens", F.col("maior"))


@query("varredura_projetada", "select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1997-01-01 00:00:00' and o_orderstatus = 'F'", tables=False)
def projected_scan(s: Star) -> DataFrame:
    """#1: the filter and both columns reach the scan."""
    where = (F.col("o_orderdate") >= F.to_timestamp(F.lit("1997-01-01 00:00:00"))) & (F.col("o_orderstatus") == "F")
    return tables.scan(s.spark, f"{s.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], where)


@query("varredura_paginada", "select id, k // 1000 pagina, n > 100000 truncada from (select id, row_number() over (order by id) - 1 k, count(*) over () n from deliberacoes) where k < 100000")
def paged_scan(s: Star, page: int = 1000, cap: int = 100_000) -> DataFrame:
    """#2: pages by position up to the stated cap, and whether it cut any row off."""
    from quorumlake.operators.ordering import positions

    rows = s.deliberacoes.select("id")
    total = rows.count()
    k = F.col("n") - 1
    return positions(rows, "id").where(k < cap).select("id", F.floor(k / page).alias("pagina"), F.lit(total > cap).alias("truncada"))


@query("matriz_local", "select id, case when ativo then sigla end sigla from agencias union all select -1, 'local'")
def local_array(s: Star) -> DataFrame:
    """#4: a view's rows are replaced by those of the agencies, then by these and a small array."""
    tables.replace_view(s.spark, [(9, "x")], "matriz_local", "id long, sigla string")
    tables.replace_view(s.spark, s.agencias.select("id", F.when(F.col("ativo"), F.col("sigla")).alias("sigla")), "matriz_local")
    more = tables.replace_view(s.spark, [(-1, "local")], "matriz_local_nova", "id long, sigla string")
    return s.spark.table("matriz_local").unionByName(more)


@query("atualizacao_por_id", "select id, case when nome like '%7' then 'Revisto' else nome end nome, case when nome like '%7' then null else review_status end review_status from diretores")
def updated_by_id(s: Star) -> DataFrame:
    """#5, #24: rows of some ids take values, a null among them."""
    d = s.diretores.select("id", "nome", "review_status")
    return tables.update_by_id(d, "id", d.where("nome like '%7'"), nome="Revisto", review_status=None)


@query("insercao_sem_conflito", "select id, nome from diretores where id % 2 = 0 union all select k, min(nome) from (select id + 1 k, nome from diretores) where k not in (select id from diretores where id % 2 = 0) group by 1")
def inserted(s: Star) -> DataFrame:
    """#23: half of the directors are held; of new rows those with an unheld key come in, the first by name."""
    held = s.diretores.where("id % 2 = 0").select("id", "nome")
    return tables.insert_missing(held, s.diretores.select((F.col("id") + 1).alias("id"), "nome"), ["id"], ["nome"])


@query("csv_de_decisoes", """select id, '"' || id || '";"' || coalesce(case when interessado like '=%' then chr(39) || interessado else replace(interessado, '"', '""') end, '') || '";"' || coalesce(resultado, '') || '"' linha
       from (select id, case when id % 5 = 0 then '=1+' || id when id % 7 = 0 then 'a "b" ' || interessado else interessado end interessado, resultado from deliberacoes)""")
def csv_rows(s: Star) -> DataFrame:
    """#17, #18, #19: quoted cells between semicolons, formulas disarmed."""
    k = F.col("id")
    who = F.when(k % 5 == 0, F.concat(F.lit("=1+"), k.cast("string"))).when(k % 7 == 0, F.concat(F.lit('a "b" '), "interessado")).otherwise(F.col("interessado"))
    line = F.concat_ws(";", *[tables.csv_cell(c) for c in (k, who, F.col("resultado"))])
    return s.deliberacoes.select("id", line.alias("linha"))


@query("datas_de_atualizacao", "select id, data_publicacao is not null tocada from deliberacoes")
def touched_rows(s: Star) -> DataFrame:
    """#27: rows that change get the time of the run, the others keep none."""
    changed = tables.touched(s.deliberacoes.where("data_publicacao is not null").select("id"))
    return s.deliberacoes.select("id").join(changed, "id", "left").select("id", F.col("updated_at").isNotNull().alias("tocada"))


_DRAW = "cast('0x' || substr(md5(id || ':1:{0}'), 1, 8) as bigint) % {1}"


@query(
    "demonstracao",
    f"""select id, {_DRAW.format('a', 3)} + 1 agencia_id, (['deliberacao', 'ata', 'pauta'])[1 + {_DRAW.format('t', 3)}] tipo_documento, case when {_DRAW.format('p', 3)} = 0 then id - 1 end documento_pai_id,
        date '2026-01-01' + cast({_DRAW.format('d', 365)} as int) data_reuniao, (['Deferido', 'Indeferido', 'Retirado de Pauta'])[1 + {_DRAW.format('r', 3)}] resultado,
        cast(null as varchar) juizo, cast(null as boolean) import_counts_as_final, (['multa', 'tarifa', 'obras'])[1 + {_DRAW.format('m', 3)}] microtema from (select o_orderkey id from orders)""",
    tables=False,
)
def demonstration(s: Star) -> DataFrame:
    """#6: the synthetic source, a decision for each order."""
    return demo.decisions(s.spark, s.table("orders").select(F.col("o_orderkey").alias("id")))


@query(
    "proxima_pagina",
    """select page_id, case when page_id % 3 = 0 then 'https://h.gov.br/p' || (page_id + 1) when page_id % 3 = 1 then 'https://h.gov.br/atas?p=' || page_id end proxima from pages""",
    tables=False,
)
def next_pages(s: Star) -> DataFrame:
    """#15: the next page of listings, by rel or by label; none on the last."""
    k = F.col("page_id")
    link = F.when(k % 3 == 0, F.concat(F.lit('<a class="n" rel="next" href="/p'), (k + 1).cast("string"), F.lit('">&gt;</a>'))).when(k % 3 == 1, F.concat(F.lit("<a href='https://h.gov.br/atas?p="), k.cast("string"), F.lit("'> Próxima</a>"))).otherwise("")
    return s.table("pages").select(k, demo.next_page(F.concat(link, F.lit("<p>"), F.length("html").cast("string"), F.lit("</p>")), "https://h.gov.br").alias("proxima"))


@query(
    "capacidade_da_fonte",
    """select id, case when sigla = 'ANM' and tipo in ('ata', 'deliberacao') then 'parcial' when sigla = 'ANTT' and tipo = 'voto_individual' then 'sempre' when sigla in ('ANTT', 'ARTESP') and coalesce(tipo, 'ata') in ('ata', 'deliberacao') then 'nenhum' else 'parcial' end capacidade,
         coalesce(year(data_reuniao) between case sigla when 'ANTT' then 1998 + 3 when 'ANM' then 2017 when 'ARTESP' then 2002 else year(data_reuniao) end and 2027, true) plausivel
       from (select id, (['ANTT', 'ANM', 'ARTESP', 'ANEEL'])[1 + id % 4] sigla, case when id % 9 <> 0 then tipo_documento end tipo, data_reuniao + interval 8 year data_reuniao from deliberacoes)""",
)
def source_capacity(s: Star) -> DataFrame:
    """#176, #177: how far a source names voters, and whether a date is plausible for its agency."""
    sigla = F.element_at(F.array(*[F.lit(x) for x in ("ANTT", "ANM", "ARTESP", "ANEEL")]), (1 + F.col("id") % 4).cast("int"))
    kind, day = F.when(F.col("id") % 9 != 0, F.col("tipo_documento")), F.add_months("data_reuniao", 96)
    return s.deliberacoes.select("id", votes.nominal_capacity(sigla, kind).alias("capacidade"), votes.plausible_date(sigla, day, 2026).alias("plausivel"))


def new_id(*parts: Column) -> Column:
    """An id made of a key, above 2^48, so that runs and tasks agree on it without a counter."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10).cast("long") + (1 << 48)


def term_done(start: Column, end: Column, day: Column) -> Column:
    """Percent of a term that has passed, 0 to 100; null without both ends in order."""
    share = F.round(F.datediff(day, start) * 100.0 / F.datediff(end, start), 2)
    return F.when(end > start, F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)))


def seeded_terms(directors: DataFrame, terms: DataFrame, asked: DataFrame, day: Column) -> DataFrame:
    """#28: (diretor_id, data_inicio, data_fim, percentual, situacao) of asked (agencia_id, nome, data_inicio, data_fim).

    A director is the one of that agency and name, case aside, or a new one; a term is the one with those
    days or a new one. situacao: diretor_novo, mandato_novo or conhecido. Of several directors of a name
    the least id counts.
    """
    name = F.lower("nome").alias("chave")
    known = directors.groupBy("agencia_id", name).agg(F.min("id").alias("id"))
    rows = asked.select("agencia_id", name, "data_inicio", "data_fim").distinct().join(known, ["agencia_id", "chave"], "left")
    rows = rows.withColumn("diretor_id", F.coalesce("id", new_id(F.col("agencia_id"), F.col("chave"))))
    end = F.coalesce("data_fim", F.to_date(F.lit("9999-12-31"))).alias("fim")
    held = terms.select("diretor_id", "data_inicio", end, F.lit(True).alias("tem")).distinct()
    rows = rows.select("*", end).join(held, ["diretor_id", "data_inicio", "fim"], "left")
    say = F.when(F.col("id").isNull(), "diretor_novo").when(F.col("tem").isNull(), "mandato_novo").otherwise("conhecido")
    return rows.select("diretor_id", "data_inicio", "data_fim", term_done(F.col("data_inicio"), F.col("data_fim"), day).alias("percentual"), say.alias("situacao"))


@query(
    "mandatos_semeados",
    """, a as (select distinct d.agencia_id, lower(case when d.id % 5 = 0 then 'Nova ' || nome else upper(nome) end) chave, case when d.id % 3 = 0 then m.data_inicio + 30 else m.data_inicio end data_inicio, m.data_fim
         from diretores d join mandatos m on m.diretor_id = d.id)
       select coalesce(k.id, cast('0x' || substr(md5(a.agencia_id || '|' || a.chave), 1, 12) as bigint) + 281474976710656) diretor_id, a.data_inicio, a.data_fim,
         case when a.data_fim > a.data_inicio then least(100e0, greatest(0e0, round((date '1998-08-02' - a.data_inicio) * 100e0 / (a.data_fim - a.data_inicio), 2))) end percentual,
         case when k.id is null then 'diretor_novo' when not exists (select 1 from mandatos m where m.diretor_id = k.id and m.data_inicio = a.data_inicio and m.data_fim is not distinct from a.data_fim) then 'mandato_novo' else 'conhecido' end situacao
       from a left join (select agencia_id, lower(nome) chave, min(id) id from diretores group by 1, 2) k on k.agencia_id = a.agencia_id and k.chave = a.chave""",
)
def seeded(s: Star) -> DataFrame:
    """#28: every director is asked for, in capitals or under a new name, some with a later start."""
    d = s.diretores.select(F.col("id").alias("diretor_id"), "agencia_id", "nome").join(s.mandatos.drop("agencia_id"), "diretor_id")
    k = F.col("diretor_id")
    name = F.when(k % 5 == 0, F.concat(F.lit("Nova "), "nome")).otherwise(F.upper("nome"))
    start = F.when(k % 3 == 0, F.date_add("data_inicio", 30)).otherwise(F.col("data_inicio"))
    return seeded_terms(s.diretores, s.mandatos, d.select("agencia_id", name.alias("nome"), start.alias("data_inicio"), "data_fim"), s.day)


@query(
    "lista_triplice",
    """select id agencia_id, 'Diretor' vaga, case when id % 3 = 0 then 'aberta' when id % 2 = 0 then 'mapeada' else 'publicada' end situacao, case when id % 2 = 1 and id % 3 <> 0 then 'A definir' when id % 2 = 0 then sigla else 'A definir' end candidato
       from agencias where id % 2 = 0 or id % 3 <> 2""",
)
def three_name_lists(s: Star) -> DataFrame:
    """#28: lists of candidates by agency and vacancy: known ones take the new status and keep their
    candidate, others come in with none yet."""
    a, k = s.agencias, F.col("id")
    held = a.where(k % 2 == 0).select(k.alias("agencia_id"), F.lit("Diretor").alias("vaga"), F.lit("mapeada").alias("situacao"), F.col("sigla").alias("candidato"))
    new = a.where(k % 3 != 2).select(k.alias("agencia_id"), F.lit("Diretor").alias("vaga"), F.when(k % 3 == 0, "aberta").when(k % 2 == 0, "mapeada").otherwise("publicada").alias("situacao"))
    return tables.upsert(held, new, ["agencia_id", "vaga"]).fillna("A definir", ["candidato"])
