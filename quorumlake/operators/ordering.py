"""Windows, top-k, pagination, fair interleaving, sampling, and set operations."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import predicates as P
from quorumlake.operators.analytics import final
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star, shared_folder


def by_rank(df: DataFrame, keys: list, order: list, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


@query("top3_por_agencia", "select agencia_id, id, data_publicacao, n from (select *, row_number() over (partition by agencia_id order by data_publicacao desc nulls last, id) n from f) where n <= 3")
def latest_three(s: Star) -> DataFrame:
    """#110: the three latest of each agency, undated last. The limit reaches below the shuffle."""
    return by_rank(final(s), ["agencia_id"], [F.desc_nulls_last("data_publicacao"), "id"]).where("n <= 3").select("agencia_id", "id", "data_publicacao", "n")


@query("distinct_on_reuniao", "select agencia_id, data_reuniao, id from (select *, row_number() over (partition by agencia_id, data_reuniao order by id) n from f where data_reuniao is not null) where n = 1")
def first_of_meeting(s: Star) -> DataFrame:
    """#112: the first decision of each meeting, as an aggregate rather than a sort."""
    return final(s).where("data_reuniao is not null").groupBy("agencia_id", "data_reuniao").agg(F.min("id").alias("id"))


@query("ultimo_mandato", "select diretor_id, data_inicio, data_fim from (select *, row_number() over (partition by diretor_id order by data_inicio desc, data_fim desc nulls last) n from mandatos) where n = 1")
def last_term(s: Star) -> DataFrame:
    """#113: the latest term of each director, of those the one that ends last; one without an end comes last."""
    last = s.mandatos.groupBy("diretor_id").agg(F.max_by(F.struct("data_inicio", "data_fim"), F.struct("data_inicio", F.col("data_fim").isNotNull(), "data_fim")).alias("m"))
    return last.select("diretor_id", "m.data_inicio", "m.data_fim")


def positions(rows: DataFrame, key: str, out: str = "n") -> DataFrame:
    """rows with their position, from 1, by a key; rows of one key in no fixed order.

    Rows are dealt by ranges of the key, in which a hash splits equal keys, and written once, so that counting and
    numbering see the same ranges. Within a range a row's place is its number, and a range's offset is the sum of
    the sizes before it, a window over a row per range.
    """
    columns = rows.columns
    dealt = rows.repartitionByRange(F.col(key), F.xxhash64(*[F.col(c) for c in columns])).sortWithinPartitions(key)
    path = shared_folder(rows.sparkSession, "positions")
    dealt.withColumn("place__", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    part = F.shiftright("place__", 33)
    sizes = placed.groupBy(part.alias("part__")).agg(F.count("*").alias("c__"))
    before = F.coalesce(F.sum("c__").over(Window.partitionBy(F.lit(0)).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part__", before.alias("before__"))
    inside = placed.withColumn("part__", part).join(offsets, "part__")
    return inside.select(*columns, (F.col("place__").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("before__")).alias(out))


@query("posicao_global", "select id, row_number() over (order by id) n from deliberacoes")
def global_position(s: Star) -> DataFrame:
    """#111: positions over a whole table, without a single sorting task."""
    return positions(s.deliberacoes.select("id"), "id")


@query("rank_com_nulos", "select agencia_id, media, case when media is not null then row_number() over (order by media desc nulls last, agencia_id) end posicao from (select a.id agencia_id, cast(sum(cast(f.extraction_confidence as decimal(18,4))) as double) / nullif(count(f.extraction_confidence), 0) media from agencias a left join f on f.agencia_id = a.id and a.id % 4 <> 0 group by 1)")
def rank_measured(s: Star) -> DataFrame:
    """#115: rank of what was measured; the others have none. One row per agency by then."""
    own = final(s).where("agencia_id % 4 <> 0").groupBy("agencia_id").agg(P.mean(F.col("extraction_confidence")).alias("media"))
    rows = s.agencias.select(F.col("id").alias("agencia_id")).join(own, "agencia_id", "left")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("media"), "agencia_id"))
    return rows.select("agencia_id", "media", F.when(F.col("media").isNotNull(), rank).alias("posicao"))


@query("melhor_e_segundo", "select agencia_id, max(t) filter (n = 1) melhor, max(t) filter (n = 2) segundo from (select agencia_id, empresa_id, count(*) t, row_number() over (partition by agencia_id order by count(*) desc, empresa_id) n from f group by 1, 2) where n <= 2 group by 1")
def best_two(s: Star) -> DataFrame:
    """#116: best and second best per group."""
    counts = final(s).groupBy("agencia_id", "empresa_id").agg(F.count("*").alias("t"))
    rows = by_rank(counts, ["agencia_id"], [F.desc("t"), "empresa_id"]).where("n <= 2")
    return rows.groupBy("agencia_id").agg(F.max(F.when(F.col("n") == 1, F.col("t"))).alias("melhor"), F.max(F.when(F.col("n") == 2, F.col("t"))).alias("segundo"))


@query("tema_dominante", "select agencia_id, microtema, total from (select agencia_id, microtema, count(*) total, row_number() over (partition by agencia_id order by count(*) desc, microtema) n from f where microtema is not null group by 1, 2) where n = 1")
def dominant_theme(s: Star) -> DataFrame:
    """#118: the most frequent theme of each agency, ties by name."""
    counts = final(s).where("microtema is not null").groupBy("agencia_id", "microtema").agg(F.count("*").alias("total"))
    return by_rank(counts, ["agencia_id"], [F.desc("total"), "microtema"]).where("n = 1").select("agencia_id", "microtema", "total")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """#119: a page of a fully ordered table."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


SORTABLE = ("data_reuniao", "id", "interessado", "microtema", "resultado", "extraction_confidence")


@query("deliberacoes_pagina", "select id, data_reuniao, interessado from f where lower(interessado) like '%00012%' or lower(coalesce(processo, '')) like '%00012%' order by data_reuniao desc nulls last, id limit 20 offset 20")
def decision_page(s: Star, term: str = "00012", sort: str = "data_reuniao", number: int = 2, size: int = 20) -> DataFrame:
    """#30, #31, #119, #120: contains on some columns, a checked sort column, a page."""
    if sort not in SORTABLE:
        raise ValueError(f"can't sort by {sort}")
    hit = F.lower("interessado").contains(term.lower()) | F.lower(F.coalesce("processo", F.lit(""))).contains(term.lower())
    return page(final(s).where(hit).select("id", "data_reuniao", "interessado"), [F.desc_nulls_last(sort), "id"], number, size)


@query("deliberacoes_total", "select count(*) total, cast(ceil(count(*) / 20e0) as bigint) paginas from f where lower(interessado) like '%00012%'")
def page_count(s: Star, term: str = "00012", size: int = 20) -> DataFrame:
    """#119: the exact total and the number of pages."""
    rows = final(s).where(F.lower("interessado").contains(term.lower()))
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / float(size)).alias("paginas"))


#: Document types that decide come before agendas.
TYPE_PRIORITY = {"ata": 0, "deliberacao": 0, "voto": 0, "reuniao": 1, "documento": 2, "pauta": 3}


def type_priority(column: str = "tipo_documento"):
    out = F.lit(2)
    for name, rank in TYPE_PRIORITY.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


@query(
    "fila_justa",
    """select id, agencia_id, vez from (select *, row_number() over (partition by agencia_id order by case when tipo_documento in ('ata', 'deliberacao', 'voto') then 0 when tipo_documento = 'reuniao' then 1
       when tipo_documento = 'pauta' then 3 else 2 end, data_reuniao desc nulls last, id) vez from deliberacoes where data_reuniao >= date '1998-01-01')""",
)
def fair_queue(s: Star) -> DataFrame:
    """#122, #123: a turn number per agency, deciding types first; ordering by (turn, agency) deals the
    agencies out in turn."""
    rows = s.deliberacoes.where(F.col("data_reuniao") >= F.to_date(F.lit("1998-01-01")))
    return by_rank(rows, ["agencia_id"], [type_priority(), F.desc_nulls_last("data_reuniao"), "id"], "vez").select("id", "agencia_id", "vez")


def rotating_window(total: int, size: int, minute: int) -> tuple[int, int]:
    """#124: first and past-the-last position of the minute's block."""
    if total <= 0 or size <= 0:
        return 0, 0
    block = minute % -(-total // size)
    return block * size, min(block * size + size, total)


@query(
    "janela_rotativa",
    "select id, k from (select id, row_number() over (order by id) - 1 k, count(*) over () n from f) where k >= (7 % cast(ceil(n / 10e0) as bigint)) * 10 and k < (7 % cast(ceil(n / 10e0) as bigint)) * 10 + 10",
)
def rotation(s: Star, size: int = 10, minute: int = 7) -> DataFrame:
    """#124: the rows of the minute's block, by position among all final decisions."""
    rows = final(s).select("id")
    start, end = rotating_window(rows.count(), size, minute)
    return positions(rows, "id").select("id", (F.col("n") - 1).alias("k")).where((F.col("k") >= start) & (F.col("k") < end))


@query("amostra_reprodutivel", "select id, agencia_id from f order by md5('auditoria:' || id), id limit 25")
def sample(s: Star, n: int = 25, seed: str = "auditoria") -> DataFrame:
    """#125: a reproducible sample, the n least seeded hashes."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    return final(s).select("id", "agencia_id").orderBy(key, "id").limit(n)


QUOTAS = ("ausencia_ou_impedimento", "divergencia_nominal", "fonte_ata", "fonte_voto_individual", "fonte_deliberacao", "desfecho_indeferido", "desfecho_deferido", "origem_lido", "origem_inferido")


def quotas(read: F.Column) -> F.Column:
    """#126: the quotas that a vote row serves, of QUOTAS."""
    t, way = F.lower(F.coalesce("tipo_documento", F.lit(""))), P.inferred_vote()
    source = F.when(t.contains("ata"), "fonte_ata").when(t.contains("voto"), "fonte_voto_individual").when(t.contains("delibera"), "fonte_deliberacao")
    return F.array_compact(F.array(
        F.when(~P.empty(F.col("motivo_nao_voto")), "ausencia_ou_impedimento"), F.when(F.col("is_divergente") & read, "divergencia_nominal"), source,
        F.when(way == "Desfavoravel", "desfecho_indeferido"), F.when(way == "Favoravel", "desfecho_deferido"), F.when(read, "origem_lido").otherwise("origem_inferido"),
    ))


def _stratified_sql(per_agency: int = 5, seed: str = "auditoria") -> str:
    """The greedy choice as two walks over each agency's list, a row a step."""
    pair = "struct_pack(deliberacao_id := x.deliberacao_id, diretor_id := x.diretor_id)"
    walk = lambda news: f"len(c) < {per_agency} and not list_contains(c, {pair})" + news
    take = walk(" and len(list_filter(x.cotas, lambda q: not list_contains(vistas, q))) > 0")
    return f""", r as (select agencia_id, deliberacao_id, diretor_id, md5('{seed}:' || agencia_id || ':' || deliberacao_id || ':' || diretor_id) sorte, list_filter([
          case when coalesce(motivo_nao_voto, '') <> '' then 'ausencia_ou_impedimento' end, case when is_divergente and nominal then 'divergencia_nominal' end,
          case when tipo_documento like '%ata%' then 'fonte_ata' when tipo_documento like '%voto%' then 'fonte_voto_individual' when tipo_documento like '%delibera%' then 'fonte_deliberacao' end,
          case when resultado = 'Indeferido' then 'desfecho_indeferido' end, case when coalesce(resultado, '') not in ('', 'Retirado de Pauta', 'Indeferido') then 'desfecho_deferido' end,
          case when nominal then 'origem_lido' else 'origem_inferido' end], lambda q: q is not null) cotas from v join f on f.id = deliberacao_id),
        e as (select *, row_number() over (partition by agencia_id, cota order by sorte, deliberacao_id, diretor_id) n from (select *, unnest(cotas) cota from r)),
        l as (select agencia_id, list(struct_pack(deliberacao_id := deliberacao_id, diretor_id := diretor_id, cotas := cotas) order by n, list_position([{", ".join(f"'{q}'" for q in QUOTAS)}], cota), deliberacao_id, diretor_id) l
            from e where n <= {per_agency} group by 1)
        select agencia_id, p.deliberacao_id, p.diretor_id from (select agencia_id, unnest(c) p from (
          with recursive t as (select agencia_id, l, 1 i, cast([] as varchar[]) vistas, cast([] as struct(deliberacao_id bigint, diretor_id bigint)[]) c from l
              union all select agencia_id, l, i + 1, case when {take} then list_distinct(vistas || x.cotas) else vistas end, case when {take} then c || [{pair}] else c end from (select *, l[i] x from t where i <= len(l))),
            u as (select agencia_id, l, 1 i, c from t where i > len(l)
              union all select agencia_id, l, i + 1, case when {walk("")} then c || [{pair}] else c end from (select *, l[i] x from u where i <= len(l)))
          select agencia_id, c from u where i > len(l)))"""


@query("amostra_estratificada", _stratified_sql())
def stratified_sample(s: Star, per_agency: int = 5, seed: str = "auditoria") -> DataFrame:
    """#126: per agency, an example for each quota by seeded hash, then others until the size is met.

    A row chosen for one quota serves its others; quotas are taken in order. Only the best few rows of
    each quota and agency come together, so the greedy step sees a bounded list.
    """
    per_agency = max(1, min(50, per_agency))
    own = final(s).select(F.col("id").alias("deliberacao_id"), "agencia_id", "tipo_documento", "resultado")
    rows = s.votos.join(own, "deliberacao_id").select("agencia_id", "deliberacao_id", "diretor_id", quotas(P.is_nominal()).alias("cotas"))
    draw = F.md5(F.concat_ws(":", F.lit(seed), "agencia_id", "deliberacao_id", "diretor_id"))
    each = rows.select("*", F.explode("cotas").alias("cota"), draw.alias("sorte"))
    best = by_rank(each, ["agencia_id", "cota"], ["sorte", "deliberacao_id", "diretor_id"]).where(F.col("n") <= per_agency)
    order = F.array_position(F.array(*[F.lit(q) for q in QUOTAS]), F.col("cota"))
    listed = best.groupBy("agencia_id").agg(F.array_sort(F.collect_list(F.struct("n", order.alias("o"), "deliberacao_id", "diretor_id", "cotas"))).alias("lista"))
    start = F.struct(F.array().cast("array<string>").alias("vistas"), F.array().cast("array<struct<deliberacao_id:bigint,diretor_id:bigint>>").alias("escolhidas"))

    def take(acc, x):
        pair = F.struct(x["deliberacao_id"].alias("deliberacao_id"), x["diretor_id"].alias("diretor_id"))
        news = F.size(F.array_except(x["cotas"], acc["vistas"])) > 0
        fits = (F.size(acc["escolhidas"]) < per_agency) & ~F.array_contains(acc["escolhidas"], pair) & news
        return F.struct(F.when(fits, F.array_union(acc["vistas"], x["cotas"])).otherwise(acc["vistas"]).alias("vistas"), F.when(fits, F.array_append(acc["escolhidas"], pair)).otherwise(acc["escolhidas"]).alias("escolhidas"))

    def fill(acc, x):
        pair = F.struct(x["deliberacao_id"].alias("deliberacao_id"), x["diretor_id"].alias("diretor_id"))
        fits = (F.size(acc) < per_agency) & ~F.array_contains(acc, pair)
        return F.when(fits, F.array_append(acc, pair)).otherwise(acc)

    chosen = listed.select("agencia_id", "lista", F.aggregate("lista", start, take)["escolhidas"].alias("c"))
    return chosen.select("agencia_id", F.explode(F.aggregate("lista", F.col("c"), fill)).alias("x")).select("agencia_id", "x.*")


@query("uniao_discriminada", "select 'decisao' origem, id, data_reuniao dia, cast(null as varchar) tipo from f union all select 'voto', deliberacao_id, cast(null as date), tipo_voto from v")
def union_tagged(s: Star) -> DataFrame:
    """#129: UNION ALL with a discriminator and nulls for what a side lacks."""
    a = final(s).select(F.lit("decisao").alias("origem"), "id", F.col("data_reuniao").alias("dia"))
    b = s.votos.select(F.lit("voto").alias("origem"), F.col("deliberacao_id").alias("id"), F.col("tipo_voto").alias("tipo"))
    return a.unionByName(b, allowMissingColumns=True)


@query("decididas_sem_voto", "select id from f where estado = 'decidido' and not exists (select 1 from v where v.deliberacao_id = f.id and v.tipo_voto <> 'Ausente')")
def anti_join(s: Star) -> DataFrame:
    """#51, #130: decided without a vote that is no absence."""
    return final(s).where(P.on_merits()).select("id").join(s.votos.where("tipo_voto <> 'Ausente'").select(F.col("deliberacao_id").alias("id")), "id", "left_anti")


@query("com_voto_nominal", "select id from f where exists (select 1 from v where v.deliberacao_id = f.id and nominal)")
def semi_join(s: Star) -> DataFrame:
    """#51: decisions with a vote that was read."""
    return final(s).select("id").join(s.votos.where(P.is_nominal()).select(F.col("deliberacao_id").alias("id")), "id", "left_semi")


@query("lote_com_lista", "select id, resultado from deliberacoes where id in (select event_id from events)")
def batched_lookup(s: Star) -> DataFrame:
    """#3: an IN list of any length, as a semi-join."""
    wanted = s.table("events").select(F.col("event_id").cast("long").alias("id"))
    return s.deliberacoes.join(wanted, "id", "left_semi").select("id", "resultado")


@query("subconsultas_correlatas", "select a.id, (select count(*) from f where f.agencia_id = a.id) total, (select min(data_reuniao) from f where f.agencia_id = a.id) primeira, (select max(data_reuniao) from f where f.agencia_id = a.id) ultima from agencias a")
def correlated(s: Star) -> DataFrame:
    """#52, #55: correlated counts and extremes, aggregated before the join."""
    own = final(s).groupBy(F.col("agencia_id").alias("id")).agg(F.count("*").alias("total"), F.min("data_reuniao").alias("primeira"), F.max("data_reuniao").alias("ultima"))
    return s.agencias.select("id").join(own, "id", "left").fillna(0, ["total"])


@query("filter_having", "select agencia_id, count(*) n, count(distinct empresa_id) filter (positivo) empresas, bool_and(auto_classified or id % 2 = 1) todas, string_agg(distinct microtema, ',' order by microtema) temas from f group by 1 having count(*) filter (positivo) > 10")
def filtered_aggregates(s: Star) -> DataFrame:
    """#108: filtered counts, bool_and, ordered aggregation and HAVING."""
    out = final(s).groupBy("agencia_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(P.is_positive(), F.col("empresa_id"))).alias("empresas"), F.bool_and(F.col("auto_classified") | (F.col("id") % 2 == 1)).alias("todas"),
        F.array_join(F.array_sort(F.collect_set("microtema")), ",").alias("temas"), F.count_if(P.is_positive()).alias("p"),
    )
    return out.where("p > 10").drop("p")


@query("embutidos", "select f.id, string_agg(v.diretor_id || ':' || v.tipo_voto, ';' order by v.diretor_id) votos from f left join v on v.deliberacao_id = f.id group by 1")
def embedded(s: Star) -> DataFrame:
    """#48, #50: decisions with their votes as a nested, ordered list."""
    own = final(s).select("id")
    votes = s.votos.groupBy(F.col("deliberacao_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("diretor_id", "tipo_voto"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["diretor_id"].cast("string"), F.lit(":"), x["tipo_voto"])), ";")
    return own.join(votes, "id", "left").select("id", text.alias("votos"))


@query("unnest_ordinality", "select id, n, cast(parte as varchar) parte from (select id, unnest(string_split(interessado, '#')) parte, unnest(range(1, len(string_split(interessado, '#')) + 1)) n from f)")
def exploded(s: Star) -> DataFrame:
    """#63: array elements as rows with their position, from 1."""
    rows = final(s).select("id", F.posexplode(F.split("interessado", "#")).alias("k", "parte"))
    return rows.select("id", (F.col("k") + 1).cast("long").alias("n"), "parte")


@query("sem_agencia", "select coalesce(a.sigla, '(sem agência)') sigla, count(*) total from f left join agencias a on a.id = f.agencia_id and a.ativo group by 1")
def labelled_left_join(s: Star) -> DataFrame:
    """#49: a left join whose misses have a label."""
    active = s.agencias.where("ativo").select(F.col("id").alias("agencia_id"), "sigla")
    return final(s).join(active, "agencia_id", "left").groupBy(F.coalesce("sigla", F.lit("(sem agência)")).alias("sigla")).agg(F.count("*").alias("total"))


@query("serie_vizinhos", "select id, lag(data_reuniao) over w anterior, lead(data_reuniao) over w seguinte from f where numero_reuniao is not null and data_reuniao is not null window w as (partition by agencia_id, coalesce(serie, '') order by cast(numero_reuniao as int), data_reuniao, id)")
def series_neighbours(s: Star) -> DataFrame:
    """#64: the dates before and after in a series."""
    rows = final(s).where("numero_reuniao is not null and data_reuniao is not null")
    w = Window.partitionBy("agencia_id", F.coalesce("serie", F.lit(""))).orderBy(F.col("numero_reuniao").cast("int"), "data_reuniao", "id")
    return rows.select("id", F.lag("data_reuniao").over(w).alias("anterior"), F.lead("data_reuniao").over(w).alias("seguinte"))


@query("itens_e_pais", "select i.id, p.id pai, p.resultado resultado_do_pai from deliberacoes i join deliberacoes p on p.id = i.documento_pai_id where i.tipo_documento = 'ata'")
def parent_join(s: Star) -> DataFrame:
    """#65: items joined to their parents."""
    parents = s.deliberacoes.select(F.col("id").alias("pai"), F.col("resultado").alias("resultado_do_pai"))
    return s.deliberacoes.where("tipo_documento = 'ata'").join(parents, F.col("documento_pai_id") == F.col("pai")).select("id", "pai", "resultado_do_pai")
