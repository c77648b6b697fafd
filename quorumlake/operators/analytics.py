"""Decision and vote analytics: overviews, themes, months, meetings, directors, companies, alerts.

Every operator takes the star's DataFrames and returns a lazy DataFrame. Rates are unrounded percent
doubles, null on an empty base; rounding and labels are presentation. All but `top` results are
unordered: order is the reader's to ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import predicates as P
from quorumlake.plans.registry import query
from quorumlake.plans.star import TODAY, Star

MONTH = "yyyy-MM"


def final(s: Star) -> DataFrame:
    return s.deliberacoes.where(P.is_final())


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("estado", P.status())


def counted(name: str, condition) -> F.Column:
    return F.count_if(condition).alias(name)


@query("s1_final_decisions", "select id, agencia_id, tipo_documento, estado from f")
def final_decisions(s: Star) -> DataFrame:
    """#33, #36: decisions that count, with their state."""
    return with_status(final(s)).select("id", "agencia_id", "tipo_documento", "estado")


@query(
    "discards",
    """select motivo, count(*) total from (select case when not is_final then case when tipo_documento in ('pauta','voto_individual','documento_apoio') then 'tipo_nao_final'
       when tipo_documento = 'ata' and documento_pai_id is null then 'ata_envelope' when tipo_documento = 'ata' and coalesce(resultado,'') = '' then 'sem_resultado_extraido'
       else 'outro' end end motivo from final) group by motivo""",
)
def discards(s: Star) -> DataFrame:
    """#34: rows by reason of discard, null for those kept."""
    return s.deliberacoes.groupBy(P.discard_reason().alias("motivo")).agg(F.count("*").alias("total"))


@query(
    "overview",
    """select count(*) total, count(*) filter (estado = 'decidido' and positivo) deferidos, count(*) filter (estado = 'decidido' and resultado = 'Indeferido') indeferidos,
       count(*) filter (estado = 'sem_resultado') sem_resultado, count(*) filter (estado = 'retirado') retirado, count(*) filter (estado = 'admissibilidade') admissibilidade,
       count(*) filter (estado = 'decidido') total_decidido,
       100e0 * count(*) filter (estado = 'decidido' and positivo) / nullif(count(*) filter (estado = 'decidido'), 0) taxa_deferimento,
       count(distinct (agencia_id, data_reuniao, coalesce(numero_reuniao, ''))) filter (data_reuniao is not null) reunioes_unicas,
       cast(sum(cast(extraction_confidence as decimal(18,4))) as double) / count(extraction_confidence) avg_confidence,
       count(*) filter (auto_classified) auto_classificadas, count(*) filter (pauta_interna) pauta_interna, count(*) filter (not pauta_interna) pauta_externa from f""",
)
def overview(s: Star) -> DataFrame:
    """#66: the key figures; positives count on decided rows, meetings by agency, date and number."""
    decided, state = P.on_merits(), P.status()
    meeting = F.when(F.col("data_reuniao").isNotNull(), F.struct("agencia_id", "data_reuniao", F.coalesce("numero_reuniao", F.lit(""))))
    return final(s).agg(
        F.count("*").alias("total"), counted("deferidos", decided & P.is_positive()), counted("indeferidos", decided & P.is_denied()),
        counted("sem_resultado", state == "sem_resultado"), counted("retirado", state == "retirado"), counted("admissibilidade", state == "admissibilidade"),
        counted("total_decidido", decided), P.rate(F.count_if(decided & P.is_positive()), F.count_if(decided)).alias("taxa_deferimento"),
        F.count_distinct(meeting).alias("reunioes_unicas"), P.mean(F.col("extraction_confidence")).alias("avg_confidence"),
        counted("auto_classificadas", F.col("auto_classified")), counted("pauta_interna", F.col("pauta_interna")), counted("pauta_externa", ~F.col("pauta_interna")),
    )


_THEMES = """select {0}, count(*) total, count(*) filter (estado = 'decidido') total_decidido, count(*) filter (estado = 'decidido' and positivo) deferido,
  count(*) filter (estado = 'decidido' and resultado = 'Indeferido') indeferido,
  100e0 * count(*) filter (estado = 'decidido' and positivo) / nullif(count(*) filter (estado = 'decidido'), 0) pct_deferido from f {1} group by 1"""


def outcomes(df: DataFrame, *by) -> DataFrame:
    """Totals, decided, granted, denied and the grant rate over decided, by key."""
    decided = P.on_merits()
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), counted("total_decidido", decided), counted("deferido", decided & P.is_positive()), counted("indeferido", decided & P.is_denied()),
        P.rate(F.count_if(decided & P.is_positive()), F.count_if(decided)).alias("pct_deferido"),
    )


@query("microtemas", _THEMES.format("coalesce(microtema, 'outros') microtema", ""))
def microtemas(s: Star) -> DataFrame:
    """#67: outcomes by theme, a missing one as `outros`."""
    return outcomes(final(s), F.coalesce("microtema", F.lit("outros")).alias("microtema"))


@query("reunioes_stats", _THEMES.format("strftime(data_reuniao, '%Y-%m') mes", "where data_reuniao is not null"))
def monthly_stats(s: Star) -> DataFrame:
    """#72: outcomes by month."""
    return outcomes(final(s).where("data_reuniao is not null"), F.date_format("data_reuniao", MONTH).alias("mes"))


#: The pivot's columns are stated, so that it needs no pass to find them.
THEMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "microtemas_evolution",
    "select strftime(data_reuniao, '%Y-%m') periodo, " + ", ".join(f"nullif(count(*) filter (microtema = '{t}'), 0) \"t{k}\"" for k, t in enumerate(THEMES, 1))
    + " from f where data_reuniao is not null and microtema is not null group by 1",
)
def theme_evolution(s: Star) -> DataFrame:
    """#68: decisions by month, a column per theme, null where there are none."""
    rows = final(s).where("data_reuniao is not null and microtema is not null").groupBy(F.date_format("data_reuniao", MONTH).alias("periodo"))
    wide = rows.pivot("microtema", list(THEMES)).count()
    return wide.select("periodo", *[F.col(f"`{t}`").alias(f"t{k}") for k, t in enumerate(THEMES, 1)])


@query("reunioes_calendar", "select data_reuniao, count(*) total from f where data_reuniao is not null group by 1")
def calendar(s: Star) -> DataFrame:
    """#71: decisions by meeting date."""
    return final(s).where("data_reuniao is not null").groupBy("data_reuniao").agg(F.count("*").alias("total"))


_VOTES = """select diretor_id, count(*) total, count(*) filter (tipo_voto = 'Favoravel') favoravel, count(*) filter (tipo_voto = 'Desfavoravel') desfavoravel,
  count(*) filter (tipo_voto = 'Abstencao') abstencao, count(*) filter (tipo_voto = 'Ausente') ausente, count(*) filter (is_divergente) divergente"""


def vote_counts(df: DataFrame, *by) -> DataFrame:
    t = F.col("tipo_voto")
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), counted("favoravel", t == "Favoravel"), counted("desfavoravel", t == "Desfavoravel"), counted("abstencao", t == "Abstencao"),
        counted("ausente", t == "Ausente"), counted("divergente", F.col("is_divergente")),
    )


@query("votacao_matrix", _VOTES + " from v group by 1")
def vote_matrix(s: Star) -> DataFrame:
    """#73: votes of each director by kind; absences only in the total."""
    return vote_counts(s.votos, "diretor_id")


@query(
    "diretores_overview_local",
    """select diretor_id, count(*) total, count(*) filter (tipo_voto = 'Favoravel') favoravel, count(*) filter (tipo_voto <> 'Favoravel') desfavoravel,
       count(*) filter (is_divergente) divergente, count(*) filter (nominal) nominais, count(*) filter (not nominal) inferidos,
       100e0 * count(*) filter (tipo_voto = 'Favoravel') / count(*) pct_favor from v group by 1""",
)
def directors_local(s: Star) -> DataFrame:
    """#69: in for or else against, with read and inferred votes."""
    favor = F.col("tipo_voto") == "Favoravel"
    return s.votos.groupBy("diretor_id").agg(
        F.count("*").alias("total"), counted("favoravel", favor), counted("desfavoravel", ~favor), counted("divergente", F.col("is_divergente")),
        counted("nominais", P.is_nominal()), counted("inferidos", ~P.is_nominal()), P.rate(F.count_if(favor), F.count("*")).alias("pct_favor"),
    )


@query(
    "diretores_overview",
    """, ult as (select diretor_id, max(data_inicio) data_inicio, arg_max(fonte_dado, data_inicio) fonte_dado from mandatos group by 1),
       vs as (select diretor_id, count(*) filter (tipo_voto in ('Favoravel','Desfavoravel')) efetivos, count(*) filter (tipo_voto = 'Favoravel') favoravel,
         count(*) filter (tipo_voto = 'Desfavoravel') desfavoravel, count(*) filter (tipo_voto = 'Abstencao') abstencao,
         count(*) filter (tipo_voto = 'Ausente' and motivo_nao_voto = 'impedimento') impedido, count(*) filter (tipo_voto = 'Ausente' and motivo_nao_voto <> 'impedimento') ausente,
         count(*) filter (nominal) nominais, count(*) filter (not nominal) inferidos, count(*) filter (is_divergente and nominal) divergente
         from v join f on f.id = v.deliberacao_id group by 1),
       rel as (select relator_nome, count(*) relatorias from (select replace(relator, 'Diretor ', '') relator_nome from f) group by 1)
       select d.id diretor_id, d.agencia_id, coalesce(efetivos, 0) efetivos, coalesce(favoravel, 0) favoravel, coalesce(desfavoravel, 0) desfavoravel, coalesce(abstencao, 0) abstencao,
         coalesce(impedido, 0) impedido, coalesce(ausente, 0) ausente, coalesce(nominais, 0) nominais, coalesce(inferidos, 0) inferidos, coalesce(divergente, 0) divergente,
         100e0 * favoravel / nullif(efetivos, 0) pct_favor, ult.data_inicio ultimo_mandato, coalesce(fonte_dado <> 'automatico', false) mandato_confiavel, coalesce(relatorias, 0) relatorias
       from diretores d left join vs on vs.diretor_id = d.id left join ult on ult.diretor_id = d.id left join rel on rel.relator_nome = d.nome
       where d.review_status <> 'rejeitado' and (coalesce(fonte_dado <> 'automatico', false) or vs.diretor_id is not null)""",
)
def directors(s: Star) -> DataFrame:
    """#70: effective votes and rates, last mandate, rapporteurships; rejected ones and those with
    neither a trusted mandate nor votes are left out."""
    t, away = F.col("tipo_voto"), F.col("motivo_nao_voto")
    of = s.votos.join(final(s).select("id"), F.col("deliberacao_id") == F.col("id")).groupBy("diretor_id").agg(
        counted("efetivos", P.is_effective()), counted("favoravel", t == "Favoravel"), counted("desfavoravel", t == "Desfavoravel"), counted("abstencao", t == "Abstencao"),
        counted("impedido", (t == "Ausente") & (away == "impedimento")), counted("ausente", (t == "Ausente") & (away != "impedimento")),
        counted("nominais", P.is_nominal()), counted("inferidos", ~P.is_nominal()), counted("divergente", F.col("is_divergente") & P.is_nominal()),
    )
    last = s.mandatos.groupBy("diretor_id").agg(F.max("data_inicio").alias("ultimo_mandato"), F.max_by("fonte_dado", F.struct("data_inicio", "fonte_dado")).alias("fonte"))
    written = final(s).groupBy(F.replace("relator", F.lit("Diretor "), F.lit("")).alias("nome")).agg(F.count("*").alias("relatorias"))
    rows = s.diretores.withColumnRenamed("id", "diretor_id").where("review_status <> 'rejeitado'")
    rows = rows.join(of, "diretor_id", "left").join(last, "diretor_id", "left").join(written, "nome", "left")
    trusted = F.coalesce(F.col("fonte") != "automatico", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.where(trusted | F.col("efetivos").isNotNull()).select(
        "diretor_id", "agencia_id", *[zero(c) for c in ("efetivos", "favoravel", "desfavoravel", "abstencao", "impedido", "ausente", "nominais", "inferidos", "divergente")],
        P.rate(F.col("favoravel"), F.col("efetivos")).alias("pct_favor"), "ultimo_mandato", trusted.alias("mandato_confiavel"), zero("relatorias"),
    )


@query("votacao_distribution", "select tipo_voto, count(*) total, 100e0 * count(*) / sum(count(*)) over () pct from v group by 1")
def vote_distribution(s: Star) -> DataFrame:
    """#74: votes by kind and their share."""
    kinds = s.votos.groupBy("tipo_voto").agg(F.count("*").alias("total"))  # four rows
    return kinds.select("tipo_voto", "total", P.rate(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(0)))).alias("pct"))


@query("votacao_fidelidade", "select diretor_id, count(*) total, count(*) filter (is_divergente) divergente, (1 - count(*) filter (is_divergente) / cast(count(*) as double)) * 100 fidelidade from v group by 1")
def loyalty(s: Star) -> DataFrame:
    """#75: share of votes with the board."""
    apart = F.count_if("is_divergente")
    return s.votos.groupBy("diretor_id").agg(F.count("*").alias("total"), apart.alias("divergente"), ((1 - apart / F.count("*")) * 100).alias("fidelidade"))


@query("votacao_sectors", "select area_regulatoria, cast(sum(greatest(coalesce(n, 0), 1)) as bigint) total from deliberacoes d left join (select deliberacao_id, count(*) n from v group by 1) x on x.deliberacao_id = d.id group by 1")
def sectors(s: Star) -> DataFrame:
    """#76: votes by sector, at least one for a decision."""
    n = s.votos.groupBy("deliberacao_id").agg(F.count("*").alias("n"))
    rows = s.deliberacoes.join(n, F.col("id") == F.col("deliberacao_id"), "left")
    return rows.groupBy("area_regulatoria").agg(F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("total"))


_PER_DECISION = """, pd as (select f.id, f.agencia_id, f.data_reuniao, f.numero_reuniao, count(v.diretor_id) votos, count(*) filter (v.nominal) nominais,
  count(v.diretor_id) filter (not v.nominal) inferidos, case when count(v.diretor_id) filter (v.tipo_voto <> 'Ausente') = 0 then null
  else not coalesce(bool_or(v.is_divergente and v.tipo_voto <> 'Ausente'), false) end consensual
  from f left join v on v.deliberacao_id = f.id group by 1, 2, 3, 4)
"""


def per_decision(s: Star, *keep: str) -> DataFrame:
    """A row per final decision with its vote counts and consensus (null without a base)."""
    votes = s.votos.groupBy(F.col("deliberacao_id").alias("id")).agg(
        F.count("*").alias("votos"), F.count_if(P.is_nominal()).alias("nominais"), F.count_if(~P.is_nominal()).alias("inferidos"),
        P.consensus(F.col("diretor_id"), F.col("is_divergente"), F.col("tipo_voto")).alias("consensual"),
    )
    rows = final(s).select("id", *keep).join(votes, "id", "left")
    return rows.fillna(0, ["votos", "nominais", "inferidos"])


_MEETING = """count(*) total_itens, count(consensual) itens_com_voto, cast(sum(votos) as bigint) total_votos, cast(sum(nominais) as bigint) votos_nominais,
  cast(sum(inferidos) as bigint) votos_inferidos, count(*) filter (not consensual) divergencias, 100e0 * count(*) filter (consensual) / nullif(count(consensual), 0) pct_consenso"""


def meeting_counts() -> list[F.Column]:
    return [
        F.count("*").alias("total_itens"), F.count("consensual").alias("itens_com_voto"), F.sum("votos").alias("total_votos"), F.sum("nominais").alias("votos_nominais"),
        F.sum("inferidos").alias("votos_inferidos"), counted("divergencias", ~F.col("consensual")), P.rate(F.count_if("consensual"), F.count("consensual")).alias("pct_consenso"),
    ]


@query("reunioes_list", _PER_DECISION + f"select agencia_id, data_reuniao, coalesce(numero_reuniao, '') numero_reuniao, {_MEETING} from pd where data_reuniao is not null group by 1, 2, 3")
def meetings(s: Star) -> DataFrame:
    """#77, #109: a row per meeting (agency, date, number)."""
    rows = per_decision(s, "agencia_id", "data_reuniao", "numero_reuniao").where("data_reuniao is not null")
    return rows.groupBy("agencia_id", "data_reuniao", F.coalesce("numero_reuniao", F.lit("")).alias("numero_reuniao")).agg(*meeting_counts())


@query("consenso_timeline", _PER_DECISION + f"select strftime(data_reuniao, '%Y-%m') periodo, {_MEETING}, 100e0 * count(*) filter (nominais > 0) / count(*) cobertura_nominal from pd where data_reuniao is not null group by 1")
def consensus_timeline(s: Star) -> DataFrame:
    """#79: consensus by month; decisions without a base leave its denominator."""
    rows = per_decision(s, "data_reuniao").where("data_reuniao is not null")
    nominal = P.rate(F.count_if(F.col("nominais") > 0), F.count("*")).alias("cobertura_nominal")
    return rows.groupBy(F.date_format("data_reuniao", MONTH).alias("periodo")).agg(*meeting_counts(), nominal)


@query(
    "reuniao_detalhe",
    ", m as (select id from f where agencia_id = 3 and strftime(data_reuniao, '%Y-%m') = '1995-03')" + _VOTES + " from v join m on m.id = v.deliberacao_id group by 1",
)
def meeting_detail(s: Star, agency: int = 3, month: str = "1995-03") -> DataFrame:
    """#78: votes of each director in one meeting or month; both filters reach the decision scan."""
    own = final(s).where((F.col("agencia_id") == agency) & (F.date_format("data_reuniao", MONTH) == month)).select(F.col("id").alias("deliberacao_id"))
    return vote_counts(s.votos.join(own, "deliberacao_id", "left_semi"), "diretor_id")


@query("mandatos_from_votes", "select v.diretor_id, min(d.data_reuniao) data_inicio from v join deliberacoes d on d.id = v.deliberacao_id group by 1")
def mandates_from_votes(s: Star) -> DataFrame:
    """#80: the earliest vote of each director."""
    dated = s.deliberacoes.select(F.col("id").alias("deliberacao_id"), "data_reuniao")
    return s.votos.join(dated, "deliberacao_id").groupBy("diretor_id").agg(F.min("data_reuniao").alias("data_inicio"))


@query(
    "mandatos_status",
    f"""select diretor_id, agencia_id, data_inicio, data_fim, case when data_fim is null or data_fim >= date '{TODAY}' then 'Ativo' else 'Encerrado' end status,
        case when data_fim is null then null else cast(data_fim - date '{TODAY}' as bigint) end dias_restantes,
        case when data_fim is null then null else least(100e0, greatest(0e0, 100e0 * (date '{TODAY}' - data_inicio) / nullif(data_fim - data_inicio, 0))) end pct_decorrido,
        case when data_fim is null then 'vigente' when data_fim - date '{TODAY}' < 0 then 'vencido' when data_fim - date '{TODAY}' < 90 then 'vencendo' else 'vigente' end situacao from mandatos""",
)
def mandate_status(s: Star) -> DataFrame:
    """#81, #154: status by today, days left, share elapsed; an open end is in force."""
    left = F.datediff("data_fim", s.day).cast("long")
    done = F.try_divide(F.lit(100.0) * F.datediff(s.day, "data_inicio"), F.datediff("data_fim", "data_inicio"))
    ends = F.col("data_fim").isNotNull()
    return s.mandatos.select(
        "diretor_id", "agencia_id", "data_inicio", "data_fim", F.when(~ends | (F.col("data_fim") >= s.day), "Ativo").otherwise("Encerrado").alias("status"),
        left.alias("dias_restantes"), F.when(ends, F.least(F.lit(100.0), F.greatest(F.lit(0.0), done))).alias("pct_decorrido"),
        F.when(left < 0, "vencido").when(left < 90, "vencendo").otherwise("vigente").alias("situacao"),
    )


@query(
    "mandatos_stats",
    _PER_DECISION + f"""select (select count(distinct diretor_id) from mandatos where data_fim is null or data_fim >= date '{TODAY}') diretores_ativos,
      (select count(*) from v join f on f.id = v.deliberacao_id) participacoes, count(*) total_deliberacoes, 100e0 * count(*) filter (consensual) / nullif(count(consensual), 0) consenso from pd""",
)
def mandate_stats(s: Star) -> DataFrame:
    """#82: directors in office, participations and consensus."""
    active = s.mandatos.where(F.col("data_fim").isNull() | (F.col("data_fim") >= s.day)).agg(F.count_distinct("diretor_id").alias("diretores_ativos"))
    whole = per_decision(s).agg(F.sum("votos").alias("participacoes"), F.count("*").alias("total_deliberacoes"), P.rate(F.count_if("consensual"), F.count("consensual")).alias("consenso"))
    both = active.unionByName(whole, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query(
    "mandatos_analytics",
    """, x as (select id, estado, positivo, resultado, coalesce(microtema = '1-URGENT', false) or coalesce(resultado = 'Indeferido', false) sancao, bool_or(is_divergente) litigio
       from f left join v on v.deliberacao_id = f.id group by 1, 2, 3, 4, 5)
       select 100e0 * count(*) filter (litigio) / count(*) taxa_litigio, 100e0 * count(*) filter (estado = 'decidido' and sancao) / nullif(count(*) filter (estado = 'decidido'), 0) taxa_sancao,
       100e0 * count(*) filter (estado = 'decidido' and positivo) / nullif(count(*) filter (estado = 'decidido'), 0) taxa_deferimento from x""",
)
def mandate_analytics(s: Star) -> DataFrame:
    """#83: litigation, sanction and grant rates; sanctions over decided rows only."""
    apart = s.votos.groupBy(F.col("deliberacao_id").alias("id")).agg(F.bool_or("is_divergente").alias("litigio"))
    rows, decided = final(s).join(apart, "id", "left"), P.on_merits()
    return rows.agg(
        P.rate(F.count_if("litigio"), F.count("*")).alias("taxa_litigio"), P.rate(F.count_if(decided & P.is_sanction(theme="1-URGENT")), F.count_if(decided)).alias("taxa_sancao"),
        P.rate(F.count_if(decided & P.is_positive()), F.count_if(decided)).alias("taxa_deferimento"),
    )


@query("resultado_distribution", "select coalesce(resultado, 'Sem resultado') resultado, strftime(data_reuniao, '%Y-%m') mes, count(*) total from f group by 1, 2")
def result_distribution(s: Star) -> DataFrame:
    """#83: results by month."""
    return final(s).groupBy(F.coalesce("resultado", F.lit("Sem resultado")).alias("resultado"), F.date_format("data_reuniao", MONTH).alias("mes")).agg(F.count("*").alias("total"))


@query(
    "diretores_dimension",
    "select v.diretor_id, arg_min(f.agencia_id, (f.data_reuniao, f.id)) agencia_id, min(f.data_reuniao) primeira from v join f on f.id = v.deliberacao_id where f.data_reuniao is not null group by 1",
)
def director_dimension(s: Star) -> DataFrame:
    """#84: the agency that a director is first seen in; ties by decision id."""
    dated = final(s).where("data_reuniao is not null").select(F.col("id").alias("deliberacao_id"), "agencia_id", "data_reuniao")
    rows = s.votos.join(dated, "deliberacao_id")
    return rows.groupBy("diretor_id").agg(F.min_by("agencia_id", F.struct("data_reuniao", "deliberacao_id")).alias("agencia_id"), F.min("data_reuniao").alias("primeira"))


@query(
    "diretor_profile",
    """, x as (select v.*, d.microtema from v join deliberacoes d on d.id = v.deliberacao_id),
       t as (select diretor_id, microtema, count(*) n, row_number() over (partition by diretor_id order by count(*) desc, microtema) r from x where tipo_voto <> 'Ausente' and microtema is not null group by 1, 2),
       a as (select diretor_id, count(*) filter (tipo_voto = 'Favoravel') favoravel, count(*) filter (tipo_voto = 'Desfavoravel') desfavoravel, count(*) filter (tipo_voto = 'Abstencao') abstencao,
         count(*) filter (tipo_voto = 'Ausente') nao_votou, count(*) filter (motivo_nao_voto = 'impedimento') impedido, count(*) filter (nominal and tipo_voto <> 'Ausente') base_nominal,
         100e0 * count(*) filter (nominal and tipo_voto <> 'Ausente' and is_divergente) / nullif(count(*) filter (nominal and tipo_voto <> 'Ausente'), 0) pct_divergente_nominal from x group by 1)
       select a.*, case when pct_divergente_nominal is null then null when pct_divergente_nominal < 5 then 'Consensual' when pct_divergente_nominal < 15 then 'Moderadamente divergente' else 'Divergente' end perfil,
         t.microtema microtema_dominante from a left join t on t.diretor_id = a.diretor_id and t.r = 1""",
)
def director_profile(s: Star) -> DataFrame:
    """#85, #118: counts, divergence on the nominal base, profile and dominant theme (ties by name)."""
    t = F.col("tipo_voto")
    voted = t != "Ausente"
    rows = s.votos.join(s.deliberacoes.select(F.col("id").alias("deliberacao_id"), "microtema"), "deliberacao_id")
    base = P.is_nominal() & voted
    a = rows.groupBy("diretor_id").agg(
        counted("favoravel", t == "Favoravel"), counted("desfavoravel", t == "Desfavoravel"), counted("abstencao", t == "Abstencao"), counted("nao_votou", ~voted),
        counted("impedido", F.col("motivo_nao_voto") == "impedimento"), counted("base_nominal", base),
        P.rate(F.count_if(base & F.col("is_divergente")), F.count_if(base)).alias("pct_divergente_nominal"),
    )
    themes = rows.where(voted & F.col("microtema").isNotNull()).groupBy("diretor_id", "microtema").agg(F.count("*").alias("n"))
    top = themes.groupBy("diretor_id").agg(F.min_by("microtema", F.struct(-F.col("n"), "microtema")).alias("microtema_dominante"))
    p = F.col("pct_divergente_nominal")
    profile = F.when(p < 5, "Consensual").when(p < 15, "Moderadamente divergente").when(p.isNotNull(), "Divergente")
    return a.join(top, "diretor_id", "left").withColumn("perfil", profile)


@query(
    "relatoria",
    """, r as (select replace(relator, 'Diretor ', '') nome, * exclude (relator) from f where relator is not null)
       select d.id diretor_id, count(*) relatadas, count(*) filter (estado = 'decidido') decididas, count(*) filter (estado = 'decidido' and positivo) deferidas, count(*) filter (estado = 'retirado') retiradas,
       100e0 * count(*) filter (estado = 'decidido' and positivo) / nullif(count(*) filter (estado = 'decidido'), 0) taxa from r join diretores d on d.nome = r.nome group by 1""",
)
def rapporteurs(s: Star) -> DataFrame:
    """#86: decisions by rapporteur, matched by name less its title."""
    named = final(s).withColumn("nome", F.regexp_replace("relator", "^(Diretor|Diretora|Dr\\.|Dra\\.) ", ""))
    rows = named.join(s.diretores.select(F.col("id").alias("diretor_id"), "nome"), "nome")
    decided = P.on_merits()
    return rows.groupBy("diretor_id").agg(
        F.count("*").alias("relatadas"), counted("decididas", decided), counted("deferidas", decided & P.is_positive()), counted("retiradas", P.status() == "retirado"),
        P.rate(F.count_if(decided & P.is_positive()), F.count_if(decided)).alias("taxa"),
    )


_COMPANY = """, e as (select empresa_id, id, data_reuniao, positivo, resultado, microtema, row_number() over (partition by empresa_id order by coalesce(cast(data_reuniao as varchar), ''), id) k,
    count(*) over (partition by empresa_id) n from f),
  c as (select empresa_id, count(*) total, count(*) filter (positivo) deferidos, count(*) filter (resultado = 'Indeferido') indeferidos, 100e0 * count(*) filter (positivo) / count(*) pct_deferido,
    max(data_reuniao) ultima, count(distinct microtema) temas, 100e0 * count(*) filter (positivo and k <= n // 2) / nullif(count(*) filter (k <= n // 2), 0) ant,
    100e0 * count(*) filter (positivo and k > n // 2) / nullif(count(*) filter (k > n // 2), 0) rec from e group by 1)
"""


@query(
    "empresas_ranking",
    _COMPANY + """select empresa_id, total, deferidos, indeferidos, pct_deferido, ultima, temas, case when pct_deferido < 40 then 'alto' when pct_deferido < 70 then 'medio' else 'baixo' end risco,
      case when coalesce(rec, pct_deferido) - coalesce(ant, pct_deferido) > 5 then 'melhorando' when coalesce(rec, pct_deferido) - coalesce(ant, pct_deferido) < -5 then 'piorando' else 'estavel' end tendencia from c""",
)
def companies(s: Star) -> DataFrame:
    """#87, #114: totals and rates over all rows, risk, and the trend between a history's halves."""
    history = Window.partitionBy("empresa_id").orderBy(F.coalesce(F.col("data_reuniao").cast("string"), F.lit("")), "id")
    rows = final(s).select("empresa_id", "id", "data_reuniao", "microtema", P.is_positive().alias("positivo"), P.is_denied().alias("negado"))
    rows = rows.withColumn("k", F.row_number().over(history)).withColumn("n", F.count("*").over(Window.partitionBy("empresa_id")))
    early, good = F.col("k") <= F.floor(F.col("n") / 2), F.col("positivo")
    pct = P.rate(F.count_if(good), F.count("*"))
    out = rows.groupBy("empresa_id").agg(
        F.count("*").alias("total"), counted("deferidos", good), counted("indeferidos", F.col("negado")), pct.alias("pct_deferido"), F.max("data_reuniao").alias("ultima"),
        F.count_distinct("microtema").alias("temas"), P.rate(F.count_if(good & early), F.count_if(early)).alias("ant"), P.rate(F.count_if(good & ~early), F.count_if(~early)).alias("rec"),
    )
    p = F.col("pct_deferido")
    step = F.coalesce("rec", p) - F.coalesce("ant", p)
    return out.select(
        "empresa_id", "total", "deferidos", "indeferidos", "pct_deferido", "ultima", "temas", F.when(p < 40, "alto").when(p < 70, "medio").otherwise("baixo").alias("risco"),
        F.when(step > 5, "melhorando").when(step < -5, "piorando").otherwise("estavel").alias("tendencia"),
    )


@query(
    "empresa_detalhe",
    f"""select strftime(data_reuniao, '%Y-%m') mes, coalesce(microtema, 'outros') microtema, count(*) total, count(*) filter (positivo) deferidos,
        count(*) filter (resultado = 'Indeferido' and data_reuniao >= date '{TODAY}' - 90) alerta_90d from f where empresa_id = 34 group by 1, 2""",
)
def company_detail(s: Star, company: int = 34) -> DataFrame:
    """#88: one company by month and theme; the company reaches the scan."""
    recent = P.is_denied() & (F.col("data_reuniao") >= F.date_sub(s.day, 90))
    rows = final(s).where(F.col("empresa_id") == company)
    return rows.groupBy(F.date_format("data_reuniao", MONTH).alias("mes"), F.coalesce("microtema", F.lit("outros")).alias("microtema")).agg(
        F.count("*").alias("total"), counted("deferidos", P.is_positive()), counted("alerta_90d", recent)
    )


@query(
    "alertas",
    f"""select * from (
       select 'empresa_risco' tipo, 'high' severity, cast(empresa_id as varchar) entidade, count(*) valor from f where resultado = 'Indeferido' and data_reuniao >= date '{TODAY}' - 1000 group by empresa_id having count(*) >= 3
       union all select 'tema_emergente', 'medium', microtema, rec from (select microtema, count(*) filter (m >= '1998-02') rec, count(*) filter (m < '1998-02' and m >= '1997-08') ant from
         (select microtema, strftime(data_reuniao, '%Y-%m') m from f where microtema is not null and data_reuniao is not null) group by 1) where ant > 0 and rec >= 3 and (rec - ant) * 100e0 / ant > 20
       union all select 'diretor_divergente', 'medium', cast(diretor_id as varchar), d from (select diretor_id, count(*) n, count(*) filter (is_divergente) d from v join f on f.id = v.deliberacao_id group by 1) where n >= 5 and d * 100e0 / n > 20)""",
)
def alerts(s: Star, days: int = 1000, recent: str = "1998-02", before: str = "1997-08", apart: float = 20.0) -> DataFrame:
    """#89: companies denied often, themes that grow, directors that diverge."""
    f = final(s)
    risk = f.where(P.is_denied() & (F.col("data_reuniao") >= F.date_sub(s.day, days))).groupBy("empresa_id").agg(F.count("*").alias("valor")).where("valor >= 3")
    risk = risk.select(F.lit("empresa_risco").alias("tipo"), F.lit("high").alias("severity"), F.col("empresa_id").cast("string").alias("entidade"), "valor")
    month = F.date_format("data_reuniao", MONTH)
    grown = f.where("microtema is not null and data_reuniao is not null").groupBy("microtema").agg(
        counted("valor", month >= recent), F.count_if((month < recent) & (month >= before)).alias("ant")
    )
    grown = grown.where((F.col("ant") > 0) & (F.col("valor") >= 3) & (F.try_divide((F.col("valor") - F.col("ant")) * F.lit(100.0), F.col("ant")) > 20))
    grown = grown.select(F.lit("tema_emergente").alias("tipo"), F.lit("medium").alias("severity"), F.col("microtema").alias("entidade"), "valor")
    votes = s.votos.join(f.select(F.col("id").alias("deliberacao_id")), "deliberacao_id", "left_semi").groupBy("diretor_id").agg(F.count("*").alias("n"), counted("valor", F.col("is_divergente")))
    votes = votes.where((F.col("n") >= 5) & (F.col("valor") * F.lit(100.0) / F.col("n") > apart))
    votes = votes.select(F.lit("diretor_divergente").alias("tipo"), F.lit("medium").alias("severity"), F.col("diretor_id").cast("string").alias("entidade"), "valor")
    return risk.unionByName(grown).unionByName(votes)


@query(
    "governanca_agencias",
    _PER_DECISION + """, g as (select f.agencia_id, count(*) total, count(*) filter (estado = 'decidido') decidido, count(*) filter (estado = 'retirado') retirado, count(*) filter (estado = 'sem_resultado') sem_resultado,
      count(*) filter (estado = 'admissibilidade') admissibilidade, 100e0 * count(*) filter (consensual) / nullif(count(consensual), 0) consenso, 100e0 * count(*) filter (nominais > 0) / count(*) cobertura_nominal,
      100e0 * count(*) filter (estado = 'decidido' and positivo) / nullif(count(*) filter (estado = 'decidido'), 0) deferimento,
      cast(sum(cast(extraction_confidence as decimal(18,4))) as double) / count(extraction_confidence) qualidade,
      100e0 * count(*) filter (estado = 'decidido' and resultado = 'Indeferido') / nullif(count(*) filter (estado = 'decidido'), 0) sancao from f join pd using (id) group by 1)
      select a.id agencia_id, sigla, coalesce(total, 0) total, coalesce(decidido, 0) decidido, coalesce(retirado, 0) retirado, coalesce(sem_resultado, 0) sem_resultado, coalesce(admissibilidade, 0) admissibilidade,
      consenso, cobertura_nominal, deferimento, qualidade, sancao, cast(round(0.3 * consenso + 0.25 * deferimento + 0.25 * qualidade * 100 + 0.2 * (100 - sancao)) as bigint) score
      from agencias a left join g on g.agencia_id = a.id where ativo""",
)
def governance(s: Star) -> DataFrame:
    """#90, #91: every active agency with its states, rates and the weighted score."""
    decided, state = P.on_merits(), P.status()
    g = per_decision(s, "agencia_id", "juizo", "resultado", "microtema", "extraction_confidence").groupBy("agencia_id").agg(
        F.count("*").alias("total"), counted("decidido", decided), counted("retirado", state == "retirado"), counted("sem_resultado", state == "sem_resultado"), counted("admissibilidade", state == "admissibilidade"),
        P.rate(F.count_if("consensual"), F.count("consensual")).alias("consenso"), P.rate(F.count_if(F.col("nominais") > 0), F.count("*")).alias("cobertura_nominal"),
        P.rate(F.count_if(decided & P.is_positive()), F.count_if(decided)).alias("deferimento"), P.mean(F.col("extraction_confidence")).alias("qualidade"),
        P.rate(F.count_if(decided & P.is_denied()), F.count_if(decided)).alias("sancao"),
    )
    score = F.round(0.3 * F.col("consenso") + 0.25 * F.col("deferimento") + 0.25 * F.col("qualidade") * 100 + 0.2 * (100 - F.col("sancao")))
    rows = s.agencias.where("ativo").select(F.col("id").alias("agencia_id"), "sigla").join(g, "agencia_id", "left")
    return rows.fillna(0, ["total", "decidido", "retirado", "sem_resultado", "admissibilidade"]).withColumn("score", score.cast("long"))


@query(
    "saude_dados",
    """select faixa, estado, count(*) total, count(*) filter (data_reuniao is null) sem_data, count(*) filter (numero_deliberacao is null) sem_numero from
       (select *, case when extraction_confidence is null then 'sem' when extraction_confidence >= 0.85 then 'alta' when extraction_confidence >= 0.60 then 'media' else 'baixa' end faixa from f) group by 1, 2""",
)
def data_health(s: Star) -> DataFrame:
    """#96, #180: decisions by confidence band and state, with gaps of fields."""
    rows = with_status(final(s)).withColumn("faixa", P.confidence_band(F.col("extraction_confidence")))
    return rows.groupBy("faixa", "estado").agg(F.count("*").alias("total"), counted("sem_data", F.col("data_reuniao").isNull()), counted("sem_numero", F.col("numero_deliberacao").isNull()))


@query(
    "completude_ano",
    """select agencia_id, string_agg(estado || '=' || n, ',' order by estado) por_estado, cast(sum(n) as bigint) total, cast(sum(orfas) as bigint) orfas, max(ultima) ultima from
       (select agencia_id, estado, count(*) n, count(*) filter (documento_pai_id is null and tipo_documento = 'ata') orfas, max(data_publicacao) ultima from final
        where coalesce(data_reuniao, data_publicacao) is null or year(coalesce(data_reuniao, data_publicacao)) = 1996 group by 1, 2) group by 1""",
)
def completeness(s: Star, year: int = 1996) -> DataFrame:
    """#39, #97: per agency, the map of states, orphans and the last capture of a year (undated stay)."""
    rows = with_status(s.deliberacoes.where(P.in_year(year))).groupBy("agencia_id", "estado").agg(
        F.count("*").alias("n"), F.count_if(F.col("documento_pai_id").isNull() & (F.col("tipo_documento") == "ata")).alias("orfas"), F.max("data_publicacao").alias("ultima")
    )
    by_state = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("estado", "n"))), lambda x: F.concat(x["estado"], F.lit("="), x["n"].cast("string"))), ",")
    return rows.groupBy("agencia_id").agg(by_state.alias("por_estado"), F.sum("n").alias("total"), F.sum("orfas").alias("orfas"), F.max("ultima").alias("ultima"))


@query(
    "votos_diretores_relatorio",
    "select f.agencia_id, v.diretor_id, strftime(data_reuniao, '%Y-%m') mes, count(*) total, count(*) filter (nominal) nominais, count(*) filter (tipo_voto = 'Favoravel') favoravel from v join f on f.id = v.deliberacao_id group by 1, 2, 3",
)
def votes_report(s: Star) -> DataFrame:
    """#100: votes per agency, director and month."""
    rows = s.votos.join(final(s).select(F.col("id").alias("deliberacao_id"), "agencia_id", "data_reuniao"), "deliberacao_id")
    return rows.groupBy("agencia_id", "diretor_id", F.date_format("data_reuniao", MONTH).alias("mes")).agg(
        F.count("*").alias("total"), counted("nominais", P.is_nominal()), counted("favoravel", F.col("tipo_voto") == "Favoravel")
    )


@query(
    "defasagem_publicacao",
    "select agencia_id, count(*) n, case when count(*) >= 5 then median(data_publicacao - data_reuniao) end mediana from f where data_publicacao >= data_reuniao group by 1",
)
def publication_lag(s: Star, least: int = 5) -> DataFrame:
    """#166, #167: the median days from meeting to publication, given enough of them."""
    days = F.datediff("data_publicacao", "data_reuniao")
    return final(s).where(days >= 0).groupBy("agencia_id").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.median(days)).alias("mediana"))


@query("top_microtema", "select microtema, count(*) total from f where microtema is not null group by 1 order by total desc, microtema limit 1")
def top_theme(s: Star) -> DataFrame:
    """#66, #118: the most frequent theme, ties by name."""
    return final(s).where("microtema is not null").groupBy("microtema").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "microtema").limit(1)
