"""Audits and repairs: filtered vote listings with counter-proof, presence against votes, board verdicts,
date repair plans, retroactive votes and targeted batches."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import predicates as P
from quorumlake.functions import text as T
from quorumlake.operators.analytics import counted, final
from quorumlake.operators.ordering import by_rank
from quorumlake.operators.roster import attendance
from quorumlake.operators.votes import inferred_vote_rows
from quorumlake.operators.ordering import positions
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star


@dataclass(frozen=True)
class Filters:
    """#40, #41: filters of decisions; what isn't well formed is ignored."""

    agency: int | None = None
    theme: str | None = None
    area: str | None = None
    first: str | None = None
    last: str | None = None
    number: str | None = None
    origin: str | None = None

    @classmethod
    def parse(cls, args: dict[str, str]) -> Filters:
        word = lambda k: v if (v := args.get(k)) and re.fullmatch(r"[\w .-]{1,60}", v) else None
        day = lambda k: v if (v := args.get(k)) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) else None
        agency = args.get("agencia_id", "")
        return cls(
            int(agency) if agency.isdigit() else None, word("microtema"), word("area_regulatoria"), day("date_from"), day("date_to"), (args.get("numero_reuniao") or "")[:10] or None,
            o if (o := args.get("origem")) in ("lido", "inferido") else None,
        )

    def decisions(self, df: DataFrame, dated: bool = True) -> DataFrame:
        for column, value in (("agencia_id", self.agency), ("microtema", self.theme), ("area_regulatoria", self.area), ("numero_reuniao", self.number)):
            if value is not None:
                df = df.where(F.col(column) == value)
        if dated and self.first:
            df = df.where(F.col("data_reuniao") >= F.to_date(F.lit(self.first)))
        if dated and self.last:
            df = df.where(F.col("data_reuniao") <= F.to_date(F.lit(self.last)))
        return df

    def votes(self, df: DataFrame) -> DataFrame:
        return df if self.origin is None else df.where(P.is_nominal() if self.origin == "lido" else ~P.is_nominal())


SHOWN = Filters.parse({"agencia_id": "4", "microtema": "2-HIGH", "date_from": "1996-01-01", "date_to": "1997-12-31", "origem": "lido", "area_regulatoria": "x;drop"})


@query(
    "auditoria_votos",
    "select v.deliberacao_id, v.diretor_id, v.tipo_voto, case when nominal then 'lido' else 'inferido' end origem, f.data_reuniao from v join f on f.id = v.deliberacao_id where agencia_id = 4 and microtema = '2-HIGH' and data_reuniao between date '1996-01-01' and date '1997-12-31' and nominal",
)
def audited_votes(s: Star, f: Filters = SHOWN) -> DataFrame:
    """#40, #41, #168: the votes that a filter shows, with their origin."""
    own = f.decisions(final(s)).select(F.col("id").alias("deliberacao_id"), "data_reuniao")
    rows = f.votes(s.votos).join(own, "deliberacao_id")
    return rows.select("deliberacao_id", "diretor_id", "tipo_voto", F.when(P.is_nominal(), "lido").otherwise("inferido").alias("origem"), "data_reuniao")


@query("auditoria_contraprova", "select year(f.data_reuniao) ano, count(*) votos from v join f on f.id = v.deliberacao_id where agencia_id = 4 and microtema = '2-HIGH' and nominal and (data_reuniao is null or data_reuniao < date '1996-01-01' or data_reuniao > date '1997-12-31') group by 1")
def counter_proof(s: Star, f: Filters = SHOWN) -> DataFrame:
    """#168: votes that only the window leaves out, by year; they tell an empty page from a lack of data."""
    day = F.col("data_reuniao")
    outside = day.isNull() | (day < F.to_date(F.lit(f.first or "0001-01-01"))) | (day > F.to_date(F.lit(f.last or "9999-12-31")))
    own = f.decisions(final(s), dated=False).where(outside).select(F.col("id").alias("deliberacao_id"), F.year(day).alias("ano"))
    return f.votes(s.votos).join(own, "deliberacao_id").groupBy("ano").agg(F.count("*").alias("votos"))


_PRESENT = """, d as (select id, agencia_id, data_reuniao from f where data_reuniao is not null),
  p as (select distinct d.id, m.diretor_id from d join mandatos m on m.agencia_id = d.agencia_id and m.data_inicio <= d.data_reuniao and (m.data_fim is null or m.data_fim >= d.data_reuniao)
    and not coalesce(m.afastado_desde <= d.data_reuniao and (m.afastado_ate is null or m.afastado_ate >= d.data_reuniao), false)),
  w as (select deliberacao_id id, diretor_id, tipo_voto from v where deliberacao_id in (select id from d) and tipo_voto <> 'Ausente')
"""


def _present(s: Star) -> DataFrame:
    """Dated final decisions with who is in office, who voted, and who did both."""
    days = final(s).where("data_reuniao is not null").select("id", "agencia_id", "data_reuniao")
    return attendance(days, s.votos.where("tipo_voto <> 'Ausente'").select(F.col("deliberacao_id").alias("id"), "diretor_id"), s.mandatos)


@query("presenca_divergente", _PRESENT + "select coalesce(p.id, w.id) id, count(*) filter (p.id is null) votou_sem_presenca, count(*) filter (w.id is null) presente_sem_voto from p full join w on p.id = w.id and p.diretor_id = w.diretor_id group by 1")
def presence(s: Star) -> DataFrame:
    """#169: those who voted without being present, and the reverse."""
    less = lambda c: F.col(c) - F.col("sentados")
    return _present(s).where("cadeiras > 0 or presentes > 0").select("id", less("presentes").alias("votou_sem_presenca"), less("cadeiras").alias("presente_sem_voto"))


@query(
    "veredito_roster",
    _PRESENT + """, a as (select d.id, (select count(*) from p where p.id = d.id) cadeiras, (select count(*) from w where w.id = d.id) presentes, (select count(*) from w where w.id = d.id and not exists (select 1 from p where p.id = w.id and p.diretor_id = w.diretor_id)) orfaos from d)
      select motivo, count(*) n from (select case when cadeiras = 0 then 'roster_vazio' when id % 2 = 0 and presentes > 0 then case when orfaos > 0 then 'roster_diverge_da_presenca' else 'roster_confere_com_presenca' end
        when id % 5 = 0 and presentes > 0 then case when orfaos > 0 then 'roster_diverge_da_assinatura' else 'roster_confere_com_assinatura' end when id % 7 = 0 then 'cadastro_incompleto' else 'roster_nao_conferivel' end motivo from a) group by 1""",
)
def board_verdict(s: Star) -> DataFrame:
    """#153, #178: an empty board, then the list of those present, then signatures, then pending
    candidates, else not verifiable. Even ids stand for minutes that name those present, multiples of
    five for signed ones, of seven for agencies with candidates."""
    a = _present(s).withColumn("orfaos", F.col("presentes") - F.col("sentados"))
    named = F.col("presentes") > 0
    either = lambda kind: F.when(F.col("orfaos") > 0, f"roster_diverge_da_{kind}").otherwise(f"roster_confere_com_{kind}")
    say = (
        F.when(F.col("cadeiras") == 0, "roster_vazio").when((F.col("id") % 2 == 0) & named, either("presenca")).when((F.col("id") % 5 == 0) & named, either("assinatura"))
        .when(F.col("id") % 7 == 0, "cadastro_incompleto").otherwise("roster_nao_conferivel")
    )
    return a.groupBy(say.alias("motivo")).agg(F.count("*").alias("n"))


@query("direcao_trocada", "select v.deliberacao_id id, count(*) autores_contra from v join f on f.id = v.deliberacao_id join diretores d on d.id = v.diretor_id where tipo_voto = 'Desfavoravel' and positivo and d.id % 10 = f.id % 10 group by 1")
def wrong_direction(s: Star) -> DataFrame:
    """#101, #170: directors read as against who wrote the vote that was approved."""
    own = final(s).where(P.is_positive()).select(F.col("id").alias("deliberacao_id"))
    rows = s.votos.where((F.col("tipo_voto") == "Desfavoravel") & (F.col("diretor_id") % 10 == F.col("deliberacao_id") % 10)).join(own, "deliberacao_id", "left_semi")
    return rows.join(s.diretores.select(F.col("id").alias("diretor_id")), "diretor_id", "left_semi").groupBy(F.col("deliberacao_id").alias("id")).agg(F.count("*").alias("autores_contra"))


@query(
    "reparo_de_datas",
    """, ref as (select agencia_id, coalesce(serie, '') serie, cast(numero_reuniao as int) k, data_reuniao from f where numero_reuniao is not null and data_reuniao is not null and year(data_reuniao) = 1996),
       g as (select agencia_id, serie, k, count(distinct data_reuniao) n, min(data_reuniao) dia from ref group by 1, 2, 3),
       o as (select *, lag(dia) over w antes, lead(dia) over w depois from g window w as (partition by agencia_id, serie order by k)),
       t as (select id, agencia_id, coalesce(serie, '') serie, cast(numero_reuniao as int) k, data_reuniao from f where numero_reuniao is not null and documento_pai_id is null)
       select t.id, case when n > 1 then 'referencia_ambigua' when dia <= antes or dia >= depois then 'fora_da_ordem_da_serie' when dia = t.data_reuniao then 'ja_certa' else 'corrigir' end motivo,
         case when n = 1 and not coalesce(dia <= antes or dia >= depois, false) then dia end para from t join o using (agencia_id, serie, k)""",
)
def date_repair(s: Star) -> DataFrame:
    """#155: a date from the reference, if it has one date for the number and keeps the series' order."""
    def keyed(df: DataFrame, *more) -> DataFrame:
        return df.where("numero_reuniao is not null").select("agencia_id", F.coalesce("serie", F.lit("")).alias("serie"), T.ordinal(F.col("numero_reuniao")).alias("k"), "data_reuniao", *more)

    ref = keyed(final(s).where(F.col("data_reuniao").isNotNull() & (F.year("data_reuniao") == 1996)))
    g = ref.groupBy("agencia_id", "serie", "k").agg(F.count_distinct("data_reuniao").alias("n"), F.min("data_reuniao").alias("dia"))
    w = Window.partitionBy("agencia_id", "serie").orderBy("k")
    o = g.select("*", F.lag("dia").over(w).alias("antes"), F.lead("dia").over(w).alias("depois"))
    t = keyed(final(s).where("documento_pai_id is null"), "id")
    order = F.coalesce((F.col("dia") <= F.col("antes")) | (F.col("dia") >= F.col("depois")), F.lit(False))
    say = F.when(F.col("n") > 1, "referencia_ambigua").when(order, "fora_da_ordem_da_serie").when(F.col("dia") == F.col("data_reuniao"), "ja_certa").otherwise("corrigir")
    return t.join(o, ["agencia_id", "serie", "k"]).select("id", say.alias("motivo"), F.when((F.col("n") == 1) & ~order, F.col("dia")).alias("para"))


@query(
    "lote_com_alvo",
    """, p as (select id, regexp_replace(coalesce(numero_deliberacao, ''), '\\D', '', 'g') n, row_number() over (order by id) - 1 k from f)
       select id, alvo from (select id, alvo, row_number() over (order by alvo desc, id) r from (select id, n in ('7', '113', '250') alvo, k from p) where alvo or k between 100 and 149) where r <= 60""",
)
def targeted_batch(s: Star, targets: tuple[str, ...] = ("7", "113", "250"), start: int = 100, end: int = 150, ceiling: int = 60) -> DataFrame:
    """#127: rows of target numbers first, then those of the window, up to the ceiling."""
    own = final(s).select("id", F.regexp_replace(F.coalesce("numero_deliberacao", F.lit("")), r"\D", "").isin(*targets).alias("alvo"))
    p = positions(own, "id").withColumn("k", F.col("n") - 1)
    return p.where(F.col("alvo") | F.col("k").between(start, end - 1)).orderBy(F.desc("alvo"), "id").limit(ceiling).select("id", "alvo")


@query("imagens_repetidas", "select event_id, case when n > 1 then d end duplicata_de from (select event_id, row_number() over w n, first_value(event_id) over w d from events where event_type = 'view' window w as (partition by props order by ts, event_id))", tables=False)
def image_dedup(s: Star) -> DataFrame:
    """#139: the first article owns an image; later ones point to it."""
    e = s.table("events").where("event_type = 'view'")
    first = e.groupBy("props").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("d"))
    rows = e.join(first, "props")
    return rows.select("event_id", F.when(F.col("event_id") != F.col("d"), F.col("d")).alias("duplicata_de"))


@query("abreviacoes", "select a.id a, b.id b from diretores a join diretores b on a.agencia_id = b.agencia_id and a.id <> b.id where a.id % 10 = b.id % 10 and a.id < b.id")
def abbreviations(s: Star) -> DataFrame:
    """#140: pairs of an agency in which a name is a strict abbreviation of the other. Names are made of
    the last digit of an id here, the longer ones with a middle name."""
    digit = (F.col("id") % 10).cast("string")
    short = s.diretores.select("agencia_id", F.col("id").alias("a"), F.concat(F.lit("Ana Souza"), digit).alias("x"))
    long = s.diretores.select("agencia_id", F.col("id").alias("b"), F.concat(F.lit("Ana de Lima Souza"), digit).alias("y"))
    return abbreviation_pairs(short, long).where("a < b")


def abbreviation_pairs(short: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b) of rows of short (agencia_id, a, x) and long (agencia_id, b, y) of one agency in which x is a strict abbreviation of y.

    Names are compared once each, and only those that begin alike; then ids meet by their names.
    """
    of = lambda df, c: df.select("agencia_id", c, F.get(T.name_tokens(F.col(c)), F.lit(0)).alias("primeiro")).where("primeiro is not null").distinct()
    alike = of(short, "x").join(of(long, "y"), ["agencia_id", "primeiro"]).where(T.strict_abbreviation(F.col("x"), F.col("y"))).select("agencia_id", "x", "y")
    return short.join(alike, ["agencia_id", "x"]).join(long, ["agencia_id", "y"]).select("a", "b")


@query(
    "votos_retroativos",
    """, d as (select id, resultado from f where agencia_id = 6 and year(data_reuniao) = 1997 and resultado is not null and resultado <> 'Retirado de Pauta')
       select d.id deliberacao_id, case when resultado = 'Indeferido' then 'Desfavoravel' else 'Favoravel' end tipo_voto from d where not exists (select 1 from v where v.deliberacao_id = d.id and v.diretor_id = 31)""",
)
def retroactive_votes(s: Star, agency: int = 6, year: int = 1997, director: int = 31) -> DataFrame:
    """#142: votes of a newly approved director on decisions that hold none of theirs."""
    own = final(s).where((F.col("agencia_id") == agency) & (F.year("data_reuniao") == year)).select(F.col("id").alias("deliberacao_id"), "resultado")
    held = s.votos.where(F.col("diretor_id") == director).select("deliberacao_id")
    return inferred_vote_rows(own).join(held, "deliberacao_id", "left_anti")


@query("pauta_fora_do_ano", "select case when year(data_publicacao) is null then 'sem_ano' when year(data_publicacao) <> 1997 then 'fora' else 'dentro' end situacao, count(*) n from deliberacoes where tipo_documento = 'pauta' group by 1")
def agenda_out_of_year(s: Star, year: int = 1997) -> DataFrame:
    """#46: agendas that are of another year."""
    y = F.year("data_publicacao")
    say = F.when(y.isNull(), "sem_ano").when(y != year, "fora").otherwise("dentro")
    return s.deliberacoes.where("tipo_documento = 'pauta'").groupBy(say.alias("situacao")).agg(F.count("*").alias("n"))


@query("ausencias_por_motivo", "select f.agencia_id, coalesce(motivo_nao_voto, 'sem_motivo') motivo, count(*) n, count(distinct v.diretor_id) diretores from v join f on f.id = v.deliberacao_id where tipo_voto = 'Ausente' group by 1, 2")
def absences(s: Star) -> DataFrame:
    """#101: absences by agency and reason."""
    rows = s.votos.where("tipo_voto = 'Ausente'").join(final(s).select(F.col("id").alias("deliberacao_id"), "agencia_id"), "deliberacao_id")
    return rows.groupBy("agencia_id", F.coalesce("motivo_nao_voto", F.lit("sem_motivo")).alias("motivo")).agg(F.count("*").alias("n"), F.count_distinct("diretor_id").alias("diretores"))


@query("diagnostico_inferencia", "select case when documento_pai_id is not null then 'item' else 'documento' end origem, estado, count(*) n, count(*) filter (unanimidade_detectada) unanimes, count(*) filter (data_reuniao is null) sem_data from f group by 1, 2")
def inference_diagnosis(s: Star) -> DataFrame:
    """#101: what inference has to go on, by origin and state."""
    rows = final(s).withColumn("estado", P.status())
    return rows.groupBy(F.when(F.col("documento_pai_id").isNotNull(), "item").otherwise("documento").alias("origem"), "estado").agg(
        F.count("*").alias("n"), counted("unanimes", F.col("unanimidade_detectada")), counted("sem_data", F.col("data_reuniao").isNull())
    )


#: Alerts from the most to the least severe.
SEVERITY = ("high", "medium", "low")


@query("alertas_ordenados", "select tipo, severity, entidade, valor from (select 'empresa_risco' tipo, case when count(*) > 12 then 'high' when count(*) > 6 then 'medium' else 'low' end severity, empresa_id entidade, count(*) valor from f where resultado = 'Indeferido' group by empresa_id) order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, valor desc, entidade limit 30")
def ordered_alerts(s: Star, size: int = 30) -> DataFrame:
    """#121: sorted by rank of severity, then count, then entity."""
    n = F.count("*").alias("valor")
    rows = final(s).where(P.is_denied()).groupBy(F.col("empresa_id").alias("entidade")).agg(n)
    kind = F.when(F.col("valor") > 12, "high").when(F.col("valor") > 6, "medium").otherwise("low")
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col("severity"))
    return rows.select(F.lit("empresa_risco").alias("tipo"), kind.alias("severity"), "entidade", "valor").orderBy(rank, F.desc("valor"), "entidade").limit(size)


@query("evidencia_de_voto", "select (n is not null) tem, (direcao > 0) direcao, count(*) deliberacoes from f left join (select deliberacao_id, count(*) n, count(*) filter (tipo_voto <> 'Ausente') direcao from v group by 1) x on x.deliberacao_id = f.id group by 1, 2")
def vote_evidence(s: Star) -> DataFrame:
    """#35, #37, #38, #42: decisions with votes, and with one that has a direction."""
    n = s.votos.groupBy(F.col("deliberacao_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(P.is_direction()).alias("d"))
    rows = final(s).select("id").join(n, "id", "left")
    return rows.groupBy(F.col("n").isNotNull().alias("tem"), (F.col("d") > 0).alias("direcao")).agg(F.count("*").alias("deliberacoes"))


@query("chaves_de_reuniao", "select count(distinct (agencia_id, data_reuniao, coalesce(numero_reuniao, ''))) reunioes, count(distinct data_reuniao) dias, count(distinct empresa_id) empresas from f where data_reuniao is not null and lower(interessado) ~ '000[0-4]'")
def distinct_keys(s: Star) -> DataFrame:
    """#29, #32, #131: distinct keys of what a pattern and predicates select."""
    rows = final(s).where(F.col("data_reuniao").isNotNull() & F.col("interessado").rlike("(?i)000[0-4]"))
    return rows.agg(F.count_distinct(F.struct("agencia_id", "data_reuniao", F.coalesce("numero_reuniao", F.lit("")))).alias("reunioes"), F.count_distinct("data_reuniao").alias("dias"), F.count_distinct("empresa_id").alias("empresas"))


@query("ultimas_por_diretor", "select diretor_id, deliberacao_id from (select v.diretor_id, v.deliberacao_id, row_number() over (partition by v.diretor_id order by f.data_reuniao desc nulls last, f.id) n from v join f on f.id = v.deliberacao_id) where n <= 5")
def latest_by_director(s: Star) -> DataFrame:
    """#85, #110: each director's latest votes."""
    rows = s.votos.select("deliberacao_id", "diretor_id").join(final(s).select(F.col("id").alias("deliberacao_id"), "data_reuniao"), "deliberacao_id")
    return by_rank(rows, ["diretor_id"], [F.desc_nulls_last("data_reuniao"), "deliberacao_id"]).where("n <= 5").select("diretor_id", "deliberacao_id")
