"""Data-quality rules (a code and a level for each finding), confirmation gates and quality scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import predicates as P
from quorumlake.operators.analytics import final
from quorumlake.operators.roster import roster
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star

# Level of each rule; any `bloqueante` finding refuses a load.
LEVELS = {
    "C03_ITENS_MUITO_ACIMA_DAS_ANCORAS": "aviso", "C03_ITENS_PERDIDOS": "bloqueante", "C04_DUPLICATA_INTRA_ATA": "info", "C05_VOTOS_ACIMA_DO_COLEGIADO": "bloqueante",
    "C06_DECIDIDO_SEM_VOTO": "aviso", "C07_UNANIMIDADE_COM_DISSENSO": "bloqueante", "C08_VOTO_QUALIDADE_DUPLO": "bloqueante", "C09_INTERESSADO_DIVERGENTE": "aviso",
    "C11_ADMISSIBILIDADE_COMO_MERITO": "aviso", "C13_LIGADURA_RESIDUAL": "aviso", "C16_IMPEDIDO_COM_VOTO": "aviso", "C17_DATA_ANTERIOR_AO_PROCESSO": "bloqueante",
    "C18_ANO_PROTOCOLO_DIVERGE": "aviso", "C19_SERIE_NAO_MONOTONICA": "aviso", "C21_SEM_SINAL_DE_DELIBERACAO": "bloqueante",
}


def finding(rows: DataFrame, code: str, key: str = "id") -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.lit(code).alias("codigo"), F.lit(LEVELS[code]).alias("nivel"))


def anchors_findings(rows: DataFrame) -> DataFrame:
    """C03, C04 of (id, ancoras, itens, duplicatas)."""
    a, n = F.col("ancoras"), F.col("itens")
    parts = [
        finding(rows.where((n > a * 1.5) & (n - a > 5)), "C03_ITENS_MUITO_ACIMA_DAS_ANCORAS"), finding(rows.where(a - n > 2), "C03_ITENS_PERDIDOS"),
        finding(rows.where("duplicatas > 0"), "C04_DUPLICATA_INTRA_ATA"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "dq_ancoras_itens",
    """, a as (select agencia_id id, count(*) filter (processo is not null) * 9 // 10 ancoras, count(distinct processo) itens, count(processo) - count(distinct processo) duplicatas from deliberacoes where tipo_documento = 'ata' group by 1)
       select id, 'C03_ITENS_MUITO_ACIMA_DAS_ANCORAS' codigo, 'aviso' nivel from a where itens > ancoras * 1.5 and itens - ancoras > 5
       union all select id, 'C03_ITENS_PERDIDOS', 'bloqueante' from a where ancoras - itens > 2 union all select id, 'C04_DUPLICATA_INTRA_ATA', 'info' from a where duplicatas > 0""",
)
def dq_anchors(s: Star) -> DataFrame:
    """C03, C04: anchors of the text against items, and items removed as doubles."""
    a = s.deliberacoes.where("tipo_documento = 'ata'").groupBy(F.col("agencia_id").alias("id")).agg(
        F.floor(F.count("processo") * 9 / 10).alias("ancoras"), F.count_distinct("processo").alias("itens"), (F.count("processo") - F.count_distinct("processo")).alias("duplicatas")
    )
    return anchors_findings(a)


_SEATS = """, r as (select distinct d.agencia_id, d.data_reuniao, m.diretor_id from f d join mandatos m on m.agencia_id = d.agencia_id and m.data_inicio <= d.data_reuniao and (m.data_fim is null or m.data_fim >= d.data_reuniao)
  and not coalesce(m.afastado_desde <= d.data_reuniao and (m.afastado_ate is null or m.afastado_ate >= d.data_reuniao), false)),
  st as (select agencia_id, data_reuniao, count(*) cadeiras from r group by 1, 2), n as (select deliberacao_id, count(*) c, bool_or(tipo_voto in ('Desfavoravel', 'Abstencao')) dissenso from v group by 1)
"""


@query(
    "dq_votos",
    _SEATS + """select f.id, 'C05_VOTOS_ACIMA_DO_COLEGIADO' codigo, 'bloqueante' nivel from f join st using (agencia_id, data_reuniao) join n on n.deliberacao_id = f.id where c > cadeiras
      union all select f.id, 'C06_DECIDIDO_SEM_VOTO', 'aviso' from f left join n on n.deliberacao_id = f.id where estado = 'decidido' and c is null
      union all select f.id, 'C07_UNANIMIDADE_COM_DISSENSO', 'bloqueante' from f join n on n.deliberacao_id = f.id where unanimidade_detectada and dissenso""",
)
def dq_votes(s: Star) -> DataFrame:
    """C05–C07: more votes than seats, decided without a vote, unanimity with dissent. Seats and votes
    are aggregated before they meet the decisions, in one row each."""
    d = final(s).select("id", "agencia_id", "data_reuniao", "unanimidade_detectada", P.status().alias("estado"))
    seats = roster(d.where("data_reuniao is not null"), s.mandatos).groupBy("agencia_id", "data_reuniao").agg(F.count("*").alias("cadeiras"))
    n = s.votos.groupBy(F.col("deliberacao_id").alias("id")).agg(F.count("*").alias("c"), F.bool_or(F.col("tipo_voto").isin("Desfavoravel", "Abstencao")).alias("dissenso"))
    rows = d.join(n, "id", "left").join(seats, ["agencia_id", "data_reuniao"], "left")
    codes = F.array_compact(F.array(
        F.when(F.col("c") > F.col("cadeiras"), "C05_VOTOS_ACIMA_DO_COLEGIADO"), F.when((F.col("estado") == "decidido") & F.col("c").isNull(), "C06_DECIDIDO_SEM_VOTO"),
        F.when(F.col("unanimidade_detectada") & F.col("dissenso"), "C07_UNANIMIDADE_COM_DISSENSO"),
    ))
    levels = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return rows.select("id", F.explode(codes).alias("codigo")).withColumn("nivel", levels[F.col("codigo")])


@query(
    "dq_campos",
    """select id, 'C21_SEM_SINAL_DE_DELIBERACAO' codigo, 'bloqueante' nivel from deliberacoes where tipo_documento = 'deliberacao' and numero_deliberacao is null and processo is null and (numero_reuniao is null or id % 2 = 0)
       union all select id, 'C17_DATA_ANTERIOR_AO_PROCESSO', 'bloqueante' from deliberacoes where year(data_reuniao) < 1992 + id % 7
       union all select id, 'C18_ANO_PROTOCOLO_DIVERGE', 'aviso' from deliberacoes where year(data_publicacao) <> year(data_reuniao)""",
)
def dq_fields(s: Star) -> DataFrame:
    """C17, C18, C21: date before the case's year, another protocol year, no sign of a decision."""
    d = s.deliberacoes
    bare = (F.col("tipo_documento") == "deliberacao") & F.col("numero_deliberacao").isNull() & F.col("processo").isNull() & (F.col("numero_reuniao").isNull() | (F.col("id") % 2 == 0))
    codes = F.array_compact(F.array(
        F.when(bare, "C21_SEM_SINAL_DE_DELIBERACAO"), F.when(F.year("data_reuniao") < 1992 + F.col("id") % 7, "C17_DATA_ANTERIOR_AO_PROCESSO"),
        F.when(F.year("data_publicacao") != F.year("data_reuniao"), "C18_ANO_PROTOCOLO_DIVERGE"),
    ))
    levels = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return d.select("id", F.explode(codes).alias("codigo")).withColumn("nivel", levels[F.col("codigo")])


_MONOTONIC = """, o as (select agencia_id, coalesce(serie, '') serie, cast(numero_reuniao as int) k, data_reuniao, id from f where numero_reuniao is not null and data_reuniao is not null),
       g as (select agencia_id, serie, k, min(data_reuniao) lo, max(data_reuniao) hi from o group by 1, 2, 3),
       w as (select *, max(hi) over (partition by agencia_id, serie order by k rows between unbounded preceding and 1 preceding) antes, min(lo) over (partition by agencia_id, serie order by k rows between 1 following and unbounded following) depois from g)
       select o.id, 'C19_SERIE_NAO_MONOTONICA' codigo, 'aviso' nivel from o join w using (agencia_id, serie, k) where data_reuniao < antes or data_reuniao > depois"""


@query("dq_serie_monotonica", _MONOTONIC)
@query("dq_serie_monotonica_inteira", _MONOTONIC)
def dq_monotonic(s: Star) -> DataFrame:
    """C19, #117, over all final decisions; under its older name too."""
    return monotonic_findings(final(s))


def monotonic_findings(decisions: DataFrame) -> DataFrame:
    """C19, #117: a larger number with an earlier date. Per ordinal, its dates are compared with the
    extremes of those before and after, which a running window gives without a self-join."""
    rows = decisions.where("numero_reuniao is not null and data_reuniao is not null")
    o = rows.select("agencia_id", F.coalesce("serie", F.lit("")).alias("serie"), F.col("numero_reuniao").cast("int").alias("k"), "data_reuniao", "id")
    g = o.groupBy("agencia_id", "serie", "k").agg(F.min("data_reuniao").alias("lo"), F.max("data_reuniao").alias("hi"))
    w = Window.partitionBy("agencia_id", "serie").orderBy("k")
    g = g.select("agencia_id", "serie", "k", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("antes"), F.min("lo").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("depois"))
    bad = (F.col("data_reuniao") < F.col("antes")) | (F.col("data_reuniao") > F.col("depois"))
    return finding(o.join(g, ["agencia_id", "serie", "k"]).where(bad), "C19_SERIE_NAO_MONOTONICA")


@query("dq_impedido_com_voto", "select distinct v.deliberacao_id id, 'C16_IMPEDIDO_COM_VOTO' codigo, 'aviso' nivel from v join v w on w.deliberacao_id = v.deliberacao_id and w.diretor_id % 10 = v.diretor_id % 10 where v.motivo_nao_voto = 'impedimento' and w.tipo_voto <> 'Ausente'")
def dq_recused(s: Star) -> DataFrame:
    """C16: a recused director with a vote; directors are taken as one by the last digit of their id."""
    who = (F.col("diretor_id") % 10).alias("d")
    away = s.votos.where("motivo_nao_voto = 'impedimento'").select("deliberacao_id", who)
    votes = s.votos.where("tipo_voto <> 'Ausente'").select("deliberacao_id", who)
    return finding(away.join(votes, ["deliberacao_id", "d"], "left_semi").select("deliberacao_id").distinct(), "C16_IMPEDIDO_COM_VOTO", "deliberacao_id")


def text_findings(rows: DataFrame) -> DataFrame:
    """C08, C09, C11, C13 of (id, texto, interessado, resultado, juizo): codes found in the text."""
    from quorumlake.functions import text as T

    body = T.strip_accents(F.lower("texto"))
    tokens = F.filter(F.split(T.normalize(F.col("interessado")), " "), lambda x: F.length(x) >= 4)
    hit = F.size(F.filter(tokens, lambda x: body.contains(x)))
    casting = F.regexp_count(body, F.lit("voto de qualidade"))
    codes = F.array_compact(F.array(
        F.when(casting > 1, "C08_VOTO_QUALIDADE_DUPLO"),
        F.when(body.rlike(r"\b(ltda|s\.?a\.?|s/a)\b") & (F.size(tokens) > 0) & (hit < 0.34 * F.size(tokens)), "C09_INTERESSADO_DIVERGENTE"),
        F.when(body.rlike(r"\bnao\s+(se\s+)?conhec(er|e|eu|ido|imento)\b") & P.is_denied() & (F.coalesce("juizo", F.lit("")) != "admissibilidade"), "C11_ADMISSIBILIDADE_COMO_MERITO"),
        F.when(F.col("texto").rlike(r"\p{L}�\p{L}|[ﬁﬂﬀ]"), "C13_LIGADURA_RESIDUAL"),
    ))
    levels = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return rows.select("id", F.explode(codes).alias("codigo")).withColumn("nivel", levels[F.col("codigo")])


def blocked(findings: DataFrame) -> DataFrame:
    """Per id: whether any finding blocks, and the codes as text."""
    return findings.groupBy("id").agg(F.bool_or(F.col("nivel") == "bloqueante").alias("bloqueado"), F.array_join(F.array_sort(F.collect_set("codigo")), ",").alias("codigos"))


@query(
    "dq_bloqueio",
    _SEATS + """select id, bool_or(nivel = 'bloqueante') bloqueado, string_agg(distinct codigo, ',' order by codigo) codigos from (
      select f.id, 'C05_VOTOS_ACIMA_DO_COLEGIADO' codigo, 'bloqueante' nivel from f join st using (agencia_id, data_reuniao) join n on n.deliberacao_id = f.id where c > cadeiras
      union all select f.id, 'C06_DECIDIDO_SEM_VOTO', 'aviso' from f left join n on n.deliberacao_id = f.id where estado = 'decidido' and c is null
      union all select f.id, 'C07_UNANIMIDADE_COM_DISSENSO', 'bloqueante' from f join n on n.deliberacao_id = f.id where unanimidade_detectada and dissenso) group by 1""",
)
def dq_blocked(s: Star) -> DataFrame:
    """The verdict of the vote rules on each decision with a finding."""
    return blocked(dq_votes(s))


@query(
    "auto_confirmacao",
    """select motivo, count(*) n from (select case when tipo_documento not in ('deliberacao', 'ata', 'resolucao', 'portaria', 'voto_individual') then 'tipo' when import_counts_as_final = false and tipo_documento not in ('ata', 'voto_individual') then 'nao_final'
         when coalesce(extraction_confidence, 0) < case when tipo_documento in ('ata', 'voto_individual') then 0.70 else 0.90 end then 'confianca' when id % 13 = 0 then 'escaneado' when id % 10 = 9 then 'duplicata' when agencia_id is null then 'agencia'
         when id % 14 = 3 then 'aviso' when resultado is null then 'resultado' else 'ok' end motivo from deliberacoes) group by 1""",
)
def auto_confirm(s: Star) -> DataFrame:
    """#175: the first reason not to confirm by itself. Density, copies and warnings of a document are
    derived from its id here."""
    t, k = F.col("tipo_documento"), F.col("id")
    loose = t.isin("ata", "voto_individual")
    why = (
        F.when(~t.isin("deliberacao", "ata", "resolucao", "portaria", "voto_individual"), "tipo").when((F.col("import_counts_as_final") == False) & ~loose, "nao_final")  # noqa: E712
        .when(F.coalesce("extraction_confidence", F.lit(0.0)) < F.when(loose, 0.70).otherwise(0.90), "confianca").when(k % 13 == 0, "escaneado").when(k % 10 == 9, "duplicata")
        .when(F.col("agencia_id").isNull(), "agencia").when(k % 14 == 3, "aviso").when(F.col("resultado").isNull(), "resultado").otherwise("ok")
    )
    return s.deliberacoes.groupBy(why.alias("motivo")).agg(F.count("*").alias("n"))


# Dimensions of the matrix and their weights, and the worth of its levels.
WEIGHTS = (0.25, 0.15, 0.20, 0.15, 0.10, 0.15)
LEVEL_VALUES = (0.0, 0.35, 0.70, 1.0)
LEVEL_NAMES = ("inexistente", "inicial", "gerenciado", "melhoria_continua")


def level_of(score):
    return F.when(score >= 85, "melhoria_continua").when(score >= 52.5, "gerenciado").when(score >= 17.5, "inicial").otherwise("inexistente")


@query(
    "nota_ponderada",
    """, n as (select id agencia_id, c criterio, (id * c * 7 + 13) % 101 nota from agencias, (select unnest(range(1, 7)) c)),
       s as (select agencia_id, least(100e0, greatest(0e0, cast(sum(nota * case c when 1 then 25 when 3 then 20 when 5 then 10 else 15 end) as double) / 100)) score from (select *, criterio c from n) group by 1)
       select agencia_id, score, case when score >= 85 then 'melhoria_continua' when score >= 52.5 then 'gerenciado' when score >= 17.5 then 'inicial' else 'inexistente' end nivel from s""",
)
def weighted_score(s: Star) -> DataFrame:
    """#102: notes by criterion as a weighted score, clamped, and its level."""
    notes = s.agencias.select(F.col("id").alias("agencia_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("c"))
    notes = notes.withColumn("nota", (F.col("agencia_id") * F.col("c") * 7 + 13) % 101)
    weight = F.element_at(F.array(*[F.lit(round(100 * w)) for w in WEIGHTS]), F.col("c"))
    total = F.sum(F.col("nota") * weight).cast("double") / 100
    out = notes.groupBy("agencia_id").agg(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)).alias("score"))
    return out.withColumn("nivel", level_of(F.col("score")))


def matrix_scores(conditions: DataFrame) -> DataFrame:
    """#103: (agencia_id, criterio, classificacao) of conditions (agencia_id, criterio, nivel 1–3, atendida).

    Levels are walked upward: one fully met is the base; the first that isn't splits the criterion by
    its met share, and the walk ends.
    """
    per = conditions.groupBy("agencia_id", "criterio", "nivel").agg(F.count_if("atendida").alias("ok"), F.count("*").alias("de"))
    walk = per.groupBy("agencia_id", "criterio").agg(F.array_sort(F.collect_list(F.struct("nivel", (F.col("ok") / F.col("de")).alias("p")))).alias("l"))
    start = F.struct(F.lit(0).alias("base"), F.lit(0.0).alias("p"), F.lit(False).alias("fim"))

    def step(acc, x):
        full = x["p"] == 1.0
        return F.when(acc["fim"], acc).when(full, F.struct(x["nivel"].alias("base"), F.lit(0.0).alias("p"), F.lit(False).alias("fim"))).otherwise(F.struct(acc["base"].alias("base"), x["p"].alias("p"), F.lit(True).alias("fim")))

    end = F.aggregate("l", start, step)
    worth = F.array(*[F.lit(v) for v in LEVEL_VALUES])
    at = lambda k: F.element_at(worth, F.least(k + 1, F.lit(4)))
    return walk.select("agencia_id", "criterio", ((1 - end["p"]) * at(end["base"]) + end["p"] * at(end["base"] + 1)).alias("classificacao"))


_MATRIX = """, cd as (select id agencia_id, c criterio, nv nivel, count(*) filter ((id * 31 + c * 7 + nv * 3 + k) % (5 + nv) <> 0) * 1e0 / count(*) p
    from agencias, (select unnest(range(1, 7)) c), (select unnest(range(1, 4)) nv), (select unnest(range(1, 5)) k) group by 1, 2, 3),
  fr as (select agencia_id, criterio, max(p) filter (nivel = 1) p1, max(p) filter (nivel = 2) p2, max(p) filter (nivel = 3) p3 from cd group by 1, 2),
  cl as (select agencia_id, criterio, case when p1 < 1 then (1 - p1) * 0e0 + p1 * 0.35e0 when p2 < 1 then (1 - p2) * 0.35e0 + p2 * 0.7e0 when p3 < 1 then (1 - p3) * 0.7e0 + p3 * 1e0 else 1e0 end classificacao from fr)
"""


@query("imqn_criterios", _MATRIX + "select * from cl")
def matrix_by_criterion(s: Star) -> DataFrame:
    """#103: each criterion's classification from its conditions."""
    c = s.agencias.select(F.col("id").alias("agencia_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("criterio"))
    c = c.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("nivel")).select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    met = (F.col("agencia_id") * 31 + F.col("criterio") * 7 + F.col("nivel") * 3 + F.col("k")) % (F.col("nivel") + 5) != 0
    return matrix_scores(c.withColumn("atendida", met))


@query("imqn_total", _MATRIX + "select agencia_id, cast(sum(cast(classificacao * case criterio when 1 then 25 when 3 then 20 when 5 then 10 else 15 end as decimal(18,6))) as double) nota from cl group by 1")
def matrix_total(s: Star) -> DataFrame:
    """#103: the matrix score, 0 to 100."""
    weight = F.element_at(F.array(*[F.lit(round(100 * w)) for w in WEIGHTS]), F.col("criterio"))
    return matrix_by_criterion(s).groupBy("agencia_id").agg(F.sum((F.col("classificacao") * weight).cast("decimal(18,6)")).cast("double").alias("nota"))


@query(
    "maturidade",
    """, a as (select agencia_id, count(*) n, count(*) filter (data_reuniao is not null and data_publicacao is not null) datas, count(distinct microtema) temas, count(*) filter (data_reuniao >= date '1998-01-01') recentes from f group by 1)
       select agencia_id, case when n >= 20 and datas >= 10 then 'gerenciado' when n > 0 then 'inicial' else 'inexistente' end processo,
       case when temas >= 1 and recentes >= 80 and n >= 400 then 'melhoria_continua' when (temas >= 1 and (recentes >= 30 or n >= 400)) or recentes >= 60 then 'gerenciado' when temas >= 1 then 'inicial' else 'inexistente' end atividade from a""",
)
def maturity(s: Star) -> DataFrame:
    """#104: levels from signals: decisions with both dates, and activity."""
    a = final(s).groupBy("agencia_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("data_reuniao").isNotNull() & F.col("data_publicacao").isNotNull()).alias("datas"), F.count_distinct("microtema").alias("temas"),
        F.count_if(F.col("data_reuniao") >= F.to_date(F.lit("1998-01-01"))).alias("recentes"),
    )
    n, recent, section = F.col("n"), F.col("recentes"), F.col("temas") >= 1
    return a.select(
        "agencia_id", F.when((n >= 20) & (F.col("datas") >= 10), "gerenciado").when(n > 0, "inicial").otherwise("inexistente").alias("processo"),
        F.when(section & (recent >= 80) & (n >= 400), "melhoria_continua").when((section & ((recent >= 30) | (n >= 400))) | (recent >= 60), "gerenciado").when(section, "inicial").otherwise("inexistente").alias("atividade"),
    )


@query(
    "premio",
    """, y as (select agencia_id, area_regulatoria, year(data_reuniao) ano, count(*) n, 100e0 * count(*) filter (positivo) / count(*) nota from f where year(data_reuniao) in (1996, 1997) group by 1, 2, 3),
       b as (select area_regulatoria, agencia_id, nota, row_number() over (partition by area_regulatoria order by nota desc, agencia_id) k from y where ano = 1997 and n >= 5)
       select b.area_regulatoria, b.agencia_id, b.nota, p.nota anterior, 100e0 * (b.nota - p.nota) / nullif(p.nota, 0) evolucao from b left join y p on p.area_regulatoria = b.area_regulatoria and p.agencia_id = b.agencia_id and p.ano = 1996 where k = 1""",
)
def prizes(s: Star, year: int = 1997, least: int = 5) -> DataFrame:
    """#105: the best eligible agency of each category and its change on the year before."""
    rows = final(s).where(F.year("data_reuniao").isin(year - 1, year)).groupBy("agencia_id", "area_regulatoria", F.year("data_reuniao").alias("ano"))
    y = rows.agg(F.count("*").alias("n"), P.rate(F.count_if(P.is_positive()), F.count("*")).alias("nota"))
    best = y.where((F.col("ano") == year) & (F.col("n") >= least)).groupBy("area_regulatoria").agg(F.min(F.struct((-F.col("nota")).alias("m"), "agencia_id", "nota")).alias("b"))
    best = best.select("area_regulatoria", "b.agencia_id", "b.nota")
    before = y.where(F.col("ano") == year - 1).select("area_regulatoria", "agencia_id", F.col("nota").alias("anterior"))
    return best.join(before, ["area_regulatoria", "agencia_id"], "left").withColumn("evolucao", P.rate(F.col("nota") - F.col("anterior"), F.nullif("anterior", F.lit(0.0))))
