"""What the words of minutes and decisions say: results, names, votes of an item, the vote that prevailed,
repairs of items from several sources, listings that are trusted, names of files, blocks of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import charset, fields, item_votes
from quorumlake.functions import extract as X
from quorumlake.functions import text as T
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star


def _sql_text(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _pick(values, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (1 + k % len(values)).cast("int"))


def _sql_pick(values, k: str) -> str:
    return f"([{', '.join(map(_sql_text, values))}])[1 + ({k}) % {len(values)}]"


# ---- results

#: Phrases of decisions and what they decide.
PHRASES = (
    ("dar provimento ao recurso", "Deferido"), ("deixar de acolher o pedido", "Indeferido"), ("não provejo o recurso", "Indeferido"), ("negar-se provimento ao apelo", "Indeferido"),
    ("pela procedência do pedido", "Deferido"), ("pela improcedência", "Indeferido"), ("julgar improcedente a impugnação", "Indeferido"), ("conhecer e dar parcial provimento", "Parcialmente Deferido"),
    ("acolher em parte as razões", "Parcialmente Deferido"), ("procedente em parte", "Parcialmente Deferido"), ("provejo o recurso", "Deferido"), ("conhecer do recurso para provê-lo", "Deferido"),
    ("indefiro o pleito", "Indeferido"), ("defiro o pleito", "Deferido"), ("retirado de pauta, contra decisão que indeferiu", "Retirado de Pauta"), ("retirada da reunião", "Retirado de Pauta"),
    ("retirada de interferências citada na pauta", None), ("sobrestar o exame", "Retirado de Pauta"), ("pedido de vistas", "Retirado de Pauta"), ("pediu vista", "Retirado de Pauta"), ("voto vista apresentado", None),
    ("reprovar as contas", "Indeferido"), ("desprover o agravo", "Indeferido"), ("recurso improvido", "Indeferido"), ("pelo não provimento", "Indeferido"), ("homologar o resultado", "Ratificado"),
    ("referendar o ato", "Ratificado"), ("aprova a minuta", "Aprovado"), ("autoriza a obra", "Autorizado"), ("recomenda ajustes", "Recomendado"), ("determinar a vistoria", "Determinado"),
    ("determina o arquivamento", None), ("não conhecer do recurso", None), ("manter a decisão", None), ("cassação da licença", "Indeferido"), ("rejeitar os embargos", "Indeferido"),
)


@query("resultado_do_texto", f"select id, {_sql_pick([r for _, r in PHRASES], 'id')} resultado from deliberacoes")
def results_of_phrases(s: Star) -> DataFrame:
    """The result of each decision by its words; the SQL states what each phrase decides."""
    words = F.concat(F.lit("A Diretoria decidiu "), _pick([p for p, _ in PHRASES], F.col("id")), F.lit(",\nnos termos do voto."))
    return s.deliberacoes.select("id", X.result(F.when(F.col("id") % 2 == 0, F.upper(words)).otherwise(words)).alias("resultado"))


_FLAT = "trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '\\s+', ' ', 'g'))"


@query(
    "resultado_em_documentos",
    "select coalesce(r, 'sem resultado') resultado, count(*) n from (select case " + " ".join(f"when regexp_matches(t, {_sql_text('|'.join(forms))}) then '{name}'" for name, forms in X.RESULTS) + f" end r from (select {_FLAT} t from documents)) group by 1",
    tables=False,
)
def results_in_documents(s: Star) -> DataFrame:
    """How many whole texts state which result."""
    return s.table("documents").groupBy(F.coalesce(X.result(F.col("text")), F.lit("sem resultado")).alias("resultado")).agg(F.count("*").alias("n"))


# ---- names

#: Texts that were taken for names, and whether they are.
NAMES = (
    ("Tasso Mendonça Jr", True), ("Renovação De Frota", False), ("Função Confiança Quantidadenível", False), ("Diretoria Colegiada", False), ("voto por", False), ("Uma Vez Que", False), ("Ana Lima", True),
    ("José Fernando de Mendonça Gomes Júnior", True), ("Restituiu-lhe A Presidência", False), ("Acesso Externo Com", False), ("Maria Maria", True), ("Diretor João", False), ("João", False), ("Rui de Sá", True),
    ("Sá-Carvalho Neto", False), ("Eva Sá-Carvalho Neto", True), ("Item: Ana Lima", False), ("ana Lima Souza", False), ("Ana Um Dois Três Quatro Cinco Seis Sete", False), ("Caio Mário Trivellato Seabra Filho", True),
    ("Absteve-se Ana Lima", False), ("Ana Abcdefghijklmno", False), ("Ana Abcdefghijklmn", True), ("Neto Filho", False),
)


@query("nomes_estritos", f"select id, {_sql_pick([n for n, _ in NAMES], 'id')} nome, ([{', '.join(str(y).lower() for _, y in NAMES)}])[1 + id % {len(NAMES)}] estrito from deliberacoes")
def strict_names(s: Star) -> DataFrame:
    """What may become a voter's name."""
    name = _pick([n for n, _ in NAMES], F.col("id"))
    return s.deliberacoes.select("id", name.alias("nome"), X.strict_name(F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("  ")))).alias("estrito"))


_BROKEN = (
    ("subs7tuir", "substituir"), ("Par,cipa", "Participa"), ("ins!tuto", "instituto"), ("re?rado", "retirado"), ("Delibera,va", "Deliberativa"), ("obje?vo", "objetivo"), ("norma7vo", "normativo"),
    ("administra?vo", "administrativo"), ("transmi?da", "transmitida"), ("polí?ca", "política"), ("adi?vo", "aditivo"), ("compar?lhamento", "compartilhamento"), ("rela?vo", "relativo"), ("des?nado", "destinado"),
    ("inves?mento", "investimento"), ("mo?va", "motiva"), ("cole?vo", "coletivo"), ("respec?vo", "respectivo"), ("compe7?vo", "competivo"), ("exposto,voto", "exposto,voto"), ("re%rada", "retirada"),
)


@query("ligaduras", f"select id, 'O ' || {_sql_pick([y for _, y in _BROKEN], 'id')} || ' e ' || {_sql_pick([y for _, y in _BROKEN], 'id // 21')} || '.' texto, 0 restam from deliberacoes")
def ligatures(s: Star) -> DataFrame:
    """Texts whose `ti` was lost, repaired; none is left broken."""
    words = [x for x, _ in _BROKEN]
    text = X.repair_ligatures(F.concat(F.lit("O "), _pick(words, F.col("id")), F.lit(" e "), _pick(words, F.floor(F.col("id") / 21)), F.lit(".")))
    return s.deliberacoes.select("id", text.alias("texto"), X.broken_ligatures(text).alias("restam"))


# ---- votes of an item

_PERSON = (
    ("Ana", "Bruno", "Carla", "Davi", "Elisa", "Fábio", "Gina", "Heitor", "Inês", "João", "Karen", "Lucas"),
    ("Alves", "Barros", "Campos", "Dias", "Esteves", "Farias", "Gomes", "Henriques", "Ishida", "Junqueira", "Klein", "Lopes"),
    ("Moura", "Neves", "Ortiz", "Pires", "Queiroz", "Ramos", "Sousa", "Tavares", "Uchôa", "Vieira", "Xavier", "Zanetti"),
    ("da Mata", "Brito", "de Castro", "Duarte", "Eiras", "dos Anjos", "Guedes", "Horta", "do Vale", "Jordão", "Leite", "Muniz"),
)


def person(k: Column) -> Column:
    """A name for a number, its own for each under 12 ** 4."""
    return F.concat_ws(" ", *[_pick(part, F.floor(k / 12**i)) for i, part in enumerate(_PERSON)])


def _sql_person(k: str) -> str:
    return " || ' ' || ".join(_sql_pick(part, f"({k}) // {12**i}") for i, part in enumerate(_PERSON))


_ITEM_SQL = f""", w as (select v.*, deliberacao_id k, {_sql_person("diretor_id")} nome, tipo_voto = 'Ausente' and coalesce(motivo_nao_voto, '') = 'impedimento' fora from votos v),
    g as (select k, min(diretor_id) filter (tipo_voto = 'Desfavoravel') n0, {_sql_person("20000 + k % 700")} q from w group by k),
    d as (select w.*, q, case when tipo_voto = 'Favoravel' then 'favor' when tipo_voto = 'Desfavoravel' and not (w.k % 11 = 0 and diretor_id = n0) then 'contra' when tipo_voto = 'Abstencao' then 'abstencao'
            when fora then 'impedido' when tipo_voto = 'Ausente' then 'ausente' end lado, tipo_voto = 'Desfavoravel' and (w.k % 11 = 0 or (w.k + diretor_id) % 3 = 2) dissenso from w join g using (k)),
    s as (select k, any_value(q) q, bool_or(dissenso) dissenso, {", ".join(f"coalesce(list(nome) filter (lado = '{d}'), []) {d}" for d in (*item_votes.DIRECTIONS, "impedido"))} from d group by k),
    r as (select *, case when k % 13 = 0 and not list_contains(favor || contra, q) then list_filter(favor || [q], lambda x: not list_contains(impedido, x)) else favor end f from s)
    select k id, array_to_string(list_sort(f), ', ') favor, {", ".join(f"array_to_string(list_sort({d}), ', ') {d}" for d in ("contra", "abstencao", "ausente", "impedido"))},
        case when k % 13 = 0 then q end voto_qualidade_por, len(contra) = 0 and (k % 13 = 0 or dissenso) aviso from r"""


@query("votos_do_item", _ITEM_SQL)
def votes_of_items(s: Star) -> DataFrame:
    """Votes read from items' texts, which are put together from the votes: tables, sentences, statements that are
    overruled, authors of approved votes among the outvoted, casting votes, recusals."""
    k, p = F.col("deliberacao_id"), F.col("diretor_id")
    name, style = person(p), (F.col("deliberacao_id") + p) % 3
    say = lambda *parts: F.concat(*[name if x is name else F.lit(x) for x in parts])
    fora = (F.col("tipo_voto") == "Ausente") & F.coalesce(F.col("motivo_nao_voto") == "impedimento", F.lit(False))
    clause = (
        F.when((F.col("tipo_voto") == "Favoravel") & (style == 0), say(name, " – Favorável.")).when((F.col("tipo_voto") == "Favoravel") & (style == 1), say("Votou favoravelmente o Diretor ", name, "."))
        .when(F.col("tipo_voto") == "Favoravel", say("O Diretor ", name, " acompanhou o voto do\nRelator.")).when((F.col("tipo_voto") == "Desfavoravel") & (style == 0), say(name, " – Contrário."))
        .when((F.col("tipo_voto") == "Desfavoravel") & (style == 1), say("Vencido o Diretor ", name, ".")).when(F.col("tipo_voto") == "Desfavoravel", say("O Diretor ", name, " divergiu do Relator."))
        .when(F.col("tipo_voto") == "Abstencao", say(name, " – Favorável. Votou contra o Diretor ", name, ". O Diretor ", name, " absteve-se."))
        .when(fora, say(name, " – Favorável. O Diretor ", name, ", este não participou da votação.")).otherwise(say("Ausente o Diretor ", name, "."))
    )
    outvoted = F.min(F.when(F.col("tipo_voto") == "Desfavoravel", F.struct("diretor_id", name.alias("nome"))))
    items = s.votos.groupBy(k.alias("id")).agg(F.array_sort(F.collect_list(F.struct(p, clause.alias("x")))).alias("l"), outvoted["nome"].alias("vencido"))
    won = F.when((F.col("id") % 11 == 0) & F.col("vencido").isNotNull(), F.concat(F.lit("Voto do Relator, Diretor "), F.col("vencido"), F.lit(", aprovado por maioria.\n"))).otherwise("")
    cast = F.when(F.col("id") % 13 == 0, F.concat(F.lit("Empate, com voto de qualidade proferido pelo Diretor "), person(20000 + F.col("id") % 700), F.lit(".\n"))).otherwise("")
    text = F.concat(won, cast, F.array_join(F.transform("l", lambda x: x["x"]), "\n"))
    read = items.select("id", text.alias("text")).select("id", item_votes.item_votes(F.col("text")).alias("v"))
    return read.select("id", *[F.array_join(F.array_sort(F.col(f"v.{d}")), ", ").alias(d) for d in (*item_votes.DIRECTIONS, "impedido")], "v.voto_qualidade_por", "v.aviso")


# ---- fields of documents

_FIELDS_SQL = f"""select id, cast(1 + id % 900 as varchar) numero_deliberacao, case when id % 2 = 0 then '1.' || lpad(cast(id % 1000 as varchar), 3, '0') else cast(100 + id % 800 as varchar) end numero_reuniao,
    case when id % 2 = 0 then 'Extraordinaria' else 'Ordinaria' end tipo_reuniao, data_reuniao, '50500.' || id || '/1996-01' processo, case when id % 5 = 4 then null else 'Companhia ' || id || ' S.A.' end interessado,
    'Reajuste ' || id assunto, case when id % 4 = 3 then null else {_sql_person("id % 20000")} end relator, case when id % 6 = 0 then 'admissibilidade' end juizo, id % 6 = 1 unanimidade_detectada,
    id % 5 = 4 or id % 7 = 0 pauta_interna, {_sql_person("id % 20000")} || ', ' || {_sql_person("(id + 1) % 20000")} signatarios from deliberacoes"""


@query("campos_do_documento", _FIELDS_SQL)
def document_fields(s: Star) -> DataFrame:
    """Fields read from documents that are put together from decisions, with several labels and forms for each."""
    k, date = F.col("id"), F.col("data_reuniao")
    month = _pick(("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"), F.month(date) - 1)
    number, d, y = (1 + k % 900).cast("string"), F.dayofmonth(date).cast("string"), F.year(date).cast("string")
    lit = F.lit
    plain = F.concat(lit("Deliberação nº "), number)
    head = (
        F.when(date.isNull(), plain).when(k % 3 == 0, F.concat(lit("DELIBERAÇÃO ARTESP Nº "), number, lit(", DE "), d, lit(" DE "), F.upper(month), lit(" DE "), y))
        .when(k % 3 == 1, F.concat(plain, lit(" citada em 3 de maio de 1991\nrealizada em "), d, lit(" de "), month, lit(" de "), y)).otherwise(F.concat(lit("DELIBERACAO No "), number, lit("\nrealizada em "), F.date_format(date, "dd/MM/yyyy")))
    )
    meeting = F.when(k % 2 == 0, F.concat(lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"), lit("ª Reunião Extraordinária"))).otherwise(F.concat((100 + k % 800).cast("string"), lit("ª Reunião Ordinária")))
    label = lambda values, by: _pick(values, by)
    process = F.concat(label(("Processo nº: ", "SEI nº ", "PROCESSOS Nº: ", "Autos nº "), k), lit("50500."), k.cast("string"), lit("/1996-01"))
    party = F.when(k % 5 == 4, "").otherwise(F.concat(label(("Interessado: ", "REQUERENTE: ", "Concessionária: ", "Empresa: "), k % 5), lit("Companhia  "), k.cast("string"), lit(" S.A."), F.when(k % 3 == 0, ", que solicita autorização").otherwise("")))
    subject = F.concat(label(("Assunto: ", "Ementa: ", "TEMA: "), k), lit("Reajuste "), k.cast("string"))
    reporter = F.when(k % 4 == 3, "").otherwise(F.concat(lit("Relator: Diretor "), person(k % 20000)))
    said = F.when(k % 6 == 0, "A Diretoria decidiu não conhecer do recurso.").when(k % 6 == 1, "Aprovado por unanimidade.").otherwise("Em debate.")
    internal = F.when(k % 7 == 0, "Expediente interno.").otherwise("")
    signed = F.concat(person(k % 20000), lit(" - Diretor-Geral\n"), person((k + 1) % 20000), lit(" – Diretora\nDocumento assinado eletronicamente por Rui Sem Nome - Diretor"))
    rows = s.deliberacoes.select("id", F.concat_ws("\n", head, meeting, reporter, process, party, subject, said, internal, signed).alias("t"))
    found = fields.fields(F.col("t"))
    out = [found[c].alias(c) for c in ("numero_deliberacao", "numero_reuniao", "tipo_reuniao", "data_reuniao", "processo", "interessado", "assunto", "relator", "juizo", "unanimidade_detectada", "pauta_interna")]
    return rows.select("id", *out, F.array_join(found["signatarios"], ", ").alias("signatarios"))


# ---- the vote that prevailed

# How the blocks of votes in minutes are headed, and how a decision names the reviewer's as approved.
BLOCK = r"(?i)voto\s+d[oa]\s+((?:primeir|segund|terceir|quart)[oa])?\s*(relatora?|revisora?)[^:\n]{0,80}:\s*([\s\S]+?)(?=\n?\s*voto\s+d[oa]\s+(?:primeir|segund|terceir|quart|relator|revisor)|delibera[çÇc][ãÃa]o\s*:|$)"
HEAD = r"(?i)^voto\s+d[oa]\s+((?:primeir|segund|terceir|quart)[oa])?\s*"
REVIEWER_WON = r"(?i)\bvoto\s+d[oa]\s+((?:primeir|segund|terceir|quart)[oa]\s+)?revisor"


def prevailing(raw: Column, decision: Column) -> Column:
    """The text of the vote that prevailed: the reviewer's whom the decision names, by ordinal or else the last
    one, else the rapporteur's, else the first; null without blocks of votes by role."""
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(BLOCK), F.lit(0))
    said = F.coalesce(decision, F.lit(""))
    stem = F.regexp_replace(F.lower(F.trim(F.regexp_extract(said, REVIEWER_WON, 1))), "[oa]$", "")

    def chosen(blocks: Column) -> Column:
        reported = F.coalesce(F.get(F.filter(blocks, lambda x: x.rlike(HEAD + "relator")), F.lit(0)), F.get(blocks, F.lit(0)))
        reviewers = F.filter(blocks, lambda x: x.rlike(HEAD + "revisor"))
        asked = lambda r: T.once(stem, lambda s: F.filter(r, lambda x: (s != "") & F.lower(F.regexp_extract(x, HEAD, 1)).startswith(s)))
        won = T.once(reviewers, lambda r: F.coalesce(F.get(asked(r), F.lit(0)), F.get(r, F.size(r) - 1)))
        return F.when(said.rlike(REVIEWER_WON), F.coalesce(won, reported)).otherwise(reported)

    # a block that was cut out ends where its text does
    return T.once(T.once(found, chosen), lambda x: F.regexp_extract(x, BLOCK, 3))


# The forms of an item's words that tell its result.
ITEM_DENIED = r"\bindefer|negad[oa]|improcedente|nao dar provimento|negar provimento"
ITEM_GRANTED = r"\bdefer|dar provimento|provimento ao"


def item_result(c: Column, unanimous: Column) -> Column:
    """The result of an item of minutes by its words; null if they tell none."""
    agreed = F.when(unanimous, "Aprovado por Unanimidade").otherwise("Aprovado")

    def told(t: Column) -> Column:
        suspended = t.rlike("|".join(X.SUSPENDED)) | t.rlike("voto vistas")
        return F.when(suspended, "Retirado de Pauta").when(t.rlike(ITEM_DENIED), "Indeferido").when(t.rlike(ITEM_GRANTED), "Deferido").when(t.rlike("aprovad[oa]") | unanimous, agreed)

    return T.once(X.flat(c), told)


@query(
    "voto_prevalecente",
    """select id, case when id % 9 = 8 then null when id % 9 in (0, 1, 2, 6) then 'relator' when id % 9 in (3, 7) then 'terceiro' when id % 9 = 4 then 'segundo' else 'primeiro' end quem,
        case when id % 9 = 8 then case when id % 2 = 0 then 'Aprovado por Unanimidade' else 'Aprovado' end when id % 9 in (0, 1, 2, 6) then 'Indeferido' when id % 9 in (3, 7) then 'Deferido' when id % 9 = 4 then 'Indeferido' else 'Retirado de Pauta' end resultado
        from deliberacoes""",
)
def prevailing_votes(s: Star) -> DataFrame:
    """Results of items by the vote that prevailed, over minutes in which the rapporteur, one of three reviewers, or
    the decision alone decides."""
    k = F.col("id") % 9
    decided = (
        F.when(k == 0, "Voto do Relator aprovado por unanimidade.").when(k == 1, "Aprovado por maioria.").when(k == 2, F.lit(None).cast("string")).when(k == 3, "Voto do revisor aprovado por maioria, vencido o relator.")
        .when(k == 4, "Voto do Segundo Revisor aprovado.").when(k == 5, "voto do\nprimeiro revisor, aprovado por unanimidade").when(k == 6, "Voto do revisor aprovado por maioria.").when(k == 7, "Voto do Quarto Revisor aprovado.")
        .otherwise(F.when(F.col("id") % 2 == 0, "Aprovado por unanimidade.").otherwise("Aprovada a minuta."))
    )
    reporter = F.lit("VOTO DO RELATOR: relator decide negar provimento\nao recurso.\n")
    reviewers = F.lit("Voto do Primeiro Revisor, Diretor Rui: primeiro pede retirar de pauta.\nVOTO DO SEGUNDO REVISOR: segundo vota por indeferir.\nVOTO DO TERCEIRO REVISOR: terceiro propõe dar provimento.\n")
    blocks = F.when(k == 8, "Assunto: minuta.\n").when(k == 6, reporter).otherwise(F.concat(reporter, reviewers))
    raw = F.concat(blocks, F.lit("DELIBERAÇÃO: "), F.coalesce(decided, F.lit("")))
    rows = s.deliberacoes.select("id", raw.alias("raw"), decided.alias("d")).withColumn("p", prevailing(F.col("raw"), F.col("d")))
    words = F.coalesce("p", "d")
    result = item_result(words, X.unanimous(words))
    return rows.select("id", F.nullif(F.regexp_extract(F.trim(F.coalesce("p", F.lit(""))), r"^(\w+)", 1), F.lit("")).alias("quem"), result.alias("resultado"))


# ---- repair of items

#: Rows of an item that is repaired, and of a source of items.
ITEM = ("pai_id", "item_numero", "resultado", "decisao")


def repair_items(children: DataFrame, stored: DataFrame, split_again: DataFrame) -> DataFrame:
    """Results for children (id, pai_id, item_numero, numero_deliberacao, resultado, resumo_pleito) that have none.

    Sources are asked in turn, each only for what the one before left open: the items stored with the minutes (ITEM), the
    child's own words with their ligatures repaired, the minutes split again (ITEM). Agenda items (PAUTA-) are no one's. Of an item that
    a source has twice the first by decision counts. Returns id, resultado, resumo_pleito, degrau; a child
    that no source helps is not in it.
    """
    open_rows = children.where("coalesce(resultado, '') = '' and not startswith(coalesce(numero_deliberacao, ''), 'PAUTA-')")
    summary = F.coalesce(F.nullif(F.col("c.resumo_pleito"), F.lit("")), F.substring("f.decisao", 1, 2000))

    def asked(rows: DataFrame, source: DataFrame) -> DataFrame:
        one = source.groupBy("pai_id", "item_numero").agg(F.min_by(F.struct("resultado", "decisao"), F.struct(F.col("decisao").isNull(), "decisao", "resultado")).alias("f"))
        met = F.col("c.pai_id").eqNullSafe(F.col("o.pai_id")) & (F.col("c.item_numero") == F.col("o.item_numero"))
        return rows.alias("c").join(one.select("pai_id", "item_numero", "f").alias("o"), met, "left").select("c.*", F.col("o.f").alias("f"))

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        has = F.coalesce(F.col("f.resultado"), F.lit("")) != ""
        return rows.where(has), rows.where(~has).drop("f")

    first, left = split(asked(open_rows, stored))
    own = item_result(X.repair_ligatures(F.col("resumo_pleito")), F.lit(False))
    left = left.withColumn("own", F.when(F.coalesce(F.col("resumo_pleito"), F.lit("")) != "", own))
    second, left = left.where("own is not null"), left.where("own is null").drop("own")
    third, _ = split(asked(left, split_again))
    from_source = lambda rows, name: rows.alias("c").select("id", F.col("f.resultado").alias("resultado"), summary.alias("resumo_pleito"), F.lit(name).alias("degrau"))
    return from_source(first, "array").unionByName(second.select("id", F.col("own").alias("resultado"), "resumo_pleito", F.lit("ligadura").alias("degrau"))).unionByName(from_source(third, "resplit"))


@query(
    "reparo_de_itens",
    """select id, case when id % 4 = 0 then 'Deferido' when id % 6 = 0 then 'Retirado de Pauta' else 'Indeferido' end resultado,
        case when id % 3 = 0 then case when id % 2 = 0 then 'Processo re%rado de pauta' else 'relata' end when id % 4 = 0 then 'guardado ' || id else 'dividido ' || id end resumo_pleito,
        case when id % 4 = 0 then 'array' when id % 6 = 0 then 'ligadura' else 'resplit' end degrau
        from deliberacoes where resultado is null and id % 5 <> 0 and (id % 4 = 0 or id % 6 = 0 or id % 8 <> 7)""",
)
def repaired_items(s: Star) -> DataFrame:
    """Items without a result, repaired by the first of three sources that tells one."""
    k = F.col("id")
    summary = F.when(k % 3 == 0, F.when(k % 2 == 0, "Processo re%rado de pauta").otherwise("relata"))
    number = F.concat(F.lit("1."), k.cast("string"))
    children = s.deliberacoes.select("id", (k % 100).alias("pai_id"), number.alias("item_numero"), F.when(k % 5 == 0, "PAUTA-1").alias("numero_deliberacao"), "resultado", summary.alias("resumo_pleito"))
    stored = s.deliberacoes.select((k % 100).alias("pai_id"), number.alias("item_numero"), F.when(k % 4 == 0, "Deferido").alias("resultado"), F.concat(F.lit("guardado "), k.cast("string")).alias("decisao"))
    again = s.deliberacoes.where("id % 8 <> 7").select((k % 100).alias("pai_id"), number.alias("item_numero"), F.lit("Indeferido").alias("resultado"), F.concat(F.lit("dividido "), k.cast("string")).alias("decisao"))
    return repair_items(children, stored, again)


# ---- listings that are trusted


def listing_number(c: Column) -> Column:
    """The number of a meeting in a listing: 1.024ª is 1024; null for none and for 0."""
    n = F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit("."), F.lit("")), r"(\d{1,5})", 1).try_cast("int")
    return F.when(n > 0, n)


def listing_gate(listing: DataFrame, checked: DataFrame) -> DataFrame:
    """(fonte, aprovado, conferidas, batem, motivo): whether a source's listing (fonte, numero, data) may give dates.

    It may if it has the date of every meeting that was checked by hand (fonte, numero, data): one false date shuts
    the whole source, as does a listing without rows or without a checked meeting.
    """
    dates = listing_dates(listing)
    own = checked.select("fonte", listing_number(F.col("numero")).alias("n"), F.col("data").alias("certa"))
    met = own.join(dates, ["fonte", "n"], "left").groupBy("fonte").agg(F.count("*").alias("conferidas"), F.count_if(F.coalesce(F.col("data") == F.col("certa"), F.lit(False))).alias("batem"))
    rows = listing.groupBy("fonte").agg(F.count("*").alias("linhas")).join(met, "fonte", "full")
    why = F.when(F.col("linhas").isNull(), "listagem_vazia").when(F.col("conferidas").isNull(), "sem_ata_para_conferir").when(F.col("batem") == F.col("conferidas"), "aprovado").otherwise("divergencia")
    zero = lambda c: F.coalesce(F.when(F.col("linhas").isNotNull(), F.col(c)), F.lit(0).cast("long")).alias(c)
    return rows.select("fonte", (why == "aprovado").alias("aprovado"), zero("conferidas"), zero("batem"), why.alias("motivo"))


def listing_dates(listing: DataFrame) -> DataFrame:
    """(fonte, n, data): the date of a number, if the listing gives just one."""
    n = listing.select("fonte", listing_number(F.col("numero")).alias("n"), "data").where("n is not null and data is not null")
    return n.groupBy("fonte", "n").agg(F.min("data").alias("data"), F.max("data").alias("ate")).where("data = ate").drop("ate")


def dates_by_listing(meetings: DataFrame, listing: DataFrame, checked: DataFrame) -> DataFrame:
    """meetings (fonte, numero, ...) with data_listagem: what a trusted source says, else null."""
    trusted = listing_dates(listing).join(listing_gate(listing, checked).where("aprovado").select("fonte"), "fonte", "left_semi")
    out = meetings.withColumn("n", listing_number(F.col("numero")))
    return out.join(trusted.withColumnRenamed("data", "data_listagem"), ["fonte", "n"], "left").drop("n")


_GATE_SQL = """, m as (select agencia_id fonte, cast(numero_reuniao as int) n, min(data_reuniao) data from deliberacoes where numero_reuniao is not null and data_reuniao is not null group by 1, 2),
    l as (select fonte, n, data from m where fonte % 7 <> 6 union all select fonte, n, data + 1 from m where fonte % 7 <> 6 and n % 10 = 3),
    u as (select fonte, n, min(data) data from l group by 1, 2 having count(distinct data) = 1),
    c as (select fonte, n, case when fonte % 3 = 0 and n = 4 then data + 2 else data end certa from m where n % 4 = 0 and fonte % 7 <> 5),
    g as (select fonte, count(*) conferidas, count(*) filter (data = certa) batem from c left join u using (fonte, n) group by fonte)"""


@query(
    "portao_da_listagem",
    _GATE_SQL + """ select f.fonte, f.fonte % 7 <> 6 and conferidas is not null and batem = conferidas aprovado, case when f.fonte % 7 = 6 then 0 else coalesce(conferidas, 0) end conferidas, case when f.fonte % 7 = 6 then 0 else coalesce(batem, 0) end batem,
        case when f.fonte % 7 = 6 then 'listagem_vazia' when conferidas is null then 'sem_ata_para_conferir' when batem = conferidas then 'aprovado' else 'divergencia' end motivo from (select distinct fonte from m) f left join g using (fonte)""",
)
def listing_gates(s: Star) -> DataFrame:
    """Which agencies' listings may give dates."""
    return listing_gate(*_listing(s)[1:])


@query(
    "datas_da_listagem",
    _GATE_SQL + """ select d.id, u.data data_listagem from deliberacoes d left join (select u.* from u join g using (fonte) where batem = conferidas) u on u.fonte = d.agencia_id and u.n = cast(d.numero_reuniao as int)""",
)
def listing_join(s: Star) -> DataFrame:
    """Dates of meetings by listings that are trusted; a number with two dates has none."""
    rows = s.deliberacoes.select("id", F.col("agencia_id").alias("fonte"), F.concat("numero_reuniao", F.lit("ª RDE")).alias("numero"))
    return dates_by_listing(rows, *_listing(s)[1:]).select("id", "data_listagem")


def _listing(s: Star) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = s.deliberacoes.where("numero_reuniao is not null and data_reuniao is not null").groupBy(F.col("agencia_id").alias("fonte"), F.col("numero_reuniao").cast("int").alias("n")).agg(F.min("data_reuniao").alias("data"))
    number = lambda form: F.format_string(form, F.col("n"))
    listing = d.where("fonte % 7 <> 6").select("fonte", number("0.0%dª Reunião").alias("numero"), "data")
    again = d.where("fonte % 7 <> 6 and n % 10 = 3").select("fonte", number("%d").alias("numero"), F.date_add("data", 1).alias("data"))
    checked = d.where("n % 4 = 0 and fonte % 7 <> 5").select("fonte", number("%d").alias("numero"), F.when((F.col("fonte") % 3 == 0) & (F.col("n") == 4), F.date_add("data", 2)).otherwise(F.col("data")).alias("data"))
    return d, listing.unionByName(again), checked


# ---- names of files

_TITLES = ("Ata ordinária", "DELIBERAÇÃO", "Decisão nº", "Resolução à espera", "Órgão técnico", "Anexo único", "Relatório", "Pauta 83ª")


@query(
    "nomes_decodificados",
    f"""select id, {_sql_pick(_TITLES, "id")} || ' ' || id || '.pdf' nome, case when regexp_matches({_sql_pick(_TITLES, "id")}, '^[ -~]*$') then 'utf-8'
        when id // 8 % 6 = 2 then 'latin-1' when id // 8 % 6 = 3 then 'cp850' when id // 8 % 6 = 4 then 'utf-8 duas vezes' else 'utf-8' end codificacao from deliberacoes where id // 8 % 6 <> 5
       union all select id, {_sql_pick(_TITLES, "id")} || ' ' || id || '.pdf', case when regexp_matches({_sql_pick(_TITLES, "id")}, '^[ -~]*$') then 'utf-8' else 'latin-1' end from deliberacoes where id // 8 % 6 = 5""",
)
def decoded_names(s: Star) -> DataFrame:
    """Names in UTF-8, percent escapes of either page, Latin-1, cp850 and UTF-8 encoded twice, all read as what they were."""
    k = F.col("id")
    name, way = F.concat(_pick(_TITLES, k), F.lit(" "), k.cast("string"), F.lit(".pdf")), F.floor(k / 8) % 6
    escaped = lambda raw: F.encode(F.regexp_replace(F.regexp_replace(F.hex(raw), "(..)", "%$1"), "%(2E|3[0-9])", "%$1"), "UTF-8")
    utf8 = F.encode(name, "UTF-8")
    raw = (
        F.when(way == 0, utf8).when(way == 1, escaped(utf8)).when(way == 2, charset.to_page(name, "latin-1")).when(way == 3, charset.to_page(name, "cp850"))
        .when(way == 4, F.encode(F.decode(utf8, "ISO-8859-1"), "UTF-8")).otherwise(escaped(charset.to_page(name, "latin-1")))
    )
    return s.deliberacoes.select("id", charset.decoded(raw).alias("d")).select("id", "d.nome", "d.codificacao")


# ---- JSON


def json_ld(html: Column) -> Column:
    """The blocks of JSON-LD of a page, as variants; broken ones are null."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    return F.transform(found, F.try_parse_json)


def json_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, node): the objects of pages' (page_id, html) JSON-LD blocks, of their lists and of their graphs."""
    blocks = pages.select("page_id", F.explode(json_ld(F.col("html"))).alias("v")).where("v is not null")
    kind = F.schema_of_variant("v")
    lists = F.when(kind.startswith("ARRAY"), F.col("v")).otherwise(F.try_variant_get("v", "$['@graph']", "variant"))
    rows = blocks.select("page_id", "v", lists.alias("l"))
    single = rows.where("l is null").select("page_id", F.col("v").alias("node"))
    each = F.from_json(F.to_json("l"), "array<variant>")
    return single.unionByName(rows.where("l is not null").select("page_id", F.explode(each).alias("node")))


def _page_block(k: Column) -> Column:
    day = F.format_string("2024-%02d-%02dT10:00:00-03:00", (1 + k % 12).cast("int"), (1 + k % 28).cast("int"))
    article = lambda a, b: F.concat(F.lit('{"@type": "'), F.lit(a), F.lit('", "headline": "Notícia '), k.cast("string"), F.lit(f'", "{b}": "'), day, F.lit('"}'))
    graph = F.concat(F.lit('{"@context": "x", "@graph": ['), article("WebPage", "dateModified"), F.lit(", "), article("NewsArticle", "datePublished"), F.lit("]}"))
    both = F.concat(F.lit("["), article("NewsArticle", "datePublished"), F.lit("]"))
    return F.when(k % 5 == 0, article("NewsArticle", "datePublished")).when(k % 5 == 1, graph).when(k % 5 == 2, both).when(k % 5 == 3, '{"@type": "NewsArticle", broken').otherwise("")


@query(
    "json_ld_das_paginas",
    """select page_id, 'Notícia ' || page_id manchete, cast('2024-' || lpad(cast(1 + page_id % 12 as varchar), 2, '0') || '-' || lpad(cast(1 + page_id % 28 as varchar), 2, '0') as date) publicada, case when page_id % 5 = 1 then 2 else 1 end nos
       from pages where page_id % 5 in (0, 1, 2)""",
    tables=False,
)
def page_json(s: Star) -> DataFrame:
    """#13: headline and date of publication by the JSON-LD of pages, into which blocks of five kinds are set."""
    k = F.col("page_id")
    block = F.concat(F.lit('<script type="application/ld+json">'), _page_block(k), F.lit("</script>"))
    nodes = json_nodes(s.table("pages").select("page_id", F.concat("html", F.when(k % 5 == 4, "").otherwise(block)).alias("html")))
    at = lambda path: F.try_variant_get("node", path, "string")
    article = at("$['@type']") == "NewsArticle"
    found = nodes.groupBy("page_id").agg(F.max(F.when(article, at("$.headline"))).alias("manchete"), F.max(F.when(article, F.to_date(F.substring(at("$.datePublished"), 1, 10)))).alias("publicada"), F.count("*").alias("nos"))
    return found.where("manchete is not null")


@query("json_sem_ordem", "select id, id % 3 <> 0 iguais, cast(id % 7 as int) paginas, case when id % 4 = 3 then null else 'juízo ' || id end juizo from deliberacoes")
def json_equality(s: Star) -> DataFrame:
    """#47: sub-paths of a JSON column, and its equality with another one whatever the order of keys."""
    k = F.col("id")
    one = F.format_string('{"ata": {"paginas": %d, "juizo": "juízo %d"}, "itens": [1, %d]}', k % 7, k, k)
    two = F.format_string('{"itens":[1,%d],"ata":{"juizo":"juízo %d","paginas":%d}}', F.when(k % 3 == 0, k + 1).otherwise(k), k, k % 7)
    rows = s.deliberacoes.select("id", F.parse_json(F.when(k % 4 == 3, F.replace(one, F.lit("juizo"), F.lit("outro"))).otherwise(one)).alias("a"), F.parse_json(F.when(k % 4 == 3, F.replace(two, F.lit("juizo"), F.lit("outro"))).otherwise(two)).alias("b"))
    # a variant keeps an object's fields by name, so its text is canonical
    return rows.select("id", (F.to_json("a") == F.to_json("b")).alias("iguais"), F.try_variant_get("a", "$.ata.paginas", "int").alias("paginas"), F.try_variant_get("a", "$.ata.juizo", "string").alias("juizo"))
