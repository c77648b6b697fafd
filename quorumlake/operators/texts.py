"""Classification, extraction and repair of texts, over `documents` and `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import charset
from quorumlake.functions import extract as X
from quorumlake.functions import text as T
from quorumlake.functions import themes
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star

#: Themes with phrases that the driver's documents have.
SAMPLE_THEMES = {"licenca": ("licensed under", "apache license", "license"), "segredo": ("token", "password", "secret"), "romance": ("de la", "los", "les"), "germanico": ("der", "und", "the")}


def classify(c, phrases: dict[str, tuple[str, ...]]):
    """(tema, confianca): the theme of the highest score, ties by the order of themes; its share of all."""
    low = F.lower(c)
    scores = [F.struct((-T.keyword_score(low, p)).alias("m"), F.lit(k).alias("k"), F.lit(name).alias("tema")) for k, (name, p) in enumerate(phrases.items())]
    return F.array(*scores)


@query(
    "microtema_por_palavras",
    "with s as (select doc_id, " + ", ".join(
        "(" + " + ".join(f"case when contains(lower(text), '{p}') then {len(p.split())} else 0 end" for p in phrases) + f") {name}" for name, phrases in SAMPLE_THEMES.items()
    ) + """ from documents) select doc_id, case when licenca + segredo + romance + germanico = 0 then 'outros' when licenca >= greatest(segredo, romance, germanico) then 'licenca'
      when segredo >= greatest(romance, germanico) then 'segredo' when romance >= germanico then 'romance' else 'germanico' end tema,
      coalesce(greatest(licenca, segredo, romance, germanico) / cast(nullif(licenca + segredo + romance + germanico, 0) as double), 0e0) confianca from s""",
    tables=False,
)
def theme_by_keywords(s: Star, phrases: dict | None = None) -> DataFrame:
    """Keyword classification over whole texts: the best theme and its share of the score."""
    rows = s.table("documents").select("doc_id", classify(F.col("text"), phrases or SAMPLE_THEMES).alias("s"))
    best, total = F.array_min("s"), -F.aggregate("s", F.lit(0), lambda acc, x: acc + x["m"])
    return rows.select("doc_id", F.when(total == 0, "outros").otherwise(best["tema"]).alias("tema"), F.coalesce(F.try_divide((-best["m"]).cast("double"), total), F.lit(0.0)).alias("confianca"))


_GENERAL, _MINING = themes.GENERAL, themes.MINING


def official_theme(c, mining):
    """(m, k, tema) of every theme: minus its score in both tables, its place among ties, and its name.

    Where mining holds, the mining table comes first, so its themes win ties.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    first, then = list(_GENERAL | _MINING), list(_MINING | _GENERAL)
    score = lambda name: T.keyword_score(low, _GENERAL.get(name, ()) + _MINING.get(name, ()))
    place = lambda name: F.when(mining, then.index(name)).otherwise(first.index(name))
    return F.array(*[F.struct((-score(name)).alias("m"), place(name).alias("k"), F.lit(name).alias("tema")) for name in first])


_PHRASES = [p for table in (_GENERAL, _MINING) for own in table.values() for p in own]


def _official_sql() -> str:
    first, then = list(_GENERAL | _MINING), list(_MINING | _GENERAL)
    score = lambda name: " + ".join(f"case when contains(x, '{p}') then {len(p.split())} else 0 end" for p in _GENERAL.get(name, ()) + _MINING.get(name, ()))
    names = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "]"
    best = lambda order: f"[{', '.join(repr(n) for n in order)}][list_position([{', '.join(order)}], greatest({', '.join(order)}))]"
    return f"""select id, case when total = 0 then 'outros' when anm then {best(then)} else {best(first)} end tema, coalesce(greatest({", ".join(first)}) / cast(nullif(total, 0) as double), 0e0) confianca from (
      select *, {" + ".join(first)} total from (select id, anm, {", ".join(f"{score(n)} {n}" for n in first)} from (
        select id, agencia_id % 5 = 0 anm, case when id % 7 = 0 then '' else lower(concat(({names})[1 + id % {len(_PHRASES)}], ', ', upper(({names})[1 + (id // 3) % {len(_PHRASES)}]), ' ', interessado)) end x from deliberacoes)))"""


@query("microtema_oficial", _official_sql())
def official_themes(s: Star) -> DataFrame:
    """The official phrases over texts that hold two of them, those of agencies 0, 5, ... being of mining;
    every seventh text is empty."""
    names = F.array(*[F.lit(p) for p in _PHRASES])
    pick = lambda k: F.element_at(names, (1 + k % len(_PHRASES)).cast("int"))
    k = F.col("id")
    text = F.when(k % 7 == 0, "").otherwise(F.concat(pick(k), F.lit(", "), F.upper(pick(F.floor(k / 3))), F.lit(" "), F.col("interessado")))
    rows = s.deliberacoes.select("id", official_theme(text, F.col("agencia_id") % 5 == 0).alias("s"))
    best, total = F.array_min("s"), -F.aggregate("s", F.lit(0), lambda acc, x: acc + x["m"])
    return rows.select("id", F.when(total == 0, "outros").otherwise(best["tema"]).alias("tema"), F.coalesce(F.try_divide((-best["m"]).cast("double"), total), F.lit(0.0)).alias("confianca"))


_AREA_PHRASES = [p for own in themes.AREAS.values() for p in own]


def area(c):
    """(area, confianca): the regulatory area of the highest score over its phrases without accents, ties by the
    order of areas, and its share of all scores; outros and 0 for none."""
    plain = {name: tuple(map(_unaccented, own)) for name, own in themes.AREAS.items()}

    def scores(low):
        return F.array(*[F.struct((-T.keyword_score(low, own)).alias("m"), F.lit(k).alias("k"), F.lit(name).alias("area")) for k, (name, own) in enumerate(plain.items())])

    def best(scored):
        first, total = F.array_min(scored), -F.aggregate(scored, F.lit(0), lambda acc, x: acc + x["m"])
        return F.struct(F.when(total == 0, "outros").otherwise(first["area"]).alias("area"), F.coalesce(F.try_divide((-first["m"]).cast("double"), total), F.lit(0.0)).alias("confianca"))

    # each step is worked out once a row
    return F.transform(F.transform(F.array(X.flat(c)), scores), best)[0]


def _unaccented(x: str) -> str:
    return x.translate(str.maketrans(T.ACCENTED, T.PLAIN))


def _area_sql() -> str:
    names = list(themes.AREAS)
    score = lambda own: " + ".join(f"case when contains(x, '{_unaccented(p)}') then {len(p.split())} else 0 end" for p in own)
    phrases = "[" + ", ".join(f"'{p}'" for p in _AREA_PHRASES) + "]"
    return f"""select id, case when total = 0 then 'outros' else {[*names]}[list_position([{", ".join(names)}], greatest({", ".join(names)}))] end area,
      case when total = 0 then 0e0 else greatest({", ".join(names)}) / cast(total as double) end confianca from (
      select id, {", ".join(names)}, {" + ".join(names)} total from (select id, {", ".join(f"{score(own)} {name}" for name, own in themes.AREAS.items())} from (
        select id, case when id % 7 = 0 then 'nada' else lower(strip_accents(concat(upper(({phrases})[1 + id % {len(_AREA_PHRASES)}]), ' e ', ({phrases})[1 + (id // 5) % {len(_AREA_PHRASES)}]))) end x from deliberacoes)))"""


@query("areas_regulatorias", _area_sql())
def regulatory_areas(s: Star) -> DataFrame:
    """The regulatory area of texts that hold two of its phrases, with the share of the winning score; every seventh has none."""
    names, k = F.array(*[F.lit(p) for p in _AREA_PHRASES]), F.col("id")
    pick = lambda n: F.element_at(names, (1 + n % len(_AREA_PHRASES)).cast("int"))
    text = F.when(k % 7 == 0, "nada").otherwise(F.concat(F.upper(pick(k)), F.lit("\n e "), pick(F.floor(k / 5))))
    return s.deliberacoes.select("id", area(text).alias("a")).select("id", "a.area", "a.confianca")


_CRITERIA = themes.CRITERIA


def _relevance_sql() -> str:
    each = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in words) + "]" for words in _CRITERIA.values()) + "]"
    return f"""select id, criterio, cast(round(least(1.0, len(list_filter(w, lambda p: contains(x, p))) / cast(least(len(w), 3) as double)) * 100) as int) relevancia from (
      select id, criterio, ({each})[criterio] w, concat(({each})[criterio][1 + id % 4], '; ', ({each})[criterio][1 + (id // 4) % 4], case when id % 3 = 0 then '' else ' e ' || ({each})[1 + (id // 16) % 6][1] end) x
      from (select id, cast(1 + id % 6 as int) criterio from deliberacoes))"""


@query("relevancia_da_evidencia", _relevance_sql())
def evidence_relevance(s: Star) -> DataFrame:
    """#104: how much of a criterion's key words an evidence has, over texts made of key words."""
    table = F.array(*[F.array(*[F.lit(w) for w in words]) for words in _CRITERIA.values()])
    k, c = F.col("id"), (1 + F.col("id") % 6).cast("int")
    word = lambda row, at: F.element_at(F.element_at(table, row), (1 + at).cast("int"))
    other = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" e "), word((1 + F.floor(k / 16) % 6).cast("int"), F.lit(0))))
    rows = s.deliberacoes.select("id", c.alias("criterio"), F.upper(F.concat(word(c, k % 4), F.lit("; "), word(c, F.floor(k / 4) % 4), other)).alias("x"))
    say = F.lit(None).cast("int")
    for n in range(1, 7):
        say = F.when(F.col("criterio") == n, X.relevance(F.col("x"), n)).otherwise(say)
    return rows.select("id", "criterio", say.alias("relevancia"))


@query(
    "privacidade",
    r"""select doc_id, regexp_matches(text, '\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b') tem_cpf, regexp_matches(text, '\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b') tem_email,
        len(regexp_extract_all(text, '\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b')) emails from documents""",
    tables=False,
)
def privacy_flags(s: Star) -> DataFrame:
    """Whether a text has a CPF or an e-mail address, and how many of the latter."""
    t = F.col("text")
    return s.table("documents").select("doc_id", t.rlike(T.CPF).alias("tem_cpf"), t.rlike(T.EMAIL).alias("tem_email"), F.regexp_count(t, F.lit(T.EMAIL)).cast("long").alias("emails"))


@query(
    "texto_limpo",
    r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b', '[CPF removido]', 'g'),
         '\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b', '[e-mail removido]', 'g'), '\b(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}[-\s]?\d{4}\b', '[telefone removido]', 'g'), '\s+', ' ', 'g')) texto from documents""",
    tables=False,
)
def scrubbed(s: Star) -> DataFrame:
    """Texts with personal data as placeholders."""
    return s.table("documents").select("doc_id", T.scrub(F.col("text")).alias("texto"))


@query("texto_ruim", "select source, count(*) n, count(*) filter (len(text) < 40) curtos, count(*) filter (len(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.5 * len(text)) gritados from documents group by 1", tables=False)
def junk(s: Star) -> DataFrame:
    """Short and shouted texts by source."""
    t = F.col("text")
    return s.table("documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.length(t) < 40).alias("curtos"), F.count_if(F.regexp_count(t, F.lit("[A-Z]")) > 0.5 * F.length(t)).alias("gritados")
    )


@query("mojibake", "select doc_id, lang, md5(text) texto from documents", tables=False)
def mojibake(s: Star) -> DataFrame:
    """Texts whose UTF-8 was read as Latin-1, repaired again, by contents."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return s.table("documents").select("doc_id", "lang", F.md5(charset.reread(broken)).alias("texto"))


@query("datas_por_extenso", "select k, cast('1996-' || lpad(cast(k % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(k % 28 + 1 as varchar), 2, '0') as date) dia from (select n_nationkey k from nation)", tables=False)
def long_dates(s: Star) -> DataFrame:
    """Dates written out, read back."""
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*[F.lit(m) for m in T.MONTHS]), (k % 12 + 1).cast("int"))
    text = F.concat(F.lit("Brasília, "), (k % 28 + 1).cast("string"), F.lit(" de "), F.replace(name, F.lit("marco"), F.lit("março")), F.lit(" de 1996."))
    return s.table("nation").select(k.alias("k"), T.long_date(text).alias("dia"))


_SMALL = "('de', 'da', 'do', 'das', 'dos', 'e')"


@query(
    "variantes_de_nome",
    f"""select id, unnest(list_filter(list_distinct([t[1] || ' ' || t[2], t[1] || ' ' || t[-1], t[1] || ' ' || t[2] || ' ' || t[3]] || list_transform(list_filter(t[2:], lambda x: lower(x) not in {_SMALL}), lambda x: t[1] || ' ' || x)
         || case when len(b) between 2 and len(t) - 1 then [array_to_string(b, ' ')] else [] end), lambda x: x <> n)) forma
       from (select id, n, t, list_filter(t, lambda x, i: lower(x) not in {_SMALL} and (i = 1 or lower(t[i - 1]) not in {_SMALL})) b from (select id, n, string_split(n, ' ') t from (select id, 'Ana Maria de ' || replace(nome, '#', ' da ') n from diretores)))""",
)
def variants(s: Star) -> DataFrame:
    """Shorter forms of the registered names."""
    return s.diretores.select("id", F.explode(T.name_variants(F.concat(F.lit("Ana Maria de "), F.replace("nome", F.lit("#"), F.lit(" da "))))).alias("forma"))


@query("paginas_titulos", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) titulo, len(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"')) links, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) lang from pages", tables=False)
def page_meta(s: Star) -> DataFrame:
    """#12, #13: title, language and number of links of a page."""
    h = F.col("html")
    return s.table("pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("titulo"), F.regexp_count(h, F.lit('<a\\s+href="([^"]*)"')).cast("long").alias("links"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"))


@query("paginas_links", "select page_id, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) href, unnest(range(len(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)))) pos from pages", tables=False)
def page_links(s: Star) -> DataFrame:
    """#14: links in order."""
    found = F.regexp_extract_all("html", F.lit('<a\\s+href="([^"]*)"'), F.lit(1))
    return s.table("pages").select("page_id", F.posexplode(found).alias("pos", "href")).select("page_id", "href", F.col("pos").cast("long").alias("pos"))


@query("tipo_de_conteudo", "select kind, count(*) n from (select case when html like '%PDF-%' and starts_with(html, '%PDF-') then 'pdf' when starts_with(html, 'PK') then 'zip' when starts_with(lower(ltrim(html)), '<!doctype html') or starts_with(lower(ltrim(html)), '<html') then 'html' else 'outro' end kind from pages) group by 1", tables=False)
def sniff(s: Star) -> DataFrame:
    """#11: content types by their first characters."""
    from quorumlake.sources.files import content_type

    return s.table("pages").groupBy(content_type(F.encode("html", "UTF-8")).alias("kind")).agg(F.count("*").alias("n"))


@query("turnos_monotonicos", "select conv_id, count(*) turnos, bool_and(ok) ordenada from (select conv_id, turn = coalesce(lag(turn) over (partition by conv_id order by turn, role) + 1, min(turn) over (partition by conv_id)) ok from conversations) group by 1", tables=False)
def turns_in_order(s: Star) -> DataFrame:
    """Whether a conversation's turns follow one another: the count of distinct turns fills their range."""
    t = s.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turnos"), F.count_distinct("turn").alias("d"), F.min("turn").alias("a"), F.max("turn").alias("b"))
    return t.select("conv_id", "turnos", ((F.col("turnos") == F.col("d")) & (F.col("b") - F.col("a") + 1 == F.col("d"))).alias("ordenada"))
