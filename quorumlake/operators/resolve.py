"""Entity resolution and deduplication: fuzzy joins, duplicate cascades, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import predicates as P
from quorumlake.functions import text as T
from quorumlake.operators.analytics import final
from quorumlake.operators.nearest import nearest_two
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star


def fuzzy_scores(names: DataFrame, register: DataFrame) -> DataFrame:
    """#59: (raw, block, id, score, visited) for names (raw, block) against register (id, block, nome), within blocks: at
    least the two best of each name.

    Distinct names meet distinct register forms (the name and its shorter variants) of their block;
    sorting tokens is done once for each. Tries of the forms are searched, so that most forms are never compared.
    """
    forms = register.select("id", "block", F.explode(F.array_union(F.array("nome"), T.name_variants(F.col("nome")))).alias("forma")).select("id", "block", T.sorted_tokens(F.col("forma")).alias("b"))
    asked = names.select("raw", "block").distinct().where(F.length(F.trim("raw")) >= 3).withColumn("a", T.sorted_tokens(F.col("raw")))
    return nearest_two(asked, forms.where("b is not null").distinct())


def best_match(scores: DataFrame) -> DataFrame:
    """#59, #60: the best entity of each name with its lead over the second; ties by id."""
    w = Window.partitionBy("raw", "block").orderBy(F.desc("score"), "id")
    two = scores.withColumn("n", F.row_number().over(w)).where("n <= 2")
    out = two.groupBy("raw", "block").agg(
        F.max(F.when(F.col("n") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))), F.lit(0.0)).alias("segundo")
    )
    kind = F.when(F.col("score") >= P.MATCH, "match").when(F.col("score") >= P.REVIEW, "revisao").otherwise("novo")
    return out.withColumn("classe", kind)


def _names(s: Star) -> tuple[DataFrame, DataFrame]:
    """Registered part names of three words and more per brand, and requests with tokens swapped, lost or added and a letter lost."""
    p = s.table("part").where("p_name is not null and p_type is not null")
    t, kind, k = F.split("p_name", " "), F.element_at(F.split(F.initcap("p_type"), " "), -1), F.col("p_partkey")
    register = p.groupBy(F.col("p_brand").alias("block"), F.concat_ws(" ", "p_name", F.when(k % 2 == 0, F.lit("de")), kind).alias("nome")).agg(F.min("p_partkey").alias("id"))
    short = F.expr("left(split(p_name, ' ')[0], greatest(length(split(p_name, ' ')[0]) - 1, 1))")
    raw = F.concat_ws(" ", F.when(k % 3 == 0, kind), F.element_at(t, -1), short)
    return p.select(raw.alias("raw"), F.col("p_brand").alias("block")), register


_SMALL = "('de', 'da', 'do', 'das', 'dos', 'e')"
_FUZZY = f"""with p as (select *, p_partkey k, string_split(p_name, ' ') t, string_split(p_type, ' ')[-1] y from part where p_name is not null and p_type is not null),
  named as (select k, p_brand block, t, p_name || case when k % 2 = 0 then ' de ' else ' ' end || upper(left(y, 1)) || lower(substr(y, 2)) nome from p),
  reg as (select block, nome, min(k) id from named group by 1, 2),
  ask as (select distinct case when k % 3 = 0 then upper(left(y, 1)) || lower(substr(y, 2)) || ' ' else '' end || t[-1] || ' ' || left(t[1], greatest(length(t[1]) - 1, 1)) raw, p_brand block from p),
  tok as (select *, string_split(nome, ' ') t from reg),
  bare as (select *, list_filter(t, lambda x, i: lower(x) not in {_SMALL} and (i = 1 or lower(t[i - 1]) not in {_SMALL})) b from tok),
  form as (select id, block, unnest([nome] || case when len(t) < 3 then [] else [t[1] || ' ' || t[2], t[1] || ' ' || t[-1], t[1] || ' ' || t[2] || ' ' || t[3]] || list_transform(list_filter(t[2:], lambda x: lower(x) not in {_SMALL}), lambda x: t[1] || ' ' || x)
         || case when len(b) between 2 and len(t) - 1 then [array_to_string(b, ' ')] else [] end end) forma from bare),
  k as (select raw, a.block, id, array_to_string(list_sort(string_split(lower(raw), ' ')), ' ') x, array_to_string(list_sort(string_split(lower(forma), ' ')), ' ') y from ask a join form r on r.block = a.block),
  sc as (select raw, block, id, max(case when x = y then 1e0 else 1e0 - levenshtein(x, y) / cast(greatest(length(x), length(y)) as double) end) score from k group by 1, 2, 3),
  rk as (select *, row_number() over (partition by raw, block order by score desc, id) n from sc),
  bm as (select raw, block, max(id) filter (n = 1) id, max(score) filter (n = 1) score, coalesce(max(score) filter (n = 2), 0e0) segundo from rk where n <= 2 group by 1, 2)
"""


@query("fuzzy_match", _FUZZY + "select raw, block, id, score, segundo, case when score >= 0.85 then 'match' when score >= 0.60 then 'revisao' else 'novo' end classe from bm", tables=False)
def fuzzy_match(s: Star) -> DataFrame:
    """#59, #60, #116."""
    return best_match(fuzzy_scores(*_names(s)))


@query(
    "candidate_approval",
    _FUZZY + "select case when score >= 0.80 then 'aprovar' when score >= 0.60 and score - segundo >= 0.15 then 'aprovar_margem' when score >= 0.60 then 'sem_margem' else 'novo' end decisao, count(*) n from bm group by 1",
    tables=False,
)
def candidate_approval(s: Star) -> DataFrame:
    """#141: approve, approve by margin, leave, or new."""
    b = best_match(fuzzy_scores(*_names(s)))
    sc, lead = F.col("score"), F.col("score") - F.col("segundo")
    say = F.when(sc >= 0.80, "aprovar").when((sc >= P.REVIEW) & (lead >= P.MARGIN), "aprovar_margem").when(sc >= P.REVIEW, "sem_margem").otherwise("novo")
    return b.groupBy(say.alias("decisao")).agg(F.count("*").alias("n"))


@query(
    "company_key",
    r"""select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(case id % 5 when 0 then 'Companhia ' || nome || ' S/A' when 1 then 'CONCESSIONÁRIA ' || nome || ' - Ltda.'
           when 2 then nome || ' Participações e  Empreendimentos S.A.' when 3 then '"' || nome || '" (EIRELI), ME' else 'Cia. São ' || replace(nome, '#', ' / ') || '\Saúde EPP' end)),
         '[.,/\\\\()''"]+', ' ', 'g'), '\b(s\s*/?\s*a|sa|ltda|eireli|epp|mei|me|cia|companhia|concessionaria|holding|participacoes|empreendimentos)\b', ' ', 'g'), '\s+', ' ', 'g')) chave from empresas""".replace("\\\\", "\\"),
)
def company_keys(s: Star) -> DataFrame:
    """#61: canonical keys of names with company forms, accents and punctuation around them."""
    k, name, lit = F.col("id") % 5, F.col("nome"), F.lit
    dressed = (
        F.when(k == 0, F.concat(lit("Companhia "), name, lit(" S/A"))).when(k == 1, F.concat(lit("CONCESSIONÁRIA "), name, lit(" - Ltda.")))
        .when(k == 2, F.concat(name, lit(" Participações e  Empreendimentos S.A."))).when(k == 3, F.concat(lit('"'), name, lit('" (EIRELI), ME')))
        .otherwise(F.concat(lit("Cia. São "), F.replace(name, lit("#"), lit(" / ")), lit("\\Saúde EPP")))
    )
    return s.empresas.select("id", T.company_key(dressed).alias("chave"))


def close_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of the pairs of rows (block, id, t) of one block whose similarity is `least` or more; a < b.

    Texts are compared once each, and ids meet by their texts. k, the most edits of a pair, is what the shorter text's
    length leaves: a text of n characters has partners of at most n / least. With one edit both texts are alike less a
    character of each at most, which few texts share. With more, one of k + 1 pieces of the shorter text stands whole in
    the longer one, at most k places off. Both meet by equi-joins, and only those pairs are measured.
    """
    rows = rows.where("t is not null").select("block", "id", "t").distinct()
    most = lambda n: F.floor(n * ((1 - least) / least) + 1e-9).cast("int")
    shortest = lambda n: F.ceil(n * least - 1e-9).cast("int")
    texts = rows.select("block", "t", F.length("t").alias("n")).distinct()
    close = _one_edit(texts.where(most(shortest(F.col("n"))) <= 1)).unionByName(_by_pieces(texts, most, shortest))
    score = T.similarity(F.col("x"), F.col("y"))
    close = close.select("block", "x", "y", score.alias("score")).where(F.col("score") >= least).distinct()
    same = rows.select("block", F.col("t").alias("x"), F.col("t").alias("y"), F.lit(1.0).alias("score")).distinct()
    of = lambda t, i: rows.select("block", F.col("t").alias(t), F.col("id").alias(i))
    pairs = lambda df: df.join(of("x", "i"), ["block", "x"]).join(of("y", "j"), ["block", "y"])
    ids = pairs(close).where("i <> j").unionByName(pairs(same).where("i < j"))
    return ids.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "score")


def _one_edit(texts: DataFrame) -> DataFrame:
    """Pairs (block, x, y), x < y, of texts that are equal with a character less of either or both."""
    less = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.substr("t", F.lit(1), i - 1), F.substr("t", i + 1)))
    forms = F.when(F.col("n") > 0, F.array_distinct(F.array_append(less, F.col("t"))))
    rows = texts.select("block", "t", F.explode(forms).alias("form"))
    met = rows.withColumnRenamed("t", "x").join(rows.withColumnRenamed("t", "y"), ["block", "form"])
    return met.where("x < y").select("block", "x", "y")


def _by_pieces(texts: DataFrame, most, shortest) -> DataFrame:
    """Pairs (block, x, y), x < y, of texts that share a piece, for two edits and more."""
    start = lambda i, n, k: F.floor(i * n / (k + 1)).cast("int")
    i, n, k = F.col("i"), F.col("n"), F.col("k")
    pieces = texts.withColumn("k", most(n)).where("k >= 2").withColumn("i", F.explode(F.sequence(F.lit(0), k)))
    size = start(i + 1, n, k) - start(i, n, k)
    pieces = pieces.select("block", F.col("t").alias("short"), "n", "i", F.substring("t", start(i, n, k) + 1, size).alias("piece"))
    asked = texts.withColumnRenamed("n", "own").withColumn("n", F.explode(F.sequence(shortest(F.col("own")), F.col("own")))).withColumn("k", most(n)).where("k >= 2")
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), k)))
    shift = F.explode(F.sequence(F.greatest(start(i, n, k) - k, F.lit(0)), start(i, n, k) + k))
    asked = asked.withColumn("size", size).withColumn("at", shift)
    asked = asked.select("block", F.col("t").alias("long"), "n", "i", F.substring("t", F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    met = pieces.join(asked, ["block", "n", "i", "piece"]).where("short <> long")
    return met.select("block", F.least("short", "long").alias("x"), F.greatest("short", "long").alias("y"))


@query(
    "director_duplicates",
    """, d as (select id, agencia_id, nome || ' Filho' nome from diretores union all select id + 1000000, agencia_id, case id % 3 when 1 then 'FILHO ' || nome when 2 then replace(nome, 'pp', 'p') || ' Filho' else 'Outra ' || nome end from diretores),
       p as (select a.id a, b.id b, array_to_string(list_sort(string_split(lower(a.nome), ' ')), ' ') x, array_to_string(list_sort(string_split(lower(b.nome), ' ')), ' ') y
       from d a join d b on a.agencia_id = b.agencia_id and a.id < b.id)
       select a, b, case when x = y then 1e0 else 1e0 - levenshtein(x, y) / cast(greatest(length(x), length(y)) as double) end score from p
       where case when x = y then 1e0 else 1e0 - levenshtein(x, y) / cast(greatest(length(x), length(y)) as double) end >= 0.95""",
)
def director_duplicates(s: Star, least: float = 0.95) -> DataFrame:
    """#62: pairs of one agency with like names, the smaller id first. Every director is registered a second time: with words
    swapped, a letter lost, or another name."""
    name, k = F.col("nome"), F.col("id") % 3
    again = F.when(k == 1, F.concat(F.lit("FILHO "), name)).when(k == 2, F.concat(F.replace(name, F.lit("pp"), F.lit("p")), F.lit(" Filho"))).otherwise(F.concat(F.lit("Outra "), name))
    d = s.diretores.select("agencia_id", "id", F.concat(name, F.lit(" Filho")).alias("nome")).unionByName(s.diretores.select("agencia_id", (F.col("id") + 1_000_000).alias("id"), again.alias("nome")))
    return close_pairs(d.select(F.col("agencia_id").alias("block"), "id", T.sorted_tokens(F.col("nome")).alias("t")), least)


@query(
    "find_existing",
    """select nid, coalesce(
      (select min(v.id) from deliberacoes v where v.id < n.nid and v.agencia_id = n.agencia_id and v.numero_deliberacao = n.nn and (v.data_reuniao is null or n.nd is null or year(v.data_reuniao) = year(n.nd))),
      (select min(v.id) from deliberacoes v where v.id < n.nid and v.agencia_id = n.agencia_id and v.data_reuniao = n.nd and regexp_replace(v.numero_deliberacao, '0+(\\d)', '\\1', 'g') = regexp_replace(n.nn, '0+(\\d)', '\\1', 'g')),
      (select min(v.id) from deliberacoes v where v.id < n.nid and v.agencia_id = n.agencia_id and v.processo = n.np and v.data_reuniao = n.nd),
      (select min(v.id) from deliberacoes v where v.id < n.nid and v.agencia_id = n.agencia_id and v.numero_reuniao = n.nr and regexp_replace(lower(v.processo), '0+(\\d)', '\\1', 'g') = regexp_replace(lower(n.np), '0+(\\d)', '\\1', 'g'))) achado
      from (select id nid, agencia_id, numero_deliberacao nn, data_reuniao nd, processo np, numero_reuniao nr from deliberacoes) n""",
)
def find_existing(s: Star) -> DataFrame:
    """#132: each decision's earliest one before it: same number in a compatible year, same date and like
    number, same process and date, same process and meeting; the first that holds. The least id of a key
    tells whether any comes before, so that no row meets all others of its key."""
    k = T.number_key
    rows = s.deliberacoes.select("id", "agencia_id", "numero_deliberacao", F.year("data_reuniao").alias("ano"), "data_reuniao", "processo", "numero_reuniao", k(F.col("numero_deliberacao")).alias("numero"), k(F.col("processo")).alias("p"))
    own = ["agencia_id", "numero_deliberacao"]
    by_year = rows.groupBy(*own, "ano").agg(F.min("id").alias("m"))
    by_number = by_year.groupBy(*own).agg(F.min("m").alias("todos"), F.min(F.when(F.col("ano").isNull(), F.col("m"))).alias("sem_ano"))
    found = rows.join(by_number, own, "left").join(by_year, [*own, "ano"], "left").withColumn("m0", F.when(F.col("ano").isNull(), F.col("todos")).otherwise(F.least("m", "sem_ano"))).drop("m")
    keys = [["agencia_id", "data_reuniao", "numero"], ["agencia_id", "processo", "data_reuniao"], ["agencia_id", "numero_reuniao", "p"]]
    for n, key in enumerate(keys, 1):
        found = found.join(rows.dropna(subset=key).groupBy(*key).agg(F.min("id").alias(f"m{n}")), key, "left")
    before = [F.when(F.col(f"m{n}") < F.col("id"), F.col(f"m{n}")) for n in range(4)]
    return found.select(F.col("id").alias("nid"), F.coalesce(*before).alias("achado"))


_KEY = """case when numero_deliberacao is not null and data_reuniao is not null then 'n|' || agencia_id || '|' || numero_deliberacao || '|' || year(data_reuniao)
  when processo is not null and data_reuniao is not null then 'p|' || agencia_id || '|' || processo || '|' || data_reuniao end"""


def duplicate_key():
    day, agency = F.col("data_reuniao"), F.col("agencia_id").cast("string")
    by_number = F.concat_ws("|", F.lit("n"), agency, F.col("numero_deliberacao"), F.year(day).cast("string"))
    by_process = F.concat_ws("|", F.lit("p"), agency, F.col("processo"), day.cast("string"))
    return F.when(F.col("numero_deliberacao").isNotNull() & day.isNotNull(), by_number).when(F.col("processo").isNotNull() & day.isNotNull(), by_process)


@query("dedup_retroativo", f"select chave, count(*) copias, min(id) fica from (select id, {_KEY} chave from deliberacoes) where chave is not null group by 1 having count(*) > 1")
def retroactive_dedup(s: Star) -> DataFrame:
    """#133: groups under one key and the oldest, which stays."""
    rows = s.deliberacoes.select("id", duplicate_key().alias("chave")).where("chave is not null")
    return rows.groupBy("chave").agg(F.count("*").alias("copias"), F.min("id").alias("fica")).where("copias > 1")


@query(
    "dedup_votos_migrados",
    f""", k as (select id, min(id) over (partition by chave) fica from (select id, {_KEY} chave from deliberacoes) where chave is not null),
       m as (select v.diretor_id, v.tipo_voto, k.fica, v.deliberacao_id from v join k on k.id = v.deliberacao_id where k.id <> k.fica)
       select fica deliberacao_id, diretor_id, min(deliberacao_id) de from m where not exists (select 1 from v where v.deliberacao_id = m.fica and v.diretor_id = m.diretor_id) group by 1, 2""",
)
def migrated_votes(s: Star) -> DataFrame:
    """#133, #137: votes of copies that their kept decision lacks, one per director."""
    keyed = s.deliberacoes.select("id", duplicate_key().alias("chave")).where("chave is not null")
    kept = keyed.groupBy("chave").agg(F.min("id").alias("fica"), F.count("*").alias("n")).where("n > 1")
    gone = keyed.join(kept, "chave").where("id <> fica").select(F.col("id").alias("deliberacao_id"), "fica")
    moved = s.votos.select("deliberacao_id", "diretor_id").join(gone, "deliberacao_id").groupBy(F.col("fica").alias("k"), F.col("diretor_id").alias("d")).agg(F.min("deliberacao_id").alias("de"))
    held = s.votos.select(F.col("deliberacao_id").alias("k"), F.col("diretor_id").alias("d"))
    return moved.join(held, ["k", "d"], "left_anti").select(F.col("k").alias("deliberacao_id"), F.col("d").alias("diretor_id"), "de")


@query(
    "chave_semantica",
    """select id, case when numero_deliberacao is not null then concat_ws('|', a, t, numero_deliberacao)
         when numero_reuniao is not null and tipo_documento in ('ata', 'pauta') then concat_ws('|', a, t, numero_reuniao)
         when processo is not null and data_reuniao is not null then concat_ws('|', a, t, lower(processo), replace(cast(data_reuniao as varchar), '-', ' ') || case when t = 'voto individual' then '|doc ' || id else '' end)
         when numero_reuniao is not null then concat_ws('|', a, t, numero_reuniao, 'doc ' || id) else concat_ws('|', a, t, 'doc ' || id) end chave
       from (select d.*, trim(regexp_replace(lower(sigla), '[^a-z0-9]+', ' ', 'g')) a, replace(tipo_documento, '_', ' ') t from deliberacoes d join agencias on agencias.id = d.agencia_id)""",
)
def semantic_keys(s: Star) -> DataFrame:
    """#134: own number; meeting, for types that are one per meeting; process and date, with the file for
    votes; meeting and file; file; else none."""
    rows = s.deliberacoes.join(s.agencias.select(F.col("id").alias("agencia_id"), "sigla"), "agencia_id")
    a, t, file = T.normalize(F.col("sigla")), T.normalize(F.col("tipo_documento")), F.concat(F.lit("doc "), F.col("id").cast("string"))
    n, m, p, d = (T.normalize(F.col(c).cast("string")) for c in ("numero_deliberacao", "numero_reuniao", "processo", "data_reuniao"))
    one_per_meeting = t.isin("ata", "pauta")
    key = (
        F.when(n != "", F.concat_ws("|", a, t, n)).when((m != "") & one_per_meeting, F.concat_ws("|", a, t, m))
        .when((p != "") & (d != ""), F.concat_ws("|", a, t, p, d, F.when(t == "voto individual", file)))
        .when(m != "", F.concat_ws("|", a, t, m, file)).otherwise(F.concat_ws("|", a, t, file))
    )
    return rows.select("id", key.alias("chave"))


@query(
    "gemeos_da_fila",
    "select event_id, case when n = 1 then 'segue' else 'espera' end decisao from (select event_id, row_number() over (partition by user_id, event_type, props order by event_id) n from events)",
    tables=False,
)
def queue_twins(s: Star) -> DataFrame:
    """#135: of pending twins only the smallest id proceeds."""
    e = s.table("events")
    least = e.groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("primeiro"))
    rows = e.join(least, (e["user_id"].eqNullSafe(least["user_id"])) & e["event_type"].eqNullSafe(least["event_type"]) & e["props"].eqNullSafe(least["props"]))
    return rows.select("event_id", F.when(F.col("event_id") == F.col("primeiro"), "segue").otherwise("espera").alias("decisao"))


@query("dedup_arquivo", "select sha256(text) hash, min(doc_id) fica, count(*) copias from documents group by 1 having count(*) > 1", tables=False)
def file_dedup(s: Star) -> DataFrame:
    """#7, #135: documents of one hash and the one that stays; only hashes are shuffled."""
    d = s.table("documents").select(F.sha2(F.col("text"), 256).alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.min("doc_id").alias("fica"), F.count("*").alias("copias")).where("copias > 1")


@query(
    "dedup_intra_ata",
    "select id from (select id, row_number() over (partition by agencia_id, numero_reuniao, processo order by (resultado is not null) desc, length(interessado) desc, id) n from deliberacoes where tipo_documento = 'ata' and processo is not null) where n = 1",
)
def intra_ata_dedup(s: Star) -> DataFrame:
    """#136: one item per meeting and process: with a decision first, then the longer text."""
    rows = s.deliberacoes.where("tipo_documento = 'ata' and processo is not null")
    best = F.min(F.struct(F.when(F.col("resultado").isNull(), 1).otherwise(0), -F.length("interessado"), F.col("id"))).alias("m")
    return rows.groupBy("agencia_id", "numero_reuniao", "processo").agg(best).select(F.col("m.id").alias("id"))


@query("enriquecer", "select o.id, coalesce(o.resultado, n.resultado) resultado, coalesce(o.processo, n.processo) processo from deliberacoes o left join deliberacoes n on n.id = o.id + 1")
def enrich(s: Star) -> DataFrame:
    """#138: fields that are unknown take the newly known ones."""
    new = s.deliberacoes.select((F.col("id") - 1).alias("id"), F.col("resultado").alias("r"), F.col("processo").alias("p"))
    rows = s.deliberacoes.join(new, "id", "left")
    return rows.select("id", F.coalesce("resultado", "r").alias("resultado"), F.coalesce("processo", "p").alias("processo"))


@query("merge_diretores", "select case when d.id % 10 = 3 then d.id - 1 else d.id end diretor_id, count(distinct deliberacao_id) votos from v join diretores d on d.id = v.diretor_id group by 1")
def merge_directors(s: Star) -> DataFrame:
    """#137: votes after directors are merged into another id; a decision where both voted counts once."""
    to = F.when(F.col("diretor_id") % 10 == 3, F.col("diretor_id") - 1).otherwise(F.col("diretor_id"))
    known = s.votos.join(s.diretores.select(F.col("id").alias("diretor_id")), "diretor_id", "left_semi")
    return known.groupBy(to.alias("diretor_id")).agg(F.count_distinct("deliberacao_id").alias("votos"))


@query("orgao_interno", "select (lower(interessado) like '%superintend%' or lower(interessado) like '%diretoria%' or lower(interessado) like '%0001%') interno, count(*) n from deliberacoes group by 1")
def internal_bodies(s: Star) -> DataFrame:
    """#45: interested parties that are no company, by pattern."""
    return s.deliberacoes.groupBy(F.lower("interessado").rlike("superintend|diretoria|0001").alias("interno")).agg(F.count("*").alias("n"))


@query("dimensao_nova", "select distinct interessado from f where data_reuniao >= date '1998-01-01' and interessado not in (select interessado from deliberacoes where data_reuniao < date '1998-01-01')")
def new_dimension_rows(s: Star) -> DataFrame:
    """#26: companies not known before a day, to be appended."""
    day = F.to_date(F.lit("1998-01-01"))
    known = s.deliberacoes.where(F.col("data_reuniao") < day).select("interessado").distinct()
    return final(s).where(F.col("data_reuniao") >= day).select("interessado").distinct().join(known, "interessado", "left_anti")


@query("fundir_referencia", "select agencia_id, numero_reuniao, max(data_publicacao) data_publicacao, bool_or(resultado is not null) publicada, count(*) itens, min(processo) processo from deliberacoes where numero_reuniao is not null group by 1, 2")
def merge_reference(s: Star) -> DataFrame:
    """#25: listing snapshots merged: known beats unknown, or, max."""
    rows = s.deliberacoes.where("numero_reuniao is not null")
    return rows.groupBy("agencia_id", "numero_reuniao").agg(
        F.max("data_publicacao").alias("data_publicacao"), F.bool_or(F.col("resultado").isNotNull()).alias("publicada"), F.count("*").alias("itens"), F.min("processo").alias("processo")
    )
