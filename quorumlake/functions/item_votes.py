"""Votes that the text of one item states: phrases become events, and a fold over the events keeps the sets
of names by direction, with the rules by which one statement overrules another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions import extract as X
from quorumlake.functions.text import once

# A name in running text, the dashes of tables, and who is diverged from or followed.
_CAPITAL, _SMALL = "[A-ZÁÉÍÓÚÂÊÔÃÕÇÀÜ]", "[a-záéíóúâêôãõçàü]"
NAME = rf"{_CAPITAL}{_SMALL}+(?:\s+(?:d[aeo]s?|e|{_CAPITAL}{_SMALL}+)){{1,5}}"
NAME_WITHOUT_AND = rf"{_CAPITAL}{_SMALL}+(?:\s+(?:d[aeo]s?|{_CAPITAL}{_SMALL}+)){{1,6}}"
DASH = "[-–—‒―]"
OFFICE = r"(?:[Dd]iretora?\s+|[Cc]onselheiroa?\s+)?"
MEMBER = r"(?:[Rr]elatora?|[Rr]evisora?|[Dd]iretora?(?:[-\s]Geral)?|[Cc]onselheir[oa])"
TARGET = rf"(?:{MEMBER}|[Vv]oto\s+d[oa]\s+[Rr]e(?:lator|visor))"
ORDINAL = "(?:[Pp]rimeir|[Ss]egund|[Tt]erceir|[Qq]uart)[oa]"
FOLLOWED = rf"(?:integralmente\s+|parcialmente\s+|na\s+[íi]ntegra\s+)?(?:(?:aos|ao|às|as|os|à|a|o)\s+)?(?:voto\s+(?:d[oa]s?\s+)?)?(?:\(\s*)?(?:{ORDINAL}\s+)?{MEMBER}"
TITLED = r"(?:[Dd]iretora?(?:[-\s](?:Geral|Substitut[oa]))?\s+|[Cc]onselheir[oa]\s+)"
# The phrases by which a text states votes; the last group of each holds the name or names.
TABLE = {"favor": "[Ff]avor[aá]vel", "contra": "[Cc]ontr[aá]ri[ao]", "abstencao": "[Aa]bsten[çc][aã]o", "ausente": "[Aa]usente"}
LIST_TAIL = r"(?:\s+(?:os?|as?))?\s+(?:Diretor(?:es|as)?\s+|Conselheiro(?:s|as)?\s+)?([^.\n;]{4,180})"
LIST_FOR = r"(?i)Vot(?:aram|ou)\s+(?:a\s+)?favor(?:avelmente|[aá]ve(?:l|is))?" + LIST_TAIL
LIST_AGAINST = r"(?i)Vot(?:aram|ou)\s+(?:contr[aá]ri(?:amente|os?|as?)?|contra)" + LIST_TAIL
LOST = r"[Vv]enci[dn][oa](?:\(a\))?\s+(?:[oa]\s+)?"
DISSENT = r"(?:[Cc]om\s+o\s+|[Pp]elo\s+)?[Vv]oto\s+(?:dissidente|divergente|contr[aá]ri[ao]|vencido)\s+d[oa]\s+"
OUTVOTED = rf"(?:{LOST}{OFFICE}|{DISSENT}{OFFICE})({NAME})"
DIVERGED = rf"{OFFICE}({NAME})\.?\s+(?:votou\s+(?:de\s+forma\s+)?(?:contr[aá]ri[ao]|contrariamente|dissidente|divergente)|(?:divergiu|discordou)\s+d[oa]\s+{TARGET})"
AGAINST_OFFICE = rf"(?:{LOST}|{DISSENT})(Diretor[-\s]Geral(?:\s+Substitut[oa])?)(?![A-Za-zÀ-ÿ])"
PRESENTED = (
    r"(?i)diverg[êe]ncia\s+(?:parcial\s+)?(?:apresentada|manifestada|suscitada)\s+pel[oa]\s+((?:Diretor|Diretora|Conselheir[oa]|Relatora?|Revisora?)[A-Za-zÀ-ÿ.'\s-]{0,70}?)"
    r"(?=\s+(?:em|quanto|que|no|na|ao|aos|à|às|acerca|sobre|com|por|apenas|somente|referente|relativ)\b|[,.;:)]|$)"
)
PREFIXES = r"(?i)^(?:(?:Diretor(?:[-\s](?:Geral|Presidente))?|Diretora|Conselheir[oa]|Relatora?|Revisora?|Substitut[oa])[\s-]*)+"
JOINED = rf"{OFFICE}({NAME})\s+(?:acompanh(?:ou|a|am|aram|ando)|segui(?:u|ram|ndo)|aderi(?:u|ram|ndo))\s+{FOLLOWED}"
LEFT = rf"{OFFICE}({NAME})\s+(?:divergi(?:u|ram)|discord(?:ou|a|am|aram|ando))\s+d[oa]\s+{TARGET}\b"
ABSENT = (rf"(?:[Aa]usente[:\s]+(?:[Oo]\s+|[Aa]\s+)?(?:[Dd]iretora?\s+)?|[Aa]us[êe]ncia\s+d[oa]\s+(?:[Dd]iretora?\s+)?)({NAME})", rf"(?:[Dd]iretora?\s+)?({NAME})\s+(?:esteve\s+)?[Aa]usente")
ABSTAINED = rf"(?:[Dd]iretora?\s+)?({NAME})\s*(?:absteve-se|se\s+absteve|(?:votou\s+(?:pela\s+|em\s+)?)?[Aa]bsten[çc][aã]o)"
RECUSED = (
    rf"{TITLED}({NAME})(?:\s*,?\s*(?:este|esta|o\s+qual|a\s+qual))?\s+(?:encontrava-se\s+impedid[oa]|(?:se\s+)?declarou[-\s]se\s+(?:impedid[oa]|suspeit[oa])|est(?:á|a|ava)\s+impedid[oa]"
    r"|impedid[oa]\s+de\s+votar|n[ãa]o\s+(?:votaria|votou)|n[ãa]o\s+(?:participaria|participou|participa)\s+(?:d[aeo]|n[ao])\s+(?:vota[çc][ãa]o|delibera[çc][ãa]o|aprecia[çc][ãa]o|discuss[ãa]o|julgamento))",
    rf"[Ii]mpedid[oa]s?\s+de\s+votar\s+(?:[oa]\s+)?{TITLED}({NAME})",
)
NOT_RECUSED = r"(?i)n[ãa]o\s+h(?:avia|á|ouve)\s+impedimento[^.]{0,200}\.?"
APPROVED = r"[Vv]oto\s+d[oa]\s+([^.;]{0,90}?)\baprovad[oa]\b"
LISTED = rf"Diretora?(?:[-\s](?:Geral|Presidente|Substitut[oa]))?\s*,?\s+({NAME_WITHOUT_AND})"
CASTING = rf"(?i:voto\s+de\s+qualidade)[^.]{{0,60}}?(?i:pel[oa])\s+(?:[Dd]iretora?(?:[-\s]Geral)?\s+|[Pp]residente\s+)({NAME})"
CASTING_OFFICE = r"(?i)voto\s+de\s+qualidade[^.]{0,60}?pel[oa]\s+(Diretor[-\s]Geral)(?![A-Za-zÀ-ÿ])"
CONTESTED = r"(?i)\bpor\s+maioria\b|maioria\s+de\s+votos|voto\s+de\s+qualidade|voto\s+vencedor|voto\s+vencid[oa]|restando\s+vencid[oa]|\bprevaleceu\b|\bempate\b|diverg[êe]nci|\bdivergi(?:r|ndo|u|ram)\b"
CHAIR = rf"(?i:presidid[ao])[\s\S]{{0,40}}?(?i:pel[oa])\s+(?i:Diretor)[-\s](?i:Geral),?\s+({NAME})"
# Words of institutions and of reasons for absence, which lists of names are cleaned of.
INSTITUTIONS = r"(?i)\b(?:Reuni[aã]o|Conselho|Ordin[aá]ria|Extraordin[aá]ria|Diretoria|Superintend[eê]ncia|Ag[eê]ncia|C[aâ]mara|Comiss[aã]o|Presid[eê]ncia|Sistema|Processo|Assunto|Interessad[oa]|Pauta|Sess[aã]o|Colegiad[oa]|Secretaria|Ger[eê]ncia|Coordena[cç][aã]o|N[uú]cleo|Ata|Estado)\b"
REASONS = r"(?i)\b(?:afastamento|f[eé]rias|licen[çc]a|viagem|recesso|justificad[oa]|m[eé]dic[oa]|miss[aã]o|compromisso)\b"
# Where no statement goes on, and what each kind of statement has in it. A full stop may only stand before a verb of dissent.
STOP = r"[,;]|\.(?!\s+(?:votou|divergiu|discordou))"
SIGNS = {
    "table": DASH, "outvoted": "[Vv]enci[dn]|[Vv]oto", "diverged": "votou|divergiu|discordou", "left": "divergi|discord", "joined": "acompanh|segui|aderi", "absent": "[Aa]usente|[Aa]us[êe]ncia", "abstained": "absteve|bsten[çc]",
}
RECUSAL, CAST = r"(?i)impedid|suspeit|n[ãa]o\s+(?:vot|particip)", r"(?i)qualidade"
DIRECTIONS = ("favor", "contra", "abstencao", "ausente")


def flattened(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")


def _all(c: Column, pattern: str) -> Column:
    """Names that a pattern finds, white space as single blanks."""
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def listed(c: Column) -> Column:
    """The names of a list, as `Ana Lima, Diretor Rui Sá e Eva Reis`."""
    bare = F.regexp_replace(c, r"(?i)\b(?:Diretora?|Diretor-Geral|Conselheiroa?|Presidente)\b", "")
    parts = F.transform(F.split(bare, r"(?i)\s*(?:,|;|\se\s)\s*|\s+[-–—]\s+"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\s\-–—]+|[\s\-–—]+$", ""), r"\s+", " ")))

    def a_name(x: Column) -> Column:
        shaped = lambda words: (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(f"^{_CAPITAL}") | w.rlike("^d[aeo]s?$"))
        # a likely name is no office alone
        return once(F.split(x, " "), shaped) & (F.length(x) <= 100) & ~x.rlike(INSTITUTIONS) & ~x.rlike(REASONS) & X.likely_name(x)

    return F.filter(parts, a_name)


def chair(c: Column) -> Column:
    """The director-general that the opening of minutes names; null if none."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), CHAIR, 1), r"(?i)\s+e\s+.*$", ""), r"\s+", " "))
    return F.when((F.size(F.split(name, " ")) >= 2) & ~X.role_only(name), name)


def presented(c: Column, general: Column) -> Column:
    """Who presented a divergence, by name or by the office of director-general."""

    def one(label: Column) -> Column:
        name = F.trim(F.regexp_replace(label, PREFIXES, ""))
        office = F.when(label.rlike(r"(?i)^diretor[-\s]geral"), general)
        return F.when((F.size(F.split(name, r"\s+")) >= 2) & ~X.role_only(name), name).otherwise(office)

    return F.array_compact(F.transform(_all(c, PRESENTED), one))


def approved_authors(c: Column, general: Column) -> Column:
    """Whose vote was approved; whoever won is no dissenter."""
    spans = F.filter(_all(c, APPROVED), lambda x: ~x.rlike(r"(?i)\bn[ãa]o\b"))
    names = F.flatten(F.transform(spans, lambda x: F.filter(_all(x, LISTED), X.strict_name)))
    office = F.when(F.exists(spans, lambda x: x.rlike(r"(?i)Diretor[-\s]Geral")) & general.isNotNull(), F.array(general)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(names, office))


def casting(c: Column, general: Column) -> Column:
    """Who gave the casting vote."""

    def of(flat: Column) -> Column:
        office = F.when(flat.rlike(CASTING_OFFICE), general)
        return once(F.trim(F.regexp_extract(flat, CASTING, 1)), lambda name: F.when((name != "") & X.strict_name(name), name).otherwise(office))

    return F.when(c.rlike(CAST), once(flattened(c), of))


def recused(c: Column) -> Column:
    found = lambda clean: F.array_distinct(F.filter(F.concat(*[_all(clean, p) for p in RECUSED]), lambda x: (F.length(x) > 4) & X.strict_name(x)))
    return F.when(c.rlike(RECUSAL), once(F.regexp_replace(flattened(c), NOT_RECUSED, " "), found)).otherwise(F.array().cast("array<string>"))


def _events(c: Column, general: Column) -> Column:
    """(kind, name) in the order in which statements take effect. Patterns that begin with a name are slow, so they are
    looked for only in those parts of the text that have their signs."""
    return once(F.split(c, STOP), lambda parts: _events_of(c, parts, general))


def _events_of(c: Column, parts: Column, general: Column) -> Column:
    def of(kind: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    def within(sign: str, find) -> Column:
        return F.flatten(F.transform(F.filter(parts, lambda x: x.rlike(SIGNS[sign])), find))

    def names(sign: str, pattern: str) -> Column:
        return within(sign, lambda x: _all(x, pattern))

    def table_row(x: Column) -> Column:
        # the words of TABLE are told apart by their ends
        kind = F.when(x.endswith("usente"), "ausente").when(x.rlike("[aã]o$"), "abstencao").when(x.endswith("vel"), "favor").otherwise("contra")
        return F.struct(kind.alias("kind"), F.trim(F.regexp_replace(F.regexp_extract(x, NAME, 0), r"\s+", " ")).alias("name"))

    rows = F.transform(within("table", lambda x: F.regexp_extract_all(x, F.lit(rf"\b({NAME})\s*{DASH}\s*({'|'.join(TABLE.values())})"), F.lit(0))), table_row)
    lists = [of(kind, F.flatten(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), listed))) for kind, p in (("favor", LIST_FOR), ("contra", LIST_AGAINST))]
    by_office = F.when(c.rlike(AGAINST_OFFICE) & general.isNotNull(), F.array(general)).otherwise(F.array().cast("array<string>"))
    against = [names("outvoted", OUTVOTED), names("diverged", DIVERGED), presented(c, general), by_office, names("left", LEFT)]
    return F.concat(
        rows, *lists, *[of("contra", a) for a in against], of("aderiu", names("joined", JOINED)), *[of("ausente", names("absent", p)) for p in ABSENT], of("absteve-se", names("abstained", ABSTAINED))
    )


def item_votes(text: Column, general: Column | None = None) -> Column:
    """favor, contra, abstencao, ausente, impedido (arrays of names), voto_qualidade_por and aviso of an item's text.

    general: the director-general by the minutes' opening, for votes that are told by office. A vote against removes one
    for, unless the text says that this vote was the approved one; an abstention removes both; a casting vote
    counts as one for; whoever is recused has no vote. Names must be strict for votes for and against. aviso:
    dissent is told, and no dissenter. A null text has none of it.
    """
    c, general = F.coalesce(text, F.lit("")), F.lit(None).cast("string") if general is None else general
    judged = F.transform(_events(c, general), lambda e: F.struct(e["kind"].alias("kind"), e["name"].alias("name"), (e["kind"].isin("favor", "contra") & X.strict_name(e["name"])).alias("strict")))
    authors, none = approved_authors(c, general), F.array().cast("array<string>")
    start = F.struct(*[none.alias(d) for d in DIRECTIONS], authors.alias("authors"))

    def step(s: Column, e: Column) -> Column:
        k, n = e["kind"], e["name"]
        long = F.length(n) > 4
        against = (k == "contra") & long & e["strict"] & ~F.array_contains(s["authors"], n)
        abstains = (k == "absteve-se") & long
        lost = against | abstains
        put = lambda a, cond: F.when(cond & ~F.array_contains(a, n), F.array_append(a, n)).otherwise(a)
        drop = lambda a, cond: F.when(cond, F.array_remove(a, n)).otherwise(a)
        return F.struct(
            put(drop(s["favor"], lost), long & (((k == "favor") & e["strict"]) | (k == "aderiu"))).alias("favor"), put(drop(s["contra"], abstains), against).alias("contra"),
            put(s["abstencao"], abstains | ((k == "abstencao") & long)).alias("abstencao"), put(s["ausente"], (k == "ausente") & long).alias("ausente"), s["authors"].alias("authors"),
        )

    def finish(s: Column, out: Column, cast: Column) -> Column:
        favor = F.when(cast.isNotNull() & ~F.array_contains(s["favor"], cast) & ~F.array_contains(s["contra"], cast), F.array_append(s["favor"], cast)).otherwise(s["favor"])
        clean = lambda a: F.filter(F.array_except(a, out), lambda x: ~X.role_only(x))
        # strict names are no offices
        contra = F.array_except(s["contra"], out)
        warn = (F.size(contra) == 0) & c.rlike(CONTESTED)
        rest = [clean(favor).alias("favor"), contra.alias("contra"), clean(s["abstencao"]).alias("abstencao"), clean(s["ausente"]).alias("ausente")]
        return F.struct(*rest, out.alias("impedido"), cast.alias("voto_qualidade_por"), warn.alias("aviso"))

    ends = F.struct(F.aggregate(judged, start, step).alias("s"), recused(c).alias("out"), casting(c, general).alias("cast"))
    return once(ends, lambda e: finish(e["s"], e["out"], e["cast"]))
