"""Text, name, number and date functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, in the same order.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
CONNECTIVES = ("de", "da", "do", "das", "dos", "e")
COMPANY_WORDS = "s\\s*/?\\s*a|sa|ltda|eireli|epp|mei|me|cia|companhia|concessionaria|holding|participacoes|empreendimentos"
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
CPF = r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"
EMAIL = r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}[-\s]?\d{4}\b"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c worked out once, however often use names it: Spark copies an expression to each place where it stands."""
    return F.transform(F.array(c), use)[0]


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normalize(c: Column) -> Column:
    """Lower case, no accents, other characters than letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.lower(strip_accents(c)), r"\s+")), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 1 if equal, 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return similarity(sorted_tokens(a), sorted_tokens(b))


def name_variants(c: Column) -> Column:
    """Shorter forms of a name of three tokens or more: first two, first and last, first three, first
    with each later one, and without what follows a connective."""
    t = F.split(F.trim(c), r"\s+")
    n, first = F.size(t), F.element_at(t, 1)
    small = F.array(*[F.lit(x) for x in CONNECTIVES])
    later = F.transform(F.filter(F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: ~F.array_contains(small, F.lower(x))), lambda x: F.concat_ws(" ", first, x))
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        link = F.array_contains(small, F.lower(x))
        return F.struct((~acc["skip"] & link).alias("skip"), F.when(acc["skip"] | link, acc["out"]).otherwise(F.array_append(acc["out"], x)).alias("out"))

    bare = F.aggregate(t, start, step)["out"]
    forms = F.concat(
        F.array(F.concat_ws(" ", F.slice(t, 1, 2)), F.concat_ws(" ", first, F.element_at(t, -1)), F.concat_ws(" ", F.slice(t, 1, 3))), later,
        F.when((F.size(bare) >= 2) & (F.size(bare) < n), F.array(F.concat_ws(" ", bare))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(n >= 3, F.array_distinct(F.filter(forms, lambda x: x != c))).otherwise(F.array().cast("array<string>"))


def company_key(c: Column) -> Column:
    """A company's name less accents, case, punctuation and company forms."""
    bare = F.regexp_replace(F.lower(strip_accents(c)), "[.,/\\\\()'\"]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"\b({COMPANY_WORDS})\b", " "), r"\s+", " "))


def name_tokens(c: Column) -> Column:
    """A name's tokens in lower case, without accents and connectives."""
    drop = F.array(*[F.lit(x) for x in CONNECTIVES])
    return F.filter(F.split(F.trim(F.lower(strip_accents(c))), r"\s+"), lambda x: (x != "") & ~F.array_contains(drop, x))


def strict_abbreviation(short: Column, long: Column) -> Column:
    """All tokens of the shorter name are in the longer one, with the same first, as a prefix or with the
    same last."""
    a, b = name_tokens(short), name_tokens(long)
    sized = (F.size(a) >= 2) & (F.size(b) >= 2) & (F.size(a) < F.size(b))
    held = (F.size(F.array_except(a, b)) == 0) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0)))
    return sized & held & ((F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(1))) == a) | (F.element_at(a, -1) == F.element_at(b, -1)))


def ordinal(c: Column) -> Column:
    """A meeting number as an integer; 1.024 is 1024."""
    return F.regexp_replace(c, r"[.\s]", "").try_cast("int")


def number_key(c: Column) -> Column:
    """Digits and letters in lower case, groups of digits less leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), r"0+(\d)", "$1")


def long_date(c: Column) -> Column:
    """The first `d de <month> de yyyy` of a text."""
    plain = F.lower(strip_accents(c))
    pattern = r"(\d{1,2})[oº°]?\s+de\s+(" + "|".join(MONTHS) + r")\s+de\s+(\d{4})"
    part = lambda k: F.regexp_extract(plain, pattern, k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(2))
    return F.try_to_date(F.when(part(1) != "", F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))), "yyyy-MM-dd")


def scrub(c: Column) -> Column:
    """CPF, e-mail and telephone numbers as placeholders, white space as single blanks."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), CPF, "[CPF removido]")
    out = F.regexp_replace(F.regexp_replace(out, EMAIL, "[e-mail removido]"), PHONE, "[telefone removido]")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def keyword_score(c: Column, phrases: tuple[str, ...]) -> Column:
    """Words of the phrases that a lower-case text contains."""
    out = F.lit(0)
    for p in phrases:
        out = out + F.when(c.contains(p), len(p.split())).otherwise(0)
    return out
