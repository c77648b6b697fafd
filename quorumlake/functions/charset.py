"""Names of files and texts whose characters were read in the wrong code page, put right by plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions.text import once

#: Code pages in the order in which ties are decided; the high half of each by its codec, undefined bytes as in Latin-1.
PAGES = ("latin-1", "cp1252", "cp850", "cp437")
_HIGH = "".join(map(chr, range(128, 256)))
# The characters that a name of a document is expected to have.
PLAUSIBLE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZáàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ0123456789 .,-_()[]{}'ºª#&+/°;!@=~"


def high_half(page: str) -> str:
    """The characters of the bytes from 128 on."""
    return "".join(bytes([b]).decode(page, "replace").replace("�", chr(b)) for b in range(128, 256))


def plausibility(c: Column) -> Column:
    """The share of expected characters; 0 for an empty name."""
    others = F.length(F.translate(c, PLAUSIBLE, ""))
    return F.when(F.length(c) == 0, 0.0).otherwise((F.length(c) - others).cast("double") / F.length(c))


def as_page(raw: Column, page: str) -> Column:
    """Bytes read in a code page."""
    latin = F.decode(raw, "ISO-8859-1")
    return latin if page == "latin-1" else F.translate(latin, _HIGH, high_half(page))


def to_page(c: Column, page: str) -> Column:
    """The bytes of a text in a code page."""
    return F.encode(c if page == "latin-1" else F.translate(c, high_half(page), _HIGH), "ISO-8859-1")


def reread(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other texts stay. Only texts of bytes that are UTF-8 beyond ASCII count."""
    raw = F.encode(F.when(c.rlike("[\u0080-ÿ]") & ~c.rlike("[^\u0000-ÿ]"), c), "ISO-8859-1")
    return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")), c)


def unescaped(raw: Column) -> Column:
    """Bytes with percent escapes resolved. Escapes are bytes too, so they are found in the Latin-1 reading."""
    runs = lambda latin: F.regexp_extract_all(latin, F.lit("(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    as_hex = lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}"), F.replace(x, F.lit("%"), F.lit(""))).otherwise(F.hex(F.encode(x, "ISO-8859-1")))
    resolved = lambda latin: F.unhex(F.array_join(F.transform(runs(latin), as_hex), ""))
    return once(F.decode(raw, "ISO-8859-1"), lambda latin: F.when(latin.rlike("%[0-9A-Fa-f]{2}"), resolved(latin)).otherwise(raw))


def decoded(raw: Column) -> Column:
    """(nome, codificacao, nota) of the bytes of a name.

    Percent escapes are resolved first. Bytes that are UTF-8 are UTF-8; encoded twice, they are read once more
    if that is no less plausible. Of the other pages the most plausible one wins, ties in their order. Null gives null.
    """
    result = lambda nome, page, nota: F.struct(nome.alias("nome"), page.alias("codificacao"), nota.alias("nota"))

    def in_utf8(text: Column) -> Column:
        # as plausible in fewer characters is better
        better = lambda p: (p["twice"] != text) & (p["b"] >= p["a"])
        both = lambda t: F.struct(t.alias("twice"), plausibility(text).alias("a"), plausibility(t).alias("b"))
        judged = lambda p: result(F.when(better(p), p["twice"]).otherwise(text), F.when(better(p), "utf-8 duas vezes").otherwise("utf-8"), F.greatest(p["a"], p["b"]))
        again = once(once(reread(text), both), judged)
        return F.when(text.rlike("[\u0080-ÿ]"), again).otherwise(result(text, F.lit("utf-8"), plausibility(text)))

    def in_page(plain: Column) -> Column:
        names = F.array(*[F.struct(F.lit(-k).alias("k"), as_page(plain, p).alias("nome"), F.lit(p).alias("codificacao")) for k, p in enumerate(PAGES)])
        rated = F.transform(names, lambda x: F.struct(plausibility(x["nome"]).alias("nota"), x["k"].alias("k"), x["nome"].alias("nome"), x["codificacao"].alias("codificacao")))
        return once(F.array_max(rated), lambda x: result(x["nome"], x["codificacao"], x["nota"]))

    read = lambda plain: once(plain.cast("string"), lambda text: F.when(F.is_valid_utf8(text), in_utf8(text)).otherwise(in_page(plain)))
    return once(raw, lambda r: F.when(r.isNotNull(), once(unescaped(r), read)))
