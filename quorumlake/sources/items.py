"""Splitting the minutes of a meeting into items: a tokenizer of lines and a walk over them, as a table
function.

A line is read as a number, a label and a value, each of which may lack. Numbers open items, labels name
fields, headings close what is open.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

# The words that label fields, and of those the ones that may follow an item's number.
LABELS = {
    "processo": "processo", "processos": "processo", "interessado": "interessado", "interessada": "interessado", "interessados": "interessado", "interessadas": "interessado", "assunto": "assunto",
    "relator": "relator", "relatora": "relator", "decisao": "decisao", "deliberacao": "decisao",
}
OPENING = ("processo", "interessado", "assunto", "relator")
# How headings between items begin.
HEADINGS = (("materia",), ("materias",), ("aprovacao", "da", "ata"), ("aprovacao", "da", "atas"), ("aprovacao", "de", "ata"), ("aprovacao", "de", "atas"), ("encerramento",))
OFFICES = ("diretor", "diretora")
FIELDS = ("processo", "interessado", "assunto", "relator", "decisao")
COLUMNS = ("item_numero", *FIELDS, "resultado", "raw_text")
_WORD = re.compile(r"\w+")


class Line(NamedTuple):
    """number is that of an item, levels its depth (0: roman), label the field that follows at once."""

    number: str | None
    levels: int
    label: str | None
    rest: str


def plain(text: str) -> str:
    """Lower case without accents, character for character."""
    return "".join(unicodedata.normalize("NFD", c)[0] for c in text).lower()


def words(text: str, most: int) -> list[str]:
    out = []
    for m in _WORD.finditer(plain(text)):
        out.append(m[0])
        if len(out) == most:
            break
    return out


def label_of(text: str) -> str | None:
    """The field whose label text starts with, dashes and stops before it aside."""
    first = words(text.lstrip(" \t-–—:."), 1)
    bare = plain(text.lstrip(" \t-–—:."))
    return LABELS.get(first[0]) if first and bare.startswith(first[0]) else None


def read(line: str) -> Line:
    """The parts of a line."""
    head = line.split(maxsplit=1)[0] if line.strip() else ""
    digits = head[: next((k for k, c in enumerate(head) if not (c.isdigit() or c == ".")), len(head))]
    parts = digits.rstrip(".").split(".")
    if 2 <= len(parts) <= 3 and all(parts):
        number = ".".join(parts)
        rest = line[len(number) :].lstrip(" \t")
        return Line(number, len(parts), label_of(rest[1:] if rest[:1] in (".", ")") else rest), rest.lstrip(".) \t"))
    size = next((k for k, c in enumerate(line) if c.upper() not in "IVXLC"), len(line))
    rest = line[size:].lstrip()
    if size and rest[:1] in ("-", "–", "."):
        return Line(line[:size], 0, label_of(rest[1:]), rest[1:].strip())
    return Line(None, 0, None, line)


def heading(line: str) -> bool:
    """Whether a line is one of HEADINGS, or a number of one level before an office."""
    first = words(line, 3)
    if not first or not plain(line).startswith(first[0]):
        return False
    if any(tuple(first[: len(h)]) == h for h in HEADINGS):
        return True
    return len(first) > 1 and first[0].isdigit() and line[len(first[0]) : len(first[0]) + 1] == "." and first[1] in OFFICES


def value_after(rest: str, field: str) -> str | None:
    """What a label gives its field: for a process the number that follows, else what follows a colon."""
    rest = rest.strip()
    if field != "processo":
        return rest[1:].strip() or None if rest.startswith(":") else None
    if rest[:1] in ("n", "N") and rest[1:2] in ("º", "o", "°"):
        rest = rest[2:].strip()
    rest = rest.removeprefix(":").strip()
    size = next((k for k, c in enumerate(rest) if not (c.isdigit() or c in "./-")), len(rest))
    return rest[:size] if size > 1 and rest[0].isdigit() else None


def fields_of(body: list[str]) -> dict[str, str | None]:
    """The first value of each field among the lines."""
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    for line in body:
        for m in _WORD.finditer(plain(line)):
            field = LABELS.get(m[0])
            if field and out[field] is None and (value := value_after(line[m.end() :], field)):
                out[field] = value.rstrip(";,.") or None
    return out


def result_of(text: str) -> str | None:
    """The result that a decision's words state; suspension first, then denial, then approval."""
    low = plain(text)
    said = lambda *roots: any(r in low for r in roots)
    unanimous = "unanimidade" in low and not said("nao houve unanimidade", "nao por unanimidade")
    if said("retirado de pauta", "retirada de pauta", "sobrestado", "sobrestada", "pedido de vista"):
        return "Retirado de Pauta"
    if said("indeferid", "indeferir", "negar provimento", "nao provid"):
        return "Indeferido"
    if said("deferid", "deferir", "dar provimento"):
        return "Deferido"
    if said("aprovado", "aprovada", "aprovar") or unanimous:
        return "Aprovado por Unanimidade" if unanimous else "Aprovado"
    return None


def blocks(text: str | None) -> Iterator[tuple[str, int, list[str]]]:
    """(number, levels, lines) of what may be an item; lines before the first or after a heading are none's."""
    lines = [x.strip() for x in (text or "").split("\n")]
    open_block = None
    for line, following in zip(lines, [*lines[1:], ""]):
        if heading(line):
            if open_block:
                yield open_block
            open_block = None
            continue
        own = read(line)
        label = own.label or (label_of(following) if own.levels and not own.rest else None)
        if own.number and label in OPENING:
            if open_block:
                yield open_block
            open_block = (own.number, own.levels, [line])
        elif open_block:
            open_block[2].append(line)
    if open_block:
        yield open_block


def split_items(text: str | None) -> list[dict]:
    """Items in order, without doubles: number and process again keep the one with a decision, then the
    longer text. Items with no field are dropped; a numbered child takes what its parent states."""
    parents: dict[str, dict] = {}
    best: dict[tuple, dict] = {}
    for number, levels, body in blocks(text):
        item = fields_of(body)
        if not any(item[f] for f in FIELDS if f != "relator"):
            continue
        if levels == 2 and item["assunto"] and not item["processo"]:
            parents[number] = item
            continue
        above = parents.get(number.rpartition(".")[0]) if levels == 3 else None
        for f in ("assunto", "decisao"):
            item[f] = item[f] or (above and above[f])
        whole = "\n".join(body).strip()
        item |= {"item_numero": number, "raw_text": whole, "resultado": result_of(item["decisao"] or whole)}
        held = best.setdefault((number, item["processo"]), item)
        if (bool(held["decisao"]), len(held["raw_text"])) < (bool(item["decisao"]), len(whole)):
            best[number, item["processo"]] = item
    return list(best.values())


def items(minutes: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """A row per item of each document; lines have an order, so a document is one unit of work."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"file": f} | item for f, t in zip(b["file"], b["text"]) for item in split_items(t)]
            yield pd.DataFrame(rows, columns=["file", *COLUMNS])

    return minutes.select(F.col(key).cast("string").alias("file"), F.col(text).alias("text")).mapInPandas(run, "file string, " + ", ".join(f"{c} string" for c in COLUMNS))
