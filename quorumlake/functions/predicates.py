"""Shared predicates of decisions and votes, as Column expressions.

Each takes column names of the decision (`deliberacoes`) or vote (`votos`) table as they are, so that
filters on them reach the scan and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
NON_FINAL_TYPES = ("pauta", "voto_individual", "documento_apoio")
NO_DECISION_SUBTYPES = ("pauta", "voto_individual")
FINAL_TYPES = ("deliberacao", "resolucao", "portaria")
POSITIVE_RESULTS = (
    "Aprovado", "Aprovado com Ressalvas", "Aprovado por Unanimidade", "Deferido", "Ratificado", "Autorizado", "Recomendado", "Determinado",
)
WITHDRAWN, DENIED = "Retirado de Pauta", "Indeferido"
NOMINAL_ORIGINS = ("nominal", "revisao_humana")
MATCH, REVIEW, MARGIN = 0.85, 0.60, 0.15


def empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def is_final(
    tipo="tipo_documento", pai="documento_pai_id", resultado="resultado", conta="import_counts_as_final", subtipo: str | None = None
) -> Column:
    """S1: a row that counts as a final decision; never null."""
    kind = F.coalesce(F.col(tipo), F.lit(""))
    sub = F.coalesce(F.col(subtipo), F.lit("")) if subtipo else F.lit("")
    stays = F.coalesce(F.col(conta), F.lit(True)) & ~kind.isin(*NON_FINAL_TYPES) & ~sub.isin(*NO_DECISION_SUBTYPES)
    item = F.col(pai).isNotNull() & ~empty(F.col(resultado))
    return stays & F.when(kind == "ata", item).otherwise(kind.isin(*FINAL_TYPES))


def discard_reason(tipo="tipo_documento", pai="documento_pai_id", resultado="resultado", conta="import_counts_as_final") -> Column:
    """Why a row is no final decision; null if it is one."""
    kind = F.coalesce(F.col(tipo), F.lit(""))
    return F.when(
        ~is_final(tipo, pai, resultado, conta),
        F.when(kind.isin(*NON_FINAL_TYPES), "tipo_nao_final")
        .when((kind == "ata") & F.col(pai).isNull(), "ata_envelope")
        .when((kind == "ata") & empty(F.col(resultado)), "sem_resultado_extraido")
        .otherwise("outro"),
    )


def status(juizo="juizo", resultado="resultado") -> Column:
    """S2: admissibilidade, sem_resultado, retirado or decidido; the first that holds."""
    r = F.col(resultado)
    return (
        F.when(F.col(juizo) == "admissibilidade", "admissibilidade").when(empty(r), "sem_resultado").when(r == WITHDRAWN, "retirado").otherwise("decidido")
    )


def on_merits(juizo="juizo", resultado="resultado") -> Column:
    return status(juizo, resultado) == "decidido"


def is_positive(resultado="resultado") -> Column:
    return F.coalesce(F.col(resultado).isin(*POSITIVE_RESULTS), F.lit(False))


def is_denied(resultado="resultado") -> Column:
    return F.coalesce(F.col(resultado) == DENIED, F.lit(False))


def is_sanction(microtema="microtema", resultado="resultado", theme: str = "multa") -> Column:
    return F.coalesce(F.col(microtema) == theme, F.lit(False)) | is_denied(resultado)


def is_nominal(proveniencia="proveniencia", nominal="is_nominal") -> Column:
    """S4: by origin; where that is unknown, by the flag."""
    p = F.col(proveniencia)
    return F.when(p.isNull(), F.coalesce(F.col(nominal), F.lit(False))).otherwise(p.isin(*NOMINAL_ORIGINS))


def is_effective(tipo="tipo_voto") -> Column:
    """S5: a vote for or against."""
    return F.coalesce(F.col(tipo).isin("Favoravel", "Desfavoravel"), F.lit(False))


def is_direction(tipo="tipo_voto") -> Column:
    return ~empty(F.col(tipo)) & (F.col(tipo) != "Ausente")


def inferred_vote(resultado="resultado") -> Column:
    """The vote that following the decision means; null if nothing was decided."""
    r = F.col(resultado)
    return F.when(empty(r) | (r == WITHDRAWN), F.lit(None)).when(r == DENIED, "Desfavoravel").otherwise("Favoravel")


def is_divergent(tipo="tipo_voto", resultado="resultado", unanime: Column | None = None) -> Column:
    t, own = F.col(tipo), inferred_vote(resultado)
    rule = (
        F.when(t == "Ausente", False)
        .when(t == "Abstencao", True)
        .when(own.isNull(), t == "Desfavoravel")
        .when(own == "Favoravel", t == "Desfavoravel")
        .otherwise(t == "Favoravel")
    )
    return rule if unanime is None else F.when(unanime, False).otherwise(rule)


def consensus(votes: Column, divergent: Column, tipo: Column) -> Column:
    """S3 over grouped votes: null without a vote that is no absence, else whether none diverges."""
    effective = F.count_if(votes.isNotNull() & (F.coalesce(tipo, F.lit("")) != "Ausente"))
    any_apart = F.coalesce(F.bool_or(F.coalesce(divergent, F.lit(False)) & (F.coalesce(tipo, F.lit("")) != "Ausente")), F.lit(False))
    return F.when(effective == 0, F.lit(None)).otherwise(~any_apart)


def in_year(year: int, first="data_reuniao", second="data_publicacao") -> Column:
    """By meeting date, else publication date; undated rows stay."""
    d = F.coalesce(F.col(first), F.col(second))
    return d.isNull() | (F.year(d) == year)


def rate(part: Column, whole: Column) -> Column:
    """Percent as a double, null for an empty base."""
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def mean(c: Column) -> Column:
    """An average that doesn't depend on the order of rows: exact decimals, then one division."""
    return F.try_divide(F.sum(c.cast("decimal(18,4)")).cast("double"), F.count(c).cast("double"))


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), "sem").when(c >= MATCH, "alta").when(c >= REVIEW, "media").otherwise("baixa")
