"""The fields of a decision document, by labels in its text and by what stands where labels lack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions import extract as X
from quorumlake.functions import item_votes as V
from quorumlake.functions import text as T

# Labels of fields and forms of headings.
NUMBER = r"(?iu)DELIBERA[ÇC][ÃA]O\s*(?:ARTESP\s*)?N[º°o]?\s*([\d.]+)"
PROCESS = r"(?iu)(?:SEI[!]?\s*n[ºo°]?|Processos?\s*(?:SEI\s*)?n[ºo°]?|PA\s*n[ºo°]?|Proc(?:esso)?\s*(?:Adm(?:inistrativo)?\s*)?n[ºo°]?|Procedimento\s*n[ºo°]?|Autos?\s*n[ºo°]?)\s*:?\s*([\d./\-]+)"
PARTIES = (
    "Interessad[ao]s?", "Requerente", "Empresa", "Solicitante", "Demandante", "Concession[aá]ri[ao]", "Permission[aá]ri[ao]", "Peticion[aá]rio", "Proponente", "Benefici[aá]ri[ao]", "Outorgad[ao]",
    "Postulante", "Requerida",
)
PARTY = rf"(?iu)(?:{'|'.join(PARTIES)})[:\s]+([^\n]{{3,200}})"
SUBJECTS = ("Assunto", "Ementa", "Tema", "Objeto")
ORIGIN = r"(?iu)Proced[eê]ncia[:\s]+([^\n]{3,150})"
CLAUSE = r"^(.{5,}?)(?:,\s*(?:que|a qual|cujo|cujos|cujas|por meio|através|representad)|;\s*|$)"
_WORD = "[A-ZÁÉÍÓÚÂÊÔÃÕÇÀÜ][A-Za-zÁÉÍÓÚÂÊÔÃÕÇÀÜáéíóúâêôãõçàü.'-]+"
REPORTER = rf"(?m)^\s*(?i:Relatora?)\s*:\s*(?i:Conselheir[oa]\s+|Diretora?(?:[- ]Geral)?\s+)?({_WORD}(?:\s+[A-Za-zÁÉÍÓÚÂÊÔÃÕÇÀÜáéíóúâêôãõçàü.'-]+){{1,6}})\s*$"
MEETING = (r"(?iu)(\d{1,3}(?:\.\d{3})+|\d{3,4})[ªa°º]?\s*Reuni[aã]o", r"(?iu)ATA\s+(\d+)[ªa°º]?\s*REUNI[AÃ]O")
KIND = r"(?iu)\b(Ordin[aá]ria|Extraordin[aá]ria)\b"
_LONG = r"(\d{1,2})\s+de\s+([a-záéíóúâêôãõçàü]+)\s+de\s+(\d{4})"
#: Where a date is looked for, in this order: the heading, after words that tell of a meeting, anywhere; written out before digits.
LONG_DATES = (r"(?iu)DELIBERA[ÇC][AÃ]O\s*(?:ARTESP\s*)?N[ºo°]?\s*[\d.]+[,\s]+" + _LONG.replace(r"(\d{1,2})", r"DE\s+(\d{1,2})", 1), r"(?iu)(?:Reuni[aã]o|realizada?\s+em|data\s+da\s+reuni[aã]o|São\s+Paulo,?)\s*[,:]?\s*" + _LONG, "(?iu)" + _LONG)
SHORT_DATES = (r"(?iu)(?:Reuni[aã]o|realizada?\s+em|São\s+Paulo)\s*[,:]?\s*(\d{2})/(\d{2})/(\d{4})", r"(\d{2})/(\d{2})/(\d{4})")
ATTESTED = r"(?s)Documento assinado eletronicamente.*?(?=A autenticidade|$)"
OFFICES = r"(?:Diretora?(?:[- ]Geral)?(?:\s*Substitut[oa])?|Conselheiroa?(?:-Presidente)?|Presidente)"
SIGNED = (rf"(?m)^\s*([A-ZÁÉÍÓÚÂÊÔÃÕÇÀÜ][A-Za-záéíóúâêôãõçàüÁÉÍÓÚÂÊÔÃÕÇÀÜ ]+?)\s*{V.DASH}\s*{OFFICES}", r"(?m)^([A-ZÁÉÍÓÚÂÊÔÃÕÇÀÜ]{2}[A-ZÁÉÍÓÚÂÊÔÃÕÇÀÜ ]+)\s*\n\s*(?:Diretora?(?:-Presidente)?|Conselheiro(?:-Presidente)?|Conselheira|Presidente)")
INTERNAL = ("pauta interna", "expediente interno", "assunto administrativo", "remuneração", "recursos humanos", "designação de empregado", "indicação para substituição", "cargo em comissão de comando", "empregado/servidor")
SUMMARY = (r"(?is)((?:Resumo|Objeto)[:\s]+.{20,600}?)(?=\n\n|\f|$)", r"(?is)((?:Trata-se|Cuida-se|Versa\s+o\s+presente|A\s+presente\s+delibera[çc][aã]o|O\s+presente\s+(?:caso|processo|requerimento|pedido)|A\s+empresa\s+requer|O\s+requerente\s+solicita|Refere-se\s+ao?\s+requerimento).{30,800}?)(?=\n\n|\f|$)")
# Votes that were given in an earlier session, and withdrawals with author and ground.
ON_RECORD = (
    rf"[Jj][áa]\s+havia\s+sido\s+proferido\s+o\s+voto\s+d[oa]\s+relator[^,]{{0,30}},\s*(?:[Dd]iretora?(?:[-\s]Geral)?\s+)?({V.NAME})", rf"ent[ãa]o\s+[Dd]iretora?(?:[-\s](?:Geral|Substitut[oa]))?\s+({V.NAME})",
    rf"[Aa]ntecip(?:a[çc][ãa]o|ou|ado)[^.]{{0,80}}?pel[oa]\s+[Dd]iretora?(?:[-\s]Geral)?\s+({V.NAME})",
)
WITHDRAWN = r"(?iu:\bretirad[oa]s?\s+(?:d[aeo]\s+)?(?:pauta|reuni[ãa]o|sess[ãa]o|julgamento|delibera[çc][ãa]o|ordem\s+do\s+dia)\b)"
WITHDRAWN_BY = WITHDRAWN + rf"[^.]{{0,140}}?\bpel[oa]\s+(?:[Dd]iretora?(?:[-\s](?:Geral|Substitut[oa]))?\s+|[Cc]onselheir[oa]\s+|[Rr]elatora?\s+)({V.NAME})"
GROUND = r"(?iu)\bart(?:igo)?\.?\s*(\d+)(?:\s*,?\s*[^.]{0,40}?)?\bd[oa]\s+Regimento\s+Interno"


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group first matches, trimmed; null if nothing."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group)), F.lit(""))


def subject(c: Column) -> Column:
    return F.coalesce(*[first(c, rf"(?iu){label}[:\s]+([^\n]{{3,300}})") for label in SUBJECTS])


def party(c: Column) -> Column:
    """Whom the case is about, up to the clause that says more of them."""
    whole = F.regexp_replace(first(c, PARTY), r"\s+", " ")
    return F.when(F.length(whole) > 5, F.coalesce(F.regexp_replace(first(whole, CLAUSE), r"[,;]\s*$", ""), whole)).otherwise(whole)


def day(c: Column) -> Column:
    """The day of a document's meeting, of the years 1990 to 2099."""
    months = F.array(*[F.lit(m) for m in T.MONTHS])

    def one(pattern: str, written: bool) -> Column:
        d, m, y = (first(c, pattern, k) for k in (1, 2, 3))
        month = F.array_position(months, F.lower(T.strip_accents(m))) if written else m.cast("int")
        return F.when(y.cast("int").between(1990, 2099), F.try_to_date(F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))

    return F.coalesce(*[one(p, True) for p in LONG_DATES], *[one(p, False) for p in SHORT_DATES])


def signers(c: Column) -> Column:
    """Who signed, by `Name - Office` and by names in capitals over an office; the electronic attestation aside."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), ATTESTED, "")
    found = F.concat(*[F.transform(F.regexp_extract_all(clean, F.lit(p), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))) for p in SIGNED])
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 4) & X.likely_name(x) & ~x.rlike(V.INSTITUTIONS)))


def on_record(c: Column) -> Column:
    """Whose votes a document only registers, as they were given in an earlier session."""
    flat = V.flattened(c)
    found = F.flatten(F.array(*[F.regexp_extract_all(flat, F.lit(p), F.lit(1)) for p in ON_RECORD]))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 4) & X.strict_name(x)))


def withdrawal(c: Column) -> Column:
    """(autor, fundamento) of a withdrawal; null where none is told."""
    flat = V.flattened(c)
    author = first(flat, WITHDRAWN_BY)
    ground = first(flat, GROUND)
    return F.when(flat.rlike(WITHDRAWN), F.struct(F.when(X.strict_name(author), author).alias("autor"), F.when(ground.isNotNull(), F.concat(F.lit("art. "), ground, F.lit(" do Regimento Interno"))).alias("fundamento")))


def fields(c: Column) -> dict[str, Column]:
    """The fields of a text by name; those that it lacks are null, and a null text lacks all."""
    who, what = party(c), subject(c)
    kind = F.lower(T.strip_accents(first(c, KIND)))
    low = F.lower(F.coalesce(c, F.lit("")))
    internal = who.isNull()
    for w in INTERNAL:
        internal = internal | low.contains(w)
    return {
        "numero_deliberacao": first(c, NUMBER), "numero_reuniao": F.coalesce(*[first(c, p) for p in MEETING]),
        "tipo_reuniao": F.when(kind.startswith("extraordin"), "Extraordinaria").when(kind.isNotNull(), "Ordinaria"), "data_reuniao": day(c), "processo": first(c, PROCESS), "interessado": who,
        "assunto": what, "procedencia": first(c, ORIGIN), "relator": first(c, REPORTER), "juizo": X.judgement(c), "unanimidade_detectada": X.unanimous(c), "pauta_interna": internal,
        "resumo_pleito": F.coalesce(*[F.substring(first(c, p), 1, 800) for p in SUMMARY], F.when(F.length(what) >= 15, what)), "signatarios": signers(c),
    }
