"""The star schema of collegiate decisions, over the driver's tables.

`Star` is what operators take: lazy DataFrames of agencies, directors, terms of office, companies,
decisions and votes. `from_tables` derives them from the TPC-H-like tables by column expressions alone,
so that projections and filters of an operator reach the Parquet scans. `stored` writes a fact when it is first
asked for, in buckets by decision, for all queries that follow: votes meet their decisions without a shuffle
and lines are grouped to votes once. `SQL` states the same tables for the oracle.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that "today" means in reports over these tables.
TODAY = "1998-08-02"


@dataclass
class Star:
    spark: SparkSession
    sf_dir: str
    agencias: DataFrame
    diretores: DataFrame
    mandatos: DataFrame
    empresas: DataFrame
    deliberacoes: DataFrame
    votos: DataFrame

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def day(self):
        return F.to_date(F.lit(TODAY))


def from_tables(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> Star:
    """The star over the tables of a folder; with buckets, facts come dealt by decision into so many parts."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda x: x.cast("string")
    null = F.lit(None)

    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    agencias = n.select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("sigla"), F.col("r_name").alias("esfera"), (F.col("n_nationkey") % 10 != 9).alias("ativo")
    )

    s = F.col("s_suppkey")
    diretores = t("supplier").select(
        s.alias("id"), F.col("s_name").alias("nome"), F.col("s_nationkey").cast("long").alias("agencia_id"),
        F.when(s % 17 == 0, "rejeitado").when(s % 5 == 0, "pendente").otherwise("aprovado").alias("review_status"),
    )
    start = F.date_add(F.to_date(F.lit("1992-01-01")), (s * 37 % 1500).cast("int"))
    mandatos = t("supplier").select(
        s.alias("diretor_id"), F.col("s_nationkey").cast("long").alias("agencia_id"), start.alias("data_inicio"),
        F.when(s % 4 != 0, F.date_add(start, (900 + s % 700).cast("int"))).alias("data_fim"),
        F.when(s % 9 == 0, F.date_add(start, 200)).alias("afastado_desde"), F.when(s % 9 == 0, F.date_add(start, 400)).alias("afastado_ate"),
        F.when(s % 6 == 0, "automatico").otherwise("oficial").alias("fonte_dado"),
    )

    c = t("customer")
    empresas = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), F.col("c_nationkey").cast("long").alias("agencia_id"))

    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    deliberacoes = o.select(
        k.alias("id"), F.col("c_nationkey").cast("long").alias("agencia_id"), F.col("c_custkey").alias("empresa_id"), F.col("c_name").alias("interessado"),
        F.when(k % 19 == 0, "pauta").when(k % 23 == 0, "voto_individual").when(k % 5 == 0, "ata").when(k % 29 == 0, "portaria").otherwise("deliberacao").alias("tipo_documento"),
        F.when(k % 10 == 0, k - 5).alias("documento_pai_id"),
        F.when(k % 31 != 0, F.to_date("o_orderdate")).alias("data_reuniao"),
        F.when(k % 3 != 0, F.date_add(F.to_date("o_orderdate"), (k % 20).cast("int"))).alias("data_publicacao"),
        F.when(k % 37 != 0, text(k % 40 + 1)).alias("numero_reuniao"),
        F.when(k % 4 == 0, "extraordinaria").when(k % 4 != 1, "ordinaria").alias("serie"),
        F.when(k % 6 != 0, text(k % 900)).alias("numero_deliberacao"),
        F.when(k % 8 != 0, F.concat(F.lit("P"), text(k % 2000))).alias("processo"),
        F.concat(F.when(k % 2 == 0, "Diretor ").otherwise(""), F.lit("Supplier#"), F.lpad(text(k % 97 + 1), 9, "0")).alias("relator"),
        F.when(k % 41 != 0, F.col("o_orderpriority")).alias("microtema"), F.col("c_mktsegment").alias("area_regulatoria"),
        F.when(k % 7 == 0, null).when((status == "O") & (k % 3 == 0), "Aprovado por Unanimidade").when(status == "O", "Deferido")
        .when(status == "F", "Indeferido").otherwise("Retirado de Pauta").alias("resultado"),
        F.when(k % 17 == 0, "admissibilidade").when(k % 2 == 0, "merito").alias("juizo"),
        F.when(k % 43 != 0, (k % 101).cast("double") / 100).alias("extraction_confidence"),
        (k % 2 == 0).alias("auto_classified"), (k % 12 == 0).alias("pauta_interna"),
        F.when(k % 47 == 0, False).when(k % 3 == 0, True).alias("import_counts_as_final"), (k % 4 == 0).alias("unanimidade_detectada"),
    )

    # a director votes once on a decision: the first line
    lines = t("lineitem")
    if buckets:
        deliberacoes, lines = deliberacoes.repartition(buckets, "id"), lines.repartition(buckets, "l_orderkey")
    first = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min(F.struct("l_linenumber", "l_returnflag", "l_linestatus")).alias("v"))
    d, p, flag = F.col("l_orderkey"), F.col("l_suppkey"), F.col("v.l_returnflag")
    tipo = F.when(flag == "A", "Desfavoravel").when(flag == "N", "Favoravel").when(F.col("v.l_linenumber") % 2 == 0, "Abstencao").otherwise("Ausente")
    votos = first.select(
        d.alias("deliberacao_id"), p.alias("diretor_id"), tipo.alias("tipo_voto"), (F.col("v.l_linestatus") == "O").alias("is_nominal"),
        F.when((d + p) % 5 == 0, null).when(F.col("v.l_linestatus") == "O", "nominal").otherwise("inferido_decisao").alias("proveniencia"),
        F.when((tipo == "Ausente") & (p % 3 == 0), "impedimento").when(tipo == "Ausente", "ausencia").alias("motivo_nao_voto"),
        ((tipo == "Abstencao") | ((tipo == "Desfavoravel") & ((d + p) % 3 == 0))).alias("is_divergente"),
    )
    return Star(spark, sf_dir, agencias, diretores, mandatos, empresas, deliberacoes, votos)


#: Bytes of source files to a bucket, about, and the least and the greatest number of buckets; beyond that, buckets grow.
BUCKET_BYTES, BUCKETS, MOST_BUCKETS = 128 << 20, 8, 50_000
_LOCAL: list[str] = []


def _base(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/quorumlake"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quorumlake-"))
    return f"{_LOCAL[0]}/quorumlake"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, among those of this application."""
    return f"{_base(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _stamp(spark: SparkSession, paths: list[str]) -> tuple[str, int]:
    """A hash of the names, sizes and times of the files below paths, and their bytes."""
    seen, total = [], 0
    for name in paths:
        path, fs = _path(spark, name)
        found = fs.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
            total += f.getLen()
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16], total


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


_ONE_AT_A_TIME = threading.Lock()
_BUCKETED = {"deliberacoes": "id", "votos": "deliberacao_id"}


class StoredStar(Star):
    """A star whose facts are bucketed tables, each written when it is first asked for.

    A table is known by the names, sizes and times of the files that it is made of, so that changed files make
    a new one, and applications with the same shared folder use the same one. A table whose files are gone is written again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        lazy = from_tables(spark, sf_dir)
        self._made: dict[str, DataFrame] = {}
        super().__init__(**{f.name: getattr(lazy, f.name) for f in fields(Star) if f.name not in _BUCKETED}, deliberacoes=None, votos=None)

    def __getattribute__(self, name: str):
        if name not in _BUCKETED:
            return super().__getattribute__(name)
        made = self._made
        if name not in made:
            made[name] = _table(self.spark, self.sf_dir, name)
        return made[name]


def _table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    key, size = _stamp(spark, [f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "lineitem")])
    most = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    buckets = min(most, max(BUCKETS, -(-size // BUCKET_BYTES)))
    by, path = _BUCKETED[kind], f"{_base(spark)}/star/{key}-{buckets}/{kind}"
    name = f"quorumlake_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{kind}"
    with _ONE_AT_A_TIME:
        if not _exists(spark, f"{path}/_SUCCESS"):
            rows = getattr(from_tables(spark, sf_dir, buckets), kind)
            draft = f"{path}-{uuid.uuid4().hex}"
            spark.sql(f"drop table if exists {name}_draft")
            rows.write.bucketBy(buckets, by).sortBy(by).option("path", draft).saveAsTable(f"{name}_draft")
            spark.sql(f"drop table {name}_draft")
            # whoever is first gives the files their name; a later draft isn't needed
            (old, fs), (new, _) = _path(spark, draft), _path(spark, path)
            if not fs.exists(new):
                fs.rename(old, new)
            fs.delete(old, True)
            spark.sql(f"drop table if exists {name}")
        if not spark.catalog.tableExists(name):
            schema = getattr(from_tables(spark, sf_dir), kind).schema
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
            spark.sql(f"create table {name} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def stored(spark: SparkSession, sf_dir: str) -> Star:
    """The star with decisions and votes as bucketed tables; nothing is written before a query asks for them."""
    return StoredStar(spark, sf_dir)


def clear(spark: SparkSession, stars: bool = False) -> None:
    """Deletes what this application wrote to the shared folder; with stars, also the stored facts of all
    applications and their tables in this session's catalog. Results still to be read must be saved before."""
    for folder in (spark.sparkContext.applicationId, *(["star"] if stars else [])):
        p, fs = _path(spark, f"{_base(spark)}/{folder}")
        fs.delete(p, True)
    if stars:
        for t in spark.catalog.listTables(pattern="quorumlake_*"):
            spark.sql(f"drop table if exists {t.name}")


SQL = """
with agencias as (
  select cast(n_nationkey as bigint) id, n_name sigla, r_name esfera, n_nationkey % 10 <> 9 ativo from nation left join region on n_regionkey = r_regionkey),
diretores as (
  select s_suppkey id, s_name nome, cast(s_nationkey as bigint) agencia_id,
    case when s_suppkey % 17 = 0 then 'rejeitado' when s_suppkey % 5 = 0 then 'pendente' else 'aprovado' end review_status from supplier),
mandatos as (
  select diretor_id, agencia_id, i data_inicio, case when diretor_id % 4 <> 0 then i + cast(900 + diretor_id % 700 as int) end data_fim,
    case when diretor_id % 9 = 0 then i + 200 end afastado_desde, case when diretor_id % 9 = 0 then i + 400 end afastado_ate,
    case when diretor_id % 6 = 0 then 'automatico' else 'oficial' end fonte_dado
  from (select s_suppkey diretor_id, cast(s_nationkey as bigint) agencia_id, date '1992-01-01' + cast(s_suppkey * 37 % 1500 as int) i from supplier)),
empresas as (select c_custkey id, c_name nome, cast(c_nationkey as bigint) agencia_id from customer),
deliberacoes as (
  select k id, cast(c_nationkey as bigint) agencia_id, c_custkey empresa_id, c_name interessado,
    case when k % 19 = 0 then 'pauta' when k % 23 = 0 then 'voto_individual' when k % 5 = 0 then 'ata' when k % 29 = 0 then 'portaria' else 'deliberacao' end tipo_documento,
    case when k % 10 = 0 then k - 5 end documento_pai_id,
    case when k % 31 <> 0 then cast(o_orderdate as date) end data_reuniao,
    case when k % 3 <> 0 then cast(o_orderdate as date) + cast(k % 20 as int) end data_publicacao,
    case when k % 37 <> 0 then cast(k % 40 + 1 as varchar) end numero_reuniao,
    case when k % 4 = 0 then 'extraordinaria' when k % 4 <> 1 then 'ordinaria' end serie,
    case when k % 6 <> 0 then cast(k % 900 as varchar) end numero_deliberacao,
    case when k % 8 <> 0 then 'P' || cast(k % 2000 as varchar) end processo,
    case when k % 2 = 0 then 'Diretor ' else '' end || 'Supplier#' || lpad(cast(k % 97 + 1 as varchar), 9, '0') relator,
    case when k % 41 <> 0 then o_orderpriority end microtema, c_mktsegment area_regulatoria,
    case when k % 7 = 0 then null when o_orderstatus = 'O' and k % 3 = 0 then 'Aprovado por Unanimidade' when o_orderstatus = 'O' then 'Deferido'
      when o_orderstatus = 'F' then 'Indeferido' else 'Retirado de Pauta' end resultado,
    case when k % 17 = 0 then 'admissibilidade' when k % 2 = 0 then 'merito' end juizo,
    case when k % 43 <> 0 then cast(k % 101 as double) / 100 end extraction_confidence,
    k % 2 = 0 auto_classified, k % 12 = 0 pauta_interna, case when k % 47 = 0 then false when k % 3 = 0 then true end import_counts_as_final,
    k % 4 = 0 unanimidade_detectada
  from (select o_orderkey k, * from orders) join customer on o_custkey = c_custkey),
votos as (
  select d deliberacao_id, p diretor_id, tipo_voto, st = 'O' is_nominal,
    case when (d + p) % 5 = 0 then null when st = 'O' then 'nominal' else 'inferido_decisao' end proveniencia,
    case when tipo_voto = 'Ausente' and p % 3 = 0 then 'impedimento' when tipo_voto = 'Ausente' then 'ausencia' end motivo_nao_voto,
    tipo_voto = 'Abstencao' or (tipo_voto = 'Desfavoravel' and (d + p) % 3 = 0) is_divergente
  from (select l_orderkey d, l_suppkey p, l_linestatus st,
      case l_returnflag when 'A' then 'Desfavoravel' when 'N' then 'Favoravel' else case when l_linenumber % 2 = 0 then 'Abstencao' else 'Ausente' end end tipo_voto
    from lineitem qualify row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber, l_returnflag, l_linestatus) = 1)),
final as (
  select *, coalesce(import_counts_as_final, true) and tipo_documento not in ('pauta', 'voto_individual', 'documento_apoio')
      and case when tipo_documento = 'ata' then documento_pai_id is not null and coalesce(resultado, '') <> '' else tipo_documento in ('deliberacao', 'resolucao', 'portaria') end is_final,
    case when juizo = 'admissibilidade' then 'admissibilidade' when coalesce(resultado, '') = '' then 'sem_resultado' when resultado = 'Retirado de Pauta' then 'retirado' else 'decidido' end estado,
    coalesce(resultado in ('Aprovado', 'Aprovado com Ressalvas', 'Aprovado por Unanimidade', 'Deferido', 'Ratificado', 'Autorizado', 'Recomendado', 'Determinado'), false) positivo
  from deliberacoes),
f as (select * from final where is_final),
v as (select *, case when proveniencia is null then coalesce(is_nominal, false) else proveniencia in ('nominal', 'revisao_humana') end nominal from votos)
"""
