"""Sources and streams as queries: a stream run to its end, listings through an HTML parser, minutes split
into items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.plans.registry import query
from quorumlake.plans.star import Star, shared_folder
from quorumlake.sources import files, items
from quorumlake.streaming import ingest, queue


@query("fluxo_de_itens", "select cast(user_id as varchar) site, props hash, min(ts) first_seen_at, max(ts) last_seen_at from events group by 1, 2", tables=False)
def streamed_items(s: Star) -> DataFrame:
    """#157, #163, #174: the events as a file stream, merged batch by batch until none is left."""
    folder = shared_folder(s.spark, "flow")
    schema = s.table("events").schema
    # a stream's source is a folder or a pattern; this one matches the table alone
    stream = s.spark.readStream.schema(schema).parquet(f"{s.sf_dir}/events.parque[t]")
    rows = stream.select(F.col("user_id").cast("string").alias("site"), F.col("props").alias("hash"), "ts")
    store = ingest.ItemStore(s.spark, f"{folder}/items")
    ingest.run_ingest(rows, store, f"{folder}/checkpoint").awaitTermination()
    return store.read()


_STATUS = "case event_type when 'purchase' then 'confirmed' when 'error' then 'failed' when 'click' then 'processing' else 'queued' end"


@query(
    "fila_em_fluxo",
    f"""with l as (select user_id, {_STATUS} status, epoch_us(ts) us from events), e as (select max(us) // 1000 agora from l),
        m as (select user_id, max(struct_pack(us := us, status := status)) m, count(*) filter (status = 'processing') ciclos from l group by 1)
        select user_id job_id, m.status status, ciclos, case when m.status = 'processing' and (m.us + 30 * 60000000) // 1000 + 1 <= agora then case when ciclos >= 3 then 'failed' else 'pending' end else m.status end desfecho from m, e""",
    tables=False,
)
def streamed_queue(s: Star) -> DataFrame:
    """#158: the events as entries of their user's job, as a stream with state whose timers give back what is stuck."""
    folder, schema = shared_folder(s.spark, "queue"), s.table("events").schema
    stream = s.spark.readStream.schema(schema).parquet(f"{s.sf_dir}/events.parque[t]")
    log = stream.select(F.col("user_id").alias("job_id"), F.expr(_STATUS).alias("status"), "ts")
    held = s.spark.conf.get(queue.PROVIDER[0])
    s.spark.conf.set(*queue.PROVIDER)
    try:
        put = lambda rows, k: rows.withColumn("k", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/out/batch={k}")
        out = queue.fates(log).writeStream.outputMode("update").foreachBatch(put)
        out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.spark.conf.set(queue.PROVIDER[0], held)
    rows = s.spark.read.parquet(f"{folder}/out")
    # a fate that a timer brings comes with a later batch than the entry, or with its own
    last = rows.groupBy("job_id").agg(F.max(F.struct("k", F.col("desfecho") != F.col("status"), "status", "ciclos", "desfecho")).alias("m"))
    return last.select("job_id", "m.status", "m.ciclos", "m.desfecho")


@query("listagem_de_paginas", "select url, len(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"')) links from pages where html like '%<a href%'", tables=False)
def listed_links(s: Star) -> DataFrame:
    """#12: links per page, by a parser rather than a pattern."""
    links = files.listing(s.table("pages").select(F.col("page_id").cast("string").alias("url"), "html")).groupBy("url").agg(F.count("*").alias("links"))
    pages = s.table("pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("address"))
    return links.join(pages, links["url"] == pages["id"]).select(F.col("address").alias("url"), "links")


@query(
    "itens_das_atas",
    """select agencia_id || '-' || numero_reuniao file, '50500.' || id || '/1996' processo, interessado, case when resultado is null then null else resultado end resultado
       from deliberacoes where tipo_documento = 'ata' and numero_reuniao is not null""",
)
def minutes_items(s: Star) -> DataFrame:
    """#136 and the splitter: minutes are put together from decisions and split into items again.

    Items are numbered in two ways; some come a second time without their decision, some follow a heading
    and a line that is in no item, and every file ends with one.
    """
    k = F.col("id").cast("string")
    words = F.coalesce(F.lower("resultado"), F.lit("em debate"))
    head = F.concat(F.lit("Processo nº 50500."), k, F.lit("/1996\nInteressado: "), F.col("interessado"))
    rows = s.deliberacoes.where("tipo_documento = 'ata' and numero_reuniao is not null")
    lines = F.struct(head.alias("h"), F.concat(F.lit("\nDecisão: "), words, F.lit(".\n")).alias("d"))
    minutes = rows.groupBy(F.concat_ws("-", F.col("agencia_id").cast("string"), "numero_reuniao").alias("file")).agg(F.array_sort(F.collect_list(F.struct("id", lines.alias("x")))).alias("l"))

    def block(x, n):
        number = F.when(x["id"] % 3 == 0, "XIV - ").otherwise(F.concat(F.lit("1."), (n + 1).cast("string"), F.lit(". ")))
        whole = F.concat(number, x["x"]["h"], x["x"]["d"])
        again = F.when(x["id"] % 4 == 0, F.concat(number, x["x"]["h"], F.lit("\n"))).otherwise("")
        between = F.when(x["id"] % 5 == 0, "MATÉRIAS EM PAUTA\nProcesso: 1.1/1900\nDecisão: de ninguém\n").otherwise("")
        return F.concat(between, again, whole, again)

    body = F.array_join(F.transform("l", block), "")
    split = items.items(minutes.select("file", F.concat(F.lit("ATA DA REUNIÃO\n"), body, F.lit("ENCERRAMENTO\nInteressado: ninguém")).alias("text")))
    return split.select("file", "processo", "interessado", "resultado")
