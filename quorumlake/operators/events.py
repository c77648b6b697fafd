"""Monitoring, queue and source-health operators, over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.analytics import counted
from quorumlake.plans.registry import query
from quorumlake.plans.star import Star

#: The moment that "now" means over the driver's events.
NOW = "2024-01-31 00:00:00"
_NOW = f"timestamp '{NOW}'"


def now():
    return F.to_timestamp(F.lit(NOW))


@query("itens_monitorados", "select user_id, props hash, min(ts) first_seen_at, max(ts) last_seen_at, count(*) vistas from events group by 1, 2", tables=False)
def monitored_items(s: Star) -> DataFrame:
    """#157, #174: one row per site and hash with the first and the last sight."""
    return s.table("events").groupBy("user_id", F.col("props").alias("hash")).agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("vistas"))


@query(
    "fila_estado",
    f"""select estado, count(*) n from (select user_id, case when e = 'purchase' then 'concluido' when e = 'error' then 'falhou' when {_NOW} - ts > interval 12 hours then 'preso' else 'pendente' end estado
        from (select user_id, arg_max(event_type, (ts, event_id)) e, max(ts) ts from events group by 1)) group by 1""",
    tables=False,
)
def queue_state(s: Star, hours: int = 12) -> DataFrame:
    """#158: the last state of each job, a pending one stuck after some hours."""
    last = s.table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("e"), F.max("ts").alias("ts"))
    state = F.when(F.col("e") == "purchase", "concluido").when(F.col("e") == "error", "falhou").when(now() - F.col("ts") > F.expr(f"INTERVAL {hours} HOURS"), "preso").otherwise("pendente")
    return last.groupBy(state.alias("estado")).agg(F.count("*").alias("n"))


@query("fontes_paradas", f"select user_id, max(ts) ultima from events group by 1 having {_NOW} - max(ts) > interval 8 hours", tables=False)
def stale_sources(s: Star, hours: int = 8) -> DataFrame:
    """#164: sources without a sight for some hours."""
    return s.table("events").groupBy("user_id").agg(F.max("ts").alias("ultima")).where(now() - F.col("ultima") > F.expr(f"INTERVAL {hours} HOURS"))


_RUNS = """with d as (select event_type site, cast(ts as date) dia, count(*) filter (user_id % 7 = extract(day from ts) % 7) n from events group by 1, 2),
  b as (select *, max(n) over (partition by site order by dia rows between 3 preceding and 1 preceding) base, max(n) over (partition by site order by dia rows between 6 preceding and 3 preceding) longe,
    max(n) over w = 0 and count(*) over w = 3 muda from d window w as (partition by site order by dia rows between 2 preceding and current row))
"""


@query("sinal_de_volume", _RUNS + "select site, dia, n, case when muda and longe >= 5 then 'fonte_muda' when base is null or base < 5 then null when n <= base * 0.75 then 'queda_de_volume' end sinal from b", tables=False)
def volume_signal(s: Star, least: int = 5, drop: float = 0.25) -> DataFrame:
    """#173: a run's items against the most of the three before it; three zeros in a row are a mute source."""
    e = s.table("events")
    own = (F.col("user_id") % 7) == (F.dayofmonth("ts") % 7)
    runs = e.groupBy(F.col("event_type").alias("site"), F.to_date("ts").alias("dia")).agg(F.count_if(own).alias("n"))
    return signals(runs, least, drop)


def signals(runs: DataFrame, least: int = 5, drop: float = 0.25, zeros: int = 3) -> DataFrame:
    """The signal of each run of (site, dia, n): fonte_muda, queda_de_volume or null. The baseline looks
    back to the last run that found anything when zeros came between."""
    w = Window.partitionBy("site").orderBy("dia")
    base = F.max("n").over(w.rowsBetween(-3, -1))
    mute = (F.col("n") == 0) & (F.sum("n").over(w.rowsBetween(1 - zeros, 0)) == 0) & (F.count("*").over(w.rowsBetween(1 - zeros, 0)) == zeros)
    far = F.max("n").over(w.rowsBetween(-3 - zeros, -zeros))
    out = runs.select("site", "dia", "n", base.alias("base"), mute.alias("mute"), far.alias("far"))
    sign = F.when(F.col("mute") & (F.col("far") >= least), "fonte_muda").when(F.col("base") < least, F.lit(None)).when(F.col("n") <= F.col("base") * (1 - drop), "queda_de_volume")
    return out.select("site", "dia", "n", sign.alias("sinal"))


@query("noticias_lista", "select event_id, user_id, coalesce(case when event_id % 4 <> 0 then ts end, ts - interval 1 day) data from events where event_type = 'view' and coalesce(case when event_id % 4 <> 0 then ts end, ts - interval 1 day) <= timestamp '2024-01-20 00:00:00' order by data desc, event_id limit 50", tables=False)
def news_page(s: Star, until: str = "2024-01-20 00:00:00", size: int = 50) -> DataFrame:
    """#171: published or else first seen, none from the future, newest first."""
    shown = F.coalesce(F.when(F.col("event_id") % 4 != 0, F.col("ts")), F.col("ts") - F.expr("INTERVAL 1 DAY"))
    rows = s.table("events").where("event_type = 'view'").select("event_id", "user_id", shown.alias("data")).where(F.col("data") <= F.to_timestamp(F.lit(until)))
    return rows.orderBy(F.desc_nulls_last("data"), "event_id").limit(size)


@query("noticias_sem_velhas", "select event_id from (select event_id, ts, max(ts) over (partition by user_id) m, count(*) filter (ts >= mx - interval 10 days) over (partition by user_id) k from (select *, max(ts) over (partition by user_id) mx from events)) where ts >= m - interval 10 days or k < 3", tables=False)
def stale_mixed(s: Star, days: int = 10, least: int = 3) -> DataFrame:
    """#172: items older than the newest by some days go, unless too few would remain. Aggregates by
    source are joined back, so a busy source isn't sorted in one task."""
    e = s.table("events").select("event_id", "user_id", "ts")
    cut = F.expr(f"INTERVAL {days} DAYS")
    newest = e.groupBy("user_id").agg(F.max("ts").alias("m"))
    dated = e.join(newest, "user_id")
    fresh = F.col("ts") >= F.col("m") - cut
    kept = dated.groupBy("user_id").agg(F.count_if(fresh).alias("k"))
    return dated.join(kept, "user_id").where(fresh | (F.col("k") < least)).select("event_id")


@query(
    "contadores_de_rodada",
    "select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) fluxo, arg_max(cast(json_extract(props, '$.k') as bigint), (ts, event_id)) fotografia from events group by 1",
    tables=False,
)
def round_counters(s: Star) -> DataFrame:
    """#107, #47: flow keys are summed over rounds, snapshot keys keep the last."""
    k = F.get_json_object("props", "$.k").cast("long")
    return s.table("events").groupBy("event_type").agg(F.sum(k).alias("fluxo"), F.max_by(k, F.struct("ts", "event_id")).alias("fotografia"))


@query("saude_das_fontes", "select user_id, count(*) filter (event_type = 'error') erros, count(*) total, case when count(*) = count(*) filter (event_type = 'error') then 'fora' when count(*) filter (event_type = 'error') * 4 > count(*) then 'instavel' else 'ok' end classe from events group by 1", tables=False)
def source_health(s: Star) -> DataFrame:
    """#106: errors of each source and its class."""
    bad, n = F.count_if(F.col("event_type") == "error"), F.count("*")
    return s.table("events").groupBy("user_id").agg(bad.alias("erros"), n.alias("total"), F.when(n == bad, "fora").when(bad * 4 > n, "instavel").otherwise("ok").alias("classe"))


@query("cobertura_diaria", "select cast(ts as date) dia, count(*) eventos, count(distinct user_id) fontes, count(*) filter (event_type = 'error') erros from events group by 1", tables=False)
def daily_coverage(s: Star) -> DataFrame:
    """#98: events, sources and errors by day."""
    return s.table("events").groupBy(F.to_date("ts").alias("dia")).agg(F.count("*").alias("eventos"), F.count_distinct("user_id").alias("fontes"), counted("erros", F.col("event_type") == "error"))


@query("nao_enfileirados", "select distinct user_id from events e where not exists (select 1 from events x where x.user_id = e.user_id and x.event_type = 'purchase' and x.ts > timestamp '2024-01-25')", tables=False)
def not_enqueued(s: Star) -> DataFrame:
    """#98: sources with nothing taken up since a day."""
    e = s.table("events")
    taken = e.where("event_type = 'purchase' and ts > timestamp '2024-01-25'").select("user_id")
    return e.select("user_id").distinct().join(taken, "user_id", "left_anti")
