"""The stored star: bucketed facts, the same rows as the lazy one, made again when files change."""

import pathlib
import shutil

import pytest

from quorumlake import catalog
from quorumlake.plans import star

SF = "/root/testdata/sf0.001"


def copied(folder):
    """A copy of the tables that any user may change; the modes of a read-only folder aren't copied."""
    folder.mkdir()
    for p in pathlib.Path(SF).glob("*.parquet"):
        (folder / p.name).write_bytes(p.read_bytes())
    return str(folder)


def test_stored_facts_meet_without_a_shuffle(spark):
    s = star.stored(spark, SF)
    j = s.deliberacoes.join(s.votos.hint("merge"), s.deliberacoes["id"] == s.votos["deliberacao_id"])
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    lazy = star.from_tables(spark, SF)
    for kind in ("deliberacoes", "votos"):
        a, b = getattr(s, kind), getattr(lazy, kind)
        assert a.schema.simpleString() == b.schema.simpleString() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_the_star_is_written_once_for_the_same_files(spark, tmp_path):
    folder = copied(tmp_path / "sf0.001")
    one = star.stored(spark, folder)
    n, files = one.deliberacoes.count(), one.votos.inputFiles()
    assert star.stored(spark, folder).votos.inputFiles() == files
    # an application that knows no tables finds the files of another one
    for t in spark.catalog.listTables(pattern="quorumlake_*"):
        spark.sql(f"drop table {t.name}")
    assert star.stored(spark, folder).votos.inputFiles() == files
    pathlib.Path(folder, "orders.parquet").unlink()
    spark.read.parquet(f"{SF}/orders.parquet").limit(10).write.parquet(f"file://{folder}/orders.parquet")
    assert star.stored(spark, folder).deliberacoes.count() <= 10 < n


def test_a_star_whose_files_are_gone_is_written_again(spark):
    s = star.stored(spark, SF)
    n, path = s.votos.count(), s.votos.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    kept = s.deliberacoes.inputFiles()
    shutil.rmtree(path)
    again = star.stored(spark, SF)
    assert again.votos.count() == n and again.deliberacoes.inputFiles() == kept


@pytest.mark.parametrize("least, most, want", [(1000, 12, 12), (100_000, 50_000, 8)])
def test_buckets_are_bounded(spark, tmp_path, monkeypatch, least, most, want):
    """Sources of any size get a number of buckets that Spark takes: beyond it they grow."""
    monkeypatch.setattr(star, "BUCKET_BYTES", least)
    monkeypatch.setattr(star, "MOST_BUCKETS", most)
    s = star.stored(spark, copied(tmp_path / "sf"))
    assert s.votos.count() == star.from_tables(spark, SF).votos.count()
    assert len({f.rsplit("_", 1)[1] for f in s.votos.inputFiles()}) == want


def test_queries_that_need_no_facts_write_none(spark, tmp_path):
    folder = copied(tmp_path / "sf")
    before = star._base(spark)
    held = lambda: sorted(map(str, pathlib.Path(before.removeprefix("file://"), "star").rglob("_SUCCESS")))
    now = held()
    for name in ("fuzzy_match", "texto_limpo", "privacidade"):
        assert catalog.queries()[name](spark, folder).count()
    assert held() == now
    catalog.queries()["overview"](spark, folder).collect()
    assert len(held()) > len(now)


def test_clear_deletes_files_and_tables(spark):
    assert star.stored(spark, SF).votos.count() and spark.catalog.listTables(pattern="quorumlake_*")
    star.clear(spark, stars=True)
    assert not spark.catalog.listTables(pattern="quorumlake_*") and not star._exists(spark, f"{star._base(spark)}/star")
    assert star.stored(spark, SF).votos.count()
