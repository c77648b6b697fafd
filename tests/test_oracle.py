import pytest

from oracle import assert_same, connect
from quorumlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs_alike_twice(spark, name):
    one, two = (sorted(map(tuple, catalog.queries()[name](spark, SF).collect()), key=repr) for _ in range(2))
    assert one and one == two


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_imports_without_the_optional_part():
    """Nothing outside the llm folders imports them but the entry, which guards it."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for p in root.rglob("*.py"):
        where = p.relative_to(root).as_posix()
        if "llm" not in where.split("/") and where not in ("corpus_pipeline.py", "__spark_entry__.py", "bench.py", "tests/test_oracle.py"):
            assert "quorumlake.llm" not in p.read_text(), where
