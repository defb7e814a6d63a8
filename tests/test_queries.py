import duckdb
import pytest

from newsweave.plans import registry, searches, stores, texts

QUERIES, ORACLES = registry.QUERIES | searches.QUERIES | stores.QUERIES | texts.QUERIES, registry.ORACLES | searches.ORACLES | stores.ORACLES | texts.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()  # noqa: SIM905


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("\0" if v is None else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in ORACLES:
        made = duck.sql(ORACLES[name])
        assert sorted(made.columns) == columns
        assert plain(made.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()) == plain(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
