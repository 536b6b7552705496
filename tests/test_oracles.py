"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import duckdb
import pytest

from chronoloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    def one(v):
        if str(v) in ("None", "nan", "<NA>", "NaT"):
            return "~"
        if isinstance(v, (bool, str)) or not hasattr(v, "__float__"):
            return str(v)
        return repr(float(v))

    cols = sorted(df.columns)
    return cols, sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, duck, sf_dir, name):
    got = plain(registry.queries()[name](spark, sf_dir).toPandas())
    want = plain(duck.sql(registry.oracles()[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
