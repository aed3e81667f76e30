"""Every registered query of the linkage library against its SQL twin."""

import duckdb
import pytest

from matchloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    return None if v is None else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(registry.oracles()[name])
    names = [x[0] for x in rel.description]
    want = sorted((tuple(_value(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert sorted(names) == cols
    assert sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
