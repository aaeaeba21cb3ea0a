"""Every registered query: same columns, types, rows and values as its SQL; the others at least run."""

import duckdb
import pytest

from gaugewarden.catalogue import ORACLES, QUERIES

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
    conversations""".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def comparable(names, rows):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = comparable(df.columns, [tuple(r) for r in df.collect()])
    relation = duck.execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    assert got == comparable(names, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    days = __spark_entry__.entry(spark).collect()
    assert len(days) == 30 and all(0 <= d["rate"] <= 5 for d in days)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
