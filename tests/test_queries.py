"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import os

import duckdb
import pytest

from factloom.rule_queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    if name not in ORACLE:
        assert spark.read.parquet(f"{tmp_path}/out").count() > 0
        return
    duck.sql(f"CREATE OR REPLACE TABLE o AS {ORACLE[name]}")
    duck.sql(f"CREATE OR REPLACE TABLE s AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    describe = lambda t: sorted((r[0], r[1]) for r in duck.sql(f"DESCRIBE {t}").fetchall())
    assert describe("o") == describe("s")
    cols = ", ".join(f'"{c}"' for c, _ in describe("o"))
    for x, y in (("o", "s"), ("s", "o")):
        assert duck.sql(f"SELECT {cols} FROM {x} EXCEPT ALL SELECT {cols} FROM {y} LIMIT 3").fetchall() == []
