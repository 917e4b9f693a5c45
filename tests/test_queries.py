"""Every query of the library against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import evgraph.plans as plans

DATA = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 4) + 0.0
        return v

    return sorted(([value(v) for v in r] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df, sql = plans.queries()[name](spark, DATA), plans.oracle_sql()[name]
    want = {r[0]: TYPES.get(r[1], r[1]) for r in duck.execute(f"describe {sql}").fetchall()}
    assert dict(df.dtypes) == want
    names = sorted(want)
    assert plain(df.select(*(f"`{n}`" for n in names)).collect()) == plain(duck.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_gives_rows(spark, name):
    assert plans.queries()[name](spark, DATA).count() >= 0
