"""Every registered query with SQL matches DuckDB on the sf0.001 tables."""
import pytest

import __spark_entry__ as entry
from tools.oracle_check import duck, normalise

from conftest import SF_SMALL

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


SPARK2DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    s_types = {f.name: SPARK2DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    rel_t = con.sql(SQL[name])
    assert s_types == {c: str(t) for c, t in zip(rel_t.columns, rel_t.types)}
    s_cols, s_rows = normalise(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = con.execute(SQL[name])
    d_cols, d_rows = normalise([d[0] for d in rel.description], rel.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "repr_text" in df.columns
