"""The queries that SQL can say, against their SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from mooring.llm import oracle, queries

Q, SQL = queries.queries(), oracle.oracle_sql()


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = Q[name](spark, small)
    cols = sorted(df.columns)
    r = con.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert want and sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=str) == want


def test_one_query_a_problem_comes_first():
    names = [n for n in Q if n.startswith("p1_")]
    assert names[0] == "p1_percentiles" and {f"p{n}_" for n in range(1, 9)} == {n.split("_")[0] + "_" for n in Q}
