"""Every core query against its SQL over the smallest tables, and its edges."""

import ast
import glob
import math
import os

import duckdb
import pytest

from mooring.plans import oracle, queries
from mooring.session import repository_root

Q, SQL = queries.queries(), oracle.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, small, duck, name):
    df = Q[name](spark, small)
    cols = sorted(df.columns)
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=str) == want


def test_every_query_has_sql_of_its_own():
    assert set(Q) == set(SQL)
    assert not [n for n in vars(oracle) if getattr(getattr(oracle, n), "__module__", "").startswith("mooring.") and getattr(oracle, n).__module__ != oracle.__name__]


@pytest.mark.parametrize("name", ["lexical_anchoring", "scored_records"])
def test_alignments_against_brute_force(spark, small, name):
    import re

    from tests.test_metrics import dp

    rows = spark.read.parquet(f"{small}/metric_rows.parquet").collect()
    text = {(r.sample_idx, m): (r.answers.get(m), r.reasonings.get(m)) for r in rows for m in r.questions}
    words = lambda s: re.findall(r"[^\W]+", s.lower())
    got = Q[name](spark, small).collect()
    assert got
    for r in got:
        a, t = map(words, text[r.sample_idx, r.method])
        assert r.lexical_anchoring == pytest.approx(dp(a, t) / len(a), abs=1e-6)


def test_empty_tables(spark, tmp_path, small):
    for f in glob.glob(f"{small}/*.parquet"):
        spark.read.parquet(f).where("false").write.parquet(f"{tmp_path}/{os.path.basename(f)}")
    one_row = {"validate_summary", "gate_summary", "method_coverage"}
    raises = {"zone_summary", "zone_thresholds", "zone_points", "zone_summary_ungated"}
    for name, f in Q.items():
        if name in raises:
            with pytest.raises(Exception, match="quantile"):
                f(spark, str(tmp_path)).collect()
        else:
            assert f(spark, str(tmp_path)).count() == (name in one_row), name


def test_nothing_imports_the_training_data_package():
    root = repository_root()
    for path in glob.glob(f"{root}/mooring/**/*.py", recursive=True):
        if "/llm/" in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("mooring.llm" in n for n in names), path
