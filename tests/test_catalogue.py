"""Every query of the catalogue against its SQL, and hand-computed agreement statistics."""

import duckdb
import pytest

from docscope.operators import agreement as A
from docscope.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in ("documents", "events", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    got = catalogue.QUERIES[name](spark, small)
    data = [tuple(r) for r in got.collect()]
    assert data
    if name in catalogue.SQL:
        want = con.sql(catalogue.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize(
    ("a", "b", "kappa"), [([0, 1, 2, 3, 4], [0, 1, 2, 3, 4], 1.0), ([2, 2, 2], [2, 2, 2], None), ([0, 1, 2], [0, 2, 2], 0.8)]
)
def test_weighted_kappa(spark, a, b, kappa):
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    got = df.agg(A.qwk(df.a, df.b)).first()[0]
    assert got == (pytest.approx(kappa) if kappa is not None else None)


def test_spearman_ties(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (3, 4)], "a int, b int")
    assert A.spearman(df, "a", "b").first()["spearman"] == pytest.approx(0.948683, abs=1e-6)
