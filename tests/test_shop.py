"""The ten reports of the shop against DuckDB: the same rows in the same order, floats within 1e-6."""

import pytest

import shop


@pytest.fixture(scope="module")
def data():
    return shop.rows()


@pytest.fixture(scope="module")
def db(spark, data):
    return shop.database(spark, data)


@pytest.fixture(scope="module")
def duck(data):
    duckdb, pd = pytest.importorskip("duckdb"), pytest.importorskip("pandas")
    con = duckdb.connect()
    for t, rows in data.items():
        con.register(t, pd.DataFrame([{"id": i + 1, **r} for i, r in enumerate(rows)]))
    return con


@pytest.mark.parametrize("name", shop.REPORTS)
def test_report(db, duck, name):
    report = shop.REPORTS[name]
    got, want = [tuple(r) for r in report.builder(db).collect()], duck.sql(report.sql()).fetchall()
    assert want and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(abs(x - y) < 1e-6 if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))
