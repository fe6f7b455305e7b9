"""Deep slices: no task gathers the rows before a slice, and the slice is the one that its order gives."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import AutoNumber, Database, catalog, col, count, max_, queries, relation

SF = "/root/testdata/sf0.01"


def gathers(df):
    """Whether the plan has a step that takes a slice of more than a few rows in one task."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return any(step in text for step in ("GlobalLimit", "Offset "))


@pytest.fixture
def shallow(monkeypatch, spark):
    """A depth of five rows, and shuffles that keep all their partitions."""
    for module in (relation, catalog):
        monkeypatch.setattr(module, "DEEP", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def db(spark):
    rng = random.Random(7)
    db = Database(spark)
    db.create_table("t")
    for n, kind in (("number", AutoNumber), ("size", float), ("name", str), ("group", int)):
        db.add_column("t", n, kind, is_primary_key=n == "number")
    db.insert_many("t", [{"size": rng.choice([None, 1.0, -2.5, float("nan")]), "name": rng.choice([None, "a", "b", "ä"]), "group": rng.choice([None, 1, 2, 3])} for _ in range(90)])
    return db


def ordered(rows, order):
    for n, down in reversed(order):
        some = sorted((r for r in rows if r[n] is not None), key=lambda r: (r[n] != r[n], r[n]) if r[n] == r[n] else (True, 0), reverse=down)
        rows = [*some, *(r for r in rows if r[n] is None)]
    return rows


SLICES = [(0, 70), (3, None), (20, 4), (88, 9), (90, 3), (1, 2)]


@pytest.mark.parametrize("order", [[], [("size", True), ("name", False)], [("name", True), ("group", True), ("number", True)]])
def test_slices_of_a_table(db, shallow, order):
    rows = ordered(db.query("t").to_list(), order)
    q = db.query("t").order_by(*[(n, "desc" if down else "asc") for n, down in order]) if order else db.query("t")
    for start, n in SLICES:
        df = q.offset(start).limit(n).select("name", "number").to_df()
        assert gathers(df) == ((start, n) == (1, 2)), (start, n)
        assert [tuple(r) for r in df.collect()] == [(r["name"], r["number"]) for r in (rows[start:] if n is None else rows[start : start + n])], (start, n)


def test_slices_of_joins_groups_and_distinct_rows(db, shallow, spark):
    join = db.query("t").join("t", on="number")
    keys = [("t_left.size", True), ("t_right.number", False)]
    rows = ordered(join.to_list(), keys)
    q = join.order_by(("t_left.size", "desc"), "t_right.number").select("t_right.number")
    groups = db.query("t").group_by("number").aggregate(n=count(), top=max_("group")).order_by(("top", "desc"), ("number", "desc"))
    found = ordered([{"number": r["number"], "n": 1, "top": r["group"]} for r in db.query("t").to_list()], [("top", True), ("number", True)])
    unique = db.query("t").select("name", "group").distinct().order_by(("group", "desc"), "name")
    every = ordered([dict(zip(("name", "group"), x, strict=True)) for x in {(r["name"], r["group"]) for r in db.query("t").to_list()}], [("group", True), ("name", False)])
    for start, n in SLICES:
        end = None if n is None else start + n
        for sliced, want in ((q, [{"t_right.number": r["t_right.number"]} for r in rows]), (groups, found), (unique, every)):
            sliced = sliced.offset(start).limit(n)
            assert sliced.to_list() == want[start:end]
            assert sliced._deep() != gathers(sliced.to_df())
    assert join.offset(30).limit(20).count() == 20 and join.offset(85).count() == 5  # no order: any rows


def test_ties_are_dealt(shallow, spark):
    """Rows that the order leaves equal do not meet in one task."""
    db = Database(spark)
    db.register_table("t", spark.range(0, 4000, 1, 8).select("id", (F.col("id") < 0).alias("same")))
    page = db.query("t").order_by("same").offset(100).limit(3000).to_df()
    assert len({r.id for r in page.collect()}) == 3000
    sizes = [r[1] for r in spark.read.parquet(db.written[-1]).groupBy(F.shiftright("place", 33)).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2500


def test_a_short_slice_alone_stays_written(db, shallow, spark):
    before = len(db.written)
    page = db.query("t").order_by("number").offset(50).limit(3).to_df()
    assert len(db.written) == before + 1 and spark.read.parquet(db.written[-1]).count() == 3
    assert [r.number for r in page.collect()] == [51, 52, 53]


def test_plain_values_of_groups_are_not_stored(shallow, spark):
    db = Database(spark)
    db.set_encryption_key(Database.generate_encryption_key())
    db.create_table("t")
    db.add_column("t", "id", AutoNumber, is_primary_key=True)
    db.add_column("t", "name", str, is_encrypted=True)
    db.insert_many("t", [{"name": f"n{i:02}"} for i in range(20)])
    assert db.query("t").order_by("name").offset(6).limit(2).to_list(decrypt=True) == [{"id": 7, "name": "n06"}, {"id": 8, "name": "n07"}]
    before = list(db.written)
    assert db.query("t").group_by("name").aggregate(n=count()).order_by("name").offset(6).limit(2).to_list() == [{"name": "n06", "n": 1}, {"name": "n07", "n": 1}]
    assert db.written == before


def test_a_page_at_the_nulls(spark):
    """The registered query, at a depth of some 60,000 rows."""
    df = queries.FOUND["order_multi_nulls_last"](spark, SF)
    assert not gathers(df)
    rows = df.collect()
    outer = queries._outer(queries.star(spark, SF)).to_df()
    every = outer.select("l_quantity", "o_orderkey", "l_linenumber", "l_partkey").toPandas().sort_values(["o_orderkey", "l_linenumber", "l_partkey"], kind="stable").sort_values("l_quantity", ascending=False, na_position="last", kind="stable")
    start = int(every.l_quantity.notna().sum()) - 150
    want = every.iloc[start : start + 300]
    assert [r.o_orderkey for r in rows] == list(want.o_orderkey) and sum(r.l_quantity is None for r in rows) == 150
    assert queries.star(spark, SF).query("lineitem").where(col("l_quantity") < 0).offset(20_000).limit(5).count() == 0
