"""Plans and storage: what the scan gets, what is aggregated, and how snapshots lie on disk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import AutoNumber, Database, SchemaError, col
from tessera.catalog import shared_dir


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def big(spark):
    db = Database(spark)
    db.create_table("t")
    db.add_column("t", "number", AutoNumber, is_primary_key=True)
    db.add_column("t", "id", int)
    db.add_column("t", "name", str)
    db.add_column("t", "size", float)
    db.add_column("t", "flag", bool)
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("id"), F.concat(F.lit("n"), F.col("id") % 50).alias("name"), (F.col("id") % 7).cast("double").alias("size"), (F.col("id") % 2 == 0).alias("flag"))
    assert db.insert_df("t", df.repartition(5)) == 20_000
    return db


def test_insert_df_numbers(big, spark):
    rows = big.frame("t").select("__rid", "number").collect()
    assert sorted(r[0] for r in rows) == sorted(r[1] for r in rows) == list(range(1, 20_001))
    big.insert_df("t", spark.createDataFrame([(50_000, "x")], "id long, name string"))
    assert big.query("t").where(col("id") == 50_000).one()["number"] == 20_001
    big.delete("t", where=col("id") == 50_000)


def test_lookup_reads_one_range(big, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        big.update("t", {"size": 1.0}, where=col("id") < 0)
        big._swap({"t": big.frame("t")})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    state = big.state["t"].base
    ranges = sorted((r[0], r[1]) for r in state.groupBy(F.input_file_name()).agg(F.min("number").alias("a"), F.max("number").alias("b")).select("a", "b").collect())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    q = big.query("t").where(col("number") == 4321).to_df()
    assert "PushedFilters: [IsNotNull(number), EqualTo(number,4321)]" in plan(q)
    assert big.to_list("t", where_key={"number": 4321})["number"] == 4321


def first_rows(rows, names, order):
    for n, down in reversed(order):
        rows = sorted(rows, key=lambda r: (r[n] is None, 0) if r[n] is None else (False, r[n]), reverse=False) if not down else [*sorted((r for r in rows if r[n] is not None), key=lambda r: r[n], reverse=True), *(r for r in rows if r[n] is None)]
    return list(dict.fromkeys(tuple(r[n] for n in names) for r in rows))


@pytest.mark.parametrize("order", [[("number", False)], [("size", True)], [("size", True), ("number", False)], [("flag", True), ("name", False)], [("name", True), ("size", False)], [("id", True), ("name", True)]])
def test_distinct_by_hidden_order(spark, order):
    rng = random.Random(3)
    db = Database(spark)
    db.create_table("t")
    for n, kind in (("number", AutoNumber), ("id", int), ("name", str), ("size", float), ("flag", bool)):
        db.add_column("t", n, kind, is_primary_key=n == "number")
    db.insert_many("t", [{"id": rng.choice([None, 1, 2, -3]), "name": rng.choice([None, "a", "b"]), "size": rng.choice([None, 1.0, -2.5]), "flag": rng.choice([None, True, False])} for _ in range(60)])
    rows = db.to_list("t")
    for names in (["name"], ["size", "flag"]):
        q = db.query("t").order_by(*[(n, "desc" if d else "asc") for n, d in order]).distinct().select(*names)
        assert [tuple(r.values()) for r in q.to_list()] == first_rows(rows, names, order)
        assert [tuple(r.values()) for r in q.offset(1).limit(2).to_list()] == first_rows(rows, names, order)[1:3]


def test_distinct_is_an_aggregate(big):
    text = plan(big.query("t").order_by(("number", "desc")).distinct().select("name").to_df())
    assert "Window" not in text and "partial_m" in text


def test_callable_in_batches(big):
    q = big.query("t").where(lambda r: r["id"] % 1000 == 0 and r["flag"]).select("id")
    assert "ArrowEvalPython" in plan(q.to_df()) and "BatchEvalPython" not in plan(q.to_df())
    want = {r["id"] for r in big.query("t").to_list() if r["id"] % 1000 == 0 and r["flag"]}
    assert set(q.pluck("id")) == want
    with pytest.raises(Exception, match="must return a bool"):
        big.query("t").where(lambda r: 1).count()


def test_batch_encryption(spark):
    db = Database(spark)
    db.set_encryption_key(Database.generate_encryption_key())
    db.create_table("t")
    db.add_column("t", "id", int, is_primary_key=True)
    db.add_column("t", "name", str, is_encrypted=True)
    db.add_column("t", "n", int, is_encrypted=True)
    names = ["a", None, "it's \x01 \"q\" é\n", "a"]
    db.insert_df("t", spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("n", F.col("id") * 10))
    db.insert("t", {"id": 9, "name": names[2], "n": 20})
    assert [r["name"] for r in db.query("t").order_by("id").to_list(decrypt=True)] == [*names, names[2]]
    assert db.query("t").where(col("name") == names[2]).order_by("id").pluck("id") == [2, 9]  # one row of a batch, one of a driver
    assert db.query("t").where(col("n") == 20).order_by("id").pluck("id") == [2, 9]
    assert db.query("t").where(col("n") > 15).order_by("id").pluck("id") == [2, 3, 9]


GOLDEN = {
    "format": "relational-db", "format_version": 1,
    "schema": {
        "users": {
            "name": "users", "primary_key": ["id"], "foreign_keys": {}, "auto_sequences": {"id": 2},
            "columns": {
                "id": {"name": "id", "data_type": "AutoNumber", "nullable": False, "has_default": False, "default": None, "is_primary_key": True, "is_pii": False, "is_encrypted": False},
                "name": {"name": "name", "data_type": "str", "nullable": True, "has_default": False, "default": None, "is_primary_key": False, "is_pii": False, "is_encrypted": False},
                "joined": {"name": "joined", "data_type": "datetime", "nullable": True, "has_default": False, "default": None, "is_primary_key": False, "is_pii": False, "is_encrypted": False},
            },
        },
        "orders": {
            "name": "orders", "primary_key": ["id"], "auto_sequences": {"id": 3},
            "foreign_keys": {"user_id": {"local_column": "user_id", "target_table": "users", "target_column": "id", "on_delete": "CASCADE"}},
            "columns": {
                "id": {"name": "id", "data_type": "AutoNumber", "nullable": False, "has_default": False, "default": None, "is_primary_key": True, "is_pii": False, "is_encrypted": False},
                "user_id": {"name": "user_id", "data_type": "int", "nullable": True, "has_default": False, "default": None, "is_primary_key": False, "is_pii": False, "is_encrypted": False},
                "amount": {"name": "amount", "data_type": "float", "nullable": True, "has_default": False, "default": None, "is_primary_key": False, "is_pii": False, "is_encrypted": False},
            },
        },
    },
    "data": {
        "users": [{"__other_row_id__": 1, "id": 1, "name": "Alice", "joined": {"__other_encoded__": True, "type": "datetime", "value": "2024-01-02T03:04:05"}}, {"__other_row_id__": 2, "id": 2, "name": "Bob", "joined": None}],
        "orders": [{"__other_row_id__": i, "id": i, "user_id": u, "amount": a} for i, u, a in ((1, 1, 120.0), (2, 1, 80.0), (3, 2, 50.0))],
    },
    "indexes": {"idx_users_name": {"name": "idx_users_name", "table_name": "users", "columns": ["name"], "unique": False, "nulls_distinct": True}},
    "internal": {"next_row_id": {"users": 3, "orders": 4}},
}


def test_saved_file_of_the_other_kind(spark, tmp_path):
    """A file of format version 1 whose marks have another prefix: rows, numbers and indexes come back and go on."""
    path = tmp_path / "saved.json"
    path.write_text(json.dumps(GOLDEN))
    db = Database.load_json(f"file://{path}", spark=spark)
    assert [(r["name"], str(r["joined"])) for r in db.query("users").order_by("id").to_list()] == [("Alice", "2024-01-02 03:04:05"), ("Bob", "None")]
    assert db.query("orders").join("users").where(col("users.name") == "Alice").count() == 2
    assert db.insert("users", {"name": "Carol"})["id"] == 3 and db.list_indexes() == ["idx_users_name"]
    assert db.delete("users", where=col("name") == "Alice") == 3


def test_shared_folder(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "/warehouse" if "warehouse" in key else None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(SchemaError):
        shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session) == "/warehouse/_tessera"
    assert shared_dir(spark).startswith("file://")


def files(db, table="t"):
    return set(db.state[table].base.inputFiles())


@pytest.fixture
def parts(spark):
    """Four appended parts of 1000 rows."""
    db = Database(spark)
    db.create_table("t")
    db.add_column("t", "id", int, is_primary_key=True)
    db.add_column("t", "a", int)
    db.add_column("t", "b", str)
    for k in range(4):
        db.insert_df("t", spark.range(1000 * k, 1000 * (k + 1), 1, 1).select("id", (F.col("id") % 10).alias("a"), F.concat(F.lit("b"), F.col("id") % 7).alias("b")))
    return db


def test_changes_keep_untouched_files(parts):
    before = files(parts)
    assert len(before) == 4
    assert parts.update("t", {"b": "new"}, where=col("id") == 2500) == 1
    after = files(parts)
    assert len(before & after) == 3 and parts.query("t").where(col("b") == "new").pluck("id") == [2500]
    assert parts.delete("t", where=col("id") < 10) == 10
    assert len(after & files(parts)) == 3 and parts.query("t").count() == 3990
    parts.insert("t", {"id": 9000, "a": 1, "b": "late"})
    parts.update("t", {"a": 5}, where=col("id") >= 3999)
    assert parts.query("t").where(col("id") >= 3998).order_by("id").pluck("a") == [8, 5, 5]
    assert parts.query("t").count() == 3991 and parts.update("t", {"a": 1}, where=col("id") < 0) == 0
    rows = parts.query("t").order_by("id").to_list()
    assert parts.vacuum() > 0 and parts.query("t").order_by("id").to_list() == rows and parts.vacuum() == 0


def test_index_scan(parts):
    parts.create_index("t", ["b", "a"], name="by_b")
    text = lambda q: q.to_df().inputFiles()
    copy, base = set(parts.copies["by_b"].inputFiles()), files(parts)
    for condition in (col("b") == "b3", (col("b") == "b3") & (col("a") > 4), col("b").in_(["b1", "b2"]) & (col("a") == 1)):
        q = parts.query("t").where(condition)
        assert set(text(q)) == copy
        want = sorted(r["id"] for r in parts.to_list("t") if r["b"] in (("b1", "b2") if "in" in str([x.op for x in condition.leaves()]) else ("b3",)) and all(x.name != "a" or (r["a"] > 4 if x.op == "gt" else r["a"] == 1) for x in condition.leaves()))
        assert q.order_by("id").pluck("id") == want
    for condition in (col("a") == 1, (col("b") == "b3") | (col("a") == 1), ~(col("b") == "b3"), col("b") == None):  # noqa: E711
        assert set(text(parts.query("t").where(condition))) == base
    parts.insert("t", {"id": 9000, "a": 1, "b": "b3"})
    parts.delete("t", where=col("id") < 3000)
    assert parts.query("t").where(col("b") == "b3").count() == sum(r["b"] == "b3" for r in parts.to_list("t"))
    parts.drop_index("by_b")
    assert set(text(parts.query("t").where(col("b") == "b3"))) == files(parts)


def test_unique_new_rows(parts, spark):
    parts.create_index("t", ["a", "id"], unique=True)
    parts.create_index("t", "id", name="u", unique=True, nulls_distinct=False)
    from tessera import ConstraintError

    row = lambda **x: spark.createDataFrame([x], "id long, a long, b string")
    with pytest.raises(ConstraintError):
        parts.insert_df("t", row(id=5, a=5, b="x"))
    parts.insert_df("t", row(id=5000, a=5, b="x"))
    with pytest.raises(ConstraintError):
        parts.insert("t", {"id": 5000, "a": 9, "b": "x"})
    assert parts.query("t").count() == 4001
    plain = Database(spark)
    plain.create_table("n")
    plain.add_column("n", "id", AutoNumber, is_primary_key=True)
    plain.add_column("n", "x", int)
    plain.create_index("n", "x", unique=True)
    plain.insert_many("n", [{"x": None}, {"x": None}, {"x": 1}])
    with pytest.raises(ConstraintError):
        plain.insert("n", {"x": 1})
    with pytest.raises(ConstraintError):
        plain.create_index("n", "x", name="strict", unique=True, nulls_distinct=False)


def test_single_inserts(spark):
    """Ten thousand inserts of one row look at each waiting row once for keys."""
    import time

    db = Database(spark)
    db.create_table("p")
    db.add_column("p", "id", int, is_primary_key=True)
    db.create_table("t")
    db.add_column("t", "id", int, is_primary_key=True)
    db.add_column("t", "p", int, references="p.id")
    db.insert_many("p", [{"id": i} for i in range(50)])
    began = time.perf_counter()
    for i in range(5000):
        db.insert("t", {"id": i, "p": i % 50})
    assert time.perf_counter() - began < 20
    from tessera import ConstraintError

    for row in ({"id": 77, "p": 1}, {"id": 9000, "p": 50}):
        with pytest.raises(ConstraintError):
            db.insert("t", row)
    db.delete("t", where=col("id") < 10)
    assert db.insert("t", {"id": 5, "p": 1})["id"] == 5 and db.query("t").count() == 4991
