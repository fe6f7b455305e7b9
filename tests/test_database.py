"""Schema, changes, joins, views, exports, encryption and persistence on small tables."""

import datetime as dt

import pytest

from tessera import (
    AutoNumber, ColumnNotFoundError, ConstraintError, Database, EncryptionError, MultipleRowsFoundError, NoRowsFoundError, QueryError, QueryTypeError,
    SchemaError, TableNotFoundError, ViewError, avg, col, count, max_, min_, sum_,
)


@pytest.fixture
def db(spark):
    db = Database(spark)
    db.create_table("users")
    db.add_column("users", "id", AutoNumber, is_primary_key=True)
    db.add_column("users", "name", str, nullable=False)
    db.add_column("users", "age", int)
    db.create_table("orders")
    db.add_column("orders", "id", AutoNumber, is_primary_key=True)
    db.add_column("orders", "user_id", int, references="users.id", on_delete="cascade")
    db.add_column("orders", "amount", float, default=1.0)
    db.insert_many("users", [{"name": "Alice", "age": 30}, {"name": "Bob"}, {"name": "Carol", "age": 25}])
    db.insert_many("orders", [{"user_id": 1, "amount": 120.0}, {"user_id": 1, "amount": 80.0}, {"user_id": 2, "amount": 50.0}, {"amount": 7.0}])
    return db


def test_schema_rules(db):
    with pytest.raises(SchemaError):
        db.create_table("users")
    with pytest.raises(SchemaError):
        db.create_table("1x")
    with pytest.raises(SchemaError):
        db.add_column("users", "d", set)
    with pytest.raises(SchemaError):
        db.add_column("users", "must", str, nullable=False)
    with pytest.raises(SchemaError):
        db.add_column("orders", "x", str, references="users.id")
    with pytest.raises(TableNotFoundError):
        db.query("nothing")
    db.add_column("users", "city", str, default="Oslo")
    assert db.query("users").distinct().select("city").to_list() == [{"city": "Oslo"}]
    described = db.describe_table("orders")
    assert described["row_count"] == 4 and described["foreign_keys"]["user_id"]["on_delete"] == "CASCADE"


def test_composite_key(spark):
    db = Database(spark)
    db.create_table("t")
    for n in ("a", "b"):
        db.add_column("t", n, int, nullable=False)
    db.insert_many("t", [{"a": 1, "b": 1}, {"a": 1, "b": 2}])
    with pytest.raises(ConstraintError):
        db.set_primary_key("t", ["a"])
    db.set_primary_key("t", ["a", "b"])
    with pytest.raises(ConstraintError):
        db.insert("t", {"a": 1, "b": 2})


def test_insert_rules(db):
    with pytest.raises(ConstraintError):
        db.insert("users", {"id": 1, "name": "x"})
    with pytest.raises(ConstraintError):
        db.insert("orders", {"user_id": 99})
    with pytest.raises(ConstraintError):
        db.insert("users", {"name": None})
    with pytest.raises(TypeError):
        db.insert("users", {"name": "x", "age": True})
    with pytest.raises(ColumnNotFoundError):
        db.insert("users", {"name": "x", "zip": 1})
    with pytest.raises(ConstraintError):
        db.insert_many("users", [{"name": "ok"}, {"id": 2, "name": "x"}])
    assert db.query("users").count() == 3
    assert db.insert("users", {"id": 10, "name": "Ten"})["id"] == 10
    assert db.insert("users", {"name": "Next"})["id"] == 11
    assert db.insert_many("users", []) == []


def test_update_and_delete(db):
    assert db.update("users", {"age": 1}, where=col("age").is_null()) == 1
    assert db.update("users", {"age": 2}, where=lambda r: r["name"] == "Carol") == 1
    assert db.query("users").order_by("id").pluck("age") == [30, 1, 2]
    with pytest.raises(QueryError):
        db.update("users", {"age": 1})
    with pytest.raises(ConstraintError):
        db.update("users", {"id": 5}, allow_all=True)
    with pytest.raises(ConstraintError):
        db.update("orders", {"user_id": 77}, allow_all=True)
    assert db.delete("users", where=col("name") == "Alice") == 3
    assert db.query("orders").order_by("id").pluck("id") == [3, 4]
    with pytest.raises(QueryError):
        db.delete("users")


def test_restrict_and_set_null(spark):
    for action, left in (("restrict", None), ("set null", [None, 2])):
        db = Database(spark)
        db.create_table("p")
        db.add_column("p", "id", int, is_primary_key=True)
        db.create_table("c")
        db.add_column("c", "id", int, is_primary_key=True)
        db.add_column("c", "p_id", int, references="p.id", on_delete=action)
        db.insert_many("p", [{"id": 1}, {"id": 2}])
        db.insert_many("c", [{"id": 1, "p_id": 1}, {"id": 2, "p_id": 2}])
        if left is None:
            with pytest.raises(ConstraintError):
                db.delete("p", where=col("id") == 1)
            assert db.query("p").count() == 2
        else:
            assert db.delete("p", where=col("id") == 1) == 1
            assert db.query("c").order_by("id").pluck("p_id") == left


def test_self_reference_cascade(spark):
    db = Database(spark)
    db.create_table("n")
    db.add_column("n", "id", int, is_primary_key=True)
    db.add_column("n", "up", int, references="n.id", on_delete="cascade")
    db.insert("n", {"id": 1})
    for i in (2, 3, 4):
        db.insert("n", {"id": i, "up": i - 1 if i < 4 else None})
    assert db.delete("n", where=col("id") == 1) == 3
    assert db.query("n").pluck("id") == [4]


def test_joins(db):
    q = db.query("orders").join("users")
    assert q.result_columns() == ["orders.id", "orders.user_id", "orders.amount", "users.id", "users.name", "users.age"]
    assert q.count() == 3
    assert db.query("orders").left_join("users").count() == 4
    assert db.query("orders").right_join("users").count() == 4
    assert db.query("orders").full_join("users").count() == 5
    assert db.query("orders").cross_join("users").count() == 12
    assert db.query("orders").natural_join("users").count() == 3  # both have id
    assert db.query("users").join("users", on="id").result_columns()[0] == "users_left.id"
    assert db.query("orders").join("users", on=("user_id", "id"), prefix_columns=False).result_columns()[0] == "id_left"
    assert db.query("users").join("users", on="age", match_nulls=True).count() == 3
    assert db.query("users").join("users", on="age").count() == 2
    with pytest.raises(QueryError):
        db.query("users").join("users")
    with pytest.raises(QueryError):
        db.query("users").cross_join("orders", on="id")
    with pytest.raises(QueryError):
        db.query("users").join("orders", method="sideways")


def test_grouping(db):
    g = db.query("orders").join("users").limit(1).group_by("users.name")
    g = g.aggregate(n=count(), s=sum_("orders.amount"), a=avg("orders.amount"), lo=min_("orders.amount"), hi=max_("orders.amount"))
    assert g.order_by("users.name").to_list() == [
        {"users.name": "Alice", "n": 2, "s": 200.0, "a": 100.0, "lo": 80.0, "hi": 120.0},
        {"users.name": "Bob", "n": 1, "s": 50.0, "a": 50.0, "lo": 50.0, "hi": 50.0},
    ]
    assert g.having(col("n") > 1).pluck("users.name") == ["Alice"]
    assert db.query("users").group_by("age").count() == 3
    with pytest.raises(QueryTypeError):
        db.query("users").group_by("age").aggregate(x=sum_("name"))
    with pytest.raises(QueryError):
        g.aggregate(n=count())


def test_terminals(db):
    q = db.query("users")
    assert q.order_by("age").pluck("age") == [25, 30, None]
    assert q.order_by("age", descending=True).pluck("age") == [30, 25, None]
    assert q.offset(1).limit(1).pluck("name") == ["Bob"]
    assert q.first()["name"] == "Alice" and q.where(col("id") > 9).first() is None
    assert q.where(col("id") == 2).one()["name"] == "Bob"
    with pytest.raises(NoRowsFoundError):
        q.where(col("id") == 9).one()
    with pytest.raises(MultipleRowsFoundError):
        q.one()
    assert q.exists() and not q.where(col("id") == 9).exists()
    assert (q.count(), q.count("age"), q.sum("age"), q.avg("age"), q.min("name"), q.max("age")) == (3, 2, 55, 27.5, "Alice", 30)
    assert [r["name"] for r in q] == ["Alice", "Bob", "Carol"]
    assert q.to_numpy().shape == (3, 3) and q.where(col("id") == 9).to_numpy().shape == (0, 3)
    assert list(q.to_pandas().columns) == ["id", "name", "age"]
    db.insert("users", {"name": "Alice"})
    assert db.query("users").order_by("id").select("name").distinct().limit(2).pluck("name") == ["Alice", "Bob"]
    with pytest.raises(QueryTypeError):
        q.limit(True)


def test_views(db):
    db.create_view("grown", lambda d: d.query("users").where(col("age") >= 28), "old enough")
    assert db.view("grown").pluck("name") == ["Alice"]
    db.insert("users", {"name": "Dan", "age": 40})
    assert db.describe_view("grown")["row_count"] == 2
    assert db.query("orders").join("grown", on=("user_id", "id")).count() == 2
    with pytest.raises(ViewError):
        db.save("/nowhere")
    db.drop_view("grown")
    assert db.list_views() == []
    with pytest.raises(ViewError):
        db.view("grown")


def test_indexes(db):
    assert db.create_index("users", ["name"], unique=True).name == "uidx_users_name"
    with pytest.raises(ConstraintError):
        db.insert("users", {"name": "Bob"})
    with pytest.raises(ConstraintError):
        db.update("users", {"name": "Same"}, allow_all=True)
    assert db.query("users").count() == 3
    assert db.describe_index("uidx_users_name")["key_count"] == 3
    with pytest.raises(ConstraintError):
        db.insert("users", {"name": "E", "age": 1}) and db.create_index("orders", "user_id", unique=True)
    db.drop_index("uidx_users_name")
    assert db.list_indexes() == []


def test_exports(db):
    assert db.to_list("users", "name") == ["Alice", "Bob", "Carol"]
    assert db.to_list("users", where_key={"id": 2})["name"] == "Bob"
    assert db.to_numpy("users", "id").tolist() == [1, 2, 3]
    assert '"name": "Alice"' in db.to_json("users")
    assert db.to_sql("users", where_key={"id": 2}) == 'INSERT INTO "users" ("id", "name", "age") VALUES (2, \'Bob\', NULL);'
    ddl = db.to_ddl(drop_existing=True)
    assert ddl.startswith("BEGIN;") and 'DROP TABLE IF EXISTS "orders" CASCADE;' in ddl and "ON DELETE CASCADE;" in ddl
    assert db.format_table("users", limit=1).splitlines()[0] == "users: 1 of 3 rows"


def test_types_round_trip(spark, tmp_path):
    db = Database(spark)
    db.create_table("t")
    db.add_column("t", "id", int, is_primary_key=True)
    values = {"f": 1.5, "b": True, "y": b"\x00\xff", "d": {"k": [1, None]}, "l": [1, "x"], "at": dt.datetime(2024, 1, 2, 3, 4, 5, 6), "on": dt.date(2024, 1, 2), "t": dt.time(1, 2, 3)}
    for n, v in values.items():
        db.add_column("t", n, type(v))
    db.insert("t", {"id": 1, **values})
    db.insert("t", {"id": 2})
    want = [{"id": 1, **values}, {"id": 2, **dict.fromkeys(values)}]
    assert db.query("t").to_list() == want
    db.save(str(tmp_path / "saved"))
    assert Database.load(str(tmp_path / "saved"), spark=spark).query("t").to_list() == want
    db.save_json(str(tmp_path / "saved.json"))
    assert Database.load_json(str(tmp_path / "saved.json"), spark=spark).query("t").to_list() == want


def test_encryption(spark, tmp_path):
    db = Database(spark)
    db.create_table("u")
    db.add_column("u", "id", AutoNumber, is_primary_key=True)
    db.add_column("u", "mail", str, is_encrypted=True)
    db.add_column("u", "pin", int, is_encrypted=True)
    with pytest.raises(EncryptionError):
        db.insert("u", {"mail": "x"})
    key = Database.generate_encryption_key()
    db.set_encryption_key(key)
    db.insert_many("u", [{"mail": "a@x", "pin": 5}, {"mail": "b@x", "pin": 7}, {}])
    assert db.query("u").pluck("mail") == ["[ENCRYPTED]", "[ENCRYPTED]", None]
    assert db.query("u").to_list(decrypt=True)[0] == {"id": 1, "mail": "a@x", "pin": 5}
    assert db.query("u").where(col("mail") == "b@x").pluck("id") == [2]
    assert db.query("u").where(col("pin") > 5).pluck("id") == [2]
    assert db.query("u").where(~(col("pin") > 5)).pluck("id") == [1, 3]
    assert db.query("u").order_by(("mail", "desc")).pluck("id") == [2, 1, 3]
    db.update("u", {"mail": "c@x"}, where=col("id") == 1)
    assert db.query("u").to_list(decrypt=True)[0]["mail"] == "c@x"
    assert db.query("u").group_by("pin").aggregate(n=count()).count() == 3
    with pytest.raises(EncryptionError):
        db.to_sql("u")
    plan = db.query("u").to_df(decrypt=True)._jdf.queryExecution().toString()
    assert "aes" not in plan.lower() or key not in plan
    db.create_index("u", "mail", unique=True)
    with pytest.raises(ConstraintError):
        db.insert("u", {"mail": "b@x"})
    db.save(str(tmp_path / "e"))
    back = Database.load(str(tmp_path / "e"), encryption_key=key, spark=spark)
    assert back.query("u").where(col("mail") == "b@x").to_list(decrypt=True) == [{"id": 2, "mail": "b@x", "pin": 7}]
    wrong = Database.load(str(tmp_path / "e"), encryption_key=Database.generate_encryption_key(), spark=spark)
    with pytest.raises(Exception, match="EncryptionError"):
        wrong.query("u").to_list(decrypt=True)


def test_insert_df(db, spark):
    df = spark.createDataFrame([("X", 1), ("Y", 2)], "name string, age long")
    assert db.insert_df("users", df) == 2
    assert db.query("users").order_by("id").pluck("id") == [1, 2, 3, 4, 5]
    with pytest.raises(ConstraintError):
        db.insert_df("orders", spark.createDataFrame([(99,)], "user_id long"))
    assert db.insert("users", {"name": "Z"})["id"] == 6
