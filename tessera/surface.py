"""Registered queries of exports, DDL, indexes, schema, encryption and refusals: small results that SQL can state too."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import AND, NOT, OR, AutoNumber, Database, col, count, sum_
from tessera.crypto import plain_json
from tessera.export import quoted, sql_literal
from tessera.joins import method_name
from tessera.queries import _secrets, _shop, query


def table(db: Database, rows: Iterable[Any], schema: str) -> DataFrame:
    return db.spark.createDataFrame([tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows], schema)


def values(rows: Iterable[tuple[str, ...]], *names: str) -> str:
    """SQL that returns the given rows of text."""
    text = ", ".join("(" + ", ".join(sql_literal(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({', '.join(names)})"


def regions(db: Database) -> Database:
    """region(id, name) and nation(id, region_id, name) as declared tables."""
    own = Database(db.spark)
    own.create_table("region")
    own.add_column("region", "id", AutoNumber, is_primary_key=True)
    own.add_column("region", "name", str, nullable=False)
    own.create_table("nation")
    own.add_column("nation", "id", int, is_primary_key=True)
    own.add_column("nation", "region_id", int, references="region.id")
    own.add_column("nation", "name", str, nullable=False, default="it's new")
    own.insert_many("region", [{"name": n} for n in db.query("region").order_by("r_regionkey").pluck("r_name")])
    found = db.query("nation").order_by("n_nationkey").to_list()
    own.insert_many("nation", [{"id": r["n_nationkey"], "region_id": r["n_regionkey"] + 1, "name": r["n_name"]} for r in found])
    return own


def refused(calls: dict[str, Callable[[], Any]]) -> list[tuple[str, str]]:
    """(case, class of the error) of calls that must not go through."""
    out = []
    for case, call in calls.items():
        try:
            call()
            out.append((case, "none"))
        except Exception as e:  # noqa: BLE001
            out.append((case, type(e).__name__))
    return out


REGION = "SELECT r_regionkey::BIGINT + 1 AS id, r_name AS name FROM region"
NATION = "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT + 1 AS region_id, n_name AS name FROM nation"

# exports


@query(REGION)
def export_list(db):
    return table(db, [(r["id"], r["name"]) for r in regions(db).to_list("region")], "id long, name string")


@query("""SELECT '[' || string_agg('{"id": ' || (r_regionkey + 1) || ', "name": "' || r_name || '"}', ', ' ORDER BY r_regionkey) || ']' AS text FROM region""")
def export_json(db):
    return table(db, [regions(db).to_json("region", indent=None)], "text string")


@query(NATION)
def export_pandas(db):
    return db.spark.createDataFrame(regions(db).to_pandas("nation"), "id long, region_id long, name string")


@query("SELECT n_nationkey::BIGINT AS pos, n_name AS name, 3::BIGINT AS width FROM nation")
def export_numpy(db):
    own = regions(db)
    width = own.to_numpy("nation").shape[1]
    return table(db, [(i, str(n), width) for i, n in enumerate(own.to_numpy("nation", "name"))], "pos long, name string, width long")


@query("""SELECT 'INSERT INTO "nation" ("id", "region_id", "name") VALUES (' || n_nationkey || ', ' || (n_regionkey + 1) || ', ''' || n_name || ''');' AS line FROM nation""")
def export_insert(db):
    return table(db, regions(db).to_sql("nation").split("\n"), "line string")


LITERALS = [
    ("null", "NULL"), ("true", "TRUE"), ("int", "-7"), ("float", "1.5"), ("bytes", "X'00ff'"), ("text", "'it''s'"), ("date", "'2024-02-29'"),
    ("datetime", "'2024-02-29T01:02:03'"), ("time", "'01:02:03'"),
]


@query(values(LITERALS, "kind", "text"))
def export_literals(db):
    given = [None, True, -7, 1.5, b"\x00\xff", "it's", dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3), dt.time(1, 2, 3)]
    return table(db, [(k, sql_literal(v)) for (k, _), v in zip(LITERALS, given, strict=True)], "kind string, text string")


@query("""SELECT name, '"' || replace(name, '"', '""') || '"' AS text FROM (SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT 'a"b')""")
def export_identifiers(db):
    names = [*db.query("part").distinct().pluck("p_type"), 'a"b']
    return table(db, [(n, quoted(n)) for n in names], "name string, text string")


DDL_REGION = ['CREATE TABLE "region" (', '  "id" INTEGER NOT NULL GENERATED BY DEFAULT AS IDENTITY,', '  "name" TEXT NOT NULL,', '  CONSTRAINT "pk_region" PRIMARY KEY ("id")', ");"]
DDL_NATION = ['CREATE TABLE "nation" (', '  "id" INTEGER NOT NULL,', '  "region_id" INTEGER,', """  "name" TEXT NOT NULL DEFAULT 'it''s new',""", '  CONSTRAINT "pk_nation" PRIMARY KEY ("id")', ");"]
DDL = ["BEGIN;", *DDL_REGION, *DDL_NATION, 'ALTER TABLE "nation" ADD CONSTRAINT "fk_nation_region_id" FOREIGN KEY ("region_id") REFERENCES "region" ("id") ON DELETE RESTRICT;', "COMMIT;"]


def numbered(lines: list[str]) -> str:
    return values([(f"{i:03}", x) for i, x in enumerate(lines)], "pos", "line")


def lines(db: Database, text: str) -> DataFrame:
    return table(db, [(f"{i:03}", x) for i, x in enumerate(text.split("\n"))], "pos string, line string")


@query(numbered(DDL))
def ddl_database(db):
    return lines(db, regions(db).to_ddl())


@query(numbered(DDL_NATION))
def ddl_table(db):
    return lines(db, regions(db).table_to_ddl("nation"))


@query(numbered(['DROP TABLE IF EXISTS "nation" CASCADE;', 'DROP TABLE IF EXISTS "region" CASCADE;', """COMMENT ON COLUMN "region"."id" IS 'type=AutoNumber';""", "refused: SchemaError"]))
def ddl_pieces(db):
    own = regions(db)
    text = own.to_ddl(include_transaction=False, drop_existing=True, include_metadata_comments=True).split("\n")
    found = [x for x in text if x.startswith(("DROP", "COMMENT"))]
    return lines(db, "\n".join([*found, *(f"refused: {e}" for _, e in refused({"dialect": lambda: own.to_ddl("oracle")}))]))


@query("""SELECT '000' AS pos, 'region: 2 of ' || count(*) || ' rows' AS line FROM region UNION ALL SELECT '001', 'id         | name' UNION ALL SELECT '002', 'AutoNumber | str'
UNION ALL SELECT '003', '-----------+-' || repeat('-', greatest(4, max(length(r_name)))::INT) FROM region WHERE r_regionkey < 2
UNION ALL SELECT '00' || (r_regionkey + 4), rpad((r_regionkey + 1)::VARCHAR, 10, ' ') || ' | ' || r_name FROM region WHERE r_regionkey < 2""")
def export_print(db):
    return lines(db, regions(db).format_table("region", limit=2))


FORMS = "(VALUES ('json'), ('list'), ('numpy'), ('pandas')) AS f(form)"


def _forms(db: Database, q: Any, name: str) -> DataFrame:
    names = q.result_columns()
    found = {
        "list": [r[name] for r in q.to_list()], "json": [r[name] for r in json.loads(q.to_json())], "pandas": q.to_pandas()[name].tolist(),
        "numpy": [r[names.index(name)] for r in q.to_numpy().tolist()],
    }
    return table(db, [(k, int(x)) for k, xs in found.items() for x in xs], "form string, x long")


@query(f"SELECT form, n_nationkey::BIGINT AS x FROM nation, {FORMS} WHERE n_regionkey = 2")
def query_exports(db):
    return _forms(db, regions(db).query("nation").where(col("region_id") == 3), "id")


@query(f"SELECT form, count(*) AS x FROM nation, {FORMS} GROUP BY form, n_regionkey")
def grouped_exports(db):
    return _forms(db, regions(db).query("nation").group_by("region_id").aggregate(n=count()), "n")


JSON_TEXT = '[{"id": 1, "data": {"__type__": "bytes", "encoding": "base64", "value": "AAEC"}, "at": "2024-02-29T01:02:03", "day": "2024-02-29", "time": "01:02:03.000004", "more": {"a": [1, null]}}]'


@query(values([("table", JSON_TEXT), ("query", JSON_TEXT)], "form", "text"))
def export_json_types(db):
    own = Database(db.spark)
    own.create_table("t")
    for n, kind in (("id", int), ("data", bytes), ("at", dt.datetime), ("day", dt.date), ("time", dt.time), ("more", dict)):
        own.add_column("t", n, kind, is_primary_key=n == "id")
    own.insert("t", {"id": 1, "data": b"\0\1\2", "at": dt.datetime(2024, 2, 29, 1, 2, 3), "day": dt.date(2024, 2, 29), "time": dt.time(1, 2, 3, 4), "more": {"a": [1, None]}})
    return table(db, [("table", own.to_json("t", indent=None)), ("query", own.query("t").to_json(indent=None))], "form string, text string")


@query(NATION)
def save_load_json(db):
    own = regions(db)
    path = f"{own.shared_dir()}/saved-{id(own)}.json"
    own.save_json(path)
    return Database.load_json(path, spark=db.spark).query("nation").to_df()


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS nation_id, c_acctbal AS balance FROM customer WHERE c_custkey IN (7, 77)")
def point_lookup(db):
    """Two rows by their key, from a table whose files are sorted by it."""
    own = _shop(db)
    rows = [own.to_list("customer", where_key={"id": k}) for k in (7, 77)]
    return table(db, [(r["id"], r["nation_id"], r["balance"]) for r in rows], "id long, nation_id long, balance double")


@query(values([("absent", "NoRowsFoundError"), ("column", "ColumnNotFoundError"), ("decrypt", "TesseraTypeError"), ("not the key", "TesseraValueError"), ("type", "TesseraTypeError")], "kind", "error"))
def export_refusals(db):
    own = regions(db)
    return table(db, refused({
        "absent": lambda: own.to_list("region", where_key={"id": 99}), "column": lambda: own.to_list("region", "zip"), "decrypt": lambda: own.to_list("region", decrypt=1),
        "not the key": lambda: own.to_list("region", where_key={"name": "x"}), "type": lambda: own.to_list("region", where_key={"id": "1"}),
    }), "kind string, error string")


# queries


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
def pluck(db):
    return table(db, db.query("nation").where(col("n_regionkey") == 1).pluck("n_name"), "name string")


@query("SELECT count(*) AS n FROM nation GROUP BY n_regionkey")
def pluck_grouped(db):
    return table(db, db.query("nation").group_by("n_regionkey").aggregate(n=count()).pluck("n"), "n long")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '1-URGENT'")
def where_functions(db):
    condition = AND(OR(col("o_orderstatus") == "F", col("o_totalprice") > 300000.0), NOT(col("o_orderpriority") == "1-URGENT"))
    return db.query("orders").where(condition).select("o_orderkey").to_df()


@query(values([("and", "QueryTypeError"), ("not", "QueryTypeError"), ("or", "QueryTypeError")], "kind", "error"))
def where_guard(db):
    a, b = col("x") == 1, col("y") == 2
    return table(db, refused({"and": lambda: a and b, "or": lambda: a or b, "not": lambda: not a}), "kind string, error string")


METHODS = [("INNER", "inner"), ("Left Outer", "left"), ("right-join", "right"), ("full_outer_join", "full"), ("outer", "full"), (" cross join ", "cross"), ("natural", "natural"), ("regular", "inner")]


@query(values([*METHODS, ("sideways", "QueryError")], "given", "method"))
def join_methods(db):
    return table(db, [*((m, method_name(m)) for m, _ in METHODS), *refused({"sideways": lambda: method_name("sideways")})], "given string, method string")


@query(values([("both", "QueryError"), ("length", "QueryError"), ("no key", "QueryError"), ("one side", "QueryError"), ("unknown left", "ColumnNotFoundError"), ("unknown right", "ColumnNotFoundError")], "kind", "error"))
def join_refusals(db):
    q = db.query("nation")
    return table(db, refused({
        "unknown left": lambda: q.join("region", on=("zip", "r_regionkey")), "unknown right": lambda: q.join("region", on=("n_regionkey", "zip")),
        "both": lambda: q.join("region", on="x", left_on="y"), "one side": lambda: q.join("region", left_on="n_regionkey"),
        "length": lambda: q.join("region", left_on=["n_regionkey", "n_name"], right_on=["r_regionkey"]), "no key": lambda: db.query("part").join("events"),
    }), "kind string, error string")


@query(values([("avg", "QueryTypeError"), ("scalar", "QueryTypeError"), ("sum", "QueryTypeError")], "kind", "error"))
def group_guard(db):
    q = db.query("nation")
    return table(db, refused({
        "sum": lambda: q.group_by("n_regionkey").aggregate(x=sum_("n_name")), "avg": lambda: q.average("n_name"), "scalar": lambda: q.sum("n_name"),
    }), "kind string, error string")


@query("""SELECT 'all' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'different', count(DISTINCT l_shipdate) FROM lineitem UNION ALL SELECT 'groups', count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'known', count(l_quantity) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def query_counts(db):
    q, outer = db.query("lineitem"), db.query("orders").left_join("lineitem", on=("o_orderkey", "l_orderkey"))
    rows = [("all", q.count()), ("different", q.distinct().count("l_shipdate")), ("groups", q.group_by("l_returnflag").count()), ("known", outer.count("lineitem.l_quantity"))]
    return table(db, rows, "kind string, n long")


@query("""SELECT 'first' AS kind, n_name AS name FROM nation WHERE n_nationkey = 24 UNION ALL SELECT 'one', n_name FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'each', n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'none', 'NoRowsFoundError' UNION ALL SELECT 'many', 'MultipleRowsFoundError'""")
def first_one_each(db):
    q = db.query("nation")
    rows = [("first", q.order_by("n_nationkey", descending=True).first()["n_name"]), ("one", q.where(col("n_nationkey") == 3).one()["n_name"])]
    rows += [("each", r["n_name"]) for r in q.where(col("n_regionkey") == 0)]
    return table(db, rows + refused({"none": lambda: q.where(col("n_nationkey") == 99).one(), "many": q.one}), "kind string, name string")


@query("SELECT r_regionkey::BIGINT AS k, r_name AS name FROM region WHERE r_regionkey > 1")
def from_rows(db):
    rows = [{"k": r["r_regionkey"], "name": r["r_name"]} for r in db.query("region").to_list()]
    return db.from_rows("given", rows, ["k", "name"]).where(col("k") > 1).to_df()


# changes


@query("SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT + 1 AS region_id, CASE WHEN n_name LIKE 'A%' THEN 'changed' ELSE n_name END AS name FROM nation WHERE n_nationkey % 5 <> 0")
def change_by_callable(db):
    own = regions(db)
    own.update("nation", {"name": "changed"}, where=lambda r: r["name"].startswith("A"))
    own.delete("nation", where=lambda r: r["id"] % 5 == 0)
    return own.query("nation").to_df()


CHANGES = [
    ("column", "ColumnNotFoundError"), ("delete all", "QueryError"), ("delete restricted", "ConstraintError"), ("foreign key", "ConstraintError"), ("key twice", "ConstraintError"),
    ("null", "ConstraintError"), ("null key", "ConstraintError"), ("row", "TesseraTypeError"), ("rows", "TesseraTypeError"), ("type", "TesseraTypeError"), ("update all", "QueryError"), ("update key", "ConstraintError"),
]


@query(values(CHANGES, "kind", "error") + " UNION ALL SELECT 'rows left', (SELECT count(*) FROM nation)::VARCHAR")
def change_refusals(db):
    own = regions(db)
    found = refused({
        "column": lambda: own.insert("region", {"zip": 1}), "null": lambda: own.insert("region", {"name": None}), "type": lambda: own.insert("nation", {"id": "1"}), "row": lambda: own.insert("nation", [1]),
        "rows": lambda: own.insert_many("nation", "x"), "key twice": lambda: own.insert("nation", {"id": 3}), "null key": lambda: own.insert("nation", {"id": None}),
        "foreign key": lambda: own.insert("nation", {"id": 900, "region_id": 77}), "update all": lambda: own.update("nation", {"name": "x"}), "update key": lambda: own.update("nation", {"id": 1}, allow_all=True),
        "delete all": lambda: own.delete("nation"), "delete restricted": lambda: own.delete("region", where=col("id") == 1),
    })
    return table(db, [*found, ("rows left", str(own.query("nation").count()))], "kind string, error string")


@query(values([("first", '{"tags":["a","b"]}'), ("second", '{"tags":["a"]}')], "kind", "text"))
def default_clone(db):
    """A default is copied for each row: changing what one insert returned changes nothing else."""
    own = Database(db.spark)
    own.create_table("t")
    own.add_column("t", "id", AutoNumber, is_primary_key=True)
    own.add_column("t", "held", dict, default={"tags": ["a"]})
    row = own.insert("t", {})
    row["held"]["tags"].append("b")
    again = own.insert("t", {})
    return table(db, [(k, json.dumps(r["held"], separators=(",", ":"))) for k, r in (("first", row), ("second", again))], "kind string, text string")


# schema, views, indexes


@query("SELECT l_orderkey, max(l_linenumber)::INT AS top FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber)")
def set_primary_key(db):
    """A composite key on the orders whose lines are unique; of the others it is refused."""
    own = Database(db.spark)
    own.create_table("line")
    own.add_column("line", "order_id", int, nullable=False)
    own.add_column("line", "number", int, nullable=False)
    lines_ = db.frame("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("number"))
    own.insert_df("line", lines_)
    assert refused({"key": lambda: own.set_primary_key("line", ["order_id", "number"])}) == [("key", "ConstraintError")]
    twice = lines_.groupBy("order_id", "number").count().where("count > 1").select("order_id").distinct()
    fine = Database(db.spark)
    fine.create_table("line")
    fine.add_column("line", "order_id", int, nullable=False)
    fine.add_column("line", "number", int, nullable=False)
    fine.insert_df("line", lines_.join(twice, "order_id", "left_anti"))
    fine.set_primary_key("line", ["order_id", "number"])
    return fine.frame("line").groupBy(F.col("order_id").alias("l_orderkey")).agg(F.max("number").cast("int").alias("top"))


DESCRIBED = [("nation", "id", "int", "false", "true", "none"), ("nation", "name", "str", "false", "false", "it's new"), ("nation", "region_id", "int", "true", "false", "none"), ("region", "id", "AutoNumber", "false", "true", "none"), ("region", "name", "str", "false", "false", "none")]


@query(f"SELECT t.*, CASE tab WHEN 'nation' THEN (SELECT count(*) FROM nation) ELSE (SELECT count(*) FROM region) END AS n FROM ({values(DESCRIBED, 'tab', 'name', 'kind', 'nullable', 'is_key', 'held')}) t")
def describe_schema(db):
    own = regions(db)
    rows = [
        (t, n, d["type"], str(d["nullable"]).lower(), str(d["is_primary_key"]).lower(), d["default"] if d["has_default"] else "none", x["row_count"])
        for t, x in own.describe_schema().items() for n, d in x["columns"].items()
    ]
    return table(db, rows, "tab string, name string, kind string, nullable string, is_key string, held string, n long")


@query("SELECT 'big' AS name, 'n_name,n_regionkey' AS columns, (SELECT count(*) FROM nation WHERE n_regionkey > 2) AS n UNION ALL SELECT 'left', 'big', 1 UNION ALL SELECT 'gone', 'ViewError', 0")
def describe_views(db):
    db.create_view("big", lambda d: d.query("nation").where(col("n_regionkey") > 2).select("n_name", "n_regionkey"), "late regions")
    db.create_view("other", lambda d: d.query("region"))
    db.drop_view("other")
    rows = [(n, ",".join(v["columns"]), v["row_count"]) for n, v in db.describe_views().items()]
    rows += [("left", ",".join(db.list_views()), 1), ("gone", refused({"v": lambda: db.view("other")})[0][1], 0)]
    return table(db, rows, "name string, columns string, n long")


INDEXED = """SELECT 'idx_nation_region_id' AS name, 'region_id' AS columns, count(DISTINCT n_regionkey) AS keys, count(*) AS n FROM nation
UNION ALL SELECT 'uidx_nation_name', 'name', count(DISTINCT n_name), count(*) FROM nation"""


def _indexed(db: Database) -> Database:
    own = regions(db)
    own.create_index("nation", "region_id")
    own.create_index("nation", ["name"], unique=True)
    return own


def _described(db: Database, own: Database) -> DataFrame:
    return table(db, [(n, ",".join(i["columns"]), i["key_count"], i["row_id_count"]) for n, i in own.describe_indexes().items()], "name string, columns string, keys long, n long")


@query(INDEXED)
def index_describe(db):
    return _described(db, _indexed(db))


@query("""SELECT 'idx_nation_region_id' AS name, 'region_id' AS columns, count(DISTINCT n_regionkey) AS keys, count(*) + 1 AS n FROM nation WHERE n_regionkey <> 4
UNION ALL SELECT 'uidx_nation_name', 'name', count(DISTINCT n_name) + 1, count(*) + 1 FROM nation WHERE n_regionkey <> 4""")
def index_maintained(db):
    own = _indexed(db)
    own.insert("nation", {"id": 100, "region_id": 1, "name": "ATLANTIS"})
    own.delete("nation", where=col("region_id") == 5)
    return _described(db, own)


@query(values([("again", "SchemaError"), ("column", "ColumnNotFoundError"), ("insert", "ConstraintError"), ("rows", "ConstraintError"), ("unknown", "SchemaError"), ("update", "ConstraintError")], "kind", "error") + " UNION ALL SELECT 'left', 'uidx_nation_name'")
def index_refusals(db):
    own = _indexed(db)
    found = refused({
        "insert": lambda: own.insert("nation", {"id": 100, "name": own.query("nation").first()["name"]}), "update": lambda: own.update("nation", {"name": "x"}, allow_all=True), "again": lambda: own.create_index("nation", "region_id"),
        "rows": lambda: own.create_index("nation", "region_id", name="u", unique=True), "column": lambda: own.create_index("nation", "zip"), "unknown": lambda: own.drop_index("u"),
    })
    own.drop_index("idx_nation_region_id")
    return table(db, [*found, ("left", ",".join(own.list_indexes("nation")))], "kind string, error string")


# encryption


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_name LIKE '%7'")
def enc_like(db):
    return _secrets(db).query("supplier").where(col("name").like("%7")).to_df(decrypt=True)


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier ORDER BY s_name DESC, s_suppkey LIMIT 10")
def enc_order(db):
    return _secrets(db).query("supplier").order_by(("name", "desc"), "id").limit(10).to_df(decrypt=True)


@query("SELECT s_name AS name, count(*) AS n FROM supplier GROUP BY s_name")
def enc_group(db):
    return _secrets(db).query("supplier").group_by("name").aggregate(n=count()).to_df()


CANONICAL = [("bool", '{"type":"bool","value":true}'), ("bytes", '{"type":"bytes","value":"AAE="}'), ("dict", '{"type":"dict","value":{"a":1,"b":"é"}}'), ("int", '{"type":"int","value":7}'), ("str", '{"type":"str","value":"it\'s"}')]


@query(values(CANONICAL, "kind", "text"))
def enc_canonical(db):
    given = {"bool": (True, bool), "bytes": (b"\0\1", bytes), "dict": ({"b": "é", "a": 1}, dict), "int": (7, int), "str": ("it's", str)}
    return table(db, [(k, plain_json(*v)) for k, v in given.items()], "kind string, text string")


@query("""SELECT 'algorithms' AS kind, 1::BIGINT AS n UNION ALL SELECT 'blind', count(DISTINCT s_name) FROM supplier UNION ALL SELECT 'tokens', count(*) FROM supplier
UNION ALL SELECT 'index length', 64 UNION ALL SELECT 'key length', 44 UNION ALL SELECT 'key set', 1 UNION ALL SELECT 'key unset', 0""")
def enc_stored(db):
    """Equal values share a blind index, but no two tokens are alike."""
    own = _secrets(db)
    s = F.col("name")
    found = own.frame("supplier").agg(F.countDistinct(s["algorithm"]), F.countDistinct(s["blind_index"]), F.countDistinct(s["ciphertext"]), F.max(F.length(s["blind_index"]))).first()
    rows = [*zip(("algorithms", "blind", "tokens", "index length"), found, strict=True), ("key length", len(Database.generate_encryption_key()))]
    return table(db, [*rows, ("key set", int(own.has_encryption_key())), ("key unset", int(Database(db.spark).has_encryption_key()))], "kind string, n long")


@query(values([("bad key", "EncryptionError"), ("export", "EncryptionError"), ("no key", "EncryptionError")], "kind", "error"))
def enc_refusals(db):
    own = _secrets(db)
    bare = Database(db.spark)
    bare.create_table("t")
    bare.add_column("t", "id", int, is_primary_key=True)
    bare.add_column("t", "x", str, is_encrypted=True)
    return table(db, refused({"bad key": lambda: own.set_encryption_key("short"), "export": lambda: own.to_sql("supplier"), "no key": lambda: bare.insert("t", {"id": 1, "x": "y"})}), "kind string, error string")


# index scans


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS nation_id, c_acctbal AS balance FROM customer WHERE c_nationkey IN (3, 7) AND c_acctbal > 0")
def index_scan(db):
    """Equality on the whole index; the other condition is checked on what the index leaves."""
    own = _shop(db)
    own.create_index("customer", "nation_id")
    q = own.query("customer").where(col("nation_id").in_([3, 7]) & (col("balance") > 0.0)).to_df()
    assert set(q.inputFiles()) == set(own.copies["idx_customer_nation_id"].inputFiles())
    return q


@query("SELECT o_orderkey AS id, o_custkey AS customer_id FROM orders WHERE o_custkey = 42")
def index_prefix(db):
    """Equality on the first column of an index of two."""
    own = _shop(db)
    own.create_index("orders", ["customer_id", "id"], unique=True)
    q = own.query("orders").where(col("customer_id") == 42).to_df()
    assert set(q.inputFiles()) == set(own.copies["uidx_orders_customer_id_id"].inputFiles())
    return q


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 3 THEN NULL ELSE o_custkey END AS customer_id FROM orders")
def update_indexed(db):
    """An indexed table goes on giving the right rows after a change."""
    own = _shop(db)
    own.create_index("orders", "customer_id")
    hit = [r["id"] for r in own.query("customer").where(lambda r: r["id"] % 10 == 3)]
    own.update("orders", {"customer_id": None}, where=col("customer_id").in_(hit))
    assert own.query("orders").where(col("customer_id") == hit[0]).count() == 0
    return own.query("orders").to_df()


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_name IN (SELECT s_name FROM supplier WHERE s_suppkey IN (3, 5))")
def enc_index(db):
    """Equality on an encrypted column through an index, whose copy is sorted by the blind index."""
    own = _secrets(db)
    own.create_index("supplier", "name")
    names = db.query("supplier").where(col("s_suppkey").in_([3, 5])).pluck("s_name")
    q = own.query("supplier").where(col("name").in_(names))
    assert set(q.to_df().inputFiles()) == set(own.copies["idx_supplier_name"].inputFiles())
    return q.to_df(decrypt=True)
