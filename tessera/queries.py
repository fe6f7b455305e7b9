"""Registered queries of the relational engine over the star-schema tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import AutoNumber, Database, Query, avg, col, count, max_, min_, sum_

TABLES = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region.r_regionkey"}),
    "customer": ("c_custkey", {"c_nationkey": "nation.n_nationkey"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation.n_nationkey"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer.c_custkey"}),
    "lineitem": ((), {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"}),
    "events": ("event_id", {}),
    "documents": ("doc_id", {}),
    "labels": ((), {"doc_id": "documents.doc_id"}),
}


_STARS: dict[tuple[str, str], Database] = {}


def star(spark: SparkSession, sf_dir: str) -> Database:
    """The tables, with a month and a net price that the builder has no functions for.

    File listings and schemas are read once for each application and folder; every caller gets a database of its own.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STARS:
        db = Database(spark)
        for name, (pk, fks) in TABLES.items():
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if name == "orders":
                df = df.withColumn("o_month", F.date_format("o_orderdate", "yyyy-MM"))
            if name == "lineitem":
                df = df.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
            db.register_table(name, df, list(pk) if isinstance(pk, tuple) else pk, fks)
        _STARS[key] = db
    db = Database(spark)
    db.schema, db.state = dict(_STARS[key].schema), dict(_STARS[key].state)
    return db


def plain(df: DataFrame) -> DataFrame:
    """Dots in names become underscores."""
    return df.toDF(*[n.replace(".", "_") for n in df.columns])


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def keep(f: Callable[[Database], DataFrame]) -> Callable:
        FOUND[f.__name__] = lambda spark, sf_dir: f(star(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


L = "WITH l AS (SELECT o.*, l.* FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey)"


def _outer(db: Database) -> Query:
    """Orders with their line items; orders without any have nulls."""
    return db.query("orders").left_join("lineitem", prefix_columns=False)


def _pair(q: Query) -> DataFrame:
    return q.select("o_orderkey", "l_quantity").to_df()


# filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def where_eq(db):
    return db.query("orders").where(col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice").to_df()


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE l_returnflag IS DISTINCT FROM 'N'")
def where_ne(db):
    return _pair(_outer(db).where(col("l_returnflag") != "N"))


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE l_quantity >= 45 AND o_totalprice < 100000")
def where_cmp(db):
    return _pair(_outer(db).where(col("l_quantity") >= 45).where(col("o_totalprice") < 100000.0))


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE NOT coalesce((l_quantity > 10 AND l_returnflag = 'R') OR o_orderstatus = 'O', false)")
def where_and_or_not(db):
    return _pair(_outer(db).where(~(((col("l_quantity") > 10) & (col("l_returnflag") == "R")) | (col("o_orderstatus") == "O"))))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
def where_like(db):
    return db.query("part").where(col("p_name").like("%a_e%")).select("p_partkey", "p_name").to_df()


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_E%'")
def where_ilike(db):
    return db.query("part").where(col("p_name").like("%A_E%", case_sensitive=False)).select("p_partkey", "p_name").to_df()


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE l_returnflag IN ('A', 'R') OR l_returnflag IS NULL")
def where_in(db):
    return _pair(_outer(db).where(col("l_returnflag").in_(["A", "R", None])))


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE l_quantity BETWEEN 10 AND 12")
def where_between(db):
    return _pair(_outer(db).where(col("l_quantity").between(10, 12)))


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE NOT coalesce(l_quantity > 10 AND l_quantity < 40, false)")
def where_between_exclusive(db):
    return _pair(_outer(db).where(~col("l_quantity").between(10, 40, inclusive=False)))


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE l_quantity IS NULL")
def where_null(db):
    return _pair(_outer(db).where(col("l_quantity").is_null()))


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE l_quantity IS NOT NULL AND l_quantity < 3")
def where_not_null(db):
    return _pair(_outer(db).where(col("l_quantity").is_not_null() & (col("l_quantity") < 3)))


@query(f"{L} SELECT o_orderkey, l_quantity FROM l WHERE NOT coalesce(l_quantity > 5, false)")
def where_not_gt_null(db):
    return _pair(_outer(db).where(~(col("l_quantity") > 5)))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_custkey % 7 = 0")
def where_callable(db):
    return db.query("customer").where(lambda r: r["c_acctbal"] > 0 and r["c_custkey"] % 7 == 0).select("c_custkey", "c_name").to_df()


# order, slice, distinct


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def select_order_limit(db):
    return db.query("orders").order_by(("o_totalprice", "desc"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25).to_df()


@query(f"""{L}, p AS (SELECT *, row_number() OVER (ORDER BY l_quantity DESC NULLS LAST, o_orderkey, l_linenumber NULLS LAST, l_partkey NULLS LAST) AS pos, greatest(count(l_quantity) OVER () - 150, 0) AS skipped FROM l)
SELECT o_orderkey, l_linenumber, l_quantity FROM p WHERE pos > skipped AND pos <= skipped + 300""")
def order_multi_nulls_last(db):
    """A page on both sides of the place where the missing values begin, whatever the size."""
    q = _outer(db).order_by(("l_quantity", "desc"), "o_orderkey", "l_linenumber", "l_partkey")
    return q.select("o_orderkey", "l_linenumber", "l_quantity").offset(max(0, q.count("l_quantity") - 150)).limit(300).to_df()


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def offset_page(db):
    return db.query("customer").order_by("c_name", "c_custkey").offset(40).limit(20).select("c_custkey", "c_name").to_df()


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_one(db):
    return db.query("customer").select("c_mktsegment").distinct().to_df()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_multi(db):
    return db.query("orders").select("o_orderstatus", "o_orderpriority").distinct().to_df()


@query("SELECT o_orderpriority FROM (SELECT o_orderpriority, min(o_totalprice) AS m FROM orders GROUP BY 1 ORDER BY m LIMIT 3)")
def distinct_order_hidden(db):
    return db.query("orders").order_by("o_totalprice").select("o_orderpriority").distinct().limit(3).to_df()


# joins


@query("SELECT o_orderkey AS orders_o_orderkey, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(db):
    return plain(db.query("orders").join("customer").select("orders.o_orderkey", "customer.c_name").to_df())


@query("SELECT o_orderkey AS orders_o_orderkey, l_linenumber AS lineitem_l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def join_left(db):
    return plain(db.query("orders").left_join("lineitem").select("orders.o_orderkey", "lineitem.l_linenumber").to_df())


@query("SELECT l_linenumber AS lineitem_l_linenumber, o_orderkey AS orders_o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey")
def join_right(db):
    return plain(db.query("lineitem").right_join("orders").select("lineitem.l_linenumber", "orders.o_orderkey").to_df())


@query("SELECT s.s_suppkey AS supplier_s_suppkey, c.c_custkey AS customer_c_custkey FROM supplier s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s.s_suppkey = c.c_custkey")
def join_full(db):
    rich = db.query("customer").where(col("c_acctbal") > 9000.0)
    return plain(db.query("supplier").full_join(rich, on=("s_suppkey", "c_custkey")).select("supplier.s_suppkey", "customer.c_custkey").to_df())


@query("SELECT r_name AS region_r_name, n_name AS nation_n_name FROM region CROSS JOIN nation")
def join_cross(db):
    return plain(db.query("region").cross_join("nation").select("region.r_name", "nation.n_name").to_df())


@query("SELECT d.doc_id AS documents_doc_id, l.quality AS labels_quality FROM documents d JOIN labels l USING (doc_id)")
def join_natural(db):
    return plain(db.query("documents").natural_join("labels").select("documents.doc_id", "labels.quality").to_df())


@query("SELECT a.n_name AS nation_left_n_name, b.n_name AS nation_right_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(db):
    return plain(db.query("nation").join("nation", on="n_regionkey").select("nation_left.n_name", "nation_right.n_name").to_df())


@query("SELECT s_suppkey AS supplier_s_suppkey, c_custkey AS customer_c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def join_multi_key(db):
    q = db.query("supplier").join("customer", left_on=["s_nationkey", "s_suppkey"], right_on=["c_nationkey", "c_custkey"])
    return plain(q.select("supplier.s_suppkey", "customer.c_custkey").to_df())


@query(f"{L}, f AS (SELECT DISTINCT l_returnflag FROM l) SELECT o_orderkey, f.l_returnflag AS flag FROM l JOIN f ON l.l_returnflag IS NOT DISTINCT FROM f.l_returnflag")
def join_match_nulls(db):
    flags = _outer(db).select("l_returnflag").distinct()
    q = _outer(db).join(flags, on="l_returnflag", match_nulls=True, left_prefix="l", right_prefix="f")
    return q.select("l.o_orderkey", "f.l_returnflag").to_df().toDF("o_orderkey", "flag")


@query("SELECT l_linenumber AS line, o_orderkey, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def join_fk_chain(db):
    q = db.query("lineitem").join("orders").join("customer").join("nation").join("region").where(col("region.r_name") == "ASIA")
    names = ["lineitem.l_linenumber", "orders.o_orderkey", "customer.c_name", "nation.n_name", "region.r_name"]
    return q.select(names).to_df().toDF("line", "o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey AS orders_o_orderkey, c_name AS customer_c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_query_side(db):
    top = db.query("orders").order_by(("o_totalprice", "desc"), "o_orderkey").limit(50)
    return plain(top.join(db.query("customer").where(col("c_acctbal") > 0.0)).select("orders.o_orderkey", "customer.c_name").to_df())


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_unprefixed(db):
    q = db.query("orders").join("customer", prefix_columns=False).where(col("c_mktsegment") == "BUILDING")
    return q.select("o_orderkey", "c_name").to_df()


# groups


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def group_count(db):
    return db.query("orders").group_by("o_orderstatus").aggregate(n=count()).to_df()


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_linenumber) AS least, max(l_linenumber) AS most, count(l_tax) AS n FROM lineitem GROUP BY 1, 2")
def group_sum_avg_min_max(db):
    g = db.query("lineitem").group_by("l_returnflag", "l_linestatus")
    specs = {"qty": sum_("l_quantity"), "price": avg("l_extendedprice"), "least": min_("l_linenumber"), "most": max_("l_linenumber"), "n": count("l_tax")}
    return rounded(g.aggregate(**specs).to_df(), "qty", "price")


@query(f"{L} SELECT l_returnflag, o_orderpriority, count(*) AS n, count(l_quantity) AS m FROM l GROUP BY 1, 2")
def group_multi(db):
    return _outer(db).group_by("l_returnflag", "o_orderpriority").aggregate(n=count(), m=count("l_quantity")).to_df()


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 12 AND NOT sum(o_totalprice) > 4000000 ORDER BY n DESC, o_custkey LIMIT 30")
def group_having(db):
    g = db.query("orders").group_by("o_custkey").aggregate(n=count(), total=sum_("o_totalprice"))
    g = g.having(col("n") > 12).having(~(col("total") > 4000000)).order_by(("n", "desc"), "o_custkey").limit(30)
    return rounded(g.to_df(), "total")


@query("SELECT DISTINCT l_shipmode_ AS l_returnflag FROM (SELECT l_returnflag AS l_shipmode_ FROM lineitem)")
def group_no_agg(db):
    return db.query("lineitem").group_by("l_returnflag").to_df()


@query("SELECT DISTINCT n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)")
def group_distinct(db):
    return db.query("customer").group_by("c_nationkey", "c_mktsegment").aggregate(n=count()).select("n").distinct().to_df()


# scalars


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def agg_count(db):
    q = db.query("orders").where(col("o_orderstatus") == "F")
    return q.to_df().agg(F.count(F.lit(1)).alias("n"))


@query(f"{L} SELECT count(l_quantity) AS n FROM l")
def agg_count_col(db):
    return _outer(db).scalar_df("count", "l_quantity", "n")


@query("SELECT round(sum(l_quantity), 2) AS x FROM lineitem")
def agg_sum(db):
    return rounded(db.query("lineitem").scalar_df("sum", "l_quantity", "x"), "x")


@query("SELECT round(sum(DISTINCT l_quantity), 2) AS x FROM lineitem")
def agg_sum_distinct(db):
    return rounded(db.query("lineitem").distinct().scalar_df("sum", "l_quantity", "x"), "x")


@query("SELECT round(avg(o_totalprice), 4) AS x FROM orders")
def agg_avg(db):
    return rounded(db.query("orders").scalar_df("avg", "o_totalprice", "x"), "x", digits=4)


@query("SELECT min(p_name) AS x FROM part")
def agg_min(db):
    return db.query("part").scalar_df("min", "p_name", "x")


@query("SELECT max(o_orderdate) AS x FROM orders")
def agg_max(db):
    return db.query("orders").scalar_df("max", "o_orderdate", "x")


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 400000")
def exists(db):
    return db.spark.createDataFrame([(db.query("orders").where(col("o_totalprice") > 400000.0).exists(),)], "found boolean")


# views


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 5000")
def view_simple(db):
    db.create_view("cars", lambda d: d.query("customer").where(col("c_mktsegment") == "AUTOMOBILE"))
    return db.view("cars").where(col("c_acctbal") > 5000.0).select("c_custkey", "c_name").to_df()


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n >= 15")
def view_grouped(db):
    db.create_view("busy", lambda d: d.query("orders").group_by("o_custkey").aggregate(n=count()))
    return db.view("busy").where(col("n") >= 15).to_df()


# changes (on tables of their own, filled from the star schema)


def _shop(db: Database) -> Database:
    own = Database(db.spark)
    own.create_table("nation")
    own.add_column("nation", "id", int, is_primary_key=True)
    own.add_column("nation", "name", str, nullable=False)
    own.create_table("customer")
    own.add_column("customer", "id", int, is_primary_key=True)
    own.add_column("customer", "nation_id", int, references="nation.id", on_delete="cascade")
    own.add_column("customer", "balance", float, default=0.0)
    own.create_table("orders")
    own.add_column("orders", "id", int, is_primary_key=True)
    own.add_column("orders", "customer_id", int, references="customer.id", on_delete="set null")
    frames = {n: db.query(n).to_df() for n in ("nation", "customer", "orders")}
    own.insert_df("nation", frames["nation"].select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    own.insert_df("customer", frames["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation_id"), F.col("c_acctbal").alias("balance")))
    own.insert_df("orders", frames["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id")))
    return own


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS nation_id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer")
def update_set(db):
    own = _shop(db)
    own.update("customer", {"balance": 0.0}, where=col("balance") < 0.0)
    return own.query("customer").to_df()


@query("SELECT o_orderkey AS id, o_custkey AS customer_id FROM orders WHERE NOT o_custkey < 500")
def delete_where(db):
    own = _shop(db)
    own.delete("orders", where=col("customer_id") < 500)
    return own.query("orders").to_df()


@query("SELECT c_custkey AS id, c_nationkey::BIGINT AS nation_id, c_acctbal AS balance FROM customer WHERE c_nationkey >= 5")
def delete_cascade(db):
    own = _shop(db)
    own.delete("nation", where=col("id") < 5)
    return own.query("customer").to_df()


@query("SELECT o_orderkey AS id, CASE WHEN c_nationkey >= 5 THEN o_custkey END AS customer_id FROM orders JOIN customer ON o_custkey = c_custkey")
def delete_set_null(db):
    own = _shop(db)
    own.delete("nation", where=col("id") < 5)
    return own.query("orders").to_df()


@query("SELECT r_regionkey::BIGINT + 1 AS id, r_name AS name FROM region UNION ALL SELECT 6, 'ATLANTIS'")
def insert_many(db):
    own = Database(db.spark)
    own.create_table("region")
    own.add_column("region", "id", AutoNumber, is_primary_key=True)
    own.add_column("region", "name", str, nullable=False, default="ATLANTIS")
    own.insert_many("region", [{"name": n} for n in db.query("region").order_by("r_regionkey").pluck("r_name")])
    own.insert("region", {})
    return own.query("region").to_df()


def _secrets(db: Database) -> Database:
    own = Database(db.spark)
    own.set_encryption_key(Database.generate_encryption_key())
    own.create_table("supplier")
    own.add_column("supplier", "id", int, is_primary_key=True)
    own.add_column("supplier", "name", str, is_encrypted=True)
    own.insert_df("supplier", db.frame("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return own


@query("SELECT s_suppkey AS id, '[ENCRYPTED]' AS name FROM supplier")
def enc_mask(db):
    return _secrets(db).query("supplier").to_df()


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_name = (SELECT s_name FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier))")
def enc_equality(db):
    first = db.query("supplier").order_by("s_suppkey").first()["s_name"]
    return _secrets(db).query("supplier").where(col("name") == first).to_df(decrypt=True)


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def save_load(db):
    own = _shop(db)
    path = f"{own.shared_dir()}/saved-{id(own)}"
    own.save(path)
    return Database.load(path, spark=db.spark).query("nation").to_df()


# the ten benchmark shapes on the star schema


@query("""SELECT r_name, p_type, count(*) AS line_count, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_quantity), 6) AS avg_quantity, max(p_retailprice) AS max_price
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2 HAVING sum(l_extendedprice * (1 - l_discount)) >= 2000 ORDER BY revenue DESC, r_name, p_type LIMIT 20""")
def bench_q01(db):
    q = db.query("orders").join("lineitem").join("part").join("customer").join("nation").join("region").where(col("orders.o_orderstatus").in_(["F", "O"]))
    g = q.group_by("region.r_name", "part.p_type").aggregate(line_count=count(), revenue=sum_("lineitem.l_net"), avg_quantity=avg("lineitem.l_quantity"), max_price=max_("part.p_retailprice"))
    df = g.having(col("revenue") >= 2000).order_by(("revenue", "desc"), "region.r_name", "part.p_type").limit(20).to_df()
    return rounded(rounded(df.toDF("r_name", "p_type", "line_count", "revenue", "avg_quantity", "max_price"), "revenue", digits=4), "avg_quantity", digits=6)


@query("""SELECT c_custkey, c_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS paid, round(avg(o_totalprice), 2) AS mean FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3 HAVING sum(o_totalprice) >= 1000 ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 15""")
def bench_q02(db):
    q = db.query("customer").join("orders").where(col("orders.o_orderstatus") == "F").group_by("customer.c_custkey", "customer.c_name", "customer.c_mktsegment")
    g = q.aggregate(n=count(), paid=sum_("orders.o_totalprice"), mean=avg("orders.o_totalprice")).having(col("paid") >= 1000)
    df = g.order_by(("paid", "desc"), "customer.c_custkey").limit(15).to_df()
    return rounded(df.toDF("c_custkey", "c_name", "c_mktsegment", "n", "paid", "mean"), "paid", "mean")


@query("""SELECT s_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY qty DESC, s_name, p_brand LIMIT 25""")
def bench_q03(db):
    g = db.query("lineitem").join("supplier").join("part").group_by("supplier.s_name", "part.p_brand")
    g = g.aggregate(n=count(), qty=sum_("lineitem.l_quantity"), discount=avg("lineitem.l_discount")).having(col("n") >= 3)
    df = g.order_by(("qty", "desc"), "supplier.s_name", "part.p_brand").limit(25).to_df().toDF("s_name", "p_brand", "n", "qty", "discount")
    return rounded(rounded(df, "qty"), "discount", digits=6)


@query("""SELECT s_name, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderstatus = 'F' GROUP BY 1, 2 ORDER BY n DESC, s_name, month LIMIT 25""")
def bench_q04(db):
    q = db.query("lineitem").join("orders").join("supplier").where(col("orders.o_orderstatus") == "F").group_by("supplier.s_name", "orders.o_month")
    df = q.aggregate(n=count(), total=sum_("orders.o_totalprice")).order_by(("n", "desc"), "supplier.s_name", "orders.o_month").limit(25).to_df()
    return rounded(df.toDF("s_name", "month", "n", "total"), "total")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1, 2")
def bench_q05(db):
    g = db.query("orders").group_by("o_orderpriority", "o_orderstatus").aggregate(n=count(), total=sum_("o_totalprice"), mean=avg("o_totalprice"))
    return rounded(g.order_by(("total", "desc")).to_df(), "total", "mean")


@query("SELECT event_type, user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM events GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, event_type, user_id LIMIT 40")
def bench_q06(db):
    g = db.query("events").group_by("event_type", "user_id").aggregate(n=count(), mean=avg("value"), top=max_("value")).having(col("n") >= 2)
    return rounded(g.order_by(("n", "desc"), "event_type", "user_id").limit(40).to_df(), "mean", digits=6)


@query("""SELECT r_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey
WHERE c_acctbal > 0 AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def bench_q07(db):
    q = db.query("customer").join("nation").join("region").join("orders").where((col("customer.c_acctbal") > 0.0) & col("orders.o_orderstatus").in_(["F", "O"]))
    df = q.group_by("region.r_name", "customer.c_mktsegment").aggregate(n=count(), total=sum_("orders.o_totalprice")).to_df()
    return rounded(df.toDF("r_name", "c_mktsegment", "n", "total"), "total")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, p_type, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2 HAVING sum(l_extendedprice * (1 - l_discount)) > 100000""")
def bench_q08(db):
    q = db.query("lineitem").join("orders").join("part").group_by("orders.o_month", "part.p_type")
    df = q.aggregate(revenue=sum_("lineitem.l_net"), n=count()).having(col("revenue") > 100000).to_df()
    return rounded(df.toDF("month", "p_type", "revenue", "n"), "revenue", digits=4)


@query("SELECT n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 10")
def bench_q09(db):
    g = db.query("supplier").join("nation").group_by("nation.n_name").aggregate(n=count(), balance=sum_("supplier.s_acctbal"))
    return rounded(g.order_by(("n", "desc"), "nation.n_name").limit(10).to_df().toDF("n_name", "n", "balance"), "balance")


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 100000 AND 200000 AND c_mktsegment <> 'MACHINERY' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def bench_q10(db):
    q = db.query("orders").join("customer").where(col("orders.o_totalprice").between(100000.0, 200000.0) & (col("customer.c_mktsegment") != "MACHINERY"))
    q = q.order_by(("orders.o_totalprice", "desc"), "orders.o_orderkey").limit(50)
    return q.select("orders.o_orderkey", "orders.o_totalprice", "customer.c_name").to_df().toDF("o_orderkey", "o_totalprice", "c_name")
