"""Conditions against a plain two-valued evaluator on rows with nulls."""

import random

import pytest

from tessera import AND, NOT, OR, Database, QueryTypeError, col

ROWS = [{"id": i, "a": a, "s": s} for i, (a, s) in enumerate([(None, "abc"), (5, None), (7, "axc"), (5, "ABC"), (0, ""), (None, None), (-3, "a%c")])]


def like(text, pattern):
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(like(text[i:], pattern[1:]) for i in range(len(text) + 1))
    return bool(text) and (pattern[0] in ("_", text[0])) and like(text[1:], pattern[1:])


def leaf(rng):
    v = rng.choice([None, -3, 0, 5, 6, 7])
    w = rng.choice([5, 7, 9])
    kind = rng.randrange(9)
    if kind == 0:
        return col("a") == v, lambda r: r["a"] == v
    if kind == 1:
        return col("a") != v, lambda r: r["a"] != v
    if kind == 2:
        return col("a") > w, lambda r: r["a"] is not None and r["a"] > w
    if kind == 3:
        return col("a") <= w, lambda r: r["a"] is not None and r["a"] <= w
    if kind == 4:
        return col("a").between(0, w), lambda r: r["a"] is not None and 0 <= r["a"] <= w
    if kind == 5:
        return col("a").between(0, w, inclusive=False), lambda r: r["a"] is not None and 0 < r["a"] < w
    if kind == 6:
        return col("a").in_([v, w]), lambda r: r["a"] in [v, w]
    if kind == 7:
        p = rng.choice(["a_c", "%c", "a%", "%", "a\\c"])
        return col("s").like(p), lambda r: r["s"] is not None and like(r["s"], p)
    return col("s").is_null(), lambda r: r["s"] is None


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return leaf(rng)
    (c1, f1), (c2, f2) = tree(rng, depth - 1), tree(rng, depth - 1)
    kind = rng.randrange(3)
    if kind == 0:
        return AND(c1, c2), lambda r: f1(r) and f2(r)
    if kind == 1:
        return OR(c1, c2), lambda r: f1(r) or f2(r)
    return NOT(c1), lambda r: not f1(r)


def test_random_trees(spark):
    rng, db = random.Random(3), Database(spark)
    q = db.from_rows("t", ROWS, ["id", "a", "s"])
    for _ in range(40):
        condition, f = tree(rng, 4)
        assert sorted(q.where(condition).pluck("id")) == [r["id"] for r in ROWS if f(r)]


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, None)], "id long, a long").write.parquet(str(tmp_path / "t"))
    db = Database(spark)
    db.register_table("t", spark.read.parquet(str(tmp_path / "t")), "id")
    df = db.query("t").where(~(col("a") > 5)).select("id").to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThanOrEqual(a,5),IsNull(a))]" in plan


def test_type_errors(spark):
    q = Database(spark).from_rows("t", ROWS, ["id", "a", "s"])
    with pytest.raises(QueryTypeError):
        q.where(col("a") > "x")
    with pytest.raises(QueryTypeError):
        bool(col("a") == 1)
    assert q.where(col("a") == "x").count() == 0
    assert q.where(col("a") != "x").count() == len(ROWS)
