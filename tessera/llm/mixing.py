"""Mixing sources to target weights by hierarchical budgeting (JVM expressions only).

The tree is domain > language > source. `leaf_budgets` sums the tokens of every leaf, multiplies them by the most
epochs allowed (a leaf's capacity), sums capacities up the tree, and hands the total budget down: at each node the
children share its budget by weight, a child takes no more than its subtree can supply, and what it leaves goes to its
siblings by weight. Only what a whole subtree cannot use shows up one level higher, so shortages are redistributed
among siblings before ancestors. All sums are whole numbers; shares are rounded by cumulative weight, so that they add
up to the node's budget exactly.

`select_prefix` turns a leaf's budget b with supply t into b div t whole epochs and, of the next epoch, the prefix of
documents whose running tokens stay within b mod t. An epoch's order is the MD5 of seed, epoch and doc_id. Running sums
go through hash buckets: sums per bucket, running sums over buckets (in groups) and a window inside each bucket; so a leaf that
holds a third of all rows is spread over as many tasks as there are buckets.

Defined cases: a null text has no tokens (such a document is taken if its leaf has a budget and the running sum before it
is within that); null tree columns form the branch ''; unknown names weigh `default`; names of weight 0 get nothing, and
nor does any other leaf without a budget, empty texts included; repeated rows and null ids stand for themselves and follow
the hash order; an empty table gives an empty table; extra columns of the stage pass through.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WS_CLASS, boxed, text_or_empty, unboxed

GROUP, SALTS = 64, 64
LEVELS = ("domain", "lang", "source")
DOMAIN_SQL = "concat('d', coalesce(cast(try_cast(substring(source, 4) AS int) % 4 AS string), 'x'))"


@dataclass(frozen=True)
class Mix:
    """weights: whole numbers by level and name; share: budget as (numerator, denominator) of all tokens."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    default: int = 1
    share: tuple[int, int] = (7, 10)
    max_epochs: int = 2
    seed: int = 17
    buckets: int = 4096


MIX = Mix(weights={"domain": {"d0": 3, "d1": 3, "d2": 2, "d3": 2, "dx": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}})


def with_tree(docs: DataFrame, domain: str = DOMAIN_SQL) -> DataFrame:
    """docs with _domain, _lang, _source and _tokens (words of the text)."""
    return docs.withColumns({
        "_domain": F.coalesce(F.expr(domain), F.lit("")),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "_tokens": F.regexp_count(text_or_empty(), F.lit(f"[^{WS_CLASS}]+")).cast("long"),
    })


def _weight(mix: Mix, level: str) -> Column:
    names = mix.weights.get(level, {})
    if not names:
        return F.lit(mix.default).cast("long")
    known = F.create_map(*[F.lit(x).cast("long") if i % 2 else F.lit(x) for kv in names.items() for i, x in enumerate(kv)])
    return F.coalesce(F.try_element_at(known, F.col(f"_{level}")), F.lit(mix.default).cast("long"))


def _share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes with `budget`: `above` of each parent shared by `w`, at most `cap` each."""
    by = Window.partitionBy(*parent)
    nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).withColumn("w", F.greatest("w", F.lit(0)))
    fill = by.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0)), name)
    df = nodes.withColumns({
        "_below": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    df = df.withColumn("_full", F.col("cap") * F.col("_left") <= (F.col("above") - F.col("_below")) * F.col("w"))
    df = df.withColumns({
        "_rest": F.col("above") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0)),
        "_all": F.sum(F.when(~F.col("_full"), F.col("w"))).over(by),
        "_to": F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("w"))).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    upto = lambda w: F.expr(f"(_rest * ({w})) div _all")
    return df.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.coalesce(upto("_to") - upto("_to - w"), F.lit(0)))).drop(
        "_below", "_left", "_full", "_rest", "_all", "_to")


def leaf_budgets(tree: DataFrame, mix: Mix = MIX) -> DataFrame:
    """One row per leaf: _domain, _lang, _source, supply, budget."""
    leaves = tree.groupBy("_domain", "_lang", "_source").agg(F.sum("_tokens").alias("supply"))
    leaves = leaves.withColumn("cap", F.col("supply") * mix.max_epochs)
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    every = Window.partitionBy("_root")
    domains = domains.withColumn("_root", F.lit(0)).withColumn("above", F.expr(f"(sum(supply) OVER (PARTITION BY _root) * {mix.share[0]}) div {mix.share[1]}"))
    domains = domains.withColumn("above", F.least("above", F.sum("cap").over(every)))
    domains = _share_out(domains.withColumn("w", _weight(mix, "domain")), ["_root"], "_domain")
    langs = langs.join(domains.select("_domain", F.col("budget").alias("above")), "_domain")
    langs = _share_out(langs.withColumn("w", _weight(mix, "lang")), ["_domain"], "_lang")
    leaves = leaves.join(langs.select("_domain", "_lang", F.col("budget").alias("above")), ["_domain", "_lang"])
    leaves = _share_out(leaves.withColumn("w", _weight(mix, "source")), ["_domain", "_lang"], "_source")
    return leaves.select("_domain", "_lang", "_source", "supply", "budget")


def select_prefix(tree: DataFrame, budgets: DataFrame, mix: Mix = MIX) -> DataFrame:
    """tree with `copies`: the times that each document is taken (0: not)."""
    leaf = ["_domain", "_lang", "_source"]
    budgets = budgets.withColumns({
        "_epochs": F.expr("coalesce(budget div nullif(supply, 0), 0)"), "_rest": F.expr("coalesce(budget % nullif(supply, 0), 0)"), "_any": F.expr("budget > 0"),
    }).drop("supply", "budget")
    # every leaf's budget goes to SALTS places, so that the documents of one leaf need not meet for it
    salted = budgets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = tree.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_tokens"), F.lit(SALTS)).cast("int")).join(salted, [*leaf, "_salt"]).drop("_salt")
    df = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    df = df.withColumn("_bucket", F.expr(f"cast(conv(substring(_h, 1, 6), 16, 10) AS int) div {(1 << 24) // mix.buckets}"))
    # running sums over buckets, in two levels: within a group of GROUP buckets, and over the groups of a leaf
    sums = df.groupBy(*leaf, "_bucket").agg(F.sum("_tokens").alias("_n")).withColumn("_group", F.expr(f"_bucket div {GROUP}"))
    ahead = lambda by, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_within", ahead([*leaf, "_group"], "_bucket", "_n"))
    # a group's buckets are in one task now, so each gives one row, and a leaf's task gets as many rows as it has groups
    groups = sums.groupBy(*leaf, "_group").agg(F.max(F.col("_within") + F.col("_n")).alias("_m"))
    groups = groups.select(*leaf, "_group", ahead(leaf, "_group", "_m").alias("_groups"))
    sums = sums.join(groups, [*leaf, "_group"])
    df = df.join(sums.select(*leaf, "_bucket", (F.col("_groups") + F.col("_within")).alias("_before")), [*leaf, "_bucket"])
    inside = Window.partitionBy(*leaf, "_bucket").orderBy("_h", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.col("_any") & (F.col("_before") + F.sum("_tokens").over(inside) <= F.col("_rest"))
    return df.withColumn("copies", F.col("_epochs") + taken.cast("long")).drop("_h", "_bucket", "_before", "_rest", "_epochs", "_any")


def mixing_query(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    tree = with_tree(docs).select("doc_id", "_domain", "_lang", "_source", "_tokens")
    out = select_prefix(tree, leaf_budgets(tree, mix), mix)
    return out.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), "copies")


def mixing_stage(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Pipeline stage: documents of no copy go, one of several copies is repeated. Columns pass through, whatever their names."""
    rows = boxed(docs, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang"), source=F.col("source"))
    tree = with_tree(rows).drop("text", "lang", "source")
    out = select_prefix(tree, leaf_budgets(tree.select("_domain", "_lang", "_source", "_tokens"), mix), mix)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return unboxed(out.where("copies > 0").select("_row", again))


def _sql_level(name: str, above: str, nodes: str, parent: str, col: str) -> str:
    """CTEs that share `above` of each parent among its children."""
    part = f"PARTITION BY {parent}"
    order = f"{part} ORDER BY CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / w ELSE 0 END, {col}"
    return f"""
{name}0 AS (SELECT * REPLACE (CASE WHEN w > 0 THEN cap ELSE 0 END AS cap) FROM ({nodes})),
{name}1 AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM {name}0),
{name}2 AS (SELECT *, cap * rest_w <= ({above} - below) * w AS full_ FROM {name}1),
{name}3 AS (SELECT *, {above} - coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({part}), 0) AS rest, sum(CASE WHEN NOT full_ THEN w END) OVER ({part}) AS all_w,
  sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {name}2),
{name} AS (SELECT *, CASE WHEN full_ THEN cap ELSE coalesce((rest * upto) // all_w - (rest * (upto - w)) // all_w, 0) END AS budget FROM {name}3)"""


def _mixing_sql(mix: Mix) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in mix.weights.get(level, {}).items())
        return f"CASE {level}{cases} ELSE {mix.default} END" if cases else str(mix.default)

    e = mix.max_epochs
    return f"""
WITH t AS (SELECT doc_id, 'd' || coalesce(CAST(try_cast(substr(source, 4) AS INT) % 4 AS VARCHAR), 'x') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM t GROUP BY ALL),
{_sql_level("d", "above", f"SELECT domain, sum(supply) * {e} AS cap, {weight('domain')} AS w, 0 AS root, least((sum(sum(supply)) OVER () * {mix.share[0]}) // {mix.share[1]}, sum(sum(supply)) OVER () * {e}) AS above FROM leaf GROUP BY domain", "root", "domain")},
{_sql_level("l", "above", f"SELECT domain, lang, sum(supply) * {e} AS cap, {weight('lang')} AS w, any_value(budget) AS above FROM leaf JOIN (SELECT domain, budget FROM d) USING (domain) GROUP BY domain, lang", "domain", "lang")},
{_sql_level("s", "above", f"SELECT domain, lang, source, supply, supply * {e} AS cap, {weight('source')} AS w, budget AS above FROM leaf JOIN (SELECT domain, lang, budget FROM l) USING (domain, lang)", "domain, lang", "source")},
x AS (SELECT t.*, coalesce(budget // nullif(supply, 0), 0) AS epochs, coalesce(budget % nullif(supply, 0), 0) AS rest, budget FROM t JOIN (SELECT domain, lang, source, supply, budget FROM s) USING (domain, lang, source)),
y AS (SELECT *, md5('{mix.seed}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM x)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(epochs + CAST(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AND budget > 0 AS BIGINT) AS BIGINT) AS copies FROM y
"""


MIXING_SQL = _mixing_sql(MIX)
