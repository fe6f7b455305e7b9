"""Quality rules as a short-circuit cascade (JVM expressions only).

`MEASURES` are the counts that rules read, `Rule` a rejecting predicate over them. `estimate` times every rule and counts
its rejections on a bounded sample, and `apply_rules` takes the rules by falling rejection per cost: a document leaves at
the first rule that rejects it, and a measure that only later rules read is not computed for it. The order changes the
cost, never the verdict. (`quality_query` returns five measures of every document, rejected or not, so there only what it
does not return is left out.)

Defined cases: a null or empty text has no words and is rejected (under 50 words); ties and repeated rows are
judged row by row; an empty table gives an empty table; extra columns pass through, where `apply_rules` replaces columns
whose names clash with the measures; the stage keeps all columns, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WS_CHARS, WS_CLASS, boxed, text_or_empty, unboxed, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS, SAMPLE_CHARS = 512, 1 << 14
POSITION_BITS = 24  # a packed window holds 40 bits of hash above its position


@dataclass(frozen=True)
class Rule:
    """rejects: SQL predicate over the document's columns, true where the rule rejects."""

    name: str
    rejects: str

    def column(self) -> Column:
        return F.coalesce(F.expr(self.rejects), F.lit(False))


RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    Rule("symbols", "3 * n_symbols > n_words"),
    Rule("shouting", "3 * (length(_text) - length(translate(_text, '!', ''))) > n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 40 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")


def _window(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _only(gate: Column | None, value: Column, other: Column) -> Column:
    return value if gate is None else F.when(gate, value).otherwise(other)


def _word_chars(df: DataFrame, gate: Column | None) -> DataFrame:
    if "_words" in df.columns:
        return df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    return df.withColumn("word_chars", _only(gate, F.length(F.translate("_text", WS_CHARS, "")).cast("long"), F.lit(0).cast("long")))


def _symbols(df: DataFrame, gate: Column | None) -> DataFrame:
    return df.withColumn("n_symbols", _only(gate, F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long"), F.lit(0).cast("long")))


def _lines(df: DataFrame, gate: Column | None) -> DataFrame:
    found = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)
    df = df.withColumn("_lines", _only(gate, found, F.array().cast("array<string>")))
    return df.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")


def _repeat_words(df: DataFrame, gate: Column | None) -> DataFrame:
    """n_repeat_words.

    Windows are hashed; where all hashes differ nothing repeats. Else windows that may repeat are found by sorting primitive
    longs (40 bits of hash above the position), and the words of those are compared themselves, so a collision of hashes
    changes nothing. All is O(n log n) in the text.
    """
    low = (1 << POSITION_BITS) - 1
    own = "_words" not in df.columns
    if own:
        df = df.withColumn("_words", _only(gate, words_of(F.col("_text")), F.array().cast("array<string>")))
    w, n = F.col("_words"), F.greatest(F.size("_words") - 2, F.lit(0))
    df = df.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))
    both = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_h", F.zip_with(F.zip_with(F.slice("_h", 1, n), F.slice("_h", 2, n), both), F.slice("_h", 3, n), both))
    df = df.withColumn("_twice", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_packed", F.when(F.col("_twice"), F.sort_array(F.transform("_h", lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long"))))))
    tag = lambda x: F.shiftright(x, POSITION_BITS)
    same = lambda i, x: F.coalesce(tag(F.get("_packed", i)) == tag(x), F.lit(False))
    wide = F.size("_h") - 1 > low  # positions would not fit: every window is compared by its words
    df = df.withColumn("_at", F.when(F.col("_twice"), F.when(wide, F.sequence(F.lit(0), F.size("_h") - 1)).otherwise(
        F.transform(F.filter("_packed", lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int"))
    ))).drop("_packed", "_h", "_twice")
    df = df.withColumn("_grams", F.sort_array(F.transform("_at", lambda p: F.struct(_window(w, p).alias("g"), p.alias("p"))))).drop("_at")
    alike = lambda i, x: F.coalesce(F.get("_grams", i)["g"] == x["g"], F.lit(False))
    df = df.withColumn("_hits", F.sort_array(F.transform(F.filter("_grams", lambda x, i: alike(i - 1, x) | alike(i + 1, x)), lambda x: x["p"]))).drop("_grams")
    covered = F.aggregate(
        F.transform("_hits", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_hits", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda acc, x: acc + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_hits", *["_words"] * own)


#: What adds the measures, by the columns that it adds.
MEASURES: dict[tuple[str, ...], Callable[[DataFrame, Column | None], DataFrame]] = {
    ("word_chars",): _word_chars, ("n_symbols",): _symbols, ("n_dup_lines", "n_lines"): _lines, ("n_repeat_words",): _repeat_words,
}


def _started(docs: DataFrame, text: str, words: bool) -> DataFrame:
    """docs with _text and n_words; words: also the words themselves, where they are needed for every row."""
    df = docs.withColumn("_text", text_or_empty(text))
    if words:
        return df.withColumn("_words", words_of(F.col("_text"))).withColumn("n_words", F.size("_words").cast("long"))
    return df.withColumn("n_words", F.regexp_count("_text", F.lit(f"[^{WS_CLASS}]+")).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _text, n_words and all measures."""
    df = _started(docs, text, False)
    for add in MEASURES.values():
        df = add(df, None)
    return df


def estimate(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejected share) of each rule on a bounded sample; the sample only decides the order.

    The sample is taken from the first partitions (a take, so no other is read), SAMPLE_CHARS of a text at most. A rule's
    job computes only the measures that the rule reads; the time of an empty job is taken off.
    """
    spark = docs.sparkSession
    taken = docs.select(F.left(F.col(text).cast("string"), F.lit(SAMPLE_CHARS)).alias(text)).take(sample_rows)
    sample = measures(spark.createDataFrame(taken, f"`{text}` string").coalesce(1), text)

    def timed(count: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(count).first()[0]
        return time.perf_counter() - began, hits

    timed(F.count(F.lit(1)))
    idle, n = timed(F.count(F.lit(1)))
    found = [(rule.name, *timed(F.count(F.when(rule.column(), 1)))) for rule in rules]
    return [(name, max(s - idle, 1e-3), hits / n if n else 0.0) for name, s, hits in found]


def ordered(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejection per cost; equal ones keep the given order."""
    found = {name: share / seconds for name, seconds, share in estimate(docs, text, rules, sample_rows)}
    return sorted(rules, key=lambda r: -found[r.name])


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    verdict = None
    for rule in rules:
        verdict = F.when(rule.column(), rule.name) if verdict is None else verdict.when(rule.column(), rule.name)
    return verdict if verdict is not None else F.lit(None).cast("string")


def apply_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, returned: Sequence[str] = ()) -> DataFrame:
    """docs with the measures that rules read and `rejected_by` (null: kept).

    A measure is 0 where an earlier rule rejects, but for those of `returned`, which are right for every row.
    """
    df = _started(docs, text, "n_repeat_words" in returned)
    have: set[str] = set()

    def add(wanted: Callable[[str], bool], gate: Column | None) -> None:
        nonlocal df
        for names, make in MEASURES.items():
            if not have & {*names} and any(wanted(n) for n in names):
                df = make(df, None if any(n in returned for n in names) else gate)
                have.update(names)

    done: list[Rule] = []
    for rule in ordered(docs, text, rules, sample_rows):
        add(lambda n, rule=rule: n in rule.rejects, cascade(done).isNull() if done else None)
        done.append(rule)
    add(lambda n: n in returned, None)
    return df.withColumn("rejected_by", cascade(done))


def quality_query(docs: DataFrame) -> DataFrame:
    judged = apply_rules(docs.select("doc_id", "text"), returned=("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = F.col("n_words") < MIN_WORDS
    failed = failed | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
    )


def quality_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rejected documents go, the columns stay as they are, whatever their names."""
    judged = apply_rules(boxed(docs, text=F.col("text"))).withColumn("_fence", F.rand(0))  # keeps the filter from being copied into each step below
    return unboxed(judged.where(F.col("rejected_by").isNull() & (F.col("_fence") >= 0)))


QUALITY_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, CASE WHEN trim(text, E' \t\n\x0b\x0c\r') = '' THEN [] ELSE string_split_regex(trim(text, E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') END AS words FROM t),
p AS (SELECT rid, unnest(words) AS w0, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT rid, i, w0 || ' ' || lead(w0) OVER o || ' ' || lead(w0, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL),
r AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, E'\n')) AS line FROM t)
      WHERE trim(line, E' \t\n\x0b\x0c\r') <> '' GROUP BY rid),
m AS (SELECT w.doc_id, w.text, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR 3 * n_symbols > n_words
    OR 3 * (length(text) - length(replace(text, '!', ''))) > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR word_chars > 40 * n_words) AS kept
FROM m
"""
