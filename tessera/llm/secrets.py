"""Secret scans (JVM expressions only).

Base kinds are the leftmost non-overlapping matches of three patterns. The method adds `entropy` spans: candidate
strings (long runs of key characters) are judged by the Shannon entropy of a sliding window of WINDOW characters. The
window's entropy is log2(W) - S / W with S the sum of c * log2(c) over its character counts; moving the window by one
changes two counts, so S is kept up by adding and subtracting table entries (fixed point, whole numbers). Each
character class has its own limit, and an allow-list suppresses strings of known harmless shapes.

Candidates have WINDOW characters or more; the classes are hex, base64 (a digit and both letter cases) and strings of one
letter case with digits. An entropy span that lies inside a base span is dropped, others stay beside the base spans.

Offsets are code points, ends exclusive. They come from the pieces between matches (split) and the matches
(regexp_extract_all), whose lengths alternate.

Defined cases: a null or empty text has no spans; equal texts give equal spans (rows are judged one by one); very long
texts are scanned whole, in time linear in their length and matches; an empty table gives an empty table; extra columns
pass through `scan`, where input columns named like its outputs are replaced, and through `redact` and the stage, where
columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boxed, quoted, text_or_empty, unboxed


@dataclass(frozen=True)
class Kind:
    """pattern: what matches; keep: of a match, the shortest length of the part that `measured` leaves."""

    name: str
    pattern: str
    least: int
    prefix: str = ""


_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
_HEAD = _KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?"
KINDS = (
    Kind("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 8, _HEAD),
    # a run is matched whole or not at all, so the least length can stand in the pattern: short runs make no pieces
    Kind("access", "AKIA[A-Z0-9]{12,}", 16),
    Kind("hex", "[0-9a-f]{32,}", 32),
)
WINDOW = 20
#: Least entropy in bits of a window, by the character class of the whole candidate.
CLASS_BITS = {"hex": 3.0, "base64": 3.9, "lower": 3.3, "upper": 3.3}
SCALE = 1 << 16
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Classes of one letter case: pattern of the whole candidate.
ONE_CASE = {"lower": "^[a-z0-9]+=*$", "upper": "^[A-Z0-9]+=*$"}
#: Whole-string shapes that are no secrets: numbers, words, UUIDs, and words or numbers joined by dashes and slashes.
JOINED_WORDS = "([a-z]+|[0-9]+)([-/_=]+([a-z]+|[0-9]+))+"
ALLOWED = (
    "[0-9+=/_-]+",
    "[A-Za-z+=/_-]+",
    "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    JOINED_WORDS,
)
FIRST_CODE, CODES = 43, 80  # '+' to 'z'
BLOCK, PIECE = 32, 4096


def clog(c: int) -> int:
    """c * log2(c) in fixed point."""
    return round(SCALE * c * math.log2(c)) if c > 1 else 0


def most_clog(kind: str) -> int:
    """The largest S whose window still has the class's least entropy."""
    return math.floor(SCALE * WINDOW * (math.log2(WINDOW) - CLASS_BITS[kind]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(items: Column, zero: Column, join: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each item, zero joined with all items before it.

    aggregate() copies its state at every step, so a state that grows would take quadratic time. Instead the items are cut
    into blocks of BLOCK, each block is joined, and the same is done with the blocks' results, `levels` times; then an item
    needs only its block's start and the items before it there.
    """
    upto = lambda a, n, first: F.aggregate(F.slice(a, 1, n), first, join)
    if not levels:
        return _let(items, lambda a: F.transform(a, lambda x, j: upto(a, j, zero)))

    def cut(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, BLOCK)))

    def solved(blocks: Column) -> Column:
        starts = _before(F.transform(blocks, lambda b: F.aggregate(b, zero, join)), zero, join, levels - 1)
        return F.flatten(F.zip_with(blocks, starts, lambda b, first: F.transform(b, lambda x, j: upto(b, j, first))))

    return _let(items, lambda a: _let(cut(a), lambda blocks: F.when(blocks.isNotNull(), solved(blocks)).otherwise(F.slice(a, 1, 0))))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s:int, t:string>>: start and text of every match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("b"))
    sizes = lambda found: F.transform(found, lambda x: F.length(x["a"]) + F.coalesce(F.length(x["b"]), F.lit(0)))
    starts = lambda found: _before(sizes(found), F.lit(0), lambda x, y: x + y)
    spans = _let(parts, lambda found: F.zip_with(found, starts(found), lambda x, at: F.struct((at + F.length(x["a"])).alias("s"), x["b"].alias("t"))))
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: x["t"].isNotNull())).otherwise(F.array().cast("array<struct<s:int,t:string>>"))


def _long_enough(kind: Kind, t: Column) -> Column:
    return F.length(F.regexp_replace(t, "^" + kind.prefix, "") if kind.prefix else t) >= kind.least


def _kept(kind: Kind) -> Column:
    return F.filter(_spans(F.col("_text"), kind.pattern), lambda x: _long_enough(kind, x["t"]))


def _as_spans(i: int, kind: Kind) -> Column:
    return F.transform(f"_{kind.name}", lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), (x["s"] + F.length(x["t"])).alias("e"), F.lit(kind.name).alias("kind")))


def _count(i: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")


def _guard(kind: Kind) -> str:
    """A pattern that any text with a kept match has; it is cheap to look for."""
    return {"hex": f"[0-9a-f]{{{kind.least}}}", "access": f"AKIA[A-Z0-9]{{{kind.least - 4}}}"}.get(kind.name, kind.prefix or kind.pattern)


def entropy_range(s: Column) -> Column:
    """struct<lo,hi>: first start and last end of the windows of s at or over the class's entropy; lo null if none.

    The counts are a string of CODES characters, one for each key character, whose code is its count; moving the window
    by one replaces two of them. The candidate is split into characters once.
    """
    table = F.array(*[F.lit(clog(c)) for c in range(WINDOW + 2)])
    limit = F.when(s.rlike("^[0-9a-fA-F]+$"), most_clog("hex"))
    for kind, pattern in ONE_CASE.items():
        limit = limit.when(s.rlike(pattern), most_clog(kind))
    limit = limit.otherwise(most_clog("base64"))
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c) - (FIRST_CODE - 1))
    gone = F.concat(F.array_repeat(F.lit(0), WINDOW), F.transform(F.filter(F.split(F.left(s, F.greatest(F.length(s) - WINDOW, F.lit(0))), ""), lambda c: c != ""), lambda c: F.ascii(c) - (FIRST_CODE - 1)))
    moves = F.zip_with(codes, gone, lambda x, y: F.struct(x.alias("into"), F.coalesce(y, F.lit(0)).alias("out")))
    count = lambda n, k: F.ascii(F.substring(n, k, 1)) - 1
    put = lambda n, k, c: F.overlay(n, F.char(c + 1), k, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        before = F.when(x["out"] > 0, put(acc["n"], x["out"], count(acc["n"], x["out"]) - 1)).otherwise(acc["n"])
        less = F.when(x["out"] > 0, F.get(table, count(acc["n"], x["out"])) - F.get(table, count(acc["n"], x["out"]) - 1)).otherwise(F.lit(0))
        have = count(acc["n"], x["into"]) - F.when(x["into"] == x["out"], 1).otherwise(0)
        total = acc["sum"] - less + F.get(table, have + 1) - F.get(table, have)
        i = acc["i"] + 1
        hit = (i >= WINDOW) & (total <= acc["limit"])
        return F.struct(
            put(before, x["into"], have + 1).alias("n"), total.alias("sum"), i.alias("i"), acc["limit"].alias("limit"),
            F.when(hit, F.coalesce(acc["lo"], i - WINDOW)).otherwise(acc["lo"]).alias("lo"), F.when(hit, i).otherwise(acc["hi"]).alias("hi"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit("\x01" * CODES).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("i"), limit.cast("int").alias("limit"), none.alias("lo"), none.alias("hi"))
    return F.aggregate(moves, start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _allowed(s: Column, pattern: str) -> Column:
    """Whether the whole of s matches; the joined words are looked at without a repeated group, which would nest deeply."""
    if pattern == JOINED_WORDS:
        return s.rlike("^[a-z0-9][a-z0-9/_=-]*[-/_=][a-z0-9/_=-]*[a-z0-9]$") & ~s.rlike("[a-z][0-9]|[0-9][a-z]")
    return s.rlike(f"^({pattern})$")


def _suspect(s: Column, allowed: Sequence[str]) -> Column:
    mixed = s.rlike("^[0-9a-fA-F]+$") | (s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]"))
    for pattern in ONE_CASE.values():
        mixed = mixed | (s.rlike("[0-9]") & s.rlike(pattern))
    for pattern in allowed:
        mixed = mixed & ~_allowed(s, pattern)
    return mixed


def _fresh_spans(base: Column, more: Column) -> Column:
    """base and those entropy spans that lie inside no base span, by start."""
    ends = lambda a: F.transform(a, lambda x: F.when(x["k"] < len(KINDS), x["e"]).otherwise(F.lit(-1)))
    far = lambda a: _before(ends(a), F.lit(-1), lambda x, y: F.greatest(x, y))  # noqa: E731  (base spans come first at a start)
    judged = lambda a: F.zip_with(a, far(a), lambda x, f: F.struct(x.alias("x"), ((x["k"] < len(KINDS)) | (f < x["e"])).alias("y")))
    return F.transform(F.filter(_let(F.array_sort(F.concat(base, more)), judged), lambda j: j["y"]), lambda j: j["x"])


def scan(docs: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """docs with `base` and `found`: arrays of struct<s, k, e, kind>, by start, then kind as listed (entropy last)."""
    df = docs.withColumn("_text", text_or_empty(text))
    df = df.withColumns({f"_{k.name}": F.when(F.col("_text").rlike(_guard(k)), _kept(k)) for k in KINDS})
    lone = "(?<![A-Za-z0-9+/_=-])" + CANDIDATE
    df = df.withColumn("_cand", F.when(F.col("_text").rlike(lone), F.filter(_spans(F.col("_text"), CANDIDATE), lambda x: _suspect(x["t"], allowed))))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    each = [F.coalesce(_as_spans(i, k), none) for i, k in enumerate(KINDS)]
    df = df.withColumn("base", F.array_sort(F.concat(*each)))
    ranges = F.transform("_cand", lambda x: F.struct(x["s"].alias("s"), entropy_range(x["t"]).alias("r")))
    spans = F.transform(F.filter(ranges, lambda x: x["r"]["lo"].isNotNull()), lambda x: F.struct(
        (x["s"] + x["r"]["lo"]).alias("s"), F.lit(len(KINDS)).alias("k"), (x["s"] + x["r"]["hi"]).alias("e"), F.lit("entropy").alias("kind")))
    df = df.withColumn("_more", F.when(F.size("_cand") > 0, spans))
    df = df.withColumn("found", F.when(F.size("_more") > 0, _fresh_spans(F.col("base"), F.col("_more"))).otherwise(F.col("base")))
    return df.drop("_text", "_cand", "_more", *[f"_{k.name}" for k in KINDS])


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets_query(docs: DataFrame) -> DataFrame:
    counts = [_count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    return scan(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def _masked(text: Column, found: Column, mark: str) -> Column:
    """text with the spans replaced by the mark, overlapping ones as one.

    The text is cut into pieces of PIECE characters first, and a cut is an event like a span; so every part that is kept
    is taken out of one short piece, and time is linear in text and spans.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def parts(cut: Column) -> Column:
        cuts = F.transform(cut, lambda x, k: F.struct(((k + 1) * PIECE).alias("s"), F.lit(0).alias("k"), ((k + 1) * PIECE).alias("e"), F.lit("").alias("kind")))
        kept = lambda x, at: F.substring(F.get(cut, F.floor(at / PIECE).cast("int")), at % PIECE + 1, x["s"] - at)
        part = lambda x, at: F.when(x["e"] <= at, F.lit("")).otherwise(F.concat(
            F.when(x["s"] > at, kept(x, at)).otherwise(F.lit("")), F.when((x["kind"] != "") & (x["s"] >= at), F.lit(mark)).otherwise(F.lit(""))))
        ends = lambda events: F.transform(events, lambda x: x["e"])
        return _let(F.array_sort(F.concat(found, cuts)), lambda events: F.zip_with(events, _before(ends(events), F.lit(0), lambda x, y: F.greatest(x, y)), part))

    return F.array_join(_let(pieces, parts), "")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark; overlapping spans are replaced as one."""
    df = scan(boxed(docs, text=F.col(quoted(text))))
    done = F.when(F.size("found") > 0, _masked(F.col("text").cast("string"), F.col("found"), mark)).otherwise(F.col("text"))
    return unboxed(df, **{text: done})


def secrets_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: secrets are masked in place and n_chars follows; no document goes, and columns may have any names."""
    df = scan(boxed(docs, text=F.col("text")))
    masked = F.when(F.size("found") > 0, _masked(F.col("text").cast("string"), F.col("found"), "[SECRET]")).otherwise(F.col("text"))
    df = df.select("_row", F.size("found").alias("_n"), masked.alias("_masked"))
    if "n_chars" not in docs.columns:
        return unboxed(df, text=F.col("_masked"))
    chars = F.col("_row").getField("n_chars")
    return unboxed(df, text=F.col("_masked"), n_chars=F.when(F.col("_n") > 0, F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(chars))


def _sql_spans(name: str, pattern: str, guard: str) -> str:
    """start, match of every match of the pattern, from pieces and matches."""
    q, g = pattern.replace("'", "''"), guard.replace("'", "''")
    return (
        f"SELECT rid, '{name}' AS kind, CAST(len_before AS BIGINT) AS s, m AS t FROM (SELECT rid, unnest(ms) AS m, "
        f"unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))) AS len_before "
        f"FROM (SELECT rid, regexp_extract_all(text, '{q}') AS ms, string_split_regex(text, '{q}') AS ps FROM t WHERE regexp_matches(text, '{g}')))"
    )


def _secrets_sql() -> str:
    head = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" if c == "?" else "" for c in w) for w in ("password", "passwd", "secret", "token", "api?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?"
    allowed = " AND ".join(f"NOT regexp_full_match(t, '{p}')" for p in ALLOWED)
    classes = " ".join(f"WHEN regexp_matches(t, '{p}') THEN {most_clog(k)}" for k, p in ONE_CASE.items())
    one_case = " OR ".join(f"regexp_matches(t, '{p}')" for p in ONE_CASE.values())
    table = "[" + ", ".join(str(clog(c)) for c in range(WINDOW + 1)) + "]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_sql_spans("assign", head + "[A-Za-z0-9+/_.=-]+", head)} UNION ALL {_sql_spans("access", "AKIA[A-Z0-9]+", "AKIA")} UNION ALL {_sql_spans("hex", "[0-9a-f]+", "[0-9a-f]{32}")}),
base AS (SELECT rid, kind, s, s + length(t) AS e, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS k FROM raw
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(t, '^{head.replace("'", "''")}', '')) >= 8 WHEN 'access' THEN length(t) >= 16 ELSE length(t) >= 32 END),
cand AS (SELECT rid, s, t, CASE WHEN regexp_full_match(t, '[0-9a-fA-F]+') THEN {most_clog("hex")} {classes} ELSE {most_clog("base64")} END AS most FROM ({_sql_spans("entropy", CANDIDATE, CANDIDATE)})
  WHERE (regexp_full_match(t, '[0-9a-fA-F]+') OR (regexp_matches(t, '[0-9]') AND (regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') OR {one_case}))) AND {allowed}),
win AS (SELECT rid, s, most, i, unnest(string_split(substr(t, i, {WINDOW}), '')) AS c FROM (SELECT *, unnest(range(1, length(t) - {WINDOW} + 2)) AS i FROM cand)),
ent AS (SELECT rid, s, most, i, sum({table}[n + 1]) AS total FROM (SELECT rid, s, most, i, c, count(*) AS n FROM win GROUP BY ALL) GROUP BY ALL),
more AS (SELECT rid, 'entropy' AS kind, s + min(i) - 1 AS s, s + max(i) - 1 + {WINDOW} AS e, 3 AS k FROM ent WHERE total <= most GROUP BY rid, ent.s),
fresh AS (SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = more.rid AND base.s <= more.s AND more.e <= base.e)),
b AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS j FROM base GROUP BY rid),
a AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS j FROM (SELECT rid, kind, s, e, k FROM base UNION ALL SELECT rid, kind, s, e, k FROM fresh) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.j, '')) AS base_sha256, coalesce(a.j, '') AS spans
FROM t LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""


SECRETS_SQL = _secrets_sql()
