"""Chat formatting by multi-party perspective rotation (JVM expressions only).

Every speaker of a conversation becomes the assistant once: in that perspective their turns are assistant turns that
are trained on, all others are named users, and system turns stay system turns. A rendered dialogue is kept as
segments, one row per turn: concatenated by `seq` they are the text, `start`/`end` are code points in it (end
exclusive), and `mask_start`/`mask_end` bound the part that is trained on (text and end mark), null elsewhere.

Segments keep a dialogue of any length out of one row. All turns are sorted once over the whole table (by ranges, so a
conversation that holds a third of all rows lies in many partitions, and so do many turns of one number) and written with
their place. Offsets are then found on places and lengths alone, in three levels: within CHUNK places, within CHUNK
chunks, and over the rest; the texts come in last, each once, whatever the number of speakers.

Defined cases: a null text is empty, a null role is a speaker named ''; a conversation of system turns alone has no
perspective and gives no rows; null conv_ids form one conversation, null turns come first; rows of equal turn follow
role, then text, and repeated rows are repeated turns; marks and line ends inside roles and texts stand as they are; an
empty table gives an empty table; columns other than conv_id, turn, role and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialised

CHUNK = 256
HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _head(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit(HEAD + "user name="), role, F.lit("\n"))
    return F.when(role == SYSTEM, F.lit(f"{HEAD}system\n")).when(role == speaker, F.lit(f"{HEAD}assistant\n")).otherwise(named)


def _sums(rows: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """rows (by, place, size) with `seq` and `end`: their number and the sum of sizes up to and with each, in order of place."""
    upto = lambda *keys: Window.partitionBy(*keys).orderBy
    rows = rows.withColumn("chunk", F.expr(f"place div {chunk}"))
    inner = upto(*by, "chunk")("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"seq": F.count(F.lit(1)).over(inner), "end": F.sum("size").over(inner)})
    sums = rows.groupBy(*by, "chunk").agg(F.max("seq").alias("n"), F.max("end").alias("m")).withColumn("part", F.expr(f"chunk div {chunk}"))
    mid = upto(*by, "part")("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"n_to": F.sum("n").over(mid), "m_to": F.sum("m").over(mid)})
    tops = sums.groupBy(*by, "part").agg(F.max("n_to").alias("n_all"), F.max("m_to").alias("m_all"))
    before = upto(*by)("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    tops = tops.select(*by, "part", F.coalesce(F.sum("n_all").over(before), zero).alias("n0"), F.coalesce(F.sum("m_all").over(before), zero).alias("m0"))
    starts = sums.join(tops, [*by, "part"]).select(*by, "chunk", (F.col("n0") + F.col("n_to") - F.col("n")).alias("n0"), (F.col("m0") + F.col("m_to") - F.col("m")).alias("m0"))
    return rows.join(starts, [*by, "chunk"]).withColumns({"seq": F.col("seq") + F.col("n0"), "end": F.col("end") + F.col("m0")}).drop("chunk", "n0", "m0")


def rotate(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, perspective, seq (from 1), turn, role, segment, start, end, mask_start, mask_end."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("conv"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialised(placed, "turns")  # written once, so every row keeps its place
    speakers = placed.where(F.col("role") != SYSTEM).select("conv", F.col("role").alias("perspective")).distinct()
    each = placed.select("conv", "place", "role", F.length("text").alias("chars")).join(speakers, "conv")
    head = F.length(_head(F.col("role"), F.col("perspective"))).cast("long")
    each = each.select("conv", "perspective", "place", (head + F.col("chars") + len(TAIL)).alias("size"))
    ends = _sums(each, ["conv", "perspective"], chunk)
    views = ends.groupBy("place").agg(F.collect_list(F.struct("perspective", "seq", "end")).alias("views"))  # one for each speaker
    out = placed.drop("conv").join(views, "place").withColumn("view", F.explode("views"))
    out = out.select("conv_id", "view.*", "turn", "role", "text").withColumn("head", _head(F.col("role"), F.col("perspective")))
    out = out.withColumn("segment", F.concat("head", "text", F.lit(TAIL))).withColumn("start", F.col("end") - F.length("segment"))
    mine = F.col("role") == F.col("perspective")
    return out.select(
        "conv_id", "perspective", "seq", "turn", "role", "segment", "start", "end",
        F.when(mine, F.col("start") + F.length("head")).alias("mask_start"), F.when(mine, F.col("end") - 1).alias("mask_end"),
    )


def render(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text: segments put together; for conversations that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment")))
    return segments.groupBy("conv_id", "perspective").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("text"))


CHAT_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT c, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
e AS (SELECT t.*, perspective, CASE WHEN role = '{SYSTEM}' THEN '{HEAD}system' WHEN role = perspective THEN '{HEAD}assistant' ELSE '{HEAD}user name=' || role END || chr(10) AS head FROM t JOIN p USING (c)),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM e),
o AS (SELECT *, row_number() OVER w AS seq, CAST(sum(length(segment)) OVER w AS BIGINT) AS "end" FROM s
  WINDOW w AS (PARTITION BY c, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, seq, turn, role, segment, "end" - length(segment) AS start, "end",
  CASE WHEN role = perspective THEN "end" - length(segment) + length(head) END AS mask_start, CASE WHEN role = perspective THEN "end" - 1 END AS mask_end FROM o
"""
