"""Chat formatting with a cumulative-snapshot collapse.

Logged conversations often hold earlier snapshots of themselves. Every turn gets
a rolling hash of all turns up to it; a conversation whose last hash is the hash
of an inner turn of a longer one is a snapshot of that one and goes (anti-join);
of equal conversations the least conv_id stays. The rest is rendered.

The rolling hash is the running sum of two 64-bit hashes of (position, role,
text): a running sum can be split, so a conversation that holds a third of all
turns is worked on in pieces of ``PIECE`` turns, whose totals are summed up per
conversation. Pieces are cut by position, not by turn number, so many rows with one
turn number (or none) make many pieces: a range shuffle by (conv_id, turn, role,
text) deals the distinct rows out, and the counts of a conversation's earlier
partitions place each row. Hashes of inner turns are made distinct before the anti-join and
equal conversations grouped, so a first turn or a whole conversation that is very
common is one row on either side. Rendered text comes in segments of ``PIECE``
turns as well (nearly always one), to be joined in order.

Defined results: turns are ordered by turn (null first), role and text; a turn
logged twice with equal role and text counts once; rows with a null conv_id are
one conversation with id null; a null role or text differs from the empty one in
comparing and is rendered as empty; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import store

#: Turns that are worked on together, and rows of a range partition.
PIECE, ROWS_PER_PART = 1024, 2_000_000
START, END = "<|im_start|>", "<|im_end|>"


def collapse_and_render(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations), segment, text of every
    maximal conversation."""
    keys = ["conv_id", "piece"]
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // ROWS_PER_PART))
    rows = store(turns.select("conv_id", "turn", "role", "text").distinct()
                 .repartitionByRange(parts, F.col("conv_id").asc_nulls_first(), *order)
                 .withColumn("part", F.spark_partition_id()), "chat-turns")

    # positions: turns in earlier partitions, one row per conversation and partition
    dealt = ["conv_id", "part"]
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*dealt).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rows = rows.withColumn("in_part", F.row_number().over(Window.partitionBy(*dealt).orderBy(*order)))
    placed = _with(rows, counts.select(*dealt, "first"), dealt).withColumn("pos", F.col("first") + F.col("in_part"))
    placed = store(placed.select("conv_id", "role", "text", "pos", F.expr(f"(pos - 1) div {piece}").alias("piece"),
                                 F.expr(f"(pos - 1) % {piece}").alias("nth")), "chat-places")
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    tag = lambda seed: F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)")
    upto = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    inner = store(placed.select(*keys, "nth", "pos", tag(1).alias("x"), tag(2).alias("y"))
                  .withColumns({"x": F.sum("x").over(upto), "y": F.sum("y").over(upto)}), "chat-hashes")
    ends = inner.groupBy(*keys).agg(F.max_by(F.struct("x", "y"), "nth").alias("e")).select(
        *keys, *(F.coalesce(F.sum(f"e.{c}").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"{c}0") for c in "xy"))
    rolling = _with(inner, ends, keys).select(
        "conv_id", "pos", *((F.col(c) + F.col(f"{c}0")).cast("decimal(38,0)").alias(c) for c in "xy"))

    lengths = rolling.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by(F.struct("x", "y"), "pos").alias("h"))
    lengths = store(lengths.select("conv_id", "n_turns", "h.x", "h.y"), "chat-ends")
    whole = lengths.groupBy("n_turns", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    sizes = lengths.select(F.col("conv_id").alias("c"), "n_turns")
    prefixes = (rolling.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).where("pos < n_turns")
                .select(F.col("pos").alias("n_turns"), "x", "y").distinct())
    kept = whole.join(prefixes, ["n_turns", "x", "y"], "left_anti").select(F.col("conv_id").alias("c"), "n_turns", "n_copies")

    line = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    shown = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
    parts = shown.groupBy("conv_id", "n_turns", "n_copies", "piece").agg(
        F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return parts.select("conv_id", "n_turns", "n_copies", F.col("piece").cast("int").alias("segment"), text.alias("text"))


def _with(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe join of values by two keys."""
    s = small.select(*(F.col(k).alias(f"{k}_") for k in keys), *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return rows.join(s, on[0] & on[1]).drop(*(f"{k}_" for k in keys))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns,
        list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
        string_agg('{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10), ''
          ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
      FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, n_turns)) AS i FROM c)),
w AS (SELECT n_turns, l, text, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY n_turns, l, text)
SELECT conv_id, n_turns, n_copies, CAST(0 AS INTEGER) AS segment, text FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = w.l)
"""
