"""Exact positions, ranks and quantiles without a one-task window.

``Window.orderBy(x)`` without ``partitionBy`` moves the whole table into one
task, and ``partitionBy(unit)`` moves a hot unit (a third of the rows) into one
task.  Instead:

1. deal the rows to ranges of about ``rows_per_bucket`` rows of the composite key
   (group, order key, tie columns, hash of the row, row number).  Spark samples
   the range bounds; a hot group, one order key on a third of the rows or rows
   repeated in full are cut as well, since the last part of the key is unique.
   The ranges are written with their number, so that they are the same in all
   later steps;
2. count rows per (group, range);
3. prefix-sum those counts per group (a window over the small table);
4. number rows inside each (group, range) with a window and add the offset.

Every step is exact; the bounds only decide how rows are spread over tasks, so the
rows are the same at any ``rows_per_bucket``.  Rows that agree in the order key and
all tie columns are put in order by a hash of the row.  NULL groups are groups like
any other (all joins are null-safe).

Average ranks pre-aggregate to (group, value, count) first, so a value repeated
on a third of all rows is a single row.  Exact quantiles bracket each wanted
position by two approximate quantiles, count the rows below the bracket and sort
only the rows inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustframe.session import scratch_table

DEFAULT_ROWS_PER_BUCKET = 1_000_000
# Rows up to which a table of cut points, offsets or brackets is broadcast;
# larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
# Ranges that one shuffle is cut into, as long as they hold no more than
# ``DEFAULT_ROWS_PER_BUCKET`` rows each: Spark sends a sample of about 300 rows per
# range to the driver to find the bounds.
MOST_RANGES = 256


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: the order of rows whose keys tie."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and t != "variant"])


def counted_side(table: DataFrame) -> DataFrame:
    """Broadcast hint for a per-group or per-piece table whose rows are counted."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if few else table


def join_null_safe(df: DataFrame, side: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which NULL matches NULL; no columns are doubled."""
    keys = list(keys)
    renamed = side.withColumnsRenamed({k: f"{k}__side" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}__side"))
    return df.join(renamed, cond, how).drop(*[f"{k}__side" for k in keys])


def join_by_value(df: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """Left join of per-value results.  NULL values match nothing and are dealt
    over all partitions, instead of meeting in one."""
    deal = F.when(F.col(value).isNull(), (F.rand(5) * 1024).cast("int")).otherwise(F.lit(0))
    renamed = side.withColumnRenamed(value, "_value_side").withColumn("_deal_side", F.lit(0))
    return (df.withColumn("_deal", deal)
            .join(renamed, (F.col(value) == F.col("_value_side")) & (F.col("_deal") == F.col("_deal_side")), "left")
            .drop("_value_side", "_deal", "_deal_side"))


def in_ranges(df: DataFrame, keys, rows_per_bucket: int, n_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``_bkt``, the number of a range of the composite key ``keys`` (NULLs
    first) of about ``rows_per_bucket`` rows, or more if that makes more than
    ``MOST_RANGES`` of them; ranges ascend in the key.  Returns (df, whether there
    is more than one); a known row count saves the count.

    The rows are written twice: with a number of their own, which makes the key
    unique and the ranges the same if a task is run again, and by range."""
    n = df.count() if n_rows is None else n_rows
    if n <= rows_per_bucket:
        return df.withColumn("_bkt", F.lit(0).cast("long")), False
    numbered = scratch_table(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    n_ranges = min(-(-n // rows_per_bucket), max(MOST_RANGES, -(-n // DEFAULT_ROWS_PER_BUCKET)))
    dealt = numbered.repartitionByRange(n_ranges, *[F.col(f"`{k}`") for k in keys], row_hash(df), F.col("_row"))
    return scratch_table(dealt.drop("_row").withColumn("_bkt", F.spark_partition_id().cast("long")), "ranges"), True


def running_sums(df: DataFrame, order_col: str, sums: dict, group_cols=(), tie_cols=(),
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, n_rows: int | None = None,
                 max_group_rows: int | None = None, unique: bool = True) -> DataFrame:
    """Add inclusive running sums (``sums``: output name -> weight column) in
    order of (order_col, *tie_cols) within ``group_cols``; unless that order is
    ``unique``, a hash of the row comes last."""
    group_cols, order = list(group_cols), [order_col, *tie_cols]
    if max_group_rows is not None and max_group_rows <= rows_per_bucket:
        b, cut = df.withColumn("_bkt", F.lit(0).cast("long")), False
    else:
        b, cut = in_ranges(df, [*group_cols, *order], rows_per_bucket, n_rows)
    last = [] if unique else [row_hash(df)]
    upto = (Window.partitionBy(*group_cols, "_bkt").orderBy(*[F.col(c).asc_nulls_first() for c in order], *last)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not cut:
        return b.withColumns({o: F.sum(w).over(upto).cast("long") for o, w in sums.items()}).drop("_bkt")
    counts = b.groupBy(*group_cols, "_bkt").agg(*[F.sum(w).alias(f"_b_{o}") for o, w in sums.items()])
    before = Window.partitionBy(*group_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = scratch_table(counts.select(*group_cols, "_bkt", *[
        F.coalesce(F.sum(f"_b_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums]), "offsets")
    joined = join_null_safe(b, counted_side(offs), [*group_cols, "_bkt"], "inner")
    return (joined.withColumns({o: (F.col(f"_off_{o}") + F.sum(w).over(upto)).cast("long") for o, w in sums.items()})
            .drop("_bkt", *[f"_off_{o}" for o in sums]))


def running_position(df: DataFrame, order_col: str, group_cols=(), tie_cols=(), weight_col: str | None = None,
                     rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, out: str = "_pos", n_rows: int | None = None,
                     max_group_rows: int | None = None, unique: bool = True) -> DataFrame:
    """Add ``out`` = inclusive running sum of the weight (1 per row by default).

    With a total order and unit weights this is ``row_number()``; with
    pre-aggregated (value, count) rows it is the last position of the value.
    """
    w = F.col(weight_col) if weight_col else F.lit(1)
    return running_sums(df, order_col, {out: w}, group_cols, tie_cols, rows_per_bucket, n_rows, max_group_rows, unique)


def row_number_global(df: DataFrame, order_col: str, tie_cols=(), group_cols=(), out: str = "_rn",
                      rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET, n_rows: int | None = None) -> DataFrame:
    """Exact ``row_number()``, optionally per group; rows that tie in all keys are
    numbered in order of a hash of the row."""
    return running_position(df, order_col, group_cols=group_cols, tie_cols=tie_cols,
                            rows_per_bucket=rows_per_bucket, out=out, n_rows=n_rows, unique=False)


def hash_order_key(id_col: str, seed: str | int) -> dict[str, Column]:
    """Portable pseudo-random order: md5('<seed>:<id>'), plus a numeric prefix
    (first 15 hex digits) that has the same order and serves for bucketing."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return {"_h": h, "_hnum": F.conv(F.substring(h, 1, 15), 16, 10).cast("double")}


def ntile_from_rank(rn: Column, n: Column, k: int) -> Column:
    """``ntile(k)`` computed from a 1-based row number and the row count."""
    q = F.floor(n / k)
    r = n - q * k
    big = q + 1
    first = F.floor((rn - 1) / big) + 1
    second = r + F.floor((rn - 1 - r * big) / q) + 1
    return F.when(rn <= r * big, first).otherwise(second).cast("int")


def _source_sizes(df: DataFrame, group_cols) -> tuple[int, int]:
    """(total rows, rows of the largest group) from one map-side aggregation of
    the source; bounds the size of any de-duplicated table built from it."""
    group_cols = list(group_cols)
    if not group_cols:
        n = df.count()
        return n, n
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("t"), F.max("_n").alias("m")).first()
    return int(sizes["t"] or 0), int(sizes["m"] or 0)


def average_rank(df: DataFrame, value_col: str, group_cols=(), out: str = "_rank",
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Distinct (group, value) -> average 1-based rank of the value (ties share
    the mean of their positions).  NULL values are not ranked."""
    group_cols = list(group_cols)
    src = df.filter(F.col(value_col).isNotNull())
    total, largest = _source_sizes(src, group_cols)
    d = src.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    p = running_position(d, value_col, group_cols, weight_col="_cnt", rows_per_bucket=rows_per_bucket,
                         n_rows=total if not group_cols else None, max_group_rows=largest)
    return p.select(*group_cols, value_col, "_cnt",
                    (F.col("_pos") - (F.col("_cnt") - 1) / 2.0).alias(out))


def exact_quantiles(df: DataFrame, value_col: str, probs, group_cols=(), out: str = "value",
                    prob_col: str = "q", rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                    accuracy: int = 10_000) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``percentile`` / ``quantile_cont``)
    per group, long form (group..., q, value).  NULLs and NaNs are skipped; a
    NULL group is a group.

    One ``percentile_approx`` pass brackets every wanted position by the
    approximate quantiles 2 / ``accuracy`` of the rows to either side (its error
    is at most 1 / ``accuracy``; small groups are bracketed whole).  A second,
    map-side pass counts the rows below each bracket and counts the values
    inside; only these, a few ten-thousandths of a large group, are shuffled and
    put in order.
    """
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    v = (df.select(*group_cols, (F.col(value_col).cast("double") + F.lit(0.0)).alias("_v"))
         .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    margin = 2.0 / accuracy
    near = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    stats = v.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                       F.percentile_approx("_v", near, accuracy).alias("_b"))
    k = len(probs)
    whole = F.col("_n") <= accuracy
    brackets = F.array(*[F.struct(
        F.lit(i).alias("i"),
        F.when(whole | F.lit(near[i] == 0.0), F.col("_min")).otherwise(F.col("_b")[i]).alias("lo"),
        F.when(whole | F.lit(near[k + i] == 1.0), F.col("_max")).otherwise(F.col("_b")[k + i]).alias("hi"),
        (F.floor(F.lit(p) * (F.col("_n") - 1)) + 1).alias("first"),
        F.least(F.floor(F.lit(p) * (F.col("_n") - 1)) + 2, F.col("_n")).alias("second")) for i, p in enumerate(probs)])
    stats = scratch_table(stats.filter(F.col("_n") > 0).select(*group_cols, "_n", brackets.alias("_want")), "brackets")
    # a bracket spans at most 6 / accuracy of a group's ranks (margins and errors)
    largest = stats.agg(F.max("_n")).first()[0] or 0
    most = max(accuracy, -(-6 * largest // accuracy)) + 2
    near_rows = join_null_safe(v, counted_side(stats.drop("_n")), group_cols, "inner") if group_cols else _with_row(v, stats.drop("_n"))

    # map-side: rows below a bracket count under NULL, values inside under themselves
    touched = near_rows.select(*group_cols, "_v", F.explode(F.filter("_want", lambda w: F.col("_v") <= w["hi"])).alias("_w"))
    counts = touched.groupBy(*group_cols, F.col("_w.i").alias("_i"),
                             F.when(F.col("_v") >= F.col("_w.lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_cnt"))
    placed = running_position(counts, "_v", [*group_cols, "_i"], weight_col="_cnt", rows_per_bucket=rows_per_bucket,
                              max_group_rows=most)
    placed = placed.filter(F.col("_v").isNotNull())  # NULL, the rows below, comes first
    flat = stats.select(*group_cols, "_n", F.explode("_want").alias("_w")).select(
        *group_cols, "_n", F.col("_w.i").alias("_i"), F.col("_w.first").alias("_first"), F.col("_w.second").alias("_second"))
    joined = join_null_safe(placed, counted_side(flat), [*group_cols, "_i"], "inner")
    here = lambda c: (F.col(c) > F.col("_pos") - F.col("_cnt")) & (F.col(c) <= F.col("_pos"))
    agg = joined.groupBy(*group_cols, "_i", "_n").agg(F.max(F.when(here("_first"), F.col("_v"))).alias("_lo"),
                                                      F.max(F.when(here("_second"), F.col("_v"))).alias("_hi"))
    qv = F.element_at(F.array(*[F.lit(q) for q in probs]), F.col("_i") + 1)
    h = qv * (F.col("_n") - 1)
    frac = h - F.floor(h)
    value = F.when(frac == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac)
    return agg.select(*group_cols, qv.alias(prob_col), value.alias(out))


def _with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach a one-row table's arrays as literals (no row: no rows)."""
    row = one.first()
    if row is None:
        return df.filter(F.lit(False)).withColumns({c: F.lit(None).cast(t) for c, t in one.dtypes})
    lits = {c: F.array(*[F.struct(*[F.lit(w[f]).alias(f) for f in w.__fields__]) for w in row[c]]) for c in one.columns}
    return df.withColumns(lits)


def exact_median(df: DataFrame, value_col: str, group_cols=(), out: str = "median",
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    return exact_quantiles(df, value_col, [0.5], group_cols, out=out,
                           rows_per_bucket=rows_per_bucket).drop("q")


def exact_quantiles_wide(df: DataFrame, value_col: str, probs, group_cols=(), names=None,
                         rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Same as :func:`exact_quantiles`, one column per probability."""
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    long = exact_quantiles(df, value_col, probs, group_cols, rows_per_bucket=rows_per_bucket)
    aggs = [F.max(F.when(F.col("q") == F.lit(float(p)), F.col("value"))).alias(nm) for p, nm in zip(probs, names)]
    return long.groupBy(*group_cols).agg(*aggs)


def column_medians(df: DataFrame, columns, group_cols=(), rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Exact median of many numeric columns in one distributed pass:
    unpivot to (group..., column, value), then quantiles grouped by column."""
    group_cols = list(group_cols)
    long = df.select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_cv"))
    long = long.select(*group_cols, F.col("_cv.column").alias("column"), F.col("_cv.v").alias("v"))
    return exact_median(long, "v", [*group_cols, "column"], rows_per_bucket=rows_per_bucket)
