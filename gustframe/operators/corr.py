"""Rank correlation, contingency tables and cut-off sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.functions import nullsafe as ns
from gustframe.operators import positions as pos
from gustframe.session import scratch_table


def threshold_grid(start: int = 10, stop: int = 95, step: int = 5) -> list[float]:
    """Cut-offs start/100 .. stop/100 built from integers (.10, .15, ..., .95)."""
    return [i / 100 for i in range(start, stop + 1, step)]


def spearman_pairs(df: DataFrame, pairs, rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Spearman rho per column pair over the rows where both are non-NULL
    (pairwise complete), average ranks for ties: (col_a, col_b, rho, n).

    All columns go through the same few steps, so that the number of shuffles does
    not grow with the columns.  Cells (row, column, value) are aggregated to the
    distinct values of each column, with the rows of a value counted under every
    partner's non-NULL condition (partners without NULLs share one count).  Running
    sums of these counts are the value's ranks among the rows that each pair keeps.
    Columns of few values (``BROADCAST_ROWS`` in all) get their ranks by broadcast; if
    every pair has such a column, no row is shuffled: the ranks of the partners
    are added up per value of the other column (``_by_lookup``).  Else values that hold
    at least 1 / ``BROADCAST_ROWS`` of all cells (there are no more than that many) are
    looked up by broadcast, the others by a join on (column, value); the ranks are put
    together by row number, and one aggregation gives the correlation of all pairs.
    """
    pairs = list(pairs)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    index = {c: i for i, c in enumerate(cols)}
    cast = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols}
    # written, so that a row has the same number if a task is run again
    rows = scratch_table(df.select(F.monotonically_increasing_id().alias("_row"), *[cast[c].alias(f"x{i}") for c, i in index.items()]), "rows")
    filled = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"x{i}").alias(f"x{i}") for i in index.values()], *[
        F.count_if(F.col(f"x{index[a]}").isNotNull() & F.col(f"x{index[b]}").isNotNull()).alias(f"n{p}") for p, (a, b) in enumerate(pairs)]).first()
    n_cells = sum(filled[f"x{i}"] for i in index.values())
    gaps = {c for c, i in index.items() if filled[f"x{i}"] < filled["n"]}
    # the conditions under which a column is ranked: none, or a partner with NULLs
    slots = {c: {} for c in cols}
    for a, b in pairs:
        for c, partner in ((a, b), (b, a)):
            slots[c].setdefault(partner if partner in gaps else None, len(slots[c]))
    width = max((len(s) for s in slots.values()), default=0)

    def weight(c: str, j: int):
        g = next((g for g, k in slots[c].items() if k == j), "")
        return F.lit(1) if g is None else F.lit(0) if g == "" else F.col(f"x{index[g]}").isNotNull().cast("int")

    weights = [f"_w{j}" for j in range(width)]
    cells = rows.select("_row", F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(f"x{i}").alias("_v"), *[weight(c, j).alias(w) for j, w in enumerate(weights)])
        for c, i in index.items()])).alias("_cell")).select("_row", "_cell.*").filter(F.col("_v").isNotNull())
    values = cells.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(w).alias(w) for w in weights])
    small = n_cells <= rows_per_bucket
    placed = pos.running_sums(values if small else scratch_table(values, "values"), "_v", {w.replace("w", "r"): F.col(w) for w in weights}, ["_c"],
                              rows_per_bucket=rows_per_bucket, n_rows=n_cells if small else None)
    ranks = scratch_table(placed.select("_c", "_v", "_n", *weights, *[
        (F.col(w.replace("w", "r")) - (F.col(w) - 1) / 2.0).alias(w.replace("w", "r")) for w in weights]), "ranks")
    few, left = set(), pos.BROADCAST_ROWS
    for r in ranks.groupBy("_c").count().orderBy("count", "_c").collect():  # one row per column
        left -= r["count"]
        if left >= 0:
            few.add(cols[r["_c"]])
    slot = {(a, b): slots[a][b if b in gaps else None] for p in pairs for a, b in (p, p[::-1])}
    if all(a in few or b in few or not filled[f"n{p}"] for p, (a, b) in enumerate(pairs)):
        return _by_lookup(rows, ranks, pairs, index, slot, few, [filled[f"n{p}"] for p in range(len(pairs))])
    hot = F.col("_n") >= max(2.0, n_cells / pos.BROADCAST_ROWS)
    found, bare = ranks.drop("_n", *weights), cells.select("_row", "_c", "_v")
    often, seldom = F.broadcast(found.filter(hot)), found.filter(~hot)
    ranked = bare.join(often, ["_c", "_v"]).unionByName(bare.join(often, ["_c", "_v"], "left_anti").join(seldom, ["_c", "_v"]))

    def rank(c: str, partner: str) -> str:
        return f"_r{index[c]}_{slots[c][partner if partner in gaps else None]}"

    wide = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_c") == i, F.col(f"_r{j}"))).alias(f"_r{i}_{j}")
                                        for c, i in index.items() for j in range(len(slots[c]))])
    def rho(a: str, b: str):
        """Correlation of two ranks; NULL if one is the same in all rows (``corr`` divides by zero there)."""
        x, y = F.col(rank(a, b)), F.col(rank(b, a))
        spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
        return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))

    row = wide.agg(*[rho(a, b).alias(f"rho{i}") for i, (a, b) in enumerate(pairs)],
                   *[F.count_if(F.col(rank(a, b)).isNotNull() & F.col(rank(b, a)).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"rho{i}").alias("rho"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*").filter(F.col("n") > 0)


def _by_lookup(rows: DataFrame, ranks: DataFrame, pairs, index: dict, slot: dict, few: set, counts: list[int]) -> DataFrame:
    """rho of pairs of which one column at least has ``few`` values.

    With ranks measured from their mean (n + 1) / 2, rho is the sum of products over
    the root of both sums of squares.  The squares are sums over the distinct values.
    The products are sums over the rows if both columns have few values; else the
    ranks of the one that has are added up per value of the other, and these sums
    meet the ranks of the values."""
    mean = [(n + 1) / 2.0 for n in counts]
    attached = rows
    for c in (c for c in index if c in few):
        i = index[c]
        table = ranks.filter(F.col("_c") == i).select(F.col("_v").alias(f"x{i}"), *[F.col(f"_r{j}").alias(f"_r{i}_{j}") for j in {j for (a, _), j in slot.items() if a == c}])
        attached = attached.join(F.broadcast(table), f"x{i}", "left")  # at most BROADCAST_ROWS rows of all columns
    dev = lambda p, a, b: F.col(f"_r{index[a]}_{slot[a, b]}") - mean[p]
    squares = lambda p, a, b: F.sum(F.when(
        F.col("_c") == index[a], F.col(f"_w{slot[a, b]}") * F.pow(F.col(f"_r{slot[a, b]}") - mean[p], F.lit(2.0))))
    row = ranks.agg(F.lit(1), *[squares(p, a, b).alias(f"a{p}") for p, (a, b) in enumerate(pairs)], *[squares(p, b, a).alias(f"b{p}") for p, (a, b) in enumerate(pairs)])
    near = [(p, a, b) for p, (a, b) in enumerate(pairs) if a in few and b in few]
    if near:
        row = row.crossJoin(attached.agg(*[F.sum(dev(p, a, b) * dev(p, b, a)).alias(f"s{p}") for p, a, b in near]))
    wide: dict[str, list] = {}  # column of many values -> its pairs
    for p, (a, b) in enumerate(pairs):
        if not (a in few and b in few) and counts[p]:
            many, other = (b, a) if a in few else (a, b)
            wide.setdefault(many, []).append((p, many, other))
    if wide:
        most = max(map(len, wide.values()))
        cells = attached.select(F.explode(F.array(*[F.struct(F.lit(index[c]).alias("_c"), F.col(f"x{index[c]}").alias("_v"), *[
            (dev(own[j][0], own[j][2], c) if j < len(own) else F.lit(None).cast("double")).alias(f"_d{j}") for j in range(most)])
            for c, own in wide.items()])).alias("_cell")).select("_cell.*").filter(F.col("_v").isNotNull())
        sums = cells.groupBy("_c", "_v").agg(*[F.sum(f"_d{j}").alias(f"_d{j}") for j in range(most)])
        met = sums.join(ranks.filter(F.col("_c").isin([index[c] for c in wide])), ["_c", "_v"])
        row = row.crossJoin(met.agg(*[F.sum(F.when(F.col("_c") == index[c], F.col(f"_d{j}") * (F.col(f"_r{slot[c, b]}") - mean[p]))).alias(f"s{p}")
                                      for c, own in wide.items() for j, (p, _, b) in enumerate(own)]))
    known = [(p, a, b) for p, (a, b) in enumerate(pairs) if counts[p]]
    one = lambda p, a, b: F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), (
        F.col(f"s{p}") / F.nullif(F.sqrt(F.col(f"a{p}")) * F.sqrt(F.col(f"b{p}")), F.lit(0.0))).alias("rho"), F.lit(counts[p]).cast("long").alias("n"))
    if not known:
        return row.select(F.lit("").alias("col_a"), F.lit("").alias("col_b"), F.lit(0.0).alias("rho"), F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    return row.select(F.explode(F.array(*[one(*k) for k in known])).alias("p")).select("p.*")


def spearman_matrix(df: DataFrame, columns, symmetric: bool = False,
                    rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """All-pairs rank correlation in long form (upper triangle by default)."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    upper = spearman_pairs(df, pairs, rows_per_bucket)
    if not symmetric:
        return upper
    lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "rho", "n")
    diag = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_a"), F.col(c).alias("v"))
                                         for c in columns])).alias("d")).select("d.*")
    diag = diag.filter(F.col("v").isNotNull()).groupBy("col_a").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("_nd"))
    diag = diag.select("col_a", F.col("col_a").alias("col_b"),
                       F.when(F.col("_nd") > 1, F.lit(1.0)).alias("rho"), "n")
    return upper.unionByName(lower).unionByName(diag)


def error_correlation(df: DataFrame, residual: str, features,
                      rows_per_bucket: int = pos.DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Rank correlation of the residual with each feature, sorted by value."""
    r = spearman_pairs(df, [(residual, f) for f in features], rows_per_bucket)
    return r.select(F.col("col_b").alias("feature"), "rho", "n").orderBy("rho", "feature")


def crosstab(df: DataFrame, a: str, b: str, values=None) -> DataFrame:
    """Contingency table a x b; missing cells are 0.  Pass ``values`` to skip
    the scan that finds the distinct values of ``b``."""
    src = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    t = src.groupBy(a).pivot(b, values).count()
    return t.na.fill(0)


def confusion_accuracy(df: DataFrame, label: Column, pred: Column) -> DataFrame:
    """Confusion counts and accuracy = trace / real row count."""
    y, p = ns.keep(label), ns.keep(pred)
    return df.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                  F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"),
                  F.count(F.lit(1)).alias("n")) \
        .withColumn("accuracy", (F.col("tn") + F.col("tp")) / F.col("n"))


def threshold_sweep(df: DataFrame, score: str, label: Column, grid=None) -> DataFrame:
    """Accuracy of ``score > t`` against ``label`` at every cut-off ``t``: one
    aggregation with two conditional counts per cut-off, then unpivoted."""
    grid = grid or threshold_grid()
    s, y = F.col(score), ns.keep(label)
    aggs = []
    for i, t in enumerate(grid):
        hit = ns.keep(s > F.lit(float(t)))
        aggs += [F.count_if(hit & y).alias(f"tp{i}"), F.count_if(~hit & ~y).alias(f"tn{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    out = row.select(F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"tn{i}").alias("tn"),
                 F.col("n").alias("n")) for i, t in enumerate(grid)])).alias("r")).select("r.*")
    return out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The cut-off of the best accuracy (the least one of equals)."""
    return sweep.orderBy(F.desc("accuracy"), "threshold").limit(1)
