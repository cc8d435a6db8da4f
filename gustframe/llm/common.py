"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gustframe.session import scratch_path, ship_package

#: Rows up to which a per-key result is broadcast; beyond it a shuffled join runs.
BROADCAST_ROWS = 20_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a stored per-key table: broadcast after its rows are counted, a
    shuffled join (skew left to adaptive execution) beyond ``BROADCAST_ROWS``."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, on, how)


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of equally named columns of two tables."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


#: Edges up to which one task finds the components (16 MB of numbers), and the
#: number of nodes whose edges may be looked up by broadcast.
EDGES, CENTRES = 1 << 20, 20_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``, whose nodes are longs, as rows (node,
    label), where the label is the component's least node; a label's own row is
    left out.

    Up to ``EDGES`` distinct edges are labelled in one task. Larger graphs take
    alternating large-star and small-star rounds: the edges of a component shrink
    to a star. Every round is a written table, so a lost executor repeats one round
    at most. A round looks up the least neighbour of each edge's node; those of
    nodes with at least 1 / ``CENTRES`` of all edge ends, hence of at most that
    many nodes, are broadcast, so that the centre of a star is no key of a join.
    """
    now = store(edges.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = _mark(now)
    if mark[0] <= EDGES:
        return store(map_arrow(now.coalesce(1), _labels, "node long, label long"), name) if mark[0] else now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0], name).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = store(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, mark[0], name).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _with_least(edges: DataFrame, ends: int, name: str) -> DataFrame:
    """``edges(u, v)`` with ``m``, the least ``v`` of ``u``."""
    least = store(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), name)
    bar = max(2, -(-ends // CENTRES))
    centre = F.broadcast(least.where(F.col("degree") >= bar).drop("degree"))
    rest = edges.join(centre, "u", "left_anti").join(least.where(F.col("degree") < bar).drop("degree"), "u")
    return edges.join(centre, "u").unionByName(rest)


def _labels(batches):
    """The least node of each node's component, all edges in one task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(c) for c in zip(*held, strict=True))
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    for at in range(0, len(other), 1 << 16):
        part = other[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[label[part]])], names=["node", "label"])


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches, rows: int = 512, mb: int = 16):
    """Cut Arrow batches into pieces of bounded rows and bytes, so that a task
    holds the working data of a few texts only."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() > mb << 20 and _bytes(batch, at, n) > mb << 20:
                n //= 2
            yield batch.slice(at, n)
            at += n


def _bytes(batch, at: int, n: int) -> int:
    return batch.slice(at, n).nbytes
