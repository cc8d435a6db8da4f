"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per dimension (1 where the value is above 0). Codes are
cut into m segments of about log2(number of codes) - 3 bits (a few codes share a
segment value), and every segment value is an index key. Round s looks up, for
each query and segment, all values that differ from the query's segment in exactly
s bits. When j segments have been looked up so, every code within distance
m * s + j - 1 has been met (else j segments would differ in more than s bits and
the others in s or more). A query whose k-th verified distance is within that
radius is done; one with k candidates looks up no more segments than its radius
needs to reach the k-th of them; the others go on with s + 1. A pair is verified
once, in the first segment of its least segment distance, and only if it can still
enter the top k.

Equal codes are one index entry with their k + 1 least ids (no other can enter a
top k ordered by distance and id), and queries with equal codes are one search,
so a vector that makes up a third of the rows is one key.

A query far from all others would need ever more lookups. Once those of its next
round exceed the number of codes, it is finished by a scan instead: blocks of such
queries against groups of all codes, each pair of a block and a group a task's work
that keeps k + 1 codes per query. The result is the same.

Defined results: neighbours are ordered by distance, then id; a query's own id is
no neighbour of it; rows with a null id, or a null vector or one of another
length, are neither found nor answered; a repeated (id, code) row counts once;
with fewer than k others all of them are returned; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gustframe.session import ship_package

from .common import store

#: Lookups of a round, as a share of the codes, beyond which a query is finished by a scan.
SCAN_SHARE = 1.0
#: Queries in a block and codes in a group of the scan.
SCAN_QUERIES, SCAN_CODES = 4_096, 65_536


def binary_codes(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """id and code: an array of 64-bit words, the sign bits of the vector."""
    words = [F.aggregate(F.transform(F.slice("v", w * 64 + 1, min(64, dims - w * 64)),
                                     lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
                         F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)) for w in range(-(-dims // 64))]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims))
    return rows.select("id", F.array(*words).alias("code"))


def _segment(code, at: int, bits: int):
    """``bits`` bits of a code from bit ``at`` on."""
    w, off = divmod(at, 64)
    low = F.shiftrightunsigned(code[w], off)
    if off + bits > 64:
        low = low.bitwiseOR(F.shiftleft(code[w + 1], 64 - off))
    return low.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _flips(p, bits: list[int], s: int):
    """The masks of ``s`` bits of a segment as parts (array of masks of its low half, array
    of masks of its high half): only masks of halves are in the plan."""
    def halves(b: int):
        low = b // 2
        of = lambda n, at, c: [sum(1 << (i + at) for i in x) for x in combinations(range(n), c)]
        return [(of(low, 0, c), of(b - low, low, s - c)) for c in range(max(0, s - (b - low)), min(s, low) + 1)]

    out = F.lit(None)
    for b in set(bits):
        parts = F.array(*(F.struct(F.lit(lo).cast("array<long>").alias("lo"), F.lit(hi).cast("array<long>").alias("hi")) for lo, hi in halves(b)))
        out = F.when(p.isin([j for j, x in enumerate(bits) if x == b]), parts).otherwise(out)
    return out


def _nearest(k: int):
    """The k + 1 codes of a group next to each query of a block, by distance and least id."""
    def run(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(asked):
            codes = codes.iloc[np.argsort(codes["ids"].map(lambda x: x[0]).to_numpy(), kind="stable")]
            held, qs = (np.array(c.tolist(), dtype=np.int64).view(np.uint64) for c in (codes["code"], asked["q"]))
            place, ids = np.arange(len(held), dtype=np.int64), codes["ids"].tolist()
            keep = min(k + 1, len(held))
            for q in qs:
                far = np.bitwise_count(held ^ q).sum(axis=1, dtype=np.int64)
                key = far * len(held) + place  # all keys differ
                for at in np.argpartition(key, keep - 1)[:keep]:
                    out.append((q.view(np.int64).tolist(), int(far[at]), ids[at]))
        return pd.DataFrame(out, columns=["q", "distance", "ids"])
    return run


def _scan(asked: DataFrame, ids: DataFrame, n: int, k: int) -> DataFrame:
    """q, distance and ids of the codes next to each query code, by comparing all ``n`` codes."""
    ship_package(ids.sparkSession)
    blocks, groups = -(-asked.count() // SCAN_QUERIES), -(-n // SCAN_CODES)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    of = lambda col, c: F.pmod(F.xxhash64(col), F.lit(c)).cast("int")
    left = ids.select("code", "ids", of("code", groups).alias("part"), every(blocks).alias("block")).groupBy("block", "part")
    right = asked.select(F.col("code").alias("q"), of("code", blocks).alias("block"), every(groups).alias("part")).groupBy("block", "part")
    found = left.cogroup(right).applyInPandas(_nearest(k), "q array<long>, distance int, ids array<long>")
    return found.select("q", "distance", F.explode("ids").alias("id"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, dims: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance."""
    codes = store(binary_codes(vectors, id_col, vec_col, dims).distinct(), "mih-codes")
    least = Window.partitionBy("code").orderBy("id")
    ids = (codes.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1)
           .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    ids = store(ids, "mih-ids")
    n = ids.count()
    m = max(1, round(dims / min(24, max(8, math.log2(max(n, 2)) - 3))))
    bits = [dims // m + (j < dims % m) for j in range(m)]
    at = [sum(bits[:j]) for j in range(m)]
    segments = F.array(*(F.struct(F.lit(j).alias("j"), _segment(F.col("code"), at[j], bits[j]).alias("value")) for j in range(m)))
    index = store(ids.select("code", "ids", F.explode(segments).alias("s")).select("s.*", "code", "ids"), "mih-index")

    asked = store(binary_codes(queries, id_col, vec_col, dims).distinct(), "mih-queries")
    active = asked.select("code").distinct().withColumns({"worst": F.lit(dims), "full": F.lit(False)})
    pool, scanned = None, []
    words = range(-(-dims // 64))
    dist = sum((F.bit_count(F.col("q")[w].bitwiseXOR(F.col("code")[w])) for w in words), F.lit(0))
    for s in range(max(bits) + 1):
        parts = [F.bit_count(_segment(F.col("q"), at[j], bits[j]).bitwiseXOR(_segment(F.col("code"), at[j], bits[j]))) for j in range(m)]
        first = F.lit(False)  # this segment is the first of the least segment distance
        for j in range(m):
            ok = F.col("j") == j
            for i in range(m):
                if i != j:
                    ok = ok & ((parts[i] > s) if i < j else (parts[i] >= s))
            first = first | ok
        probes = F.array(*(F.struct(F.lit(j).alias("j"), _segment(F.col("q"), at[j], bits[j]).alias("own")) for j in range(m)))
        reach = F.when(F.col("full"), F.least(F.lit(m), F.col("worst") - (m * s - 1))).otherwise(F.lit(m))
        active = active.withColumn("segments", reach)
        cost = [sum(math.comb(b, s) for b in bits[:j + 1]) for j in range(m)]  # lookups of a query with j + 1 segments
        if cost[-1] > SCAN_SHARE * n:
            dear = F.element_at(F.array(*[F.lit(c) for c in cost]), F.col("segments")) > F.lit(SCAN_SHARE * n)
            far = store(active.where(dear).select("code"), "mih-far")
            if far.take(1):
                scanned.append(_scan(far, ids, n, k))
                pool = pool if pool is None else store(pool.join(far.withColumnRenamed("code", "q"), "q", "left_anti"), "mih-pool")
                active = store(active.where(~dear), "mih-active")
                if not active.take(1):
                    break
        looked = (active.withColumnRenamed("code", "q").withColumn("p", F.explode(F.slice(probes, F.lit(1), F.col("segments"))))
                  .select("q", "worst", "p.j", "p.own", F.explode(_flips(F.col("p.j"), bits, s)).alias("half"))
                  .select("q", "worst", "j", "half.hi", F.col("own"), F.explode("half.lo").alias("low"))
                  .select("q", "worst", F.col("j").alias("pj"), F.col("own").bitwiseXOR(F.col("low")).alias("own"), F.explode("hi").alias("high"))
                  .select("q", "worst", "pj", F.col("own").bitwiseXOR(F.col("high")).alias("pv")))
        # lookups grow with the queries and have no size known beforehand: never broadcast
        hits = (index.join(looked.hint("merge"), (F.col("j") == F.col("pj")) & (F.col("value") == F.col("pv")) & (dist <= F.col("worst")) & first)
                .select("q", dist.alias("distance"), F.explode("ids").alias("id")))
        ranked = Window.partitionBy("q").orderBy("distance", "id")
        new = hits if pool is None else hits.unionByName(pool)
        pool = store(new.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1).drop("nth"), "mih-pool")
        kth = pool.groupBy("q").agg(F.count("*").alias("found"), F.max("distance").alias("last"))
        state = active.join(kth, F.col("code") == F.col("q"), "left").select(
            "code", "segments", F.when(F.col("found") > k, F.col("last")).otherwise(F.lit(dims)).cast("int").alias("worst"),
            (F.coalesce("found", F.lit(0)) > k).alias("full"))
        active = store(state.where(~(F.col("full") & (F.col("worst") <= m * s - 1 + F.col("segments")))).drop("segments"), "mih-active")
        if m * (s + 1) - 1 >= dims or not active.take(1):
            break
    for part in scanned:
        best = Window.partitionBy("q").orderBy("distance", "id")
        part = store(part.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth"), "mih-scan")
        pool = part if pool is None else pool.unionByName(part)
    rank = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return (asked.select(F.col("id").alias("query_id"), "code").join(pool, F.col("code") == F.col("q"))
            .where(F.col("query_id") != F.col("id"))
            .select("query_id", F.col("id").alias("neighbour_id"), F.col("distance").cast("int").alias("distance"))
            .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "neighbour_id", "distance"))


def every_hundredth(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return vectors.where(F.col(id_col) % 100 == 0)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) = 64),
p AS (SELECT a.id AS query_id, c.id AS neighbour_id,
        CAST(len(list_filter(range(1, 65), lambda i: a.b[i] <> c.b[i])) AS INTEGER) AS distance
      FROM v a JOIN v c ON a.id <> c.id WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
