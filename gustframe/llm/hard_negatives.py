"""Hard-negative mining with exact integer scores by a residue-number-system GEMM.

Vectors are quantised to integers, so a score is an integer inner product. It is
not computed in float64 or int64 (slow), but modulo several primes: a prime p is
small enough that a float32 product of matrices of centred residues is exact (the
sum of ``dims`` products stays within 2^24), and there are as many primes as it
takes for their product to pass twice the largest possible score (the largest
squared norm, by Cauchy and Schwarz; measured in a pass over the rows). Chinese
remaindering puts the residues together to the exact signed score.

Anchors are dealt to blocks of about ``ANCHORS`` and all rows to groups of about
``ROWS``; a task streams a group's rows past a block of anchors in order of their
ids and holds the block, a slice of rows and the best few of each anchor. Rows
are copied once per block of anchors. The first pass finds each anchor's
positives: its best rows of the same label. Their scores are the upper ends of
the windows in which the second pass looks for the best rows of other labels. The
few candidates of each (anchor, group) are ranked by a window per anchor.

Defined results: a row is told by its id, label and vector, so that a row repeated
in full counts once, and rows that share an id only are rows of their own; rows
with a null id, label or vector, or with a null or non-finite component, take no
part; a shorter vector counts as filled up with zeros (an empty one scores 0);
ties go to the smaller id; an anchor without a row of its label has no positives,
and a positive without a row in its window no negatives, hence no result rows; an
empty table gives none; other columns are not read. Scores that pass 2^55 raise
ValueError.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_arrow, store

ANCHORS, ROWS = 1 << 15, 1 << 18
#: Anchors and rows of one matrix product, and the columns summed before reducing.
SLICE_A, SLICE_R, DEPTH = 1024, 2048, 4096
#: float32 holds all integers up to this one; scores stay below ``LIMIT``.
EXACT, LIMIT = 1 << 24, 1 << 55
_NONE = -1 << 62  # below all scores


def primes_for(dims: int, bound: int) -> list[int]:
    """Primes whose residue products over ``dims`` columns are exact in float32,
    the largest first, until their product exceeds 2 * bound."""
    top = 2 * int((EXACT // max(1, min(dims, DEPTH))) ** 0.5) + 1
    out, product, n = [], 1, top
    while product <= 2 * bound:
        while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
            n -= 1
        out.append(n)
        product, n = product * n, n - 1
    return out


def planes(q: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of ``q`` as float32, one matrix per prime."""
    out = []
    for p in primes:
        r = q % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact a @ b.T of the integers that the residue planes stand for."""
    x, m = None, 1
    for p, ap, bp in zip(primes, a, b, strict=True):
        r = np.zeros((len(ap), len(bp)), np.int64)
        for at in range(0, ap.shape[1], DEPTH):
            r += (ap[:, at:at + DEPTH] @ bp[:, at:at + DEPTH].T).astype(np.int64)
        x = r % p if x is None else x + m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return np.where(x > m // 2, x - m, x)


class _Best:
    """The best ``k`` (score, id) per anchor, rows coming in order of their ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), _NONE), np.zeros((n, k), np.int64)

    def take(self, at: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        s = np.where(allowed, scores, _NONE)
        own = self.score[at]
        better = np.flatnonzero(s.max(axis=1) > own[:, -1])  # a later row loses a tie
        if not len(better):
            return
        s = s[better]
        first = np.argsort(-s, axis=1, kind="stable")[:, :self.k] if s.shape[1] > 1 else np.zeros((len(s), 1), np.int64)
        both = np.concatenate((own[better], np.take_along_axis(s, first, 1)), axis=1)
        names = np.concatenate((self.id[at][better], ids[first]), axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :self.k]
        rows = np.arange(at.start, at.stop)[better]
        self.score[rows], self.id[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix, shorter lists filled up with zeros."""
    flat, sizes = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


class _Search:
    """A block of anchors and the rows of a group that stream past it."""

    def __init__(self, dims: int, primes: list[int], k: int, least: Fraction | None):
        self.dims, self.primes, self.k, self.least, self.parts, self.best = dims, primes, k, least, [], None

    def anchors(self, batch: pa.RecordBatch) -> None:
        self.parts.append((batch["row"].to_numpy(), batch["label"].to_numpy(), _matrix(batch["q"], self.dims),
                           _matrix(batch["limits"], self.k), np.diff(batch["limits"].offsets.to_numpy())))

    def rows(self, batch: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.best is None:
            self.key, self.label, q, self.limit, self.windows = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.a = planes(q, self.primes)
            self.best = [_Best(len(self.key), self.k) for _ in range(1 if self.least is None else self.k)]
        for at in range(0, batch.num_rows, SLICE_R):
            part = batch.slice(at, SLICE_R)
            key, label, ids = (part[c].to_numpy() for c in ("row", "label", "id"))
            b = planes(_matrix(part["q"], self.dims), self.primes)
            for lo in range(0, len(self.key), SLICE_A):
                s = slice(lo, min(lo + SLICE_A, len(self.key)))
                scores = product([p[s] for p in self.a], b, self.primes)
                alike = self.label[s][:, None] == label
                if self.least is None:
                    self.best[0].take(s, scores, alike & (self.key[s][:, None] != key), ids)
                    continue
                num, den = self.least.numerator, self.least.denominator
                for j in range(self.windows[s].max(initial=0)):
                    high = self.limit[s][:, j][:, None]
                    inside = ~alike & (scores <= high) & (den * scores >= num * high) & (self.windows[s] > j)[:, None]
                    self.best[j].take(s, scores, inside, ids)

    def result(self) -> pa.RecordBatch:
        cols = [[], [], [], []]
        for j, best in enumerate(self.best or []):
            i, n = np.nonzero(best.score > _NONE)
            high = self.limit[i, j] if self.least is not None else np.zeros(len(i), np.int64)
            for c, v in zip(cols, (self.key[i], high, best.id[i, n], best.score[i, n]), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols],
                                          names=["anchor", "high", "id", "score"])


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, dims: int, primes: list[int], k: int, least: Fraction | None) -> DataFrame:
    """anchor, high, id, score: the best ``k`` of every group for each anchor (and
    window, if ``least`` is given)."""
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    asked = anchors.select(F.lit(0).alias("side"), "row", "id", "label", "q", "limits", own(blocks).alias("block"), every(groups).alias("group"))
    past = rows.select(F.lit(1).alias("side"), "row", "id", "label", "q", F.array().cast("array<long>").alias("limits"),
                       own(groups).alias("group"), every(blocks).alias("block"))
    dealt = (asked.unionByName(past).repartition("block", "group").sortWithinPartitions("block", "group", "side", "id")
             .select("block", "group", "side", "row", "id", "label", "q", "limits"))

    def run(batches):
        search, at = None, None
        for b in batches:
            place = np.stack([b[c].to_numpy() for c in ("block", "group", "side")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at != tuple(place[:2, lo]):
                    if search:
                        yield search.result()
                    search, at = _Search(dims, primes, k, least), tuple(place[:2, lo])
                (search.rows if place[2, lo] else search.anchors)(b.slice(lo, hi - lo))
        if search:
            yield search.result()

    return map_arrow(dealt, run, "anchor long, high long, id long, score long")


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, q (floor(scale * x) of every component) of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return (rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
            .select("id", "label", F.transform("v", lambda x: F.floor(x * float(scale))).alias("q")))


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, least: Fraction = Fraction(80, 100),
         scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each anchor (rows for which ``is_anchor``, a condition on ``id``) and each
    of its ``n_positives`` best rows of the same label, the ``n_negatives`` best
    rows of other labels whose score is between ``least`` times and once the
    positive's."""
    k = max(n_positives, n_negatives)
    rows = store(quantised(vectors, scale, id_col, vec_col, label_col).distinct().withColumn("row", F.monotonically_increasing_id()), "mine-rows")
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, asked, dims, top = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("q")), F.max(norm)).first()
    if (top or 0) >= LIMIT:
        raise ValueError(f"scores reach {top:.3g}; the exact range ends at {LIMIT}")
    dims = max(dims or 0, 1)
    primes = primes_for(dims, int(top or 0) + 1)
    blocks = max(1, -(-asked // ANCHORS))
    groups = max(1, -(-n // ROWS), -(-rows.sparkSession.sparkContext.defaultParallelism // blocks))

    anchors = rows.where(is_anchor)
    near = _search(rows, anchors.withColumn("limits", F.array().cast("array<long>")), blocks, groups, dims, primes, k, None)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    positives = store(near.withColumn("nth", place).where(F.col("nth") <= n_positives)
                      .select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")

    limits = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("limits"))
    limited = anchors.join(limits, F.col("row") == F.col("anchor")).drop("anchor")
    far = _search(rows, limited, blocks, groups, dims, primes, k, least)
    place = F.row_number().over(Window.partitionBy("anchor", "high").orderBy(F.desc("score"), "id"))
    negatives = far.withColumn("rank", place).where(F.col("rank") <= n_negatives)
    return (positives.join(negatives.withColumnRenamed("anchor", "a"), (F.col("anchor") == F.col("a")) & (F.col("positive_score") == F.col("high")))
            .select("anchor", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            .join(anchors.select(F.col("id").alias("anchor_id"), "row"), F.col("anchor") == F.col("row"))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def mine_shifted(vectors: DataFrame) -> DataFrame:
    """The registered query: labels of ids divisible by 7 move on by one, anchors
    are the ids divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


#: ``mine_shifted`` of ``embeddings`` in DuckDB, by brute force over all pairs of an anchor and a row.
ORACLE = """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER () AS k FROM e),
s AS (SELECT a.k, a.id AS anchor_id, b.id, b.label = a.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM r a JOIN r b ON a.k <> b.k WHERE a.id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS nth FROM s WHERE alike),
c AS (SELECT p.k, p.nth, p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.k, p.nth ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.k = p.k AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 5
"""
