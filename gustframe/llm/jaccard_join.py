"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed shingles of five words (lower case, runs of letters,
digits and underscores). Equal sets are one class from the start, whatever the
number of copies. A class has a sketch of ``COORDS`` min-hash values; equal values
at a coordinate mean a shared token, sampled evenly from the union of two sets.

A run puts all classes into a root bucket and splits buckets recursively: at each
bucket two coordinates are chosen by the bucket's path, and a class goes into the
two child buckets of its values there. Two sets of similarity t share at least one
child with probability 1 - (1 - t)^2 and more. Buckets of one class go, buckets of
up to ``LEAF`` are leaves, and so is what is left after ``DEPTH`` levels, or what
holds ``ALIKE`` of the bucket above: sets that alike would only be copied into
more buckets by further splits. Runs use coordinates of their own and are repeated until the chance to miss a pair at the
threshold is below 1 - ``recall`` (``runs_for``).

Leaves are compared by brute force on the sketches; what may be similar (few
deviations below the threshold are allowed for) is linked, and the linked groups
come out of connected components. Only their members' texts are read again, and
within each group all pairs are compared exactly, so that a group finds links
that no leaf showed. Leaves and groups beyond ``BLOCK`` members, or a bounded
number of shingles, are compared in pairs of blocks in tasks of their own, so none
is capped. No pairs are emitted: a class gets its number of linked documents and
one edge, and connected components of these edges are the result's classes.

Defined results: a text of fewer than five words is one shingle of all its words;
null texts and texts without words have no shingles, no links, and are classes of
their own; a class id is the least doc_id of the class (null only if all are), and
a document's links are all other documents of similarity ``threshold`` or more,
copies included; a repeated row is a copy; an empty table gives no rows; other
columns, whatever their names, are handed through by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, fresh, map_arrow, slices, store

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
COORDS, PER_RUN, CHOSEN = 64, 16, 2
LEAF, DEPTH, BLOCK, BLOCK_SHINGLES = 48, 4, 1024, 2_000_000
ALIKE = 0.5
#: Bits of the text hash by which texts to be read again are sorted out first.
PREFIX_BITS = 20

_WORD = re.compile(r"\w+")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], np.uint64)
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    flat = np.array([w for ws in words for w in ws] or [""], dtype=object)
    codes = pd.util.hash_array(flat, categorize=False).astype(np.uint64)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        own, at = codes[at:at + n], at + n
        k = min(SHINGLE, n)
        h = np.zeros(n - k + 1 if n else 0, np.uint64)
        for j in range(k if n else 0):
            h += own[j:n - k + 1 + j] * _POWERS[j]
        out.append(np.unique(_mixed(h + np.uint64(k))))
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """``COORDS`` min-hash values of 32 bits, big-endian."""
    low = np.full(COORDS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 1 << 14):
        low = np.minimum(low, ((shingles[i:i + (1 << 14)] * _FACTORS[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return low.astype(">u4").tobytes()


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is missed with 1 - recall at most, if
    all its buckets are split down to ``depth``."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - threshold * q) ** CHOSEN
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q))) if q < 1 else 1


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (text hash), skey (set hash; null without words), n, sketch."""
    schema = docs.select("doc_id").schema.add("tkey", "binary").add("skey", "binary").add("n", "long").add("sketch", "binary")

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.md5(t.encode()).digest() if t is not None else None for t in texts], pa.binary()),
                 pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "tkey", "skey", "n", "sketch"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _children(run: Column, path: Column) -> Column:
    """The buckets of a class below ``path``."""
    out = []
    half = PER_RUN // CHOSEN
    for i in range(CHOSEN):
        coord = run * PER_RUN + half * i + F.pmod(F.xxhash64(path, F.lit(i)), F.lit(half))
        out.append(F.xxhash64(path, coord, F.substr("sketch", (coord * 4 + 1).cast("int"), F.lit(4))))
    return F.explode(F.array(*out))


def leaves(classes: DataFrame, runs: int) -> DataFrame:
    """path, cid, size: the buckets that are compared."""
    root = F.xxhash64(F.lit("root"), F.col("run"))
    rows = (classes.select("cid", "sketch", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
            .select("cid", "run", _children(F.col("run"), root).alias("path"))
            .withColumn("above", F.lit(None).cast("long")))
    out = None
    for level in range(1, DEPTH + 1):
        rows = store(rows, "paths")
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        shared = store(rows.join(sizes, "path"), "buckets")
        leaf = (F.col("size") <= LEAF) | F.coalesce(F.col("size") >= ALIKE * F.col("above"), F.lit(False)) | F.lit(level == DEPTH)
        done = shared.where(leaf)
        out = done if out is None else out.unionByName(done)
        rows = shared.where(~leaf)
        if level == DEPTH or not rows.take(1):
            break
        rows = (rows.join(classes.select("cid", "sketch"), "cid")
                .select("cid", "run", _children(F.col("run"), F.col("path")).alias("path"), F.col("size").alias("above")))
    return out.select("path", "cid", "size")


def _in_blocks(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Deal the members of ``key`` to pairs of blocks: a row for each pair that a
    member's block is in, with the pair (``bi`` <= ``bj``) and own block ``own``."""
    rows = rows.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (rows.withColumn("other", other).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
            .drop("other", "blocks").withColumnRenamed(key, "key"))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _by_group(rows: DataFrame, compare, columns: list[str]) -> DataFrame:
    """``compare(batch, bounds)`` over the rows of each (key, bi, bj): rows are
    dealt and sorted by group, and a task takes whole groups out of the sorted
    stream, many at a time; it holds one batch and the group that crosses it."""
    keyed = rows.select(F.xxhash64("key").alias("gid"), "bi", "bj", "own", *columns)

    def run(batches):
        rest = None
        for b in batches:
            b = pa.concat_batches([rest, b]) if rest is not None else b
            if not b.num_rows:
                continue
            ids = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
            if len(new):
                yield compare(b.slice(0, new[-1]), [0, *new.tolist()])
                b = b.slice(new[-1])
            rest = b
        if rest is not None:
            yield compare(rest, [0, rest.num_rows])

    return map_arrow(keyed.repartition("gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj"), run, "cid long, links long, root long")


def _linked(batch: pa.RecordBatch, bounds: list[int], matcher, weight: np.ndarray) -> pa.RecordBatch:
    """cid, links, root of the members linked to others; ``matcher(a, b)`` gives
    for the group a:b the function from a member to its later matches. Of a pair
    of different blocks, only pairs across count."""
    own, bi, bj = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("own", "bi", "bj"))
    keys = batch.column(batch.schema.get_field_index("cid"))
    links, root = np.zeros(batch.num_rows, np.int64), np.arange(batch.num_rows)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 2:
            continue
        matches, union, w = matcher(a, b), _Union(b - a), weight[a:b]
        for i in range(b - a - 1):
            js = matches(i)
            if bi[a] != bj[a]:
                js = js[own[a + js] != own[a + i]]
            if len(js):
                links[a + i] += w[js].sum()
                links[a + js] += w[i]
                for j in js.tolist():
                    union.join(i, j)
        root[a:b] = [a + union.find(i) for i in range(b - a)]
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(hit)), pa.array(links[hit]), keys.take(pa.array(root[hit]))], names=["cid", "links", "root"])


def _values(batch: pa.RecordBatch, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array of ``dtype``, and its offsets."""
    col = batch.column(batch.schema.get_field_index(name))
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]].view(dtype), (at - at[0]) // np.dtype(dtype).itemsize


def _compare_sketches(least: int):
    def compare(batch: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        s = _values(batch, "sketch", np.uint32)[0].reshape(-1, COORDS)
        return _linked(batch, bounds, lambda a, b: lambda i: i + 1 + np.flatnonzero((s[a + i + 1:b] == s[a + i]).sum(axis=1) >= least),
                       np.ones(batch.num_rows, np.int64))

    return compare


def _compare_sets(threshold: Fraction):
    num, den = threshold.numerator, threshold.denominator

    def compare(batch: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        flat, at = _values(batch, "shingles", np.uint64)
        sizes = np.diff(at)

        def matcher(a: int, b: int):
            known, codes = np.unique(flat[at[a]:at[b]], return_inverse=True)
            flags, starts, n = np.zeros(len(known), np.int64), at[a:b] - at[a], sizes[a:b]

            def matches(i: int) -> np.ndarray:
                mine = codes[starts[i]:starts[i] + n[i]]
                flags[mine] = 1
                shared = np.add.reduceat(flags[codes[starts[i + 1]:]], starts[i + 1:] - starts[i + 1])
                flags[mine] = 0
                return i + 1 + np.flatnonzero(shared * den >= num * (n[i] + n[i + 1:] - shared))

            return matches

        return _linked(batch, bounds, matcher, batch.column(batch.schema.get_field_index("copies")).to_numpy())

    return compare


def _sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (tkey, doc_id of one text each) with the text's shingles; the
    text hash's first bits (at most 2^PREFIX_BITS values, so a bounded broadcast)
    keep other texts out of the shuffle."""
    prefix = F.conv(F.substring(F.hex("tkey"), 1, PREFIX_BITS // 4), 16, 10).cast("int")
    wanted = members.select(prefix.alias("prefix")).distinct()
    texts = (docs.select(F.col("doc_id").alias("d"), "text", F.unhex(F.md5("text")).alias("t"))
             .withColumn("prefix", F.conv(F.substring(F.hex("t"), 1, PREFIX_BITS // 4), 16, 10).cast("int"))
             .join(F.broadcast(wanted), "prefix", "left_semi").drop("prefix"))
    found = texts.join(members, (F.col("t") == F.col("tkey")) & F.col("d").eqNullSafe(F.col("doc_id"))).drop("d", "t", "tkey", "doc_id")
    rest = [c for c in found.columns if c != "text"]
    schema = found.select(*rest).schema.add("shingles", "binary")

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            sets = shingle_sets(b.column(at).to_pylist())
            cols = [b.column(i) for i, f in enumerate(b.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s in sets], pa.binary())], names=[*rest, "shingles"])

    return map_arrow(found.select(*rest, "text"), run, schema).dropDuplicates(["cid"])


def join_rows(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, tkey, class_id, class_tkey (that document's text), n_links."""
    runs = runs_for(threshold, recall)
    if runs > COORDS // PER_RUN:
        raise ValueError(f"threshold {threshold} with recall {recall} takes {runs} runs; a sketch of {COORDS} coordinates has {COORDS // PER_RUN}")
    rows = store(text_rows(docs), "shingle-rows")
    classes = (rows.where("skey is not null").groupBy("skey")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", "n", "sketch")).alias("m"), F.count("*").alias("copies"))
               .select("skey", "copies", "m.doc_id", "m.tkey", "m.n", "m.sketch")
               .withColumn("cid", F.monotonically_increasing_id()))  # a short name, kept by the written table
    classes = store(classes, "shingle-classes")

    met = leaves(classes, runs).join(classes.select("cid", "sketch"), "cid")
    met = _in_blocks(met, "path", F.ceil(F.col("size") / BLOCK))
    least = math.floor(threshold * COORDS - 4.5 * math.sqrt(COORDS * threshold * (1 - threshold)))
    like = _by_group(met, _compare_sketches(least), ["cid", "sketch"])
    groups = components(like.select(F.col("cid").alias("a"), F.col("root").alias("b")), "jaccard-groups")

    members = groups.unionByName(groups.select(F.col("label").alias("node"), "label").distinct())
    members = store(members.withColumnRenamed("node", "cid").join(classes.drop("sketch", "skey"), "cid"), "jaccard-members")
    sizes = members.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    sets = _sets_of(docs, members.join(sizes, "label"))
    sets = _in_blocks(sets, "label", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)))
    exact = store(_by_group(sets, _compare_sets(Fraction(threshold).limit_denominator(1000)), ["cid", "copies", "shingles"]), "jaccard-links")
    labels = components(exact.select(F.col("cid").alias("a"), F.col("root").alias("b")), "jaccard-classes")

    each = (classes.select("cid", "skey", "copies", "doc_id", "tkey")
            .join(exact.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
            .join(labels.withColumnRenamed("node", "cid"), "cid", "left")
            .withColumn("label", F.coalesce("label", "cid")))
    each = store(each, "jaccard-each")
    heads = (each.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("m"))
             .select("label", F.col("m.doc_id").alias("class_id"), F.col("m.tkey").alias("class_tkey")))
    each = each.join(heads, "label").select("skey", "class_id", "class_tkey", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = F.col("skey").isNull()
    return (rows.select("doc_id", "tkey", "skey").join(each, "skey", "left")
            .select("doc_id", "tkey", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(alone, F.col("tkey")).otherwise(F.col("class_tkey")).alias("class_tkey"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return join_rows(docs, threshold, recall).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each class (the least doc_id), with all its columns."""
    rows = store(join_rows(docs, threshold, recall), "jaccard-rows")
    goes = rows.where(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("tkey").eqNullSafe(F.col("class_tkey"))))
    key, other_id, other_key = fresh(docs, "jaccard_key"), fresh(docs, "jaccard_id"), fresh(docs, "jaccard_other")
    goes = goes.select(F.col("doc_id").alias(other_id), F.col("tkey").alias(other_key)).distinct()
    kept = docs.withColumn(key, F.unhex(F.md5("text"))).join(
        goes, F.col(key).eqNullSafe(F.col(other_key)) & F.col("doc_id").eqNullSafe(F.col(other_id)), "left_anti")
    if rows.where("tkey is not null").groupBy("doc_id", "tkey").count().where("count > 1").take(1):  # rows repeated in full
        kept = kept.where(F.col(key).isNull()).unionByName(kept.where(F.col(key).isNotNull()).dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


#: ``jaccard_classes`` of ``documents`` in DuckDB, by brute force over shared shingles.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
k AS (SELECT a AS rid, min(doc_id) AS least FROM t JOIN d ON t.b = d.rid GROUP BY a),
c AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, CASE WHEN k.rid IS NULL THEN doc_id ELSE k.least END AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN k USING (rid) LEFT JOIN c USING (rid)"""
