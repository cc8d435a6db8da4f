"""Sharding: contiguous shards of nearly equal bytes by global prefix sums.

Rows are ordered by (doc_id, size, text_crc32). A range shuffle of the narrow
rows (no text) deals that order out; its partition totals, summed up over one
row per partition, give every partition's first byte and row; a running sum
inside each partition gives every row's. A row whose middle byte lies in the
k-th of ``shards`` equal cuts of all bytes goes to shard k, so shard sizes
differ from the target by less than the largest row.

Equal keys carry a random last sort key, so one repeated row that makes up a
third of the table is dealt over many partitions too; which of two identical
rows comes first cannot be seen in the result.

Defined results: a null text has no bytes (size 1) and the checksum of the empty
text; a null doc_id comes first; repeated rows are kept, each with a slot of its
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import store

#: Rows of a range partition, which one task sorts.
ROWS_PER_PART = 2_000_000


def shard_by_bytes(docs: DataFrame, shards: int = 16, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit(""))
    keys = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw.cast("binary")).alias("text_crc32"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_per_part))
    rows = store(rows.repartitionByRange(parts, *(F.col(k).asc_nulls_first() for k in keys), F.rand(7))
                 .withColumn("part", F.spark_partition_id()), "shard-rows")

    # one row per range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = store(rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).coalesce(1), "shard-parts")
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    total = totals.agg(F.sum("bytes")).first()[0] or 1

    upto = Window.partitionBy("part").orderBy(*(F.col(k).asc_nulls_first() for k in keys)).rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.withColumns({"upto": F.sum("size").over(upto), "nth": F.row_number().over(upto)})
              .join(F.broadcast(starts), "part")
              .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
              .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
              .withColumn("shard", F.expr(f"twice_middle * {shards} div (2 * {total}L)").cast("int")))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        *keys, F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


#: ``shard_by_bytes`` of ``documents`` in DuckDB; the checksum is CRC-32 byte by
#: byte with a table that is itself made from the polynomial.
ORACLE = """
WITH tab AS (SELECT string_agg(lpad(to_hex(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)), 8, '0'), '' ORDER BY i) AS t
             FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 1 AS size, xor(4294967295, list_reduce(range(len(h) // 2),
        lambda c, i: xor(c >> 8, ('0x' || substr(t, 8 * xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) + 1, 8))::BIGINT), 4294967295)) AS text_crc32 FROM d, tab),
o AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER () AS total FROM b
      WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
s AS (SELECT *, CAST((2 * upto - size) * 16 // (2 * total) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""
