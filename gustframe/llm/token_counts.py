"""Token counts by a separator scan of flat token files.

A token file is a run of 16-bit little-endian ids without any index; an
end-of-document id follows every document. Files are cut into blocks of
``BLOCK`` bytes, whatever the documents in them. A task reads a block's byte
range and finds all separators in one vectorised comparison; documents that begin
and end in a block are complete. What is left is at most one document per block
whose end lies further on: a scan over the blocks' first separators (one row per
block) gives it. Blocks without a separator emit nothing, so one document may
span any number of them.

``write_tokens`` makes such files from documents: Spark's text writer writes the
raw ids of each row, and the separator as its line end. Every document starts
with a header of ``HEADER`` ids that hold its doc_id, so that counts can be
matched without relying on row order.

Defined results: a null or empty text has 0 tokens; a null doc_id stays null; a
document that ends with the file instead of a separator counts; an odd last byte
is ignored; repeated rows are counted each; an empty table or folder gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gustframe.session import scratch_path

from . import unigram
from .common import map_arrow, slices, store

#: Bytes of a block (even), and the separator: the model's end-of-text id, whose
#: two bytes are the line end "\x02\x00".
BLOCK = 4 << 20
SEPARATOR = 2
#: A doc_id in a header: 5 ids of 14 bits each, plus ``SHIFT``; null is all ``NULL``.
HEADER, BITS, SHIFT, NULL = 5, 14, 3, 1


def header(doc_id: int | None) -> list[int]:
    if doc_id is None:
        return [NULL] * HEADER
    bits = doc_id & (1 << 64) - 1
    return [(bits >> BITS * i & (1 << BITS) - 1) + SHIFT for i in range(HEADER)]


def write_tokens(docs: DataFrame, path: str, model_path: str = unigram.MODEL) -> None:
    """Write the ids of ``docs(doc_id, text)`` as flat token files under ``path``."""
    model = unigram.load_model(model_path)

    def run(batches):
        own = unigram.codec(model)
        for b in slices(batches):
            rows = [np.array(header(i), "<u2").tobytes() + ids.astype("<u2").tobytes()
                    for i, ids in zip(b.column(0).to_pylist(), own.encode_all(b.column(1).to_pylist()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    lines = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "ids binary")
    lines.select(F.col("ids").cast("string")).write.option("lineSep", SEPARATOR.to_bytes(2, "little").decode()).text(path)


def scan_blocks(blocks: DataFrame, separator: int, header_ids: int, block: int) -> DataFrame:
    """file, block, start, end (null: further on), head of every document that
    starts in one of ``blocks(file, length, block)``, and of the place after the
    file's last separator; places are ids in the file."""
    def run(batches):
        for b in slices(batches, rows=1):
            name, length, k = (c[0].as_py() for c in b.columns)
            fs, path = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
            with fs.open_input_file(path) as f:
                data = f.read_at(min(block + 2 * header_ids, length - k * block), k * block)
            ids = np.frombuffer(data, "<u2", len(data) // 2)
            first = k * block // 2
            at = np.flatnonzero(ids[:block // 2] == separator)
            starts = np.concatenate(([0], at + 1)) if k == 0 else at + 1
            ends = np.concatenate((at, [-1])) if k == 0 else np.concatenate((at[1:], [-1]))[:len(at)]
            padded = np.concatenate((ids, np.zeros(header_ids + 1, "<u2")))
            heads = padded[starts[:, None] + np.arange(header_ids)].astype(np.int32).ravel()
            offsets = np.arange(len(starts) + 1, dtype=np.int32) * header_ids
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array([k] * n, pa.int64()), pa.array(starts + first, pa.int64()),
                 pa.array(ends + first, pa.int64(), mask=ends < 0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(heads))],
                names=["file", "block", "start", "end", "head"])

    return map_arrow(blocks.select("file", "length", "block"), run, "file string, block long, start long, end long, head array<int>")


def separator_scan(spark: SparkSession, path: str, separator: int = SEPARATOR, header_ids: int = 0, block: int = BLOCK) -> DataFrame:
    """file, start, end, head, n_tokens of every document in the token files under
    ``path``; n_tokens leaves out the header."""
    files = (spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length >= 2"))
    blocks = files.withColumn("block", F.explode(F.expr(f"sequence(0L, (length - 1) div {block}L)")))
    found = store(scan_blocks(blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), separator, header_ids, block), "token-blocks")

    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    edges = (found.groupBy("file", "block").agg(F.min(F.when(F.col("start") > 0, F.col("start") - 1)).alias("first"))
             .withColumn("next", F.min("first").over(later)))
    lengths = files.select("file", F.expr("length div 2").alias("total"))
    open_ = (found.where("end is null").drop("end").join(edges.select("file", "block", "next"), ["file", "block"])
             .join(lengths, "file").where("start < total").withColumn("end", F.coalesce("next", "total")))
    cols = ["file", "start", "end", "head"]
    return (found.where("end is not null").select(*cols).unionByName(open_.select(*cols))
            .withColumn("n_tokens", F.greatest(F.col("end") - F.col("start") - header_ids, F.lit(0))))


def count_tokens(docs: DataFrame, model_path: str = unigram.MODEL, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every document, counted in its token file."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, model_path)
    found = separator_scan(docs.sparkSession, path, SEPARATOR, HEADER, block)
    digit = lambda i: F.shiftleft((F.col("head")[i] - SHIFT).cast("long"), BITS * i)
    doc_id = digit(0)
    for i in range(1, HEADER):
        doc_id = doc_id.bitwiseOR(digit(i))
    return found.select(F.when(F.col("head")[0] != NULL, doc_id).alias("doc_id"), "n_tokens")
