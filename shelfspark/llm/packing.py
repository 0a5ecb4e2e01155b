"""Packing by concatenating and cutting.

All token streams stand in one long row: partition after partition, document
after document. Pass one encodes each document once and writes its ids with its
place inside its own partition. Prefix sums over the partitions' totals then
give every partition its global offset, and pass two cuts the row into fixed
windows. Only the very last window is short. No text and no id is shuffled.

Null text is an empty text (its end id alone); documents with the same id or
the same text are packed one by one; an empty table gives no pieces; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, materialize
from .tokenize import encoder, in_chunks, release

WINDOW = 2048

#: Chunks that the encoder keeps here: half the usual, beside a large heap.
CACHE_CHUNKS = 500_000

TOKENS = "pid int, seq long, doc_id long, local_start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pass one, written to the shared folder: ids with their place in the partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq, at = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer, end_id, CACHE_CHUNKS)
        for batch in batches:
            for part in in_chunks(batch, size=4_000_000):
                ids = enc.encode(part.column("text"))
                n = np.array([len(x) for x in ids], np.int64)
                k = len(ids)
                starts = at + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, pid, np.int32)), pa.array(np.arange(seq, seq + k)), part.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(n), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    ["pid", "seq", "doc_id", "local_start", "n", "ids"],
                )
                seq, at = seq + k, at + int(n.sum())
        release(encoders=False)

    return materialize(docs.select("doc_id", "text").mapInArrow(encode, TOKENS), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """Global offset of each partition: one row a partition, so one small window."""
    totals = tokens.groupBy("pid").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of fixed windows: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset), and ``ids`` (little-endian unsigned 32 bits) on request.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer, end_id)
    bases = offsets(tokens)
    # one row for each task of pass one: bounded by the partition count, and checked
    rows = bases.limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) <= MAX_BROADCAST_ROWS:
        bases = F.broadcast(spark.createDataFrame(rows, "pid int, base long"))
    placed = tokens.join(bases, "pid").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, raw = batch.column("doc_id"), batch.column("at").to_numpy(), batch.column("ids")
            row, start, length, crc, ids = [], [], [], [], []
            total = np.zeros(len(at), np.int64)
            for i in range(len(at)):
                data = raw[i].as_buffer()
                n = total[i] = data.size // 4
                view, a = memoryview(data), 0
                while a < n:
                    b = min(n, a + window - (int(at[i]) + a) % window)
                    row.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(view[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(view[4 * a : 4 * b].tobytes())
                    a = b
            row, start = np.array(row, np.int64), np.array(start, np.int64)
            place = at[row] + start if len(row) else row
            columns = [doc.take(pa.array(row)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total[row] if len(row) else row), pa.array(place // window), pa.array(place % window)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Whole sequences (sequence_id, n, ids) from pieces with ids.

    A piece that fills its window is a sequence already. The boundary records,
    which share a window with others, meet by its number: at most ``window`` of
    them, as each holds one id at least.
    """
    full = F.col("length") == window
    rest = pieces.filter(~full).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.filter(full).select("sequence_id", F.col("length").alias("n"), "ids").unionByName(rest.select("sequence_id", "n", joined.alias("ids")))
