"""Packing by concatenating and cutting.

All documents form one long row of ids, each ended by an end id, and the row
is cut into windows of fixed length.  A first pass encodes each document once,
writes its ids with their place inside their partition, and sums every
partition; prefix sums over those totals give each partition's place in the
whole.  A second pass cuts every document where a window ends and writes one
boundary record for each piece.  Only totals of partitions are shuffled, and
only the last window is padded.

A null text counts as empty; an empty document still has its end id.  Repeated
rows are packed as often as they come.  An empty table gives no pieces.  A
document may span any number of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.llm.columns import named, whole
from shopgrain.llm.tokens import word_encoder
from shopgrain.sources.shared import materialize

LENGTH = 2048
END_ID = 1
BROADCAST_PARTITIONS = 1_000_000
TEXTS_AT_ONCE = 512


def encoded(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, part, first (ids before it in its partition), n, ids (little-endian unsigned 32-bit), as files.

    Written before it is used: the place of a row in its partition must be
    the same in both passes.
    """
    rows = docs.select(
        named(id_column).alias("doc_id"), whole(named(text_column)).alias("text"), F.spark_partition_id().alias("part")
    )
    schema = T.StructType([
        rows.schema["doc_id"], rows.schema["part"], T.StructField("first", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = word_encoder(tokenizer_path), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                ids = [coder.encode(t) + end for t in some.column("text").to_pylist()]
                n = [len(x) // 4 for x in ids]
                firsts = []
                for k in n:
                    firsts.append(first)
                    first += k
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("part"), pa.array(firsts, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(ids, pa.binary())],
                    ["doc_id", "part", "first", "n", "ids"],
                )

    return materialize(rows.mapInArrow(encode, schema))


def part_starts(rows: DataFrame) -> DataFrame:
    """part, start: ids in the partitions before it.  One row per partition is windowed."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))


def pieces(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of each piece of each document."""
    starts = materialize(part_starts(rows))
    if starts.count() <= BROADCAST_PARTITIONS:
        starts = F.broadcast(starts)
    placed = rows.join(starts, "part").withColumn("at", F.col("start") + F.col("first")).drop("start")
    at, n = F.col("at"), F.col("n")
    windows = F.sequence(F.floor(at / length), F.floor((at + n - 1) / length))

    def piece(w):
        begin = F.greatest(w * length - at, F.lit(0))
        size = F.least((w + 1) * length - at, n) - begin
        return F.struct(
            begin.alias("start"), size.alias("length"),
            F.substring(F.col("ids"), (begin * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
            w.alias("sequence_id"), (at + begin - w * length).alias("offset"),
        )

    cut = placed.select("doc_id", n.alias("doc_tokens"), F.inline(F.transform(windows, piece)))
    return cut.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Boundary records of all documents packed into windows of ``length`` ids."""
    return pieces(encoded(docs, tokenizer_path, end_id, id_column, text_column), length)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, used: whole windows, the last one padded.  A window holds at most ``length`` pieces."""
    order = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(order.alias("p"), F.sum("length").alias("used"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(length) - F.col("used")).cast("int")))
    return rows.select("sequence_id", F.concat(joined, pad).alias("ids"), "used")
