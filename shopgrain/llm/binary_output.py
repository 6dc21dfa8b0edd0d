"""Token-id matrices packed by best-fit decreasing.

Documents longer than a row are split losslessly into rows and a rest.  The
parts of a block of documents are taken from the longest down, each into the
open row with the least room that still fits it; a segment tree over room,
with one leaf for each amount of room, finds that row in a logarithmic number
of steps.  A block is a run of neighbouring documents of bounded size inside a
task, so nothing is shuffled and memory does not grow with the table.

Each row has the ids padded to its length, the cumulative lengths of its
segments, and positions that begin anew with each segment; these three, with
the ids and offsets of the documents, give back every text.  A null text
counts as empty; every document ends with an end id, so an empty one has a
segment of one id.  Repeated rows are packed as often as they come.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.llm.columns import named, whole
from shopgrain.llm.tokens import byte_encoder

LENGTH = 2048
BLOCK_TOKENS = 2_000_000


class RoomTree:
    """Open rows by the room they have left, and the least room that is enough."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << max(length, 1).bit_length()
        self.any = [False] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def _mark(self, room: int, there: bool) -> None:
        i = room + self.leaves
        self.any[i] = there
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def put(self, row: int, room: int) -> None:
        if room:
            self.rows[room].append(row)
            if len(self.rows[room]) == 1:
                self._mark(room, True)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, and its room."""
        i = need + self.leaves
        while not self.any[i]:
            while i & 1:  # a right child: go on beside the parent
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._mark(room, False)
        return row, room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of part numbers: best fit, longest part first, ties in their order."""
    tree, rows = RoomTree(length), []
    for part in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[part])
        if found is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = found
        rows[row].append(part)
        tree.put(row, room - lengths[part])
    return rows


def write_rows(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """sequence_id, doc_ids, doc_starts, cu_seqlens, input_ids, position_ids of every packed row.

    ``input_ids`` is a matrix row of ``length`` little-endian unsigned 32-bit
    ids, padded with the end id; ``position_ids`` has the same shape and counts
    from 0 in each segment and in the padding.  ``cu_seqlens`` begins with 0 and
    ends with the number of ids that are not padding.
    """
    rows = docs.select(
        named(id_column).alias("doc_id"), whole(named(text_column)).alias("text"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)),
        T.StructField("doc_starts", T.ArrayType(T.LongType())), T.StructField("cu_seqlens", ints),
        T.StructField("input_ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType()),
    ])

    def packed(parts: list[tuple[object, int, np.ndarray]], end: int, first: int, kind: pa.DataType) -> pa.RecordBatch:
        made = best_fit([len(p[2]) for p in parts], length)
        out: list[list] = [[], [], [], [], [], []]
        for k, members in enumerate(made):
            chosen = [parts[i] for i in members]
            sizes = [len(p[2]) for p in chosen]
            ids = np.full(length, end, "<u4")
            ids[: sum(sizes)] = np.concatenate([p[2] for p in chosen])
            places = [np.arange(n, dtype="<u4") for n in [*sizes, length - sum(sizes)]]
            values = (
                first + k, [p[0] for p in chosen], [p[1] for p in chosen], [0, *np.cumsum(sizes).tolist()],
                ids.tobytes(), np.concatenate(places).tobytes(),
            )
            for column, value in zip(out, values, strict=True):
                column.append(value)
        types = [pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema.fieldNames())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(tokenizer_path)
        end = np.array([coder.end_id], "<u4").tobytes()
        parts: list[tuple[object, int, np.ndarray]] = []
        held, first, kind = 0, None, pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc, text, part in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                    first = part << 33 if first is None else first
                    ids = np.frombuffer(coder.encode(text) + end, "<u4")
                    parts += [(doc, i, ids[i : i + length]) for i in range(0, len(ids), length)]
                    held += len(ids)
                    if held >= block_tokens:
                        done = packed(parts, coder.end_id, first, kind)
                        first += done.num_rows
                        parts, held = [], 0
                        yield done
        if parts:
            yield packed(parts, coder.end_id, first, kind)

    return rows.mapInArrow(pack, schema)
