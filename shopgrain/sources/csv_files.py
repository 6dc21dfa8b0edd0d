"""CSV and TSV exports read as all-text rows.

Files are grouped by separator and header, each group is one scan, and every
row keeps the names of its own file's header.  A record goes on over the line
ends inside its quotes, at every file size, and files stay splittable: one
pass finds for each block of a file in which state a reader leaves it that
enters it inside or outside of quotes, prefix sums over the blocks give the
state at each block's start, and then every line knows whether it begins a
record.  Lines that are records by themselves, nearly all, are parsed where
they lie; only the others are brought together.

A quote that is never closed would swallow what follows.  So a record of
several lines that does not fit its header, or is longer than MAX_LINES or
MAX_CHARS, is taken as single lines, and those that do not fit are logged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopgrain.sources.shared import materialize

_BAD = "_malformed"
PEEK_BYTES = 512
_BROADCAST_BLOCKS = 100_000
MALFORMED = "linha malformada"
#: Longest record that goes over line ends.
MAX_LINES = 1000
MAX_CHARS = 1 << 20


class Shape(NamedTuple):
    """Files that share a separator and a header record."""

    sep: str
    header: str
    paths: list[str]


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def separator(path: Column, start: Column) -> Column:
    """Tab for .tsv; else the one of ; or tab that beats all others at the start of the file."""
    semi, comma, tab = (_count(start, c) for c in ";,\t")
    return F.when(F.lower(path).endswith(".tsv"), "\t").when(
        (semi > comma) & (semi > tab), ";"
    ).when((tab > comma) & (tab > semi), "\t").otherwise(",")


def file_heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, sep, header of each file that has a line, found where the files are read.

    Only the first block of a file is looked at.  Lines are numbered by their
    place in a task; the first 512 lines hold the first 512 bytes.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
    ).filter("block = 0")
    first = F.struct("id", "value")
    heads = lines.groupBy("path").agg(
        F.min("id").alias("start"), F.min(F.when(F.col("value") != "", first)).alias("head"),
    ).filter("head IS NOT NULL")
    near = lines.select("path", "id", F.substring("value", 1, PEEK_BYTES).alias("value")).join(
        heads.select("path", "start"), "path"
    ).filter(F.col("id") < F.col("start") + PEEK_BYTES)
    peek = near.groupBy("path").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), "\n"
    ).alias("text"))
    start = F.substring(F.col("text").cast("binary"), 1, PEEK_BYTES).cast("string")
    return heads.join(peek, "path").select(
        "path", separator(F.col("path"), start).alias("sep"), F.col("head.value").alias("header")
    )


def detect_separator(spark: SparkSession, path: str) -> str:
    """Separator of the first file of a path that has a line; a comma if none has."""
    first = file_heads(spark, [path]).orderBy("path").select("sep").first()
    return first["sep"] if first else ","


def scan_shapes(spark: SparkSession, paths: Sequence[str], sep: str | None = None) -> list[Shape]:
    """Group files by separator and whole header record; files without a line have no shape."""
    heads = file_heads(spark, paths)
    if sep is not None:
        heads = heads.withColumn("sep", F.lit(sep))
    groups = heads.groupBy("sep", "header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    # As many entries as there are files.
    return sorted(Shape(r["sep"], r["header"], list(r["paths"])) for r in groups.collect())


def inside_after(line: str, sep: str, inside: bool) -> bool:
    """Whether a reader is inside quotes at the end of a line; ``inside`` is its state at the start.

    A field is quoted if it begins with a quote, spaces before it aside.  A
    doubled quote stands for one, a quote before a separator or the line's end
    closes the field, and any other quote is a character of the field.
    """
    i = 0
    while True:
        if not inside:
            while i < len(line) and line[i].isspace() and line[i] != sep:
                i += 1
            if line[i:i + 1] != '"':
                i = line.find(sep, i) + 1
                if not i:
                    return False
                continue
            i += 1
        i = line.find('"', i)
        if i < 0:
            return True
        if line[i + 1:i + 2] == '"':
            i, inside = i + 2, True
            continue
        after = i + 1
        while after < len(line) and line[after].isspace() and line[after] != sep:
            after += 1
        if after == len(line):
            return False
        inside = line[after] != sep
        i = i + 1 if inside else after + 1


def _text_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )


def line_states(lines: DataFrame, sep: str) -> DataFrame:
    """``lines`` with the states at the start and end of each line (true: inside quotes).

    ``_start0`` and ``_end0`` hold if the block of the line is entered outside
    of quotes, ``_start1`` and ``_end1`` if inside.  A task reads the lines of a
    block in order.
    """
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, (False, True)
        for batch in batches:
            quoted = pc.match_substring(batch.column("value"), '"')
            files, blocks = batch.column("_file").to_pylist(), batch.column("_block").to_pylist()
            starts, ends = ([], []), ([], [])
            for i, has_quote in enumerate(quoted.to_pylist()):
                if (files[i], blocks[i]) != at:
                    at, state = (files[i], blocks[i]), (False, True)
                starts[0].append(state[0])
                starts[1].append(state[1])
                if has_quote:
                    line = batch.column("value")[i].as_py()
                    state = tuple(inside_after(line, sep, x) for x in state)
                ends[0].append(state[0])
                ends[1].append(state[1])
            made = [pa.array(x, pa.bool_()) for x in (*starts, *ends)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], [*batch.schema.names, "_start0", "_start1", "_end0", "_end1"]
            )

    states = "_start0 boolean, _start1 boolean, _end0 boolean, _end1 boolean"
    return lines.mapInArrow(follow, f"_file string, _block bigint, _id bigint, value string, {states}")


def block_states(states: DataFrame) -> DataFrame:
    """_file, _block, _inside (whether it is entered inside quotes), _head, _joins, _carry: one row for each block.

    ``_head`` is the id of the file's header line, ``_joins`` says whether the
    block has a line that is not a record by itself, and ``_carry`` is the line
    that begins the record which the block is entered in.
    """
    def last(value: str) -> Column:
        return F.max_by(value, "_id")

    def begin(start: str) -> Column:
        return F.max(F.when(~F.col(start), F.col("_id")))

    found = states.groupBy("_file", "_block").agg(
        last("_end0").alias("_end0"), last("_end1").alias("_end1"), begin("_start0").alias("_begin0"),
        begin("_start1").alias("_begin1"), F.min(F.when(_filled("value"), F.col("_id"))).alias("_head"),
        F.max(F.col("_start0") | F.col("_end0")).alias("_joins0"), F.max(F.col("_start1") | F.col("_end1")).alias("_joins1"),
    )
    # A block that is left in one state however it is entered settles it; others keep it or turn it around.
    earlier = _earlier_blocks()
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    settles = F.col("_end0") == F.col("_end1")
    turns = (F.col("_end0") & ~F.col("_end1")).cast("int")
    counted = found.withColumn("_turns", F.sum(turns).over(upto))
    settled = F.last(F.when(settles, F.struct("_end0", "_turns")), ignorenulls=True).over(earlier)
    before = F.coalesce(F.lag("_turns").over(Window.partitionBy("_file").orderBy("_block")), F.lit(0))
    since = before - F.coalesce(settled["_turns"], F.lit(0))
    entered = counted.withColumn(
        "_inside", (F.coalesce(settled["_end0"].cast("int"), F.lit(0)) + since) % 2 == 1
    )

    def known(name: str) -> Column:
        return F.when(F.col("_inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    carry = F.last(F.col("_begin"), ignorenulls=True).over(earlier)
    return entered.withColumns({"_begin": known("_begin"), "_joins": known("_joins")}).select(
        "_file", "_block", "_inside", F.when(F.col("_block") == 0, F.col("_head")).alias("_head"), "_joins",
        carry.alias("_carry"),
    )


def _filled(value: str) -> Column:
    """Whether a line has anything but control characters and spaces."""
    return F.col(value).rlike(r"[^\x00-\x20]")


class _Parser(NamedTuple):
    """How the lines of a shape become rows."""

    sep: str
    names: list[str]

    def parse(self, records: DataFrame) -> DataFrame:
        """``records`` with the trimmed values of ``value`` in columns c0, c1, ... and the text that does not fit in _BAD."""
        every = [f"c{i}" for i in range(len(self.names))]
        row = F.from_csv("value", ", ".join(f"{c} string" for c in [*every, _BAD]), {
            "sep": self.sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true",
            "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD,
        })
        rows = records.withColumn("_row", row)
        return rows.select(*records.columns, *[F.coalesce(F.trim(f"_row.{c}"), F.lit("")).alias(c) for c in every],
                           f"_row.{_BAD}")


def _joined(lines: DataFrame, parser: _Parser) -> DataFrame:
    """Parsed records of lines that are not records by themselves.

    ``lines`` has _start (whether it is entered inside quotes) and _carry.
    """
    upto = Window.partitionBy("_file", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(~F.col("_start"), F.col("_id"))).over(upto)
    lines = materialize(lines.select(
        "_file", "_block", "_id", "value", F.coalesce(begun, F.col("_carry")).alias("_record"),
    ))
    size = lines.groupBy("_file", "_record").agg(
        F.count(F.lit(1)).alias("_lines"), F.sum(F.char_length("value") + 1).alias("_chars")
    )
    bounded = size.filter((F.col("_lines") <= MAX_LINES) & (F.col("_chars") <= MAX_CHARS)).select("_file", "_record")
    groups = lines.join(bounded, ["_file", "_record"], "left_semi").groupBy("_file", "_record").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_id", "value"))).alias("_lines")
    )
    groups = materialize(parser.parse(groups.withColumn(
        "value", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n")
    )))
    first = F.element_at("_lines", 1)
    good = groups.filter(F.col(_BAD).isNull()).select(
        "_file", first["_block"].alias("_block"), first["_id"].alias("_id"), "value",
        *[c for c in groups.columns if c not in ("_file", "_record", "_lines", "value")],
    )
    apart = groups.filter(F.col(_BAD).isNotNull()).select("_file", F.inline("_lines"))
    unbounded = lines.join(bounded, ["_file", "_record"], "left_anti").select("_file", "_block", "_id", "value")
    return good.unionByName(parser.parse(apart.unionByName(unbounded).filter(_filled("value"))))


def scan_group(spark: SparkSession, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Rows of one shape, and the records (_file, _text) that its header does not fit."""
    named = spark.read.option("sep", shape.sep).option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(shape.paths[0]).columns
    parser = _Parser(shape.sep, [n.strip().lower() for n in named])
    lines = _text_lines(spark, shape.paths)
    blocks = materialize(block_states(line_states(lines, shape.sep)))
    known = blocks.agg(F.count(F.lit(1)).alias("n"), F.max("_joins").alias("joins")).first()
    few = known["n"] <= _BROADCAST_BLOCKS

    def of_block(rows: DataFrame, what: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(what) if few else what, ["_file", "_block"])

    def body(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("_head").isNull() | (F.col("_id") != F.col("_head")))

    if known["joins"]:
        states = of_block(materialize(line_states(lines, shape.sep)), blocks)
        start, end = (F.when(F.col("_inside"), F.col(f"{x}1")).otherwise(F.col(f"{x}0")) for x in ("_start", "_end"))
        states = body(states.withColumns({"_start": start, "_end": end}))
        alone = states.filter(~F.col("_start") & ~F.col("_end")).select("_file", "_block", "_id", "value")
        parsed = parser.parse(alone.filter(_filled("value"))).unionByName(
            _joined(states.filter(F.col("_start") | F.col("_end")), parser)
        )
    else:
        alone = body(of_block(lines, blocks.select("_file", "_block", "_head"))).select("_file", "_block", "_id", "value")
        parsed = parser.parse(alone.filter(_filled("value")))
    # The text is parsed once; numbering and the reject log read the result.
    kept = materialize(parsed.drop("value"))
    whole = kept.filter(F.col(_BAD).isNull()).drop(_BAD)
    rows = _numbered(whole, few).toDF(*parser.names, "_file", "_line")
    return rows, kept.filter(F.col(_BAD).isNotNull()).select("_file", F.col(_BAD).alias("_text"))


def _numbered(rows: DataFrame, few: bool) -> DataFrame:
    """Rows with ``_line``, their place in their file, in place of block and id.

    Rows are numbered inside each block, then shifted by the rows of earlier
    blocks, so they are neither sorted nor shuffled, except those of blocks
    whose ids have gaps.
    """
    columns = [c for c in rows.columns if c not in ("_file", "_block", "_id")]
    blocks = materialize(rows.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.max("_id").alias("_last"),
    ))
    offsets = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(_earlier_blocks()), F.lit(0)).alias("_off"),
        (F.col("_last") - F.col("_first") + 1 != F.col("_rows")).alias("_gaps"),
    )
    marked = rows.join(F.broadcast(offsets) if few else offsets, ["_file", "_block"])
    # Rows of one block lie in one task, in order; skipped ones leave gaps in the ids.
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_id"))
    even = marked.filter(~F.col("_gaps")).withColumn("_line", F.col("_off") + F.col("_id") - F.col("_first") + 1)
    gappy = marked.filter("_gaps").withColumn("_line", F.col("_off") + place)
    return even.unionByName(gappy).select(*columns, "_file", "_line")


def _earlier_blocks():
    # One row per block of a file.
    return Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )


def csv_parts(
    spark: SparkSession, path: str | Sequence[str], sep: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All rows of the files, and the records that do not fit their file's header."""
    shapes = scan_shapes(spark, [path] if isinstance(path, str) else path, sep)
    if not shapes:
        empty = spark.createDataFrame([], "_file string, _line bigint")
        return empty, spark.createDataFrame([], "_file string, _text string")
    parts = [scan_group(spark, s) for s in shapes]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r, _ in parts])
    # A column that a file does not have is empty in its rows.
    texts = [c for c in rows.columns if c != "_line"]
    names = [c for c in rows.columns if c not in ("_file", "_line")]
    rows = rows.na.fill("", texts).select(*names, "_file", "_line")
    return rows, reduce(DataFrame.unionByName, [b for _, b in parts])


def csv_scan(spark: SparkSession, path: str | Sequence[str], sep: str | None = None) -> DataFrame:
    """Rows of the files, every value trimmed text, line ends inside quotes included.

    Header names are lower-cased and trimmed; a header is one line.  A column
    that only some files have is empty in the others.  A row whose number of
    fields differs from the header's is skipped, as is one that cannot be
    parsed; ``csv_parts`` also returns those.  ``_file`` and ``_line`` (1-based
    number among the kept rows of its file) follow the headers' columns.
    """
    return csv_parts(spark, path, sep)[0]
