"""CSV files of any size, cut by Spark at lines although cells may hold line breaks.

Whether a line begins inside a quoted cell depends on all lines before it. So the lines of
each block (the part of a file that one task reads) are first taken as a function: from
outside or inside of a cell before the block to outside or inside after it. Functions of a
file's blocks, chained in order, tell how each block begins. A second reading then puts
lines together to rows, block by block; only a row that lies across blocks is moved.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.batches import slices
from docketry.session import saved

SOURCE = "source_file"
START = "block_start"
_MARK = "﻿"
#: A row within one block; the first, a middle and the last part of one across blocks.
WHOLE, HEAD, MIDDLE, TAIL = range(4)
#: Of a block: it begins inside of a cell; its file ends there, inside of one.
BEGINS, OPEN_END = 1, 2
#: What readers of bytes hold is several numbers for each byte.
_RUN_BYTES = 1 << 20


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins outside or `inside` of a quoted cell ends inside of one.

    A cell is quoted if it begins with a quote; within it a quote is doubled.
    """
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                at += 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        while True:
            at = line.find('"', at) + 1
            if not at:
                return True
            if not line.startswith('"', at):
                break
            at += 1
        inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """Lines in their order within each block, with the name of the block."""
    stored = spark.read.options(lineSep="\n", pathGlobFilter=glob).text(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return stored.select("value", file.alias(SOURCE), start.alias(START))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Each batch cut where another block begins, and into slices of `_RUN_BYTES`; the blocks of
    a task follow each other."""
    for batch in batches:
        starts = batch.column(START).to_numpy(zero_copy_only=False)
        names = batch.column(SOURCE).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(1 + np.flatnonzero((starts[1:] != starts[:-1]) | (names[1:] != names[:-1]))).tolist(), len(starts)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                name, run = (batch.column(SOURCE)[i].as_py(), int(starts[i])), batch.slice(i, j - i)
                for start, stop in slices(run.column("value"), _RUN_BYTES):
                    yield name, run.slice(start, stop - start)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block where it ends from outside and from inside, and the first line of a file."""
    block, after, header = None, (False, True), None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{SOURCE: block[0], START: block[1], "outside": after[0], "inside": after[1], "header": header}], schema=schema
        )

    schema = pa.schema([(SOURCE, pa.string()), (START, pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("header", pa.string())])
    for name, lines in runs(batches):
        values = lines.column("value")
        if name != block:
            if block is not None:
                yield told()
            block, after = name, (False, True)
            header = values[0].as_py().removeprefix(_MARK).rstrip("\r") if name[1] == 0 else None
        for line in values.filter(pc.match_substring(values, '"')).to_pylist():
            after = (ends_inside(line, after[0]), ends_inside(line, after[1]))
    if block is not None:
        yield told()


def _chain(table: pa.Table) -> pa.Table:
    """How each block of one file begins, and whether the file ends within a cell there."""
    rows = sorted(table.to_pylist(), key=lambda r: r[START])
    inside, out = False, []
    for at, r in enumerate(rows):
        begins, inside = inside, r["inside"] if inside else r["outside"]
        out.append({SOURCE: r[SOURCE], START: r[START], "begins": begins, "open_end": inside and at == len(rows) - 1, "header": r["header"]})
    return pa.Table.from_pylist(out, schema=pa.schema(
        [(SOURCE, pa.string()), (START, pa.int64()), ("begins", pa.bool_()), ("open_end", pa.bool_()), ("header", pa.string())]
    ))


class Layout(NamedTuple):
    """Files of one header: what to read, and of all their blocks the hashed names, in order,
    with how each begins and ends (9 bytes for each block)."""

    columns: list[str]
    path: str | list[str]
    names: np.ndarray
    marks: np.ndarray

    def mark(self, name: int) -> int:
        at = int(np.searchsorted(self.names, name))
        if at == len(self.names) or self.names[at] != name:
            raise RuntimeError("the files were cut into other blocks than before, as cores came or went; read them again")
        return int(self.marks[at])


def _name():
    return F.xxhash64(SOURCE, START)


def layouts(spark: SparkSession, path: str | list[str], glob: str = "*") -> list[Layout]:
    """The layouts of all CSV files below `path`, in order of their headers; a header is one
    line. Files without a line have none."""
    told = _chained(spark, path, glob)
    heads = told.filter("header IS NOT NULL").groupBy("header").agg(F.count("*").alias("files")).orderBy("header").collect()
    marks = F.when(F.col("begins"), BEGINS).otherwise(0) + F.when(F.col("open_end"), OPEN_END).otherwise(0)
    out = []
    for head in heads:
        # One header is the rule, and then no file names need to be fetched. Files read without
        # the others are cut into blocks of another size: their blocks are told anew.
        files, own = path, told
        if len(heads) > 1:
            files = [r[0] for r in told.filter(F.col("header") == head.header).select(SOURCE).orderBy(SOURCE).collect()]
            own = _chained(spark, files, glob)
        blocks = own.select(_name().alias("name"), marks.alias("marks")).toArrow().sort_by("name")
        names, marked = blocks.column("name").to_numpy(), blocks.column("marks").to_numpy().astype("uint8")
        out.append(Layout(next(csv.reader([head.header]), []), files, names, marked))
    return out


def _chained(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    functions = _lines(spark, path, glob).mapInArrow(
        _functions, f"{SOURCE} string, {START} bigint, outside boolean, inside boolean, header string"
    )
    chained = functions.groupBy(SOURCE).applyInArrow(
        _chain, f"{SOURCE} string, {START} bigint, begins boolean, open_end boolean, header string"
    )
    return saved(chained, "csv-blocks")


def _put_together(batches: Iterator[pa.RecordBatch], mark_of: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    """Rows out of the lines of blocks, handed on by `_RUN_BYTES` of text."""
    block, held, within, first, number, mark = None, [], False, True, 0, 0
    out: list[tuple] = []
    size = 0

    def row(closed: bool) -> None:
        nonlocal held, first, number, size
        kind = (WHOLE if closed else HEAD) if first else (TAIL if closed else MIDDLE)
        value = "\n".join(held).removesuffix("\r")
        header = first and number == 0 and block[1] == 0
        if not header and (value or kind != WHOLE):
            out.append((value, block[0], block[1], number, kind))
            size += len(value)
        held, first, number = [], True, number + 1

    for name, lines in runs(batches):
        if name != block:
            if held:
                row(closed=mark & OPEN_END > 0)
            block, number, mark = name, 0, mark_of(lines.column("name")[0].as_py())
            within = mark & BEGINS > 0
            first = not within
        values = lines.column("value")
        for line, quoted in zip(values.to_pylist(), pc.match_substring(values, '"').to_pylist()):
            held.append(line)
            if quoted:
                within = ends_inside(line, within)
            if not within:
                row(closed=True)
        if size > _RUN_BYTES or len(out) > 5_000:
            yield batch_of(out)
            out, size = [], 0
    if held:
        row(closed=mark & OPEN_END > 0)
    if out:
        yield batch_of(out)


def rows(spark: SparkSession, layout: Layout, glob: str = "*") -> DataFrame:
    """The text of each row but the headers (`value`), its file, and its place there: the block
    in which it begins and its number among the rows of that block."""
    named = _lines(spark, layout.path, glob).withColumn("name", _name())
    pieces = named.mapInArrow(
        lambda batches: _put_together(batches, layout.mark), f"value string, {SOURCE} string, {START} bigint, row bigint, kind int"
    )
    whole = pieces.filter(F.col("kind") == WHOLE).drop("kind")
    if not (layout.marks & BEGINS).any():
        return whole
    # Only the parts of rows across blocks are moved.
    return whole.unionByName(stitched(pieces.filter(F.col("kind") != WHOLE)))


def batch_of(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["value", SOURCE, START, "row", "kind"])


def stitched(parts: DataFrame, joint: str = "\n") -> DataFrame:
    """Rows from their parts; a row begins where its first part does."""
    order = Window.partitionBy(SOURCE).orderBy(START, "row")
    head = F.last(F.when(F.col("kind") == HEAD, F.struct(START, "row")), ignorenulls=True).over(order)
    told = parts.withColumn("head", head).groupBy(SOURCE, "head").agg(
        F.array_sort(F.collect_list(F.struct(START, "row", "value"))).alias("parts")
    )
    value = F.array_join(F.transform("parts", lambda p: p["value"]), joint)
    return told.select(value.alias("value"), SOURCE, F.col(f"head.{START}").alias(START), F.col("head.row").alias("row"))
