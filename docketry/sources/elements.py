"""JSON documents of any size, cut by Spark into the records that they hold.

A document is a list of records; or an object with a list of records under a wrapper key; or
one record. It is read in pieces that end at a `}`, so that a document without line breaks
makes no text of its own size. Whether a byte lies within a string, and how deep in brackets,
depends on all bytes before it. So each block (the part of a file that one task reads) is first
taken as a function: from outside or inside of a string before the block to outside or inside
after it, and how much deeper. Functions of a file's blocks, chained in order, tell how each
block begins. Of objects, a second reading gathers the text outside of nested values, in which
the place of each list stands for its elements; that names the list to cut. The last reading cuts
elements at commas, block by block; only an element that lies across blocks is moved.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import saved
from docketry.sources.splits import HEAD, MIDDLE, SOURCE, START, TAIL, WHOLE, batch_of, runs, stitched

#: Of a document: a list; an object; not JSON, as far as brackets and strings tell.
LIST, OBJECT, BROKEN = range(3)
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_STEPS = np.zeros(256, np.int8)
_STEPS[list(b"{[")] = 1
_STEPS[list(b"}]")] = -1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
#: Stands for the place of a list in a text that is no object.
_NOWHERE = [-1, -1]


def _pieces(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """The bytes between closing braces in their order within each block."""
    stored = spark.read.options(lineSep="}", pathGlobFilter=glob).text(path)
    meta = F.col("_metadata")
    return stored.select(
        F.col("value").cast("binary").alias("value"),
        meta["file_path"].alias(SOURCE),
        meta["file_block_start"].alias(START),
        meta["file_size"].alias("size"),
    )


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where strings begin or end: quotes behind an even number of backslashes."""
    quotes = data == _QUOTE
    escapes = data == _BACKSLASH
    if escapes.any():
        at = np.arange(len(data))
        last_other = np.maximum.accumulate(np.where(escapes, -1, at))
        behind = np.zeros(len(data), np.int64)
        behind[1:] = at[:-1] - last_other[:-1]
        quotes &= behind % 2 == 0
    return quotes


def depths(data: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """After each byte: whether it lies outside of strings, and the depth in brackets."""
    outside = (np.cumsum(_quotes(data)) + inside) % 2 == 0
    return outside, depth + np.cumsum(np.where(outside, _STEPS[data], 0), dtype=np.int64)


def _joined(values: pa.Array, lead: bytes) -> np.ndarray:
    return np.frombuffer(lead + b"}".join(values.to_pylist()), np.uint8)


_FUNCTION = "size bigint, bytes bigint, ends_inside array<boolean>, deeper array<bigint>, first int"


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block where it ends and how much deeper, from outside and from inside of a
    string, each piece taken with a closing brace; and the first byte of a file that is not blank."""
    schema = pa.schema([
        (SOURCE, pa.string()), (START, pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()),
        ("ends_inside", pa.list_(pa.bool_())), ("deeper", pa.list_(pa.int64())), ("first", pa.int32()),
    ])
    told: dict | None = None
    for (name, start), pieces in runs(batches):
        if told is None or (told[SOURCE], told[START]) != (name, start):
            if told:
                yield pa.RecordBatch.from_pylist([told], schema=schema)
            told = {SOURCE: name, START: start, "size": pieces.column("size")[0].as_py(), "bytes": 0,
                    "ends_inside": [False, True], "deeper": [0, 0], "first": None}
        data = np.append(_joined(pieces.column("value"), b""), np.uint8(ord("}")))
        if told["first"] is None and start == 0 and not _BLANK[data].all():
            told["first"] = int(data[~_BLANK[data]][0])
        odd = np.cumsum(_quotes(data)) % 2 == 1
        steps = _STEPS[data]
        told["bytes"] += len(data)
        for i, inside in enumerate(told["ends_inside"]):
            told["deeper"][i] += int(steps[odd == inside].sum())
            told["ends_inside"][i] = bool(odd[-1]) != inside
    if told:
        yield pa.RecordBatch.from_pylist([told], schema=schema)


def _chain(table: pa.Table) -> pa.Table:
    """How each block of one file begins, and whether its last closing brace is none of the file's.

    Every piece was counted with a closing brace, so a file that ends otherwise seems one byte
    too long; a mark of three bytes before the text is left out by the reader.
    """
    found = sorted(table.to_pylist(), key=lambda r: r[START])
    more = sum(r["bytes"] for r in found) - found[0]["size"]
    unclosed = more in (1, -2)
    inside, depth, out = False, 0, []
    for r in found:
        out.append({SOURCE: r[SOURCE], START: r[START], "inside": inside, "depth": depth, "unclosed": False, "final": False})
        depth += r["deeper"][inside]
        inside = r["ends_inside"][inside]
    out[-1] |= {"unclosed": unclosed, "final": True}
    if unclosed and not inside:
        depth += 1
    kind = {ord("["): LIST, ord("{"): OBJECT}.get(found[0]["first"], BROKEN)
    if inside or depth:
        kind = BROKEN
    return pa.Table.from_pylist([r | {"kind": kind} for r in out], schema=pa.schema(
        [(SOURCE, pa.string()), (START, pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("unclosed", pa.bool_()),
         ("final", pa.bool_()), ("kind", pa.int32())]
    ))


class _Begin(NamedTuple):
    inside: bool
    depth: int
    unclosed: bool
    final: bool
    kind: int


class _Blocks(NamedTuple):
    """How all blocks of all files begin, by their hashed names in order (13 bytes a block)."""

    names: np.ndarray
    marks: np.ndarray
    depths: np.ndarray

    def begin(self, name: int) -> _Begin:
        at = int(np.searchsorted(self.names, name))
        if at == len(self.names) or self.names[at] != name:
            raise RuntimeError("the files were cut into other blocks than before, as cores came or went; read them again")
        mark = int(self.marks[at])
        return _Begin(mark & 1 > 0, int(self.depths[at]), mark & 2 > 0, mark & 4 > 0, mark >> 3)


class _Lists(NamedTuple):
    """Of objects that wrap their records, by the hashed names of the files in order, the places
    of the brackets of that list: block and byte of the opening, block and byte of the closing."""

    files: np.ndarray
    places: np.ndarray

    def of(self, file: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
        at = int(np.searchsorted(self.files, file))
        if at == len(self.files) or self.files[at] != file:
            return None
        a, b, c, d = self.places[at].tolist()
        return (a, b), (c, d)


def _walk(batches: Iterator[pa.RecordBatch], blocks: _Blocks) -> Iterator[tuple]:
    """Parts of blocks: block, hashed file, how it begins, byte in the block, the bytes, which lie
    outside of strings, how deep, and whether the block ends with them."""
    block, file, begin, at, inside, depth = None, 0, None, 0, False, 0

    def part(data: np.ndarray, last: bool):
        nonlocal at, inside, depth
        outside, deep = depths(data, inside, depth)
        here, at = at, at + len(data)
        if len(data):
            # A byte that closes a string counts as outside, one that opens it as inside.
            inside, depth = not outside[-1], int(deep[-1])
        return block, file, begin, here, data, outside, deep, last

    def end():
        return part(np.frombuffer(b"" if begin.unclosed else b"}", np.uint8), True)

    for name, pieces in runs(batches):
        lead = b"}"
        if name != block:
            if block is not None:
                yield end()
            block, file, lead = name, pieces.column("file")[0].as_py(), b""
            begin, at = blocks.begin(pieces.column("name")[0].as_py()), 0
            inside, depth = begin.inside, begin.depth
        yield part(_joined(pieces.column("value"), lead), False)
    if block is not None:
        yield end()


def _named(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("name", F.xxhash64(SOURCE, START)).withColumn("file", F.xxhash64(SOURCE))


def _outlines(pieces: DataFrame, blocks: _Blocks) -> DataFrame:
    """Of objects the text outside of nested values; a list with elements holds the places of its
    brackets instead."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, start), file, begin, at, data, outside, deep, _ in _walk(batches, blocks):
            if begin.kind != OBJECT:
                continue
            steps = np.where(outside, _STEPS[data], 0)
            opening = np.flatnonzero((deep == 2) & (steps == 1))
            closing = np.flatnonzero((deep == 1) & (steps == -1))
            solid = np.flatnonzero(~_BLANK[data])
            keep = deep <= 1
            keep[opening] = True
            inserted = {}
            for i in opening[data[opening] == ord("[")].tolist():
                after = np.searchsorted(solid, i, side="right")
                if after == len(solid) or data[solid[after]] != ord("]"):
                    inserted[i] = b"[[%d,%d]" % (start, at + i)
            for i in closing[data[closing] == ord("]")].tolist():
                before = np.searchsorted(solid, i) - 1
                if before < 0 or data[solid[before]] != ord("["):
                    inserted[i] = b",[%d,%d]]" % (start, at + i)
            text, done = b"", 0
            for i, places in sorted(inserted.items()):
                text += data[done:i][keep[done:i]].tobytes() + places
                done = i + 1
            text += data[done:][keep[done:]].tobytes()
            if text:
                yield pa.RecordBatch.from_pydict({SOURCE: [name], "file": [file], START: [start], "at": [at], "text": [text]})

    return pieces.mapInArrow(outer, f"{SOURCE} string, file bigint, {START} bigint, at bigint, text binary")


def _lists(pieces: DataFrame, blocks: _Blocks, wrappers: tuple[str, ...]) -> _Lists:
    def chosen(table: pa.Table) -> pa.Table:
        parts = sorted(table.select([START, "at", "text"]).to_pylist(), key=lambda r: (r[START], r["at"]))
        try:
            outline = json.loads(b"".join(r["text"] for r in parts))
        except ValueError:
            outline = {wrappers[0]: [_NOWHERE, _NOWHERE]}
        held = next((outline[w] for w in wrappers if isinstance(outline.get(w), list) and len(outline[w]) == 2), None)
        rows = [{"file": table.column("file")[0].as_py(), "places": held[0] + held[1]}] if held else []
        return pa.Table.from_pylist(rows, schema=pa.schema([("file", pa.int64()), ("places", pa.list_(pa.int64()))]))

    found = _outlines(pieces, blocks).groupBy(SOURCE).applyInArrow(chosen, "file bigint, places array<bigint>").toArrow().sort_by("file")
    places = found.column("places").combine_chunks().flatten().to_numpy().reshape(-1, 4)
    return _Lists(found.column("file").to_numpy(), places)


def records(spark: SparkSession, path: str | list[str], wrappers: tuple[str, ...], glob: str = "*") -> DataFrame:
    """The text of each record (`value`), its file, and its place there: the block in which it
    begins and its number among the records of that block.

    The records are the elements of a list; or of the first list with elements under one of the
    `wrappers`; else the whole text is one. Text that is no JSON is a record that cannot be
    parsed, so that a caller finds out. Files without a byte have none.
    """
    pieces = _pieces(spark, path, glob)
    functions = pieces.mapInArrow(_functions, f"{SOURCE} string, {START} bigint, {_FUNCTION}")
    chained = functions.groupBy(SOURCE).applyInArrow(
        _chain, f"{SOURCE} string, {START} bigint, inside boolean, depth bigint, unclosed boolean, final boolean, kind int"
    )
    told = saved(chained, "json-blocks")
    mark = F.col("inside").cast("int") + 2 * F.col("unclosed").cast("int") + 4 * F.col("final").cast("int") + 8 * F.col("kind")
    known = told.select(F.xxhash64(SOURCE, START).alias("name"), mark.alias("mark"), "depth").toArrow().sort_by("name")
    names, marks, deep = (known.column(c).to_numpy() for c in known.column_names)
    blocks = _Blocks(names, marks.astype(np.uint8), deep.astype(np.int32))
    named = _named(pieces)
    objects = bool((blocks.marks >> 3 == OBJECT).any())
    lists = _lists(named, blocks, wrappers) if objects else _Lists(np.array([], np.int64), np.zeros((0, 4), np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        # Of a block: the part of an element so far, whether the element begins here, and whether
        # the last byte lies within the list; of the list: nothing in it yet, its end passed.
        block, held, number, first, within, empty, closed = None, [], 0, True, False, False, False

        def element(ends: bool) -> None:
            nonlocal held, first, number
            kind = (WHOLE if ends else HEAD) if first else (TAIL if ends else MIDDLE)
            out.append((b"".join(held).decode(), *block, number, kind))
            held, first, number = [], True, number + 1

        for name, file, begin, at, data, outside, deep, last in _walk(batches, blocks):
            start = name[1]
            bounds = lists.of(file) if begin.kind == OBJECT else None
            broken = begin.kind == BROKEN or bounds and list(bounds[0]) == _NOWHERE
            level = 1 if begin.kind == LIST else 2 if bounds else 0
            if name != block:
                block, held, number, empty = name, [], 0, False
                continued = start > 0 and (bounds[0][0] < start <= bounds[1][0] if bounds else level == 0 or begin.depth > 0)
                first, within, closed = not continued, continued or level == 0, start > 0 and begin.depth == 0
            if broken:
                if start == at == 0:
                    out.append(("", *block, number, WHOLE))
                continue
            done = 0
            if level:
                steps = np.where(outside, _STEPS[data], 0)
                commas = outside & (data == _COMMA)
                edges = ((deep == level) & ((steps == 1) | commas)) | ((deep == level - 1) & (steps == -1))
                for i in np.flatnonzero(edges).tolist():
                    if bounds and not bounds[0] <= (start, at + i) <= bounds[1]:
                        continue
                    if steps[i] == 1:
                        within = empty = True
                    else:
                        held.append(data[done:i].tobytes())
                        if commas[i] or not empty or b"".join(held).strip():
                            element(ends=True)
                        held, empty, within = [], False, bool(commas[i])
                    done = i + 1
            if within:
                held.append(data[done:].tobytes())
            if level == 1:
                # Outside of the list only its closing bracket may stand.
                rest = data[(deep <= 0) & ~_BLANK[data]]
                if len(rest) > (not closed) or (rest != ord("]")).any():
                    out.append(("", *block, number, WHOLE))
                    number += 1
                closed = closed or len(rest) > 0
            if last and within:
                element(ends=begin.final and level == 0)
            if len(out) > 5_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    parts = named.mapInArrow(cut, f"value string, {SOURCE} string, {START} bigint, row bigint, kind int")
    # Null for what is only a part: a caller's checks may be run before the filter.
    whole = parts.withColumn("value", F.when(F.col("kind") == WHOLE, F.col("value"))).filter(F.col("kind") == WHOLE).drop("kind")
    if not (blocks.depths > 0).any():
        return whole
    # Only the parts of elements across blocks are moved.
    return whole.unionByName(stitched(parts.filter(F.col("kind") != WHOLE), ""))
