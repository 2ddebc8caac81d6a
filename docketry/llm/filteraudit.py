"""How document filters interact: what each removes, in every order they can be applied.

The duplicate filter is settled by radix tries. Texts are dealt by ranges of their
prefixes; a prefix that holds more than its share is told further until it does not, or
until it is the whole text. Each range inserts its full texts into a compressed trie whose
terminals hold the least id; traversing it gives the least id of each repeated text. With
that every document has a mask of the filters it fails, and all orders are worked out from
the counts of the at most 32 masks of a part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.batches import as_texts, slices
from docketry.llm.components import saved

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
MARKS = "[#$%&*|]"
DUPLICATE = 1 << FILTERS.index("E")
#: Code points of the first prefix; a full one is told this many times further.
PREFIX, FURTHER = 16, 4
RANGE_BYTES = 64 << 20
HELD_BYTES = 32 << 20


def failed(texts: pa.Array) -> np.ndarray:
    """For each text the bits of A to D, where it fails."""
    raw = pc.cast(texts, pa.binary())
    words, distinct = np.zeros(len(texts), "int64"), np.zeros(len(texts), "int64")
    capitals = np.zeros(len(texts), "int64")
    for i, text in enumerate(raw):
        text = text.as_py()
        found = text.split()  # bytes are split at ASCII white space only
        words[i], distinct[i] = len(found), len(set(found))
        letters = np.frombuffer(text, "uint8")
        capitals[i] = np.count_nonzero(letters - np.uint8(65) < 26)
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("int64")
    marked = pc.match_substring_regex(texts, MARKS).to_numpy(zero_copy_only=False)
    tests = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, marked]
    return sum(np.where(test, 1 << i, 0) for i, test in enumerate(tests)).astype("int32")


def names(raw: list[bytes]) -> np.ndarray:
    """A digest of each text, as two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<i8").reshape(-1, 2)


class Node:
    __slots__ = ("edges", "least", "rows")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.least, self.rows = None, 0

    def end(self, least: int | None, rows: int) -> None:
        """A text ends here: `rows` rows, the least id of which is `least`."""
        self.rows += rows
        if least is not None and (self.least is None or least < self.least):
            self.least = least


def _alike(label: bytes, text: bytes, at: int) -> int:
    """Bytes that `label` and `text` from `at` on begin with alike, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """Whole texts by their bytes; an edge holds as many bytes as go one way only."""

    def __init__(self):
        self.root = Node()

    def insert(self, text: bytes, least: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Node()
                node.edges[text[at]] = (text[at:], leaf)
                node, at = leaf, len(text)
                break
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            alike = _alike(label, text, at)
            fork = Node()
            fork.edges[label[alike]] = (label[alike:], below)
            node.edges[text[at]] = (label[:alike], fork)
            node, at = fork, at + alike
        node.end(least, rows)

    def repeated(self) -> Iterator[tuple[bytes, int]]:
        """(text, least id) of the texts with several rows and any id."""
        waiting: list[tuple[Node, tuple[bytes, ...]]] = [(self.root, ())]
        while waiting:
            node, way = waiting.pop()
            if node.rows > 1 and node.least is not None:
                yield b"".join(way), node.least
            waiting += [(below, (*way, label)) for label, below in node.edges.values()]


def adaptive_prefix(texts: DataFrame, ranges: int) -> Column:
    """A prefix of `text` that no more than about 1 / `ranges` of all characters share, unless
    it is the whole text. Fewer than `ranges` prefixes of each length are told further, so
    the driver holds a bounded number of them; lengths grow until none is left."""
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    size, prefix, left = PREFIX, F.substring("text", 1, PREFIX), texts
    while True:
        held = left.groupBy(F.substring("text", 1, size).alias("prefix")).agg(
            F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("longest")
        )
        full = [r["prefix"] for r in held.filter((F.col("n") * ranges > total) & (F.col("longest") > size)).collect()]
        if not full:
            return prefix
        more = F.substring("text", 1, size).isin(full)
        left = left.filter(more)
        size *= FURTHER
        # Prefixes keep the order of texts, so a longer one lies within the range of the shorter.
        prefix = F.when(more, F.substring("text", 1, size)).otherwise(prefix)


def repeated_texts(documents: DataFrame) -> DataFrame:
    """(a, b, least): digest of each text that several rows have, and their least id.

    Equal texts meet in each task before they are moved, so a text that very many rows have
    is moved once for each HELD_BYTES of a task.
    """
    spark = documents.sparkSession
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        room = HELD_BYTES
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1))):
                text = text.as_py()
                seen = held.get(text)
                if seen is None:
                    held[text] = [doc, 1]
                    room -= len(text)
                else:
                    seen[0] = doc if seen[0] is None else seen[0] if doc is None else min(doc, seen[0])
                    seen[1] += 1
                if room < 0:
                    yield packed(held)
                    held, room = {}, HELD_BYTES
        if held:
            yield packed(held)

    def packed(held: dict[str, list]) -> pa.RecordBatch:
        least, rows = zip(*held.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([*held], pa.string()), pa.array(least, pa.int64()), pa.array(rows, pa.int64())], names=["text", "least", "rows"]
        )

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for batch in batches:
            for text, least, rows in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                trie.insert(text.as_py().encode(), least, rows)
        found = [(xxhash.xxh3_128_digest(text), least) for text, least in trie.repeated()]
        for part in range(0, len(found), 10_000):
            digests, least = zip(*found[part:part + 10_000])
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": halves[:, 0], "b": halves[:, 1], "least": pa.array(least, pa.int64())})

    folded = documents.select("id", "text").mapInArrow(fold, "text string, least bigint, rows bigint")
    dealt = folded.repartitionByRange(ranges, adaptive_prefix(documents.select("text"), ranges))
    return dealt.mapInArrow(tries, "a bigint, b bigint, least bigint")


def masks(documents: DataFrame) -> DataFrame:
    """id, part and the mask of failed filters for each row of `documents` (id, part, text)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_texts(batch.column(2))
            for start, stop in slices(texts):
                some = texts.slice(start, stop - start)
                halves = names(pc.cast(some, pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), pa.array(failed(some)),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    names=["id", "part", "mask", "a", "b"],
                )

    judged = documents.select("id", "part", "text").mapInArrow(judge, "id bigint, part string, mask int, a bigint, b bigint")
    repeated = saved(repeated_texts(documents), "repeated")
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    mask = F.col("mask") + F.when(later, DUPLICATE).otherwise(0)
    return judged.join(repeated, ["a", "b"], "left").select("id", "part", mask.alias("mask"))


def counted(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows of each mask, and those that `labels` marks."""
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marked = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").alias("id")).agg(yes("quality"), yes("toxic"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return masked.join(marked, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic")
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step of it: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `documents` has doc_id, text, lang (the part), `labels` doc_id, quality, toxic; other
    columns are left out. Null text and null lang are empty. A null id has no label; such a row
    is no duplicate and makes none. Rows of one id and text are no duplicates of each other; each
    row counts. Of several labels of an id any 1 counts. No documents give no rows.
    """
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    # At most 32 masks for each part.
    entry = F.struct("mask", "n", "good", "toxic")
    parts = counted(masks(rows), labels).groupBy("part").agg(F.collect_list(entry).alias("masks"))
    bit_of = {x: 1 << i for i, x in enumerate(FILTERS)}
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "before": sum(bit_of[x] for x in order[:k]), "bit": bit_of[order[k]]}
        for order in permutations(FILTERS) for k in range(len(FILTERS))
    ]
    orders = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    told = parts.select("part", "masks", F.explode(orders).alias("s")).select("part", "masks", "s.*")

    def total(value: str, test) -> Column:
        kept = F.filter("masks", test)
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x[value])

    before, bit = F.col("before"), F.col("bit")
    free = lambda x: x["mask"].bitwiseAND(before) == 0
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    removed = lambda x: free(x) & fails(x)
    # Of the orders, the filter comes first among those that a document fails in this share.
    first = lambda x: (F.lit(120) / F.bit_count(x["mask"])).cast("bigint")
    shapley = F.aggregate(F.filter("masks", fails), F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["n"] * first(x))
    return told.select(
        "part", "filter_order", "step",
        total("n", lambda x: free(x) & ~fails(x)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda x: fails(x) & ~free(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
