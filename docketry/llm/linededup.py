"""Line deduplication over a sharded minimal perfect hash.

Lines are hashed to 128 bits; those found in enough documents are dealt into shards by
their hash. A shard is one row: the bit levels of a minimal perfect hash, and by its
positions an array each of fingerprints, counts and keepers (the largest document that
holds the line). Documents send their line hashes, packed by shard, and probe the arrays
as a stream; lines themselves are never joined. The few lines that make up much of the
corpus lie in one more shard of bounded size which every task holds, so that no shard
gets a hot line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.batches import as_texts, slices
from docketry.llm.components import saved

SPACE = " \t\n\v\f\r"
#: A line counts from this length and this many documents on.
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
SHARD_LINES = 1 << 18
#: Lines with more than 1 / HEAVY of all finds; there are fewer than HEAVY of them.
HEAVY = 4096
#: Stands for a null id, which counts as the smallest of all.
NO_ID = -(2**63)
GAMMA = 2.0


def line_keys(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines of some texts: as they stand, the row of each, which ones count, and the
    two halves of the hashes of those."""
    parts = pc.split_pattern(texts, "\n")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    lines = parts.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE))
    counts = pc.greater_equal(pc.utf8_length(keys), LEAST_LENGTH).to_numpy(zero_copy_only=False)
    long = pc.cast(keys.filter(pa.array(counts)), pa.binary()).to_pylist()
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, long)), "<u8").reshape(-1, 2)
    return lines, row, counts, digests


def _mixed(digests: np.ndarray, level: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)
    out = digests[:, 0] ^ (digests[:, 1] * np.uint64(0x9E3779B97F4A7C15) + salt)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class PerfectHash:
    """Keys to 0 .. n-1, each to its own: at each level those keys that are alone in their
    bit settle there, the others go on to the next level."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)]).astype("int64")
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype("int64"))])

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], digests
        while len(left):
            size = (int(len(left) * GAMMA) // 64 + 1) * 64
            bit = _mixed(left, len(sizes)) % np.uint64(size)
            alone = np.bincount(bit.astype("int64"), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[bit.astype("int64")]]
        return cls(np.array(sizes, "int64"), np.concatenate([*words, np.zeros(0, "<u8")]))

    def __call__(self, digests: np.ndarray) -> np.ndarray:
        """Positions; of a key that is not among those hashed any one, or -1."""
        out = np.full(len(digests), -1, "int64")
        left = np.arange(len(digests))
        for level, size in enumerate(self.sizes.tolist()):
            bit = _mixed(digests[left], level) % np.uint64(size)
            word = self.starts[level] + (bit >> np.uint64(6)).astype("int64")
            below = np.uint64(1) << (bit & np.uint64(63))
            there = (self.words[word] & below) > 0
            at = word[there]
            out[left[there]] = self.ranks[at] + np.bitwise_count(self.words[at] & (below[there] - np.uint64(1)))
            left = left[~there]
        return out


class LineIndex:
    """The arrays of one shard."""

    FIELDS = "sizes binary, words binary, fingerprints binary, counts binary, keepers binary"

    def __init__(self, place: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.place, self.fingerprints, self.counts, self.keepers = place, fingerprints, counts, keepers

    @classmethod
    def of(cls, digests: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> LineIndex:
        place = PerfectHash.of(digests)
        order = np.argsort(place(digests))
        return cls(place, digests[order, 1], np.minimum(counts[order], 2**32 - 1).astype("<u4"), keepers[order])

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.place.sizes, self.place.words, self.fingerprints, self.counts, self.keepers)]

    @classmethod
    def unpacked(cls, sizes: bytes, words: bytes, fingerprints: bytes, counts: bytes, keepers: bytes) -> LineIndex:
        place = PerfectHash(np.frombuffer(sizes, "<i8"), np.frombuffer(words, "<u8"))
        return cls(place, *(np.frombuffer(x, kind) for x, kind in ((fingerprints, "<u8"), (counts, "<u4"), (keepers, "<i8"))))

    def probe(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are here, and for all of them a keeper (meaningless where not)."""
        if not len(self.keepers):
            return np.zeros(len(digests), bool), np.zeros(len(digests), "int64")
        at = np.maximum(self.place(digests), 0)
        return self.fingerprints[at] == digests[:, 1], self.keepers[at]


def _shard(digests: np.ndarray, shards: int) -> np.ndarray:
    return ((digests[:, 0] >> np.uint64(16)) % np.uint64(shards)).astype("int64")


def _found(documents: DataFrame) -> DataFrame:
    """(a, b, n, keeper): halves of a line's hash, how many rows have it, the largest id."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), as_texts(batch.column(1))
            for start, stop in slices(texts):
                _, row, counts, digests = line_keys(texts.slice(start, stop - start))
                row = row[counts]
                order = np.lexsort((row, digests[:, 1], digests[:, 0]))
                a, b, row = digests[order, 0], digests[order, 1], row[order]
                line = np.ones(len(a), bool)
                line[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                once = line.copy()
                once[1:] |= row[1:] != row[:-1]
                first = np.flatnonzero(line)
                if len(first):
                    yield pa.RecordBatch.from_pydict({
                        "a": a[first].view("int64"), "b": b[first].view("int64"),
                        "n": np.add.reduceat(once.astype("int64"), first),
                        "keeper": np.maximum.reduceat(ids[start:stop][row], first),
                    })

    told = documents.select("id", "text").mapInArrow(tell, "a bigint, b bigint, n bigint, keeper bigint")
    whole = told.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return whole.filter(F.col("n") >= LEAST_DOCUMENTS)


def _digests(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    halves = [np.asarray(table.column(c).to_numpy(), "int64").view("uint64") for c in ("a", "b")]
    return np.ascontiguousarray(np.column_stack(halves))


def _index(table: pa.Table) -> LineIndex:
    return LineIndex.of(_digests(table), *(np.asarray(table.column(c).to_numpy(), "int64") for c in ("n", "keeper")))


def line_index(documents: DataFrame) -> tuple[DataFrame, LineIndex, int]:
    """The shards as a written table (shard, the arrays), the shard of the heavy lines, and
    the number of shards. `documents` has `id` and `text`."""
    spark = documents.sparkSession
    found = saved(_found(documents), "lines")
    size = found.agg(F.count("*").alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("finds")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["lines"] // SHARD_LINES))
    heavy = F.col("n") * HEAVY > F.lit(size["finds"])

    def build(table: pa.Table) -> pa.Table:
        row = [[int(table.column("shard")[0].as_py())], *([x] for x in _index(table).packed())]
        return pa.Table.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=names)

    names = ["shard", *(x.split()[0] for x in LineIndex.FIELDS.split(", "))]
    unsigned = F.shiftrightunsigned("a", 16)  # as in _shard
    dealt = found.filter(~heavy).withColumn("shard", F.pmod(unsigned, F.lit(shards).cast("bigint")))
    indexes = saved(dealt.groupBy("shard").applyInArrow(build, f"shard bigint, {LineIndex.FIELDS}"), "line-index")
    return indexes, _index(found.filter(heavy).toArrow()), shards


_PACKED = "shard bigint, kind int, ids binary, marks binary, a binary, b binary"


def _drops(documents: DataFrame) -> DataFrame:
    """(id, mark, dropped): for each text that loses lines the hashes (first halves) of those."""
    indexes, heavy, shards = line_index(documents)
    everywhere = documents.sparkSession.sparkContext.broadcast(heavy.packed())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = LineIndex.unpacked(*everywhere.value)
        settled = 0
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            texts = as_texts(batch.column(2))
            for start, stop in slices(texts):
                _, row, counts, digests = line_keys(texts.slice(start, stop - start))
                row = row[counts] + start
                here, keeper = heavy.probe(digests)
                shard = _shard(digests, shards)
                # Answered already: dealt evenly over all tasks, under negative shards.
                settled += 1
                shard[here] = -1 - settled % shards
                keep = ~here | (keeper != ids[row])
                order = np.flatnonzero(keep)[np.argsort(shard[keep], kind="stable")]
                cuts = np.flatnonzero(np.diff(shard[order], prepend=np.int64(2**62)))
                out = []
                for x, y in zip(cuts, [*cuts[1:], len(order)]):
                    some = order[x:y]
                    out.append((int(shard[some[0]]), 1, ids[row[some]].tobytes(), marks[row[some]].tobytes(),
                                digests[some, 0].tobytes(), digests[some, 1].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int32(), *[pa.binary()] * 4])],
                        names=["shard", "kind", "ids", "marks", "a", "b"],
                    )

    asked = documents.select("id", "mark", "text").mapInArrow(ask, _PACKED)
    arrays = indexes.withColumn("kind", F.lit(0))
    stream = asked.unionByName(arrays, allowMissingColumns=True)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        for batch in batches:
            for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if values[1] == 0:
                    shard, index = values[0], LineIndex.unpacked(*values[6:])
                    continue
                ids, marks, a, b = (np.frombuffer(x, "<i8") for x in values[2:6])
                if values[0] >= 0:
                    if values[0] != shard:
                        continue  # no line of this shard is frequent
                    digests = np.ascontiguousarray(np.column_stack([a, b])).view("uint64")
                    here, keeper = index.probe(digests)
                    here &= keeper != ids
                    ids, marks, a = ids[here], marks[here], a[here]
                if len(ids):
                    yield pa.RecordBatch.from_pydict({"id": ids, "mark": marks, "a": a})

    # A shard's arrays come first in its partition, then its probes, one by one.
    dealt = stream.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    hits = dealt.mapInArrow(answer, "id bigint, mark bigint, a bigint")
    return hits.groupBy("id", "mark").agg(F.collect_set("a").alias("dropped"))


KEPT = "struct<n_lines: bigint, n_dropped: bigint, kept: string>"


def _cut(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    texts = as_texts(texts)
    dropped = dropped.combine_chunks() if isinstance(dropped, pa.ChunkedArray) else dropped
    n_lines, n_dropped, kept = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [pa.array([], pa.string())]
    for start, stop in slices(texts):
        some, gone = texts.slice(start, stop - start), dropped.slice(start, stop - start)
        lines, row, counts, digests = line_keys(some)
        where = np.repeat(np.arange(stop - start), pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
        hashes = gone.flatten().to_numpy(zero_copy_only=False).astype("int64").view("uint64")
        drop = np.zeros(len(lines), bool)
        if len(hashes):
            # Pairs of a row and a hash as one order of pairs, so that membership is a search.
            pairs = np.zeros(len(hashes), [("row", "<i8"), ("hash", "<u8")])
            pairs["row"], pairs["hash"] = where, hashes
            mine = np.zeros(int(counts.sum()), pairs.dtype)
            mine["row"], mine["hash"] = row[counts], digests[:, 0]
            drop[counts] = np.isin(mine, pairs)
        n_lines.append(np.bincount(row, minlength=stop - start))
        n_dropped.append(np.bincount(row[drop], minlength=stop - start))
        left = np.bincount(row[~drop], minlength=stop - start)
        offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype("int32"))
        kept.append(pc.binary_join(pa.ListArray.from_arrays(offsets, lines.filter(pa.array(~drop))), "\n"))
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(n_lines)), pa.array(np.concatenate(n_dropped)), pa.concat_arrays(kept)],
        names=["n_lines", "n_dropped", "kept"],
    )


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text `kept`, one row for each row of `documents`.

    A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys
    of LEAST_LENGTH code points or more that are in LEAST_DOCUMENTS rows or more lose all their
    lines except in the rows of the largest id that holds them; other lines stay as they are.

    A null or empty text is one empty line. A null id counts as the smallest (as NO_ID does)
    and stays null in the result. Rows are documents of their own: repeated rows count each,
    and rows of one id are kept or lose lines together. A text of any length is read whole. No
    rows give no rows; other columns are left out.
    """
    rows = documents.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    joined = rows.join(_drops(rows), ["id", "mark"], "left")
    found = joined.select("id", F.arrow_udf(_cut, KEPT)("text", "dropped").alias("found"))
    return found.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "found.*")
