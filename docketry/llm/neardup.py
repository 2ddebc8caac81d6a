"""Near duplicates by chosen paths: a set similarity join on MinHash.

Texts with equal shingle sets form a class; classes are what is joined. Every class has
PLACES minwise hashes. A tree node picks BRANCHES of the places by a hash of its path and
sends each of its classes to the children named by place and hash, so two classes of
similarity s stay together in a child with probability s, and are parted only if all
branches part them. TREES independent trees make up the recall: at s = 0.75 a pair is
parted with probability 0.016 in the first level of a tree and 0.018 over all levels, so
that one pair in 10**7 is missed. First-level nodes go by hashes of 32 bits, as all classes
meet there; 16 bits of each are kept for all that follows, where they rarely agree by chance.

Nodes are compared as follows, so that no group of copies is ever written out as pairs:
1. In each first-level node all classes are paired with its smallest one only. Pairs whose
   hashes agree enough are checked on full sets and linked, and components taken.
2. Nodes that still hold several components: one of SMALL classes or fewer is compared
   inside, by hashes, the others against its largest component and each other; what agrees
   enough is checked on full sets. A larger one branches on.
3. Tight nodes, of many alike but mostly unlinked classes, would branch without end and
   yield pairs by the square. They are told by the share of pairs that their children keep
   together, or by the pairs found. They are compared on full sets, block by block, as
   matrix products, and give the links of a spanning forest only. So are nodes of one huge
   component with few others, and what is large at the deepest level.
Components are then taken once more.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.batches import as_texts, slices
from docketry.llm.blocks import meet
from docketry.llm.components import components, saved

WORDS, PERCENT = 5, 75
PLACES, TREES, BRANCHES, DEPTH, SMALL = 128, 4, 3, 12, 512
#: A node is tight if its classes' mean similarity is this, or it has so many pairs per class.
TIGHT_SIMILARITY, TIGHT_PAIRS = 0.3, 8
#: Agreeing hashes from which a pair is checked; at 75 % similarity fewer happen once in 10**7.
AGREE = 70
BLOCK_ROWS, COLUMNS = 1024, 4096
#: Bits of the broadcast bitmap of ids, 16 MB.
MARK_BITS = 27


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w) for w in words], "uint64")


def shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of texts: its rows, all rows' shingle hashes (sorted and distinct in a
    row), and where each row's end. A text of fewer words is one shingle, one without words none."""
    for start, stop in slices(texts):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(start, stop - start)))
        row = np.repeat(np.arange(stop - start), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        hashes = _word_hashes(coded.dictionary.to_pylist())[at] if len(at) else np.zeros(0, "uint64")
        full = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[at] > 0 if len(at) else np.zeros(0, bool)
        row, hashes = row[full], hashes[full]  # white space at the ends leaves empty words
        counts = np.bincount(row, minlength=stop - start)
        ends = np.cumsum(counts)
        code = np.zeros(len(hashes), "uint64")
        place = np.arange(len(hashes)) - (ends - counts)[row]
        left = counts[row] - place  # words from here to the end of the text
        for i in range(WORDS):
            inside = np.flatnonzero((left > i) & ((left >= WORDS) | (place == 0)))
            code[inside] = mix(code[inside] + hashes[inside + i] + np.uint64(0x9E3779B97F4A7C15))
        first = (left >= WORDS) | (place == 0)
        row, code = row[first], code[first]
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        row, code = row[new], code[new]
        yield start, stop, code, np.cumsum(np.bincount(row, minlength=stop - start))


def _keys(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits that name a set: two sums of its scrambled shingles."""
    if not len(code):
        return [b""] * len(ends)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(mix(code ^ np.uint64(salt)), dtype="uint64")])
        out.append(mix(sums[ends] - sums[starts] + (ends - starts).astype("uint64")))
    raw = np.stack(out, axis=1).astype(">u8").tobytes()
    return [raw[16 * i:16 * i + 16] for i in range(len(ends))]


def _signatures(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """PLACES minwise hashes of each set that is not empty, as 32-bit numbers."""
    full = np.flatnonzero(ends > starts)
    out = np.zeros((len(ends), PLACES), "uint32")
    if len(full):
        salts = mix(np.arange(1, PLACES + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        base = mix(code)
        for p in range(PLACES):
            hashed = ((base ^ salts[p]) * salts[(p * 7 + 3) % PLACES]) >> np.uint64(32)
            out[full, p] = np.minimum.reduceat(hashed.astype("uint32"), starts[full])
    return out


SKETCH = "doc_id bigint, key binary, n_shingles bigint, signature binary, paths array<bigint>"


def sketches(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The set's name, size, minwise hashes and first-level nodes for each row; null key for an
    empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, TREES + 1, dtype="uint64"))
        picked = _picked(roots)
        for batch in batches:
            for start, stop, code, ends in shingles(as_texts(batch.column(1))):
                starts = np.concatenate([[0], ends[:-1]]).astype("int64")
                full = ends > starts
                signature = _signatures(code, starts, ends)
                paths = np.stack([
                    path.view("int64")
                    for root, places in zip(roots, picked)
                    for path in _descend(np.full(len(ends), root), np.tile(places, (len(ends), 1)), signature)
                ], axis=1)
                raw = signature.astype("uint16").tobytes()
                size = PLACES * 2
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(start, stop - start),
                    "key": pa.array([k if f else None for k, f in zip(_keys(code, starts, ends), full)], pa.binary()),
                    "n_shingles": pa.array(ends - starts, pa.int64()),
                    "signature": pa.array([raw[i * size:(i + 1) * size] if f else None for i, f in enumerate(full)], pa.binary()),
                    "paths": pa.array([x if f else None for x, f in zip(paths.tolist(), full)], pa.list_(pa.int64())),
                })

    return documents.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(sketch, SKETCH)


def _picked(paths: np.ndarray) -> np.ndarray:
    """The BRANCHES different places that each node picks."""
    out = np.zeros((len(paths), BRANCHES), "int64")
    for b in range(BRANCHES):
        out[:, b] = (mix(paths + np.uint64(b + 1)) % np.uint64(PLACES - b)).astype("int64")
        for earlier in np.sort(out[:, :b], axis=1).T:
            out[:, b] += out[:, b] >= earlier
    return out


def _descend(path: np.ndarray, places: np.ndarray, signature: np.ndarray) -> list[np.ndarray]:
    """Children of each row's node: a hash of path, place and minwise hash, per branch."""
    found = []
    for b in range(BRANCHES):
        p = places[:, b]
        value = signature[np.arange(len(p)), p].astype("uint64")
        found.append(mix(path ^ mix(value + (p.astype("uint64") << np.uint64(32)) + np.uint64(1))))
    return found


def _matrix(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), "uint16").reshape(len(values), PLACES)


def first_nodes(classes: DataFrame) -> DataFrame:
    """(path, key) of each class in the first-level nodes of all trees."""
    return classes.select(F.explode("paths").alias("path"), "key")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose minwise hashes agree in AGREE places or more."""
    side = lambda n: classes.select(F.col("key").alias(n), F.col("signature").alias(f"{n}_signature"))

    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_matrix(a) == _matrix(b)).sum(axis=1), pa.int32())

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.withColumn("agree", F.arrow_udf(agree, "int")("a_signature", "b_signature")).filter(
        F.col("agree") >= AGREE
    ).select("a", "b")


def _marked(ids: DataFrame) -> DataFrame:
    """(cell, bits): a bitmap of 2**MARK_BITS bits with a hash of each id set. At most
    2**(MARK_BITS - 15) rows of 4 KB, whatever the number of ids."""
    placed = ids.select(*_place(F.col("doc_id")))
    # Ids are dealt before they are summed, as a task's partial bitmaps would be larger.
    return placed.repartition("cell").groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _place(doc_id: Column) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(doc_id), F.lit(1 << MARK_BITS))
    return F.shiftright(place, 15).cast("int").alias("cell"), (place % 32768).alias("bit")


def full_sets(keys: DataFrame, classes: DataFrame, documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, items): the whole shingle sets of the given classes, from the texts.

    Texts stay where they are: a bitmap of the wanted ids, of a fixed size, is broadcast and
    most other rows drop out at the scan. Those that slip through go by the join on key, so
    the more ids are wanted, the less is saved, but the result is the same.
    """
    wanted = classes.select("key", "doc_id").join(keys.select("key").distinct(), "key")
    wanted = saved(wanted.select("doc_id", F.col("key").alias("wanted")), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, code, ends in shingles(as_texts(batch.column(0))):
                starts = np.concatenate([[0], ends[:-1]]).astype("int64")
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(_keys(code, starts, ends), pa.binary()),
                    "items": pa.array([code[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()),
                })

    marked = F.broadcast(saved(_marked(wanted), "marked_ids"))
    texts = documents.select(*_place(F.col(doc_id).cast("bigint")), F.col(text).alias("text")).join(marked, "cell")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    texts = texts.filter(byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0)
    found = texts.select("text").mapInArrow(sets, "key binary, items binary")
    # Copies of a text need one set.
    own = found.join(wanted.select(F.col("wanted").alias("key")), "key", "left_semi")
    return saved(own.groupBy("key").agg(F.min("items").alias("items")), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose full shingle sets are similar enough."""

    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    side = lambda n: sets.select(F.col("key").alias(n), F.col("items").alias(f"{n}_items"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(F.arrow_udf(similar, "boolean")("a_items", "b_items")).select("a", "b")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def _sizes(rows: DataFrame, *along: str) -> DataFrame:
    """For each node of rows (path, key, root): `size`, how many components (`roots`), its
    largest one (`main`) and how many classes are not in that (`others`). A node's component
    is folded before it is shuffled."""
    parts = rows.groupBy(*along, "path", "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy(*along, "path").agg(F.sum("n").alias("size"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"))
    return sizes.select(*along, "path", "size", "roots", (F.col("size") - F.col("most.n")).alias("others"), F.col("most.root").alias("main"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of `documents`.

    component_id is the smallest doc_id of all texts that links lead to, the own one
    included. Texts without words, null ones too, are linked with nothing: component_id is
    the own doc_id. Rows of equal text or equal id stay rows; a null id takes part but is
    never a component's id unless all are null. Other columns are left out; no rows give none.
    """
    rows = saved(sketches(documents, doc_id, text), "sketches")
    classes = saved(
        rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature"), F.min("paths").alias("paths")),
        "classes",
    )
    nodes = first_nodes(classes)
    sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), F.min("key").alias("smallest")).filter("size > 1")
    nodes = saved(nodes.join(sizes, "path"), "nodes")
    star = nodes.filter(F.col("key") != F.col("smallest")).select(F.col("smallest").alias("a"), F.col("key").alias("b")).distinct()
    star = saved(_agreeing(star, classes), "pairs")
    links = saved(confirmed(star, full_sets(ends_of(star), classes, documents, doc_id, text)), "links")
    roots = saved(components(links), "roots")

    pairs, tight = _inside(nodes.select("path", "key"), classes, roots)
    needed = ends_of(pairs).unionByName(tight.select("key"))
    sets = full_sets(needed, classes, documents, doc_id, text)
    links = links.unionByName(confirmed(pairs, sets)).unionByName(_in_blocks(tight, sets))
    roots = saved(components(links), "roots")

    least = (
        classes.join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    )
    ids = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = least.join(ids, "root").select("key", "component_id")
    out = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


NODE = ("path", "key", "root", "size", "others", "main")


def _inside(nodes: DataFrame, classes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the nodes of all depths: pairs of different components with agreeing hashes, and
    the rows of tight nodes. Rows take their component and hashes along from the first level."""
    pairs, tight = [], []
    rows = nodes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Nodes of two are done in the first level, where each meets the smallest.
    sizes = _sizes(rows).filter("roots > 1 AND size > 2")
    held = saved(rows.join(sizes, "path").select(*NODE).join(classes.select("key", "signature"), "key"), "marked")
    for depth in range(1, DEPTH + 1):
        found = saved(_compared(held.filter(F.col("size") <= SMALL)), "pairs")
        pairs.append(found.filter("a IS NOT NULL").select("a", "b"))
        crowded = found.filter("a IS NULL").select("path").distinct()
        tight.append(held.filter(F.col("size") <= SMALL).select(*NODE).join(crowded, "path", "left_semi"))
        large = held.filter(F.col("size") > SMALL)
        if large.isEmpty():
            break
        few = F.col("others") * 4 <= SMALL
        tight.append(large.filter(few).select(*NODE))
        large = large.filter(~few)
        if depth == DEPTH:
            tight.append(large.select(*NODE))
            break
        children = saved(_branched(large), "children")
        sizes = saved(_sizes(children, "parent"), "sizes")
        # The chance that two classes of a node agree in a place is their mean similarity.
        kept = sizes.groupBy("parent").agg(
            (F.sum(F.col("size") * F.col("size")) * BRANCHES / (F.sum("size") * F.sum("size"))).alias("similarity")
        )
        close = saved(kept.filter(F.col("similarity") >= TIGHT_SIMILARITY).select("parent"), "close")
        tight.append(large.select(*NODE).join(close.withColumnRenamed("parent", "path"), "path", "left_semi"))
        several = sizes.filter("roots > 1").join(close, "parent", "left_anti").drop("parent", "roots")
        held = saved(children.drop("parent").join(several, "path").select(*NODE, "signature"), "marked")
    together = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    return saved(together(pairs).distinct(), "pairs"), saved(together(tight), "tight")


def _branched(rows: DataFrame) -> DataFrame:
    """The children of nodes, with their rows' component and hashes."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            path = batch.column(0).to_numpy(zero_copy_only=False).view("uint64")
            for child in _descend(path, _picked(path), _matrix(batch.column(3))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(child.view("int64")), *batch.columns[1:]],
                    names=["parent", "path", "key", "root", "signature"],
                )

    return rows.select("path", "key", "root", "signature").mapInArrow(
        branch, "parent bigint, path bigint, key binary, root binary, signature binary"
    )


PAIR = "a binary, b binary"


def _pairs(keys: list[bytes], others: list[bytes], roots: list, other_roots: list, a: np.ndarray, b: np.ndarray) -> set:
    """Pairs of different roots that agree in AGREE places or more, smaller key first."""
    names = {r: i for i, r in enumerate({*roots, *other_roots})}
    left, right = np.array([names[r] for r in roots]), np.array([names[r] for r in other_roots])
    out = set()
    for i in range(0, len(a), 32):
        same = (a[i:i + 32, None, :] == b[None, :, :]).sum(axis=2, dtype="int16") if len(b) <= 4096 else np.concatenate(
            [(a[i:i + 32, None, :] == b[None, j:j + 4096, :]).sum(axis=2, dtype="int16") for j in range(0, len(b), 4096)], axis=1
        )
        for x, y in zip(*np.nonzero((same >= AGREE) & (left[i:i + 32, None] != right[None, :]))):
            out.add((min(keys[i + x], others[y]), max(keys[i + x], others[y])))
    return out


def _pair_table(pairs: set) -> pa.Table:
    ordered = sorted(pairs)
    return pa.table({"a": pa.array([p[0] for p in ordered], pa.binary()), "b": pa.array([p[1] for p in ordered], pa.binary())})


def _compared(rows: DataFrame) -> DataFrame:
    """(path, a, b): pairs inside nodes of SMALL classes or fewer; nulls name a tight node."""
    dealt = rows.select("path", "key", "root", "main", "signature").repartition("path").sortWithinPartitions("path")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
            for i, j in zip([0, *cuts], [*cuts, len(path)]):
                if i == j:
                    continue
                if held and path[i] != last:
                    yield _node(held)
                    held = []
                held.append(batch.slice(i, j - i))
                last = path[i]
        if held:
            yield _node(held)

    return dealt.mapInArrow(compare, "path bigint, a binary, b binary")


def _node(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts)
    path = rows.column("path")[0].as_py()
    keys, roots, main = (rows.column(n).to_pylist() for n in ("key", "root", "main"))
    signature = _matrix(rows.column("signature").combine_chunks())
    rest = [i for i, r in enumerate(roots) if r != main[0]]
    found = _pairs([keys[i] for i in rest], keys, [roots[i] for i in rest], roots, signature[rest], signature)
    if len(found) > TIGHT_PAIRS * len(keys):
        found = {(None, None)}
    a, b = zip(*sorted(found)) if found else ((), ())
    return pa.RecordBatch.from_pydict({
        "path": pa.array([path] * len(a), pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()),
    })


def _in_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside tight nodes: what is outside of a node's main component against all of the
    node, on full sets. A pair of blocks gives at most a spanning forest's links."""
    rows = rows.select("path", "key", "root", "main", "size", "others").join(sets, "key")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), blocks(n))
    keep = [F.col("path").alias("key"), F.col("key").alias("name"), F.col("root").alias("root"), F.col("items").alias("items")]
    all_ = rows.select(*keep, own("size").alias("point_block"), every("others").alias("query_block"))
    others = rows.filter("root <> main").select(*keep, every("size").alias("point_block"), own("others").alias("query_block"))

    def compare(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return _pair_table(set())
        return _pair_table(_forest(points, queries))

    return meet(all_, others, compare, PAIR)


def _forest(points: pa.Table, queries: pa.Table) -> set:
    """Links between different components of two blocks, none that others imply."""
    names = [t.column("name").to_pylist() for t in (points, queries)]
    roots = [t.column("root").to_pylist() for t in (points, queries)]
    items = [[np.frombuffer(x, "uint64") for x in t.column("items").to_pylist()] for t in (points, queries)]
    sizes = [np.array([len(x) for x in side], "int64") for side in items]
    flat = np.concatenate([*items[0], *items[1]])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    # An item that only one set has is in no intersection.
    shared = np.cumsum(times > 1) - 1
    column = np.where(times[code] > 1, shared[code], -1)
    cut = sizes[0].sum()
    sides = [(np.repeat(np.arange(len(s)), s), c) for s, c in zip(sizes, (column[:cut], column[cut:]))]
    common = np.zeros((len(names[1]), len(names[0])), "float32")
    for low in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
        matrices = []
        for (row, c), s in zip(sides, sizes):
            here = (c >= low) & (c < low + COLUMNS)
            matrix = np.zeros((len(s), COLUMNS), "float32")
            matrix[row[here], c[here] - low] = 1
            matrices.append(matrix)
        common += matrices[1] @ matrices[0].T
    whole = common.astype("int64")
    alike = 100 * whole >= PERCENT * (sizes[1][:, None] + sizes[0][None, :] - whole)
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = set()
    for q, p in zip(*np.nonzero(alike)):
        a, b = root(roots[1][q]), root(roots[0][p])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.add((min(names[1][q], names[0][p]), max(names[1][q], names[0][p])))
    return out
