"""The trie of all conversations, in shards of balanced parentheses.

Each conversation becomes a path: 16 bytes for each of its turns. Equal paths are folded,
the others are sorted and cut into shards by range, so that one beginning shared by very
many conversations spreads over many shards. A shard is encoded as balanced parentheses
and answers for all nodes that lie in it alone; those on its first and its last path
(its spines) may go on in the neighbours. Spines of adjacent shards are merged, group by
group, until one group is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.components import saved
from docketry.llm.parens import Parens, parents, range_min

#: Turns of a shard, about; shards merged by one task.
SHARD_TURNS, FAN = 1 << 17, 1024
DIGEST = 16
CHUNK_IDS = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE = (
    "shard bigint, spine boolean, on_first boolean, on_last boolean, key binary, parent_key binary, conv_id bigint, "
    "depth bigint, parent_conv_id bigint, n_convs bigint, words bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
_KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in NODE.split(", "))])
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def own_turns(conversations: DataFrame) -> DataFrame:
    """block, conv_id, turns: (key, words) in order of turn, null first, then of the key."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % 20).alias("block"),
        "conv_id",
        F.struct(
            F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"),
            F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
            F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("turn"),
    )
    # Dealt by block, so that a conversation and those that begin like it are in one task.
    dealt = turns.repartition("block").groupBy("block", "conv_id")
    return dealt.agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (DIGEST bytes a turn) and words (a number a turn) of rebuilt conversations."""
    own = own_turns(conversations)
    first = own.filter(F.col("conv_id") == F.col("block")).select("block", F.slice("turns", 1, 3).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice("first", F.lit(1), h)
    turns = F.when(F.col("first").isNull(), rest).otherwise(F.concat(head, rest))
    joined = own.join(first, "block", "left").select("conv_id", turns.alias("turns"))
    return joined.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (name, id) as (name, first id, count, decimal ids joined by commas)."""
    for batch in batches:
        names, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(code, prepend=-1)).tolist()
        ends = [*cuts[1:], len(code)]
        yield pa.RecordBatch.from_pydict({
            "name": names.take(pa.array(cuts, pa.int64())), "first": ids[cuts], "n": np.array(ends, "int64") - np.array(cuts, "int64"),
            "ids": pa.array([",".join(map(str, ids[x:y].tolist())) for x, y in zip(cuts, ends)], pa.string()),
        })


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of a name follow each other: one hash of all their ids, with one chunk in memory."""
    name, conv, n, sha = None, 0, 0, hashlib.sha256()
    out: list[tuple] = []
    for batch in batches:
        for at, first, count, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != name:
                if name is not None:
                    out.append((conv, n, sha.hexdigest()))
                name, conv, n, sha = at, first, 0, hashlib.sha256()
            sha.update((b"," if n else b"") + ids.encode())
            n += count
        if len(out) > 10_000:
            yield _told(out)
            out = []
    if name is not None:
        yield _told([*out, (conv, n, sha.hexdigest())])


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string()])], names=["conv_id", "n", "ends"])


def paths(rebuilt_turns: DataFrame) -> DataFrame:
    """conv_id, n, ends, path, words, one row for each different path: the smallest
    conversation that has it, how many have it, and the hash of their ids.

    The ids are sorted by range, so that a path that very many conversations have is
    spread; only the hash itself, which takes its ids in order, runs in one task a path.
    """
    spark = rebuilt_turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rebuilt_turns.select(F.md5("path").alias("name"), "conv_id")
    runs = named.repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    chunks = runs.mapInArrow(_chunks, "name string, first bigint, n bigint, ids string")
    ends = chunks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digest, "conv_id bigint, n bigint, ends string")
    return rebuilt_turns.join(ends, "conv_id")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // DIGEST
    x, y = np.frombuffer(a, "uint8", size), np.frombuffer(b, "uint8", size)
    return int(np.argmax(x != y)) // DIGEST


def _keys(path: bytes) -> list[bytes]:
    """A name for each node on a path, the root's first."""
    sha, out = hashlib.md5(), []
    out.append(sha.digest())
    for at in range(0, len(path), DIGEST):
        sha.update(path[at:at + DIGEST])
        out.append(sha.copy().digest())
    return out


def encode(shard: int, path: list[bytes], words: list, conv: np.ndarray, n: np.ndarray, ends: list[str]) -> pa.Table:
    """The nodes of a shard from its sorted, different paths. Nodes on a spine have of n_children,
    n_leaves and saved_tokens what hangs below them beside the spines."""
    shared = [-1, *(_common(a, b) for a, b in zip(path, path[1:]))]
    sizes = np.array([len(p) // DIGEST for p in path])
    shared = np.array(shared)
    count = sizes - shared  # new nodes of each path; the first brings the root
    of = np.repeat(np.arange(len(path)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    depth = shared[of] + 1 + place
    tree = Parens.of_depths(depth)
    opened = tree.select()
    closed = tree.findclose(opened)
    above = parents(depth)
    first, stop = np.arange(len(depth)), np.arange(len(depth)) + (closed - opened + 1) // 2
    ending = np.cumsum(count) - 1  # a path's end is the last of its new nodes
    def whole(values):  # sums over subtrees of a value of each node
        total = np.concatenate([[0], np.cumsum(values)])
        return total[stop] - total[first]

    at_end, conv_at, ends_at = np.zeros(len(depth), "int64"), np.full(len(depth), 2**63 - 1), np.full(len(depth), NO_ENDS, object)
    at_end[ending], conv_at[ending], ends_at[ending] = n, conv, ends
    convs, least = whole(at_end), range_min(conv_at, first, stop)
    each = np.concatenate([np.zeros(1, "int64"), *(np.asarray(w, "int64")[max(s, 0):] for w, s in zip(words, shared))])
    on_first, on_last = np.zeros(len(depth), bool), np.zeros(len(depth), bool)
    on_first[:sizes[0] + 1] = True
    node = len(depth) - 1
    while node >= 0:
        on_last[node] = True
        node = above[node]
    spine = on_first | on_last
    saving = whole(np.where(spine, 0, (convs - 1) * each))
    leaves = tree.leaf_rank[closed] - tree.leaf_rank[opened]
    inner = ~spine & (above >= 0)
    children = np.bincount(above[inner], minlength=len(depth))
    hang = inner & spine[above]
    for values in (saving, leaves):
        below = np.zeros(len(depth), "int64")
        np.add.at(below, above[hang], values[hang])
        values[spine] = below[spine]
    named = np.full(len(depth), None, object)
    named[on_first] = _keys(path[0])
    named[on_last] = _keys(path[-1])
    over = np.where(above >= 0, named[above], None)
    known = (above >= 0) & ~spine & ~spine[above]
    return pa.Table.from_arrays([
        pa.array(np.full(len(depth), shard)), pa.array(spine), pa.array(on_first), pa.array(on_last), pa.array(named, pa.binary()),
        pa.array(np.where(known, None, over), pa.binary()), pa.array(least), pa.array(depth.astype("int64")),
        pa.array(np.where(known, least[above], 0), mask=~known), pa.array(convs), pa.array(each), pa.array(children.astype("int64")),
        pa.array(leaves.astype("int64")), pa.array(saving.astype("int64")), pa.array(ends_at, pa.string()),
    ], schema=_SCHEMA)


def merge(table: pa.Table, last: bool) -> pa.Table:
    """Nodes on the spines of adjacent shards, each once. Those on the first spine of the
    first shard and on the last of the last stay spines, unless this is the `last` merge."""
    column = {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names if c not in ("parent_key", "parent_conv_id")}
    names, code = np.unique(np.array([k.hex() for k in column["key"]]), return_inverse=True)
    row = np.zeros(len(names), "int64")
    row[code] = np.arange(len(code))
    place = {k: i for i, k in enumerate(names.tolist())}
    over = [None if k is None else k.hex() for k in table.column("parent_key").take(pa.array(row)).to_pylist()]
    above = np.array([-1 if k is None else place[k] for k in over])
    depth, words = column["depth"][row], column["words"][row]
    ends = np.full(len(names), NO_ENDS, object)
    told = column["ends_sha256"] != NO_ENDS
    ends[code[told]] = column["ends_sha256"][told]
    least = np.full(len(names), 2**63 - 1)
    np.minimum.at(least, code, column["conv_id"])
    sums = {}
    for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
        sums[c] = np.zeros(len(names), "int64")
        np.add.at(sums[c], code, column[c])
    on_first, on_last = np.zeros(len(names), bool), np.zeros(len(names), bool)
    shard = column["shard"]
    on_first[code[column["on_first"] & (shard == shard.min())]] = not last
    on_last[code[column["on_last"] & (shard == shard.max())]] = not last
    spine = on_first | on_last
    for level in np.unique(depth)[::-1]:
        here = np.flatnonzero((depth == level) & ~spine)
        sums["n_leaves"][here] += sums["n_children"][here] == 0
        sums["saved_tokens"][here] += (sums["n_convs"][here] - 1) * words[here]
        here = here[above[here] >= 0]
        np.add.at(sums["n_children"], above[here], 1)
        for c in ("n_leaves", "saved_tokens"):
            np.add.at(sums[c], above[here], sums[c][here])
    known = (above >= 0) & ~spine & ~spine[above]
    return pa.Table.from_arrays([
        pa.array(np.full(len(names), shard.min())), pa.array(spine), pa.array(on_first), pa.array(on_last),
        pa.array([bytes.fromhex(k) for k in names.tolist()], pa.binary()),
        pa.array([None if k is None or s else bytes.fromhex(k) for k, s in zip(over, known)], pa.binary()),
        pa.array(least), pa.array(depth), pa.array(np.where(known, least[above], 0), mask=~known), pa.array(sums["n_convs"]),
        pa.array(words), pa.array(sums["n_children"]), pa.array(sums["n_leaves"]), pa.array(sums["saved_tokens"]), pa.array(ends, pa.string()),
    ], schema=_SCHEMA)


def merge_some(table: pa.Table) -> pa.Table:
    return merge(table, False)


def merge_last(table: pa.Table) -> pa.Table:
    return merge(table, True)


def conversation_trie(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (RESULT's columns).

    `conversations` has conv_id, turn, role, text; other columns are left out. Turns go by
    turn, null first, then by the MD5 of role and text, so that repeated rows are turns of
    their own. Conversation c is rebuilt as the first h turns of conversation c - c % 20
    (the remainder has c's sign) and its own turns behind its first h, h = crc32(c) % 4. Null
    role or text is empty; rows without conv_id belong to no conversation. Texts enter as
    digests, so that their length matters to the scan only. No conversations, no nodes.

    A conversation is one row of about 60 bytes for each of its turns; conversations of more
    than some ten million turns are beyond it. `fan` shards are merged by a task.
    """
    whole = saved(rebuilt(conversations.select("conv_id", "turn", "role", "text")), "rebuilt")
    spark = whole.sparkSession
    turns = whole.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if read:
            t = pa.Table.from_batches(read)
            conv, n = (t.column(c).to_numpy() for c in ("conv_id", "n"))
            found = encode(
                TaskContext.get().partitionId(), t.column("path").to_pylist(), t.column("words").to_pylist(), conv, n, t.column("ends").to_pylist()
            )
            yield from found.to_batches(10_000)

    sorted_paths = paths(whole).repartitionByRange(shards, "path").sortWithinPartitions("path")
    nodes = [saved(sorted_paths.select("conv_id", "n", "ends", "path", "words").mapInArrow(shard, NODE), "trie")]
    while True:
        last = shards <= fan
        spines = nodes[-1].filter("spine")
        part = F.lit(0) if last else F.floor(F.col("shard") / fan)
        merged = spines.groupBy(part.alias("part")).applyInArrow(merge_last if last else merge_some, NODE)
        nodes.append(saved(merged.withColumn("shard", F.floor(F.col("shard") / fan)), "spines"))
        if last:
            break
        shards = -(-shards // fan)
    upper = nodes[1]
    for more in nodes[2:]:
        upper = upper.unionByName(more)
    names = upper.filter("NOT spine").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv"))
    found = nodes[0].unionByName(upper).filter("NOT spine").drop("key")
    linked = found.join(names, "parent_key", "left")
    return linked.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_conv")).select(RESULT)
