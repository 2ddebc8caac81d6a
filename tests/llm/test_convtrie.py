import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docketry.llm import convtrie
from docketry.llm.convtrie import RESULT, conversation_trie
from docketry.llm.oracle import llm_oracles
from docketry.llm.parens import BLOCK, Parens, parents, range_min
from docketry.llm.queries import llm_queries
from tests.compare import connect, differences

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, key string"


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[:d - 1]].add(path[:d])

    def words(p):
        return len(p[-1][1].encode().split()) if p else 0

    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if whole[c] == p))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below),
            sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(3)
    said = ["a b", "a  b", "", None, " x y", "\x0bz\x1cz", "long " * 3000]
    rows = []
    for c in [*range(-45, 90), 1000, 2**40]:
        for turn in range(rng.randint(1, 5)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(said[:3] if c % 3 else said)))
    rows += [(5, 0, "user", "tie"), (5, 0, "user", "tie"), (5, 0, "assistant", "tie"), (None, 0, "user", "no one")]
    rows += [(2000 + k, t, "user", f"same {t}") for k in range(60) for t in range(4)]
    rows += [(77, t, "user", f"deep {t}") for t in range(300)]
    return [(*r, "d", "k") for r in rows]


def found(frame):
    return sorted((tuple(r[c] for c in RESULT) for r in frame.collect()), key=str)


@pytest.mark.parametrize("fan", [1024, 2, 3])
def test_equals_brute_force(spark, fan):
    """With one merge of all shards, and with several levels of them."""
    rows = odd_rows()
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), fan)) == by_hand(rows)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "SHARD_TURNS", 20)
    rows = [r for r in odd_rows() if r[0] is None or r[0] < 1000]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA), 4)) == by_hand(rows)


def test_equals_sql_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    name = "op12_conversation_trie"
    n, problems = differences(spark, connect(str(tmp_path)), llm_queries()[name], llm_oracles()[name], str(tmp_path))
    assert n and not problems, problems


def test_no_conversations(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "", "")], SCHEMA)).collect() == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    bare = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(bare, 0, "user", "gone", "", "")]
    ends = hashlib.sha256(str(bare).encode()).hexdigest()
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == [(bare, 0, None, 1, 0, 1, 0, ends)]


@pytest.mark.parametrize("n", [1, 2, 40, 1000, 20 * BLOCK])
@pytest.mark.parametrize("deep", [1, 3, 10**6])
def test_parentheses(n, deep):
    rng = random.Random(n * deep)
    depths = [0]
    for _ in range(n - 1):
        depths.append(rng.randint(max(1, depths[-1] - deep), depths[-1] + 1) if rng.random() < 0.5 else depths[-1] + 1)
    depths = np.array(depths)
    tree = Parens.of_depths(depths)
    opened = tree.select()
    closed, stack, want, over = tree.findclose(opened), [], {}, {}
    for at, is_open in enumerate(tree.opens):
        if is_open:
            over[at] = stack[-1] if stack else None
            stack.append(at)
        else:
            want[stack.pop()] = at
    assert not stack and closed.tolist() == [want[a] for a in opened.tolist()]
    assert parents(depths).tolist() == [-1 if over[a] is None else int(tree.rank[over[a]]) for a in opened.tolist()]
    leaves = (tree.leaf_rank[closed] - tree.leaf_rank[opened]).tolist()
    assert leaves == [int(sum(tree.opens[a:b] & ~tree.opens[a + 1:b + 1])) for a, b in zip(opened, closed)]


def test_range_min():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 300)
    starts = rng.integers(0, 300, 500)
    ends = starts + 1 + (rng.random(500) * (300 - starts)).astype(int)
    assert range_min(values, starts, np.minimum(ends, 300)).tolist() == [int(values[a:b].min()) for a, b in zip(starts, np.minimum(ends, 300))]
