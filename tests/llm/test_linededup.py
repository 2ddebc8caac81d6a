import hashlib

import numpy as np
import pytest

from docketry.llm import linededup
from docketry.llm.linededup import LineIndex, PerfectHash, dedup_lines
from docketry.llm.oracle import llm_oracles
from docketry.llm.queries import llm_queries
from tests.compare import connect, differences

LONG = "This very line stands in several documents, "
SCHEMA = "doc_id bigint, text string, kept string, id string, n bigint"


def documents(rows):
    return [(i, t, "other", "other", 7) for i, t in rows]


CASES = documents(
    [(i, f"own line {i}\n  {LONG}A \t\nlast") for i in range(8)]
    + [(9, f"{LONG}a\n{LONG}A\n\n"), (9, f"{LONG}a\nmore"), (20, None), (21, ""), (22, "\n\n"), (None, f"x\n{LONG}a"), (None, f"{LONG}a")]
    + [(30 + i, f"{LONG}four") for i in range(4)]  # one too few
    + [(40 + i, "é" * 39 + "\n" + "é" * 40 + " ") for i in range(6)]
    + [(50, f"{LONG}tie")] * 5 + [(60, f"{LONG}b\r\n{LONG}b"), *[(61 + i, f"\x0b{LONG}B\x0c") for i in range(5)]]
    + [(70, "\n".join(f"{LONG}{k % 3}" for k in range(40_000))), *[(71 + i, "\n".join(f"{LONG}{k}" for k in range(3))) for i in range(5)]]
)


def by_hand(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    holds: dict = {}
    for at, (i, text, *_) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holds.setdefault(k, []).append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holds.items() if len(ids) >= 5}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    rows = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in frame.collect()]
    return sorted(rows, key=str)


@pytest.mark.parametrize("heavy", [1, 4096, 10**9])
def test_equals_brute_force(spark, monkeypatch, heavy):
    """Whether lines go through the shards or through what each task holds."""
    monkeypatch.setattr(linededup, "HEAVY", heavy)
    assert found(dedup_lines(spark.createDataFrame(CASES, SCHEMA))) == by_hand(CASES)


def test_equals_sql_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(CASES, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    name = "op13_line_dedup"
    n, problems = differences(spark, connect(str(tmp_path)), llm_queries()[name], llm_oracles()[name], str(tmp_path))
    assert n == len(CASES) and not problems, problems


def test_no_rows(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_lines(spark):
    rng = np.random.default_rng(5)
    lines = [f"{LONG}{k}" for k in range(60)] + ["short", ""]
    rows = documents((int(i) if i % 13 else None, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in rng.integers(0, 150, 250))
    assert found(dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(6))) == by_hand(rows)


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_perfect_hash(n):
    digests = np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype("uint64")
    assert sorted(PerfectHash.of(digests)(digests).tolist()) == list(range(n))
    index = LineIndex.unpacked(*LineIndex.of(digests, np.ones(n, "int64"), np.arange(n)).packed())
    here, keeper = index.probe(digests)
    assert here.all() and keeper.tolist() == list(range(n))
    assert not index.probe(digests + np.uint64(1))[0].any()
