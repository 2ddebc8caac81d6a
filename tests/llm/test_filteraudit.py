from itertools import permutations

import pytest

from docketry.llm import filteraudit
from docketry.llm.filteraudit import RadixTrie, adaptive_prefix, audit, repeated_texts
from docketry.llm.oracle import llm_oracles
from docketry.llm.queries import llm_queries
from tests.compare import connect, differences

SCHEMA = "doc_id bigint, text string, lang string, source string, part string, mask int, quality string"
LABELS = "doc_id bigint, quality int, toxic int, part string"
GOOD = " ".join(f"w{i}" for i in range(250))


def odd_rows():
    same = "the same beginning of all of these texts, which is long enough to be told further " * 4
    texts = [
        None, "", "", GOOD, GOOD, GOOD + " #", "A " * 400, GOOD.upper(), GOOD + " ", "a\x1cb " * 300, "é" * 500,
        *[same + str(i % 7) for i in range(40)], *[same] * 30, "x" * 300_000, "x" * 300_000, "x" * 300_001, "W" * 3 + "w" * 97,
    ]
    rows = [(i if i % 11 else None, t, ["en", "fr", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(500, GOOD, "en"), (500, GOOD, "en"), (3, GOOD, "de"), (-4, "W" * 3 + "w" * 97, "de")]
    return [(*r, "s", "p", 1, "q") for r in rows]


LABELLED = [(i, i % 2, (i // 2) % 2, "x") for i in range(0, 60, 2)] + [(3, 1, 0, "x"), (3, 0, 1, "x"), (4, None, 1, "x"), (None, 1, 1, "x"), (500, 1, None, "x")]


def by_hand(rows, labels):
    least: dict = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _, _ in labels if q == 1}
    toxic = {i for i, _, t, _ in labels if t == 1}
    told = []
    for i, t, lang, *_ in rows:
        t = t or ""
        words = t.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        told.append((lang or "", {k for k, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {t[0] for t in told}:
        docs = [t[1:] for t in told if t[0] == part]
        gone = {(o, k): [d for d in docs if not d[0] & set(o[:k]) and o[k] in d[0]] for o in permutations("ABCDE") for k in range(5)}
        share = {f: sum(len(v) for (o, k), v in gone.items() if o[k] == f) for f in "ABCDE"}
        for (o, k), lost in gone.items():
            out.append((
                part, "".join(o), k + 1, sum(not d[0] & set(o[:k + 1]) for d in docs), len(lost),
                sum(bool(d[0] & set(o[:k])) and o[k] in d[0] for d in docs), sum(d[0] == {o[k]} for d in docs),
                sum(d[1] for d in lost), sum(d[2] for d in lost), share[o[k]],
            ))
    return sorted(out)


def test_equals_brute_force(spark):
    rows = odd_rows()
    got = audit(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(LABELLED, LABELS))
    assert sorted(map(tuple, got.collect())) == by_hand(rows, LABELLED)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_equals_sql_on_odd_rows(spark, tmp_path):
    for name, frame in (("documents", spark.createDataFrame(odd_rows(), SCHEMA)), ("labels", spark.createDataFrame(LABELLED, LABELS))):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    name = "op11_filter_audit"
    n, problems = differences(spark, connect(str(tmp_path)), llm_queries()[name], llm_oracles()[name], str(tmp_path))
    assert n == 120 * 5 * 4 and not problems, problems


def test_no_documents(spark):
    assert audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("held", [1, 32 << 20])
def test_repeated_texts(spark, monkeypatch, held):
    monkeypatch.setattr(filteraudit, "RANGE_BYTES", 1000)
    docs = spark.createDataFrame([(i, t or "") for i, t, *_ in odd_rows()], "id bigint, text string").repartition(7)
    want: dict = {}
    for i, t, *_ in odd_rows():
        want.setdefault(t or "", []).append(i)
    least = sorted(min(i for i in ids if i is not None) for ids in want.values() if len(ids) > 1 and any(i is not None for i in ids))
    assert sorted(r.least for r in repeated_texts(docs).collect()) == least


def test_prefixes_grow_until_they_part_the_texts(spark):
    docs = spark.createDataFrame([(t or "",) for _, t, *_ in odd_rows()], "text string")
    got = [r for r in docs.select("text", adaptive_prefix(docs, 200).alias("p")).distinct().collect()]
    assert all(r.text.startswith(r.p) for r in got)
    assert max(len(r.p) for r in got if r.text.startswith("the same")) > 256
    # Ranges of prefixes are ranges of texts.
    by_prefix = sorted(got, key=lambda r: (r.p.encode(), r.text.encode()))
    assert [r.text for r in by_prefix] == sorted((r.text for r in got), key=str.encode)


def test_radix_trie():
    texts = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcabcabc", b"abcabcabd", b"ab", b"", b"abd", b"\xff" * 9, b"\xff" * 9]
    trie = RadixTrie()
    for i, t in enumerate(texts):
        trie.insert(t, 100 - i)
    assert dict(trie.repeated()) == {b"": 91, b"ab": 92, b"abd": 90, b"\xff" * 9: 88}
