"""op8 against a version of sets of n-grams, one pair of texts at a time."""

import re
import struct
import zlib
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from docketry.llm import langid
from docketry.llm.queries import op8_language_id

SF = "/root/testdata/sf0.001"


def grams(text):
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    out = set()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i:i + n], "big")
            out.add(((code + (n << 24)) * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
    return out


def kernel(a, b):
    return len(a & b) / (max(len(a), 1) * max(len(b), 1)) ** 0.5


def order(row):
    doc_id, text, _ = row
    seed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    h = xxhash.xxh64_intdigest(text.encode(), seed=seed)
    return h - (1 << 64) if h >> 63 else h


def has_letter(text):
    return re.search(r"[^\W\d_]", text or "") is not None


def plain(rows):
    """(language, score) of each row, in order."""
    known = [r for r in rows if r[0] is not None and r[2] and has_letter(r[1]) and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sample = []
    for lang, group in groupby(sorted(known, key=lambda r: r[2]), lambda r: r[2]):
        ranked = sorted(group, key=order)
        assert len(ranked) <= langid.SAMPLE
        sample += [(lang, at, grams(r[1])) for at, r in enumerate(ranked)]
    languages = sorted({s[0] for s in sample})
    marks = [g for _, at, g in sample if at < langid.LANDMARKS]
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    kept = values > 1e-6 * values.max()
    features = np.array([[kernel(g, b) for b in marks] for _, _, g in sample]) @ vectors[:, kept] / np.sqrt(values[kept])
    targets = np.array([[1.0 if s[0] == x else -1.0 for x in languages] for s in sample])
    gram = features.T @ features + langid.RIDGE * len(features) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ targets)
    out = []
    for _, text, _ in rows:
        if not has_letter(text):
            out.append(("und", 0.0))
            continue
        g = grams(text)
        margin = langid.SHARPNESS * (np.array([kernel(g, b) for b in marks]) @ vectors[:, kept] / np.sqrt(values[kept]) @ solved)
        share = np.exp(margin - margin.max())
        share /= share.sum()
        out.append((languages[int(share.argmax())], float(share.max())))
    return out


def agree(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_query_equals_plain_version(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    got = {r.doc_id: (r.lang_pred, r.score) for r in op8_language_id(spark, SF).collect()}
    agree([got[r[0]] for r in rows], plain(rows))


def test_odd_rows(spark):
    said = {"en": "the cat and the dog of the house", "es": "el gato y el perro de la casa"}
    rows = [(i, f"{said[x]} {i}", x) for i in range(40) for x in ("en" if i % 2 else "es",)]
    rows += [
        (50, None, "en"), (51, "", "en"), (52, "12 !?", None), (53, "x" * 300_000, None), (54, "the " * 100_000 + "\U0001d11e", None),
        (55, "the cat", ""), (55, "the cat", ""), (None, "el perro", "en"), (56, "\u00c9", None), (57, "zzqj", None), (58, "a", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("found", F.lit(1)).coalesce(1)
    model = langid.fit(docs)
    got = docs.select(langid.language_column(F.col("text"), model, docs).alias("p")).select("p.*").collect()
    agree([tuple(r) for r in got], plain(rows))
    assert got[45] == got[46] and got[40].lang_pred == got[41].lang_pred == got[42].lang_pred == "und"


def test_sizes_count_bins_outside_of_landmarks():
    position = np.full(langid.BINS, -1, "int32")
    some = sorted(grams("abc"))
    position[some] = np.arange(len(some))
    texts = ["abcabc", "", "zq abc", "q" * 9, "abc"]
    (rows, sizes), = langid.presence(pa.array(texts), position, len(some))
    assert sizes.tolist() == [len(grams(t)) for t in texts]
    assert rows.sum(axis=1).tolist() == [len(grams(t) & set(some)) for t in texts]
