"""Language of a text by string kernels.

The kernel is the blended spectrum of one to three bytes: two texts are alike by the n-grams
that are present in both, over the root of the product of what each has. A bounded sample
of texts of known language gives landmarks; kernel values to the landmarks, whitened by
the landmarks' own kernel (Nystroem), are features of a ridge regression for each language
against the rest. A batch of texts is a presence matrix; scoring it is two matrix products.

N-grams are hashed to bins. Only bins of landmarks can be shared with one, but all bins of
a text count as what it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.batches import as_texts, slices
from docketry.llm.toxicity import in_fold

UNKNOWN = "und"
#: Bounds of the fit, for each language: texts learned from, and landmarks among them.
SAMPLE, LANDMARKS = 400, 24
SPARE = 4
GRAMS, BINS = 3, 1 << 15
RIDGE, SHARPNESS = 1e-2, 6.0
SLICE = 1 << 20

#: ASCII that is no letter is a blank; other bytes stay.
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], "uint8")


def gram_bins(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """For each slice of texts: its rows, and for each n the bins of all n-grams, with the row of each byte."""
    for start, stop in slices(texts, SLICE):
        low = pc.cast(pc.utf8_lower(texts.slice(start, stop - start)), pa.binary())
        sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype("int64")
        raw = _LETTERS[np.frombuffer(b"".join(low.to_pylist()), "uint8")].astype("uint32")
        row = np.repeat(np.arange(stop - start, dtype="int32"), sizes)
        found, code = [], raw
        for n in range(1, GRAMS + 1):
            if n > 1:
                code = code[:-1] << np.uint32(8) | raw[n - 1:] if len(code) > 1 else code[:0]
            mixed = (code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
            found.append((mixed >> np.uint32(17)).astype("int32"))
        yield start, stop, found, row


def presence(texts: pa.Array, position: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """0/1 matrix of the bins that `position` names (-1: none), and how many bins each text has
    in all, slice by slice."""
    for start, stop, found, row in gram_bins(texts):
        out = np.zeros((stop - start) * width, "bool")
        others = []
        for n, bins in enumerate(found):
            rows = row[:len(bins)].astype("int64")
            if n:  # not across the edge of two texts
                within = rows == row[n:]
                rows, bins = rows[within], bins[within]
            at = position[bins]
            inside = at >= 0
            out[rows[inside] * width + at[inside]] = True
            others.append(rows[~inside] * BINS + bins[~inside])
        matrix = out.reshape(stop - start, width)
        sizes = np.bincount(np.unique(np.concatenate(others)) // BINS, minlength=stop - start) + np.count_nonzero(matrix, axis=1)
        yield matrix.astype("float32"), sizes


@dataclass
class Model:
    """Bounded by LANDMARKS and BINS for each language."""

    languages: list[str]
    position: np.ndarray
    landmarks: np.ndarray  # presence rows
    weights: np.ndarray  # kernel values to one score per language

    def kernel(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """From presence in the bins of landmarks, and the numbers of all bins of the texts."""
        own = np.maximum(self.landmarks.sum(axis=1, dtype="float64"), 1)
        return rows @ self.landmarks.T / np.sqrt(np.maximum(sizes, 1)[:, None] * own)

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row and its share; of equal shares the first language."""
        margins = SHARPNESS * (self.kernel(rows, sizes) @ self.weights)
        shares = np.exp(margins - margins.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        return best, shares[np.arange(len(rows)), best]


def build(languages: list[str], landmarks: np.ndarray, samples: np.ndarray, known: np.ndarray) -> Model:
    """From 0/1 rows over all bins: landmarks, and samples with the position of their language."""
    used = np.flatnonzero(landmarks.any(axis=0))
    position = np.full(BINS, -1, "int32")
    position[used] = np.arange(len(used))
    model = Model(languages, position, landmarks[:, used].astype("float32"), np.zeros((len(landmarks), len(languages))))
    # Nystroem features: kernel to the landmarks times the inverse root of theirs.
    values, vectors = np.linalg.eigh(model.kernel(model.landmarks, landmarks.sum(axis=1)))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = model.kernel(samples[:, used].astype("float32"), samples.sum(axis=1)) @ whiten
    targets = np.where(known[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = features.T @ features + RIDGE * len(features) * np.eye(features.shape[1])
    model.weights = whiten @ np.linalg.solve(gram, features.T @ targets)
    return model


def fit(documents: DataFrame, held_out: tuple[int, int] = (4, 2)) -> Model | None:
    """A model from text and lang of `documents` outside of the held-out fold; None without any.

    SAMPLE texts of each language, by the hash of id and text, are learned from: whole texts,
    as bits of their bins. Null or empty langs, null ids and texts without a letter are no samples.
    """
    usable = documents.select("doc_id", "lang", "text").filter(
        "lang IS NOT NULL AND lang <> '' AND text IS NOT NULL AND doc_id IS NOT NULL"
    ).filter(~in_fold(F.col("doc_id"), *held_out) & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    # Of a language with many texts only hashes below a bound are ranked, about SPARE times
    # SAMPLE rows however many there are; so no task gathers a language.
    hashed = F.xxhash64("doc_id", "text")
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], -(2.0**63) + 2.0**64 * min(1.0, SPARE * SAMPLE / r["count"]))])
    ranked = Window.partitionBy("lang").orderBy(hashed, "doc_id", "text")
    known = usable.filter(hashed <= F.element_at(bounds, F.col("lang")))
    sample = known.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= SAMPLE)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[bytes] = []
            for rows, _ in presence(as_texts(batch.column(2)), np.arange(BINS, dtype="int32"), BINS):
                packed += [r.tobytes() for r in np.packbits(rows > 0, axis=1)]
            yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "rank": batch.column(1), "bits": pa.array(packed, pa.binary())})

    rows = sorted(sample.select("lang", "rank", "text").mapInArrow(bits, "lang string, rank int, bits binary").collect())
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    matrix = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), "uint8").reshape(len(rows), -1), axis=1)
    at = np.array([languages.index(r["lang"]) for r in rows])
    first = np.array([r["rank"] <= LANDMARKS for r in rows])
    return build(languages, matrix[first], matrix, at)


PREDICTED = "struct<lang_pred: string, score: double>"


def language_column(text: Column, model: Model | None, documents: DataFrame) -> Column:
    """lang_pred and score of a whole text; `und` with score 0 where it is null or has no letter.

    Equal texts, so repeated rows too, get equal results; no rows give none.
    """
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        texts = as_texts(texts)
        best, share = [np.zeros(0, "int64")], [np.zeros(0)]
        for rows, sizes in presence(texts, model.position, model.landmarks.shape[1]):
            b, s = model.score(rows, sizes)
            best.append(b)
            share.append(s)
        letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        names = np.where(letters, np.array(model.languages, object)[np.concatenate(best)], UNKNOWN)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(letters, np.concatenate(share), 0.0))], names=["lang_pred", "score"]
        )

    return F.arrow_udf(predict, PREDICTED)(text)
