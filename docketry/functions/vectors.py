"""Text vectors and cosine scores.

Vectors are `array<float>` columns. The numeric work runs as Arrow UDFs on whole batches:
a NumPy product over a batch is several times faster than an `aggregate(zip_with(...))`
expression, which Spark interprets element by element.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.batches import slices

VECTOR = T.ArrayType(T.FloatType())
DEFAULT_DIM = 384
# Scores are rounded so that equal vectors tie and the key decides, whatever the
# order in which a batch was summed.
SCORE_DIGITS = 9
# A word is a run of these.
WORD_LETTER = r"[\p{L}\p{N}]"
_ASCII_LETTERS = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


def to_matrix(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list array as float64, and the positions of rows that are `dim` long.

    A null, short, long or part-null vector has no row.
    """
    fits = pc.fill_null(pc.equal(pc.list_value_length(values), dim), False)
    kept = values.filter(fits)
    matrix = pc.cast(kept.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    whole = ~np.isnan(matrix).any(axis=1)
    return matrix[whole], rows[whole]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def cosine_matrix(matrix: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of every row with every query row; 0 where one of them is zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    query_norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    scale = np.outer(norms, query_norms)
    scale[scale == 0] = 1.0
    return np.round(matrix @ queries.T / scale, SCORE_DIGITS)


def cosine_pairs(matrix: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query row at the same place; 0 where one of them is zero."""
    scale = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * np.sqrt(np.einsum("ij,ij->i", queries, queries))
    scale[scale == 0] = 1.0
    return np.round(np.einsum("ij,ij->i", matrix, queries) / scale, SCORE_DIGITS)


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column with one fixed vector; null where lengths differ."""
    fixed = np.asarray(query, dtype="float64").reshape(1, -1)

    def score(values: pa.Array) -> pa.Array:
        matrix, rows = to_matrix(values, fixed.shape[1])
        out = np.full(len(values), np.nan)
        out[rows] = cosine_matrix(matrix, fixed)[:, 0]
        return pa.array(out, from_pandas=True)

    # Declared non-deterministic only to keep a filter on the score from being pushed
    # down, which would compute every score twice.
    return F.arrow_udf(score, T.DoubleType()).asNondeterministic()(vector)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns of the same row, as a plain expression."""
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    similarity = F.coalesce(
        F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)
    )
    return F.when(F.size(a) == F.size(b), F.round(similarity, SCORE_DIGITS))


def words_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in order, with the row of each.

    Their places are found on the bytes of all texts at once; of the letters outside ASCII
    each distinct one is looked up.
    """
    offsets = np.frombuffer(texts.buffers()[1], "int32")[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.empty(0, "int64"), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], "uint8")[: offsets[-1]]
    inside = _ASCII_LETTERS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype("int32")
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        codes, which = np.unique(code, return_inverse=True)
        letters = pc.match_substring_regex(pa.array(list(map(chr, codes.tolist()))), WORD_LETTER).to_numpy(zero_copy_only=False)[which]
        for k in range(4):
            inside[lead[size > k] + k] = letters[size > k]
    inside[: offsets[0]] = False
    # Words end at the ends of texts too.
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    bounds = offsets[(offsets > offsets[0]) & (offsets < offsets[-1])]
    begins[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    starts = np.flatnonzero(begins)
    cuts = np.empty(2 * len(starts), "int32")
    cuts[0::2], cuts[1::2] = starts, np.flatnonzero(ends) + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    if not len(starts):
        return row, pa.array([], pa.string())
    # Words and what is between them, by turns.
    parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), texts.buffers()[2])
    return row, parts.take(pa.array(np.arange(0, len(cuts), 2)))


class HashingEmbedder:
    """Counts of words, each word put in the dimension its md5 names.

    Stands in where no trained model is at hand: it keeps word overlap, not meaning.
    """

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim

    def _buckets(self, words: pa.Array) -> np.ndarray:
        digests = b"".join(hashlib.md5(w).digest()[:4] for w in words.cast(pa.binary()).to_pylist())
        return np.frombuffer(digests, ">u4").astype("int64") % self.dim

    def _count(self, texts: pa.Array) -> np.ndarray:
        lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.string()))
        row, words = words_of(lowered)
        # Each distinct word of the batch is hashed once.
        coded = words.dictionary_encode()
        bucket = self._buckets(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(row * self.dim + bucket, minlength=len(texts) * self.dim)
        return counts.reshape(len(texts), self.dim).astype("float32")

    def _by_slices(self, texts: pa.Array) -> np.ndarray:
        """Counts of a whole batch; words are held for a slice of its texts at a time."""
        counts = np.empty((len(texts), self.dim), "float32")
        for start, stop in slices(texts):
            counts[start:stop] = self._count(texts.slice(start, stop - start))
        return counts

    def column(self, text: Column) -> Column:
        def embed(texts: pa.Array) -> pa.Array:
            counts = self._by_slices(texts)
            offsets = pa.array(np.arange(len(texts) + 1, dtype="int32") * self.dim)
            return pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()))

        return F.arrow_udf(embed, VECTOR)(text)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return self._count(pa.array(list(texts), pa.string())).astype("float64")


class BatchEmbedder:
    """Any model of the caller's: `load()` gives a function from texts to a matrix.

    `load` is called once per Python worker, not once per batch.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int):
        self.load = load
        self.dim = dim

    def column(self, text: Column) -> Column:
        load = self.load

        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in batches:
                matrix = np.asarray(encode(texts.fillna("").tolist()), dtype="float32")
                yield pd.Series(list(matrix))

        return F.pandas_udf(embed, VECTOR)(text)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return np.asarray(self.load()(list(texts)), dtype="float64")
