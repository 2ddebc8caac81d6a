"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces whose lengths are the powers of two that n is made
of, longest first, those above `limit` as several pieces of `limit`. Pieces of equal
length form a bucket (column `bucket`, the length's exponent): a training batch is drawn
from one bucket and needs no padding, and no sequence holds tokens of two documents. Each
piece is a sequence of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.batches import give_back
from docketry.llm.bpe import encoder

LIMIT = 4096
END_OF_DOCUMENT = 2
#: Pieces gathered into one batch of output.
OUT_TOKENS = 1 << 17


def lengths(n: int, limit: int = LIMIT) -> list[int]:
    """The powers of two that make up `n`, longest first."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in reversed(range(limit.bit_length())) if rest >> b & 1]


def pack(
    documents: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    end: int = END_OF_DOCUMENT,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    bucket, ids (unless left out).

    A null or empty text is the end token alone; rows with equal or null ids are packed
    each for itself; other columns of `documents` are not carried on; no rows give no rows.
    Sequence ids are unique, not gapless: they come from the place of a row in its
    partition, so that nothing has to be shuffled or counted.
    """
    bits = {1 << b: b for b in range(limit.bit_length())}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the worker holds of earlier stages, before the vocabulary is read
        coder = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            parts: list[np.ndarray] = []
            held = 0
            names = batch.column(0).to_pylist()
            for name, found in zip(names, coder.rows(batch.column(1))):
                ids = np.concatenate([*found, np.array([end], "<u4")]).astype("<u4")
                start = 0
                for size in lengths(len(ids), limit):
                    piece = ids[start:start + size]
                    rows.append((name, start, size, bits[size], zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        parts.append(piece)
                    held += size
                    start += size
                if held >= OUT_TOKENS:
                    yield _batch(rows, parts, with_ids)
                    rows, parts, held = [], [], 0
            if rows:
                yield _batch(rows, parts, with_ids)

    kind = "doc_id bigint, start bigint, length bigint, bucket int, ids_crc32 bigint, doc_tokens bigint"
    pieces = documents.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(
        cut, kind + (", ids array<int>" if with_ids else "")
    )
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        "bucket", *(["ids"] if with_ids else []),
    )


def _batch(rows: list[tuple], parts: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    name, start, size, bucket, crc, total = zip(*rows)
    columns = {
        "doc_id": pa.array(name, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()),
        "bucket": pa.array(bucket, pa.int32()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
    }
    if with_ids:
        ends = np.concatenate([[0], np.cumsum(size)]).astype("int32")
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype("int32")))
    return pa.RecordBatch.from_pydict(columns)
