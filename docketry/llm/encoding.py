"""Encoding and decoding of document texts as columns (the transducer is in bpe.py)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.llm.bpe import Joiner, Reader, encoder

DIGEST = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def encode_column(text: Column, tokenizer: str) -> Column:
    """Token ids of a text as `array<int>`; a null or empty text has none."""

    def ids(texts: pa.Array) -> pa.Array:
        rows = [np.concatenate([*found, np.zeros(0, "<u4")]) for found in encoder(tokenizer).rows(texts)]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("int32")
        flat = np.concatenate([*rows, np.zeros(0, "<u4")]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return F.arrow_udf(ids, "array<int>")(text)


def decode_column(ids: Column, tokenizer: str, readable: bool = False) -> Column:
    """Text of token ids: as the library decodes, or `readable` (word ends as blanks).

    Null ids give null, no ids empty text.
    """

    def texts(values: pa.Array) -> pa.Array:
        coder = encoder(tokenizer)
        out = []
        for row in values:
            if not row.is_valid:
                out.append(None)
                continue
            found = row.values.to_numpy(zero_copy_only=False).astype("<u4")
            out.append(Reader(coder).feed(found, final=True) if readable else Joiner(coder).feed(found))
        return pa.array(out, pa.string())

    return F.arrow_udf(texts, "string")(ids)


def digest_column(text: Column, tokenizer: str) -> Column:
    """Count and hash of a text's ids, and hash of what they decode to.

    Ids stay in the worker: they are hashed, decoded and dropped portion by portion, so a
    text of any length needs the memory of one portion.
    """

    def digest(texts: pa.Array) -> pa.Array:
        coder = encoder(tokenizer)
        counts, hashes, decoded = [], [], []
        for found in coder.rows(texts):
            n, of_ids, of_text, joiner = 0, hashlib.sha256(), hashlib.sha256(), Joiner(coder)
            for ids in found:
                n += len(ids)
                of_ids.update(ids.tobytes())
                of_text.update(joiner.feed(ids).encode())
            counts.append(n)
            hashes.append(of_ids.hexdigest())
            decoded.append(of_text.hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return F.arrow_udf(digest, DIGEST)(text)
