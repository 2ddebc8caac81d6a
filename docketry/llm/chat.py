"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, its turns' places are noted while it is rendered, the
whole is encoded once with offsets, and each token gets its mask by looking its span up
among the sorted spans of the turns by binary search.

Rendered form: `begin`, then per turn `opening role \\n text closing`. Control strings
inside roles and texts are broken up reversibly: a backslash follows their first
character, and every backslash is doubled. So no text can end a turn or open another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    opening: str = "[INST]"
    closing: str = "[/INST]</s>"
    #: Never left whole inside a role or text; marks of other common templates too.
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|", "|>", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for mark in self.control:
            text = text.replace(mark, mark[0] + "\\" + mark[1:])
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def role(self, role: str) -> str:
        """A role is one line: its line breaks are written as a backslash and the break."""
        return self.escape(role).replace("\n", "\\\n")

    def render(self, turns: Sequence[tuple[str, str]]) -> tuple[str, list[int], list[int], list[bool]]:
        """The conversation, where each turn's text starts and ends in it, and which are trained on."""
        parts, at = [self.begin], len(self.begin)
        starts, ends, trained = [], [], []
        for role, text in turns:
            head, body = f"{self.opening}{self.role(role)}\n", self.escape(text)
            starts.append(at + len(head))
            ends.append(starts[-1] + len(body))
            trained.append(role in self.trained)
            parts += [head, body, self.closing]
            at = ends[-1] + len(self.closing)
        return "".join(parts), starts, ends, trained

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns back from the rendered form alone."""
        turns = []
        for part in formatted[len(self.begin):].split(self.closing)[:-1]:
            role, text = re.match(r"((?:\\.|[^\\\n])*)\n(.*)\Z", part[len(self.opening):], re.DOTALL).groups()
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


def token_mask(
    starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens overlap a span, and the overlap's start and end. Spans are sorted and apart."""
    if not len(span_starts) or not len(starts):
        none = np.zeros(len(starts), "int64")
        return none.astype(bool), none, none
    at = np.searchsorted(span_ends, starts, side="right")  # the first span that ends after the token's start
    there = np.minimum(at, len(span_starts) - 1)
    low = np.maximum(starts, span_starts[there])
    high = np.minimum(ends, span_ends[there])
    return (at < len(span_starts)) & (low < high), low, high


@lru_cache(maxsize=4)
def offset_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # control strings of the tokenizer are text here
    return tokenizer


FORMATTED = (
    "conv_id bigint, n_turns bigint, formatted string, ids array<int>, loss_mask array<boolean>, "
    "loss_starts array<int>, loss_ends array<int>"
)


def format_conversations(
    turns: DataFrame,
    tokenizer: str,
    template: Template = Template(),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its rendered form, ids of a byte-level tokenizer, the mask
    of tokens to train on, and the runs of characters under the mask (start, end).

    Tokens that share a character, as the bytes of one letter may, share its mask; a token
    that reaches over a turn's edge counts, with the characters inside only.

    Turns go by `turn`, ties by role and text; repeated rows are turns of their own. A null
    role or text is empty, a null turn comes first, rows of a null id are one conversation.
    An empty text has no characters under the mask. Other columns are left out; no rows give
    no rows. A conversation is one output row, so it is rendered by one task.
    """
    whole = (
        turns.select(
            F.col(conv_id).cast("bigint").alias("conv_id"),
            F.struct(
                F.col(turn).alias("turn"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            ).alias("row"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select("conv_id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    )

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = offset_tokenizer(tokenizer)
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = batch.slice(i, 256)
                yield _formatted(coder, template, rows)

    return whole.mapInArrow(shape, FORMATTED)


def _formatted(coder, template: Template, rows: pa.RecordBatch) -> pa.RecordBatch:
    rendered = [
        template.render([*zip(roles, texts)])
        for roles, texts in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())
    ]
    masks, runs_from, runs_to, ids = [], [], [], []
    for found, (_, starts, ends, trained) in zip(
        coder.encode_batch([r[0] for r in rendered], add_special_tokens=False), rendered
    ):
        offsets = np.array(found.offsets, "int64").reshape(-1, 2)
        here = np.array(trained, bool) & (np.array(ends) > np.array(starts))
        mask, low, high = token_mask(
            offsets[:, 0], offsets[:, 1], np.array(starts, "int64")[here], np.array(ends, "int64")[here]
        )
        low, high = low[mask], high[mask]
        # Tokens inside one letter repeat its offsets; runs are the union of all.
        reach = np.maximum.accumulate(high) if len(high) else high
        new = np.ones(len(low), bool)
        new[1:] = low[1:] > reach[:-1]
        first = np.flatnonzero(new)
        masks.append(mask)
        ids.append(found.ids)
        runs_from.append(low[first])
        runs_to.append(reach[np.append(first[1:] - 1, len(reach) - 1)] if len(first) else high)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0),
            pa.array([len(r[1]) for r in rendered], pa.int64()),
            pa.array([r[0] for r in rendered], pa.string()),
            pa.array(ids, pa.list_(pa.int32())),
            pa.array(masks, pa.list_(pa.bool_())),
            pa.array(runs_from, pa.list_(pa.int32())),
            pa.array(runs_to, pa.list_(pa.int32())),
        ],
        names=["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_starts", "loss_ends"],
    )
