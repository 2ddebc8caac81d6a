"""Toxicity from the nearest labelled examples by exact cosine of TF-IDF vectors.

A text's vector has every word of it: count x idf x relevance. Document frequencies are
counted over all documents. The relevance of a term grows with its chi-square between the
labels on a bounded sample of labelled rows and is never zero, so no word is left out of a
vector or of its length; beginnings of words that tell the labels apart are terms too.
Words outside the examples can match none and only lengthen the vector; they share COUNTERS
document counters by hash, so a rare one may take the frequency of words it shares with.
The examples lie in an inverted index: a term's postings are cut by blocks of examples, each
piece with its largest weight. The product of a text's weights with those maxima bounds its
cosine with every example of a block, so only blocks are opened that may hold a nearer
example. Votes of the nearest examples, weighted by cosine and brought back to the labels'
natural shares, are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.batches import as_texts, gather, give_back, slices
from docketry.session import fresh_folder

#: Bound of the fit: examples of each label. Their words are all terms.
EXAMPLES = 4096
#: Least chi-square of a beginning, and documents of the sample that it, or a term of more
#: than the least relevance, must be in.
LEAST_CHI, LEAST_DOCUMENTS = 24.0, 5
#: Relevance of a term without chi-square, and the chi-square that adds 1 to its root.
LEAST_RELEVANCE, UNIT_CHI = 0.0025, 25.0
COUNTERS = 1 << 20
#: Text taken at once: what is held of it is several numbers for each word and each posting.
SLICE = 1 << 20
NEAREST, BLOCK = 25, 64
#: Blocks that are opened first, to tell which others need not be.
FIRST_BLOCKS = (6,)
#: Terms in most examples, whose postings are kept as a matrix, and rows looked up at once.
HEAD, TOGETHER = 256, 64
LEVELS = (1,)
PREFIXES = (4, 5, 6)
BREAKS = r"[^\pL\pN]+"


def _stems(word: str) -> list[str]:
    """The word itself and, marked, its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def counted_words(texts: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of texts: its first and last row, its distinct words, and for each
    pair of a row and a word in it: row, word, count."""
    for start, stop in slices(texts, SLICE):
        words = pc.split_pattern_regex(pc.utf8_lower(texts.slice(start, stop - start)), BREAKS)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(stop - start), lengths)
        word = coded.indices.to_numpy(zero_copy_only=False).astype("int64") if len(row) else row
        pair, count = np.unique(row * max(1, len(coded.dictionary)) + word, return_counts=True)
        size = max(1, len(coded.dictionary))
        yield start, stop, coded.dictionary.to_pylist(), pair // size, pair % size, count


def term_matrix(texts: pa.Array, terms: dict[str, list[tuple[int, int]]], width: int) -> Iterator[np.ndarray]:
    """Presence of given terms as a dense matrix, a row per text, slice by slice; for small checks.

    `terms` has for each stem its (level, position)s.
    """
    texts = as_texts(texts)
    for start, stop in slices(texts):
        lists = pc.split_pattern_regex(pc.utf8_lower(texts.slice(start, stop - start)), BREAKS)
        coded = lists.flatten().dictionary_encode()
        stems = [[s for s in _stems(w) if s in terms] for w in coded.dictionary.to_pylist()]
        used = {s: i for i, s in enumerate(dict.fromkeys(s for found in stems for s in found))}
        out = np.zeros((stop - start, width), "float32")
        if used:
            fan = np.fromiter(map(len, stems), "int64", len(stems))
            flat = np.array([used[s] for found in stems for s in found], "int64")
            word = coded.indices.to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(fan[word] > 0)  # words with a term are few
            row = np.repeat(np.arange(stop - start), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[hit]
            word = word[hit]
            which = flat[gather((np.cumsum(fan) - fan)[word], fan[word])]
            sums = np.bincount(np.repeat(row, fan[word]) * len(used) + which, minlength=len(out) * len(used)).reshape(len(out), -1)
            for s, i in used.items():
                for level, position in terms[s]:
                    out[:, position] = sums[:, i] >= level
        yield out


@dataclass
class Sparse:
    """Rows of (position, value) pairs; row i is at ptr[i]..ptr[i + 1]."""

    ptr: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def take(self, rows: np.ndarray) -> Sparse:
        lengths = np.diff(self.ptr)[rows]
        at = gather(self.ptr[:-1][rows], lengths)
        return Sparse(np.concatenate([[0], np.cumsum(lengths)]), self.place[at], self.value[at])


def sparse(rows: np.ndarray | Sparse) -> Sparse:
    if isinstance(rows, Sparse):
        return rows
    row, place = np.nonzero(rows)
    return Sparse(np.searchsorted(row, np.arange(len(rows) + 1)), place, rows[row, place])


@dataclass
class Terms:
    """Positions of terms: the examples' words, beginnings, then COUNTERS for other words."""

    words: pa.Array
    beginnings: dict[str, int]

    def __post_init__(self) -> None:
        self.width = len(self.words) + len(self.beginnings)
        self._beginning = pa.array([b[:-1] for b in self.beginnings], pa.string()), np.fromiter(self.beginnings.values(), "int64", len(self.beginnings))

    def counts(self, texts: pa.Array) -> Iterator[Sparse]:
        """Count of every word and known beginning of each text, slice by slice."""
        for start, stop, words, row, word, count in counted_words(as_texts(texts)):
            known = pc.index_in(pa.array(words, pa.string()), value_set=self.words)
            place = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype("int64")
            unseen = np.flatnonzero(place < 0)
            place[unseen] = [self.width + zlib.crc32(words[i].encode()) % COUNTERS for i in unseen.tolist()]
            blank = np.array([not w for w in words], bool)
            keep = ~blank[word] if len(word) else np.zeros(0, bool)
            # Known beginnings of each distinct word, then of each pair.
            spelled, length = pa.array(words, pa.string()), pc.utf8_length(pa.array(words, pa.string()))
            begun = []
            for n in PREFIXES:
                begin = pc.if_else(pc.greater_equal(length, n), pc.utf8_slice_codeunits(spelled, 0, n), None)
                begun.append(pc.fill_null(pc.index_in(begin, value_set=self._beginning[0], skip_nulls=True), -1).to_numpy(zero_copy_only=False))
            begun = np.column_stack(begun) if words else np.zeros((0, len(PREFIXES)), "int64")
            fan = (begun >= 0).sum(axis=1)
            hit = np.flatnonzero(fan[word] > 0) if len(word) else word
            flat = self._beginning[1][begun[begun >= 0]]
            more = flat[gather((np.cumsum(fan) - fan)[word[hit]], fan[word[hit]])] if len(hit) else flat[:0]
            whole = self.width + COUNTERS
            pair, back = np.unique(np.repeat(row[hit], fan[word[hit]]) * whole + more, return_inverse=True)
            sums = np.bincount(back, np.repeat(count[hit], fan[word[hit]]), len(pair))
            row = np.concatenate([row[keep], pair // whole])
            place = np.concatenate([place[word[keep]], pair % whole])
            value = np.concatenate([count[keep], sums]).astype("float64")
            order = np.lexsort((place, row))
            yield Sparse(np.searchsorted(row[order], np.arange(stop - start + 1)), place[order], value[order])


@dataclass
class Model:
    """A fitted index; its size is bounded by the examples' words, COUNTERS and nothing else."""

    terms: Terms | None
    weights: np.ndarray  # idf x relevance of each term and counter
    examples: Sparse  # unit rows of the examples that have any term, sorted into blocks
    names: np.ndarray
    votes: np.ndarray  # label times the label's natural share
    against: np.ndarray
    empty: float  # the share of label 1 among examples without any term
    calibration: tuple[float, float] = (1.0, 0.0)
    maxima: np.ndarray = field(init=False)  # first example of each block

    def __post_init__(self) -> None:
        rows = self.examples
        self.maxima = np.arange(0, len(rows), BLOCK)
        inside = np.flatnonzero(rows.place < (self.terms.width if self.terms else len(self.weights))).astype("int32")
        order = inside[np.argsort(rows.place[inside], kind="stable")]
        term = rows.place[order].astype("int32")
        owner = np.repeat(np.arange(len(rows), dtype="int32"), np.diff(rows.ptr))
        self.example, self.weight = owner[order], rows.value[order]
        del inside, order, owner
        # Long postings are a matrix of terms and examples, the others lists.
        often = np.bincount(term, minlength=1)
        long = np.sort(np.argsort(-often, kind="stable")[:HEAD])
        self.head_at = np.full(len(self.weights), -1, "int16")
        self.head_at[long[long < len(self.weights)]] = np.arange(len(long))[long < len(self.weights)]
        self.head = np.zeros((HEAD, len(self.maxima) * BLOCK))
        listed = self.head_at[term] < 0
        self.head[self.head_at[term[~listed]], self.example[~listed]] = self.weight[~listed]
        self.head_most = self.head.reshape(HEAD, -1, BLOCK).max(axis=2, initial=0) if len(self.maxima) else np.zeros((HEAD, 0))
        term, self.example, self.weight = term[listed], self.example[listed], self.weight[listed]
        block = self.example // BLOCK
        # Pieces: the postings of a term within a block, with the largest weight among them.
        self.inside = (self.example % BLOCK).astype("uint8")
        del self.example
        self.start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, "int64")
        self.size = np.diff(np.append(self.start, len(term)))
        self.block = block[self.start]
        self.most = np.maximum.reduceat(self.weight, self.start) if len(term) else np.zeros(0)
        width = len(self.weights)
        self.pieces = np.searchsorted(term[self.start], np.arange(width + 1))

    def __getstate__(self) -> tuple:
        # Workers build the postings again, so that a broadcast holds each weight once.
        return self.terms, self.weights, self.examples, self.names, self.votes, self.against, self.empty, self.calibration

    def __setstate__(self, state: tuple) -> None:
        give_back()
        self.__init__(*state)
        give_back()

    @property
    def vectors(self) -> np.ndarray:
        """The examples as a dense matrix, for small checks."""
        out = np.zeros((len(self.examples), len(self.weights)), "float32")
        out[self.examples.row, self.examples.place] = self.examples.value
        return out

    def unit(self, counts: np.ndarray | Sparse) -> np.ndarray | Sparse:
        rows = sparse(counts)
        weighted = rows.value * self.weights[rows.place]
        norms = np.sqrt(np.bincount(rows.row, weighted**2, len(rows)))
        rows = Sparse(rows.ptr, rows.place, (weighted / np.where(norms > 0, norms, 1)[rows.row]).astype("float32"))
        if isinstance(counts, Sparse):
            return rows
        out = np.zeros(counts.shape, "float32")
        out[rows.row, rows.place] = rows.value
        return out

    def nearest(self, units: np.ndarray | Sparse, skip: np.ndarray | None = None, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and cosines of the k nearest examples (-1 where fewer), and blocks opened.

        `skip`: for each row an example that is left out, -1 for none. Ties go to the
        earlier example.
        """
        units = sparse(units)
        best = np.zeros((len(units), k), "float32")
        where = np.full((len(units), k), -1, "int64")
        opened = 0
        for start in range(0, len(units) if len(self.maxima) else 0, TOGETHER):
            rows = np.s_[start:start + TOGETHER]
            opened += self._nearest(units.take(np.arange(len(units))[rows]), None if skip is None else skip[rows], where[rows], best[rows])
        return where, best, opened

    def _nearest(self, units: Sparse, skip: np.ndarray | None, where: np.ndarray, best: np.ndarray) -> int:
        """As `nearest`, for a few rows at once, into `where` and `best`; the number of blocks opened."""
        n, blocks, k = len(units), len(self.maxima), where.shape[1]
        row, place, value = units.row, units.place, units.value.astype("float64")
        column = self.head_at[place]
        dense = np.zeros((n, self.head.shape[0]))
        dense[row[column >= 0], column[column >= 0]] = value[column >= 0]
        fan = self.pieces[place + 1] - self.pieces[place]
        piece, value = gather(self.pieces[place], fan), np.repeat(value, fan)
        pair = np.repeat(row * blocks, fan) + self.block[piece]
        bound = dense @ self.head_most + np.bincount(pair, self.most[piece] * value, n * blocks).reshape(n, blocks)
        done = np.zeros((n, blocks), bool)
        wanted, opened, least = bound > 0, 0, np.zeros(n)
        # Cosines of the blocks opened first, for the k-th best so far; finds of all blocks.
        held, finds = np.zeros((n, 0)), []
        for most in (*FIRST_BLOCKS, blocks):
            if most < blocks:  # the most promising ones first, to tell which others need not be
                order = np.argsort(np.where(wanted, -bound, 0), axis=1, kind="stable")[:, :most]
                few = np.zeros_like(wanted)
                np.put_along_axis(few, order, True, axis=1)
                wanted &= few
            asks, at = np.nonzero(wanted)
            score = self._open(dense, piece, value, pair, wanted)
            if skip is not None:
                own = np.flatnonzero((skip[asks] >= 0) & (skip[asks] // BLOCK == at))
                score[own, skip[asks[own]] % BLOCK] = 0
            opened += len(asks)
            done |= wanted
            if most < blocks:
                first = np.zeros((n, most, BLOCK))
                first[asks, np.arange(len(asks)) - np.searchsorted(asks, asks)] = score
                held = np.concatenate([held, first.reshape(n, -1)], axis=1)
                least = np.partition(held, -k, axis=1)[:, -k] if held.shape[1] > k else least
            hit, inside = np.nonzero(score > np.maximum(least, 1e-6)[asks, None] - 2e-6)
            finds.append((asks[hit], at[hit] * BLOCK + inside, np.round(score[hit, inside], 6)))
            # Equal rounded cosines may go to an earlier example, so a bound that ties is opened too.
            wanted = ~done & (bound > 0) & (bound + 2e-6 >= least[:, None])
        row, there, cosine = (np.concatenate(x) for x in zip(*finds))
        kept = cosine >= np.maximum(np.round(least, 6), 1e-6)[row]
        row, there, cosine = row[kept], there[kept], cosine[kept]
        order = np.lexsort((there, -cosine, row))
        row, there, cosine = row[order], there[order], cosine[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < k
        where[row[first], rank[first]], best[row[first], rank[first]] = there[first], cosine[first]
        return opened

    def _open(self, dense: np.ndarray, piece: np.ndarray, value: np.ndarray, pair: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Cosines with the examples of each wanted pair of a row and a block, in order of the pairs."""
        slot = np.full(wanted.shape, -1, "int64")
        count = int(wanted.sum())
        slot[wanted] = np.arange(count)
        score = np.zeros((count, BLOCK))
        for at in np.flatnonzero(wanted.any(axis=0)):
            here = np.flatnonzero(wanted[:, at])
            score[slot[here, at]] = dense[here] @ self.head[:, at * BLOCK:(at + 1) * BLOCK]
        target = slot.reshape(-1)[pair]
        chosen = np.flatnonzero(target >= 0)
        sizes = self.size[piece[chosen]]
        post = gather(self.start[piece[chosen]], sizes)
        cell = np.repeat(target[chosen] * BLOCK, sizes) + self.inside[post]
        score += np.bincount(cell, self.weight[post] * np.repeat(value[chosen], sizes), score.size).reshape(score.shape)
        return score

    def raw(self, units: np.ndarray | Sparse, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where, cosine, _ = self.nearest(units, skip)
        there = where >= 0
        weight = np.where(there, cosine.astype("float64") ** 2, 0)
        for_ = (weight * self.votes[where]).sum(axis=1) if len(self.votes) else np.zeros(len(units))
        no = (weight * self.against[where]).sum(axis=1) if len(self.votes) else np.zeros(len(units))
        share = np.where(there.any(axis=1), (for_ + 1e-3 * self.empty) / (for_ + no + 1e-3), self.empty)
        return share, where, cosine

    def score(self, counts: np.ndarray | Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of label 1, and the nearest examples with their cosines."""
        share, where, cosine = self.raw(self.unit(counts))
        slope, shift = self.calibration
        logit = np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
        return 1 / (1 + np.exp(-(slope * logit + shift))), where, cosine


def chi_square(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    a, b = with_1.astype("float64"), with_0.astype("float64")
    c, d = n1 - a, n0 - b
    return (n1 + n0) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)


def relevance(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How much terms count that are in so many sample texts of each label."""
    chi = np.where(with_1 + with_0 >= LEAST_DOCUMENTS, chi_square(with_1, with_0, n1, n0), 0)
    return (np.sqrt(chi / UNIT_CHI) + LEAST_RELEVANCE**0.5) ** 2


def index(terms: Terms | None, weights: np.ndarray, names, counts: np.ndarray | Sparse, labels: np.ndarray, natural: tuple[float, float]) -> Model:
    """The index of the examples (rows in order of their names), without calibration."""
    rows = sparse(counts)
    sizes = np.bincount(labels, minlength=2).astype("float64")
    share = np.array(natural) / np.maximum(sizes, 1)
    any_term = np.diff(rows.ptr) > 0
    bare = np.bincount(labels[~any_term], minlength=2) * share
    empty = float((bare[1] + 1e-3 * natural[1] / max(1, sum(natural))) / (bare.sum() + 1e-3))
    # Examples with the same strongest terms share a block, which keeps its maxima low.
    strong = rows.place[np.lexsort((rows.place, -rows.value * weights[rows.place], rows.row))]
    first = np.minimum(rows.ptr[:-1], max(0, len(strong) - 2))
    top = [strong[first + i] if len(strong) > 1 else np.zeros(len(rows), "int64") for i in (0, 1)]
    order = np.lexsort((top[1], top[0]))
    order = order[any_term[order]]
    model = Model(terms, weights, rows.take(order), np.asarray(names)[order], labels[order] * share[1], (1 - labels[order]) * share[0], empty)
    model.examples = model.unit(model.examples)
    model.examples.place = model.examples.place.astype("int32")
    model.__post_init__()
    return model


def build(terms: list, weights: np.ndarray, names, counts: np.ndarray | Sparse, labels: np.ndarray, natural: tuple[float, float]) -> Model:
    """Index and calibration, without a vocabulary, from the examples' counts of terms."""
    model = index(None, weights, names, counts, labels, natural)
    if len(model.examples):
        calibrate(model, np.asarray(names), labels, natural, model.raw(model.examples, skip=np.arange(len(model.examples)))[0])
    return model


def calibrate(model: Model, names: np.ndarray, labels: np.ndarray, natural: tuple[float, float], votes: np.ndarray) -> None:
    """`votes`: those of each example of the index, left out of its own."""
    share = np.array(natural) / np.maximum(np.bincount(labels, minlength=2), 1)
    order = np.argsort(names, kind="stable")
    raw = np.full(len(labels), model.empty)
    raw[order[np.searchsorted(names[order], model.names)]] = votes
    model.calibration = platt(raw, labels, share[labels])


def platt(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the log odds of the votes."""
    x = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / np.clip(1 - raw, 1e-4, 1))
    w = weights / weights.sum() * len(labels)
    # Smoothed targets and a pull towards the identity keep separable examples finite.
    counts = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    a, b, pull = 1.0, 0.0, 0.01 * len(labels)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - target) * x).sum() + pull * (a - 1), (w * (p - target)).sum() + pull * b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + pull, (v * x).sum()], [(v * x).sum(), v.sum() + pull]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = float(np.clip(a - step[0], 0.2, 3)), float(np.clip(b - step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def sample_terms(texts: pa.Array, labels: np.ndarray) -> Counter:
    """(stem, level, label) to the number of texts that have it."""
    out: Counter = Counter()
    for start, stop, words, row, word, count in counted_words(as_texts(texts)):
        stems = [_stems(w) if w else [] for w in words]
        cuts = np.searchsorted(row, np.arange(stop - start + 1))
        for i in range(stop - start):
            seen: Counter = Counter()
            for w, n in zip(word[cuts[i]:cuts[i + 1]].tolist(), count[cuts[i]:cuts[i + 1]].tolist()):
                for s in stems[w]:
                    seen[s] += n
            label = int(labels[start + i])
            out.update((s, level, label) for s, n in seen.items() for level in LEVELS if n >= level)
    return out


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves `fold` over `folds`; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (5, 0)) -> Model:
    """A model from `documents` (doc_id, text) and `labels` (doc_id, label 0 or 1).

    Rows of the held-out fold are never learned from, nor those without id or label; of
    several labels of an id the largest counts, of several texts the smallest. The sample
    takes EXAMPLES rows of each label by the hash of their id; document frequencies count
    all documents. Without any labelled row the model gives every text 0.5.
    """
    spark = documents.sparkSession
    given = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), *held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("given"))
        .join(documents.select("doc_id"), "doc_id", "left_semi")
    )
    natural = {r["given"]: r["count"] for r in given.groupBy("given").count().collect()}
    chosen = None
    for value in (0, 1):
        part = given.filter(F.col("given") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
        chosen = part if chosen is None else chosen.unionByName(part)
    folder = fresh_folder(spark, "toxicity")
    # At most twice EXAMPLES ids are broadcast.
    (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "given").agg(F.min("text").alias("text"))
        .repartition(12, "doc_id").write.parquet(folder)
    )
    sample = spark.read.schema("doc_id bigint, given int, text string").parquet(folder)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sample_terms(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False))
            for part in range(0, len(found), 100_000):
                keys = [*found][part:part + 100_000]
                stem, level, value = zip(*keys)
                yield pa.RecordBatch.from_pydict({
                    "stem": pa.array(stem, pa.string()), "level": pa.array(level, pa.int32()),
                    "given": pa.array(value, pa.int32()), "n": pa.array([found[k] for k in keys], pa.int64()),
                })

    told = sample.select("text", "given").mapInArrow(tell, "stem string, level int, given int, n bigint")
    sizes = {r["given"]: r["count"] for r in sample.groupBy("given").count().collect()}
    n1, n0 = (float(sizes.get(v, 0)) for v in (1, 0))
    with_label = [F.sum(F.when(F.col("given") == v, F.col("n")).otherwise(0)).alias(name) for name, v in (("a", 1), ("b", 0))]
    joint = told.groupBy("stem").agg(*with_label)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    cross = a * (n0 - b) - b * (n1 - a)
    chi = (n1 + n0) * cross * cross / F.greatest((a + b) * (n1 + n0 - a - b) * n1 * n0, F.lit(1e-9))
    # All words of the examples; beginnings if they tell the labels apart.
    beginning = F.col("stem").endswith("*")
    best = joint.filter(~beginning | ((chi >= LEAST_CHI) & (a + b >= LEAST_DOCUMENTS))).withColumn("beginning", beginning).toArrow()
    best = best.sort_by([("beginning", "ascending"), ("stem", "ascending")])
    stem = best.column("stem").combine_chunks()
    n_words = len(stem) - (pc.sum(pc.cast(best.column("beginning"), pa.int64())).as_py() or 0)
    terms = Terms(stem.slice(0, n_words), {t: n_words + i for i, t in enumerate(stem.slice(n_words).to_pylist())})
    width = terms.width + COUNTERS
    vocabulary = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(width, "int64"), 0
        for batch in batches:
            rows += len(batch)
            for found in vocabulary.value.counts(batch.column(0)):
                total += np.bincount(found.place, minlength=width)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"position": np.append(seen, width), "n": np.append(total[seen], rows)})

    counts = documents.select("text").mapInArrow(count, "position bigint, n bigint").groupBy("position").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(width + 1)
    seen[counts.column("position").to_numpy()] = counts.column("n").to_numpy()
    known = np.full(width, LEAST_RELEVANCE)
    if n1 + n0:
        known[:terms.width] = relevance(best.column("a").to_numpy(), best.column("b").to_numpy(), n1, n0)
    weights = ((np.log((1 + seen[width]) / (1 + seen[:width])) + 1) * known).astype("float32")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for found in vocabulary.value.counts(batch.column(1)):
                for at, end in zip(found.ptr[:-1], found.ptr[1:]):
                    places.append(found.place[at:end].astype("<i4").tobytes())
                    values.append(found.value[at:end].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "given": batch.column(2), "places": pa.array(places, pa.binary()), "counts": pa.array(values, pa.binary()),
            })

    # At most twice EXAMPLES rows.
    rows = sample.select("doc_id", "text", "given").mapInArrow(present, "doc_id bigint, given int, places binary, counts binary").toArrow().sort_by("doc_id")
    shares = (natural.get(0, 0), natural.get(1, 0))
    if not len(rows):
        rate = shares[1] / sum(shares) if sum(shares) else 0.5
        none = np.zeros(0)
        return Model(terms, weights, sparse(np.zeros((0, width), "float32")), np.zeros(0, "int64"), none, none, rate)
    vocabulary.destroy()
    joined = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    ends = np.cumsum(pc.binary_length(rows.column("places")).to_numpy() // 4)
    examples = Sparse(np.concatenate([[0], ends]).astype("int64"), joined("places", "<i4").astype("int64"), joined("counts", "<f4"))
    names, given_ = rows.column("doc_id").to_numpy(), rows.column("given").to_numpy().astype("int64")
    model = index(terms, weights, names, examples, given_, shares)
    if not len(model.examples):
        return model
    # Each example's votes without its own, in tasks.
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"at": own, "raw": model.raw(model.examples.take(own), skip=own)[0]})

    votes = spark.range(len(model.examples), numPartitions=12).mapInArrow(left_out, "at bigint, raw double").toArrow().sort_by("at")
    shared.destroy()
    calibrate(model, names, given_, shares, votes.column("raw").to_numpy())
    return model


SCORED = "struct<score: double, predicted: int, evidence: array<struct<doc_id: bigint, cosine: double>>>"
EVIDENCE = 5


def toxicity_column(text: Column, model: Model, documents: DataFrame) -> Column:
    """score, predicted (1 from 0.5 on) and the nearest examples of a text.

    Null and empty texts, and those that share no term with any example, get the label's
    share among examples without any.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        scores, evidence = [np.zeros(0)], []
        for counts in model.terms.counts(texts):
            found, where, cosine = model.score(counts)
            scores.append(found)
            for places, near in zip(where[:, :EVIDENCE], cosine[:, :EVIDENCE]):
                evidence.append([{"doc_id": int(model.names[p]), "cosine": float(c)} for p, c in zip(places, near) if p >= 0])
        all_ = np.clip(np.concatenate(scores), 0, 1)
        near = pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))
        return pa.StructArray.from_arrays(
            [pa.array(all_), pa.array((all_ >= 0.5).astype("int32")), near], names=["score", "predicted", "evidence"]
        )

    return F.arrow_udf(score, SCORED)(text)
