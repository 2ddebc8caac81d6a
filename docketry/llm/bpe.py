"""Byte-pair encoding as a transducer with bounded lookahead, and its inverse.

The tokenizer file is one of the `tokenizers` library with a BPE model whose words end in
a suffix symbol (`end_of_word_suffix`). White space is dropped there, so a text is a row
of chunks between white space, and a chunk is a row of words found by the file's pattern.

A word is a row of byte symbols, the last one marked as the word's end. `lookahead()` is
computed from the merge list: however a word goes on, tokens that end that many symbols
before the end of what has been read are final. `Encoder.stream` reads a word of any
length in windows, emits what is final and goes on from there, so it holds a window and
never the word's tokens. A shorter word is a single window.

Why the bound holds. Take a word and a cut-off front part of it and apply the merges to
both in order of rank. Left of some place both have the same tokens; at first that place
is the cut. Rule (u, v) can move it left only by merging in one of the two where it can't
in the other, that is where `v` stands over the place, so by at most the length of `v`;
and once per rule, because equal merges are applied from the left. A later rule (u2, v2)
moves it further only if v2 covers the token u that stood left of it. So the sum of
lengths of right parts along the longest chain of rules, each later than the one before
and with the former's left part inside its own right part, is enough.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from docketry.llm.batches import as_texts, gather, slices

#: Symbols read in one window beside the lookahead.
WINDOW = 8192
#: Chunks, and words, whose tokens a worker remembers; it starts anew when they are more.
REMEMBERED = 200_000
#: Texts above this many characters are encoded piece by piece.
PIECE = 1 << 20
#: Bytes of a word up to which many are merged at once and remembered.
SHORT = 32
#: Up to here the Unicode tables of all versions in use agree.
SETTLED = 0x0530
#: A text with one of these is cut at white space before anything else, chunk by chunk:
#: special tokens, white space beyond ASCII's, letters whose lower case is two, what NFC
#: may change, and all that is not settled, but for dashes and quotation marks.
ODD = (
    r"<\||[\x1c-\x1f\x{85}\x{a0}\x{130}\x{300}-\x{36f}\x{374}\x{37e}\x{387}\x{483}-\x{489}]"
    r"|[^\x00-\x{52f}\x{2010}-\x{2027}]"
)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self.suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.suffix:
            raise ValueError(f"{path}: not a BPE tokenizer with a word-end symbol")
        vocab = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        #: A pair of ids, as one number, to its rank; a rank to the id it makes.
        self.base = len(self.tokens)
        self.rank = {vocab[a] * self.base + vocab[b]: r for r, (a, b) in enumerate(self.merges)}
        self.made = [vocab[a + b] for a, b in self.merges]
        order = np.argsort(np.fromiter(self.rank, "int64", len(self.rank)))
        self.keys = np.fromiter(self.rank, "int64", len(self.rank))[order]
        self.key_ranks = np.fromiter(self.rank.values(), "int64", len(self.rank))[order]
        self.made_ids = np.array(self.made, "int64")
        named = byte_symbols()
        self.inner = [vocab[named[b]] for b in range(256)]
        self.final = [vocab[named[b] + self.suffix] for b in range(256)]
        self.symbols = np.array([self.inner, self.final], "int64")
        self.byte_of = {c: b for b, c in named.items()}
        split = next(p for p in content["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        # The same for RE2, whose \\s lacks the vertical tab.
        self.spacing = pattern.replace(r"[^\s", r"[^\s\v")
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True)))
        self.library = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._lookahead: int | None = None

    # -- one word

    def lookahead(self) -> int:
        """Symbols after a token's end that settle it (see the module's text)."""
        if self._lookahead is None:
            def symbols(token: str) -> str:
                # The suffix is part of the symbol before it.
                return token[:-len(self.suffix)] + "\0" if token.endswith(self.suffix) else token

            longest: dict[str, int] = {}
            for a, b in self.merges:
                v = symbols(b)
                inside = max(
                    (longest.get(v[i:j], 0) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=0
                )
                chain = len(v) + inside
                if chain > longest.get(symbols(a), 0):
                    longest[symbols(a)] = chain
            self._lookahead = max(longest.values(), default=0)
        return self._lookahead

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one window: lowest rank first, equal ranks from the left."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, base, none = self.rank.get, self.base, len(self.made)
        ranks = [get(a * base + b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * base + ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] * base + ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, base, n = self.rank.get, self.base, len(ids)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            rank = get(ids[i] * base + ids[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or the number of rules where there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], len(self.made))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """`merge` for many words of a window or less at once: each round applies to every
        word the first of its merges. Gives each word's ids as 32-bit integers."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), "int64", len(words))
        last = np.zeros(sizes.sum(), "int64")
        last[np.cumsum(sizes) - 1] = 1
        ids = self.symbols[last, np.frombuffer(b"".join(words), "uint8")]
        word = np.repeat(np.arange(len(words)), sizes)
        none = len(self.made)
        rank = np.full(len(ids), none)  # of the pair that begins here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._ranks(ids[inside], ids[inside + 1])
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            per = np.repeat(best, np.diff(np.append(starts, len(ids))))
            if (over := per == none).any():  # nothing left to merge in these words
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, rank, per = (x[~over] for x in (ids, word, rank, per))
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == per)
            at = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            ids[at] = self.made_ids[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # each word before lost one symbol
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                after = np.minimum(i + 1, len(ids) - 1)
                pair = (after > i) & (word[after] == word[i])
                rank[i] = np.where(pair, self._ranks(ids[i], ids[after]), none)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        raw = ids[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words)) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def stream(self, symbols: Iterable[int], window: int = WINDOW) -> Iterator[int]:
        """Tokens of one word from its symbols, each as soon as nothing to come can change it."""
        held: list[int] = []
        keep = self.lookahead()
        for symbol in symbols:
            held.append(symbol)
            if len(held) >= window + keep:
                settled, done = len(held) - keep, 0
                for token in self.merge(held.copy()):
                    size = self._size(token)
                    if done + size > settled:
                        break
                    done += size
                    yield token
                held = held[done:]
        yield from self.merge(held)

    def _size(self, token: int) -> int:
        text = self.tokens[token]
        return len(text) - len(self.suffix) + (len(text) == len(self.suffix)) if text.endswith(self.suffix) else len(text)

    def word(self, raw: bytes) -> list[int]:
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return self.merge(ids) if len(ids) <= WINDOW else list(self.stream(ids))

    # -- texts

    def _plain(self, chunk: str) -> Iterator[str]:
        """Words of a chunk without special tokens."""
        if max(map(ord, chunk)) < SETTLED:
            yield from self.words.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        else:
            # Letters that Unicode versions disagree on: ask the tokenizer's own steps.
            norm = self.library.normalizer.normalize_str(chunk)
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(norm):
                yield bytes(self.byte_of[c] for c in word).decode()

    def _parts(self, chunk: str) -> list[str | int]:
        """Words and special tokens of a stretch of text without ASCII white space."""
        if not chunk:
            return []
        if "<" not in chunk or not self.specials.search(chunk):
            return [*self._plain(chunk)]
        found: list[str | int] = []
        for part in self.specials.split(chunk):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += self._plain(part)
        return found

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit integers; those of short words are remembered."""
        known = self._known
        out = [known.get(w) for w in words]
        unseen = [i for i, ids in enumerate(out) if ids is None]
        short = {w: w.encode() for i in unseen if 0 < len(w := words[i]) <= SHORT}
        fresh = dict(zip(short, self.merge_all([*short.values()])))
        for i in unseen:
            w = words[i]
            out[i] = fresh[w] if w in fresh else np.array(self.word(w.encode()) if w else [], "<u4").tobytes()
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
        known.update(fresh)
        return out

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        parts = [self._parts(c) for c in chunks]
        words = [*{p for found in parts for p in found if isinstance(p, str)}]
        ids = dict(zip(words, self.word_ids(words)))
        return [b"".join([p.to_bytes(4, "little") if isinstance(p, int) else ids[p] for p in found]) for found in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and end."""
        texts = as_texts(texts)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if odd.all():
            return _looked_up(pc.ascii_split_whitespace(texts), self.chunk_ids)
        plain = texts.filter(pa.array(~odd))
        spaced = pc.replace_substring_regex(pc.utf8_lower(plain), self.spacing, r"\0 ")
        ids, ends = _looked_up(pc.ascii_split_whitespace(spaced), self.word_ids)
        if not odd.any():
            return ids, ends
        more, more_ends = _looked_up(pc.ascii_split_whitespace(texts.filter(pa.array(odd))), self.chunk_ids)
        starts, sizes = np.zeros(len(odd), "int64"), np.zeros(len(odd), "int64")
        starts[~odd], sizes[~odd] = ends[:-1], np.diff(ends)
        starts[odd], sizes[odd] = len(ids) + more_ends[:-1], np.diff(more_ends)
        return np.concatenate([ids, more])[gather(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def rows(self, texts: pa.Array) -> Iterator[Iterator[np.ndarray]]:
        """For each text an iterator over its ids, in arrays: one, or more for a long text."""
        texts = as_texts(texts)
        for start, stop in slices(texts):
            part = texts.slice(start, stop - start)
            if stop - start == 1 and len(part[0].as_py()) > PIECE:
                yield self._pieces(part[0].as_py())
            else:
                ids, ends = self.encode(part)
                for i in range(stop - start):
                    yield iter((ids[ends[i]:ends[i + 1]],))

    def _pieces(self, text: str) -> Iterator[np.ndarray]:
        space = regex.compile(r"[\x20\x09-\x0D]")
        start = 0
        while start < len(text):
            cut = space.search(text, min(start + PIECE, len(text)))
            stop = cut.start() if cut else len(text)
            yield self.encode(pa.array([text[start:stop]]))[0]
            start = stop


def _looked_up(lists: pa.Array, ids_of) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists of strings in a row, each distinct string looked up once."""
    coded = lists.flatten().dictionary_encode()
    pool = ids_of(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, pool), "int64", len(pool)) // 4
    at = coded.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[at] if len(at) else np.zeros(0, "int64")
    starts = (np.cumsum(sizes) - sizes)[at] if len(at) else lengths
    ids = np.frombuffer(b"".join(pool), "<u4")[gather(starts, lengths)]
    rows = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return ids, np.concatenate([[0], np.cumsum(lengths)])[rows.astype("int64")]


class Joiner:
    """Decodes as a tokenizer file without a decoder does: tokens with a blank between."""

    def __init__(self, encoder: Encoder):
        self.tokens, self.between = encoder.tokens, ""

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        tokens = self.tokens
        out = self.between + " ".join([tokens[i] for i in ids.tolist()])
        self.between = " "
        return out


class Reader:
    """Decodes to readable text: bytes are held until they complete a character, a word's
    end is a blank. Feeding ids in any portions gives the same text."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.pending = ""

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        out = []
        for i in ids.tolist():
            token = self.encoder.tokens[i]
            if token in self.encoder.special:
                out += [self.pending, self.state.decode(b"", True), token]
                self.pending = ""
                continue
            ends = token.endswith(self.encoder.suffix)
            body = token[:-len(self.encoder.suffix)] if ends else token
            out += [self.pending, self.state.decode(bytes(self.encoder.byte_of[c] for c in body))]
            self.pending = " " if ends else ""
        if final:
            out.append(self.state.decode(b"", True))
        return "".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a file, built once per worker process."""
    return Encoder(path)
