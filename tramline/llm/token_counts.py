"""Exact token counts at every prefix of a text, by dynamic programming over prefixes, stored.

The last token of each prefix's encoding fixes the encoding: it is the longest vocabulary entry that ends there and may
follow the last token of the prefix before it. So one pass over a word gives the count at each of its prefixes, and
words never share tokens. A text is cut into chunks that no token spans; the steps of the count, from each character
of a chunk to the next, are found once for each distinct chunk, and those of a text are its chunks' in order.

The store holds a text's steps, mostly a byte for each character. The count of the whole text, of the text cut anywhere,
and the longest prefix within a budget are read from it, without encoding again.

Defined results: a null text counts as empty, with no tokens; repeated rows are counted each; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.batches import slices
from tramline.llm.tokens import BYTE_LEVEL, WHITE, _Index, cut, kept

# The pattern of words of the byte-level tokenizer, and the endings that it takes as words of their own.
PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WHITE}\\p{{L}}\\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

STORE = "doc_id long, n_bytes long, steps binary"


class PrefixCounter:
    """Counts tokens of texts as the tokenizers library does for a byte-level BPE file."""

    def __init__(self, path: str, limit: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.specials = [t["content"] for t in file["added_tokens"]]
        to_byte = {c: b for b, c in enumerate(BYTE_LEVEL)}
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self.vocab = {as_bytes(t): n for t, n in file["model"]["vocab"].items() if all(c in to_byte for c in t)}
        self.lengths: dict[int, list[int]] = {}  # by last byte: lengths of entries that end in it, longest first
        for t in self.vocab:
            self.lengths.setdefault(t[-1], set()).add(len(t))
        self.lengths = {b: sorted(x, reverse=True) for b, x in self.lengths.items()}
        self.pattern, self.white, self.limit = regex.compile(PATTERN), regex.compile(f"[{WHITE}]+"), limit
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self):
        self.index = _Index()
        self.steps, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32)
        self.follows.clear()

    def _merged(self, word: bytes) -> list[bytes]:
        """The tokens of a short word by applying merges in order of rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            at, joined = 0, []
            while at < len(parts):
                if at + 1 < len(parts) and (parts[at], parts[at + 1]) == pair:
                    joined.append(pair[0] + pair[1])
                    at += 2
                else:
                    joined.append(parts[at])
                    at += 1
            parts = joined
        return parts

    def _may_follow(self, before: bytes, token: bytes) -> bool:
        known = self.follows.get((before, token))
        if known is None:
            known = self.follows[before, token] = self._merged(before + token) == [before, token]
        return known

    def word(self, word: bytes) -> list[int]:
        """Counts of the word's prefixes of 0, 1, ... bytes."""
        last, counts, vocab = [b""] * (len(word) + 1), [0] * (len(word) + 1), self.vocab
        for end in range(1, len(word) + 1):
            for n in self.lengths[word[end - 1]]:
                if n > end:
                    continue
                token = word[end - n : end]
                if token in vocab and (n == end or self._may_follow(last[end - n], token)):
                    last[end], counts[end] = token, counts[end - n] + 1
                    break
        return counts

    def _by_character(self, word: str) -> list[int]:
        """Counts of the word's prefixes of 1, 2, ... characters."""
        raw = word.encode()
        counts = self.word(raw)
        if len(raw) == len(word):
            return counts[1:]
        return [n for n, b in zip(counts[1:], [*raw[1:], 0], strict=True) if b & 0xC0 != 0x80]

    def plain(self, text: str) -> list[int]:
        """Counts of the prefixes of 0, 1, ... characters of a text that holds no special string, all in one pass.

        A prefix has the words of the text, the last one cut, but for two cases: within white space, all of it is one
        word; and an ending such as 'll is one only when complete.
        """
        counts, base = [0], 0
        for word in self.pattern.findall(text):
            own = self._by_character(word)
            if word in ENDINGS:
                begun = self.word(b"'")[-1]
                counts += [base + begun, base + begun + self.word(word[1].encode())[-1]][: len(word) - 1]
                counts.append(base + own[-1])
            else:
                counts += [base + n for n in own]
            base += own[-1]
        for run in self.white.finditer(text):
            a, b = run.span()
            counts[a + 1 : b + 1] = [counts[a] + n for n in self._by_character(run.group())]
        return counts

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... characters of a text."""
        if not any(s in text for s in self.specials):
            return np.array(self.plain(text), np.int32)
        counts, base = [np.zeros(1, np.int32)], 0
        parts = regex.split("(" + "|".join(map(regex.escape, self.specials)) + ")", text)
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            own = np.array(self.plain(parts[k] + special), np.int32)  # until a special string is complete, it is ordinary text
            total = self.plain(parts[k])[-1] + bool(special)
            own[-1] = total
            counts.append(base + own[1:])
            base += total
        return np.concatenate(counts)

    def _learn(self):
        new, self.index.new = self.index.new, []
        first = len(self.index) - len(new)
        found = []
        for w in new:
            counts = self.prefixes(w).tolist() if any(s in w for s in self.specials) else self.plain(w)
            found.append([b - a for a, b in zip(counts, counts[1:], strict=False)])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        filled, total = int(self.ends[first]), int(lengths.sum())
        while filled + total > len(self.steps):
            self.steps = np.concatenate([self.steps, np.zeros_like(self.steps)])
        while len(self.index) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[first + 1 : len(self.index) + 1] = filled + np.cumsum(lengths)
        self.steps[filled : filled + total] = np.fromiter(chain.from_iterable(found), np.int32, total)

    def steps_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Steps of the counts of all texts, one for each character, and the offsets of each text in them."""
        if len(self.index) > self.limit or len(self.follows) > self.limit:
            self._clear()
        whole = np.zeros(len(column), bool)
        for s in self.specials:
            whole |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        chunks, counts = cut(column, whole)
        numbered = chunks.dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        if self.index.new:
            self._learn()
        known = pa.ListArray.from_arrays(pa.array(self.ends[: len(self.index) + 1]), pa.array(self.steps))
        found = known.take(pa.array(numbers[numbered.indices.to_numpy()]))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[counts].astype(np.int64)


def packed(steps: np.ndarray) -> bytes:
    """Steps in as few bytes as hold the largest: the width in bytes, then the steps."""
    width = 1 if not len(steps) or (steps.min() >= -128 and steps.max() < 128) else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def counts_of(steps: bytes) -> np.ndarray:
    """Counts of the prefixes of 1, 2, ... characters from packed steps."""
    return np.cumsum(np.frombuffer(steps, f"<i{steps[0]}", offset=1), dtype=np.int64)


def prefix_store(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and steps (the count at every prefix, packed) of each row, to be written and asked often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(PrefixCounter, tokenizer)
        for batch in slices(batches):
            text = batch.column("text")
            steps, offsets = counter.steps_of(text)
            stored = [packed(steps[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text).fill_null(0).cast(pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "steps"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, STORE)


def token_counts(store: DataFrame, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and chars_within (the most characters whose encoding has at most limit
    tokens) of each row of a store."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "steps"):
            tokens, within = [], []
            for steps in batch.column("steps").to_pylist():
                counts = counts_of(steps)
                tokens.append(int(counts[-1]) if len(counts) else 0)
                # Counts may fall where a token gets complete, so it is the last place within the limit that counts.
                within.append(len(counts) if not len(counts) or tokens[-1] <= limit else len(counts) - int((counts[::-1] <= limit).argmax()) if counts[0] <= limit else 0)
            tokens = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens, pc.greater(tokens, limit), pa.array(within, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"])

    return store.select("doc_id", "n_bytes", "steps").mapInArrow(answer, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def prefix_tokens(store: DataFrame) -> DataFrame:
    """doc_id and prefix_tokens, the count at each prefix of 0, 1, ... characters, for tokens_at and longest_within."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "steps"):
            tables = [np.concatenate([[0], counts_of(s)]).astype(np.int32) for s in batch.column("steps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tables, pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    return store.select("doc_id", "steps").mapInArrow(unpack, "doc_id long, prefix_tokens array<int>")


def tokens_at(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the text cut after so many characters; of the whole text if it is shorter."""
    return F.element_at(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1) + 1)


def longest_within(prefix_tokens: Column, budget: Column) -> Column:
    """The most characters from the start whose encoding has at most budget tokens."""
    within = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(within)
