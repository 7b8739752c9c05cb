"""Token ids of texts from public tokenizer files, with the ids of each distinct word kept.

Texts are cut, by numpy over their bytes, into chunks that the tokenizer never merges across, so ids of a text are the
ids of its chunks in order. Arrow numbers a batch's distinct chunks; the library encodes each of them once; texts are
then assembled by numpy gathers.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tramline.llm.batches import stores

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The characters with the Unicode property White_Space, which the tokenizers' patterns call \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"

LETTERS = re.compile(f" ?[{LATIN}]+")

#: The byte-level alphabet: printable bytes stand for themselves, the others in order for the characters from 256 on.
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
_others = [b for b in range(256) if b not in _plain]
BYTE_LEVEL = "".join(chr(256 + _others.index(b)) if b in _others else chr(b) for b in range(256))

_is_white, _is_letter, _is_sign = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\v\f\r ", range(65, 91), b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"))
_is_letter |= np.roll(_is_letter, 32)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(column: pa.Array, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Chunks of texts one after another, and where each text's begin and end among them.

    Cuts are put where white space begins after something else, and where a sign follows a letter: there, no tokenizer
    with a word pattern joins what is on both sides. Places that may be other than they look (beside white space beyond
    ASCII) are left uncut. whole: texts that are one chunk each.
    """
    column = pa.concat_arrays([column.fill_null("")])
    offsets, data = column.buffers()[1:]
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first, end = int(offsets[0]), int(offsets[-1])
    offsets -= first
    b = np.frombuffer(data, np.uint8)[first:end] if end > first else np.zeros(0, np.uint8)
    # The two or three bytes before a place tell whether a character beyond ASCII ends there that may be white space.
    at = np.flatnonzero(_is_white[b])
    at = at[at > 2]
    two, three, one = b[at - 2], b[at - 3], b[at - 1]
    spaces = at[~_is_white[one] & ((one < 0x80) | ((two != 0xC2) & ((three < 0xE1) | (three > 0xE3))))]
    at = np.flatnonzero(_is_sign[b])
    at = at[at > 1]
    one = b[at - 1]
    signs = at[_is_letter[one] | ((b[at - 2] == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]
    starts = np.zeros(len(b) + 1, bool)
    starts[spaces], starts[signs] = True, True
    for k in () if whole is None else np.flatnonzero(whole).tolist():
        starts[offsets[k] : offsets[k + 1]] = False
    starts[offsets] = True
    starts = np.flatnonzero(starts[: len(b)])
    counts = np.searchsorted(starts, offsets)
    chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(b)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(b)))
    return chunks, counts


class _Index(dict):
    """Numbers for words in the order of first sight; new words are also listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Encodes texts as the tokenizers library does with add_special_tokens=False.

    spaces: whether the tokenizer's words carry the space before them (byte-level) or drop white space.
    limit: distinct words kept; beyond it the store is emptied, which bounds a worker's memory.
    """

    def __init__(self, path: str, spaces: bool, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces, self.limit = spaces, limit
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self):
        self.index = _Index()
        self.index[None] = 0  # the id put after each text
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32)
        self.ends[1] = 1

    def _library(self, words: list[str]) -> list[list[int]]:
        """Words of letters go straight to the tokenizer's model, which is what its earlier steps would hand on."""
        letters, model = LETTERS.fullmatch, self.tokenizer.model.tokenize
        plain = [k for k, w in enumerate(words) if letters(w)]
        text = "\n".join([words[k] for k in plain])
        if not self.spaces:
            text = text.replace(" ", "").lower()
        found: list = [None] * len(words)
        for k, w in zip(plain, text.encode().decode("latin-1").translate(BYTE_LEVEL).split(BYTE_LEVEL[10]) if plain else [], strict=True):
            found[k] = [t.id for t in model(w)]
        rest = [k for k, f in enumerate(found) if f is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return found

    def _learn(self):
        new, self.index.new = self.index.new, []
        for at in range(0, len(new), 20_000):
            found = self._library(new[at : at + 20_000])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            first, total = len(self.index) - len(new) + at, int(lengths.sum())
            filled = int(self.ends[first])
            while filled + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while first + len(found) >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ends[first + 1 : first + 1 + len(found)] = filled + np.cumsum(lengths)
            self.ids[filled : filled + total] = np.fromiter(chain.from_iterable(found), np.int32, total)

    def encode(self, texts: list[str] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text in them. end: an id put after each text."""
        if len(self.index) > self.limit:
            self._clear()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = np.zeros(len(column), bool)
        for s in self.specials:  # a special string takes part in cutting the text around it
            whole |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        chunks, counts = cut(column, whole)
        numbered = chunks.dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        if self.index.new:
            self._learn()
        numbers = numbers[numbered.indices.to_numpy()]
        if end is not None:
            self.ids[0] = end
            numbers, counts = np.insert(numbers, counts[1:], 0), counts + np.arange(len(counts))
        known = pa.ListArray.from_arrays(pa.array(self.ends[: len(self.index) + 1]), pa.array(self.ids))
        found = known.take(pa.array(numbers))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[counts].astype(np.int64)


def kept(make, *args):
    """One object per Python worker for these arguments."""
    if (make, *args) not in stores:
        stores.clear()
        stores[(make, *args)] = make(*args)
    return stores[(make, *args)]
