"""Removal of word sequences that repeat anywhere in a corpus, by suffix automata of reference shards.

A window is a fixed number of consecutive words. Its anchor is the smallest hash among its short word n-grams, so equal
windows have equal anchors, and neighbouring windows mostly share theirs: a document has few anchors. A context is the
stretch of words whose windows share one anchor place.

1. Each document gives its anchors. Those that occur once in the corpus are done with: no window of theirs repeats.
2. Equal contexts are counted. Where a context occurs twice, all of its windows repeat.
3. Contexts that share an anchor but differ may still share windows. They are dealt by anchor to reference shards of
   bounded size. A shard's contexts are streamed through its suffix automaton: where the matching statistic reaches a
   window's length, the window repeats (there and in the reference); what matches nothing extends the automaton. The
   repeated text of a large corpus has no bound, so shards are sent to where the contexts are, not broadcast to all.
4. Anchors with very many different contexts (a passage in a large share of all documents) would make a shard too large.
   There, window hashes are counted instead, with partial sums before the shuffle.

Results come back by context, are joined to the anchors' places, and gathered by document: nothing but a document's own
places meets in one row. Hashes have 64 bits for the anchor and 64 for the context or window within it.

Defined results: a null text has no words; texts shorter than a window keep all words; rows that repeat in id and text
are copies like others; an empty table gives no rows; other columns are ignored or kept, whatever their names. A window
may have any number of words from one on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.batches import byte_texts, column_of, give_back, slices
from tramline.session import materialize

SEED = 42
#: Contexts in a shard; different contexts of an anchor up to which shards compare them.
SHARD, MANY = 1024, 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _WordHashes(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any stretches of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        powers = np.full(len(words) + 1, _BASE)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        inverse = np.full(len(words) + 1, _INVERSE)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[:-1], dtype=np.uint64)])

    def stretch(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each run of width values."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = place[:-step], place[step:]
        place, span = np.where(values[a] <= values[b], a, b), span + step
    return place


def gram(window: int) -> int:
    """Words of an anchor's n-gram: 8, or what a shorter window has, or as many as leave a context 63 windows at most."""
    if window < 1:
        raise ValueError(f"a window has one word at least, not {window}")
    return min(window, max(8, window - 62))


def anchors(words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document, anchor, first window in the document, number of windows, and context of each anchor place."""
    n = np.diff(offsets)
    total = len(words)
    if total < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    rolling, n_words = Rolling(words), gram(window)
    at = np.arange(total - n_words + 1)
    grams = rolling.stretch(at, at + n_words)
    place = _first_least(grams, window - n_words + 1)  # of each run of n-grams that a window would hold
    doc = np.repeat(np.arange(len(n)), n)[: len(place)]
    real = np.arange(len(place)) + window <= offsets[1:][doc]
    starts, place, doc = np.flatnonzero(real), place[real], doc[real]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    opens = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(doc, prepend=-1))
    count = np.diff(opens, append=len(starts))
    begin = starts[opens]
    context = rolling.stretch(begin, begin + count + window - 1)
    context ^= _mixed((place[opens] - begin).astype(np.uint64) + np.uint64(1))
    return doc[opens], grams[place[opens]].view(np.int64), begin - offsets[doc[opens]], count, context.view(np.int64)


class SuffixAutomaton:
    """Of one growing sequence of integers; knows where each of its substrings first ended."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        self.last = self.size = 0

    def extend(self, c: int) -> None:
        next_, link, length = self.next, self.link, self.length
        new, p = len(next_), self.last
        next_.append({})
        length.append(length[p] + 1)
        link.append(0)
        self.first.append(self.size)
        while p != -1 and c not in next_[p]:
            next_[p][c] = new
            p = link[p]
        if p != -1:
            q = next_[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(next_)
                next_.append(next_[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.first.append(self.first[q])
                while p != -1 and next_[p].get(c) == q:
                    next_[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        self.last = new
        self.size += 1


def repeated_windows(sequences: list[list[int]], window: int) -> list[np.ndarray]:
    """Which windows of each sequence occur elsewhere in these sequences. Sequences hold integers from 0 on."""
    found = [np.zeros(max(0, len(s) - window + 1), bool) for s in sequences]
    automaton, owners = SuffixAutomaton(), []
    next_, link, length = automaton.next, automaton.link, automaton.length

    def cut(state: int) -> int:
        """The state that holds the window which ends where this state's strings end."""
        while length[link[state]] >= window:
            state = link[state]
        return state

    for number, sequence in enumerate(sequences):
        state = matched = 0
        for i, c in enumerate(sequence):
            while state and c not in next_[state]:
                state = link[state]
                matched = length[state]
            if c in next_[state]:
                state, matched = next_[state][c], matched + 1
            if matched >= window:
                state, matched = cut(state), window
                found[number][i - window + 1] = True
                owner, place = owners[automaton.first[state]]
                found[owner][place] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[True], found[number], [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # windows a to b-1 are new
            automaton.extend(-1 - automaton.size)  # a separator that occurs once
            owners.append((-1, -1))
            for i in range(a, b + window - 1):
                automaton.extend(sequence[i])
                place = i - window + 1
                owners.append((number, place))
                earlier = link[automaton.last]
                if place >= a and length[earlier] >= window:
                    found[number][place] = True
                    owner, before = owners[automaton.first[cut(earlier)]]
                    found[owner][before] = True
    return found


def _bits(flags: np.ndarray) -> int:
    return int(sum(1 << k for k in np.flatnonzero(flags).tolist()))


def _key(doc_id: Column, text: Column) -> list[Column]:
    """A row's key: its id and the hash of its text. Rows that agree in both are alike to all that follows."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("key_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key_text")]


def anchor_places(docs: DataFrame, window: int) -> DataFrame:
    """key_id, key_text, anchor, place (the first window's), n (windows) and context of each anchor place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(stored=True)
        hashes = _WordHashes()
        for batch in slices(batches):
            if len(hashes) > 200_000:
                hashes = _WordHashes()
            words = [t.split() for t in byte_texts(batch)]
            offsets = np.cumsum([0, *map(len, words)])
            flat = np.concatenate([np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in words])
            doc, anchor, place, n, context = anchors(flat, offsets, window)
            key = [batch.column(c).take(pa.array(doc)) for c in ("key_id", "key_text")]
            yield pa.RecordBatch.from_arrays([*key, pa.array(anchor), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(context)], ["key_id", "key_text", "anchor", "place", "n", "context"])

    return docs.select("text", *_key(F.col("doc_id"), F.col("text"))).mapInArrow(each, "key_id long, key_text long, anchor long, place int, n int, context long")


def repeated_places(docs: DataFrame, window: int = 35, shard: int = SHARD, many: int = MANY) -> DataFrame:
    """key_id, key_text and spans, an array of (place, mask): windows from place on whose bit is set repeat."""
    places = materialize(anchor_places(docs, window), "anchor-places")
    # What joins back to places is written first: Spark deals a very common anchor's rows to several tasks only where
    # both sides come straight from a shuffle.
    often = materialize(places.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    shared = materialize(places.join(often, "anchor"), "shared-places")
    contexts = materialize(shared.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.max("n").alias("n"), F.min(F.struct("key_id", "key_text", "place")).alias("sample")), "contexts")
    variety = materialize(contexts.groupBy("anchor").agg(F.count("*").alias("variety")).where("variety > 1"), "variety")
    # A context that occurs twice needs no comparison for itself, but those that differ from it do need it.
    different = contexts.join(variety, "anchor").select("anchor", "context", "n", "variety", "sample.*")
    texts = docs.select("text", *_key(F.col("doc_id"), F.col("text")))
    wanted = different.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("anchor", "context", "place", "n", "variety")).alias("wanted"))
    length = window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, items in zip(byte_texts(batch), batch.column("wanted").to_pylist(), strict=True):
                words = text.split()
                rows += [(w["anchor"], w["context"], w["variety"], b" ".join(words[w["place"] : w["place"] + w["n"] + length - 1])) for w in items]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "context", "variety", "words"])

    stretches = materialize(texts.join(wanted, ["key_id", "key_text"]).select("text", "wanted").mapInArrow(cut, "anchor long, context long, variety long, words binary"), "stretches")
    few, lots = stretches.where(F.col("variety") <= many), stretches.where(F.col("variety") > many)
    shards = max(1, -(-few.count() // shard))

    def match(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["anchor", "context"]).sort_values(["anchor", "context"], kind="stable")
        numbers: dict[bytes, int] = {}
        sequences = [[numbers.setdefault(w, len(numbers)) for w in words.split()] for words in f["words"]]
        return pd.DataFrame({"anchor": f["anchor"], "context": f["context"], "mask": np.array([_bits(x) for x in repeated_windows(sequences, length)], np.int64)})

    matched = few.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInPandas(match, "anchor long, context long, mask long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(stored=True)
        hashes = _WordHashes()
        for batch in slices(batches, "words"):
            columns = [[], [], [], []]
            for anchor, context, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "words")), strict=True):
                values = np.fromiter((hashes[w] for w in words.split()), np.uint64)
                begin = np.arange(len(values) - length + 1)
                for c, v in zip(columns, ([anchor] * len(begin), [context] * len(begin), begin, Rolling(values).stretch(begin, begin + length).view(np.int64)), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "context", "bit", "hash"])

    one_each = lots.dropDuplicates(["anchor", "context"]).select("anchor", "context", "words")
    hashes = materialize(one_each.mapInArrow(hashed, "anchor long, context long, bit long, hash long"), "window-hashes")
    again = materialize(hashes.groupBy("anchor", "hash").agg(F.count("*").alias("times")).where("times > 1").select("anchor", "hash"), "repeated-hashes")
    counted = hashes.join(again, ["anchor", "hash"]).groupBy("anchor", "context").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("mask"))
    copies = contexts.where("times > 1").select("anchor", "context", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = materialize(matched.unionByName(counted).unionByName(copies).where("mask <> 0").groupBy("anchor", "context").agg(F.bit_or("mask").alias("mask")), "masks")
    spans = shared.join(masks, ["anchor", "context"]).groupBy("key_id", "key_text").agg(F.collect_set(F.struct("place", "mask")).alias("spans"))
    return spans


def _covered(spans: list[dict] | None, words: int, window: int) -> np.ndarray:
    """Which words the spans' windows cover."""
    change = np.zeros(words + 1, np.int64)
    for s in spans or ():
        mask, at = s["mask"], s["place"]
        while mask:
            if mask & 1:
                change[at] += 1
                change[at + window] -= 1
            mask >>= 1
            at += 1
    return np.cumsum(change[:-1]) > 0


def _kept(text: bytes, spans: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the words kept, joined by one space."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    covered = _covered(spans, len(words), window)
    return len(words), int(covered.sum()), b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c)


def repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    docs = docs.select("doc_id", "text")
    found = docs.select(F.col("doc_id").cast("long"), "text", *_key(F.col("doc_id"), F.col("text"))).join(repeated_places(docs, window), ["key_id", "key_text"], "left")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_kept(t, s, window) for t, s in zip(byte_texts(batch), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows])],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return found.select("doc_id", "text", "spans").mapInArrow(report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs with the repeated words taken out of text; a text that loses none stays as it was."""
    columns = docs.columns
    inner = docs.select(F.struct("*").alias("doc"), *_key(F.col("doc_id"), F.col("text")))
    found = inner.join(repeated_places(docs.select("doc_id", "text"), window), ["key_id", "key_text"], "left").select("doc", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(stored=True)
        for batch in slices(batches):
            kept = []
            for text, spans in zip(column_of(batch, "text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept.append(_kept(text.encode(), spans, window)[2].decode() if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.string())], ["doc", "kept"])

    done = found.mapInArrow(strip, inner.select("doc", F.lit(None).cast("string").alias("kept")).schema)
    return done.select(*[F.col("kept").alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in columns])
