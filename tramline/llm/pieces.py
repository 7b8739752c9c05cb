"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding starts from a word's characters and merges neighbours in the order of an agenda: the pair whose piece has the
best score, the leftmost of equals. With dropout, a hash keyed by the seed, the document and the place in it decides at
which turns of the agenda the merge is skipped; a new candidate arises only when a neighbour is merged. So each
occurrence of a word is cut in a way of its own that is the same each time for a seed, and all decode to the text.

Where no piece holds two characters side by side, no merge ever joins them: there (at the ends of words, and elsewhere)
texts are cut into stretches that are encoded on their own. What a stretch gives depends on the skipped turns alone, so
the ids for each list of skipped turns (none, at first) are found once and kept; another list begins only where an
occurrence skips a turn that the one before it would have taken.

Defined results: a null text is empty and gives no ids; characters outside the vocabulary, and the sign that stands for
a space, are spelt in byte pieces, so that every text decodes to itself; repeated rows are encoded each, alike; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.batches import slices, texts
from tramline.llm.tokens import _Index, kept

#: Words of more characters than this are cut by themselves, each time that they occur.
LONG = 40
#: A turn that no agenda reaches.
NEVER = 1 << 40
#: The sign for a space, and what stands for that sign where a text itself holds it: half a pair, which no text holds.
SPACE, ESCAPED = "▁", "\ud800"
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each of these 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class PieceCodec:
    """Encodes and decodes with a BPE model file whose normaliser changes nothing but spaces."""

    def __init__(self, path: str, rate: float, seed: int, limit: int = 500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(len(names))]
        self.ids = {n: i for i, n in enumerate(names) if not special[i]}
        self.scores = {n: model.get_score(i) for n, i in self.ids.items()}
        # Characters that some piece holds side by side: numbers of characters, and which of their pairs occur.
        beside = {(a, b) for n in self.ids for a, b in zip(n, n[1:], strict=False)}
        signs = {c: k + 1 for k, c in enumerate(sorted({c for p in beside for c in p}))}
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in signs]] = list(signs.values())
        self.beside = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        for a, b in beside:
            self.beside[signs[a], signs[b]] = True
        # Pairs of pieces that merge into a piece, as one number each, in order.
        count, pairs = len(names), {}
        for n, i in self.ids.items():
            for cut in range(1, len(n)):
                left, right = self.ids.get(n[:cut]), self.ids.get(n[cut:])
                if left is not None and right is not None:
                    pairs[left * 2 * count + right] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[x] for x in self.pairs.tolist()], np.int64)
        # Places of the pieces' scores in their order, from 1 on; equal ones share a place.
        self.rank_of = np.unique([model.get_score(i) for i in range(count)], return_inverse=True)[1].astype(np.int32) + 1
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.count = len(names)
        self.longest = max(map(len, self.ids))
        self.rate, self.seed, self.limit = rate, seed, limit
        self._clear()

    def _clear(self):
        self.index, self.names, self.nodes, self.filled, self.slots = _Index(), [], 0, 0, 0
        self.flat, self.child = np.zeros(1 << 16, np.uint16 if self.count <= 1 << 16 else np.int32), np.zeros(1 << 16, np.int32)
        # The node of each stretch without a skip (-1 if it is not found yet, or long).
        self.root = np.zeros(0, np.int32)
        # Of each node: where its ids begin and their number, its turns, its last skipped turn, the node without that, its
        # stretch, and where the nodes begin that skip one more turn.
        self.start, self.length, self.turns, self.last, self.parent, self.stretch, self.children = (np.zeros(1 << 14, k) for k in (np.int64, np.int32, np.int16, np.int16, np.int32, np.int32, np.int64))

    def keys(self, number: int, count: int) -> np.ndarray:
        """Keys of the first places of a document."""
        own = _mixed(_mixed(np.array([self.seed & _MASK], np.uint64)) ^ np.uint64(number & _MASK))
        with np.errstate(over="ignore"):
            return (_mixed(_mixed(own) + np.arange(count, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)

    def gaps(self, keys: np.ndarray, level: int) -> np.ndarray:
        """How many turns are taken before the next is skipped (each with the rate), after as many skips."""
        with np.errstate(over="ignore", divide="ignore"):
            share = ((_mixed(keys.astype(np.uint64) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & _MASK)) >> np.uint64(11)) + np.uint64(1)).astype(float) / (1 << 53)
            return np.minimum(np.log(share) / np.log1p(-self.rate), NEVER).astype(np.int64)

    def skips(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The first skipped turns under each key, and NEVER; under the key -1 none."""
        turns = np.cumsum([self.gaps(keys, k) + (k > 0) for k in range(most)], 0).reshape(most, len(keys)).T
        return np.concatenate([np.where(keys[:, None] < 0, NEVER, turns), np.full((len(keys), 1), NEVER)], 1)

    def stretches(self, text: str) -> list[str]:
        """A text with a space before it, cut wherever no merge can join."""
        text = SPACE + text.replace(SPACE, ESCAPED).replace(" ", SPACE)
        signs = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.beside[signs[:-1], signs[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def word(self, word: str, key: int) -> list[int]:
        """Ids of one word under a key; the key -1 skips nothing."""
        n, score, heap = len(word), self.scores.get, []
        # Parts are named by their first characters.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(k: int):
            """The merge of part k and the next goes on the agenda, if there is such a piece."""
            if k >= 0 and (middle := after[k]) < n and (end := after[middle]) - k <= self.longest:
                if (found := score(word[k:end])) is not None:
                    heappush(heap, (-found, k, middle, end))

        for k in range(n - 1):
            offer(k)
        turn, level = 0, 0
        skip = int(self.gaps(np.array([key]), 0)[0]) if key >= 0 else NEVER
        while heap:
            _, k, middle, end = heappop(heap)
            if after[k] != middle or after[middle] != end:
                continue
            turn += 1
            if turn > skip:
                level += 1
                skip += 1 + int(self.gaps(np.array([key]), level)[0])
                continue
            after[k], after[middle] = end, -1
            if end < n:
                before[end] = k
            offer(k)
            offer(before[k])
        ids, found, k = self.ids, [], 0
        while k < n:
            p = word[k : after[k]]
            if p in ids:
                found.append(ids[p])
            else:
                found += [self.bytes[b] for b in p.replace(ESCAPED, SPACE).encode()]
            k = after[k]
        return found

    def many_words(self, words: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """What word gives for each of many words under keys."""
        flat, lengths, _ = self.many(words, self.skips(np.asarray(keys), 3 * max(map(len, words))))
        return np.split(flat, np.cumsum(lengths)[:-1])

    def many(self, words: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words, one after another, how many each has, and its turns; a merge of all at a time.

        skips: the turns that each word skips, and NEVER.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        signs, inverse = np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        count, width = self.count, int(lengths.max())
        numbers = np.array([self.ids.get(chr(c), count + k) for k, c in enumerate(signs.tolist())], np.int64)
        # A part lies at its first character; the column after the last stands for none.
        column = np.arange(width + 1)
        parts = np.full((len(words), width + 1), -1, np.int64)
        parts[column < lengths[:, None]] = numbers[inverse]
        after = np.broadcast_to(np.minimum(column + 1, width).astype(np.int32), parts.shape).copy()
        before = np.broadcast_to(np.where(column, column - 1, width).astype(np.int32), parts.shape).copy()

        def candidates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair = left * 2 * count + right
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            found = (self.pairs[at] == pair) & (left >= 0) & (right >= 0) & (left < count) & (right < count)
            piece = np.where(found, self.merged[at], 0)
            return np.where(found, self.rank_of[piece], 0), piece

        ranks, pieces = np.zeros(parts.shape, np.int32), np.zeros(parts.shape, np.int32)
        first = np.nonzero(parts[:, 1:] >= 0)
        ranks[first], pieces[first] = candidates(parts[first], parts[:, 1:][first])
        turn, level = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        rows = np.arange(len(words))
        while len(rows):
            own = ranks[rows]
            best = own.argmax(1)
            on = own[np.arange(len(rows)), best] > 0
            rows, best = rows[on], best[on]
            skip = skips[rows, level[rows]] == turn[rows]
            turn[rows] += 1
            level[rows[skip]] += 1
            ranks[rows, best] = 0
            r, k = rows[~skip], best[~skip]
            middle = after[r, k]
            end, head = after[r, middle], before[r, k]
            parts[r, k], parts[r, middle], ranks[r, middle] = pieces[r, k], -1, 0
            after[r, k], before[r, end] = end, k
            for left, right in ((k, end), (head, k)):
                ranks[r, left], pieces[r, left] = candidates(parts[r, left], parts[r, right])
        used = parts >= 0
        flat, lengths = parts[used], used.sum(1)
        if len(flat) and flat.max() >= count:
            spelt = {i: [self.bytes[b] for b in chr(signs[i - count]).replace(ESCAPED, SPACE).encode()] for i in np.unique(flat[flat >= count]).tolist()}
            sizes = np.ones(len(flat), np.int64)
            odd = np.flatnonzero(flat >= count)
            sizes[odd] = [len(spelt[i]) for i in flat[odd].tolist()]
            owner, ends = np.repeat(np.arange(len(words)), lengths), np.cumsum(sizes)
            lengths, old = np.bincount(owner, sizes, len(words)).astype(np.int64), flat
            flat = np.repeat(flat, sizes)
            for k in odd.tolist():
                flat[ends[k] - sizes[k] : ends[k]] = spelt[int(old[k])]
        return flat, lengths, turn

    def _learn(self, stretches: np.ndarray, parents: np.ndarray, last: np.ndarray) -> np.ndarray:
        """New nodes of stretches: what the parent (-1: none) skips, and the turn last."""
        lists, at = [np.where(parents >= 0, last.astype(np.int64), NEVER)], parents
        while (on := at >= 0).any():
            lists.append(np.where(on, np.where(self.parent[at] >= 0, self.last[at].astype(np.int64), NEVER), NEVER))
            at = np.where(on, self.parent[at], -1)
        skips = np.sort(np.stack([*lists, np.full(len(parents), NEVER)], 1), 1)
        names = [self.names[k] for k in stretches.tolist()]
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        nodes = np.arange(self.nodes, self.nodes + len(names))
        while self.nodes + len(names) > len(self.start):
            for name in ("start", "length", "turns", "last", "parent", "stretch", "children"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.nodes += len(names)
        self.last[nodes], self.parent[nodes], self.stretch[nodes] = np.where(parents >= 0, last, -1), parents, stretches
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 4096):
            group = order[at : at + 4096]
            ids, lengths, turns = self.many([names[k] for k in group.tolist()], skips[group])
            own, more = nodes[group], np.maximum(turns - 1 - self.last[nodes[group]], 0)
            while self.filled + lengths.sum() > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.slots + more.sum() > len(self.child):
                self.child = np.concatenate([self.child, np.zeros_like(self.child)])
            self.flat[self.filled : self.filled + lengths.sum()] = ids
            self.child[self.slots : self.slots + more.sum()] = -1
            self.start[own], self.length[own], self.turns[own] = self.filled + np.cumsum(lengths) - lengths, lengths, turns
            self.children[own] = self.slots + np.cumsum(more) - more
            self.filled += int(lengths.sum())
            self.slots += int(more.sum())
        return nodes

    def encode(self, docs: list[tuple[int, str]], drop: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each with a number that keys its words, one after another, and their offsets."""
        if len(self.index) > self.limit or self.nodes > 2 * self.limit:
            self._clear()
        get, numbers, keys, long = self.index.__getitem__, [], [], {}
        for number, text in docs:
            chunks = self.stretches(text) if text else []
            if max(map(len, chunks), default=0) > LONG:
                first = sum(map(len, numbers))
                long |= {first + k: c for k, c in enumerate(chunks) if len(c) > LONG}
                chunks = ["" if len(c) > LONG else c for c in chunks]
            numbers.append(np.fromiter(map(get, chunks), np.int64, len(chunks)))
            keys.append(self.keys(number, len(chunks)) if drop else np.full(len(chunks), -1))
        self.names += self.index.new
        self.index.new = []
        own, all_keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, keys))
        self.root = np.concatenate([self.root, np.full(len(self.names) - len(self.root), -1, np.int32)])
        fresh = np.unique(own[self.root[own] < 0])
        fresh = fresh[[self.names[k] != "" for k in fresh.tolist()]] if len(fresh) else fresh
        if len(fresh):
            self.root[fresh] = self._learn(fresh, np.full(len(fresh), -1), np.full(len(fresh), -1))
        node = self.root[own].astype(np.int64)
        if drop:
            # Occurrences whose next skipped turn is one of the turns of their node go on to the node that skips it too.
            on = np.flatnonzero(node >= 0)
            turn, level = self.gaps(all_keys[on], 0), 0
            while True:
                hit = turn < self.turns[node[on]]
                on, turn = on[hit], turn[hit]
                if not len(on):
                    break
                slot = self.children[node[on]] + turn - self.last[node[on]] - 1
                new, first = np.unique(slot[self.child[slot] < 0], return_index=True)
                if len(new):
                    where = np.flatnonzero(self.child[slot] < 0)[first]
                    self.child[new] = self._learn(self.stretch[node[on[where]]], node[on[where]], turn[where])
                node[on] = self.child[slot]
                level += 1
                turn = turn + 1 + self.gaps(all_keys[on], level)
        starts, lengths = self.start[node], self.length[node].astype(np.int64)
        filled = self.filled
        for k, c in long.items():  # these lie beyond what is kept, until the next call
            ids = self.word(c, int(all_keys[k]))
            while filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[filled : filled + len(ids)] = ids
            starts[k], lengths[k] = filled, len(ids)
            filled += len(ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])].astype(np.int32)
        offsets = ends[np.cumsum([0, *map(len, numbers)])]
        return flat, offsets


def piece_texts(path: str) -> list[bytes]:
    """What each piece stands for in a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(model.get_piece_size())]
    for b in range(256):
        found[model.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
    return found


def decode(ids: list[int], pieces: list[bytes]) -> bytes:
    """The text that these are ids of, without the space put before it."""
    return b"".join(map(pieces.__getitem__, ids)).removeprefix(b" ")


def encode_pieces(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 42) -> DataFrame:
    """doc_id, ids and text_sha256 (of the text that was encoded) of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(PieceCodec, model, rate, seed)
        for batch in slices(batches, budget=2 << 20):
            found = texts(batch)
            ids, offsets = codec.encode(list(zip((d or 0 for d in batch.column("doc_id").to_pylist()), found, strict=True)), rate > 0)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            sha = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, sha], ["doc_id", "ids", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, text_sha256 string")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """encoded without ids, with n_pieces, ids_crc32 and the decoded text after its columns."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(piece_texts, model)
        for batch in slices(batches, "ids"):
            lists, place = batch.column("ids"), batch.schema.get_field_index("ids")
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            new = [pa.array(np.diff(offsets), pa.int64()), pa.array([zlib.crc32(ids[a:b].data) for a, b in spans], pa.int64()), pa.array([decode(ids[a:b].tolist(), pieces).decode() for a, b in spans], pa.string())]
            rest = [c for k, c in enumerate(batch.columns) if k != place]
            yield pa.RecordBatch.from_arrays([*rest, *new], [*(n for n in batch.schema.names if n != "ids"), "n_pieces", "ids_crc32", "decoded"])

    schema = encoded.drop("ids").select("*", F.lit(0).cast("long").alias("n_pieces"), F.lit(0).cast("long").alias("ids_crc32"), F.lit("").alias("decoded")).schema
    return encoded.mapInArrow(decoded, schema)
