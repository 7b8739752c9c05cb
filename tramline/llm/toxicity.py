"""Toxicity of texts: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (four to six characters, with marks for the
word's ends), so an unseen misspelling shares most of its vector with the word it stands for. What is longer than a
word of any language (text without spaces) is cut into overlapping pieces that count as words. The vectors of a
window's words are averaged and go through a linear softmax; a text's score is that of its most toxic window, so a long
text does not dilute a few words. All windows of the whole text are scored. Vectors and softmax are learnt together by
Adam on the windows that decide the scores of a bounded sample of labelled documents. All of them start at random: vectors
with a deviation of 0.001, the softmax's weights with one of 16, so that a small step of a vector moves a score. Vectors of
n-grams that occur in both classes about as often as any other stay at zero, as they tell nothing.

Defined results: null, empty or white texts have no words and get the score of no evidence (the softmax's bias);
repeated rows are scored each; an empty table gives no rows; without labels of both classes the score is constant; a
column that has the name of a result is replaced by it, and all others are kept, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.batches import byte_texts, give_back, slices
from tramline.llm.tokens import _Index

BUCKETS = 1 << 18
#: Characters of the n-grams. N-grams in fewer of the sampled documents than LEAST_DOCS keep the weight zero (they tell
#: documents apart, not classes), as do those in a class less than TELLS standard deviations more or less than expected.
GRAMS, LEAST_DOCS, TELLS = (4, 5, 6), 3, 4.0
#: Words in a window; windows start at every half of it.
WINDOW = 32
#: Characters of a word that is scored in one piece, and characters that a longer one's pieces share.
LONG, LAP = 62, max(GRAMS) - 1
#: Labelled documents, and bytes of their texts, that training gathers at most (they are drawn by a hash of their id).
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 11 << 20


def subwords(word: bytes) -> list[int]:
    """Buckets of a word's character n-grams."""
    text = f"<{word.decode('utf-8', 'replace').lower()}>"
    return [zlib.crc32(text[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(max(1, len(text) - n + 1))]


def pieces(word: bytes) -> list[bytes]:
    """A word of up to LONG characters; a longer one (of a script without spaces, or joined words) in pieces of as many.

    Each piece repeats the last LAP characters of the one before, so that each n-gram of the word is in a piece.
    """
    if len(word) <= LONG or len(text := word.decode("utf-8", "replace")) <= LONG:
        return [word]
    return [text[k : k + LONG].encode() for k in range(0, len(text) - LAP, LONG - LAP)]


class WordBags:
    """Numbers distinct words and holds the n-gram buckets of each."""

    def __init__(self):
        self.index = _Index()

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(text) > LONG and max(map(len, words), default=0) > LONG:
            words = [p for w in words for p in pieces(w)]
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def new(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words seen since the last call, one after another, and where each word's begin."""
        words, self.index.new, lengths = self.index.new, [], []

        def each():
            for w in words:
                found = subwords(w)
                lengths.append(len(found))
                yield from found

        buckets = np.fromiter(each(), np.int32)
        return buckets, np.cumsum([0, *lengths])


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and document of each window; documents lie one after another."""
    per = np.where(lengths > 0, np.maximum(1, -(-(lengths - WINDOW // 2) // (WINDOW // 2))), 0)
    docs = np.repeat(np.arange(len(lengths)), per)
    firsts = np.cumsum(lengths) - lengths
    k = np.arange(len(docs)) - np.repeat(np.cumsum(per) - per, per)
    begin = firsts[docs] + k * (WINDOW // 2)
    end = np.minimum(begin + WINDOW, firsts[docs] + lengths[docs])
    begin = np.maximum(firsts[docs], end - WINDOW)
    return begin, end, docs


class Model:
    """weights: of each bucket in the softmax's log-odds (its vector times the difference of the softmax's rows)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def words(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        return np.add.reduceat(self.weights.astype(np.float32)[buckets], starts[:-1]) / np.diff(starts)

    def texts(self, word_scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of each document, and the deciding window of each that has one: its document and first word."""
        begin, end, docs = windows(lengths)
        sums = np.concatenate([[0], np.cumsum(word_scores)])
        means = (sums[end] - sums[begin]) / np.maximum(end - begin, 1)
        if not len(docs):
            return np.full(len(lengths), self.bias), docs, docs
        opens = np.flatnonzero(np.diff(docs, prepend=-1))
        best = np.repeat(np.maximum.reduceat(means, opens), np.diff(opens, append=len(docs)))
        hits = np.flatnonzero(means == best)
        first = hits[np.diff(docs[hits], prepend=-1) > 0]
        odds = np.full(len(lengths), self.bias)
        odds[docs[first]] += means[first]
        return odds, first, docs[first]


def train(texts: list[bytes], labels: np.ndarray, dim: int = 4, rounds: int = 100, rate: float = 0.1, decay: float = 1e-5, drop: float = 0.3, scale: float = 16.0, seed: int = 42) -> Model:
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        share = float(np.mean(labels)) if len(labels) else 0.5
        return Model(np.zeros(BUCKETS), float(np.log((share + 0.01) / (1.01 - share))))
    bags = WordBags()
    numbers = [bags.numbers(t) for t in texts]
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.concatenate(numbers)
    buckets, starts = bags.new()
    all_sizes = np.diff(starts)
    begin, end, _ = windows(lengths)
    # In how many clean and toxic documents each n-gram is.
    seen = np.zeros((2, BUCKETS))
    for found, label in zip(numbers, labels, strict=True):
        words = np.unique(found)
        sizes = all_sizes[words]
        seen[label, np.unique(buckets[np.repeat(starts[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())])] += 1
    in_docs, share = seen.sum(0), labels.mean()
    tells = (in_docs >= LEAST_DOCS) & (np.abs(seen[1] - in_docs * share) >= TELLS * np.sqrt(in_docs * share * (1 - share)))
    # Of each word, the n-grams that tell something; what it is averaged over stays the number of all.
    known = tells[buckets]
    own = np.bincount(np.repeat(np.arange(len(all_sizes)), all_sizes)[known], minlength=len(all_sizes))
    owner, buckets, starts = np.repeat(np.arange(len(own)), own), buckets[known], np.cumsum(own) - own
    vectors = rng.normal(0, 0.001, (BUCKETS, dim)).astype(np.float32) * tells[:, None]
    softmax = rng.normal(0, scale, (dim, 2)).astype(np.float32)
    bias = np.array([1.0, -1.0], np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, softmax, bias)]
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for t in range(1, rounds + 1):
        model = Model(vectors @ (softmax[:, 1] - softmax[:, 0]), bias[1] - bias[0])
        word_scores = np.bincount(owner, model.weights[buckets], len(own)) / all_sizes
        odds, first, docs = model.texts(word_scores[flat], lengths)
        error = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - labels) * balance / len(labels)
        # Buckets of the deciding windows' words, each with its share of the document's average.
        b, e = begin[first], end[first]
        word_at = np.repeat(b, e - b) + np.arange((e - b).sum()) - np.repeat(np.cumsum(e - b) - (e - b), e - b)
        words, weight = flat[word_at], np.repeat(error[docs] / (e - b), e - b) * (rng.random(len(word_at)) >= drop)
        sizes = own[words]
        at = np.repeat(starts[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        push = np.bincount(buckets[at], np.repeat(weight / all_sizes[words], sizes), BUCKETS)  # of each bucket on the loss, for a unit of log-odds
        pull = vectors.T @ push
        grads = [np.outer(push.astype(np.float32), softmax[:, 1] - softmax[:, 0]) + decay * vectors, np.stack([-pull, pull], 1) + decay * softmax, error.sum() * np.array([-1.0, 1.0])]
        for p, g, (m, v) in zip((vectors, softmax, bias), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))


def fold(doc_id, folds: int, left_out: int):
    """Whether a document is held out: by the crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == left_out, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, docs_most: int, bytes_most: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a bounded sample of the documents to learn from: as many of each label, drawn by a hash of
    their id.

    Only ids and sizes decide what is gathered, before any text moves: rows in order of the hash, as far as the bounds
    go. A text over a thirtieth of bytes_most is passed over, as it would take the place of many others.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sized = docs.where(learn & (size <= bytes_most // 30)).select("doc_id", size.alias("size")).join(known, "doc_id")
    ids = {}
    for mark in (0, 1):
        total = 0
        for r in sized.where(F.col("label") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_most // 2).collect():
            total += r["size"]
            if total <= bytes_most // 2:
                ids[r["doc_id"]] = mark
    if not ids:
        return [], np.zeros(0, np.int64)
    rows = docs.where(learn & F.col("doc_id").isin(list(ids)) & (size <= bytes_most // 30)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).limit(docs_most).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"].encode() for r in rows], np.array([ids[r["doc_id"]] for r in rows], np.int64)


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn=None, docs_most: int = SAMPLE_DOCS, bytes_most: int = SAMPLE_BYTES) -> Model:
    """learn: a condition on documents whose labels may be used (all, if none)."""
    learn = F.lit(True) if learn is None else learn
    return train(*labelled_sample(docs, labels, "toxic", learn, docs_most, bytes_most))


def _scorer(weights: np.ndarray, bias: float, limit: int = 300_000) -> Callable[[list[bytes]], np.ndarray]:
    """Scores of texts, with those of up to limit distinct words kept between calls."""
    model, bags, known = Model(weights.astype(np.float64), bias), WordBags(), np.zeros(0)

    def score(texts: list[bytes]) -> np.ndarray:
        nonlocal bags, known
        if len(bags.index) > limit:
            bags, known = WordBags(), np.zeros(0)
        numbers = [bags.numbers(t) for t in texts]
        known = np.concatenate([known, model.words(*bags.new())])
        odds = model.texts(known[np.concatenate(numbers)], np.fromiter(map(len, numbers), np.int64, len(numbers)))[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    return score


def scored(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], threshold: float) -> DataFrame:
    """doc (a row of docs), score double and predicted int (1 from the threshold on). make gives a task its scorer."""
    inner = docs.select(F.struct("*").alias("doc"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(stored=True)
        score = make()
        for batch in slices(batches):
            scores = score(byte_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc", "score", "predicted"])

    return inner.mapInArrow(each, inner.select("doc", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def named(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The columns of docs, and name_score and name_predicted in the place of any that are called so."""
    results = [F.col("score").alias(f"{name}_score"), F.col("predicted").alias(f"{name}_predicted")]
    return rows.select(*[F.col("doc")[c].alias(c) for c in columns if c not in (f"{name}_score", f"{name}_predicted")], *results)


def _toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # BUCKETS numbers
    return scored(docs, lambda: _scorer(*shared.value), threshold)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, with toxic_score double and toxic_predicted int (1 from the threshold on) after them."""
    return named(_toxic(docs, model, threshold), docs.columns, "toxic")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score less than the threshold."""
    return _toxic(docs, model, threshold).where("predicted = 0").select("doc.*")
