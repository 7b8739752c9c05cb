"""Quality of texts: histogram gradient-boosted trees over document statistics, in numpy.

Every statistic is one of the whole text. Trees are grown level by level on binned statistics of a bounded sample of
labelled documents, with second-order gains; they are then flattened into arrays of features, thresholds and leaves, and
all documents of a batch walk down a tree together, a level at a time.

Defined results: null and empty texts have the statistics of an empty text; repeated rows are scored each; an empty
table gives no rows; without labels of both classes the score is constant; a column that has the name of a result is
replaced by it, and all others are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.toxicity import labelled_sample, named, scored

#: Labelled documents, and bytes of their texts, that training gathers at most (they are drawn by a hash of their id).
SAMPLE_DOCS, SAMPLE_BYTES = 8000, 24 << 20

STATISTICS = ["bytes", "words", "mean_word", "long_words", "upper", "digits", "punctuation", "odd_signs", "high_bytes", "white", "distinct_words", "top_word", "repeated_word", "lines", "mean_line", "repeated_lines", "bars", "stops", "capital_words", "signed_words", "short_words"]
_class = np.zeros((9, 256))
for _k, _bytes in enumerate((range(65, 91), range(48, 58), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#$%&*<>=@^~\\{}[]", range(128, 256), b" \t\n\r", b"|", b".", b"!?")):
    _class[_k, list(_bytes)] = 1


def statistics(text: bytes) -> list[float]:
    n, words = max(1, len(text)), text.split()
    upper, digits, punctuation, odd, high, white, bars, stops, marks = (_class @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    m, counts, lengths = max(1, len(words)), Counter(words), np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words[1:], words))
    return [
        len(text), len(words), float(lengths.sum()) / m, float((lengths > 12).sum()) / m, upper / n, digits / n, punctuation / n, odd / n, high / n, white / n,
        len(counts) / m, max(counts.values(), default=0) / m, same / m, len(lines), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), bars / m, stops / m,
        sum(w[:1].isupper() for w in words) / m, marks / m, float((lengths < 3).sum()) / m,
    ]


class Trees:
    """features, thresholds: of the inner nodes of complete trees, in order of level; leaves: of each tree."""

    def __init__(self, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray, start: float):
        self.features, self.thresholds, self.leaves, self.start = features, thresholds, leaves, start

    def odds(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.full(len(rows), self.start), np.arange(len(rows))
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(int(np.log2(len(leaves)))):
                node = 2 * node + 1 + (rows[each, features[node]] > thresholds[node])
            total += leaves[node - len(features)]
        return total


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least: float = 3.0) -> Trees:
    n, width = rows.shape if len(rows) else (0, len(STATISTICS))
    inner = 2**depth - 1
    share = (labels.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if not n or labels.min() == labels.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1)  # above cut k: bin > k
    odds, found = np.full(n, start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = p - labels, np.maximum(p * (1 - p), 1e-6)
        features, thresholds, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = (node - first)[:, None] * width * bins + np.arange(width) * bins + binned
            sums = [np.bincount(at.ravel(), np.repeat(x, width), count * width * bins).reshape(count, width, bins).cumsum(2) for x in (g, h)]
            (gl, hl), (ga, ha) = sums, (x[:, :, -1:] for x in sums)
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[k, f, cut] > 1e-9 and cut < len(cuts[f]):
                    features[first + k], thresholds[first + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (rows[np.arange(n), features[node]] > thresholds[node])
        leaf = node - inner
        leaves = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        odds += leaves[leaf]
        found.append((features, thresholds, leaves))
    return Trees(*(np.stack(x) for x in zip(*found, strict=True)), start)


def learn_quality(docs: DataFrame, labels: DataFrame, learn=None, docs_most: int = SAMPLE_DOCS, bytes_most: int = SAMPLE_BYTES) -> Trees:
    """learn: a condition on documents whose labels may be used (all, if none)."""
    texts, marks = labelled_sample(docs, labels, "quality", F.lit(True) if learn is None else learn, docs_most, bytes_most)
    return grow(np.array([statistics(t) for t in texts]), marks)


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, with quality_score double and quality_predicted int (1 from the threshold on) after them."""
    score = lambda texts: 1 / (1 + np.exp(-model.odds(np.array([statistics(t) for t in texts]))))
    return named(scored(docs, lambda: score, threshold), docs.columns, "quality")
