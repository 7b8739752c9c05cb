"""Collocations: phrases of two to four words that occur together far more often than their parts do apart, by language.

Phrases get names by hierarchical pair naming. Texts are cut into chunks of a bounded size (or one longer text), each a
sequence of small numbers and a table of the distinct words they stand for. Each chunk asks once for each of its distinct
words: rows meet by language and word, and words frequent enough get a name in all of the corpus, which is sent back to the
chunks that hold it. A phrase of k words is then a pair of names next to each other, of k - 1 words each and overlapping in all
but their ends; the distinct pairs of a chunk, counted, are asked for likewise. No phrase is as frequent as asked for
unless both of its names are, so pairs with a rare one are left out at once, and no phrase is lost. The two names of a pair
are its parents: their chains give the counts of all first and last parts for the cuts. A phrase of k words lies within a
longer one that is almost as frequent only if it is a parent of one of k + 1 words that is, as that one is at least as
frequent; so children alone decide on subsumption.

Names go by written tables, so they stay the same if an executor is lost. No group of rows is collected but a chunk's names,
which are at most as many as its words. Counts are whole numbers; scores are decimals of 38 digits.

Defined results: a null text is empty, a null language `und`; pieces without words count nothing; a text without a piece end is
one piece, however long; rows that repeat count each; an empty table, and languages without frequent phrases, give no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.batches import byte_texts, slices, texts
from tramline.session import materialize, release

# What ends a piece, and what sets words apart.
PIECE_ENDS, WORD = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"

#: Bytes of text that a task gathers before it writes a chunk for each language.
CHUNK_BYTES = 32 << 20
#: A name is the place where a phrase was first met: a chunk's number, and in so many low bits the phrase's number in it.
PLACE_BITS = 28
#: Steps by which the rows of a language are narrowed to its first: shares of a language that are ranked apart.
RANKED_APART = (512, 8)

_END = re.compile(rb"[.,;:!?\n-\r]+")
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_GAP = b"."  # no word holds it


def _packed(sequence: np.ndarray) -> bytes:
    """A sequence of 32-bit numbers, compressed, after its length in bytes."""
    raw = sequence.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(sequence: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(sequence[8:], int.from_bytes(sequence[:8], "little"), "zstd", asbytes=True), np.int32)


class _Chunk:
    """Texts of one language as a sequence of numbers, 0 between pieces, and the words that the numbers stand for."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.numbers[_GAP] = 0
        self.runs: list[np.ndarray] = []

    def add(self, text: bytes) -> None:
        words = _END.sub(b" . ", text.translate(_LOWER)).split()  # splits at space, tab and what ends a piece anyway
        words.append(_GAP)
        self.runs.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))

    def row(self) -> tuple[bytes, list[bytes], np.ndarray]:
        sequence = np.concatenate(self.runs)
        counts = np.bincount(sequence, minlength=len(self.numbers))[1:]
        return _packed(sequence), [w for w in self.numbers if w != _GAP], counts


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (lang, text) rows: lang, sequence, words and counts of each word."""
    chunks: defaultdict[str, _Chunk] = defaultdict(_Chunk)
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, chunk in chunks.items():
            sequence, words, counts = chunk.row()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([sequence], pa.binary()), pa.ListArray.from_arrays([0, len(words)], pa.array(words, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64()))],
                names=["lang", "sequence", "words", "counts"],
            )
        chunks.clear()

    for batch in slices(batches):
        for lang, text in zip(texts(batch, "lang"), byte_texts(batch), strict=True):
            chunks[lang].add(text)
            held += len(text)
            if held >= CHUNK_BYTES:
                yield from flushed()
                held = 0
    yield from flushed()


def _pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where numbers above 0 follow each other, the number of the distinct pair that begins there, from 1, else 0; then the
    distinct pairs' left and right numbers."""
    both = np.zeros(len(at), bool)
    np.logical_and(at[:-1] > 0, at[1:] > 0, out=both[:-1])
    where = np.flatnonzero(both)
    keys = at[where].astype(np.int64) << 32 | at[where + 1]
    pairs = np.unique(keys)
    if len(pairs) >= 1 << PLACE_BITS:
        raise ValueError("one text has too many different phrases")
    begins = np.zeros(len(at), np.int32)
    for k in range(0, len(keys), 1 << 20):  # a part at a time: numbers of all would take as much memory again, twice
        begins[where[k : k + (1 << 20)]] = np.searchsorted(pairs, keys[k : k + (1 << 20)]) + 1
    return begins, pairs >> 32, pairs & 0xFFFFFFFF


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each chunk (chunk, sequence, names), with their numbers in it and their counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            chunk, names = batch.column("chunk")[k].as_py(), batch.column("names")[k].values.to_numpy()
            begins, left, right = _pairs(_unpacked(batch.column("sequence")[k].as_py()))
            counts = np.bincount(begins, minlength=len(left) + 1)[1:]
            del begins
            places = np.arange(1, len(left) + 1) + (chunk << PLACE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(names[left - 1]), pa.array(names[right - 1]), pa.array(counts.astype(np.int32))], names=["place", "left", "right", "n"])
            pa.default_memory_pool().release_unused()


def _told(paired: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks (chunk, sequence, named) with only the numbers that have got names, of words or (paired) of the pairs of the
    numbers: chunk, sequence, and names in order of the new numbers. Of what has no name, one 0 is kept."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                named = batch.column("named")[k].values
                nos, names = named.field("no").to_numpy(), named.field("name")
                numbers = _unpacked(batch.column("sequence")[k].as_py())
                if paired:
                    numbers = _pairs(numbers)[0]
                known = np.zeros(max(int(numbers.max(initial=0)), int(nos.max(initial=0))) + 1, np.int32)
                known[nos] = np.arange(1, len(nos) + 1)
                at = known[numbers]
                kept = at > 0
                kept[1:] |= at[:-1] > 0
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(k, 1), pa.array([_packed(at[kept])], pa.binary()), pa.ListArray.from_arrays([0, len(nos)], names)], names=["chunk", "sequence", "names"])
                pa.default_memory_pool().release_unused()

    return told


def _named(asked: DataFrame, by: list[str], least: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """asked: place (a chunk's number and, in the low bits, the thing's in it), n and the columns by which the same things meet. Returns the frequent things (by, f and name) and,
    for each chunk, its numbers' names (named), and the written table that both read.

    A thing is met at most once a chunk, so no group is large next to the rows of all chunks."""
    same = Window.partitionBy(*by)
    counted = asked.withColumns({"f": F.sum("n").over(same), "name": F.min("place").over(same)}).where(F.col("f") >= least)
    first = F.col("name") == F.col("place")  # one row of each thing tells what it is
    chunk, no = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    met = materialize(counted.select(chunk.alias("chunk"), no.alias("no"), "name", *[F.when(first, F.col(c)).alias(c) for c in (*by, "f")]), f"met{level}")
    replies = met.groupBy("chunk").agg(F.collect_list(F.struct("no", "name")).alias("named"))
    return met.where("f IS NOT NULL").select(*by, "f", "name"), replies, met


def phrases(docs: DataFrame, least: int, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words that occur `least` times or more: lang, size, name, left, right, f, phrase, last
    (its last word), firsts and lasts (counts of its first and last 1, 2, ... words); and n, all words, of each lang."""
    texts_of = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cut = materialize(texts_of.mapInArrow(_cut, "lang string, sequence binary, words array<string>, counts array<long>").withColumn("at", F.monotonically_increasing_id()), "chunks")
    # Chunks are numbered on from task to task: the counts of the tasks are as many rows as there are tasks, so they are broadcast.
    task = F.shiftright("at", 33)
    tasks = cut.groupBy(task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("chunks"))
    before = F.coalesce(F.sum("chunks").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = cut.join(F.broadcast(tasks.select("task", (before - F.col("first")).alias("shift"))), task == F.col("task")).withColumn("chunk", F.col("at") + F.col("shift"))
    total = cut.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    total = materialize(total, "totals")
    asked = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "w")).select((F.shiftleft("chunk", PLACE_BITS) + F.col("no") + 1).alias("place"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    things, replies, met = _named(asked, ["lang", "word"], least, 1)
    none = F.lit(None).cast("long")
    levels = [materialize(things.select("lang", F.lit(1).alias("size"), "name", none.alias("left"), none.alias("right"), "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("firsts"), F.array("f").alias("lasts")), "level1")]
    told = cut
    for size in range(2, longest + 1):
        whole, last_met = told, met
        told = (chunks if size == 2 else told).select("chunk", "sequence").join(replies, "chunk").mapInArrow(_told(size > 2), "chunk long, sequence binary, names array<long>")
        told = materialize(told, f"told{size}")
        release(last_met)  # what the last level was made of has been written
        release(whole)
        asked = told.mapInArrow(_asked, "place long, left long, right long, n int")
        things, replies, met = _named(asked, ["left", "right"], least, size)
        below = levels[-1]
        left = below.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("head"), "firsts")
        right = below.select(F.col("name").alias("right"), "last", "lasts")
        told_of = things.join(left, "left").join(right, "right")
        own = F.array("f")
        levels.append(materialize(told_of.select("lang", F.lit(size).alias("size"), "name", "left", "right", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("firsts", own).alias("firsts"), F.concat("lasts", own).alias("lasts")), f"level{size}"))
    release(told)
    release(met)
    return reduce(DataFrame.unionByName, levels), total


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, longest: int = 4, covered_percent: int = 80) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a (its count), l and r (those of the parts at its weakest cut), n
    (all words of the language) and score, floor(2,000,000 a / (l + r))."""
    found, total = phrases(docs, least, longest)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    many = found.where("size >= 2")
    # A phrase is dropped for a child that is almost as frequent. A name is a number of its level alone.
    parents = many.select((F.col("size") - 1).alias("size"), F.explode(F.array("left", "right")).alias("name"), "f").groupBy("size", "name").agg(F.max("f").alias("longer"))
    kept = many.join(parents, ["size", "name"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("f") * covered_percent))
    cut = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    l, r = F.expr("firsts[cut - 1]"), F.expr("lasts[size - cut - 1]")
    scored = cut.select("lang", "size", "name", "phrase", F.col("f").alias("a"), "cut", l.alias("l"), r.alias("r")).withColumn("score", F.expr("(cast(a as decimal(28,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    best = scored.groupBy("lang", "size", "name").agg(F.min(F.struct("score", "cut", "phrase", "a", "l", "r")).alias("b")).select("lang", "b.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = materialize(best, "scored")
    for apart in RANKED_APART:
        share = Window.partitionBy("lang", "share").orderBy(*order)
        best = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(apart))).withColumn("at", F.row_number().over(share)).where(F.col("at") <= first).drop("share", "at")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 30, first: int = 2000, covered_percent: int = 80) -> str:
    """The same as DuckDB SQL over the table documents."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{PIECE_ENDS}')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '{WORD}') AS w FROM pieces),
grams AS (
  SELECT lang, size, list_slice(w, i, i + size - 1) AS g
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
counted AS (SELECT lang, size, g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY 1),
candidates AS (SELECT * FROM counted WHERE size >= 2 AND f >= {least}),
within AS (
  SELECT lang, part, max(f) AS longer
  FROM (SELECT lang, f, list_slice(g, i, i + m - 1) AS part
        FROM (SELECT lang, g, f, size, m, unnest(range(1, size - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE size > m))
  GROUP BY 1, 2),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN within x ON x.lang = c.lang AND x.part = c.g
  WHERE x.longer IS NULL OR 100::HUGEINT * x.longer < {covered_percent}::HUGEINT * c.f),
cuts AS (SELECT lang, g, f, size, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.g, c.f AS a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, c.k) JOIN counted r ON r.lang = c.lang AND r.g = list_slice(c.g, c.k + 1, c.size)),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {first}
"""
