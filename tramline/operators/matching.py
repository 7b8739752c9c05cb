"""Matching of landmark names to stops: a cascade from sure to doubtful ways, each for what the ones before left."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tramline.functions import constants as C
from tramline.functions import text as X
from tramline.session import materialize


def name_index(stops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys to stops (stop_id, name_ar, name_en): exact, normalised, and aliases given in parentheses.

    An alias counts if it is no bare name or key of its own; otherwise it says where a stop is.
    """
    named = stops.select("stop_id", F.explode(F.array("name_ar", "name_en")).alias("name")).where("name IS NOT NULL AND name <> ''")
    forms = named.select("stop_id", F.explode(X.variants(F.col("name"))).alias("form"))
    exact = forms.select(F.col("form").alias("key"), "stop_id").distinct()
    normed = forms.select(X.normalise(F.col("form")).alias("key"), "stop_id").where("key <> ''").distinct()
    inner = named.select("stop_id", F.explode(X.in_parentheses(F.col("name"))).alias("form")).select(X.normalise(F.col("form")).alias("key"), "stop_id")
    alias = inner.where(F.length("key") >= 4).join(normed.select("key"), "key", "left_anti").distinct()
    return exact, normed, alias


def contains_match(landmarks: DataFrame, normed: DataFrame) -> DataFrame:
    """For each key (landmark, key), the stop key of the nearest length that holds it or lies in it, if long enough.

    Strings that hold one another share all n-grams of the shorter; both sides are joined on the first and any n-gram
    of CONTAINS_CHARS characters, so only keys with a common stretch are compared.
    """
    n = C.CONTAINS_CHARS
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    long_enough = lambda df, c: df.where(F.length(c) >= n)
    names = long_enough(normed.groupBy("key").agg(F.min("stop_id").alias("stop_id")).select(F.col("key").alias("name"), "stop_id"), "name")
    marks = long_enough(landmarks.select("landmark", "key").distinct(), "key")
    inside = marks.withColumn("g", F.substring("key", 1, n)).join(names.withColumn("g", F.explode(F.array_distinct(grams(F.col("name"))))), "g").where(F.contains("name", "key"))
    around = marks.withColumn("g", F.explode(F.array_distinct(grams(F.col("key"))))).join(names.withColumn("g", F.substring("name", 1, n)), "g").where(F.contains("key", "name"))
    both = inside.unionByName(around).where("name <> key").withColumn("ratio", F.least(F.length("name"), F.length("key")) / F.greatest(F.length("name"), F.length("key")))
    good = both.where(F.col("ratio") >= C.CONTAINS_RATIO)
    best = good.groupBy("landmark", "key").agg(F.min(F.struct(F.abs(F.length("name") - F.length("key")).alias("gap"), "name", "stop_id")).alias("b"))
    return best.select("landmark", "key", "b.stop_id", F.col("b.name").alias("matched"))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy(landmarks: DataFrame, normed: DataFrame, least: float = C.FUZZY_LEAST, most: int = 1) -> DataFrame:
    """The most alike keys of each landmark (landmark, key), with a ratio of least or more.

    Strings so alike have lengths l and m with 2 min / (l + m) >= least, and share a pair of neighbouring characters:
    pairs are joined on those, then filtered by length, and by the characters that they share in any order, which are
    no fewer than those that match, before the ratio is computed.
    """
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    left = landmarks.select("landmark", "key").where(F.length("key") > 1).distinct()
    right = normed.groupBy(F.col("key").alias("name")).agg(F.min("stop_id").alias("stop_id")).where(F.length("name") > 1)
    met = left.withColumn("g", F.explode(pairs(F.col("key")))).join(right.withColumn("g", F.explode(pairs(F.col("name")))), "g")
    close = met.where(2 * F.least(F.length("key"), F.length("name")) >= least * (F.length("key") + F.length("name"))).select("landmark", "key", "name", "stop_id").distinct()
    times = lambda text, c: F.length(text) - F.length(F.replace(F.col(text), c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split("key", "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times("key", c), times("name", c))))
    close = close.where(2 * shared >= least * (F.length("key") + F.length("name")))
    scored = close.withColumn("score", similarity("key", "name")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("landmark", "key").orderBy(F.desc("score"), "name"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def cascade(landmarks: DataFrame, stops: DataFrame) -> DataFrame:
    """landmark, how and candidates (at most 12 stops) of each landmark (a text)."""
    exact, normed, alias = (materialize(x, "name-index") for x in name_index(stops))
    marks = materialize(landmarks.select("landmark").distinct().withColumn("key", X.normalise(X.nfkc(F.col("landmark")))), "landmarks")
    found = marks.where(X.is_road(F.col("key"))).select("landmark", F.lit("road").alias("how"), F.array().cast("array<bigint>").alias("candidates"))

    def take(matches: DataFrame, how: str) -> DataFrame:
        stops_of = F.slice(F.sort_array(F.collect_set("stop_id")), 1, C.CANDIDATES)
        return matches.groupBy("landmark").agg(stops_of.alias("candidates")).select("landmark", F.lit(how).alias("how"), "candidates")

    for how, step in (
        ("exact", lambda m: m.join(exact, m["landmark"] == exact["key"]).select("landmark", "stop_id")),
        ("normalised", lambda m: m.join(normed, "key").select("landmark", "stop_id")),
        ("alias", lambda m: m.join(alias, "key").select("landmark", "stop_id")),
        ("contains", lambda m: contains_match(m, normed).select("landmark", "stop_id")),
        ("fuzzy", lambda m: fuzzy(m, normed).select("landmark", "stop_id")),
    ):
        found = materialize(found.unionByName(take(step(marks.join(found.select("landmark"), "landmark", "left_anti")), how)), "matched")
    rest = marks.join(found.select("landmark"), "landmark", "left_anti").select("landmark", F.lit("unresolved").alias("how"), F.array().cast("array<bigint>").alias("candidates"))
    return found.unionByName(rest)
