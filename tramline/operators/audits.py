"""Reports on a network's quality and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import planar_metres


def ordered_pairs(points: DataFrame) -> DataFrame:
    """All ordered pairs of a report's named points (some tens): origin, destination."""
    return points.select(F.col("name").alias("origin")).join(points.select(F.col("name").alias("destination")), F.col("origin") != F.col("destination"))


def coverage(pairs: DataFrame) -> DataFrame:
    """Share of pairs (origin, destination, answered, complete) by origin, by destination, and of all."""
    pct = lambda c: F.bround(F.avg(F.col(c).cast("double")) * 100, 1)
    sets = pairs.groupingSets([("origin",), ("destination",), ()], "origin", "destination")
    return sets.agg(F.count("*").alias("pairs"), pct("answered").alias("answered_pct"), pct("complete").alias("complete_pct"), F.grouping_id().cast("int").alias("level"))


def suspicious_pairs(edges: DataFrame, least_m: float = 300.0, speed: float = 8.0, limit: int | None = None) -> DataFrame:
    """Pairs of stops that some surface route joins faster than speed (m/s), the fastest first."""
    far = edges.where(F.col("vehicle_type").isin("bus", "minibus", "microbus") & (F.col("dist_m") >= least_m))
    best = far.groupBy("u", "v").agg(F.min("sec").alias("sec"), F.first("dist_m").alias("dist_m")).withColumn("speed", F.when(F.col("sec") > 0, F.col("dist_m") / F.col("sec")).otherwise(0.0))
    found = best.where(F.col("speed") > speed)
    return found.orderBy(F.desc("speed"), "u", "v").limit(limit) if limit else found


def barriers(pairs: DataFrame, road: DataFrame, every_m: float = 60.0, end_m: float = 150.0, gap_m: float = 180.0, ratio: float = 2.5, cell: float = 0.002, rings: int = 2) -> DataFrame:
    """Walking pairs (u, v, dist_m, lat1, lon1, lat2, lon2) with road near both ends but far from the middle.

    Distances to the nearest road point (lat, lon) are looked for in the cells around a place; none found counts as the
    farthest that the cells can tell.
    """
    steps = F.greatest(F.lit(3), (F.col("dist_m") / every_m).cast("int"))
    sampled = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), steps))).withColumn("f", F.col("i") / steps).withColumn("end", (F.col("i") == 0) | (F.col("i") == steps))
    at = sampled.select("u", "v", "dist_m", "i", "end", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("f")).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.col("f")).alias("lon"))
    cells = lambda df: df.withColumns({"cx": F.floor(F.col("lat") / cell), "cy": F.floor(F.col("lon") / cell)})
    around = F.explode(F.sequence(F.lit(-rings), F.lit(rings)))
    near = cells(at).withColumn("dx", around).withColumn("dy", around).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})
    points = cells(road.select("lat", "lon").distinct()).select("cx", "cy", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    gap = near.join(points, ["cx", "cy"], "left").groupBy("u", "v", "dist_m", "i", "end").agg(F.coalesce(F.min(planar_metres(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))), F.lit(rings * cell * 111000.0)).alias("gap"))
    judged = gap.groupBy("u", "v").agg(F.max(F.when(F.col("end"), F.col("gap"))).alias("ends"), F.max(F.when(~F.col("end"), F.col("gap"))).alias("worst"))
    return judged.where((F.col("ends") <= end_m) & (F.col("worst") >= gap_m) & (F.col("worst") >= F.greatest(F.col("ends"), F.lit(30.0)) * ratio))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many answers (pair_id, minutes) got better, worse, or stayed."""
    both = before.join(after.withColumnRenamed("minutes", "new"), "pair_id")
    return both.groupBy(F.when(F.col("new") < F.col("minutes"), "better").when(F.col("new") > F.col("minutes"), "worse").otherwise("same").alias("outcome")).agg(F.count("*").alias("pairs"))


def upper_median(values: str):
    """The upper of the two middle values of an even number of them, from counts of the values."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{values})")


def far_pairs(points: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """Of the farthest quarter of pairs of a bounded set of points (name, lat, lon), k drawn by a seeded hash."""
    from tramline.functions.geo import haversine

    a = points.select(F.col("name").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select(F.col("name").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("m", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    edge = pairs.agg(F.percentile("m", 0.75).alias("edge"))
    return pairs.join(edge, F.col("m") >= F.col("edge")).orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b").limit(k).select("a", "b", "m")


def tally(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.bround(100 * F.count("*") / F.sum(F.count("*")).over(Window.partitionBy()), 1).alias("pct"))


def frequency_order(rows: DataFrame, key: str) -> DataFrame:
    """Values with how often they occur, the most frequent first, and of equals the one that comes first in the alphabet."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def resolved_shares(matches: DataFrame) -> DataFrame:
    """Corridors by the share of their landmarks (corridor_id, how) that were matched to a stop."""
    share = F.avg((~F.col("how").isin("road", "unresolved")).cast("double"))
    each = matches.groupBy("corridor_id").agg(share.alias("share"))
    bucket = F.when(F.col("share") >= 0.8, ">=80%").when(F.col("share") >= 0.6, ">=60%").when(F.col("share") >= 0.4, ">=40%").otherwise("<40%")
    return each.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("corridors"))


def answered(options: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (od_id, origin, destination) with whether an option (od_id, kind) rides at all (answered), and whether one does
    that is not partial (complete)."""
    rides = F.max(~F.col("kind").isin("walk", "none")).alias("answered")
    whole = F.max(~F.col("kind").isin("walk", "none", "partial")).alias("complete")
    found = options.groupBy("od_id").agg(rides, whole)
    return pairs.join(found, "od_id", "left").select("od_id", "origin", "destination", F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce("complete", F.lit(False)).alias("complete"))
