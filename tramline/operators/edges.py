"""Riding times of a network's edges from noisy timetables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import constants as C
from tramline.functions.geo import haversine
from tramline.session import dealt

EDGE = ("u", "v", "route_id", "direction_id")


def hops(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Pairs of stops that follow each other in a trip, with distance and timetable seconds. Equal stops give none.

    The window needs each trip's rows together: one shuffle by trip. Stops and routes are small next to stop times,
    and Spark broadcasts or shuffles them by their size.
    """
    order = Window.partitionBy("trip_id").orderBy("seq")
    pairs = stop_times.select("trip_id", "seq", F.col("stop_id").alias("u"), F.lead("stop_id").over(order).alias("v"), (F.lead("t").over(order) - F.col("t")).alias("dt")).where("u <> v")
    place = lambda k: stops.select(F.col("stop_id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    known = pairs.join(place("u"), "u").join(place("v"), "v").join(trips.select("trip_id", "route_id", "direction_id"), "trip_id").join(routes.select("route_id", "rail", "reconstructed", "vehicle_type"), "route_id")
    return known.withColumn("dist_m", haversine(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))).drop("u_lat", "u_lon", "v_lat", "v_lon")


def guarded(hops: DataFrame) -> DataFrame:
    """timed: timetable seconds where the speed they imply can be true, else null."""
    cap = F.when(F.col("rail"), C.RAIL_CAP).otherwise(C.SURFACE_CAP)
    return hops.withColumn("timed", F.when((F.col("dt") > 0) & (F.col("dist_m") / F.col("dt") <= cap), F.col("dt").cast("double")))


def riding_times(guarded: DataFrame) -> DataFrame:
    """sec: the time kept for each hop. A hop three times slower than its trip rides at the trip's pace; one without a
    time rides at a usual speed."""
    trip = Window.partitionBy("trip_id")
    timed_m = F.sum(F.when(F.col("timed").isNotNull(), F.col("dist_m"))).over(trip)
    pace = F.when(F.sum("timed").over(trip) > 0, timed_m / F.sum("timed").over(trip))
    slow = (F.col("dist_m") > 0) & (F.col("pace") > 0) & (F.col("dist_m") / F.col("timed") < F.col("pace") / C.SLOW_RATIO) & (F.col("timed") >= C.SLOW_LEAST_S)
    usual = F.greatest(F.col("dist_m") / (F.when(F.col("rail"), C.RAIL_KMH).otherwise(C.SURFACE_KMH) / 3.6), F.lit(C.LEAST_HOP_S))
    sec = F.when(F.col("timed").isNull(), usual).when(F.coalesce(slow, F.lit(False)), F.col("dist_m") / F.col("pace")).otherwise(F.col("timed"))
    return guarded.withColumn("pace", pace).withColumns({"slow": F.coalesce(slow, F.lit(False)), "sec": sec})


def edge_means(times: DataFrame, parts: int = 1) -> DataFrame:
    """Mean seconds of each edge of a route and direction, over its trips. Many parts are dealt by pairs of stops, which
    sums and joins by such pairs (blended) build on."""
    return dealt(times, parts, "u", "v").groupBy(*EDGE).agg(F.avg("sec").alias("sec"), F.count("*").alias("samples"), F.first("dist_m").alias("dist_m"), F.first("reconstructed").alias("reconstructed"), F.first("vehicle_type").alias("vehicle_type"))


def road_floor(edges: DataFrame, road: DataFrame) -> DataFrame:
    """Raises surface edges to the time that a known road distance takes at the fastest real speed. road: u, v, distance_m."""
    surface = F.col("vehicle_type").isin("bus", "minibus", "microbus")
    floor = F.when(surface, F.col("distance_m") / C.ROAD_CAP)
    return edges.join(road.select("u", "v", "distance_m"), ["u", "v"], "left").withColumns({"floored": F.coalesce(floor > F.col("sec"), F.lit(False)), "sec": F.greatest("sec", floor)}).drop("distance_m")


def blended(edges: DataFrame) -> DataFrame:
    """Where three or more surveyed routes share a pair of stops, an edge far off their median is moved half-way to it."""
    votes = edges.where(~F.col("reconstructed")).groupBy("u", "v", "route_id").agg(F.max_by("sec", "direction_id").alias("vote"))
    medians = votes.groupBy("u", "v").agg(F.median("vote").alias("median"), F.count("*").alias("voters")).where(F.col("voters") >= C.MEDIAN_ROUTES)
    ratio = F.col("sec") / F.col("median")
    off = F.coalesce((F.col("median") > 0) & ((ratio >= C.MEDIAN_RATIO) | (ratio <= 1 / C.MEDIAN_RATIO)), F.lit(False))
    return edges.join(medians.drop("voters"), ["u", "v"], "left").withColumns({"blended": off, "sec": F.when(off, F.col("sec") + (F.col("median") - F.col("sec")) * C.MEDIAN_BLEND).otherwise(F.col("sec"))}).drop("median")


def discounted(edges: DataFrame, trusted: DataFrame, factor: float = 0.75) -> DataFrame:
    """Edges of a route whose two stops are both trusted for it (route_id, stop_id) count as that much faster in a search."""
    known = trusted.select("route_id", "stop_id").distinct()
    side = lambda k: known.select("route_id", F.col("stop_id").alias(k), F.lit(True).alias(f"{k}_trusted"))
    both = edges.join(side("u"), ["route_id", "u"], "left").join(side("v"), ["route_id", "v"], "left")
    return both.withColumn("sec", F.when(F.col("u_trusted") & F.col("v_trusted"), F.col("sec") * factor).otherwise(F.col("sec"))).drop("u_trusted", "v_trusted")
