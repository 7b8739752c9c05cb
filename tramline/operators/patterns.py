"""Stop sequences of routes, and questions that they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequences(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Each trip's stops in order, without repeats of a stop by itself: trip_id, route_id, direction_id, stops."""
    order = Window.partitionBy("trip_id").orderBy("seq")
    changed = stop_times.withColumn("before", F.lag("stop_id").over(order)).where("before IS NULL OR before <> stop_id")
    listed = changed.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "stop_id"))).alias("s"))
    return listed.join(trips.select("trip_id", "route_id", "direction_id"), "trip_id").select("trip_id", "route_id", "direction_id", F.col("s.stop_id").alias("stops"))


def longest(sequences: DataFrame) -> DataFrame:
    """The longest sequence of each route and direction; of equals, the first trip's."""
    key = F.struct(F.size("stops"), -F.col("trip_id"))
    return sequences.groupBy("route_id", "direction_id").agg(F.max_by("stops", key).alias("stops"), F.max_by("trip_id", key).alias("trip_id"))


def variants(sequences: DataFrame) -> DataFrame:
    """Different sequences of each route and direction, numbered from the longest."""
    different = sequences.groupBy("route_id", "direction_id", "stops").agg(F.min("trip_id").alias("first_trip"), F.count("*").alias("trips"))
    order = Window.partitionBy("route_id", "direction_id").orderBy(F.size("stops").desc(), "first_trip")
    return different.withColumn("variant", F.row_number().over(order))


def pattern_stops(patterns: DataFrame) -> DataFrame:
    return patterns.select("route_id", "direction_id", F.posexplode("stops").alias("pos", "stop_id"))


def equivalent_routes(patterns: DataFrame, journeys: DataFrame, routes: DataFrame, arrivals: DataFrame, most: int = 4) -> DataFrame:
    """Routes that also go from a journey's board to its alight (journey_id, route_id, board, alight), by their first
    visits. One direction of a route counts, the first that does. The journey's own comes first; then those with a vehicle
    under way, the soonest first (arrivals: route_id, direction_id, stop_id, eta_sec); then those of the same kind."""
    at = pattern_stops(patterns).groupBy("route_id", "direction_id", "stop_id").agg(F.min("pos").alias("pos"))
    boards = at.select(F.col("route_id").alias("other"), "direction_id", F.col("stop_id").alias("board"), F.col("pos").alias("from_pos"))
    alights = at.select(F.col("route_id").alias("other"), "direction_id", F.col("stop_id").alias("alight"), F.col("pos").alias("to_pos"))
    both = journeys.join(boards, "board").join(alights, ["other", "direction_id", "alight"]).where("from_pos < to_pos")
    one = both.groupBy("journey_id", "route_id", "board", "other").agg(F.min("direction_id").alias("direction_id"))
    soonest = arrivals.groupBy(F.col("route_id").alias("other"), "direction_id", F.col("stop_id").alias("board")).agg(F.min("eta_sec").alias("eta_sec"))
    kind = lambda k: routes.select(F.col("route_id").alias(k), F.col("vehicle_type").alias(f"{k}_kind"))
    known = one.join(soonest, ["other", "direction_id", "board"], "left").join(kind("other"), "other").join(kind("route_id"), "route_id")
    known = known.withColumn("same_kind", F.col("other_kind") == F.col("route_id_kind"))
    order = Window.partitionBy("journey_id").orderBy((F.col("other") == F.col("route_id")).desc(), F.col("eta_sec").asc_nulls_last(), F.desc("same_kind"), "other")
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("journey_id", "place", "other", "direction_id", "eta_sec", "same_kind")


def towards(patterns: DataFrame, pairs: DataFrame) -> DataFrame:
    """The last stop of the first direction of a route that visits second after first (pair_id, route_id, first, second)."""
    found = pairs.join(patterns, "route_id").where((F.array_position("stops", F.col("first")) > 0) & (F.array_position("stops", F.col("second")) > F.array_position("stops", F.col("first"))))
    return found.groupBy("pair_id").agg(F.min_by(F.element_at("stops", -1), "direction_id").alias("terminus"))


def stations(patterns: DataFrame, routes: DataFrame) -> DataFrame:
    """Stops of rail routes with their lines and modes; an interchange has more than one of either."""
    served = pattern_stops(patterns).join(routes.where("rail").select("route_id", "vehicle_type"), "route_id")
    listed = served.groupBy("stop_id").agg(F.countDistinct("route_id").alias("lines"), F.countDistinct("vehicle_type").alias("modes"))
    return listed.withColumn("interchange", (F.col("lines") > 1) | (F.col("modes") > 1))


def station_list(patterns: DataFrame, routes: DataFrame, stops: DataFrame, modes: tuple[str, ...] | None = None) -> DataFrame:
    """Rail stations by name, with their lines and modes; of some modes only, if any are named."""
    rail = routes.where("rail") if modes is None else routes.where(F.col("rail") & F.col("vehicle_type").isin(*modes))
    served = pattern_stops(patterns).join(rail.select("route_id", "vehicle_type"), "route_id")
    listed = served.groupBy("stop_id").agg(F.sort_array(F.collect_set("route_id")).alias("lines"), F.sort_array(F.collect_set("vehicle_type")).alias("modes"))
    named = listed.join(stops.select("stop_id", F.col("stop_name").alias("name"), "lat", "lon"), "stop_id")
    return named.withColumn("interchange", (F.size("lines") > 1) | (F.size("modes") > 1)).orderBy("name", "stop_id")


def stop_sets(patterns: DataFrame) -> DataFrame:
    return pattern_stops(patterns).select("route_id", "stop_id").distinct()


def best_overlap(corridors: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each corridor's stops (corridor_id, stop_id), the largest share that one existing route covers."""
    shared = corridors.join(sets, "stop_id").groupBy("corridor_id", "route_id").agg(F.count("*").alias("shared"))
    best = shared.groupBy("corridor_id").agg(F.max("shared").alias("shared"), F.min_by("route_id", F.struct(-F.col("shared"), "route_id")).alias("route_id"))
    sizes = corridors.groupBy("corridor_id").agg(F.count("*").alias("size"))
    return sizes.join(best, "corridor_id", "left").select("corridor_id", "size", F.coalesce("shared", F.lit(0)).alias("shared"), "route_id", (F.coalesce("shared", F.lit(0)) / F.col("size")).alias("overlap"))
