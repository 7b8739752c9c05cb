"""Search and detail of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.fares import fare_bands, literal_map, route_colour, shown_flat_fare
from tramline.functions.text import SYNONYMS, route_number, search_text


def match_rank(query: Column, numbers: list[Column], vehicle: Column) -> Column:
    """0 if the query is a number of the route, 1 if it is a word for its kind of vehicle, else 2."""
    tokens = F.split(query, " ")

    def is_number(n: Column) -> Column:
        own = search_text(n)
        words = F.split(own, " ")
        return F.coalesce((own != "") & ((own == query) | F.array_contains(words, query) | F.forall(tokens, lambda t: F.array_contains(words, t))), F.lit(False))

    by_number = F.lit(False)
    for n in numbers:
        by_number = by_number | is_number(n)
    kinds = F.split(search_text(literal_map(SYNONYMS)[vehicle]), " ")
    return F.when(query == "", 2).when(by_number, 0).when(F.coalesce(F.exists(tokens, lambda t: F.array_contains(kinds, t)), F.lit(False)), 1).otherwise(2)


def cards(patterns: DataFrame, routes: DataFrame, stops: DataFrame, headways: DataFrame) -> DataFrame:
    """What a list shows of each route: its first direction's longest pattern, by both names of its ends."""
    first = patterns.groupBy("route_id").agg(F.min(F.struct("direction_id", "stops")).alias("p")).select("route_id", "p.*")
    end = lambda k: stops.select(F.col("stop_id").alias(f"{k}_id"), F.col("stop_name").alias(k))
    placed = first.withColumns({"from_id": F.col("stops")[0], "to_id": F.element_at("stops", -1)}).join(end("from"), "from_id").join(end("to"), "to_id")
    timed = placed.join(headways, ["route_id", "direction_id"], "left").join(routes, "route_id")
    return timed.select(
        "route_id", route_number(F.col("route_short_name")).alias("number"), F.col("route_long_name").alias("description"), "vehicle_type", "from", "to",
        F.size("stops").alias("stop_count"), "headway_min", "reconstructed", shown_flat_fare(F.col("vehicle_type"), F.col("agency_id")).alias("fare"), "route_short_name",
    )


def search_routes(cards: DataFrame, query: str, limit: int = 40, vehicle_type: str | None = None) -> DataFrame:
    """Cards that hold all words of the query: by rank, numbered ones first, those of more stops first."""
    if vehicle_type:
        cards = cards.where(F.col("vehicle_type") == vehicle_type)
    q = search_text(F.lit(query))
    text = search_text(F.concat_ws(" ", "number", "description", "from", "to", "route_short_name", "vehicle_type", literal_map(SYNONYMS)[F.col("vehicle_type")]))
    held = cards.withColumn("text", text).where((q == "") | F.forall(F.split(q, " "), lambda t: F.contains("text", t))).drop("text")
    ranked = held.withColumn("rank", match_rank(q, [F.col("number"), F.col("route_short_name")], F.col("vehicle_type")))
    return ranked.orderBy("rank", F.col("number").isNull(), F.desc("stop_count"), "route_id").limit(limit)


def route_detail(variants: DataFrame, stops: DataFrame, route_id: int) -> DataFrame:
    """Stops of every variant of one route, in order."""
    own = variants.where(F.col("route_id") == route_id).select("direction_id", "variant", (F.col("variant") == 1).alias("main"), F.posexplode("stops").alias("pos", "stop_id"))
    return own.join(stops.select("stop_id", "stop_name"), "stop_id")


def route_facts(routes: DataFrame, windows: DataFrame, headways: DataFrame) -> DataFrame:
    """What a route's page shows beside its stops, of each direction: number, colour, fare or bands, hours and headway."""
    hours = windows.groupBy("route_id").agg(F.min("start_sec").alias("first_sec"), F.max("end_sec").alias("last_sec"))
    known = routes.join(hours, "route_id", "left").join(headways, "route_id", "left")
    vehicle = F.col("vehicle_type")
    return known.select(
        "route_id", "direction_id", route_number(F.col("route_short_name")).alias("number"), "vehicle_type", route_colour(vehicle).alias("colour"), shown_flat_fare(vehicle, F.col("agency_id")).alias("fare"),
        fare_bands(vehicle).alias("bands"), "first_sec", "last_sec", "headway_min", "reconstructed",
    )


def localised(names: DataFrame, translations: DataFrame) -> DataFrame:
    """name, and its translation or itself. translations: field_value, translation, and _row, of which the last wins."""
    last = translations.groupBy(F.col("field_value").alias("name")).agg(F.max_by("translation", "_row").alias("t"))
    return names.join(last, "name", "left").withColumn("local", F.coalesce("t", "name")).drop("t")


def top_per_key(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= k)
