"""Answers to requests for journeys between places: options of several profiles, an alternative, a walk, or how near the
network comes. All requests of a table are answered together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import constants as C
from tramline.functions.fares import walk_offered
from tramline.functions.geo import haversine
from tramline.operators import search, service, spatial
from tramline.session import materialize

# Stops tried at each end, exits tried for a partial answer, how far and how much of the way such an answer
# may leave, and how much slower than the best an alternative may be.
FROM_STOPS, TO_STOPS, EXITS, MOST_TAIL_M, MOST_LEFT = 3, 4, 200, 15000.0, 0.75
ALTERNATIVE_TIMES, ALTERNATIVE_MORE_MIN = 1.8, 15
TIERS = {"recommended": 0, "fastest": 1, "cheapest": 2, "alternative": 3, "partial": 4, "walk": 5, "none": 6}


@dataclass
class Model:
    """Tables that searches read: written ones, as each is read in every round."""

    stops: DataFrame
    routes: DataFrame
    edges: DataFrame
    headways: DataFrame
    walks: DataFrame
    spots: DataFrame | None = None

    def restricted(self, shut: DataFrame | None = None, without: tuple[str, ...] = ()) -> Model:
        """Without routes that don't run (route_id) and without kinds of vehicles."""
        routes = self.routes.where(~F.col("vehicle_type").isin(*without)) if without else self.routes
        routes = routes if shut is None else routes.join(shut, "route_id", "left_anti")
        on = lambda df: df.join(routes.select("route_id"), "route_id", "left_semi")
        return Model(self.stops, routes, materialize(on(self.edges), "edges"), self.headways, self.walks, self.spots)


def _ends(requests: DataFrame, stops: DataFrame, k: int, most: int, metres: float = C.SNAP_M) -> DataFrame:
    points = requests.select(F.col("od_id").alias("point_id"), F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"))
    return spatial.nearest_stops(points, stops, most, metres)


def _searched(model: Model, start: DataFrame, exits: DataFrame, profile: str, kind: str, min_walk: bool, min_transfers: bool, avoid: DataFrame | None = None) -> DataFrame:
    """The best option of each request: od_id, kind, stop_id, path, walks at both ends in metres, and what it costs."""
    times = max(C.PROFILES[profile][1], 3.5) if min_walk else C.PROFILES[profile][1]
    seconds = lambda c: F.greatest(F.col(c) / C.WALK_SPEED, F.lit(10.0)) * times
    origins = start.select(F.col("point_id").alias("od_id"), "stop_id", seconds("dist_m").alias("cost"))
    left = materialize(exits.select(F.col("point_id").alias("od_id"), "stop_id", F.col("dist_m").alias("end_m"), seconds("dist_m").alias("exit_cost")), "exits")
    boards = search.boardings(model.edges, model.routes, model.headways, profile, min_transfers)
    # A journey without a ride is none: the answers at exits have one.
    reach = search.answers(model.edges, boards, model.walks, origins, times, avoid, search.Bound(left.select("od_id", "stop_id", "exit_cost"), model.stops), spots=model.spots)
    found = reach.join(left, ["od_id", "stop_id"]).groupBy("od_id").agg(F.min(F.struct((F.col("cost") + F.col("exit_cost")).alias("total"), "stop_id", "end_m", "cost", "path")).alias("b")).select("od_id", "b.*")
    first = start.select(F.col("point_id").alias("od_id"), F.col("stop_id").alias("first"), F.col("dist_m").alias("start_m"))
    return materialize(found.withColumn("first", F.col("path")[0]["start"]).join(first, ["od_id", "first"]).withColumn("kind", F.lit(kind)).drop("first"), "option")


def _told(model: Model, found: DataFrame) -> DataFrame:
    told = search.itineraries(found, model.routes, model.headways)
    both = told.join(found.select("od_id", "stop_id", "kind", "start_m", "end_m", "path"), ["od_id", "stop_id"])
    walk = (F.col("start_m") + F.col("end_m")) / C.WALK_SPEED / 60
    routes = F.transform(F.filter("path", lambda s: s["kind"] == "ride"), lambda s: s["route_id"])
    return both.select("od_id", "kind", "boardings", (F.col("minutes") + F.ceil(walk)).alias("minutes"), (F.col("metres") + F.round(F.col("start_m") + F.col("end_m")).cast("long")).alias("metres"), "fare", routes.alias("routes"), F.round("end_m").cast("long").alias("end_m"), F.col("stop_id").alias("last_stop"))


def plan(model: Model, requests: DataFrame, windows: DataFrame, inactive: DataFrame, now: int, min_walk: bool = False, min_transfers: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """One row for each option of each request (od_id, lat1, lon1, lat2, lon2), best tier first: n, kind, minutes, fare,
    metres, boardings, routes. A request without any has one row that says why (reason). Requests between the same places are
    answered once."""
    ends = ("lat1", "lon1", "lat2", "lon2")
    one = materialize(requests.groupBy(*ends).agg(F.min("od_id").alias("od_id")), "asked")
    found = _planned(model, one, windows, inactive, now, min_walk, min_transfers, without)
    a, b = requests.alias("a"), one.withColumnRenamed("od_id", "same").alias("b")
    alike = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ends]).select(F.col("od_id").alias("own"), F.col("same").alias("od_id"))
    return alike.join(found, "od_id").withColumn("od_id", F.col("own")).drop("own")


def _planned(model: Model, requests: DataFrame, windows: DataFrame, inactive: DataFrame, now: int, min_walk: bool, min_transfers: bool, without: tuple[str, ...]) -> DataFrame:
    requests = materialize(requests.withColumn("direct_m", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))), "requests")
    open_ = model.restricted(inactive.union(service.closed_at(windows, now)).distinct(), without)
    start = materialize(spatial.usable_origins(_ends(requests, model.stops, 1, FROM_STOPS)), "start")
    exits = materialize(_ends(requests, model.stops, 2, TO_STOPS), "exits")
    options = None
    for profile in ("recommended", "fastest", "cheapest"):
        found = _told(open_, _searched(open_, start, exits, profile, profile, min_walk, min_transfers))
        options = found if options is None else options.unionByName(found)
    options = materialize(options, "options")
    used = options.groupBy("od_id").agg(F.array_distinct(F.flatten(F.collect_list("routes"))).alias("used"), F.min("minutes").alias("least"))
    avoid = used.select("od_id", F.explode("used").alias("route_id"))
    other = _told(open_, _searched(open_, start, exits, "fastest", "alternative", min_walk, min_transfers, avoid)).join(used, "od_id")
    slow = F.col("least") * ALTERNATIVE_TIMES + ALTERNATIVE_MORE_MIN
    other = other.where((F.size(F.array_except("routes", "used")) > 0) & (F.col("minutes") <= slow)).drop("used", "least")
    # Requests without an option: how near does the network come?
    rest = materialize(requests.join(options.select("od_id"), "od_id", "left_anti"), "rest")
    near = _ends(rest, model.stops, 2, EXITS, MOST_TAIL_M)
    partial = _told(open_, _searched(open_, start, near, "fastest", "partial", min_walk, min_transfers)).join(rest.select("od_id", "direct_m"), "od_id").where(F.col("end_m") <= F.col("direct_m") * MOST_LEFT).drop("direct_m")
    walk = requests.where(walk_offered(F.col("direct_m"), F.col("direct_m"))).select(
        "od_id", F.lit("walk").alias("kind"), F.lit(0).cast("long").alias("boardings"), F.ceil(F.col("direct_m") / C.WALK_SPEED / 60).alias("minutes"), F.round("direct_m").cast("long").alias("metres"),
        F.lit(0).cast("long").alias("fare"), F.array().cast("array<bigint>").alias("routes"), F.lit(0).cast("long").alias("end_m"), F.lit(None).cast("long").alias("last_stop"),
    )
    every = materialize(options.unionByName(other).unionByName(partial).unionByName(walk), "answers")
    tier = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), F.col("kind"))
    alike = F.row_number().over(Window.partitionBy("od_id", "routes", "fare", "minutes").orderBy("tier"))
    once = every.withColumn("tier", tier).withColumn("alike", alike).where("alike = 1 OR kind = 'walk'")
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("od_id").orderBy("tier", "minutes"))).drop("tier", "alike").withColumn("reason", F.lit(None).cast("string"))
    state = service.network_state(windows, now).first()["reason"]
    none = requests.join(every.select("od_id"), "od_id", "left_anti").select("od_id", F.lit("none").alias("kind"), F.lit(1).alias("n"), F.lit(state).alias("reason"))
    return ranked.unionByName(none, allowMissingColumns=True)


def nearest_hubs(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """The nearest stop to each end of a request, however far."""

    def side(k: int) -> DataFrame:
        points = requests.select(F.col("od_id").alias("point_id"), F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"))
        return spatial.nearest_anywhere(points, stops).select(F.col("point_id").alias("od_id"), F.col("stop_id").alias(f"hub{k}"), F.round("dist_m").cast("long").alias(f"hub{k}_m"))

    return requests.select("od_id").join(side(1), "od_id", "left").join(side(2), "od_id", "left")


def station_notes(stations: DataFrame, notes: DataFrame) -> DataFrame:
    """stop_id and note: by the station's normalised name, else by the name without what it has in parentheses."""
    from tramline.functions.text import normalise_station

    bare = F.trim(F.regexp_replace("name", "\\s*[(（][^)）]*[)）]\\s*", " "))
    known = notes.select(normalise_station(F.col("station_ar")).alias("key"), "note_ar").groupBy("key").agg(F.min("note_ar").alias("note"))
    keyed = stations.withColumns({"whole": normalise_station(F.col("name")), "bare": normalise_station(bare)})
    one, two = known.withColumnsRenamed({"key": "whole", "note": "n1"}), known.withColumnsRenamed({"key": "bare", "note": "n2"})
    return keyed.join(one, "whole", "left").join(two, "bare", "left").select("stop_id", F.coalesce("n1", "n2").alias("note"))
