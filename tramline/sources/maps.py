"""Readers of map extracts and of the documents that go with a network, and writers of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine
from tramline.functions.text import corridor_stops, place_key

# Modes of the relations that are kept, tags that make a node a station, and the box of the area (south,
# west, north, east).
MODES = ("monorail", "light_rail", "tram", "train", "subway", "ferry")
STATION_TAGS = {
    "railway": ("station", "halt", "tram_stop", "stop", "subway_entrance"),
    "public_transport": ("station", "stop_position", "platform"),
    "amenity": ("ferry_terminal",),
}
BOX = (29.70, 30.80, 30.35, 31.80)
# Speeds on foot and on the road (m/s).
SPEEDS = {"walk": 1.25, "drive": 11.0}

_TAGS = "tags:map<string,string>"
EXTRACT = f"routes array<struct<id:bigint,{_TAGS},members:array<struct<type:string,ref:bigint,role:string>>>>, nodes map<string,struct<id:bigint,lat:double,lon:double,{_TAGS}>>"


def is_route(tags: Column) -> Column:
    """Whether a relation is a route of a wanted mode."""
    return F.coalesce((tags["type"] == "route") & tags["route"].isin(*MODES), F.lit(False))


def is_station(tags: Column) -> Column:
    found = F.lit(False)
    for key, values in STATION_TAGS.items():
        found = found | F.coalesce(tags[key].isin(*values), F.lit(False))
    return found


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def transit_extract(relations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted relations (id, tags, members), and the nodes (id, lat, lon, tags) that are members of one or stations in
    the area. Both tables come from an export of the map; nodes are read once for either."""
    routes = relations.where(is_route(F.col("tags")))
    members = routes.select(F.explode("members").alias("m")).where("m.type = 'n'").select(F.col("m.ref").alias("id"), F.lit(True).alias("member")).distinct()
    station = is_station(F.col("tags")) & in_box(F.col("lat"), F.col("lon"))
    kept = nodes.join(members, "id", "left").where(F.coalesce("member", F.lit(False)) | station).drop("member")
    return routes, kept


def read_extract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Relations (id, tags, members) and nodes (id, lat, lon, tags) of an extract's document."""
    doc = spark.read.schema(EXTRACT).json(path, multiLine=True)
    return doc.select(F.explode("routes").alias("r")).select("r.*"), doc.select(F.explode("nodes").alias("key", "n")).select("n.*")


def ordered_stations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stations of each relation in order: relation_id, pos, osm_node, name_en, name_ar, lat, lon. Members that are no
    nodes, or whose place is unknown, are left out."""
    at = relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m")).where("m.type = 'n'")
    known = at.join(nodes.where("lat IS NOT NULL").select(F.col("id").alias("osm_node"), "lat", "lon", "tags"), F.col("m.ref") == F.col("osm_node"))
    t = F.col("tags")
    name = lambda *keys: F.coalesce(*[F.nullif(t[k], F.lit("")) for k in keys])
    named = known.select(
        "relation_id", "pos", "osm_node", F.coalesce(name("name:en", "name"), F.concat(F.lit("node "), F.col("osm_node").cast("string"))).alias("name_en"),
        F.coalesce(t["name:ar"], F.lit("")).alias("name_ar"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
    )
    order = Window.partitionBy("relation_id").orderBy("pos")
    return named.withColumn("pos", F.row_number().over(order) - 1)


def landmark_corridors(spark: SparkSession, path: str) -> DataFrame:
    """Corridors of a document of routes told by their landmarks: tag, route, route_num, fare_egp, corridor, and pos and
    landmark of each landmark."""
    row = "struct<route:string,route_num:string,fare_egp:double,corridor:string>"
    doc = spark.read.schema(f"documents map<string,array<{row}>>").json(path, multiLine=True)
    rows = doc.select(F.explode("documents").alias("tag", "rows")).select("tag", F.explode("rows").alias("r")).select("tag", "r.*")
    return rows.select("*", F.posexplode(corridor_stops(F.col("corridor"))).alias("pos", "landmark"))


def road_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Points of known roads between two stops (a, b, seq, lat, lon), from lines with a, b and coordinates (lon, lat)."""
    rows = spark.read.schema("a bigint, b bigint, coordinates array<array<double>>").json(path)
    return rows.select("a", "b", F.posexplode("coordinates").alias("seq", "c")).select("a", "b", "seq", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"))


def station_notes(spark: SparkSession, path: str) -> DataFrame:
    """key, station_ar and note_ar of a document of notes on stations; a document that has none gives no rows."""
    doc = spark.read.schema("station_notes map<string,struct<station_ar:string,note_ar:string>>").json(path, multiLine=True)
    return doc.select(F.explode("station_notes").alias("key", "n")).select("key", "n.*")


def routes_between(pairs: DataFrame, cache: DataFrame, mode: str = "walk") -> DataFrame:
    """Distance and time of each pair (lat1, lon1, lat2, lon2 and what else it has), on foot or by road: a cached one (cache:
    cache_key, distance_m, duration_sec), else the straight line. On foot, a cached one that goes far round is not taken."""
    prefix = "" if mode == "walk" else "drive_"
    direct = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    key = F.concat(F.lit(prefix), place_key(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    known = cache.groupBy(F.col("cache_key").alias("key")).agg(F.min(F.struct("distance_m", "duration_sec")).alias("known"))
    both = pairs.withColumns({"direct_m": direct, "key": key}).join(known, "key", "left")
    good = F.col("known").isNotNull()
    if mode == "walk":
        good = good & (F.col("known.distance_m") <= F.greatest(F.col("direct_m") * 2.1, F.lit(350.0)))
    return both.withColumns({
        "distance_m": F.when(good, F.col("known.distance_m")).otherwise(F.col("direct_m")), "duration_sec": F.when(good, F.col("known.duration_sec")).otherwise(F.col("direct_m") / SPEEDS[mode]),
        "source": F.when(good, "cache").otherwise("straight"),
    }).drop("known", "direct_m")


def walking_table(points: DataFrame, cache: DataFrame) -> DataFrame:
    """Walks between all places of each table (table_id, ordinal, lat, lon; some tens a table): table_id, from, to, and
    distance_m and duration_sec. A table of one place has no rows."""
    side = lambda k, name: points.select("table_id", F.col("ordinal").alias(name), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    pairs = side(1, "from").join(side(2, "to"), "table_id").where(F.col("from") != F.col("to"))
    return routes_between(pairs, cache).select("table_id", "from", "to", "distance_m", "duration_sec")


def with_translations(existing: DataFrame, added: DataFrame) -> DataFrame:
    """existing with the Arabic of values that have none yet (added: table_name, field_name, field_value, translation)."""
    keys = ["table_name", "field_name", "language", "field_value"]
    good = added.where("translation <> '' AND field_value <> ''").withColumn("language", F.lit("ar"))
    once = good.groupBy(*keys).agg(F.min("translation").alias("translation"))
    return existing.unionByName(once.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def review_sheet(unresolved: DataFrame, near: DataFrame, k: int = 3) -> DataFrame:
    """Unresolved landmarks with their k most alike names (near: landmark, name, score), in columns, for people to review."""
    order = Window.partitionBy("landmark").orderBy(F.desc("score"), "name")
    first = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    wide = first.groupBy("landmark").pivot("n", list(range(1, k + 1))).agg(F.first("name"))
    named = wide.withColumnsRenamed({str(n): f"candidate_{n}" for n in range(1, k + 1)})
    return unresolved.select("landmark").distinct().join(named, "landmark", "left").withColumn("verdict", F.lit(""))


def write_report(rows: DataFrame, path: str) -> None:
    """A report as lines of JSON, in the place of the one before."""
    rows.write.mode("overwrite").json(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_version(rows: DataFrame, path: str, stamp: str) -> str:
    """A copy of a table beside it, named by a stamp such as a time, and never written twice: the path."""
    to = f"{path.rstrip('/')}.{stamp}"
    rows.write.mode("error").parquet(to)
    return to
