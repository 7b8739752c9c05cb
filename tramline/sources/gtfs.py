"""Readers of GTFS folders and of the documents beside them, and writers of the same."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.fares import is_rail, vehicle_type
from tramline.functions.schedule import gtfs_seconds

# The columns of each table that the engine uses, as DDL.
TABLES = {
    "stops": "stop_id string, stop_name string, stop_lat string, stop_lon string",
    "routes": "route_id string, agency_id string, route_long_name string, route_short_name string, route_type string, continuous_pickup string, continuous_drop_off string",
    "trips": "route_id string, service_id string, trip_headsign string, direction_id string, shape_id string, trip_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs string, exact_times string",
    "translations": "table_name string, field_name string, language string, field_value string, translation string",
    "calendar": "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string",
    "shapes": "shape_id string, shape_pt_sequence string, shape_pt_lat string, shape_pt_lon string",
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string",
    "feed_info": "feed_publisher_name string, feed_publisher_url string, feed_start_date string, feed_end_date string, feed_version string, feed_lang string",
}
REQUIRED = ("stops", "routes", "trips", "stop_times")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


class GtfsFeed:
    """The tables of a feed. Text columns by name, whatever their order; a byte-order mark before the first is dropped;
    an optional table that is missing is empty, and a missing column null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        wanted = [c.split()[0] for c in TABLES[name].split(", ")]
        try:
            found = self.spark.read.csv(f"{self.path}/{name}.txt", header=True, quote='"', escape='"', multiLine=True)
        except AnalysisException:
            if name in REQUIRED:
                raise
            return self.spark.createDataFrame([], TABLES[name])
        found = found.toDF(*[c.lstrip("﻿").strip() for c in found.columns])
        return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in wanted])

    def ordered(self, name: str) -> DataFrame:
        """raw with _row, which rises along the file, for rules by which the first or last row wins."""
        return self.raw(name).withColumn("_row", F.monotonically_increasing_id())

    @property
    def stops(self) -> DataFrame:
        return self.raw("stops").select("stop_id", "stop_name", F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"))

    @property
    def routes(self) -> DataFrame:
        vehicle = vehicle_type(F.col("route_type"), F.col("agency_id"))
        return self.raw("routes").withColumns({"vehicle_type": vehicle, "rail": is_rail(vehicle), "reconstructed": F.coalesce(F.col("agency_id").isin("GOV_CTA", "GOV_CTA_M"), F.lit(False))})

    @property
    def trips(self) -> DataFrame:
        return self.raw("trips").withColumn("direction_id", F.coalesce("direction_id", F.lit("")))

    @property
    def stop_times(self) -> DataFrame:
        t = self.raw("stop_times")
        return t.select("trip_id", F.col("stop_sequence").try_cast("int").alias("seq"), "stop_id", gtfs_seconds(F.col("arrival_time")).alias("arrival"), gtfs_seconds(F.col("departure_time")).alias("t"))

    @property
    def frequencies(self) -> DataFrame:
        """Well-formed blocks that last and have a headway, with their trip's route and direction."""
        f = self.raw("frequencies").select("trip_id", gtfs_seconds(F.col("start_time")).alias("start_sec"), gtfs_seconds(F.col("end_time")).alias("end_sec"), F.col("headway_secs").try_cast("double").alias("headway_secs"))
        return f.where("end_sec > start_sec AND headway_secs > 0").join(self.trips.select("trip_id", "route_id", "direction_id"), "trip_id")

    @property
    def calendar(self) -> DataFrame:
        days = ", ".join(f"'{d}', {d}" for d in DAYS)
        return self.raw("calendar").selectExpr("service_id", f"stack(7, {days}) AS (dow, runs)").where("trim(runs) = '1'").select("service_id", "dow")

    @property
    def translations(self) -> DataFrame:
        """Arabic of a table's field value; the last row of a value wins."""
        t = self.ordered("translations").where("language = 'ar'")
        return t.groupBy("table_name", "field_name", "field_value").agg(F.max_by("translation", "_row").alias("translation"))

    @property
    def shape_points(self) -> DataFrame:
        return self.raw("shapes").select("shape_id", F.col("shape_pt_sequence").try_cast("int").alias("seq"), F.col("shape_pt_lat").try_cast("double").alias("lat"), F.col("shape_pt_lon").try_cast("double").alias("lon"))

    @property
    def route_shapes(self) -> DataFrame:
        """The first trip's shape of each route and direction."""
        t = self.ordered("trips").where("shape_id IS NOT NULL AND shape_id <> ''")
        return t.groupBy("route_id", F.coalesce("direction_id", F.lit("")).alias("direction_id")).agg(F.min_by("shape_id", "_row").alias("shape_id"))

    def validity(self) -> DataFrame:
        """First and last day of the calendar: reported, not enforced."""
        return self.raw("calendar").agg(F.min("start_date").alias("first"), F.max("end_date").alias("last"))


def write_table(df: DataFrame, path: str, name: str) -> None:
    """A table in a feed's columns and order, as CSV with a header, to a folder of part files."""
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").csv(f"{path.rstrip('/')}/{name}.txt", header=True, emptyValue="")


def merged(existing: DataFrame, added: DataFrame, marked) -> DataFrame:
    """existing without its marked rows, and the added ones in its columns: the same however often it is done."""
    return existing.where(~F.coalesce(marked, F.lit(False))).unionByName(added.select(*[F.col(c) if c in added.columns else F.lit(None).alias(c) for c in existing.columns]))


def reconstructed_rows(agency=None, key=None):
    """Whether a row was reconstructed: by its agency, or by the prefix of its key."""
    by_agency = F.lit(False) if agency is None else F.coalesce(agency.isin("GOV_CTA", "GOV_CTA_M"), F.lit(False))
    return by_agency | (F.lit(False) if key is None else F.coalesce(key.startswith("GOV_"), F.lit(False)))


def rail_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a rail line document, one row each, in order, with the line's figures."""
    doc = spark.read.json(path, multiLine=True).select(F.explode("lines").alias("l"))
    legs = doc.select("l.*").select("*", F.explode("directions").alias("d"))
    at = legs.select("key", "short_name", "route_type", "agency_id", "headway_sec", "dwell_sec", "journey_minutes", F.col("d.direction_id").alias("direction_id"), "d.hop_seconds", F.posexplode("d.stations").alias("pos", "s"))
    return at.select("*", "s.osm_node", "s.name_en", "s.name_ar", "s.lat", "s.lon", F.try_element_at("hop_seconds", F.col("pos") + 1).alias("hop_sec")).drop("s", "hop_seconds")


def osm_relations(spark: SparkSession, path: str) -> DataFrame:
    """Tags of mapped relations: id, key, value."""
    found = spark.read.option("multiLine", True).schema("elements array<struct<type:string,id:bigint,tags:map<string,string>>>").json(path)
    return found.select(F.explode("elements").alias("e")).where("e.type = 'relation'").select("e.id", F.explode("e.tags").alias("key", "value"))


def edge_cache(spark: SparkSession, path: str) -> DataFrame:
    """Known road distances: u, v, duration_s, distance_m, from a map of 'u|v' to figures."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,struct<duration_s:double,distance_m:double,source:string>>")).alias("pair", "x"))
    parts = F.split("pair", "\\|")
    return rows.select(parts[0].alias("u"), parts[1].alias("v"), "x.*")


def walk_route(pairs: DataFrame, cache: DataFrame, speed: float = 1.25) -> DataFrame:
    """Distance and time of each walk (walk_id, key, direct_m): the cached one unless it goes far round, else straight."""
    c = pairs.join(cache.select(F.col("cache_key").alias("key"), F.col("distance_m").alias("cached_m"), F.col("duration_sec").alias("cached_s")), "key", "left")
    good = F.coalesce(F.col("cached_m") <= F.greatest(F.col("direct_m") * 2.1, F.lit(350.0)), F.lit(False))
    return c.withColumns({"distance_m": F.when(good, F.col("cached_m")).otherwise(F.col("direct_m")), "duration_sec": F.when(good, F.col("cached_s")).otherwise(F.col("direct_m") / speed), "source": F.when(good, "cache").otherwise("straight")}).drop("cached_m", "cached_s")


def upserted(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with the rows of fresh put in, or in the place of those with the same key."""
    both = stored.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_age"))).where("_n = 1").drop("_n", "_age")


def not_yet_known(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.join(known.select(key), key, "left_anti")


def log_gaps(events: DataFrame, path: str) -> None:
    """Adds events of missing coverage to a folder of JSON lines; places to three decimals."""
    places = {c: F.transform(c, lambda x: F.round(x, 3)) for c in ("start", "end") if c in events.columns}
    events.withColumns(places).write.mode("append").json(path)
