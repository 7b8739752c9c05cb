"""A transit network derived from the star-schema tables, by fixed rules: each table as a DataFrame.

Suppliers are stops, orders are trips, order lines are stop times, and routes are customers modulo 60.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions import constants as C
from tramline.functions.fares import is_rail, vehicle_type
from tramline.session import dealt, parts_of, table

ROUTES = 60
AGENCIES = list(C.AGENCY_VEHICLES)


@dataclass
class Network:
    """Tables of one network. Each is built once, lazily; readers of few columns scan few columns."""

    spark: SparkSession
    sf_dir: str

    def _read(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def parts(self) -> int:
        """Parts that stop times, and what is made of each, are dealt into where that is more than by setting."""
        return parts_of(self._read("lineitem"))

    @cached_property
    def stops(self) -> DataFrame:
        k = F.col("s_suppkey")
        names = F.broadcast(self._read("nation").select("n_nationkey", "n_name"))  # 25 rows
        at = (F.lit(30.02) + ((k * 7919) % 1000) * F.lit(0.00003)).alias("lat"), (F.lit(31.20) + ((k * 6271) % 1000) * F.lit(0.000035)).alias("lon")
        return self._read("supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("stop_id"), F.col("n_name").alias("stop_name"), *at)

    @cached_property
    def routes(self) -> DataFrame:
        """One row for each of the 60 routes."""
        r = F.col("route_id")
        agency = F.array(*map(F.lit, AGENCIES))[(r % len(AGENCIES)).cast("int")]
        kind = F.when(r == 57, "0").when(r == 58, "2").when(r == 59, "12").when(agency == "NAT", "1").otherwise("3")
        base = self.spark.range(ROUTES).select(F.col("id").alias("route_id")).withColumns({"agency_id": agency, "route_type": kind})
        names = self._read("part").where(F.col("p_partkey") < ROUTES).select("p_partkey", F.col("p_name").alias("route_long_name"))
        named = base.join(F.broadcast(names), r == F.col("p_partkey"), "left").drop("p_partkey")
        vehicle = vehicle_type(F.col("route_type"), F.col("agency_id"))
        return named.withColumns({"vehicle_type": vehicle, "rail": is_rail(vehicle), "reconstructed": F.col("agency_id").isin(*C.RECONSTRUCTED), "route_short_name": F.concat(F.upper(F.substring(vehicle, 1, 1)), r.cast("string"))})

    @cached_property
    def trips(self) -> DataFrame:
        o = self._read("orders")
        return o.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % ROUTES).alias("route_id"), (F.col("o_orderkey") % 2).cast("int").alias("direction_id"), F.col("o_orderpriority").alias("service_id"))

    @cached_property
    def stop_times(self) -> DataFrame:
        """trip_id, seq, stop_id and t (seconds of the service day)."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
        hop = F.floor(60 + F.col("l_quantity") * 20).cast("long")
        # One shuffle by trip; windows and joins by trip that follow need no other.
        return dealt(self._read("lineitem"), self.parts, "l_orderkey").select(
            F.col("l_orderkey").alias("trip_id"), F.row_number().over(order).alias("seq"), F.col("l_suppkey").alias("stop_id"),
            (21600 + F.sum(hop).over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("t"),
        )

    @cached_property
    def frequencies(self) -> DataFrame:
        """Blocks of equal headways: one or two for each trip; some touch, some overlap."""
        k = F.col("trip_id")
        start, length = (5 + k % 3) * 3600, F.lit(54000)
        one = self.trips.select("trip_id", "route_id", "direction_id", start.alias("start_sec"), (start + length).alias("end_sec"), (300 + (k % 7) * 150).alias("headway_secs"))
        night = self.trips.where(k % 5 == 0).select("trip_id", "route_id", "direction_id", F.lit(82800).cast("long").alias("start_sec"), F.lit(90000).cast("long").alias("end_sec"), F.lit(1800).cast("long").alias("headway_secs"))
        return one.unionByName(night).where("route_id % 10 <> 9")

    @cached_property
    def calendar(self) -> DataFrame:
        """service_id and dow, one row for each day that a service runs: five services."""
        days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
        runs = {"1-URGENT": days, "2-HIGH": days[:5], "3-MEDIUM": days[5:], "4-NOT SPECIFIED": days[4:5], "5-LOW": days[:3]}
        return self.spark.createDataFrame([(s, d) for s, x in runs.items() for d in x], "service_id string, dow string")

    @cached_property
    def shape_points(self) -> DataFrame:
        """A polyline for each route and direction: one trip's stops in order, with the place between."""
        trip = self.trips.groupBy("route_id", "direction_id").agg(F.min("trip_id").alias("trip_id"))
        rows = self.stop_times.join(F.broadcast(trip), "trip_id").join(self.stops, "stop_id")  # at most two trips for each route
        return rows.select(F.concat_ws("_", "route_id", "direction_id").alias("shape_id"), "route_id", "direction_id", "seq", "lat", "lon", "stop_id")

    @cached_property
    def positions(self) -> DataFrame:
        """Live reports of vehicles: one for each event; errors end a session."""
        e = self._read("events")
        k = F.get_json_object("props", "$.k").cast("int")
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
        return e.select(
            "event_id", F.col("user_id").alias("session_id"), (F.col("user_id") % ROUTES).alias("route_id"), (F.floor(micros / 86400e6).cast("long") % 2).cast("int").alias("direction_id"),
            (F.lit(30.0) + F.col("value") * 0.0001).alias("lat"), (F.lit(31.2) + k * 0.0005).alias("lon"), (micros / 600e6).alias("at"), (F.col("event_type") == "error").alias("ended"),
        )
