"""Live positions of riders' vehicles: their state as a batch query and as a stream, and times of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tramline.functions import constants as C
from tramline.functions.fares import literal_map
from tramline.functions.geo import haversine
from tramline.session import scratch_dir

REPORT = "session_id long, route_id long, direction_id int, lat double, lon double, at double, ended boolean"
STATE = "route_id long, direction_id int, lats array<double>, lons array<double>, ats array<double>"
VEHICLE = "session_id long, route_id long, direction_id int, lat double, lon double, at double, speed double, fixes int"


def latest(reports: DataFrame, now: float) -> DataFrame:
    """Each session's last fix if it is fresh and the session goes on; speed from the fix before on the same ride.

    Rides are told apart by a change of route or direction, or by an end. A fix counts by its own time, not its arrival.
    """
    order = Window.partitionBy("session_id").orderBy("at", "event_id")
    fixes = reports.where(F.col("at") <= now)
    changed = (F.lag("route_id").over(order) != F.col("route_id")) | (F.lag("direction_id").over(order) != F.col("direction_id")) | F.lag("ended").over(order)
    rides = fixes.withColumn("changed", F.coalesce(changed, F.lit(False)).cast("int")).withColumn("ride", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ride = Window.partitionBy("session_id", "ride").orderBy("at", "event_id")
    dt = F.col("at") - F.lag("at").over(ride)
    speed = F.when(dt >= C.LIVE_LEAST_DT, haversine(F.lag("lat").over(ride), F.lag("lon").over(ride), F.col("lat"), F.col("lon")) / dt)
    kept = F.least(F.row_number().over(ride), F.lit(C.LIVE_KEEP))
    last = rides.withColumns({"speed": speed, "fixes": kept}).groupBy("session_id").agg(F.max_by(F.struct("route_id", "direction_id", "lat", "lon", "at", "speed", "fixes", "ended"), F.struct("at", "event_id")).alias("l"))
    return last.where(~F.col("l.ended") & (F.lit(now) - F.col("l.at") <= C.LIVE_TTL_S)).select("session_id", *[f"l.{c}" for c in ("route_id", "direction_id", "lat", "lon", "at", "speed", "fixes")])


def arrivals(vehicles: DataFrame, lat: Column, lon: Column, now: float, vehicle_type: Column, distance: Column | None = None) -> DataFrame:
    """eta_sec of each vehicle at a place: by its own speed if that can be trusted, else by its kind's usual one."""
    usual = F.coalesce(literal_map(C.LIVE_DEFAULTS)[vehicle_type], F.lit(6.0))
    speed = F.when(F.col("speed").between(*C.LIVE_SPEEDS), F.col("speed")).otherwise(usual)
    metres = haversine(F.col("lat"), F.col("lon"), lat, lon) if distance is None else distance
    return vehicles.withColumns({"eta_sec": F.bround(metres / speed).cast("long"), "distance_m": F.bround(metres).cast("long"), "reported_speed": F.bround("speed", 1), "age_sec": F.bround(F.lit(now) - F.col("at")).cast("long")})


def next_arrivals(arriving: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Arrivals of each key, the soonest first (n); those without a figure come last."""
    order = Window.partitionBy(key).orderBy(F.col("eta_sec").asc_nulls_last(), "session_id")
    numbered = arriving.withColumn("n", F.row_number().over(order))
    return numbered if most is None else numbered.where(F.col("n") <= most)


def report_errors(reports: DataFrame) -> DataFrame:
    """reports with error: why one is not taken (missing, outside, time), or null."""
    lat, lon = F.col("lat"), F.col("lon")
    missing = F.col("session_id").isNull() | F.col("route_id").isNull() | lat.isNull() | lon.isNull()
    outside = ~lat.between(22.0, 32.0) | ~lon.between(24.0, 37.0)
    return reports.withColumn("error", F.when(missing, "missing").when(outside, "outside").when(F.col("at").isNull(), "time"))


class Sessions(StatefulProcessor):
    """Keeps a session's last fixes; a new route starts anew, an end or a time without fixes clears it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("fixes", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else None
        route, fixes = ((state[0], state[1]), list(zip(state[2], state[3], state[4], strict=True))) if state else (None, [])
        for r in pd.concat(list(rows)).sort_values("at").itertuples():
            if r.ended:
                route, fixes = None, []
                continue
            if route != (r.route_id, r.direction_id):
                route, fixes = (r.route_id, r.direction_id), []
            fixes = [*fixes, (r.lat, r.lon, r.at)][-C.LIVE_KEEP :]
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if not fixes:
            self.state.clear()
            return
        self.state.update((route[0], route[1], *(list(x) for x in zip(*fixes, strict=True))))
        self.handle.registerTimer(int((fixes[-1][2] + C.LIVE_TTL_S) * 1000) + 1)
        yield self._vehicle(key[0], route, fixes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    @staticmethod
    def _vehicle(session: int, route: tuple, fixes: list[tuple]) -> pd.DataFrame:
        from tramline.operators.spatial import _metres

        lat, lon, at = fixes[-1]
        dt = at - fixes[-2][2] if len(fixes) > 1 else 0.0
        speed = _metres(fixes[-2][0], fixes[-2][1], lat, lon) / dt if dt >= C.LIVE_LEAST_DT else None
        return pd.DataFrame({"session_id": [session], "route_id": [route[0]], "direction_id": [route[1]], "lat": [lat], "lon": [lon], "at": [at], "speed": pd.Series([speed], dtype="float64"), "fixes": pd.Series([len(fixes)], dtype="int32")})


def vehicles(reports: DataFrame) -> DataFrame:
    """A stream of reports (REPORT) to a stream of vehicles (VEHICLE), one for each session that a batch touches.

    Sessions expire by event time, LIVE_TTL_S after their last fix; a fix may be as late as that. Needs the RocksDB state store.
    """
    timed = reports.withColumn("event_time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("event_time", f"{C.LIVE_TTL_S} seconds")
    return timed.groupBy("session_id").transformWithStateInPandas(Sessions(), StructType.fromDDL(VEHICLE), "Update", "EventTime")


def reports_per_minute(reports: DataFrame, key: str) -> DataFrame:
    """Reports of each key in windows of one minute of event_time: what a rate limit counts."""
    return reports.withWatermark("event_time", "90 seconds").groupBy(F.window("event_time", "1 minute"), key).agg(F.count("*").alias("reports"))


def ride_sessions(reports: DataFrame, gap: str = "90 seconds") -> DataFrame:
    """Rides as session windows: fixes of a session, route and direction no more than gap apart."""
    return reports.withWatermark("event_time", "90 seconds").groupBy(F.session_window("event_time", gap), "session_id", "route_id", "direction_id").agg(F.count("*").alias("fixes"))


def timed(reports: DataFrame) -> DataFrame:
    """Reports with event_time, from at (seconds)."""
    return reports.withColumn("event_time", F.timestamp_millis((F.col("at") * 1000).cast("long")))


def replayed(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs a stream over what there is, into a sink of written batches, and reads back the last row of each key.

    Each batch is a folder that is written anew if it is repeated after a failure; offsets and state are kept in a checkpoint
    beside the folders, both in the shared scratch folder.
    """
    spark = stream.sparkSession
    base = scratch_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/batches/n={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/batches/n=-1")  # a sink, however little came
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.schema(schema).parquet(f"{base}/batches").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")
