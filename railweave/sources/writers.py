"""Writers (A13, A14, A19, A23) and operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions import clock


def feed_tables(net: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a feed; every route has its own carrier, stop times are in numeric order."""
    carriers = net["carriers"]
    agency = carriers.select(F.col("carrier_id").alias("agency_id"), F.col("name").alias("agency_name"))
    agency = agency.select("*", F.lit("https://example.org").alias("agency_url"), F.lit("UTC").alias("agency_timezone"))
    zones = net["zones"].select("stop_id", "zone_id")
    stops = net["stops"].join(zones, "stop_id", "left").select("stop_id", F.col("name").alias("stop_name"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"), "zone_id")
    routes = net["routes"].select("route_id", F.col("carrier_id").alias("agency_id"), F.col("name").alias("route_short_name"), clock.route_type(F.col("mode")).alias("route_type"))
    sid = F.when(F.coalesce("service_id", F.lit(0)) == 0, 1).otherwise(F.col("service_id"))
    trips = net["trips"].select("route_id", sid.alias("service_id"), "trip_id", F.when(F.col("direction") == "backward", 1).otherwise(0).alias("direction_id"))
    times = net["stop_times"].select("trip_id", clock.feed_hms(F.col("arrival_s")).alias("arrival_time"), clock.feed_hms(F.col("departure_s")).alias("departure_time"), "stop_id", F.col("seq").alias("stop_sequence"))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    calendar = net["services"].select("service_id", *clock.weekday_flags(F.col("weekdays")), day("start_date").alias("start_date"), day("end_date").alias("end_date"))
    dates = net["service_exceptions"].select("service_id", day("date").alias("date"), F.when(F.col("exception_type") == "removed", 2).otherwise(1).alias("exception_type"))
    transfers = net["transfers"].select(F.col("from_stop").alias("from_stop_id"), F.col("to_stop").alias("to_stop_id"), F.lit(2).alias("transfer_type"), (F.col("minutes") * 60).alias("min_transfer_time"))
    fares = net["fares"].select("fare_id", "price", F.col("currency").alias("currency_type"))
    info = net["services"].agg(day(F.min("start_date")).alias("feed_start_date"), day(F.max("end_date")).alias("feed_end_date"))
    return {"agency": agency, "stops": stops, "routes": routes, "trips": trips, "stop_times": times, "calendar": calendar, "calendar_dates": dates, "transfers": transfers, "fare_attributes": fares, "fare_rules": net["fare_rules"], "feed_info": info}


def write_feed(net: dict[str, DataFrame], folder: str) -> None:
    """A folder of CSV for each table; stop times are sorted within their files by trip and number."""
    for name, df in feed_tables(net).items():
        if name == "stop_times":
            df = df.repartition("trip_id").sortWithinPartitions("trip_id", "stop_sequence")
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def region_feed(net: dict[str, DataFrame], route_regions: DataFrame, region: str, snapshot: str) -> dict[str, DataFrame]:
    """The part of a network that serves a region, with a deterministic feed id and a year's validity."""
    routes = net["routes"].join(route_regions.where(F.col("region") == region).select("route_id"), "route_id", "left_semi")
    trips = net["trips"].join(routes.select("route_id"), "route_id", "left_semi")
    times = net["stop_times"].join(trips.select("trip_id"), "trip_id", "left_semi")
    stops = net["stops"].join(times.select("stop_id"), "stop_id", "left_semi")
    both = net["transfers"].join(stops.select(F.col("stop_id").alias("from_stop")), "from_stop", "left_semi").join(stops.select(F.col("stop_id").alias("to_stop")), "to_stop", "left_semi")
    return dict(net) | {"routes": routes, "trips": trips, "stop_times": times, "stops": stops, "transfers": both}


def feed_version(region: str, snapshot: str, spark: SparkSession) -> DataFrame:
    one = spark.range(1)
    return one.select(F.concat(F.lit(f"{region}-"), F.substring(F.sha2(F.lit(f"{region}|{snapshot}"), 256), 1, 12)).alias("feed_id"), F.lit(snapshot).alias("version"), F.to_date(F.lit(snapshot)).alias("valid_from"), F.add_months(F.to_date(F.lit(snapshot)), 12).alias("valid_to"))


def write_feed_by_region(net: dict[str, DataFrame], route_regions: DataFrame, regions: list[str], snapshot: str, folder: str) -> None:
    """One feed folder a region."""
    for region in regions:
        write_feed(region_feed(net, route_regions, region, snapshot), f"{folder}/region={region}")


def write_ops_log(rows: DataFrame, folder: str) -> None:
    """Append operation rows as JSON lines."""
    rows.write.mode("append").json(folder)


def read_ops_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last done line of each chunk key."""
    rows = spark.read.schema(schema).json(folder).where("state = 'done'")
    return rows.groupBy("chunk_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "chunk_key"]), "at").alias("x")).select("chunk_key", "x.*")


def write_review_csv(reviews: DataFrame, folder: str) -> None:
    """Reviews with five columns and a header."""
    reviews.select("entity_type", "entity_id", "reason", "score", "observed_at").write.mode("overwrite").option("header", True).csv(folder)


def write_staging(records: DataFrame, folder: str) -> None:
    """Staging rows in one folder for each run."""
    records.write.mode("append").partitionBy("run_id").parquet(folder)
