"""The day's network from canon tables or from several providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.operators.filters import filter_providers, filter_service_days, live_only, service_active
from railweave.operators.sequences import build_connections, first_per_key


def load_network(tables: dict[str, DataFrame], day: Column, providers: list[str] = [], calendar: str = "string") -> dict[str, DataFrame]:
    """Stops, trips, stop times, connections of a day, lazily; dimension rows pass through.

    Stops without a name or point take their terminal's. Trips run by their day
    string, or with ``calendar='full'`` by services, weekdays and exceptions.
    """
    terminals = tables["terminals"].select("terminal_id", F.col("name").alias("tname"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    stops = filter_providers(tables["stops"], providers).join(terminals, "terminal_id", "left")
    stops = stops.select("stop_id", "terminal_id", F.coalesce(F.nullif("name", F.lit("")), "tname").alias("name"), F.coalesce("lat", "tlat").alias("lat"), F.coalesce("lon", "tlon").alias("lon"))
    routes = live_only(filter_providers(tables["routes"], providers))
    trips = live_only(tables["trips"]).join(routes.select("route_id", "mode"), "route_id")
    if calendar == "string":
        trips = filter_service_days(trips, day)
    else:
        asked = trips.select("service_id", day.alias("day")).distinct()
        runs = service_active(asked, tables["services"], tables["service_days"], tables["service_exceptions"]).where("active")
        trips = trips.join(runs.select("service_id"), "service_id", "left_semi")
    times = tables["stop_times"].join(trips.select("trip_id"), "trip_id", "left_semi")
    trips = trips.join(times.select("trip_id").distinct(), "trip_id", "left_semi")
    legs = build_connections(times).join(trips.select("trip_id", "route_id", "mode"), "trip_id")
    out = {"stops": stops, "routes": routes, "trips": trips, "stop_times": times, "connections": legs, "modes": trips.select("trip_id", "mode")}
    return out | {k: tables[k] for k in ("transfers", "fares", "fare_rules", "zones") if k in tables}


REFERENCES = {"stop_times": (("trip_id", "trips"), ("stop_id", "stops")), "trips": (("route_id", "routes"),), "connections": (("trip_id", "trips"), ("from_stop", "stops"), ("to_stop", "stops")), "transfers": (("from_stop", "stops"), ("to_stop", "stops"))}
OWN_KEY = {"stops": "stop_id", "routes": "route_id", "trips": "trip_id"}


def merge_networks(nets: list[tuple[str, dict[str, DataFrame]]]) -> dict[str, DataFrame]:
    """Union of providers' networks; text ids that clash with an earlier provider's take the provider as prefix.

    References follow their ids. Connections that arrive before they leave are dropped.
    """
    tagged: dict[str, DataFrame] = {}
    for i, (provider, net) in enumerate(nets):
        for name, df in net.items():
            part = df.withColumn("_i", F.lit(i)).withColumn("_p", F.lit(provider))
            tagged[name] = part if name not in tagged else tagged[name].unionByName(part, allowMissingColumns=True)
    renames = {}
    for name, key in OWN_KEY.items():
        if name in tagged:
            first = tagged[name].groupBy(key).agg(F.min("_i").alias("_first"))
            renames[name] = tagged[name].select(key, "_i", "_p").distinct().join(first, key).select(F.col(key).alias("_old"), "_i", F.when(F.col("_i") == F.col("_first"), F.col(key)).otherwise(F.concat_ws(":", "_p", key)).alias("_new"))
    out = {}
    for name, df in tagged.items():
        for column, kind in ((OWN_KEY[name], name),) * (name in OWN_KEY) + REFERENCES.get(name, ()):
            if kind in renames and column in df.columns:
                df = df.withColumnRenamed(column, "_old").join(renames[kind], ["_old", "_i"], "left").withColumn(column, F.coalesce("_new", "_old")).drop("_old", "_new")
        if name == "connections":
            df = df.where("arrival_s >= departure_s")
        if name in ("services", "carriers", "zones", "fares"):
            df = first_per_key(df, [df.columns[0]], ["_i"])
        out[name] = df.drop("_i", "_p")
    return out
