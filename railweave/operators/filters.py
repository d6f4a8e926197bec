"""Row filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions import clock, geo, names


def filter_bbox(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside (south, west, north, east); rows without a point go."""
    south, west, north, east = box
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def auto_bbox(df: DataFrame, other: DataFrame, margin: float = 1.0) -> DataFrame:
    """Rows of ``other`` inside the box of ``df``'s points plus a margin. The box is one row."""
    box = df.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.col("lat").between(F.col("lo_lat") - margin, F.col("hi_lat") + margin) & F.col("lon").between(F.col("lo_lon") - margin, F.col("hi_lon") + margin)
    return other.join(F.broadcast(box), inside).select(*other.columns)


def _open(allow: list[str]) -> bool:
    wanted = [x.strip() for x in allow if x.strip()]
    return not wanted or any(x.lower() in ("all", "*") for x in wanted)


def filter_regions(df: DataFrame, allow: list[str], column: str = "region") -> DataFrame:
    """Rows of allowed regions; an array column passes if any of its regions is allowed."""
    if _open(allow):
        return df
    if dict(df.dtypes)[column].startswith("array"):
        return df.where(F.arrays_overlap(column, F.array(*[F.lit(x.strip()) for x in allow])))
    return df.where(F.col(column).isin([x.strip() for x in allow]))


def mode_list(csv: Column, known: tuple[str, ...] = ("bus", "rail", "tram", "metro", "flight", "walk")) -> Column:
    """Modes named in a comma list; coach is bus; unknown words and repeats go."""
    words = F.transform(F.split(F.lower(csv), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.transform(words, lambda m: F.when(m == "coach", "bus").otherwise(m)), lambda m: m.isin(*known)))


def filter_modes(df: DataFrame, csv: str, column: str = "mode") -> DataFrame:
    """Rows whose mode is allowed; an empty list allows all."""
    modes = mode_list(F.lit(csv))
    return df.where((F.size(modes) == 0) | F.array_contains(modes, F.when(F.col(column) == "coach", "bus").otherwise(F.col(column))))


def filter_service_days(trips: DataFrame, day: Column) -> DataFrame:
    """Trips whose day string is empty or names the weekday of ``day``."""
    days = F.coalesce(F.col("service_days"), F.lit(""))
    return trips.where((days == "") | F.array_contains(F.split(days, ","), clock.weekday(day).cast("string")))


def service_active(requests: DataFrame, services: DataFrame, days: DataFrame, exceptions: DataFrame, added_wins: bool = False) -> DataFrame:
    """(service_id, day) rows with ``active`` by the calendar rule.

    Unknown services run; outside the dates nothing runs, an added day neither
    unless ``added_wins``; then exceptions, then weekdays, and no weekday rows
    mean every day.
    """
    weekly = days.groupBy("service_id").agg(F.collect_set("weekday").alias("weekdays"))
    special = exceptions.groupBy("service_id", F.col("date").alias("day")).agg(F.max("exception_type").alias("special"))
    rows = requests.join(services, "service_id", "left").join(weekly, "service_id", "left").join(special, ["service_id", "day"], "left")
    outside = (F.col("day") < F.col("start_date")) | (F.col("day") > F.col("end_date"))
    rule = F.when(F.col("start_date").isNull(), True)
    if added_wins:
        rule = rule.when(F.col("special") == "added", True)
    rule = rule.when(outside, False).when(F.col("special") == "removed", False).when(F.col("special") == "added", True)
    rule = rule.when(F.col("weekdays").isNull(), True).otherwise(F.array_contains("weekdays", clock.weekday(F.col("day"))))
    return rows.select(*requests.columns, rule.alias("active"))


def leg_speeds(connections: DataFrame, stops: DataFrame) -> DataFrame:
    """Connections with km, hours and speed columns; NULL where an end has no point."""
    point = lambda side: stops.select(F.col("stop_id").alias(f"{side}_stop"), F.when((F.col("lat") != 0) | (F.col("lon") != 0), F.col("lat")).alias(f"{side}_lat"), F.when((F.col("lat") != 0) | (F.col("lon") != 0), F.col("lon")).alias(f"{side}_lon"))
    rows = connections.join(point("from"), "from_stop", "left").join(point("to"), "to_stop", "left")
    km = geo.haversine_km(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    hours = (F.col("arrival_s") - F.col("departure_s")) / 3600.0
    return rows.select(*connections.columns, km.alias("km"), hours.alias("hours"), F.when(hours > 0, km / hours).alias("kmh"))


def is_implausible(mode: Column) -> Column:
    """A leg of 5 km or more that is faster than its mode's cap; columns of :func:`leg_speeds`."""
    return F.coalesce((F.col("km") >= 5) & (F.col("hours") > 0) & (F.col("kmh") > clock.max_speed(mode)), F.lit(False))


def drop_implausible(connections: DataFrame, stops: DataFrame) -> DataFrame:
    """Legs that are plausible or can't be told."""
    return leg_speeds(connections, stops).where(~is_implausible(F.col("mode"))).select(*connections.columns)


def live_only(df: DataFrame) -> DataFrame:
    """Rows that are not closed."""
    return df.where("valid_to IS NULL")


def live_trips(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Live trips of live routes."""
    return live_only(trips).join(live_only(routes).select("route_id"), "route_id", "left_semi")


def filter_providers(df: DataFrame, allow: list[str]) -> DataFrame:
    """Rows of allowed providers; an empty list allows all."""
    return df.where(F.col("provider").isin(allow)) if allow else df


def exclude_bad_stops(network: dict[str, DataFrame], issues: DataFrame) -> dict[str, DataFrame]:
    """A network without the stops that have coordinate warnings and whatever touches them."""
    bad = issues.where("severity = 'warn' AND field = 'coordinates'").select(F.col("entity_id").alias("stop_id")).distinct()
    gone = network["stop_times"].join(bad, "stop_id", "left_semi").select("trip_id").distinct()
    drop = lambda df, col: df.join(bad.select(F.col("stop_id").alias(col)), col, "left_anti")
    out = dict(network)
    out["stops"] = drop(network["stops"], "stop_id")
    for name in ("trips", "stop_times", "connections"):
        if name in out:
            out[name] = out[name].join(gone, "trip_id", "left_anti")
    for name in ("connections", "transfers"):
        if name in out:
            out[name] = drop(drop(out[name], "from_stop"), "to_stop").select(*network[name].columns)
    return out


def search_text(df: DataFrame, query: str, columns: list[str], aliases: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows where a column or an alias holds the text, whatever the case."""
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    if aliases is None:
        return df.where(hit)
    named = aliases.where(F.contains(F.lower("alias"), needle)).select(key).distinct().withColumn("_named", F.lit(True))
    return df.join(named, key, "left").where(hit | F.coalesce("_named", F.lit(False))).select(*df.columns)


def validate_bounds(stops: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """An issue row for each stop outside the provider's box."""
    south, west, north, east = box
    out = ~(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return stops.where(out).select(F.lit("stop").alias("entity"), F.col("stop_id").alias("entity_id"), F.lit("warn").alias("severity"), F.lit("coordinates").alias("field"), F.lit("outside the provider's bounds").alias("message"))


def region_plausible(points: DataFrame, centers: DataFrame, large: list[str], near_km: float = 600.0, far_km: float = 800.0, box=(41.0, 19.0, 82.0, 191.0)) -> DataFrame:
    """``plausible`` for points with a region: near its centre, or in the country's box without one.

    ``centers`` has one row for each region (region, clat, clon); it is joined by
    equality and left to the optimizer.
    """
    rows = points.join(centers, "region", "left")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    limit = F.when(F.col("region").isin(large), far_km).otherwise(near_km) if large else F.lit(near_km)
    coarse = F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
    return rows.select(*points.columns, F.when(F.col("clat").isNull(), coarse).otherwise(km <= limit).alias("plausible"))


def route_attachable(routes: DataFrame, blocked: list[str], force: bool = False) -> DataFrame:
    """Routes with ``attachable``, false if any of their regions is blocked."""
    hit = F.arrays_overlap("regions", F.array(*[F.lit(x) for x in blocked])) if blocked and not force else F.lit(False)
    return routes.withColumn("attachable", ~F.coalesce(hit, F.lit(False)))


def barrier_waiting(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: regions still missing, in order, and whether none is."""
    missing = wanted.select("region").distinct().join(done.select("region").distinct(), "region", "left_anti")
    return missing.agg(F.sort_array(F.collect_list("region")).alias("waiting")).withColumn("open", F.size("waiting") == 0)


def with_settlement(terminals: DataFrame, tags: DataFrame) -> DataFrame:
    """Settlement from the manual tag, else from the name; ``manual`` tells which."""
    rows = terminals.join(tags.select("terminal_id", F.nullif("settlement", F.lit("")).alias("_tag")), "terminal_id", "left")
    return rows.select(*[c for c in terminals.columns if c != "settlement"], F.coalesce("_tag", names.extract_settlement(F.col("name"))).alias("settlement"), F.col("_tag").isNotNull().alias("manual"))
