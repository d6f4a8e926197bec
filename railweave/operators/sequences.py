"""Windows over ordered stops and rankings within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.functions import geo, names


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


latest_per_key = first_per_key


def build_connections(stop_times: DataFrame) -> DataFrame:
    """A leg for each pair of consecutive stops; an arrival before its departure gains a day."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = stop_times.select("trip_id", "seq", F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop"), "departure_s", F.lead("arrival_s").over(w).alias("arrival_s")).where("to_stop IS NOT NULL")
    return rows.withColumn("arrival_s", F.when(F.col("arrival_s") < F.col("departure_s"), F.col("arrival_s") + 86400).otherwise(F.col("arrival_s")))


def unwrap_midnight(times: DataFrame, day: int = 1440) -> DataFrame:
    """Clock times (trip_id, seq, arr, dep) made non-decreasing by whole days.

    Arrivals and departures form one sequence; each descent starts a day.
    """
    flat = times.select("trip_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("arr").alias("t")), F.struct(F.lit(1).alias("half"), F.col("dep").alias("t")))).alias("x")).select("trip_id", "seq", "x.*")
    w = Window.partitionBy("trip_id").orderBy("seq", "half")
    drops = flat.withColumn("down", F.when(F.col("t") < F.lag("t").over(w), 1).otherwise(0))
    whole = drops.withColumn("t", F.col("t") + day * F.sum("down").over(w))
    return whole.groupBy("trip_id", "seq").agg(F.max(F.when(F.col("half") == 0, F.col("t"))).alias("arr"), F.max(F.when(F.col("half") == 1, F.col("t"))).alias("dep"))


def collapse_consecutive(stops: DataFrame, key: str = "stop_id") -> DataFrame:
    """Neighbouring rows of one stop become one, with the last departure; seq is renumbered."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    islands = stops.withColumn("_new", F.when(F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    merged = islands.groupBy("trip_id", "_island").agg(F.min_by(key, "seq").alias(key), F.min_by("arrival_s", "seq").alias("arrival_s"), F.max_by("departure_s", "seq").alias("departure_s"))
    return merged.select("trip_id", (F.col("_island") - 1).cast("int").alias("seq"), key, "arrival_s", "departure_s")


def check_monotonic(stops: DataFrame) -> DataFrame:
    """For each trip that goes back in time, the first stop where it does."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    bad = (F.col("arrival_s") > F.col("departure_s")) | (F.col("arrival_s") < F.col("previous"))
    return stops.withColumn("previous", F.lag("departure_s").over(w)).where(bad).groupBy("trip_id").agg(F.min("seq").alias("seq"))


def check_speeds(stops: DataFrame, terminals: DataFrame, cap_kmh: float = 200.0) -> DataFrame:
    """Legs above the cap with a verdict, dead if both ends are final, else needs_review.

    ``stops`` has terminal_id, ``terminals`` (terminal_id, lat, lon, final). The
    time is in whole minutes; none at all is infinitely fast beyond 50 m.
    """
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = stops.join(terminals.select("terminal_id", "lat", "lon", "final"), "terminal_id", "left")
    for c in ("lat", "lon", "final", "departure_s"):
        rows = rows.withColumn(f"p_{c}", F.lag(c).over(w))
    km = geo.haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    minutes = F.floor((F.col("arrival_s") - F.col("p_departure_s")) / 60)
    kmh = F.when(minutes > 0, km / (minutes / 60.0)).when(km >= 0.05, F.lit(1e9))
    return rows.withColumn("kmh", kmh).where(F.col("kmh") > cap_kmh).select("trip_id", "seq", "kmh", F.when(F.col("final") & F.col("p_final"), "dead").otherwise("needs_review").alias("verdict"))


def interpolate_position(stops: DataFrame) -> DataFrame:
    """Points of unmatched stops between matched ones of a trip.

    Shares go by duration, else distance, of the stops from the last matched one
    on, plus half of the own; without any weights by sequence.
    """
    back = Window.partitionBy("trip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("trip_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    weight = F.when(F.coalesce("duration", F.lit(0.0)) > 0, F.col("duration")).otherwise(F.coalesce("distance", F.lit(0.0)))
    rows = stops.withColumn("w", weight).withColumn("sum_before", F.coalesce(F.sum("w").over(back), F.lit(0.0)))
    here = F.when(F.col("matched"), F.struct("seq", "lat", "lon", "sum_before", "w"))
    rows = rows.withColumn("p", F.last(here, ignorenulls=True).over(back)).withColumn("n", F.first(here, ignorenulls=True).over(ahead))
    inside = rows.where(~F.col("matched") & F.col("p").isNotNull() & F.col("n").isNotNull())
    total = F.col("n.sum_before") - F.col("p.sum_before")
    any_weight = (total > 0) | (F.col("n.w") > 0)
    share = F.when(total > 0, (F.col("sum_before") - F.col("p.sum_before") + F.col("w") / 2) / total).otherwise((F.col("seq") - F.col("p.seq")) / (F.col("n.seq") - F.col("p.seq")))
    km = geo.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("n.lat"), F.col("n.lon"))
    sure = F.when(any_weight, 0.45).otherwise(0.3) * F.when(km > 50, 0.6).otherwise(1.0)
    at = lambda c: F.col(f"p.{c}") + (F.col(f"n.{c}") - F.col(f"p.{c}")) * share
    return inside.select("trip_id", "seq", at("lat").alias("lat"), at("lon").alias("lon"), sure.alias("confidence"), F.lit("seed").alias("origin"), F.when(any_weight, "duration_distance_share").otherwise("seq_proportional").alias("method"))


def elect_field(candidates: DataFrame) -> DataFrame:
    """The winning value of each entity's field.

    A row of a person wins; seeds count only among themselves; map sources gain
    0.15 on geometry; ties go to the latest observation, then to the first row.
    """
    bonus = F.when((F.col("field") == "geom") & F.col("source").isin("osm", "motis"), F.least(F.lit(1.0), F.col("confidence") + 0.15)).otherwise(F.col("confidence"))
    hand = F.col("actor_id").isNotNull()
    order = [F.desc(hand), F.asc(F.when(hand, F.col("event_id"))), F.asc((F.col("origin") == "seed") & ~hand), F.desc("score"), F.desc("observed_at"), F.asc("event_id")]
    return first_per_key(candidates.withColumn("score", bonus), ["entity_id", "field"], order)


def legacy_vote(votes: DataFrame, entities: DataFrame) -> DataFrame:
    """The most confident vote of each entity, the first on ties; a default where there is none."""
    best = first_per_key(votes, ["entity_id"], [F.desc("confidence"), F.asc("event_id")])
    return entities.join(best.select("entity_id", "source", "confidence"), "entity_id", "left").select("entity_id", F.coalesce("source", F.lit("mintrans")).alias("source"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def contest_fields(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Winners with ``updated``, true if no person set them and they differ from what stands."""
    won = elect_field(candidates).select("entity_id", "field", "value", "source", F.col("actor_id").isNotNull().alias("manual"))
    rows = won.join(current.select("entity_id", "field", F.col("value").alias("standing")), ["entity_id", "field"], "left")
    return rows.withColumn("updated", ~F.col("manual") & ~F.col("value").eqNullSafe(F.col("standing")))


def primary_identifier(identifiers: DataFrame) -> DataFrame:
    """The primary identifier of each terminal; a later one must rank above."""
    rank = F.when(F.col("system") == "manual", 4).when(F.col("system") == "yandex", 3).when(F.col("system") == "osm", 2).when(F.col("system") == "mintrans", 1).otherwise(0)
    return first_per_key(identifiers.withColumn("_r", rank), ["terminal_id"], [F.desc("_r"), F.asc("arrived")]).drop("_r")


def settlement_representative(terminals: DataFrame, stop_times: DataFrame) -> DataFrame:
    """One terminal for each settlement: most stop times, then kind, then id."""
    busy = stop_times.groupBy("terminal_id").agg(F.count("*").alias("times"))
    kind = F.when(F.col("kind") == "bus_station", 0).when(F.col("kind") == "station", 1).otherwise(2)
    rows = terminals.where(F.coalesce("settlement", F.lit("")) != "").join(busy, "terminal_id", "left").withColumn("times", F.coalesce("times", F.lit(0))).withColumn("_k", kind)
    return first_per_key(rows, ["settlement"], [F.desc("times"), F.asc("_k"), F.asc("terminal_id")]).drop("_k")


def load_settlements(gazetteer: DataFrame, canon: DataFrame) -> DataFrame:
    """A gazetteer in which plausible canon settlements replace or join places of their name."""
    key = names.normalize_name(F.col("name"))
    good = first_per_key(canon.where(names.is_plausible_settlement(F.col("name"))).withColumn("key", key), ["key"], ["name"]).select("key", F.col("name").alias("cname"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    rows = gazetteer.withColumn("key", key).join(good, "key", "full_outer")
    how = F.when(F.col("name").isNull(), "added").when(F.col("cname").isNotNull(), "replaced").otherwise("kept")
    return rows.select(F.coalesce("name", "cname").alias("name"), F.coalesce("clat", "lat").alias("lat"), F.coalesce("clon", "lon").alias("lon"), how.alias("outcome"))


def add_stops_to_gazetteer(stops: DataFrame) -> DataFrame:
    """One stop for each alias, the text before the comma; shortest name first."""
    alias = F.lower(F.trim(F.substring_index("name", ",", 1)))
    rows = stops.withColumn("alias", alias).where("alias <> ''")
    return first_per_key(rows, ["alias"], [F.length("name"), "name", "stop_id"])


def terminal_schedule(stop_times: DataFrame, trips: DataFrame, exceptions: DataFrame, day: Column, n: int) -> DataFrame:
    """The first ``n`` departures of each terminal on a day, filtered before they are counted."""
    special = exceptions.where(F.col("date") == day).groupBy("service_id").agg(F.max("exception_type").alias("special"))
    days = F.coalesce("service_days", F.lit(""))
    weekly = (days == "") | F.array_contains(F.split(days, ","), (F.dayofweek(day) - 1).cast("string"))
    runs = F.when(F.col("special") == "removed", False).when(F.col("special").isNotNull(), True).otherwise(weekly)
    rows = stop_times.join(trips, "trip_id").join(special, "service_id", "left").where(runs)
    rank = F.row_number().over(Window.partitionBy("stop_id").orderBy("departure_s", "trip_id", "seq"))
    return rows.withColumn("n", rank).where(F.col("n") <= n).select("stop_id", "n", "trip_id", "departure_s")


def trip_stop_times(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """A trip's stops in order with missing times filled from each other."""
    rows = stop_times.join(stops.select("stop_id", "name"), "stop_id", "left")
    return rows.select("trip_id", "seq", "name", F.coalesce("arrival_s", "departure_s").alias("arrival_s"), F.coalesce("departure_s", "arrival_s").alias("departure_s"))


def trip_duration(stop_times: DataFrame) -> DataFrame:
    """Seconds from first arrival to last departure; NULL under two stops or if negative."""
    span = F.max_by("departure_s", "seq") - F.min_by("arrival_s", "seq")
    return stop_times.groupBy("trip_id").agg(F.when((F.count("*") >= 2) & (span >= 0), span).alias("duration_s"))


def backbone_promotable(matched: Column, total: Column, ends: Column | None = None) -> Column:
    """Two matched stops and two thirds of all; with ``ends`` both ends too."""
    rule = (matched >= 2) & (matched * 3 >= total * 2)
    return rule if ends is None else rule & ends


def pareto_top(journeys: DataFrame, preference: str = "transfers", keep: int = 3) -> DataFrame:
    """The best ``keep`` distinct (arrival, transfers) of each request, ranked from 1."""
    order = ["transfers", "arrival_s"] if preference == "transfers" else ["arrival_s", "transfers"]
    once = first_per_key(journeys, ["request_id", "arrival_s", "transfers"], ["journey_id"])
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*order, "journey_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= keep)


def true_front(journeys: DataFrame) -> DataFrame:
    """E20, option: journeys that no other beats in arrival and transfers both."""
    fewer = F.min("transfers").over(Window.partitionBy("request_id").orderBy("arrival_s").rangeBetween(Window.unboundedPreceding, -1))
    same = F.min("transfers").over(Window.partitionBy("request_id", "arrival_s"))
    rows = journeys.withColumn("_f", fewer).withColumn("_s", same)
    return rows.where((F.col("transfers") == F.col("_s")) & (F.col("_f").isNull() | (F.col("transfers") < F.col("_f")))).drop("_f", "_s")


def pick_by_preference(journeys: DataFrame, preference: str = "transfers") -> DataFrame:
    """One journey for each request."""
    return pareto_top(journeys, preference, 1).drop("rank")


def attribute_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New attributes over old; observed_at moves only with the value or its confidence."""
    k = ["entity_id", "field"]
    o = old.select(*k, *[F.col(c).alias(f"o_{c}") for c in ("value", "confidence", "observed_at")])
    rows = o.join(new, k, "full_outer")
    fresh = F.col("observed_at").isNotNull()
    moved = ~(F.col("value").eqNullSafe(F.col("o_value")) & F.col("confidence").eqNullSafe(F.col("o_confidence")))
    return rows.select(*k, F.when(fresh, F.col("value")).otherwise(F.col("o_value")).alias("value"), F.when(fresh, F.col("confidence")).otherwise(F.col("o_confidence")).alias("confidence"), F.when(fresh & moved, F.col("observed_at")).otherwise(F.col("o_observed_at")).alias("observed_at"))
