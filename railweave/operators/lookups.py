"""Joins by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railweave.operators.sequences import first_per_key


def fare_for_leg(legs: DataFrame, rules: DataFrame, zones: DataFrame, fares: DataFrame) -> DataFrame:
    """Fare of the first rule, in list order, whose route and zones are blank or match.

    Blank columns are wildcards, so a case is looked up under its eight patterns of
    kept and blanked values: an equi-join, whatever the number of rules. A case is
    a route and the zones of both stops; legs share few, so the legs themselves are
    neither multiplied nor sorted.
    """
    held = zones.groupBy("stop_id").agg(F.array_sort(F.collect_set(F.coalesce(F.col("zone_id").cast("string"), F.lit("")))).alias("zones"))
    z = lambda side: held.select(F.col("stop_id").alias(f"{side}_stop"), F.col("zones").alias(f"_{side}"))
    bare = F.array(F.lit(""))
    route = F.coalesce(F.col("route_id").cast("string"), F.lit(""))
    rows = legs.join(z("from"), "from_stop", "left").join(z("to"), "to_stop", "left").withColumns({"_route": route, "_from": F.coalesce("_from", bare), "_to": F.coalesce("_to", bare)})
    case = ["_route", "_from", "_to"]
    asked = rows.select(*case).distinct().select(*case, F.explode("_from").alias("a")).select(*case, "a", F.explode("_to").alias("b"))
    sep = "\u0001"
    patterns = F.array_distinct(F.array(*[F.concat_ws(sep, *[F.col(c) if mask >> i & 1 else F.lit("") for i, c in enumerate(("_route", "a", "b"))]) for mask in range(8)]))
    key = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("route_id", "from_zone", "to_zone")])
    known = first_per_key(rules.withColumn("_k", key), ["_k"], ["rule_no"]).select("_k", "rule_no", "fare_id")
    hits = asked.select(*case, F.explode(patterns).alias("_k")).join(known, "_k")
    best = hits.groupBy(*case).agg(F.min(F.struct("rule_no", "fare_id")).alias("x")).select(*case, "x.fare_id")
    told = rows.join(best.join(fares.select("fare_id", "price", "currency"), "fare_id"), case, "left")
    return told.select("leg_id", *[c for c in legs.columns if c != "leg_id"], "fare_id", "price", "currency")


def join_by_code(df: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Terminal of each (system, code): primary first, then the lowest id."""
    one = first_per_key(identifiers, ["system", "code"], [F.desc("is_primary"), "terminal_id"]).select("system", "code", "terminal_id")
    return df.join(one, ["system", "code"], "left")


def dead_terminals(terminals: DataFrame, stop_times: DataFrame, live: bool = False) -> DataFrame:
    """Terminals without any stop time, or with ``live`` those with one."""
    return terminals.join(stop_times.select("terminal_id"), "terminal_id", "left_semi" if live else "left_anti")


def legacy_terminals(terminals: DataFrame, attributes: DataFrame, skeleton: bool = False) -> DataFrame:
    """Terminals without an attribute written by a skeleton run, or with ``skeleton`` those with one."""
    written = attributes.where("run_kind = 'skeleton'").select("terminal_id")
    return terminals.join(written, "terminal_id", "left_semi" if skeleton else "left_anti")


def review_view(reviews: DataFrame, terminals: DataFrame, identifiers: DataFrame, log: DataFrame) -> DataFrame:
    """Reviews with their terminal's point, lock and name, primary code and latest stage."""
    code = identifiers.where("is_primary").groupBy("terminal_id").agg(F.min("code").alias("code"))
    stage = log.groupBy("terminal_id").agg(F.max_by("stage", F.struct("at", "stage")).alias("stage"))
    t = terminals.select("terminal_id", "name", "lat", "lon", "locked")
    return reviews.join(t, "terminal_id", "left").join(code, "terminal_id", "left").join(stage, "terminal_id", "left")


def code_conflicts(matches: DataFrame, identifiers: DataFrame, system: str) -> DataFrame:
    """Codes owned by another terminal, and codes of matched terminals that no match of the run shows."""
    held = identifiers.where(F.col("system") == system).select("code", F.col("terminal_id").alias("owner"))
    other = matches.join(held, "code").where("terminal_id <> owner").select("terminal_id", "code", "owner", F.lit("possible_merge").alias("reason"))
    mine = held.join(matches.select(F.col("terminal_id").alias("owner")).distinct(), "owner")
    stale = mine.join(matches.select("code").distinct(), "code", "left_anti").select(F.col("owner").alias("terminal_id"), "code", "owner", F.lit("possible_merge").alias("reason"))
    return other.unionByName(stale).distinct()


def place_city(places: DataFrame, closure: DataFrame, level: int = 4) -> DataFrame:
    """The ancestor at city level of each place, with its name and time zone."""
    cities = places.where(F.col("level") == level).select(F.col("place_id").alias("ancestor"), F.col("name").alias("city"), "tz")
    hits = closure.join(cities, "ancestor")
    return first_per_key(hits, ["descendant"], ["depth", "ancestor"]).select(F.col("descendant").alias("place_id"), F.col("ancestor").alias("city_id"), "city", "tz")


def terminal_card(terminals: DataFrame, tags: DataFrame, stats: DataFrame, aliases: DataFrame, reviews: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One row a terminal with what is known of it nested; lists are of one terminal each."""
    lists = lambda df, name, *cols: df.groupBy("terminal_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = terminals.join(tags.groupBy("terminal_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("tags")), "terminal_id", "left").join(stats, "terminal_id", "left")
    for df, name, cols in ((aliases, "aliases", ("alias",)), (reviews, "reviews", ("reason", "score")), (identifiers, "identifiers", ("system", "code_type", "code"))):
        out = out.join(lists(df, name, *cols), "terminal_id", "left")
    return out


def rank_within(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
