"""Aggregations over stops, trips, outcomes and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.functions import names
from railweave.operators.graph import drop, keep
from railweave.operators.sequences import first_per_key


def coverage_by_region(best: DataFrame, soft: float) -> DataFrame:
    """Stops and matched stops of each region; ``best`` has (stop_id, region, score), score NULL without candidates."""
    hit = F.coalesce(F.col("score") >= soft, F.lit(False))
    out = best.groupBy("region").agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"))
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("matched") / F.col("total")))


def gate_pass(coverage: DataFrame, gate: float) -> DataFrame:
    """One row: regions below the gate, in order, and whether there is none."""
    low = F.sort_array(F.collect_list(F.when(F.col("ratio") < gate, F.col("region"))))
    return coverage.agg(low.alias("below")).withColumn("passed", F.size("below") == 0)


def threshold_sweep(best: DataFrame, thresholds: list[float], margin: float = 0.1) -> DataFrame:
    """Verified, margin band and rejected stops for each threshold, in one pass over the scores.

    ``best`` has each stop's best score, NULL counting as 0: the score alone tells,
    without the guard of a decision. The thresholds are columns of one aggregate,
    so nothing is multiplied.
    """
    aggs = []
    for i, t in enumerate(thresholds):
        score = F.coalesce("score", F.lit(0.0))
        sure, near = score >= t, (score < t) & (score >= t - margin)
        aggs += [F.count_if(sure).alias(f"v{i}"), F.count_if(near).alias(f"m{i}")]
    one = best.agg(F.count("*").alias("total"), *aggs)
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"v{i}").alias("verified"), F.col(f"m{i}").alias("in_margin")) for i, t in enumerate(thresholds)])
    rows = one.select("total", F.explode(cells).alias("x")).select("x.*", "total")
    rate = F.when(F.col("total") == 0, 1.0).otherwise(F.col("verified") / F.col("total"))
    return rows.withColumn("rejected", F.col("total") - F.col("verified") - F.col("in_margin")).withColumn("rate", rate)


def calibrate(clean: DataFrame, shifted: DataFrame, thresholds: list[float], shift_degrees: float) -> DataFrame:
    """The sweep on clean and on shifted terminals; the shift in metres."""
    rows = threshold_sweep(clean, thresholds).withColumn("set", F.lit("clean")).unionByName(threshold_sweep(shifted, thresholds).withColumn("set", F.lit("shifted")))
    return rows.withColumn("shift_m", F.when(F.col("set") == "clean", 0.0).otherwise(shift_degrees * 111000.0))


def recommend_threshold(report: DataFrame, target: float) -> DataFrame:
    """The highest threshold whose shifted rate reaches the target, else the lowest, with a reason."""
    noisy = report.where("set = 'shifted'") if "set" in report.columns else report
    one = noisy.agg(F.max(F.when(F.col("rate") >= target, F.col("threshold"))).alias("best"), F.min("threshold").alias("least"))
    return one.select(F.coalesce("best", "least").alias("threshold"), F.when(F.col("best").isNull(), "no threshold reaches the target").otherwise("highest that reaches the target").alias("reason"))


def compare_gates(best: DataFrame, soft: float) -> DataFrame:
    """Soft and verified rates of each region; ``best`` has (region, score, decision)."""
    return best.groupBy("region").agg((F.count_if(F.col("score") >= soft) / F.count("*")).alias("soft_rate"), (F.count_if(F.col("decision") == "verified") / F.count("*")).alias("verified_rate"))


OUTCOMES = ["promoted", "staged", "dead"]


def summarize_by_route(outcomes: DataFrame) -> DataFrame:
    """Trips in, promoted, staged and dead of each route."""
    return outcomes.groupBy("route_id").agg(F.count("*").alias("n_in"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def full_trip_rate(outcomes: DataFrame) -> DataFrame:
    """Promoted over all; 1 when there are none."""
    return outcomes.agg(F.when(F.count("*") == 0, 1.0).otherwise(F.count_if(F.col("outcome") == "promoted") / F.count("*")).alias("rate"))


def churn(previous: DataFrame, current: DataFrame, threshold: float = 0.2) -> DataFrame:
    """One row of shares, counts and the alert for two key tables (trip_id); alert only if there was something before."""
    both = previous.select("trip_id", F.lit(1).alias("o")).join(current.select("trip_id", F.lit(1).alias("c")), "trip_id", "full_outer")
    one = both.agg(F.count("o").alias("old"), F.count("c").alias("new"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("c").isNull()).alias("removed"))
    most = F.greatest("old", "new")
    out = one.withColumn("churn", F.when(most == 0, 0.0).otherwise((F.col("added") + F.col("removed")) / most)).withColumn("disappeared", F.when(F.col("old") == 0, 0.0).otherwise(F.col("removed") / F.col("old")))
    return out.withColumn("alert", (F.col("old") > 0) & ((F.col("churn") > threshold) | (F.col("disappeared") > threshold)))


def row_balance(summary: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """The rows of ``summary``; reading one whose parts don't add up to its total fails."""
    whole = F.lit(0)
    for p in parts:
        whole = whole + F.col(p)
    return summary.withColumn("balanced", F.assert_true(F.col(total) == whole, F.lit("outcomes do not add up to input")).isNull())


def count_by_state(staging: DataFrame) -> DataFrame:
    """D13"""
    return staging.groupBy("state").agg(F.count("*").alias("n"))


def terminal_stats(terminals: DataFrame, stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop times, provisional ones, live trips and the dead flag of each terminal."""
    rows = stop_times.join(trips.select("trip_id", F.col("valid_to").isNull().alias("live")), "trip_id", "left")
    per = rows.groupBy("terminal_id").agg(F.count("*").alias("times"), F.count_if("provisional").alias("provisional"), F.count_distinct(F.when(F.col("live"), F.col("trip_id"))).alias("live_trips"))
    out = terminals.select("terminal_id").join(per, "terminal_id", "left").na.fill(0, ["times", "provisional", "live_trips"])
    return out.withColumn("dead", F.col("times") == 0)


def route_listing(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Routes with carrier and number of live trips."""
    n = trips.where("valid_to IS NULL").groupBy("route_id").agg(F.count("*").alias("live_trips"))
    return routes.join(n, "route_id", "left").na.fill(0, ["live_trips"])


def trip_listing(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Trips with stops, provisional stops and the live flag."""
    n = stop_times.groupBy("trip_id").agg(F.count("*").alias("stops"), F.count_if("provisional").alias("provisional"))
    return trips.join(n, "trip_id", "left").na.fill(0, ["stops", "provisional"]).withColumn("live", F.col("valid_to").isNull())


def route_regions(routes: DataFrame, schedules: DataFrame) -> DataFrame:
    """Distinct (route_id, region) of the code's prefix and of the stops."""
    own = routes.select("route_id", F.substring("code", 1, 2).alias("region")).where("length(region) = 2")
    return own.union(schedules.select("route_id", "region").where("region IS NOT NULL")).distinct()


def price_totals(legs: DataFrame) -> DataFrame:
    """Sums by currency of each journey; a total where there is one currency, else mixed."""
    by = legs.groupBy("journey_id", "currency").agg(F.sum("price").alias("amount"))
    rows = by.groupBy("journey_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("currency", "amount")))).alias("totals"), F.count("*").alias("_n"), F.max("amount").alias("_a"))
    return rows.select("journey_id", "totals", (F.col("_n") > 1).alias("mixed"), F.when(F.col("_n") == 1, F.col("_a")).alias("total"))


def registry_stops(trip_stops: DataFrame) -> DataFrame:
    """Distinct stops of all trips, first occurrence first, with the settlement in the name."""
    return first_per_key(trip_stops, ["stop_id"], ["trip_id", "seq"]).select("stop_id", "name", names.extract_settlement(F.col("name")).alias("settlement"))


def origin_stops(stop_times: DataFrame) -> DataFrame:
    """Stops at which some trip begins."""
    return stop_times.groupBy("trip_id").agg(F.min_by("stop_id", "seq").alias("stop_id")).select("stop_id").distinct()


def network_bounds(connections: DataFrame) -> DataFrame:
    """D21"""
    return connections.agg(F.min("departure_s").alias("first_departure_s"), F.max("arrival_s").alias("last_arrival_s"))


def feed_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of a feed; each count is an aggregate of its own table."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def provider_health(stops: DataFrame, issues: DataFrame) -> DataFrame:
    """Records, issues and excluded stops of each provider."""
    per = stops.groupBy("provider").agg(F.count("*").alias("records"))
    bad = issues.groupBy("provider").agg(F.count("*").alias("issues"), F.count_distinct(F.when((F.col("severity") == "warn") & (F.col("field") == "coordinates"), F.col("entity_id"))).alias("excluded"))
    return per.join(bad, "provider", "left").na.fill(0, ["issues", "excluded"])


def daily_quota(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Calls with ``admitted``, by order within provider and day."""
    day = F.to_date("ts")
    rank = F.row_number().over(Window.partitionBy("provider", "day").orderBy("ts", "event_id"))
    rows = calls.withColumn("day", day).withColumn("nth", rank).join(limits, "provider", "left")
    return rows.withColumn("admitted", F.coalesce(F.col("nth") <= F.col("quota"), F.lit(False)))


def kpi_report(coverage: DataFrame, outcomes: DataFrame, staging: DataFrame, shares: DataFrame) -> DataFrame:
    """(kpi, region, value): match rate and full trip rate by region, stuck staging, churn."""
    a = coverage.select(F.lit("match_rate").alias("kpi"), "region", F.col("ratio").alias("value"))
    b = outcomes.groupBy("region").agg((F.count_if(F.col("outcome") == "promoted") / F.count("*")).alias("value")).select(F.lit("full_trip_rate").alias("kpi"), "region", "value")
    c = staging.agg(F.count_if(F.col("state") != "expired").cast("double").alias("value")).select(F.lit("stuck_staging").alias("kpi"), F.lit(None).cast("string").alias("region"), "value")
    d = shares.select(F.lit("churn").alias("kpi"), F.lit(None).cast("string").alias("region"), F.col("churn").alias("value"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def closure_table(places: DataFrame, root: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth) of a parent-pointer hierarchy, depth 0 included.

    Doubles the reach each round, so a hierarchy of depth d takes log2(d) joins. A
    place that is its own ancestor has no depth: that raises an error.
    """
    up = places.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("ancestor"), F.col("place_id").alias("descendant"), F.lit(1).alias("depth"))
    reach, have = 1, keep(up, "closure")
    while True:
        if not have.where("ancestor = descendant").isEmpty():
            raise ValueError("the hierarchy runs in a circle")
        step = have.where(F.col("depth") == reach)
        far = have.alias("a").join(step.alias("b"), F.col("a.ancestor") == F.col("b.descendant")).select("b.ancestor", "a.descendant", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        more = keep(have.unionByName(far).distinct(), "closure")
        if more.where(F.col("depth") > reach).isEmpty():
            drop(more)
            break
        drop(have)
        have, reach = more, reach * 2
    own = places.select(F.col("place_id").alias("ancestor"), F.col("place_id").alias("descendant"), F.lit(0).alias("depth"))
    full = own.unionByName(have)
    if root is None:
        return full
    below = full.where(F.col("ancestor") == root).select("descendant").distinct()
    return full.join(below, "descendant", "left_semi").join(below.withColumnRenamed("descendant", "ancestor"), "ancestor", "left_semi").select("ancestor", "descendant", "depth")


def closure_update(closure: DataFrame, places: DataFrame, changed: DataFrame) -> DataFrame:
    """The closure after an edit; ``changed`` (place_id) holds the places that are new, gone or have another parent.

    ``closure`` is that of the hierarchy before, ``places`` the one after. Only
    rows of the changed places and of what lay below them are made anew: within
    that part by doubling, and above it from the rows that stay. Unchanged places
    keep their rows, which are read once and not joined among themselves.
    """
    stale = keep(closure.join(changed.select(F.col("place_id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("place_id")).union(changed.select("place_id")).distinct(), "stale")
    stays = closure.join(stale.select(F.col("place_id").alias("descendant")), "descendant", "left_anti").select("ancestor", "descendant", "depth")
    rows = places.select("place_id", "parent_id").join(stale, "place_id", "left_semi")
    marked = keep(rows.join(stale.select(F.col("place_id").alias("parent_id"), F.lit(True).alias("inside")), "parent_id", "left"), "moved")
    inner = closure_table(marked.select("place_id", F.when(F.col("inside"), F.col("parent_id")).alias("parent_id")))
    roots = marked.where("inside IS NULL AND parent_id IS NOT NULL").select(F.col("place_id").alias("top"), F.col("parent_id").alias("up"))
    above = roots.join(stays.where("depth > 0"), F.col("up") == F.col("descendant")).select("top", "ancestor", "depth")
    above = above.union(roots.select("top", F.col("up").alias("ancestor"), F.lit(0).alias("depth")))
    outer = above.join(inner.select(F.col("ancestor").alias("top"), "descendant", F.col("depth").alias("down")), "top").select("ancestor", "descendant", (F.col("depth") + 1 + F.col("down")).alias("depth"))
    return stays.union(inner.select("ancestor", "descendant", "depth")).union(outer)


def closure_diff(places: DataFrame, closure: DataFrame) -> DataFrame:
    """For each descendant the ancestors its closure rows lack or have too many."""
    k = ["ancestor", "descendant"]
    both = closure_table(places).select(*k, F.lit(1).alias("w")).join(closure.select(*k, F.lit(1).alias("h")), k, "full_outer")
    lists = both.groupBy("descendant").agg(F.sort_array(F.collect_list(F.when(F.col("h").isNull(), F.col("ancestor")))).alias("missing"), F.sort_array(F.collect_list(F.when(F.col("w").isNull(), F.col("ancestor")))).alias("extra"))
    return lists.where((F.size("missing") > 0) | (F.size("extra") > 0))


def provisional_stops(stop_times: DataFrame) -> DataFrame:
    """Stops with any provisional stop time."""
    return stop_times.groupBy("stop_id").agg(F.bool_or("provisional").alias("provisional")).where("provisional").select("stop_id")


def trip_stop_lists(stop_times: DataFrame) -> DataFrame:
    """The stops of each trip in order."""
    return stop_times.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))), lambda x: x["stop_id"]).alias("stops"))


def route_stop_lists(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """The distinct stops of each route."""
    return stop_times.join(trips.select("trip_id", "route_id"), "trip_id").groupBy("route_id").agg(F.sort_array(F.collect_set("stop_id")).alias("stops"))
