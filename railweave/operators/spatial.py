"""Joins by place and name.

Distance joins become equi-joins on grid cells as wide as the radius: the left
side is copied to the cells around its own, the right side stays in its cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.functions import geo, names
from railweave.operators.sequences import first_per_key
from railweave.operators.tiling import tiles


def _cell_degrees(km: float, most_lat: float = 72.0) -> tuple[float, float]:
    """Cell height and width in degrees that hold ``km`` up to a latitude."""
    return km / 111.0, km / (111.0 * math.cos(math.radians(most_lat)))


def near_join(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """All columns of pairs within ``km``; left has lat, lon and right rlat, rlon. Points at (0, 0) or NULL pair with nothing."""
    dy, dx = _cell_degrees(km)
    row, col = (lambda la: F.floor(la / dy).cast("int")), (lambda lo: F.floor(lo / dx).cast("int"))
    real = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & ((F.col(a) != 0) | (F.col(b) != 0))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = left.where(real("lat", "lon")).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumn("_r", row(F.col("lat")) + F.col("_i")).withColumn("_c", col(F.col("lon")) + F.col("_j"))
    held = right.where(real("rlat", "rlon")).withColumn("_r", row(F.col("rlat"))).withColumn("_c", col(F.col("rlon")))
    pairs = spread.join(held, ["_r", "_c"]).withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")))
    return pairs.where(F.col("km") <= km).drop("_i", "_j", "_r", "_c")


def _right(stops: DataFrame, key: str = "stop_id", extra: tuple[str, ...] = ()) -> DataFrame:
    return stops.select(F.col(key).alias("other_id"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), *[F.col(c).alias(f"other_{c}") for c in extra])


def radius_join(stops: DataFrame, km: float) -> DataFrame:
    """Unordered pairs of stops within ``km``."""
    return near_join(stops.select("stop_id", "lat", "lon"), _right(stops), km).where("stop_id < other_id").select("stop_id", "other_id", "km")


def walk_transfers(stops: DataFrame, existing: DataFrame, metres: float = 400.0) -> DataFrame:
    """Walk links in both directions between stops near each other, besides those that exist; provisional stops get none."""
    pairs = radius_join(stops.where(~F.coalesce("provisional", F.lit(False))), metres / 1000.0)
    both = pairs.select(F.col("stop_id").alias("from_stop"), F.col("other_id").alias("to_stop"), "km").union(pairs.select("other_id", "stop_id", "km"))
    fresh = both.join(existing.select("from_stop", "to_stop"), ["from_stop", "to_stop"], "left_anti")
    return fresh.select("from_stop", "to_stop", geo.walk_transfer_minutes(F.col("km") * 1000).alias("minutes"))


def transfer_links(stops: DataFrame, km: float) -> DataFrame:
    """C14: links of near stops in both directions with minutes rounded up and whole metres."""
    pairs = radius_join(stops, km)
    both = pairs.select(F.col("stop_id").alias("from_stop"), F.col("other_id").alias("to_stop"), "km").union(pairs.select("other_id", "stop_id", "km"))
    return both.select("from_stop", "to_stop", geo.walk_minutes(F.col("km")).alias("minutes"), F.round(F.col("km") * 1000).cast("int").alias("metres"))


def nearest_stops(points: DataFrame, stops: DataFrame, max_walk_minutes: float = 30.0, limit: int | None = None) -> DataFrame:
    """(point_id, stop_id, km, rank) of stops in walking range, nearest first, then by id."""
    km = max_walk_minutes / 60 * geo.WALK_KMH
    rank = F.row_number().over(Window.partitionBy("point_id").orderBy("km", "other_id"))
    if limit is None:
        pairs = near_join(points.select("point_id", "lat", "lon"), _right(stops), km)
        return pairs.select("point_id", F.col("other_id").alias("stop_id"), "km", rank.alias("rank"))
    # Equal distances go by id, so of stops at one place only the first few can be among the nearest.
    first = F.row_number().over(Window.partitionBy("rlat", "rlon").orderBy("other_id"))
    few = _right(stops).withColumn("_n", first).where(F.col("_n") <= limit).drop("_n")
    pairs = near_join(points.select("point_id", "lat", "lon"), few, km)
    return pairs.select("point_id", F.col("other_id").alias("stop_id"), "km", rank.alias("rank")).where(F.col("rank") <= limit)


EARTH_KM = 6371.0


def _in_space(lat: Column, lon: Column) -> list[Column]:
    """Kilometres from the middle of the earth along three axes."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.lit(EARTH_KM) * F.cos(a) * F.cos(b), F.lit(EARTH_KM) * F.cos(a) * F.sin(b), F.lit(EARTH_KM) * F.sin(a)]


def nearest_of_all(points: DataFrame, stops: DataFrame, finest_km: float = 1.0) -> DataFrame:
    """(point_id, stop_id, km): the nearest of all stops, however far; the smallest id of equals.

    Cells are cubes in space, so neither poles nor the date line are special. From
    cells of a quarter of the earth down to ``finest_km``, each four times as fine as
    the one before, a point keeps the cells that can still hold its nearest stop:
    no further than the nearest of the cells' sample stops. Distances through the
    earth order stops as those around it do. Points and stops that are NULL or at
    (0, 0) are left out.
    """
    real = lambda df: df.where("lat IS NOT NULL AND lon IS NOT NULL AND (lat <> 0 OR lon <> 0)")
    axes, cell = ("x", "y", "z"), ["i", "j", "k"]
    sides = [finest_km * 4.0**n for n in range(math.ceil(math.log(EARTH_KM / finest_km, 4)), -1, -1)]
    at = lambda df: df.withColumns({a: c for a, c in zip(axes, _in_space(F.col("lat"), F.col("lon")), strict=True)})
    placed = at(real(stops).select("stop_id", "lat", "lon"))
    corner = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip((i, j, k), cell, strict=True)]) for i in (-1, 0) for j in (-1, 0) for k in (-1, 0)])
    front = at(real(points).select("point_id", "lat", "lon")).withColumn("c", F.explode(corner)).select("point_id", "lat", "lon", *axes, "c.*")
    for side in sides:
        own = [F.floor(F.col(a) / side).cast("int").alias(c) for a, c in zip(axes, cell, strict=True)]
        one = placed.select(*own, F.struct(*axes).alias("some")).groupBy(*cell).agg(F.min("some").alias("some"))
        if side is not sides[0]:
            finer = one.select(*[F.floor(F.col(c) / 4).cast("int").alias(c) for c in cell], F.struct(*cell).alias("sub"), "some")
        else:
            finer = one.select(*cell, F.struct(*cell).alias("sub"), "some")
        met = front.join(finer, cell)
        far = lambda c: F.sqrt(sum((F.col(a) - c(a, n)) ** 2 for a, n in zip(axes, cell, strict=True)))
        met = met.withColumn("most", far(lambda a, n: F.col(f"some.{a}"))).withColumn("least", far(lambda a, n, side=side: (F.col(f"sub.{n}") + 0.5) * side) - side * math.sqrt(3) / 2)
        bound = F.min("most").over(Window.partitionBy("point_id"))
        front = met.withColumn("bound", bound).where(F.col("least") <= F.col("bound") + 1e-6).select("point_id", "lat", "lon", *axes, "sub.*")
    held = placed.select("stop_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), *[F.floor(F.col(a) / sides[-1]).cast("int").alias(c) for a, c in zip(axes, cell, strict=True)])
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    best = front.join(held, cell).groupBy("point_id").agg(F.min(F.struct(km.alias("km"), "stop_id")).alias("x"))
    return best.select("point_id", "x.stop_id", "x.km")


def knn_staged(points: DataFrame, staged: DataFrame, km: float, k: int = 20) -> DataFrame:
    """The k nearest records of another source in the same run."""
    held = staged.select(F.col("code").alias("other_code"), F.col("source").alias("other_source"), F.col("run_id").alias("other_run"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    pairs = near_join(points, held, km).where("source <> other_source AND run_id = other_run")
    rank = F.row_number().over(Window.partitionBy("run_id", "source", "code").orderBy("km", "other_code"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("run_id", "source", "code", "other_source", "other_code", "km", "rank")


def _told(name: str) -> list[Column]:
    """What :func:`resolve_stop_coords` asks of a name, worked out once a row and not for each pair."""
    c = F.col(name)
    low = F.lower(c)
    return [names.core_name(c).alias("core"), names.normalize_name(c).alias("norm"), c.isNotNull().alias("named"), names.stop_type_signal(F.lit("hub"), c).alias("hub"), names.stop_type_signal(F.lit("airport"), c).alias("airport"), F.filter(F.array(*[F.lit(w) for w in names.CONTRAST]), lambda w: F.contains(low, w)).alias("telling")]


def resolve_stop_coords(stops: DataFrame, terminals: DataFrame, floor: float = 0.6, gap: float = 0.15) -> DataFrame:
    """C17: points for stops without one from the best-named terminal of their settlement.

    Terminals of the stop's settlement are tried; where there are none, those
    without a settlement. A type word adds 0.25, a telling word the stop lacks
    costs as much. A close second that also reaches the floor blocks.
    """
    # Stops of one name and settlement have one answer, and terminals of one name and settlement one score: each is worked out once.
    bare = stops.where("lat IS NULL OR lon IS NULL").select("settlement", F.col("name").alias("asked")).distinct().withColumn("name", F.col("asked"))
    bare = bare.select("settlement", "asked", names.infer_stop_type(F.col("name")).alias("kind"), *_told("name"))
    placed = terminals.where("lat IS NOT NULL AND lon IS NOT NULL").select("terminal_id", F.coalesce("settlement", F.lit("")).alias("tplace"), "name", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))

    def named(df: DataFrame) -> DataFrame:
        """A row for each name of a place with its two first terminals, as no more can count."""
        nth = F.row_number().over(Window.partitionBy("tplace", "name").orderBy("terminal_id"))
        two = df.withColumn("_n", nth).where("_n <= 2").groupBy("tplace", "name").agg(F.collect_list(F.struct("terminal_id", "tlat", "tlon")).alias("two"))
        return two.select("tplace", "two", *_told("name"))

    held = named(placed.dropDuplicates(["terminal_id", "tplace", "name"]))
    # Settlements meet as such, once each; their stops and terminals then meet by equality.
    keys = lambda df, c: df.select(c).distinct().withColumn("_key", F.explode(names.settlement_keys(F.col(c))))
    same = keys(bare, "settlement").join(keys(held, "tplace"), "_key").where(names.same_settlement(F.col("settlement"), F.col("tplace"))).select("settlement", "tplace").distinct()
    own = tiles(bare.join(same, "settlement"), held, ("tplace",))
    rest = bare.join(same.select("settlement").distinct(), "settlement", "left_anti")
    # Terminals without a settlement are open to all these stops by rule, and names need share no word.
    loose = tiles(rest, named(placed.where("tplace = ''")))
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    signal = F.when(x("kind") == "hub", y("hub")).when(x("kind") == "airport", y("airport")).otherwise(False)
    contrast = x("named") & (F.size(F.array_except(y("telling"), x("telling"))) > 0)
    total = names.core_similarity(x("core"), y("core"), x("norm"), y("norm")) + F.when(signal, 0.25).otherwise(0.0) - F.when(contrast, 0.25).otherwise(0.0)
    # Below the floor neither a best nor a second one counts, so no such pair leaves the comparison.
    ask = ["settlement", "asked"]
    rated = lambda df: df.select(x("settlement").alias("settlement"), "asked", "two", total.alias("score")).where(F.col("score") >= floor).select(*ask, "score", F.inline("two"))
    scored = rated(own).groupBy(*ask, "terminal_id").agg(F.max("score").alias("score"), F.max_by("tlat", "score").alias("tlat"), F.max_by("tlon", "score").alias("tlon")).unionByName(rated(loose))
    w = Window.partitionBy(*ask).orderBy(F.desc("score"), "terminal_id")
    top = scored.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("n = 1")
    good = top.where((F.col("score") >= floor) & (F.col("second").isNull() | (F.col("second") < floor) | (F.col("score") - F.col("second") >= gap)))
    found = good.select(F.col("settlement").alias("_place"), "asked", "tlat", "tlon", F.col("terminal_id").alias("resolved_by"))
    bare_stop = F.col("lat").isNull() | F.col("lon").isNull()
    rows = stops.join(found, bare_stop & F.col("settlement").eqNullSafe(F.col("_place")) & F.col("name").eqNullSafe(F.col("asked")), "left")
    return rows.withColumn("lat", F.coalesce("lat", "tlat")).withColumn("lon", F.coalesce("lon", "tlon")).drop("tlat", "tlon", "_place", "asked")


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(names.normalize_name(c), " "), lambda w: F.length(w) > 0))


def token_match(stops: DataFrame, stations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Station of each stop by shared words; overrides go first.

    Shared words over the larger word count, 0.3 more if the settlement is in the
    station's name, 0.05 for buses; 0.5 is enough, 0.8 if the settlement isn't there.
    """
    s = stops.withColumn("_t", _words(F.col("name")))
    t = stations.select("station_id", F.col("name").alias("sname"), F.col("transport").alias("stransport")).withColumn("_u", _words(F.col("sname")))
    pairs = s.withColumn("_w", F.explode("_t")).join(t.withColumn("_w", F.explode("_u")), "_w").drop("_w").dropDuplicates(["stop_id", "station_id"])
    settled = F.coalesce((F.col("settlement") != "") & F.contains(F.lower("sname"), F.lower("settlement")), F.lit(False))
    score = F.size(F.array_intersect("_t", "_u")) / F.greatest(F.size("_t"), F.size("_u")) + F.when(settled, 0.3).otherwise(0.0) + F.when(F.col("stransport") == "bus", 0.05).otherwise(0.0)
    rows = pairs.withColumn("score", score).where((F.col("score") >= 0.5) & (settled | (F.col("score") >= 0.8)))
    best = first_per_key(rows, ["stop_id"], [F.desc("score"), "station_id"]).select("stop_id", "station_id", "score", F.lit("tokens").alias("method"))
    fixed = overrides.select("stop_id", "station_id", F.lit(1.0).alias("score"), F.lit("override").alias("method"))
    return fixed.unionByName(best.join(fixed, "stop_id", "left_anti"))


def token_geo_match(stops: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """C20: place of each stop: with a point the nearest that shares a word; without one by words alone."""
    t = places.select("place_id", F.col("name").alias("pname"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).withColumn("_u", _words(F.col("pname")))
    s = stops.withColumn("_t", _words(F.col("name")))
    near = near_join(s, t, km).where(F.arrays_overlap("_t", "_u"))
    a = first_per_key(near, ["stop_id"], ["km", "place_id"]).select("stop_id", "place_id", F.lit("near").alias("method"))
    bare = s.where("lat IS NULL OR lon IS NULL").withColumn("_w", F.explode("_t")).join(t.withColumn("_w", F.explode("_u")), "_w").drop("_w").dropDuplicates(["stop_id", "place_id"])
    common = F.size(F.array_intersect("_t", "_u"))
    score = 2 * common - F.size("_u") - 0.1 * F.size("_t") + F.when((common == F.size("_t")) & (common == F.size("_u")), 10).otherwise(0)
    b = first_per_key(bare.withColumn("score", score), ["stop_id"], [F.desc("score"), "place_id"]).select("stop_id", "place_id", F.lit("words").alias("method"))
    return a.unionByName(b)


def place_match_cascade(stops: DataFrame, stations: DataFrame, gazetteer: DataFrame, overrides: DataFrame, centers: DataFrame, large: list[str]) -> DataFrame:
    """First rule that gives a point in the stop's region.

    Rules in order: same name, override of the settlement, longest gazetteer word
    in the name, hub station with the most shared words, gazetteer name as whole
    words, gazetteer word equal to a stop word's stem.
    """
    from railweave.operators.filters import region_plausible

    s = stops.select("stop_id", "name", "region", "settlement", names.normalize_name(F.col("name")).alias("_n")).withColumn("_t", _words(F.col("name")))
    st = stations.select(F.col("name").alias("hit"), names.normalize_name(F.col("name")).alias("_n"), F.col("lat"), F.col("lon"), "hub").withColumn("_u", _words(F.col("hit")))
    g = gazetteer.select(F.col("name").alias("hit"), names.normalize_name(F.col("name")).alias("_g"), "lat", "lon")
    base = ["stop_id", "region", "hit", "lat", "lon"]
    exact = s.join(st, "_n").select(*base, F.lit(1).alias("rule"), F.lit(0.0).alias("order"))
    by_city = s.join(overrides.select(F.col("settlement"), F.col("settlement").alias("hit"), "lat", "lon"), "settlement").select(*base, F.lit(2).alias("rule"), F.lit(0.0).alias("order"))
    word = s.withColumn("_g", F.explode("_t")).join(g, "_g").select(*base, F.lit(3).alias("rule"), (-F.length("_g")).cast("double").alias("order"))
    hubs = s.withColumn("_w", F.explode("_t")).join(st.where("hub").drop("_n").withColumn("_w", F.explode("_u")), "_w").select(*base, F.lit(4).alias("rule"), (-F.size(F.array_intersect("_t", "_u"))).cast("double").alias("order"))
    first_word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    whole = s.withColumn("_w", F.explode("_t")).join(g.withColumn("_w", first_word("_g")), "_w").where(names.word_bound_contains(F.col("_n"), F.col("_g"))).select(*base, F.lit(5).alias("rule"), (-F.length("_g")).cast("double").alias("order"))
    stem = s.withColumn("_w", F.explode("_t")).withColumn("_k", F.explode(names.settlement_keys(F.col("_w")))).join(g.withColumn("_k", F.explode(names.settlement_keys(F.col("_g")))), "_k").where(names.same_settlement(F.col("_w"), F.col("_g"))).select(*base, F.lit(6).alias("rule"), (-F.length("_g")).cast("double").alias("order"))
    hits = exact
    for more in (by_city, word, hubs, whole, stem):
        hits = hits.unionByName(more)
    good = region_plausible(hits, centers, large).where("plausible")
    return first_per_key(good, ["stop_id"], ["rule", "order", "hit", "lat", "lon"]).select("stop_id", "hit", "lat", "lon", "rule")


def resolve_hub(hubs: DataFrame, sources: DataFrame) -> DataFrame:
    """First source by priority that has a point for a hub's name or alias, facility words aside."""
    key = lambda c: names.core_name(c)
    asked = hubs.select("hub_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a")).select("hub_id", key(F.col("_a")).alias("_k")).where("_k <> ''").distinct()
    held = sources.where("lat IS NOT NULL AND lon IS NOT NULL AND (lat <> 0 OR lon <> 0)").withColumn("_k", key(F.col("name")))
    return first_per_key(asked.join(held, "_k"), ["hub_id"], ["priority", "name", "lat", "lon"]).select("hub_id", "source", "lat", "lon")


def gazetteer_resolve(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Point of a query: exact name, then shared word, then the shortest name that holds it as whole words."""
    q = queries.select("query_id", names.normalize_query(F.col("text")).alias("_q"))
    p = places.select("place_id", F.col("name").alias("place"), names.normalize_query(F.col("name")).alias("_p"), "lat", "lon")
    word = lambda c: F.explode(F.array_distinct(F.split(F.col(c), r"[\s,]+")))
    exact = q.join(p, q["_q"] == p["_p"]).withColumn("_way", F.lit(1)).withColumn("_len", F.lit(0))
    tokens = p.withColumn("_w", word("_p"))
    token = q.join(tokens, q["_q"] == tokens["_w"]).drop("_w").withColumn("_way", F.lit(2)).withColumn("_len", F.lit(0))
    # A whole-word occurrence shares the query's first word, so this is an equi-join too.
    lead = q.withColumn("_w", F.split_part("_q", F.lit(" "), F.lit(1)))
    inside = lead.join(tokens, "_w").where(names.word_bound_contains(F.col("_p"), F.col("_q"))).drop("_w").withColumn("_way", F.lit(3)).withColumn("_len", F.length("_p"))
    return first_per_key(exact.unionByName(token).unionByName(inside), ["query_id"], ["_way", "_len", "place_id"]).select("query_id", "place", "lat", "lon", F.element_at(F.array(F.lit("exact"), F.lit("token"), F.lit("inside")), F.col("_way")).alias("method"))


def stop_for_place(requests: DataFrame, stops: DataFrame, origins: DataFrame, max_walk_minutes: float = 30.0) -> DataFrame:
    """Boarding stop for a named place.

    Stops in range whose name has the place's words go before those that merely
    hold its text; then hubs and trip origins that are not village halts, any
    origin, any hub; then the nearest.
    """
    begins = origins.select("stop_id").distinct().withColumn("origin", F.lit(True))
    s = stops.join(begins, "stop_id", "left").select(F.col("stop_id").alias("other_id"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.col("name").alias("sname"), F.coalesce("origin", F.lit(False)).alias("origin"))
    near = near_join(requests.select("request_id", F.col("place").alias("place"), "lat", "lon"), s, max_walk_minutes / 60 * geo.WALK_KMH)
    hub = names.infer_stop_type(F.col("sname")) == "hub"
    village = names.is_village_name(F.col("sname"))
    match = F.when(names.token_name_match(F.col("place"), F.col("sname")), 0).when(F.contains(F.lower("sname"), F.lower("place")), 1).otherwise(2)
    kind = F.when(hub & ~village, 0).when(F.col("origin") & ~village, 1).when(F.col("origin"), 2).when(hub, 3).when(~village, 4).otherwise(5)
    rows = near.withColumn("_m", match).withColumn("_k", kind)
    return first_per_key(rows, ["request_id"], ["_k", "_m", "km", "other_id"]).select("request_id", F.col("other_id").alias("stop_id"), "km", geo.walk_minutes(F.col("km")).alias("walk_minutes"))


def recover_unverified(unverified: DataFrame, stations: DataFrame, km: float = 0.5, most: int = 200) -> DataFrame:
    """First station near each unmatched record that has a point, for the first ``most`` records."""
    some = unverified.where("lat IS NOT NULL AND lon IS NOT NULL").orderBy("ordinal").limit(most)
    held = stations.select("station_id", F.col("name").alias("station_name"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    pairs = near_join(some.select("record_id", "ordinal", "lat", "lon"), held, km)
    return first_per_key(pairs, ["record_id"], ["station_id"]).select("record_id", "station_id", "station_name", F.lit(0.75).alias("score"), F.lit("identity_only").alias("result"))


def duplicate_suggestions(reviews: DataFrame, terminals: DataFrame, floor: float = 0.6, most: int = 3) -> DataFrame:
    """Terminals that a review may duplicate: they hold its settlement, or the last word of its core name."""
    place = names.extract_settlement(F.col("name"))
    core = F.split(names.core_name(F.col("name")), " ")
    r = reviews.select("review_id", "name", F.coalesce(F.nullif(place, F.lit("")), F.try_element_at(core, F.lit(-1)), F.lit("")).alias("_want")).where("_want <> ''")
    t = terminals.select("terminal_id", F.col("name").alias("tname"), names.normalize_name(F.col("name")).alias("_tn"))
    pairs = r.withColumn("_w", F.split_part("_want", F.lit(" "), F.lit(1))).join(t.withColumn("_w", F.explode(F.array_distinct(F.split("_tn", " ")))), "_w").where(F.contains("_tn", "_want"))
    rows = pairs.withColumn("score", names.name_similarity(F.col("name"), F.col("tname"))).where(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("review_id").orderBy(F.desc("score"), "terminal_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("review_id", "terminal_id", "score", "rank")


def geocode_cache_join(queries: DataFrame, cache: DataFrame, now: Column, days: int = 90, short_days: int = 7) -> DataFrame:
    """Queries with ``state`` fresh, stale or miss; seeds and unverified entries age fast."""
    c = cache.select(F.col("query").alias("_k"), "provider", "cached_at", "origin", "verified")
    rows = queries.withColumn("_k", names.normalize_query(F.col("text"))).join(c, ["_k", "provider"], "left")
    ttl = F.when((F.col("origin") == "seed") | ~F.col("verified"), short_days).otherwise(days)
    age = (F.unix_timestamp(now) - F.unix_timestamp("cached_at")) / 86400.0
    return rows.select(*queries.columns, F.when(F.col("cached_at").isNull(), "miss").when(age <= ttl, "fresh").otherwise("stale").alias("state"))


def name_gate(candidates: DataFrame, floor: float = 0.8) -> DataFrame:
    """Best candidate by name for each region and settlement, if good enough; none without a settlement."""
    rows = candidates.where(F.coalesce("settlement", F.lit("")) != "").withColumn("score", names.name_similarity(F.col("name"), F.col("settlement")))
    return first_per_key(rows.where(F.col("score") >= floor), ["region", "settlement"], [F.desc("score"), "candidate_id"])
