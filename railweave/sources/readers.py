"""Readers (A01-A12, A18, A20-A22): every one returns DataFrames and reads by Spark's own paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railweave.functions import clock, geo, names
from railweave.operators.sequences import first_per_key
from railweave.sources import documents
from railweave.sources import schemas as S

# Transport names of the station tree that differ from ours.
TRANSPORT = {"train": "rail", "suburban": "rail", "plane": "flight"}
# Tags kept of map objects.
KEPT_TAGS = ("name", "name:ru", "amenity", "public_transport", "railway", "highway", "bus", "operator", "ref")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of an unzipped feed folder; header names are trimmed, ragged rows padded, rows without an id skipped."""
    out = {}
    for name, columns in S.FEED.items():
        path = f"{folder}/{name}.txt"
        if not _exists(spark, path):
            if name not in S.OPTIONAL:
                raise FileNotFoundError(path)
            out[name] = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
            continue
        raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
        raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
        rows = raw.select(*[(_blank(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        key = {"stops": "stop_id", "routes": "route_id"}.get(name, "trip_id" if "trip_id" in columns else "service_id")
        out[name] = rows.where(F.col(key).isNotNull())
    out["stops"] = out["stops"].withColumn("stop_code", F.coalesce("stop_code", "stop_id")).withColumn("lat", F.col("stop_lat").try_cast("double")).withColumn("lon", F.col("stop_lon").try_cast("double"))
    return out


def import_feed(feed: dict[str, DataFrame], offset: int = 10**10) -> dict[str, DataFrame]:
    """Canon rows of a feed; children of unknown parents go, service ids move by ``offset``, headways stay in seconds."""
    sid = lambda df: df.withColumn("service_id", F.col("service_id").try_cast("long") + offset).where("service_id IS NOT NULL")
    flags = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    days = F.filter(F.array(*[F.when(F.col(d) == "1", F.lit(i)) for i, d in enumerate(flags)]), lambda x: x.isNotNull())
    services = sid(feed["calendar"]).select("service_id", clock.feed_date(F.col("start_date")).alias("start_date"), clock.feed_date(F.col("end_date")).alias("end_date"), clock.weekday_csv(days).alias("service_days"))
    exceptions = sid(feed["calendar_dates"]).select("service_id", clock.feed_date(F.col("date")).alias("date"), F.when(F.col("exception_type") == "2", "removed").otherwise("added").alias("exception_type"))
    routes = feed["routes"].select("route_id", F.coalesce("route_short_name", "route_long_name", "route_id").alias("name"), clock.feed_mode(F.col("route_type")).alias("mode"))
    trips = sid(feed["trips"]).join(routes.select("route_id"), "route_id", "left_semi").join(services.select("service_id", "service_days"), "service_id", "left")
    trips = trips.select("trip_id", "route_id", "service_id", F.when(F.col("direction_id") == "1", "backward").otherwise("forward").alias("direction"), "service_days")
    stops = feed["stops"].select("stop_id", "stop_code", F.col("stop_name").alias("name"), "lat", "lon")
    times = feed["stop_times"].join(trips.select("trip_id"), "trip_id", "left_semi").join(stops.select("stop_id"), "stop_id", "left_semi")
    a, d = clock.feed_seconds(F.col("arrival_time")), clock.feed_seconds(F.col("departure_time"))
    times = times.select("trip_id", F.col("stop_sequence").try_cast("int").alias("seq"), "stop_id", F.coalesce(a, d).alias("arrival_s"), F.coalesce(d, a).alias("departure_s"))
    heads = feed["frequencies"].join(trips.select("trip_id"), "trip_id", "left_semi").select("trip_id", clock.feed_seconds(F.col("start_time")).alias("start_s"), clock.feed_seconds(F.col("end_time")).alias("end_s"), F.col("headway_secs").try_cast("int").alias("headway_s"))
    return {"services": services, "service_exceptions": exceptions, "routes": routes, "trips": trips, "stops": stops, "stop_times": times, "frequencies": heads}


def _array_rows(spark: SparkSession, path: str, schema: str, name: str | None, split: bool) -> DataFrame:
    """Rows of the array ``name`` of JSON documents, or of documents that are arrays; ``split``: by many tasks a document."""
    kind = T.StructType.fromDDL(schema)
    if not split:
        rows = spark.read.schema(kind).json(path, multiLine=True)
        return rows.select(F.explode(name).alias("e")).select("e.*") if name else rows
    rows = documents.elements(spark, path, keyed=name is not None).where(F.col("name") == (name or ""))
    return rows.select(F.from_json("value", kind[name].dataType.elementType if name else kind).alias("e")).select("e.*")


def read_registry(spark: SparkSession, path: str, split: bool = False) -> dict[str, DataFrame]:
    """Tables of a registry snapshot, one nested document a file; ``split``: large documents by many tasks."""
    tables = ("routes", "stops", "carriers", "services", "service_days", "service_exceptions", "schedules")
    if split:
        kind, rows = T.StructType.fromDDL(S.REGISTRY), documents.elements(spark, path)
        meta = documents.frame(rows).select(F.from_json("value", kind).alias("d")).select("d.meta.*")
        return {n: rows.where(F.col("name") == n).select(F.from_json("value", kind[n].dataType.elementType).alias("x")).select("x.*") for n in tables} | {"meta": meta}
    doc = spark.read.schema(S.REGISTRY).json(path, multiLine=True)
    return {name: doc.select(F.explode(name).alias("x")).select("x.*") for name in tables} | {"meta": doc.select("meta.*")}


def _codes(*pairs: tuple[str, str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(s).alias("system"), F.lit(t).alias("code_type"), c.alias("code"))) for s, t, c in pairs]), lambda x: x.isNotNull())


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def read_stations(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Records of a flat list of tagged map stations; nameless ones go, (0, 0) is no point."""
    return stations_to_records(_array_rows(spark, path, S.STATIONS, None, split))


def stations_to_records(rows: DataFrame) -> DataFrame:
    zero = (F.col("lat") == 0) & (F.col("lon") == 0)
    name = F.coalesce(_blank(F.try_element_at("tags", F.lit("name:ru"))), _blank(F.col("name")))
    code = F.when(F.coalesce("kind", F.lit("node")) == "node", F.col("id").cast("string")).otherwise(F.concat_ws("/", "kind", F.col("id").cast("string")))
    out = _record(rows, record_id=F.col("id"), name=name, lat=F.when(~zero, F.col("lat")), lon=F.when(~zero, F.col("lon")), settlement=F.try_element_at("tags", F.lit("addr:city")), transport=F.when(F.try_element_at("tags", F.lit("railway")).isNotNull(), "rail").otherwise("bus"), source=F.lit("osm"), codes=_codes(("osm", "id", code)))
    return out.where("name IS NOT NULL")


def read_station_tree(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a country, region, settlement tree; coordinates may be text or missing."""
    return flatten_station_tree(spark.read.schema(S.STATION_TREE).json(path, multiLine=True))


def flatten_station_tree(doc: DataFrame) -> DataFrame:
    rows = doc.select(F.explode("countries").alias("c")).select(F.col("c.title").alias("country"), F.explode("c.regions").alias("r")).select("country", F.col("r.title").alias("region"), F.explode("r.settlements").alias("s")).select("country", "region", F.col("s.title").alias("settlement"), F.explode("s.stations").alias("x"))
    number = lambda c: _blank(F.col(c).cast("string")).try_cast("double")
    book = F.create_map(*[F.lit(v) for kv in TRANSPORT.items() for v in kv])
    return rows.select("country", "region", "settlement", F.col("x.title").alias("name"), number("x.latitude").alias("lat"), number("x.longitude").alias("lon"), F.coalesce(F.try_element_at(book, F.col("x.transport_type")), F.col("x.transport_type")).alias("transport"), F.col("x.station_type").alias("station_type"), F.lit("yandex").alias("source"), _codes(("yandex", "yandex_code", F.col("x.codes.yandex_code")), ("esr", "esr_code", F.col("x.codes.esr_code"))).alias("codes"))


def read_map_elements(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Records of map elements, at their point or centre; nameless and placeless ones go."""
    rows = _array_rows(spark, path, S.MAP_FILE, "elements", split)
    code = F.when(F.col("type") == "node", F.col("id").cast("string")).otherwise(F.concat_ws("/", "type", F.col("id").cast("string")))
    name = F.coalesce(_blank(F.try_element_at("tags", F.lit("name:ru"))), _blank(F.try_element_at("tags", F.lit("name"))))
    return _record(rows, code=code, name=name, lat=F.coalesce("lat", "center.lat"), lon=F.coalesce("lon", "center.lon"), codes=_codes(("osm", "id", code))).where("name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def read_route_relations(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Routes of map relations with their member stops in order."""
    rows = _array_rows(spark, path, S.MAP_FILE, "elements", split).where("type = 'relation'")
    tag = lambda k: _blank(F.try_element_at("tags", F.lit(k)))
    stop = F.filter("members", lambda m: m["type"].isin("node", "way"))
    stops = F.transform(stop, lambda m, i: F.struct(i.alias("seq"), F.when(m["type"] == "node", m["ref"].cast("string")).otherwise(F.concat_ws("/", m["type"], m["ref"].cast("string"))).alias("code"), F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("stop")).alias("role")))
    return rows.select(F.col("id").alias("relation_id"), tag("ref").alias("ref"), tag("name").alias("name"), tag("route").alias("mode"), stops.alias("stops")).where("ref IS NOT NULL AND name IS NOT NULL").withColumn("stop_count", F.size("stops"))


def explode_area_chain(matches: DataFrame) -> DataFrame:
    """A place row for each area of a match, its parent the area before, and a terminal row below."""
    areas = matches.select("match_id", F.posexplode("areas").alias("pos", "a")).select("match_id", "pos", F.col("a.name").alias("name"), F.col("a.admin_level").alias("admin_level"))
    last = matches.select("match_id", F.size("areas").alias("pos"), "name", F.lit(None).cast("int").alias("admin_level"))
    from pyspark.sql import Window

    rows = areas.withColumn("kind", F.lit("place")).unionByName(last.withColumn("kind", F.lit("terminal")))
    return rows.withColumn("parent", F.lag("name").over(Window.partitionBy("match_id").orderBy("pos")))


def validate_match(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and bad match rows, the bad with a reason."""
    why = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(~F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False)), "coordinates out of range").when(~F.col("type").isin("STOP", "PLACE", "ADDRESS"), "unknown type")
    rows = matches.withColumn("reason", why)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def filter_tagged_objects(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """A10: bus and rail stop objects with nine tags; a way stands at the mean of its known nodes."""
    t = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    wanted = (t("amenity") == "bus_station") | (t("highway") == "bus_stop") | t("railway").isin("station", "halt", "stop") | t("public_transport").isin("station", "stop_position", "platform")
    kept = objects.where(wanted).withColumn("tags", F.map_filter("tags", lambda k, v: k.isin(*KEPT_TAGS)))
    ways = kept.where("kind = 'way'").select("id", F.explode("node_ids").alias("node_id")).join(nodes, "node_id").groupBy("id").agg(F.avg("lat").alias("wlat"), F.avg("lon").alias("wlon"))
    out = kept.join(ways, "id", "left")
    return out.select("id", "kind", "tags", F.coalesce("lat", "wlat").alias("lat"), F.coalesce("lon", "wlon").alias("lon"))


def threads_to_feed(threads: DataFrame, stations: DataFrame) -> dict[str, DataFrame]:
    """Feed tables of raw schedule threads; a thread counts once, missing times come from the other."""
    once = first_per_key(threads, ["thread_id"], ["date"])
    route = F.coalesce(_blank(F.col("number")), _blank(F.col("title")), F.col("uid"))
    routes = once.select(route.alias("route_id"), F.col("title").alias("name"), F.col("transport_type").alias("mode"))
    routes = first_per_key(routes, ["route_id"], ["name", "mode"])
    trips = once.select(F.col("thread_id").alias("trip_id"), route.alias("route_id"), F.xxhash64("thread_id").alias("service_id"))
    times = once.select(F.col("thread_id").alias("trip_id"), F.posexplode("stops").alias("seq", "s"))
    a, d = clock.feed_seconds(F.substring("s.arrival", -8, 8)), clock.feed_seconds(F.substring("s.departure", -8, 8))
    stop_times = times.select("trip_id", "seq", F.col("s.code").alias("stop_id"), F.coalesce(a, d).alias("arrival_s"), F.coalesce(d, a).alias("departure_s"))
    dates = threads.select(F.xxhash64("thread_id").alias("service_id"), F.to_date("date").alias("date"), F.lit("added").alias("exception_type")).distinct()
    extra = first_per_key(times.select(F.col("s.code").alias("stop_id"), F.col("s.title").alias("name")).join(stations.select(F.col("code").alias("stop_id")), "stop_id", "left_anti"), ["stop_id"], ["name"])
    return {"routes": routes, "trips": trips, "stop_times": stop_times, "service_exceptions": dates, "extra_stops": extra}


def extract_region_stations(tree: DataFrame, region: str, mode: str, country: str) -> DataFrame:
    """Stations of a region and mode; of one code the last counts."""
    rows = tree.where((F.col("country") == country) & (F.col("region") == region) & (F.col("transport") == mode))
    rows = rows.withColumn("code", F.try_element_at(F.transform("codes", lambda x: x["code"]), F.lit(1))).withColumn("display", F.concat_ws(", ", _blank(F.col("settlement")), "name"))
    return first_per_key(rows.where("code IS NOT NULL"), ["code"], [F.desc("ordinal") if "ordinal" in rows.columns else F.desc("display")])


def skip_unchanged(spark: SparkSession, path: str, provider: str, imports: DataFrame) -> DataFrame:
    """(provider, sha256) of the files below ``path`` unless the provider's last import had that hash."""
    one = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256")).withColumn("provider", F.lit(provider))
    last = first_per_key(imports, ["provider"], [F.desc("imported_at")]).select("provider", "sha256")
    return one.join(last, ["provider", "sha256"], "left_anti")


def read_seed_places(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Seed places as cache rows."""
    rows = _array_rows(spark, path, S.PLACES, None, split)
    return rows.select(names.normalize_query(F.col("name")).alias("query"), "name", "lat", "lon", F.lit("seed").alias("origin"), geo.geo_cache_key(F.col("lat"), F.col("lon")).alias("cache_key"))


def build_gazetteer(stations: DataFrame, curated: DataFrame) -> DataFrame:
    """One hub station for each place name, best kind first; curated rows only where a name is missing."""
    low = F.lower("name")
    place = F.coalesce(_blank(F.regexp_extract("name", r"^([^,]+),", 1)), _blank(names.extract_settlement(F.col("name"))))
    kind = F.when(F.contains(low, F.lit("автовокзал")), 0).when(F.contains(low, F.lit("автостанция")), 1).when(F.try_element_at("tags", F.lit("amenity")) == "bus_station", 2).when(F.contains(low, F.lit("аэропорт")), 3).otherwise(4)
    rows = stations.withColumn("place", place).where("place IS NOT NULL AND lat IS NOT NULL").withColumn("_k", kind)
    best = first_per_key(rows, ["place"], ["_k", "name", "lat", "lon"]).select(F.col("place").alias("name"), "lat", "lon")
    return best.unionByName(curated.select("name", "lat", "lon").join(best.select("name"), "name", "left_anti"))


def build_registry(routes: DataFrame, carriers: DataFrame, forward: DataFrame, backward: DataFrame, regions: list[str]) -> dict[str, DataFrame]:
    """Registry tables of sheet rows.

    A route touched by a wanted region keeps all its stops. A stop is (name,
    region); its id is its code, else slug and hash. Carriers go by tax id, first
    row first. Each distinct (days, period) is a service.
    """
    both = forward.withColumn("direction", F.lit("forward")).unionByName(backward.withColumn("direction", F.lit("backward")))
    touched = both.where(F.col("region").isin(regions)).select("reg").distinct() if regions else both.select("reg").distinct()
    rows = both.join(touched, "reg", "left_semi")
    stop_id = F.coalesce(_blank(F.col("op_reg")), F.concat_ws("-", names.slug(F.col("name")), names.name_hash(F.col("name"), F.col("region"))))
    rows = rows.withColumn("stop_id", stop_id)
    stops = first_per_key(rows.select("stop_id", "name", "region", "op_reg", "reg", "seq"), ["name", "region"], ["reg", "seq"]).select("stop_id", "name", "region", "op_reg")
    firms = first_per_key(carriers, ["inn"], ["ordinal"])
    text = F.concat_ws("|", F.coalesce("days", F.lit("")), F.coalesce("period", F.lit("")))
    firsts = first_per_key(rows, ["reg", "direction"], ["seq"]).withColumn("service_key", text)
    services = firsts.select("service_key", "days", "period").distinct().withColumn("service_id", F.abs(F.xxhash64("service_key")))
    schedules = rows.groupBy("reg", "direction").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "region", "dep", "arr"))).alias("stops")).join(firsts.select("reg", "direction", "service_key"), ["reg", "direction"]).join(services.select("service_key", "service_id"), "service_key")
    return {"routes": routes.join(touched, "reg", "left_semi"), "stops": stops, "carriers": firms, "services": services.drop("service_key"), "schedules": schedules.drop("service_key"), "service_days": services.select("service_id", F.explode(clock.parse_days_range(F.col("days"))).alias("weekday"))}
