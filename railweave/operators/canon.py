"""Maintenance of the canon tables (I05-I18, I20-I23): every job returns next table states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railweave.functions import keys, names
from railweave.operators.sequences import first_per_key
from railweave.operators.tables import merge_by_key

UNFINISHED = ["awaiting_times", "incomplete_trip", "skeleton_gap", "needs_review"]


def persist_attach(report: dict[str, DataFrame], canon: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """Next trips, stop times, staging and reviews after an attach; refused on a churn alert."""
    alert = report["churn"].first()["alert"]
    if alert:
        raise ValueError("churn alert: nothing is written")
    done = report["outcomes"].where("outcome = 'promoted'")
    fresh = done.select(F.col("trip_nk").alias("trip_id"), "route_id").dropDuplicates(["trip_id"])
    trips = merge_by_key(canon["trips"], fresh, ["trip_id"])
    gone = report["tombstones"].select("trip_id", F.lit(True).alias("_gone"))
    trips = trips.join(gone, "trip_id", "left").withColumn("valid_to", F.when(F.col("_gone") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).drop("_gone")
    named = report["stop_times"].join(done.select("trip_id", F.col("trip_nk")), "trip_id").select(F.col("trip_nk").alias("trip_id"), "seq", "terminal_id", "arrival_s", "departure_s")
    times = canon["stop_times"].join(fresh.select("trip_id"), "trip_id", "left_anti").unionByName(named)
    staged = report["outcomes"].where("outcome = 'staged'").select(F.col("trip_nk").alias("trip_id"), "route_id", "state", now.alias("observed_at"))
    staging = canon["staging"].join(report["outcomes"].select(F.col("trip_nk").alias("trip_id")), "trip_id", "left_anti").unionByName(staged)
    opened = report["outcomes"].where("state IN ('incomplete_trip', 'needs_review', 'duplicate_ambiguous', 'low_confidence')").select(F.lit("trip").alias("entity_type"), keys.surrogate_id(F.lit("trip"), F.col("state"), F.lit("attach"), F.col("trip_nk")).alias("entity_id"), F.col("state").alias("reason"), F.lit(0.0).alias("score"), F.col("trip_nk").alias("fingerprint"), now.alias("observed_at"))
    reviews = resolve_reviews(upsert_reviews(canon["reviews"], opened), fresh.select(F.col("trip_id").alias("fingerprint")))
    return dict(canon) | {"trips": trips, "stop_times": times, "staging": staging, "reviews": reviews}


def promote_skeleton(links: DataFrame, left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """Terminals, names, attributes and reviews from a linkage.

    Rows with a point are written, at confidence 0.4 if they are not linked;
    rows without one, and ambiguous ones, go to review. The longer name that
    only adds context becomes the primary one, the other an alias.
    """
    rows = left.alias("a").join(links.select("left_id", "right_id", "score", "result"), "left_id").join(right.select("right_id", F.col("name").alias("rname"), F.col("settlement").alias("rplace"), F.col("source").alias("rsource")), "right_id", "left")
    adds = names.name_adds_context(F.col("rname"), F.col("a.name"))
    primary = F.when((F.col("result") == "enriched") & adds, F.col("rname")).otherwise(F.col("a.name"))
    full = rows.select("left_id", primary.alias("name"), F.when(F.col("result") == "enriched", F.when(adds, F.col("a.name")).otherwise(F.col("rname"))).alias("alias"), "a.lat", "a.lon", F.coalesce(F.nullif(F.col("a.settlement"), F.lit("")), F.col("rplace")).alias("settlement"), F.col("a.source").alias("source"), "rsource", "score", "result")
    point = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    good = full.where(point & (F.col("result") != "ambiguous")).withColumn("confidence", F.when(F.col("result") == "enriched", F.col("score")).otherwise(0.4))
    bad = full.where(~point | (F.col("result") == "ambiguous"))
    attributes = good.select("left_id", F.lit("geom").alias("field"), F.concat_ws(",", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon")).alias("value"), "source", "confidence").unionByName(good.select("left_id", F.lit("name").alias("field"), F.col("name").alias("value"), F.coalesce("rsource", "source").alias("source"), "confidence"))
    aliases = good.where("alias IS NOT NULL AND alias <> name").select("left_id", "alias")
    tags = good.where("coalesce(settlement, '') <> ''").select("left_id", F.lit("settlement").alias("key"), F.col("settlement").alias("value"))
    reviews = bad.select(keys.surrogate_id(F.lit("terminal"), F.when(F.col("result") == "ambiguous", "duplicate_ambiguous").otherwise("no_point"), F.col("source"), F.col("left_id").cast("string")).alias("entity_id"), F.when(F.col("result") == "ambiguous", "duplicate_ambiguous").otherwise("no_point").alias("reason"), "score")
    provenance = good.select("left_id", "source").unionByName(good.where("rsource IS NOT NULL AND result = 'enriched'").select("left_id", F.col("rsource").alias("source"))).distinct()
    return {"terminals": good.select("left_id", "name", "lat", "lon", "confidence"), "aliases": aliases, "tags": tags, "attributes": attributes, "reviews": reviews, "provenance": provenance}


def tombstone_routes(routes: DataFrame, trips: DataFrame, codes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Routes named in ``codes`` and their trips, closed if they are live."""
    hit = codes.select("route_id").distinct().withColumn("_hit", F.lit(True))
    close = lambda df: df.join(hit, "route_id", "left").withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).drop("_hit")
    return close(routes), close(trips)


def expire_staging(staging: DataFrame, older_days: int, now: Column) -> DataFrame:
    """Unfinished rows older than the age become expired; again is a no-op."""
    if older_days <= 0:
        raise ValueError("age must be positive")
    old = F.col("state").isin(UNFINISHED) & (F.col("observed_at") < now - F.expr(f"INTERVAL {older_days} DAYS"))
    return staging.withColumn("state", F.when(old, "expired").otherwise(F.col("state")))


def resolve_reviews(reviews: DataFrame, promoted: DataFrame) -> DataFrame:
    """Open trip reviews whose fingerprint was promoted are resolved."""
    hit = promoted.select("fingerprint").distinct().withColumn("_hit", F.lit(True))
    done = (F.col("entity_type") == "trip") & F.col("_hit") & (F.col("state") == "open")
    return reviews.join(hit, "fingerprint", "left").withColumn("state", F.when(done, "resolved").otherwise(F.col("state"))).select(*reviews.columns)


def upsert_reviews(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """Reviews by (type, id, reason): latest score, counted sightings, fingerprint kept if the new one is blank."""
    k = ["entity_type", "entity_id", "reason"]
    last = F.struct("observed_at", "score")
    n = new.groupBy(*k).agg(F.max_by("score", last).alias("n_score"), F.max_by(F.nullif("fingerprint", F.lit("")), last).alias("n_print"), F.max("observed_at").alias("n_at"), F.count("*").alias("n_seen"))
    rows = reviews.join(n, k, "full_outer")
    return rows.select(*k, F.coalesce("n_score", "score").alias("score"), F.coalesce("n_print", "fingerprint").alias("fingerprint"), (F.coalesce("seen", F.lit(0)) + F.coalesce("n_seen", F.lit(0))).alias("seen"), F.greatest("observed_at", "n_at").alias("observed_at"), F.coalesce("state", F.lit("open")).alias("state"))


def apply_overrides(candidates: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, rejected): manual values over elected ones; incomplete or repeated overrides are rejected."""
    k = ["entity_id", "field"]
    n = F.count("*").over(Window.partitionBy(*k))
    why = F.when(F.col("entity_id").isNull() | (F.coalesce("field", F.lit("")) == "") | (F.coalesce("value", F.lit("")) == ""), "incomplete").when(F.col("actor_id").isNull(), "no actor").when(n > 1, "repeated key")
    told = overrides.withColumn("why", why)
    good = told.where("why IS NULL").select(*k, F.col("value").alias("o"))
    rows = candidates.join(good, k, "full_outer").select(*k, F.coalesce("o", "value").alias("value"), F.col("o").isNotNull().alias("manual"))
    return rows, told.where("why IS NOT NULL")


def approve_terminals(terminals: DataFrame, approvals: DataFrame, updates: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(terminals, conflicts): approved rows are locked with their values; updates of locked rows go to review."""
    a = approvals.select("terminal_id", F.col("name").alias("a_name"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lit(True).alias("_a"))
    rows = terminals.join(a, "terminal_id", "left")
    locked = rows.select("terminal_id", F.coalesce("a_name", "name").alias("name"), F.coalesce("a_lat", "lat").alias("lat"), F.coalesce("a_lon", "lon").alias("lon"), (F.col("locked") | F.coalesce("_a", F.lit(False))).alias("locked"), F.when(F.col("_a"), now).otherwise(F.col("verified_at")).alias("verified_at"))
    u = updates.select("terminal_id", F.col("name").alias("u_name"), F.col("lat").alias("u_lat"), F.col("lon").alias("u_lon"))
    both = locked.join(u, "terminal_id", "left")
    free = ~F.col("locked")
    out = both.select("terminal_id", *[F.when(free, F.coalesce(f"u_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("name", "lat", "lon")], "locked", "verified_at")
    differs = F.coalesce(F.col("u_name") != F.col("name"), F.lit(False)) | F.coalesce(F.col("u_lat") != F.col("lat"), F.lit(False)) | F.coalesce(F.col("u_lon") != F.col("lon"), F.lit(False))
    return out, both.where(F.col("locked") & differs).select("terminal_id", F.lit("conflicts_with_confirmed").alias("reason"))


def clear_provider(canon: dict[str, DataFrame], provider: str) -> dict[str, DataFrame]:
    """The canon without a provider's routes, services, trips and stop times."""
    routes = canon["routes"].where(F.col("provider") == provider).select("route_id")
    trips = canon["trips"].join(routes, "route_id", "left_semi").select("trip_id")
    return dict(canon) | {"routes": canon["routes"].join(routes, "route_id", "left_anti"), "trips": canon["trips"].join(routes, "route_id", "left_anti"), "stop_times": canon["stop_times"].join(trips, "trip_id", "left_anti"), "services": canon["services"].where(F.col("provider") != provider)}


def ensure_stops(terminals: DataFrame, stops: DataFrame) -> DataFrame:
    """One stop a terminal: the lowest that exists, else a new one; missing points are healed."""
    have = first_per_key(stops, ["terminal_id"], ["stop_id"]).select("terminal_id", "stop_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    rows = terminals.join(have, "terminal_id", "left")
    return rows.select("terminal_id", F.coalesce("stop_id", F.abs(F.xxhash64("terminal_id"))).alias("stop_id"), F.coalesce("slat", "lat").alias("lat"), F.coalesce("slon", "lon").alias("lon"), names.infer_stop_type(F.col("name")).alias("stop_type"), F.col("stop_id").isNull().alias("created"))


def skip_fresh_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks not yet done under their plan id."""
    return chunks.join(done.select("chunk_key", "plan_id"), ["chunk_key", "plan_id"], "left_anti")


def record_provenance(current: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I16: (latest vote of each entity and source, the votes to append to the history)."""
    both = current.unionByName(votes)
    return first_per_key(both, ["entity_type", "entity_id", "source"], [F.desc("observed_at"), F.desc("confidence")]), votes


def orphan_check(provenance: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """Provenance rows that point at nothing; ``entities`` maps a type to its ids (entity_id)."""
    known = None
    for kind, df in entities.items():
        one = df.select(F.lit(kind).alias("entity_type"), "entity_id")
        known = one if known is None else known.unionByName(one)
    return provenance.join(known, ["entity_type", "entity_id"], "left_anti")


def audit_sample(matches: DataFrame, n: int) -> DataFrame:
    """A repeatable sample of ``n`` verified matches for each method."""
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.xxhash64("match_id"), "match_id"))
    return matches.where("decision = 'verified'").withColumn("nth", rank).where(F.col("nth") <= n).drop("nth")


STAGES = ["normalize", "enrich", "dedup", "verify", "canonical"]


def log_stages(records: DataFrame) -> DataFrame:
    """A log row for each record and stage."""
    return records.select("record_id", F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("step", "stage"), "confidence", "distance_m", "source")


def apply_review_decisions(reviews: DataFrame, decisions: DataFrame, terminals: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Approve locks the terminal and votes for it by hand; approve and dismiss remove the review; each is audited."""
    d = decisions.where("decision IN ('approve', 'dismiss')")
    done = reviews.join(d.select("review_id", "decision", "actor_id"), "review_id")
    approved = done.where("decision = 'approve'").select("terminal_id").distinct().withColumn("_ok", F.lit(True))
    locked = terminals.join(approved, "terminal_id", "left").withColumn("locked", F.col("locked") | F.coalesce("_ok", F.lit(False))).drop("_ok")
    votes = done.where("decision = 'approve'").select(F.lit("terminal").alias("entity_type"), F.col("terminal_id").alias("entity_id"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"), now.alias("observed_at"))
    audit = done.select("review_id", "decision", "actor_id", now.alias("at"))
    return {"reviews": reviews.join(d.select("review_id"), "review_id", "left_anti"), "terminals": locked, "provenance": votes, "audit": audit}


def apply_terminal_edits(terminals: DataFrame, edits: DataFrame, reviews: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Edits by hand lock terminals; approved ones close their reviews, others open a conflict; nameless ones are rejected."""
    good = first_per_key(edits.where("trim(coalesce(name, '')) <> ''"), ["terminal_id"], [F.desc("edit_id")])
    e = good.select("terminal_id", F.col("name").alias("e_name"), F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"), F.lit(True).alias("_e"))
    rows = terminals.join(e, "terminal_id", "left")
    out = rows.select("terminal_id", *[F.coalesce(f"e_{c}", c).alias(c) for c in ("name", "lat", "lon")], (F.col("locked") | F.coalesce("_e", F.lit(False))).alias("locked"))
    closed = good.where("approved").select("terminal_id")
    opened = good.where("NOT approved").select("terminal_id", F.lit("conflicts_with_confirmed").alias("reason"))
    left = reviews.join(closed, "terminal_id", "left_anti").select("terminal_id", "reason").unionByName(opened).distinct()
    tags = good.where("coalesce(settlement, '') <> ''").select("terminal_id", F.lit("settlement").alias("key"), F.col("settlement").alias("value"))
    return {"terminals": out, "reviews": left, "tags": tags, "audit": good.select("terminal_id", "edit_id", now.alias("at")), "rejected": edits.where("trim(coalesce(name, '')) = ''")}


def dedupe_carriers(carriers: DataFrame, routes: DataFrame) -> DataFrame:
    """Carriers of the list, then those only on routes; one for each tax id, or name without one."""
    a = carriers.select("name", "inn", F.lit(0).alias("rank"))
    b = routes.select(F.col("carrier").alias("name"), F.col("carrier_inn").alias("inn"), F.lit(1).alias("rank"))
    key = F.when(F.coalesce("inn", F.lit("")) != "", F.col("inn")).otherwise(F.concat(F.lit("name:"), F.coalesce("name", F.lit(""))))
    return first_per_key(a.unionByName(b).where("coalesce(name, '') <> ''").withColumn("carrier_key", key), ["carrier_key"], ["rank", "name"]).select("carrier_key", "name", "inn")
