"""Streaming forms of the table jobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from railweave.operators.spatial import geocode_cache_join


def consume_outbox(stream: DataFrame, handle: Callable[[list[str]], None], checkpoint: str, most: int = 1000):
    """Hand each batch's distinct regions, in order, to ``handle``; the checkpoint takes the place of deleting rows.

    Regions are a small code table; more than ``most`` in a batch is an error.
    """

    def batch(df: DataFrame, _: int) -> None:
        rows = df.where("event = 'terminal_created'").select("region").where("region IS NOT NULL").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("too many regions in a batch")
        if rows:
            handle(sorted(r["region"] for r in rows))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def event_rows(df: DataFrame, aggregate: str, key: str, event: str) -> DataFrame:
    """Event rows with the other columns as a JSON payload; works on tables and streams."""
    rest = [c for c in df.columns if c != key]
    return df.select(F.lit(aggregate).alias("aggregate"), F.col(key).cast("string").alias("aggregate_id"), F.lit(event).alias("event"), F.to_json(F.struct(*rest)).alias("payload"))


def publish_events(df: DataFrame, folder: str, checkpoint: str):
    """A writer that appends event rows as JSON files."""
    return df.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")


def review_stream(stream: DataFrame) -> DataFrame:
    """Sightings, last score and last time of each review key, to be written in update mode."""
    at = F.struct("observed_at", "score")
    return stream.groupBy("entity_type", "entity_id", "reason").agg(F.count("*").alias("seen"), F.max_by("score", at).alias("score"), F.max("observed_at").alias("observed_at"))


def review_episodes(table: DataFrame, ttl_s: int) -> DataFrame:
    """S03 on a table: one row for each run of sightings of a review key with pauses below ``ttl_s``."""
    k = ["entity_type", "entity_id", "reason"]
    w = Window.partitionBy(*k).orderBy("observed_at", "score")
    at_us = F.unix_micros(F.col("observed_at").cast("timestamp"))
    pause = at_us - F.lag(at_us).over(w)
    rows = table.where("observed_at IS NOT NULL").withColumn("_new", F.when(pause < ttl_s * 1_000_000, 0).otherwise(1))
    runs = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("observed_at", "score")
    return runs.groupBy(*k, "_run").agg(F.count("*").alias("seen"), F.max_by("score", at).alias("score"), F.max("observed_at").alias("observed_at")).drop("_run")


def review_ttl_stream(stream: DataFrame, ttl_s: int, late: str = "10 minutes") -> DataFrame:
    """S03 with a timer for each review key, to be written in update mode.

    A key's sightings form runs with pauses below ``ttl_s``. Each batch with
    sightings of a key gives its open runs as ``live`` rows with what was seen so
    far; once the watermark has passed a run's last sighting by ``ttl_s`` it gives
    one ``expired`` row and leaves the state. Sightings out of order, as long as
    the watermark takes them, may still join two runs. Sightings without a time
    belong to no run; of equal times the higher score counts, null the lowest.
    """
    schema = StructType([stream.schema[c] for c in ("entity_type", "entity_id", "reason")])
    schema = schema.add("seen", "long").add("score", "double").add("observed_at", "timestamp").add("state", "string")
    held = "seen array<long>, score array<double>, from_us array<long>, at_us array<long>"
    rows = stream.where("observed_at IS NOT NULL").select("entity_type", "entity_id", "reason", F.col("score").cast("double").alias("score"), F.unix_micros("observed_at").alias("at_us"), "observed_at")
    ttl_us = ttl_s * 1_000_000

    def update(key, batches, state):
        # A run is (first, last, seen, score of the last); those of a batch's pieces are found apart and then joined.
        runs = list(zip(*[state.get[i] for i in (2, 3, 0, 1)], strict=True)) if state.exists else []
        for pdf in () if state.hasTimedOut else batches:
            rows = pdf.sort_values(["at_us", "score"], na_position="first")
            number = (rows.at_us.diff() >= ttl_us).cumsum()
            for _, run in rows.groupby(number):
                score = run.score.iloc[-1]
                runs.append((int(run.at_us.iloc[0]), int(run.at_us.iloc[-1]), len(run), None if pd.isna(score) else float(score)))
        joined = []
        for run in sorted(runs, key=lambda x: x[:2]):
            if joined and run[0] - joined[-1][1] < ttl_us:
                old = joined.pop()
                last = max(old, run, key=lambda x: (x[1], x[3] is not None, x[3] or 0.0))
                run = (old[0], last[1], old[2] + run[2], last[3])
            joined.append(run)
        past = state.getCurrentWatermarkMs()
        ends = [run[1] // 1000 + ttl_s * 1000 for run in joined]
        still = [run for run, end in zip(joined, ends, strict=True) if end > past]
        if still:
            state.update(([r[2] for r in still], [r[3] for r in still], [r[0] for r in still], [r[1] for r in still]))
            state.setTimeoutTimestamp(min(end for end in ends if end > past))
        elif state.exists:
            state.remove()
        shown = [(r, "live" if end > past else "expired") for r, end in zip(joined, ends, strict=True) if end <= past or not state.hasTimedOut]
        yield pd.DataFrame([(*key, r[2], r[3], pd.Timestamp(r[1], unit="us"), name) for r, name in shown], columns=schema.names).astype({"score": "float64"})

    return rows.withWatermark("observed_at", late).groupBy("entity_type", "entity_id", "reason").applyInPandasWithState(update, schema, held, "update", GroupStateTimeout.EventTimeTimeout)


def expiry_stream(stream: DataFrame, key: str, time: str, ttl: str, late: str = "10 minutes") -> DataFrame:
    """A row for each key that was not seen for ``ttl``, with first and last sighting.

    A session of sightings closes when the watermark has passed its last one by
    ``ttl``; a sighting after that starts another session, so the key is live
    again. Closed sessions leave the state.
    """
    rows = stream.withWatermark(time, late).groupBy(key, F.session_window(time, ttl).alias("w")).agg(F.count("*").alias("seen"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    return rows.select(key, "seen", "first_seen", "last_seen", F.lit("expired").alias("state"))


def quota_stream(stream: DataFrame, limit: int, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Calls of each provider and day and whether they pass the limit."""
    rows = stream.withWatermark(time, late).groupBy("provider", F.window(time, "1 day").alias("w")).agg(F.count("*").alias("calls"))
    return rows.select("provider", F.to_date("w.start").alias("day"), "calls", (F.col("calls") > limit).alias("over"))


def cache_stream(stream: DataFrame, cache: DataFrame, now: str = "asked_at", days: int = 90, short_days: int = 7) -> DataFrame:
    """Queries with their cache state, against a static cache table."""
    return geocode_cache_join(stream, cache, F.col(now), days, short_days)
