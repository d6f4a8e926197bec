"""Tables and states that are kept up to date equal those made anew."""

import datetime
import random
import time

import pytest

from railweave.operators import summaries
from railweave.streaming import streams

PLACES = "place_id long, parent_id long"


def _forest(rng, count):
    """Parents below children by number, so there are no circles; some roots, some parents that don't exist."""
    return {i: None if rng.random() < 0.1 else 900 + i if rng.random() < 0.05 else rng.randrange(i) for i in range(1, count)} | {0: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_update_equals_the_closure_made_anew(spark, seed):
    rng = random.Random(seed)
    old = _forest(rng, 60)
    new = dict(old)
    for i in rng.sample(range(1, 60), 6):
        new[i] = rng.choice([None, rng.randrange(i)])
    for i in rng.sample(range(1, 60), 3):
        del new[i]
    new |= {60: 3, 61: 60, 62: None}
    changed = [(i,) for i in sorted(old.keys() | new.keys()) if i not in old or i not in new or old[i] != new[i]]
    table = lambda x: spark.createDataFrame(sorted(x.items()), PLACES)
    got = summaries.closure_update(summaries.closure_table(table(old)), table(new), spark.createDataFrame(changed, "place_id long"))
    rows = lambda df: sorted((r.ancestor, r.descendant, r.depth) for r in df.collect())
    assert rows(got) == rows(summaries.closure_table(table(new)))


def test_closure_update_edges(spark):
    places = spark.createDataFrame([(0, None), (1, 0), (2, 1)], PLACES)
    full = summaries.closure_table(places)
    none = spark.createDataFrame([], "place_id long")
    assert summaries.closure_update(full, places, none).count() == full.count() == 6
    gone = spark.createDataFrame([], PLACES)
    assert summaries.closure_update(full, gone, places.select("place_id")).count() == 0
    with pytest.raises(ValueError):
        summaries.closure_update(full, spark.createDataFrame([(0, 2), (1, 0), (2, 1)], PLACES), spark.createDataFrame([(0,)], "place_id long"))


def test_review_keys_expire_and_come_back(spark, tmp_path):
    at = lambda d, m=0: datetime.datetime(2024, 1, d, 0, m)
    schema = "entity_type string, entity_id long, reason string, score double, observed_at timestamp"
    files = [
        [("trip", 1, "gap", 0.1, at(1)), ("trip", 2, "gap", None, at(1)), ("trip", None, "gap", 0.5, None)],
        [("trip", 1, "gap", 0.2, at(2)), ("trip", 1, "gap", 0.4, at(2))],
        [("trip", 9, "gap", 0.3, at(20))],
        [("trip", 1, "gap", 0.7, at(21)), ("trip", 9, "gap", None, at(20))],
        [("trip", 5, "gap", 0.5, at(28))],
    ]
    src = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.review_ttl_stream(stream, 3 * 86400).writeStream.outputMode("update").format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "ttl")).start()
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = spark.table("ttl").collect()
    expired = sorted((r.entity_id, r.seen, r.score, r.observed_at) for r in got if r.state == "expired")
    assert expired == [(1, 1, 0.7, at(21)), (1, 3, 0.4, at(2)), (2, 1, None, at(1)), (9, 2, 0.3, at(20))]
    assert max(held) >= 2 and held[-1] == 1  # only the last key is left
    last = {(r.entity_id, r.seen, r.score, r.observed_at) for r in got if r.state == "live" and r.entity_id == 5}
    table = spark.read.schema(schema).parquet(src)
    assert {tuple(r)[1:2] + tuple(r)[3:] for r in streams.review_episodes(table, 3 * 86400).collect()} == set(expired) | last
