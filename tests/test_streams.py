"""Streams run to the end of their input equal the batch operators."""

import datetime

from pyspark.sql import functions as F

from railweave.streaming import streams


def test_streams(spark, tmp_path):
    at = lambda d, m=0: datetime.datetime(2024, 1, d, 0, m)
    rows = [("trip", 1, "gap", 0.1, at(1), "p", "54", "terminal_created"), ("trip", 1, "gap", 0.2, at(2), "p", "42", "terminal_created"), ("trip", 2, "gap", 0.3, at(2, 5), "q", "54", "other"), ("trip", 9, "gap", 0.3, at(20), "q", "22", "terminal_created")]
    schema = "entity_type string, entity_id long, reason string, score double, observed_at timestamp, provider string, region string, event string"
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    got = {(r.entity_id, r.reason): (r.seen, r.score) for r in run(streams.review_stream(read()), "complete", "s03")}
    assert got[1, "gap"] == (2, 0.2)
    expired = {r.entity_id: r.seen for r in run(streams.expiry_stream(read(), "entity_id", "observed_at", "3 days"), "append", "s04")}
    assert expired == {1: 2, 2: 1}
    quota = run(streams.quota_stream(read(), 0, "observed_at"), "complete", "s05")
    assert all(r.over for r in quota)
    cache = spark.createDataFrame([("54", "p", at(1), "live", True)], "query string, provider string, cached_at timestamp, origin string, verified boolean")
    asked = read().select(F.col("region").alias("text"), "provider", F.col("observed_at").alias("asked_at"))
    states = sorted(r.state for r in run(streams.cache_stream(asked, cache), "append", "s06"))
    assert states == ["fresh", "miss", "miss", "miss"]
    seen: list[list[str]] = []
    q = streams.consume_outbox(read(), seen.append, str(tmp_path / "s01")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [["22", "42", "54"]]
    q = streams.publish_events(streams.event_rows(read().select("entity_id", "reason"), "trip", "entity_id", "seen"), str(tmp_path / "out"), str(tmp_path / "s02")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 4
