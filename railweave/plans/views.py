"""Transit-shaped views over the driver's tables; one SQL text for Spark and for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "v_stops": """SELECT s_suppkey AS stop_id, s_name AS name, CAST(54.0 + (s_suppkey * 37 % 400) / 200.0 AS DOUBLE) AS lat, CAST(82.0 + (s_suppkey * 91 % 600) / 200.0 AS DOUBLE) AS lon, n_name AS settlement, r_name AS region
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_trips": """SELECT o_orderkey AS trip_id, o_custkey % 200 AS route_id, o_orderkey % 7 AS service_id, CAST(o_orderdate AS DATE) AS service_date,
        CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '1,2,3,4,5' WHEN o_orderkey % 4 = 2 THEN '0,6' ELSE '0,3' END AS service_days,
        CASE WHEN o_orderkey % 2 = 0 THEN 'forward' ELSE 'backward' END AS direction, CASE WHEN o_orderkey % 9 = 0 THEN CAST('2024-01-01' AS DATE) END AS valid_to FROM {orders}""",
    "v_stop_times": """SELECT l_orderkey AS trip_id, seq, l_suppkey AS stop_id, 21600 + (l_orderkey % 600) * 60 + seq * 3600 AS arrival_s, 21600 + (l_orderkey % 600) * 60 + seq * 3600 + 60 * (1 + l_linenumber % 3) AS departure_s, l_suppkey % 6 = 0 AS provisional
        FROM (SELECT l_orderkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS seq FROM {lineitem}) t""",
    "v_terminals": """SELECT c_custkey AS terminal_id, c_name AS name, CAST(50.0 + (c_custkey * 53 % 900) / 100.0 AS DOUBLE) AS lat, CAST(80.0 + (c_custkey * 97 % 1100) / 100.0 AS DOUBLE) AS lon, n_name AS settlement, r_name AS region, 'osm' AS source,
        CASE WHEN c_custkey % 5 = 0 THEN 'rail' ELSE 'bus' END AS transport, c_custkey % 7 = 0 AS locked FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_records": """SELECT c_custkey AS record_id, replace(c_name, '#', ' ') AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(50.0 + (c_custkey * 53 % 900) / 100.0 + (c_custkey % 7) * 0.0006 AS DOUBLE) END AS lat,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(80.0 + (c_custkey * 97 % 1100) / 100.0 AS DOUBLE) END AS lon, n_name AS settlement, 'yandex' AS source, 'bus' AS transport
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0""",
    "v_candidates": """SELECT event_id, user_id AS entity_id, event_type AS field, CAST(value AS VARCHAR(40)) AS value, CAST((event_id * 7919 % 100) / 100.0 AS DOUBLE) AS confidence, ts AS observed_at,
        CASE event_id % 4 WHEN 0 THEN 'osm' WHEN 1 THEN 'yandex' WHEN 2 THEN 'mintrans' ELSE 'gtfs' END AS source, CASE WHEN event_id % 5 = 0 THEN 'seed' ELSE 'live' END AS origin, CASE WHEN event_id % 97 = 0 THEN 1 END AS actor_id FROM {events}""",
    "v_places": """SELECT CAST(1000000 + r_regionkey AS BIGINT) AS place_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, 2 AS level FROM {region}
        UNION ALL SELECT CAST(2000000 + n_nationkey AS BIGINT), CAST(1000000 + n_regionkey AS BIGINT), n_name, 4 FROM {nation}
        UNION ALL SELECT CAST(3000000 + s_suppkey AS BIGINT), CAST(2000000 + s_nationkey AS BIGINT), s_name, 5 FROM {supplier}""",
    "v_routes": """SELECT c_custkey AS route_id, c_name AS name, n_name AS carrier, lpad(CAST(c_nationkey AS VARCHAR(4)), 2, '0') || '.' || CAST(c_custkey AS VARCHAR(12)) AS code, CASE WHEN c_custkey % 5 = 0 THEN 'rail' ELSE 'bus' END AS mode,
        CASE WHEN c_custkey % 13 = 0 THEN CAST('2024-01-01' AS DATE) END AS valid_to, CASE WHEN c_custkey % 2 = 0 THEN 'north' ELSE 'south' END AS provider FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_outcomes": """SELECT o_orderkey AS trip_id, o_custkey % 200 AS route_id, r_name AS region, CASE WHEN o_orderkey % 5 = 0 THEN 'dead' WHEN o_orderkey % 3 = 0 THEN 'staged' ELSE 'promoted' END AS outcome,
        CASE WHEN o_orderkey % 3 = 0 THEN 'awaiting_times' WHEN o_orderkey % 5 = 0 THEN 'skeleton_gap' ELSE 'done' END AS state, CAST(o_orderdate AS DATE) AS observed_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_best": """SELECT s_suppkey AS stop_id, r_name AS region, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST((s_suppkey * 31 % 100) / 100.0 AS DOUBLE) END AS score, s_suppkey % 4 <> 0 AS guard, CASE WHEN s_suppkey * 31 % 100 >= 60 THEN 'verified' ELSE 'rejected' END AS decision
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_identifiers": """SELECT c_custkey % 500 AS terminal_id, CASE c_custkey % 4 WHEN 0 THEN 'osm' WHEN 1 THEN 'yandex' WHEN 2 THEN 'mintrans' ELSE 'esr' END AS system, 'id' AS code_type, CAST(c_custkey % 700 AS VARCHAR(12)) AS code, c_custkey AS arrived, c_custkey % 3 = 0 AS is_primary FROM {customer}""",
    "v_reviews": """SELECT event_id AS review_id, user_id AS terminal_id, event_type AS reason, CAST((event_id * 7919 % 100) / 100.0 AS DOUBLE) AS score, ts AS observed_at, CAST(event_id % 50 AS VARCHAR(8)) AS fingerprint FROM {events} WHERE event_id % 3 = 0""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Attribute access to the driver's tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return base(self.spark, self.sf_dir, name)
        if name not in VIEWS:
            raise AttributeError(name)
        used = {t: base(self.spark, self.sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **used)


def twin(text: str) -> str:
    """A SQL twin with the views it names as common table expressions."""
    used = [f"{n} AS ({v.format(**{t: t for t in TABLES})})" for n, v in VIEWS.items() if n in text]
    if not used:
        return text
    head = "WITH RECURSIVE " if "WITH RECURSIVE" in text else "WITH "
    body = text.replace("WITH RECURSIVE", "", 1) if "WITH RECURSIVE" in text else text
    stripped = body.strip()
    more = stripped[4:].strip() if stripped.startswith("WITH ") else stripped
    joint = ", " if stripped.startswith("WITH ") or "WITH RECURSIVE" in text else " "
    return head + ", ".join(used) + joint + more
