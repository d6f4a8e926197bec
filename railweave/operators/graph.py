"""Shared-folder tables and connected components.

Lineage is cut by writing parquet below the folder that the cluster names in
``spark.checkpoint.dir``; a lost executor only costs the tasks it ran, because
every later read starts from files all executors can see.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors can read")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="railweave-"))
    return context.getCheckpointDir()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The kept tables of one computation, which are deleted once its result has been written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def add(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.add(keep(df, name))

    def drop(self, table: DataFrame) -> None:
        self.tables = [x for x in self.tables if x is not table]
        drop(table)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df``, delete all tables kept before, and read it back."""
        out = keep(df, name)
        for table in self.tables:
            drop(table)
        self.tables = []
        return out


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components as (node, root), root being the smallest node id.

    Each round hooks every node to its smallest neighbour, renames the edges to
    the hooks and drops those that became loops, so at least half of the nodes
    that still have edges vanish per round. Nodes without an edge are not
    returned; no edges give an empty table. Only a row count reaches the driver.
    """
    live = keep(
        edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "edges",
    )
    names = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = keep(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("up")), "hooks")
        if names is None:
            names_next = keep(hooks.select(F.col("u").alias("node"), F.col("up").alias("root")), "names")
        else:
            names_next = keep(
                names.join(hooks, names.root == hooks.u, "left").select("node", F.coalesce("up", "root").alias("root")), "names"
            )
            drop(names)
        names = names_next
        moved = live.join(hooks, "u").select(F.col("up").alias("a"), "v")
        far = hooks.select(F.col("u").alias("v"), F.col("up").alias("b"))
        renamed = moved.join(far, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        live_next = keep(renamed, "edges")
        drop(live)
        drop(hooks)
        live = live_next
    if names is None:
        names = live.select(F.col("u").alias("node"), F.col("v").alias("root"))
        names._kept_at = live._kept_at
    else:
        drop(live)
    return names
