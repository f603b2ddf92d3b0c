"""Connected components by edges, for small and large graphs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The session's shared folder; in local mode only, a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="basewise-"))
    return sc.getCheckpointDir()


def kept_folder(spark: SparkSession) -> str:
    """The path of a new folder in the shared one for a result that is read later; it goes when the driver ends."""
    path = f"{_shared(spark)}/kept-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 (the JVM may have ended first)
            pass

    atexit.register(clean)
    return path


def _cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node reaches. Labels go along edges and jump to their label's label."""
    both = _cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component"))
    while True:
        labels = _cut(labels)
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        nxt = labels.join(near, "node").select("node", F.least("component", "m").alias("component"))
        jump = nxt.join(nxt.select(F.col("node").alias("component"), F.col("component").alias("j")), "component", "left").select("node", F.coalesce("j", "component").alias("component"))
        jump = _cut(jump)
        if not jump.join(labels.withColumnRenamed("component", "old"), "node").where("component != old").limit(1).count():
            return jump
        labels = jump
