"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import scratch

EDGE = "u long, v long"


def saved(df: DataFrame, schema: str, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def forget(*tables: DataFrame | None) -> None:
    """Deletes what ``saved`` wrote, once nothing that is still to run reads it."""
    for t in tables:
        for d in {f.rpartition("/")[0] for f in t.inputFiles()} if t is not None else ():
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(d)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """node and label, the least node of its component, of each node on an edge (u, v).

    Every step hangs nodes onto smaller ones; the edges end as stars. A step groups by node with partial
    minima, so a node with very many edges is no single task's load, and each round's edges are written.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), EDGE, "edges")
    before = None
    for _ in range(most):
        # large star: a node's larger neighbours move to its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        pairs = large.join(_least(large), "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, e = e, saved(small, EDGE, "edges")
        forget(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    labels = saved(labels, "node long, label long", "labels")
    forget(e)
    return labels
