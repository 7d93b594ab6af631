"""Connected components over an edge table by alternating star contraction, and the checkpoints it needs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the folder the session names; only in a local session that names none (tests), a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a written folder that is no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """A copy in the shared checkpoint folder: survives lost executors and cuts the lineage."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


#: Parts that the edges of a node are dealt to when they meet the node's minimum.
PARTS = 8


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (u, v) with the row of `low` for u. The edges of a node are dealt to PARTS by their other end, and each part gets a copy of that row."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    copies = low.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), ["u", "part"]).drop("part")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b): root is the smallest node it reaches.

    Loops and repeated edges do no harm; nodes without an edge to another node are not returned. The number of
    rounds grows with the logarithm of the longest path, and a node of high degree is only ever joined to copies
    of one row, its minimum.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(e)
    sign = _sign(e)
    while sign[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, sign = sign, _sign(e)
        if before == sign:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
