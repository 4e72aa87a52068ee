"""Connected components of an edge table, and where intermediate results are cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take spark.checkpoint.dir from the session; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder: lineage ends here and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, max_rounds: int = 80) -> DataFrame:
    """(node, component) for every node of edges(src, dst); component is the smallest node it reaches.

    Nodes have an order by hash. Each round maps every node to the first of itself and its neighbours (a map-side combined
    min), rewrites the edges between those and drops loops and repeats. The order being random, a share of the nodes of any path goes
    in each round, so rounds grow with the logarithm of the longest path, and a star is gone in three. A hub's edges are only
    ever min-aggregated or sort-merge joined, which adaptive execution splits. Null ends are ignored;
    self-loops give their node a component; an empty table gives an empty result.
    """
    pairs = edges.select(F.col("src"), F.col("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = cut(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    sides = lambda df, a, b: df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()
    live = cut(sides(pairs, "src", "dst"))
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        ends = F.array(*(F.struct(F.col(a).alias("node"), F.col(b).alias("to")) for a in ("src", "dst") for b in ("src", "dst")))
        near = live.select(F.inline(ends))
        first = F.min(F.struct(F.xxhash64("to").alias("h"), "to"))
        step = cut(near.groupBy("node").agg(first.alias("first")).select("node", "first.to"))
        steps.append(step)
        a = step.select(F.col("node").alias("src"), F.col("to").alias("a"))
        b = step.select(F.col("node").alias("dst"), F.col("to").alias("b"))
        live = cut(sides(live.join(a, "src").join(b, "dst"), "a", "b"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = nodes.select("node", F.col("node").alias("root"))
    for step in steps:
        s = step.select(F.col("node").alias("root"), F.col("to"))
        out = out.join(s, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    # dealt anew by node: whoever reads this next would else find a large component in one task
    return out.join(least, "root").select("node", "component").repartition("node")
