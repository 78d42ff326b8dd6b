"""Which processes descend from others, at any depth and with cycles of reused pids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share: the session's, else one in the warehouse."""
    spark = frame.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return frame.checkpoint()


def descendants(forks: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots (pid) and all that descends from them by ``forks`` (parent, child), once each.

    Nodes with one parent point upwards, and each round doubles how far they point, so a chain of any
    length takes rounds in proportion to its logarithm; in a cycle they stop once they have seen all of
    it. Nodes with several parents, as reused pids have, are then reached in rounds over those nodes
    alone, never twice. Nulls and self-forks are left out; repeated rows count once.
    """
    start = _kept(roots.select(F.col("pid").cast("long").alias("pid")).where("pid is not null").distinct())
    edges = forks.select(F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child")).where("parent <> child").distinct()
    above = _kept(edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("up")))
    is_root = start.withColumn("hit", F.lit(True))
    own = above.where("n = 1").join(is_root, F.col("child") == F.col("pid"), "left")
    # hit: whether a root is among the nodes from this one up to, but without, the one it points to.
    climb = _kept(own.select(F.col("child").alias("node"), "up", F.coalesce("hit", F.lit(False)).alias("hit"), F.lit(False).alias("top")))
    for _ in range(climb.count().bit_length() + 1):
        over = climb.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hit").alias("hit2"))
        moved = climb.where("not top").join(over, "up", "left")
        step = moved.select("node", F.coalesce("up2", "up").alias("up"), (F.col("hit") | F.coalesce("hit2", F.lit(False))).alias("hit"), F.col("up2").isNull().alias("top"))
        climb = _kept(climb.where("top").unionByName(step))
        if not climb.where("not top").limit(1).count():
            break
    joined = edges.join(above.where("n > 1").select("child"), "child")
    if not joined.limit(1).count():
        reached = start
    else:
        via = joined.join(climb.select(F.col("node").alias("parent"), "up", "hit"), "parent", "left")
        # An edge from where a parent's chain ends; null if a root is on the chain itself.
        steps = _kept(via.select(F.when(~F.coalesce("hit", F.lit(False)), F.coalesce("up", "parent")).alias("from"), F.col("child").alias("pid")).distinct())
        new = _kept(steps.where("from is null").select("pid").union(start).distinct())
        reached = new
        while new.limit(1).count():
            new = _kept(steps.join(new.withColumnRenamed("pid", "from"), "from", "left_semi").select("pid").distinct().join(reached, "pid", "left_anti"))
            reached = _kept(reached.union(new))
    below = climb.join(reached.select(F.col("pid").alias("up"), F.lit(True).alias("far")), "up", "left").where("hit or far").select(F.col("node").alias("pid"))
    return reached.union(below).distinct()
