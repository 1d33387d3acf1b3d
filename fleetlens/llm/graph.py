"""Connected components by randomised contraction in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, shared_dir


#: Edges of a round that a task takes, and up to which its picks are broadcast.
EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected edges ``a, b`` (longs).

    Each round every node picks the node of least random rank among itself and
    its neighbours; edges move to the picks, and those inside a pick go. Picks
    are minima (combined before the shuffle) and every round is written, so
    neither a hub nor a long chain is special: the nodes left shrink by a
    constant factor a round, in expectation. It ends when no edge is left.

    In a round of few edges every node picks its neighbour of least rank, itself
    only to end the one cycle there is, of two nodes that pick each other. Its
    picks are broadcast and followed four steps, in few tasks however many
    partitions shuffles have. So a star is one round and the nodes at least halve
    but for deeper picks.
    """
    spark = edges.sparkSession
    cores = spark.sparkContext.defaultParallelism
    spent: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        spent.append(shared_dir(spark, "components"))
        df.write.parquet(spent[-1])
        return spark.read.schema(df.schema).parquet(spent[-1])

    e = put(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while rows := e.count():
        turn, few = turn + 1, rows <= EDGES
        part = lambda df: df.coalesce(cores) if few else df  # noqa: E731,B023
        side = lambda df: F.broadcast(df) if few else df  # noqa: E731,B023
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731,B023
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = both.select("a", F.struct(rank("b").alias("r"), F.col("b").alias("n")).alias("x")).groupBy("a").agg(F.min("x").alias("x"))
        if few:
            pick = put(part(pick.select(F.col("a").alias("node"), F.col("x.n").alias("to"))))
            follow = lambda p: p.join(F.broadcast(p.select(F.col("node").alias("to"), F.col("to").alias("next"))), "to")
            pick = put(follow(pick).select("node", F.when(F.col("next") == F.col("node"), F.least("node", "to")).otherwise(F.col("next")).alias("to")))
            pick = put(follow(pick).select("node", F.col("next").alias("to")))
        else:
            pick = put(pick.select(F.col("a").alias("node"), F.when(
                F.struct(rank("a").alias("r"), F.col("a").alias("n")) < F.col("x"), F.col("a")).otherwise(F.col("x.n")).alias("to")))
        if labels is None:
            labels = put(pick.withColumnRenamed("to", "root"))
        else:
            labels = labels.join(side(pick.select(F.col("node").alias("root"), "to")), "root", "left")
            labels = put(labels.select("node", F.coalesce("to", "root").alias("root")))
        last = spent[-1]
        moved = (e.join(side(pick.select(F.col("node").alias("a"), F.col("to").alias("pa"))), "a")
                 .join(side(pick.select(F.col("node").alias("b"), F.col("to").alias("pb"))), "b")
                 .where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        e = put(part(moved))
        for path in [p for p in spent if p not in (last, spent[-1])]:
            delete_path(spark, path)
        spent[:] = [last, spent[-1]]
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
