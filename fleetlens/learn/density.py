"""Density clustering on a grid (survey 2.10 ``cluster_density``, re-aimed).

Exact DBSCAN needs the eps-neighbourhood of every point, i.e. distances
between the points of neighbouring cells; one crowded cell makes that
quadratic. This job never pairs points. With cells of side eps / (2 * sqrt(d))
any two points in cells at most one step apart (in every dimension) are
within eps, so:

* a point is core when its cell block (the 3^d cells around it) holds at
  least ``min_samples`` points (a count per cell, then a sum over the block);
* core cells one step apart are connected; clusters are the connected
  components of the core-cell graph, found by min-label propagation with
  pointer jumping (checkpointed rounds, until no label changes);
* a non-core point joins the cluster of a core cell in its block (smallest
  label), otherwise it is noise (-1).

Every core point it reports is a DBSCAN core point and every link it makes is
a DBSCAN link, but points whose eps-neighbours lie two or more cells away are
not counted, so it can report more noise than DBSCAN. It is a different
algorithm, named as such; work is linear in rows (one row per cell and
neighbour offset, 3^d offsets) and suits up to 3 dimensions.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _offsets(d: int):
    return [list(o) for o in itertools.product((-1, 0, 1), repeat=d)]


def grid_density_clusters(df: DataFrame, id_col: str, features, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, cluster) with cluster = -1 for noise; labels are the smallest cell
    id (as text) of each component, then renumbered 0..k-1 by that order.

    At most 3 features (3^d neighbour cells per cell); a row with a null
    feature is noise."""
    feats = list(features)
    d = len(feats)
    if d > 3:
        raise ValueError("grid density clustering is meant for at most 3 dimensions")
    side = eps / (2.0 * math.sqrt(d))
    cell_cols = [F.floor(F.col(f"`{f}`") / F.lit(side)).cast("long").alias(f"_c{i}") for i, f in enumerate(feats)]
    pts = df.select(F.col(id_col).alias("_id"), *cell_cols).persist(StorageLevel.MEMORY_AND_DISK)
    cnames = [f"_c{i}" for i in range(d)]
    cells = pts.groupBy(*cnames).agg(F.count(F.lit(1)).alias("_n"))

    # block counts: every cell sends its count to the 3^d cells around it
    offs = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in _offsets(d)])).alias("_o")
    sent = cells.select(*cnames, "_n", offs)
    moved = sent.select(*[(F.col(c) + F.col("_o")[i]).alias(c) for i, c in enumerate(cnames)], "_n")
    block = moved.groupBy(*cnames).agg(F.sum("_n").alias("_block"))
    core_cells = materialize(cells.join(block, cnames).where(F.col("_block") >= min_samples)
                             .select(*cnames, F.concat_ws(",", *[F.col(c).cast("string") for c in cnames])
                                     .alias("_cell")))

    # edges between core cells one step apart (both directions, self loop kept)
    nb = core_cells.select(*cnames, "_cell", offs)
    nb = nb.select("_cell", *[(F.col(c) + F.col("_o")[i]).alias(c) for i, c in enumerate(cnames)])
    edges = nb.join(core_cells.select(*cnames, F.col("_cell").alias("_dst")), cnames).select("_cell", "_dst")
    edges = materialize(edges)

    labels = core_cells.select("_cell", F.col("_cell").alias("_lab"))
    labels = materialize(labels)
    while True:
        prop = (edges.join(labels, "_cell").groupBy("_dst").agg(F.min("_lab").alias("_new"))
                .withColumnRenamed("_dst", "_cell"))
        low = labels.join(prop, "_cell").select("_cell", F.least("_lab", "_new").alias("_lab"))
        # every label is itself a cell of the same component: hook the label's own
        # cell under the smaller label seen below it, then jump to the label's label
        hook = low.join(labels.withColumnRenamed("_lab", "_old"), "_cell").groupBy(F.col("_old").alias("_cell")).agg(
            F.min("_lab").alias("_hook"))
        low = materialize(low.join(hook, "_cell", "left").select("_cell", F.least("_lab", F.coalesce("_hook", "_lab")).alias("_lab")))
        jump = low.select(F.col("_cell").alias("_lab"), F.col("_lab").alias("_far"))
        nxt = materialize(low.join(jump, "_lab").select("_cell", F.least("_lab", "_far").alias("_lab")))
        changed = nxt.join(labels.withColumnRenamed("_lab", "_old"), "_cell").where(
            F.col("_lab") != F.col("_old")).limit(1).count()
        labels = nxt
        if changed == 0:
            break

    cell_lab = core_cells.join(labels, "_cell").select(*cnames, "_lab")
    # every cell of the grid that touches a core cell inherits its smallest label
    reach = cell_lab.select(*cnames, "_lab", offs)
    reach = reach.select(*[(F.col(c) + F.col("_o")[i]).alias(c) for i, c in enumerate(cnames)], "_lab")
    reach = reach.groupBy(*cnames).agg(F.min("_lab").alias("_reach"))
    own = cell_lab.withColumnRenamed("_lab", "_own")
    assigned = (pts.join(own, cnames, "left").join(reach, cnames, "left")
                .select("_id", F.coalesce("_own", "_reach").alias("_lab")))
    # renumber component labels 0..k-1 in label order (one row per component)
    comps = assigned.where(F.col("_lab").isNotNull()).select("_lab").distinct()
    from pyspark.sql import Window
    comps = comps.select("_lab", (F.dense_rank().over(Window.orderBy("_lab")) - 1).cast("int").alias("cluster"))
    out = assigned.join(comps, "_lab", "left").select(
        F.col("_id").alias(id_col), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
    return out
