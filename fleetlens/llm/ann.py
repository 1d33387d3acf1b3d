"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Graph. Equal vectors are one node. The first neighbours come from a few random
projections: nodes sort by (code of projection signs, one more projection), and
windows of that order compare their members. Then NN-descent rounds, each a set
of Spark joins: every node gathers its neighbours and a bounded share of those
that name it, with their vectors; pairs of them, at least one new, are held
against each other, since neighbours of neighbours tend to be neighbours; what
beats a node's worst neighbour is merged into its list. Rounds go on until fewer
than ``settled`` of all list entries change. Vectors travel as float32 where that holds
every component exactly, else as float64. Products of centred vectors only pick
pairs, with room for their rounding; the distances kept are sums of squared
differences, so near copies stay apart and a large vector blurs no other.

Search. A query starts at its own node. Each hop opens its best unopened nodes,
fetches their neighbours by join, measures the exact distance and keeps the best
``beam``; a query ends when its beam holds nothing unopened. Nodes found then
stand for all their rows.

Lists, gathered neighbours and beams have fixed lengths; ranks are limited before
the shuffle, so a node that very many name is no hot spot. Each round is written
to the shared folder.

Defined cases: null, empty and zero vectors, vectors with null or non-finite
components and null ids take no part; rows that repeat an id count once, with the
smallest vector; vectors of different lengths meet as if filled with zeros; equal
distances go to the smaller id; fewer candidates than k give all that the graph
reaches; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, stored
from .vectors import matrix, usable

NEIGHBOURS, NAMED_BY = 40, 40
TREES, WINDOW = 6, 512
SETTLED = 0.02
BEAM, OPEN = 96, 24
SAMPLE = 4096

PAIRS, HELD = 16_384, 1 << 20  # pairs measured at a time, pairs a task holds before it keeps the k best of each node
_EDGE = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("d", pa.float64())])
_EDGE_DDL = "node long, id long, d double"


def _first_rank(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The n first rows of each key (limited before the shuffle)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _about(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs in a stack (..., members, dims), by products, and a bound of their error."""
    x = x - x[..., :1, :]
    sq = (x * x).sum(axis=-1)
    both = sq[..., :, None] + sq[..., None, :]
    return both - 2 * x @ np.swapaxes(x, -1, -2), both * (8 * (x.shape[-1] + 8) * np.finfo(float).eps)


def _exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[a], x[b]), by differences: the same for a pair wherever it is met."""
    out = np.empty(len(a))
    for lo in range(0, len(a), PAIRS):
        diff = x[a[lo:lo + PAIRS]] - x[b[lo:lo + PAIRS]]
        out[lo:lo + PAIRS] = (diff * diff).sum(axis=1)
    return out


def _seed_graph(nodes: DataFrame, dims: int, k: int, trees: int, window: int, n: int, kind: type) -> DataFrame:
    """``node, id, d``: neighbours within windows of random projection orders."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / window)))))
    rng = np.random.default_rng(7)
    directions = rng.normal(size=(dims, trees * (bits + 1)))
    sample = np.array([list(r[0]) + [0] * (dims - len(r[0])) for r in nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").collect()])
    middle = np.median(sample @ directions, axis=0)
    shared = nodes.sparkSession.sparkContext.broadcast((directions, middle))

    def place(batches: Iterator[pa.RecordBatch]):
        r, m = shared.value
        for b in batches:
            p = matrix(b.column(1), dims) @ r - m
            for t in range(trees):
                own = p[:, t * (bits + 1):(t + 1) * (bits + 1)]
                code = (own[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(code), pa.array(own[:, bits]),
                                                  b.column(0), b.column(2)], names=["tree", "code", "at", "node", "small"])

    def near(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            node = b.column(0).to_numpy()
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), kind).reshape(-1, dims).astype(float)
            for lo in range(0, len(node), window):
                lo = max(0, min(lo, len(node) - window))
                ids = node[lo:lo + window]
                d, room = _about(x[lo:lo + window])
                d[ids[:, None] == ids[None, :]] = np.inf
                last = np.partition(d, k - 1, axis=1)[:, k - 1:k] if k < len(ids) else np.inf
                rows, cols = np.nonzero((d <= last + 2 * room) & np.isfinite(d))
                exact = _exact(x[lo:lo + window], rows, cols)
                by = np.lexsort((cols, exact, rows))
                rows, cols, exact = rows[by], cols[by], exact[by]
                ok = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                yield pa.record_batch([pa.array(ids[rows[ok]]), pa.array(ids[cols[ok]]), pa.array(exact[ok])], schema=_EDGE)

    placed = nodes.select("node", "vec", "small").mapInArrow(place, "tree int, code long, at double, node long, small binary")
    parts = max(1, int(np.ceil(trees * n / (16 * window))))  # full windows, whatever the session's partitions are
    ordered = placed.repartitionByRange(parts, "tree", "code", "at").sortWithinPartitions("tree", "code", "at")
    return ordered.select("node", "small").mapInArrow(near, _EDGE_DDL)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """``node, id, d, fresh, rank, worst``: the k nearest of each node; fresh unless an edge of the pair was
    known; ``worst`` is the distance to beat (infinite while the list is short).

    Limited before its one shuffle: an edge found several times has one dense rank, and all
    that follows keeps the partitioning by node.
    """
    near, whole = Window.partitionBy("node").orderBy("d", "id"), Window.partitionBy("node")
    best = edges.withColumn("rank", F.dense_rank().over(near)).where(F.col("rank") <= k)
    one = best.groupBy("node", "id").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    worst = F.when(F.count(F.lit(1)).over(whole) >= k, F.max("d").over(whole)).otherwise(F.lit(float("inf")))
    return one.withColumn("rank", F.row_number().over(near)).withColumn("worst", worst)


def _descend(graph: DataFrame, small: DataFrame, dims: int, k: int, named: int, turn: int, kind: type) -> DataFrame:
    """Updates ``node, id, d`` from one round of local joins."""
    back = graph.select(F.col("id").alias("at"), F.col("node").alias("member"), "fresh")
    back = _first_rank(back, "at", [F.desc("fresh"), F.xxhash64(F.lit(turn), "member"), "member"], named)
    around = graph.select(F.col("node").alias("at"), F.col("id").alias("member"), "fresh").unionByName(back)
    # at most k + named rows a node, so one shuffle by node serves both steps
    around = around.repartition("at").groupBy("at", "member").agg(F.max("fresh").alias("fresh"))
    # nodes around which nothing is fresh have nothing to compare
    around = around.withColumn("any", F.max("fresh").over(Window.partitionBy("at"))).where("any").drop("any")
    known = small.join(graph.where("rank = 1").select("node", "worst"), "node", "left").select(
        F.col("node").alias("member"), "small", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    met = around.join(known, "member").groupBy("at").agg(F.collect_list(F.struct("member", "fresh", "worst", "small")).alias("m"))
    met = met.select(
        F.col("m.member").alias("ids"), F.col("m.fresh").alias("fresh"), F.col("m.worst").alias("worst"), F.col("m.small").alias("small"))

    def best(out):
        """The k best of each node among the pairs held are enough."""
        node, other, d = (np.concatenate(z) for z in zip(*out))
        order = np.lexsort((d, node))
        node, other, d = node[order], other[order], d[order]
        keep = np.ones(len(node), bool)
        same = np.lexsort((d, other, node))
        dup = np.concatenate(([False], (node[same][1:] == node[same][:-1]) & (other[same][1:] == other[same][:-1])))
        keep[same[dup]] = False
        node, other, d = node[keep], other[keep], d[keep]
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
        ok = rank < k
        return pa.record_batch([pa.array(node[ok]), pa.array(other[ok]), pa.array(d[ok])], schema=_EDGE)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out, held = [], 0
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids = [c.values.to_numpy() for c in part.column(0)]
                size = max(map(len, ids))
                n = len(ids)
                idx = np.full((n, size), -1, np.int64)
                fresh, worst = np.zeros((n, size), bool), np.full((n, size), -1.0)
                x = np.zeros((n, size, dims))
                for i in range(n):
                    c = len(ids[i])
                    idx[i, :c] = ids[i]
                    fresh[i, :c] = part.column(1)[i].values.to_numpy(zero_copy_only=False)
                    worst[i, :c] = part.column(2)[i].values.to_numpy()
                    x[i, :c] = np.frombuffer(b"".join(part.column(3)[i].as_py()), kind).reshape(c, dims)
                d, room = _about(x)
                real = np.arange(size)[None, :] < np.array([len(v) for v in ids])[:, None]
                ok = (d < worst[:, :, None] + room) & (fresh[:, :, None] | fresh[:, None, :]) & real[:, :, None] & real[:, None, :]
                ok &= ~np.eye(size, dtype=bool)[None]
                g, r, c = np.nonzero(ok)
                d = _exact(x.reshape(-1, dims), g * size + r, g * size + c)
                ok = d < worst[g, r]
                out.append((idx[g, r][ok], idx[g, c][ok], d[ok]))
                held += len(out[-1][0])
                if held > HELD:
                    yield best(out)
                    out, held = [], 0
            if held:
                yield best(out)

    return met.mapInArrow(run, _EDGE_DDL)


def build_graph(nodes: DataFrame, dims: int, k: int = NEIGHBOURS, named: int = NAMED_BY, trees: int = TREES, window: int = WINDOW,
                settled: float = SETTLED) -> DataFrame:
    """``node, id, d, fresh, rank, worst``: the neighbour lists of ``nodes`` (node, vec), by NN-descent."""
    whole = F.min(F.forall("vec", lambda v: v.cast("float").cast("double") == v))
    n, short = nodes.agg(F.count(F.lit(1)), whole).first()
    kind = np.float32 if short else np.float64

    def packed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = matrix(b.column(1), dims).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "vec", "small"])

    both = stored(nodes.mapInArrow(packed, "node long, vec array<double>, small binary"), "ann-nodes")
    small = both.select("node", "small")
    graph = stored(_lists(_seed_graph(both, dims, k, trees, window, n, kind).withColumn("fresh", F.lit(True)), k), "ann-graph")
    turn = 0
    while True:
        turn += 1
        found = _descend(graph, small, dims, k, named, turn, kind).withColumn("fresh", F.lit(True))
        # known neighbours are no longer fresh; a pair found again keeps that
        new = stored(_lists(graph.select("node", "id", "d", F.lit(False).alias("fresh")).unionByName(found), k), "ann-graph")
        changed = new.where("fresh").count()
        graph = new
        release(nodes.sparkSession)
        if changed <= settled * n * k:
            return graph


def _measured(pairs: DataFrame, dims: int) -> DataFrame:
    """``q, node, d`` from rows (q, node, qv, vec): exact distances."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            diff = matrix(b.column(2), dims) - matrix(b.column(3), dims)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt((diff * diff).sum(axis=1)))], names=["q", "node", "d"])
    return pairs.select("q", "node", "qv", "vec").mapInArrow(run, "q long, node long, d double")


def _beams(rows: DataFrame, beam: int, open_: int) -> DataFrame:
    """The best ``beam`` rows of each query; ``next`` marks the best unopened ones (one shuffle, by query)."""
    order = Window.partitionBy("q", "opened").orderBy("d", "node")
    return _first_rank(rows, "q", ["d", "node"], beam).withColumn("next", ~F.col("opened") & (F.row_number().over(order) <= open_))


def search(nodes: DataFrame, graph: DataFrame, asked: DataFrame, dims: int, beam: int = BEAM, open_: int = OPEN,
           named: int = NAMED_BY) -> DataFrame:
    """``q, node, d``: the best ``beam`` nodes that greedy search reaches from each query's ``start`` node.

    ``asked`` has ``q, qv, start``.
    """
    back = _first_rank(graph.select(F.col("id").alias("node"), F.col("node").alias("id"), "d"), "node", ["d", "id"], named)
    ways = stored(graph.select("node", "id").unionByName(back.select("node", "id")).distinct()
                  .groupBy("node").agg(F.collect_list("id").alias("ids")), "ann-ways")
    start = asked.join(nodes.select(F.col("node").alias("start"), "vec"), "start").withColumn("node", F.col("start"))
    found = stored(_beams(_measured(start, dims).withColumn("opened", F.lit(False)), beam, open_), "ann-beams")
    while True:
        todo = found.where("next").select("q", "node")
        if todo.isEmpty():
            return found.select("q", "node", "d")
        seen = found.select("q", "node", "d", (F.col("opened") | F.col("next")).alias("opened"))
        reach = todo.join(ways, "node").select("q", F.explode("ids").alias("node")).distinct()
        reach = reach.join(found.select("q", "node"), ["q", "node"], "left_anti")
        new = _measured(reach.join(nodes, "node").join(asked.select("q", "qv"), "q"), dims).withColumn("opened", F.lit(False))
        found = stored(_beams(seen.unionByName(new), beam, open_), "ann-beams")
        release(nodes.sparkSession)


def nearest(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: k near rows of each query by Euclidean distance.

    ``queries`` is a condition on ``vec_id``; a query's candidates are all rows but its own.
    """
    rows = stored(usable(df, id_col, vec_col, nonzero=True), "ann-rows")
    dims = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(1))).first()[0]
    padded = rows.withColumn("key", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vec"))))
    nodes = stored(padded.groupBy("key").agg(F.min("vec_id").alias("node")).select("node", F.col("key").alias("vec")), "ann-distinct")
    of = padded.join(nodes.select("node", F.col("vec").alias("key")), "key").select("vec_id", "node", F.col("key").alias("vec"))
    of = stored(of, "ann-members")
    if nodes.isEmpty():
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    graph = build_graph(nodes, dims, **options)
    ask = materialize(of.where(queries).select(F.col("vec_id").alias("q"), F.col("vec").alias("qv"), F.col("node").alias("start")))
    found = search(nodes, graph, ask, dims)
    # a node stands for all rows with its vector; k + 1 of them are enough for any query
    members = _first_rank(of.select("node", "vec_id"), "node", ["vec_id"], k + 1)
    rows_found = found.join(members, "node").where("vec_id != q")
    best = Window.partitionBy("q").orderBy("d", "vec_id")
    return (rows_found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score")))
