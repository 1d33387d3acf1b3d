"""Exact top-k search by inner product over integer vectors, with multi-resolution
segment statistics.

Vectors are cut into segments; a segment is described by its mean and its
deviation. For two segments of n components, q and x,

    q . x <= n * (mean q * mean x + deviation q * deviation x)

(the rest of the product is that of the centred parts: Cauchy-Schwarz), so the
sum over the segments bounds the score from above - and the squared distance
``|q|^2 + |x|^2 - 2 q . x`` from below. Bounds go from coarse to fine segments;
only candidates whose bound reaches the query's running k-th best score go on,
and scores are computed exactly for the survivors.

On Spark: candidates are numbered by falling length (range partitions, no one-task
window) and cut into blocks of bounded size, so that a block's vectors are alike in
length and its envelope (largest and smallest mean, largest deviation, per segment)
bounds all its scores at once. A first pass holds every query block against one of
the blocks of longest vectors, which gives each query a threshold. The second
pass lays a grid of tiles over queries and candidates: a task gets a few query
blocks and a few candidate blocks, drops blocks by envelope, then single pairs by
their segments, coarse to fine, scores what is left, and raises its thresholds as it
goes. A block travels once per tile of the other side; nothing is broadcast and a
task holds one tile. A window keeps the k best of the tiles' lists.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do null ids; rows that repeat an id count once, with
the smallest vector; vectors of different lengths meet as if filled with zeros;
equal scores go to the smaller id; fewer candidates than k give them all; an
empty table gives an empty result; components whose floor(scale * x) leaves the
range of a long, or scores that do, are outside this operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import positions
from .common import stored
from .vectors import usable

K = 20
SEGMENTS = (4, 16, 32)
BLOCK, QUERIES = 4096, 1024
AT_ONCE = 256  # queries of a block whose bounds are held at once
CELLS = 1 << 20  # components of a block at most
GATHERED = 1 << 21  # components of surviving candidates gathered at once


def _pack(rows: DataFrame, block: Column, dims: int, kind: str) -> DataFrame:
    """One row per block: ids and the integer matrix, as binaries."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        m = np.zeros((len(pdf), dims), kind)
        for i, v in enumerate(pdf["vec"]):
            m[i, :len(v)] = v
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                             "data": [m.tobytes()]})

    return rows.select("vec_id", "vec", block.cast("int").alias("block")).groupBy("block").applyInPandas(run, "block int, ids binary, data binary")


def bounds_of(m: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * (means, deviations) per segment: their inner product bounds that of the vectors."""
    parts = np.array_split(m.astype(float), min(segments, m.shape[1]), axis=1)
    cols = [f(p) * np.sqrt(p.shape[1]) for p in parts for f in (lambda x: x.mean(axis=1), lambda x: x.std(axis=1))]
    return np.stack(cols, axis=1)


def envelope(xb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per statistic, the largest and the smallest of a block's ``bounds_of`` rows."""
    return xb.max(axis=0), xb.min(axis=0)


def _reaches(top: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a bound reaches the threshold, with room for rounding in the bound."""
    return top * (1 + 1e-9 * np.sign(top)) + 1e-6 * (1 + np.abs(top)) >= floor


def exact_type(q: np.ndarray, x: np.ndarray):
    """The fastest type in which all inner products are exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return np.float32 if top < 2 ** 24 else np.float64 if top < 2 ** 52 else np.int64


class Block:
    """A block's ids, integer vectors and segment statistics per level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segments=SEGMENTS):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        self.levels = [bounds_of(self.vectors, s) for s in segments if s < vectors.shape[1]]


class Best:
    """The k best ``(score, id)`` of every query of a block and the score a candidate must reach."""

    def __init__(self, queries: Block, k: int, least: np.ndarray | None = None):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.least = np.full(n, -np.inf) if least is None else least.astype(float)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
        self.scored = 0  # pairs whose exact score was computed

    def search(self, x: Block) -> None:
        """Hold the queries against a candidate block; only pairs whose every bound reaches the threshold are scored."""
        if not len(x.ids) or not len(self.q.ids):
            return
        ask = np.arange(len(self.q.ids))
        if x.levels:  # queries that no vector of the block can serve skip it whole
            high, low = envelope(x.levels[-1])
            q = self.q.levels[-1]
            top = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
            ask = ask[_reaches(top, self.least)]
        kind = exact_type(self.q.vectors, x.vectors)
        qv, xv = self.q.vectors.astype(kind), x.vectors.astype(kind)
        some = max(1, GATHERED // xv.shape[1])
        for at in range(0, len(ask), AT_ONCE):
            rows = ask[at:at + AT_ONCE]
            alive = x.ids[None, :] != self.q.ids[rows, None]
            cols = np.arange(len(x.ids))
            for a, b in zip(self.q.levels, x.levels):
                alive &= _reaches(a[rows] @ b[cols].T, self.least[rows, None])
                keep = alive.any(axis=0)
                cols, alive = cols[keep], alive[:, keep]
            for r, live in zip(rows, alive):
                mine = cols[live]
                self.scored += len(mine)
                score = [xv[mine[i:i + some]] @ qv[r] for i in range(0, len(mine), some)]
                if score:
                    self._take(r, np.concatenate(score).astype(np.int64), x.ids[mine])

    def _take(self, r: int, score: np.ndarray, ids: np.ndarray) -> None:
        ok = score >= self.least[r]
        score, ids = np.concatenate([self.found[r][0], score[ok]]), np.concatenate([self.found[r][1], ids[ok]])
        if len(score) > self.k:
            best = np.lexsort((ids, -score))[:self.k]
            score, ids = score[best], ids[best]
        if len(score) == self.k:
            self.least[r] = max(self.least[r], float(score.min()))
        self.found[r] = score, ids


_DDL = "query_id long, vec_id long, score long"


def _matrix(data: bytes, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dims)


def _thresholds(dims: int, kind: str, k: int):
    """Task over rows (q_ids, q, ids, data): the k-th best score of each query; -inf where there are fewer."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for q_ids, q, ids, x in zip(*(c.to_pylist() for c in b.columns)):
                best = Best(Block(np.frombuffer(q_ids, np.int64), _matrix(q, dims, kind)), k)
                best.search(Block(np.frombuffer(ids, np.int64), _matrix(x, dims, kind)))
                yield pa.record_batch([pa.array([q_ids], pa.binary()), pa.array([best.least.tobytes()], pa.binary())], names=["q_ids", "least"])
    return run


def _tile(dims: int, kind: str, k: int):
    """Task over one tile: its query blocks against its candidate blocks, the longest vectors first."""
    import pandas as pd

    def run(asked: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        packed = packed.sort_values("block")
        lists = [Best(Block(np.frombuffer(i, np.int64), _matrix(q, dims, kind)), k, np.frombuffer(least, np.float64))
                 for i, q, least in zip(asked["q_ids"], asked["q"], asked["least"])]
        for i, x in zip(packed["ids"], packed["data"]):
            block = Block(np.frombuffer(i, np.int64), _matrix(x, dims, kind))
            for best in lists:
                best.search(block)
        rows = [(np.full(len(s), i), c, s) for best in lists for i, (s, c) in zip(best.q.ids, best.found)]
        if not rows:
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(z) for z in zip(*rows)))))
    return run


def top_k(df: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 64.0, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of greatest integer inner product.

    Components become floor(scale * x). ``queries`` is a condition on ``vec_id``;
    a query's candidates are all rows but its own. Blocks hold ``block`` and
    ``query_block`` vectors at most, fewer of long vectors.
    """
    rows = usable(df, id_col, vec_col)
    rows = rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    rows = stored(positions(rows.withColumn("length", length), [F.desc("length"), F.col("vec_id")], "at"), "topk-rows")
    n, n_q, dims, most = rows.agg(
        F.count(F.lit(1)), F.count(F.when(queries, 1)), F.coalesce(F.max(F.size("vec")), F.lit(1)),
        F.coalesce(F.max(F.array_max(F.transform("vec", F.abs))), F.lit(0.0))).first()
    kind = next((t for t, top in (("int16", 2 ** 15), ("int32", 2 ** 31)) if most < top), "int64")
    block, query_block = (max(1, min(size, CELLS // dims)) for size in (block, query_block))
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_q // query_block))
    # a tile: up to 16 candidate blocks and 4 query blocks, fewer where that would leave cores idle
    side, q_side = min(16, max(1, blocks // 32)), min(4, max(1, q_blocks // 32))
    tiles, q_tiles = -(-blocks // side), -(-q_blocks // q_side)
    packed = stored(_pack(rows, F.floor(F.col("at") / block), dims, kind), "topk-blocks")
    # hash of the id: a query block is no run of equal lengths, so all ask for alike work
    asked = stored(_pack(rows.where(queries), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)), dims, kind)
                   .select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q")), "topk-queries")
    first = asked.withColumn("block", F.pmod("q_block", F.lit(max(1, blocks // 8))).cast("int")).join(packed, "block")
    least = stored(first.repartition(min(q_blocks, 1 << 16), "q_block").select("q_ids", "q", "ids", "data")
                   .mapInArrow(_thresholds(dims, kind, k), "q_ids binary, least binary"), "topk-thresholds")

    def spread(frame: DataFrame, own: Column, other: int, name: str) -> DataFrame:
        at = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        cols = (own.alias("tile"), at.alias("q_tile")) if name == "tile" else (at.alias("tile"), own.alias("q_tile"))
        return frame.select("*", *cols).repartition(min(tiles * q_tiles, 1 << 16), "tile", "q_tile")
    left = spread(asked.join(least, "q_ids"), F.floor(F.col("q_block") / q_side).cast("int"), tiles, "q_tile")
    right = spread(packed, F.floor(F.col("block") / side).cast("int"), q_tiles, "tile")
    found = left.groupBy("tile", "q_tile").cogroup(right.groupBy("tile", "q_tile")).applyInPandas(_tile(dims, kind, k), _DDL)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
