"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms of a text are its words (Unicode word characters, lower case) and their
beginnings of 3 to 7 characters, so that forms of one stem meet. Of the terms in
the labelled examples, those whose presence depends on the label are the space in
which texts are compared. Their effect is chi-squared over the number of examples
(the squared correlation with the label), so that it does not grow with that
number; ``EFFECT`` is its least value. A term weighs (1 + ln tf) times the inverse
document frequency over ALL documents times its effect, scaled to length 1, which
keeps chance words of few examples below words that many hold. A word that toxic
texts alone hold passes when a fiftieth of them hold it, so some fifty texts' terms
bound the vocabulary.

The examples form an inverted index with block maxima: postings by term, cut at
blocks of ``BLOCK`` examples, and the largest weight of each term in each block.
A text adds up the block maxima of its terms, reads blocks from the highest
bound down and stops when no bound reaches its ``k``-th best cosine, so the ``k``
nearest (ties to the smaller example id) are exact. Votes weigh 1 / (distance +
``SOFT``) and are drawn towards the rate of all examples by one vote's weight.
Texts without any of the terms get the toxic rate of the examples without any.

At most ``max_train`` labelled rows (those of least hash) are examples; that
bounds the index, which is what tasks share. All rows are tokenized whole, once.

Defined cases: null and empty texts have no term; rows without id or label are
no examples; an example never votes on its own id; without examples every score
is 0.5 and evidence is empty; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

MAX_TRAIN, EFFECT = 4096, 0.02
K, BLOCK, SOFT, EVIDENCE = 16, 64, 0.05, 3
BEGINNINGS = range(3, 8)
WORD = re.compile(r"\w+")
HELD = 200_000  # words whose terms a worker remembers, partial counts it holds


def terms_of(word: str) -> list[str]:
    """A word and, marked, its proper beginnings."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


def _examples(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column | None, id_col: str, text_col: str,
              max_train: int) -> DataFrame:
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.lit(True) if learn is None else learn))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_train)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "id")  # at most max_train ids
    return rows.orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text")).limit(max_train)


def select_terms(examples: DataFrame, least: float = EFFECT) -> dict[str, float]:
    """Terms whose presence depends on the label and their effects, most dependent first."""
    def count(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[int]] = {}

        def flush():
            t = list(held)
            out = pa.record_batch([pa.array(t), pa.array([held[x][0] for x in t]), pa.array([held[x][1] for x in t])], names=["term", "n0", "n1"])
            held.clear()
            return out
        for b in batches:
            for text, label in zip(b.column(0), b.column(1)):
                y = int(label.as_py() != 0)
                found = set()
                for w in set(WORD.findall((text.as_py() or "").lower())):
                    found.update(terms_of(w))
                for t in found:
                    held.setdefault(t, [0, 0])[y] += 1
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    n = {r["y"]: r["n"] for r in examples.groupBy((F.col("label") != 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(False, 0), n.get(True, 0)
    if not n0 or not n1:
        return {}
    c = examples.select("text", "label").mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(
        F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b"))
    have = F.col("a") + F.col("b")
    c = c.where(have < n0 + n1)
    effect = F.pow(F.col("b") * (n0 - F.col("a")) - F.col("a") * (n1 - F.col("b")), F.lit(2.0)) / (
        F.lit(float(n0)) * n1 * have * (n0 + n1 - have))
    best = c.select("term", effect.alias("effect")).where(F.col("effect") >= least).orderBy(F.desc("effect"), "term")
    return {r["term"]: r["effect"] for r in best.collect()}


def term_counts(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``rows`` (their last column a text) with the text replaced by ``terms`` and ``tfs`` within the vocabulary."""
    names = [f.name for f in rows.schema.fields[:-1]]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    shared = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]):
        place = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            all_terms, all_tfs = [], []
            for text in b.columns[-1]:
                tf: dict[int, int] = {}
                for w, n in Counter(WORD.findall((text.as_py() or "").lower())).items():
                    at = known.get(w)
                    if at is None:
                        if len(known) > HELD:
                            known.clear()
                        at = known[w] = tuple(place[t] for t in terms_of(w) if t in place)
                    for i in at:
                        tf[i] = tf.get(i, 0) + n
                ids = sorted(tf)
                all_terms.append(ids)
                all_tfs.append([tf[i] for i in ids])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(all_terms, pa.list_(pa.int32())), pa.array(all_tfs, pa.list_(pa.int32()))],
                names=[*names, "terms", "tfs"])

    return rows.mapInArrow(run, schema)


class BlockMaxIndex:
    """Exact top-k cosine over unit vectors by postings with block maxima."""

    def __init__(self, ids: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        # examples with the same strongest term share blocks, which keeps the bounds tight
        first = np.array([v[0][np.argmax(v[1])] for v in vectors], np.int64)
        order = np.lexsort((ids, first))
        self.block, self.ids = block, ids[order]
        n_blocks = max(1, -(-len(ids) // block))
        term = np.concatenate([vectors[i][0] for i in order] or [np.empty(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.empty(0)])
        example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by = np.lexsort((example, term))
        self.example, self.weight = example[by].astype(np.int32), weight[by]
        cell = term[by] * n_blocks + self.example // block
        self.ends = np.searchsorted(cell, np.arange(n_terms * n_blocks + 1)).astype(np.int64)
        self.n_blocks = n_blocks
        top = np.zeros(n_terms * n_blocks)
        np.maximum.at(top, cell, self.weight)
        self.top = top.reshape(n_terms, n_blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best ``(cosine, position)``, ties to the smaller id; cosine 0 is no neighbour."""
        bound = weights @ self.top[terms]
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-12:
                break
            low = int(b) * self.block
            acc = np.zeros(min(self.block, len(self.ids) - low))
            for t, w in zip(terms, weights):
                c = t * self.n_blocks + b
                s, e = self.ends[c], self.ends[c + 1]
                if s < e:
                    acc[self.example[s:e] - low] += w * self.weight[s:e]
            found = np.flatnonzero(acc > 0)
            best += [(round(float(acc[i]), 12), int(self.ids[low + i]), low + int(i)) for i in found]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
        return [(c, i) for c, _, i in best]


class Model:
    """The index, the vocabulary's weights and the rates, as tasks share them."""

    def __init__(self, vocabulary, weight, ids, labels, vectors):
        self.vocabulary, self.weight = vocabulary, weight
        has = np.array([len(v[0]) > 0 for v in vectors], bool)
        self.prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
        without = labels[~has]
        self.without = float((without.sum() + self.prior) / (len(without) + 1.0))
        keep = np.flatnonzero(has)
        self.index = BlockMaxIndex(ids[keep], [self.unit(*vectors[i]) for i in keep], len(vocabulary)) if len(keep) else None
        of = dict(zip(ids[keep].tolist(), labels[keep].tolist()))
        self.label = np.array([of[i] for i in self.index.ids.tolist()]) if len(keep) else np.empty(0)

    def unit(self, terms, tfs):
        w = (1 + np.log(np.asarray(tfs, float))) * self.weight[terms]
        return np.asarray(terms), w / math.sqrt(float(w @ w))

    def score(self, own_id, terms, tfs, k: int = K) -> tuple[float, list[int]]:
        if not len(terms) or self.index is None:
            return self.without, []
        got = [(c, i) for c, i in self.index.nearest(*self.unit(terms, tfs), k + 1) if self.index.ids[i] != own_id][:k]
        votes = [(1 / (1 - min(c, 1.0) + SOFT), self.label[i]) for c, i in got]
        score = (sum(w * y for w, y in votes) + self.prior) / (sum(w for w, _ in votes) + 1)
        return float(score), [int(self.index.ids[i]) for _, i in got[:EVIDENCE]]


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", learn: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", max_train: int = MAX_TRAIN, k: int = K) -> DataFrame:
    """``doc_id, score, evidence`` (ids of the nearest examples) for every row; ``learn`` is over ``id``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    examples = stored(_examples(docs, labels, label_col, learn, id_col, text_col, max_train), "toxic-examples")
    effects = select_terms(examples)
    vocabulary = list(effects)
    counted = stored(term_counts(rows, vocabulary), "toxic-terms")
    n = counted.count()
    df = np.zeros(max(1, len(vocabulary)))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]
    weight = (np.log((1 + n) / (1 + df)) + 1) * np.array([*effects.values()] or [0.0])
    got = term_counts(examples.select(F.col("id").cast("long").alias("id"), (F.col("label") != 0).cast("int").alias("label"), "text"),
                      vocabulary).orderBy("id", "label", "terms", "tfs").collect()  # at most max_train short rows
    got = [r for at, r in enumerate(got) if not at or r["id"] != got[at - 1]["id"]]
    if not got:
        return counted.select(F.col("id").alias("doc_id"), F.lit(0.5).alias("score"), F.array().cast("array<long>").alias("evidence"))
    model = Model(vocabulary, weight, np.array([r["id"] for r in got], np.int64), np.array([r["label"] for r in got], float),
                  [(np.array(r["terms"], np.int64), np.array(r["tfs"])) for r in got])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        same: dict = {}
        voters = set(m.index.ids.tolist()) if m.index is not None else set()
        for b in batches:
            out = []
            for i, t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                key = (i if i in voters else None, tuple(t), tuple(f))
                if key not in same:
                    if len(same) > HELD // 4:
                        same.clear()
                    same[key] = m.score(i, np.array(t, np.int64), f, k)
                out.append(same[key])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))],
                names=["doc_id", "score", "evidence"])

    return counted.select("id", "terms", "tfs").mapInArrow(run, "doc_id long, score double, evidence array<long>")
