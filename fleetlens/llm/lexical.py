"""Ranked lexical search, a hybrid of term-at-a-time and document-at-a-time.

Terms are maximal runs of letters, digits and non-ASCII characters of the whole
text, A-Z lower-cased. Scores are integers (see :func:`search`).

Index. Documents are cut into segments of a bounded number of terms. A segment
holds the posting lists (document, count) of the terms that the queries ask for
and is one row of a table in the shared folder. Corpus figures (documents,
terms, document frequencies) are sums over segments.

Search, per query and segment. Short posting lists are taken term at a time: their
contributions are summed into accumulators, which become one more list, sorted by
document, with the greatest sum of each block of documents as its bound. The long
lists keep their greatest contribution of each block. Then, document at a time,
blocks whose bounds add up to less than the score to beat are skipped, in all lists
at once; in the other blocks a document leaves as soon as its sum and the bounds of
the lists still to come can't reach that score. The score to beat is the k-th best
so far, from the accumulators at first; a task carries it from segment to segment.
Skipping is strict, so ties are kept and results are exact.

Bounds. Queries go in blocks of about ``BLOCK_BYTES`` of text, each with a search
of its own over all segments, so what is sent to the tasks does not grow with the
queries. A task holds one segment and k results for each query of a block.

Defined cases: null and empty text has no term, is no result and not counted; a
query without a known term has no results; a repeated row is a document of its
own; a query row that comes twice is answered twice; equal scores go by ascending
doc_id, null ids last; with no documents or no queries the result is empty;
columns other than ids and texts are not read; ids are cast to long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir

#: A segment is full at so many documents or terms.
SEGMENT_DOCS, SEGMENT_TERMS = 8192, 1 << 20
#: A list of more than one in so many of a segment's documents is long.
LONG = 32
#: Documents of a block, and blocks looked at between two looks at the score to beat.
BLOCK, TURN = 64, 16
#: Bytes of query texts sent to the tasks at a time.
BLOCK_BYTES = 8 << 20

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


# ---------------------------------------------------------------- index

class _Segment:
    """Collects documents until a segment is full."""

    def __init__(self):
        self.ids, self.n, self.postings, self.total = [], [], [], 0

    def add(self, doc_id, terms: list[bytes], vocabulary: dict[bytes, int]) -> None:
        found = np.array([i for i in map(vocabulary.get, terms) if i is not None], np.int64)
        self.postings.append((found << 32) | len(self.ids))
        self.ids.append(doc_id)
        self.n.append(len(terms))
        self.total += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.total >= SEGMENT_TERMS

    def row(self) -> pa.RecordBatch:
        key, tf = np.unique(np.concatenate(self.postings), return_counts=True)
        term, starts = np.unique(key >> 32, return_index=True)
        values = (self.ids, self.n, sum(x > 0 for x in self.n), self.total, term.astype(np.int32), np.diff(np.append(starts, len(key))).astype(np.int32),
                  (key & 0xFFFFFFFF).astype(np.int16), tf.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("with_terms", pa.int64()), ("all_terms", pa.int64()),
                    ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("docs", pa.list_(pa.int16())), ("tfs", pa.list_(pa.int32()))])
_SPARK = ("ids array<long>, n array<long>, with_terms long, all_terms long, terms array<int>, sizes array<int>, docs array<short>, "
          "tfs array<int>")


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments (one row each) with the posting lists of the vocabulary's terms."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        made = _Segment()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                made.add(doc_id, terms_of(text.as_py()), known.value)
                if made.full():
                    yield made.row()
                    made = _Segment()
        if made.ids:
            yield made.row()

    return rows.mapInArrow(run, _SPARK)


# ---------------------------------------------------------------- search

class _Lists:
    """One segment ready for search: contributions (without the term's weight) and the blocks of the long lists."""

    def __init__(self, row: dict[str, np.ndarray], n_docs: int, n_terms: int):
        n = row["n"]
        self.size, self.n_blocks = len(n), -(-len(n) // BLOCK)
        m = 50 + 50 * n * n_docs // n_terms
        docs, tf = row["docs"].astype(np.int64), row["tfs"].astype(np.int64)
        gain = 1_000_000_000 * tf // (1000 * tf + 20 * m[docs])
        ends = np.cumsum(row["sizes"], dtype=np.int64)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t, at, end in zip(row["terms"].tolist(), (ends - row["sizes"]).tolist(), ends.tolist()):
            if (end - at) * LONG <= self.size:
                self.short[t] = docs[at:end], gain[at:end]
            else:  # by document, so that skipping is one step
                all_docs = np.zeros(self.n_blocks * BLOCK, np.int32)
                all_docs[docs[at:end]] = gain[at:end]
                self.long[t] = all_docs, all_docs.reshape(-1, BLOCK).max(axis=1).astype(np.int64)

    def best(self, query: list[tuple[int, int]], k: int, beat: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least ``beat``, among them the k best; query: (term, weight)."""
        short = [(self.short[t], w) for t, w in query if t in self.short]
        total = np.zeros(self.n_blocks * BLOCK, np.int64)
        if short:  # sums of whole numbers below 2**53: exact in doubles
            docs = np.concatenate([d for (d, _), _ in short])
            total += np.bincount(docs, np.concatenate([g * w for (_, g), w in short]).astype(float), len(total)).astype(np.int64)
        lists = sorted(((self.long[t], w) for t, w in query if t in self.long), key=lambda x: -int(x[0][1].max()) * x[1])
        bounds = [b * w for (_, b), w in lists]
        rest = np.zeros((len(lists) + 1, self.n_blocks), np.int64)  # bound of the lists from i on
        for i in range(len(lists) - 1, -1, -1):
            rest[i] = rest[i + 1] + bounds[i]
        if len(total) > k:
            beat = max(beat, int(np.partition(total, -k)[-k]))
        beat = max(beat, 1)
        most = total.reshape(-1, BLOCK).max(axis=1) + rest[0]
        live, docs_out, scores_out, held = np.flatnonzero(most >= beat), [], [], np.empty(0, np.int64)
        for at in range(0, len(live), TURN):
            blocks = live[at:at + TURN]
            blocks = blocks[most[blocks] >= beat]
            docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            docs = docs[total[docs] + rest[0][docs // BLOCK] >= beat]
            score = total[docs]
            for i, ((gains, _), w) in enumerate(lists):
                score = score + gains[docs].astype(np.int64) * w
                stay = score + rest[i + 1][docs // BLOCK] >= beat
                if not stay.all():
                    docs, score = docs[stay], score[stay]
            if len(docs):
                docs_out.append(docs)
                scores_out.append(score)
                held = np.concatenate([held, score])
                if len(held) > k:
                    held = np.partition(held, -k)[-k:]
                if len(held) == k:
                    beat = max(beat, int(held.min()))
        if not docs_out:
            return np.empty(0, np.int64), held
        docs, score = np.concatenate(docs_out), np.concatenate(scores_out)
        return docs[score >= beat], score[score >= beat]


def _queries(items: list, vocabulary: dict[bytes, int]) -> list[list[int]]:
    return [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(x["text"])}) for x in items]


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k documents of highest score above 0.

    N counts the documents with a term, L their terms, n a document's, df the documents
    that hold a term, tf how often. A term weighs w = floor(1000 ln((2N + 2)/(2df + 1))); a
    document's m is 50 + 50 n N div L; its score sums w ((10^9 tf) div (1000 tf + 20 m)) over the item's terms.
    """
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    bytes_ = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    parts = max(1, math.ceil(bytes_ / BLOCK_BYTES))
    kind = asked.schema["item_id"].dataType
    out = None
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        found = _search_block(docs, block, kind, k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, block: list, kind: T.DataType, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    queries = _queries(block, vocabulary)
    path = shared_dir(spark, "lexical-index")
    build_index(docs, vocabulary, id_col, text_col).write.parquet(path)
    index = spark.read.schema(_SPARK).parquet(path)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("all_terms"), F.lit(0))).first()
    df = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    weights = {r[0]: r[1] for r in df.select("terms", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")).collect()}
    sent = spark.sparkContext.broadcast([[(t, weights[t]) for t in q if weights.get(t, 0) > 0] for q in queries])

    def run(batches: Iterator[pa.RecordBatch]):
        best: dict[int, tuple] = {}
        for b in batches:
            for i in range(b.num_rows if n_terms else 0):
                ids = b.column("ids")[i].values
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                lists = _Lists({c: b.column(c)[i].values.to_numpy() for c in ("n", "docs", "tfs", "sizes", "terms")}, n_docs, n_terms)
                for q, query in enumerate(sent.value):
                    old = best.get(q)
                    beat = int(old[0][-1]) if old is not None and len(old[0]) == k else 0
                    d, s = lists.best(query, k, beat)
                    if not len(d):
                        continue
                    new = s, null[d], ids[d]
                    if old is not None:
                        new = tuple(np.concatenate(x) for x in zip(old, new))
                    order = np.lexsort((new[2], new[1], -new[0]))[:k]
                    best[q] = tuple(x[order] for x in new)
        for q, (s, null, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q, np.int32)), pa.array(ids, mask=null), pa.array(s)], names=["q", "doc_id", "score"])

    found = index.mapInArrow(run, "q int, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, x["item_id"]) for q, x in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", kind)]))
    return top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
