"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: every word shingle is hashed with XXH64 (seed 42); a bit is 1 if it
is set in over half the hashes. Two fingerprints link at ``MAX_BITS`` (3) or
fewer differing bits.

Candidates. The 64 bits are four blocks of 16. Three errors leave at least one
block exact (pigeonhole), and of the two 24-bit halves of the other 48 bits one
holds at most one error. 23 bits of that half are decoded by the perfect binary
Golay code: a fingerprint is filed under the index of the one codeword nearest to
the half, and asked for under all codewords within distance 4 of it (one, or six
if it lies 3 away from its own). A vector within one bit of another is at most
1 + 3 = 4 from the other's codeword, so no link is missed. That gives 8 filed and
about 42 asked keys of 28 bits per distinct fingerprint, whatever the input;
each key's candidates are verified by their exact bit distance.

Links. Equal fingerprints are one class before any of this. Keys with many
members are cut into salted chunks, and a task returns only a spanning forest of
the links it verified, so near-copies of one another never become all pairs.
Components come from randomised contraction in Spark joins, with a checkpoint
each round, until no edge is left.

Defined cases: null or empty text and text of white space only have fingerprint
zero; fewer words than a shingle make one shingle of all words; repeated rows and
null ids are ordinary (a null id names a component only if all its ids are null);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_keys, stored
from .graph import components

MAX_BITS = 3
SHINGLE = 3
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the (23, 12) code
#: Members of a key that one chunk of a task compares with another chunk.
CHUNK = 2048
PAIRS_AT_ONCE = 1 << 20


# ---------------------------------------------------------------- fingerprints

def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``rows`` (their last column a text) with the text replaced by its fingerprint ``fp`` (signed 64-bit)."""
    *keep, _ = rows.schema.fields
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", fp long"
    names = [f.name for f in keep] + ["fp"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fp = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in b.columns[-1]), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=names)

    return rows.mapInArrow(run, out)


# ---------------------------------------------------------------- Golay keys

@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits; per syndrome the error pattern, and the offsets
    (exclusive-or on the codeword index) of the codewords within distance 4."""
    def rem(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v
    upper = np.array([rem(i << 11) for i in range(4096)], np.int64)
    errors = np.zeros(2048, np.int64)
    for w in range(1, 4):
        for bits in combinations(range(23), w):
            e = sum(1 << b for b in bits)
            errors[upper[e >> 11] ^ (e & 0x7FF)] = e
    words = (np.arange(4096) << 11) | upper
    sevens = words[np.bitwise_count(words) == 7]
    offsets = np.zeros((2048, 6), np.int64)
    for s, e in enumerate(errors):
        if int(e).bit_count() == 3:
            offsets[s, 1:] = sevens[(sevens & e) == e] >> 11
    return upper, errors, offsets


def _segments(fp: np.ndarray):
    """(kind, exact 16 bits, 23 bits of a half) for the eight kinds of key."""
    u = fp.view(np.uint64)
    blocks = [(u >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF for k in range(4)]
    for i in range(4):
        a, b, c = (blocks[k] for k in range(4) if k != i)
        rest = (a << 32) | (b << 16) | c
        for half, seg in enumerate((rest >> 25, (rest >> 1) & 0x7FFFFF)):
            yield 2 * i + half, blocks[i], seg


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, asked) of int64 fingerprints: filed keys (asked 0) and asked keys (asked 1)."""
    upper, errors, offsets = golay()
    rows, keys, asked = [], [], []
    at = np.arange(len(fp))
    for kind, exact, seg in _segments(fp):
        syn = upper[seg >> 11] ^ (seg & 0x7FF)
        index = (seg ^ errors[syn]) >> 11
        base = (kind << 28) | (exact << 12)
        rows.append(at)
        keys.append(base | index)
        asked.append(np.zeros(len(fp), np.int8))
        for k in range(6):
            use = slice(None) if k == 0 else np.flatnonzero(offsets[syn, k])
            rows.append(at[use])
            keys.append((base | (index ^ offsets[syn, k]))[use])
            asked.append(np.ones(len(rows[-1]), np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(asked)


# ---------------------------------------------------------------- links

def _key_rows(fps: DataFrame) -> DataFrame:
    """``key, asked, fp``: the filed and asked keys of distinct fingerprints."""
    schema = pa.schema([("key", pa.int64()), ("asked", pa.int8()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at:at + 4096]
                row, key, asked = golay_keys(part)
                yield pa.record_batch([pa.array(key), pa.array(asked), pa.array(part[row])], schema=schema)

    return fps.select("fp").mapInArrow(run, "key long, asked byte, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (stars) with the same components as the links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[out]], nodes[out]


def _verified(group: np.ndarray, asked: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between filed and asked members of each group; rows are sorted by group, then asked."""
    n_groups = int(group[-1]) + 1
    filed = np.bincount(group[asked == 0], minlength=n_groups)
    starts = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n_groups))[:-1]))
    probes = np.flatnonzero((asked == 1) & (filed[group] > 0))
    counts = filed[group[probes]]
    a, b = [], []
    ends = np.cumsum(counts)
    at = 0
    while at < len(probes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        c = counts[at:to]
        p = np.repeat(probes[at:to], c)
        f = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c) + starts[group[p]]
        d = np.bitwise_count(fp[p].view(np.uint64) ^ fp[f].view(np.uint64))
        ok = (d <= bits) & (d > 0)
        if ok.any():
            x, y = _forest(fp[p[ok]], fp[f[ok]])
            a.append(x)
            b.append(y)
        at = to
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: edges with the components of all links among distinct fingerprints ``fp``."""
    if bits > MAX_BITS:
        raise ValueError(f"these keys find links of at most {MAX_BITS} bits")
    rows = _key_rows(fps)
    hot = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("asked").alias("n_asked"))
                      .where(F.col("n") > CHUNK)
                      .select("key", F.ceil((F.col("n") - F.col("n_asked")) / CHUNK).cast("int").alias("c0"),
                              F.ceil(F.col("n_asked") / CHUNK).cast("int").alias("c1")))
    if hot.isEmpty():
        rows = rows.withColumn("chunk", F.lit(0))
    else:  # a row keeps its own chunk and meets every chunk of the other side
        c0, c1 = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("c0", "c1"))
        own0, own1 = F.pmod(F.xxhash64("fp"), c0), F.pmod(F.xxhash64("fp"), c1)
        chunk = F.when(F.col("asked") == 1, F.transform(F.sequence(F.lit(0), c0 - 1), lambda i: (i * c1 + own1).cast("int"))).otherwise(
            F.transform(F.sequence(F.lit(0), c1 - 1), lambda i: (own0 * c1 + i).cast("int")))
        rows = rows.join(hot, "key", "left").select("key", "asked", "fp", F.explode(chunk).alias("chunk"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        kept = None

        def out(t):
            key, chunk, asked, fp = t
            new = np.concatenate(([False], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))
            x, y = _verified(np.cumsum(new), asked, fp, bits)
            return pa.record_batch([pa.array(x), pa.array(y)], schema=schema)

        for batch in batches:
            t = [batch.column(i).to_numpy() for i in range(4)]
            if kept is not None:
                t = [np.concatenate(z) for z in zip(kept, t)]
            key, chunk = t[0], t[1]
            if not len(key):
                continue
            cut = int(np.argmax((key == key[-1]) & (chunk == chunk[-1])))  # where the last, open group begins
            kept = [z[cut:] for z in t]
            if cut:
                yield out([z[:cut] for z in t])
        if kept is not None and len(kept[0]):
            yield out(kept)

    rows = rows.select("key", "chunk", "asked", "fp").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "asked")
    return rows.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- classes

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, r1, r2, fp, root, component_id`` for every row; r1 and r2 are hashes of the whole row.

    ``root`` names the component; ``component_id`` is the smallest doc_id in it.
    """
    r1, r2 = row_keys(docs)
    rows = stored(fingerprints(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"),
                                           F.col(f"`{text_col}`").cast("string").alias("text")), shingle), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes, bits))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.select("fp", "root").join(least, "root")
    return rows.join(ids, "fp").select("doc_id", "r1", "r2", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest id (null last), then the smallest row hash."""
    found = near_duplicates(docs, id_col, text_col, shingle, bits)
    rows = found.groupBy("root", "doc_id", "r1", "r2").agg(F.count(F.lit(1)).alias("same"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "r1", "r2", "same")).alias("m"))
    best = best.select("m.r1", "m.r2", "m.same")
    r1, r2 = row_keys(docs)
    own = docs.select(r1.alias("r1"), r2.alias("r2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = own.join(best, ["r1", "r2"])
    return kept.where("same = 1").unionByName(kept.where("same > 1").dropDuplicates(["r1", "r2"])).select("doc.*")
