"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles (ASCII letters lower-cased, words
separated by ASCII white space; fewer words than a shingle make one shingle of
all words). Two documents link when ``100 * |A n B| >= percent * |A u B|``.

Sketch. Every shingle hash flips one bit of a sketch, so a bit holds the parity
of the shingles that fall on it, and two sketches differ in at most as many bits
as the sets differ in shingles: the Hamming distance is a lower bound of the
symmetric difference. Linked sets of n and m shingles differ in at most
``d = (n + m)(100 - percent) / (100 + percent)``.

Size bands. Band k + 1 begins where a set is too large to link with the first of
band k's, so linked sets lie in the same or in neighbouring bands. Group k holds
bands k and k + 1 and has one sketch layout: P parts of 2**32 bits (kept sparse,
a part's word is the exclusive-or of one 64-bit number for each set bit).

Pigeonhole. d errors spoil at most d parts, so linked sets agree in P - d words
of their P. With all words in one global order it is enough that each set files
its first d + 1 (the prefix principle). The order puts words that a sample of the
documents shows to be frequent last and words of many bits first, so that a
shared passage or an empty part brings hardly any candidate; any fixed order
gives the same links.

Verification. Candidates pass the Hamming bound on dense folded sketches, then
the exact count on their texts. Sets that file the same word are first tried
against the least of them only (a star), and components are built from what is
verified. Sets of a word that still lie in different components are compared by
their sketches in tasks, which give a forest of the near ones; what it connects is a
bunch, whose sets meet once more for the exact count and give a forest of links.
Near copies of one another so never become all pairs, and no pair is given up: one
that is not compared lies in one component already.

Equal sets are one class before any of this. Sets, and shingles, are compared by
64-bit hashes. Words that the sample shows to be frequent are spread over salted
groups, whose least members form a star of their own.

Defined cases: null and empty text and text of white space have the empty set
(0 shingles), link with nothing and are their own component; repeated rows and
null ids are ordinary (a null id names a component only if all its ids are null);
an empty table gives an empty result; other columns of the table are not read;
ids are cast to long.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, release, shared_dir
from .graph import components
from ..operators.lookups import bounded_broadcast

WORDS = 5
PERCENT = 80
#: Shingles that a part of a sketch holds on average.
LOAD = 3
#: One document in so many is read for frequent words, which are in at least so many of these.
SAMPLE, FREQUENT = 16, 8
#: No more frequent words than this are sent to the tasks (8 bytes each).
MAX_FREQUENT = 1 << 18
SALTS = 16
#: Sets of a word that a task compares with as many, and the bytes of a sketch that it holds of each.
BLOCK, CARRIED = 1024, 256
#: Shingles of all the sets of such a block.
LONG = 1 << 22
#: Documents whose rows a task writes at least.
DOCS = 2000
#: Words whose hashes a worker remembers.
HELD = 1 << 20

_U = np.uint64


# ---------------------------------------------------------------- sets

class _WordHashes(dict):
    """Hash of a word; a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= HELD:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 7)
        return got


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(words, len(w))
    odd = _mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += w[i:i + n] * odd[i]
    h = _mix(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def class_of(h: np.ndarray) -> int:
    """One signed 64-bit number for a whole set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 11)).view(np.int64))


# ---------------------------------------------------------------- sketches

def most_apart(n: int, m: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of n and m shingles."""
    return (n + m) * (100 - percent) // (100 + percent)


class Bands:
    """Size bands and the sketch layout of their groups."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def largest(self, n: int) -> int:
        return n * 100 // self.percent

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.largest(self.starts[-1]) + 1)
        return bisect_right(self.starts, n) - 1

    def groups(self, n: int) -> list[tuple[int, int, int]]:
        """(group, parts, words to file) of a set of n shingles: as one of the lower band, then of the upper."""
        k = self.band(n)
        out = []
        for g, partner in ((k, self.largest(n)), (k - 1, self.starts[k] - 1)):
            if g < 0 or self.largest(partner) < n:
                continue
            top = self.starts[g + 1] - 1
            parts = max(most_apart(top, self.largest(top), self.percent) + 1, -(-top // LOAD))
            out.append((g, parts, min(parts, most_apart(n, partner, self.percent) + 1)))
        return out


def part_words(sets: list[np.ndarray], groups: list[int], parts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, number of set bits) of every part of the sketches of several sets, set i in its group."""
    n = np.array(parts, np.uint64)
    base = np.concatenate(([0], np.cumsum(n)))[:-1].astype(np.uint64)
    sizes = [len(h) for h in sets]
    h = np.concatenate(sets)
    place = (((h >> _U(32)) * np.repeat(n, sizes)) >> _U(32)) + np.repeat(base, sizes)
    bit = np.sort((place << _U(32)) | (h & _U(0xFFFFFFFF)))
    if (bit[1:] == bit[:-1]).any():  # an even number of shingles on a bit leaves it unset
        bit, times = np.unique(bit, return_counts=True)
        bit = bit[times % 2 == 1]
    row = np.repeat(np.arange(len(sets)), parts)
    inside = np.arange(len(row), dtype=np.uint64) - base[row]
    place = (bit >> _U(32)).astype(np.int64)
    word = np.zeros(len(row), np.uint64)
    if len(bit):
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        word[place[starts]] = np.bitwise_xor.reduceat(_mix(((inside[place] << _U(32)) | (bit & _U(0xFFFFFFFF))) + _U(1)), starts)
    where = (np.array(groups, np.uint64)[row] << _U(32)) | inside
    return row, _mix(word ^ _mix(~where)), np.bincount(place, minlength=len(row))


def first_words(row: np.ndarray, word: np.ndarray, load: np.ndarray, hot: np.ndarray, want: list[int]) -> np.ndarray:
    """Indices of each row's first ``want`` words (at least): frequent words last, words of many bits first, then by hash."""
    order = (hot.astype(np.uint64) << _U(63)) | ((255 - np.minimum(load, 255)).astype(np.uint64) << _U(55)) | (word >> _U(9))
    at = np.lexsort((order, row))
    starts = np.searchsorted(row, np.arange(len(want)))
    last = order[at[starts + np.array(want) - 1]]
    return at[order[at] <= last[row[at]]]


def dense_sketch(h: np.ndarray) -> bytes:
    """A parity sketch of at least four bits a shingle (a power of two, 64 or more), packed."""
    bits = max(64, 1 << (4 * len(h) - 1).bit_length())
    parity = np.bincount((h & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A dense sketch as 64-bit words, halves laid over one another down to ``size`` bytes."""
    x = np.frombuffer(sketch, np.uint64)
    while 8 * len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two dense sketches, the larger folded onto the smaller's bits."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


# ---------------------------------------------------------------- keys

def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _filed(sets: list[np.ndarray], classes: list[int | None], bands: Bands, frequent: np.ndarray | None) -> tuple[list, list]:
    """Per set the words that it files, and those of them that are frequent; all words if ``frequent`` is not known yet."""
    found, common = [np.empty(0, np.int64)] * len(sets), [np.empty(0, np.int64)] * len(sets)
    at = 0
    while at < len(sets):
        todo, size = [], 0
        end = at
        while end < len(sets) and (size < 1 << 16 or not todo):
            if classes[end] is not None:
                todo += [(end, sets[end], g, p, w) for g, p, w in bands.groups(len(sets[end]))]
                size += 2 * len(sets[end])
            end += 1
        if todo:
            doc, part, groups, parts, want = map(list, zip(*todo))
            row, word, load = part_words(part, groups, parts)
            hot = np.isin(word, frequent) if frequent is not None and len(frequent) else np.zeros(len(word), bool)
            if frequent is not None:
                first = first_words(row, word, load, hot, want)
                row, word, hot = row[first], word[first], hot[first]
            of, word = np.array(doc)[row], word.view(np.int64)
            for out, which in ((found, ~hot), (common, hot)):
                d, w = of[which], word[which]
                ends = np.searchsorted(d, np.arange(at, end + 1))
                for i in range(at, end):
                    out[i] = w[ends[i - at]:ends[i - at + 1]]
        at = end
    return found, common


def _digests(texts: DataFrame, words: int, percent: int, frequent: np.ndarray | None) -> DataFrame:
    """``doc_id, th, n, cls, sketch, filed, common`` of every row; class and sketch are null for the empty set.

    The words that a set files stand with the first copy of the set in a task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sketch", pa.binary()),
                        ("filed", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])

    def lists(values: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))

    def run(batches: Iterator[pa.RecordBatch]):
        bands, seen = Bands(percent), set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                sets = [shingle_set(t.as_py(), words) for t in b.column(2)]
                classes = [class_of(h) if len(h) else None for h in sets]
                new = []
                for c in classes:
                    new.append(None if c in seen else c)
                    if len(seen) >= HELD:
                        seen.clear()
                    seen.add(c)
                found, common = _filed(sets, new, bands, frequent)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array(classes, pa.int64()),
                     pa.array([dense_sketch(h) if len(h) else None for h in sets], pa.binary()), lists(found), lists(common)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, th long, n long, cls long, sketch binary, filed array<long>, common array<long>")


def frequent_words(texts: DataFrame, words: int, percent: int, keep) -> np.ndarray:
    """Sorted words that are frequent in a sample of the documents (chosen by their text's hash).

    They only go last in the order and are salted: the links do not depend on them. A word counts from
    ``FREQUENT`` sampled sets on, and from so many that ``MAX_FREQUENT`` words can't exceed it.
    """
    part = texts.where(F.pmod("th", F.lit(SAMPLE)) == 0)
    counts = _digests(part, words, percent, None).select(F.explode("filed").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    counts = keep(counts.where(F.col("rows") >= FREQUENT), "frequent")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    least = max(FREQUENT, -(-total // MAX_FREQUENT))
    return np.sort(np.array([r.word for r in counts.where(F.col("rows") >= least).select("word").toLocalIterator()], np.int64).view(np.uint64))


# ---------------------------------------------------------------- candidates

def _stars(filed: DataFrame) -> DataFrame:
    """``word, salt, a, b``: of the sets that filed a word (and salt), every other with the least; of salted
    groups the least with itself too."""
    schema = pa.schema([("word", pa.int64()), ("salt", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        word, salt, least, last = 0, -1, 0, 0  # of the group that the rows so far end in
        for b in batches:
            w, s, c = (b.column(i).to_numpy() for i in range(3))
            if not len(w):
                continue
            new = np.concatenate(([w[0] != word or s[0] != salt], (w[1:] != w[:-1]) | (s[1:] != s[:-1])))
            again = ~new & np.concatenate(([c[0] == last], c[1:] == c[:-1]))
            starts = np.flatnonzero(new)
            lead = np.concatenate(([least], c[starts]))[np.cumsum(new)]
            keep = (~new & ~again) | (new & (s > 0))
            if keep.any():
                yield pa.record_batch([pa.array(x[keep]) for x in (w, s, lead, c)], schema=schema)
            word, salt, least, last = w[-1], s[-1], lead[-1], c[-1]

    rows = filed.repartition("word", "salt").sortWithinPartitions("word", "salt", "cls")
    return rows.mapInArrow(run, "word long, salt int, a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first three columns, which follow one another."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        k = [t.column(i).to_numpy() for i in range(3)]
        new = np.flatnonzero(np.concatenate(([True], (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1]))))
        for x, y in zip(new, new[1:]):
            yield t.slice(x, y - x)
        held = t.slice(new[-1])
    if held is not None:
        yield held


def _block_pairs(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """``key, lo, hi, own, cls, root, n`` and ``carried`` of the sets, for every two blocks of a key's sets that are to be
    compared: keys of many or long sets are cut into blocks."""
    blocks = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / LONG)
    rows = rows.join(rows.groupBy(key).agg(F.ceil(blocks).cast("int").alias("c")), key).withColumn("own", F.pmod(F.xxhash64("cls"), "c").cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(F.least(i, "own").alias("lo"), F.greatest(i, "own").alias("hi")))
    rows = rows.withColumn("x", F.explode(both)).select(key, "x.lo", "x.hi", "own", "cls", "root", "n", *carried)
    return rows


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of ``_block_pairs``, the two blocks of a key that a task compares one after the other."""
    by = rows.columns[:3]
    return rows.repartition(*by).sortWithinPartitions(*by)


def _near_pairs(t: pa.Table, sketches: list[bytes], percent: int) -> Iterator[tuple[list[int], list[int]]]:
    """Row numbers of the pairs of a table of ``_block_pairs`` that lie in different components, within the Hamming
    bound of their sketches."""
    _, lo, hi, own, cls, root, n = (t.column(i).to_numpy() for i in range(7))
    size = min(CARRIED, *map(len, sketches))
    w = np.stack([folded(x, size) for x in sketches])
    left, right = np.flatnonzero(own == lo[0]), np.flatnonzero(own == hi[0])
    step = max(1, (1 << 21) // max(1, len(right) * w.shape[1]))
    for at in range(0, len(left) if len(right) else 0, step):
        i = left[at:at + step, None]
        d = np.bitwise_count(w[i] ^ w[right][None]).sum(axis=2, dtype=np.int64)
        ok = (root[i] != root[right]) & (d <= most_apart(n[i], n[right], percent))
        if lo[0] == hi[0]:
            ok &= cls[i] < cls[right]
        x, y = np.nonzero(ok)
        if len(x):
            yield left[at + x].tolist(), right[y].tolist()


class _Forest(dict):
    """Components by the parent of each joined node."""

    def find(self, x: int) -> int:
        top = x
        while top in self:
            top = self[top]
        while x != top:
            self[x], x = top, self[x]
        return top


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _near_forest(member: DataFrame, percent: int) -> DataFrame:
    """``a, b``: of the sets that share a word and lie in different components (columns ``word, cls, root, n, sketch``),
    pairs within the Hamming bound of their sketches.

    A task leaves out what its pairs connect already, so it gives fewer rows than it has sets, and the same
    components as all near pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        joined = _Forest()
        for t in _runs(batches):
            cls, out = t.column(4).to_pylist(), []
            for left, right in _near_pairs(t, t.column(7).to_pylist(), percent):
                for i, j in zip(left, right):
                    x, y = joined.find(cls[i]), joined.find(cls[j])
                    if x != y:
                        joined[x] = y
                        out.append((cls[i], cls[j]))
            if out:
                yield _edges(out)
            if len(joined) > HELD:
                joined.clear()

    return _dealt(_block_pairs(member, "word", ["sketch"])).mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``th, shingles``: the sorted hashes of the sets of the wanted text hashes, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), words).tobytes() for x in b.column(1)], pa.binary())],
                                             names=["th", "shingles"])

    rows = texts.select("th", "text").join(bounded_broadcast(wanted.select("th").distinct()), "th").dropDuplicates(["th"])
    return rows.mapInArrow(run, "th long, shingles binary")


def _joining_links(bunches: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: roots of components that links between sets of a bunch (columns ``bunch, cls, root, n, th``) join.

    Near pairs get the exact count. A task leaves out what its links have joined already, so it gives fewer rows
    than it has sets, and the same components as all links of the bunch.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        joined = _Forest()
        for t in _runs(batches):
            root, out = t.column(5).to_pylist(), []
            sets = [np.frombuffer(x, np.uint64) for x in t.column(7).to_pylist()]
            for left, right in _near_pairs(t, [folded(dense_sketch(h), CARRIED).tobytes() for h in sets], percent):
                for i, j in zip(left, right):
                    x, y = joined.find(root[i]), joined.find(root[j])
                    if x == y:
                        continue
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        joined[x] = y
                        out.append((root[i], root[j]))
            if out:
                yield _edges(out)
            if len(joined) > HELD:
                joined.clear()

    rows = _block_pairs(bunches, "bunch", ["th"]).join(_sets(texts, bunches, words), "th")
    return _dealt(rows.select("bunch", "lo", "hi", "own", "cls", "root", "n", "shingles")).mapInArrow(run, "a long, b long")


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _of_texts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One of ``rows`` for every text hash in the pairs' ``ta, tb``."""
    wanted = pairs.select(F.col("ta").alias("th")).union(pairs.select(F.col("tb").alias("th"))).distinct()
    return rows.join(bounded_broadcast(wanted), "th").dropDuplicates(["th"])


def _folded(digests: DataFrame, members: DataFrame) -> DataFrame:
    """``th, sketch`` of the members, at most ``CARRIED`` bytes of each."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(x.as_py(), CARRIED).tobytes() for x in b.column(1)], pa.binary())],
                                             names=["th", "sketch"])

    wanted = members.select("th").distinct()
    rows = digests.where("sketch is not null").select("th", "sketch").join(bounded_broadcast(wanted), "th")
    return rows.mapInArrow(run, "th long, sketch binary").dropDuplicates(["th"])


def _verified(pairs: DataFrame, classes: DataFrame, digests: DataFrame, texts: DataFrame, words: int, percent: int, tasks: int, keep) -> DataFrame:
    """The linked ones of candidate pairs of classes ``a, b``: sizes, then sketches, then texts."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("th").alias(f"t{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    rows = keep(rows.select("a", "b", "ta", "tb", "na", "nb").coalesce(tasks), "sized")
    sketches = _of_texts(digests.select("th", "sketch"), rows)
    rows = (rows.join(sketches.select(F.col("th").alias("ta"), F.col("sketch").alias("sa")), "ta")
            .join(sketches.select(F.col("th").alias("tb"), F.col("sketch").alias("sb")), "tb").select("a", "b", "ta", "tb", "na", "nb", "sa", "sb"))

    def near(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ok = [hamming(x.as_py(), y.as_py()) <= most_apart(n, m, percent)
                  for n, m, x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6), b.column(7))]
            yield b.select([0, 1, 2, 3]).filter(pa.array(ok, pa.bool_()))

    left = keep(rows.mapInArrow(near, "a long, b long, ta long, tb long"), "near")
    # the partners of one set come in salted groups, each with that set's text first
    counts = left.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("c"), F.min("ta").alias("th"))
    heads = counts.select("th", "a", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    partners = left.join(counts.select("a", "c"), "a").select(F.col("tb").alias("th"), "a", F.pmod(F.xxhash64("b"), "c").cast("int").alias("salt"), "b")
    both = heads.unionByName(partners).join(_of_texts(texts.select("th", "text"), left), "th").select("a", "salt", "b", "text")

    def exact(batches: Iterator[pa.RecordBatch]):
        x = None
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                y = shingle_set(text.as_py(), words)
                if b is None:
                    x = y
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    out.append((a, b))
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    both = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return keep(both.mapInArrow(exact, "a long, b long"), "links")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the size of its set, and the smallest
    doc_id that links reach from it (itself included)."""
    if not 0 < percent <= 100:
        raise ValueError("percent lies above 0, at most 100")
    spark = docs.sparkSession
    spent: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(spark, f"jaccard-{name}")
        df.write.parquet(path)
        spent.append(path)
        return spark.read.schema(df.schema).parquet(path)

    texts = _texts(docs, id_col, text_col)
    digests = _digests(texts, words, percent, frequent_words(texts, words, percent, keep))
    path = shared_dir(spark, "jaccard-digests")  # the result reads these, so they stay
    digests.write.parquet(path)
    digests = spark.read.schema(digests.schema).parquet(path)
    # what tasks only shuffle and join is written by few of them if there are few documents
    tasks = max(spark.sparkContext.defaultParallelism, -(-digests.count() // DOCS))
    classes = keep(digests.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("first"), F.min("th").alias("th"), F.min("n").alias("n")).coalesce(tasks), "classes")

    filed = digests.select(F.explode("filed").alias("word"), F.lit(0).alias("salt"), "cls").unionByName(
        digests.select(F.explode("common").alias("word"), (F.pmod("cls", F.lit(SALTS)) + 1).cast("int").alias("salt"), "cls"))
    stars = keep(_stars(filed), "stars")
    heads = stars.where("salt > 0").select("word", "a").distinct()  # least members of the salted groups of a word
    heads = heads.join(heads.groupBy("word").agg(F.min("a").alias("least")), "word").select("word", F.col("least").alias("a"), F.col("a").alias("b"))
    stars = stars.select("word", "a", "b").unionByName(heads)
    tried = keep(_pairs(stars).coalesce(tasks), "tried")
    links = _verified(tried, classes, digests, texts, words, percent, tasks, keep)

    # sets that share a word but lie in different components
    part, joined = components(links), None
    release(spark)
    many = stars.groupBy("word").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    member = stars.join(many, "word").select("word", F.explode(F.array("a", "b")).alias("cls")).distinct()
    member = member.join(part.withColumnRenamed("node", "cls"), "cls", "left").select("word", "cls", F.coalesce("root", "cls").alias("root"))
    member = keep(member.join(classes.select("cls", "n", "th"), "cls").coalesce(tasks), "members")
    split = member.groupBy("word").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("word")
    member = keep(member.join(split, "word").coalesce(tasks), "split")
    sketched = member.join(_folded(digests, member), "th").select("word", "cls", "root", "n", "sketch")
    near = keep(_near_forest(sketched, percent), "near-forest")
    if not near.isEmpty():
        bunches = components(near).select(F.col("node").alias("cls"), F.col("root").alias("bunch"))
        release(spark)
        bunches = bunches.join(member.select("cls", "root", "n", "th").distinct(), "cls").select("bunch", "cls", "root", "n", "th")
        found = keep(_joining_links(keep(bunches.coalesce(tasks), "bunches"), texts, words, percent), "joining")
        if not found.isEmpty():
            joined = components(found)  # of the components so far, by their roots

    named = classes.select("cls", "first").join(part.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    if joined is not None:
        named = named.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        named = named.select("cls", "first", F.coalesce("top", "root").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    path = shared_dir(spark, "jaccard-named")
    named.join(least, "root").select("cls", "component_id").coalesce(tasks).write.parquet(path)
    for p in spent:
        delete_path(spark, p)
    named = spark.read.schema("cls long, component_id long").parquet(path)
    return digests.select("doc_id", "n", "cls").join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
