"""Fill-in-middle transformation with content-defined chunk memoisation.

Units are tokens: a run of non-space characters with the white space before it, or
the white space at the text's end (six ASCII white-space characters). Cuts fall
after a number of units, drawn from a hash of the document's id, so a text's units
must be counted and the places after given counts found.

A rolling hash of a window of bytes, at places where its upper bits are zero, cuts
the text into chunks. Where texts share a passage they share chunks, whatever
stands before them. A chunk's summary is its number of words and whether it begins
and ends inside one. A worker remembers summaries by the chunk's whole content, so
a hash that collides is never taken for another's. Summaries combine: counts add up, less
one where a word goes on across the border. The prefix sums of combined counts name the
chunk that holds a cut, and only that chunk is scanned for it.

Output: plain, the text; psm, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; spm, ``<S>``
suffix ``<P>`` prefix ``<M>`` middle. Texts that hold a mark stay plain, so the parts
are found again in the output; ``restore`` gives back the exact text.

Memory: a text and its hashes at a time; a bounded number of summaries.

Defined cases: null text counts as empty (0 units, plain); a null id hashes as the
empty string; repeated rows are transformed alike; texts of white space only are one
unit; an empty table gives an empty result; other columns may be kept under any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of texts that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 50, 80
#: Bytes of the rolling window; a chunk ends at one place in 2**BITS; longest chunk.
WINDOW, BITS, LONGEST = 32, 9, 8192
#: Half the chunks that a worker remembers.
HELD = 1 << 15

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and powers of an odd number and of its inverse (mod 2**64)."""
    table = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
    g = 0x9E3779B97F4A7C15 | 1
    n = 1 << 16
    up = np.cumprod(np.full(n, g, np.uint64)) * np.uint64(pow(g, -1, 1 << 64))
    down = np.cumprod(np.full(n, pow(g, -1, 1 << 64), np.uint64)) * np.uint64(g)
    return table, up, down


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end; the last is its length."""
    table, up, down = _powers()
    ends = []
    step = len(up) - WINDOW
    for at in range(0, len(data), step):  # windows of consecutive parts overlap, so parts don't show in the result
        part = np.frombuffer(data, np.uint8, min(step + WINDOW, len(data) - at), at)
        sums = np.cumsum(table[part] * down[:len(part)])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * up[:max(0, len(part) - WINDOW)]
        ends.append(np.flatnonzero(rolled >> np.uint64(64 - BITS) == 0) + at + WINDOW + 1)
    cuts = np.concatenate([*ends, [len(data)]]) if ends else np.array([len(data)])
    out, last = [], 0
    for c in cuts.tolist():
        while c - last > LONGEST:
            last += LONGEST
            out.append(last)
        if c > last:
            out.append(c)
            last = c
    return out


class Summaries:
    """Summaries of chunks, remembered by content."""

    def __init__(self, held: int = HELD):
        self.limit, self.new, self.old, self.made = held, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, bool, bool]:
        """(words, begins inside a word, ends inside one)."""
        got = self.new.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                self.made += 1
                got = len(chunk.split()), chunk[0] not in _SPACES, chunk[-1] not in _SPACES
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
            self.new[chunk] = got
        return got


class Counted:
    """A text's chunks with combined counts."""

    def __init__(self, data: bytes, memory: Summaries):
        self.data, self.starts, self.before, self.joins = data, [0], [], []
        words, inside, at = 0, False, 0
        for end in chunk_ends(data):
            n, first, last = memory.of(data[at:end])
            self.before.append(words)  # words that begin before the chunk
            self.joins.append(inside and first)  # its first word began earlier
            words += n - (inside and first)
            inside, at = last, end
            self.starts.append(end)
        self.words = words
        self.units = words + (bool(data) and not inside)

    def end_of(self, units: int) -> int:
        """Bytes of the first ``units`` units."""
        if units <= 0:
            return 0
        if units >= self.units:
            return len(self.data)
        k = int(np.searchsorted(self.before, units, "left")) - 1  # the chunk in which word ``units`` begins
        nth = units - self.before[k] - 1 + self.joins[k]
        at = self.starts[k]
        for i, m in enumerate(_WORD.finditer(self.data, at)):
            if i == nth:
                return m.end()
        raise AssertionError("summaries and text differ")


def transform(doc_id: int | None, text: str | None, memory: Summaries) -> dict:
    """n, form, output, prefix_chars and middle_chars of one document."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counted = Counted(data, memory)
    n = counted.units
    hexed = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    if not data or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= PLAIN:
        return {"n": n, "form": "plain", "output": text or "", "prefix_chars": None, "middle_chars": None}
    a, b = (counted.end_of(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (data[:a], data[a:b], data[b:]))
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    if form == "spm":
        output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        output = PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return {"n": n, "form": form, "output": output, "prefix_chars": len(prefix), "middle_chars": len(middle)}


def restore(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second)
    end = output.index(MIDDLE)
    x, y, middle = output[len(first):at], output[at + len(second):end], output[end + len(MIDDLE):]
    prefix, suffix = (y, x) if form == "spm" else (x, y)
    return prefix + middle + suffix


@lru_cache(1)
def _memory() -> Summaries:
    return Summaries()


_COLUMNS = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("output", T.StringType(), pa.string()),
            ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64())]
_DIGESTS = [("output_sha256", T.StringType(), pa.string()), ("restored_sha256", T.StringType(), pa.string())]


def _run(docs: DataFrame, keep: list[str], id_col: str, text_col: str, digests: bool) -> DataFrame:
    own = [c for c in _COLUMNS if c[0] != "output"] + _DIGESTS if digests else _COLUMNS
    # columns that stay travel in one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(a, t) for a, t, _ in own]])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                made = [transform(i.as_py(), t.as_py(), _memory()) for i, t in zip(part.column(1), part.column(2))]
                if digests:
                    for x in made:
                        x["output_sha256"] = hashlib.sha256(x["output"].encode("utf-8", "surrogatepass")).hexdigest()
                        x["restored_sha256"] = hashlib.sha256(restore(x["output"], x["form"]).encode("utf-8", "surrogatepass")).hexdigest()
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[a] for x in made], t) for a, _, t in own]],
                                                 names=["row", *[a for a, _, _ in own]])

    return rows.mapInArrow(run, schema).select("row.*", *[a for a, _, _ in own])


def fill_in_middle(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``n, form, output, prefix_chars, middle_chars`` (code points; null if plain)."""
    return _run(docs, keep, id_col, text_col, False)


def fill_in_middle_digests(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`fill_in_middle`, with SHA-256 of the output and of the text restored from it in the output's place."""
    return _run(docs, keep, id_col, text_col, True)
