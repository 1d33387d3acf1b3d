"""SentencePiece encoding and decoding with exact N-best segmentation.

The pieces and scores come from a public SentencePiece model file (a parameter).
White space is part of the text: a space is written as U+2581 and the text starts
with one more, as the model's own normalisation does; nothing else is changed.

The pieces that occur in a stretch of text form a lattice. A forward Viterbi pass
gives the best score from the start to every position; a backward A-star search
from the end uses these scores as its heuristic. They are exact, so complete
paths leave its queue in order of their scores, and the first ``n`` are the N-best
segmentations. A code point that no single piece covers gets a place of its own,
at a score below every piece, and is written as byte pieces.

No piece crosses from one stretch to the next where the model allows none: before
U+2581 after another character (if no piece has that), around characters that
only single pieces hold, and between letters and marks that are never side by side
in a piece. A text's lattice is the chain of its stretches' lattices;
each stretch is searched once and remembered by the worker, and the text's N-best
are the least sums of the stretches' losses against their best.

Decoding joins pieces and bytes back; ``decode(encode(text)) == text`` for every
text, U+2581 in the text included (it is written as bytes).

Defined cases: a null or empty text has no piece, one score (0.0), and decodes to
the empty string; among equal scores the search's own order decides, the same
for the same text; a text with fewer than ``n`` segmentations has those;
repeated rows are encoded alike; an empty table gives an empty result. A worker
remembers a bounded number of short stretches; others are searched again.
"""

from __future__ import annotations

import gc
import hashlib
import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
HELD_MARK = ""  # stands for a U+2581 of the text itself while spaces are written as U+2581
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
UNKNOWN_LOSS = 10.0
HELD, LONG = 250_000, 48  # half the stretches that a worker remembers, and their longest
HELD_SEVERAL = 50_000  # stretches whose n best a worker remembers


def _least(x: np.ndarray, n: int) -> list[int]:
    """Places of the n least values, least first; the first place among equal ones."""
    if n < 1:
        return []
    at = np.arange(len(x)) if len(x) <= n else np.flatnonzero(x <= np.partition(x, n - 1)[n - 1])
    return at[np.argsort(x[at], kind="stable")][:n].tolist()


class Pieces:
    """A model's pieces, scores and byte pieces, and the segmentation of texts."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(m.is_byte(i) for i in self.byte):
            raise ValueError("the model has no byte pieces, so it can't write every text")
        self.scores = [m.get_score(i) for i in range(n)]
        self.text = [m.id_to_piece(i) for i in range(n)]
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.written = [of_byte.get(i, t.replace(SPACE, " ").encode()) for i, t in enumerate(self.text)]
        self.ids = {self.text[i]: i for i in range(n)
                    if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.unknown = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_LOSS
        self.matches = ahocorasick.Automaton()  # every occurrence of a piece: (its length - 1, piece, score)
        for p, i in self.ids.items():
            self.matches.add_word(p, (len(p) - 1, i, self.scores[i]))
        self.matches.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        bound = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        beside = {(x, y) for p in self.ids for x, y in zip(p, p[1:])}
        mixed = {c for x, y in beside if x.isalpha() != y.isalpha() for c in (x, y)}
        marks = {c for c in bound if not c.isalpha()} - mixed  # beside nothing but other marks in any piece
        while joined := {c for x, y in beside if (x in marks) != (y in marks) and SPACE not in (x, y) for c in (x, y)} & marks:
            marks -= joined
        runs = [f"[{re.escape(''.join(sorted(x)))}]" for x in (bound - marks, marks) if x]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.stretch = re.compile(f"(?:{'|'.join([SPACE, *runs])})+|.", re.S)
        else:
            self.stretch = re.compile("|".join([*(f"{SPACE}*{r}+" for r in runs), f"{SPACE}+", "."]), re.S)
        self.held: dict[str, tuple[float, tuple[int, ...], float]] = {}
        self.before: dict[str, tuple[float, tuple[int, ...], float]] = {}
        self.several: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def _ways(self, s: str) -> Iterator[tuple[int, tuple[int, int, float]]]:
        """``(last, (length - 1, piece, score))`` of every piece in a stretch, by end, the longest first; a
        code point without a piece of its own has piece -1."""
        if self.single.issuperset(s):
            return self.matches.iter(s)
        return self._ways_unknown(s)

    def _ways_unknown(self, s: str):
        at = 0
        for last, way in self.matches.iter(s) if self.ids else ():
            for k in range(at, last):
                if s[k] not in self.single:
                    yield k, (0, -1, self.unknown)
            at = max(at, last)
            yield last, way
        for k in range(at, len(s)):
            if s[k] not in self.single:
                yield k, (0, -1, self.unknown)

    def _forward(self, s: str):
        """Per position every ``(score, start, piece)`` that ends there, and the best of them."""
        ends: list[list[tuple[float, int, int]]] = [[] for _ in range(len(s) + 1)]
        best: list[tuple[float, int, int]] = [(float("-inf"), 0, 0)] * (len(s) + 1)
        best[0] = (0.0, 0, 0)
        for last, (back, piece, score) in self._ways(s):
            way = (best[last - back][0] + score, last - back, piece)
            ends[last + 1].append(way)
            if way[0] > best[last + 1][0]:
                best[last + 1] = way
        return ends, best

    def _ids(self, s: str, rest) -> tuple[int, ...]:
        """Ids of a path of nested ``(start, piece, rest)``."""
        ids: list[int] = []
        while rest is not None:
            at, piece, rest = rest
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte[b] for b in s[at].encode("utf-8", "surrogatepass")]
        return tuple(ids)

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best ``(score, ids)`` of one stretch, best first.

        Forward: every way a piece ends at a position, and the best score there.
        Backward: a path's bound is its score so far plus the best score of what
        is left, so its loss against the best path is known when it leaves the
        best way; along the best way the bound does not change. The queue holds
        as many paths as are still wanted.
        """
        ends, best = self._forward(s)
        total, found, order = best[-1][0], [], 0
        queue: list[tuple] = [(0.0, 0, len(s), None)]  # (loss, order, position, rest of the path), sorted
        while queue and len(found) < n:
            loss, _, j, rest = queue.pop(0)
            want = n - len(found) - 1
            while j:
                top = best[j]
                for way in ends[j]:
                    if way is not top:
                        at = loss + top[0] - way[0]
                        if len(queue) < want or want and at < queue[-1][0]:
                            order += 1
                            insort(queue, (at, order, way[1], (way[1], way[2], rest)))
                            del queue[want:]
                rest, j = (top[1], top[2], rest), top[1]
            found.append((total - loss, self._ids(s, rest)))
        return found

    def _n_best_of(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """:meth:`n_best`; the results of short stretches are remembered."""
        got = self.several.get((s, n))
        if got is None:
            got = self.n_best(s, n)
            if len(s) <= LONG:
                if len(self.several) >= HELD_SEVERAL:
                    self.several.clear()
                self.several[s, n] = got
        return got

    def _search(self, s: str) -> tuple[float, tuple[int, ...], float]:
        """(best score, best ids, loss of the second) of a stretch; short ones are remembered."""
        return self._remember(s, self.before.get(s) or self._best(s))

    def _remember(self, s: str, got: tuple) -> tuple[float, tuple[int, ...], float]:
        if len(s) <= LONG:
            if len(self.held) >= HELD:  # the older half goes; what is still in use comes back from it
                self.before = dict(self.held)
                self.held.clear()
            self.held[s] = got
        return got

    def _best(self, s: str) -> tuple[float, tuple[int, ...], float]:
        """The best path by Viterbi; the second's loss is the bound at the head of the
        backward search's queue once the best path has left it."""
        size = len(s)
        best, second = [float("-inf")] * (size + 1), [float("-inf")] * (size + 1)
        start, piece = [0] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        for last, (back, i, score) in self._ways(s):
            score += best[last - back]
            last += 1
            if score > best[last]:
                second[last], best[last], start[last], piece[last] = best[last], score, last - back - 1, i
            elif score > second[last]:
                second[last] = score
        least, rest, j = float("inf"), None, size
        while j:
            if best[j] - second[j] < least:
                least = best[j] - second[j]
            rest, j = (start[j], piece[j], rest), start[j]
        return best[size], self._ids(s, rest), least

    def segment(self, text: str | None, n: int = N_BEST):
        """``(parts, scores, choices)`` of a whole text: its stretches as searched, the scores of the text's n
        best, and for each of these the ``{stretch position: ids}`` in which it differs from the best."""
        if not text:
            return [], [0.0], [{}]
        parts: list[tuple] = []
        texts: list[str] = []
        get, search = self.held.get, self._search
        for at, raw in enumerate(text.split(SPACE)):
            if at:  # a U+2581 of the text itself, as bytes
                parts.append((self.unknown, tuple(self.byte[b] for b in SPACE.encode()), float("inf")))
                texts.append("")
            found = self.stretch.findall((SPACE if not at else "") + raw.replace(" ", SPACE))
            parts += [get(s) or search(s) for s in found]
            texts += found
        scores, _, losses = zip(*parts)
        best = sum(scores)
        sums: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        # of the n best texts none changes a stretch beyond the n - 1 of least second loss
        for at in _least(np.array(losses), n - 1):
            if losses[at] < float("inf"):
                top, *others = self._n_best_of(texts[at], n)
                more = [(loss + top[0] - score, {**c, at: ids}) for loss, c in sums for score, ids in others]
                sums = sorted(sums + more, key=itemgetter(0))[:n]
        return parts, [best - loss for loss, _ in sums], [c for _, c in sums]

    def encode(self, text: str | None, n: int = N_BEST) -> tuple[list[int], list[float]]:
        """Ids of the best segmentation and the scores of the n best."""
        parts, scores, _ = self.segment(text, n)
        return list(chain.from_iterable(map(itemgetter(1), parts))), scores

    def encode_n_best(self, text: str | None, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations in full."""
        parts, scores, choices = self.segment(text, n)
        return [(s, [i for at, p in enumerate(parts) for i in c.get(at, p[1])]) for s, c in zip(scores, choices)]

    def decode(self, ids) -> str:
        """The text of a sequence of ids (without the space that encoding puts first)."""
        w = self.written
        return b"".join([w[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """The model of a file, loaded once per worker."""
    return Pieces(path)


def _one(model: Pieces, text: str | None, n: int, ids: bool):
    got, scores = model.encode(text, n)
    if ids:
        return got, scores, len(got)
    return (len(got), scores, hashlib.sha256(np.array(got, "<i4").tobytes()).hexdigest(),
            hashlib.sha256(model.decode(got).encode("utf-8", "surrogatepass")).hexdigest())


def encode_texts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """``keep`` columns (default: all), ``ids`` (best segmentation), ``scores`` (of the n best) and ``n_pieces``."""
    return _run(docs, text_col, keep, n, model, True)


def encode_digests(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """Like :func:`encode_texts`, with SHA-256 of the ids (32-bit little endian) and of the text
    decoded from them in their place: ``n_pieces, scores, ids_sha256, decoded_sha256``."""
    return _run(docs, text_col, keep, n, model, False)


def _run(docs: DataFrame, text_col: str, keep: list[str] | None, n: int, model: str, full: bool) -> DataFrame:
    keep = docs.columns if keep is None else keep
    # columns that stay travel in one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if full:
        own = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("scores", T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
               ("n_pieces", T.LongType(), pa.int64())]
    else:
        own = [("n_pieces", T.LongType(), pa.int64()), ("scores", T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
               ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    schema = T.StructType([rows.schema["row"], *[T.StructField(a, t) for a, t, _ in own]])

    def run(batches: Iterator[pa.RecordBatch]):
        m = pieces(model)
        gc.disable()  # no cycles are made here, and passes over the remembered stretches cost a tenth of the time
        try:
            for b in batches:
                for lo in range(0, b.num_rows, 256):  # ids are many times larger than texts: small batches out
                    part = b.slice(lo, 256)
                    got = [_one(m, t.as_py(), n, full) for t in part.column(1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([g[k] for g in got], t) for k, (_, _, t) in enumerate(own)]],
                                                     names=["row", *[a for a, _, _ in own]])
        finally:
            gc.enable()

    out = rows.mapInArrow(run, schema)
    return out.select("row.*", *[a for a, _, _ in own])


def decode_ids(df: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` plus the text of its ids."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else pieces(model).decode(i) for i in x], dtype=object)
    return df.withColumn(out, run(F.col(f"`{ids_col}`")))
