import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import spm


@pytest.fixture(scope="module")
def model():
    return spm.pieces(spm.MODEL)


def all_segmentations(model, marked):
    """Every (score, ids) of a marked stretch, by plain recursion."""
    if not marked:
        return [(0.0, ())]
    out = []
    for j in range(1, len(marked) + 1):
        p = model.ids.get(marked[:j])
        if p is not None:
            out += [(model.scores[p] + s, (p, *r)) for s, r in all_segmentations(model, marked[j:])]
    if marked[0] not in model.ids:
        b = tuple(model.byte[x] for x in marked[0].encode())
        out += [(model.unknown + s, b + r) for s, r in all_segmentations(model, marked[1:])]
    return out


def test_n_best_of_a_stretch_matches_enumeration(model):
    for s in ["▁hello", "▁thtion", "aaaaaa", "▁▁▁▁", "▁éonpa", "zz\t", "▁\n", "𝄞a", "▁worthless"]:
        every = sorted((x for x in all_segmentations(model, s)), key=lambda x: -x[0])
        for n in (1, 2, 4, 9):
            got = model.n_best(s, n)
            assert len(got) == min(n, len(every)) and len({ids for _, ids in got}) == len(got)
            assert np.allclose([x for x, _ in got], [x for x, _ in every[:n]], rtol=0, atol=1e-3)
            assert all(any(ids == e and abs(x - y) < 1e-3 for y, e in every) for x, ids in got)


def test_n_best_of_a_text_is_that_of_one_lattice(model):
    """Cutting at stretches loses nothing: the whole text as one lattice gives the same scores."""
    rng = random.Random(7)
    for _ in range(40):
        t = "".join(rng.choice(["he", "llo", " ", "  ", "\n", "th", "é", "ß!", "x", "𝄞"]) for _ in range(rng.randrange(1, 9)))
        whole = model.n_best(spm.SPACE + t.replace(" ", spm.SPACE), 4)
        cut = model.encode_n_best(t, 4)
        assert np.allclose([s for s, _ in whole], [s for s, _ in cut], rtol=1e-12, atol=1e-3)
        assert len({tuple(i) for _, i in cut}) == len(cut)
        assert all(model.decode(ids) == t for _, ids in cut)


def test_round_trip(model):
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(chr(rng.choice([32, 9, 10, 0x2581, 0x20AC, 0x1D11E, 0, 97, 65, 233, 0x4E2D, 46])) for _ in range(rng.randrange(40)))
        ids, scores = model.encode(t)
        assert model.decode(ids) == t and scores == sorted(scores, reverse=True)
    long = "a" * 30000 + " ▁ " + "é\n" * 3000
    assert model.decode(model.encode(long)[0]) == long


def test_frames(spark, awkward, model):
    full = spm.encode_texts(awkward)
    assert full.columns == [*awkward.columns, "ids", "scores", "n_pieces"]
    rows = spm.decode_ids(full.select("doc_id", "text", "ids", "scores", "n_pieces")).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.decoded == (r.text or "") and r.n_pieces == len(r.ids)
        if not r.text:
            assert r.ids == [] and r.scores == [0.0]
    digests = {(r.doc_id, r.decoded_sha256, r.ids_sha256) for r in spm.encode_digests(awkward, keep=["doc_id"]).collect()}
    assert digests == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest(), hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()) for r in rows}
    assert spm.encode_texts(awkward.limit(0)).count() == 0


def test_bounded_memory(model, monkeypatch):
    monkeypatch.setattr(spm, "HELD", 10)
    t = " ".join(f"w{i}" for i in range(200))
    assert model.decode(model.encode(t)[0]) == t and len(model.held) <= 300_000
