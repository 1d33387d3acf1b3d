"""Cuts against tokens found by a plain search; exact round trips; chunks do not depend on what stands before."""

import hashlib
import random
import re

from fleetlens.llm import middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    t = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(t), "plain", text, None, None
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h[3] % 100 < 80:
        return len(t), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(t), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def texts():
    r = random.Random(1)
    passage = "".join(r.choice("ab é\n\t<x") for _ in range(3000))
    out = ["", None, " ", "a", " a ", "x" * 30_000, " " * 20_000, "é" * 9_000 + " b", "a<P>b c", "a < P> b<S", "\x85  x\x1c y"]
    for i in range(150):
        out.append("".join(r.choice("abc  é\n\r\x0b<") for _ in range(r.randint(0, 900))) + passage * r.randint(0, 1))
    out.append(" ".join(f"w{i}" for i in range(300_000)))
    return out


def test_units_and_cuts():
    memory = M.Summaries(50)
    for i, text in enumerate(texts()):
        for doc_id in (i, i + 1000, None):
            got = M.transform(doc_id, text, memory)
            assert (got["n"], got["form"], got["output"], got["prefix_chars"], got["middle_chars"]) == brute(doc_id, text)
            assert M.restore(got["output"], got["form"]) == (text or "")


def test_every_count_is_located():
    memory = M.Summaries()
    text = texts()[40] * 3
    c, t, at = M.Counted(text.encode(), memory), TOKEN.findall(text), 0
    assert c.units == len(t)
    for k, x in enumerate(t):
        assert c.end_of(k) == at
        at += len(x.encode())
    assert c.end_of(len(t)) == at


def test_shared_passages_share_chunks():
    r = random.Random(2)
    passage = " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(20_000))
    memory = M.Summaries()
    M.Counted(passage.encode(), memory)
    once = memory.made
    for lead in ("x ", "a longer beginning ", "b" * 100_000):
        before = memory.made
        M.Counted((lead + passage).encode(), memory)
        assert memory.made - before < 0.2 * once + len(lead) / 500
    assert once > 100


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:60])] + [(None, "a b c", None), (3, "a b c d e", "y"), (3, "a b c d e", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = M.fill_in_middle(df.withColumnRenamed("form", "output2"), ["doc_id"]).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute(i, t)) for i, t, _ in rows), key=str)
    sums = M.fill_in_middle_digests(df.withColumnRenamed("form", "n"), ["doc_id"]).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.output_sha256, r.restored_sha256) for r in sums) == sorted((sha(brute(i, t)[2]), sha(t or "")) for i, t, _ in rows)
    assert M.fill_in_middle(df.limit(0), ["doc_id"]).count() == 0
