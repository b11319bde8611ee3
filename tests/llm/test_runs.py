"""Runs by recompression against every period tried at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from melospark.llm import periodic_runs as pr


def plain_runs(w, least=24):
    """Stretches of w[i] == w[i + q] for each q; of equal stretches the least period."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.randrange(0, 160)
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(0, 4) if n > 5 else 0):
        a, p = rng.randrange(n), rng.randrange(1, 40)
        for i in range(a + p, rng.randrange(a, n)):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least", [24, 3, 7])
def test_runs_equal_plain_ones(least):
    rng = random.Random(least)
    for _ in range(150):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 12))]
        docs += [list(docs[0])] * rng.choice([0, 0, 3])
        assert pr.runs([np.array(d, dtype=np.int64) for d in docs], least) == [plain_runs(d, least) for d in docs]


def test_long_texts():
    one = np.zeros(200_000, dtype=np.int64)
    other = np.tile(np.arange(1000), 100)
    assert pr.runs([one, other, np.arange(5000)]) == [[(0, 200_000, 1)], [(0, 100_000, 1000)], []]


def test_common_letters_both_ways():
    rng = random.Random(1)
    for _ in range(60):
        w = [10**6, *repetitive(rng), 10**6 + 1]
        g = pr.Grammar(np.array(w, dtype=np.int64))
        pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w))]
        pairs = rng.sample(pairs, min(len(pairs), 300))
        x, y = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))
        ahead, back = g.common(x, y, True), g.common(x, y, False)
        for (i, j), f, b in zip(pairs, ahead.tolist(), back.tolist(), strict=True):
            assert f == next(k for k in range(len(w)) if j + k >= len(w) or w[i + k] != w[j + k])
            assert b == next(k for k in range(len(w)) if w[i - k] != w[j - k])


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    left = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_equals_plain_rows(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{x}" for x in repetitive(rng))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (None, "a b " * 40), (903, "a b c\x00d " * 30), (904, "x y z " * 20), (904, "x y z " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'n' as period", "0 as start").repartition(3)
    got = [tuple(r) for r in pr.planted_runs(docs).collect()]
    want = [plain_row(*r) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 50
    assert pr.planted_runs(docs.limit(0)).collect() == []


def test_runs_and_texts_as_rows(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end"), (2, "nothing here")], "doc_id long, text string")
    assert [tuple(r) for r in pr.find_runs(docs).collect()] == [(1, 1, 30, 3)]
    kept = {r.doc_id: r.collapsed for r in pr.collapse_runs(docs, keep_text=True).collect()}
    assert kept == {1: "start a b c end", 2: "nothing here"}
