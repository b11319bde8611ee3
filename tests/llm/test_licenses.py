"""License scans against windows counted one by one, and against phrases sought plainly."""

import random
import re

import pytest

from melospark.llm import license_scan as ls


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_stretches(words, t):
    """Best window of each stretch of overlapping windows that hold enough, windows taken at every word."""
    held = {w.decode() for w in t.words}
    good = []
    for s in range(len(words)):
        if words[s] in held:
            window = words[s : s + t.window]
            last = max(k for k, w in enumerate(window) if w in held)
            shared = len(held.intersection(window))
            if shared >= t.least:
                good.append((s, s + last + 1, shared))
    out, reach = [], -1
    for s, e, n in good:
        if s >= reach:
            out.append([(s, e, n)])
        else:
            out[-1].append((s, e, n))
        reach = e
    return [max(g, key=lambda b: (b[2], -b[0])) for g in out]


def plain_scan(text, templates):
    words = plain_words(text)
    places = [(s, label) for p, label in ls.PHRASES for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
    hits = [{"label": t.label, "start": s, "end": e, "shared": n, "size": len(t.words)} for t in templates for s, e, n in plain_stretches(words, t)]
    best = []
    for h in hits:
        over = [g for g in hits if g["start"] < h["end"] and h["start"] < g["end"]]
        if all((g["shared"], g["shared"] / g["size"]) <= (h["shared"], h["shared"] / h["size"]) for g in over):
            best.append(h)
    base = sorted({label for _, label in places})
    labels = sorted(set(base) | {h["label"] for h in best})
    score = 1.0 if base else max((h["shared"] / h["size"] for h in best), default=0.0)
    starts = [s for s, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score)


def disturbed(rng, text):
    words = text.split()
    for _ in range(rng.randint(0, len(words) // 3)):
        k = rng.randrange(len(words))
        what = rng.random()
        words[k : k + 1] = [] if what < 0.4 else [rng.choice(["zug", "été", "the", "of"])] if what < 0.8 else [words[k], "so"]
        words = words or ["x"]
    return rng.choice([" ", "\n", "\n# ", " * "]).join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    filler = "the of to in mit der die and or any software license gnu general public apache cc by notice conditions copies".split()
    out = []
    for k in range(160):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randint(0, 60))))
            if rng.random() < 0.7:
                parts.append(disturbed(rng, rng.choice(ls.NOTICES)[1]))
        out.append((k, "\n".join(parts)))
    out += [(500, None), (501, ""), (None, "MIT License"), (502, "CC BY-NC 4.0 and cc-by; Apache\nLicense"), (502, "CC BY-NC 4.0 and cc-by; Apache\nLicense"), (503, "Ünder the gnu general public license"), (504, "word " * 200_000)]
    return out


@pytest.mark.parametrize("words_a_pass", [500_000, 60])
def test_equals_plain_windows(spark, rows, words_a_pass):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as hits", "'x' as labels").repartition(3)
    templates = ls.templates_of()
    want = [(i, *plain_scan(t, templates)) for i, t in rows]
    got = [tuple(r) for r in ls.scan(docs, words_a_pass=words_a_pass).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum("," in r[6] for r in want) > 5 and len({r[6] for r in want}) > 8
    assert ls.scan(docs.limit(0)).collect() == []


def test_each_notice_gets_its_own_label(spark):
    docs = spark.createDataFrame([(k, f"some words before\n{text}\nand behind") for k, (_, text) in enumerate(ls.NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.scan(docs).collect()}
    assert got == {k: label for k, (label, _) in enumerate(ls.NOTICES)}
    found = ls.find_blocks(docs).where("shared = size").collect()
    assert {(r.doc_id, r.template) for r in found} >= {(k, k) for k in range(len(ls.NOTICES))}
    assert all(r.start == 3 for r in found if r.doc_id == r.template)


def test_filters_lose_no_candidate():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)]
    for _ in range(300):
        notices = tuple((str(k), " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for k in range(6))
        templates = ls.templates_of(notices, threshold=rng.choice([0.3, 0.6, 0.8, 1.0]))
        used = sorted(frozenset().union(*(t.words for t in templates)))
        rng.shuffle(used)
        index = ls.PrefixIndex(templates, {w: k for k, w in enumerate(used)})
        held = {w.encode() for w in rng.sample(vocabulary, rng.randint(0, 20))} & set(used)
        got = {t.number for t in index.candidates(held)}
        assert got >= {t.number for t in templates if len(t.words & held) >= t.least}


def test_templates_without_words_are_refused():
    with pytest.raises(ValueError):
        ls.templates_of((("x", "!? -"),))
