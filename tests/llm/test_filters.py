"""The pipeline's filters on repeated and missing ids, against plain versions of each."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from melospark.llm import exact_dedup, language_id, simhash

CLEAN = "this is a clean text of some words that nobody would drop"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    body = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    rows = [(7, "123 456"), (7, CLEAN), (None, "99 88"), (None, CLEAN + " too"), (None, None), (8, None), (8, "")]
    rows += [(1, body[0]), (2, body[0]), (2, body[1]), (None, body[0]), (3, body[1] + "  "), (None, body[2]), (None, body[2]), (4, body[2])]
    rows += [(5, body[3]), (5, body[3]), (6, body[3]), (6, body[4]), (None, body[5]), (None, body[6]), (9, body[7]), (9, body[8])]
    rows += [(k, b + " " + b + " " + b + tail) for k, b, tail in ((20, body[9], ""), (20, body[9], " end"), (21, body[9], " one"), (None, body[9], " end"), (21, body[10], ""))]
    rows += [(30, CLEAN), (30, CLEAN)]
    return spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_language_stage_keeps_clean_rows(spark, docs):
    model = language_id.train(docs.where(~language_id.held_out()))
    texts = {r.text for r in docs.collect()}
    # a verdict depends on the text alone, so each different text is asked once, under a number of its own
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verdict = {r.doc_id: r for r in language_id.identify(asked, model, evidence=True).collect()}
    gone = {t for k, t in enumerate(texts) if verdict[k].letters == 0 or verdict[k].scored > 0 and verdict[k].score < corpus_pipeline.LEAST_SCORE}
    assert {"123 456", "99 88", None, ""} <= gone and CLEAN not in gone
    assert rows_of(corpus_pipeline.keep_languages(spark, docs, "")) == sorted((r for r in rows_of(docs) if r[1] not in gone), key=repr)


def test_exact_stage_drops_copies_alone(docs):
    best = {}
    for i, t in rows_of(docs):
        key = re.sub(r"[\x20\x09-\x0d]+", "", t or "")
        rank = (-len(t or ""), i is None, i or 0)
        best[key] = min(best.get(key, rank), rank)
    want = [(i, t) for i, t in rows_of(docs) if (i is None, i or 0) == best[re.sub(r"[\x20\x09-\x0d]+", "", t or "")][1:]]
    assert rows_of(exact_dedup.drop_repeats(docs)) == want
    assert sum(i == 2 for i, _ in want) == 0 and sum(i is None for i, _ in want) >= 4


def test_near_stage_keeps_one_of_each_group(docs):
    rows = rows_of(docs)
    print_of = {t: simhash.fingerprint(t) for _, t in rows}
    group = {f: f for f in print_of.values()}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for f in group:
        for g in group:
            if (f ^ g).bit_count() <= simhash.THRESHOLD:
                group[max(root(f), root(g))] = min(root(f), root(g))
    got = rows_of(simhash.drop_near_duplicates(docs))
    held = {}
    for i, t in got:
        held.setdefault(root(print_of[t]), set()).add((i, t))
    assert set(held) == {root(f) for f in group}
    for f, kept in held.items():
        members = {(i, t) for i, t in rows if root(print_of[t]) == f}
        assert len(kept) == 1 and kept <= members
        least = min((i is None, i or 0) for i, _ in members)
        assert {(i is None, i or 0) for i, _ in kept} == {least}
    assert sorted((r for r in rows if r in {k for s in held.values() for k in s}), key=repr) == got  # rows repeated stay together


def test_filters_keep_columns_with_clashing_names(spark, docs):
    clashing = docs.withColumns({c: F.lit(1) for c in ("no_id", "id", "text_hash", "__gone_id", "digest", "fp")})
    for name, function in corpus_pipeline.STAGES[:-1]:
        got = function(spark, clashing, "")
        assert got.columns == clashing.columns, name
        assert function(spark, clashing.limit(0), "").count() == 0
