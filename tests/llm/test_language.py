"""Language identification against plain versions, and on held-out rows."""

import os
import random
import time

import numpy as np
import pytest

from melospark.llm import language_id
from melospark.llm.language_id import SWITCH_COST, split_words, viterbi


def plain_best(scores, cost):
    """Largest total over all label sequences, by the plain recursion."""
    best = scores[0].astype(float)
    for row in scores[1:]:
        best = np.maximum(best, best.max() - cost) + row  # stay, or come from the best label
    return best.max()


def total(scores, labels, cost):
    return sum(float(s[k]) for s, k in zip(scores, labels)) - cost * sum(a != b for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("states", [1, 2, 3, 4, 12, 13, 40, 127, 128, 130, 255, 256, 300])
def test_viterbi_is_optimal(states):
    rng = np.random.default_rng(states)
    for _ in range(6 if states > 50 else 25):
        sizes = rng.integers(0, 300 if states < 50 else 90, size=rng.integers(1, 7))
        first = np.append(0, np.cumsum(sizes))
        scores = -rng.integers(0, 9, size=(first[-1], states)).astype(np.float32)
        for cost in (2.0, SWITCH_COST, 0.0):
            labels = viterbi(scores, first, cost)
            assert len(labels) == first[-1] and ((labels >= 0) & (labels < states)).all()
            for a, b in zip(first, first[1:]):
                if b > a:
                    assert total(scores[a:b], labels[a:b], cost) == pytest.approx(plain_best(scores[a:b], cost))


def test_labels_above_the_range_of_a_byte():
    scores = np.full((4, 400), -50, dtype=np.float32)
    scores[[0, 1], 129] = scores[[2, 3], 399] = 0
    assert viterbi(scores, np.array([0, 4])).tolist() == [129, 129, 399, 399]


def test_a_long_text_with_many_labels_stays_small():
    words, states = 20_000, 127
    scores = -np.random.default_rng(1).random((words, states), dtype=np.float32)
    began = time.time()
    assert len(viterbi(scores, np.array([0, words]))) == words
    assert time.time() - began < 20


def test_marks_belong_to_words():
    words = split_words(["हिन्दी में लिखा", "été ́ x", "́́"], 1 << 10)
    assert np.diff(words.first_of_text).tolist() == [3, 2, 0]
    assert words.length.tolist() == [6, 3, 4, 5, 1]


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 200 and right >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_stay_out_of_a_prediction(spark):
    """lang, source and doc_id of the rows predicted, and texts of held-out rows, change nothing."""
    from pyspark.sql import functions as F

    rows = [(k, "the house by the river and the bridge" if k % 2 else "das haus an dem fluss und die brücke", "en" if k % 2 else "de") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(language_id.held_out(), "xx").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_documents(d).collect()} for d in (docs, other))
    assert a == b


def test_long_texts_in_pieces(spark):
    """Pieces end behind white space, cover the text, and give what the whole does, in memory of a piece."""
    text = "wort und word " * 5000
    pieces = list(language_id.text_pieces(text, 1000))
    assert "".join(p for _, p in pieces) == text and all(len(p) <= 1000 and p.endswith(" ") for _, p in pieces)
    assert [o for o, _ in pieces] == [sum(len(p) for _, p in pieces[:k]) for k in range(len(pieces))]
    assert [len(p) for _, p in language_id.text_pieces("x" * 2500, 1000)] == [1000, 1000, 500] and list(language_id.text_pieces("")) == [(0, "")]
    rng = random.Random(3)
    words = {"a": ["alpha", "albe", "ano", "area"], "b": ["zulu", "zeck", "zwirn", "zorn"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for k in range(60) for lang in ("a", "b")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choice(words[lang]) for lang in runs for _ in range(40)) for runs in ("aab", "bbb", "abba", "a" * 50)]
    docs = spark.createDataFrame([*enumerate(texts), (9, None), (10, " . ")], "doc_id long, text string")
    frame = language_id.identify(docs, model, spans=True, evidence=True)
    found = {r.doc_id: r for r in frame.collect()}
    assert [[s.lang for s in found[k].spans] for k in range(4)] == [["a", "b"], ["b"], ["a", "b", "a"], ["a"]]
    assert all(found[k].spans[0].start == 0 and found[k].spans[-1].end == len(t) for k, t in enumerate(texts))
    assert found[9].lang_pred == found[10].lang_pred == "und" and found[9].letters == 0


def test_pieces_add_up():
    """Spans of pieces are those of the text where no language changes at a cut."""
    held = []
    language_id._extend(held, [{"start": 0, "end": 5, "lang": "a"}, {"start": 6, "end": 9, "lang": "b"}], 0)
    language_id._extend(held, [{"start": 0, "end": 4, "lang": "b"}, {"start": 5, "end": 7, "lang": "a"}], 10)
    language_id._extend(held, [], 20)
    assert held == [{"start": 0, "end": 5, "lang": "a"}, {"start": 6, "end": 14, "lang": "b"}, {"start": 15, "end": 17, "lang": "a"}]


def test_a_long_text_takes_the_memory_of_a_piece(spark):
    """Ten million characters: the peak beyond the text stays below 300 MB."""
    import tracemalloc

    text = "wort und word " * 715_000
    tracemalloc.start()
    peak = 0
    for _, piece in language_id.text_pieces(text):
        words = split_words([piece], 1 << 16)
        scores = np.zeros((len(words.start), 4), dtype=np.float32)
        viterbi(scores, words.first_of_text)
        peak = max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert len(text) > 10_000_000 and peak < 300e6
