"""BPE, packing, token counts and the pipeline against the tokenizers library and plain versions."""

import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from melospark.llm import bin_completion, bpe, entries, packing, secret_scan, token_counts
from tests.llm.test_dedup import frame, plain_components, plain_fingerprint
from tests.llm.test_text import plain_secrets

ALPHABET = list("ab's'tdlrevm  \n\n\t\r1234!?.,-#<|>éßü\xa0　 漢字あ😀́АбвZQxX\x1c\x85\x00") + ["'s", "'ll", "<|endoftext|>", "  ", "\n\n", " the", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def random_text(rng, n=25):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, n)))


def test_encoding_equals_the_library(library):
    rng, own = random.Random(1), bpe.encoder(bpe.default_vocabulary())
    for _ in range(6000):
        text = random_text(rng)
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text
    for text in ["a" * 20000, " " * 5000 + "x", "ab" * 5000 + "\n" * 300, "word " * 3000]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_query(spark, library):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "x<|endoftext|>y"), (1, "Hello wörld")]
    got = bpe.encode_decode(frame(spark, rows), keep_ids=True).collect()
    assert len(got) == 5
    for r, (i, text) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda r: (r[0] or 0, len(r[1] or "")))):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def fewest_bins(lengths, capacity):
    """Exact by dynamic programming over subsets."""
    n = len(lengths)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (0, capacity)
    for mask in range(1 << n):
        bins, used = best[mask]
        for k in range(n):
            if not mask >> k & 1:
                new = (bins, used + lengths[k]) if used + lengths[k] <= capacity else (bins + 1, lengths[k])
                best[mask | 1 << k] = min(best[mask | 1 << k], new)
    return best[-1][0]


def check_plan(counts, capacity, planned):
    used = {}
    for filling, times in planned.patterns:
        assert sum(x * n for x, n in filling) <= capacity and times > 0
        for x, n in filling:
            used[x] = used.get(x, 0) + n * times
    assert used == {x: n for x, n in counts.items() if n} and planned.sequences == sum(t for _, t in planned.patterns)
    assert planned.sequences >= planned.lower_bound


def test_plans_are_optimal_on_small_input():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        planned = bin_completion.plan(counts, capacity)
        check_plan(counts, capacity, planned)
        assert planned.sequences == fewest_bins(lengths, capacity) and planned.optimal


def test_search_beats_best_fit():
    counts = {44: 2, 24: 2, 22: 2, 21: 2, 17: 2, 8: 2, 6: 4, 51: 1, 28: 1, 27: 2, 15: 2}
    capacity = 100
    first = sum(n for _, n in bin_completion.best_fit_decreasing(counts, capacity))
    planned = bin_completion.plan(counts, capacity)
    check_plan(counts, capacity, planned)
    assert planned.sequences <= first
    hard = {6: 3, 4: 3, 3: 4, 2: 3}
    check_plan(hard, 12, bin_completion.plan(hard, 12))
    big = {x: 1000 + 37 * x % 91 for x in range(1, 1025)}
    check_plan(big, 1024, bin_completion.plan(big, 1024, max_nodes=50))
    assert bin_completion.plan({}, 1024).sequences == 0


def test_completions_are_all_undominated_fillings():
    rng = random.Random(10)
    for _ in range(200):
        counts = {x: rng.randint(1, 4) for x in rng.sample(range(1, 30), rng.randint(1, 6))}
        room, waste = rng.randint(1, 40), rng.randint(0, 6)
        got = list(bin_completion.completions(counts, room, waste))
        assert [s for s, _ in got] == sorted(s for s, _ in got)
        kept = [tuple(sorted(f.items())) for _, f in got if f is not None]
        fillings = [{}]
        for x, n in counts.items():
            fillings = [f | {x: k} if k else f for f in fillings for k in range(n + 1)]
        expected = set()
        for f in fillings:
            slack = room - sum(x * n for x, n in f.items())
            if not 0 <= slack <= waste:
                continue
            pieces = [x for x, n in f.items() for _ in range(n)]
            left = [x for x, n in counts.items() if n > f.get(x, 0)]
            parts = [c for k in range(1, len(pieces) + 1) for c in itertools.combinations(pieces, k)]
            if not any(sum(c) <= y <= sum(c) + slack and (len(c) > 1 or y > c[0]) for c in parts for y in left):
                expected.add(tuple(sorted(f.items())))
        assert len(kept) == len(set(kept)) and set(kept) == expected, (counts, room, waste)


def test_large_histograms_meet_the_bound():
    rng = random.Random(2)
    counts = {}
    for _ in range(30_000):
        x = min(1024, max(1, int(rng.gauss(330, 90))) if rng.random() < 0.8 else rng.randint(1, 1024))
        counts[x] = counts.get(x, 0) + 1
    planned = bin_completion.plan(counts, 1024)
    check_plan(counts, 1024, planned)
    assert planned.sequences <= planned.lower_bound + 2


def check_packed(rows, got, library, capacity):
    """Pieces are those of the documents, sequences are gapless and none is too long."""
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        start, number = 0, 0
        for n in ([len(ids) % capacity] if len(ids) % capacity else []) + [capacity] * (len(ids) // capacity):
            piece = np.array(ids[start : start + n], "<u4").tobytes()
            expected.append((i, number, start, n, zlib.crc32(piece)))
            start, number = start + n, number + 1
    order = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(expected, key=order)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, library, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma!", "δ"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(1000 + k, "same text again") for k in range(80)] + [(2000, None), (2001, ""), (2002, "long " * 500), (None, "x"), (2000, None)]
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)  # many groups for a length
    got = packing.pack_documents(frame(spark, rows), capacity=64).collect()
    n = check_packed(rows, got, library, 64)
    total = sum(r.length for r in got)
    assert n <= -(-total // 64) + 2
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_token_counts(spark, library):
    rng = random.Random(6)
    rows = [(k, random_text(rng, 60).replace("<|endoftext|>", "")) for k in range(80)] + [(900, None), (901, ""), (902, "\n\n\n a\n\nb")]
    for rule in token_counts.RULES:
        got = {}
        for r in token_counts.section_token_counts(frame(spark, rows), rule).collect():
            got.setdefault(r.doc_id, {})[r.section] = r
        for i, text in rows:
            text = text or ""
            spans = token_counts.line_sections(text)
            encoded = library.encode(text, add_special_tokens=False)
            counts = [0.0] * len(spans)
            for a, b in encoded.offsets:
                share = [max(0, min(b, y) - max(a, x)) for x, y in spans]
                if rule == "split":
                    counts = [c + s / (b - a) for c, s in zip(counts, share)]
                else:
                    touched = [k for k, s in enumerate(share) if s]
                    k = {"first": touched[0], "last": touched[-1], "most": share.index(max(share))}[rule]
                    counts[k] += 1
            assert np.allclose([got[i][k].n_tokens for k in range(len(spans))], counts), (rule, text)
            assert all(got[i][k].doc_tokens == len(encoded.ids) and (got[i][k].start, got[i][k].end) == spans[k] for k in range(len(spans)))
            assert -1 not in got[i]


def test_token_counts_with_given_sections(spark):
    df = spark.createDataFrame([(1, "one two three four", [(0, 4), (8, 13)]), (2, "abc", []), (3, None, None)], "doc_id long, text string, s array<struct<start:long,end:long>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.section_token_counts(df, "first", sections_col="s").collect()}
    # " two" begins in the first section, " three" before the second, " four" behind it
    assert got == {(1, 0): 2, (1, 1): 0, (1, -1): 2, (2, -1): 1}


def test_sections_must_be_sorted_and_disjoint(spark):
    for spans in ([(4, 8), (0, 2)], [(0, 5), (4, 8)], [(3, 1)]):
        df = spark.createDataFrame([(1, "one two three", spans)], "doc_id long, text string, s array<struct<start:long,end:long>>")
        with pytest.raises(Exception, match="disjoint and sorted"):
            token_counts.section_token_counts(df, sections_col="s").collect()


def test_vocabularies_out_of_order_are_refused(tmp_path):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[10], merges[11] = merges[11], merges[10]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="order of the merges"):
        bpe.FragmentEncoder(str(tmp_path / "v.json"))


def test_pipeline_on_a_fixture(spark, tmp_path, library):
    rng = random.Random(12)
    english = "the of and to in that it is was for on with as his they at be this from have".split()
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()
    rows = []
    for k in range(40):
        words = [rng.choice(english if k % 2 else german) + rng.choice(["", "s", "er"]) for _ in range(80)]
        rows.append((k, " ".join(words), "en" if k % 2 else "de"))
    rows += [(100 + k, rows[k][1].replace(" ", "\n", 3), rows[k][2]) for k in range(5)]  # exact copies, white space aside
    rows += [(200 + k, rows[k][1] + " end", rows[k][2]) for k in range(5)]  # near copies
    rows += [(300, "12345 !!", "en"), (301, None, None), (302, rows[7][1][::-1] + " password=abcdef123456 x", "en")]
    df = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t, _ in rows}
    assert set(kept["language_id"]) == set(texts) - {300, 301}
    groups = {}
    for i in kept["language_id"]:
        groups.setdefault("".join(texts[i].split()), []).append(i)
    assert set(kept["exact_dedup"]) == {min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values()}
    fps = {i: plain_fingerprint(texts[i]) for i in kept["exact_dedup"]}
    reach = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert set(kept["near_dedup"]) == set(reach.values())
    assert kept["secret_scan"].keys() == kept["near_dedup"].keys() and secret_scan.PLACEHOLDER in kept["secret_scan"][302]
    assert not any(plain_secrets(t) for t in kept["secret_scan"].values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packed(list(kept["secret_scan"].items()), got, library, 1024)


def test_entries_are_complete():
    found = entries.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
    assert set(entries.oracle_sql()) <= set(found)


def test_budgets_reach_the_search(spark):
    """Without limits the plan is proved; with one of a node it is best-fit decreasing, which says so."""
    rng, docs = random.Random(12), []
    for k in range(60):
        docs.append((k, " ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.choice([7, 11, 13, 17, 23, 31])))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    exact = packing.pack_documents(df, capacity=40, max_nodes=None, max_fillings=None)
    row = exact.first()
    assert row.optimal and exact.agg(F.countDistinct("sequence_id")).first()[0] == row.sequences >= row.least_sequences
    quick = packing.pack_documents(df, capacity=40, max_nodes=1).first()
    assert quick.sequences >= row.sequences and quick.least_sequences == row.least_sequences


def test_rows_that_repeat_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    df = spark.createDataFrame([(1, "same text")] * 3000, "doc_id long, text string").repartition(3)
    pieces = packing.stage(packing.token_pieces(df), "pieces")
    numbers = packing.numbered(pieces, 30)
    assert sorted(r.number for r in numbers.select("number").collect()) == list(range(3000))
    got = packing.pack_documents(df)
    assert got.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0 and got.count() == 3000
