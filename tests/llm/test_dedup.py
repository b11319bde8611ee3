"""Exact and near dedup against plain versions."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash

from melospark.llm import common, components, exact_dedup, simhash

SCHEMA = "doc_id long, text string, digest string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    group = {n: n for n in nodes}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_exact_dedup_small(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a  b"), (9, None), (8, ""), (7, " \n"), (1, "A b"), (None, "ab"), (2, "é "), (6, "é")]
    got = {r.doc_id: r for r in exact_dedup.dedup(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert {got[i].keep_id for i in (5, 3, 4, None)} == {4}  # most code points
    assert {got[i].keep_id for i in (9, 8, 7)} == {7}  # null counts as empty
    assert got[4].kept and not got[3].kept and got[3].group_size == 4 and got[1].kept and got[2].kept and got[6].kept
    assert got[3].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.dedup(frame(spark, [])).count() == 0


def test_index_is_kept_between_batches(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, "kept_index", buckets=4, path=path)
    exact_dedup.dedup(frame(spark, [(10, "x y"), (11, "z")]), index).count()
    spark.sql("DROP TABLE kept_index")
    again = exact_dedup.DigestIndex(spark, "kept_index", buckets=4, path=path)
    got = {r.doc_id: r for r in exact_dedup.dedup(frame(spark, [(1, "x  y"), (2, "new"), (3, "n e w")]), again).collect()}
    assert got[1].keep_id == 10 and not got[1].kept  # the index wins, whatever the length
    assert got[2].keep_id == got[3].keep_id == 3
    assert again.table().count() == 3
    plan = again.table().join(spark.table("kept_index").select("digest").hint("merge"), "digest", "left_semi")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


def test_buckets_follow_the_size_and_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 2)
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 1)
    path = f"file://{tmp_path}/sized"
    index = exact_dedup.DigestIndex(spark, "sized_index", path=path)
    assert index.buckets is None
    exact_dedup.dedup(frame(spark, [(k, f"text {k}") for k in range(9)]), index).count()
    assert index.buckets == 5
    with pytest.raises(ValueError, match="5 buckets"):
        exact_dedup.DigestIndex(spark, "sized_index", buckets=8, path=path)
    index.drop()
    with pytest.raises(ValueError, match="5 buckets"):
        exact_dedup.DigestIndex(spark, "sized_index", buckets=8, path=path)
    again = exact_dedup.DigestIndex(spark, "sized_index", path=path)
    assert again.buckets == 5 and again.table().count() == 9
    again.drop()


def test_an_index_of_a_single_call_is_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.dedup(frame(spark, [(1, "a"), (-(2**63), "a"), (2**63 - 1, "a")])).collect()
    got = exact_dedup.drop_repeats(frame(spark, [(1, "a"), (-(2**63), "a"), (2**63 - 1, "a")])).collect()
    assert [r.doc_id for r in got] == [-(2**63)]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_drop_repeats_keeps_columns(spark):
    out = exact_dedup.drop_repeats(frame(spark, [(1, "a"), (2, "a"), (3, "b")]))
    assert out.columns == ["doc_id", "text", "digest", "keep_id"] and {r.doc_id for r in out.collect()} == {1, 3}


def test_fingerprints_match_plain_version():
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice(["Ab", "c", "é", "dd", " x"]) for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_links_are_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, size=40, dtype=np.uint64)
    found = {0, (1 << 64) - 1, 7}
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.integers(0, 64, size=rng.integers(0, 5)):
                x ^= 1 << int(b)
            found.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(found)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    mask = (1 << 64) - 1
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 300


def test_spanning_links_have_the_components_of_all(spark):
    rng = np.random.default_rng(3)
    found = set()
    for c in rng.integers(0, 2**63, size=6, dtype=np.uint64):  # dense balls, and chains of distance three
        for _ in range(150):
            x = int(c)
            for b in rng.choice(64, size=rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            found.add(x)
        found |= {int(c) ^ ((1 << 3 * k) - 1) for k in range(10)}
    found |= {((1 << 32 + k) >> 32 << 32) ^ (1 << j) for k in range(32) for j in range(0, 30, 2)}  # full cells
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(found)]
    mask = (1 << 64) - 1
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for threshold in (3, 2, 1):
        own = [(a, b) for a, b in near if ((a ^ b) & mask).bit_count() <= threshold]
        got = [tuple(r) for r in simhash.spanning_links(frame, threshold).collect()]
        assert all(((a ^ b) & mask).bit_count() <= threshold for a, b in got)
        sets = [{k: v for k, v in plain_components_of(signed, pairs).items()} for pairs in (got, own)]
        assert sets[0] == sets[1]
        assert threshold == 1 or len(got) < 0.7 * len(own)


def plain_components_of(nodes, pairs):
    group = {n: n for n in nodes}

    def top(n):
        while group[n] != n:
            group[n] = group[group[n]]
            n = group[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        group[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_near_duplicates_match_plain_version(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(200)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One")]
    for k in range(15):
        base = [rng.choice(words) for _ in range(120)]
        for j in range(4):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10 * (k + 1) + j, " ".join(copy)))
    rows += [(500, rows[-1][1]), (500, rows[-1][1])]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    expected = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == set(expected.values())


def test_near_duplicates_write_the_parts_that_their_rows_need(spark, monkeypatch):
    """Few rows make few files, whatever number of partitions the shuffles have; more rows make more."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.sample(words, 60))) for k in range(40)]
    rows += [(100 * j + k, rows[k][1] + " more" * j) for k in range(20) for j in (1, 2)]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    expected = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert len(set(expected.values())) < len(rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    written = []

    def noted(df, name, put=common.stage):
        out = put(df, name)
        folder = out._staged_at.removeprefix("file://")
        written.append((name, len([f for f in os.listdir(folder) if f.startswith("part-")])))
        return out

    for module in (simhash, components):
        monkeypatch.setattr(module, "stage", noted)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for part_rows, least, most in ((10_000, 1, 1), (10, 4, 8)):
            monkeypatch.setattr(common, "PART_ROWS", part_rows)
            written.clear()
            out = simhash.near_duplicates(frame(spark, rows))
            parts = out.rdd.getNumPartitions()
            assert {r.doc_id: r.component_id for r in out.collect()} == expected
            shuffled = [n for name, n in written if name != "fingerprints"] + [parts]
            assert len(shuffled) >= 5 and max(shuffled) <= most
            assert least <= dict(written)["reps"] and least <= dict(written)["components"] and least <= parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_duplicates_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_on_chains_and_cliques(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + a, 100 + b) for a in range(8) for b in range(a)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(8)}
    rounds = [n for n in os.listdir(folder) if n.startswith("round-")]
    components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len([n for n in os.listdir(folder) if n.startswith("round-")]) == len(rounds) + 1  # the last one alone
