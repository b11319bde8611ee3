"""Every operator and stage on nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from melospark.llm import bpe, exact_dedup, html_text, language_id, packing, pii, quality_rules, secret_scan, simhash, token_counts

CLASHES = ("host", "fp", "of", "of_hash", "digest", "keep_id", "group_size", "text_hash", "kinds", "spans", "salt", "number", "length", "score", "lang_pred", "n_words", "component", "anchor", "__cuts_", "found")


@pytest.fixture(scope="module")
def edge(spark):
    long_text = "Wort und word " * 30000 + "password=abcdef123456 a@b.co"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here at all", "en", "s", 3), (None, None, None, None, None), (3, long_text, "de", "s", 5)]
    rows += [(4, "a text of some words that repeats", "en", "t", 1)] * 3 + [(5, "a text of some words that repeats", "en", None, None), (6, " \n\t ", "en", "s", 1), (7, "\x00﷐ ☃ 漢字", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3).cache()


OPERATORS = {
    "quality": quality_rules.judge,
    "pii": lambda d: pii.digest_pii(pii.find_pii(d)),
    "exact": lambda d: exact_dedup.dedup(d),
    "bpe": bpe.encode_decode,
    "language": language_id.identify_documents,
    "simhash": simhash.near_duplicates,
    "secrets": secret_scan.scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(edge, name):
    got = OPERATORS[name](edge)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in edge.collect())
    assert OPERATORS[name](edge.limit(0)).collect() == []


def test_pieces_and_sections(edge):
    packed = packing.pack_documents(edge).collect()
    assert sum(r.piece == 0 for r in packed) == edge.count() and sum(r.length for r in packed if r.doc_id == 2) == 1
    sections = token_counts.section_token_counts(edge).collect()
    assert {r.doc_id for r in sections} == {r.doc_id for r in edge.collect()}
    assert token_counts.section_token_counts(edge.limit(0)).count() == 0


def test_results_on_edges(edge):
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge).collect() if r.doc_id}
    assert near[1] == near[2] == near[6] == 1 and near[4] == near[5] == 4
    exact = {r.doc_id: r for r in OPERATORS["exact"](edge).collect() if r.doc_id}
    assert exact[6].kept and exact[1].keep_id == 6 and exact[5].keep_id == 4 and exact[4].group_size == 4
    found = {r.doc_id: r.spans for r in secret_scan.scan(edge).collect()}
    assert found[3].startswith("assign:420000:") and found[7] == ""


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, edge, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    got = function(spark, edge, "")
    got.collect()
    if stage != "pack":
        assert got.columns == edge.columns
    assert function(spark, edge.limit(0), "").count() == 0


def test_pages(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a</p>" * 20000, "x"), (2, "u", "<p>a</p>" * 20000, "x"), (3, "u", "<<<>>> & &amp &#0; </p></div>", "x"), (4, "u", "<div " * 2000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 6 and sum(r.n_chars == 39999 for r in got) == 2 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0
