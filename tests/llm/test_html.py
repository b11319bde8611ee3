"""Composite text density against a plain tree, and the choice it makes."""

import math
import os
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from melospark.llm import html_text
from melospark.llm.html_text import Page, main_text


class Node:
    """A DOM node written and measured on its own, recursively."""

    def __init__(self, rng, depth=0, in_link=False, in_inline=False):
        inline = in_inline or rng.random() < 0.2
        self.tag = "a" if not in_inline and rng.random() < 0.3 else rng.choice(["b", "span", "i"]) if inline else rng.choice(["div", "section", "ul", "blockquote"])
        self.in_link = in_link or self.tag == "a"
        self.inline = self.tag in ("a", "b", "span", "i")
        n = 0 if depth > 4 else rng.randint(0, 4)
        self.children = [Node(rng, depth + 1, self.in_link, self.inline) if rng.random() < 0.6 else "x" * rng.randint(1, 60) for _ in range(n)]
        if self.inline:
            self.children = [c for c in self.children if isinstance(c, str) or c.inline and c.tag != "a"]

    def source(self):
        return f"<{self.tag}>" + "".join(c if isinstance(c, str) else c.source() for c in self.children) + f"</{self.tag}>"

    def nodes(self):
        return [self] + [m for c in self.children if not isinstance(c, str) for m in c.nodes()]

    def chars(self):
        return sum(len(c) if isinstance(c, str) else c.chars() for c in self.children)

    def link_chars(self):
        return self.chars() if self.in_link else sum(0 if isinstance(c, str) else c.link_chars() for c in self.children)

    def density(self, ratio):
        c, below = self.chars(), self.nodes()[1:]
        t, lt = max(1, len(below)), max(1, sum(m.tag == "a" for m in below))
        lc, other = max(1, self.link_chars()), max(1, c - self.link_chars())
        if c == 0:
            return 0
        return c / t * math.log((c / lc) * (t / lt), math.log(c / other * lc + ratio * c + math.e))


def test_densities_match_a_plain_tree():
    rng, seen = random.Random(4), 0
    for _ in range(400):
        while (root := Node(rng)).inline:
            pass
        page = Page(root.source())
        ratio = root.link_chars() / max(1, root.chars())
        got = [(t, d) for t, d in zip(page.tag, page.densities(), strict=True) if t not in ("#root", "#run")]
        expected = [(m.tag, m.density(ratio)) for m in root.nodes()]
        assert [t for t, _ in got] == [t for t, _ in expected]
        assert [d for _, d in got] == pytest.approx([d for _, d in expected], rel=1e-9, abs=1e-9)
        seen += len(got)
    assert seen > 2000


def test_links_alone_have_no_density():
    assert html_text.composite_density(100, 5, 100, 5, 0.5) == 0
    assert html_text.composite_density(0, 5, 0, 0, 0.5) == 0
    few, many = html_text.composite_density(600, 6, 60, 2, 0.3), html_text.composite_density(600, 6, 500, 5, 0.3)
    assert few > many > 0


LINKS = "<div><ul>" + "".join(f'<li><a href="/{k}">Some link text of number {k}</a></li>' for k in range(12)) + "</ul></div>"
SHORT = "<div><p>A short paragraph of two lines.</p><p>And another short one here.</p></div>"


def test_prose_beats_a_list_of_links():
    for page in (LINKS + SHORT, SHORT + LINKS, f"<div>{LINKS}</div><div>{SHORT}</div>"):
        assert main_text(f"<html><body>{page}</body></html>") == "A short paragraph of two lines.\nAnd another short one here."


def test_parts_beside_the_heart():
    long_ = "<p>" + "A paragraph that goes on for a while, with many words in it. " * 6 + "</p>"
    page = f"<body><div><h2>Before</h2><div>{long_ * 4}</div><h2>Part</h2><section>{long_}</section><h2>After</h2><p>© me</p></div>{LINKS}</body>"
    got = main_text(page).split("\n")
    assert got[0] == "Before" and got[5] == "Part" and len(got) == 7
    loose = "Text without any paragraph, as old pages have it, told at some length. " * 5
    assert main_text(f"<body>{loose}<br>{loose}<div><p>tiny</p></div></body>").startswith("Text without")
    two = f"<body><article>{long_}</article>{LINKS}<article>{long_}</article><p>© me</p></body>"
    assert main_text(two).count("\n") == 1
    comment = f"<body><article>{long_}<article><p>A reader's comment that is long enough to be dense, surely.</p></article></article></body>"
    assert "reader" not in main_text(comment)


def test_the_prior_only_helps():
    """Without words of class and id the choice stands wherever density tells it; a short article beside a longer
    advert is told by the words."""
    advert = '<div class="ad">An advert of some sixty characters, longer than the text.</div>'
    short, long_ = "<article><h1>Short.</h1><p><b>Short.<br><p>Two</p></article>", "<article><p>" + "Long text. " * 50 + "</p></article>"
    page = f"<body><nav>m</nav>{advert}{long_}<footer>f</footer></body>"
    assert main_text(page) == main_text(page, prior=1.0) == ("Long text. " * 50).strip()
    page = f"<body><nav>m</nav>{advert}{short}<footer>f</footer></body>"
    assert main_text(page) == "Short.\nShort.\nTwo" != main_text(page, prior=1.0)
    aside = f"<body><div class='comments'><p>{'A long comment. ' * 9}</p><p>{'Another long one. ' * 9}</p></div>{SHORT}</body>"
    assert main_text(aside) == "A short paragraph of two lines.\nAnd another short one here."
    assert main_text(aside, prior=1.0) != main_text(aside)
    assert main_text("<body><article></article><div class=widget><p>a b c</p><p>d e f</p></div></body>") == ""


def test_unclosed_comments_in_scripts_and_hidden_parts():
    page = "<script><!-- x </script><div><p>Kept text.</p><p style='display: none'>gone</p></div><SCRIPT>if (a</b/.test('</p>')) {}</SCRIPT >"
    assert main_text(page) == "Kept text."
    assert main_text("<p>1 < 2 and <3 &amp;lt; x</p>") == "1 < 2 and <3 &lt; x"


@pytest.mark.parametrize("start", ["", "<p><table><td>", "<a href=x>", "<ul><li>", "<nav>x</nav>", "<dl><dd>"])
def test_nesting_is_linear(start):
    def took(n):
        began = time.process_time()
        assert main_text(start + "<div>" * n + "deep") == "deep"
        return time.process_time() - began

    took(1000)
    short, long_ = min(took(5000) for _ in range(3)), min(took(40_000) for _ in range(2))
    assert long_ < 16 * short + 0.1  # 8 times as many; quadratic would be 64


PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_density_decides(monkeypatch):
    """On the pages of the table the texts are the same with <article> renamed, nearly all of them with the prior off;
    with a constant for a density none is."""
    pages = pq.read_table(PAGES)["html"].to_pylist()
    renamed = [re.sub(r"(</?)article", r"\1div", p) for p in pages]
    texts = [main_text(p) for p in pages]
    assert all("<article" in p for p in pages) and all(texts)
    assert [main_text(p) for p in renamed] == texts
    assert sum(main_text(p, prior=1.0) == t for p, t in zip(renamed, texts, strict=True)) >= 0.97 * len(pages)
    monkeypatch.setattr(html_text, "composite_density", lambda chars, *_: float(chars > 0))
    assert sum(main_text(p) == t for p, t in zip(renamed, texts, strict=True)) == 0


@pytest.mark.parametrize("piece", ["a<b", "<a", '<a"', "<a '", "<!", "<?x ", "<a '\"''", "</", "<div ", "<a x= ", "><a !<a ", ">>><a xx", "<!--x", "<script"])
def test_markup_is_read_in_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4
