"""Recall of disguised identifiers by kind, on a planted set; the gate against none."""

import random

import pytest

from melospark.llm import pii

WORDS = {d: w for w, d in pii.DIGIT_WORDS.items() if w != "oh"}
LOOKS = {v: k for k, v in pii.HOMOGLYPHS.items() if v.isalpha()}
PROSE = "the report of the group was read at length and a point was made about it by one of two people in town".split()


def luhn_card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def digits_disguised(rng, text):
    """Digits as words, or as other digits, or with characters that take no room."""
    how = rng.randrange(3)
    if how == 0:
        return " ".join(WORDS[c] if c.isdigit() else c for c in text)
    if how == 1:
        return "".join(chr(ord("０") + int(c)) if c.isdigit() else c for c in text)
    return rng.choice(pii.INVISIBLE).join(text)


def plant(rng, kind):
    """A disguised identifier of a kind."""
    if kind == "email":
        local, domain = rng.choice(["john.doe", "a_b", "info", "maria99"]), rng.choice(["example", "mail-box", "corp"])
        at = rng.choice([" at ", "(at)", " [at] ", " (AT) ", "@", "{at}"])
        dot = rng.choice([" dot ", "[dot]", "(dot)", " (Dot) "])
        if at == "@":
            local, dot = "".join(LOOKS.get(c, c) for c in local), "."
            local = local if not local.isascii() else "jоhn"
        return f"{local}{at}{domain}{dot}{rng.choice(['com', 'org', 'co.uk' if dot == '.' else 'net'])}"
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        how = rng.randrange(3)
        if how == 0:
            return " dot ".join(" ".join(WORDS[c] for c in p) for p in parts)
        return "[.]".replace(".", "dot").join(parts) if how == 1 else "．".join("".join(chr(ord("０") + int(c)) for c in p) for p in parts)
    if kind == "card":
        return digits_disguised(rng, luhn_card(rng))
    number = "".join(rng.choice("0123456789") for _ in range(rng.randint(10, 14)))
    return ("plus " + " ".join(WORDS[c] for c in number)) if rng.random() < 0.5 else "+" + digits_disguised(rng, number).lstrip()


@pytest.mark.parametrize("kind", pii.KINDS)
def test_recall_of_planted_disguises(kind):
    rng, caught, n = random.Random(kind), 0, 1000
    for _ in range(n):
        held, before = plant(rng, kind), " ".join(rng.choices(PROSE, k=8))
        if before.split()[-1] in ("at", "one", "two", "point"):
            before += " here:"
        text = f"{before} {held}, {' '.join(rng.choices(PROSE, k=8))}"
        spans = [(k, text[a:b]) for k, a, b in [*pii.detect(text), *pii.disguised(text, pii.detect(text))]]
        caught += any(k == kind and s.strip("​‌‍⁠﻿­ ") == held.strip() for k, s in spans)
    print(kind, caught / n)
    assert caught >= 0.9 * n


def test_the_gate_loses_nothing():
    rng = random.Random(8)
    parts = ["john", " at ", "(at)", "@", " dot ", ".", "example", "com", "one ", "two ", "seven-", "+", "plus ", "4", "17", "о", "а", "１", "​", " ", "-", "(", ")", "[dot]", "192", "0"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(3, 14)))
        plain = pii.detect(text)
        gated = pii.disguised(text, plain)
        found += bool(gated)
        if not pii.rewritable(text):
            tape = pii.normalise(text)
            assert not any(tape.changed) and gated == [], text
    assert found > 200


def test_long_runs_of_digits():
    zeros = "0" * 5000
    assert pii.detect(f"{zeros}.1.2.3") == [("ip", 0, 5006)]
    assert pii.detect(f"{zeros}9999.1.2.3") == []
    pii.disguised(f"{zeros} one dot two dot three", pii.detect(zeros))


PLAIN_PROSE = """look at node.js for that
see him at 5.30
version at 2.0
meet at 5.30pm
stayed at home.Then we left
arrive at St.Pancras in the morning
We met at example.com last year
one.two.three.four
2·4·6·8 who do we appreciate
count one.two.three.four and go
the price at 9.99 each
he laughed at it.She did too
it stood at 12.5 per cent
look @ node.js
we are at v1.2 now
set at max.speed of the car
sold at Harrods.London
the train at 10.15 and at 11.45
at about 3.4 million people
good at math.And at art
aim at two.point.five
stopped at U.S.Customs
read it at www.example.com
posted at blog.example.org
they are at e.g.Rome
came in at no.one on the list
start at index.html of it
run at localhost.localdomain
at night.He slept
the file at report.pdf
clock at 6.00 a.m.
one two three and four
a plus one for me
two or three at most.Or four
he stared at one dot and left
a point at 0.5 dot two
step one.two and step three.four
at the end of section 3.1.2.4
published at arxiv.org in may
buy at amazon.de now
""".strip().split("\n")


def test_prose_holds_no_address():
    """Phrases with "at" and dots: none is marked by the transducers."""
    assert len(PLAIN_PROSE) >= 30
    wrong = {t: found for t in PLAIN_PROSE if (found := pii.disguised(t, pii.detect(t)))}
    assert wrong == {}
    together = ". ".join(PLAIN_PROSE)
    assert pii.disguised(together, pii.detect(together)) == []


@pytest.mark.parametrize("text", ["john at example.com", "jane.doe at mail.example.co.uk", "a_b at corp dot net", "JOHN AT EXAMPLE.COM", "met at example dot com", "maria99 @ example.org"])
def test_bare_signs_with_evidence(text):
    assert [(k, text[a:b]) for k, a, b in pii.disguised(text, pii.detect(text))] == [("email", text)]
