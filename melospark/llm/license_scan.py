"""License scans by an exact set-similarity join of texts and notice templates (operator 13).

Words are runs of digits, small letters (A-Z lowered) and characters beyond ASCII. A block of a template is a window of
consecutive words, ``SLACK`` times as many as the template has (the whole text where that is shorter). Every block
that holds at least ``THRESHOLD`` of the template's distinct words is found:

1. The words of all templates are ordered by the number of documents that hold them, rarest first, counted over the
   whole corpus (one row a template word).
2. A template of m words, a of which must be held, is indexed by its first m - a + 1 words: a block without any of
   them holds fewer than a (prefix filter). A text with fewer than a of all template words is passed over (length
   filter), and so is a template as soon as what it may still share, seen from the places of a common word in both
   orders, doesn't make a (positional filter).
3. What is left is verified: windows at each place of a template word, counted as they slide.

The index goes to the tasks with their code; templates beyond ``WORDS_A_PASS`` words are joined in several passes, so
what is sent is bounded. Texts pass through without a shuffle.

Of blocks that overlap, those that share most words with their template give labels (on a tie those with the higher
containment, then all). Labels of the base phrases stay whatever the templates say. The score is 1 where a base phrase
stands, else the highest containment of a labelling block, else 0.

Edge cases: null and empty texts have no words; rows may repeat, each is answered alone; null doc_ids are kept; other
columns are ignored; an empty table gives no rows; templates without words are refused.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melospark.llm.common import texts

THRESHOLD = 0.8
SLACK = 1.25
WORDS_A_PASS = 500_000

# Fixed values of the contract: phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Published notices by which works name their licenses.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
)

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: frozenset[bytes]
    window: int  # words of a block
    least: int  # distinct words that a block must hold


def templates_of(notices: tuple[tuple[str, str], ...] = NOTICES, threshold: float = THRESHOLD, slack: float = SLACK) -> list[Template]:
    out = []
    for k, (label, text) in enumerate(notices):
        words = words_of(text)
        if not words:
            raise ValueError(f"template {k} has no words")
        distinct = frozenset(words)
        out.append(Template(k, label, distinct, math.ceil(slack * len(words)), math.ceil(threshold * len(distinct) - 1e-9)))
    return out


class PrefixIndex:
    """Templates by the words of their prefixes; ``order`` is the place of each template word, rarest first."""

    def __init__(self, templates: list[Template], order: dict[bytes, int]):
        self.templates, self.order = templates, order
        self.prefix: defaultdict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(templates):
            for place, word in enumerate(sorted(t.words, key=order.__getitem__)[: len(t.words) - t.least + 1]):
                self.prefix[word].append((k, place))
        self.least = min(t.least for t in templates)
        self.first = frozenset(self.prefix)

    def candidates(self, held: set[bytes]) -> list[Template]:
        """Templates that a text with these template words may hold, by the three filters."""
        if len(held) < self.least or self.first.isdisjoint(held):
            return []
        ordered = sorted(held, key=self.order.__getitem__)
        shared: dict[int, int] = {}
        for i, word in enumerate(ordered):
            for k, place in self.prefix.get(word, ()):
                t = self.templates[k]
                common = shared.get(k, 0)
                if common >= 0 and len(ordered) >= t.least:
                    may = common + 1 + min(len(ordered) - i - 1, len(t.words) - place - 1)
                    shared[k] = common + 1 if may >= t.least else -1
        return [self.templates[k] for k, common in shared.items() if common > 0]


def blocks(words: list[bytes], t: Template) -> list[tuple[int, int, int]]:
    """(start, end, shared): for each stretch of overlapping blocks that hold enough of the template, the first of
    those that hold most, from its first to behind its last template word."""
    at = [k for k, w in enumerate(words) if w in t.words]
    count: dict[bytes, int] = {}
    found: list[tuple[int, int, int]] = []
    right, reach = 0, -1
    for left, start in enumerate(at):
        while right < len(at) and at[right] < start + t.window:
            count[words[at[right]]] = count.get(words[at[right]], 0) + 1
            right += 1
        if len(count) >= t.least:
            block = (start, at[right - 1] + 1, len(count))
            if start >= reach:
                found.append(block)
            elif len(count) > found[-1][2]:
                found[-1] = block
            reach = at[right - 1] + 1
        word = words[start]
        count[word] -= 1
        if not count[word]:
            del count[word]
    return found


def labelling(hits: list[dict]) -> list[dict]:
    """The hits that no overlapping hit outdoes."""

    def strength(h: dict) -> tuple[int, float]:
        return h["shared"], h["shared"] / h["size"]

    return [h for h in hits if all(g["start"] >= h["end"] or h["start"] >= g["end"] or strength(g) <= strength(h) for g in hits)]


def phrase_places(words: list[bytes], held: set[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) of each place where the words of a phrase stand one after another."""
    out = []
    for phrase, label in phrases:
        if held.issuperset(phrase):
            at = -1
            for _ in range(words.count(phrase[0])):
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
    return out


def word_order(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Places of the words by the number of documents that hold them, then by themselves. The driver gets at most a
    row a word of ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[bytes, int] = defaultdict(int)
        for batch in batches:
            for value in batch["text"]:
                for word in vocabulary.intersection(words_of(value.as_py())):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "docs"])

    counted = texts(docs).select("text").mapInArrow(run, "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    held = {bytes(r["word"]): r["docs"] for r in counted.collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (held.get(w, 0), w)))}


_HIT = "array<struct<template int, label string, start long, end long, shared long, size long>>"


def _passes(templates: list[Template], most: int) -> list[list[Template]]:
    """Templates in groups of at most ``most`` distinct words (one template at least)."""
    groups: list[list[Template]] = [[]]
    for t in templates:
        if groups[-1] and sum(len(x.words) for x in groups[-1]) + len(t.words) > most:
            groups.append([])
        groups[-1].append(t)
    return groups


def _hits(words: list[bytes], index: PrefixIndex) -> list[dict]:
    held = index.order.keys() & set(words)
    return [
        {"template": t.number, "label": t.label, "start": s, "end": e, "shared": n, "size": len(t.words)}
        for t in index.candidates(held)
        for s, e, n in blocks(words, t)
    ]


def _with_hits(docs: DataFrame, templates: list[Template], words_a_pass: int) -> DataFrame:
    """doc_id, text, hits of all templates; one pass for each group of them."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.withColumn("hits", F.array().cast(_HIT))
    for group in _passes(templates, words_a_pass):
        index = PrefixIndex(group, word_order(rows, frozenset().union(*(t.words for t in group))))

        def run(batches: Iterator[pa.RecordBatch], index: PrefixIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(h or []) + _hits(words_of(t), index) for t, h in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(found, batch["hits"].type)], names=["doc_id", "text", "hits"])

        out = out.mapInArrow(run, f"doc_id {kind}, text string, hits {_HIT}")
    return out


def find_blocks(
    docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, threshold: float = THRESHOLD, slack: float = SLACK, words_a_pass: int = WORDS_A_PASS
) -> DataFrame:
    """A row per block found: doc_id, template (place in ``notices``), label, start, end (words), shared, size."""
    found = _with_hits(docs, templates_of(notices, threshold, slack), words_a_pass)
    return found.select("doc_id", F.inline("hits"))


def scan(
    docs: DataFrame,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    threshold: float = THRESHOLD,
    slack: float = SLACK,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    words_a_pass: int = WORDS_A_PASS,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = _with_hits(docs, templates_of(notices, threshold, slack), words_a_pass)
    looked = [(words_of(p), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, hits in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True):
                words = words_of(text)
                places = phrase_places(words, set(words), looked)
                base, best = {label for _, label in places}, labelling(hits)
                labels = base | {h["label"] for h in best}
                score = 1.0 if base else max((h["shared"] / h["size"] for h in best), default=0.0)
                starts = [s for s, _ in places]
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
