"""Boolean trigram queries derived from regular expressions.

Every text that a pattern matches satisfies its query: an AND/OR tree of trigrams (ASCII letters folded to lower
case). Strings the pattern must hold are followed through sequences, small character sets, options and
alternatives; what can't be followed ends a string. ``None`` means that no trigram is mandatory.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

#: A trigram, or ("and" | "or", (queries, ...)), or None: anything may match.
Query = str | tuple[str, tuple] | None

_MOST_STRINGS = 64
_MOST_SET = 8


def _all(queries) -> Query:
    parts = tuple(dict.fromkeys(q for q in queries if q is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(queries) -> Query:
    parts = tuple(dict.fromkeys(queries))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> Query:
    """One of the strings is there, so all trigrams of that one are."""
    return _any(_all(s[k : k + 3] for k in range(len(s) - 2)) for s in sorted(strings))


def _set(items) -> set[str] | None:
    """The folded characters of a small set, or None."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 2 * _MOST_SET:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= _MOST_SET else None


def _follow(nodes) -> tuple[set[str] | None, Query]:
    """(all strings a sequence can be, its query); the strings are None when they can't be listed."""
    strings: set[str] = {""}  # what the text surely holds at this place, in one piece
    listed, queries = True, []

    def end_of_string() -> None:
        nonlocal strings, listed
        queries.append(_of_strings(strings))
        strings, listed = {""}, False

    for kind, value in nodes:
        if kind is op.LITERAL:
            new, query = {chr(value).lower()}, None
        elif kind is op.IN:
            new, query = _set(value), None
        elif kind is op.SUBPATTERN:
            new, query = _follow(value[3])
        elif kind is op.BRANCH:
            parts = [_follow(branch) for branch in value[1]]
            new = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            query = _any(p[1] if p[0] is None else _of_strings(p[0]) for p in parts) if new is None else None
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            inner_strings, inner_query = _follow(inner)
            if most == 1 and least == 0 and inner_strings is not None:
                new, query = inner_strings | {""}, None
            elif least == most and least <= 8 and inner_strings is not None and len(inner_strings) ** least <= _MOST_STRINGS:
                new, query = {"".join(p) for p in product(inner_strings, repeat=least)}, None
            else:
                new, query = None, (inner_query if inner_strings is None else _of_strings(inner_strings)) if least else None
        elif kind is op.AT:
            continue
        else:
            new, query = None, None
        if new is not None and len(strings) * len(new) > _MOST_STRINGS:
            end_of_string()
            strings, listed = new, False
        elif new is not None:
            strings = {a + b for a in strings for b in new}
        else:
            end_of_string()
            queries.append(query)
    if listed:
        return strings, None
    return None, _all([*queries, _of_strings(strings)])


def trigram_query(pattern: str) -> Query:
    """The query of a pattern, or None if it has no mandatory trigram."""
    strings, query = _follow(_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def weakened(query: Query, known: frozenset[str]) -> Query:
    """What remains of a query when only ``known`` trigrams can be looked up; every match still satisfies it."""
    if query is None or isinstance(query, str):
        return query if query in known else None
    parts = [weakened(q, known) for q in query[1]]
    return _all(parts) if query[0] == "and" else _any(parts)
