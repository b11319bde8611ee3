"""Packing plan over a length histogram: bin completion with branch and bound.

The planner never sees documents, only how many pieces have each length: at most ``capacity`` numbers, however
large the corpus. A plan is a list of patterns, each a filling of one sequence and how often it is used.

* Incumbent: best-fit decreasing, done on counts (equal bins move together).
* Bound: the waste bound of Martello and Toth over all thresholds.
* Branching: the largest remaining length is completed by the undominated fillings of the room beside it, fullest
  first and among equally full ones by few pieces and frequent lengths, generated one by one as the search comes back
  for more: none is left out. A filling is used as often as it fits, or once; a branch is cut when its waste alone, or
  the bound of what remains, rules out beating the incumbent.
* Every 64th node is also closed by the best-fit plan of what remains, which may improve the incumbent.

Search ends when the bound is met, when every branch is cut (the plan then is optimal), or when ``max_nodes`` nodes or
``max_fillings`` fillings were looked at; the plan then is the best incumbent. These two budgets are the only limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

#: A filling as ((length, how many), ...) by falling length, and how many sequences use it.
Pattern = tuple[tuple[tuple[int, int], ...], int]


@dataclass(frozen=True)
class Plan:
    patterns: list[Pattern]
    sequences: int
    lower_bound: int
    #: Nodes and fillings looked at, and whether the plan is known to be optimal.
    nodes: int = 0
    fillings: int = 0
    optimal: bool = False


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Least number of sequences: for each threshold a, lengths over capacity - a stand alone, those over half
    stand in bins of their own, and what of [a, half] doesn't fit beside them needs further bins."""
    by_length = [0] * (capacity + 1)
    for length, n in counts.items():
        by_length[length] += n
    number, tokens = [0], [0]
    for length, n in enumerate(by_length):
        number.append(number[-1] + n)
        tokens.append(tokens[-1] + n * length)
    half, best = capacity // 2, -(-tokens[-1] // capacity)
    for a in range(half + 1):
        alone = number[capacity + 1] - number[capacity - a + 1]
        paired = number[capacity - a + 1] - number[half + 1]
        room = paired * capacity - (tokens[capacity - a + 1] - tokens[half + 1])
        small = tokens[half + 1] - tokens[a]
        best = max(best, alone + paired + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: bins of equal room and filling are one group."""
    groups: dict[int, list[list]] = {}  # room -> [[filling, how many bins], ...]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in groups if r >= length):
            if not left:
                break
            fits, rest = room // length, []
            for filling, bins in groups.pop(room):
                full = min(bins, left // fits)
                if full:
                    groups.setdefault(room - fits * length, []).append([(*filling, (length, fits)), full])
                    left -= full * fits
                part = left if full < bins else 0
                if part:
                    groups.setdefault(room - part * length, []).append([(*filling, (length, part)), 1])
                    left = 0
                if bins - full - bool(part):
                    rest.append([filling, bins - full - bool(part)])
            if rest:
                groups.setdefault(room, []).extend(rest)
        fits = capacity // length
        if left >= fits:
            groups.setdefault(capacity - fits * length, []).append([((length, fits),), left // fits])
        if left % fits:
            groups.setdefault(capacity - left % fits * length, []).append([((length, left % fits),), 1])
    return [(filling, bins) for group in groups.values() for filling, bins in group]


#: Fillings of up to so many pieces come first, by the number of pieces: few long pieces leave the small ones, with
#: which any gap can be closed, to the end.
_FEW = 4


def _reachable(lengths: list[int], counts: dict[int, int], room: int) -> list[list[int]]:
    """For each place in ``lengths``, bit sets of the sums up to ``room`` that the lengths from there on can make:
    of any pieces (0), and of exactly 1, 2, ... ``_FEW`` pieces."""
    within = (1 << (room + 1)) - 1
    here = [1] + [0] * _FEW
    sums = [here]
    for x in reversed(lengths):
        made, step, left = here[0], 1, min(counts[x], room // x)
        most = left
        while left:  # doubling: any number of pieces up to the count
            took = min(step, left)
            made |= made << took * x & within
            left -= took
            step *= 2
        now = [made]
        for p in range(1, _FEW + 1):
            exact = here[p] | (1 << p * x if p <= most else 0)
            for n in range(1, min(most, p - 1) + 1):
                exact |= here[p - n] << n * x
            now.append(exact & within)
        here = now
        sums.append(here)
    return sums[::-1]


def _dominated(filling: list[tuple[int, int]], slack: int, counts: dict[int, int], available: int) -> bool:
    """Whether a part of the filling could be swapped for one single longer (or, for several pieces, equally
    long) piece that it leaves out: the swap frees smaller pieces, which fit wherever that piece does."""
    one = many = 0  # bit sets: sums of one piece, sums of several
    left_out = available  # lengths that are left over
    for x, n in filling:
        for _ in range(n):
            many |= (one | many) << x
            one |= 1 << x
        if n == counts[x]:
            left_out &= ~(1 << x)
    longer, span = (one | many) << 1, 1  # sums and up to slack more
    while span < slack:
        step = min(span, slack - span)
        longer |= longer << step
        span += step
    return bool(left_out & (many | (longer if slack else 0)))


def completions(counts: dict[int, int], room: int, waste: int) -> Iterator[tuple[int, dict[int, int] | None]]:
    """(slack, filling) of every undominated filling of ``room`` that leaves at most ``waste``: fullest first, then
    those of few pieces, then of the lengths with most pieces left, which keeps the histogram even. A dominated one gives (slack, None), so that the caller can count it.
    The walk enters no branch without a filling, since it knows the sums that the lengths ahead can make."""
    lengths = sorted((x for x in counts if x <= room and counts[x]), key=lambda x: (counts[x], x), reverse=True)
    sums = _reachable(lengths, counts, room)
    available = sum(1 << x for x in lengths)
    filling: list[tuple[int, int]] = []

    def extend(k: int, rest: int, pieces: int) -> Iterator[None]:
        """Walks all ways to make ``rest``; of exactly so many ``pieces``, or of any number if that is 0."""
        if not rest:
            yield
            return
        for j in range(k, len(lengths)):
            if not sums[j][pieces] >> rest & 1:
                return
            x = lengths[j]
            for n in range(min(rest // x, counts[x], pieces or room), 0, -1):
                ends = n * x == rest and pieces in (0, n)
                if ends or (n < pieces or not pieces) and n * x < rest and sums[j + 1][pieces and pieces - n] >> rest - n * x & 1:
                    filling.append((x, n))
                    yield from extend(j + 1, rest - n * x, pieces and pieces - n)
                    filling.pop()

    for slack in range(min(waste, room) + 1):
        rest = room - slack
        for pieces in (*range(1, _FEW + 1), 0) if rest else (0,):
            if sums[0][pieces] >> rest & 1:
                for _ in extend(0, rest, pieces):
                    again = not pieces and 0 < sum(n for _, n in filling) <= _FEW
                    yield slack, None if again or _dominated(filling, slack, counts, available) else dict(filling)


#: Where the search stops unless told otherwise.
MAX_NODES, MAX_FILLINGS = 1500, 50_000


def plan(counts: dict[int, int], capacity: int, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> Plan:
    """Best plan found for the histogram ``counts`` (length -> number of pieces, 1 <= length <= capacity). Without limits
    (None) it is the best there is."""
    max_nodes, max_fillings = (math.inf if m is None else m for m in (max_nodes, max_fillings))
    counts = {x: n for x, n in counts.items() if n}
    bound, total = lower_bound(counts, capacity), sum(x * n for x, n in counts.items())
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(n for _, n in best)
    nodes = looked = 0

    def children(left: dict[int, int], used: int, wasted: int) -> Iterator[tuple[dict[int, int], Pattern, int]]:
        """What remains, the pattern used and its waste, for every branch of a node. Counts what it looks at."""
        nonlocal looked
        largest = max(left)
        others = {x: n - (x == largest) for x, n in left.items()}
        for slack, filling in completions(others, capacity - largest, (fewest - 1) * capacity - total - wasted):
            looked += 1
            if wasted + slack > (fewest - 1) * capacity - total:
                return  # the incumbent has improved since; what follows leaves as much or more
            if filling is not None:
                need = filling | {largest: filling.get(largest, 0) + 1}
                most = min(left[x] // n for x, n in need.items())
                spare = (fewest - 1) * capacity - total - wasted
                for times in sorted({min(most, spare // slack) if slack else most, 1}, reverse=True):
                    after = {x: m for x, n in left.items() if (m := n - times * need.get(x, 0))}
                    yield after, (tuple(sorted(need.items(), reverse=True)), times), slack * times
            if looked >= max_fillings:
                return

    open_nodes: list[tuple[Iterator, int, int]] = []  # branches left, sequences used, waste so far
    done: list[Pattern] = []

    def enter(left: dict[int, int], used: int, wasted: int) -> bool:
        """Looks at a node; true if its branches are worth following."""
        nonlocal best, fewest, nodes
        nodes += 1
        if not left or nodes % 64 == 1:
            rest = best_fit_decreasing(left, capacity)
            if used + sum(n for _, n in rest) < fewest:
                best, fewest = done + rest, used + sum(n for _, n in rest)
        if not left or used + lower_bound(left, capacity) >= fewest:
            return False
        open_nodes.append((children(left, used, wasted), used, wasted))
        return True

    if fewest > bound:
        enter(counts, 0, 0)
    while open_nodes and fewest > bound and nodes < max_nodes and looked < max_fillings:
        branches, used, wasted = open_nodes[-1]
        child = next(branches, None)
        if child is None:
            open_nodes.pop()
            del done[len(open_nodes) - 1 if open_nodes else 0 :]
            continue
        after, pattern, waste = child
        del done[len(open_nodes) - 1 :]
        done.append(pattern)
        enter(after, used + pattern[1], wasted + waste)
    return Plan(best, fewest, bound, nodes, looked, fewest <= bound or not open_nodes and looked < max_fillings)
