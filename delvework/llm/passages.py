"""Passages of language in pieces of a file, put together associatively.

A piece of a file is summed up by what is known of it whatever stands before and behind: the passages that end inside
(``closed``), and the first and last run of lines of the comment or string that goes on over its borders. Two
neighbouring sums make the sum of both, so a file can be folded in any grouping and gives what it gives as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

#: How a comment or string goes on over a border: as line comments on neighbouring lines, or open.
LINES, OPEN = "l", "o"
Sums = tuple  # words, wide characters, characters, scores


def _plus(a: Sums, b: Sums) -> Sums:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3]


def _minus(a: Sums, b: Sums) -> Sums:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2], a[3] - b[3]


class Run(NamedTuple):
    """Lines that belong together: their sums, the language of the first that shows one, the sums of those before it."""

    sums: Sums
    label: str | None
    lead: Sums | None = None


def joined(a: Run, b: Run) -> list[Run]:
    """A run and one that may go on from it: one run, or two where they show different languages."""
    if b.label is None:
        return [Run(_plus(a.sums, b.sums), a.label, a.lead)]
    if a.label is None:
        return [Run(_plus(a.sums, b.sums), b.label, _plus(a.sums, b.lead) if b.lead else a.sums)]
    if a.label == b.label:
        return [Run(_plus(a.sums, b.sums), a.label, a.lead)]
    if b.lead is None:
        return [a, b]
    return [Run(_plus(a.sums, b.lead), a.label, a.lead), Run(_minus(b.sums, b.lead), b.label)]


class Part(NamedTuple):
    """A part of one comment or string: its first and last run, and whether lines before and behind can go on from them.

    A part without runs lets others go on over it unless it is ``broken`` by a line without language.
    """

    joins: bool
    runs: tuple[Run, ...]
    open: bool
    broken: bool


class Sum(NamedTuple):
    """What is known of a piece: sizes of closed passages by language, the part that goes on at its start and end.

    ``through``: both are one part, kept as ``head``.
    """

    closed: dict[str, int]
    head: Part | None = None
    tail: Part | None = None
    head_kind: str | None = None
    tail_kind: str | None = None
    through: bool = False


Verdict = Callable[[Run], str | None]


def close(closed: dict[str, int], runs, verdict: Verdict) -> None:
    """Adds the runs that make a passage to the sizes by language."""
    for r in runs:
        lang = verdict(r)
        if lang:
            closed[lang] = closed.get(lang, 0) + r.sums[2]


def _chained(a: Part, b: Part, closed: dict, verdict: Verdict) -> Part:
    if not a.runs:
        return Part(b.joins and not a.broken, b.runs, b.open, a.broken or b.broken)
    if not b.runs:
        return a._replace(open=a.open and not b.broken)
    runs = [*a.runs[:-1], *joined(a.runs[-1], b.runs[0]), *b.runs[1:]] if a.open and b.joins else [*a.runs, *b.runs]
    close(closed, runs[1:-1], verdict)
    return Part(a.joins, (runs[0], runs[-1]) if len(runs) > 1 else tuple(runs), b.open, False)


def start_only(p: Part, closed: dict, verdict: Verdict) -> Part:
    """A part that ends here: only its first run can still grow."""
    close(closed, p.runs[1:], verdict)
    return p._replace(runs=p.runs[:1])


def end_only(p: Part, closed: dict, verdict: Verdict) -> Part:
    """A part that begins here: only its last run can still grow."""
    close(closed, p.runs[:-1], verdict)
    return p._replace(runs=p.runs[-1:])


def combined(a: Sum, b: Sum, neighbours: bool, verdict: Verdict) -> Sum:
    """The sum of two pieces, one behind the other; line comments go on only where the pieces are ``neighbours``."""
    closed = dict(a.closed)
    for k, v in b.closed.items():
        closed[k] = closed.get(k, 0) + v
    last = a.head if a.through else a.tail
    linked = last is not None and b.head is not None and a.tail_kind == b.head_kind and (b.head_kind == OPEN or neighbours)
    if linked:
        both = _chained(last, b.head, closed, verdict)
        if a.through and b.through:
            return Sum(closed, both, None, a.head_kind, b.tail_kind, True)
        if a.through:
            return Sum(closed, start_only(both, closed, verdict), b.tail, a.head_kind, b.tail_kind)
        if b.through:
            return Sum(closed, a.head, end_only(both, closed, verdict), a.head_kind, b.tail_kind)
        close(closed, both.runs, verdict)
        return Sum(closed, a.head, b.tail, a.head_kind, b.tail_kind)
    head, tail = a.head, b.tail
    if a.through:
        head = start_only(a.head, closed, verdict)
    elif a.tail is not None:
        close(closed, a.tail.runs, verdict)
    if b.through:
        tail = end_only(b.head, closed, verdict)
    elif b.head is not None:
        close(closed, b.head.runs, verdict)
    return Sum(closed, head, tail, a.head_kind, b.tail_kind)


def finished(s: Sum, verdict: Verdict) -> dict[str, int]:
    """Sizes of all passages by language, where nothing stands before and behind."""
    closed = dict(s.closed)
    for p in (s.head, s.tail):
        if p is not None:
            close(closed, p.runs, verdict)
    return closed
