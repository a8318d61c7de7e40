"""Point-based scoring rules as plain column expressions.

A rule is a pair (points, note). Points are added as doubles in the order the rules are listed: the pass
marks are float sums, so the order decides on which side of a mark a borderline total falls.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    points: Column
    note: Column


def _text(note) -> Column:
    return note if isinstance(note, Column) else F.lit(note).cast("string")


def rule(cond: Column, points: float, note: Column | str | None = None) -> Rule:
    return ladder((cond, points, note))


def ladder(*steps: tuple) -> Rule:
    """The first step whose condition holds gives points and note; the others give nothing."""
    points = note = None
    for step in steps:
        cond, pts, txt = step if len(step) == 3 else (*step, None)
        pts, txt = F.lit(float(pts)), _text(txt)
        points = F.when(cond, pts) if points is None else points.when(cond, pts)
        note = F.when(cond, txt) if note is None else note.when(cond, txt)
    return Rule(points.otherwise(F.lit(0.0)), note)


def total(rules: list[Rule], start: float = 0.0) -> Column:
    s = F.lit(start)
    for r in rules:
        s = s + r.points
    return s


def notes(rules: list[Rule], sep: str, empty: str) -> Column:
    """The notes of the rules that applied, joined; a fallback text when none did."""
    joined = F.concat_ws(sep, *[r.note for r in rules])
    return F.when(joined == "", F.lit(empty)).otherwise(joined)


def reasons(*cases: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in cases]))
