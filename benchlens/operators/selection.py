"""Exact order statistics of numeric columns, found by narrowing intervals instead of sorting.

Each pass is one aggregation over all columns at once.  It counts the values below, at and inside the
interval that still holds a wanted value, and sketches the inside; the next interval is a narrow bracket
around the wanted rank in that sketch, a few thousandths of the one before.  Once few values are left
inside, they alone are read.  What is counted decides, so the result is exact however good the sketch is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interval with no more values than this is read as a list.
FEW = 4096
#: Error of a sketch as a share of its values, inverted; brackets lie ``SLACK`` of the values to each side.
ACCURACY, SLACK = 2000, 0.002
#: Intervals that one aggregation narrows at once.
AT_ONCE = 64


@dataclass
class _Search:
    """The wanted rank (from 0) of a column; open bounds (None: unbounded) with ``below`` values under them and inside ``n``."""

    column: str
    rank: int
    n: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def inside(self) -> Column:
        x = F.col(self.column)
        return x.isNotNull() & (F.lit(True) if self.low is None else x > self.low) & (F.lit(True) if self.high is None else x < self.high)


def _narrow(values: DataFrame, searches: list[_Search]) -> None:
    """Two aggregations: brackets out of sketches of the insides, then counts around them."""
    asked = []
    for k, s in enumerate(searches):
        at = (s.rank - s.below + 0.5) / s.n
        shares = [F.lit(max(0.0, at - SLACK)), F.lit(min(1.0, at + SLACK))]
        asked.append(F.percentile_approx(F.when(s.inside(), F.col(s.column)), F.array(*shares), ACCURACY).alias(f"s{k}"))
    brackets = values.agg(*asked).first()
    counts = []
    for k, s in enumerate(searches):
        x, (a, b) = F.col(s.column), brackets[f"s{k}"]
        tests = {"under": x < a, "at_low": x == a, "within": (x > a) & (x < b), "at_high": (x == b) & F.lit(b > a)}
        counts += [F.count(F.when(s.inside() & t, 1)).alias(f"{name}{k}") for name, t in tests.items()]
    got = values.agg(*counts).first()
    for k, s in enumerate(searches):
        a, b = brackets[f"s{k}"]
        under, at_low, within, at_high = (got[f"{name}{k}"] for name in ("under", "at_low", "within", "at_high"))
        place = s.rank - s.below
        if place < under:
            s.high, s.n = a, under
        elif place < under + at_low:
            s.found = a
        elif place < under + at_low + within:
            s.low, s.high, s.below, s.n = a, b, s.below + under + at_low, within
        elif place < under + at_low + within + at_high:
            s.found = b
        else:
            s.low, s.below, s.n = b, s.below + under + at_low + within + at_high, s.n - under - at_low - within - at_high


def order_statistics(values: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int]) -> dict[str, list[float]]:
    """The values of given ranks (from 0, among non-null values) of double columns without NaN.

    ``counts`` has each column's number of values.  ``values`` is read a few times: it should be a table.
    """
    searches = [_Search(c, r, counts[c]) for c, wanted in ranks.items() for r in sorted(set(wanted))]
    while todo := [s for s in searches if s.found is None and s.n > FEW]:
        for k in range(0, len(todo), AT_ONCE):
            _narrow(values, todo[k : k + AT_ONCE])
    last = [s for s in searches if s.found is None]
    for k in range(0, len(last), AT_ONCE):
        part = last[k : k + AT_ONCE]
        lists = values.agg(*[F.sort_array(F.collect_list(F.when(s.inside(), F.col(s.column)))).alias(f"v{i}") for i, s in enumerate(part)]).first()  # FEW values each at most
        for i, s in enumerate(part):
            s.found = lists[f"v{i}"][s.rank - s.below]
    known = {(s.column, s.rank): s.found for s in searches}
    return {c: [known[c, r] for r in wanted] for c, wanted in ranks.items()}


def medians(values: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column; the mean of the middle two for even counts, null without values."""
    counts = values.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    held = [c for c in columns if counts[c]]
    found = order_statistics(values, {c: [(counts[c] - 1) // 2, counts[c] // 2] for c in held}, counts)
    return {c: 0.5 * found[c][0] + 0.5 * found[c][1] if c in found else None for c in columns}
