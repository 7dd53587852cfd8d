"""Exact quantiles of many columns by refinement, without sorting the table or merging sketches.

A first pass gives rows, minimum and maximum of each column. Every further pass lays a grid of
equal cells over the spans that still hold a wanted rank, and counts rows per column and
cell, with the least and the largest value of the cell; the counts of all tasks are merged by
column and cell, spread over the shuffle. The cell of a rank becomes a span of the next pass,
bounded by its own least and largest value, until both are the same: that is the value. The
driver sees the cells, ``ALL_CELLS`` at most per pass, however many rows there are. Outliers
cost a pass and no more, as spans shrink to the values that are there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import number_sql

ALL_CELLS = 1 << 17  # of all columns and spans together
SPAN_CELLS = 4096  # of one span, at most
LARGEST = 1.7976931348623157e308


@dataclass
class _Span:
    low: float
    high: float
    before: int  # rows of smaller values
    ranks: list[int]


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column; None for a column without values."""
    columns = list(columns)
    numbers = df.select(*(_number(c).alias(f"v{i}") for i, c in enumerate(columns)))
    ends = numbers.agg(
        *(F.struct(F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("low"), F.max(f"v{i}").alias("high")).alias(f"v{i}") for i in range(len(columns)))
    ).first() if columns else ()
    sizes = [e["n"] for e in ends]
    ranks = [sorted({r for p in probabilities for r in _ranks(n, p)}) if n else [] for n in sizes]
    found = _values_at(numbers, {i: _Span(ends[i]["low"], ends[i]["high"], 0, r) for i, r in enumerate(ranks) if r})
    return {
        c: [_interpolate(found[i], sizes[i], p) for p in probabilities] if sizes[i] else None for i, c in enumerate(columns)
    }


def values_at_ranks(numbers: DataFrame, ranks: Sequence[Sequence[int]]) -> list[dict[int, float]]:
    """Per column v0, v1, ... the values at zero-based ranks, which must lie below its number of values."""
    ends = numbers.agg(*(F.struct(F.min(f"v{i}").alias("low"), F.max(f"v{i}").alias("high")).alias(f"v{i}") for i in range(len(ranks)))).first() if ranks else ()
    spans = {i: _Span(ends[i]["low"], ends[i]["high"], 0, sorted(set(r))) for i, r in enumerate(ranks) if r}
    found = _values_at(numbers, spans)
    return [found.get(i, {}) for i in range(len(ranks))]


def _ranks(n: int, p: float) -> tuple[int, int]:
    position = (n - 1) * p
    return math.floor(position), math.ceil(position)


def _interpolate(values: dict[int, float], n: int, p: float) -> float:
    low, high = _ranks(n, p)
    share = (n - 1) * p - low
    if values[low] == values[high]:
        return values[low]
    return values[low] + (values[high] - values[low]) * share


def _values_at(numbers: DataFrame, whole: dict[int, _Span]) -> dict[int, dict[int, float]]:
    """Values at zero-based ranks of the columns v0, v1, ..."""
    found: dict[int, dict[int, float]] = {i: {} for i in whole}
    spans = {i: [s] for i, s in whole.items()}
    rows = numbers.select(*(f"v{i}" for i in spans), *(F.expr(f"IF(v{i} IS NOT NULL, 1, 0)").alias(f"s{i}") for i in spans))
    while True:
        for i in list(spans):
            for span in spans[i]:
                if span.low == span.high:
                    found[i].update((r, span.low) for r in span.ranks)
            if all(span.low == span.high for span in spans[i]):
                del spans[i]
        if not spans:
            return found
        rows, spans = _refine(rows, spans)


def _refine(rows: DataFrame, spans: dict[int, list[_Span]]) -> tuple[DataFrame, dict[int, list[_Span]]]:
    """Counts the cells of all spans. Returns the rows, each with its span among the new ones, and those.

    s<i> is the row's span in column i, from 1, and 0 outside of all.
    """
    cells = max(2, min(SPAN_CELLS, ALL_CELLS // sum(map(len, spans.values()))))
    placed = rows.select(
        *(f"v{i}" for i in spans),
        *(F.expr(_cell_sql(f"v{i}", f"s{i}", s, cells)).alias(f"c{i}") for i, s in spans.items()),
    )
    columns = list(spans)
    each = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("c"), F.col(f"v{i}").alias("v")) for i in columns)), lambda x: x["c"] >= 0)
    counts = (
        placed.select(F.inline(each))
        .groupBy("i", "c")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .toArrow()
    )
    by_column: dict[int, list[tuple]] = {i: [] for i in columns}
    for i, *cell in sorted(zip(*(c.to_pylist() for c in counts.columns), strict=True)):
        by_column[i].append(cell)
    nearer = {i: _choose(spans[i], by_column[i], cells) for i in columns}
    chosen = {i: [c for c, _ in nearer[i]] for i in columns}
    rows = placed.select(
        *(f"v{i}" for i in columns),
        *(F.expr(f"CAST(array_position(array({', '.join(map(str, chosen[i]))}), c{i}) AS INT)").alias(f"s{i}") for i in columns),
    )
    return rows, {i: [s for _, s in nearer[i]] for i in columns}


def _cell_sql(v: str, s: str, spans: list[_Span], cells: int) -> str:
    """The row's cell, counted through all spans of its column; -1 outside."""
    def per_span(values) -> str:
        return f"element_at(array({', '.join(map(number_sql, values))}), {s})"

    lows = [max(x.low, -LARGEST) for x in spans]
    # halves, as the width of a span may exceed the largest double
    halves = [min(x.high, LARGEST) / 2 - low / 2 for x, low in zip(spans, lows, strict=True)]
    scales = [min(cells / h, LARGEST) if h else 0.0 for h in halves]
    place = f"CAST(FLOOR(({v} / 2 - {per_span(lows)} / 2) * {per_span(scales)}) AS BIGINT)"
    return f"IF({s} > 0, ({s} - 1) * {cells} + CAST(GREATEST(0, LEAST({cells - 1}, {place})) AS INT), -1)"


def _choose(spans: list[_Span], counted: list[tuple], cells: int) -> list[tuple[int, _Span]]:
    """The cells that hold a wanted rank, as spans. ``counted`` is ordered by cell."""
    out, at = [], 0
    for number, span in enumerate(spans):
        before, wanted = span.before, list(span.ranks)
        while at < len(counted) and counted[at][0] < (number + 1) * cells:
            cell, n, low, high = counted[at]
            inside = [r for r in wanted if r < before + n]
            if inside:
                out.append((cell, _Span(low, high, before, inside)))
                wanted = wanted[len(inside):]
            before += n
            at += 1
    return out
