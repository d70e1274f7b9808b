"""Exponentially weighted mean without a sequential loop and without a horizon.

Semantics: ``ewm(alpha, adjust=False)`` with missing values kept in place.
The first valid value seeds the average; a missing value repeats the last
average; after ``g`` missing rows the next valid ``x`` gives
``y = (d^(g+1) * y_prev + alpha * x) / (d^(g+1) + alpha)`` with ``d = 1 - alpha``.

Every valid row after the first of its block is an affine map ``y -> A*y + b``; the
average at a row is the composition of all maps up to it. It is taken exactly, in
three levels:

* inside a block of ``BLOCK_ROWS`` rows by running window aggregates: with the
  average ``y1`` at the block's first valid row, ``P = prod(A)`` and ``Q = sum(b / P)``,
  the average is ``P * (y1 + Q)``. A block is short enough that ``P`` stays far from
  underflow. Blocks subdivide the segments by which the rows are dealt already, so
  their windows and sums need no exchange;
* a block is summed up by its first valid position and value, its last valid
  position and its map from ``y1`` to its end; the summaries of a segment (65,536 rows),
  an array of at most 128 elements, compose to that of the segment, and those of ``FAN``
  segments to that of a stretch;
* one summary a stretch (16 million rows) is folded along the key.

The fold's result goes back down: the state before each stretch, segment and block.
A row finds its block's state in the array of its segment, joined on (key, segment) by
which the rows lie. Only summaries move, and no task holds more of a key than a block
of rows or an array of summaries. Ratios of two averages (RSI, DI, ADX) stay right
however long a flat stretch or gap lasts, because nothing old is cut off. A series can
also go on from a stored state (``before``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SEG, segment

BLOCK_ROWS = 512
FAN = 256
BLK, STRETCH = "_blk", "_stretch"
#: Least weight of the past after a gap; keeps the products of a block in range.
LEAST = 1e-30
UNB = Window.unboundedPreceding


def with_ewm(df: DataFrame, keys: Sequence[str], cols: dict[str, str], alpha: float,
             idx: str = "idx", block_rows: int = BLOCK_ROWS, fan: int = FAN, seg: str = SEG,
             before: DataFrame | None = None) -> DataFrame:
    """Add ``out = ewm(src)`` for each ``out: src`` in ``cols``, evaluated together.

    ``idx`` is the position of a row inside its key (``keys``), without gaps, and ``seg`` a
    column of segments of it; rows that are dealt by (keys, seg) are not moved. Without
    that column the rows are dealt here. ``before`` may hold, by key, the average and the
    last valid position before the first row: ``_y_<out>`` and ``_l_<out>``. The
    projections are SQL text: one call each instead of thousands of Column objects.
    """
    outs, al = list(cols), f"{float(alpha)!r}D"
    ks = [f"`{c}`" for c in keys]
    names = [f"`{c}`" for c in df.columns]
    if seg not in df.columns:
        df = segment(df, idx).withColumnRenamed(SEG, seg).repartition(*keys, seg)
    over = f"OVER (PARTITION BY {', '.join(ks)}, {seg}, {BLK} ORDER BY `{idx}` ROWS BETWEEN UNBOUNDED PRECEDING AND"

    def past(steps: str) -> str:
        return f"greatest(exp(CAST({steps} AS DOUBLE) * {math.log(1.0 - alpha)!r}D), {LEAST!r}D)"

    # rows: position of the last valid row of the block before each, then P and Q
    cur = df.selectExpr("*", f"floor(`{idx}` / {int(block_rows)}) AS {BLK}")
    cur = cur.selectExpr("*", *[f"max(CASE WHEN `{src}` IS NOT NULL THEN `{idx}` END) {over} 1 PRECEDING) AS `_pv_{o}`" for o, src in cols.items()])
    maps = []
    for o, src in cols.items():
        still, p = f"`{src}` IS NULL OR `_pv_{o}` IS NULL", past(f"`{idx}` - `_pv_{o}`")
        maps += [f"CASE WHEN {still} THEN 1.0D ELSE {p} / ({p} + {al}) END AS `_A_{o}`", f"CASE WHEN {still} THEN 0.0D ELSE {al} * `{src}` / ({p} + {al}) END AS `_b_{o}`"]
    cur = cur.selectExpr("*", *maps)
    cur = cur.selectExpr("*", *[f"exp(sum(ln(`_A_{o}`)) {over} CURRENT ROW)) AS `_P_{o}`" for o in outs])
    kept = dict.fromkeys([*names, f"`{seg}`", BLK, *[f"`_pv_{o}`" for o in outs], *[f"`_P_{o}`" for o in outs]])
    cur = cur.selectExpr(*kept, *[f"sum(`_b_{o}` / `_P_{o}`) {over} CURRENT ROW) AS `_Q_{o}`" for o in outs])

    # summaries (f, fx: first valid position and value; l: last valid position; a, b: map from there to the end),
    # one row a block and average, so that every fold below is written once
    def valid(src: str) -> str:
        return f"CASE WHEN `{src}` IS NOT NULL THEN `{idx}` END"

    kind = "STRUCT<f: BIGINT, fx: DOUBLE, l: BIGINT, a: DOUBLE, b: DOUBLE>"
    parts = [f"CAST(struct(min({valid(src)}), min_by(`{src}`, {valid(src)}), max({valid(src)}), min(`_P_{o}`), min(`_P_{o}`) * max_by(`_Q_{o}`, `{idx}`)) AS {kind}) AS `{o}`"
             for o, src in cols.items()]
    ko = [*ks, "_o"]
    p = past("x.s.f - acc.l")
    both = (f"CAST(struct(acc.f, acc.fx, x.s.l, x.s.a * {p} / ({p} + {al}) * acc.a, "
            f"x.s.a * ({p} / ({p} + {al}) * acc.b + {al} * x.s.fx / ({p} + {al})) + x.s.b) AS {kind})")
    composed = (f"aggregate(_items, CAST(struct(NULL, NULL, NULL, 1.0D, 0.0D) AS {kind}), "
                f"(acc, x) -> CASE WHEN x.s.f IS NULL THEN acc WHEN acc.f IS NULL THEN x.s ELSE {both} END) AS s")

    def gathered(table: DataFrame, by: list[str], item: str) -> DataFrame:
        """One row for each ``by`` and average with the array ``_items`` of its (item, summary), in order."""
        return table.groupBy(*by, "_o").agg(F.expr(f"array_sort(collect_list(struct({item}, s))) AS _items"))

    def first(y: str, last: str, x: str) -> str:
        """Average at a summary's first valid row, from the state (y, last) before it."""
        p = past(f"{x}.f - {last}")
        return f"CASE WHEN {last} IS NULL THEN {x}.fx ELSE ({p} * {y} + {al} * {x}.fx) / ({p} + {al}) END"

    # state (y, l) before each of the items, from that before all of them
    state = "STRUCT<y: DOUBLE, l: BIGINT>"
    fold = f"STRUCT<seen: ARRAY<{state}>, s: {state}>"
    states = (f"aggregate(_items, CAST(struct(array(), struct(_y, _l)) AS {fold}), (acc, x) -> CAST(struct(concat(acc.seen, array(acc.s)), "
              f"CASE WHEN x.s.f IS NULL THEN acc.s ELSE CAST(struct(x.s.a * {first('acc.s.y', 'acc.s.l', 'x.s')} + x.s.b, x.s.l) AS {state}) END) AS {fold})).seen AS _states")

    def spread(table: DataFrame, item: str) -> DataFrame:
        """One row an item with the state before it: ``_y``, ``_l``."""
        return table.selectExpr(*ko, "_items", states).selectExpr(*ko, "explode(arrays_zip(_items, _states)) AS _z").selectExpr(
            *ko, f"_z._items.`{item}` AS `{item}`", "_z._states.y AS _y", "_z._states.l AS _l")

    each = ", ".join(f"struct('{o}' AS _o, `{o}` AS s)" for o in outs)
    blocks = cur.groupBy(*keys, seg, BLK).agg(*map(F.expr, parts)).selectExpr(*ks, f"`{seg}`", BLK, f"inline(array({each}))")
    segs = gathered(blocks, [*keys, seg], BLK)
    stretches = gathered(segs.selectExpr(*ko, f"`{seg}`", f"floor(`{seg}` / {int(fan)}) AS {STRETCH}", composed), [*keys, STRETCH], f"`{seg}`")
    line = gathered(stretches.selectExpr(*ko, STRETCH, composed), list(keys), STRETCH)
    if before is None:
        line = line.selectExpr("*", "CAST(NULL AS DOUBLE) AS _y", "CAST(NULL AS BIGINT) AS _l")
    else:
        given = ", ".join(f"struct('{o}' AS _o, `_y_{o}` AS _y, `_l_{o}` AS _l)" for o in outs)
        line = line.join(before.selectExpr(*ks, f"inline(array({given}))"), [*keys, "_o"], "left")
    by = [*keys, "_o"]
    starts = segs.join(spread(stretches.join(spread(line, STRETCH), [*by, STRETCH]), seg), [*by, seg]).selectExpr(*ko, f"`{seg}`", "_items", states)
    starts = starts.selectExpr(*ko, f"`{seg}`", f"_items[0].{BLK} AS _b0",
                               f"struct(_states.y AS y0, transform(_items, (x, j) -> {first('_states[j].y', '_states[j].l', 'x.s')}) AS y1) AS _s")
    starts = starts.groupBy(*keys, seg).agg(F.min("_b0").alias("_b0"), F.map_from_entries(F.collect_list(F.struct("_o", "_s"))).alias("_m"))
    starts = starts.selectExpr(*ks, f"`{seg}`", "_b0", *[e for o in outs for e in (f"_m['{o}'].y0 AS `_y0_{o}`", f"_m['{o}'].y1 AS `_y1_{o}`")])

    at = f"CAST({BLK} - _b0 AS INT)"
    return cur.join(starts, [*keys, seg]).selectExpr(*names, *[
        f"CASE WHEN `_pv_{o}` IS NULL AND `{src}` IS NULL THEN get(`_y0_{o}`, {at}) ELSE `_P_{o}` * (get(`_y1_{o}`, {at}) + `_Q_{o}`) END AS `{o}`" for o, src in cols.items()])
