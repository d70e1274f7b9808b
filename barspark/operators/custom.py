"""Indicators that a user writes: a function of column arrays and a declared look-back.

The function gets a segment's rows in time order as numpy arrays (with the ``look_back``
rows before it) and returns one array of equal length; Spark deals the segments,
sends them through Arrow and keeps the segment's own rows. A segment is bounded, so
is what a call sees, and a key of any size is as many calls as it has segments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import params as P
from ..plans import ordered
from .indicators import indexed_bars

#: Rows of a segment that a function sees, without its look-back.
ROWS = 1 << 14


@dataclass(frozen=True)
class Indicator:
    name: str
    inputs: tuple[str, ...]
    look_back: int
    function: Callable[..., np.ndarray]


KNOWN: dict[str, Indicator] = {}


def indicator(name: str, inputs: Sequence[str], look_back: int):
    """Register ``function(*arrays) -> array`` of doubles under ``name``; missing values are NaN both ways.

    A result may depend on the row and the ``look_back`` rows before it only."""
    def add(function):
        KNOWN[name] = Indicator(name, tuple(inputs), int(look_back), function)
        return function
    return add


def with_indicators(bars: DataFrame, names: Sequence[str], keys: Sequence[str] = ("symbol",), bar_seconds: int = P.SMALLEST_BAR_SECONDS, rows: int = ROWS) -> DataFrame:
    """keys, ts, idx and one double column an indicator."""
    keys, wanted = list(keys), [KNOWN[n] for n in names]
    inputs = list(dict.fromkeys(c for i in wanted for c in i.inputs))
    b = indexed_bars(bars, keys, bar_seconds).select(*keys, "ts", "idx", *inputs)
    h = ordered.halo(b, back=max((i.look_back for i in wanted), default=0), seg_rows=rows)
    base = b.select(*keys, "ts", "idx")
    schema = T.StructType([*base.schema.fields, *(T.StructField(i.name, T.DoubleType()) for i in wanted)])
    plain, home = base.columns, ordered.HOME

    def call(part: pa.Table) -> pa.Table:
        part = part.sort_by("idx")
        arrays = {c: part.column(c).cast(pa.float64()).to_numpy() for c in inputs}
        out = {c: part.column(c) for c in plain}
        for i in wanted:
            got = np.asarray(i.function(*(arrays[c] for c in i.inputs)), np.float64)
            if got.shape != (part.num_rows,):
                raise ValueError(f"indicator {i.name} gave {got.shape} for {part.num_rows} rows")
            out[i.name] = pa.array(got, pa.float64(), from_pandas=True)
        return pa.table(out).filter(part.column(home))

    return h.groupBy(*keys, ordered.SEG).applyInArrow(call, schema)
