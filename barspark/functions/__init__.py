"""Scalar column functions of the engine (all JVM-side expressions).

* ``parse_ts``      text -> TIMESTAMP_NTZ trying the accepted formats in order
* ``ts_lit``        zone-independent TIMESTAMP_NTZ literal
* ``epoch_seconds`` wall-clock seconds since 1970-01-01 (no time zone involved)
* ``condor_pnl``    (pnl, outcome) of an iron condor valued at a price
* ``strikes_sql``   short strikes and wings of an entry, as SQL expressions
"""

from ..operators.positions import condor_pnl, strikes_sql
from ..operators.quality import parse_ts
from ..plans.ordered import epoch_seconds
from ..session import ts_lit

__all__ = ["parse_ts", "ts_lit", "epoch_seconds", "condor_pnl", "strikes_sql"]
