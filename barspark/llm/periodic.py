"""Periodic runs of words: suffix automaton and link-cut access.

The suffix links of a text's automaton form a tree whose nodes stand for its
substrings by their ends. Every node keeps the end of its last occurrence. When
word ``i`` is appended, the path from the prefix's node to the root becomes one
preferred path of colour ``i``: link-cut ``access`` walks it segment by segment, a
segment being the part that was last seen at one earlier end ``e``. Its deepest
node has the length ``L`` of the longest common suffix of the prefixes ending at
``e`` and ``i``; with ``p = i - e <= L`` the last ``L + p`` words are a square of
period ``p``, which cannot be extended to the left, and ``p`` is their smallest
period (a smaller one would have shown the same words at a later end). If the next
word does not continue it, it is a maximal run. Amortised, an append walks
O(log n) segments. The automaton is complete before the walk starts, so that the
tree is never cut and relinked elsewhere; preferred paths are splay trees.

Only runs of at least ``MIN_POWER`` periods and ``MIN_WORDS`` words count. Each of
their words is there ``MIN_POWER`` times within the run, so a word that is rarer in
a stretch of the text lies in no run and no run reaches across it: the text is cut
at such words until none is left, and every remaining stretch gets an automaton of
its own. This is exact and leaves little of ordinary prose.

A text is a row and is worked on by one task in memory of the order of its words;
rows are spread by Spark, nothing is shuffled.

Defined results: null, empty and blank texts have no words, no runs and an empty
collapsed text; repeated rows get equal results; null ids and extra columns are
carried through, columns named like a result are replaced; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_slices

MIN_POWER = 4
MIN_WORDS = 6
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest string) of each state and the state of each prefix; 1 is the root, 0 is none."""
    link, longest, step, ends = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for n, c in enumerate(s, 1):
        cur = len(link)
        link.append(1)
        longest.append(n)
        step.append({})
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                step.append(dict(step[q]))
                link[q] = link[cur] = clone
                while p and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        ends.append(cur)
        last = cur
    return link, longest, ends


def squares(s: list[int], power: int = MIN_POWER, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of ``s`` with at least ``power`` (2 or more) periods and ``least`` words."""
    up, longest, ends = automaton(s)              # up: parent in the splay tree, or of the whole path where there is none
    size, n = len(up), len(s)
    left, right, colour = [0] * size, [0] * size, [-1] * size  # left: nearer to the root; colour: kept at the top of a splay tree
    found = []

    def lift(x: int) -> None:
        """Rotate x over its parent."""
        y = up[x]
        z = up[y]
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        else:
            colour[x] = colour[y]
        up[x], up[y] = z, x
        if left[y] == x:
            left[y] = m = right[x]
            right[x] = y
        else:
            right[y] = m = left[x]
            left[x] = y
        if m:
            up[m] = y

    def splay(x: int) -> None:
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                lift(y if (left[y] == x) == (left[z] == y) else x)
            lift(x)

    for i, x in enumerate(ends):
        below = 0
        while x:
            splay(x)
            e = colour[x]
            if e >= 0:
                length, p = longest[x], i - e
                if p <= length and length + p >= max(least, power * p) and (i + 1 == n or s[i + 1] != s[i + 1 - p]):
                    found.append((i - length - p + 1, length + p, p))
            if r := right[x]:
                colour[r] = e
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def stretches(ids: np.ndarray, times: int = MIN_POWER, least: int = MIN_WORDS) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the stretches without an id below 0 in which every id is there ``times`` times."""
    out, todo = [], [(0, ids)]
    while todo:
        at, a = todo.pop()
        if len(a) < least:
            continue
        kinds, number, count = np.unique(a, return_inverse=True, return_counts=True)
        rare = np.flatnonzero((count < times)[number] | (a < 0))
        if not len(rare):
            out.append((at, number))
            continue
        cuts = np.concatenate([[-1], rare, [len(a)]])
        for k in np.flatnonzero(np.diff(cuts) > least):
            todo.append((at + int(cuts[k]) + 1, a[cuts[k] + 1:cuts[k + 1]]))
    return sorted(out, key=lambda x: x[0])


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    often = {w: k for k, (w, c) in enumerate(Counter(words).items()) if c >= MIN_POWER}
    if not often:
        return []
    ids = np.fromiter((often.get(w, -1) for w in words), np.int64, len(words))
    return [(at + a, n, p) for at, part in stretches(ids) for a, n, p in squares(part.tolist())]


def longest_power(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: least start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """Words joined by a space, without those that only repeat a run's first period."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for at, n, p in found:
        edge[at + p] += 1
        edge[at + n] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def detect(docs: DataFrame, text_col: str = "text", names: tuple[str, str, str] = ("runs", "best_run", "collapsed")) -> DataFrame:
    """The columns of ``docs`` without its texts, and the runs, the one of greatest power and the text without repeats."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (*names, text_col)]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").cast("binary").alias("_words_of"))
    schema = T.StructType(rows.schema.fields[:-1])
    schema = schema.add(names[0], T.ArrayType(RUN)).add(names[1], RUN).add(names[2], "string")
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def work(batches):
        for part in text_slices(batches):
            found, best, text = [], [], []
            for t in part.column(part.num_columns - 1):
                words = (t.as_py() or b"").split()
                r = runs(words)
                found.append(r)
                best.append(longest_power(r))
                text.append(collapsed(words, r).decode("utf-8", "surrogatepass"))
            as_rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
            tops = [b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best]
            yield pa.RecordBatch.from_arrays(part.columns[:-1] + [pa.array(as_rows, pa.list_(kind)), pa.array(tops, kind), pa.array(text, pa.string())], names=keep + list(names))

    return rows.mapInArrow(work, schema)
