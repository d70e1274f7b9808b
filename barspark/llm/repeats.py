"""Removal of long repeated passages with run-length compressed suffix indexes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else.

Dealing the work: every window is owned by its anchor, the leftmost of its grams of
``GRAM`` bytes whose hash is least. The anchor depends on the window's bytes alone, so
equal windows lie in the group of one anchor hash. Consecutive windows with the same
anchor make a piece: its bytes hold exactly those windows, so over all pieces every
window of the corpus is there once, and a match of ``WINDOW`` bytes between two
places of a group is a match between two different places of the corpus. A text
has a piece about every 85 bytes; what moves is its two hashes and its place.
Groups that hold one piece only are done. Equal pieces are counted, not moved.

Index: pieces of the other groups, different ones only, are fetched and indexed,
complete groups together. The Burrows-Wheeler transform of a task's pieces is cut into
its runs, and the suffix array is sampled at the two ends of every run. The match of
a suffix with its neighbour in the suffix array is computed at those samples alone:
at any other place it is that of the place before it, one byte shorter, since
stepping back inside a run keeps neighbours together. Streaming the text over the samples thus
gives at every place the longest match with any other place (the matching statistics
of the collection against itself), and a place of at least ``WINDOW`` bytes starts a
repeated window. A piece that occurs more than once matches in full.

Hot groups: equal pieces weigh one row, so a group is large only when a very common
gram stands in many different surroundings. A group of over ``GROUP`` different
pieces is dealt anew: the windows of each piece are divided by their distance from
the anchor into blocks of fixed distances; all windows of a block share a longer core, and the
core's hash is the new group. The last division has blocks of one window, whose
group holds one piece, so every group ends small and no window is left out.

Defined results: null and empty texts have no bytes and no spans; repeated rows repeat
each other (their bytes go, if long enough); ids may be null or repeated, as rows are
known by id and text together; extra columns are carried through, columns named like a
result are replaced; texts shorter than a window stay; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, mix, release, ship, stored, text_slices

WINDOW = 200
GRAM = 32
#: Most different pieces of one anchor that a task indexes together.
GROUP = 2048
#: Distances from the anchor that stay together when a hot group is dealt anew.
BLOCKS = (16, 1)
#: Bytes of text whose grams are hashed at a time, and of pieces that are indexed at a time.
CHUNK, INDEXED = 1 << 19, 1 << 19

_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, CHUNK + WINDOW)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + WINDOW)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each place on."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[:n], out=total[1:])
    return mix((total[GRAM:] - total[:-GRAM]) * _DOWN[:n - GRAM + 1])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the concatenated texts that end at ``ends``: (first window, windows, place of the anchor, its hash).

    All places count from the start of ``data``. A piece may be cut where a chunk of the work ends.
    """
    wide, found = WINDOW - GRAM + 1, []
    last = np.repeat(ends, np.diff(ends, prepend=0))
    low = np.uint64((1 << 20) - 1)                     # chunks are shorter than 2 ** 20
    for at in range(0, len(data) - WINDOW + 1, CHUNK):
        h = gram_hashes(data[at:at + CHUNK + WINDOW - 1])
        n = len(h)
        keys = np.full(-(-n // wide) * wide, ~np.uint64(0))
        keys[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
        keys = keys.reshape(-1, wide)
        ahead = np.minimum.accumulate(keys, axis=1).ravel()
        behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - wide + 1
        least = (np.minimum(behind[:windows], ahead[wide - 1:wide - 1 + windows]) & low).astype(np.int64)
        end = last[at:at + windows]
        s = np.flatnonzero(np.arange(at + WINDOW, at + WINDOW + windows) <= end)
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = (np.diff(least[s]) != 0) | (np.diff(end[s]) != 0)
        first = np.flatnonzero(new)
        place = least[s[first]]
        found.append((s[first] + at, np.diff(first, append=len(s)), place + at, h[place]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (*[np.empty(0, np.int64)] * 3, np.empty(0, np.uint64))


def places(docs: DataFrame, pieces: bool) -> DataFrame:
    """One row a piece of ``docs`` (doc_id, tx, text as bytes): the anchor's hash h and, if ``pieces``, the piece's hash g and its place."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"h bigint, g bigint, doc_id {kind}, tx bigint, first bigint, own int, lead int" if pieces else "h bigint"

    def run(batches):
        for part in text_slices(batches, most=CHUNK):
            texts = part.column(2).cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
            ends = bounds[1:] - bounds[0]
            first, own, place, h = anchors(data, ends)
            cols = [pa.array(h.view(np.int64))]
            if pieces:
                whole = memoryview(data)
                g = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(first.tolist(), (first + own + WINDOW - 1).tolist(), strict=True)), np.uint64, len(first))
                row = np.searchsorted(ends, first, side="right")
                starts = ends - np.diff(ends, prepend=0)
                cols += [pa.array(g.view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(first - starts[row]),
                         pa.array(own.astype(np.int32)), pa.array((place - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "doc_id", "tx", "first", "own", "lead"][:len(cols)])

    return docs.select("doc_id", "tx", "text").mapInArrow(run, schema)


def suffixes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of bytes cut into pieces by ``ends`` (the place of each piece's terminator) and ranks by depth.

    ``data`` holds byte values + 1, terminators 0. Terminators are ordered by place, so nothing compares beyond one.
    """
    n = len(data)
    at = np.arange(n)
    stop = np.repeat(ends, np.diff(ends, prepend=-1))
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | np.where(at + j < stop, data[np.minimum(at + j, n - 1)], 0)
    depth, ranks, longest = 7, [], int(np.diff(ends, prepend=-1).max())
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        ranks.append((depth, rank))
        if depth >= longest:
            return order, ranks
        key = (rank.astype(np.int64) << 32) | np.where(at + depth <= stop, rank[np.minimum(at + depth, n - 1)], 0)
        depth *= 2


def common(a: np.ndarray, b: np.ndarray, data: np.ndarray, stop: np.ndarray, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, from the ranks of all depths."""
    n, done = len(data), np.zeros(len(a), np.int64)
    most = np.minimum(stop[a] - a, stop[b] - b)
    for depth, rank in reversed(ranks):
        x, y = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
        done += np.where((done < most) & (rank[x] == rank[y]), depth, 0)
    for _ in range(ranks[0][0] - 1):
        x, y = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
        done += (done < most) & (data[x] == data[y])
    return np.minimum(done, most)


def statistics(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Longest match of each place with another place of ``pieces``, the place of each terminator, and the number of runs of the transform."""
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    data[ends] = 0
    stop = np.repeat(ends, np.diff(ends, prepend=-1))
    order, ranks = suffixes(data, ends)
    before = data[order - 1].astype(np.int64)
    before[before == 0] = -1 - order[before == 0]      # every terminator is a letter of its own
    head = np.ones(len(order), bool)
    head[1:] = before[1:] != before[:-1]
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:] - 1, len(order) - 1)
    reach = np.zeros(len(order), np.int64)             # end of the match from a sample
    for rows, step in ((heads[heads > 0], -1), (tails[tails < len(order) - 1], 1)):
        a, b = order[rows], order[rows + step]
        reach[a] = np.maximum(reach[a], a + common(a, b, data, stop, ranks))
    return np.maximum.accumulate(reach) - np.arange(len(order)), ends, len(heads)


def marked(starts: np.ndarray) -> list[int]:
    """Flags as from, to, from, to ..."""
    return np.flatnonzero(np.diff(starts.astype(np.int8), prepend=0, append=0)).tolist()


def indexed(pieces: DataFrame) -> DataFrame:
    """(h, g, marks) of groups of at most ``GROUP`` different pieces (h, g, n, own, bytes); marks: window numbers from, to, ..."""

    def answer(held: dict):
        longest, ends, _ = statistics([v[2] for v in held.values()])
        hs, gs, marks = [], [], []
        for (h, g), (n, own, piece), end in zip(held, held.values(), ends.tolist(), strict=True):
            starts = np.ones(own, bool) if n > 1 else longest[end - len(piece):end - len(piece) + own] >= WINDOW
            if starts.any():
                hs.append(h)
                gs.append(g)
                marks.append(marked(starts))
        return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(gs, pa.int64()), pa.array(marks, pa.list_(pa.int32()))], names=["h", "g", "marks"])

    def run(batches):
        held, size, last = {}, 0, None
        for b in batches:
            for h, g, n, own, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != last and size >= INDEXED:
                    yield answer(held)
                    held, size = {}, 0
                last = h
                if (h, g) not in held:
                    size += len(piece)
                held[h, g] = n, own, piece
        if held:
            yield answer(held)
        release()

    rows = pieces.select("h", "g", "n", "own", "bytes").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, "h bigint, g bigint, marks array<int>")


def dealt_anew(pieces: DataFrame, block: int) -> DataFrame:
    """Windows of each piece by ``block`` distances from the anchor: h0, g0 of the piece, ``at`` its first window here, and the new piece."""

    def run(batches):
        for part in text_slices(batches, most=1 << 16):
            rows = []
            for h, g, n, own, lead, piece in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for b in range((lead - own + 1) // block, lead // block + 1):
                    near, far = b * block, b * block + block - 1      # distances of the block; the farthest window comes first
                    at, to = max(0, lead - far), min(own - 1, lead - near)
                    core = piece[max(0, lead - near):lead - far + WINDOW]
                    sub = piece[at:to + WINDOW]
                    rows.append((h, g, at, xxhash.xxh3_64_intdigest(core, seed=(h ^ (b * _BASE)) & (2**64 - 1)) - (1 << 63), xxhash.xxh3_64_intdigest(sub) - (1 << 63),
                                 n, to - at + 1, lead - at, sub))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h0", "g0", "at", "h", "g", "n", "own", "lead", "bytes"])

    return pieces.select("h", "g", "n", "own", "lead", "bytes").mapInArrow(
        run, "h0 bigint, g0 bigint, at int, h bigint, g bigint, n bigint, own int, lead int, bytes binary")


def resolved(pieces: DataFrame, blocks: tuple[int, ...] = BLOCKS, group: int | None = None) -> DataFrame:
    """(h, g, marks) of pieces (h, g, n, d: different pieces of the anchor, own, lead, bytes)."""
    group = GROUP if group is None else group
    small = indexed(pieces.where(F.col("d") <= group))
    if not blocks or not pieces.where(F.col("d") > group).take(1):
        return small
    hot = pieces.where(F.col("d") > group).dropDuplicates(["h", "g"])
    subs = stored(dealt_anew(hot, blocks[0]))
    kinds = subs.groupBy("h", "g").agg(F.sum("n").alias("n"), F.first("own").alias("own"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    counts = kinds.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("d"))
    kinds = stored(kinds.join(counts.where("total > 1"), "h"))
    whole = kinds.where("d = 1").select("h", "g", F.array(F.lit(0), F.col("own")).alias("marks"))
    found = whole.unionByName(resolved(kinds.where("d > 1"), blocks[1:], group))
    back = subs.select("h0", "g0", "at", "h", "g").join(found, ["h", "g"])
    back = back.select(F.col("h0").alias("h"), F.col("g0").alias("g"), F.transform("marks", lambda m: m + F.col("at")).alias("marks"))
    return small.unionByName(back.groupBy("h", "g").agg(F.flatten(F.collect_list("marks")).alias("marks")))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int | None = None) -> DataFrame:
    """The columns of ``docs`` without its texts, and n_bytes, n_removed, spans (from, to, ... in bytes) and kept (the bytes that stay)."""
    ship(docs.sparkSession)
    new = ("n_bytes", "n_removed", "spans", "kept")
    keep = [c for c in docs.columns if c not in (*new, text_col)]
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("tx"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    known = ["doc_id", "tx"]

    # counts are written before they are joined: both sides of a join are then plain shuffles, whose hot keys Spark can split
    often = stored(places(keyed, False).groupBy("h").count().where("count > 1").select("h"))
    here = stored(places(keyed, True).join(often, "h", "left_semi"))
    every = stored(here.groupBy("h", "g").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*known, "first", "own", "lead")]))
    counts = stored(every.groupBy("h").agg(F.count("*").alias("d")))
    kinds = stored(every.join(counts, "h"))
    drop(often, every, counts)
    whole = kinds.where("d = 1 and n > 1").select("h", "g", F.array(F.lit(0), F.col("own")).alias("marks"))
    wanted = kinds.where("d > 1").groupBy(*known).agg(F.collect_list(F.struct("h", "g", "n", "d", "own", "lead", "first")).alias("wanted"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in known])
    fetched = keyed.join(wanted, same(keyed, wanted)).select(F.explode(F.transform("wanted", lambda w: F.struct(
        *[w[c].alias(c) for c in ("h", "g", "n", "d", "own", "lead")], F.substring("text", (w["first"] + 1).cast("int"), w["own"] + WINDOW - 1).alias("bytes")))).alias("p")).select("p.*")
    fetched = stored(fetched)
    found = stored(whole.unionByName(resolved(fetched, group=group)))
    spans = here.join(found, ["h", "g"]).groupBy(*known).agg(F.collect_set(F.struct("first", "marks")).alias("_marks"))

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_tx"), F.coalesce(text, F.lit("")).cast("binary").alias("_text"))
    spans = spans.select(F.col("doc_id").alias("_sid"), F.col("tx").alias("_stx"), "_marks")
    rows = rows.join(spans, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_tx") == F.col("_stx")), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.expr("transform(_marks, m -> m.first)").alias("_first"), F.expr("transform(_marks, m -> m.marks)").alias("_marks"), "_text")
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("spans", T.ArrayType(T.LongType())).add("kept", "binary")

    def run(batches):
        for part in text_slices(batches):
            n, gone, spans, kept = [], [], [], []
            for text, first, marks in zip(part.column(part.num_columns - 1), *(part.column(part.num_columns - k).to_pylist() for k in (3, 2)), strict=True):
                data = text.as_py()
                cut = merged(first, marks)
                n.append(len(data))
                gone.append(sum(cut[1::2]) - sum(cut[::2]))
                spans.append(cut)
                kept.append(b"".join(data[a:b] for a, b in zip([0, *cut[1::2]], [*cut[::2], len(data)], strict=True)) if cut else data)
            yield pa.RecordBatch.from_arrays(part.columns[:-3] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                                             names=keep + list(new))

    out = stored(rows.mapInArrow(run, schema))
    drop(here, kinds, fetched, found)
    return out


def merged(first: list[int] | None, marks: list[list[int]] | None) -> list[int]:
    """Bytes covered by windows that start at the marked places: from, to, ... in order, without overlaps."""
    parts = sorted((f + a, f + b + WINDOW - 1) for f, m in zip(first or (), marks or (), strict=True) for a, b in zip(m[::2], m[1::2], strict=True))
    out: list[int] = []
    for a, b in parts:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out
