"""Repeated passages against a window count, the index against brute force, hot groups, edge rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barspark.llm import repeats
from barspark.llm.registry import QUERIES

RND = random.Random(13)
W = repeats.WINDOW


def brute(rows):
    """Every window of every text counted; rows of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + W] for d in data for i in range(len(d) - W + 1))
    out = []
    for (doc_id, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - W + 1):
            if seen[d[i:i + W]] > 1:
                gone[i] += 1
                gone[i + W] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        out.append((doc_id, len(d), int(cut.sum()), int((np.diff(cut.astype(int), prepend=0) > 0).sum()), hashlib.sha256(bytes(x for x, c in zip(d, cut, strict=True) if not c)).hexdigest()))
    return out


def prose(n, kinds=4000):
    return " ".join(f"{RND.choice('bcdfgé')}{RND.randrange(kinds):x}" for _ in range(n))


def corpus():
    passage, line = prose(90), prose(60)
    exact = [passage.encode()[k:k + 199].decode(errors="ignore") for k in (0, 40)]
    rows = [(None, passage), (None, None), (0, ""), (1, " \n"), (2, "x" * 199), (3, "y" * 200), (4, "z" * 201), (5, "ab" * 700), (6, prose(5000) + line + prose(3000)),
            (7, prose(20) + passage[:210] + prose(20)), (8, exact[0] + prose(3)), (9, prose(3) + exact[1]), (10, "\0" * 300 + prose(9)), (11, prose(9) + "\0" * 250), (12, passage), (12, passage)]
    for k in range(20, 120):
        base = prose(RND.randint(1, 120))
        rows.append((k, base))
        for _ in range(RND.choice([0, 0, 1, 3])):              # near copies
            words = base.split()
            for _ in range(RND.randint(0, 3)):
                words[RND.randrange(len(words))] = prose(1)
            rows.append((1000 + len(rows), " ".join(words)))
    rows += [(k, prose(RND.randint(0, 15)) + RND.choice([" ", "\n"]) + line + " " + prose(RND.randint(0, 15))) for k in range(200, 280)]  # many surroundings of one line
    return rows


@pytest.mark.parametrize("group", [None, 4])
def test_removal_against_brute_force(spark, tmp_path, group, monkeypatch):
    if group:
        monkeypatch.setattr(repeats, "GROUP", group)
    rows = corpus()
    spark.createDataFrame([(*r, "spans", 1) for r in rows], "doc_id bigint, text string, kept string, h int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_repeats"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert sum(r[2] > 0 for r in got) > 100


def test_no_rows(spark):
    out = repeats.remove(spark.createDataFrame([], "doc_id string, text string, spans int, x int"))
    assert out.columns == ["doc_id", "x", "n_bytes", "n_removed", "spans", "kept"] and out.count() == 0


def test_matching_statistics():
    for _ in range(60):
        pieces = list({bytes(RND.choice(b"ab\0") for _ in range(RND.randint(1, 5))) * RND.randint(1, 6) + bytes(RND.choice(b"ab") for _ in range(RND.randint(1, 30)))
                       for _ in range(RND.randint(1, 12))})
        longest, ends, runs = repeats.statistics(pieces)
        places = [(p, i) for p in range(len(pieces)) for i in range(len(pieces[p]))]

        def match(a, b):
            x, y = pieces[a[0]][a[1]:], pieces[b[0]][b[1]:]
            return next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))

        for p, i in places:
            want = max((match((p, i), o) for o in places if o != (p, i)), default=0)
            assert longest[ends[p] - len(pieces[p]) + i] == want
        assert runs <= len(places) + len(pieces)


def test_run_count_of_a_repetitive_collection():
    """Near copies add few runs to the transform."""
    base = bytearray(RND.randbytes(300))
    pieces = []
    for k in range(100):
        copy = base.copy()
        copy[RND.randrange(300)] = k
        pieces.append(bytes(copy))
    _, _, runs = repeats.statistics(pieces)
    assert runs < 0.1 * sum(map(len, pieces))


def test_anchors_cut_windows_alike_anywhere():
    text = np.frombuffer(prose(400).encode(), np.uint8)
    first, own, place, h = repeats.anchors(text, np.array([len(text)]))
    assert own.sum() == len(text) - W + 1 and (np.diff(first) == own[:-1]).all()
    for shift in (1, 77):
        moved = repeats.anchors(text[shift:], np.array([len(text) - shift]))
        assert {*zip((moved[2] + shift).tolist(), moved[3].tolist(), strict=True)} <= {*zip(place.tolist(), h.tolist(), strict=True)}
