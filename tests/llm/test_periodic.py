"""Runs of words against brute force, the rewriting of the query, edge rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

from barspark.llm import periodic
from barspark.llm.registry import QUERIES

RND = random.Random(12)


def brute_runs(s):
    """Maximal stretches with ``w[k] == w[k + q]``, by every period, smallest period only."""
    out = []
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(s[k] == s[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_of(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rs = brute_runs(w)
    best = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rs else None
    gone = {i for a, n, q in rs for i in range(a + q, a + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(rs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{n},{q}\n" for a, n, q in rs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def text_of(rnd):
    s, kinds = [], rnd.choice([1, 2, 3, 8])
    for _ in range(rnd.randint(0, 8)):
        block = [f"w{rnd.randrange(kinds)}" for _ in range(rnd.randint(1, 7))]
        s += block * rnd.choice([1, 1, 2, 4, 7]) + block[:rnd.randint(0, 3)]
        if rnd.random() < 0.3:
            s.append(f"rare{rnd.random()}")
    return rnd.choice([" ", "\n", "\t ", "\x0b"]).join(s)


def test_runs_are_those_of_brute_force():
    for _ in range(3000):
        w = text_of(RND).encode().split()
        assert periodic.runs(w) == brute_runs(w)
    w = [b"a", b"b", b"a"] * 4000
    assert periodic.runs(w) == [(0, 12_000, 3)]


def test_squares_of_lower_power():
    """The walk itself finds every maximal repetition, not only those of four periods."""
    for _ in range(300):
        s = [RND.randrange(2) for _ in range(RND.randint(0, 30))]
        want = []
        for q in range(1, len(s) // 2 + 1):
            for i in range(len(s)):
                n = q + next((k for k in range(len(s) - i - q) if s[i + k] != s[i + q + k]), max(0, len(s) - i - q))
                if n >= 2 * q and (i == 0 or s[i - 1] != s[i + q - 1]) and not any(all(s[k] == s[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                    want.append((i, n, q))
        assert periodic.squares(s, power=2, least=2) == sorted(want, key=lambda r: (r[0], r[2]))


def test_query_against_brute_force(spark, tmp_path):
    rows = [(None, "a " * 9, "x"), (None, None, None), (0, "", "x"), (1, " \t\n ", None), (2, None, "y"), (3, "é ü " * 12, "y"), (3, "é ü " * 12, "y"),
            (4, "x" * 4000 + " y" * 3000, "z")]
    rows += [(k, text_of(RND), "runs") for k in range(5, 300)]
    rows += [(k, " ".join(f"v{RND.randrange(400)}" for _ in range(RND.randint(1, 300))), "best_run") for k in range(300, 400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((row_of(i, t) for i, t, _ in rows), key=repr)
    assert sum(r[1] for r in got) > 200


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, collapsed int")
    out = periodic.detect(docs)
    assert out.columns == ["doc_id", "runs", "best_run", "collapsed"] and out.count() == 0
