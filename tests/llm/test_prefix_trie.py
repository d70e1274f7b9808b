"""Trie nodes against a brute-force trie, in bands of both kinds; edge rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from barspark.llm import prefix_trie
from barspark.llm.registry import QUERIES

RND = random.Random(11)
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:30], (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []

    def sums(k):
        leaves, saved = (0, 0) if k in kids else (1, 0)
        if k:
            saved += (len(nodes[k]) - 1) * len(k[-1][1].encode())
        for child in kids.get(k, ()):
            a, b = sums(child)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(nodes[k]) if len(built[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids.get(k, ())), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        sums(())
    return sorted(out, key=repr)


def conversations():
    rows = [(None, 0, "user", "a"), (3, None, None, None), (3, None, "user", "é"), (3, 0, "user", "é"), (3, 0, "user", "é"), (4, 7, None, "")]
    texts = ["hello", "yes", "no", "ünd", "", "a much longer turn of the other side " * 5]
    for c in [*range(10, 90), 10_000, 10_001, 50_005, 9_000_000_001]:
        for t in range(RND.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, 2 * t + 1, RND.choice(["user", "assistant", "user", None]), RND.choice(texts[:2] if t < 3 else texts)))
    for c in range(100, 130):                              # long conversations that part late
        rows += [(c, t, "user", "same" if t < 20 or RND.random() < 0.9 else RND.choice(texts)) for t in range(RND.choice([12, 28, 29, 40]))]
    rows += [(c, t, "user", "copy") for c in range(200, 300) for t in range(4)]
    RND.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [None, 40])
def test_nodes_against_brute_force(spark, tmp_path, limit, monkeypatch):
    if limit:
        monkeypatch.setattr(prefix_trie, "GROUP_TURNS", limit)   # deep bands level by level
        monkeypatch.setattr(prefix_trie, "IDS", 16)
    rows = conversations()
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_prefix_trie"](spark, str(tmp_path)).count() == 0


def test_bands_cover_all_depths():
    for deepest in (0, 1, 8, 9, 31, 32, 33, 400, 100_000):
        cuts = prefix_trie.edges(deepest)
        assert cuts[0] == 0 and cuts[-1] >= deepest and cuts == sorted(set(cuts))
