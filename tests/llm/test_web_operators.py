"""Archives, URL filter, licences, pipeline and query registration."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct

import pytest
import zstandard

import corpus_pipeline
from barspark.llm import licences, url_filter, warc
from barspark.llm.common import bloom_split, scratch_path
from barspark.llm.registry import ORACLES, QUERIES

PAGES = "page_id bigint, url string, html string, payload string, digest string"


def pages():
    big = "<p>" + "long page é " * 40 + "</p>"
    return [(3, "http://a.net/x\r\nEvil: 1", big, None, "d"), (1, "http://b.net/", big, "p", "d"), (1, "http://b.net/", big, "p", "d"),
            (None, None, big, None, None), (5, "u", None, None, None), (6, "u", "", None, None), (7, "u", "short", None, None),
            (8, "u", "short", None, None), (None, "u", "only null ids " * 20, None, None), (None, "u", "only null ids " * 20, None, None),
            (9, "u", "z" * 300_000, None, None), (10, "u", "z" * 300_000, None, None)]


def want(rows):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        ids = [r[0] for r in rows if r[0] is not None and (r[2] or "") == (html or "")]
        first = min(ids, default=None) if len(data) >= 100 else None
        visit = first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if visit else "response", first if visit else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES)
    got = warc.round_trip(df).collect()
    assert all(r.error is None for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == want(pages())
    kept = {r.page_id: r for r in got if r.record_type == "response"}
    assert kept[9].payload == b"z" * 300_000 and kept[5].payload == b""
    assert kept[1].payload.decode() == pages()[1][2]
    assert {r.target_uri for r in got if r.page_id == 3} == {"http://a.net/x%0D%0AEvil: 1"}
    assert warc.round_trip(df.limit(0)).count() == 0


def frame(data):
    return zstandard.ZstdCompressor().compress(data)


def test_archive_format_and_faults(spark):
    body = b"hello" * 30
    good = warc.record(4, "http://x/", body, hashlib.sha256(body).hexdigest(), None)
    visit = warc.record(5, None, body, hashlib.sha256(body).hexdigest(), 4)
    assert warc.parse(good)[0] == 4 and warc.parse(visit)[3:5] == ("revisit", 4)
    faults = {
        "version": good.replace(b"WARC/1.1", b"WARC/9.9"), "block": good[:-6] + b"\r\n\r\n", "digest": good.replace(b"hello", b"jello", 1),
        "missing": good.replace(b"WARC-Record-ID", b"X-Other"), "twice": good.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"),
        "two records": good + good, "payload": good.replace(b"Content-Length: 150", b"Content-Length: 149", 1), "empty": b"",
    }
    for what, data in faults.items():
        with pytest.raises(ValueError):
            warc.parse(data)
            pytest.fail(what)
    dictionary = zstandard.train_dictionary(2000, [good + bytes([k % 250]) * k for k in range(300)])
    head = lambda d: struct.pack("<II", warc.DICTIONARY_MAGIC, len(d)) + d
    packed = zstandard.ZstdCompressor(dict_data=dictionary).compress(good)
    for d in (dictionary.as_bytes(), frame(dictionary.as_bytes())):     # plain or compressed dictionary
        assert list(warc.frames(head(d) + packed + warc.SEPARATOR + packed)) == [good, good]
    rows = [("a", frame(good) + frame(faults["digest"]) + frame(visit)), ("b", frame(good)[:-3]), ("c", frame(good) + b"junk"), ("d", packed), ("e", b""), ("f", None)]
    got = warc.read(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sum(r.error is None for r in got) == 3
    assert sum("archive" in (r.error or "") for r in got) == 3 and sum("digest" in (r.error or "") for r in got) == 1


URLS = [None, "", "no scheme", "http://", "http://A.B.example.NET/en/x", "http://example.net/fr/", "http://net", "http://net/", "ftp://x.org/fr/?q#f",
        "http://org/fr", "http://sub.example.com/de/1.html#top", "http://example.com/d", "http://www.Example.com/p.html?utm_a=1&b=2&utm_c=3#x",
        "https://example.com/p?b=2", "https://example.com/p/?b=2", "https://example.com/p?b=3", "http://myexample.com/de/", "x://h/a://b/c", "http://h\n/p", "http://netnet/"]


def test_url_filter(spark):
    rows = [(k, u, "h", "v") for k, u in enumerate(URLS)] + [(None, URLS[4], "h", "v"), (4, URLS[4], "h", "v")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    listed = df.where("url like '%utm_%'").select("url")
    got = {r.page_id: r for r in url_filter.judge(df, listed).collect()}
    assert url_filter.judge(df, listed).count() == len(rows)
    assert [(got[k].host, got[k].path) for k in (0, 2, 3, 4, 8, 17)] == [("", ""), ("", ""), ("", ""), ("a.b.example.net", "/en/x"), ("x.org", "/fr/"), ("h", "/a://b/c")]
    assert {k: (got[k].rule, got[k].verdict) for k in (4, 5, 6, 7, 8, 9, 10, 16, 19)} == {
        4: ("example.net/en/", "allow"), 5: ("net/", "block"), 6: (None, "allow"), 7: ("net/", "block"), 8: ("org/fr/", "allow"),
        9: (None, "allow"), 10: ("example.com/de/", "block"), 16: (None, "allow"), 19: (None, "allow")}
    assert [got[k].verdict for k in (12, 13, 14, 15)] == ["block", "block", "block", "allow"]
    assert {r.verdict for r in url_filter.judge(df, listed.limit(0)).collect() if r.rule is None} == {"allow"}
    assert url_filter.judge(df.limit(0), listed).count() == 0


def test_bloom_split_loses_nothing(spark):
    df = spark.range(5000).selectExpr("cast(id as string) as k", "id").union(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    keys = df.where("id % 7 = 0").select("k")
    may, clear = bloom_split(df, "k", keys)
    assert may.count() + clear.count() == 5001
    assert clear.where("id % 7 = 0").count() == 0 and may.count() < 1500
    assert may.where("k is null").count() == 1


def test_licences(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    files = [("a/LICENSE", mit + "\nmore", 1), ("a/b/x.txt", "text", 2), ("a/b/c/y.txt", "words\n" + gpl.upper() + "\nend", 3), ("a/b/c/z.txt", None, 4),
             ("a/b/d/COPYING.md", gpl, 5), ("a/b/d/e/f.py", "", 6), ("q.txt", "license", 7), (None, mit, 8), ("r.txt", "cc " * 50_000, 9),
             ("a/b/x.txt", mit, 10), ("LICENCES/n.txt", "no", 11), ("other/LICENSE", "nothing here", 12), ("other/k", "no", 13)]
    df = spark.createDataFrame(files, "path string, text string, doc_id bigint")
    got = {r.doc_id: (r.licence, r.origin, r.from_dir) for r in licences.scan(df, keep=("doc_id",)).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "own", None), 3: ("GPL-3.0", "own", None), 4: ("MIT", "inherited", "a"), 5: ("GPL-3.0", "own", None),
                   6: ("GPL-3.0", "inherited", "a/b/d"), 7: (None, None, None), 8: (None, None, None), 9: (None, None, None), 10: ("MIT", "own", None),
                   11: (None, None, None), 12: (None, None, None), 13: (None, None, None)}
    for name, text in licences.TEMPLATES.items():
        one = licences.scan(spark.createDataFrame([("p", text)], "path string, text string")).first()
        assert one.licence == name
    root = spark.createDataFrame([("LICENSE", mit), ("x", "t"), ("d/y", "t")], "path string, text string")
    assert {r.licence for r in licences.scan(root).collect()} == {"MIT"}
    assert licences.scan(df.limit(0)).count() == 0


def test_licence_lines_need_no_marker(spark):
    """All lines against brute force: no wording is asked for, and the counts cover all lines."""
    rnd = random.Random(21)
    vocab = ["the", "of", "to", "in", "and", "with", "under", "this", "version", "2.0", "work", "all"] + [f"w{k}" for k in range(30)]
    texts = ["\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 9))) for _ in range(12)) for _ in range(40)]
    odd = ["Redistributions in source and binary forms, with or without modification, are permitted",
           "The author has waived all rights to this work, to the extent possible under law.", "released under the MIT", "MIT MIT license under released",
           "work under the terms of the GNU General Public, version 3", "Licensed under the Apache License, Version 2.0 w3", "w1 w2\nlicense of w7"]
    files = [(f"d/{k}", t) for k, t in enumerate(texts + [a + "\n" + b for a, b in zip(odd, texts, strict=False)])]

    def split(line):
        return collections.Counter(x for x in (y.strip(".-") for y in re.findall("[a-z0-9.-]+", line.lower())) if x)

    lines = [(p, split(x)) for p, t in files for x in set(t.split("\n")) if split(x)]
    df = collections.Counter(x for _, w in lines for x in w)
    vector = lambda w: {x: n * (math.log((1 + len(lines)) / (1 + df[x])) + 1) for x, n in w.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for p, w in lines:
        v = vector(w)
        for name, text in licences.TEMPLATES.items():
            t = vector(split(text))
            c = sum(x * t.get(k, 0) for k, x in v.items()) / norm(v) / norm(t)
            if c >= licences.THRESHOLD:
                want[p] = min(want.get(p, (0, "")), (-c, name))
    got = {r.path: (-r.cosine, r.licence) for r in licences.own_licences(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: x[1] for p, x in got.items()} == {p: x[1] for p, x in want.items()}
    assert {p: x[0] for p, x in got.items()} == pytest.approx({p: x[0] for p, x in want.items()}, abs=1e-8)
    assert got["d/40"][1] == "BSD-3-Clause" and len(got) >= 4


def test_pipeline(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "decontaminate", "tokenize"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'c' as cls", "1 as _cls2").union(
        spark.createDataFrame([(None, None, None, None, None, "c", 1), (None, "", "en", None, 0, "c", 1), (900_001, None, "en", "s", None, None, None)],
                              "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, _cls2 int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, odd, sf)
        assert left.columns == odd.columns, name
        assert 0 < left.count() <= odd.count()
        assert stage(spark, odd.limit(0), sf).count() == 0
    out = corpus_pipeline.run(spark, sf)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) > 0
    assert out.where("not intact").count() == 0
    from barspark.llm import decontaminate, near_dedup
    survivors = docs.join(out.select("doc_id"), "doc_id", "left_semi")
    assert near_dedup.near_duplicates(survivors).where("not kept").count() == 0
    assert decontaminate.matches(survivors, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0


def test_registered():
    import __spark_entry__ as entry
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 14))
