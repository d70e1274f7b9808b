"""Edge cases and brute-force comparisons of the document operators."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from barspark.llm import bpe, decontaminate, language_id, near_dedup, quality, quality_rules, toxicity
from barspark.llm.common import fold

RND = random.Random(11)
VOCAB = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, cls string, score string"


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty, blank, short, very long, repeated rows, clashing extra columns."""
    long = prose(30_000, random.Random(30))
    return [(1, None, None, None, None, None), (2, "", "en", 0, "x", "y"), (3, " \t\n\x0b\f\r ", "en", 6, None, None),
            (4, "one two", "en", 7, "a", "b"), (4, "one two", "en", 7, "a", "b"), (None, "one  TWO", None, -1, "a", "b"),
            (5, long, "en", len(long), "a", "b"), (6, long + " tail", "en", 5, "a", "b"), (None, None, None, None, None, None),
            (7, "x" * 5000 + " " + " " * 3000 + "\n\n" + "é" * 700, "fr", 1, "a", "b"), (8, "123 456 !!", "en", 9, "a", "b")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} - {b""}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [(rows[k][0], len(sets[k]), least[group[k]]) for k in range(len(rows))]


def order(rows):
    return sorted(rows, key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, prose(rnd.randint(1, 90), rnd)) for k in range(60)]
    common = prose(30, rnd)
    for k in range(60, 110):                        # near copies with growing edits, some of a passage many share
        w = (rnd.choice(rows)[1] if k % 2 else common + " " + prose(rnd.randint(2, 60), rnd)).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "edit"
        rows.append((k, " ".join(w)))
    base = prose(80, rnd).split()
    for k in range(110, 190):                       # one large group of near copies
        w = list(base)
        w[rnd.randrange(80)] = f"e{k}"
        rows.append((k, " ".join(w)))
    rows += [(190, rows[5][1]), (191, rows[5][1].upper())]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(brute_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_plans_are_small(spark, monkeypatch):
    """No single plan of the linking step keeps dozens of joins and their exchanges on the driver."""
    joins = []

    def counted(df, **more):
        joins.append(df._jdf.queryExecution().sparkPlan().toString().count("Join"))
        return written(df, **more)

    written = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", counted)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k % 7 * 2] + [f"x{k % 5}"] + base[k % 7 * 2:])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    near_dedup.links(docs, near_dedup.sketch(docs))
    assert max(joins) <= 6


def test_near_duplicates_edges(spark, edge, none):
    got = near_dedup.near_duplicates(edge)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = order((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    texts = [(r[0], r[1]) for r in edge_rows()]
    assert rows == order((i, n, c if n else i) for i, n, c in brute_components(texts))
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.one_of_each(edge)
    assert kept.columns == edge.columns
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(
        (i, t) for i, t in texts[:4] + [texts[6], (None, None), texts[9], texts[10]])
    assert near_dedup.one_of_each(none).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def brute_leaks(docs, items):
    def grams(w, q):
        return [tuple(w[i:i + q]) for i in range(len(w) - q + 1)]
    out = set()
    for i, t in items:
        iw = (t or "").encode().lower().split()
        if not iw:
            continue
        q = min(5, len(iw))
        a = collections.Counter(grams(iw, q))
        for d, text in docs:
            w = (text or "").encode().lower().split()
            for s in range(max(1, len(w) - len(iw) + 1)):
                b = collections.Counter(grams(w[s:s + len(iw)], q))
                if b and sum((a & b).values()) >= 0.75 * sum((a | b).values()):
                    out.add((d, i))
                    break
    return out


def test_decontamination_equals_brute_force(spark, edge, none):
    rnd = random.Random(5)
    items = [(k, prose(rnd.choice([1, 2, 3, 4, 5, 6, 9, 14, 20, 33, 40, 58, 90, 140]), rnd)) for k in range(40)] + [(98, None), (99, "")]
    docs = []
    for k in range(120):
        w = prose(rnd.randint(0, 120), rnd).split()
        if k % 2:
            leak = rnd.choice(items[:40])[1].upper().split()
            for _ in range(rnd.randint(0, 2)):
                leak[rnd.randrange(len(leak))] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = leak
        docs.append((k, " ".join(w)))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.matches(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)
    assert all(r.similarity >= 0.75 for r in got)
    left = decontaminate.clean(d, i)
    assert {r.doc_id for r in left.collect()} == {k for k, _ in docs} - {r.doc_id for r in got}
    no_items = i.limit(0)
    assert decontaminate.matches(edge, no_items).count() == 0
    assert decontaminate.clean(edge, no_items).count() == edge.count()
    leaks = decontaminate.matches(edge, spark.createDataFrame([(1, "one two")], "item_id bigint, text string")).collect()
    assert order(r.doc_id for r in leaks) == order([4, 4, None])
    assert decontaminate.matches(none, i).count() == 0
    assert decontaminate.clean(edge, i).columns == edge.columns


def test_decontamination_finds_reordered_and_changed_leaks(spark):
    rnd = random.Random(15)
    items = [(k, prose(n, rnd)) for k, n in enumerate([30, 50, 50, 64, 80, 110])] + [(6, " ".join(["x", "y", "x", "z"] * 12))]
    docs = []
    for i, t in items:
        w = t.split()
        h, third = len(w) // 2, len(w) // 3
        kinds = [w[h:] + w[:h], w[third:] + w[:third], w[:h] + ["new"] * 3 + w[h:], w[:h] + w[h + 3:], w[:third] + w[:0] + w[third + 1:],
                 w[:h] + w[h - 4:], w[::-1], w[:third] + ["new"] + w[third:]]
        for part in kinds:
            at = rnd.randint(0, 60)
            docs.append((len(docs), " ".join(prose(60, rnd).split()[:at] + part + prose(rnd.randint(0, 90), rnd).split())))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.matches(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)
    swapped = next(r for r in got if (r.doc_id, r.item_id) == (8, 1))   # both halves of 50 words, in the other order
    assert swapped.similarity == 42 / 50
    texts = dict(docs)
    for r in got:
        item = collections.Counter(tuple(x) for x in zip(*(dict(items)[r.item_id].split()[k:] for k in range(5))))
        run = texts[r.doc_id].split()[r.start_word:r.start_word + r.n_words]
        own = collections.Counter(tuple(x) for x in zip(*(run[k:] for k in range(5))))
        assert r.similarity == sum((item & own).values()) / sum((item | own).values())


def test_blocks_find_all_fingerprints_within_radius():
    rnd = np.random.default_rng(1)
    prints = rnd.integers(0, 1 << 63, 50, dtype=np.uint64)
    index = decontaminate.Index(prints, np.arange(50), np.zeros(50, np.int64))
    asked = prints.copy()
    for bits in range(4):
        pos, entry = index.probe(asked)
        assert {(k, k) for k in range(50)} <= set(zip(pos.tolist(), entry.tolist(), strict=True)), bits
        asked = asked ^ (np.uint64(1) << rnd.integers(0, 64, 50).astype(np.uint64))


def test_window_fingerprints_are_majorities():
    from barspark.llm.common import shingle_hashes, word_hashes
    h = word_hashes(prose(60).encode().split())
    for size in (1, 4, 5, 12, 24, 42):
        got = decontaminate.window_fingerprints(h, size)
        for p in range(len(h) - size + 1):
            sh = shingle_hashes(h[p:p + size], min(5, size))
            votes = np.unpackbits(sh.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
            bits = np.packbits(votes * 2 > len(sh), bitorder="little").view(np.uint64)[0]
            assert got[p] == bits


PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec.parse(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_equals_the_library(codec, library):
    rnd = random.Random(9)
    parts = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", "1", "22", "!", "#", "the", "ing", "\x85", "\x1c", "　", "日", "\U0001f600", "'s", "'ll", "\xa0"]
    for k in range(400):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        if k % 3 == 0:
            s = s.replace(" ", "").replace("\n", "") * 9
        if k % 5 == 0:
            s = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(60, 900)))
        ids = np.frombuffer(codec.encode(s), "<u4").tolist()
        assert ids == library.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()


def test_bpe_long_pieces(codec, library):
    for s in ("a" * 3000, " " * 3000, "xyz" * 900):
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == library.encode_ordinary(s)
    for data in (b"abcabcabd" * 60, b"\xff\xfe" * 200):
        assert codec.leaf_by_heap(data) == codec.join(codec.leaf_by_heap(data[:99]), codec.leaf_by_heap(data[99:]))
        assert codec.leaf_by_heap(data[:200]) == codec.leaf(data[:200])


def test_bpe_edges(spark, edge, none, library):
    got = bpe.round_trip(edge, RANKS, PATTERN, tokens=True).collect()
    want = []
    for i, t, *_ in edge_rows():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True, ids))
    assert order(tuple(r) for r in got) == order(want)
    assert bpe.round_trip(none, RANKS, PATTERN).count() == 0


def labelled(spark, n=240):
    rnd = random.Random(2)
    sounds = {"aa": ["kra", "zul", "mok", "tir"], "bb": ["sheo", "lia", "nue", "poi"]}
    rows = []
    for k in range(n):
        lang = ("aa", "bb")[k % 2]
        text = " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 60)))
        rows.append((k, text, lang if k % 9 else None, len(text), "x", "y"))
    return spark.createDataFrame(rows, SCHEMA), {r[0]: ("aa", "bb")[r[0] % 2] for r in rows}


def test_language_id(spark, edge, none):
    docs, truth = labelled(spark)
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    got = language_id.predict(docs, model).collect()
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= float(r.score) <= 1 and not r.rejected for r in got)
    odd = language_id.predict(edge, model)
    assert set(odd.columns) == set(edge.columns) | {"lang_pred", "rejected"}
    by = {(r.doc_id, r.text): r for r in odd.collect()}
    for t in (None, "", "123 456 !!", " \t\n\x0b\f\r "):
        r = next(v for (_, x), v in by.items() if x == t)
        assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert len(by) == edge.count() - 1 and all(r.lang_pred in ("aa", "bb", "und") for r in by.values())
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_quality_co_training(spark, edge, none):
    rnd = random.Random(4)
    rows, marks = [], []
    for k in range(400):
        good = k % 4 != 0
        if good:
            text = "\n".join(" ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(8, 20))).capitalize() + "." for _ in range(rnd.randint(3, 9)))
        else:
            text = " ".join(f"{rnd.choice(VOCAB).upper()}{rnd.choice(['***', '###', '!!'])}" for _ in range(rnd.randint(20, 90)))
        rows.append((k, text, "en", len(text), "x", "y"))
        if k % 2 == 0 or k % 7 == 0:
            marks.append((k, int(good)))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks + [(None, 1), (3, None), (9999, 0)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert sum(r.good == (r.doc_id % 4 != 0) for r in got) >= 0.98 * len(rows)
    odd = quality.score(edge, model)
    assert odd.count() == edge.count()
    assert all(r.quality_score == 0 and not r.good for r in odd.collect() if not (r.text or "").strip(" \t\n\x0b\f\r"))
    assert quality.score(none, model).count() == 0
    untaught = quality.fit(docs, labels.limit(0))
    assert all(r.quality_score == 1 for r in quality.score(docs, untaught).collect())
    quality.score(docs.drop("n_chars"), model).count()


def test_toxicity(spark, edge, none):
    rnd = random.Random(8)
    bad = ["vilething", "nastyword", "foulspeech"]
    rows, marks = [], []
    for k in range(400):
        w = prose(rnd.randint(30, 120), rnd).split()
        if k % 4 == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        rows.append((k, " ".join(w), "en", 1, "x", "y"))
        marks.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    held = fold("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held), labels)
    got = toxicity.score(docs.where(held), model).collect()
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got) >= 0.95 * len(got)
    odd = toxicity.score(edge, model).collect()
    assert len(odd) == edge.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(none, model).count() == 0
    untaught = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(edge, untaught).collect()} == {0.0}


def test_toxicity_prior_does_not_follow_the_sample_caps(spark, monkeypatch):
    rnd = random.Random(18)
    rows = []
    for k in range(900):
        w = prose(rnd.randint(20, 60), rnd).split()
        if k % 5 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["vilething", "nastyword"])
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    shifts = []
    for toxic, ordinary in ((1500, 4000), (1500, 200), (60, 4000)):   # no cap binds, each one binds
        monkeypatch.setattr(toxicity, "TOXIC", toxic)
        monkeypatch.setattr(toxicity, "ORDINARY", ordinary)
        even = []
        fit = toxicity.Logistic.fit
        with monkeypatch.context() as m:
            m.setattr(toxicity.Logistic, "fit", lambda *a, **k: even.append(fit(*a, **k).w[0]) or a[0])
            shifts.append(toxicity.fit(docs, docs.drop("text")).calibration.w[0] - even[0])
    assert shifts == pytest.approx([np.log(180 / 720)] * 3)


def brute_measures(text):
    import re
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = {i + k for i, g in enumerate(tri) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, edge, none):
    rnd = random.Random(6)
    texts = [None, "", "a b c a b c", "a a a a a", "x\nx\n \nx", "a b c d a b c d e", "\U0001f600 é#|"]
    texts += ["".join(rnd.choice(["a", "b", " ", " ", "\n", "#"]) for _ in range(rnd.randint(0, 200))) for _ in range(150)]
    rows = list(enumerate(texts))
    led = quality_rules.ledger(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for r in led.collect():
        assert tuple(r[m] for m in quality_rules.MEASURES) == brute_measures(r.text), r.text
    kept = {r.doc_id for r in quality_rules.apply_policy(led, "base_v1").collect() if r.kept}
    want = {i for i, t in rows if brute_measures(t)[0] >= 50 and 100 * brute_measures(t)[5] <= 50 * brute_measures(t)[0]}
    assert kept == want
    bits = [r.fail_bits for r in led.collect()]
    for r in quality_rules.ablations(led).collect():
        m, b = quality_rules.mask(quality_rules.POLICIES[r.policy]), quality_rules.mask([r.rule])
        assert (r.docs, r.kept, r.kept_without, r.only_this) == (
            len(bits), sum(not x & m for x in bits), sum(not x & m & ~b for x in bits), sum(x & m == b for x in bits))
    odd = quality_rules.ledger(edge).collect()
    assert order((r.doc_id, r.n_words) for r in odd) == order((i, brute_measures(t)[0]) for i, t, *_ in edge_rows())
    assert quality_rules.ledger(none).count() == 0 and quality_rules.ablations(quality_rules.ledger(none)).count() == 0
