"""What the contracts fix and earlier versions missed: isolation of labels, letters, ids of any type, deep paths, many classes."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from barspark.llm import decontaminate, language_id, licences, quality, url_filter
from barspark.llm.common import fold, table, text_slices
from barspark.llm.registry import QUERIES

RND = random.Random(3)


def test_held_out_labels_do_not_reach_the_toxicity_model(spark, sf, tmp_path):
    """Any change of labels of remainder 0, and labels of unknown documents, leave every score equal."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = fold("doc_id", 5) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    strange = flipped.unionByName(labels.limit(50).withColumn("doc_id", F.col("doc_id") + 10_000_003).withColumn("toxic", F.lit(1)))
    scores = []
    for n, x in enumerate((labels, strange)):
        docs.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        x.write.parquet(f"{tmp_path}/{n}/labels.parquet")
        scores.append({r.doc_id: r.score for r in QUERIES["op6_toxicity"](spark, f"{tmp_path}/{n}").collect()})
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 5


def test_numbers_are_no_letters():
    for text in ("½", "2² ①", "४५", "Ⅷ", "12 _ 7"):
        assert not len(language_id.features(text)[0]) and not regex.search(r"\p{L}", text)
    for text in ("x²", "ª", "語"):
        assert len(language_id.features(text)[0])


def test_six_hundred_languages(spark):
    rows = [(k * 3 + j, " ".join(f"l{k}x{RND.randrange(30)}q{k}" for _ in range(60)), f"lang{k:03}") for k in range(600) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    assert len(set(model.langs)) == 600


def test_a_repeated_row_teaches_once(spark):
    rows = [(1, "one two three four five", "en")] * 5000 + [(2, "eins zwei drei vier", "de"), (3, "un deux trois quatre", "fr")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs.count("en") == 1


def test_benchmark_ids_of_any_type(spark):
    words = [f"w{RND.randrange(10_000)}" for _ in range(40)]
    docs = spark.createDataFrame([(1, "a b c " + " ".join(words) + " d e"), (2, "nothing here")], "doc_id int, text string")
    items = spark.createDataFrame([("q-0", " ".join(words)), ("q-0", " ".join(words)), (None, " ".join(words[:30])), ("q-1", None)], "item_id string, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()), key=repr)
    assert got == [(1, "q-0"), (1, None)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]


def test_licence_is_inherited_from_any_depth(spark):
    deep = "d0/" + "/".join(f"x{k}" for k in range(70)) + "/a.txt"
    files = spark.createDataFrame([("d0/LICENSE", licences.TEMPLATES["MIT"]), (deep, "text"), ("e/a.txt", "text")], "path string, text string")
    got = {r.path: (r.licence, r.origin, r.from_dir) for r in licences.scan(files).collect()}
    assert got[deep] == ("MIT", "inherited", "d0") and got["e/a.txt"] == (None, None, None)


def test_listed_urls_are_met_by_a_hash_join(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    text = url_filter.judge(pages, pages.where("url like '%utm_%'").select("url"))._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_combined_quality_score(spark, sf):
    """The score of a row, written out from the weights of both views and of their combination."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)

    def logit(m, x):
        z = [max(-8.0, min(8.0, (a - mu) / s)) for a, mu, s in zip(x, m.mean, m.scale, strict=True)]
        return m.w[0] + sum(w * a for w, a in zip(m.w[1:], z, strict=True))

    got = {r.doc_id: (r.quality_score, r.good) for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        if not (r.text or "").split():
            assert got[r.doc_id] == (0.0, False)
            continue
        views = quality.features(r.text), quality.metadata(r.n_chars, r.source, r.lang)
        both = [logit(c, [logit(v, x)]) for v, c, x in zip(model.views, model.calibrated, views, strict=True)]
        want = 1 / (1 + np.exp(-np.clip(logit(model.both, both), -30, 30)))
        assert abs(got[r.doc_id][0] - want) < 1e-9 and got[r.doc_id][1] == (got[r.doc_id][0] >= quality.KEEP)


def test_metadata_view_reads_no_text():
    a, b = quality.metadata(10, "s1", "en"), quality.metadata(10, "s2", "en")
    assert len(a) == quality.META and a != b and sum(x != y for x, y in zip(a, b, strict=True)) in (0, 2)
    assert quality.metadata(None, None, None)[:4] == [0.0, 1.0, 1.0, 1.0]


def test_slices_hold_every_row_once():
    import pyarrow as pa
    texts = [None, "", "a" * 10, "b" * 100, "c", None, "d" * 30, "e" * 30, ""]
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["i", "t"])
    parts = list(text_slices([b, b.slice(0, 0), b.slice(2, 3)], 1, most=50))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(9), 2, 3, 4]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 50 for p in parts)


@pytest.mark.parametrize("query", ["quality_ablations"])
def test_ablations_count_every_document(spark, sf, query):
    rows = QUERIES[query](spark, sf).collect()
    n = table(spark, sf, "documents").count()
    assert len(rows) == 13 and {r.docs for r in rows} == {n} and all(r.kept <= r.kept_without <= n for r in rows)
