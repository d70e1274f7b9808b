"""Named queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, licences, near_dedup, periodic, prefix_trie, quality, quality_rules, repeats, toxicity, url_filter, warc
from .oracle import ORACLES
from .common import fold, table

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.lit(quality_rules.mask(quality_rules.POLICIES["base_v1"]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does to ``documents``: docs, kept, kept_without, only_this."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents").select("text")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no list of URLs; the query lists campaign pages: the canonical
    form of every url that carries a ``utm_`` parameter on some page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("url").rlike("[?&]utm_")).select("url")
    return url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/<doc_id div 100>/<name>``; every hundredth is its directory's LICENSE."""
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 100 as string)"), name)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licences.scan(files, keep=("doc_id",)).select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "origin", "from_dir")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text", "n_chars", "source", "lang"), model).select("doc_id", "quality_score", F.col("good").alias("kept"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of conversations that begin with up to eight turns of the first one of their five."""
    rows = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    taken = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.peel(*prefix_trie.spliced(rows, conv - conv % 5, taken, 8))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, every tenth (by its id's crc32) with a periodic end, and digests of their runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(w):
        """Every word from a on becomes word a + (i - a) % p."""
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, 1, a), again))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), looped), F.lit(0))).otherwise(F.col("text"))
    found = periodic.detect(docs.select("doc_id", text.alias("text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best_run.start", "best_run.length", "best_run.period",
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.floor(F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_warc, op2_decontamination, op3_quality_rules, quality_ablations, op4_url_filter, op5_minhash, op6_toxicity, op7_bpe, op8_licences, op9_language,
    op10_quality, op11_prefix_trie, op12_periodic_runs, op13_repeats, pipeline)}
