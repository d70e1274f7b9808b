"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
toxic text. The toxic training text is what toxic documents say and ordinary ones
do not: words that occur in at least ``MIN_CONTEXTS`` (or ``CONTEXT_SHARE`` of the
toxic sample) different contexts and ``LIFT`` times as often as in ordinary
documents; counting contexts instead of occurrences makes copies of a document
count once. A whole text is cut into windows of ``WINDOW`` words. A window's
margin is its length compressed with the ordinary dictionary less its length
compressed with ordinary plus toxic dictionary. The margins' maximum, means of
the largest and shares beyond fixed byte thresholds go through a logistic
calibration, fitted on labelled texts that trained no dictionary; its probability
is the score and 0.5 the threshold. The calibration weighs both kinds evenly and is
then shifted to the share of toxic among all labels, not among the sample.

Fitted on a bounded sample: about ``TOXIC`` and ``ORDINARY`` labelled texts of at
most ``SAMPLE_CHARS`` characters each. Scoring covers all rows and whole texts.

Defined results: null and empty texts are scored like a text with one empty
window; null ids carry through; several labels of an id are averaged (>= 0.5 is
toxic); without both labels every score is 0; other columns do not matter.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices
from .quality import Logistic, _sigmoid
from .samples import by_label

TOXIC = 1500
ORDINARY = 4000
SAMPLE_CHARS = 50_000
WINDOW = 8
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 1_024
#: Parameters of the dictionary trainer: length of its segments and of the runs it counts.
SEGMENT, RUN = 32, 6
ORDINARY_WINDOWS = 40_000
#: Of the calibration: weak, so that its probabilities keep their scale.
RIDGE = 1e-4
MIN_CONTEXTS, CONTEXT_SHARE, LIFT = 5, 0.005, 5


def _words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def windows(text: str | None) -> list[bytes]:
    w = _words(text)
    return [b" ".join(w[i:i + WINDOW]) for i in range(0, len(w), WINDOW)] or [b""]


def _contexts(texts: list[str]) -> Counter:
    seen = set()
    for t in texts:
        w = [b"", *_words(t), b""]
        seen.update(zip(w, w[1:], w[2:], strict=False))
    return Counter(x[1] for x in seen)


def _train(size: int, samples: list[bytes]) -> bytes:
    """Dictionary content of at most ``size`` bytes; short corpora are their own dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=RUN, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    calibration: Logistic | None = None

    def __post_init__(self):
        self._plain = self._both = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "calibration": self.calibration, "_plain": None, "_both": None}

    def _ready(self):
        if self._plain is None:
            def compressor(content):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            self._plain, self._both = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
        return self._plain, self._both

    def features(self, text: str | None) -> list[float]:
        plain, both = self._ready()
        ws = windows(text)
        m = np.fromiter((len(plain(w)) - len(both(w)) for w in ws), np.int64, len(ws))
        top = np.sort(m)[::-1]
        n = len(m)
        return [float(top[0]), float(top[:2].mean()), float(top[:4].mean()), float((m >= 3).mean()), float((m >= 5).mean()),
                float(np.log1p((m >= 4).sum())), float(np.log1p((m >= 6).sum())), float(np.log1p(n))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.calibration is None or not texts:
            return np.zeros(len(texts))
        return _sigmoid(self.calibration.logit(np.array([self.features(t) for t in texts])))


def train(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Model:
    """Model from labelled texts; a quarter of each kind only calibrates.

    ``odds``: toxic to ordinary texts where the samples come from; theirs if not given."""
    if len(toxic) < 8 or len(ordinary) < 8:
        return Model(b"", b"")
    toxic, ordinary = sorted(toxic), sorted(ordinary)
    random.Random(5).shuffle(toxic)
    random.Random(6).shuffle(ordinary)
    t_cal, t_fit, o_cal, o_fit = toxic[::4], [x for k, x in enumerate(toxic) if k % 4], ordinary[::4], [x for k, x in enumerate(ordinary) if k % 4]
    t_ctx, o_ctx = _contexts(t_fit), _contexts(o_fit)
    least = max(MIN_CONTEXTS, CONTEXT_SHARE * len(t_fit))
    own = {w for w, n in t_ctx.items() if n >= least and n / len(t_fit) >= LIFT * (o_ctx[w] + 1) / len(o_fit)}
    said = [b" " + b" ".join(w for w in _words(t) if w in own) + b" " for t in t_fit]
    plain = sorted({w for t in o_fit for w in windows(t)})
    random.Random(7).shuffle(plain)
    model = Model(_train(ORDINARY_BYTES, plain[:ORDINARY_WINDOWS]), _train(TOXIC_BYTES, [s for s in said if len(s) > RUN + 2]))
    x = np.array([model.features(t) for t in t_cal + o_cal])
    y = np.array([1] * len(t_cal) + [0] * len(o_cal))
    model.calibration = Logistic().fit(x, y, ridge=RIDGE)
    # the fit weighs both kinds evenly; a threshold of 0.5 is meant for the labels' own shares, which the sample's caps change
    model.calibration.w[0] += float(np.log(len(toxic) / len(ordinary) if odds is None else odds))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("label"))
    marks = marks.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")  # what is not given to learn from teaches nothing
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        F.char_length("text") <= SAMPLE_CHARS)
    # the labels are sampled, not the texts: a few thousand ids are broadcast and no text moves
    picked = by_label(marks.where("label = 1"), "label", TOXIC, ["doc_id"]).unionByName(
        by_label(marks.where("label = 0"), "label", ORDINARY, ["doc_id"]))
    # an id that comes in many rows is one text
    rows = known.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text").collect()
    n = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    return train([t for l, t in rows if l == 1], [t for l, t in rows if l == 0], n[1] / n[0] if n.get(0) and n.get(1) else None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in text_slices(batches, 1):
            p = m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int")
