"""Language identification by nearest clustered centroid.

A text is lower-cased, every ASCII byte that is no letter becomes a space, runs
of spaces one space. Its byte 1- to 3-grams are hashed into ``DIMS`` features,
weighted ``(1 + ln tf) * idf`` and scaled to length 1. Each language has up to
``CLUSTERS`` centroids (spherical k-means); the language of the centroid with
the largest cosine wins, ties go to the alphabetically first language. The
cosine is the score.

Rejection is by distance: a text is rejected when it has no letter, or when its
best cosine is below ``REJECT_SHARE`` times the ``REJECT_QUANTILE`` quantile of the
training texts' cosines.

The model is fitted on a bounded sample: about ``PER_LANGUAGE`` texts a language
and ``SAMPLE`` in all (whole texts; features are computed in the tasks).

Defined results: null text or a text without letters: ``und``, score 0, rejected.
Null ids are carried through, repeated rows get equal results, rows without lang
teach nothing; with nothing to learn from every text is ``und`` and rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_input, text_slices
from .samples import by_label

DIMS = 1 << 14
PER_LANGUAGE = 500
SAMPLE = 4000
CLUSTERS = 3
REJECT_QUANTILE = 0.01
REJECT_SHARE = 0.5
UND = "und"

_SPACES = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))
#: A letter is a character of a Unicode category L*; digits and numbers such as a half or a raised two are none.
_HAS_LETTER = regex.compile(r"\p{L}")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, 1 + ln tf) of a whole text; empty without a letter."""
    if not text or not _HAS_LETTER.search(text):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()) + b" "
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = (a[:-1] << 8) | a[1:]
    three = (two[:-1] << 8) | a[2:]
    count = np.bincount(a, minlength=DIMS)
    for gram, salt in ((two, 1), (three, 2)):
        h = (gram + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
        count += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIMS - 1), minlength=DIMS)
    at = np.flatnonzero(count)
    return at, (1 + np.log(count[at])).astype(np.float32)


@dataclass
class Model:
    langs: list[str]          # language of each centroid
    idf: np.ndarray           # DIMS
    centroids: np.ndarray     # DIMS x centroids
    floor: float              # least accepted cosine

    def cosines(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = tf * self.idf[at]
        norm = float(np.sqrt((w * w).sum()))
        return (w @ self.centroids[at]) / norm if norm else np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        at, tf = features(text)
        if not len(at) or not self.langs:
            return UND, 0.0, True
        cos = self.cosines(at, tf)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[best], score, score < self.floor


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from mutually far rows; rows of ``x`` have length 1."""
    k = min(k, len(x))
    first = x.mean(axis=0)
    far = [int(np.argmin(x @ first))]
    while len(far) < k:
        far.append(int(np.argmin((x @ x[far].T).max(axis=1))))
    cent = x[far]
    for _ in range(8):
        own = np.argmax(x @ cent.T, axis=1)
        rows = [x[own == c].sum(axis=0) if (own == c).any() else cent[c] for c in range(k)]
        cent = np.stack([r / max(float(np.linalg.norm(r)), 1e-12) for r in rows]).astype(np.float32)
    return cent


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from a bounded sample of rows with a language."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n_langs = max(1, rows.where("lang is not null").select("lang").distinct().count())
    per = max(8, min(PER_LANGUAGE, SAMPLE // n_langs))
    picked = by_label(rows, "lang", per, ["doc_id", "text"])

    def run(batches):
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                at, tf = features(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([tf], pa.list_(pa.float32()))], names=["lang", "at", "tf"])

    got = picked.select("lang", "text").mapInArrow(run, "lang string, at array<int>, tf array<float>").toArrow()
    at = [np.asarray(v.values) for v in got.column("at").combine_chunks()] if got.num_rows else []
    tf = [np.asarray(v.values) for v in got.column("tf").combine_chunks()] if got.num_rows else []
    by: dict[str, list[int]] = {}
    for k in sorted(range(len(at)), key=lambda k: (len(at[k]), at[k].tobytes(), tf[k].tobytes())):  # order of arrival must not matter
        if len(at[k]):
            by.setdefault(got.column("lang")[k].as_py(), []).append(k)
    df = np.zeros(DIMS)
    used = [k for v in by.values() for k in v]
    for k in used:
        df[at[k]] += 1
    idf = (np.log((1 + len(used)) / (1 + df)) + 1).astype(np.float32)
    langs, cents = [], []
    for lang in sorted(by):
        x = np.zeros((len(by[lang]), DIMS), np.float32)
        for r, k in enumerate(by[lang]):
            x[r, at[k]] = tf[k] * idf[at[k]]
            x[r] /= np.linalg.norm(x[r])
        c = _clusters(x, CLUSTERS)
        cents.append(c)
        langs += [lang] * len(c)
    model = Model(langs, idf, np.concatenate(cents).T.copy() if cents else np.zeros((DIMS, 0), np.float32), 0.0)
    if used:
        best = [float(model.cosines(at[k], tf[k]).max()) for k in used]
        model.floor = REJECT_SHARE * float(np.quantile(best, REJECT_QUANTILE))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All columns of ``docs`` and the three new ones (which replace columns so named)."""
    ship(docs.sparkSession)
    new = names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in new]
    out, at = text_input(docs, text_col, keep)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = schema.add(new[0], "string").add(new[1], "double").add(new[2], "boolean")

    def run(batches):
        m = shared.value
        for b in text_slices(batches, at):
            got = [m.predict(t.as_py()) for t in b.column(at)]
            lang, score, no = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(b.columns[:len(keep)] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], names=keep + list(new))

    return out.mapInArrow(run, schema)
