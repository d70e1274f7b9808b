"""Quality classification by co-training two views.

View 1 sees the text (symbols, capitals, repetition, vocabulary, lines, punctuation at
line ends). View 2 sees the page's metadata only: its stated length, source and language,
the last two hashed into ``SOURCES`` and ``LANGS`` indicators, whose weights are
learned from training rows; it never reads the text.
Each view has a logistic model. Over ``ROUNDS`` rounds each view labels the
unlabelled pool; rows on which it is confident (calibrated probability beyond
``CONFIDENT``) join the other view's training rows as pseudo-labels. At the end
both views are calibrated on labelled rows that neither model saw, and a logistic
model of the two calibrated logits scores every document; a document below
``KEEP`` is rejected.

Fitted on bounded samples: about ``LABELLED`` rows a label and ``POOL`` unlabelled
rows, whole texts. Scoring covers every row.

Defined results: null and empty texts score 0 and are rejected; with one label
value or none to learn from, every text with words scores 1. Null ids carry
through; ids match labels by value, several labels of an id are averaged (>= 0.5
is good); repeated rows get equal results; other columns pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, ship, text_input, text_slices, word_hashes
from .samples import SLACK, by_label

LABELLED = 1500
POOL = 3000
ROUNDS = 4
CONFIDENT = 0.97
KEEP = 0.5
RIDGE = 1e-2

_SYMBOL = np.frombuffer(bytes(c in b"#*$%&|<>{}[]\\^~_=+@" for c in range(256)), np.uint8).astype(bool)
_UPPER = np.frombuffer(bytes(65 <= c <= 90 for c in range(256)), np.uint8).astype(bool)
_LETTER = np.frombuffer(bytes(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)), np.uint8).astype(bool)
_DIGIT = np.frombuffer(bytes(48 <= c <= 57 for c in range(256)), np.uint8).astype(bool)
CONTENT, SOURCES, LANGS = 18, 32, 16
META = 4 + SOURCES + LANGS


def metadata(n_chars: int | None, source: str | None, lang: str | None) -> list[float]:
    """Metadata view: stated length, what is missing, indicators of the hashed source and language."""
    known = n_chars is not None and n_chars >= 0
    out = [float(np.log1p(n_chars)) / 10 if known else 0.0, float(not known), float(source is None), float(lang is None)] + [0.0] * (SOURCES + LANGS)
    if source is not None:
        out[4 + xxhash.xxh3_64_intdigest(source) % SOURCES] = 1.0
    if lang is not None:
        out[4 + SOURCES + xxhash.xxh3_64_intdigest(lang) % LANGS] = 1.0
    return out


def features(text: str) -> list[float]:
    """Text view of a text with words."""
    data = text.encode("utf-8", "surrogatepass")
    tokens = data.split()
    n = len(tokens)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    black = max(1, len(data) - int(count[[9, 10, 11, 12, 13, 32]].sum()))
    h = word_hashes(tokens)
    tri = shingle_hashes(h, 3)
    letters = max(1, int(count[_LETTER].sum()))
    content = [
        int(count[_SYMBOL].sum()) / black,
        int(count[_UPPER].sum()) / letters,
        int(count[_DIGIT].sum()) / black,
        int(count[33]) / n,
        min(1.0, int(count[124]) / n),
        float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(tri)) / len(tri),
        1 - len(np.unique(h)) / n,
        black / n / 10,
        letters / black,
    ]
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":", b'"') for x in lines) / len(lines)
    size = len(text)
    layout = [
        float(np.log1p(size)) / 10,
        float(np.log1p(len(lines))) / 5,
        float(np.log1p(size / len(lines))) / 10,
        1 - len(set(lines)) / len(lines),
        ends,
        (int(count[46]) + int(count[44])) / n,
        int(count[46]) / n,
        float(np.log1p(max(map(len, lines)))) / 10,
    ]
    return content + layout


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    w: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> "Logistic":
        """Newton steps on the ridge-penalised likelihood, classes weighted evenly."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = _sigmoid(z @ w)
            grad = z.T @ (weight * (p - y)) + ridge * np.r_[0, w[1:]]
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]) @ self.w


@dataclass
class Model:
    views: list[Logistic]
    calibrated: list[Logistic]
    both: Logistic | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.both is None or not len(x):
            return np.ones(len(x))
        parts = x[:, :CONTENT], x[:, CONTENT:]
        logits = [c.logit(v.logit(p)[:, None]) for v, c, p in zip(self.views, self.calibrated, parts, strict=True)]
        return _sigmoid(self.both.logit(np.column_stack(logits)))


def co_train(x: np.ndarray, y: np.ndarray, pool: np.ndarray) -> Model:
    if len(np.unique(y)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return Model([], [], None)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::4]] = True
    view = [slice(0, CONTENT), slice(CONTENT, CONTENT + META)]
    extra: list[dict[int, int]] = [{}, {}]   # pool row -> pseudo-label, for each view's training
    models: list[Logistic] = []
    calibrated: list[Logistic] = []
    for turn in range(ROUNDS + 1):
        models, calibrated = [], []
        for v, s in enumerate(view):
            rows = np.fromiter(extra[v], np.int64, len(extra[v]))
            m = Logistic().fit(np.concatenate([x[~held][:, s], pool[rows][:, s]]), np.concatenate([y[~held], np.fromiter(extra[v].values(), np.int64, len(rows))]))
            models.append(m)
            calibrated.append(Logistic().fit(m.logit(x[held][:, s])[:, None], y[held]))
        if turn == ROUNDS or not len(pool):
            break
        for v, s in enumerate(view):
            p = _sigmoid(calibrated[v].logit(models[v].logit(pool[:, s])[:, None]))
            sure = np.flatnonzero((p > CONFIDENT) | (p < 1 - CONFIDENT))
            extra[1 - v] = {int(r): int(p[r] > 0.5) for r in sure}
    logits = np.column_stack([c.logit(m.logit(x[held][:, s])[:, None]) for m, c, s in zip(models, calibrated, view, strict=True)])
    return Model(models, calibrated, Logistic().fit(logits, y[held]))


def _matrix(b: pa.RecordBatch, text_at: int, meta_at: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows of texts with words, their positions); metadata are three columns from ``meta_at`` on."""
    rows, at = [], []
    for k, (t, *meta) in enumerate(zip(b.column(text_at), *(b.column(meta_at + j).to_pylist() for j in range(3)), strict=True)):
        text = t.as_py()
        if text and text.encode("utf-8", "surrogatepass").split():
            rows.append(features(text) + metadata(*meta))
            at.append(k)
    return np.array(rows, np.float64).reshape(-1, CONTENT + META), np.array(at, np.int64)


def _collect(rows: DataFrame, label) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for b in text_slices(batches, 0):
            x, at = _matrix(b, 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(4).take(pa.array(at))], names=["x", "y"])

    got = rows.select("text", *META_COLS, label.cast("int").alias("y")).mapInArrow(run, "x array<double>, y int").toArrow()
    if not got.num_rows:
        return np.zeros((0, CONTENT + META)), np.zeros(0, np.int64)
    x = np.array(got.column("x").to_pylist())
    y = np.array([-1 if v is None else v for v in got.column("y").to_pylist()])
    order = np.lexsort(np.column_stack([x, y]).T)   # order of arrival must not matter
    return x[order], y[order]


#: Metadata columns, null where a table lacks them, and their types.
META_COLS = {"n_chars": "bigint", "source": "string", "lang": "string"}


def _meta(docs: DataFrame, prefix: str = "") -> list:
    return [(F.col(f"`{c}`").cast(kind) if c in docs.columns else F.lit(None).cast(kind)).alias(prefix + c) for c, kind in META_COLS.items()]


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *_meta(docs))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    ship(docs.sparkSession)
    rows = _inputs(docs, id_col, text_col)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("label"))
    # the labels are sampled, not the texts: a few thousand ids are broadcast and no text moves
    known = rows.join(F.broadcast(by_label(marks, "label", LABELLED, ["doc_id"])), "doc_id")
    known = known.groupBy("doc_id", "label").agg(F.min(F.struct("text", *META_COLS)).alias("r")).select("label", "r.*")  # an id that comes in many rows is one text
    x, y = _collect(known, F.col("label"))
    total = max(1, rows.count())
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pool, _ = _collect(rows.where(draw < min(1.0, SLACK * POOL / total)).dropDuplicates(["doc_id", "text"]), F.lit(None))
    return co_train(x, y, pool)


def score(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("quality_score", "good")) -> DataFrame:
    """All columns of ``docs`` and the two new ones (which replace columns so named)."""
    ship(docs.sparkSession)
    new = names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in new]
    given, text_at = text_input(docs.select(*[F.col(f"`{c}`") for c in docs.columns], *_meta(docs, "_scored_")), text_col, [*keep, *("_scored_" + c for c in META_COLS)])
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(new[0], "double").add(new[1], "boolean")

    def run(batches):
        m = shared.value
        for b in text_slices(batches, text_at):
            x, at = _matrix(b, text_at, len(keep))
            p = np.zeros(b.num_rows)
            p[at] = m.score(x)
            yield pa.RecordBatch.from_arrays(b.columns[:len(keep)] + [pa.array(p), pa.array(p >= KEEP)], names=keep + list(new))

    return given.mapInArrow(run, schema)
