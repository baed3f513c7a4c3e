"""Quality classifier by positive-unlabelled learning.

Every whole text becomes a short vector of surface features (shares of characters and words, repetition, worst line,
compressibility). A small network minimises the non-negative unbiased risk from trusted positives (label 1) and
unlabelled web text under a class prior that is estimated from those two alone. The raw output is then calibrated to a
probability on the labelled rows it may learn from, rows of label 0 included: the scale of a score, not the order of
the documents, comes from them. Labels, language, source and id never enter a score.

Fitting uses a bounded sample, the ``MOST`` rows of each kind with the smallest hash of their id; everything else runs
over all rows. Scoring is row-local: the model is a few hundred numbers that go with the code, the text is read once.
Defined results: a null text is empty and scored as such; a row with a null id is scored and never learnt from, and
it is not held out; repeated rows are scored alike; a document with several labels has the smallest; without any
positive to learn from every score is 0.5; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import read_table, staged

#: Rows of each kind (positive, negative, unlabelled) that the fit may collect.
MOST = 8000
CUT = 0.7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"!|#$%&*<>{}[]=~^_\\/@+"
_HIGH = bytes(range(128, 256))


def _share(data: bytes, which: bytes) -> float:
    return 1 - len(data.translate(None, which)) / len(data) if data else 0.0


def features(data: bytes) -> list[float]:
    """Of one text, as UTF-8."""
    words = data.split()
    n = max(len(words), 1)
    size = max(len(data), 1)
    distinct = set(words)
    upper, lower = _share(data, _UPPER), _share(data, _LOWER)
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    lines = [x for x in data.split(b"\n") if x]
    most = Counter(words).most_common(1)[0][1] if words else 0
    long_lines = [x for x in lines if len(x) >= 16] or [data]
    line_words = [x.split() for x in long_lines]
    root = math.sqrt
    return [
        math.log1p(len(words)),
        math.log1p(len(data)),
        upper / (upper + lower + 1e-9),
        root(_share(data, _DIGIT)),
        root(_share(data, _MARKS)),
        root(data.count(b"!") / n),
        root(data.count(b"|") / n),
        root(sum(map(data.count, (b"#", b"$", b"%", b"&", b"*"))) / n),
        len(distinct) / n,
        math.log1p(len(distinct)) / math.log1p(n + 1),
        root(sum(same) / n),
        math.log1p(longest),
        most / n,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(len(lines)) / math.log1p(n),
        sum(map(len, words)) / n,
        math.log1p(max(map(len, words), default=0)),
        root(data.count(b".") / n),
        root(data.count(b",") / n),
        _share(data, _HIGH),
        root(max(_share(x, _UPPER) for x in long_lines)),
        root(max(_share(x, _MARKS) for x in long_lines)),
        max(1 - len(set(w)) / max(len(w), 1) for w in line_words),
        len(zlib.compress(data, 1)) / (size + 20),
        n / size,
    ]


def featured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the feature vector of each whole text."""
    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "__x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or b"") for t in b["__text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "__x"])

    return docs.select(*keep, docs[text_col].alias("__text")).mapInArrow(run, kinds)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


class Model:
    """One hidden layer; ``score`` gives probabilities."""

    def __init__(self, width: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
        self.mean, self.std, self.a, self.b = np.zeros(width), np.ones(width), 1.0, 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h, (h @ self.w[2] + self.w[3])[:, 0]

    def gradient(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        d = (g[:, None] @ self.w[2].T) * (1 - h * h)
        return [z.T @ d, d.sum(0), h.T @ g[:, None], g.sum(keepdims=True)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x))[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.raw(x) + self.b)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 1024, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimises prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss l.

    When a batch's negative part is below zero, the step undoes it instead (non-negative correction)."""
    r, model = np.random.default_rng(seed), Model(positive.shape[1])
    every = np.concatenate([positive, unlabelled])
    model.mean, model.std = every.mean(0), every.std(0) + 1e-6
    p, u = model.scaled(positive), model.scaled(unlabelled)
    m, v, t = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w], 0
    steps = max(1, -(-len(u) // batch))
    for _ in range(epochs):
        for part in np.array_split(r.permutation(len(u)), steps):
            zp, zu = p[r.integers(0, len(p), min(batch, len(p)))], u[part]
            (hp, gp), (hu, gu) = model.forward(zp), model.forward(zu)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            up = prior * _sigmoid(gp) / len(gp)
            if negative >= 0:
                dp, du = -prior * _sigmoid(-gp) / len(gp) - up, _sigmoid(gu) / len(gu)
            else:
                dp, du = up, -_sigmoid(gu) / len(gu)
            t += 1
            for i, (x, y) in enumerate(zip(model.gradient(zp, hp, dp), model.gradient(zu, hu, du), strict=True)):
                g = x + y + decay * model.w[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                model.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from both alone.

    A classifier of one half of the rows scores the other. Above a cut stand a share of the positives and a share of the
    unlabelled; positives alone would make their ratio the prior, others only raise it, so the cut with the smallest
    upper bound of that ratio (by the deviation of both shares) gives the estimate."""
    model = fit_nnpu(positive[::2], unlabelled[::2], 0.5, epochs=20)
    p, u = np.sort(model.raw(positive[1::2])), np.sort(model.raw(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.concatenate([p, [-np.inf]])
    above = lambda x: 1 - np.searchsorted(x, cuts, "left") / len(x)
    deviation = math.sqrt(math.log(4 / 0.1) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((above(u) + deviation) / np.maximum(above(p), 1e-9)))
    return float(min(max(above(u)[best] / above(p)[best], 0.05), 0.98))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
    """Logistic regression of the label on the raw output (Newton steps), with smoothed targets."""
    z = model.raw(x)
    scale = z.std() + 1e-6
    z = z / scale
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w, a = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
    for _ in range(steps):
        q = _sigmoid(a @ w)
        w = w - np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), a.T @ (q - target) + 1e-3 * (w - [1, 0]))
    model.a, model.b = max(float(w[0] / scale), 1e-6), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model from rows outside the held-out fold; None without positives. ``labels``: (doc_id, quality)."""
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"))
    ids = docs.where(F.coalesce(fold(id_col), F.lit(2)) != 2).select(docs[id_col].alias("__id")).distinct()
    kinds = staged(ids.join(known, "__id", "left").select("__id", F.coalesce("quality", F.lit(-1)).cast("int").alias("kind")))
    share = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not share.get(1):
        return None
    by_hash = F.xxhash64("__id")
    sample = None
    for kind in (1, 0, -1):
        part = kinds.where(F.col("kind") == kind).orderBy(by_hash, "__id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    # at most three times ``most`` ids
    rows = docs.join(F.broadcast(staged(sample)), docs[id_col] == F.col("__id")).select(F.col("__id"), F.col("kind"), docs[text_col].alias("text"))
    by_kind: dict[int, list] = {1: [], 0: [], -1: []}
    for r in featured(rows, ["__id", "kind"]).dropDuplicates(["__id"]).orderBy("__id").collect():
        by_kind[r["kind"]].append(r["__x"])
    positive, negative, unlabelled = (np.array(by_kind[k]) for k in (1, 0, -1))
    if not len(unlabelled):
        unlabelled = np.concatenate([positive, negative]) if len(negative) else positive
    model = fit_nnpu(positive, unlabelled, class_prior(positive, unlabelled))
    if len(negative):
        n = min(len(positive), max(1, round(len(negative) * share[1] / share[0])))
        calibrate(model, np.concatenate([positive[:n], negative]), np.concatenate([np.ones(n), np.zeros(len(negative))]))
    return model


def scored(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and score: the text is read, scored and let go in one pass."""
    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None or not b.num_rows:
                s = np.full(b.num_rows, 0.5)
            else:
                s = model.score(np.array([features(t or b"") for t in b["__text"].cast(pa.binary()).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    return docs.select(*keep, docs[text_col].alias("__text")).mapInArrow(run, kinds)


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
