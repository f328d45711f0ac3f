"""Quality classifier by positive-unlabelled learning.

A linear score over style features (shares of byte classes and of their pairs, repetition of words and lines, lengths) is
fitted by minimising the non-negative unbiased risk: trusted positives (label 1) stand for the good class, a sample of all
training documents for the unlabelled web. The class prior is estimated from scores alone: for classifiers of positives
against the web, trained on one half, it is the least ratio of the web's and the positives' masses above a cut, on the other
half. So the weights come from positives and unlabelled texts only. Last, a logistic curve of two parameters, fitted on the
training folds' labels of both kinds, turns the score into a probability; without labels 0 the score's own curve stays.

The fit takes at most ``SAMPLE`` positives, ``SAMPLE`` labelled negatives (for the curve alone) and ``SAMPLE`` unlabelled
documents, picked by a digest of the id, from rows whose crc32(doc_id as text) mod 5 is not 0; this bound is a parameter.
Every row is scored.

Defined cases: null text counts as the empty text, whose score is that of all-zero features; null doc_ids are not held out
and have no labels; labels repeated for one doc_id count once, at their greatest; without labels the score is 0.5;
repeated rows each get a row; an empty table gives an empty result; further columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import Rolling, byte_table, flat, runs_of_docs, tidy
from .shared import bounded

SAMPLE = 6000
THRESHOLD = 0.3
_SLICE = 1_500_000

# Byte classes of the features; bytes of one string share a class, all others are the last class.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "\"'", "()[]{}", "@", "/\\", ":;", "-_", "=+<>"]
_K = len(CLASSES) + 2


def _classes() -> np.ndarray:
    t = np.full(256, _K - 1, np.int32)
    t[128:] = _K - 2
    for i, s in enumerate(CLASSES):
        t[list(s.encode())] = i
    return t


_TABLE, _BYTES = _classes(), byte_table(11)
N_FEATURES = _K * _K + _K + 8


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, distinct units) of each document."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(doc, minlength=n), np.bincount(d[new], minlength=n)


def _units(data: np.ndarray, doc: np.ndarray, gap: np.ndarray, roll: Rolling, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the runs between gaps; runs end at document ends."""
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1] | (doc[1:] != doc[:-1])
    last = inside.copy()
    last[:-1] &= gap[1:] | (doc[1:] != doc[:-1])
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return doc[s], roll.of(s, e)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each document of a slice."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, -1] = np.log1p(size)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    c = _TABLE[data]
    pair = (doc[1:] * (_K * _K) + c[:-1] * _K + c[1:])[doc[1:] == doc[:-1]]
    per = np.maximum(size, 1)[:, None]
    out[:, : _K * _K] = np.bincount(pair, minlength=n * _K * _K).reshape(n, -1) / per
    out[:, _K * _K : _K * _K + _K] = np.bincount(doc * _K + c, minlength=n * _K).reshape(n, -1) / per
    roll = Rolling(_BYTES[data])
    w, wd = _repeats(*_units(data, doc, (data == 32) | (data == 10) | (data == 9) | (data == 13), roll, offs), n)
    li, ld = _repeats(*_units(data, doc, data == 10, roll, offs), n)
    at = _K * _K + _K
    for k, x in enumerate((wd / np.maximum(w, 1), ld / np.maximum(li, 1), np.log1p(w), np.log1p(li), size / np.maximum(w, 1) / 16, w / np.maximum(li, 1) / 64, (w == 0))):
        out[:, at + k] = x
    out[size == 0] = 0  # alike in any company
    return out


def _blocks(col) -> Iterator[np.ndarray]:
    data, offs = flat(col)
    for i, j in runs_of_docs(offs, _SLICE):
        yield features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


class Model:
    """Standardised linear score and a logistic curve."""

    def __init__(self, mean, scale, w, b, curve=(1.0, 0.0)):
        self.mean, self.scale, self.w, self.b, self.curve = mean, scale, w, b, curve

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.curve[0] * self.raw(x) + self.curve[1], -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the unbiased risk under logistic loss: of positives, and of negatives as the web without its positives."""
    soft = lambda z: np.logaddexp(0, z)
    return float(prior * soft(-fp).mean()), float(soft(fu).mean() - prior * soft(fp).mean())


def gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> np.ndarray:
    """Of the non-negative risk: where the negatives' term falls below 0 the step follows its negative, as the method's authors do
    against overfitting."""
    fp, fu = p @ w + b, u @ w + b
    gp, gu = _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    neg = np.append(u.T @ gu - prior * (p.T @ gp), gu.sum() - prior * gp.sum())
    if risk(fp, fu, prior)[1] < 0:
        return -neg
    gpos = -_sigmoid(-fp) / len(fp)
    return prior * np.append(p.T @ gpos, gpos.sum()) + neg


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.02, decay: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear weights that minimise the non-negative risk prior*E_p[l(f)] + max(0, E_u[l(-f)] - prior*E_p[l(-f)]), logistic loss, Adam."""
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = gradient(p, u, w, b, prior)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def mass_ratio(fp: np.ndarray, fu: np.ndarray, least: float = 0.5) -> float:
    """The least ratio of the masses of the web and of the positives above a cut that keeps a share of the positives."""
    fp, fu = np.sort(fp), np.sort(fu)
    cuts = fp[: int(len(fp) * (1 - least)) + 1 : max(1, len(fp) // 200)]
    above = lambda x: (len(x) - np.searchsorted(x, cuts)) / len(x)
    return float((above(fu) / above(fp)).min())


def class_prior(p: np.ndarray, u: np.ndarray, splits: int = 4, steps: int = 100) -> float:
    """Share of the good class in the web: the median over alternating halves."""
    out = []
    for k in range(splits):
        half = lambda x: (np.arange(len(x)) >> (k // 2)) % 2 == k % 2  # noqa: E731, B023
        hp, hu = half(p), half(u)
        if not hp.any() or hp.all() or not hu.any() or hu.all():
            continue
        w, b = nnpu(p[hp], u[hu], 0.5, steps)
        out.append(mass_ratio(p[~hp] @ w + b, u[~hu] @ w + b))
    return float(np.clip(np.median(out), 0.02, 0.98)) if out else 0.5


def curve(f: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic curve of labels over scores, by Newton steps with a small ridge."""
    x = np.stack([f, np.ones_like(f)], 1)
    t = np.zeros(2)
    for _ in range(steps):
        q = _sigmoid(x @ t)
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        t = t - np.clip(np.linalg.solve(h, x.T @ (q - y) + 1e-3 * t), -2, 2)
    return float(t[0]), float(t[1])


def _fold(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _pick(df: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About so many rows by a digest of the id; with salts of their own, samples do not hold the same documents."""
    return df if n <= most else df.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the training folds."""
    bounded(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & ~_fold()).groupBy("doc_id").agg(F.max("quality").alias("y_"))
    train = docs.select("doc_id", "text").filter(~_fold())
    count = {r["y_"]: r["n"] for r in known.groupBy("y_").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = count.get(1, 0), count.get(0, 0)
    if not n_pos:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    ids = _pick(known.filter("y_ = 1"), n_pos, sample, "positives").unionByName(_pick(known.filter("y_ = 0"), n_neg, sample, "negatives"))
    web = _pick(train, train.count(), sample, "web").select(F.lit(-1).alias("y_"), "text")
    rows = train.join(F.broadcast(ids), "doc_id").select("y_", "text").unionByName(web)  # ids: at most about 2 x sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([*_blocks(b.column("text")), np.zeros((0, N_FEATURES), np.float32)])
            yield pa.RecordBatch.from_arrays([b.column("y_").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), N_FEATURES)
    y = got["y"].to_numpy()
    if not (y == -1).any():
        x, y = np.concatenate([x, x]), np.concatenate([y, np.full(len(y), -1)])
    web_x = x[y == -1]
    mean, scale = web_x.mean(0, dtype=np.float64).astype(np.float32), (web_x.std(0, dtype=np.float64) + 1e-3).astype(np.float32)
    del got, web_x
    model = Model(mean, scale, np.zeros(N_FEATURES), 0.0)
    z = np.clip((x - mean) / scale, -6, 6)
    pos, web = z[y == 1], z[y == -1]
    if not len(pos):  # labels of no document
        return model
    model.w, model.b = nnpu(pos, web, class_prior(pos, web))
    del z, pos, web
    told = y >= 0
    if (y == 0).any():
        weight_fix = np.log(n_pos / n_neg) - np.log((y == 1).sum() / (y == 0).sum())
        a, c = curve(model.raw(x[told]), y[told])
        model.curve = (a, c + float(weight_fix))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tidy()
            s = np.concatenate([*(model.score(x) for x in _blocks(b.column("text"))), np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", _fold().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
