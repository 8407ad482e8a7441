"""Quality classifier by positive-unlabelled learning.

A linear scorer minimises the non-negative unbiased risk
``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))`` (logistic loss) from trusted positives (documents labelled 1) and
unlabelled web text (a random sample of all documents). The class prior ``pi`` is estimated, not given: a plain
positive-against-unlabelled scorer is fitted on one half, and on the other half the smallest upper confidence bound
of (share of unlabelled above t) / (share of positives above t) over thresholds t gives the prior. Two calibration
parameters (slope and offset of the final probability) are fitted on the labelled fitting rows of both classes.

Features of a whole text: square roots of the frequencies of neighbouring character classes (16 x 16), share of
words that repeat the word before or the one before that, share of distinct words, mean word length, log length.
Labels, lang, source and doc_id are no inputs. Fitting reads a bounded sample: ``FIT_ROWS`` labelled rows in the
order of a hash of their id and about as many unlabelled rows; scoring reads every text.

Edge cases: null text is scored as empty text; empty text has zero features and a score; a document labelled both
ways counts as 0; labels without a document, with a null quality or a null id are ignored; without any usable
positive, or without documents, the scorer is constant (score 0.5, predicted 0); repeated rows get equal scores;
a null doc_id is scored and not held out; ``with_scores`` keeps all columns but replaces score and predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

FIT_ROWS = 8_000
THRESHOLD = 0.7
SEED = 7

# Character classes by byte; bytes beyond ASCII are split into lead and continuation bytes.
CLASS = np.zeros(256, np.int32)
for _number, _members in enumerate((
        "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".?", ",;:",
        "\"()[]{}", "#$%&*+=<>@^~\\/_`", "|", "-'", "!")):
    for _c in _members:
        CLASS[ord(_c)] = _number
CLASS[[*range(10), *range(11, 32), 127]] = 12
CLASS[0x80:0xC0] = 13
CLASS[0xC0:] = 14
N_FEATURES = 256 + 5


def features(column: pa.Array) -> np.ndarray:
    """Feature matrix (rows x N_FEATURES, float32) of a string column."""
    parts = [np.zeros((0, N_FEATURES), np.float32)]
    for lo, hi in K.row_slices(column):
        w = K.Words(column.slice(lo, hi - lo), K.SPACE_WORD)
        n = hi - lo
        size = np.diff(w.off)
        row = np.repeat(np.arange(n, dtype=np.int32), size)
        c = CLASS[w.buf]
        same = row[1:] == row[:-1]
        pair = (row[:-1] * 256 + c[:-1] * 16 + c[1:])[same]
        del row, c, same
        x = np.zeros((n, N_FEATURES), np.float64)
        x[:, :256] = np.sqrt(np.bincount(pair, minlength=n * 256).reshape(n, 256) / np.maximum(size - 1, 1)[:, None])
        h = w.hashes()
        words = np.diff(w.first)
        wrow = w.row
        for k, lag in enumerate((1, 2)):
            again = (h[lag:] == h[:-lag]) & (wrow[lag:] == wrow[:-lag])
            x[:, 256 + k] = np.bincount(wrow[lag:][again], minlength=n) / np.maximum(words, 1)
        for r in range(n):
            if words[r]:
                x[r, 258] = len(np.unique(h[w.first[r]:w.first[r + 1]])) / words[r]
        x[:, 259] = np.log1p(size / np.maximum(words, 1)) / 4
        x[:, 260] = np.log1p(size) / 10
        parts.append(x.astype(np.float32))
    return np.concatenate(parts)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -80, 80)))


class _Adam:
    def __init__(self, n, rate):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, g):
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def non_negative_risk(xp, xu, prior, steps=700, rate=0.05, decay=1e-5):
    """Weights minimising the non-negative unbiased risk with the logistic loss (full batches, Adam)."""
    w = np.zeros(xp.shape[1])
    adam = _Adam(len(w), rate)
    for _ in range(steps):
        v = w.astype(xp.dtype)
        sp, su = _sigmoid(xp @ v), _sigmoid(xu @ v)
        plus = xp.T @ (sp - 1) / len(xp)  # gradient of the loss of positives as positives
        minus = xu.T @ su / len(xu) - prior * (xp.T @ sp / len(xp))
        top = 1 - np.finfo(xp.dtype).eps
        negative_part = np.mean(-np.log1p(-np.minimum(su, top))) - prior * np.mean(-np.log1p(-np.minimum(sp, top)))
        g = prior * plus + minus if negative_part >= 0 else -minus
        w -= adam.step(g + decay * w)
    return w


def against_unlabelled(xp, xu, steps=400, rate=0.05, decay=1e-4):
    """Weights of a plain logistic scorer of positives against unlabelled rows, both sides of weight one half."""
    w = np.zeros(xp.shape[1])
    adam = _Adam(len(w), rate)
    for _ in range(steps):
        v = w.astype(xp.dtype)
        g = xp.T @ (_sigmoid(xp @ v) - 1) / len(xp) + xu.T @ _sigmoid(xu @ v) / len(xu)
        w -= adam.step(g / 2 + decay * w)
    return w


def estimate_prior(score_p, score_u, delta=0.1):
    """Share of positives among the unlabelled: ratio of tail shares at the threshold with the least upper bound."""
    t = np.unique(score_p)
    qp = 1 - np.searchsorted(np.sort(score_p), t, side="left") / len(score_p)
    qu = 1 - np.searchsorted(np.sort(score_u), t, side="left") / len(score_u)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(score_u))) + np.sqrt(np.log(4 / delta) / (2 * len(score_p)))
    best = np.argmin((qu + slack) / qp)
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def calibrate(z, y, steps=200):
    """Slope and offset of P(label 1 | z) by Newton steps with a small ridge; at least one row of each class."""
    a = np.array([1.0, 0.0])
    m = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(steps):
        p = _sigmoid(m @ a)
        g = m.T @ (p - y) + 1e-3 * a
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
        a = a - np.linalg.solve(h, g)
    return a


def fit_arrays(x_labelled, y, x_unlabelled, seed=SEED) -> dict:
    """Model from labelled rows (only positives enter the risk) and unlabelled rows."""
    none = {"w": np.zeros(N_FEATURES + 1), "prior": 0.5}
    xp = x_labelled[y == 1]
    if len(xp) < 10 or len(x_unlabelled) < 10:
        return none
    n, total = len(xp) + len(x_unlabelled), xp.sum(axis=0, dtype=float) + x_unlabelled.sum(axis=0, dtype=float)
    mean = total / n
    scale = np.sqrt(sum(((x - mean) ** 2).sum(axis=0) for x in (xp, x_unlabelled)) / n) + 0.02

    def ready(x):
        out = np.ones((len(x), x.shape[1] + 1), x.dtype)
        np.clip((x - mean.astype(x.dtype)) / scale.astype(x.dtype), -8, 8, out=out[:, :-1])
        return out

    xp, xu = ready(xp), ready(x_unlabelled)
    order = np.random.Generator(np.random.PCG64(seed))
    ip, iu = order.permutation(len(xp)), order.permutation(len(xu))
    hp, hu = len(ip) // 2, len(iu) // 2
    first = against_unlabelled(xp[ip[:hp]], xu[iu[:hu]])
    prior = estimate_prior(xp[ip[hp:]] @ first, xu[iu[hu:]] @ first)
    w = non_negative_risk(xp, xu, prior)
    slope, offset = 1.0, 0.0
    if (y == 0).any():
        slope, offset = calibrate(np.clip(ready(x_labelled) @ w.astype(x_labelled.dtype), -30, 30).astype(float), y)
    return {"mean": mean, "scale": scale, "w": w, "prior": prior, "slope": slope, "offset": offset}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "mean" not in model:
        return np.full(len(x), 0.5)
    # summed row by row, so that a text's score does not depend on the rows around it
    z = (np.clip((x - model["mean"]) / model["scale"], -8, 8) * model["w"][:-1]).sum(axis=1) + model["w"][-1]
    return _sigmoid(model["slope"] * np.clip(z, -30, 30) + model["offset"])


def training_fold(doc_id):
    """True for rows whose labels may be learned: crc32 of the id as text modulo 4 is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Fit on a bounded sample: one pass over the documents computes the features of the sampled rows only."""
    known = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("y")).where(training_fold("doc_id"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    total = docs.count()
    share = min(1.0, fit_rows / max(total, 1))
    marked = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left")
              .withColumn("u", F.rand(SEED) < share).where("u or y is not null").select("text", "y", "u"))

    def task(batches):
        K.tidy()
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["y", "u", "x"])

    rows = marked.mapInArrow(task, "y int, u boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
    y = rows["y"].fill_null(-1).to_numpy()
    u = rows["u"].to_numpy()
    known = np.flatnonzero(y >= 0)
    return fit_arrays(x[known], y[known], x[u])


def with_scores(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (int, 1 at ``threshold`` and above) added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        K.tidy()
        parts = [predict(shared.value, features(text.slice(lo, hi - lo))) for lo, hi in K.row_slices(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    scored = docs.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
