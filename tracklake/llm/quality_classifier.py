"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model that minimises the non-negative unbiased risk
    prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)).
The class prior is estimated from the same two sets: a plain classifier of labelled against unlabelled texts gives a
positive text the labelling rate c on average, and the prior is its mean over all texts divided by c. Texts are seen as
shares of byte classes, repetition and lengths, and as hashed words and pairs of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import small_batches

SAMPLE = 10_000  # rows of each set, about, that the model is fitted on
HASHED = 256  # places of the hashed words and pairs of words
STEPS = 400
RATE = 0.2
L2, L2_PRIOR = 1e-3, 1e-2

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n"
_CLASSES = np.zeros((256, len(_MARKS) + 5))
for _i, _c in enumerate(_MARKS):
    _CLASSES[_c, _i] = 1
for _i, _own in enumerate((range(48, 58), range(65, 91), range(97, 123), (9, 11, 12, 13, 32), range(128, 256))):
    _CLASSES[list(_own), len(_MARKS) + _i] = 1
N_PLAIN = _CLASSES.shape[1] + 7
N_FEATURES = N_PLAIN + HASHED
_PLACES = np.uint64(HASHED - 1)


def hashed_words(words: list[bytes]) -> np.ndarray:
    """Roots of the shares of words and pairs of words (A-Z lower-cased) that fall on each of HASHED places."""
    if not words:
        return np.zeros(HASHED)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    places = np.concatenate([h & _PLACES, pairs >> np.uint64(64 - HASHED.bit_length() + 1)]).astype(np.int64)
    return np.sqrt(np.bincount(places, minlength=HASHED) / len(places))


def features(text: str | None) -> np.ndarray:
    """Numbers of a text: shares of byte classes and of single marks, repetition, word and line lengths, hashed words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    words = raw.split()
    lines = raw.split(b"\n")
    m = max(1, len(words))
    rest = [
        np.log1p(len(words)), len(raw) / m / 10, len(set(words)) / m, len(set(zip(words, words[1:], words[2:], strict=False))) / m,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(map(len, words)) / m / 10,
    ]
    return np.concatenate([np.sqrt(shares), rest, hashed_words(raw.lower().split())]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(gradient, size: int, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Adam from zero on a full-batch gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def two_sided(prior: float, n: int) -> float:
    """A prior by which one of n texts is positive and one negative at least: at 0 or 1 the risk has no two sides."""
    return float(np.clip(prior, 1 / n, 1 - 1 / n))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among p and u together: each half is judged by a classifier of the other."""
    on_all, on_p = [], []
    for fold in (0, 1):
        rest_p, rest_u = p[fold::2], u[fold::2]
        x, y = np.vstack([rest_p, rest_u]), np.concatenate([np.ones(len(rest_p)), np.zeros(len(rest_u))])
        w = descend(lambda w, x=x, y=y: x.T @ (sigmoid(x @ w) - y) / len(y) + L2_PRIOR * w, x.shape[1], 200)
        own_p, own_u = sigmoid(p[1 - fold :: 2] @ w), sigmoid(u[1 - fold :: 2] @ w)
        on_all += [own_p, own_u]
        on_p.append(own_p)
    return two_sided(np.concatenate(on_all).mean() / max(np.concatenate(on_p).mean(), 1e-6), len(p) + len(u))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the logistic loss: of positives as 1, and of negatives as 0, which is not bounded."""
    loss = lambda z: np.logaddexp(0, z).mean()  # of a text taken for 0 at score z
    return prior * loss(-(p @ w)), loss(u @ w) - prior * loss(p @ w)


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Direction in which the non-negative risk falls least: that of both parts while the second is 0 or more; below that
    the second alone, turned round, so that it climbs back."""
    sp, su = sigmoid(p @ w), sigmoid(u @ w)
    of_positive = prior * p.T @ (sp - 1) / len(p)
    of_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    return of_positive + of_negative if risk(w, p, u, prior)[1] >= 0 else -of_negative


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk."""
    return descend(lambda w: risk_gradient(w, p, u, prior) + L2 * w, p.shape[1])


def with_features(df: DataFrame, text: str) -> DataFrame:
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float32()))], [*keep, "_tl_x"])

    schema = df.select(*keep).withColumn("_tl_x", F.array(F.lit(0.0).cast("float"))).schema
    return df.mapInArrow(run, schema)


def fit(positives: DataFrame, unlabelled: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, prior: float | None = None) -> dict[str, np.ndarray | float] | None:
    """Model from about `sample` rows of each set, chosen by id hash; only their numbers (1.2 KB a row) come to the driver.

    None if either set has under two rows. Null texts are empty ones. The prior of all rows is estimated unless given; it, and that of
    the unlabelled which follows from it, leave one text on either side at least.
    """
    def some(df: DataFrame) -> np.ndarray:
        n = df.count()
        part = df.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1_000_000)) < min(1_000_000, 1_000_000 * sample // max(1, n))).select(doc_id, text)
        rows = with_features(part, text).select(doc_id, "_tl_x").toArrow().sort_by(doc_id)
        return rows["_tl_x"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)

    p, u = some(positives), some(unlabelled)
    if min(len(p), len(u)) < 2:
        return None
    mean, scale = np.vstack([p, u]).mean(axis=0), np.vstack([p, u]).std(axis=0) + 1e-3
    scale[N_PLAIN:] *= 2  # a hashed place weighs half as much as another number
    ready = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = ready(p), ready(u)
    # the prior among the unlabelled, from the one among all
    prior = estimate_prior(p, u) if prior is None else prior
    prior = two_sided((prior * (len(p) + len(u)) - len(p)) / len(u), len(u))
    return {"mean": mean, "scale": scale, "w": nn_pu(p, u, prior), "prior": prior}


def predict(df: DataFrame, model: dict[str, np.ndarray | float] | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """df with its text replaced by score (0 to 1) and predicted (1 if score >= least, else 0).

    Null and empty texts are scored as empty; without a model every score is 0.5. Repeated rows are scored alike. Columns score and predicted of df are replaced.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (text, "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(text)]).reshape(-1, N_FEATURES)
            scores = np.full(len(x), 0.5)
            if model:
                z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
                scores = sigmoid(z @ model["w"][:-1] + model["w"][-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores), pa.array((scores >= least).astype(np.int32))], [*keep, "score", "predicted"])

    return df.mapInArrow(run, df.select(*keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(0).cast("int")}).schema)
