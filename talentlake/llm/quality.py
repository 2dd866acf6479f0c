"""Quality classifier by positive-unlabelled learning.

A linear scorer over style features is fitted by minimising the non-negative unbiased risk
(Kiryo et al., 2017) of trusted positives and unlabelled web text:

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss; ``prior`` is the estimated share of good documents.  The fit uses a bounded
hash sample (``MAX_POSITIVES``, ``MAX_UNLABELLED`` expected rows); scoring reads every whole text.

The features are language-free: frequencies of neighbouring byte classes (letters, digits, white
space, each kind of punctuation) and how much words, lines and neighbouring words repeat.

Defined results: null and empty texts have all features 0 and get the score of that point; a row
with a null doc_id is never learned from and is not held out; repeated rows get equal scores.
Without positives or other training rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.session import ship_package

MAX_POSITIVES = 6_000
MAX_UNLABELLED = 8_000
THRESHOLD = 0.3
#: features whose deviation is taken at a time, as that copies them
COLUMNS = 64

#: characters of one class each; all other punctuation is one more class
_PUNCTUATION = [".", ",", "!", "?", ";:", "'\"", "-_", "()[]{}", "#", "$", "%", "&", "*", "|", "/\\", "@", "=+<>~^"]
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _CONTROL, _HIGH = range(7)
_OTHER = 7 + len(_PUNCTUATION)
N_CLASSES = _OTHER + 1
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 7


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    table[:32], table[127], table[128:] = _CONTROL, _CONTROL, _HIGH
    table[ord(" ")], table[ord("\n")] = _SPACE, _LINE
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
                        ("0123456789", _DIGIT), *((c, 7 + i) for i, c in enumerate(_PUNCTUATION))):
        table[[ord(c) for c in chars]] = kind
    return table


_CLASSES = _byte_classes()


def text_features(text: bytes) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    kinds = _CLASSES[np.frombuffer(text, np.uint8)]
    n, pairs = len(kinds), N_CLASSES * N_CLASSES
    out[:pairs] = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=pairs)
    out[pairs:pairs + N_CLASSES] = np.bincount(kinds, minlength=N_CLASSES)
    out[:pairs + N_CLASSES] = np.sqrt(out[:pairs + N_CLASSES] / n)
    words, lines = text.lower().split(), [x for x in text.split(b"\n") if x.strip()]
    if words:
        m = len(words)
        distinct = len(set(words))
        runs = sum(a == b for a, b in zip(words, words[1:]))
        thirds = len(set(zip(words, words[1:], words[2:])))
        out[-7:] = (np.log1p(m) / 10, distinct / m, distinct / m ** 0.75, runs / m, thirds / max(1, m - 2),
                    len(set(lines)) / len(lines), np.log1p(n / m))
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 200, rate: float = 0.03,
             decay: float = 1e-3) -> QualityModel:
    """Full-batch Adam on the non-negative risk of a linear scorer.

    Where the negative part falls below zero, the step climbs it back (the ascent step of the
    non-negative estimator) instead of fitting the positives' noise.
    """
    return _fitted(np.concatenate([positive, unlabelled]), len(positive), prior, steps, rate, decay)


def _fitted(x: np.ndarray, n_positive: int, prior: float, steps: int = 200, rate: float = 0.03, decay: float = 1e-3) -> QualityModel:
    """``fit_nnpu`` of the positives and, below them, the unlabelled rows; ``x`` is overwritten, as the driver holds it but once."""
    if not n_positive or n_positive == len(x):
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    mean, scale = x.mean(0), np.concatenate([x[:, i:i + COLUMNS].std(0) for i in range(0, x.shape[1], COLUMNS)]) + 1e-3
    np.subtract(x, mean, out=x)
    np.divide(x, scale, out=x)
    x = np.clip(x, -8, 8, out=x).astype(np.float32, copy=False)
    p, u = x[:n_positive], x[n_positive:]
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z.clip(-40, 40)))
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # gradients of the means: loss(+1) is log(1 + e^-z), loss(-1) is log(1 + e^z)
        g_pos = -prior * (1 - sigmoid(zp)) / len(p)
        g_neg_p, g_neg_u = -prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        if negative < 0:
            gp, gu = -g_neg_p, -g_neg_u
        else:
            gp, gu = g_pos + g_neg_p, g_neg_u
        g = np.append(gp @ p + gu @ u + decay * w, gp.sum() + gu.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return QualityModel(mean, scale, w, float(b))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _sampled(key: Column, share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def _features(rows: DataFrame, text: str) -> np.ndarray:
    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([text_features((t or "").encode()).tobytes() for t in texts.to_pylist()], pa.binary())

    got = rows.select(features(F.col(f"`{text}`")).alias("x")).collect()
    return np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, N_FEATURES)


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    """Fit on rows outside the held-out fold.

    The class prior is the share of positives among the labelled training rows; of the labels, the
    fit itself only sees the positives.  A document with contradicting labels counts as negative.
    """
    ship_package(docs.sparkSession)
    own = F.col(f"`{doc_id}`")
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    n, good = known.agg(F.count(F.lit(1)), F.sum("quality")).first()
    if not good:
        return fit_nnpu(np.zeros((0, N_FEATURES)), np.zeros((0, N_FEATURES)), 1.0)
    trainable = docs.filter(own.isNotNull() & ~held_out(own))
    rows = trainable.select(own).count()
    # sampled before the broadcast: max_positives ids are expected
    chosen = known.filter("quality = 1").filter(_sampled(F.col("doc_id"), min(1.0, max_positives / good), 1))
    positive = trainable.join(F.broadcast(chosen.select(F.col("doc_id").alias(doc_id))), doc_id, "left_semi")
    unlabelled = trainable.filter(_sampled(own, min(1.0, max_unlabelled / max(rows, 1)), 2))
    parts = [_features(positive, text), _features(unlabelled, text)]
    both, n_positive = np.concatenate(parts), len(parts[0])
    parts.clear()
    return _fitted(both, n_positive, min(0.98, good / n))


def score_column(spark, model: QualityModel, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.zeros((len(texts), N_FEATURES), np.float32)
        for i, t in enumerate(texts):
            x[i] = text_features((t.as_py() or "").encode())
        return pa.array(shared.value.score(x).astype(np.float64), pa.float64())

    return score(text)


def classify_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                     threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``docs`` with held_out, score and predicted (these replace columns of the same name)."""
    model = fit_quality(docs, labels, text, doc_id, **bounds)
    return docs.withColumns({"held_out": held_out(F.col(f"`{doc_id}`")),
                             "score": score_column(docs.sparkSession, model, F.col(f"`{text}`"))}
                            ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
