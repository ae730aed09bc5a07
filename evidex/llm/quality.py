"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text.  It is learned from preference pairs (a
document labelled 1 is preferred to one labelled 0) by logistic loss on the difference of their
features, with Newton steps.  The threshold is the quantile of the training scores at the share of
label 0; the score is the logistic of the distance to it, moved so that the threshold scores
``CUT``.

The model is fitted on the driver to a bounded sample: at most ``rows`` labelled documents and
``chars`` characters of them (see ``learning.labelled_sample``), and ``pairs`` pairs.
Scoring reads every whole text in Arrow batches, without a shuffle.

Defined results: null and empty texts get the features of an empty text; repeated rows get equal
scores; where the sample lacks one of the labels, every score is 0.5; an empty table gives an empty
result; ``filter_quality`` keeps all columns, ``score_quality`` reads doc_id and text only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .learning import kept_by, labelled_sample, scored

CUT = 0.3
FOLDS, HELD = 5, 0
DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1")
MARKS = [i for i in range(33, 127) if not chr(i).isalnum()]
END = re.compile(r"[.!?]+")
# Byte classes: 0 other, 1 lower and non-ASCII, 2 upper, 3 digit, 4 space, 5 plain punctuation, 6 symbol.
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 6
CLASS[128:] = 1
for chars, number in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:'\"()-?!", 5)):
    CLASS[list(chars)] = number


def features(text: str) -> list[float]:
    """Shares and means over the whole text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=7)
    words = raw.split()
    k = max(1, len(words))
    letters = max(1, counts[1] + counts[2])
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:])) / k
    repeated = 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    runs = len(END.findall(text))
    ends = sum(CLASS[w[-1]] == 6 or w[-1:] == b"!" for w in words) / k
    marks = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[MARKS]
    bare = sum(not w.isalnum() and len(w) == 1 and w[0] < 128 for w in words) / k
    return [
        math.log1p(len(words)), len(raw) / k, counts[2] / letters, counts[3] / n, counts[5] / n, counts[6] / n, counts[4] / n,
        distinct / k, math.log1p(distinct) / math.log1p(k), same, repeated, len(set(lines)) / max(1, len(lines)), runs / k, math.log1p(k / max(1, runs)), ends, bare,
        len(DOUBLED.findall(raw)) / k, marks.max() / k, (marks > 0).sum() / len(MARKS),
    ]


@dataclass
class Model:
    low: np.ndarray
    mid: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    fitted: bool = True

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and how far they lie above and below the usual range."""
        z = (x - self.mid) / self.scale
        return np.clip(np.hstack([z, np.maximum(0, z - 2), np.maximum(0, -2 - z)]), -8, 8)

    def strength(self, texts: list[str]) -> np.ndarray:
        return self.expand(np.array([features(t) for t in texts])) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), 0.5)
        gap = np.clip(self.strength(texts) - self.threshold + math.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-gap))


def fit(sample: list[tuple[str, int]], pairs: int = 100_000, ridge: float = 1.0, seed: int = 7) -> Model:
    """Bradley-Terry by Newton steps on the pairs' differences."""
    y = np.array([b for _, b in sample])
    if not len(y) or (y == 1).all() or (y != 1).all():
        none = np.zeros(1)
        return Model(none, none, none, none, 0.0, False)
    x = np.array([features(t) for t, _ in sample])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    mid = np.median(x[good], axis=0)
    scale = np.maximum(np.percentile(x[good], 84, axis=0) - np.percentile(x[good], 16, axis=0), 1e-3) / 2
    model = Model(mid, mid, scale, np.zeros(0), 0.0)
    z = model.expand(x)
    draw = np.random.default_rng(seed)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = w
    model.threshold = float(np.quantile(z @ w, np.mean(y != 1)))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = 8_000, chars: int = 24_000_000) -> Model:
    return fit(labelled_sample(docs, labels, "quality", crc_mod(F.col("doc_id"), FOLDS) != HELD, rows, chars))


def score_quality(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))
    out = scored(docs, lambda: model.value.score)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_by(docs, lambda: lambda texts: shared.value.score(texts) >= CUT)
