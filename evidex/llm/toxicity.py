"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's probability is the logistic of a bias and the weights of its distinct features (words,
their beginnings and endings); a document's is the noisy-or of its sentences,
1 - prod(1 - p).  Both are trained together from document labels, so the sentences that explain a
toxic label are found without being labelled: the query returns them beside each document's score.

The model is fitted on the driver to a bounded sample: at most ``rows`` labelled documents and
``chars`` characters of them (see ``learning.labelled_sample``); features are chosen by how
far their document shares differ between the labels.  Scoring reads every whole text in Arrow
batches, without a shuffle.

Defined results: a null or empty text has no sentence and scores 0; repeated rows get equal
scores; where the sample lacks one of the labels, every score is 0; an empty table gives an empty
result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, worker_memory
from .learning import labelled_sample, slices

CUT = 0.3
FOLDS, HELD = 4, 2
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORDS = re.compile(r"[^\W\d_]+")
KNOWN = 200_000
NOISE = 0.01


def word_features(word: str) -> set[str]:
    """The word itself and its beginnings and endings."""
    return {f"={word}", *[f"^{word[:n]}" for n in (3, 4, 5) if len(word) >= n], *[f"${word[-n:]}" for n in (4, 5) if len(word) > n]}


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple] = field(default_factory=dict)

    def of(self, word: str) -> tuple:
        """The word's features that have weights."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            got = self.known[word] = tuple(x for x in word_features(word) if x in self.weights)
        return got

    def sentence_logits(self, text: str) -> list[float]:
        out = []
        for part in SENTENCE.findall(text.lower()):
            found = {x for w in set(WORDS.findall(part)) for x in self.of(w)}
            out.append(self.bias + sum(self.weights[x] for x in found))
        return out

    def judge(self, text: str, cut: float = CUT) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and start, end and score of its sentences that score at least ``cut``."""
        if not self.weights:
            return 0.0, []
        z = np.clip(np.array(self.sentence_logits(text)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        hot, spans = np.flatnonzero(p >= cut), []
        if len(hot):
            lowered = text.lower()
            at, place = sentences(lowered), places(text, lowered)
            spans = [(place[at[i][0]], place[at[i][1] - 1] + 1, float(p[i])) for i in hot]
        return float(-np.expm1(-np.logaddexp(0, z).sum())), spans

    def score(self, texts: list[str]) -> np.ndarray:
        return np.array([self.judge(x, np.inf)[0] for x in texts])


def choose(documents: list[set[str]], y: np.ndarray, most: int, least: int, bound: float) -> dict[str, float]:
    """The features whose document shares differ most, in units of their spread, with their log odds."""
    seen, toxic = Counter(), Counter()
    for words, label in zip(documents, y):
        own = set().union(*map(word_features, words))
        seen.update(own)
        if label:
            toxic.update(own)
    rate = y.mean()
    lift = {x: (n - seen[x] * rate) / np.sqrt(seen[x] * rate * (1 - rate)) for x, n in toxic.items() if seen[x] >= least}
    best = sorted((x for x in lift if lift[x] > bound), key=lambda x: (-lift[x], x))[:most]
    share = lambda a, n: (a + 0.5) / (n + 1)
    return {x: float(np.log(share(toxic[x], y.sum()) / share(seen[x] - toxic[x], len(y) - y.sum()))) for x in best}


def fit(sample: list[tuple[str, int]], most: int = 4000, epochs: int = 300, ridge: float = 0.01, least: int = 6, lift: float = 4.0) -> Model:
    """Noisy-or log-likelihood by Adam on all documents of the sample at once."""
    y = np.array([b for _, b in sample])
    if not len(y) or (y == 1).all() or (y != 1).all():
        return Model({}, 0.0)
    odds_of = choose([set(WORDS.findall(t.lower())) for t, _ in sample], (y == 1).astype(int), most, least, lift)
    names = list(odds_of)
    place = {x: i for i, x in enumerate(names)}
    own = Model(odds_of, 0.0)
    doc, rows, cols = array("i"), array("i"), array("i")
    n = 0
    for i, (text, _) in enumerate(sample):
        for part in SENTENCE.findall(text.lower()):
            found = {place[x] for w in set(WORDS.findall(part)) for x in own.of(w)}
            doc.append(i)
            rows.extend([n] * len(found))
            cols.extend(found)
            n += 1
    doc, rows, cols = (np.array(x, np.int64) for x in (doc, rows, cols))
    truth = (y == 1).astype(float)
    # Log odds as a start keep one clear sentence convincing even where most toxic documents have many.
    theta = np.append(np.clip([odds_of[x] for x in names], 0, 4), -6.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1):
        z = np.clip(np.bincount(rows, theta[cols], n) + theta[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        silent = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log of no sentence being toxic
        # A label is taken to be wrong with probability NOISE, so that no document counts without bound.
        none = np.exp(-silent)
        likely = NOISE + (1 - 2 * NOISE) * np.where(truth == 1, 1 - none, none)
        pull = (1 - 2 * NOISE) * none * np.where(truth == 1, 1, -1) / likely  # times p: d log-likelihood / dz of a sentence
        g = p * pull[doc]
        grad = np.append(np.bincount(cols, g[rows], len(names)), g.sum()) / len(y) - np.append(ridge / len(y) * theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({x: float(w) for x, w in zip(names, theta) if abs(w) > 1e-3}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = 6_000, chars: int = 12_000_000) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), FOLDS) != HELD, rows, chars))


def places(text: str, lowered: str) -> Sequence[int]:
    """For each character of the lower-cased text, the one of the text that it comes from."""
    if len(lowered) == len(text):
        return range(len(text))
    return [i for i, c in enumerate(text) for _ in c.lower()]


def judged(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score and sentences (start, end, score; code points, end exclusive) that score at least ``cut``, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        worker_memory("judged")
        own = shared.value
        for batch in batches:
            out = [own.judge(text, cut) for part in slices(batch.column(1)) for text in part]
            spans = pa.array([[dict(zip(("start", "end", "score"), x)) for x in found] for _, found in out], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.float64()), spans], names=["doc_id", "score", "sentences"])
        worker_memory("judged")

    own_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {own_kind}, score double, sentences array<struct<start:long,end:long,score:double>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every row."""
    out = judged(docs, train(docs, labels, **bounds))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "sentences")


def locate(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, start, end, score of every sentence that scores at least ``cut``."""
    return judged(docs, model, cut).select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.start", "s.end", "s.score")
