"""Language ID by a linear-chain conditional random field over words.

Every word of a text gets a distribution over languages by forward-backward: affixes, character
n-grams and a lexicon score the word, learned transitions tie it to its neighbours, so the words of
code-switched texts are told apart.  A document's language is the one with the largest share of
its words; the score is that share.

The model is fitted on the driver to a bounded sample: per language at most ``rows`` documents of
the least hashes of doc_id and ``chars`` characters of them (see ``learning.fitting``).  Word labels start as the
document's language; halfway through, words are relabelled by the model itself, so that foreign
words in a document do not count as its language and switches are learned.  Prediction reads every
whole text in Arrow batches, without a shuffle; chunks of a long text are scanned side by side and
joined exactly by products of their transfer matrices.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties fall to the
language that sorts first; without a learnable language every text is ``und``; repeated rows get
equal results; an empty table gives an empty result; only doc_id, text and lang are read, lang only
for the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod
from .learning import SHARE, fitting, slices

FOLDS, HELD = 4, 2
WORDS = re.compile(r"[^\W\d_]+")
CHUNK = 64
KNOWN = 300_000
SALTS = 64
NONE = "und"


def word_features(word: str) -> list[str]:
    """The word for the lexicon, its affixes of up to 3 letters, and its 2- and 3-grams."""
    w = f"^{word}$"
    return ["=" + word, *["<" + word[:n] for n in (1, 2, 3)], *[">" + word[-n:] for n in (1, 2, 3)], *[w[i : i + 2] for i in range(len(w) - 1)], *[w[i : i + 3] for i in range(len(w) - 2)]]


def scan(e: np.ndarray, real: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: posteriors of all words, and the normalised forward and backward vectors.

    e: (chunks, CHUNK, K) word potentials; real: which places hold words, always a chunk's first
    ones; first: the first chunk of each document, ascending; trans: (K, K) potentials."""
    n, length, k = e.shape
    eye = np.eye(k)
    whole = np.broadcast_to(eye, (n, k, k)).copy()
    for t in range(length):  # each chunk's transfer matrix
        live = np.flatnonzero(real[:, t])
        if not len(live):
            break
        m = (whole[live].reshape(-1, k) @ trans).reshape(-1, k, k) * e[live, t][:, None, :]
        whole[live] = m / m.sum(axis=(1, 2), keepdims=True)
    count = np.diff(np.append(first, n))
    into, after = np.empty((n, k)), np.empty((n, k))
    v = np.full((len(first), k), 1.0 / k)
    for j in range(count.max(initial=0)):  # chunk by chunk, all documents at once
        live = np.flatnonzero(count > j)
        at = first[live] + j
        into[at] = v[live]
        v[live] = np.einsum("ni,nij->nj", v[live], whole[at])
        v[live] /= v[live].sum(axis=1, keepdims=True)
    v = np.full((len(first), k), 1.0)
    for j in range(count.max(initial=0)):
        live = np.flatnonzero(count > j)
        at = first[live] + count[live] - 1 - j
        after[at] = v[live]
        v[live] = np.einsum("nij,nj->ni", whole[at], v[live])
        v[live] /= v[live].sum(axis=1, keepdims=True)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    a = into
    for t in range(length):
        step = (a @ trans) * e[:, t]
        a = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), a)
        alpha[:, t] = a
    b = after
    for t in range(length - 1, -1, -1):
        beta[:, t] = b
        step = (b * e[:, t]) @ trans.T
        b = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), b)
    gamma = alpha * beta
    return gamma / np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300) * real[:, :, None], alpha, beta


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words in chunks: (chunks, CHUNK) word numbers, which are real, first chunk of each text.  Texts have words."""
    chunks = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.arange(chunks.sum()) - np.repeat(first, chunks)
    begin = np.repeat(starts, chunks) + inside * CHUNK
    size = np.minimum(CHUNK, np.repeat(starts + lengths, chunks) - begin)
    place = begin[:, None] + np.arange(CHUNK)[None, :]
    real = np.arange(CHUNK)[None, :] < size[:, None]
    return np.where(real, place, 0), real, first


@dataclass
class Model:
    languages: list[str]
    features: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def potentials(self, words: list[str]) -> np.ndarray:
        """(words, K): what each word says by itself."""
        rows, stops = [], [0]
        get = self.features.get
        for w in words:
            rows += [i for f in word_features(w) if (i := get(f)) is not None]
            stops.append(len(rows))
        sums = np.vstack([np.zeros((1, len(self.languages))), np.cumsum(self.weights[np.array(rows, int)], axis=0)]) if rows else np.zeros((1, len(self.languages)))
        z = np.diff(sums[np.array(stops)], axis=0)
        z = np.clip(z - z.max(axis=1, keepdims=True), -12, 0)
        return np.exp(z)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Potentials of distinct words, those seen before from memory."""
        if self.table is None or len(self.known) > KNOWN:
            self.known, self.table = {}, np.zeros((0, len(self.languages)))
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.vstack([self.table, self.potentials(new)])
        return self.table[np.fromiter(map(self.known.__getitem__, words), int, len(words))]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        found, lengths, at, numbers = [], [], [], {}
        for i, text in enumerate(texts):
            words = WORDS.findall(text.lower()) if self.languages else []
            if words and (any(map(str.isalpha, words)) or any(map(str.isalpha, text))):
                at.append(i)
                lengths.append(len(words))
                found += [numbers.setdefault(w, len(numbers)) for w in words]
        names, scores = [NONE] * len(texts), np.zeros(len(texts))
        if at:
            place, real, first = layout(np.array(lengths))
            e = self.lookup(list(numbers))[np.array(found)][place]
            gamma, _, _ = scan(e, real, first, self.trans)
            total = np.add.reduceat(gamma.sum(axis=1), first, axis=0)
            share = total / total.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            for i, b in zip(at, best):
                names[i] = self.languages[b]
            scores[np.array(at)] = np.minimum(share[np.arange(len(at)), best], 1.0)
        return names, scores


def fit(sample: list[tuple[str, str]], steps: int = 60, ridge: float = 1e-4) -> Model:
    """Conditional log-likelihood by Adam on the whole sample, relabelled once by the model itself."""
    languages = sorted({lang for _, lang in sample})
    k = len(languages)
    numbers: dict[str, int] = {}
    tokens, lengths, tags = [], [], []
    for text, lang in sample:
        words = WORDS.findall(text.lower())
        if words:
            tokens += [numbers.setdefault(w, len(numbers)) for w in words]
            lengths.append(len(words))
            tags += [languages.index(lang)] * len(words)
    if not lengths:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)))
    tokens, tags = np.array(tokens), np.array(tags)
    counts = np.bincount(tokens)
    features: dict[str, int] = {}
    rows, cols = [], []
    for word, i in numbers.items():
        for f in word_features(word):
            if f[0] != "=" or counts[i] >= 5:  # the lexicon holds words seen five times
                rows.append(i)
                cols.append(features.setdefault(f, len(features)))
    rows, cols = np.array(rows), np.array(cols)
    place, real, first = layout(np.array(lengths))
    theta, trans = np.zeros((len(features), k)), np.eye(k) * 2.0
    moments = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(trans), np.zeros_like(trans)]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.ones(len(tokens), bool)
    inner[starts] = False
    pairs = np.flatnonzero(inner)
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(rows, theta[cols, j], len(numbers)) for j in range(k)], axis=1)
        z = np.exp(np.clip(z - z.max(axis=1, keepdims=True), -12, 0))
        potential = np.exp(trans)
        gamma, alpha, beta = scan(z[tokens][place], real, first, potential)
        post, a, b = gamma[real], alpha[real], beta[real]
        if step == steps // 2:
            tags = post.argmax(axis=1)
        e = z[tokens[pairs]]
        joint = a[pairs - 1][:, :, None] * potential[None] * (e * b[pairs])[:, None, :]
        joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
        miss = np.eye(k)[tags] - post
        by_word = np.stack([np.bincount(tokens, miss[:, j], len(numbers)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(cols, by_word[rows, j], len(features)) for j in range(k)], axis=1) / len(tokens) - ridge * theta
        seen = np.bincount(tags[pairs - 1] * k + tags[pairs], minlength=k * k).reshape(k, k)
        grad_trans = (seen - joint.sum(axis=0)) / len(tokens) - ridge * trans
        for p, g, m, v in ((theta, grad, *moments[:2]), (trans, grad_trans, *moments[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    used = np.flatnonzero(np.abs(theta).max(axis=1) > 1e-3)
    renumber = {old: new for new, old in enumerate(used.tolist())}
    return Model(languages, {f: renumber[i] for f, i in features.items() if i in renumber}, theta[used], np.exp(trans - trans.max()))


def train(docs: DataFrame, rows: int = 300, chars: int = 400_000) -> Model:
    """The model of the documents outside the held-out fold."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    may = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD) & F.col("doc_id").isNotNull())
    each = may.select("doc_id", "lang", h.alias("h"), F.length("text").alias("n"), F.pmod(h, F.lit(SALTS)).alias("salt"))
    # Texts longer than a share of the budget come last, the shortest of them first, so that they take no places.
    order = [F.greatest(F.col("n"), F.lit(chars // SHARE)), "h", "doc_id", "n"]
    # Ranked within salts first: a frequent language is spread, and the last ranking sees a bounded number of rows.
    some = each.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= rows)
    ranked = some.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    by_lang: dict[str, list] = {}
    for r in sorted(ranked.filter(F.col("place") <= rows).collect(), key=lambda r: (r["lang"], r["place"])):
        by_lang.setdefault(r["lang"], []).append((r["doc_id"], r["n"]))
    chosen = [(i,) for sizes in by_lang.values() for i in sorted(fitting(sizes, chars))]
    if not chosen:
        return fit([])
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])).distinct())
    found = may.join(ids, "doc_id").select("doc_id", "text", "lang").distinct()
    return fit([(r["text"], r["lang"]) for r in sorted(found.toLocalIterator(), key=lambda r: (r["doc_id"], r["text"], r["lang"]))])


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, **bounds))

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for part in slices(batch.column(1)):
                a, b = model.value.predict(part)
                names += a
                scores += b.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")


def tag_words(texts: list[str], model: Model) -> list[list[tuple[str, str, float]]]:
    """(word, language, probability) of every word of some texts."""
    out = []
    for text in texts:
        words = WORDS.findall(text.lower())
        if not words or not model.languages:
            out.append([])
            continue
        place, real, first = layout(np.array([len(words)]))
        gamma, _, _ = scan(model.potentials(words)[place], real, first, model.trans)
        post = gamma[real]
        out.append([(w, model.languages[j], float(p[j])) for w, p, j in zip(words, post, post.argmax(axis=1))])
    return out
