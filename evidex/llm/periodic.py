"""Periodic run detection on a harmonic grid of longest common extensions.

A run is a maximal stretch of words that repeats with a smallest period, several times over.  For each
period p the grid holds the pairs (jp, (j+1)p); the forward and backward longest common extensions of
a pair give the widest stretch around it that has period p.  A stretch of at least three periods
holds such pairs, so none is missed; stretches found under several periods are runs of the least one.
Extensions are range minima over the common prefixes of a suffix array of the words, and of a
second one of the reversed words.

A pair whose own words differ extends nowhere, and a run makes a known number of consecutive pairs
of its period agree.  So the grid is first compared word by word, and suffix arrays are only built
for texts in which that many pairs agree.

Scale: a text is one row of work, n log n in its words, without any shuffle; texts pass in slices of
a few MB, and a task holds the arrays of one text (some 200 bytes a word where runs are suspected).
Losing an executor costs its tasks alone.

Defined results: null text counts as empty; an empty text or one without words has no run and
collapses to the empty text; of runs that cover each other, each is reported; repeated rows give
repeated rows; null ids stay null; an empty table gives an empty result; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_memory
from .learning import slices

LEAST, REPEATS = 24, 3
#: Grid pairs compared at a time.
PAIRS = 1 << 21
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Extensions:
    """Lengths of common prefixes of two suffixes: suffix array, adjacent common prefixes, range minima."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        ranks, width = [np.unique(words, return_inverse=True)[1].astype(np.int32)], 1
        while ranks[-1].max() < n - 1:  # ranks of twice as long beginnings, until all differ
            after = np.zeros(n, np.int64)
            after[: n - width] = ranks[-1][width:] + 1
            ranks.append(np.unique(ranks[-1] * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.rank = ranks[-1]
        suffixes = np.argsort(self.rank)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n - 1, np.int32)
        for level in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
            for x in (common, a, b):
                x[same] += 1 << level
        self.minima = [common]
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def agreeing(words: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid pairs that may lie in a run: in as many consecutive agreeing pairs as a run has."""
    n, last = len(words), len(words) // repeats
    places, periods = [], []
    first = 1
    while first <= last:
        to = first
        room = PAIRS
        while to <= last and room > 0:  # periods from first on, some two million pairs
            step = min(last + 1 - to, max(1, room * to // n))
            room -= step * (n // to + 1)
            to += step
        period = np.arange(first, to)
        pairs = (n - 1) // period
        start = np.cumsum(pairs + 1) - pairs - 1  # one closing place each
        p = np.repeat(period, pairs + 1)
        i = (np.arange(len(p)) - np.repeat(start, pairs + 1)) * p
        closing = start + pairs
        i[closing] = 0
        same = words[i] == words[np.minimum(i + p, n - 1)]
        same[closing] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        need = np.maximum(least - p[begin], (repeats - 1) * p[begin]) // p[begin]
        for b, e in zip(begin[end - begin >= need], end[end - begin >= need]):
            places.append(i[b:e])
            periods.append(p[b:e])
        first = to
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``least`` words and ``repeats`` (2 or more) periods, by start, then period."""
    n = len(words)
    i, p = agreeing(words, least, repeats) if n >= least else (np.empty(0, np.int64),) * 2
    if not len(i):
        return np.empty((0, 3), np.int64)
    ahead, behind = Extensions(words), Extensions(words[::-1])
    found = np.empty((0, 3), np.int64)
    for at in range(0, len(i), PAIRS):
        x, q = i[at : at + PAIRS], p[at : at + PAIRS]
        back = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x)
        back[inner] = behind(n - x[inner], n - x[inner] - q[inner])
        start, stop = x - back, x + q + ahead(x, x + q)
        long = stop - start >= np.maximum(least, repeats * q)
        found = np.unique(np.concatenate([found, np.stack([start, stop - start, q], axis=1)[long]]), axis=0)
    kept = np.ones(len(found), bool)  # of equal stretches the first has the least period
    kept[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[kept]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, without those of a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, rewrite: Callable | None = None) -> DataFrame:
    """doc_id, its runs (start, length, period in words) and the text with its repeats collapsed.

    ``rewrite``, from (doc_id, words) to words, may change the words first."""

    def run(batches):
        worker_memory("periodic")
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1)):
                found, texts = [], []
                for name, text in zip(ids[at : at + len(part)], part):
                    words = text.encode("utf-8", "replace").split()  # bytes: ASCII white space only
                    if rewrite:
                        words = rewrite(name, words)
                    number: dict[bytes, int] = {}
                    coded = np.array([number.setdefault(x, len(number)) for x in words], np.int32)
                    own = find_runs(coded, least, repeats)
                    found.append(own)
                    texts.append(collapsed(words, own))
                flat = np.concatenate(found)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
                each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(offsets, each), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])
                at += len(part)
        worker_memory("periodic")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: in every tenth document a tail repeats (a null id leaves its words as they are)."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    greater = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    by_exponent = lambda a, b: (
        F.when(greater(a, b) != 0, -F.signum(greater(a, b))).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")
    )
    best = F.get(F.array_sort("runs", by_exponent), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return periodic(docs, rewrite=planted).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        ((best["length"] * 1000 - best["length"] * 1000 % best["period"]) / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashes AS (
  SELECT k, doc_id, w, len(w)::BIGINT AS n, xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::BIGINT)),
        lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) AS h
  FROM texts),
marks AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM hashes),
periods AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM marks),
edits AS (
  SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM periods),
places AS (
  SELECT k, n, unnest(w) AS word, unnest(range(n)) AS i FROM edits),
equal AS (
  SELECT x.k, y.i - x.i AS p, x.i FROM places x JOIN places y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (
  SELECT k, p, i, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS island FROM equal),
stretches AS (
  SELECT k, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY k, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (
  SELECT k, start, length, min(p) AS period FROM stretches GROUP BY k, start, length),
listed AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY k),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length::DOUBLE / period DESC, start, period) = 1),
dropped AS (
  SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS collapsed FROM (FROM places ANTI JOIN dropped USING (k, i)) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""
