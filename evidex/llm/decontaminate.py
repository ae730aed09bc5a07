"""Benchmark decontamination: greedy string tiling by running Karp-Rabin.

Texts are compared as sequences of lower-cased words.  A rolling hash of ``least`` words finds the
seeds that a document shares with test items (shorter items are one seed).  For every pair with a
seed, the longest match that overlaps no earlier one is marked, again and again, until no match
of ``least`` words is left; the tiles may stand in any order, so reordered passages count.  A
document is contaminated if the tiles cover at least ``share`` of an item's words.

Scale: the benchmark is read in blocks of at most ``block_chars`` characters (one larger item is a
block of its own), and each block is broadcast and meets every whole document once, in Arrow
batches and without a shuffle.  More test items mean more blocks, never larger ones.  Of a pair
only the places where a match begins are held, at most as many as its two texts have words for every
different word before them, so repeated words cost no square of memory.

Ties: of equally long matches the one first in the item, then in the document, is marked.  A very
long text is one sequence of numbers; nothing of it is cut.

Defined results: null and empty texts and items without words match nothing; repeated items and
rows are each reported; an empty table gives an empty result; ``decontaminate`` keeps all columns,
``tiled`` reads doc_id and text, item_id and text only.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .learning import kept_by, slices

WORDS = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n ids, modulo 2**64."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    if not len(h):
        return h
    for j in range(n):
        h = h * BASE + ids[j : len(ids) - n + 1 + j]
    return h


def begins(item: np.ndarray, doc: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which of the seeds (p, t) have no equal words before them: a match begins there."""
    return (p == 0) | (t == 0) | (item[p - 1] != doc[t - 1])


def lengths(item: np.ndarray, doc: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many words are equal from each pair of places on, one word of all pairs at a time."""
    out = np.zeros(len(p), np.int64)
    alive = np.arange(len(p))
    k = 0
    while len(alive):
        alive = alive[(p[alive] + k < len(item)) & (t[alive] + k < len(doc))]
        alive = alive[item[p[alive] + k] == doc[t[alive] + k]]
        k += 1
        out[alive] = k
    return out


def tiles(item: Sequence[int], doc: Sequence[int], seeds: Sequence[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one pair from its seeds (place in item, place in document): longest first."""
    item, doc = np.asarray(item, np.uint64), np.asarray(doc, np.uint64)
    p, t = np.asarray(seeds, np.int64).reshape(-1, 2).T
    first = begins(item, doc, p, t)
    p, t = p[first], t[first]
    k = lengths(item, doc, p, t)
    heap = sorted((-n, a, b) for n, a, b in zip(k.tolist(), p.tolist(), t.tolist()) if n >= least)
    if not heap:
        return []
    base = min(b for _, _, b in heap)  # only the stretch of the document that any match touches is marked
    used_item, used_doc = np.zeros(len(item), bool), np.zeros(max(b - n for n, _, b in heap) - base, bool)
    found, room = [], len(item)
    while heap and room >= least:
        n, p, t = heapq.heappop(heap)
        n, u = -n, t - base
        used = used_item[p : p + n] | used_doc[u : u + n]
        if not used.any():
            used_item[p : p + n] = used_doc[u : u + n] = True
            room -= n
            found.append((p, t, n))
            continue
        ends = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for a, b in ends.reshape(-1, 2).tolist():  # what is left of the match between marked places
            if b - a >= least:
                heapq.heappush(heap, (a - b, p + a, t + a))
    return sorted(found)


class Block:
    """Some test items, indexed by the hashes of their seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int, share: float):
        self.least, self.share = least, share
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORDS.findall(text.lower())]
            if ids:
                n = min(least, len(ids))
                for p, h in enumerate(rolling(np.array(ids, np.uint64), n)):
                    self.seeds[n][int(h)].append((len(self.items), p))
                self.items.append((name, np.array(ids, np.uint64)))
        self.seeds = {n: dict(x) for n, x in self.seeds.items()}
        self.sorted = {n: np.sort(np.array(list(x), np.uint64)) for n, x in self.seeds.items()}

    def matches(self, text: str) -> Iterator[tuple[int, float, int, int, list]]:
        """(item_id, coverage, matched, n_words, tiles) of the items that the text contains."""
        ids = np.array([self.vocabulary.get(w, 0) for w in WORDS.findall(text.lower())], np.uint64)
        if not ids.any():
            return
        places: dict[int, list[tuple[list[int], np.ndarray]]] = defaultdict(list)
        for n, known in self.sorted.items():
            h = rolling(ids, n)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[at] == h)
            if not len(hit):
                continue
            hit = hit[np.argsort(at[hit], kind="stable")]
            for part in np.split(hit, np.flatnonzero(np.diff(at[hit])) + 1):  # the places of one seed
                for item, own in groupby(self.seeds[n][int(h[part[0]])], lambda x: x[0]):
                    places[item].append(([p for _, p in own], part))
        for item, seeds in sorted(places.items()):
            name, own = self.items[item]
            n = min(self.least, len(own))
            if len({p + i for ps, _ in seeds for p in ps for i in range(n)}) < self.share * len(own):
                continue  # even all seeds together cover too little
            starts = [np.stack([np.full(len(ts), p), ts], 1)[begins(own, ids, np.full(len(ts), p), ts)] for ps, ts in seeds for p in ps]
            found = tiles(own, ids, np.concatenate(starts), n)
            matched = sum(k for _, _, k in found)
            if matched and matched >= self.share * len(own):
                yield name, matched / len(own), matched, len(own), found


def blocks(benchmark: DataFrame, least: int, share: float, block_chars: int) -> Iterator[Block]:
    """The benchmark, a bounded part at a time."""
    part, size = [], 0
    for row in benchmark.select("item_id", "text").dropna(subset=["text"]).toLocalIterator():
        if part and size + len(row["text"]) > block_chars:
            yield Block(part, least, share)
            part, size = [], 0
        part.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if part:
        yield Block(part, least, share)


def tiled(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, coverage, matched, n_words, tiles of every contaminated document and its items."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, coverage double, matched long, n_words long, tiles array<struct<item_at:long,doc_at:long,n:long>>"
    out = docs.sparkSession.createDataFrame([], schema)
    tile = pa.list_(pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("n", pa.int64())]))
    for block in blocks(benchmark, least, share, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                at, found = [], []
                i = 0
                for part in slices(batch.column(1)):
                    for text in part:
                        got = list(shared.value.matches(text))
                        at += [i] * len(got)
                        found += got
                        i += 1
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                columns = [pa.array([x[k] for x in found]) for k in range(4)] if found else []
                parts = [[{"item_at": p, "doc_at": t, "n": n} for p, t, n in x[4]] for x in found]
                if found:
                    yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(parts, tile)], names=["doc_id", "item_id", "coverage", "matched", "n_words", "tiles"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5, block_chars: int = 4_000_000) -> DataFrame:
    """The rows that no test item contaminates, with all their columns and without a shuffle."""
    for block in blocks(benchmark, least, share, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = kept_by(docs, lambda shared=shared: lambda texts: np.array([next(shared.value.matches(t), None) is None for t in texts], bool))
    return docs
