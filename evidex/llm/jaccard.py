"""Near-duplicates by set similarity: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Such pairs lie about 10 of 64 bits apart as SimHash fingerprints, and often 15 or more, which no
feasible number of covering masks reaches.  So candidates come from min-hashes here, and what decides
is the similarity of the sets themselves: ``BANDS`` keys of ``ROWS`` min-hashes each, of which a pair of
similarity s shares one but for a chance of (1 - s**ROWS) ** BANDS, 4e-7 at 0.8 and less above.  With a ``radius``, the links of ``simhash`` are added to these.

Scale: equal sets collapse to one before anything else.  Sets that share a key are joined to the least
of them, and connected sets form a candidate cluster; only sets of clusters move, once unless their
cluster has more than ``block`` shingles.  Such a cluster is dealt by hash into blocks, and each pair of
its blocks is compared by a task of its own, so no cluster is ever held whole and none is capped; within
a cell only a spanning star of each group leaves the task.  Groups are contracted as in ``simhash``.

Defined results: words are those of ``simhash``; null text, empty text and text of white space have the
empty set and are copies of each other; shorter texts have the one shingle of all their words; repeated
rows and ids, rows without id and empty tables are taken; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, worker_memory
from .learning import slices
from .simhash import SEED, contract, fingerprints, first_row, one_each, shingle_hashes
from .simhash import links as print_links

ROWS, BANDS = 4, 28
#: Odd factors: each orders the shingle hashes in its own way.
FACTORS = (np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Sets are compared and kept by this many bytes of each hash.
WIDTH = 6


def packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes, none of the empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (FACTORS * hashes[None, i : i + 1024]).min(axis=1), out=least)
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ (key >> np.uint64(29))) * MIX + least[:, j]
    return key


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, th (hash of the text), rid (a number of its own), sid, n, hashes and keys of every row's set."""

    def run(batches):
        worker_memory("jaccard")
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                sets = [np.unique(shingle_hashes(t, shingle) & np.uint64((1 << 8 * WIDTH) - 1)) for t in part]
                keys = [band_keys(s) for s in sets]
                lists = [pa.array([packed(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), np.concatenate(keys).view(np.int64))]
                sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                rows = [batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(np.arange(rid, rid + len(part))), pa.array(sid), pa.array([len(s) for s in sets], pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "th", "rid", "sid", "n", "hashes", "keys"])
                at += len(part)
                rid += len(part)
        worker_memory("jaccard")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, rid long, sid long, n long, hashes binary, keys array<long>")


def stars(sids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(set, another of its group) of what is linked among some sets of sorted distinct hashes."""
    n = np.array([len(s) for s in sets])
    enough = lambda shared, a, b: shared >= similarity * (a + b - shared) - 1e-9
    if len(sets) == 2:
        return [(sids[1], sids[0])] if enough(len(np.intersect1d(*sets, assume_unique=True)), n[0], n[1]) else []
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), n)[np.argsort(ids, kind="stable")]  # of shingle i: from first[i], counts[i] of them
    first = np.cumsum(counts) - counts
    begin = np.cumsum(n) - n
    left = np.ones(len(sets), bool)
    out = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        todo = [seed]
        while todo and left.any():
            a = todo.pop()
            mine = ids[begin[a] : begin[a] + n[a]]
            k = counts[mine]
            places = np.repeat(first[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            near = np.flatnonzero(left & enough(np.bincount(holders[places], minlength=len(sets)), n[a], n))
            left[near] = False
            todo += near.tolist()
            out += [(sids[b], sids[seed]) for b in near.tolist()]
    return out


def links(prints: DataFrame, distinct: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): pairs of sets that join all groups linked by the similarity."""
    entries = prints.select("sid", F.explode("keys").alias("key")).distinct()
    least = entries.groupBy("key").agg(F.min("sid").alias("lead"), F.count(F.lit(1)).alias("shared")).filter("shared > 1")
    # A merge join by hint: the planner takes the entries for no larger than the table they are exploded from.
    met = entries.join(least.hint("merge"), "key").filter("sid <> lead").select(F.col("sid").alias("a"), F.col("lead").alias("b")).distinct()
    clusters = distinct.select("sid", "rid", "n", F.xxhash64("sid").alias("h")).join(contract(met, "candidates"), "h").select("root", "sid", "rid", "n")
    blocks = clusters.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
    dealt = clusters.join(blocks, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "sid", "rid")
    full = cells.join(prints.select("rid", "hashes"), "rid").select("root", "lo", "hi", "sid", "hashes")

    def run(table: pa.Table) -> pa.Table:
        sids, sets = table.column("sid").to_pylist(), [unpacked(x) for x in table.column("hashes").to_pylist()]
        out = stars(sids, sets, similarity) if len(sids) > 1 else []
        if table.nbytes > 1 << 20:
            worker_memory("jaccard")
        return pa.table([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return full.groupBy("root", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def near_prints(docs: DataFrame, texts: DataFrame, radius: int, cell: int) -> DataFrame:
    """(a, b): pairs of sets that join all groups of texts whose SimHash fingerprints are linked; ``texts``: th, sid of every text.

    Fingerprints are those of ``simhash``: four-word shingles, linked within ``radius`` bits by covering masks.
    Their groups are not contracted here but with those of the sets, in the same rounds."""
    prints = materialize(fingerprints(docs, 4, F.xxhash64("text").alias("th")).join(texts, "th").select("fp", "sid").distinct(), "near-prints")
    least = materialize(prints.groupBy("fp").agg(F.min("sid").alias("lead")), "near-least")
    same = prints.join(least, "fp").filter("sid <> lead").select(F.col("sid").alias("a"), F.col("lead").alias("b"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    met = print_links(least, radius, cell).join(of("a"), "a").join(of("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    return same.unionByName(met.filter("a <> b"))


def groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, block: int = 1 << 20, radius: int | None = None, cell: int = 1024) -> DataFrame:
    """first (see ``simhash.first_row``) of each group; with a ``radius``, SimHash fingerprints within it link as well."""
    prints = materialize(shingle_sets(docs, shingle), "jaccard", "snappy")
    distinct = materialize(prints.groupBy("sid").agg(first_row().alias("first"), F.min("rid").alias("rid"), F.min("n").alias("n")), "jaccard-distinct")
    found = links(prints, distinct, similarity, block)
    if radius is not None:
        found = found.unionByName(near_prints(docs, prints.select("th", "sid").distinct(), radius, cell))
    roots = contract(found, "jaccard")
    for path in {f.rsplit("/", 1)[0] for f in prints.inputFiles()}:  # the sets are as large as the texts
        drop_path(docs.sparkSession, path)
    rooted = distinct.withColumn("h", F.xxhash64("sid")).join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    return rooted.groupBy("root").agg(F.min("first").alias("first"))


def dedup(docs: DataFrame, **params) -> DataFrame:
    """One row of each group, of the least id, with all its columns: decided by row, not by id."""
    return one_each(docs, groups(docs, **params))
