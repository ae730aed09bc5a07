"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the hashes of its word shingles.  Bit i of the
fingerprint gets a vector m(i) of r + 1 bits; for each nonzero v of r + 1 bits a mask keeps the bits
with odd <m(i), v>.  For any r positions some v is orthogonal to their vectors, so any two
fingerprints that differ in at most r bits agree under some of the 2**(r+1) - 1 masks: no pair within
the radius is missed.

Scale: exact copies collapse to one fingerprint before anything else.  A bucket (mask, masked
fingerprint) of more than ``cell`` fingerprints is dealt by hash into blocks, and each pair of its
blocks is compared by a task of its own, so no bucket is ever held whole and none is capped; within
a cell only a spanning star of each group leaves the task, never all pairs.  Groups are contracted
in rounds whose tables lie in the shared folder; the driver sees only whether links are left.

Defined results: null text, empty text and text of white space have fingerprint zero, linked like
any other; shorter texts have the one shingle of all their words; null ids never become a
component's id unless all its ids are null; repeated rows and ids are kept; an empty table gives an
empty result; columns besides doc_id and text are not read by ``components``.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, materialize, worker_memory
from .learning import slices

SEED = 42
PLACES = (np.arange(8) * 256)[None, :]
#: Row 256 p + b, column j: whether bit j of the fingerprint is set in byte b at place p.
BITS = np.zeros((2048, 64), np.float32)
for _p in range(8):
    for _j in range(8):
        BITS[_p * 256 : (_p + 1) * 256, _p * 8 + _j] = (np.arange(256) >> _j) & 1


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hashes of a text's word shingles in order, none of a text without words."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    n = min(shingle, len(words))
    parts = words if n < 2 else map(b" ".join, zip(*[words[i:] for i in range(n)]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in parts], "<u8")


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + PLACES).ravel(), minlength=2048).astype(np.float64) @ BITS
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, *more: Column) -> DataFrame:
    """doc_id and its fingerprint as a signed long, with further columns of long."""
    rows = docs.select("doc_id", "text", *more)
    names = ["doc_id", *rows.columns[2:], "fp"]

    def run(batches):
        worker_memory("simhash")
        for batch in batches:
            out = [fingerprint(t, shingle) for part in slices(batch.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.array(out, np.uint64).view(np.int64))], names=names)
        worker_memory("simhash")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{c} long" for c in names[1:]]]))


def masks(radius: int) -> list[int]:
    """The covering masks, as signed longs."""
    top = 1 << (radius + 1)

    def of(vector: list[int]) -> list[int]:
        return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, top)]

    if top - 1 <= 64:  # every nonzero vector is used about as often
        every = of([i % (top - 1) + 1 for i in range(64)])
    else:  # a choice of vectors under which even the thinnest mask keeps many bits
        tries = [of(random.Random(seed).sample(range(1, top), 64)) for seed in range(100)]
        every = max(tries, key=lambda masks_: min(m.bit_count() for m in masks_))
    return [m - (1 << 64) if m >> 63 else m for m in every]


def stars(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, least fingerprint of its group) of what is linked among some fingerprints."""
    if len(found) == 2:
        a, b = sorted(found.tolist())
        return [(b, a)] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius else []
    x = np.unique(found)
    u = x.view(np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    while True:
        least = np.where(near, label[None, :], len(x)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(x[i]), int(x[j])) for i, j in enumerate(label) if i != j]


def links(distinct: DataFrame, radius: int, cell: int) -> DataFrame:
    """(a, b): pairs of fingerprints that join all groups linked within the radius."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks(radius)])
    # The distinct fingerprints are a small table that grows by the number of masks here: dealt out first, by number.
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    entries = dealt.select("fp", F.posexplode(keys).alias("v", "key")).withColumn("v", F.col("v").cast("byte"))
    shared = entries.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A merge join by hint: the planner takes the entries for no larger than the table they are exploded from.
    met = entries.join(shared.hint("merge"), ["v", "key"]).withColumn("blocks", F.ceil(F.col("n") / cell).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = met.withColumn("own", own).withColumn("other", other).select("v", "key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = cells.groupBy("v", "key", "lo", "hi").agg(F.collect_list("fp").alias("fps"))

    def run(batches):
        worker_memory("simhash")
        for batch in batches:
            column = batch.column(0)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            out = [e for a, b in zip(offsets[:-1], offsets[1:]) if b - a > 1 for e in stars(values[a:b], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return full.select("fps").mapInArrow(run, "a long, b long").distinct()


def contract(edges: DataFrame, name: str = "groups") -> DataFrame:
    """(node, root) of every node of the edges (a, b): equal roots for connected nodes.

    Nodes are taken in the order of a one-to-one hash, so a round removes a constant share of
    them whatever the shape of the groups: each node joins its least neighbour, followed twice."""
    spark = edges.sparkSession
    hashed = lambda c: F.xxhash64(c)  # noqa: E731  one-to-one on a long
    left = materialize(edges.select(hashed("a").alias("a"), hashed("b").alias("b")), f"{name}-edges")
    roots = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("x", F.col("q").alias("p"))
        parent = materialize(parent, f"{name}-parents")
        if roots is None:
            new = parent.select(F.col("x").alias("h"), F.col("p").alias("root"))
        else:
            new = roots.join(parent, roots["root"] == parent["x"], "left").select("h", F.coalesce("p", "root").alias("root"))
        new = materialize(new, f"{name}-roots")
        to = lambda df, c: df.join(parent.withColumnRenamed("x", c), c).drop(c).withColumnRenamed("p", c)  # noqa: E731, B023
        fewer = materialize(to(to(left, "a"), "b").filter("a <> b").distinct(), f"{name}-edges")
        for old in (left, roots, parent):
            if old is not None:
                for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
                    drop_path(spark, path)
        left, roots = fewer, new
    if roots is None:
        roots = spark.createDataFrame([], "h long, root long")
    return roots


def rooted(prints: DataFrame, rep: Column, radius: int, cell: int) -> DataFrame:
    """fp, rep, root of every distinct fingerprint: ``rep`` over its rows, equal roots for linked ones."""
    distinct = materialize(prints.groupBy("fp").agg(rep.alias("rep")), "simhash-distinct")
    roots = contract(links(distinct, radius, cell), "simhash")
    return distinct.withColumn("h", F.xxhash64("fp")).join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))


def components(docs: DataFrame, *, shingle: int = 4, radius: int = 4, cell: int = 1024) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = materialize(fingerprints(docs, shingle), "simhash")
    linked = rooted(prints, F.min("doc_id"), radius, cell)
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def first_row() -> Column:
    """The row of the least id among some rows (doc_id, th), those without id last: a row is its id and its text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))


def one_each(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows named by ``first`` (a column ``first`` of ``first_row``), each once, with all their columns."""
    keep = first.select(F.col("first.doc_id").alias("keep_id"), F.col("first.th").alias("keep_text"))
    met = docs.join(keep, (F.xxhash64(docs["text"]) == keep["keep_text"]) & docs["doc_id"].eqNullSafe(keep["keep_id"]))
    place = F.row_number().over(W.partitionBy("keep_text", "keep_id").orderBy("keep_text"))
    return met.withColumn("keep_rank", place).filter("keep_rank = 1").select(*[docs[c] for c in docs.columns])


def dedup(docs: DataFrame, *, shingle: int = 4, radius: int = 4, cell: int = 1024) -> DataFrame:
    """One row of each component, of the least id, with all its columns.

    Decided by row, not by id: a row without id stays only if its component has no id, and then one;
    rows that share an id but are in different components all stay."""
    prints = materialize(fingerprints(docs, shingle, F.xxhash64("text").alias("th")), "simhash")
    return one_each(docs, rooted(prints, first_row(), radius, cell).groupBy("root").agg(F.min("rep").alias("first")))
