"""Bounded labelled samples for the trained operators, and passes of whole batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import worker_memory

#: Text handled at a time within an Arrow batch, in characters.
SLICE = 4_000_000
#: Texts of more than this part of a sample's characters are left out of it, so that a few cannot fill it.
SHARE = 16


def fitting(sizes: list[tuple[int, int]], chars: int) -> set[int]:
    """The ids of a sample of up to ``chars`` characters, from (id, characters) in its order.

    What does not fit or is longer than ``chars / SHARE`` is passed over and the next one tried; only
    if nothing is left so, the shortest text is taken, whatever its length."""
    kept, room = set(), chars
    for i, n in sizes:
        if n <= min(room, chars // SHARE):
            kept.add(i)
            room -= n
    return kept or {min(sizes, key=lambda x: x[1])[0] for _ in sizes[:1]}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int) -> list[tuple[str, int]]:
    """Texts and labels of up to ``rows`` labelled documents and ``chars`` characters (see ``fitting``).

    ``learn`` says of doc_id whether its label may be learned.  The rows are those of the least
    hashes of doc_id, so the sample does not depend on how the tables are partitioned; null ids,
    labels and texts are left out.  Only the ids of the sample are broadcast, at most ``rows``."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    few = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col(label).cast("int").alias("y")).orderBy(order, "doc_id", "y").limit(rows)
    ids = [(r["doc_id"], r["y"]) for r in few.collect()]
    if not ids:
        return []
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))
    there = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id")
    sizes = there.select("doc_id", order.alias("h"), F.length("text").alias("n")).groupBy("doc_id", "h").agg(F.max("n").alias("n")).orderBy("h", "doc_id").collect()
    kept = fitting([(r["doc_id"], r["n"]) for r in sizes], chars)
    last = F.broadcast(spark.createDataFrame([x for x in ids if x[0] in kept], "doc_id long, y int"))
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(last, "doc_id").select("doc_id", "text", "y").distinct()
    return [(r["text"], r["y"]) for r in sorted(found.toLocalIterator(), key=lambda r: (r["doc_id"], r["text"], r["y"]))]


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in order, a few MB at a time; null is empty."""
    part, size = [], 0
    for x in texts:
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def scored(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """doc_id and the score of each text; ``make`` builds the scorer, once a task."""

    def run(batches):
        worker_memory("scored")
        score = make()
        for batch in batches:
            out = [score(part) for part in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["doc_id", "score"])
        worker_memory("scored")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def kept_by(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows whose texts ``make()`` marks true, with all their columns and without a shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        worker_memory("kept_by")
        keep = make()
        for batch in batches:
            marks = [keep(part) for part in slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(marks) if marks else [], pa.bool_()))
        worker_memory("kept_by")

    return docs.mapInArrow(run, docs.schema)
