"""A file tree as rows: listed folder by folder on executors, a round for each depth.

Folders that are ignored, hidden, links, unreadable or checkouts of their own are named with the reason and
never entered, so what they hold costs nothing.  The driver only learns whether a round found more folders.
Names of one folder are streamed.  Roots are folders or URIs that all executors see; only local ones tell links
and permissions.

Defined results: an empty or missing root gives no rows; a folder that goes away meanwhile gives none of its
files; links are named and not followed, so there are no cycles; a file gone before it is read is left out."""

from __future__ import annotations

import os
import stat
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import accepted, classify
from .rules import IGNORED_DIRS
from .store import kept

NAMES = 4096
ENTRY = "relative_path string, folder boolean, length long, micros long, symlink boolean, readable boolean, checkout boolean"


def local_entries(base: str, folder: str):
    """(name, folder, length, microseconds, symlink, readable, checkout) of what a folder of this machine holds."""
    with os.scandir(os.path.join(base, folder)) as found:
        for entry in found:
            try:
                info = entry.stat(follow_symlinks=False)
                link, inside = entry.is_symlink(), entry.is_dir(follow_symlinks=False)
                regular = inside or link or stat.S_ISREG(info.st_mode)
                readable = not link and regular and os.access(entry.path, os.R_OK | (os.X_OK if inside else 0))
                checkout = inside and os.path.lexists(os.path.join(entry.path, ".git"))
            except OSError:
                continue
            yield entry.name, inside, 0 if inside else info.st_size, info.st_mtime_ns // 1000, link, readable, checkout


def remote_entries(fs, base: str, folder: str):
    """The same of another file system, which tells no links and no permissions."""
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"))):
        inside = info.type == pafs.FileType.Directory
        checkout = inside and fs.get_file_info(f"{info.path}/.git").type != pafs.FileType.NotFound
        yield info.base_name, inside, 0 if inside else info.size, (info.mtime_ns or 0) // 1000, False, True, checkout


def _lister(root: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        names = [f.split(" ")[0] for f in ENTRY.split(", ")]
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows = []
            for folder in batch.column("relative_path").to_pylist():
                found = local_entries(base, folder) if isinstance(fs, pafs.LocalFileSystem) else remote_entries(fs, base, folder)
                try:
                    for name, *rest in found:
                        rows.append((f"{folder}/{name}" if folder else name, *rest))
                        if len(rows) == NAMES:
                            yield batch_of(rows)
                            rows = []
                except OSError:  # gone, or closed to us, since its parent was listed
                    continue
            if rows:
                yield batch_of(rows)

    return run


def refused() -> Column:
    """Why a folder is not entered, or null."""
    name = F.element_at(F.split("relative_path", "/"), -1)
    return F.when(F.col("symlink"), "symlink").when(F.lower(name).isin(*IGNORED_DIRS) | F.startswith(name, F.lit(".")) | F.col("checkout"), "ignored_dir").when(~F.col("readable"), "unreadable")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, folder, length, modificationTime, symlink, readable, reason of what lies below a root.

    Files have the reasons of ``files.classify``; folders without a reason were entered."""
    from ..operators.live import uri

    level, rounds = spark.createDataFrame([("",)], "relative_path string"), []
    while True:
        rounds.append(kept(level.mapInArrow(_lister(uri(root)), ENTRY), "tree"))
        inner = rounds[-1].filter(F.col("folder") & refused().isNull()).select("relative_path")
        if inner.isEmpty():
            break
        level = inner.repartition("relative_path")
    rows = reduce(DataFrame.unionByName, rounds).withColumn("modificationTime", F.timestamp_micros("micros"))
    named = classify(rows.drop("micros"))
    return named.withColumn("reason", F.when(F.col("folder"), refused()).otherwise(F.col("reason"))).drop("checkout")


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (relative_path, length, modificationTime) with their content, each read by the task that has its row."""
    from ..operators.live import uri

    where = uri(root)

    def read(batches):
        fs, base = pafs.FileSystem.from_uri(where)
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with fs.open_input_file(f"{base}/{row['relative_path']}") as source:
                        data = source.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([row["relative_path"]]), pa.array([row["length"]], pa.int64()), pa.array([row["micros"]], pa.int64()), pa.array([data], pa.binary())], names=["relative_path", "length", "micros", "content"])

    asked = files.select("relative_path", "length", F.unix_micros("modificationTime").alias("micros")).repartition("relative_path")
    return asked.mapInArrow(read, "relative_path string, length long, micros long, content binary").withColumn("modificationTime", F.timestamp_micros("micros")).drop("micros")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``files.read_sources`` by a walk: only what passes the rules of names and sizes is opened."""
    return accepted(contents(walk(spark, root).filter("not folder and reason is null"), root))
