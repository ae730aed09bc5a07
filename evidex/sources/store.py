"""Snapshots of many tables: data goes to new folders first, then one manifest names them all.

A reader that holds a manifest sees one state of all tables, whatever is written meanwhile; a job
that dies before its manifest is renamed leaves no trace in any table.  Plain Parquet, any file system."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMAT_VERSION = 4


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``.

    Only a session on one machine may have none; it gets a temporary folder, gone when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="evidex-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/evidex/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """What a plan gives, written to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self.jvm.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last committed state: version, and for each table the folders that make it up."""
        path = self.jvm.Path(f"{self.root}/_manifests")
        if not self.fs.exists(path):
            return {"format_version": FORMAT_VERSION, "version": 0, "tables": {}}
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(path) if f.getPath().getName().endswith(".json"))
        if not names:
            return {"format_version": FORMAT_VERSION, "version": 0, "tables": {}}
        stream = self.fs.open(self.jvm.Path(f"{self.root}/_manifests/{names[-1]}"))
        try:
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if state["format_version"] > FORMAT_VERSION:
            raise ValueError(f"the store is of a newer format: {state['format_version']}")
        return state

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in self.manifest()["tables"][table]])

    def folders(self) -> list[tuple[str, str, int]]:
        """(table, folder, bytes) of everything that was ever written and not deleted."""
        top = self.jvm.Path(self.root)
        names = [f.getPath() for f in self.fs.listStatus(top) if f.isDirectory() and f.getPath().getName() != "_manifests"] if self.fs.exists(top) else []
        return sorted((n.getName(), f.getPath().getName(), self.fs.getContentSummary(f.getPath()).getLength()) for n in names for f in self.fs.listStatus(n) if f.isDirectory())

    def delete(self, folder: str) -> None:
        self.fs.delete(self.jvm.Path(f"{self.root}/{folder}"), True)

    def place(self, table: str, df: DataFrame) -> tuple[str, DataFrame]:
        """Rows written to a new folder of a table, and read back; they belong to it once a commit is told of the folder (``placed``)."""
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, drop: list[str] | None = None, placed: dict[str, str] | None = None, format_version: int | None = None, first_format: int = FORMAT_VERSION) -> int:
        """Write tables anew, add to them or drop them, all at once; the new version.

        Another commit in between makes this one fail instead of hiding it.  The format never falls;
        ``first_format`` is that of a store's first commit."""
        state = self.manifest()
        state["format_version"] = state["format_version"] if state["version"] else first_format
        tables = {n: f for n, f in state["tables"].items() if n not in (drop or [])}
        reached = max(state["format_version"], format_version or 0)
        for adds, frames in ((False, replace or {}), (True, append or {})):
            for name, df in frames.items():
                folder, _ = self.place(name, df)
                tables[name] = [*(tables.get(name, []) if adds else []), folder]
        for name, folder in (placed or {}).items():
            tables[name] = [*tables.get(name, []), folder]
        version = state["version"] + 1
        text = json.dumps({"format_version": reached, "version": version, "tables": tables}, sort_keys=True)
        part, final = (self.jvm.Path(f"{self.root}/_manifests/{n}") for n in (f"_{uuid.uuid4().hex}", f"{version:012d}.json"))
        out = self.fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(part, final):
            self.fs.delete(part, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version
