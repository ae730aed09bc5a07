"""Text of spans from the files themselves, in place of a stored copy.

A span is live while its file has the hash that the span was taken from; only then is the file's text
returned.  Each file is hashed once, in blocks of 1 MB; the tasks that hold its spans seek to them by the stored
offsets of every 64th line, if its size and time are still those of the hashing.  Texts read are not shuffled.
No file is held whole, but for those whose bytes are no UTF-8 (other code pages, word-processor files).

Files lie below one root, a folder or URI that all executors see.

Defined results: a file that is gone, unreadable, a folder, or named by a path that leaves the root is
``missing``; one with another hash, or a span without a hash, is ``changed``.  Either way the stored text is
given and the span is stale; a null stored text counts as empty.  Lines past the end, or a null line, give
an empty text.  Rows that repeat are all returned; an empty table gives none.  Columns named ``text``,
``stale`` or ``live_state`` are replaced, all others kept."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import decode_bytes, docx_text

STEP, BLOCK, SALTS = 64, 1 << 20, 16
BREAK = re.compile(rb"\r\n?|\n")
STATE = ["place", "live_hash", "live_size", "live_time"]


def offsets_of(data: bytes) -> list[int] | None:
    """Where every 64th line begins; None where lines cannot be cut from the bytes as they are."""
    if 0 in data[:4096]:
        return None
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return [0] + [m.end() for i, m in enumerate(BREAK.finditer(data), 1) if i % STEP == 0]


@F.pandas_udf(T.ArrayType(T.LongType()))
def offsets_udf(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or p.lower().endswith(".docx") else offsets_of(c) for c, p in zip(content, path)], dtype=object)


def line_index(files: DataFrame) -> DataFrame:
    """path, content_hash, offsets of files (path, content): what ``hydrate`` seeks by, a number for every 64 lines."""
    named = files.filter("path is not null")
    return named.select("path", F.sha2("content", 256).alias("content_hash"), offsets_udf("content", "path").alias("offsets")).dropDuplicates(["path", "content_hash"])


def below(path: str) -> bool:
    """Whether a relative path stays below its root."""
    return not posixpath.isabs(path) and posixpath.normpath(path).split("/")[0] not in ("..", ".")


class _File:
    """A live file of known size and time, from which lines are read by offset."""

    def __init__(self, fs, base: str, path: str, size: int, time: int):
        self.path, self.size, self.time, self.source, self.lines = path, size, time, None, None
        try:
            info = fs.get_file_info(f"{base}/{path}")
            if (info.size, info.mtime_ns) == (size, time):
                self.source = fs.open_input_file(info.path)
        except OSError:
            pass

    def close(self) -> None:
        if self.source is not None:
            self.source.close()

    def read(self, start: int, end: int) -> bytes:
        self.source.seek(start)
        return self.source.read(end - start)

    def text(self, first: int | None, last: int | None, offsets: list[int] | None) -> str | None:
        """Lines first to last, counted from 1, without the space around them."""
        if first is None or last is None:
            return ""
        first = max(1, first)
        if offsets is None:
            if self.lines is None:
                data = self.read(0, self.size)
                whole = docx_text(data) if self.path.lower().endswith(".docx") else decode_bytes(data)
                self.lines = None if whole is None else re.split(r"\r\n|\r|\n", whole)
            return None if self.lines is None else "\n".join(self.lines[first - 1 : last]).strip()
        page = (first - 1) // STEP
        if page >= len(offsets) or last < first:
            return ""
        after = (last - 1) // STEP + 1
        data = self.read(offsets[page], offsets[after] if after < len(offsets) else self.size)
        lines = re.split(r"\r\n|\r|\n", data.decode("utf-8-sig" if page == 0 else "utf-8", "replace"))
        return "\n".join(lines[first - 1 - page * STEP : last - page * STEP]).strip()


def states(paths: DataFrame, root: str) -> DataFrame:
    """place, live_hash, live_size, live_time of files (place) as they are; null where there is no such file to read.

    Each file is read in blocks of 1 MB by one task."""
    where = uri(root)

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(where)
        for batch in batches:
            rows = []
            for place in batch.column("place").to_pylist():
                found = (None, None, None)
                try:
                    info = fs.get_file_info(f"{base}/{place}") if below(place) else None
                    if info is not None and info.type == pafs.FileType.File:
                        digest = hashlib.sha256()
                        with fs.open_input_stream(info.path) as source:
                            while block := source.read(BLOCK):
                                digest.update(block)
                        found = (digest.hexdigest(), info.size, info.mtime_ns)
                except OSError:
                    pass
                rows.append((place, *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=STATE)

    return paths.mapInArrow(run, "place string, live_hash string, live_size long, live_time long")


def _reader(root: str, names: list[str]):
    def read(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        held = None
        try:
            for batch in batches:
                texts, found = [], []
                for place, now, size, time, want, first, last, offsets in zip(*(batch.column(n).to_pylist() for n in (*STATE, "at_hash", "at_start", "at_end", "offsets"))):
                    text, state = None, "missing" if now is None else "changed"
                    if now is not None and now == want:
                        if held is None or (held.path, held.time) != (place, time):
                            if held:
                                held.close()
                            held = _File(fs, base, place, size, time)
                        try:
                            text = held.text(first, last, offsets) if held.source else None
                            state = "live" if text is not None else "missing" if held.source else "changed"
                        except OSError:
                            state = "missing"
                    texts.append(text)
                    found.append(state)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(found, pa.string())], names=[*names, "live_text", "live_state"])
        finally:
            if held:
                held.close()

    return read


def uri(root: str) -> str:
    """A folder as a URI."""
    found = root if re.match(r"[a-z][a-z0-9+.-]*:", root) else "file://" + os.path.abspath(root)
    return re.sub(r"^file:/(?!/)", "file:///", found).rstrip("/")


def hydrate(refs: DataFrame, root: str, index: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """refs with text, stale and live_state: the live file's text where it is what the span was taken from.

    refs: path, content_hash, line_start, line_end, text, any others that Arrow has types for; where they have
    chunk_hash, the text read must have it too.  index: ``line_index`` of the files as they were taken; without a
    row of it a file is decoded whole.  moved: old_path, path of files that are elsewhere by now (``ledger.renames``)."""
    names = refs.columns
    # The rows of a file are dealt over salts: a file that many ask for is read by as many tasks as it has of them.
    salt = F.pmod(F.xxhash64(*_hashable(refs.drop("text"))), F.lit(SALTS)).alias("salt")
    rows = refs.select(F.struct(*names).alias("row"), F.col("path").alias("at_path"), F.col("content_hash").alias("at_hash"), F.col("line_start").cast("long").alias("at_start"), F.col("line_end").cast("long").alias("at_end"), salt)
    asked = rows.groupBy("at_path", "at_hash").agg(F.collect_set("salt").alias("salts")).filter("at_path is not null")
    if moved is not None:
        asked = asked.join(moved.groupBy(F.col("old_path").alias("at_path")).agg(F.min("path").alias("to")), "at_path", "left")
    asked = asked.withColumn("place", F.coalesce("to", "at_path") if moved is not None else F.col("at_path"))
    lines = index.select(F.col("path").alias("at_path"), F.col("content_hash").alias("at_hash"), "offsets")
    live = states(asked.select("place").distinct(), root)
    known = asked.join(lines, ["at_path", "at_hash"], "left").join(live, "place").select(F.col("at_path").alias("of_path"), F.col("at_hash").alias("of_hash"), F.explode("salts").alias("of_salt"), *STATE, "offsets")
    same = (F.col("at_path") == F.col("of_path")) & F.col("at_hash").eqNullSafe(F.col("of_hash")) & (F.col("salt") == F.col("of_salt"))
    met = rows.join(known, same, "left").select("row", *STATE, "at_hash", "at_start", "at_end", "offsets")
    schema = T.StructType([met.schema["row"], T.StructField("live_text", T.StringType()), T.StructField("live_state", T.StringType())])
    read = met.mapInArrow(_reader(uri(root), ["row"]), schema)
    state = F.col("live_state")
    if "chunk_hash" in names:
        wrong = (state == "live") & (F.sha2("live_text", 256) != F.col("row.chunk_hash"))
        state = F.when(wrong, "changed").otherwise(state)
    text = F.when(F.col("now") == "live", F.col("live_text")).otherwise(F.coalesce("row.text", F.lit("")))
    rest = [n for n in names if n not in ("text", "stale", "live_state")]
    return read.withColumn("now", state).select(*[F.col(f"row.`{n}`") for n in rest], text.alias("text"), (F.col("now") != "live").alias("stale"), F.col("now").alias("live_state"))


def _hashable(df: DataFrame) -> list[Column]:
    """Columns that have a hash: all but maps."""
    return [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]


def compacted(chunks: DataFrame, root: str, index: DataFrame) -> DataFrame:
    """Chunks without the stored text that their live files give back; the others, and those without a file, keep it."""
    stored = chunks.withColumn("stored_text", F.col("text"))
    live = hydrate(stored, root, index)
    back = (F.col("live_state") == "live") & (F.col("text") == F.trim("stored_text"))
    return live.withColumn("text", F.when(back, "").otherwise(F.col("stored_text"))).select(*chunks.columns)
