"""Files as rows: listing, exclusion, decoding, sensitive content, project discovery, coverage.

Everything is a column expression over Spark's ``binaryFile`` listing, except the decoding of bytes
that are not UTF-8 and of word-processor files, which are Arrow-batched functions.  Contents are
only read for files that pass the name and size rules: the listing prunes the content column.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_excluded
from .rules import CREDENTIAL, IGNORED_DIRS, MAX_FILES, PLACEHOLDERS, PRIVATE_KEY, PROJECT_MARKERS

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, relative_path, length, modificationTime, content of every file below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    cut = F.instr("path", base) + len(base) + 1
    return files.withColumn("relative_path", F.substring("path", cut, F.length("path")))


def in_ignored_dir(path: Column) -> Column:
    """Whether a folder on the way is ignored or hidden."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(parts, lambda p: F.lower(p).isin(*IGNORED_DIRS) | F.startswith(p, F.lit(".")))


def classify(files: DataFrame) -> DataFrame:
    """Adds reason: why a file is left out, or null.

    A listing that tells links and unreadable files apart (boolean columns ``symlink`` and ``readable``) has these reasons first."""
    path, reason = F.col("relative_path"), F.when(in_ignored_dir(F.col("relative_path")), "ignored_dir")
    if "symlink" in files.columns:
        reason = reason.when(F.col("symlink"), "symlink")
    if "readable" in files.columns:
        reason = reason.when(~F.col("readable"), "unreadable")
    return files.withColumn("reason", reason.otherwise(path_excluded(path, F.col("length"))))


def coverage(classified: DataFrame, gaps: int = 20, max_files: int = MAX_FILES) -> DataFrame:
    """reason, files, examples, complete: counts by reason, the first paths of each, and whether the included files are within their cap.

    Paths are ranked among what is left out only, and each task keeps ``gaps`` of a reason before any are moved."""
    counts = classified.groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))
    place = F.row_number().over(W.partitionBy("reason").orderBy("relative_path"))
    first = classified.filter("reason is not null").select("reason", "relative_path").withColumn("place", place).filter(F.col("place") <= gaps)
    examples = first.groupBy("reason").agg(F.sort_array(F.collect_list("relative_path")).alias("examples"))
    within = F.when(F.col("reason") == "included", F.col("files") <= max_files).otherwise(True)
    return counts.join(examples, "reason", "left").select("reason", "files", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), within.alias("complete"))


def decode_bytes(data: bytes) -> str | None:
    """Text of a file's bytes; None for binary content, which has a NUL among its first 4,096 bytes."""
    if 0 in data[:4096]:
        return None
    for codec in ("utf-8-sig", "utf-16", "cp1252"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def docx_text(data: bytes) -> str | None:
    """Paragraphs of a word-processor file, divided by blank lines."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    marks = {WORD_NS + "tab": "\t", WORD_NS + "br": "\n", WORD_NS + "cr": "\n"}
    paragraphs = ["".join(n.text or "" if n.tag == WORD_NS + "t" else marks.get(n.tag, "") for n in p.iter()) for p in root.iter(WORD_NS + "p")]
    return "\n\n".join(p for p in paragraphs if p.strip())


@F.pandas_udf(T.StringType())
def extract_text(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else docx_text(c) if p.lower().endswith(".docx") else decode_bytes(c) for c, p in zip(content, path)], dtype=object)


def sensitive(text: Column) -> Column:
    """A private key, or a credential assigned a value that is no placeholder."""
    values = F.regexp_extract_all(text, F.lit("(?im)" + CREDENTIAL), F.lit(1))
    real = F.exists(values, lambda v: ~F.rlike(F.lower(v), F.lit("^(?:" + "|".join(_quote(p) for p in PLACEHOLDERS) + ")")))
    return F.rlike(text, F.lit(PRIVATE_KEY)) | real


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in text)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, text, content_hash, size, modified of all files that pass every rule."""
    return accepted(classify(list_files(spark, root)).filter("reason is null"))


def accepted(files: DataFrame) -> DataFrame:
    """The same of files with their contents (relative_path, content, length, modificationTime): texts without secrets."""
    texts = files.withColumn("text", extract_text("content", "relative_path")).filter("text is not null")
    return texts.filter(~sensitive(F.col("text"))).select("relative_path", "text", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def discover_projects(files: DataFrame, depth: int = 5) -> DataFrame:
    """project: the topmost folders that hold a marker, at most ``depth`` below the root, ignored folders aside."""
    path = F.col("relative_path")
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    marker = name.isin(*PROJECT_MARKERS) | F.rlike(name, F.lit(r"\.(?:sln|code-workspace)$"))
    holder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    holders = files.filter(marker & ~in_ignored_dir(path)).select(holder.alias("project")).distinct().filter(F.size(F.split("project", "/")) <= depth)
    steps = F.split("project", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    nested = holders.filter(F.size(steps) > 1).select("project", above.alias("above")).join(holders.select(F.col("project").alias("above")), "above").select("project")
    return holders.join(nested, "project", "left_anti")


def write_files(rows: DataFrame, root: str, paths_differ: bool = False) -> int:
    """Write rows (path, content) as files below a root URI that all executors see; how many.

    A file appears whole, by a rename, so a task that runs twice does no harm; of rows with one path, the
    greatest content is written; ``paths_differ`` says that there are none, which saves a shuffle of the contents.
    Rows without a path or content are left out."""

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                final = f"{base}/{path}"
                part = f"{final}.{uuid.uuid4().hex}"
                fs.create_dir(final.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(part) as out:
                    out.write(bytes(content))
                fs.move(part, final)
            yield pd.DataFrame({"n": [len(batch)]})

    named = rows.select("path", "content").filter("path is not null and content is not null")
    once = named if paths_differ else named.groupBy("path").agg(F.max("content").alias("content"))
    return once.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
