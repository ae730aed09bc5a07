"""Document fingerprints: a Merkle tree over sections and paragraphs (built-in functions only).

Sections are divided by blank lines and paragraphs by line ends; a paragraph's leaves are its
sentence-like pieces of at most 64 characters.  Every node is the SHA-256 of its children, so
equal roots mean equal texts.  The fingerprint lists the root and then 32 bits of every leaf, with
``/`` between paragraphs and ``;`` between sections: comparing branches of two fingerprints
locates edits (``changed_leaves``), and the share of common leaves is their likeness.

Scale: one shuffle of the texts, by ranges of the id.  The next document comes from a window
within a range; the first document of each range travels along as a guest into the range before
it, so that no window is global.  The driver holds one pair of numbers a range.

Defined results: null text counts as empty; empty texts have the tree of one empty paragraph and
are alike to degree 1; a single document is its own next; null ids sort below all others; rows that
share an id follow each other by their texts; an empty table gives an empty result; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE = r"[^.!?]{1,64}[.!?]*|[.!?]+"
LOWEST = -(2**63)
RANGES = 4096


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def tree(text: Column) -> Column:
    """The leaves' hashes: sections of paragraphs of pieces."""
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), sha)
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), pieces))


def fingerprint(leaves: Column) -> Column:
    """Root and branches of a tree, as one string."""
    paragraph = lambda p: sha(F.concat(F.lit("P"), F.array_join(p, "")))
    section = lambda s: sha(F.concat(F.lit("S"), F.array_join(F.transform(s, paragraph), "")))
    root = sha(F.concat(F.lit("R"), F.array_join(F.transform(leaves, section), "")))
    short = lambda p: F.array_join(F.transform(p, lambda h: F.substring(h, 1, 8)), ",")
    branches = F.array_join(F.transform(leaves, lambda s: F.array_join(F.transform(s, short), "/")), ";")
    return F.concat(root, F.lit("|"), branches)


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of a column of texts; the tree is its own step, so that it is built once."""
    return docs.withColumn("leaves_of", tree(F.col(text))).withColumn(name, fingerprint(F.col("leaves_of"))).drop("leaves_of")


def leaf_set(print_: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring_index(print_, "|", -1), "[,/;]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common leaves over the leaves of both, each leaf once; 1 for equal roots."""
    x, y = leaf_set(a), leaf_set(b)
    return F.when(a == b, 1.0).otherwise(F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / F.nullif(F.size(x) + F.size(y), F.lit(0)), F.lit(0.0)))


def changed_leaves(a: Column, b: Column) -> Column:
    """Indexes (section, paragraph, from 0) of a's paragraphs that b lacks at the same place."""
    parts = lambda p: F.transform(F.split(F.substring_index(p, "|", -1), ";", -1), lambda s: F.split(s, "/", -1))
    other = parts(b)
    at = lambda s, i: F.filter(F.transform(s, lambda p, j: F.when(~p.eqNullSafe(F.get(F.get(other, i), j)), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())
    return F.when(a == b, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(F.transform(parts(a), at)))


def with_next(docs: DataFrame, carried: list[str], ranges: int) -> DataFrame:
    """Adds next_<column> of the next document in descending doc_id, around the end."""
    spark, key = docs.sparkSession, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    keys = docs.select(key.alias("key"))
    cuts = keys.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted({int(x) for x in cuts})
    width = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<long>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("key")))
    heads, table = longs([r[0] for r in rows]), F.array(*[longs(r) for r in rows]) if rows else None
    row = below(heads)
    place = F.when(row > 0, (row - 1) * width + below(F.element_at(table, F.greatest(row, F.lit(1))))).otherwise(0) if rows else F.lit(0)
    ranged = lambda df: df.withColumn("range", place.cast("int"))
    tops = sorted((r["range"], r["top"]) for r in ranged(keys).groupBy("range").agg(F.max("key").alias("top")).collect())
    above = [(tops[(i + 1) % len(tops)][0], top) for i, (_, top) in enumerate(tops)]
    guests = F.broadcast(spark.createDataFrame(above or [(0, 0)], "guest int, key long"))
    dealt = ranged(docs.withColumn("key", key)).join(guests, "key", "left")
    into = F.explode(F.when(F.col("guest").isNull(), F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("is_guest")))).otherwise(F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("is_guest")), F.struct(F.col("guest").alias("at"), F.lit(1).alias("is_guest")))))
    order = W.partitionBy("at").orderBy("is_guest", F.col("key").desc(), "text")
    spread = dealt.withColumn("into", into).select(*docs.columns, "key", "into.at", "into.is_guest")
    return spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).filter("is_guest = 0").drop("at", "is_guest", "key")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    spark = docs.sparkSession
    ranges = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprint(own, "text", "fingerprint")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = with_fingerprint(with_next(own, ["text", "fingerprint"], ranges).withColumn("edited", edited), "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        sha(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id, -9223372036854775808) AS key FROM documents),
following AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM docs WINDOW w AS (ORDER BY key DESC, text)),
edits AS (
  SELECT doc_id, text, next_text, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM following),
trees AS (
  SELECT *, list_transform([text, next_text, edited], lambda t: list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,64}[.!?]*|[.!?]+'), lambda x: sha256(x))))) AS forest
  FROM edits),
prints AS (
  SELECT *, list_transform(forest, lambda t:
    sha256('R' || list_aggregate(list_transform(t, lambda s: sha256('S' || list_aggregate(list_transform(s, lambda p: sha256('P' || coalesce(list_aggregate(p, 'string_agg', ''), ''))), 'string_agg', ''))), 'string_agg', ''))
    || '|' || list_aggregate(list_transform(t, lambda s: list_aggregate(list_transform(s, lambda p: coalesce(list_aggregate(list_transform(p, lambda h: h[1:8]), 'string_agg', ','), '')), 'string_agg', '/')), 'string_agg', ';')) AS prints
  FROM trees),
leaves AS (
  SELECT *, list_transform(prints, lambda p: list_distinct(list_filter(string_split_regex(p[66:], '[,/;]'), lambda x: x <> ''))) AS sets FROM prints)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, prints[1] AS fingerprint, prints[3] AS edited_fingerprint,
  CASE WHEN prints[1] = prints[3] THEN 1.0::DOUBLE WHEN len(sets[1]) + len(sets[3]) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(sets[1], sets[3])) / (len(sets[1]) + len(sets[3])) END::DOUBLE AS near_edited,
  CASE WHEN prints[1] = prints[2] THEN 1.0::DOUBLE WHEN len(sets[1]) + len(sets[2]) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(sets[1], sets[2])) / (len(sets[1]) + len(sets[2])) END::DOUBLE AS near_next
FROM leaves
"""
