"""Secret scans over an incremental blob ledger (built-in functions only).

Every historical version of a path is addressed by the SHA-256 of its text.  The ledger holds one
row per (blob, rule version) that has ever been scanned, with its spans, empty ones included.  A
scan anti-joins the distinct blobs of the versions with the ledger, reads only the texts of unseen
pairs, appends what it finds, and joins findings back to every path of a blob.

Scale: texts are shuffled once, by address, and copies are collapsed before that shuffle, so a
group of a third of all rows sends one text per task; the anti-join with the ledger finds them dealt
as it needs them.  The ledger's rows are far smaller than the texts they stand for, so each scan
gathers them into fewer files than it has tasks.  The join back carries ids and 32-byte addresses
only, and adaptive execution can split a hot blob there.  Span positions come from
prefix sums in two levels, so a text of very many matches costs little more than its length.

Defined results: null text counts as empty and has no spans; repeated rows and copies each get
their spans; null ids and null versions are kept; an empty table gives an empty result; columns
besides the named ones are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, scratch_path

# The kinds of secrets in their order: name, pattern, group whose length counts, least length.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
CHUNK = 256
#: Scanning tasks whose findings share a file of the ledger.
TASKS_A_FILE = 8


def rule_version(rules=RULES) -> str:
    """Changes whenever a pattern, its order or its least length does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array<long>, built in chunks so that appends stay short."""
    empty = F.array().cast("array<long>")

    def sums(xs: Column) -> Column:
        step = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["a"], F.array(acc["t"] + x)).alias("a"))
        return F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("t"), empty.alias("a")), step, lambda acc: acc["a"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: sums(F.slice(values, c * CHUNK + 1, F.lit(CHUNK))))
    ends = sums(F.transform(chunks, lambda c: F.element_at(c, -1)))
    joined = F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), ends.alias("e")), lambda z: F.transform(z["c"], lambda x: x + z["e"] - F.element_at(z["c"], -1))))
    return F.when(F.size(values) > 0, joined).otherwise(empty)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text) to (blob, rules, spans): spans sorted by start, then by the order of the rules."""
    text, kind_spans = F.col("text"), []
    for order, (kind, pattern, group, least) in enumerate(rules):
        p, none = F.lit(pattern), F.array().cast("array<string>")
        hit = text.rlike(pattern)
        blobs = blobs.withColumn(f"m{order}", F.when(hit, F.regexp_extract_all(text, p, F.lit(0))).otherwise(none))
        blobs = blobs.withColumn(f"v{order}", F.col(f"m{order}") if not group else F.when(F.size(f"m{order}") > 0, F.regexp_extract_all(text, p, F.lit(group))).otherwise(none))
        gaps = F.when(F.size(f"m{order}") > 0, F.split(text, pattern, -1)).otherwise(none)
        blobs = blobs.withColumn(f"g{order}", F.transform(gaps, lambda x: F.length(x).cast("long")))
        moves = F.transform(F.arrays_zip(F.col(f"m{order}").alias("m"), F.slice(f"g{order}", F.lit(1), F.size(f"m{order}")).alias("g")), lambda z: z["g"] + F.length(z["m"]))
        blobs = blobs.withColumn(f"e{order}", running_sums(moves))
        zipped = F.arrays_zip(F.col(f"m{order}").alias("m"), F.col(f"v{order}").alias("v"), F.col(f"e{order}").alias("e"))
        kept = F.filter(zipped, lambda z: F.length(z["v"]) >= least)  # noqa: B023
        kind_spans.append(F.transform(kept, lambda z: F.struct((z["e"] - F.length(z["m"])).cast("long").alias("start"), F.lit(order).alias("place"), z["e"].cast("long").alias("end"), F.lit(kind).alias("kind"))))  # noqa: B023
    return blobs.select("blob", F.lit(rule_version(rules)).alias("rules"), F.sort_array(F.concat(*kind_spans)).alias("spans"))


def address(versions: DataFrame) -> DataFrame:
    """Adds the content address of each version's text."""
    return versions.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def ledger_of(spark: SparkSession, path: str, rules=RULES) -> DataFrame | None:
    """The ledger at a path, or None where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def scan_versions(versions: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` has not seen, append it there, and return the whole ledger.

    ``versions`` has a column text and any others; a ledger that does not exist yet is begun."""
    spark = versions.sparkSession
    blobs = address(versions).groupBy("blob").agg(F.first("text").alias("text"))
    ledger = ledger_of(spark, ledger_path)
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rules") == rule_version(rules)).select("blob"), "blob", "left_anti")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // TASKS_A_FILE)
    scan(blobs, rules).repartition(files).write.mode("append").option("compression", "zstd").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Every version with the spans of its blob: the columns of ``versions`` without its text, and spans."""
    known = ledger.filter((F.col("rules") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    return address(versions).drop("text").join(known, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(known.schema["spans"].dataType)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, steps: int = 2) -> DataFrame:
    """The contract's columns: counts by base kind, the hash of the base spans, and all spans.

    The table is scanned in ``steps`` increments by a hash of the id, each through the ledger that the
    earlier ones left, so a text that an earlier increment held is not scanned again."""
    versions, path = docs.select("doc_id", "text"), scratch_path(docs.sparkSession, "ledger")
    for step in range(steps):
        ledger = scan_versions(versions.filter(crc_mod(F.col("doc_id"), steps) == step), path)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return findings(versions, ledger).select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_listed(of(*BASE)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"""SELECT rid, {quote(kind)} AS kind, {order} AS place, {least} AS least,
          unnest(regexp_extract_all(text, {quote(pattern)})) AS m, unnest(regexp_extract_all(text, {quote(pattern)}, {group})) AS v,
          unnest(list_slice(string_split_regex(text, {quote(pattern)}), 1, -2)) AS gap,
          unnest(range(len(regexp_extract_all(text, {quote(pattern)})))) AS i
        FROM docs WHERE regexp_matches(text, {quote(pattern)})"""
        for order, (kind, pattern, group, least) in enumerate(RULES)
    ]
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, place ORDER BY i) AS stop FROM hits),
spans AS (
  SELECT rid, kind, place, (stop - length(m))::BIGINT AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span
  FROM placed WHERE length(v) >= least),
per AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (kind <> 'pem'), '') AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (rid)
"""


ORACLE_SQL = _oracle()
