"""The driver's tables seen as ledger tables, the same in both engines: each function has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import request_tokens
from ..operators import search
from ..sources.store import scratch


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _heading():
    """Two documents of three have their first three long words for a heading; no text is read beyond them."""
    begin = F.regexp_extract("text", r"(?s)\A(?>.*?[A-Za-z]{6,}+){0,3}", 0)
    return F.when(F.col("doc_id") % 3 > 0, F.nullif(F.array_join(F.regexp_extract_all(begin, F.lit("[A-Za-z]{6,}"), F.lit(0)), " "), F.lit("")))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """documents: a source and a project folder each."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("project_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit(1).alias("line_start"), (F.col("doc_id") % 17 != 0).alias("current"), "text", _heading().alias("heading"),
    )


CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, source AS project_id, lang || '/' || doc_id || '.txt' AS path, 1 AS line_start, doc_id % 17 <> 0 AS current, text, CASE WHEN doc_id % 3 > 0 THEN nullif(array_to_string(regexp_extract_all(text, '[A-Za-z]{6,}')[:3], ' '), '') END AS heading FROM documents)"


def policies(spark: SparkSession, d: str) -> DataFrame:
    """orders: a rule about each order's shipping."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    verb = F.when(k % 3 == 0, "must not ship").when(k % 7 == 0, "was tested with").otherwise("must ship")
    return o.select(
        k.alias("chunk_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("project_id"), F.concat(F.lit("orders/"), (k % 50).cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("Decision: parcel "), verb, F.lit(" priority "), F.lower("o_orderpriority"), F.lit(" within "), (k % 4 + 2).cast("string"), F.lit(" days.")).alias("text"),
        F.col("o_custkey").alias("request_id"), F.lower("o_orderpriority").alias("priority_name"), (k % 2 == 0).alias("live"),
    )


POLICIES = """policies AS (SELECT o_orderkey AS chunk_id, 'p' || (o_custkey % 5) AS project_id, 'orders/' || (o_orderkey % 50) || '.md' AS path,
  'Decision: parcel ' || (CASE WHEN o_orderkey % 3 = 0 THEN 'must not ship' WHEN o_orderkey % 7 = 0 THEN 'was tested with' ELSE 'must ship' END) || ' priority ' || lower(o_orderpriority) || ' within ' || (o_orderkey % 4 + 2) || ' days.' AS text,
  o_custkey AS request_id, lower(o_orderpriority) AS priority_name, o_orderkey % 2 = 0 AS live, o_orderkey % 3 = 0 AS banned, o_orderkey % 3 = 0 OR lower(o_orderpriority) LIKE '%not %' AS neg, o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 AS trial, o_orderkey % 4 + 2 AS days FROM orders)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """part: a file a part, some of them inactive or moved on."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("source_id"), F.concat(F.lit("src/"), (k % 10).cast("string"), F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"), F.sha2(F.concat("p_name", F.lit("#"), (k % 5).cast("string")), 256).alias("current_hash"), F.col("p_size").cast("long").alias("size"), (k % 100).alias("mtime"), (k % 13 != 0).alias("active"))


SOURCES = "sources AS (SELECT p_partkey AS source_id, 'src/' || (p_partkey % 10) || '/' || p_partkey || '.md' AS path, sha256(p_name || '#' || (p_partkey % 5)) AS current_hash, p_size::BIGINT AS size, p_partkey % 100 AS mtime, p_partkey % 13 <> 0 AS active FROM part)"


def listing(spark: SparkSession, d: str) -> DataFrame:
    """part again, later: some files changed, moved, or went."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    folder = F.when(k % 11 == 0, "moved/").otherwise("src/")
    content = F.when(k % 9 == 0, (k % 5 + 1)).otherwise(k % 5)
    return p.filter(k % 8 != 0).select(F.concat(folder, (k % 10).cast("string"), F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"), F.sha2(F.concat("p_name", F.lit("#"), content.cast("string")), 256).alias("content_hash"), (F.col("p_size") + F.when(k % 9 == 0, 1).otherwise(0)).cast("long").alias("size"), (k % 100).alias("mtime"))


LISTING = """listing AS (SELECT (CASE WHEN p_partkey % 11 = 0 THEN 'moved/' ELSE 'src/' END) || (p_partkey % 10) || '/' || p_partkey || '.md' AS path,
  sha256(p_name || '#' || (CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 5 + 1 ELSE p_partkey % 5 END)) AS content_hash, (p_size + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS size, p_partkey % 100 AS mtime FROM part WHERE p_partkey % 8 <> 0)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of each part's file."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    both = F.explode(F.array(F.struct(F.lit(0).alias("no"), (k % 5).alias("c")), F.struct(F.lit(1).alias("no"), (k % 5 + 1).alias("c"))))
    return p.select("p_name", k.alias("source_id"), both.alias("v")).select((F.col("source_id") * 2 + F.col("v.no")).alias("version_id"), "source_id", F.sha2(F.concat("p_name", F.lit("#"), F.col("v.c").cast("string")), 256).alias("content_hash"))


VERSIONS = "versions AS (SELECT p_partkey * 2 + no AS version_id, p_partkey AS source_id, sha256(p_name || '#' || (p_partkey % 5 + no)) AS content_hash FROM part, (VALUES (0), (1)) AS v(no))"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """customer: a claim each."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    state = F.when(k % 4 == 0, "proposed").when(k % 9 == 0, "disputed").otherwise("observed")
    return c.select(F.sha1(k.cast("string").cast("binary")).alias("claim_id"), k.alias("no"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("project_id"), state.alias("trust_state"), F.concat(F.lower("c_name"), F.lit(" must pay in "), F.lower("c_mktsegment")).alias("normalized_text"))


CLAIMS = """claims AS (SELECT sha1(c_custkey::VARCHAR) AS claim_id, c_custkey AS no, 'p' || (c_custkey % 5) AS project_id, CASE WHEN c_custkey % 4 = 0 THEN 'proposed' WHEN c_custkey % 9 = 0 THEN 'disputed' ELSE 'observed' END AS trust_state,
  lower(c_name) || ' must pay in ' || lower(c_mktsegment) AS normalized_text FROM customer)"""


def validations(spark: SparkSession, d: str) -> DataFrame:
    """labels: a validation each, of some customer's claim."""
    lab = table(spark, d, "labels")
    result = F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 1, "verified").otherwise("disputed")
    return lab.select(F.col("doc_id").alias("validation_id"), F.sha1((F.col("doc_id") % 300).cast("string").cast("binary")).alias("claim_id"), result.alias("result"))


VALIDATIONS = "validations AS (SELECT doc_id AS validation_id, sha1((doc_id % 300)::VARCHAR) AS claim_id, CASE WHEN toxic = 1 THEN 'superseded' WHEN quality = 1 THEN 'verified' ELSE 'disputed' END AS result FROM labels)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """events: a run each, some of unnamed agents."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("run_id"), F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("agent"), (F.col("user_id") % 30).cast("string"))).alias("agent"), F.col("event_type").alias("project_id"), F.round("value", 2).alias("elapsed_ms"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("created_at"))


RUNS = "runs AS (SELECT event_id AS run_id, CASE WHEN user_id % 10 <> 0 THEN 'agent' || (user_id % 30) END AS agent, event_type AS project_id, round(value, 2) AS elapsed_ms, epoch_us(ts) AS created_at FROM events)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """benchmark: four requests an item, of all its words: as it is, as pairs of joined words, as plurals of its first words, as beginnings of words."""
    words = F.col("words")
    plain = F.filter(words, lambda w: F.length(w) >= 6)
    pair = lambda a, sign: F.concat(F.coalesce(F.try_element_at(words, F.lit(a)), F.lit("x")), F.lit(sign), F.coalesce(F.try_element_at(words, F.lit(a + 1)), F.lit("y")))
    every = lambda f: F.array_join(F.transform(plain, f), " ")
    item = table(spark, d, "benchmark").select("item_id", "text", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    forms = F.array(
        F.struct(F.lit(0).alias("form"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("form"), F.concat_ws(" ", pair(1, "_"), pair(3, "-"), pair(5, ".")).alias("text")),
        F.struct(F.lit(2).alias("form"), F.concat_ws("s ", F.try_element_at(plain, F.lit(1)), F.try_element_at(plain, F.lit(2)), F.try_element_at(plain, F.lit(3)), F.lit("")).alias("text")),
        F.struct(F.lit(3).alias("form"), every(lambda w: F.concat(F.substring(w, 1, 5), F.lit("q"))).alias("text")),
        F.struct(F.lit(4).alias("form"), every(lambda w: F.substring(w, F.lit(1), F.length(w) - 1)).alias("text")),
    )
    return item.select("item_id", F.explode(forms).alias("f")).select((F.col("item_id") * 5 + F.col("f.form")).alias("request_id"), F.col("f.text").alias("text"), request_tokens(F.col("f.text")).alias("terms"))


REQUEST_TEXTS = r"""words AS (SELECT item_id, text, regexp_extract_all(lower(text), '[a-z]+') AS words FROM benchmark),
plain AS (SELECT *, list_filter(words, lambda w: length(w) >= 6) AS long FROM words),
asked AS (
  SELECT item_id * 5 AS request_id, text FROM plain
  UNION ALL SELECT item_id * 5 + 1, coalesce(words[1], 'x') || '_' || coalesce(words[2], 'y') || ' ' || coalesce(words[3], 'x') || '-' || coalesce(words[4], 'y') || ' ' || coalesce(words[5], 'x') || '.' || coalesce(words[6], 'y') FROM plain
  UNION ALL SELECT item_id * 5 + 2, concat_ws('s ', long[1], long[2], long[3], '') FROM plain
  UNION ALL SELECT item_id * 5 + 3, array_to_string(list_transform(long, lambda w: left(w, 5) || 'q'), ' ') FROM plain
  UNION ALL SELECT item_id * 5 + 4, array_to_string(list_transform(long, lambda w: left(w, length(w) - 1)), ' ') FROM plain)"""


_INDEXES: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, d: str) -> search.Index:
    """The written index of ``chunks``, made once an application: searches read it and no text."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = scratch(spark, "index")
        search.write_index(chunks(spark, d), path)
        _INDEXES[key] = path
    return search.read_index(spark, _INDEXES[key])
