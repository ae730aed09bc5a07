"""Queries of identity, packets end to end, caches and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import identity, session
from . import tables as tb
from .registry import query


@query("r_packets_end_to_end")
def packets(spark, d):
    docs = tb.chunks(spark, d)
    chunks = docs.select("*", F.size(F.split("text", "\n")).alias("line_end"), F.sha2("text", 256).alias("chunk_hash"), (F.col("chunk_id") % 19 == 0).alias("stale"))
    requests = tb.table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    scope = requests.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("p")).select("request_id", F.concat(F.lit("src"), F.col("p").cast("string")).alias("project_id"), (F.col("p") != F.col("request_id") % 20).cast("int").alias("priority"))
    return session.packets(requests, chunks, scope, index=tb.index(spark, d)).select("request_id", "status", F.size("evidence").alias("n_evidence"), F.to_json("requirements").alias("requirements"), "empty_result", "packet_hash")


@query("v1_git_remotes", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'ssh://host.org/team/r' || s_suppkey WHEN 1 THEN 'https://host.org/team/r' || s_suppkey WHEN 2 THEN 'https://host.org/r' || s_suppkey ELSE 'ssh://host.org/r' || s_suppkey END AS remote FROM supplier")
def git_remotes(spark, d):
    k = F.col("s_suppkey")
    n = k.cast("string")
    url = F.when(k % 4 == 0, F.concat(F.lit("git@Host.org:team/R"), n, F.lit(".git"))).when(k % 4 == 1, F.concat(F.lit("https://user:pw@host.org/team/r"), n, F.lit(".git/"))).when(k % 4 == 2, F.concat(F.lit(" https://HOST.org:443/r"), n)).otherwise(F.concat(F.lit("ssh://git@host.org:22/r"), n, F.lit(".git")))
    return tb.table(spark, d, "supplier").select(k.alias("id"), identity.git_remote(url).alias("remote"))


@query("v2_register", "WITH f AS (SELECT s_suppkey, 'w/' || s_suppkey AS path, sha1(unhex('a675f73673584d37a45a9b192538ab42') || encode(sha256(s_suppkey::VARCHAR))) AS h FROM supplier) SELECT path, CASE WHEN s_suppkey % 3 = 0 THEN 'k' || s_suppkey WHEN s_suppkey % 5 = 0 THEN 'a' || s_suppkey ELSE left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] END AS project_id, CASE WHEN s_suppkey % 3 = 0 THEN 'canonical_key' WHEN s_suppkey % 5 = 0 THEN 'resolved_path' ELSE 'created' END AS match_method FROM f")
def register(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    s = tb.table(spark, d, "supplier")
    found = s.select(F.concat(F.lit("w/"), n).alias("path"), F.sha2(n.cast("binary"), 256).alias("canonical_key"))
    projects = s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("k"), n).alias("project_id"), F.sha2(n.cast("binary"), 256).alias("canonical_key"))
    aliases = s.filter("s_suppkey % 5 = 0").select(F.concat(F.lit("w/"), n).alias("path"), F.concat(F.lit("a"), n).alias("project_id"))
    return identity.register(found, projects, aliases)


@query("m9_structure_hash", "SELECT c_nationkey AS project_id, sha256(string_agg('file|' || lower(c_name) || '|' || CASE WHEN c_custkey % 9 = 0 THEN md5(c_name) ELSE '' END, chr(10) ORDER BY 'file|' || lower(c_name) || '|' || CASE WHEN c_custkey % 9 = 0 THEN md5(c_name) ELSE '' END)) AS structure_hash FROM customer GROUP BY 1")
def structure_hash(spark, d):
    c = tb.table(spark, d, "customer")
    listing = c.select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"), F.lit("file").alias("kind"), F.when(F.col("c_custkey") % 9 == 0, F.md5(F.col("c_name").cast("binary"))).alias("content_hash"))
    return identity.structure_signature(listing)


@query("f8_visible_projects", "WITH " + tb.CLAIMS + " SELECT claim_id FROM claims WHERE project_id IN ('p1', 'p3') OR no % 50 = 0")
def visible_projects(spark, d):
    c = tb.claims(spark, d).withColumn("project_id", F.when(F.col("no") % 50 != 0, F.col("project_id")))
    allowed = c.filter("project_id in ('p1', 'p3')").select("project_id")
    return identity.visible(c.select("claim_id", "project_id"), allowed).select("claim_id")


@query("r14_stale_text", "SELECT doc_id AS chunk_id, md5(text) AS h, CASE WHEN doc_id % 6 = 0 THEN 'indexed_copy' END AS stale_text FROM documents")
def stale_text(spark, d):
    """Every document; the rest are neither stale nor emptied."""
    docs = tb.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = docs.select("chunk_id", (F.col("chunk_id") % 2 == 0).alias("stale"), F.when(F.col("chunk_id") % 6 == 0, "").otherwise(F.col("text")).alias("text"))
    return session.stale_text(hits, docs).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("h"), "stale_text")


@query("c7_cache_validity", "WITH dep AS (SELECT l_orderkey AS cache_key, l_partkey AS p, l_suppkey % 10 <> 0 AS matched FROM lineitem) SELECT cache_key, bool_and((p % 7 <> 0) = matched) AS valid FROM dep GROUP BY 1")
def cache_validity(spark, d):
    li = tb.table(spark, d, "lineitem")
    path = lambda c: F.col(c).cast("string")
    dep = li.select(F.col("l_orderkey").alias("cache_key"), path("l_partkey").alias("path"), F.md5(path("l_partkey").cast("binary")).alias("content_hash"), (F.col("l_suppkey") % 10 != 0).alias("matched"))
    parts = tb.table(spark, d, "part")
    now = parts.select(path("p_partkey").alias("path"), F.when(F.col("p_partkey") % 7 != 0, F.md5(path("p_partkey").cast("binary"))).otherwise("moved").alias("content_hash"))
    return session.cache_valid(dep.select("cache_key").distinct(), dep, now)


@query("c7_cache_keys", "SELECT item_id AS request_id, sha256('{\"q\":\"' || item_id || '\",\"v\":' || (item_id % 3) || '}') AS cache_key FROM benchmark")
def cache_keys(spark, d):
    from ..operators.ledger import cache_key

    b = tb.table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("request_id"), cache_key([F.col("item_id").cast("string").alias("q"), (F.col("item_id") % 3).alias("v")]).alias("cache_key"))


@query("q10_attach_validations", "WITH " + tb.CLAIMS + """, v AS (SELECT project_id, CASE WHEN no % 8 = 1 THEN normalized_text ELSE 'every ' || normalized_text || ' by noon' END AS claim FROM claims WHERE no % 4 = 1),
a AS (SELECT no AS request_id, project_id, CASE no % 3 WHEN 0 THEN normalized_text || ' today' WHEN 1 THEN split_part(normalized_text, ' ', 1) || ' must pay' ELSE 'pay' END AS said FROM claims)
SELECT a.request_id, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.project_id = a.project_id AND (contains(a.said, v.claim) OR contains(v.claim, a.said))) THEN 'validated' ELSE 'lexical' END AS basis FROM a""".replace("\n,", ","))
def attach_validations(spark, d):
    """Sentences that hold a validated claim, are held by one, or are a word of one."""
    c = tb.claims(spark, d)
    k = F.col("no") % 3
    said = F.when(k == 0, F.concat(F.upper("normalized_text"), F.lit("  today"))).when(k == 1, F.concat(F.element_at(F.split("normalized_text", " "), 1), F.lit(" must pay"))).otherwise("pay")
    claim = F.when(F.col("no") % 8 == 1, F.col("normalized_text")).otherwise(F.concat(F.lit("every "), F.col("normalized_text"), F.lit(" by noon")))
    return session.attach_validations(c.select(F.col("no").alias("request_id"), "project_id", said.alias("sentence")), c.filter("no % 4 = 1").select("project_id", claim.alias("normalized_text")))


@query("m15_limit_sweep", "WITH r AS (SELECT o_orderkey % 12 + 1 AS found, o_custkey % 900 + 100 AS size FROM orders), g AS (SELECT l AS \"limit\", b AS budget FROM (VALUES (4), (8), (12)) AS x(l), (VALUES (2000), (4000), (8000)) AS y(b)) SELECT \"limit\", budget, round(avg(least(found, \"limit\", floor(budget / size)) / found), 6) AS mean_coverage FROM r, g GROUP BY 1, 2")
def limit_sweep(spark, d):
    o = tb.table(spark, d, "orders")
    return session.sweep(o.select((F.col("o_orderkey") % 12 + 1).alias("found"), (F.col("o_custkey") % 900 + 100).alias("size")), [4, 8, 12], [2000, 4000, 8000])


@query("a5_project_counts", "WITH " + tb.CLAIMS + ", " + tb.RUNS + ", p AS (SELECT 'p' || x AS project_id FROM range(6) AS r(x)) SELECT p.project_id, (SELECT count(*) FROM claims c WHERE c.project_id = p.project_id)::BIGINT AS claims, (SELECT count(*) FROM claims c WHERE c.project_id = p.project_id AND trust_state = 'proposed')::BIGINT AS proposed FROM p")
def project_counts(spark, d):
    c = tb.claims(spark, d)
    p = tb.table(spark, d, "region").limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("x")).select(F.concat(F.lit("p"), F.col("x").cast("string")).alias("project_id"))
    counts = c.groupBy("project_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("trust_state") == "proposed").alias("proposed"))
    return p.join(counts, "project_id", "left").na.fill(0, ["claims", "proposed"])


@query("a11_distinct_values", "WITH " + tb.POLICIES + " SELECT request_id, array_to_string(list_sort(list(DISTINCT days)), ',') AS days FROM policies GROUP BY 1")
def distinct_values(spark, d):
    p = tb.policies(spark, d).withColumn("day", F.element_at(t.numbers(F.regexp_extract("text", "within (.*)", 1)), 1).cast("int"))
    return p.groupBy("request_id").agg(F.array_join(F.sort_array(F.collect_set("day")), ",").alias("days"))
