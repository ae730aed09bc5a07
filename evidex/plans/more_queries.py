"""Further queries: symbols, ledger claims, counters, restricted scopes, deletes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph, ledger, search
from . import stems_sql as sq
from . import tables as tb
from .ledger_queries import _EVIDENCE, _LIVE, _evidence, _live, _sql
from .ledger_queries import version_actions as _version_actions
from .registry import query


@query("g5_symbols", "SELECT p_partkey AS chunk_id, 'Part' || p_partkey AS name FROM part UNION ALL SELECT p_partkey, 'f' || (p_partkey % 7) FROM part UNION ALL SELECT p_partkey, 'run_' || p_size FROM part")
def symbols(spark, d):
    k = F.col("p_partkey").cast("string")
    code = F.concat(F.lit("class Part"), k, F.lit(":\n    def f"), (F.col("p_partkey") % 7).cast("string"), F.lit("(self):\n        return 1\nexport async function run_"), F.col("p_size").cast("string"), F.lit("() {}\n"))
    chunks = tb.table(spark, d, "part").select(F.lit("p").alias("project_id"), F.col("p_partkey").alias("chunk_id"), code.alias("text"))
    return graph.symbols(chunks).select("chunk_id", "name")


@query("g3_contains_edges", _sql(tb.CHUNKS) + "SELECT project_id, path, count(*)::BIGINT AS n FROM chunks GROUP BY 1, 2")
def contains_edges(spark, d):
    c = tb.chunks(spark, d)
    none = c.limit(0).select("project_id", "chunk_id", F.col("text").alias("normalized_text"))
    edges = graph.edges(c, none).filter("predicate = 'contains'")
    return c.join(edges.select("chunk_id"), "chunk_id", "left_semi").groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query("g9_ledger_claims", _sql(tb.CLAIMS) + """, q AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 3 = 0 THEN ['building'] ELSE ['pay', 'building', (s_suppkey % 40)::VARCHAR] END AS terms, 'p' || (s_suppkey % 5) AS project_id FROM supplier),
m AS (SELECT request_id, terms, claim_id, no, len(list_filter(terms, lambda x: contains(normalized_text, x))) AS held FROM q JOIN claims USING (project_id) WHERE trust_state IN ('verified', 'proposed')),
n AS (SELECT * FROM m WHERE held > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY no DESC, claim_id) <= 200)
SELECT request_id, claim_id, held::INT AS held, row_number() OVER (PARTITION BY request_id ORDER BY no DESC, claim_id)::INT AS position FROM n WHERE held >= least(2, len(terms)) QUALIFY position <= 4""".replace("\n, q", ", q"))
def ledger_claims(spark, d):
    s = F.col("s_suppkey")
    terms = F.when(s % 3 == 0, F.array(F.lit("building"))).otherwise(F.array(F.lit("pay"), F.lit("building"), (s % 40).cast("string")))
    asked = tb.table(spark, d, "supplier").select(s.alias("request_id"), terms.alias("terms"), F.concat(F.lit("p"), (s % 5).cast("string")).alias("project_id"))
    return graph.ledger_claims(asked, tb.claims(spark, d).withColumn("created_at", F.col("no")), asked)


@query("g10_live_dependencies", _sql(tb.CLAIMS, _EVIDENCE, _LIVE) + "SELECT claim_id, count(*)::BIGINT AS spans, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM live))::BIGINT AS live_spans FROM claims JOIN evidence USING (claim_id) GROUP BY 1")
def live_dependencies(spark, d):
    live = _live(spark, d).withColumn("live", F.lit(True))
    met = tb.claims(spark, d).select("claim_id").join(_evidence(spark, d), "claim_id").join(live, "chunk_id", "left")
    return met.groupBy("claim_id").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("live").isNotNull()).alias("live_spans"))


@query("a10_any_and_all", _sql(tb.VALIDATIONS) + "SELECT claim_id, bool_or(result = 'verified') AS any_verified, bool_and(result = 'verified') AS all_verified FROM validations GROUP BY 1")
def any_and_all(spark, d):
    v = tb.validations(spark, d)
    ok = F.col("result") == "verified"
    return v.groupBy("claim_id").agg(F.bool_or(ok).alias("any_verified"), F.bool_and(ok).alias("all_verified"))


@query("a9_ingest_counters", _sql(tb.SOURCES, tb.LISTING) + "SELECT count(*) FILTER (path IN (SELECT path FROM sources))::BIGINT AS known, count(*)::BIGINT AS listed FROM listing")
def ingest_counters(spark, d):
    acts = _version_actions(spark, d)
    return acts.agg(F.count_if(F.col("action").isin("touch", "update", "revert")).alias("known"), F.count(F.lit(1)).alias("listed"))


@query("f2_scope_filter", _sql(tb.CHUNKS) + "SELECT chunk_id FROM chunks WHERE project_id IN ('src1', 'src7', 'src19')")
def scope_filter(spark, d):
    c = tb.chunks(spark, d)
    scope = c.filter("project_id in ('src1', 'src7', 'src19')").select("project_id").distinct()
    return c.join(scope, "project_id", "left_semi").select("chunk_id")


@query("l3_capped_before_join", "WITH top AS (SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5) SELECT o_orderkey, c_name FROM top JOIN customer ON o_custkey = c_custkey")
def capped_before_join(spark, d):
    place = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    top = tb.table(spark, d, "orders").withColumn("r", place).filter("r <= 5").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return top.join(tb.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("d4_never_lower", "SELECT s_suppkey AS id, greatest(s_nationkey, s_suppkey % 20)::BIGINT AS version FROM supplier")
def never_lower(spark, d):
    s = tb.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.greatest(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 20).alias("version"))


@query("d5_batched_delete", _sql(tb.CLAIMS) + "SELECT claim_id FROM claims WHERE project_id <> 'p3'")
def batched_delete(spark, d):
    c = tb.claims(spark, d)
    return c.join(c.filter("project_id = 'p3'").select("claim_id"), "claim_id", "left_anti").select("claim_id")


@query("m13_explain_packet", _sql(tb.RUNS) + "SELECT md5((run_id % 500)::VARCHAR) AS packet_hash, max(run_id) AS run_id FROM runs GROUP BY 1")
def explain_packet(spark, d):
    r = tb.runs(spark, d).withColumn("packet_hash", F.md5((F.col("run_id") % 500).cast("string").cast("binary")))
    return ledger.latest(r.select("packet_hash", "run_id", F.col("run_id").alias("o")), ["packet_hash"], "o").select("packet_hash", "run_id")


@query("m5_reindex_semi", f"WITH {tb.CHUNKS.replace('FROM documents)', 'FROM documents WHERE doc_id % 17 <> 0)')}, asked AS (SELECT 1 AS request_id, '' AS text), {sq.REQUESTS}, {sq.INDEX} SELECT chunk_id, count(DISTINCT term)::BIGINT AS terms FROM laid GROUP BY 1")
def reindex(spark, d):
    """Rows whose chunk is gone are dropped; the rest are cut into terms anew."""
    c = tb.chunks(spark, d)
    kept = c.join(c.filter("current").select("chunk_id"), "chunk_id", "left_semi")
    return search.build(kept).postings.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("terms"))


@query("q6_topic_relation", f"WITH {tb.POLICIES} SELECT request_id, count(*)::BIGINT AS related FROM policies WHERE days IN (2, 3, 4, 5) GROUP BY 1")
def topic_relation(spark, d):
    p = tb.policies(spark, d)
    q = t.check_topics(F.lit("How many days within which a parcel ships with priority?"))
    return p.filter(t.related(q, t.check_topics(F.col("text")), True)).groupBy("request_id").agg(F.count(F.lit(1)).alias("related"))


@query("q4_sentences", "SELECT doc_id AS chunk_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::BIGINT AS n FROM documents".replace("\\\\", "\\"))
def sentence_counts(spark, d):
    c = tb.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return c.select("chunk_id", F.size(t.sentences(F.col("text"))).cast("long").alias("n"))
