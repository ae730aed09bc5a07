"""Queries of sources, versions, claims' states, runs and maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ledger
from ..sources import files
from . import tables as tb
from .registry import query


def _sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@query("s9_content_hash", "SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS size FROM documents")
def content_hash(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))


# customers' files: names that each rule has something to say about
_NAMES = ["notes.md", "app.min.js", "photo.png", ".env.local", "package-lock.json", "id_rsa", "data.csv", "api-keys.txt", "server.pem", "big.txt"]
_FILES = "files AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 21 = 0 THEN 'node_modules/' WHEN c_custkey % 23 = 0 THEN '.cache/' ELSE 'docs/' END || [" + ", ".join(f"'{n}'" for n in _NAMES) + "][c_custkey % 10 + 1] AS path, CASE WHEN c_custkey % 10 = 9 THEN 3000000 ELSE 100 END AS length FROM customer)"
_REASON = """reasons AS (SELECT id, path, CASE WHEN path LIKE 'node_modules/%' OR path LIKE '.cache/%' THEN 'ignored_dir' WHEN id % 10 IN (3, 5, 7, 8) THEN 'sensitive_name' WHEN id % 10 IN (1, 4) THEN 'generated' WHEN id % 10 = 2 THEN 'unsupported_type' WHEN length > 2097152 THEN 'too_large' END AS reason FROM files)"""


def _files(spark, d):
    c = tb.table(spark, d, "customer")
    k = F.col("c_custkey")
    folder = F.when(k % 21 == 0, "node_modules/").when(k % 23 == 0, ".cache/").otherwise("docs/")
    return c.select(k.alias("id"), F.concat(folder, F.element_at(t.words_in(_NAMES), (k % 10 + 1).cast("int"))).alias("relative_path"), F.when(k % 10 == 9, 3000000).otherwise(100).alias("length"))


@query("s5_exclusion_reasons", _sql(_FILES, _REASON) + "SELECT id, reason FROM reasons")
def exclusion_reasons(spark, d):
    return files.classify(_files(spark, d)).select("id", "reason")


@query("s4_coverage", _sql(_FILES, _REASON) + "SELECT coalesce(reason, 'included') AS reason, count(*)::BIGINT AS files FROM reasons GROUP BY 1")
def coverage(spark, d):
    return files.coverage(files.classify(_files(spark, d))).select("reason", "files")


@query("s10_sensitive_content", r"""SELECT c_custkey AS id, c_custkey % 4 = 1 OR c_custkey % 7 = 0 AS sensitive FROM customer""")
def sensitive_content(spark, d):
    c = tb.table(spark, d, "customer")
    line = F.element_at(t.words_in(["api_key = your-key-goes-here", "  db_password: 'hunter2hunter2'", "password: short", "see the password section"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    pem = F.when(F.col("c_custkey") % 7 == 0, "\n-----BEGIN RSA PRIVATE KEY-----\n").otherwise("\n")
    return c.select(F.col("c_custkey").alias("id"), files.sensitive(F.concat(F.lit("intro\n"), line, pem)).alias("sensitive"))


_TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()


@query("s15_table_stats", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {n}" for n in _TABLES))
def table_stats(spark, d):
    return reduce(lambda a, b: a.union(b), [tb.table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in _TABLES])


@query("f1_current_chunks", _sql(tb.SOURCES, tb.VERSIONS) + "SELECT version_id, v.source_id FROM versions v JOIN sources s ON v.source_id = s.source_id AND v.content_hash = s.current_hash WHERE active")
def current(spark, d):
    v = tb.versions(spark, d)
    return ledger.current_chunks(v.select("version_id", "source_id"), v, tb.sources(spark, d))


@query("f3_path_prefix", _sql(tb.SOURCES) + "SELECT source_id FROM sources WHERE path = 'src/1' OR starts_with(path, 'src/1/')")
def path_prefix(spark, d):
    return tb.sources(spark, d).filter((F.col("path") == "src/1") | F.startswith("path", F.lit("src/1/"))).select("source_id")


@query("f4_like_contains", _sql(tb.CLAIMS) + "SELECT claim_id FROM claims WHERE normalized_text ILIKE '%BUILD%'")
def like_contains(spark, d):
    return tb.claims(spark, d).filter(F.col("normalized_text").ilike("%BUILD%")).select("claim_id")


@query("f5_prefix_seek", _sql(tb.CLAIMS) + "SELECT claim_id FROM claims WHERE starts_with(claim_id, 'a1')")
def prefix_seek(spark, d):
    return tb.claims(spark, d).filter(F.startswith("claim_id", F.lit("a1"))).select("claim_id")


@query("f6_trust_order", _sql(tb.CLAIMS) + "SELECT CASE trust_state WHEN 'verified' THEN 0 WHEN 'disputed' THEN 1 WHEN 'observed' THEN 2 ELSE 3 END AS trust_order, count(*)::BIGINT AS n FROM claims GROUP BY 1")
def trust_order(spark, d):
    s = F.col("trust_state")
    return tb.claims(spark, d).groupBy(F.when(s == "verified", 0).when(s == "disputed", 1).when(s == "observed", 2).otherwise(3).alias("trust_order")).agg(F.count(F.lit(1)).alias("n"))


@query("f10_stale_files", _sql(tb.SOURCES, tb.LISTING) + "SELECT source_id, content_hash IS DISTINCT FROM current_hash AS stale FROM sources LEFT JOIN listing USING (path)")
def stale_files(spark, d):
    met = tb.sources(spark, d).join(tb.listing(spark, d).select("path", "content_hash"), "path", "left")
    return met.select("source_id", (~F.col("content_hash").eqNullSafe(F.col("current_hash"))).alias("stale"))


_EVIDENCE = "evidence AS (SELECT sha1((o_custkey % 1500)::VARCHAR) AS claim_id, o_orderkey AS chunk_id FROM orders WHERE o_orderkey % 3 <> 0)"
_LIVE = "live AS (SELECT o_orderkey AS chunk_id FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 6 <> 0)"


def _evidence(spark, d):
    o = tb.table(spark, d, "orders")
    return o.filter("o_orderkey % 3 <> 0").select(F.sha1((F.col("o_custkey") % 1500).cast("string").cast("binary")).alias("claim_id"), F.col("o_orderkey").alias("chunk_id"))


def _live(spark, d):
    return tb.table(spark, d, "orders").filter("o_orderkey % 4 <> 0 AND o_custkey % 6 <> 0").select(F.col("o_orderkey").alias("chunk_id"))


@query("j3_live_claims", _sql(tb.CLAIMS, _EVIDENCE, _LIVE) + "SELECT claim_id, trust_state FROM claims c WHERE trust_state = 'proposed' OR EXISTS (SELECT 1 FROM evidence e JOIN live USING (chunk_id) WHERE e.claim_id = c.claim_id)")
def live_claims(spark, d):
    return ledger.live_claims(tb.claims(spark, d), _evidence(spark, d), _live(spark, d)).select("claim_id", "trust_state")


@query("j2_claims_for_chunks", _sql(tb.CLAIMS, _EVIDENCE, _LIVE) + "SELECT DISTINCT c.claim_id, c.project_id FROM claims c JOIN evidence USING (claim_id) JOIN live USING (chunk_id)")
def claims_for_chunks(spark, d):
    of = _evidence(spark, d).join(_live(spark, d), "chunk_id", "left_semi")
    return tb.claims(spark, d).join(of, "claim_id", "left_semi").select("claim_id", "project_id")


@query("j4_pending_claims", _sql(tb.CLAIMS, tb.VALIDATIONS) + "SELECT claim_id FROM claims WHERE trust_state = 'proposed' AND claim_id NOT IN (SELECT claim_id FROM validations)")
def pending_claims(spark, d):
    return ledger.pending(tb.claims(spark, d), tb.validations(spark, d)).select("claim_id")


@query("j6_validated_states", _sql(tb.CLAIMS, tb.VALIDATIONS) + "SELECT claim_id, coalesce((SELECT arg_max(result, validation_id) FROM validations v WHERE v.claim_id = c.claim_id), trust_state) AS trust_state FROM claims c")
def validated_states(spark, d):
    return ledger.validated(tb.claims(spark, d), tb.validations(spark, d)).select("claim_id", "trust_state")


@query("g12_claim_validations", _sql(tb.CLAIMS, tb.VALIDATIONS) + "SELECT claim_id, validation_id, result, row_number() OVER (PARTITION BY claim_id ORDER BY validation_id)::INT AS no FROM claims JOIN validations USING (claim_id)")
def claim_validations(spark, d):
    from pyspark.sql import Window as W

    met = tb.claims(spark, d).select("claim_id").join(tb.validations(spark, d), "claim_id")
    return met.select("claim_id", "validation_id", "result", F.row_number().over(W.partitionBy("claim_id").orderBy("validation_id")).alias("no"))


@query("v13_integrity", _sql(tb.CLAIMS, tb.VALIDATIONS, _EVIDENCE, _LIVE) + """SELECT 'evidence_without_claim' AS "check", count(*)::BIGINT AS violations FROM evidence WHERE claim_id NOT IN (SELECT claim_id FROM claims)
UNION ALL SELECT 'evidence_without_chunk', count(*)::BIGINT FROM evidence WHERE chunk_id NOT IN (SELECT chunk_id FROM live)
UNION ALL SELECT 'claim_without_evidence', count(*)::BIGINT FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM evidence)
UNION ALL SELECT 'validation_without_claim', count(*)::BIGINT FROM validations WHERE claim_id NOT IN (SELECT claim_id FROM claims)""")
def integrity(spark, d):
    c, e, live = tb.claims(spark, d), _evidence(spark, d), _live(spark, d)
    return ledger.integrity({"evidence_without_claim": (e, c, "claim_id", "claim_id"), "evidence_without_chunk": (e, live, "chunk_id", "chunk_id"), "claim_without_evidence": (c, e, "claim_id", "claim_id"), "validation_without_claim": (tb.validations(spark, d), c, "claim_id", "claim_id")})


@query("v3_changes", _sql(tb.SOURCES, tb.LISTING) + """SELECT path, CASE WHEN l.path IS NULL THEN 'missing' WHEN s.path IS NULL THEN 'new' WHEN l.size = s.size AND l.mtime = s.mtime THEN 'unchanged' ELSE 'changed' END AS state
FROM listing l FULL JOIN (SELECT * FROM sources WHERE active) s USING (path)""")
def change_states(spark, d):
    return ledger.changes(tb.listing(spark, d), tb.sources(spark, d))


@query("v7_freshness", "WITH s AS (" + _sql(tb.SOURCES, tb.LISTING) + """SELECT CASE WHEN l.path IS NULL THEN 'missing' WHEN s.path IS NULL THEN 'new' WHEN l.size = s.size AND l.mtime = s.mtime THEN 'unchanged' ELSE 'changed' END AS state
FROM listing l FULL JOIN (SELECT * FROM sources WHERE active) s USING (path)) SELECT state, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def freshness(spark, d):
    return ledger.changes(tb.listing(spark, d), tb.sources(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_RENAMES = """fresh AS (SELECT content_hash, min(path) AS path FROM listing WHERE path NOT IN (SELECT path FROM sources) GROUP BY 1),
gone AS (SELECT current_hash AS content_hash, min(path) AS old_path FROM sources WHERE path NOT IN (SELECT path FROM listing) GROUP BY 1 HAVING count(*) = 1),
moved AS (SELECT path, old_path FROM fresh JOIN gone USING (content_hash))"""


@query("j15_renames", _sql(tb.SOURCES, tb.LISTING, _RENAMES) + "SELECT * FROM moved")
def rename_pairs(spark, d):
    return ledger.renames(tb.listing(spark, d), tb.sources(spark, d))


@query("v4_version_actions", _sql(tb.SOURCES, tb.LISTING, tb.VERSIONS, _RENAMES) + """SELECT l.path, CASE WHEN s.source_id IS NULL THEN CASE WHEN m.path IS NOT NULL THEN 'rename' ELSE 'insert' END WHEN s.current_hash = l.content_hash THEN 'touch'
  WHEN EXISTS (SELECT 1 FROM versions v WHERE v.source_id = s.source_id AND v.content_hash = l.content_hash) THEN 'revert' ELSE 'update' END AS action
FROM listing l LEFT JOIN sources s ON l.path = s.path LEFT JOIN moved m ON l.path = m.path""")
def version_actions(spark, d):
    return ledger.version_actions(tb.listing(spark, d), tb.sources(spark, d), tb.versions(spark, d))


@query("v5_deactivated", _sql(tb.SOURCES, tb.LISTING) + "SELECT source_id, path FROM sources WHERE active AND starts_with(path, 'src/') AND path NOT IN (SELECT path FROM listing)")
def deactivated(spark, d):
    return ledger.deactivate(tb.listing(spark, d), tb.sources(spark, d), "src")


@query("g2_copy_free", "SELECT doc_id AS ordinal, source AS version_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1")
def copy_free(spark, d):
    docs = tb.table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("version_id"), F.sha2("text", 256).alias("chunk_hash"))
    return ledger.copy_free(docs).select("ordinal", "version_id")


@query("v10_prune_plan", _sql(tb.CLAIMS, tb.VALIDATIONS, _EVIDENCE, _LIVE) + """, kept AS (SELECT claim_id FROM claims WHERE trust_state <> 'observed' UNION SELECT claim_id FROM validations)
SELECT o_orderkey AS chunk_id FROM orders WHERE o_orderkey NOT IN (SELECT chunk_id FROM live) AND o_orderkey NOT IN (SELECT chunk_id FROM evidence JOIN kept USING (claim_id))""".replace("\n, kept", ", kept"))
def prune_plan(spark, d):
    chunks = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    return ledger.prunable(chunks, _live(spark, d), _evidence(spark, d), tb.claims(spark, d), tb.validations(spark, d))


@query("v11_project_groups", "WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 10 AS b FROM supplier WHERE s_suppkey <= (SELECT max(s_suppkey) - 10 FROM supplier) AND s_suppkey % 40 < 30), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1")
def project_groups(spark, d):
    s = tb.table(spark, d, "supplier")
    top = s.agg((F.max("s_suppkey") - 10).alias("top"))
    links = s.join(F.broadcast(top)).filter("s_suppkey <= top AND s_suppkey % 40 < 30").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 10).alias("b"))
    return ledger.group_projects(links)


@query("j8_path_owner", "WITH p AS (SELECT p_partkey AS id, 'root/' || (p_partkey % 7) || '/' || (p_partkey % 3) || '/' || p_partkey || '.md' AS path FROM part), a AS (SELECT 'root' AS path, 'all' AS project_id UNION ALL SELECT 'root/' || r_regionkey, 'r' || r_regionkey FROM region UNION ALL SELECT 'root/' || r_regionkey || '/1', 's' || r_regionkey FROM region) SELECT p.path, arg_max(project_id, length(a.path)) AS project_id FROM p JOIN a ON p.path = a.path OR starts_with(p.path, a.path || '/') GROUP BY 1")
def path_owner(spark, d):
    k = F.col("p_partkey")
    p = tb.table(spark, d, "part").select(F.concat(F.lit("root/"), (k % 7).cast("string"), F.lit("/"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"))
    r = F.col("r_regionkey").cast("string")
    region = tb.table(spark, d, "region")
    a = region.limit(1).select(F.lit("root").alias("path"), F.lit("all").alias("project_id")).union(region.select(F.concat(F.lit("root/"), r), F.concat(F.lit("r"), r))).union(region.select(F.concat(F.lit("root/"), r, F.lit("/1")), F.concat(F.lit("s"), r)))
    return ledger.owner_of(p, a)


_PROJECTS = "projects AS (SELECT 'n' || n_nationkey AS project_id, CASE WHEN n_nationkey % 8 = 3 THEN 'shared' WHEN n_nationkey < 5 THEN 'domain' ELSE 'project' END AS scope, CASE WHEN n_nationkey < 5 THEN 'w/' || n_nationkey ELSE 'w/' || n_regionkey || '/' || n_nationkey END AS path FROM nation)"


@query("r7_search_scope", _sql(_PROJECTS) + """, every AS (SELECT project_id AS for_project, project_id, 0 AS tier, 0 AS depth FROM projects
  UNION ALL SELECT a.project_id, b.project_id, 1, -length(b.path) FROM projects a JOIN projects b ON b.scope = 'domain' AND a.project_id <> b.project_id AND starts_with(a.path, b.path || '/')
  UNION ALL SELECT a.project_id, b.project_id, 2, 0 FROM projects a JOIN projects b ON b.scope = 'shared' AND a.project_id <> b.project_id),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY for_project, project_id ORDER BY tier, depth) = 1)
SELECT for_project, project_id, (row_number() OVER (PARTITION BY for_project ORDER BY tier, depth, project_id) - 1)::INT AS priority FROM best""".replace("\n, every", ", every"))
def search_scope(spark, d):
    n = tb.table(spark, d, "nation")
    k = F.col("n_nationkey")
    p = n.select(F.concat(F.lit("n"), k.cast("string")).alias("project_id"), F.when(k % 8 == 3, "shared").when(k < 5, "domain").otherwise("project").alias("scope"), F.when(k < 5, F.concat(F.lit("w/"), k.cast("string"))).otherwise(F.concat(F.lit("w/"), F.col("n_regionkey").cast("string"), F.lit("/"), k.cast("string"))).alias("path"))
    return ledger.search_scope(p.select("project_id", "scope"), p.select("project_id", "path"))


@query("a2_usage_by_agent", _sql(tb.RUNS) + "SELECT coalesce(agent, '(unrecorded)') AS agent, project_id, count(*)::BIGINT AS runs, round(avg(elapsed_ms), 2) AS avg_ms, max(created_at) AS last_run FROM runs GROUP BY 1, 2")
def usage_by_agent(spark, d):
    return ledger.usage(tb.runs(spark, d))


@query("a7_latency_median", _sql(tb.RUNS) + "SELECT project_id, quantile_cont(elapsed_ms, 0.5) AS median_ms, max(elapsed_ms) AS max_ms FROM runs GROUP BY 1")
def latency_median(spark, d):
    return tb.runs(spark, d).groupBy("project_id").agg(F.percentile("elapsed_ms", F.lit(0.5)).alias("median_ms"), F.max("elapsed_ms").alias("max_ms"))


@query("c8_run_budgets", _sql(tb.RUNS) + "SELECT run_id, greatest(0, 8 - row_number() OVER (PARTITION BY project_id, agent ORDER BY created_at, run_id))::BIGINT AS remaining FROM runs")
def run_budgets(spark, d):
    return ledger.budgets(tb.runs(spark, d), 8)


@query("c9_latest_run", _sql(tb.RUNS) + "SELECT agent, arg_max(run_id, (created_at, run_id)) AS run_id FROM runs WHERE agent IS NOT NULL GROUP BY 1")
def latest_run(spark, d):
    r = tb.runs(spark, d).filter("agent is not null").withColumn("o", F.struct("created_at", "run_id"))
    return ledger.latest(r, ["agent"], "o").select("agent", "run_id")


@query("c11_last_three_runs", _sql(tb.RUNS) + "SELECT project_id, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) <= 3")
def last_three_runs(spark, d):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("project_id").orderBy(F.col("created_at").desc(), F.col("run_id").desc()))
    return tb.runs(spark, d).withColumn("r", place).filter("r <= 3").select("project_id", "run_id")


@query("a1_resume_counts", _sql(tb.CLAIMS, tb.VALIDATIONS) + ", s AS (SELECT claim_id, project_id, coalesce((SELECT arg_max(result, validation_id) FROM validations v WHERE v.claim_id = c.claim_id), trust_state) AS trust_state FROM claims c) SELECT project_id, trust_state, count(*)::BIGINT AS n FROM s GROUP BY 1, 2".replace("\n,", ","))
def resume_counts(spark, d):
    return ledger.validated(tb.claims(spark, d), tb.validations(spark, d)).groupBy("project_id", "trust_state").agg(F.count(F.lit(1)).alias("n"))


@query("u1_live_or_proposed", _sql(tb.CLAIMS, _EVIDENCE) + "SELECT claim_id FROM evidence UNION SELECT claim_id FROM claims WHERE trust_state = 'proposed'")
def live_or_proposed(spark, d):
    return _evidence(spark, d).select("claim_id").union(tb.claims(spark, d).filter("trust_state = 'proposed'").select("claim_id")).distinct()


@query("l1_newest_claims", _sql(tb.CLAIMS) + "SELECT claim_id, no FROM claims ORDER BY no DESC, claim_id LIMIT 20")
def newest_claims(spark, d):
    return tb.claims(spark, d).select("claim_id", "no").orderBy(F.col("no").desc(), "claim_id").limit(20)


@query("c12_inbox_cards", "SELECT c_custkey AS id, 'CARD/v1 | kind=note | topic=' || lower(c_mktsegment) || ' | from=' || c_custkey AS card FROM customer WHERE c_mktsegment = 'BUILDING'")
def inbox_cards(spark, d):
    c = tb.table(spark, d, "customer")
    card = F.concat(F.lit("CARD/v1 | kind=note | topic="), F.lower("c_mktsegment"), F.lit(" | from="), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), card.alias("card")).filter(F.col("card").like("CARD/v1 |%") & F.contains("card", F.lit("| topic=building |")))


@query("d1_upsert", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def upsert(spark, d):
    c = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return ledger.upsert(c, tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("d2_insert_new", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT s_suppkey FROM supplier)")
def insert_new(spark, d):
    return ledger.insert_new(tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id")), tb.table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("d3_move_rows", "WITH m AS (SELECT c_custkey AS id, 'p' || (c_custkey % 6) AS old, CASE WHEN c_custkey % 6 = 5 THEN 'p0' ELSE 'p' || (c_custkey % 6) END AS project_id, c_name[-3:] AS name FROM customer) SELECT project_id, name FROM m GROUP BY 1, 2")
def move_rows(spark, d):
    c = tb.table(spark, d, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") % 6).cast("string")).alias("project_id"), F.substring("c_name", -3, 3).alias("name"))
    mapping = tb.table(spark, d, "region").limit(1).select(F.lit("p5").alias("project_id"), F.lit("p0").alias("survivor_id"))
    return ledger.move_rows(c, mapping, ["name"])


@query("j9_match_partner", "WITH m AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation WHERE n_nationkey < (n_nationkey * 7 + 3) % 25) SELECT n_nationkey AS project, CASE WHEN a = n_nationkey THEN b ELSE a END AS partner FROM nation JOIN m ON n_nationkey = a OR n_nationkey = b")
def match_partner(spark, d):
    n = tb.table(spark, d, "nation")
    m = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b")).filter("a < b")
    both = m.select(F.col("a").alias("project"), F.col("b").alias("partner")).union(m.select("b", "a"))
    return both.join(n.select(F.col("n_nationkey").alias("project")), "project")


@query("j10_merge_mapping", _sql(tb.CLAIMS) + """, w AS (SELECT no, claim_id, project_id, trust_state, 'rule ' || (no % 97) || ' of ' || split_part(normalized_text, ' must ', 2) AS wording FROM claims)
SELECT a.claim_id AS loser, min(b.claim_id) AS survivor FROM w a JOIN w b ON a.wording = b.wording AND a.project_id = 'p1' AND b.project_id = 'p2' GROUP BY 1""".replace("\n, w", ", w"))
def merge_mapping(spark, d):
    c = tb.claims(spark, d)
    wording = F.concat(F.lit("rule "), (F.col("no") % 97).cast("string"), F.lit(" of "), F.element_at(F.split("normalized_text", " must "), 2))
    return ledger.merge_mapping(c.withColumn("normalized_text", wording), "p1", "p2")


@query("j14_structure_matches", "WITH s AS (SELECT s_suppkey AS id, md5((s_nationkey % 9)::VARCHAR) AS h FROM supplier) SELECT a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.h = b.h AND a.id < b.id")
def structure_matches(spark, d):
    s = tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.md5((F.col("s_nationkey") % 9).cast("string").cast("binary")).alias("h"))
    # A signature of many projects is dealt out: each stretch of its left rows meets all its right rows in a task of its own.
    tasks, parts = int(spark.conf.get("spark.sql.shuffle.partitions")), 32
    left = s.select(F.col("id").alias("left_id"), "h", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).repartition(tasks, "h", "part")
    right = s.select(F.col("id").alias("right_id"), "h", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(tasks, "h", "part")
    return left.join(right.hint("merge"), ["h", "part"]).filter("left_id < right_id").select("left_id", "right_id")


@query("c13_resolve_claims", _sql(tb.CLAIMS) + """, refs AS (SELECT CASE WHEN no % 3 = 0 THEN claim_id WHEN no % 3 = 1 THEN claim_id[1:9] ELSE normalized_text END AS reference FROM claims),
m AS (SELECT reference, claim_id FROM refs JOIN claims ON length(reference) >= 8 AND starts_with(claim_id, reference) UNION SELECT reference, claim_id FROM refs JOIN claims ON normalized_text = reference)
SELECT reference, CASE WHEN count(*) = 1 THEN min(claim_id) END AS claim_id, count(*)::BIGINT AS matches FROM m GROUP BY 1""".replace("\n, refs", ", refs"))
def resolve(spark, d):
    """Every claim is a reference."""
    c = tb.claims(spark, d)
    refs = c.select(F.when(F.col("no") % 3 == 0, F.col("claim_id")).when(F.col("no") % 3 == 1, F.substring("claim_id", 1, 9)).otherwise(F.col("normalized_text")).alias("reference"))
    return ledger.resolve_claims(refs, c)


@query("c14_replay_drift", _sql(tb.RUNS) + """, b AS (SELECT run_id, md5(run_id::VARCHAR) AS h, run_id % 5 AS v, run_id % 7 AS s FROM runs WHERE run_id % 11 <> 0), a AS (SELECT run_id, CASE WHEN run_id % 4 = 0 THEN md5('x') ELSE md5(run_id::VARCHAR) END AS h, CASE WHEN run_id % 8 = 0 THEN -1 ELSE run_id % 5 END AS v, CASE WHEN run_id % 12 = 0 THEN -1 ELSE run_id % 7 END AS s FROM runs WHERE run_id % 13 <> 0)
SELECT run_id, CASE WHEN b.h IS NULL OR a.h IS NULL THEN 'missing' WHEN a.h = b.h THEN 'match' WHEN a.v <> b.v THEN 'corpus_moved' WHEN a.s <> b.s THEN 'sources_changed' ELSE 'algorithmic' END AS cause FROM b FULL JOIN a USING (run_id)""".replace("\n, b AS", ", b AS"))
def replay(spark, d):
    r, k = tb.runs(spark, d), F.col("run_id")
    h = F.md5(k.cast("string").cast("binary"))
    b = r.filter("run_id % 11 <> 0").select("run_id", h.alias("packet_hash"), (k % 5).alias("corpus_version"), (k % 7).alias("sources_hash"))
    a = r.filter("run_id % 13 <> 0").select("run_id", F.when(k % 4 == 0, F.md5(F.lit("x").cast("binary"))).otherwise(h).alias("packet_hash"), F.when(k % 8 == 0, -1).otherwise(k % 5).alias("corpus_version"), F.when(k % 12 == 0, -1).otherwise(k % 7).alias("sources_hash"))
    return ledger.replay_drift(b, a)
