"""Queries of one-call checks, audits, clean-up plans, pruning and migrations of a store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import checks, compact, evidence, ingest, ledger, live, maintenance
from ..sources import files, tree
from ..sources.store import Store, kept, scratch
from . import tables as tb
from .registry import query


def _answer_rows(spark, d):
    """Orders' policies as evidence of claims: a call a customer, a question an answer."""
    p = tb.policies(spark, d)
    spans = p.select(F.concat_ws("/", F.col("request_id").cast("string"), F.lit("a")).alias("call"), "project_id", "chunk_id", "path", F.lit(1).alias("line_start"), F.regexp_replace("text", r"priority [^ ]+( [a-z]+)? within", "priority within").alias("text"))
    asked = tb.table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"), F.lit("a").alias("question_id"), F.lit("claim").alias("type"), F.lit("Parcel priority must ship within 3 days").alias("text"),
        F.lit(None).cast("array<string>").alias("options"), F.lit(None).cast("map<string,array<string>>").alias("aliases"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("pattern"),
    )
    return asked, checks.answer(asked, spans)


_CALL = f"""WITH {tb.POLICIES}, f AS (SELECT DISTINCT request_id, path, chunk_id, banned AS neg, days FROM policies WHERE days = 3 OR NOT banned),
v AS (SELECT request_id, count(DISTINCT chunk_id) FILTER (days = 3 AND NOT neg) AS support, count(DISTINCT chunk_id) FILTER ((days = 3 AND neg) OR (days <> 3 AND NOT neg)) AS oppose FROM f GROUP BY 1)"""


@query("q3_one_call", f"""{_CALL} SELECT c_custkey AS request_id, CASE WHEN coalesce(support, 0) > 0 AND coalesce(oppose, 0) > 0 THEN 'disagreement' WHEN coalesce(support, 0) > 0 THEN 'supported' WHEN coalesce(oppose, 0) > 0 THEN 'contradicted' ELSE 'unknown' END AS answer,
  CASE WHEN coalesce(support, 0) > 0 AND coalesce(oppose, 0) = 0 THEN 'true' WHEN coalesce(support, 0) = 0 AND coalesce(oppose, 0) > 0 THEN 'false' END AS value FROM customer LEFT JOIN v ON c_custkey = request_id""")
def one_call(spark, d):
    return _answer_rows(spark, d)[1].select("request_id", "answer", "value")


@query("q11_check_hash")
def check_hash(spark, d):
    return checks.results(*_answer_rows(spark, d)).select("request_id", "status", "check_hash")


@query("q12_fitted_checks")
def fitted_checks(spark, d):
    return checks.fit(_answer_rows(spark, d)[1], 900).select("request_id", "n_bytes", F.get_json_object("packet_json", "$.status").alias("status"))


@query("q13_explain_check", f"""WITH {tb.SOURCES}, e AS (SELECT l_orderkey AS request_id, l_linenumber::VARCHAR AS question_id, 'p' || (l_suppkey % 5) AS project_id, 'src/' || (l_partkey % 10) || '/' || l_partkey || '.md' AS path, min(l_partkey) AS chunk_id, min(l_suppkey % 3) AS old FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT e.request_id, question_id, e.path, chunk_id, coalesce(old = 0 OR s.path IS NULL, true) AS stale FROM e LEFT JOIN (SELECT DISTINCT path FROM sources WHERE active) s ON e.path = s.path WHERE project_id <> 'p3'""")
def explain_check(spark, d):
    """Lines of orders as recorded evidence; a third of it rests on older files; one project is not to be seen."""
    s = tb.sources(spark, d).filter("active")
    heads = s.select("path", "current_hash").join(spark.range(5).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("project_id"), F.lit(1).alias("one")), F.lit(1) == F.col("one")).select("project_id", "path", "current_hash", F.lit(True).alias("active"))
    li = tb.table(spark, d, "lineitem")
    part = F.col("l_partkey")
    path = F.concat(F.lit("src/"), (part % 10).cast("string"), F.lit("/"), part.cast("string"), F.lit(".md"))
    items = li.groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("string").alias("question_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("project_id"), path.alias("path")).agg(F.min("l_partkey").alias("chunk_id"), F.min(F.col("l_suppkey") % 3).alias("old"))
    known = tb.sources(spark, d).select("path", "current_hash").dropDuplicates(["path"])
    recorded = items.join(known, "path", "left").withColumn("source_hash", F.when(F.col("old") == 0, "older").otherwise(F.coalesce("current_hash", F.lit("none"))))
    visible = spark.createDataFrame([("p0",), ("p1",), ("p2",), ("p4",)], "project_id string")
    return checks.explain(recorded, heads, visible)


_OWN = "list_distinct(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z0-9_][A-Za-z0-9_.-]*'), lambda x: length(x) >= 3 AND x NOT IN (%s)))" % ", ".join("'" + w + "'" for w in t.STOPWORDS)


@query("c10_audit_answers", f"""WITH m AS (SELECT o_orderkey AS item, o_custkey AS request_id, o_orderkey % 4 AS k, 'parcel ships priority ' || lower(o_orderpriority) || ' soon' AS text FROM orders),
r AS (SELECT c_custkey AS request_id, 'Parcel  ships priority 1-urgent soon. Parcel ships quickly with clerk reports. Short.' AS answer FROM customer),
s AS (SELECT request_id, 0 AS statement_no, ['parcel', 'ships', 'priority', '1-urgent', 'soon.'] AS tokens, 'parcel ships priority 1-urgent soon.' AS whole FROM r UNION ALL SELECT request_id, 1, ['parcel', 'ships', 'quickly', 'clerk', 'reports.'], 'parcel ships quickly with clerk reports.' FROM r),
o AS (SELECT s.request_id, statement_no, max(CASE WHEN contains(text, whole) THEN 1.0 ELSE len(list_filter(tokens, lambda x: list_contains(string_split(text, ' '), x))) / len(tokens) END) AS best FROM s LEFT JOIN m ON m.request_id = s.request_id GROUP BY 1, 2),
q AS (SELECT o_custkey AS request_id, count(*) FILTER (o_orderkey % 9 = 0) AS uncovered, count(*) FILTER (o_orderkey % 11 = 1 AND o_orderkey % 9 <> 0) AS disagreements FROM orders GROUP BY 1),
u AS (SELECT request_id, count(*) FILTER (coalesce(best, 0) < 0.45) AS unsupported FROM o GROUP BY 1)
SELECT r.request_id, CASE WHEN coalesce(disagreements, 0) > 0 THEN 'clarification_needed' WHEN coalesce(uncovered, 0) > 0 OR coalesce(unsupported, 0) > 0 THEN 'residuals_open' ELSE 'match_move_complete' END AS result,
  coalesce(uncovered, 0)::BIGINT AS uncovered, coalesce(unsupported, 0)::BIGINT AS unsupported, coalesce(disagreements, 0)::BIGINT AS disagreements FROM r LEFT JOIN q USING (request_id) LEFT JOIN u USING (request_id)""")
def audit_answers(spark, d):
    """Two statements a customer against the orders' lines; some orders are open requirements, some disagree."""
    o, k = tb.table(spark, d, "orders"), F.col("o_orderkey")
    answers = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("Parcel  ships priority 1-urgent soon. Parcel ships quickly with clerk reports. Short.").alias("answer"))
    items = o.select(F.col("o_custkey").alias("request_id"), k.cast("int").alias("item_no"), F.concat(F.lit("parcel ships priority "), F.lower("o_orderpriority"), F.lit(" soon")).alias("text"))
    needs = o.select(F.col("o_custkey").alias("request_id"), k.alias("leaf_no"), F.when(k % 9 == 0, "unknown").when(k % 11 == 1, "disagreement").otherwise("evidence_found").alias("status"), F.lit(0).alias("found"))
    return evidence.audit_answers(answers, items, needs)[1].select("request_id", "result", "uncovered", "unsupported", "disagreements")


@query("v11_cleanup_plan", """WITH p AS (SELECT c_custkey AS id, 'p' || c_custkey AS project_id, 'k' || (c_custkey // 3) AS key, c_custkey % 7 = 0 AS guarded, c_custkey % 5 = 0 AS idle, c_nationkey FROM customer),
g AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, max(id) FILTER (guarded) OVER (PARTITION BY key) AS strong FROM p),
s AS (SELECT *, arg_max(project_id, (guarded::INT, NOT idle, project_id)) OVER (PARTITION BY key) AS survivor, count(DISTINCT c_nationkey % 2) OVER (PARTITION BY key) AS commits FROM g)
SELECT project_id, CASE WHEN n > 1 AND survivor <> project_id AND commits > 1 THEN 'review' WHEN n > 1 AND survivor <> project_id THEN 'merge' WHEN idle AND guarded THEN 'review' WHEN idle THEN 'prune' ELSE 'keep' END AS action, CASE WHEN n > 1 AND survivor <> project_id THEN survivor END AS survivor_id FROM s""")
def cleanup_plan(spark, d):
    """Customers as projects: three registrations of a folder each, some validated, some idle."""
    c, k = tb.table(spark, d, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("p"), k.cast("string"))
    idle = k % 5 == 0
    projects = c.select(
        name.alias("project_id"), F.concat(F.lit("directory-path:"), name).alias("canonical_key"), F.lit("directory").alias("kind"), F.lit("app").alias("display_name"), F.lit("/w/app").alias("path"), F.lit(True).alias("path_exists"),
        (F.col("c_nationkey") % 2).cast("string").alias("root_commit"), F.lit(False).alias("worktree"), (k % 7 == 0).cast("int").alias("validations"), F.lit(0).alias("ledger_claims"), F.lit(1).alias("corpus_version"),
        F.when(idle, 0).otherwise(1).alias("active_sources"), F.when(idle, 0).otherwise(1).alias("runs"), F.lit("t").alias("created_at"),
    )
    keys = c.select(name.alias("project_id"), F.concat(F.lit("k"), F.floor(k / 3).cast("string")).alias("key"))
    return ledger.cleanup_plan(projects, keys, ["/tmp"]).select("project_id", "action", "survivor_id")


@query("v10_pruned", """WITH v AS (SELECT p_partkey * 2 + no AS version_id, p_partkey AS source_id, no FROM part, (VALUES (0), (1)) AS x(no)), c AS (SELECT version_id * 10 + i AS chunk_id, version_id, source_id, no FROM v, range(2) AS r(i)),
e AS (SELECT DISTINCT 'c' || (chunk_id % 700) AS claim_id, chunk_id FROM c WHERE chunk_id % 3 = 0), k AS (SELECT DISTINCT claim_id, CASE WHEN substr(claim_id, 2)::INT % 4 = 0 THEN 'verified' ELSE 'observed' END AS state FROM e),
live AS (SELECT chunk_id FROM c WHERE no = 1 AND source_id % 13 <> 0), gone AS (SELECT chunk_id FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM live) AND chunk_id NOT IN (SELECT chunk_id FROM e JOIN k USING (claim_id) WHERE state <> 'observed' OR substr(claim_id, 2)::INT % 9 = 0)),
back AS (SELECT * FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM gone))
SELECT 'chunks' AS name, count(*)::BIGINT AS n FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) UNION ALL SELECT 'evidence', count(*) FROM back
UNION ALL SELECT 'claims', count(*) FROM k WHERE state <> 'observed' OR substr(claim_id, 2)::INT % 9 = 0 OR claim_id IN (SELECT claim_id FROM back)""")
def pruned(spark, d):
    v = tb.table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("no")).select((F.col("source_id") * 2 + F.col("no")).alias("version_id"), "source_id", F.col("no").cast("string").alias("content_hash"))
    c = v.select("version_id", F.explode(F.array(F.col("version_id") * 10, F.col("version_id") * 10 + 1)).alias("chunk_id")).select("chunk_id", "version_id")
    sources = v.select("source_id").distinct().select("source_id", F.lit("1").alias("current_hash"), (F.col("source_id") % 13 != 0).alias("active"))
    e = c.filter("chunk_id % 3 = 0").select(F.concat(F.lit("c"), (F.col("chunk_id") % 700).cast("string")).alias("claim_id"), "chunk_id").distinct()
    no = F.substring("claim_id", 2, 9).cast("int")
    claims = e.select("claim_id").distinct().withColumn("trust_state", F.when(no % 4 == 0, "verified").otherwise("observed"))
    none = spark.createDataFrame([], "node_id string, kind string, subject string, object string, chunk_id long")
    out = maintenance.pruned(c, v, sources, none.select("node_id", "kind"), none.select("subject", "object", "chunk_id"), claims, e, claims.filter(no % 9 == 0).select("claim_id"))
    counted = [out[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("chunks", "evidence", "claims")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("m4_migrated_runs", "WITH " + tb.RUNS + " SELECT run_id, project_id, NULL::VARCHAR AS agent FROM runs")
def migrated_runs(spark, d):
    """Runs written by the oldest format, after all its steps."""
    store = Store(spark, scratch(spark, "store"))
    store.commit(replace={"runs": tb.runs(spark, d).select("run_id", "project_id")}, first_format=1)
    maintenance.migrate(store)
    return store.read("runs")


@query("v6_ingested_sources", """WITH first AS (SELECT 'd/' || doc_id || '.md' AS path, md5(text) AS h FROM documents),
second AS (SELECT CASE WHEN doc_id % 7 = 3 THEN 'e/' ELSE 'd/' END || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 1 THEN md5(text || ' edited') ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 <> 2),
gone AS (SELECT h, min(path) AS old FROM (FROM first ANTI JOIN second USING (path)) GROUP BY h HAVING count(*) = 1),
moved AS (SELECT h, min(path) AS path, any_value(old) AS old FROM (FROM second ANTI JOIN first USING (path)) JOIN gone USING (h) GROUP BY h)
SELECT second.path, second.h AS current_hash, true AS active, CASE WHEN first.h <> second.h THEN 2 ELSE 1 END::BIGINT AS n_versions FROM second LEFT JOIN first USING (path)
UNION ALL SELECT path, h, false, 1 FROM first WHERE path NOT IN (SELECT path FROM second) AND path NOT IN (SELECT old FROM moved)""")
def ingested_sources(spark, d):
    """Every document as a file, ingested twice: some are edited, some gone, some renamed by the second run."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    docs = tb.table(spark, d, "documents")

    def files(path, text, docs):
        each = docs.select(path.alias("path"), text.alias("text"))
        return each.select("path", "text", F.md5(F.col("text").cast("binary")).alias("content_hash"), F.length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))

    store = Store(spark, scratch(spark, "ingested"))
    ingest.ingest(store, "p", files(F.concat(F.lit("d/"), n, F.lit(".md")), F.col("text"), docs))
    later = F.concat(F.when(k % 7 == 3, "e/").otherwise("d/"), n, F.lit(".md"))
    ingest.ingest(store, "p", files(later, F.when(k % 7 == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")), docs.filter("doc_id % 7 <> 2")))
    versions = store.read("versions").groupBy("source_id").agg(F.count("*").alias("n_versions"))
    return ingest.heads(store).join(versions, "source_id").select("path", "current_hash", "active", "n_versions")


@query("c1_compact_packets")
def compact_packets(spark, d):
    """Orders' lines as spans of one packet a customer, within 1,500 bytes."""
    p = tb.policies(spark, d)
    torn = (F.col("request_id") % 4 == 0) & (F.col("chunk_id") % 5 < 3)
    item = F.struct("project_id", "path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), "text", (F.col("chunk_id") % 23 == 0).alias("stale"), torn.alias("disagreeing"))
    whole = p.groupBy("request_id").agg(F.lit("parcel ship").alias("query"), F.sort_array(F.collect_list(item)).alias("evidence"))
    return compact.compacted(whole, 1500).select("request_id", "n_bytes", F.md5(F.col("packet_json").cast("binary")).alias("h"))


_SPACE = "||".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


@query("r13_live_files", rf"""WITH l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(lines) + 1, 5)) AS line_start, lines FROM l),
p AS (SELECT doc_id, line_start, CASE WHEN doc_id % 7 = 1 THEN 'changed' WHEN doc_id % 7 IN (2, 3) AND doc_id % 2 = 0 OR doc_id % 7 = 2 THEN 'missing' ELSE 'live' END AS live_state, trim(array_to_string(lines[line_start:line_start + 4], chr(10)), {_SPACE}) AS part FROM s)
SELECT doc_id, line_start, live_state, live_state <> 'live' AS stale, md5(CASE WHEN live_state = 'live' OR doc_id % 3 = 0 THEN part ELSE '' END) AS h FROM p""")
def live_files(spark, d):
    """Every document as a file, and references to all its lines; since then some files were edited, deleted, or moved.

    A third of the references have a stored text beside them; of every other moved file the new place is known."""
    docs, k = tb.table(spark, d, "documents"), F.col("doc_id")
    root = live.uri(scratch(spark, "files"))
    path = F.concat((k % 500).cast("string"), F.lit("/"), k.cast("string"), F.lit(".md"))
    broken = F.when(k % 5 == 0, F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?|\n", "\r\n")).otherwise(F.coalesce("text", F.lit("")))
    taken = docs.select("doc_id", path.alias("path"), broken.cast("binary").alias("content"))
    away = k % 7 == 3
    now = taken.filter("doc_id % 7 <> 2").select(F.when(away, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(k % 7 == 1, F.concat("content", F.lit(" edited").cast("binary"))).otherwise(F.col("content")).alias("content"))
    files.write_files(now, root, paths_differ=True)
    moved = taken.filter(away & (k % 2 == 1)).select(F.col("path").alias("old_path"), F.concat(F.lit("moved/"), "path").alias("path"))
    n = F.size(F.split(F.col("content").cast("string"), "\r\n?|\n"))
    spans = taken.select("doc_id", "path", F.sha2("content", 256).alias("content_hash"), F.split(F.col("content").cast("string"), "\r\n?|\n").alias("lines"), F.explode(F.sequence(F.lit(1), n, F.lit(5))).alias("line_start"))
    stored = F.regexp_replace(F.array_join(F.slice("lines", F.col("line_start"), F.lit(5)), "\n"), r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    refs = spans.select("doc_id", "path", "content_hash", "line_start", (F.col("line_start") + 4).alias("line_end"), F.when(k % 3 == 0, stored).alias("text"))
    out = live.hydrate(refs, root, live.line_index(taken), moved)
    return out.select("doc_id", "line_start", "live_state", "stale", F.md5(F.col("text").cast("binary")).alias("h"))


@query("s3_tree_walk", """WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'src/' || (p_partkey % 20) || '/' || p_partkey || '.md' WHEN 1 THEN 'app/node_modules/' || (p_partkey % 20) || '/' || p_partkey || '.md' WHEN 2 THEN '.hidden/' || p_partkey || '.txt'
  WHEN 3 THEN 'mods/m' || (p_partkey % 40) || '/' || p_partkey || '.md' WHEN 4 THEN 'deep/a/b/c' || (p_partkey % 10) || '/' || p_partkey || '.exe' ELSE 'conf/.env.' || p_partkey END AS path FROM part)
SELECT DISTINCT CASE k % 6 WHEN 1 THEN 'app/node_modules' WHEN 2 THEN '.hidden' WHEN 3 THEN CASE WHEN k % 40 % 3 = 0 THEN 'mods/m' || (k % 40) ELSE path END ELSE path END AS relative_path, k % 6 IN (1, 2) OR k % 6 = 3 AND k % 40 % 3 = 0 AS folder,
  CASE WHEN k % 6 IN (1, 2) OR k % 6 = 3 AND k % 40 % 3 = 0 THEN 'ignored_dir' WHEN k % 6 = 4 THEN 'unsupported_type' WHEN k % 6 = 5 THEN 'sensitive_name' END AS reason FROM f""")
def tree_walk(spark, d):
    """A file a part, in a tree with ignored and hidden folders and checkouts of their own; what is found, and what is not entered."""
    p, k = tb.table(spark, d, "part"), F.col("p_partkey")
    s = lambda x: x.cast("string")
    ways = [
        F.concat(F.lit("src/"), s(k % 20), F.lit("/"), s(k), F.lit(".md")), F.concat(F.lit("app/node_modules/"), s(k % 20), F.lit("/"), s(k), F.lit(".md")), F.concat(F.lit(".hidden/"), s(k), F.lit(".txt")),
        F.concat(F.lit("mods/m"), s(k % 40), F.lit("/"), s(k), F.lit(".md")), F.concat(F.lit("deep/a/b/c"), s(k % 10), F.lit("/"), s(k), F.lit(".exe")), F.concat(F.lit("conf/.env."), s(k)),
    ]
    rows = p.select(F.element_at(F.array(*ways), (k % 6 + 1).cast("int")).alias("path"), F.encode("p_name", "UTF-8").alias("content"))
    marks = p.filter("p_partkey % 6 = 3 and p_partkey % 40 % 3 = 0").select(F.concat(F.lit("mods/m"), s(k % 40), F.lit("/.git")).alias("path"), F.lit(b"gitdir: x").alias("content"))
    root = live.uri(scratch(spark, "walked"))
    files.write_files(rows.unionByName(marks), root)
    return tree.walk(spark, root).filter("not folder or reason is not null").select("relative_path", "folder", "reason")
