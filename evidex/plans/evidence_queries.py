"""Queries of claims, conflicts, questions and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evidence, graph, packet
from . import tables as tb
from .registry import query

_P = f"WITH {tb.POLICIES}"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::INT & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
# whether a policy sentence is evidence: the trial verb tells of a test, but "Decision" makes it count
_STATE = "CASE WHEN neg THEN 'negated' WHEN trial THEN 'plain' ELSE 'affirmed' END"


def uuid5_sql(namespace: str, name: str) -> str:
    return f"(SELECT {_UUID} FROM (SELECT sha1(unhex('{namespace}') || encode({name})) AS h))"


@query("g6_claim_ids", f"""{_P}, c AS (SELECT project_id, lower(text) AS normalized_text, count(DISTINCT chunk_id)::BIGINT AS n_evidence FROM policies GROUP BY 1, 2),
h AS (SELECT *, sha1(unhex('{t.CLAIM_NAMESPACE}') || encode(project_id || ':' || normalized_text)) AS h FROM c)
SELECT {_UUID} AS claim_id, project_id, normalized_text, n_evidence FROM h""")
def claim_ids(spark, d):
    return evidence.claims(tb.policies(spark, d).select("chunk_id", "project_id", "text")).select("claim_id", "project_id", "normalized_text", "n_evidence")


@query("g4_graph_edges", f"""{_P}, s AS (SELECT chunk_id, project_id, path, lower(text) AS claim FROM policies),
e AS (SELECT chunk_id, 'contains' AS predicate, sha1(unhex('{t.NODE_NAMESPACE}') || encode(project_id || ':project:' || project_id)) AS a, sha1(unhex('{t.NODE_NAMESPACE}') || encode(project_id || ':source:' || path)) AS b FROM s
  UNION ALL SELECT chunk_id, 'states', sha1(unhex('{t.NODE_NAMESPACE}') || encode(project_id || ':source:' || path)), sha1(unhex('{t.NODE_NAMESPACE}') || encode(project_id || ':claim:' || claim)) FROM s)
SELECT (SELECT {_UUID} FROM (SELECT a AS h)) AS subject, predicate, (SELECT {_UUID} FROM (SELECT b AS h)) AS object, chunk_id FROM e""")
def graph_edges(spark, d):
    p = tb.policies(spark, d).withColumn("heading", F.lit(None).cast("string"))
    of = p.select("project_id", "chunk_id", t.fold(F.col("text")).alias("normalized_text"))
    return graph.edges(p, of)


@query("j12_disagreements", f"""{_P}, s AS (SELECT *, {_STATE} AS side FROM policies)
SELECT DISTINCT l.request_id, l.chunk_id AS negated_chunk, r.chunk_id AS affirmed_chunk FROM s l JOIN s r ON l.request_id = r.request_id AND l.path <> r.path WHERE l.side = 'negated' AND r.side = 'affirmed'""")
def disagreements(spark, d):
    return evidence.disagreements(tb.policies(spark, d).select("request_id", "chunk_id", "path", "text"))


@query("j13_conflict_witness", f"""{_P}, s AS (SELECT *, {_STATE} AS side FROM policies),
pairs AS (SELECT l.request_id, l.chunk_id AS negated_chunk, r.chunk_id AS affirmed_chunk, length(l.text) + length(r.text) AS size FROM s l JOIN s r ON l.request_id = r.request_id AND l.path <> r.path WHERE l.side = 'negated' AND r.side = 'affirmed')
SELECT request_id, negated_chunk, affirmed_chunk, size::INT AS size FROM pairs QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY size, negated_chunk, affirmed_chunk) = 1""")
def conflict_witness(spark, d):
    return evidence.conflict_witness(tb.policies(spark, d).select("request_id", "chunk_id", "path", "text"))


def _spans(spark, d):
    return tb.policies(spark, d).select("request_id", "chunk_id", "path", "text")


@query("q5_evidence_filter", f"""{_P}, f AS (SELECT request_id, path, chunk_id % 6 AS k, days FROM policies),
e AS (SELECT DISTINCT request_id, path, CASE k WHEN 0 THEN 'a' ELSE 'b' END AS wording, CASE k WHEN 0 THEN days END AS days FROM f WHERE k IN (0, 3)) SELECT request_id, count(*)::BIGINT AS n FROM e GROUP BY 1""")
def evidence_filter(spark, d):
    """Of six kinds of sentences two are evidence: a rule and a decided trial; a question, a doubt, a proposal and a mere trial are not."""
    k = F.col("chunk_id") % 6
    days = F.regexp_extract("text", r"within (\d+) days", 1)
    said = F.element_at(t.words_in(["", "Must parcels ship?", "Whether parcels ship is unclear.", "We tested three carriers and chose the second.", "They proposed another carrier.", "We tested three carriers."]), (k + 1).cast("int"))
    spans = _spans(spark, d).withColumn("text", F.when(k == 0, F.concat(F.lit("Parcels must ship within "), days, F.lit(" days."))).otherwise(said))
    return evidence.evidence_sentences(spans).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


@query("q7_check_claims", f"""{_P}, f AS (SELECT DISTINCT request_id, path, banned AS neg, trial, days FROM policies),
v AS (SELECT request_id, count(*) FILTER (days = 3 AND NOT neg) AS support, count(*) FILTER ((days = 3 AND neg) OR (days <> 3 AND NOT neg)) AS oppose FROM f GROUP BY 1),
q AS (SELECT c_custkey AS request_id FROM customer)
SELECT request_id, CASE WHEN coalesce(support, 0) > 0 AND coalesce(oppose, 0) > 0 THEN 'disagreement' WHEN coalesce(support, 0) > 0 THEN 'supported' WHEN coalesce(oppose, 0) > 0 THEN 'contradicted' ELSE 'unknown' END AS answer,
  coalesce(support, 0)::BIGINT AS support, coalesce(oppose, 0)::BIGINT AS oppose FROM q LEFT JOIN v USING (request_id)""")
def check_claims(spark, d):
    q = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("Parcel priority must ship within 3 days").alias("claim"))
    # the priority's own number ("1-urgent") is no day count, so the sentences are read without it
    s = _spans(spark, d).withColumn("text", F.regexp_replace("text", r"priority \d-?[a-z ]+ within|priority [^ ]+( [a-z]+)? within", "priority within"))
    return evidence.check_claims(q, evidence.evidence_sentences(s))


@query("q8_check_choices", f"""{_P}, f AS (SELECT DISTINCT request_id, path, text, neg, priority_name FROM policies WHERE NOT trial),
s AS (SELECT request_id, priority_name, count(*) FILTER (NOT neg) AS yes, count(*) FILTER (neg) AS no FROM f WHERE priority_name IN ('1-urgent', '2-high') GROUP BY 1, 2),
p AS (SELECT request_id, count(*) FILTER (yes > 0) AS sup, count(*) FILTER (yes > 0 AND no > 0) AS torn, count(*) FILTER (yes = 0 AND no > 0) AS ruled, min(priority_name) FILTER (yes > 0) AS first FROM s GROUP BY 1)
SELECT c_custkey AS request_id, CASE WHEN coalesce(sup, 0) >= 2 OR (sup = 1 AND torn > 0) THEN 'disagreement' WHEN sup = 1 THEN 'selected' WHEN ruled > 0 THEN 'excluded' ELSE 'unknown' END AS answer,
  CASE WHEN sup = 1 AND torn = 0 THEN first END AS chosen FROM customer LEFT JOIN p ON c_custkey = request_id""")
def check_choices(spark, d):
    q = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("Which parcel ships within days?").alias("question"), t.words_in(["1-urgent", "2-high"]).alias("options"))
    return evidence.check_choices(q, evidence.evidence_sentences(_spans(spark, d)))


@query("q9_check_values", f"""{_P}, v AS (SELECT request_id, count(DISTINCT days) AS n, min(days)::DOUBLE AS value FROM policies WHERE NOT neg GROUP BY 1)
SELECT c_custkey AS request_id, CASE WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'disagreement' ELSE 'unknown' END AS answer, coalesce(n, 0)::BIGINT AS n_values, CASE WHEN n = 1 THEN value END AS value FROM customer LEFT JOIN v ON c_custkey = request_id""")
def check_values(spark, d):
    q = tb.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("What priority does a parcel have?").alias("question"), F.lit("days").alias("unit"))
    return evidence.check_values(q, evidence.evidence_sentences(_spans(spark, d))).drop("text_value")


_AUDIT = r"""WITH s AS (SELECT item_id AS statement_id, list_distinct(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z0-9_][A-Za-z0-9_.-]*'), lambda x: length(x) >= 3 AND x NOT IN (%s))) AS tokens FROM benchmark),
o AS (SELECT statement_id, least(len(tokens), 24) AS n FROM s),
d AS (SELECT doc_id AS chunk_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z0-9_][A-Za-z0-9_.-]*'))) AS token FROM documents),
r AS (SELECT item_id AS statement_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[A-Za-z0-9_][A-Za-z0-9_.-]*') AS a FROM benchmark),
u AS (SELECT statement_id, unnest(a) AS token, unnest(range(len(a))) AS i FROM r),
f AS (SELECT statement_id, token, min(i) AS i FROM u WHERE length(token) >= 3 AND token NOT IN (%s) GROUP BY 1, 2),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY i) <= 24)
SELECT statement_id, chunk_id, round(count(*) / n, 4) AS score FROM k JOIN d USING (token) JOIN o USING (statement_id) GROUP BY statement_id, chunk_id, n HAVING round(count(*) / n, 4) >= 0.45""".replace("%s", ", ".join("'" + w + "'" for w in t.STOPWORDS))


@query("j11_audit_matrix", _AUDIT)
def audit_matrix(spark, d):
    s = tb.table(spark, d, "benchmark").select(F.col("item_id").alias("statement_id"), "text")
    return evidence.audit(s, tb.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@query("c10_audit_residuals", """WITH k AS (%s) SELECT item_id AS statement_id, max(score) AS best, CASE WHEN max(score) IS NULL THEN 'unsupported_output' ELSE 'matched' END AS result FROM benchmark LEFT JOIN k ON item_id = statement_id GROUP BY 1""" % _AUDIT)
def audit_residuals(spark, d):
    s = tb.table(spark, d, "benchmark").select(F.col("item_id").alias("statement_id"))
    best = audit_matrix(spark, d).groupBy("statement_id").agg(F.max("score").alias("best"))
    return s.join(best, "statement_id", "left").select("statement_id", "best", F.when(F.col("best").isNull(), "unsupported_output").otherwise("matched").alias("result"))


@query("f12_claim_noise", "SELECT p_partkey AS id, (len(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z]{2,}')) < 4 OR length(array_to_string(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z]{2,}'), '')) < 0.55 * length(replace(p_name || ' ' || p_type, ' ', ''))) AS noise FROM part")
def claim_noise(spark, d):
    p = tb.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), t.claim_noise(F.concat_ws(" ", "p_name", "p_type")).alias("noise"))


@query("c2_protected_policy", f"{_P} SELECT chunk_id, chunk_id % 2 = 0 AS protected FROM policies")
def protected_policy(spark, d):
    """Whole rules, their tails, an exception, and a plain sentence."""
    k = F.col("chunk_id") % 4
    tail = F.lit("parcels leave within two days of approval")
    text = F.when(k == 0, F.col("text")).when(k == 1, tail).when(k == 2, F.concat(tail, F.lit(" unless it rains"))).otherwise(F.concat(F.lit("see "), F.col("path")))
    return tb.policies(spark, d).select("chunk_id", packet.protected(text).alias("protected"))


@query("g7_graph_match", """WITH nodes AS (SELECT 'p' || CASE WHEN p_partkey % 4 = 0 THEN 'small' || p_partkey // 400 ELSE 'large' END AS project_id, p_partkey AS node_id, CASE WHEN p_partkey % 11 = 0 THEN 'project' ELSE 'topic' END AS kind, lower(p_name) || ' ' || p_partkey AS name, CASE WHEN p_partkey % 6 = 0 THEN 'verified' WHEN p_partkey % 5 = 0 THEN 'disputed' ELSE 'observed' END AS trust FROM part UNION ALL SELECT 'plarge', -s_suppkey, 'symbol', 'part ' || (s_suppkey % 30), 'observed' FROM supplier),
asked AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 3 = 0 THEN ['part ' || (s_suppkey % 30)] ELSE ['part', (s_suppkey % 9)::VARCHAR, 'part 1' || (s_suppkey % 9)] END AS terms FROM supplier),
pairs AS (SELECT request_id, terms, n.* FROM asked a, nodes n WHERE kind <> 'project'),
s AS (SELECT *, len(list_filter(terms, lambda x: contains(name, x))) AS held, list_contains(terms, name)::INT AS exact, CASE trust WHEN 'verified' THEN 0 WHEN 'observed' THEN 1 ELSE 2 END AS o FROM pairs),
k AS (SELECT *, held + 2 * exact AS score FROM s WHERE (exact = 1 OR held >= CASE WHEN len(terms) >= 3 THEN 2 ELSE 1 END) AND node_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY held + 2 * exact DESC, o, kind, name, node_id) <= 20)
SELECT request_id, node_id, score::BIGINT AS score, exact::INT AS exact, row_number() OVER (PARTITION BY request_id ORDER BY o, score DESC, kind, name, node_id)::INT AS position FROM k""")
def graph_match(spark, d):
    """Parts as nodes, a quarter of them in small projects; every seventh has no live edge."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    parts = tb.table(spark, d, "part").select(
        F.concat(F.lit("p"), F.when(k % 4 == 0, F.concat(F.lit("small"), text(F.floor(k / 400)))).otherwise("large")).alias("project_id"), k.alias("node_id"), F.when(k % 11 == 0, "project").otherwise("topic").alias("kind"),
        F.concat(F.lower("p_name"), F.lit(" "), text(k)).alias("name"), F.when(k % 6 == 0, "verified").when(k % 5 == 0, "disputed").otherwise("observed").alias("trust"),
    )
    s = F.col("s_suppkey")
    suppliers = tb.table(spark, d, "supplier")
    symbols = suppliers.select(F.lit("plarge").alias("project_id"), (-s).alias("node_id"), F.lit("symbol").alias("kind"), F.concat(F.lit("part "), text(s % 30)).alias("name"), F.lit("observed").alias("trust"))
    nodes = parts.unionByName(symbols)
    terms = F.when(s % 3 == 0, F.array(F.concat(F.lit("part "), text(s % 30)))).otherwise(F.array(F.lit("part"), text(s % 9), F.concat(F.lit("part 1"), text(s % 9))))
    asked = suppliers.select(s.alias("request_id"), terms.alias("terms"), F.lit(1).alias("scope_id"))  # all see all projects
    scope = nodes.select(F.lit(1).alias("scope_id"), "project_id").distinct()
    return graph.matches(asked, nodes, scope, nodes.filter("node_id % 7 <> 0"))


@query("g11_select_claims", f"""WITH {tb.CLAIMS}, q AS (SELECT 'p' || x AS request_id, ['pay', 'building', 'machinery'] AS terms FROM range(5) AS r(x)),
m AS (SELECT q.request_id, claim_id, normalized_text AS display_text, CASE trust_state WHEN 'disputed' THEN 1 WHEN 'observed' THEN 2 ELSE 3 END AS o, len(list_filter(terms, lambda x: contains(normalized_text, x))) AS overlap FROM claims JOIN q ON project_id = request_id
  WHERE len(regexp_extract_all(normalized_text, '[A-Za-z]{{2,}}')) >= 4 AND length(array_to_string(regexp_extract_all(normalized_text, '[A-Za-z]{{2,}}'), '')) >= 0.55 * length(replace(normalized_text, ' ', '')))
SELECT request_id, claim_id, row_number() OVER (PARTITION BY request_id ORDER BY o, overlap DESC, length(display_text), display_text, claim_id)::INT AS position, overlap::INT AS overlap, display_text FROM m QUALIFY position <= 4""")
def selected_claims(spark, d):
    c = tb.claims(spark, d).select(F.col("project_id").alias("request_id"), "claim_id", F.col("normalized_text").alias("display_text"), "trust_state", t.words_in(["pay", "building", "machinery"]).alias("terms"))
    return evidence.select_claims(c)
