"""A batch of requests to packets, end to end, and what is recorded about them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..sources.store import kept
from . import evidence, graph, packet, search
from . import live as live_text


@F.pandas_udf(T.StringType())
def canonical_hash(bodies: pd.Series) -> pd.Series:
    """SHA-256 of canonical JSON: sorted keys, no spaces, no escapes for letters."""
    import hashlib
    import json

    return bodies.map(lambda b: hashlib.sha256(packet.canonical_json(json.loads(b)).encode()).hexdigest())


def packets(requests: DataFrame, chunks: DataFrame, scope: DataFrame, limit: int = 4, budget: int = 16_000, max_per_file: int = 2, index: search.Index | None = None, claims: DataFrame | None = None, nodes: DataFrame | None = None, files: tuple | None = None) -> DataFrame:
    """request_id, status, requirements, evidence, claims, graph_nodes, empty_result, packet_hash for every request.

    Each requirement says its status, why its search stopped, and how many shown spans that still hold.
    claims: project_id, claim_id, chunk_id (a row a chunk that states it, null for proposals), display_text,
    normalized_text, trust_state, created_at; nodes: project_id, node_id, kind, name, trust, chunk_id.
    All share one budget of characters (``packet.whole_budget``).
    files: (root, lines[, moved]) of ``live.hydrate``; the found spans, and only they, are then read from their
    files, and one is stale whose file is not what it was (chunks then have content_hash).

    requests: request_id, text; chunks: chunk_id, project_id, path, line_start, line_end, heading,
    text, chunk_hash, current, stale; scope: request_id, project_id, priority."""
    # each leaf of a request is searched like a request of its own
    index = index or search.build(chunks)
    head = chunks.select("chunk_id", "path", "line_start", "current", "heading")

    def found_by(leaf: DataFrame) -> DataFrame:
        asked = leaf.select(F.col("leaf_id").alias("request_id"), t.request_tokens(F.col("leaf")).alias("terms"))
        leaf_scope = leaf.select("leaf_id", "request_id").join(scope, "request_id").select(F.col("leaf_id").alias("request_id"), "project_id", "priority")
        return search.retrieve(asked, index, head, leaf_scope, limit)

    first = kept(packet.leaves(requests).withColumn("leaf_id", F.concat_ws("/", F.col("request_id").cast("string"), F.col("leaf_no").cast("string"))), "leaves")
    hits = found_by(first)
    # a leaf without rows is divided once more; its parts take its place
    rows = hits.select(F.col("request_id").alias("leaf_id")).distinct().withColumn("held", F.lit(True))
    each = first.join(rows, "leaf_id", "left").select("request_id", "leaf_no", "leaf", F.col("held").isNull().alias("empty"))
    splits = F.when(F.col("empty") & packet.compound(F.col("leaf")), packet.second_split_udf("leaf")).otherwise(F.array().cast("array<string>"))
    order = W.partitionBy("request_id").orderBy("old_no", "part")
    leaf = packet.divided_again(each.withColumn("parts", splits)).withColumnRenamed("leaf_no", "old_no")
    leaf_id = F.concat_ws("/", F.col("request_id").cast("string"), F.col("old_no").cast("string"), F.when(F.col("part") >= 0, F.col("part").cast("string")))
    leaf = kept(leaf.withColumn("leaf_id", leaf_id).withColumn("leaf_no", F.row_number().over(order) - 1), "divided")
    again = leaf.filter("part >= 0")
    if not again.isEmpty():
        hits = hits.unionByName(found_by(again))
    found = hits.select(F.col("request_id").alias("leaf_id"), "chunk_id", "priority", "match_pass", "rank").join(leaf.select("leaf_id", "request_id", "leaf_no"), "leaf_id")
    spans = chunks.select("chunk_id", "project_id", "path", "line_start", "line_end", "text", "chunk_hash", "stale", *["content_hash"] * bool(files))
    if files:
        spans = live_text.hydrate(spans.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumnRenamed("stale", "old"), *files)
        spans = kept(spans.withColumn("stale", F.col("stale") | F.col("old")).drop("old", "live_state", "content_hash"), "spans")
    full = found.join(spans, "chunk_id")
    # conflicts are judged within a leaf, and mark all its spans that still hold
    pairs = evidence.disagreements(full.filter(~F.col("stale")).select(F.col("leaf_id").alias("request_id"), "chunk_id", "path", "text"))
    torn = pairs.select(F.col("request_id").alias("leaf_id")).distinct().withColumn("torn", F.lit(True))
    marked = kept(full.join(torn, "leaf_id", "left").withColumn("disagreeing", F.col("torn").isNotNull() & ~F.col("stale")).drop("torn"), "marked")
    one = packet.select_across_leaves(marked.drop("leaf_id"))
    merged = kept(packet.merge(packet.prioritize(one), max_per_file), "merged")
    terms = requests.select("request_id", t.request_tokens(F.col("text")).alias("terms"))
    shown = merged.join(terms, "request_id").withColumn("text", packet.clip(F.col("text"), F.col("terms"))).withColumn("size", F.length("text"))
    asked_scope = scope.select("request_id", "project_id").distinct()
    live = chunks.filter(F.col("current") & ~F.col("stale")).select("chunk_id")
    told = _claims_of(terms, merged.filter(~F.col("stale")), claims, asked_scope) if claims is not None else _none(terms, "claim_id string, position int, display_text string, trust_state string, size int")
    named_nodes = _nodes_of(terms, nodes, asked_scope, live) if nodes is not None else _none(terms, "node_id string, position int, name string, trust string, size int")
    within, told, named_nodes = packet.whole_budget(shown, told, named_nodes, budget)
    within = within.withColumn("text", F.substring("text", F.lit(1), F.col("kept_size")))
    # spans that no longer hold count neither as found nor as shown
    by_leaf = marked.filter(~F.col("stale")).groupBy("request_id", "leaf_no").agg(F.count(F.lit(1)).alias("found"), F.count_if("disagreeing").alias("conflicts"))
    included = within.filter(~F.col("stale")).select("request_id", F.explode("requirements").alias("leaf_no")).groupBy("request_id", "leaf_no").agg(F.count(F.lit(1)).alias("included"))
    status = packet.statuses(leaf.select("request_id", "leaf_no").join(by_leaf, ["request_id", "leaf_no"], "left").join(included, ["request_id", "leaf_no"], "left").na.fill(0, ["found", "conflicts", "included"]))
    stop = F.when(F.col("status").isin("evidence_found", "budget_exhausted"), "evidence_found").when(F.col("status") == "disagreement", "disagreement").when(F.col("blocked"), "max_leaves").otherwise("unknown")
    said = leaf.join(status, ["request_id", "leaf_no"]).join(included.withColumnRenamed("included", "evidence_count"), ["request_id", "leaf_no"], "left").na.fill(0, ["evidence_count"]).withColumn("stop_reason", stop)
    each = F.struct("leaf_no", F.col("leaf").alias("text"), "status", "stop_reason", (F.col("status") != "").alias("checkable"), "evidence_count")
    tree = said.groupBy("request_id").agg(F.sort_array(F.collect_list(each)).alias("requirements"))
    listed = lambda df, name, *fields: df.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("position", *fields))).alias(name))
    parts = (
        listed(within, "evidence", "project_id", "path", "line_start", "line_end", "text", "chunk_hash", "stale", "disagreeing", "match_pass", "requirements"),
        listed(told, "claims", "claim_id", "display_text", "trust_state"),
        listed(named_nodes, "graph_nodes", "node_id", "name", "trust"),
    )
    whole = requests.select("request_id", "text").join(tree, "request_id", "left")
    for part, name in zip(parts, ("evidence", "claims", "graph_nodes")):
        whole = whole.join(part, "request_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    body = F.to_json(F.struct(F.col("text").alias("query"), "requirements", "evidence", "claims", "graph_nodes"))
    return whole.select("request_id", overall(F.col("requirements.status")).alias("status"), "requirements", "evidence", "claims", "graph_nodes", empty_result(F.col("evidence.stale")).alias("empty_result"), canonical_hash(body).alias("packet_hash"))


def _none(like: DataFrame, fields: str) -> DataFrame:
    kind = like.schema["request_id"].dataType.simpleString()
    return like.sparkSession.createDataFrame([], f"request_id {kind}, {fields}")


def _claims_of(terms: DataFrame, found: DataFrame, claims: DataFrame, scope: DataFrame) -> DataFrame:
    """The claims that found spans state, and those of the ledger that hold a request's terms, selected and in order."""
    each = claims.dropDuplicates(["claim_id"]).drop("chunk_id")
    stated = found.select("request_id", "chunk_id").distinct().join(claims.select("chunk_id", "claim_id"), "chunk_id").select("request_id", "claim_id")
    looked = graph.ledger_claims(terms, each, scope).select("request_id", "claim_id")
    matched = stated.union(looked).distinct().join(terms, "request_id").join(each.select("claim_id", F.col("display_text").alias("full"), "trust_state"), "claim_id")
    kept_ = evidence.select_claims(matched.withColumnRenamed("full", "display_text"))
    return kept_.join(each.select("claim_id", "trust_state"), "claim_id").select("request_id", "claim_id", "position", "display_text", "trust_state", F.length("display_text").alias("size"))


def _nodes_of(terms: DataFrame, nodes: DataFrame, scope: DataFrame, live: DataFrame) -> DataFrame:
    alive = nodes.join(live, "chunk_id", "left_semi").select("node_id")
    each = nodes.drop("chunk_id").dropDuplicates(["node_id"])
    hit = graph.matches(terms, each, scope, alive)
    return hit.join(each.select("node_id", "name", "trust"), "node_id").select("request_id", "node_id", "position", "name", "trust", F.length("name").alias("size"))


def overall(statuses: Column) -> Column:
    """A request's status from its leaves': a conflict shows, then a gap, then the budget."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(has("disagreement"), "disagreement").when(has("unknown") | statuses.isNull(), "unknown").when(has("budget_exhausted"), "budget_exhausted").otherwise("evidence_found")


def empty_result(stale: Column) -> Column:
    """Why a packet shows nothing usable: no_matching_spans or only_stale_spans."""
    return F.when(F.size(stale) == 0, "no_matching_spans").when(F.forall(stale, lambda s: s), "only_stale_spans")


def solver_checks(packets_: DataFrame) -> DataFrame:
    """request_id, schema_holds, span_exists: what can be said of a packet without reading anything else.

    Where a packet disagrees or its schema does not hold, hash_matches says whether its hash is that of its
    parts (column ``body``, if there); elsewhere it is null."""
    ok = F.forall("evidence", lambda e: e["path"].isNotNull() & (e["line_start"] >= 1) & (e["line_end"] >= e["line_start"]))
    schema = F.col("requirements").isNotNull() & F.forall("requirements", lambda r: r["status"].isin("evidence_found", "unknown", "disagreement", "budget_exhausted"))
    odd = ~schema | F.exists("requirements", lambda r: r["status"] == "disagreement")
    same = F.when(odd, canonical_hash("body") == F.col("packet_hash")) if "body" in packets_.columns else F.lit(None).cast("boolean")
    return packets_.select("request_id", schema.alias("schema_holds"), ok.alias("span_exists"), same.alias("hash_matches"))


def stale_text(hits: DataFrame, indexed: DataFrame) -> DataFrame:
    """Stale hits without text get the indexed copy, labelled as such; hits: chunk_id, stale, text; indexed: chunk_id, text."""
    met = hits.join(indexed.select("chunk_id", F.col("text").alias("copy")), "chunk_id", "left")
    fills = F.col("stale") & (F.coalesce("text", F.lit("")) == "") & F.col("copy").isNotNull()
    rest = [c for c in hits.columns if c != "text"]
    return met.select(*rest, F.when(fills, F.col("copy")).otherwise(F.col("text")).alias("text"), F.when(fills, "indexed_copy").alias("stale_text"))


def cache_valid(entries: DataFrame, dependencies: DataFrame, now: DataFrame) -> DataFrame:
    """cache_key, valid: an entry holds while every file it used is in the state it was in.

    dependencies: cache_key, path, content_hash, matched; now: path, content_hash."""
    current = now.select("path", F.col("content_hash").alias("now_hash"))
    moved = dependencies.join(current, "path", "left").filter((F.col("now_hash").eqNullSafe(F.col("content_hash"))) != F.col("matched")).select("cache_key").distinct()
    bad = moved.withColumn("bad", F.lit(True))
    return entries.join(bad, "cache_key", "left").select("cache_key", F.col("bad").isNull().alias("valid"))


GRAM = 8  # characters by which one text finds those that hold it


def holding(inner: DataFrame, outer: DataFrame, by: str) -> DataFrame:
    """inner, outer: pairs of texts with an equal ``by`` of which the second holds the first.

    inner: by, inner; outer: by, outer.  A text that another holds gives it all its stretches of
    ``GRAM`` characters, so pairs meet on one of them, the one that fewest texts hold; shorter texts meet
    on all they are.  So this is an equi-join, a common stretch costs no more than the rarest beside it, and
    a text with a stretch that no other has is never compared.  Stretches are joined by their hashes
    and carry no text; what they name is compared itself."""
    small = inner.select(by, "inner").distinct().filter("inner <> ''").withColumn("n", F.least(F.length("inner"), F.lit(GRAM)))
    sizes = [r[0] for r in small.select("n").distinct().collect()] or [GRAM]  # GRAM numbers at most
    large = outer.select(by, "outer").distinct().withColumn("place", F.xxhash64(by, "outer"))
    # By number, since the texts are few bytes beside the work on their stretches.
    tasks = int(inner.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = lambda df, c: df.withColumn("i", F.explode(F.sequence(F.lit(1), F.length(c) - F.col("n") + 1))).withColumn("key", F.xxhash64(by, F.substring(F.col(c), F.col("i"), F.col("n"))))
    every = large.repartition(tasks, "place").withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).filter(F.length("outer") >= F.col("n"))
    # Merge joins by hint: the planner takes the stretches for no larger than the texts they are exploded from.
    there = stretch(every, "outer").select("place", "key").hint("merge")
    held = there.groupBy("key").agg(F.count(F.lit(1)).alias("n_held")).hint("merge")
    own = stretch(small.repartition(tasks, "inner"), "inner").select(by, "inner", "key").join(held, "key", "left")
    told = own.groupBy(by, "inner").agg(F.min_by("key", F.struct("n_held", "key")).alias("key"), F.bool_and(F.col("n_held").isNotNull()).alias("whole")).filter("whole")
    met = told.select(by, "inner", "key").join(there, "key").select(by, "inner", "place").distinct()
    return met.join(large, [by, "place"]).filter(F.contains("outer", F.col("inner"))).select(by, "inner", "outer")


def attach_validations(answers: DataFrame, validated: DataFrame) -> DataFrame:
    """request_id, basis: an answer rests on a validation if a validated claim holds its sentence or the sentence holds the claim; the answer stays.

    answers: request_id, project_id, sentence; validated: project_id, normalized_text."""
    said = answers.select("request_id", "project_id", t.fold(t.collapse(F.col("sentence"))).alias("said"))
    claims = validated.select("project_id", t.fold(t.collapse(F.col("normalized_text"))).alias("claim")).filter("claim <> ''")
    sentence, claim = said.select("project_id", F.col("said").alias("x")), claims.select("project_id", F.col("claim").alias("x"))
    name = lambda df, n: df.withColumnRenamed("x", n)
    in_sentence = holding(name(claim, "inner"), name(sentence, "outer"), "project_id").select("project_id", F.col("outer").alias("said"))
    in_claim = holding(name(sentence, "inner"), name(claim, "outer"), "project_id").select("project_id", F.col("inner").alias("said"))
    rests = said.join(in_sentence.union(in_claim).distinct(), ["project_id", "said"], "left_semi").select("request_id").distinct().withColumn("hit", F.lit(True))
    return answers.select("request_id").distinct().join(rests, "request_id", "left").select("request_id", F.when(F.col("hit"), "validated").otherwise("lexical").alias("basis"))


def sweep(runs: DataFrame, limits: list[int], budgets: list[int]) -> DataFrame:
    """limit, budget, mean_coverage over recorded runs: each run's (found, size) against a grid of settings; the grid is a parameter."""
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), F.lit(y).alias("budget")) for x in limits for y in budgets]))
    kept = F.least("found", F.col("g.limit"), F.floor(F.col("g.budget") / F.col("size")))
    each = runs.withColumn("g", grid).select("g.limit", "g.budget", (kept / F.col("found")).alias("coverage"))
    return each.groupBy("limit", "budget").agg(F.round(F.avg("coverage"), 6).alias("mean_coverage"))
