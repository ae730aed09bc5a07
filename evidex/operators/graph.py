"""The property graph of a corpus: nodes, edges and lexical matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.store import kept

# What declares a symbol.
SYMBOLS = (
    r"(?m)^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type)\s+([A-Za-z_$][A-Za-z0-9_$]*)",
    r"(?m)^\s*(?:public\s+|private\s+|internal\s+)?(?:class|interface|struct)\s+([A-Za-z_][A-Za-z0-9_]*)",
)


def node_id(project, kind, name):
    return t.uuid5(t.NODE_NAMESPACE, F.concat_ws(":", project, kind, name))


def symbols(chunks: DataFrame) -> DataFrame:
    """project_id, chunk_id, name of every declared symbol."""
    found = F.array_union(F.array_union(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in SYMBOLS[:2]]), F.regexp_extract_all("text", F.lit(SYMBOLS[2]), F.lit(1)))
    return chunks.select("project_id", "chunk_id", F.explode(found).alias("name"))


def edges(chunks: DataFrame, claims_of: DataFrame) -> DataFrame:
    """subject, predicate, object, chunk_id: contains, has_topic, declares and states, each once.

    chunks: project_id, path, chunk_id, heading, text; claims_of: project_id, chunk_id, normalized_text."""
    source = lambda: node_id(F.col("project_id"), F.lit("source"), t.fold(F.col("path")))
    project = node_id(F.col("project_id"), F.lit("project"), F.col("project_id"))
    contains = chunks.select(project.alias("subject"), F.lit("contains").alias("predicate"), source().alias("object"), "chunk_id")
    topics = chunks.filter(F.col("heading").isNotNull()).select(source().alias("subject"), F.lit("has_topic").alias("predicate"), node_id(F.col("project_id"), F.lit("topic"), t.fold(t.collapse(F.col("heading")))).alias("object"), "chunk_id")
    declared = symbols(chunks).join(chunks.select("chunk_id", "path"), "chunk_id").select(source().alias("subject"), F.lit("declares").alias("predicate"), node_id(F.col("project_id"), F.lit("symbol"), t.fold(F.col("name"))).alias("object"), "chunk_id")
    states = claims_of.join(chunks.select("chunk_id", "path"), "chunk_id").select(source().alias("subject"), F.lit("states").alias("predicate"), node_id(F.col("project_id"), F.lit("claim"), F.col("normalized_text")).alias("object"), "chunk_id")
    return contains.unionByName(topics).unionByName(declared).unionByName(states).distinct()


def nodes(chunks: DataFrame, claims_of: DataFrame) -> DataFrame:
    """node_id, project_id, kind, name, trust of everything that ``edges`` of the same rows joins, each once."""
    named = lambda df, kind, name, key: df.select(node_id(F.col("project_id"), F.lit(kind), key).alias("node_id"), "project_id", F.lit(kind).alias("kind"), name.alias("name"))
    titled = chunks.filter(F.col("heading").isNotNull()).withColumn("heading", t.collapse(F.col("heading")))
    every = (
        named(chunks, "project", F.col("project_id"), F.col("project_id")),
        named(chunks, "source", F.col("path"), t.fold(F.col("path"))),
        named(titled, "topic", F.col("heading"), t.fold(F.col("heading"))),
        named(symbols(chunks), "symbol", F.col("name"), t.fold(F.col("name"))),
        named(claims_of, "claim", F.col("normalized_text"), F.col("normalized_text")),
    )
    one = reduce(DataFrame.unionByName, every).groupBy("node_id", "project_id", "kind").agg(F.min("name").alias("name"))
    return one.select("node_id", "project_id", "kind", "name", F.lit("observed").alias("trust"))


# Terms, results; characters of the stretch by which a term finds the names that hold it.
TERMS, RESULTS, GRAM = 8, 20, 3


def trust_order(trust):
    return F.when(trust == "verified", 0).when(trust == "observed", 1).otherwise(2)


def grouped(requests: DataFrame, scope: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests of equal terms and scope are one: (request_id, terms, scope_id of the first; scope_id, project_id; first and request_id of every request).

    requests: request_id, terms and perhaps scope_id; scope: project_id and scope_id, where requests have one,
    else request_id.  The least request of those that are alike stands for all.  Only the first ``most`` terms count."""
    asked = requests.withColumn("terms", F.slice("terms", 1, most)).filter(F.size("terms") > 0)
    if "scope_id" in requests.columns:
        asked = asked.select("request_id", "terms", "scope_id")
        own = scope.select("scope_id", "project_id").distinct()
    else:
        sets = scope.groupBy("request_id").agg(F.sort_array(F.collect_set("project_id")).alias("scope_id"))
        asked = asked.select("request_id", "terms").join(sets, "request_id")
        own = asked.select("scope_id").distinct().select("scope_id", F.explode("scope_id").alias("project_id"))
    first = asked.groupBy("terms", "scope_id").agg(F.min("request_id").alias("first"))
    whose = asked.join(first, ["terms", "scope_id"]).select("first", "request_id").distinct()
    return first.select(F.col("first").alias("request_id"), "terms", "scope_id"), own, whose


def alike(requests: DataFrame, scope: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests of equal terms and scope are looked up once (see ``grouped``): (first requests, their scope, first and request_id of every request)."""
    first, own, whose = grouped(requests, scope, most)
    return first.select("request_id", "terms"), first.join(own, "scope_id").select("request_id", "project_id"), whose


def naming(first: DataFrame, own: DataFrame, nodes: DataFrame, live: DataFrame) -> DataFrame:
    """request_id, terms, node_id, kind, name, trust: every live node of a request's projects whose name holds one of its terms, each once.

    first, own: see ``grouped``.  A term may stand anywhere in a name, in a project of any size.  Names meet a
    term on the one of its stretches of ``GRAM`` characters that fewest names hold, a shorter term on all it
    is, and are then asked for the whole term; so no request meets all nodes of a project.  A request meets
    a name at the first of its terms that the name holds, so that nothing is made distinct.  Requests, scopes and terms are written, so
    that they are broadcast where their size allows, and names stay where they are."""
    named = nodes.filter("kind <> 'project'").select("project_id", "node_id", "kind", "name", "trust")
    asked = kept(first, "naming-asked")
    each = kept(asked.select(F.explode("terms").alias("term")).filter("term is not null").distinct().withColumn("n", F.least(F.length("term"), F.lit(GRAM))), "naming-terms")
    sizes = [r[0] for r in each.select("n").distinct().collect()]  # GRAM + 1 numbers at most

    def stretches(df: DataFrame, c: str) -> DataFrame:
        """A row for each stretch (gram) of n characters of a text, each at its first place."""
        placed = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))))).filter(F.col("i") + F.col("n") <= F.length(c) + 1)
        return placed.withColumn("gram", F.substring(F.col(c), F.col("i"), F.col("n"))).filter(F.instr(F.col(c), F.col("gram")) == F.col("i")).drop("i", "n")

    all_of = lambda df: stretches(df.filter("name is not null").withColumn("n", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))), "name")
    counts = all_of(named.select("name")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_held"))
    rarest = stretches(each, "term").join(counts, "gram", "left")
    # a term with a stretch that no name has is held by none
    told = rarest.groupBy("term").agg(F.min_by("gram", F.struct("n_held", "gram")).alias("gram"), F.bool_and(F.col("n_held").isNotNull()).alias("whole")).filter("whole")
    told = kept(told.select("term", "gram"), "naming-grams")
    there = all_of(named.join(live.select("node_id"), "node_id", "left_semi"))
    met = there.join(told, "gram").filter(F.contains("name", F.col("term"))).drop("gram")
    seen = met.join(kept(own, "naming-scopes"), "project_id")
    whose = asked.select("request_id", "terms", "scope_id", F.explode(F.array_distinct("terms")).alias("term"))
    at_first = F.get(F.filter("terms", lambda x: F.contains(F.col("name"), x)), F.lit(0)) == F.col("term")
    return seen.join(whose, ["scope_id", "term"]).filter(at_first).select("request_id", "terms", "node_id", "kind", "name", "trust")


def matches(requests: DataFrame, nodes: DataFrame, scope: DataFrame, live: DataFrame, cap: int = RESULTS) -> DataFrame:
    """request_id, node_id, score, exact, position: live nodes whose names hold a request's terms.

    requests: request_id, terms; nodes: project_id, node_id, kind, name, trust; scope: request_id,
    project_id; live: node_id of nodes with an edge from a current chunk.  A name holds a term anywhere;
    with three terms or more it must hold two, or be one.  The best by score are kept, and shown by trust.
    Requests without terms and null names match nothing.  Many requests that see the same projects may
    share a ``scope_id`` (see ``alike``); requests that are alike cost one look-up."""
    first, own, whose = grouped(requests, scope, TERMS)
    each = naming(first, own, nodes, live)
    score = F.aggregate("terms", F.lit(0), lambda n, x: n + F.contains("name", x).cast("int"))
    exact = F.array_contains("terms", F.col("name")).cast("int")
    told = each.withColumn("exact", exact).withColumn("held", score).filter((F.col("exact") == 1) | (F.col("held") >= F.when(F.size("terms") >= 3, 2).otherwise(1)))
    ranked = told.withColumn("score", F.col("held") + 2 * F.col("exact")).withColumn("trust_order", trust_order(F.col("trust")))
    by = W.partitionBy("request_id")
    best = F.row_number().over(by.orderBy(F.col("score").desc(), "trust_order", "kind", "name", "node_id"))
    shown = F.row_number().over(by.orderBy("trust_order", F.col("score").desc(), "kind", "name", "node_id"))
    top = ranked.withColumn("r", best).filter(F.col("r") <= cap)
    return top.withColumn("position", shown).withColumnRenamed("request_id", "first").join(whose, "first").select("request_id", "node_id", "score", "exact", "position")


# Terms that a claim of the ledger is looked up by, the newest taken, terms it must hold, claims added.
CLAIM_TERMS, NEWEST, HELD, EXTRA = 6, 200, 2, 4


def ledger_claims(requests: DataFrame, claims: DataFrame, scope: DataFrame) -> DataFrame:
    """request_id, claim_id, held, position: verified and proposed claims that hold a request's terms, beside those of its chunks.

    requests: request_id, terms; claims: project_id, claim_id, normalized_text, trust_state, created_at;
    scope: request_id, project_id.  Of the claims that hold one of the first six terms the newest 200 are
    looked at; two terms are needed, one where the request has no more.  They meet requests on the project, and
    requests that are alike (see there) meet them once."""
    asked, seen, whose = alike(requests, scope, CLAIM_TERMS)
    met = asked.join(seen, "request_id").join(claims.filter("trust_state in ('verified', 'proposed')"), "project_id")
    held = F.aggregate("terms", F.lit(0), lambda n, x: n + F.contains("normalized_text", x).cast("int"))
    any_term = met.withColumn("held", held).filter("held > 0")
    new = any_term.withColumn("r", F.row_number().over(W.partitionBy("request_id").orderBy(F.col("created_at").desc(), "claim_id"))).filter(F.col("r") <= NEWEST)
    kept = new.filter(F.col("held") >= F.least(F.lit(HELD), F.size("terms")))
    place = F.row_number().over(W.partitionBy("request_id").orderBy("r"))
    few = kept.withColumn("position", place).filter(F.col("position") <= EXTRA).withColumnRenamed("request_id", "first")
    return few.join(whose, "first").select("request_id", "claim_id", "held", "position")
