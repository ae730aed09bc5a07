"""Versioned sources, claims' states, run logs and maintenance plans, as relations.

Head tables are the latest rows of append-only logs (``latest``); changes are plans (DataFrames of
what to add, touch or drop) that a writer appends or swaps in, because plain tables have no merge."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.store import kept


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The head of a log: the row of the greatest ``order`` for each key, without a window over the log."""
    rest = [c for c in log.columns if c not in keys]
    head = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("head"))
    return head.select(*keys, *[F.col(f"head.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: a changed key's row replaces the old one."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows whose keys the table lacks, once each."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def move_rows(rows: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of merged projects under their survivor; where both have a key, the survivor's row stays.

    mapping: project_id, survivor_id."""
    to = rows.join(mapping, "project_id", "left").withColumn("own", F.col("survivor_id").isNull()).withColumn("project_id", F.coalesce("survivor_id", "project_id")).drop("survivor_id")
    first = F.row_number().over(W.partitionBy("project_id", *keys).orderBy(F.col("own").desc()))
    return to.withColumn("r", first).filter("r = 1").drop("r", "own")


def merge_mapping(claims: DataFrame, loser: str, survivor: str) -> DataFrame:
    """loser, survivor: claims of one project and those of the other that say the same; of equal ones the least id.

    claims: claim_id, project_id, normalized_text."""
    side = lambda p, name: claims.filter(F.col("project_id") == p).groupBy("normalized_text", *(["claim_id"] if name == "loser" else [])).agg(F.min("claim_id").alias(name)).select("normalized_text", name)
    return side(loser, "loser").join(side(survivor, "survivor"), "normalized_text").select("loser", "survivor")


def current_chunks(chunks: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of the version that an active source is at."""
    live = sources.filter("active").select("source_id", F.col("current_hash").alias("content_hash"))
    return chunks.join(versions.join(live, ["source_id", "content_hash"], "left_semi").select("version_id"), "version_id", "left_semi")


def changes(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """path, state: unchanged, changed, new or missing, by size and modification time."""
    old = sources.filter("active").select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    new = listing.select("path", "size", "mtime", F.lit(True).alias("listed"))
    state = F.when(F.col("listed").isNull(), "missing").when(F.col("known").isNull(), "new").when((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")), "unchanged").otherwise("changed")
    return new.join(old, "path", "full_outer").select("path", state.alias("state"))


def use_decision(states: DataFrame, known: bool, max_refresh: int = 25) -> str:
    """What a workspace needs: initial_ingest, fresh, targeted_refresh or stale."""
    if not known:
        return "initial_ingest"
    n = {r["state"]: r["n"] for r in states.filter("state <> 'unchanged'").groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return "fresh"
    return "targeted_refresh" if "missing" not in n and sum(n.values()) <= max_refresh else "stale"


def renames(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """path, old_path: new paths whose hash belongs to exactly one known source that is not in this listing.

    Counts are combined before the join, so a hash that very many files share is never paired out.  Merge joins
    by hint: paths and hashes are far larger in memory than the file that the planner judges them by."""
    fresh = listing.join(sources.select("path").hint("merge"), "path", "left_anti").select("path", "content_hash")
    gone = sources.join(listing.select("path").hint("merge"), "path", "left_anti").select(F.col("path").alias("old_path"), F.col("current_hash").alias("content_hash"))
    only = gone.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("old_path").alias("old_path")).filter("n = 1").drop("n")
    first = fresh.groupBy("content_hash").agg(F.min("path").alias("path"))
    return first.join(only.hint("merge"), "content_hash").select("path", "old_path")


def version_actions(listing: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """path, action of every listed file: touch, rename, revert, update or insert.  Merge joins as in ``renames``."""
    known = sources.select("path", "source_id", "current_hash")
    # dealt out first: a file's few tasks would each hold all their versions
    had = versions.select("source_id", "content_hash").repartition("source_id", "content_hash").distinct().withColumn("had", F.lit(True))
    met = listing.select("path", "content_hash").join(known.hint("merge"), "path", "left").join(had.hint("merge"), ["source_id", "content_hash"], "left").join(renames(listing, sources).withColumn("moved", F.lit(True)).select("path", "moved").hint("merge"), "path", "left")
    action = F.when(F.col("source_id").isNull(), F.when(F.col("moved"), "rename").otherwise("insert")).when(F.col("current_hash") == F.col("content_hash"), "touch").when(F.col("had"), "revert").otherwise("update")
    return met.select("path", action.alias("action"))


def deactivate(listing: DataFrame, sources: DataFrame, root: str) -> DataFrame:
    """Active sources below a root that a full listing did not show."""
    below = (F.col("path") == root) | F.startswith("path", F.lit(root.rstrip("/") + "/"))
    return sources.filter(F.col("active") & below).join(listing.select("path"), "path", "left_anti").select("source_id", "path")


def copy_free(chunks: DataFrame) -> DataFrame:
    """Chunks of a version without later copies of the same text."""
    first = F.row_number().over(W.partitionBy("version_id", "chunk_hash").orderBy("ordinal"))
    return chunks.withColumn("r", first).filter("r = 1").drop("r")


def validated(claims: DataFrame, validations: DataFrame) -> DataFrame:
    """Claims with the state that their last validation names; nothing else changes a state."""
    last = validations.groupBy("claim_id").agg(F.max_by("result", "validation_id").alias("result"))
    return claims.join(last, "claim_id", "left").withColumn("trust_state", F.coalesce("result", "trust_state")).drop("result")


def pending(claims: DataFrame, validations: DataFrame) -> DataFrame:
    """Proposed claims that nobody has validated."""
    return claims.filter("trust_state = 'proposed'").join(validations.select("claim_id"), "claim_id", "left_anti")


def live_claims(claims: DataFrame, evidence: DataFrame, live: DataFrame) -> DataFrame:
    """Claims with at least one current chunk; proposals need none."""
    backed = evidence.join(live.select("chunk_id"), "chunk_id", "left_semi").select("claim_id")
    return claims.filter("trust_state <> 'proposed'").join(backed, "claim_id", "left_semi").unionByName(claims.filter("trust_state = 'proposed'"))


def integrity(checks: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """check, violations: rows of a table whose reference has no counterpart, for each named (table, other, key, other key)."""
    out = None
    for name, (table, other, key, other_key) in checks.items():
        lost = table.filter(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = lost if out is None else out.unionByName(lost)
    return out


def usage(runs: DataFrame) -> DataFrame:
    """agent, project_id, runs, avg_ms, last_run; unnamed agents under one name."""
    return runs.groupBy(F.coalesce("agent", F.lit("(unrecorded)")).alias("agent"), "project_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("elapsed_ms"), 2).alias("avg_ms"), F.max("created_at").alias("last_run"))


def budgets(runs: DataFrame, initial: int) -> DataFrame:
    """run_id, remaining: each (project, agent) has so many units; a run takes one and never goes below none."""
    spent = F.row_number().over(W.partitionBy("project_id", "agent").orderBy("created_at", "run_id"))
    return runs.select("run_id", F.greatest(F.lit(0), initial - spent).cast("long").alias("remaining"))


def prunable(chunks: DataFrame, live: DataFrame, evidence: DataFrame, claims: DataFrame, validations: DataFrame) -> DataFrame:
    """Superseded chunks, but for those that back a claim that is validated or not merely observed."""
    kept = claims.filter("trust_state <> 'observed'").select("claim_id").union(validations.select("claim_id")).distinct()
    protected = evidence.join(kept, "claim_id", "left_semi").select("chunk_id")
    return chunks.join(live.select("chunk_id"), "chunk_id", "left_anti").join(protected, "chunk_id", "left_anti")


def ancestors(path: Column) -> Column:
    """The folders above a path and the path itself."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))


def owner_of(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """path, project_id: the project of the longest alias folder that holds the path; an equi-join on its ancestors."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    met = up.join(aliases.select(F.col("path").alias("folder"), "project_id"), "folder")
    return met.groupBy("path").agg(F.max_by("project_id", F.struct(F.length("folder"), "project_id")).alias("project_id"))


def search_scope(projects: DataFrame, aliases: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """request project -> project_id, priority: itself, then domains above it from the nearest, then shared ones.

    projects: project_id, scope; aliases: project_id, path; asked: the project_ids of a batch of requests,
    all projects if there is none.  Every asked project has every shared one in its scope."""
    askers = projects if asked is None else projects.join(asked.select("project_id").distinct(), "project_id", "left_semi")
    own = askers.select(F.col("project_id").alias("for_project"), "project_id", F.lit(0).alias("tier"), F.lit(0).alias("depth"))
    domains = aliases.join(projects.filter("scope = 'domain'").select("project_id"), "project_id", "left_semi").select(F.col("project_id"), F.col("path").alias("folder"))
    above = aliases.join(askers.select("project_id"), "project_id", "left_semi").select(F.col("project_id").alias("for_project"), F.explode(ancestors(F.col("path"))).alias("folder")).join(domains, "folder").filter("for_project <> project_id")
    tier1 = above.groupBy("for_project", "project_id").agg((-F.max(F.length("folder"))).alias("depth")).select("for_project", "project_id", F.lit(1).alias("tier"), "depth")
    shared = projects.filter("scope = 'shared'").select("project_id", "scope")
    tier2 = askers.select(F.col("project_id").alias("for_project"), F.lit("shared").alias("scope")).join(shared, "scope").filter("for_project <> project_id").select("for_project", "project_id", F.lit(2).alias("tier"), F.lit(0).alias("depth"))
    every = own.unionByName(tier1).unionByName(tier2).groupBy("for_project", "project_id").agg(F.min(F.struct("tier", "depth")).alias("s"))
    place = F.row_number().over(W.partitionBy("for_project").orderBy("s.tier", "s.depth", "project_id"))
    return every.select("for_project", "project_id", (place - 1).alias("priority"))


def cache_key(columns: list[Column]) -> Column:
    """SHA-256 of a request's identity: query, project, path, versions, settings."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def replay_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """run_id, cause: match, missing, corpus_moved, sources_changed or algorithmic.

    Both: run_id, packet_hash, corpus_version, sources_hash."""
    b = before.select("run_id", *[F.col(c).alias(f"b_{c}") for c in ("packet_hash", "corpus_version", "sources_hash")])
    met = b.join(after, "run_id", "full_outer")
    cause = (
        F.when(F.col("b_packet_hash").isNull() | F.col("packet_hash").isNull(), "missing")
        .when(F.col("b_packet_hash") == F.col("packet_hash"), "match")
        .when(F.col("b_corpus_version") != F.col("corpus_version"), "corpus_moved")
        .when(F.col("b_sources_hash") != F.col("sources_hash"), "sources_changed")
        .otherwise("algorithmic")
    )
    return met.select("run_id", cause.alias("cause"))


def resolve_claims(references: DataFrame, claims: DataFrame) -> DataFrame:
    """reference, claim_id, matches: by full id, by a prefix of eight characters or more, or by exact wording; one match resolves."""
    ids = claims.select("claim_id", "normalized_text", F.substring("claim_id", 1, 8).alias("head"))
    asked = references.select("reference", F.substring("reference", 1, 8).alias("head"))
    by_id = asked.filter(F.length("reference") >= 8).join(ids, "head").filter(F.startswith("claim_id", F.col("reference"))).select("reference", "claim_id")
    by_text = references.select("reference").join(ids, references["reference"] == ids["normalized_text"]).select("reference", "claim_id")
    found = by_id.union(by_text).distinct().groupBy("reference").agg(F.count(F.lit(1)).alias("matches"), F.min("claim_id").alias("claim_id"))
    full = references.select("reference").distinct().join(found, "reference", "left").na.fill(0, ["matches"])
    return full.select("reference", F.when(F.col("matches") == 1, F.col("claim_id")).alias("claim_id"), "matches")


def group_projects(links: DataFrame) -> DataFrame:
    """node, root: connected projects by links (a, b), each with the least of its group.

    Every round hangs the neighbours of each node on their least one, first the greater ones, then the
    lesser ones, until nothing moves; a chain of n nodes takes about log n rounds.  Each round is written
    to the shared folder, so plans stay short."""
    either = links.filter("a <> b")
    now = kept(either.select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down")).distinct(), "groups")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("up", "down").cast("decimal(38,0)"))).first())
    seen = state(now)
    while True:
        around = now.select(F.col("up").alias("node"), F.col("down").alias("near")).union(now.select("down", "up"))
        least = around.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("top"))
        hung = around.join(least, "node").filter("near > node").select(F.col("near").alias("up"), F.col("top").alias("down")).filter("up <> down").distinct()
        top = hung.groupBy("up").agg(F.min("down").alias("top"))
        moved = hung.join(top, "up").select(F.col("down").alias("up"), F.col("top").alias("down")).union(top.select("up", "top"))
        now = kept(moved.filter("up <> down").distinct(), "groups")
        if (new := state(now)) == seen:
            break
        seen = new
    return now.select(F.col("up").alias("node"), F.col("down").alias("root")).union(now.select("down", "down")).distinct()


STRENGTH = ["validations", "ledger_claims", "corpus_version", "active_sources", "form", "created_at"]


def cleanup_plan(projects: DataFrame, keys: DataFrame, temp_roots: list[str], scratch_name: str = r"^(?:tmp|temp|scratch|test)[-_. ]?\d*$") -> DataFrame:
    """project_id, action, survivor_id, reasons: what a clean-up would do; it changes nothing.

    projects: project_id, canonical_key, kind, display_name, path, path_exists, root_commit, worktree,
    validations, ledger_claims, corpus_version, active_sources, runs, created_at; keys: project_id, key
    (its folder hash and its paths).  Projects that share a key are one; the strongest survives and the
    others merge into it, unless their root commits differ (review).  Of the rest, those with a reason
    go (prune) unless claims or validations protect them (review)."""
    lead = keys.groupBy("key").agg(F.min("project_id").alias("lead"))
    links = keys.join(lead, "key").filter("project_id <> lead").select(F.col("project_id").alias("a"), F.col("lead").alias("b")).distinct()
    grouped = projects.join(group_projects(links).withColumnRenamed("node", "project_id"), "project_id", "left")
    form = F.when(F.startswith("canonical_key", F.lit("git:")), 3).when(F.startswith("canonical_key", F.lit("git-common:")), 2).when(F.col("kind") == "git", 1).otherwise(0)
    strong = grouped.withColumn("form", form).filter("root is not null").groupBy("root").agg(F.max_by("project_id", F.struct(*STRENGTH, "project_id")).alias("survivor_id"), F.countDistinct("root_commit").alias("commits"))
    below = reduce(or_, [F.startswith(F.lower("path"), F.lit(x.lower().rstrip("/") + "/")) for x in temp_roots], F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("path").isNull(), "no_registered_path"),
            F.when(F.col("path").isNotNull() & ~F.col("path_exists"), "path_missing"),
            F.when(F.col("worktree"), "agent_worktree"),
            F.when(F.coalesce(below, F.lit(False)), "temp_folder"),
            F.when(F.rlike(F.lower("display_name"), F.lit(scratch_name)), "scratch_name"),
            F.when((F.col("active_sources") == 0) & (F.col("runs") == 0), "empty"),
        )
    )
    each = grouped.join(strong, "root", "left").withColumn("reasons", reasons)
    merges = F.col("survivor_id").isNotNull() & (F.col("survivor_id") != F.col("project_id"))
    guarded = (F.col("validations") > 0) | (F.col("ledger_claims") > 0)
    action = F.when(merges & (F.col("commits") > 1), "review").when(merges, "merge").when((F.size("reasons") > 0) & guarded, "review").when(F.size("reasons") > 0, "prune").otherwise("keep")
    return each.select("project_id", action.alias("action"), F.when(merges, F.col("survivor_id")).alias("survivor_id"), "reasons")


def pointers(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks whose stored text the live file gives back at their lines keep no text of their own.

    chunks: chunk_id, path, content_hash, line_start, line_end, text; live: path, content_hash, text."""
    there = live.select("path", "content_hash", F.split("text", "\n").alias("lines"))
    met = chunks.join(there, ["path", "content_hash"], "left")
    part = F.trim(F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))
    same = F.coalesce(part == F.trim("text"), F.lit(False))
    return met.select(*[c for c in chunks.columns if c != "text"], F.when(same, "").otherwise(F.col("text")).alias("text"))
