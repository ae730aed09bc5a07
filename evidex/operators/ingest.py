"""Ingest of a project: one run over what was found, one commit to all tables, and an index kept up by segments.

Tables only grow.  ``sources`` and ``projects`` are logs whose heads are their latest rows; versions,
chunks, claims, evidence, nodes, edges and postings get what is new.  So a run writes as much as has
changed, whatever the store holds.  Each run's postings are a segment of their own with the counts that
ranking needs; chunks that no source is at any more are tombstones, left out of every search and taken
off the counts, until ``merge_segments`` writes the segments as one.

    sources      source_id, project_id, path, current_hash, size, mtime, active, seq
    versions     version_id, source_id, project_id, content_hash, seq
    chunks       chunk_id, version_id, project_id, path, content_hash, ordinal, line_start, line_end, heading, text, chunk_hash
    claims       claim_id, project_id, normalized_text, display_text, trust_state, created_by
    evidence     claim_id, chunk_id
    nodes, edges as of ``graph``; projects: project_id, corpus_version; validations as of ``maintenance.validate``
    postings, vocabulary (term, df), lengths (n_chunks, total_length): the segments

Defined results: a run that finds nothing new commits nothing; null texts have no chunks; a path found
twice counts once, its greatest hash; an empty listing of a known project marks all its sources missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store, kept
from . import evidence, graph, ledger, packet, search

TABLES = {
    "projects": "project_id string, corpus_version long",
    "sources": "source_id string, project_id string, path string, current_hash string, size long, mtime long, active boolean, seq long",
    "versions": "version_id string, source_id string, project_id string, content_hash string, seq long",
    "chunks": "chunk_id long, version_id string, project_id string, path string, content_hash string, ordinal int, line_start int, line_end int, heading string, text string, chunk_hash string",
    "claims": "claim_id string, project_id string, normalized_text string, display_text string, trust_state string, created_by string",
    "evidence": "claim_id string, chunk_id long",
    "nodes": "node_id string, project_id string, kind string, name string, trust string",
    "edges": "subject string, predicate string, object string, chunk_id long",
    "validations": "validation_id long, claim_id string, validator string, result string, details string, observed_at string",
    "postings": "term string, chunk_id long, project_id string, length long, f double, at array<int>",
    "vocabulary": "term string, df long",
    "lengths": "n_chunks long, total_length long",
}


def table(store: Store, name: str) -> DataFrame:
    """A table of the store; empty if nothing was written to it yet."""
    return store.read(name) if name in store.manifest()["tables"] else store.spark.createDataFrame([], TABLES[name])


def heads(store: Store) -> DataFrame:
    """The sources as they are now."""
    return ledger.latest(table(store, "sources"), ["source_id"], "seq")


def current_chunks(store: Store) -> DataFrame:
    """The chunks of the version, and the place, that an active source is at."""
    live = heads(store).filter("active")
    at = table(store, "versions").join(live.select("source_id", F.col("current_hash").alias("content_hash"), "path"), ["source_id", "content_hash"]).select("version_id", "path")
    return table(store, "chunks").join(at, ["version_id", "path"], "left_semi")


def planned(found: DataFrame, old: DataFrame, versions: DataFrame, project_id: str, seq: int, full: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): each found file with its action and source_id; active sources that a full listing lacks.

    A source that was renamed keeps its id.  found: path, content_hash and others."""
    hashes = found.select("path", "content_hash")
    known = old.select("path", F.col("source_id").alias("known_id"), "active")
    moved = ledger.renames(hashes, old).join(old.select(F.col("path").alias("old_path"), F.col("source_id").alias("moved_id")), "old_path")
    acts = ledger.version_actions(hashes, old, versions)
    fresh = F.sha2(F.concat_ws(":", F.lit(project_id), "path", F.lit(str(seq))), 256)
    rows = found.join(acts, "path").join(known, "path", "left").join(moved, "path", "left").withColumn("source_id", F.coalesce("known_id", "moved_id", fresh))
    lost = old.filter("active").join(hashes.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rows.drop("known_id", "moved_id", "old_path"), lost if full else lost.limit(0)


def ingest(store: Store, project_id: str, found: DataFrame, full: bool = True) -> dict[str, int]:
    """Bring a project up to what was found; the counts of each action and the store's version.

    found: path, text, content_hash, size, mtime.  ``full``: the listing shows all of the project, so
    active sources that it lacks are missing.  What is to be done is planned without texts; those of changed
    files are joined once.  Chunks and postings, the largest tables, are written once, where the commit names them."""
    seq = store.manifest()["version"] + 1
    mine = F.col("project_id") == project_id
    once = found.groupBy("path").agg(F.max_by(F.struct("content_hash", "size", "mtime"), "content_hash").alias("x")).select("path", "x.*")
    old, versions = kept(heads(store).filter(mine), "heads"), table(store, "versions").filter(mine)
    rows, lost = planned(once, old, versions, project_id, seq, full)
    rows, lost = kept(rows, "planned"), kept(lost, "lost")
    version_id = F.sha2(F.concat_ws(":", "source_id", "content_hash"), 256)
    changed = kept(rows.join(old.select("source_id", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime")), "source_id", "left").filter((F.col("action") != "touch") | ~F.coalesce("active", F.lit(True)) | ~F.col("size").eqNullSafe(F.col("old_size")) | ~F.col("mtime").eqNullSafe(F.col("old_mtime"))), "changed")
    counts = {r["action"]: r["n"] for r in rows.groupBy("action").agg(F.count("*").alias("n")).collect()} | {"missing": lost.count()}
    if changed.isEmpty() and not counts["missing"]:
        return counts | {"version": seq - 1}
    head = ["source_id", F.lit(project_id).alias("project_id"), "path"]
    state = changed.select(*head, F.col("content_hash").alias("current_hash"), "size", "mtime", F.lit(True).alias("active"), F.lit(seq).cast("long").alias("seq"))
    away = lost.select(*head, "current_hash", "size", "mtime", F.lit(False).alias("active"), F.lit(seq).cast("long").alias("seq"))
    made = changed.filter("action in ('insert', 'update')").select(version_id.alias("version_id"), "source_id", F.lit(project_id).alias("project_id"), "content_hash", F.lit(seq).cast("long").alias("seq"))
    to_cut = changed.filter("action in ('insert', 'update', 'rename')").select(version_id.alias("version_id"), F.lit(project_id).alias("project_id"), "path", "content_hash")
    # a merge join by hint: files' rows are far larger in memory than in the table they were written to
    read = found.select("path", "content_hash", "text").join(to_cut.hint("merge"), ["path", "content_hash"])
    cut = packet.chunks(read.groupBy("version_id", "project_id", "path", "content_hash").agg(F.first("text").alias("text")))
    chunks = cut.withColumn("chunk_id", F.xxhash64("version_id", "path", "ordinal"))
    placed = {}
    placed["chunks"], chunks = store.place("chunks", ledger.insert_new(table(store, "chunks"), chunks, ["chunk_id"]).select(*columns("chunks")))
    said = kept(evidence.claim_rows(chunks), "claims")
    claims = said.groupBy("claim_id", "project_id", "normalized_text").agg(F.max_by("display_text", F.struct("chunk_id", "sentence_no")).alias("display_text")).withColumn("trust_state", F.lit("observed")).withColumn("created_by", F.lit("ingest"))
    claims_of = said.select("project_id", "chunk_id", "normalized_text").distinct()
    placed["postings"], rows = store.place("postings", search.postings(chunks).select(*columns("postings")))
    segment = counted(rows)
    del segment["postings"]
    last = table(store, "projects").filter(mine).agg(F.max("corpus_version")).first()[0] or 0
    append = {
        "projects": store.spark.createDataFrame([(project_id, last + 1)], TABLES["projects"]),
        "sources": state.unionByName(away),
        "versions": made,
        "claims": ledger.insert_new(table(store, "claims"), claims, ["claim_id"]),
        "evidence": said.select("claim_id", "chunk_id").distinct(),
        "nodes": ledger.insert_new(table(store, "nodes"), graph.nodes(chunks, claims_of), ["node_id"]),
        "edges": graph.edges(chunks, claims_of),
        "validations": store.spark.createDataFrame([], TABLES["validations"]),
        **segment,
    }
    tables = store.manifest()["tables"]
    replace = {"cache": store.read("cache").filter(~mine)} if "cache" in tables else {}
    append = {n: df.select(*columns(n)) for n, df in append.items() if n != "validations" or n not in tables}
    return counts | {"version": store.commit(append=append, replace=replace, placed=placed)}


def columns(name: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in TABLES[name].split(", ")]


def segments(chunks: DataFrame) -> dict[str, DataFrame]:
    """The postings of some chunks, in runs sorted by term as they come out of their texts, and what is counted from them."""
    return counted(kept(search.postings(chunks), "postings"))


def counted(rows: DataFrame) -> dict[str, DataFrame]:
    """Postings as the tables of one segment."""
    words, lengths = rows.filter(F.col("term") != search.STATS), rows.filter(F.col("term") == search.STATS)
    return {
        "postings": rows.select(*columns("postings")),
        "vocabulary": words.groupBy("term").agg(F.count("*").alias("df")),
        "lengths": lengths.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length")),
    }


def index(store: Store) -> search.Index:
    """The index of the current chunks: all segments without their tombstones, statistics as sums less those of the tombstones."""
    rows = table(store, "postings")
    dead = kept(table(store, "chunks").select("chunk_id").join(current_chunks(store).select("chunk_id"), "chunk_id", "left_anti"), "dead")
    gone = kept(rows.join(dead, "chunk_id", "left_semi").groupBy("term").agg(F.count("*").alias("n"), F.sum("length").alias("total")), "gone")
    words = gone.filter(F.col("term") != search.STATS).select("term", "n")
    vocabulary = table(store, "vocabulary").groupBy("term").agg(F.sum("df").alias("df")).join(words, "term", "left").select("term", (F.col("df") - F.coalesce("n", F.lit(0))).alias("df")).filter("df > 0")
    lost = gone.filter(F.col("term") == search.STATS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    sums = table(store, "lengths").agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("total_length"), F.lit(0)).alias("all_length")).join(F.broadcast(lost))
    n = F.col("all_n") - F.col("n")
    stats = sums.select(n.alias("n_chunks"), F.when(n > 0, (F.col("all_length") - F.col("total")).cast("double") / n).alias("avg_length"))
    return search.Index(rows.filter(F.col("term") != search.STATS).join(dead, "chunk_id", "left_anti"), vocabulary, stats)


def merge_segments(store: Store, least: int = 1) -> int:
    """All segments written as one, without tombstones, if there are more than ``least``; the store's version."""
    state = store.manifest()
    if len(state["tables"].get("postings", [])) <= least:
        return state["version"]
    return store.commit(replace=counted(table(store, "postings").join(current_chunks(store).select("chunk_id"), "chunk_id", "left_semi").sortWithinPartitions("term", "chunk_id")))


def packets(store: Store, requests: DataFrame, scope: DataFrame, states: DataFrame | None = None, **more) -> DataFrame:
    """``session.packets`` over what the store holds now.

    states: path, state of the files by now (``ledger.changes``); spans of files that are not unchanged are stale.
    files=(root, lines): found spans are read from their files instead (``live.hydrate``)."""
    from . import maintenance, session

    chunks = current_chunks(store).withColumn("current", F.lit(True))
    if states is None:
        chunks = chunks.withColumn("stale", F.lit(False))
    else:
        moved = states.filter("state in ('changed', 'missing')").select("path").distinct().withColumn("moved", F.lit(True))
        chunks = chunks.join(moved, "path", "left").withColumn("stale", F.col("moved").isNotNull()).drop("moved")
    claims = maintenance.claims(store).join(table(store, "evidence"), "claim_id", "left").withColumn("created_at", F.lit(0).cast("long"))
    edges = table(store, "edges")
    at = edges.select(F.col("subject").alias("node_id"), "chunk_id").unionByName(edges.select(F.col("object").alias("node_id"), "chunk_id")).distinct()
    nodes = table(store, "nodes").join(at, "node_id")
    return session.packets(requests, chunks, scope, index=index(store), claims=claims, nodes=nodes, **more)
