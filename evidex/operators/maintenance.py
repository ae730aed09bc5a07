"""Changes to a whole store: validations and proposals, pruning, clean-up, migrations, space, health, repair, a page to read.

Every change is planned as DataFrames and becomes visible by one manifest (``Store.commit``): readers see
all of it or nothing, and a job that dies before that has changed nothing."""

from __future__ import annotations

import html
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.store import FORMAT_VERSION, Store, kept
from . import ledger

# What a validation may say, files that a query may have read again, rows of a table on a page.
RESULTS = ("verified", "disputed", "superseded")
REPAIRS, PAGE_ROWS = 25, 200


def claims(store: Store) -> DataFrame:
    """The claims of a store in the state that their last validation names."""
    return ledger.validated(store.read("claims"), store.read("validations")).select(*store.read("claims").columns)


def projects(store: Store) -> DataFrame:
    """project_id and corpus_version as of its last change."""
    log = store.read("projects")
    return ledger.latest(log, ["project_id"], "corpus_version").select(*log.columns)


def _raised(store: Store, project_id: str) -> dict[str, dict[str, DataFrame]]:
    """What every change to a project adds to a commit: its next version; its cached packets go."""
    row = projects(store).filter(F.col("project_id") == project_id).withColumn("corpus_version", F.col("corpus_version") + 1)
    cached = "cache" in store.manifest()["tables"]
    return {"append": {"projects": row}, "replace": {"cache": store.read("cache").filter(F.col("project_id") != project_id)} if cached else {}}


def validate(store: Store, claim_id: str, validator: str, result: str, now: str, details: str = "{}") -> int:
    """Record a named validation: a row of the log, by which ``claims`` reads the claim's state, and its project's next version; one commit.

    No table is rewritten but the cache.  The new version.  ValueError for an unknown claim, no name, or another result."""
    if not validator.strip() or result.strip().casefold() not in RESULTS:
        raise ValueError(f"a validator's name and one of {RESULTS} are needed")
    result = result.strip().casefold()
    log = store.read("validations")
    owner = store.read("claims").filter(F.col("claim_id") == claim_id).select("project_id").first()
    if owner is None:
        raise ValueError(f"unknown claim: {claim_id}")
    number = (log.agg(F.max("validation_id")).first()[0] or 0) + 1
    row = store.spark.createDataFrame([(number, claim_id, validator.strip(), result, details, now)], "validation_id long, claim_id string, validator string, result string, details string, observed_at string")
    change = _raised(store, owner[0])
    return store.commit(replace=change["replace"], append=change["append"] | {"validations": row})


def propose(store: Store, project_id: str, text: str, by: str) -> int:
    """Add a claim as a proposal and drop the project's cached packets; a claim that is there already stays as it is.  The new version."""
    row = store.spark.createDataFrame([(project_id, " ".join(text.split()), by)], "project_id string, display_text string, created_by string").withColumn("normalized_text", t.fold(F.col("display_text")))
    name = t.uuid5(t.CLAIM_NAMESPACE, F.concat_ws(":", "project_id", "normalized_text"))
    new = ledger.insert_new(store.read("claims"), row.withColumn("claim_id", name).withColumn("trust_state", F.lit("proposed")), ["claim_id"])
    return store.commit(replace=_raised(store, project_id)["replace"], append={"claims": new.select(*store.read("claims").columns)})


def pruned(chunks: DataFrame, versions: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, claims: DataFrame, evidence: DataFrame, validations: DataFrame) -> dict[str, DataFrame]:
    """The tables after pruning: superseded chunks go unless they back a claim that is validated or more than observed; then what only they held.

    chunks: chunk_id, version_id; versions: version_id, source_id, content_hash; sources: source_id, current_hash, active; edges:
    subject, object, chunk_id; nodes: node_id, kind; claims: claim_id, trust_state; evidence: claim_id, chunk_id."""
    live = ledger.current_chunks(chunks, versions, sources.filter("active"))
    gone = ledger.prunable(chunks, live, evidence, claims, validations).select("chunk_id")
    left_chunks = chunks.join(gone, "chunk_id", "left_anti")
    backs = evidence.join(gone, "chunk_id", "left_anti")
    guarded = claims.filter("trust_state <> 'observed'").select("claim_id").union(validations.select("claim_id")).union(backs.select("claim_id")).distinct()
    left = edges.join(gone, "chunk_id", "left_anti")
    named = left.select(F.col("subject").alias("node_id")).union(left.select("object")).distinct()
    used = left_chunks.select("version_id").union(versions.join(sources.select("source_id", F.col("current_hash").alias("content_hash")), ["source_id", "content_hash"], "left_semi").select("version_id")).distinct()
    after = {
        "chunks": left_chunks,
        "evidence": backs,
        "edges": left,
        "claims": claims.join(guarded, "claim_id", "left_semi"),
        "nodes": nodes.filter("kind = 'project'").unionByName(nodes.filter("kind <> 'project'").join(named, "node_id", "left_semi")),
        "versions": versions.join(used, "version_id", "left_semi"),
    }
    before = {"chunks": chunks, "evidence": evidence, "edges": edges, "claims": claims, "nodes": nodes, "versions": versions}
    return {name: df.select(*before[name].columns) for name, df in after.items()}


def _of_chunks(store: Store, chunks: DataFrame) -> dict[str, DataFrame]:
    """What rests on chunks, for those that are left: evidence, edges, and the index as one segment."""
    from .ingest import counted

    tables = store.manifest()["tables"]
    left = {n: store.read(n).join(chunks.select("chunk_id"), "chunk_id", "left_semi") for n in ("evidence", "edges", "postings") if n in tables}
    return left | (counted(left["postings"]) if "postings" in left else {})


def prune(store: Store) -> int:
    """``pruned`` as one commit, with the index of what is left; the new version."""
    from .ingest import heads

    names = ("chunks", "versions", "nodes", "edges", "claims", "evidence")
    t_ = {n: store.read(n) for n in names} | {"claims": claims(store)}
    after = pruned(t_["chunks"], t_["versions"], heads(store), t_["nodes"], t_["edges"], t_["claims"], t_["evidence"], store.read("validations"))
    after = {n: kept(df, n) for n, df in after.items()}
    index = {n: df for n, df in _of_chunks(store, after["chunks"]).items() if n not in after}
    return store.commit(replace=after | index)


def blocked_merges(mapping: DataFrame, claims: DataFrame, validations: DataFrame) -> DataFrame:
    """project_id, orphans: merges that would lose a validation, since the survivor has no claim of the same words.

    mapping: project_id, survivor_id."""
    checked = claims.join(validations.select("claim_id").distinct(), "claim_id", "left_semi").join(mapping, "project_id")
    there = claims.select(F.col("project_id").alias("survivor_id"), "normalized_text")
    return checked.join(there, ["survivor_id", "normalized_text"], "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("orphans"))


def apply_cleanup(store: Store, plan: DataFrame) -> dict:
    """Carry out a clean-up plan (project_id, action, survivor_id): merges move history to the survivor, prunes delete; one commit.

    The work list is written into the store first and again read from there, so a run that was
    interrupted is taken up as it was planned.  Merges that would lose a validation are left and told."""
    tables = store.manifest()["tables"]
    if "cleanup" not in tables:
        store.commit(replace={"cleanup": plan.select("project_id", "action", "survivor_id")})
    work = store.read("cleanup")
    claims_, validations = claims(store), store.read("validations")
    merges = work.filter("action = 'merge'").select("project_id", "survivor_id")
    blocked = blocked_merges(merges, claims_, validations)
    mapping = merges.join(blocked, "project_id", "left_anti")
    gone = work.filter("action = 'prune'").select("project_id").union(mapping.select("project_id"))
    last = validations.groupBy("claim_id").agg(F.max("validation_id").alias("checked"))
    twins = claims_.join(last, "claim_id", "left").join(mapping, "project_id").select(F.col("claim_id").alias("old"), F.col("survivor_id").alias("project_id"), "normalized_text", F.col("trust_state").alias("state"), F.coalesce("checked", F.lit(0)).alias("checked"))
    # a survivor may have one wording under two ids: the least of them takes the history
    own = claims_.groupBy("project_id", "normalized_text").agg(F.min("claim_id").alias("new"), F.min_by("trust_state", "claim_id").alias("own"))
    same = twins.join(own, ["project_id", "normalized_text"])
    moved = validations.join(same.select(F.col("old").alias("claim_id"), "new"), "claim_id", "left").withColumn("claim_id", F.coalesce("new", "claim_id")).drop("new").select(*validations.columns)
    # the state of the moved claim that was validated last, if one was lifted at all
    lifted = same.filter("own = 'observed' and state <> 'observed'").groupBy(F.col("new").alias("claim_id")).agg(F.max_by("state", F.struct("checked", "old")).alias("lifted"))
    proposals = claims_.filter("trust_state = 'proposed'").join(mapping, "project_id").withColumn("project_id", F.col("survivor_id")).join(claims_.select("project_id", "normalized_text"), ["project_id", "normalized_text"], "left_anti").select(*claims_.columns)
    stay = claims_.join(gone, "project_id", "left_anti").join(lifted, "claim_id", "left").withColumn("trust_state", F.coalesce("lifted", "trust_state")).select(*claims_.columns)
    replace = {"claims": stay.unionByName(proposals), "validations": moved, "projects": projects(store).join(gone, "project_id", "left_anti")}
    for name, keys in (("aliases", ["path"]), ("runs", ["run_id"]), ("budgets", ["agent"])):
        if name in tables:
            table = store.read(name)
            pruned_ = table.join(work.filter("action = 'prune'").select("project_id"), "project_id", "left_anti")
            replace[name] = ledger.move_rows(pruned_, mapping, keys).select(*table.columns)
    for name in ("chunks", "sources", "versions", "nodes", "cache"):
        if name in tables:
            replace[name] = store.read(name).join(gone, "project_id", "left_anti")
    replace |= _of_chunks(store, replace["chunks"]) if "chunks" in replace else {}
    told = {"blocked": {r["project_id"]: r["orphans"] for r in blocked.collect()}, "merged": mapping.count(), "pruned": work.filter("action = 'prune'").count()}
    told["version"] = store.commit(replace=replace, drop=["cleanup"])
    return told


def _budgets(store: Store) -> dict:
    """Format 2: a table of run budgets; those that were never changed from their first value carry nothing and go."""
    if "budgets" not in store.manifest()["tables"]:
        return {"budgets": store.spark.createDataFrame([], "project_id string, agent string, initial long, remaining long")}
    return {"budgets": store.read("budgets").filter("initial <> 8 or remaining <> 8")}


def _agents(store: Store) -> dict:
    """Format 3: runs name their agent, null where none was recorded."""
    runs = store.read("runs") if "runs" in store.manifest()["tables"] else None
    return {} if runs is None or "agent" in runs.columns else {"runs": runs.withColumn("agent", F.lit(None).cast("string"))}


def _stems(store: Store) -> dict:
    """Format 4: terms are stemmed; postings are made anew, and rows without a chunk are gone."""
    if "chunks" not in store.manifest()["tables"]:
        return {}
    from .ingest import segments

    return segments(store.read("chunks"))


MIGRATIONS: dict[int, Callable[[Store], dict]] = {2: _budgets, 3: _agents, 4: _stems}


def migrate(store: Store) -> list[int]:
    """Run the steps that a store's format lacks, each its own commit; the formats reached.  A newer store is refused by ``Store.manifest``."""
    done = []
    for version in range(store.manifest()["format_version"] + 1, FORMAT_VERSION + 1):
        store.commit(replace=MIGRATIONS[version](store), format_version=version)
        done.append(version)
    return done


def space(store: Store) -> DataFrame:
    """table, folder, bytes, used: what lies in a store, and whether its last manifest names it."""
    tables = store.manifest()["tables"]
    used = {folder for folders in tables.values() for folder in folders}
    rows = [(name, f"{name}/{folder}", size, f"{name}/{folder}" in used) for name, folder, size in store.folders()]
    return store.spark.createDataFrame(rows, "table string, folder string, bytes long, used boolean")


def vacuum(store: Store, confirmed: bool = False) -> dict:
    """Bytes of folders that no table uses; they are deleted only if ``confirmed``, and readers of older states lose them."""
    loose = [(r["folder"], r["bytes"]) for r in space(store).filter("not used").collect()]
    for folder, _ in loose if confirmed else ():
        store.delete(folder)
    return {"folders": len(loose), "bytes": sum(b for _, b in loose), "deleted": confirmed}


def doctor(store: Store, integrity: bool = False) -> dict:
    """Whether a store is fit to use: manifest, schemas, an index probe; with ``integrity`` every table is read.  Milliseconds beside each."""
    out, spent = {"code_format": FORMAT_VERSION}, {}

    def timed(name, f):
        began = time.perf_counter()
        try:
            return f()
        except Exception as error:  # a failed probe is a finding, not the end of the report
            out.setdefault("errors", {})[name] = str(error).splitlines()[0][:300]
            return None
        finally:
            spent[name] = round(1000 * (time.perf_counter() - began), 1)

    state = timed("manifest", store.manifest) or {"tables": {}, "format_version": None, "version": None}
    out |= {"format": state["format_version"], "version": state["version"]}
    out["columns"] = {n: timed(f"schema:{n}", lambda n=n: len(store.read(n).columns)) for n in state["tables"]}
    if "vocabulary" in state["tables"]:
        out["index"] = timed("index", lambda: store.read("vocabulary").limit(1).count() >= 0)
    if integrity:
        out["rows"] = {n: timed(f"rows:{n}", lambda n=n: store.read(n).select(F.xxhash64("*").alias("h")).agg(F.count("h")).first()[0]) for n in state["tables"]}
    return out | {"ready": "errors" not in out and out["format"] == FORMAT_VERSION, "timings_ms": spent}


def answered_fresh(ask: Callable[[], DataFrame], stale_paths: Callable[[DataFrame], DataFrame], ingest: Callable[[list[str]], None], most: int = REPAIRS) -> DataFrame:
    """The packets of ``ask``; if they rest on a few files that changed since, those are read again and ``ask`` runs once more.

    stale_paths: path of the changed files of the active project that a result rests on; more than ``most``
    are left as they are, and so is a result whose files could not be read again."""
    first = ask()
    paths = [r["path"] for r in stale_paths(first).select("path").distinct().limit(most + 1).collect()]
    if not paths or len(paths) > most:
        return first
    try:
        ingest(sorted(paths))
    except (OSError, ValueError, RuntimeError):
        return first
    return ask()


def page(store: Store, project_id: str, rows: int = PAGE_ROWS) -> str:
    """A project as one HTML page, to be read only: at most ``rows`` rows of each of its tables; everything is escaped."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(project_id)}</title><h1>{html.escape(project_id)}</h1>"]
    for name in ("sources", "chunks", "claims", "validations", "runs"):
        if name not in store.manifest()["tables"]:
            continue
        table = store.read(name)
        if "project_id" in table.columns:
            table = table.filter(F.col("project_id") == project_id)
        elif "claim_id" in table.columns:
            table = table.join(store.read("claims").filter(F.col("project_id") == project_id).select("claim_id"), "claim_id", "left_semi")
        shown = table.orderBy(*table.columns[:1]).limit(rows).collect()
        cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v)[:500])}</{tag}>" for v in values) + "</tr>"
        parts.append(f"<h2>{name}</h2><table>{cells('th', table.columns)}{''.join(cells('td', r) for r in shown)}</table>")
    return "".join(parts)
