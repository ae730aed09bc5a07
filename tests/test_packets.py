"""Compact packets, references, audits, and changes to a whole store."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidex.operators import compact, evidence, ingest, maintenance, packet, search, session
from evidex.sources.store import FORMAT_VERSION, Store


SPAN = "struct<project_id: string, path: string, line_start: int, line_end: int, text: string, source_hash: string, requirements: array<int>, disagreeing: boolean, stale: boolean>"
WHOLE = f"request_id long, query string, status string, packet_hash string, requirements array<struct<leaf_no: int, text: string, status: string>>, claims array<struct<claim_id: string, trust_state: string, display_text: string>>, evidence array<{SPAN}>"


def span(path, text, **more):
    return {"project_id": "p", "path": path, "line_start": 5, "line_end": 5 + text.count("\n"), "text": text, "source_hash": "h", "requirements": [0], "disagreeing": False, "stale": False} | more


def compacted(spark, items, budget, query="widgets é", status="evidence_found", claims=()):
    df = spark.createDataFrame([(1, query, status, "0" * 64, [(0, query, status)], list(claims), items)], WHOLE)
    row = compact.compacted(df, budget).first()
    body = json.loads(row["packet_json"])
    assert row["n_bytes"] == body["byte_count"] == len(row["packet_json"].encode()) <= budget
    return body


def test_excerpts(spark):
    text = "nothing\nwidgets here\nand widgets\nnothing\nwidgets again"
    policy = "widgets fly\nunless it rains"
    items = [span("a.md", text), span("b.md", "none here\nat all"), span("c.md", policy), span("d.md", "widgets", stale=True), span("e.md", "")]
    df = spark.createDataFrame([(1, "widgets", "ok", "h", [], [], items)], WHOLE)
    got = compact.excerpts(df).orderBy("place").collect()
    assert [(r["path"], r["line_start"], r["line_end"], r["text"]) for r in got] == [("a.md", 6, 7, "widgets here\nand widgets"), ("a.md", 9, 9, "widgets again"), ("b.md", 5, 6, "none here\nat all"), ("c.md", 5, 6, policy), ("d.md", 5, 5, ""), ("e.md", 5, 5, "")]
    assert got[1]["expand"].asDict() == {"project_id": "p", "path": "a.md", "expected_hash": "h", "line_start": 9, "line_end": 9}


@pytest.mark.parametrize("budget", [256, 400, 1200, 4000, 100_000])
def test_compact_is_within_its_budget(spark, budget):
    items = [span(f"f{i}.md", "\n".join(f"widgets line {j} " + "x" * 60 for j in range(30)), requirements=[i]) for i in range(5)]
    got = compacted(spark, items, budget, claims=[("c", "verified", "y" * 900)])
    if budget == 100_000:
        assert len(got["evidence"]) == 5 and not got["omitted"] and "degraded" not in got and len(got["claims"][0]["display_text"]) == 200
    if budget in (1200, 4000):
        assert got["degraded"]["found"] == 5 and got["degraded"]["needs_bytes"] > budget and 0 < len(got["omitted"]) <= 3
    if budget == 4000:  # one whole, the next by its leading lines
        assert [x.get("truncated") for x in got["evidence"]] == [None, True] and got["evidence"][1]["text"] == "\n".join(items[1]["text"].split("\n")[: got["evidence"][1]["line_end"] - 4])
        assert got["omitted"][0]["reason"] == "truncated" and got["omitted_count"] == 4


def test_conflicts_show_both_sides_or_none(spark):
    one, two = "Studio must use bounded roots. " + "z" * 300, "Studio must not use bounded roots."
    items = [span("a.md", one, disagreeing=True), span("b.md", two, disagreeing=True), span("c.md", "Studio must use bounded roots.", disagreeing=True), span("d.md", "w" * 2000, disagreeing=True), span("e.md", "bounded roots plain")]
    small = compacted(spark, items, 1500, "bounded roots", "disagreement")
    assert [x["path"] for x in small["evidence"]] == ["b.md", "c.md", "e.md"] and {x["reason"] for x in small["omitted"]} == {"conflict_set"}
    large = compacted(spark, items, 9000, "bounded roots", "disagreement")
    assert [x["path"] for x in large["evidence"]] == ["a.md", "b.md", "c.md", "d.md", "e.md"] and large["status"] == "disagreement"
    none = compacted(spark, items, 700, "bounded roots", "disagreement")
    assert none["status"] == "insufficient_budget" and not none["evidence"] and none["omitted_count"] == 5
    assert compacted(spark, [], 256)["evidence"] == []


def test_expand(spark):
    text = "\n".join(f"line {i} " + "x" * 90 for i in range(10))
    sources = spark.createDataFrame([("p", "a.md", "h1", text, True), ("p", "b.md", "h2", "must\nship\nunless " + "y" * 600, True), ("p", "gone.md", "h", "x", False), ("q", "other.md", "h", "x", True)], "project_id string, path string, content_hash string, text string, active boolean")
    refs = spark.createDataFrame([(1, "p", "a.md", "h1", 1, 2), (2, "p", "a.md", "h1", 2, 9), (3, "p", "a.md", "old", 1, 2), (4, "p", "gone.md", "h", 1, 1), (5, "p", "b.md", "h2", 1, 3), (6, "q", "other.md", "h", 1, 1), (7, "p", "b.md", "h2", 1, 1)], "request_id long, project_id string, path string, expected_hash string, line_start int, line_end int")
    allowed = spark.createDataFrame([("p",)], "project_id string")
    got = {r["request_id"]: r for r in compact.expand(sources, refs, 300, allowed).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "ok", 3: "stale", 4: "unavailable", 5: "insufficient_budget", 6: "unavailable", 7: "ok"}
    assert got[1]["text"] == "\n".join(text.split("\n")[:2]) and got[1]["next_line"] is None
    assert got[2]["line_end"] + 1 == got[2]["next_line"] and got[2]["text"] == "\n".join(text.split("\n")[1 : got[2]["line_end"]])
    assert got[7]["text"] == "must"


def test_audit_of_an_answer(spark):
    answers = spark.createDataFrame([(1, "The preview export runs at 24 fps. Yes.\n- Audio mixes use Dolby Atmos everywhere"), (2, "short"), (3, "Parcels must ship within two days.")], "request_id long, answer string")
    items = spark.createDataFrame([(1, 0, "Notes: the preview  export runs at 24 fps.", [0]), (1, 1, "filler", [1]), (3, 0, "parcels must ship within two days. Or not.", [0])], "request_id long, item_no int, text string, requirements array<int>")
    needs = spark.createDataFrame([(1, 0, "fps", "evidence_found", 3), (1, 1, "audio", "unknown", 0), (1, 2, "other", "unknown", 0), (3, 0, "ship", "disagreement", 1)], "request_id long, leaf_no int, text string, status string, found int")
    told, verdicts = evidence.audit_answers(answers, items, needs)
    assert {(r["request_id"], r["statement_no"]): (r["status"], r["coverage"], r["items"]) for r in told.collect()} == {(1, 0): ("candidate_evidence", 1.0, [0]), (1, 1): ("unknown", 0.0, []), (3, 0): ("candidate_evidence", 1.0, [0])}
    assert {r["request_id"]: (r["result"], r["worst_kind"], r["worst_no"]) for r in verdicts.collect()} == {1: ("residuals_open", "uncovered_requirement", 1), 2: ("match_move_complete", None, None), 3: ("clarification_needed", None, None)}


def test_packets_hold_claims_and_nodes(spark):
    chunks = spark.createDataFrame([(1, "p", "spec.md", 1, 2, None, "Decision: widgets must be blue.", "c1", True, False)] + [(i, "p", f"f{i}.md", 1, 1, None, "filler words", f"h{i}", True, False) for i in range(5, 12)], "chunk_id long, project_id string, path string, line_start int, line_end int, heading string, text string, chunk_hash string, current boolean, stale boolean")
    claims = spark.createDataFrame([("p", "c1", 1, "widgets must be blue", "widgets must be blue", "verified", 1), ("p", "c2", None, "All widgets should stay blue forever", "all widgets should stay blue forever", "proposed", 2)], "project_id string, claim_id string, chunk_id long, display_text string, normalized_text string, trust_state string, created_at long")
    nodes = spark.createDataFrame([("p", "n1", "symbol", "blue_widgets", "observed", 1)], "project_id string, node_id string, kind string, name string, trust string, chunk_id long")
    requests = spark.createDataFrame([(1, "blue widgets"), (2, "zzzz unknown thing")], "request_id long, text string")
    scope = spark.createDataFrame([(1, "p", 0), (2, "p", 0)], "request_id long, project_id string, priority int")
    got = {r["request_id"]: r for r in session.packets(requests, chunks, scope, claims=claims, nodes=nodes).collect()}
    assert [c["claim_id"] for c in got[1]["claims"]] == ["c1", "c2"] and [n["node_id"] for n in got[1]["graph_nodes"]] == ["n1"]
    assert [(r["status"], r["stop_reason"], r["evidence_count"]) for r in got[1]["requirements"]] == [("evidence_found", "evidence_found", 1)]
    assert got[2]["empty_result"] == "no_matching_spans" and [r["stop_reason"] for r in got[2]["requirements"]] == ["unknown"]


@pytest.fixture()
def store(spark, tmp_path):
    own = Store(spark, str(tmp_path / "store"))
    own.commit(replace={
        "projects": spark.createDataFrame([("a", 1), ("b", 1), ("t", 1), ("x", 1)], "project_id string, corpus_version long"),
        "claims": spark.createDataFrame([("c1", "a", "widgets are blue", "Widgets are blue", "observed", "ingest"), ("c2", "b", "widgets are blue", "Widgets are blue", "disputed", "ingest"), ("c3", "x", "only here", "Only here", "observed", "ingest"), ("c4", "b", "new idea", "New idea", "proposed", "me")], "claim_id string, project_id string, normalized_text string, display_text string, trust_state string, created_by string"),
        "validations": spark.createDataFrame([(1, "c2", "ci", "disputed", "{}", "t0"), (2, "c3", "ci", "verified", "{}", "t0")], "validation_id long, claim_id string, validator string, result string, details string, observed_at string"),
        "cache": spark.createDataFrame([("k1", "a"), ("k2", "b")], "cache_key string, project_id string"),
        "chunks": spark.createDataFrame([(1, "a", "<b>widgets</b> are blue", "a.md"), (2, "t", "temp", "t.md")], "chunk_id long, project_id string, text string, path string"),
        "runs": spark.createDataFrame([("r1", "b"), ("r2", "t")], "run_id string, project_id string"),
    })
    return own


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_validation_is_one_commit(store):
    before = store.manifest()["version"]
    assert maintenance.validate(store, "c1", "tests", "Verified", "t1") == before + 1
    assert rows(maintenance.claims(store).filter("claim_id = 'c1'"), "trust_state") == [("verified",)]
    assert rows(maintenance.projects(store), "project_id", "corpus_version") == [("a", 2), ("b", 1), ("t", 1), ("x", 1)]
    assert rows(store.read("cache"), "cache_key") == [("k2",)] and store.read("validations").count() == 3
    for bad in (("zz", "me", "verified"), ("c1", " ", "verified"), ("c1", "me", "maybe")):
        with pytest.raises(ValueError):
            maintenance.validate(store, *bad, "t")


def test_proposals(store):
    maintenance.propose(store, "a", "Roots   must be bounded", "agent")
    maintenance.propose(store, "a", "roots must be bounded", "agent")
    assert rows(store.read("claims").filter("project_id = 'a'"), "normalized_text", "trust_state") == [("roots must be bounded", "proposed"), ("widgets are blue", "observed")]
    assert rows(store.read("cache"), "cache_key") == [("k2",)]


def test_cleanup_moves_history(spark, store):
    plan = spark.createDataFrame([("b", "merge", "a"), ("x", "merge", "a"), ("t", "prune", None), ("a", "keep", None)], "project_id string, action string, survivor_id string")
    told = maintenance.apply_cleanup(store, plan)
    assert told["blocked"] == {"x": 1} and told["merged"] == 1 and told["pruned"] == 1
    assert rows(store.read("projects"), "project_id") == [("a",), ("x",)]
    assert rows(store.read("validations"), "validation_id", "claim_id") == [(1, "c1"), (2, "c3")]
    assert rows(store.read("claims"), "claim_id", "project_id", "trust_state") == [("c1", "a", "disputed"), ("c3", "x", "verified"), ("c4", "a", "proposed")]
    assert rows(store.read("runs"), "run_id", "project_id") == [("r1", "a")] and "cleanup" not in store.manifest()["tables"]


def test_pruning_keeps_what_claims_rest_on(spark):
    df = spark.createDataFrame
    out = maintenance.pruned(
        df([(1, 10), (2, 20), (3, 20), (4, 10)], "chunk_id long, version_id long"),
        df([(10, 1, "new"), (20, 1, "old"), (30, 1, "older")], "version_id long, source_id long, content_hash string"),
        df([(1, "new", True)], "source_id long, current_hash string, active boolean"),
        df([("n1", "symbol"), ("n2", "symbol"), ("p", "project")], "node_id string, kind string"),
        df([("p", "n1", 1), ("p", "n2", 3)], "subject string, object string, chunk_id long"),
        df([("c1", "observed"), ("c2", "verified"), ("c3", "observed")], "claim_id string, trust_state string"),
        df([("c1", 1), ("c2", 2), ("c3", 3)], "claim_id string, chunk_id long"),
        df([], "claim_id string"),
    )
    assert {k: sorted(r[0] for r in v.collect()) for k, v in out.items()} == {"chunks": [1, 2, 4], "evidence": ["c1", "c2"], "edges": ["p"], "claims": ["c1", "c2"], "nodes": ["n1", "p"], "versions": [10, 20]}


def test_migrations_space_and_health(spark, store, tmp_path):
    old = Store(spark, str(tmp_path / "old"))
    old.commit(replace={"runs": store.read("runs"), "chunks": store.read("chunks")}, first_format=1)
    assert not maintenance.doctor(old)["ready"]
    assert maintenance.migrate(old) == [2, 3, 4] and maintenance.migrate(old) == []
    assert old.read("runs").columns == ["run_id", "project_id", "agent"]
    assert ("widget", 1) in rows(old.read("vocabulary"), "term", "df")
    report = maintenance.doctor(old, integrity=True)
    assert report["ready"] and report["format"] == FORMAT_VERSION and report["rows"]["runs"] == 2 and report["index"]
    assert maintenance.vacuum(old)["folders"] == 1 and maintenance.vacuum(old, True)["bytes"] > 0 and maintenance.vacuum(old)["folders"] == 0


def test_page_escapes(store):
    text = maintenance.page(store, "a")
    assert "&lt;b&gt;widgets" in text and "<b>" not in text and "temp" not in text


def test_repair_asks_once_more(spark):
    asked, read = [], []
    ask = lambda: asked.append(1) or spark.range(len(read), 1)
    stale = lambda df: df.select(F.lit("a.md").alias("path"))
    assert maintenance.answered_fresh(ask, stale, read.append).count() == 0 and len(asked) == 2 and read == [["a.md"]]
    asked.clear()

    def broken(_):
        raise OSError("gone")

    assert maintenance.answered_fresh(lambda: asked.append(1) or spark.range(1), stale, broken).count() == 1 and len(asked) == 1
    assert json.loads(json.dumps(asked)) == [1]


def test_commands_on_an_ingested_store(spark, tmp_path, capsys):
    from evidex.__main__ import main

    root, store = tmp_path / "widgets", str(tmp_path / "store")
    root.mkdir()
    (root / "a.md").write_text("# Widgets\n\nThe widget must ship within two days.\n")

    def told(*args, code=0):
        assert main(list(args)) == code
        out = capsys.readouterr().out
        return json.loads(out) if out.startswith(("{", "[")) else out

    assert told("ingest", store, "p", str(root)) == {"insert": 1, "missing": 0, "version": 1}
    assert told("ingest", store, "p", str(root)) == {"touch": 1, "missing": 0, "version": 1}
    (root / "b.md").write_text("# Parcels\n\nA parcel must never ship on Sunday.\n")
    assert told("ingest", store, "p", str(root)) == {"insert": 1, "touch": 1, "missing": 0, "version": 2}
    claim = Store(spark, store).read("claims").filter("display_text like '%within two days%'").first()["claim_id"]
    assert told("validate", store, claim, "tests", "verified")["version"] == 3
    packet_ = told("query", store, "widget", "ship")[0]
    assert packet_["status"] == "evidence_found" and packet_["evidence"][0]["path"] == "a.md"
    assert {c["claim_id"]: c["trust_state"] for c in packet_["claims"]}[claim] == "verified"
    told("validate", store, "nobody", "tests", "verified", code=2)
    assert told("propose", store, "p", "me", "Widgets", "should", "be", "blue")["version"] == 4
    assert told("fresh", store, str(root)) == {"unchanged": 2, "advice": "fresh"}
    assert told("rebuild-index", store)["version"] == 5 and told("rebuild-index", store)["version"] == 5
    assert told("doctor", store, "integrity")["rows"]["chunks"] == 2
    assert told("migrate", store) == {"formats": []}
    assert told("compact", store)["deleted"] is False and told("compact", store, "confirmed")["folders"] == 6
    assert all(r["used"] for r in told("space", store))
    assert "must ship within two days" in told("explain-project", store, "p")
    told("unknown", store, code=2)


FOUND = "path string, text string, content_hash string, size long, mtime long"


def found(spark, texts, at):
    return spark.createDataFrame([(p, x, f"h-{x}", len(x or ""), at) for p, x in texts.items()], FOUND)


def test_ingest_of_edits_renames_reverts_and_deletions(spark, tmp_path):
    """After each run, sources, chunks and searches over the segments are those of a store that is filled at once."""
    store = Store(spark, str(tmp_path / "many"))
    a, b, c = "# A\n\nThe alpha widget must ship.", "beta gadget words", "gamma lamp words and alpha too"
    rounds = [
        ({"a.md": a, "b.md": b, "c.md": c, "empty.md": None}, {"insert": 4, "missing": 0}),
        ({"a.md": a, "b.md": b + " edited", "c.md": c, "empty.md": None}, {"touch": 3, "update": 1, "missing": 0}),
        ({"moved.md": a, "b.md": b, "c.md": c}, {"rename": 1, "revert": 1, "touch": 1, "missing": 1}),
        ({"moved.md": a, "a.md": "# A\n\nA new file must stand where one was.", "c.md": c}, {"touch": 2, "insert": 1, "missing": 1}),
        ({"moved.md": a, "a.md": "# A\n\nA new file must stand where one was.", "b.md": b, "c.md": c}, {"touch": 4, "missing": 0}),
    ]
    asked = spark.createDataFrame([(1, ["alpha", "widget"]), (2, ["beta", "edited"]), (3, ["words"]), (4, ["file", "stood"]), (5, ["moved"])], "request_id long, terms array<string>")
    scope = spark.createDataFrame([(i, "p", 0) for i in range(1, 6)], "request_id long, project_id string, priority int")
    ids = {}

    def answers(own):
        chunks = ingest.current_chunks(own).withColumn("current", F.lit(True))
        hits = search.retrieve(asked, ingest.index(own), chunks.select("chunk_id", "project_id", "path", "line_start", "current", "heading"), scope)
        return sorted((r["request_id"], r["path"], r["match_pass"], round(r["rank"], 6)) for r in hits.collect())

    for i, (texts, want) in enumerate(rounds):
        before = {r["path"]: r["source_id"] for r in ingest.heads(store).collect()} if i else {}
        got = ingest.ingest(store, "p", found(spark, texts, i))
        assert got == want | {"version": i + 1}
        now = {r["path"]: r for r in ingest.heads(store).filter("active").collect()}
        assert {p: r["current_hash"] for p, r in now.items()} == {p: f"h-{x}" for p, x in texts.items()}
        ids[i] = {p: r["source_id"] for p, r in now.items()}
    once = Store(spark, str(tmp_path / "once"))
    ingest.ingest(once, "p", found(spark, rounds[-1][0], 0))
    text_of = lambda own: rows(ingest.current_chunks(own), "path", "ordinal", "text", "heading")
    assert text_of(store) == text_of(once)
    whole = answers(store)
    assert whole == answers(once)
    assert ids[2]["moved.md"] == ids[1]["a.md"] and ids[3]["a.md"] not in (ids[0]["a.md"], ids[2]["moved.md"]) and ids[4]["b.md"] == ids[0]["b.md"]
    assert len(store.manifest()["tables"]["postings"]) == 5 and rows(maintenance.projects(store), "corpus_version") == [(5,)]
    assert ingest.merge_segments(store) == 6 and len(store.manifest()["tables"]["postings"]) == 1
    kinds = {r["kind"] for r in store.read("nodes").collect()}
    assert {"project", "source", "topic", "claim"} <= kinds and {r["predicate"] for r in store.read("edges").collect()} >= {"contains", "has_topic", "states"}
    claim = store.read("claims").filter("normalized_text like '%alpha widget%'").first()["claim_id"]
    maintenance.validate(store, claim, "ci", "verified", "t")
    maintenance.prune(store)
    assert answers(store) == whole and rows(maintenance.claims(store).filter("trust_state = 'verified'"), "claim_id") == [(claim,)]
    assert ingest.ingest(store, "p", found(spark, {"z.md": "only this"}, 9), full=False)["missing"] == 0
    assert ingest.ingest(store, "p", found(spark, {}, 9))["missing"] == 5 and ingest.current_chunks(store).isEmpty()


CHUNK = "chunk_id long, project_id string, path string, line_start int, line_end int, heading string, text string, chunk_hash string, current boolean, stale boolean"


def packets_of(spark, chunks, asked, **more):
    """Packets of requests over chunks (path, first line, last line, text, stale) beside files of no interest."""
    rows = [(i, "p", path, a, b, None, text, f"h{i}", True, stale) for i, (path, a, b, text, stale) in enumerate(chunks)]
    rows += [(1000 + i, "p", f"filler{i}.md", 1, 1, None, f"nothing here {i}", f"n{i}", True, False) for i in range(30)]
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id long, text string")
    scope = spark.createDataFrame([(i, "p", 0) for i in range(len(asked))], "request_id long, project_id string, priority int")
    return [r for _, r in sorted((r["request_id"], r) for r in session.packets(requests, spark.createDataFrame(rows, CHUNK), scope, **more).collect())]


def test_packets_of_odd_requests(spark):
    """Two leaves answered by adjacent chunks; stale spans only; ten divisible leaves; a conflict beside a plain neighbour."""
    chunks = [
        ("a.md", 1, 3, "alpha gadget notes", False),
        ("a.md", 4, 6, "beta gizmo notes", False),
        ("old.md", 1, 2, "obsolete turbine figures", True),
        ("AGENTS.md", 1, 2, "Studio must use bounded roots.", False),
        ("AGENTS.md", 3, 4, "Plain words of roots follow.", False),
        ("README.md", 1, 2, "Studio must not use bounded roots.", False),
        ("late.md", 7, 8, "quartz lamp", False),
    ]
    many = "; ".join(f"zzq{i} and zzr{i} and zzs{i}" for i in range(10))
    asked = ["alpha gadget; beta gizmo", "obsolete turbine", many, "bounded roots; plain words", "zzq and zzr; quartz lamp", "; ".join(f"zzq{i} and zzr{i} and zzs{i}" if i % 2 else f"zz{i}" for i in range(9))]
    two, stale, ten, torn, order, nine = packets_of(spark, chunks, asked)
    assert [(r["status"], r["evidence_count"]) for r in two["requirements"]] == [("evidence_found", 1)] * 2
    assert [(e["line_start"], e["line_end"], e["text"], e["requirements"]) for e in two["evidence"]] == [(1, 6, "alpha gadget notes\nbeta gizmo notes", [0, 1])]
    assert [(r["status"], r["stop_reason"], r["evidence_count"]) for r in stale["requirements"]] == [("unknown", "unknown", 0)]
    assert stale["status"] == "unknown" and stale["empty_result"] == "only_stale_spans" and len(stale["evidence"]) == 1
    texts = [r["text"] for r in ten["requirements"]]
    assert texts == ["zzq0", "zzr0", "zzs0", *[f"zzq{i} and zzr{i} and zzs{i}" for i in range(1, 10)]]
    assert [r["stop_reason"] for r in ten["requirements"]] == ["unknown"] * 3 + ["max_leaves"] * 9
    assert [r["leaf_no"] for r in ten["requirements"]] == list(range(12))
    by = {(e["path"], e["line_start"]): e for e in torn["evidence"]}
    assert by["AGENTS.md", 1]["disagreeing"] and by["README.md", 1]["disagreeing"] and by["AGENTS.md", 1]["line_end"] == 2
    assert torn["status"] == "disagreement"
    assert [(r["text"], r["status"]) for r in order["requirements"]] == [("zzq", "unknown"), ("zzr", "unknown"), ("quartz lamp", "evidence_found")]
    assert order["evidence"][0]["requirements"] == [2]
    assert [r["text"] for r in nine["requirements"]] == ["zz0", "zzq1", "zzr1", "zzs1", "zz2", "zzq3", "zzr3", "zz4", "zzq5 and zzr5 and zzs5", "zz6", "zzq7 and zzr7 and zzs7", "zz8"]
    assert [r["text"] for r in nine["requirements"] if r["stop_reason"] == "max_leaves"] == ["zzr3", "zzq5 and zzr5 and zzs5", "zzq7 and zzr7 and zzs7"]


def brute_merge(rows, most=2):
    """One request's hits, dicts by position: islands of lines within a file, then copies and quotas."""
    plain, islands = [r for r in rows if not r["disagreeing"]], []
    for file in {(r["project_id"], r["path"]) for r in plain}:
        mine = sorted((r for r in plain if (r["project_id"], r["path"]) == file), key=lambda r: (r["line_start"], r["position"]))
        groups = []
        for r in mine:
            g = groups[-1] if groups else None
            if g and g[0]["stale"] == r["stale"] and r["line_start"] <= max(x["line_end"] for x in g) + 1 and len(text_of(g)) + len(r["text"]) <= packet.MERGE_CHARS:
                g.append(r)
            else:
                groups.append([r])
        islands += groups
    kept = []
    for g in sorted(islands, key=lambda g: g[0]["position"]):
        same = [k for k in kept if (k[0]["project_id"], k[0]["path"]) == (g[0]["project_id"], g[0]["path"])]
        copy = len(g) == 1 and any(k[0]["chunk_hash"] == g[0]["chunk_hash"] for k in kept)
        if not copy and len(same) < most:
            kept.append(g)
    out = [[r] for r in rows if r["disagreeing"]] + kept
    return [(i + 1, g[0]["path"], g[0]["line_start"], max(x["line_end"] for x in g), text_of(g), sorted({q for x in g for q in x["requirements"]}), min(x["rank"] for x in g), len(g)) for i, g in enumerate(out)]


def text_of(group):
    text, reach = "", -1
    for r in group:
        if r["line_end"] > reach:
            text, reach = (text.rstrip("\n") + "\n" if text else "") + r["text"], r["line_end"]
    return text


def test_merge_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for request in range(60):
        for position in range(1, rng.randint(1, 14)):
            start = rng.randint(1, 12)
            rows.append({"request_id": request, "project_id": rng.choice("pq"), "path": rng.choice("ab"), "line_start": start, "line_end": start + rng.randint(0, 4), "text": rng.choice("xyz") * rng.choice([3, 700, 1500]), "stale": rng.random() < 0.2, "rank": float(rng.randint(-9, 0)), "match_pass": 0, "chunk_hash": rng.choice("hijk"), "disagreeing": rng.random() < 0.1, "requirements": [rng.randint(0, 3)], "position": position})
    hits = spark.createDataFrame(rows, "request_id long, project_id string, path string, line_start int, line_end int, text string, stale boolean, rank double, match_pass int, chunk_hash string, disagreeing boolean, requirements array<int>, position int")
    got = {}
    for r in packet.merge(hits).orderBy("request_id", "position").collect():
        got.setdefault(r["request_id"], []).append((r["position"], r["path"], r["line_start"], r["line_end"], r["text"], r["requirements"], r["rank"], r["merged"]))
    assert got == {i: brute_merge([r for r in rows if r["request_id"] == i]) for i in {r["request_id"] for r in rows}}
    assert packet.merge(hits.limit(0)).count() == 0
