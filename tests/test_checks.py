"""Typed questions in one call, on small ledgers."""

import json

import pytest
from pyspark.sql import functions as F

from evidex.operators import checks, evidence, packet, search
from evidex.sources.store import kept

TEXTS = {
    1: ("spec.md", "Decision: export the preview at\n24 fps for all clips.\nDo not upload previews to public buckets."),
    2: ("render.md", "We evaluated Arnold, and chose Blender Cycles for the final render."),
    3: ("limits.md", "The upload size limit is 12,000 bytes. Release tag is v2.4 for uploads."),
    4: ("old.md", "Preview export must run at 30 fps."),
}


@pytest.fixture(scope="module")
def answers(spark, tmp_path_factory):
    chunks = spark.createDataFrame([(i, "p", p, 10, i != 9, i == 4, x) for i, (p, x) in TEXTS.items()] + [(i, "p", f"f{i}.md", 1, True, False, "filler words only") for i in range(20, 40)], "chunk_id long, project_id string, path string, line_start int, current boolean, stale boolean, text string")
    asked = checks.questions(spark, {
        1: [{"id": "a", "type": "claim", "text": "Preview export is 24 fps"}, {"id": "b", "type": "claim", "text": "Upload previews to public buckets"}, {"id": "c", "type": "claim", "text": "Audio mixes use Dolby Atmos"}],
        2: [{"id": "a", "type": "choice", "text": "Which renderer makes the final render?", "options": ["Cycles", "Arnold"], "aliases": {"Cycles": ["Blender Cycles"]}}, {"id": "b", "type": "value", "text": "What is the upload size limit?", "unit": "bytes"}, {"id": "c", "type": "value", "text": "Which release tag do uploads have?", "pattern": r"\b(v\d+\.\d+)\b"}],
    })
    scope = spark.createDataFrame([(1, "p", 0), (2, "p", 0)], "request_id long, project_id string, priority int")
    path = str(tmp_path_factory.mktemp("checks") / "index")
    search.write_index(chunks, path)
    spans = checks.spans_for(asked, search.read_index(spark, path), chunks, scope)
    validated = spark.createDataFrame([("p", "the upload size limit is 12,000 bytes")], "project_id string, normalized_text string")
    return asked, kept(checks.answer(asked, spans, validated), "answers")


def test_answers_of_a_call(answers):
    got = {(r["request_id"], r["question_id"]): r for r in answers[1].collect()}
    assert {k: (r["answer"], r["value"]) for k, r in got.items()} == {(1, "a"): ("supported", "true"), (1, "b"): ("contradicted", "false"), (1, "c"): ("unknown", None), (2, "a"): ("selected", "Cycles"), (2, "b"): ("found", "12000"), (2, "c"): ("found", "v2.4")}
    # a wrapped sentence has the lines it spans; a stale file is no evidence
    assert [(e["path"], e["first_line"], e["last_line"]) for e in got[1, "a"]["evidence"]] == [("spec.md", 10, 11)]
    assert got[1, "b"]["counter_evidence"][0]["path"] == "spec.md" and not got[1, "c"]["evidence"]
    assert {k: r["basis"] for k, r in got.items() if r["basis"] != "lexical"} == {(2, "b"): "validated"}


def test_hash_run_record_and_budget(spark, answers):
    done = checks.results(*answers)
    again = {r["request_id"]: r["check_hash"] for r in checks.results(*answers).collect()}
    assert {r["request_id"]: r["check_hash"] for r in done.collect()} == again and len(set(again.values())) == 2
    runs = spark.createDataFrame([("r0", "p", "me", 1)], "run_id string, project_id string, agent string, created_at long")
    calls = spark.createDataFrame([(1, "r1", "p", "me", 2), (2, "r2", "p", "you", 3)], "request_id long, run_id string, project_id string, agent string, created_at long")
    got = {r["run_id"]: (r["packet_hash"], r["remaining_budget"]) for r in checks.record(done, runs, calls).collect()}
    assert got == {"r1": (again[1], 6), "r2": (again[2], 7)}


def test_fitting_sheds_in_order(answers):
    sizes = {}
    for budget in (100_000, 1200, 700, 400, 256):
        for r in checks.fit(answers[1], budget).collect():
            body = json.loads(r["packet_json"])
            assert r["n_bytes"] == body["byte_count"] == len(r["packet_json"].encode()) <= budget
            sizes[budget, r["request_id"]] = body
    assert sizes[100_000, 1]["status"] == "ok" and sizes[100_000, 1]["omitted_count"] == 0
    small = sizes[700, 2]
    assert small["status"] == "insufficient_budget" and small["omitted_count"] > 0
    assert [a["answer"] for a in small["answers"]] == ["selected", "found", "found"]


def test_explanation_marks_moved_files(spark, answers):
    items = answers[1].select("request_id", "question_id", F.explode("evidence").alias("e")).select("request_id", "question_id", F.lit("p").alias("project_id"), "e.path", "e.chunk_id", F.lit("h1").alias("source_hash"))
    sources = spark.createDataFrame([("p", "spec.md", "h1", True), ("p", "render.md", "h2", True), ("p", "limits.md", "h1", False)], "project_id string, path string, current_hash string, active boolean")
    got = {r["path"]: r["stale"] for r in checks.explain(items, sources).collect()}
    assert got == {"spec.md": False, "render.md": True, "limits.md": True}
    assert checks.explain(items, sources, spark.createDataFrame([("q",)], "project_id string")).count() == 0


def test_values_are_written_one_way(spark):
    rows = spark.createDataFrame([(1, "a.md", "The size limit of uploads is 3.50 units"), (1, "b.md", "The size limit of uploads is 3.5 units"), (2, "a.md", "The size limit of uploads is 1,200 units")], "request_id long, path string, sentence string")
    asked = spark.createDataFrame([(1, "What size limit do uploads have?", "units", None), (2, "What size limit do uploads have?", "units", None), (3, "What size limit do uploads have?", None, "(x)")], "request_id long, question string, unit string, pattern string")
    got = {r["request_id"]: (r["answer"], r["text_value"]) for r in evidence.check_values(asked, rows).collect()}
    assert got == {1: ("found", "3.5"), 2: ("found", "1200"), 3: ("unknown", None)}
