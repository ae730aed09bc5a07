"""The ledger engine on small corpora, and its queries against SQL."""

import io
import math
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from evidex.functions import porter
from evidex.functions import text as t
from evidex.operators import evidence, graph, ledger, packet, search, session
from evidex.plans import registry
from evidex.sources import files
from evidex.streaming import watch

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_request_tokens(spark):
    assert one(spark, t.request_tokens(F.lit("What is the Export_settings for v1.2-beta? Export_settings fps. généralement"))) == ["export_settings", "v1.2-beta", "fps.", "ralement"]


def test_uuid5(spark):
    assert one(spark, t.uuid5(t.NODE_NAMESPACE, F.lit("p:k:n"))) == "52734346-e90e-5345-8735-ef010a6ed98f"


@pytest.mark.parametrize("word, stem", [("render", "render"), ("rendering", "render"), ("settings", "set"), ("ponies", "poni"), ("relational", "relat"), ("universities", "univers"), ("café", "cafe"), ("exported", "export")])
def test_porter(word, stem):
    assert porter.porter(porter.fold(word)) == stem


def test_ladder_prefers_full_matches(spark):
    chunks = spark.createDataFrame([(1, "p", "policy.md", 1, True, "blue widgets policy"), (2, "p", "other.md", 1, True, "blue blue blue"), (3, "p", "old.md", 1, False, "blue widgets policy"), (4, "q", "away.md", 1, True, "blue widgets policy")] + [(i, "p", f"f{i}.md", 1, True, "filler words") for i in range(10, 30)], "chunk_id long, project_id string, path string, line_start int, current boolean, text string")
    asked = spark.createDataFrame([(1, "blue widgets policy")], "request_id long, text string")
    scope = spark.createDataFrame([(1, "p", 0)], "request_id long, project_id string, priority int")
    out = search.search(asked, chunks, scope).orderBy("position").collect()
    assert [(r["chunk_id"], r["match_pass"]) for r in out] == [(1, 0), (2, 2)]


def test_chunker():
    text = "# Top\nintro line\n\n## Next\n" + "x" * 1590 + "\nlast line\n" + "y" * 4000
    cut = packet.cut_lines(text)
    assert [(c[1], c[2], c[3]) for c in cut] == [(1, 3, "Top"), (4, 5, "Next"), (6, 6, "Next"), (7, 7, "Next")]
    assert packet.cut_lines("") == [] and packet.cut_lines("a\r\nb")[0][4] == "a\nb"


def test_requirements():
    assert packet.requirements("what color are the widgets; do not register Documents as a root") == ["what color are the widgets", "do not register Documents as a root"]
    assert len(packet.requirements("; ".join(f"clause number {i}" for i in range(20)))) == 12
    assert packet.requirements("  ") == []


def test_merge_folds(spark):
    rows = [(1, "p", "a.md", 1, 2, "one", False, -2.0, 0, "h1", False, 1), (1, "p", "a.md", 3, 4, "two", False, -3.0, 1, "h2", False, 2), (1, "p", "b.md", 9, 9, "copy", False, -1.0, 0, "h3", False, 3), (1, "p", "c.md", 9, 9, "copy", False, -1.0, 0, "h3", False, 4), (1, "p", "a.md", 20, 20, "x", False, -1.0, 0, "h4", False, 5), (1, "p", "a.md", 30, 30, "y", False, -1.0, 0, "h5", False, 6)]
    hits = spark.createDataFrame(rows, "request_id long, project_id string, path string, line_start int, line_end int, text string, stale boolean, rank double, match_pass int, chunk_hash string, disagreeing boolean, position int")
    out = packet.merge(hits).orderBy("position").collect()
    assert [(r["path"], r["line_start"], r["line_end"], r["merged"]) for r in out] == [("a.md", 1, 4, 2), ("b.md", 9, 9, 1), ("a.md", 20, 20, 1)]
    assert out[0]["text"] == "one\ntwo" and out[0]["rank"] == -3.0


def test_disagreement_needs_topic_and_path(spark):
    rows = [(1, 1, "AGENTS.md", "Studio must use bounded roots."), (1, 2, "README.md", "Studio must not use bounded roots."), (2, 3, "rules.md", "Do not commit secrets to widgets config."), (2, 4, "spec.md", "widgets must be blue"), (3, 5, "a.md", "Studio must use bounded roots. Studio must not use bounded roots.")]
    out = evidence.disagreements(spark.createDataFrame(rows, "request_id long, chunk_id long, path string, text string")).collect()
    assert [tuple(r) for r in out] == [(1, 2, 1)]


def test_claim_checks(spark):
    spec = "Decision: export the preview at 24 fps.\nDo not upload previews to public buckets."
    asked = {1: "Preview export is 24 fps", 2: "Upload previews to public buckets", 3: "Audio mixes use Dolby Atmos", 4: "Preview export is 30 fps"}
    spans = spark.createDataFrame([(i, 1, "spec.md", spec) for i in asked], "request_id long, chunk_id long, path string, text string")
    out = evidence.check_claims(spark.createDataFrame(list(asked.items()), "request_id long, claim string"), evidence.evidence_sentences(spans)).collect()
    assert {r["request_id"]: r["answer"] for r in out} == {1: "supported", 2: "contradicted", 3: "unknown", 4: "contradicted"}


def test_choice_and_value_checks(spark):
    spans = spark.createDataFrame([(1, 1, "a.md", "Decision: we evaluated Arnold and chose Cycles for the final render."), (2, 1, "a.md", "Preview export runs at 24 fps."), (2, 2, "b.md", "Preview export runs at 30 fps."), (3, 1, "a.md", "The upload size limit is 12,000 bytes"), (4, 1, "a.md", "Was Cycles chosen for the render?")], "request_id long, chunk_id long, path string, text string")
    sentences = evidence.evidence_sentences(spans)
    choices = spark.createDataFrame([(1, "Which renderer makes the final render?", ["Cycles", "Arnold"]), (4, "Which renderer makes the render?", ["Cycles", "Arnold"])], "request_id long, question string, options array<string>")
    assert {r["request_id"]: (r["answer"], r["chosen"]) for r in evidence.check_choices(choices, sentences).collect()} == {1: ("selected", "Cycles"), 4: ("unknown", None)}
    values = spark.createDataFrame([(2, "What preview export rate?", "fps"), (3, "What is the upload size limit?", "bytes")], "request_id long, question string, unit string")
    assert {r["request_id"]: (r["answer"], r["value"]) for r in evidence.check_values(values, sentences).collect()} == {2: ("disagreement", None), 3: ("found", 12000.0)}


def test_files(spark, tmp_path):
    root = tmp_path / "root"
    for name, body in {"app/AGENTS.md": b"# Agents", "app/sub/package.json": b"{}", "app/node_modules/x.md": b"x", "app/app.min.js": b"x", "app/id_rsa": b"A=1", "app/bin.md": b"a\0b", "app/key.md": b"api_key = abcdefgh1234", "app/latin.txt": "un caf\xe9".encode("cp1252"), "app/my password.txt": b"x", "app/API Key.md": b"x", "app/wide.txt": "wide \u03b1".encode("utf-16"), "lib/pyproject.toml": b"[x]"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (root / "app/note.docx").write_bytes(doc.getvalue())
    got = {r["relative_path"]: r["text"] for r in files.read_sources(spark, str(root)).collect()}
    assert got == {"app/AGENTS.md": "# Agents", "app/sub/package.json": "{}", "app/latin.txt": "un café", "lib/pyproject.toml": "[x]", "app/note.docx": "One\t\n\nTwo"}
    reasons = {r["reason"]: r["files"] for r in files.coverage(files.classify(files.list_files(spark, str(root)))).collect()}
    assert reasons["ignored_dir"] == 1 and reasons["generated"] == 1 and reasons["sensitive_name"] == 3
    assert {r["project"] for r in files.discover_projects(files.list_files(spark, str(root))).collect()} == {"app", "lib"}
    heads = watch.listing(spark, str(root)).withColumn("active", F.lit(True)).filter("path <> 'lib/pyproject.toml'").withColumn("size", F.when(F.col("path") == "app/AGENTS.md", 1).otherwise(F.col("size")))
    versions, states = watch.ingest_once(spark, str(root), heads)
    assert {r["relative_path"] for r in versions.collect()} == {"app/AGENTS.md", "lib/pyproject.toml"}
    assert ledger.use_decision(states, True) == "targeted_refresh" and ledger.use_decision(states, False) == "initial_ingest"


def test_packet_hash_ignores_run_fields():
    packet_ = {"query": "é", "evidence": [{"text": "x" * 900, "disagreeing": False, "path": "a"}, {"text": "y", "disagreeing": True, "path": "b"}], "run": {"id": 1}}
    assert packet.packet_hash(packet_) == packet.packet_hash(packet_ | {"run": {"id": 2}, "cache": {}})


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, con):
    out = registry.queries()[name](spark, SF)
    rows = out.collect()
    if name in registry.oracle_sql():
        cur = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(out.columns)
        show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
        assert sorted(tuple(show(r[n]) for n in names) for r in rows) == sorted(tuple(map(show, r)) for r in cur.fetchall())


def test_store_swaps_all_tables_at_once(spark, tmp_path):
    from evidex.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    assert store.commit(replace={"a": spark.range(3), "b": spark.range(1)}) == 1
    held = store.read("a")
    assert store.commit(replace={"b": spark.range(5)}, append={"a": spark.range(2)}) == 2
    assert (held.count(), store.read("a").count(), store.read("b").count()) == (3, 5, 5)


def test_guards():
    from evidex.operators import identity

    reasons = {p: identity.refuse_root(p, "/home/me") for p in ("/", "/home", "/home/me", "/home/me/Documents", "/home/me/.config", "/etc/x", "/home/me/work")}
    assert list(reasons.values()) == ["filesystem_root", "profile", "profile", "personal_folder", "hidden_profile_folder", "system_folder", None]


def test_packets_report_conflicts(spark):
    from evidex.operators import session

    rows = [(1, "p", "AGENTS.md", "Studio must use bounded roots."), (2, "p", "README.md", "Studio must not use bounded roots."), (3, "p", "other.md", "Nothing of interest to anyone in this file.")] + [(i, "p", f"f{i}.md", "filler line") for i in range(10, 20)]
    chunks = spark.createDataFrame([(i, p, path, text) for i, p, path, text in rows], "chunk_id long, project_id string, path string, text string").select("*", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(None).cast("string").alias("heading"), F.sha2("text", 256).alias("chunk_hash"), F.lit(True).alias("current"), F.lit(False).alias("stale"))
    requests = spark.createDataFrame([(1, "bounded roots"), (2, "absent thing entirely")], "request_id long, text string")
    scope = spark.createDataFrame([(1, "p", 0), (2, "p", 0)], "request_id long, project_id string, priority int")
    out = {r["request_id"]: r for r in session.packets(requests, chunks, scope).collect()}
    assert out[1]["status"] == "disagreement" and {e["path"] for e in out[1]["evidence"]} == {"AGENTS.md", "README.md"}
    assert out[2]["status"] == "unknown" and out[2]["empty_result"] == "no_matching_spans"
    again = {r["request_id"]: r["packet_hash"] for r in session.packets(requests.repartition(3), chunks.repartition(5), scope).collect()}
    assert again == {k: r["packet_hash"] for k, r in out.items()}


def test_wrapped_lines_join():
    from evidex.functions.lines import sentences

    assert sentences("The export runs\nat 24 fps. It is final.\n- item one\n- item two\n\n| a | b |", 3) == [(3, 4, "The export runs at 24 fps."), (3, 4, "It is final."), (5, 5, "item one"), (6, 6, "item two"), (8, 8, "| a | b |")]


def test_questions_are_validated():
    good = evidence.validated_questions([{"type": "choice", "text": "Which?", "options": ["A", "B"], "aliases": {"A": ["first"]}}, {"type": "value", "text": "How many?", "unit": "fps"}])
    assert [q["id"] for q in good] == ["q1", "q2"] and evidence.retrieval_text(good[0]) == "Which? A first B"
    for bad in ([], [{"type": "claim", "text": ""}], [{"type": "claim", "text": "x", "unit": "y"}], [{"type": "choice", "text": "x", "options": ["a", "A"]}], [{"type": "value", "text": "x", "pattern": "(a+)+"}]):
        with pytest.raises(ValueError):
            evidence.validated_questions(bad)


def test_pointers_keep_only_what_is_lost(spark):
    chunks = spark.createDataFrame([(1, "a", "h", 1, 2, "x\ny"), (2, "a", "old", 1, 1, "x")], "chunk_id long, path string, content_hash string, line_start int, line_end int, text string")
    live = spark.createDataFrame([("a", "h", "x\ny\nz")], "path string, content_hash string, text string")
    assert {r["chunk_id"]: r["text"] for r in ledger.pointers(chunks, live).collect()} == {1: "", 2: "x"}


def test_groups_of_long_chains(spark):
    chain = spark.range(1, 1000).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(5000, 5001), (5001, 5001)], "a long, b long"))
    got = {r["node"]: r["root"] for r in ledger.group_projects(chain).collect()}
    assert got == {i: 1 for i in range(1, 1001)} | {5000: 5000, 5001: 5000}
    assert ledger.group_projects(chain.limit(0)).count() == 0


def test_cleanup_plan(spark):
    schema = "project_id string, canonical_key string, kind string, display_name string, path string, path_exists boolean, root_commit string, worktree boolean, validations int, ledger_claims int, corpus_version int, active_sources int, runs int, created_at string"
    rows = [("a", "git:x", "git", "app", "/w/app", True, "c1", False, 0, 0, 1, 3, 2, "1"), ("b", "directory-path:y", "directory", "app", "/w/app", True, "c1", False, 0, 0, 1, 3, 2, "2"), ("c", "git:z", "git", "lib", "/w/lib", True, "c1", False, 1, 0, 1, 3, 2, "1"), ("d", "git:q", "git", "lib", "/w/lib", True, "c2", False, 0, 0, 1, 3, 2, "1"), ("e", "directory-path:e", "directory", "tmp-1", "/tmp/e", False, None, False, 0, 0, 0, 0, 0, "1"), ("f", "directory-path:f", "directory", "keep", "/w/f", False, None, False, 2, 0, 1, 1, 1, "1"), ("g", "directory-path:g", "directory", "good", "/w/g", True, None, None, 0, 0, 1, 1, 1, "1")]
    keys = spark.createDataFrame([(r[0], r[4]) for r in rows], "project_id string, key string")
    got = {r["project_id"]: (r["action"], r["survivor_id"], r["reasons"]) for r in ledger.cleanup_plan(spark.createDataFrame(rows, schema), keys, ["/tmp"]).collect()}
    assert got == {"a": ("keep", None, []), "b": ("merge", "a", []), "c": ("keep", None, []), "d": ("review", "c", []), "e": ("prune", None, ["path_missing", "temp_folder", "scratch_name", "empty"]), "f": ("review", None, ["path_missing"]), "g": ("keep", None, [])}


def test_validations_attach_both_ways(spark):
    answers = spark.createDataFrame([(1, "p", "must ship within two days"), (2, "p", "We agreed: the parcel must ship within two days, always"), (3, "p", "must ship"), (4, "q", "must ship within two days"), (5, "p", "parcels wait"), (6, "p", "")], "request_id long, project_id string, sentence string")
    claims = spark.createDataFrame([("p", "the parcel must ship within two days"), ("p", ""), ("q", None)], "project_id string, normalized_text string")
    got = {r["request_id"]: r["basis"] for r in session.attach_validations(answers, claims).collect()}
    assert got == {1: "validated", 2: "validated", 3: "validated", 4: "lexical", 5: "lexical", 6: "lexical"}


def test_graph_matches_anywhere_in_a_name(spark):
    nodes = spark.createDataFrame([("p", 1, "symbol", "exporter", "observed"), ("p", 2, "symbol", "my_export_settings", "verified"), ("p", 3, "topic", "other", "observed"), ("p", 4, "symbol", "export", "observed"), ("p", 5, "project", "export", "observed")], "project_id string, node_id long, kind string, name string, trust string")
    asked = spark.createDataFrame([(1, ["export"]), (2, [])], "request_id long, terms array<string>")
    scope = spark.createDataFrame([(1, "p"), (2, "p")], "request_id long, project_id string")
    got = [(r["node_id"], r["score"]) for r in graph.matches(asked, nodes, scope, nodes.filter("node_id <> 1")).orderBy("position").collect()]
    assert got == [(2, 1), (4, 3)]


def test_texts_that_hold_others_meet_on_their_rarest_stretch(spark, capsys):
    texts = [f"customer {i:05d} must pay in building" for i in range(0, 60, 7)] + ["must pay", "pay", "a", "", "customer 00014 must", "must pay in buildings", "éé", None]
    wide = ["every " + x + " by noon" for x in texts if x] + texts
    rows = lambda xs, c: spark.createDataFrame([(p, x) for p in ("p", "q", None) for x in (xs if p != "q" else xs[:5])], f"project_id string, {c} string")
    held = session.holding(rows(texts, "inner"), rows(wide, "outer"), "project_id")
    got = sorted(tuple(r) for r in held.collect())
    assert got == sorted((p, x, y) for p, xs, ys in (("p", texts, wide), ("q", texts[:5], wide[:5])) for x in {*xs} - {"", None} for y in {*ys} - {None} if x in y)
    held.explain()
    assert capsys.readouterr().out.count("SortMergeJoin") >= 4  # stretches are never broadcast, whatever their texts' size


def test_requests_alike_are_looked_up_once(spark):
    nodes = spark.createDataFrame([(p, 10 * k + i, "topic", f"{w} {i}", "observed") for k, p in enumerate("pq") for i, w in enumerate(["export", "export", "import"])], "project_id string, node_id long, kind string, name string, trust string")
    asked = spark.createDataFrame([(i, ["export"] if i % 2 else ["import"], i % 3) for i in range(1, 31)], "request_id long, terms array<string>, scope_id int")
    scope = spark.createDataFrame([(0, "p"), (1, "p"), (1, "q"), (2, "q")], "scope_id int, project_id string")
    each = asked.join(scope, "scope_id").select("request_id", "project_id")
    assert graph.alike(asked, scope, 8)[0].count() == graph.alike(asked.drop("scope_id"), each, 8)[0].count() == 6
    rows = lambda df: sorted(map(tuple, df.collect()))
    both = rows(graph.matches(asked, nodes, scope, nodes))
    assert both == rows(graph.matches(asked.drop("scope_id"), nodes, each, nodes))
    alone = [r for i in range(1, 7) for r in rows(graph.matches(asked.filter(f"request_id = {i}"), nodes, scope, nodes))]
    assert [r for r in both if r[0] <= 6] == alone and len({r[0] for r in both}) == 30


def test_claims_of_requests_alike(spark):
    claims = spark.createDataFrame([(p, f"{p}{i}", f"must pay {i % 3} fee", "proposed" if i % 2 else "observed", i) for p in "pq" for i in range(40)], "project_id string, claim_id string, normalized_text string, trust_state string, created_at long")
    asked = spark.createDataFrame([(i, [["pay", "fee"], ["1"], []][i % 3]) for i in range(12)], "request_id long, terms array<string>")
    scope = spark.createDataFrame([(i, p) for i in range(12) for p in ("pq" if i % 2 else "q")], "request_id long, project_id string")
    got = {}
    for r in graph.ledger_claims(asked, claims, scope).orderBy("request_id", "position").collect():
        got.setdefault(r["request_id"], []).append(r["claim_id"])
    assert graph.alike(asked, scope, 6)[0].count() == 4
    assert got[0] == got[6] == ["q39", "q37", "q35", "q33"] and got[3] == got[9] == ["p39", "q39", "p37", "q37"]
    assert got[4] == ["q37", "q31", "q25", "q19"] and sorted(got) == [0, 1, 3, 4, 6, 7, 9, 10]


def test_pairs_of_one_signature_are_dealt_to_many_tasks(spark):
    """Nine signatures: without a part in the key no more than nine tasks, or one, would make all pairs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        made = registry.queries()["j14_structure_matches"](spark, "/root/testdata/sf0.01")
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_graph_matches_do_not_depend_on_a_projects_size(spark):
    """A project of 700 nodes, and one of 40: every node that holds a term is scored, as by brute force; terms of all lengths, none held, null, repeated."""
    names = [f"{w} {i} {v}" for i, (w, v) in enumerate([("ring", "export"), ("bolt", "rings"), ("éxport", "x"), ("wide part", "1")] * 185)] + ["", "ring", None]
    rows = [("large" if i >= 40 else "small", i, "project" if i % 97 == 0 else "topic", x, ["verified", "observed", "disputed"][i % 3]) for i, x in enumerate(names)]
    terms = [["ring"], ["1"], ["7 ri", "rings", "x"], ["part", "9", "wide part 3"], ["éx"], ["never here"], ["ring", "ring"], [None, "bolt"], ["export", "never"], [], [""]]
    nodes = spark.createDataFrame(rows, "project_id string, node_id long, kind string, name string, trust string").repartition(5)
    asked = spark.createDataFrame(list(enumerate(terms)), "request_id long, terms array<string>")
    seen = {i: [("large", "small"), ("large",), ("small",)][i % 3] for i in range(len(terms))}
    scope = spark.createDataFrame([(i, p) for i, ps in seen.items() for p in ps], "request_id long, project_id string")
    want = []
    for i, ts in enumerate(terms):
        if None in ts:  # a count with a null is none
            continue
        best = []
        for p, n, kind, name, trust in rows:
            if name is None or kind == "project" or p not in seen[i] or n % 7 == 0 or not ts:
                continue
            held, exact = sum(x in name for x in ts), int(name in ts)
            if exact or held >= (2 if len(ts) >= 3 else 1):
                best.append((-held - 2 * exact, ["verified", "observed", "disputed"].index(trust), kind, name, n, exact))
        shown = sorted(sorted(best)[:20], key=lambda x: (x[1], x[0], x[3], x[4]))
        want += [(i, x[4], -x[0], x[5], k) for k, x in enumerate(shown, 1)]
    found = graph.matches(asked, nodes, scope, nodes.filter("node_id % 7 <> 0"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert {r[0] for r in want} == {0, 1, 2, 3, 4, 6, 8, 10}
