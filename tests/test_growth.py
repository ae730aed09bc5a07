"""What must not grow faster than the input: where rows are dealt, joined and written."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from evidex.operators import checks, evidence, ingest, packet, search
from evidex.plans import store_queries
from evidex.sources.store import Store

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_and_hashes_are_not_broadcast(spark):
    for name in ("v4_version_actions", "a9_ingest_counters"):
        assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, SMALL))


def test_pairs_count_at_their_first_shared_word(spark):
    """Sentences that share four words are one pair, met by a merge join."""
    rows = [(1, 1, "a", "Parcels must ship quickly today."), (1, 2, "b", "Parcels must not ship quickly today."), (1, 3, "b", "Invoices must not wait."), (2, 4, "a", "Parcels must ship quickly today.")]
    found = evidence.conflicts(spark.createDataFrame(rows, "request_id long, chunk_id long, path string, text string"))
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1, len(rows[0][3]) + len(rows[1][3]))]
    assert "BroadcastHashJoin" not in plan(found)


def test_lines_are_dealt_before_they_are_aggregated(spark):
    """One exchange, right above the scan: no task sorts a whole split of lineitem."""
    for name in ("r21_requirement_status", "r15_across_leaves"):
        found = plan(entry.queries()[name](spark, SMALL))
        assert found.count("Exchange") == 1 and "Aggregate" not in found[found.index("Exchange") :]


def test_spans_are_joined_by_sizes_alone(spark):
    rows = [(1, "p", "f", n, n + n % 3, "x" * (300 + 97 * n % 900), n % 7 == 0, 0.0, 0, f"h{n % 5}", n % 6 == 5, n) for n in range(1, 25)]
    hits = spark.createDataFrame(rows, "request_id long, project_id string, path string, line_start int, line_end int, text string, stale boolean, rank double, match_pass int, chunk_hash string, disagreeing boolean, position int")
    sized = hits.withColumn("size", F.length("text")).drop("text")
    got = lambda df, size: sorted(tuple(r) for r in packet.merge(df, 9).select("position", "line_end", "merged", size).collect())
    assert got(sized, F.col("size")) == got(hits, F.length("text")) and any(r[2] > 1 for r in got(sized, F.col("size")))


def test_only_kinds_that_are_asked_for_are_evaluated(spark, monkeypatch):
    written = []
    monkeypatch.setattr(checks, "kept", lambda df, name, f=checks.kept: written.append(name) or f(df, name))
    assert store_queries.one_call(spark, SMALL).count() > 0
    assert written == ["items-claim", "verdicts"]


def test_ingest_plans_without_texts_and_writes_chunks_and_postings_once(spark, tmp_path, monkeypatch):
    written = {}
    monkeypatch.setattr(ingest, "kept", lambda df, name, f=ingest.kept: written.update({name: df.columns}) or f(df, name))
    store = Store(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("a.md", "Parcels must ship.", "h1", 1, 0), ("a.md", "Parcels must ship soon.", "h2", 1, 0), ("b.md", None, None, 0, 0), ("c.md", "Same.", "h3", 1, 0), ("c.md", "Same.", "h3", 1, 0)], "path string, text string, content_hash string, size long, mtime long")
    assert ingest.ingest(store, "p", files)["version"] == 1
    assert "planned" in written and not {"chunks", "postings"} & set(written) and not any("text" in c for n, c in written.items() if n != "claims")
    assert sorted((r["path"], r["text"]) for r in store.read("chunks").collect()) == [("a.md", "Parcels must ship soon."), ("c.md", "Same.")]
    assert store.read("postings").select("chunk_id").distinct().count() == 2


def documents(n: int):
    return [(i, f"p{i % 3}", f"a/{i}.md", f"alpha beta gamma{i % 7} the end of line{i % 11} alpha betamax") for i in range(n)]


def shuffled(df) -> list[str]:
    """The operators whose rows move by chunk or by term in what is run."""
    return [x for x in plan(df).split("\n") if "Exchange hashpartitioning(chunk_id" in x or "Exchange hashpartitioning(term" in x]


def test_postings_stay_where_they_are_in_a_prefix_pass(spark, tmp_path, monkeypatch):
    """Hits of whole words and of phrases are gathered where a chunk's postings lie, and move once, a row a chunk."""
    chunks = spark.createDataFrame(documents(90), "chunk_id long, project_id string, path string, text string")
    search.write_index(chunks, str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    moved = {}
    monkeypatch.setattr(search, "kept", lambda df, name, f=search.kept: moved.update({name: (shuffled(df), df.columns)}) or f(df, name))
    asked = spark.createDataFrame([(1, ["alph", "beta_gam", "the_e", "line1"]), (2, ["alpha_beta", "end.of.lin"])], "request_id long, terms array<string>")
    got = {(r["request_id"], r["chunk_id"]): r["matched"] for r in search.prefix_scored(asked, index).collect()}
    assert got == {(1, i): 3 + (i % 11 in (1, 10)) for i in range(90)} | {(2, i): 1 for i in range(90)}
    assert moved["prefixes"] == ([], ["chunk_id", "project_id", "length", "keys", "fs"])


def test_phrases_are_numbers_and_broadcasts_have_a_bound(spark, tmp_path, monkeypatch):
    """What grows with the index has no text of a phrase in it, and is broadcast up to a number of rows, not of a file's bytes."""
    chunks = spark.createDataFrame(documents(60), "chunk_id long, project_id string, path string, text string")
    index = search.build(chunks)
    whole = "alpha_beta_gamma3_the_end_of_line5"
    each = search.phrases(spark.createDataFrame([(1, [whole, "the_end"])], "request_id long, terms array<string>"))
    written = {}
    monkeypatch.setattr(search, "kept", lambda df, name, f=search.kept: written.update({name: df.columns}) or f(df, name))
    found = search.phrase_hits(search.words_of(each), index.postings, index.vocabulary)
    want = sorted([(" ".join(["the", "end"]), i) for i in range(60)] + [(each.filter(F.size("phrase") > 2).first()["key"], i) for i in range(60) if i % 7 == 3 and i % 11 == 5])
    rows = lambda df: sorted((r["key"], r["chunk_id"]) for r in df.select("key", "chunk_id").collect())
    assert rows(found) == want and len(want) > 60
    assert all("key" not in written[x] and "no" in written[x] for x in ("pairs", "probes"))
    monkeypatch.setattr(search, "TOLD", 0)
    none = search.phrase_hits(search.words_of(each), index.postings, index.vocabulary)
    assert "BroadcastHashJoin" not in plan(none) and rows(none) == want


def test_places_come_to_hits_and_are_folded_once(spark, monkeypatch):
    """Hits are not sorted to meet their places, and a place is folded before its terms are looked for in it."""
    plans = {}
    monkeypatch.setattr(search, "kept", lambda df, name, f=search.kept: plans.update({name: plan(df)}) or f(df, name))
    assert entry.queries()["r12_term_coverage"](spark, SMALL).count() > 0
    assert "ShuffledHashJoin" in plans["coverage"] and "SortMergeJoin" not in plans["coverage"]
    hits = spark.createDataFrame([(1, ["a", "strasse", "c", "d"], "A Straße", "x/c.txt")], "request_id long, terms array<string>, heading string, path string").repartition(2)
    folded = hits.select(search.coverage(F.col("terms"), F.col("heading"), F.col("path")).alias("n"))
    assert "contains(replace(" not in folded._jdf.queryExecution().optimizedPlan().toString() and folded.first()["n"] == 3
