"""Typed questions answered in one call: evidence, answers, validations, hash, budget, trimming, explanation.

A batch holds many calls; a call (``request_id``) holds up to a dozen questions of three kinds.  Every
question is searched like a request of its own, each kind is evaluated for the whole batch at once,
and only the finished answers of a call, a few hundred short rows, come together in one row.

Defined results: a question nothing is found for is ``unknown``; a call without questions has no row;
null texts hold no sentence; equal sentences of a file at equal lines count once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.store import kept
from . import compact, evidence, ledger, search, session

# Characters of a sentence that an answer shows, rows searched for a question, units a budget begins with.
EXCERPT_CHARS, SEARCH_LIMIT, FIRST_BUDGET = 240, 8, 8
QUESTION = "request_id long, question_id string, type string, text string, options array<string>, aliases map<string,array<string>>, unit string, pattern string"


def questions(spark, calls: dict[int, list[dict]]) -> DataFrame:
    """The questions of some calls as rows; each is validated first."""
    rows = [(call, q["id"], q["type"], q["text"], q.get("options"), q.get("aliases"), q.get("unit"), q.get("pattern")) for call, raw in calls.items() for q in evidence.validated_questions(raw)]
    return spark.createDataFrame(rows, QUESTION)


def search_texts(asked: DataFrame) -> DataFrame:
    """request_id, question_id, text: what is searched for a question: its text, and its text with all its names or its unit."""
    phrases = F.concat(F.coalesce("options", F.array().cast("array<string>")), F.coalesce(F.flatten(F.map_values("aliases")), F.array().cast("array<string>")))
    wider = F.when(F.col("type") == "choice", F.concat_ws(" ", "text", F.array_join(phrases, " "))).when(F.col("unit").isNotNull(), F.concat_ws(" ", "text", "unit"))
    return asked.select("request_id", "question_id", F.explode(F.array_compact(F.array("text", wider))).alias("text"))


def spans_for(asked: DataFrame, index: search.Index, chunks: DataFrame, scope: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """call, project_id, chunk_id, path, line_start, text of what is found for each question; call is request_id and question_id.

    chunks: chunk_id, project_id, path, line_start, current, stale, text; stale ones are no evidence."""
    texts = search_texts(asked).withColumn("request", F.concat_ws("/", F.col("request_id").cast("string"), "question_id", F.md5("text")))
    terms = texts.select(F.col("request").alias("request_id"), t.request_tokens(F.col("text")).alias("terms"))
    own = texts.select("request", "request_id").join(scope, "request_id").select(F.col("request").alias("request_id"), "project_id", "priority")
    found = search.retrieve(terms, index, chunks.drop("text"), own, limit, strict=False).select(F.col("request_id").alias("request"), "chunk_id")
    call = texts.select("request", call_of().alias("call"))
    live = chunks.filter(~F.col("stale")).select("project_id", "chunk_id", "path", "line_start", "text")
    return kept(found.join(call, "request").select("call", "chunk_id").distinct().join(live, "chunk_id"), "spans")  # read by every kind of question


def call_of():
    return F.concat_ws("/", F.col("request_id").cast("string"), "question_id")


def answer(asked: DataFrame, spans: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """request_id, question_id, type, answer, value, basis, evidence, counter_evidence of every question.

    spans: as of ``spans_for``; validated: project_id, normalized_text of claims that someone validated."""
    called = asked.withColumn("request_key", call_of())
    kinds = sorted(r[0] for r in called.select("type").distinct().collect())  # three at most
    # dealt out first: sentences are cut by all tasks, and stay where their question is
    found = evidence.wrapped_evidence(spans.withColumnRenamed("call", "request_id").repartition("request_id"))
    rows = kept(found, "sentences") if len(kinds) > 1 else found
    of = lambda kind, **named: called.filter(F.col("type") == kind).select(F.col("request_key").alias("request_id"), *[F.col(c).alias(n) for n, c in named.items()])
    claims, choices, values = of("claim", claim="text"), of("choice", question="text", options="options", aliases="aliases"), of("value", question="text", unit="unit", pattern="pattern")
    text = lambda x: x.cast("string")
    place = ["chunk_id", "path", "first_line", "last_line", "sentence"]
    make = {
        "claim": lambda: evidence.claim_items(claims, rows).select("request_id", "supports", F.lit(None).cast("string").alias("matched"), *place),
        "choice": lambda: evidence.choice_items(choices, rows).select("request_id", "supports", F.col("option").alias("matched"), *place),
        "value": lambda: evidence.value_items(values, rows).select("request_id", F.lit(True).alias("supports"), F.col("value").alias("matched"), *place),
    }
    judge = {
        "claim": lambda x: evidence.check_claims(claims, None, x).select("request_id", "answer", text(F.when(F.col("answer") == "supported", True).when(F.col("answer") == "contradicted", False)).alias("value")),
        "choice": lambda x: evidence.check_choices(choices, None, x.withColumnRenamed("matched", "option")).select("request_id", "answer", F.col("chosen").alias("value")),
        "value": lambda x: evidence.check_values(values, None, x.withColumnRenamed("matched", "value")).select("request_id", "answer", F.col("text_value").alias("value")),
    }
    # only the kinds that are asked for; what each finds is computed once, and its verdicts are counted from that
    mine = {kind: kept(make[kind](), f"items-{kind}") for kind in kinds if kind in make} or {"claim": make["claim"]()}
    items = reduce(DataFrame.unionByName, mine.values())
    verdicts = kept(reduce(DataFrame.unionByName, [judge[kind](x) for kind, x in mine.items()]), "verdicts")
    # an excluded option's evidence is what speaks against it
    sided = items.join(verdicts.select("request_id", "answer"), "request_id").withColumn("shown", F.col("supports") | (F.col("answer") == "excluded"))
    told = sided.filter((F.col("answer") != "selected") | F.col("supports"))
    item = F.struct("path", "first_line", "last_line", F.substring("sentence", 1, EXCERPT_CHARS).alias("text"), "matched", "chunk_id")
    listed = told.groupBy("request_id").agg(F.sort_array(F.collect_set(F.when(F.col("shown"), item))).alias("evidence"), F.sort_array(F.collect_set(F.when(~F.col("shown"), item))).alias("counter_evidence"))
    none = lambda c: F.coalesce(c, F.array().cast(listed.schema["evidence"].dataType))
    full = called.join(verdicts.withColumnRenamed("request_id", "request_key"), "request_key").join(listed.withColumnRenamed("request_id", "request_key"), "request_key", "left")
    if validated is None:
        basis = full.withColumn("basis", F.lit("lexical"))
    else:
        said = told.join(spans.select("chunk_id", "project_id").distinct(), "chunk_id").select("request_id", "project_id", "sentence")
        rests = session.attach_validations(said, validated).withColumnRenamed("request_id", "request_key")
        basis = full.join(rests, "request_key", "left").withColumn("basis", F.coalesce("basis", F.lit("lexical")))
    return basis.select("request_id", "question_id", "type", "answer", "value", "basis", none("evidence").alias("evidence"), none("counter_evidence").alias("counter_evidence"))


def results(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """request_id, status, body (JSON of questions and answers), check_hash: one row a call; the hash leaves out what a run adds."""
    fields = [f for f in ("question_id", "type", "text", "options", "aliases", "unit", "pattern") if f in asked.columns]
    q = asked.groupBy("request_id").agg(F.sort_array(F.collect_list(F.to_json(F.struct(*fields)))).alias("questions"))
    a = answers.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in answers.columns if c != "request_id"]))).alias("answers"))
    body = F.to_json(F.struct("questions", "answers"), {"ignoreNullFields": "false"})
    return q.join(a, "request_id").withColumn("body", body).select("request_id", F.lit("ok").alias("status"), "body", session.canonical_hash("body").alias("check_hash"))


def record(done: DataFrame, runs: DataFrame, calls: DataFrame, initial: int = FIRST_BUDGET) -> DataFrame:
    """Rows for the run log: run_id, project_id, agent, packet_hash, packet_json, created_at, remaining_budget.

    calls: request_id, run_id, project_id, agent, created_at; runs: the log so far.  A call takes one unit
    of its project's and agent's budget, which never goes below none and stops nothing."""
    new = done.join(calls, "request_id").select("run_id", "project_id", "agent", F.col("check_hash").alias("packet_hash"), F.col("body").alias("packet_json"), "created_at")
    spent = runs.select("run_id", "project_id", "agent", "created_at").unionByName(new.select("run_id", "project_id", "agent", "created_at"))
    return new.join(ledger.budgets(spent, initial), "run_id").withColumnRenamed("remaining", "remaining_budget")


def fit(answers: DataFrame, budget: int = 4000) -> DataFrame:
    """request_id, packet_json, n_bytes: each call's answers within a number of bytes.

    Evidence is ranked: the first item of each side of each answer, then the further ones, both in the
    order of the answers; the leading ranks that fit are shown, all of them if there is room.  Up to three of
    the others are named by reference.  If a first item is not shown the status is insufficient_budget;
    if the answers do not fit even without evidence, only ids, answers and values are told, or nothing."""
    budget = max(256, budget)
    by = W.partitionBy("request_id")
    told = F.struct("question_id", "type", "answer", "value", "basis")
    listed = answers.withColumn("answer_bytes", F.octet_length(F.to_json(told)) + 60)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("items")) for i, c in enumerate(("evidence", "counter_evidence"))])
    each = listed.select("request_id", "question_id", F.sum("answer_bytes").over(by).alias("answer_bytes"), F.explode(sides).alias("s"))
    each = each.select("request_id", "question_id", "answer_bytes", "s.side", F.posexplode("s.items").alias("k", "item"))
    ref = F.struct("question_id", F.struct(*[F.col(f"item.{c}").alias(c) for c in ("path", "first_line", "last_line", "chunk_id")]).alias("expand"))
    each = each.withColumn("n", F.octet_length(F.to_json("item")) + 1).withColumn("ref", ref).withColumn("m", F.octet_length(F.to_json("ref")) + 1)
    order = by.orderBy((F.col("k") > 0).cast("int"), "question_id", "side", "k")
    room = F.lit(budget - 130) - F.col("answer_bytes")
    rows = each.withColumn("rank", F.row_number().over(order)).withColumn("used", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("shown", (F.sum("n").over(by) <= room) | (F.col("used") <= room - compact.REFERENCES * F.max("m").over(by)))
    kept_ = rows.groupBy("request_id", "question_id").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("shown") & (F.col("side") == i), F.struct("rank", "item")))), lambda x: x["item"]).alias(c) for i, c in enumerate(("evidence", "counter_evidence"))], F.max(~F.col("shown")).alias("evidence_omitted"))
    lost = rows.groupBy("request_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.when(~F.col("shown"), F.struct("rank", "ref")))), lambda x: x["ref"]), 1, compact.REFERENCES).alias("omitted"), F.count_if(~F.col("shown")).alias("omitted_count"), F.max(~F.col("shown") & (F.col("k") == 0)).alias("short"))
    full = answers.select("request_id", *[F.col(f"{c}") for c in ("question_id", "type", "answer", "value", "basis")]).join(kept_, ["request_id", "question_id"], "left")
    one = F.struct("question_id", "type", "answer", "value", "basis", "evidence", "counter_evidence", F.when(F.col("evidence_omitted"), True).alias("evidence_omitted"))
    calls = full.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("question_id", F.to_json(one).alias("long"), F.to_json(F.struct("question_id", "answer", "value")).alias("short_answer")))).alias("a")).join(lost, "request_id", "left")
    count = F.lit(',"omitted_count":'), F.coalesce("omitted_count", F.lit(0)).cast("string"), F.lit(f',"byte_budget":{budget}')
    texts = lambda name: F.array_join(F.transform("a", lambda x: x[name]), ",")
    status = F.when(F.col("short"), "insufficient_budget").otherwise("ok")
    whole = F.concat(F.lit('{"status":"'), status, F.lit('","answers":['), texts("long"), F.lit('],"omitted":'), F.coalesce(F.to_json("omitted"), F.lit("[]")), *count)
    small = F.concat(F.lit('{"status":"insufficient_budget","answers":['), texts("short_answer"), F.lit("]"), *count)
    none = F.concat(F.lit('{"status":"insufficient_budget"'), *count)
    bodies = [compact.stamped(x) for x in (whole, small, none)]
    body = F.coalesce(*[F.when(F.octet_length(x) <= budget, x) for x in bodies[:2]], bodies[2])
    return calls.select("request_id", body.alias("packet_json")).withColumn("n_bytes", F.octet_length("packet_json"))


def explain(answers: DataFrame, sources: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """request_id, question_id, path, chunk_id, stale of the evidence of recorded answers: stale where the file has another hash by now.

    answers: request_id, question_id, project_id, path, chunk_id, source_hash (a row an item); sources: project_id, path,
    current_hash, active; visible: project_ids that the caller may see; items of others are left out."""
    seen = answers if visible is None else answers.join(visible.select("project_id").distinct(), "project_id", "left_semi")
    heads = sources.filter("active").groupBy("project_id", "path").agg(F.max("current_hash").alias("now"))
    met = seen.join(heads, ["project_id", "path"], "left")
    return met.select("request_id", "question_id", "path", "chunk_id", (~F.col("now").eqNullSafe(F.col("source_hash"))).alias("stale"))
