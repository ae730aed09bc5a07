"""Claims, conflicts and typed questions over sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.lines import sentences_udf
from ..sources.store import kept

CLAIM_CHARS = (12, 600)


def sentence_rows(chunks: DataFrame) -> DataFrame:
    """Every sentence of every chunk with its place: the columns of chunks but text, then sentence_no, sentence."""
    return chunks.select(*[c for c in chunks.columns if c != "text"], F.posexplode(t.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def claim_rows(chunks: DataFrame) -> DataFrame:
    """claim_id, project_id, chunk_id, sentence_no, normalized_text, display_text: sentences that state a rule, one row a place."""
    found = sentence_rows(chunks).withColumn("display_text", t.collapse(F.col("sentence"))).filter(F.length("display_text").between(*CLAIM_CHARS)).filter(F.rlike("display_text", F.lit(t.java(t.CLAIM))))
    named = found.withColumn("normalized_text", t.fold(F.col("display_text")))
    return named.select(t.uuid5(t.CLAIM_NAMESPACE, F.concat_ws(":", "project_id", "normalized_text")).alias("claim_id"), "project_id", "chunk_id", "sentence_no", "normalized_text", "display_text")


def claims(chunks: DataFrame) -> DataFrame:
    """claim_id, project_id, normalized_text, display_text, n_evidence: one row a project and wording."""
    rows = claim_rows(chunks).groupBy("claim_id", "project_id", "normalized_text").agg(F.max(F.struct("chunk_id", "sentence_no", "display_text"))["display_text"].alias("display_text"), F.countDistinct("chunk_id").alias("n_evidence"))
    return rows.select("claim_id", "project_id", "normalized_text", "display_text", "n_evidence")


def conflicts(spans: DataFrame) -> DataFrame:
    """request_id, negated_chunk, affirmed_chunk, size (of both texts): a row a pair of sentences of different paths that conflict about one topic.

    spans: request_id, chunk_id, path, text.  Sentences are read once and written without their texts.  They
    meet on (request, topic word), so no two sentences without a shared word are ever paired; two shared
    words and half of the smaller topic count.  A pair counts at the first word that it shares, so its
    words need not be brought together again.  A merge join by hint: the planner takes the rows for no
    larger than the file that they are exploded from."""
    sized = spans.withColumn("size", F.length("text"))
    polar = sentence_rows(sized).withColumn("neg", t.negated(F.col("sentence"))).withColumn("aff", t.affirmed(F.col("sentence"))).filter("neg or aff")
    about = kept(polar.select("request_id", "chunk_id", "path", "size", "neg", t.topics(F.col("sentence")).alias("topics")), "polar")
    side = lambda neg, p: about.filter(F.col("neg") == neg).select("request_id", *[F.col(c).alias(f"{p}_{c}") for c in ("chunk_id", "path", "size", "topics")], F.explode("topics").alias("topic"))
    met = side(True, "l").join(side(False, "r").hint("merge"), ["request_id", "topic"]).filter("l_path <> r_path")
    pairs = met.withColumn("shared", F.array_intersect("l_topics", "r_topics")).filter((F.get("shared", F.lit(0)) == F.col("topic")) & (F.size("shared") >= 2) & (F.size("shared") * 2 >= F.least(F.size("l_topics"), F.size("r_topics"))))
    return pairs.select("request_id", F.col("l_chunk_id").alias("negated_chunk"), F.col("r_chunk_id").alias("affirmed_chunk"), (F.col("l_size") + F.col("r_size")).alias("size"))


def disagreements(spans: DataFrame) -> DataFrame:
    """request_id, negated_chunk, affirmed_chunk: spans of different paths whose sentences conflict; arguments as in ``conflicts``."""
    return conflicts(spans).drop("size").distinct()


def conflict_witness(spans: DataFrame) -> DataFrame:
    """The smallest pair of spans that shows each request's conflict: request_id, negated_chunk, affirmed_chunk, size."""
    best = F.min(F.struct("size", "negated_chunk", "affirmed_chunk"))
    return conflicts(spans).groupBy("request_id").agg(best.alias("b")).select("request_id", "b.negated_chunk", "b.affirmed_chunk", "b.size")


def evidence_sentences(spans: DataFrame) -> DataFrame:
    """Sentences that count as evidence: each (request, path, wording) once, no questions, suggestions or mere experiments."""
    return sentence_rows(spans).filter(t.is_evidence(F.col("sentence"))).dropDuplicates(["request_id", "path", "sentence"])


def wrapped_evidence(spans: DataFrame) -> DataFrame:
    """Like ``evidence_sentences``, with hard-wrapped lines rejoined: adds first_line and last_line; spans have line_start."""
    each = spans.select(*[c for c in spans.columns if c != "text"], F.explode(sentences_udf("text", "line_start")).alias("s")).select("*", "s.*").drop("s")
    return each.filter(t.is_evidence(F.col("sentence"))).dropDuplicates(["request_id", "path", "first_line", "sentence"])


# What a question may hold.
QUESTION_KEYS = {"claim": {"id", "type", "text"}, "choice": {"id", "type", "text", "options", "aliases"}, "value": {"id", "type", "text", "unit", "pattern"}}
MOST = {"questions": 12, "options": 32, "aliases": 8, "unit": 32, "pattern": 200}


def validated_questions(raw: list[dict]) -> list[dict]:
    """Questions in one form, or a ValueError that names what is wrong."""
    if not raw or len(raw) > MOST["questions"]:
        raise ValueError(f"one to {MOST['questions']} questions are taken")
    out, seen = [], set()
    for n, q in enumerate(raw, 1):
        kind, text = q.get("type"), str(q.get("text") or "").strip()
        name = str(q.get("id") or f"q{n}")
        if kind not in QUESTION_KEYS or not text:
            raise ValueError(f"{name}: a known type and a text are needed")
        if odd := set(q) - QUESTION_KEYS[kind]:
            raise ValueError(f"{name}: unknown keys {sorted(odd)}")
        if name in seen:
            raise ValueError(f"{name}: the id is used twice")
        seen.add(name)
        item = {"id": name, "type": kind, "text": text}
        if kind == "choice":
            options, aliases = list(q.get("options") or []), dict(q.get("aliases") or {})
            phrases = [p.casefold() for o in options for p in [o, *aliases.get(o, [])]]
            if not 2 <= len(options) <= MOST["options"] or set(aliases) - set(options) or any(len(a) > MOST["aliases"] for a in aliases.values()):
                raise ValueError(f"{name}: two to {MOST['options']} options, each with at most {MOST['aliases']} aliases")
            if len(set(phrases)) < len(phrases):
                raise ValueError(f"{name}: a phrase belongs to two options")
            item |= {"options": options, "aliases": aliases}
        if kind == "value":
            if (q.get("unit") is None) == (q.get("pattern") is None):
                raise ValueError(f"{name}: either a unit or a pattern")
            key = "unit" if q.get("unit") is not None else "pattern"
            value = str(q[key]).strip()
            if not value or len(value) > MOST[key] or key == "pattern" and re.search(r"\([^()]*[+*][^()]*\)\s*[+*{]", value):
                raise ValueError(f"{name}: the {key} is empty, too long or nests quantifiers")
            item[key] = value
        out.append(item)
    return out


def retrieval_text(question: dict) -> str:
    """What to search for on behalf of a question."""
    phrases = [p for o in question.get("options", []) for p in [o, *question.get("aliases", {}).get(o, [])]]
    return " ".join([question["text"], *phrases, *([question["unit"]] if "unit" in question else [])])


PLACE = ["chunk_id", "path", "first_line", "last_line", "sentence"]


def _places(evidence: DataFrame) -> list[str]:
    return [c for c in PLACE if c in evidence.columns]


def claim_items(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, supports, and the sentence's place: what speaks for or against claim questions.

    questions: request_id, claim; evidence: rows of ``evidence_sentences`` or ``wrapped_evidence``.  Where a claim states
    numbers, a sentence must state them all; other numbers contradict it if both are affirmative."""
    asked = questions.select("request_id", t.check_topics(F.col("claim")).alias("q"), t.negated(F.col("claim")).alias("q_neg"), F.array_distinct(t.numbers(F.col("claim"))).alias("q_num"))
    met = evidence.select("request_id", *_places(evidence), t.check_topics(F.col("sentence")).alias("s"), t.negated(F.col("sentence")).alias("neg"), t.numbers(F.col("sentence")).alias("num")).join(asked, "request_id")
    about = met.filter(t.related(F.col("q"), F.col("s"), True))
    others = (F.size("q_num") > 0) & (F.size(F.array_except("q_num", "num")) > 0)
    clash = (F.size("num") > 0) & ~F.col("neg") & ~F.col("q_neg")
    supports = F.when(~others, F.col("neg") == F.col("q_neg")).when(clash, False)
    return about.withColumn("supports", supports).filter("supports is not null").select("request_id", "supports", *_places(evidence))


def check_claims(questions: DataFrame, evidence: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    """request_id, answer, support, oppose of claim questions; arguments as in ``claim_items``, or its rows as ``items``."""
    counts = (claim_items(questions, evidence) if items is None else items).groupBy("request_id").agg(F.count_if("supports").alias("support"), F.count_if(~F.col("supports")).alias("oppose"))
    full = questions.select("request_id").join(counts, "request_id", "left").na.fill(0, ["support", "oppose"])
    answer = F.when((F.col("support") > 0) & (F.col("oppose") > 0), "disagreement").when(F.col("support") > 0, "supported").when(F.col("oppose") > 0, "contradicted").otherwise("unknown")
    return full.select("request_id", answer.alias("answer"), "support", "oppose")


def clauses(sentence: Column) -> Column:
    """A sentence's clauses: at punctuation, at "but", and before a decision verb joined by "and" or "then"."""
    cut = r"(?iU)\s*[,;:]\s*|\s+but\s+|\s+(?:and|then)\s+(?=(?:(?:we|they|the\s+team)\s+)?" + t.DECISION_VERB + r"\b)"
    return F.split(sentence, cut, -1)


def choice_items(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, option, supports, and the sentence's place: clauses that speak for or against an option of choice questions.

    questions: request_id, question, options (array) and perhaps aliases (map of option to array); an
    option is named by itself or by an alias."""
    names = F.map_from_arrays("options", F.transform("options", lambda o: F.array(o)))
    if "aliases" in questions.columns:
        more = lambda o: F.coalesce(F.element_at("aliases", o), F.array().cast("array<string>"))
        names = F.map_from_arrays("options", F.transform("options", lambda o: F.concat(F.array(o), more(o))))
    named = questions.withColumn("names", names).withColumn("phrases", F.flatten(F.map_values("names")))
    own = F.flatten(F.transform("phrases", t.check_topics))
    asked = named.select("request_id", "names", F.array_except(t.check_topics(F.col("question")), own).alias("q"))
    met = evidence.select("request_id", *_places(evidence), t.check_topics(F.col("sentence")).alias("s")).join(asked, "request_id")
    about = met.filter((F.size("q") == 0) | t.related(F.col("q"), F.col("s"), False))
    split = about.select("request_id", *_places(evidence), "names", F.explode(clauses(F.col("sentence"))).alias("clause"))
    trial = F.rlike("clause", F.lit(t.java(t.EXPLORATION))) & ~F.rlike("clause", F.lit(t.java(t.DECISION)))
    words = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\w]+", " ")), F.lit(" "))
    each = split.filter(~trial).withColumn("said", words(F.col("clause"))).select("*", F.explode("names").alias("option", "own"))
    hit = each.filter(F.exists("own", lambda p: F.contains(F.col("said"), words(p))))
    return hit.select("request_id", "option", (~t.negated(F.col("clause"))).alias("supports"), *_places(evidence)).distinct()


def check_choices(questions: DataFrame, evidence: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    """request_id, answer, chosen of choice questions: never a tie broken by rank; arguments as in ``choice_items``, or its rows as ``items``."""
    sides = (choice_items(questions, evidence) if items is None else items).groupBy("request_id", "option").agg(F.count_if("supports").alias("n_for"), F.count_if(~F.col("supports")).alias("n_against"))
    per = sides.groupBy("request_id").agg(
        F.count_if(F.col("n_for") > 0).alias("supported"),
        F.count_if((F.col("n_for") > 0) & (F.col("n_against") > 0)).alias("torn"),
        F.count_if((F.col("n_for") == 0) & (F.col("n_against") > 0)).alias("ruled_out"),
        F.min(F.when(F.col("n_for") > 0, F.col("option"))).alias("first"),
    )
    full = questions.select("request_id").join(per, "request_id", "left").na.fill(0, ["supported", "torn", "ruled_out"])
    answer = F.when((F.col("supported") >= 2) | ((F.col("supported") == 1) & (F.col("torn") > 0)), "disagreement").when(F.col("supported") == 1, "selected").when(F.col("ruled_out") > 0, "excluded").otherwise("unknown")
    return full.select("request_id", answer.alias("answer"), F.when(answer == "selected", F.col("first")).alias("chosen"))


def value_items(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, value (text), and the sentence's place: numbers before a unit, or first groups of a pattern, in affirmative sentences.

    questions: request_id, question, unit and perhaps pattern, one of which is set.  Numbers are written
    one way, whole ones without a point; what a pattern finds that is no number stays as it is."""
    pattern = F.col("pattern") if "pattern" in questions.columns else F.lit(None).cast("string")
    topic = F.array_except(t.check_topics(F.col("question")), F.coalesce(t.check_topics(F.col("unit")), F.array().cast("array<string>")))
    quoted = F.regexp_replace("unit", r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    by_unit = F.concat(F.lit(r"(?iU)(?<![\w.,])(" + t.NUMBER + r")\s*"), quoted, F.lit(r"(?!\w)"))
    asked = questions.select("request_id", "unit", topic.alias("q"), F.coalesce(by_unit, pattern).alias("look"))
    met = evidence.select("request_id", *_places(evidence)).join(asked, "request_id").filter(~t.negated(F.col("sentence")) & t.related(F.col("q"), t.check_topics(F.col("sentence")), False))
    found = met.select("request_id", "unit", *_places(evidence), F.explode(F.regexp_extract_all("sentence", F.col("look"), F.lit(1))).alias("raw")).withColumn("raw", F.trim("raw")).filter("raw <> ''")
    number = F.when(F.col("unit").isNotNull(), F.replace("raw", F.lit(","), F.lit(""))).otherwise(F.col("raw")).try_cast("double")
    value = F.when(number.isNull(), F.col("raw")).when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    return found.select("request_id", value.alias("value"), *_places(evidence))


def check_values(questions: DataFrame, evidence: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    """request_id, answer, n_values, value (number) of value questions; arguments as in ``value_items``, or its rows as ``items``."""
    per = (value_items(questions, evidence) if items is None else items).groupBy("request_id").agg(F.countDistinct("value").alias("n_values"), F.min("value").alias("text_value"))
    full = questions.select("request_id").join(per, "request_id", "left").na.fill(0, ["n_values"])
    answer = F.when(F.col("n_values") == 1, "found").when(F.col("n_values") > 1, "disagreement").otherwise("unknown")
    only = F.when(F.col("n_values") == 1, F.col("text_value"))
    return full.select("request_id", answer.alias("answer"), "n_values", only.try_cast("double").alias("value"), only.alias("text_value"))


def audit(statements: DataFrame, spans: DataFrame, threshold: float = 0.45) -> DataFrame:
    """statement_id, chunk_id, score: evidence that covers enough of a statement's tokens.

    statements: statement_id, text; spans: chunk_id, text.  Statements meet spans on shared tokens
    and the overlap is counted after that join, in place of scoring every pair."""
    own = statements.select("statement_id", t.request_tokens(F.col("text")).alias("tokens")).select("statement_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    there = spans.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(t.fold(F.col("text")), F.lit("[A-Za-z0-9_][A-Za-z0-9_.-]*"), F.lit(0)))).alias("token"))
    met = own.join(there, "token").groupBy("statement_id", "n", "chunk_id").agg(F.count(F.lit(1)).alias("k"))
    return met.select("statement_id", "chunk_id", F.round(F.col("k") / F.col("n"), 4).alias("score")).filter(F.col("score") >= threshold)


def statements(answers: DataFrame) -> DataFrame:
    """request_id, statement_no, text: what an answer states; pieces of less than twelve characters are none."""
    pieces = F.split(F.regexp_replace("answer", r"(?U)(?<=[.!?])\s+|\n+", t.MARK), t.MARK)
    full = F.filter(pieces, lambda x: F.length(F.trim(x)) >= 12)
    return answers.select("request_id", F.posexplode(F.transform(full, lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" -*\t")))).alias("statement_no", "text"))


def audit_answers(answers: DataFrame, items: DataFrame, requirements: DataFrame, threshold: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """What an answer states against the packet it was made from: (statements, verdicts).

    answers: request_id, answer; items: request_id, item_no, text, requirements (array of leaf numbers);
    requirements: request_id, leaf_no, text, status, found.  Statements: request_id, statement_no, text,
    status, coverage, item_no (the best), items (all above the threshold); an item that holds a statement
    covers it whole.  Verdicts: request_id, result, residuals, worst_kind, worst_no.  A statement meets the
    items of its own request only, a few dozen."""
    said = statements(answers).withColumn("tokens", t.request_tokens(F.col("text"))).withColumn("folded", t.fold(t.collapse(F.col("text"))))
    shown = items.select("request_id", "item_no", t.fold(t.collapse(F.col("text"))).alias("there"), F.array_distinct(F.filter(F.regexp_extract_all(t.fold(F.col("text")), F.lit("[A-Za-z0-9_][A-Za-z0-9_.-]*"), F.lit(0)), lambda x: (F.length(x) >= t.MIN_TOKEN) & ~x.isin(t.STOPWORDS))).alias("own"))
    met = said.join(shown, "request_id")
    score = F.when((F.col("folded") != "") & F.contains("there", F.col("folded")), 1.0).when(F.size("tokens") == 0, 0.0).otherwise(F.size(F.array_intersect("tokens", F.slice("own", 1, t.MAX_TOKENS))) / F.size("tokens"))
    scored = met.select("request_id", "statement_no", "item_no", score.alias("score"))
    best = scored.groupBy("request_id", "statement_no").agg(
        F.max("score").alias("coverage"),
        F.max_by("item_no", F.struct("score", -F.col("item_no"))).alias("item_no"),
        F.sort_array(F.collect_list(F.when(F.col("score") >= threshold, F.struct((-F.col("score")).alias("s"), "item_no")))).alias("above"),
    )
    covered = said.select("request_id", "statement_no", "text").join(best, ["request_id", "statement_no"], "left").na.fill(0.0, ["coverage"])
    told = covered.select("request_id", "statement_no", "text", F.when(F.col("coverage") >= threshold, "candidate_evidence").otherwise("unknown").alias("status"), F.round("coverage", 4).alias("coverage"), "item_no", F.coalesce(F.col("above.item_no"), F.array().cast("array<int>")).alias("items"))
    open_ = requirements.filter(~F.col("status").isin("evidence_found", "disagreement"))
    gaps = open_.groupBy("request_id").agg(F.count(F.lit(1)).alias("uncovered"), F.min(F.struct("found", "leaf_no"))["leaf_no"].alias("worst_leaf"))
    bare = told.filter("status = 'unknown'").groupBy("request_id").agg(F.count(F.lit(1)).alias("unsupported"), F.min("statement_no").alias("worst_statement"))
    torn = requirements.filter("status = 'disagreement'").groupBy("request_id").agg(F.count(F.lit(1)).alias("disagreements"))
    counts = ["uncovered", "unsupported", "disagreements"]
    all_ = answers.select("request_id").distinct().join(gaps, "request_id", "left").join(bare, "request_id", "left").join(torn, "request_id", "left").na.fill(0, counts)
    result = F.when(F.col("disagreements") > 0, "clarification_needed").when((F.col("uncovered") > 0) | (F.col("unsupported") > 0), "residuals_open").otherwise("match_move_complete")
    kind = F.when(F.col("uncovered") > 0, "uncovered_requirement").when(F.col("unsupported") > 0, "unsupported_output")
    number = F.when(F.col("uncovered") > 0, F.col("worst_leaf")).otherwise(F.col("worst_statement"))
    return told, all_.select("request_id", result.alias("result"), *counts, kind.alias("worst_kind"), number.alias("worst_no"))


def select_claims(matched: DataFrame, cap: int = 4, max_chars: int = 400) -> DataFrame:
    """Per request the claims to show: verified first, then by shared terms, short before long; noise goes unless verified.

    matched: request_id, terms (array), claim_id, display_text, trust_state."""
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("verified", 0), ("disputed", 1), ("observed", 2), ("proposed", 3)) for x in p]), F.col("trust_state")), F.lit(4))
    overlap = F.aggregate("terms", F.lit(0), lambda n, x: n + F.contains(F.lower("display_text"), x).cast("int"))
    shown = matched.filter((F.col("trust_state") == "verified") | ~t.claim_noise(F.col("display_text"))).withColumn("o", order).withColumn("overlap", overlap)
    place = F.row_number().over(W.partitionBy("request_id").orderBy("o", F.col("overlap").desc(), F.length("display_text"), "display_text", "claim_id"))
    clipped = F.when(F.length("display_text") > max_chars, F.concat(F.rtrim(F.substring("display_text", 1, max_chars)), F.lit("..."))).otherwise(F.col("display_text"))
    return shown.withColumn("position", place).filter(F.col("position") <= cap).select("request_id", "claim_id", "position", "overlap", clipped.alias("display_text"))
