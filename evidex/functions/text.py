"""Column expressions of the text rules: tokens, sentences, polarity, topics, numbers, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request stopwords, topic stoplist and question words.
STOPWORDS = (
    "the a an of for to and or is it in on at be as by what how does did can are was were been being has have had do done this that these those there their "
    "them they then than with without from into onto over under about after before when where which while who whom whose why will would should could may might must "
    "shall not no yes all any each some such only also just very more most other our ours your yours his her its use used uses using get got make made like need needs "
    "want wants find show tell give know see look please let lets out off per via thing things way ways"
).split()
TOPIC_STOPWORDS = (
    "a an and are as at be been by can could do does don't for from has have if in into is it its may must never no not of on or shall should so than that the their then "
    "there these this those to use used uses using was were when which while will with without would you your approved unapproved required decision"
).split()
QUESTION_WORDS = "which what where who whom whose how why does did pick picked choose chosen".split()
# The patterns of negation, affirmation, claims, reports, experiments, decisions and policies.
NEGATION = r"\b(?:not|never|cannot|no\s+longer|unapproved)\b|n't\b"
CLAIM = r"\b(must|should|shall|required|approved|decision|authoritative|canonical|do not|don't|never|prohibited|blocked|supersedes?)\b"
AFFIRM = r"\bmust\b(?!\s+not\b)|\bshall\b(?!\s+not\b)|\brequired\b|(?<!not)(?<!not\s)\bapproved\b"
REPORT = r"\?|\b(?:asked|asking|whether|unclear|undecided|tbd|to\s+be\s+decided|open\s+question|propos(?:e|es|ed|al)|consider(?:ing)?|should\s+we|do\s+we|maybe|might\s+we)\b"
DECISION_VERB = r"(?:chose|choose|chosen|picked|selected|decided|adopt(?:s|ed)?|went\s+with|settled\s+on|switch(?:ed)?\s+to|standardi[sz]ed?\s+on|will\s+use|use|uses)"
DECISION = r"\b(?:decision|decided|must|shall|required?|" + DECISION_VERB + r")\b"
EXPLORATION = (
    r"\b(?:evaluat(?:e|es|ed|ing|ion)|test(?:s|ed|ing)|tri(?:ed|al|als|aled|alled)|trying|compar(?:e|es|ed|ing)|benchmark(?:s|ed|ing)?|prototyp(?:e|ed|ing)"
    r"|investigat(?:e|ed|ing)|explor(?:e|ed|ing)|look(?:ed|ing)\s+(?:at|into)|experiment(?:s|ed|ing)?|reviewed|assess(?:ed|ing)?)\b"
)
PROTECTED = r"\b(?:must|shall|required|do not|don't|never|except|unless|decision|authoritative)\b"
NUMBER = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
NODE_NAMESPACE = "55f724f6aaed459f8b3f0aa177ca9cf4"
CLAIM_NAMESPACE = "bb44190c303c4f808f8b145ccbcd8210"
PROJECT_NAMESPACE = "a675f73673584d37a45a9b192538ab42"

MAX_TOKENS, MIN_TOKEN = 24, 3
MARK = "\u0001"


def words_in(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def java(pattern: str) -> str:
    """A pattern with Unicode classes and without regard to case."""
    return "(?iU)" + pattern


def fold(text: Column) -> Column:
    """Lower case with the sharp s spelt out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def request_tokens(text: Column) -> Column:
    """The terms of a request: ASCII, at least three characters, no stopwords, no repeats, the first 24."""
    found = F.regexp_extract_all(fold(text), F.lit("[A-Za-z0-9_][A-Za-z0-9_.-]*"), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, MAX_TOKENS)


def index_terms(text: Column) -> Column:
    """The terms that the index holds, before stemming: runs of letters and digits, folded."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences and lines, trimmed, none empty."""
    marked = F.regexp_replace(text, r"(?U)([.!?])\s+|\n+", "$1" + MARK)
    return F.filter(F.transform(F.split(marked, MARK), lambda s: F.trim(s)), lambda s: s != "")


def negated(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(java(NEGATION))), F.lit(False))


def affirmed(text: Column) -> Column:
    return ~negated(text) & F.coalesce(F.rlike(text, F.lit(java(AFFIRM))), F.lit(False))


def is_evidence(text: Column) -> Column:
    """Neither a recorded question or suggestion nor a mere experiment."""
    trial = F.rlike(text, F.lit(java(EXPLORATION))) & ~F.rlike(text, F.lit(java(DECISION)))
    return ~F.rlike(text, F.lit(java(REPORT))) & ~trial


def topics(text: Column) -> Column:
    """Topic words: longer than two characters, outside the stoplist, each once."""
    found = F.regexp_extract_all(fold(text), F.lit(r"[a-z0-9][a-z0-9_\-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(TOPIC_STOPWORDS)))


def stem_once(token: Column) -> Column:
    """One round: a plural's ending, or else ing, ed or er."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(F.rlike(token, F.lit("(?:ches|shes|sses|xes|zes)$")) & (n >= 5), cut(2))
        .when(F.rlike(token, F.lit("(?<!s)s$")) & (n >= 4), cut(1))
        .when(F.rlike(token, F.lit("ing$")) & (n >= 7), cut(3))
        .when(F.rlike(token, F.lit("(?:ed|er)$")) & (n >= 6), cut(2))
        .otherwise(token)
    )


def stems(tokens: Column) -> Column:
    """Three rounds over an array; each is its own transform, so that an element is bound once a round."""
    for _ in range(3):
        tokens = F.transform(tokens, stem_once)
    return tokens


def check_topics(text: Column) -> Column:
    """Stemmed topics without question words."""
    return F.array_distinct(stems(F.filter(topics(text), lambda t: ~t.isin(QUESTION_WORDS))))


def related(question: Column, sentence: Column, symmetric: bool) -> Column:
    """Enough shared topics; symmetric also asks for half of the smaller set."""
    shared, a, b = F.size(F.array_intersect(question, sentence)), F.size(question), F.size(sentence)
    base = (a > 0) & (b > 0) & (shared >= F.least(F.lit(2), a))
    return base & (shared * 2 >= F.least(a, b)) if symmetric else base


def numbers(text: Column) -> Column:
    """Plain or comma-grouped numbers as doubles."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w.,])(" + NUMBER + r")(?!\d)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def claim_noise(text: Column) -> Column:
    """Fewer than four words, or letters less than 55 % of what is not a space."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    letters = F.length(F.array_join(found, ""))
    return (F.size(found) < 4) | (letters < F.length(F.replace(text, F.lit(" "), F.lit(""))) * 0.55)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """A version 5 UUID by SHA-1, from built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), F.substring(variant, -1, 1), part(18, 3), F.lit("-"), part(21, 12))


def path_excluded(path: Column, size: Column) -> Column:
    """The first reason to leave a file out, or null: sensitive_name, generated, unsupported_type, too_large."""
    from ..sources.rules import DOCUMENT_SUFFIXES, GENERATED_NAMES, GENERATED_SUFFIXES, MAX_FILE_BYTES, SENSITIVE_NAMES, SENSITIVE_PATTERN, SENSITIVE_SUFFIXES, TEXT_SUFFIXES

    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)  # a name that only has a dot in front has none
    ends = lambda xs: F.exists(words_in(list(xs)), lambda x: F.endswith(name, x))
    secret = name.isin(*SENSITIVE_NAMES) | suffix.isin(*SENSITIVE_SUFFIXES) | F.startswith(name, F.lit(".env.")) | F.rlike(name, F.lit(SENSITIVE_PATTERN))
    return (
        F.when(secret, "sensitive_name")
        .when(name.isin(*GENERATED_NAMES) | ends(GENERATED_SUFFIXES), "generated")
        .when(~suffix.isin(*TEXT_SUFFIXES, *DOCUMENT_SUFFIXES), "unsupported_type")
        .when(size > MAX_FILE_BYTES, "too_large")
    )
