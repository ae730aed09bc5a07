"""Spelling variants grouped by an even-partition pigeonhole join.

Two words are near if one inserted, deleted or replaced code point makes one of the other.  A word of
length l is cut into two even segments; one edit leaves one of them whole.  So each word is indexed by
its first and its last segment, and probes the index of words as long as itself, and of words shorter
by one, with the substrings that stand where those segments would: from the start, or shifted so
that they end with the word.  Candidates are verified to be one edit apart and their repeats, found
by both segments, are dropped.

A bucket whose candidates would be more than ``pairs`` is cut again: what both words share is
stripped, and what is left between is cut evenly in turn, so that an edit still leaves one of the two
halves whole.  In the end all but one place is shared and a bucket is as large as the alphabet.
No bucket is capped, and none is compared whole while it can be cut.

The form of a word is its near word of the largest count if that is ``factor`` times its own or
more; its root is the last form in the chain.  Counts grow by that factor along a chain, so a few
rounds of pointer doubling reach its end.

Scale: runs of letters are counted with map-side combination and only distinct words go on.  Index
keys are 64-bit hashes; a collision adds a candidate that verification drops.  All of it is built-in
functions.

Defined results: null text has no words; a null id counts as the empty text where a hash is taken;
of near words with equal counts the smallest in code-point order is the form; repeated rows count
each; very long runs are words like any other; an empty table or one without words gives an empty
result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: Fixed values of the query's contract: letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
#: Candidates of a bucket beyond which it is cut again.
PAIRS = 2048


def misspelt(doc_id: Column, run: Column) -> Column:
    """The contract's runs: some lose one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(h % 31 == 0, less).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change=lambda doc_id, run: run) -> DataFrame:
    """word and its count n over all texts: runs of letters, A-Z lower-cased; ``change`` (of doc_id and run) may shorten them."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select(change(F.col("doc_id"), lower_ascii(F.col("run"))).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def halved(rows: DataFrame) -> DataFrame:
    """Index keys of (word, n, l, a, b) rows, two each: the first a and last b code points of a word and of words of
    length l are shared, and so is one half of what lies between."""
    a, b, between = F.col("a"), F.col("b"), F.col("l") - F.col("a") - F.col("b")
    each = [F.struct("l", x.cast("int").alias("a"), y.cast("int").alias("b")) for x, y in ((a + F.floor(between / 2), b), (a, b + F.ceil(between / 2)))]
    cut = rows.select("word", "n", F.explode(F.array(*each)).alias("cut")).select("word", "n", "cut.*")
    shared = F.substring("word", F.lit(1), a), F.substring(F.col("word"), F.length("word") - b + 1, b)
    return cut.select(F.xxhash64("l", "a", "b", *shared).alias("key"), "word", "n", "l", "a", "b")


def segments(words: DataFrame) -> DataFrame:
    """Each word by its own two segments and by those of words shorter by one."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda l: l > 0)
    return halved(words.select("word", "n", F.explode(lengths).alias("l"), F.lit(0).alias("a"), F.lit(0).alias("b")))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Pairs of (word, n) rows one edit apart: word, n, other, other_n, each pair once; ``other`` is the longer or later."""
    own, between = F.col("l") == F.length("word"), F.col("l") - F.col("a") - F.col("b")
    level, found = segments(words), None
    while True:
        sizes = level.groupBy("key").agg(F.count_if(own).alias("held"), F.count("*").alias("probes"), F.max(between).alias("between"))
        crowded = materialize(sizes.filter((F.col("held") * F.col("probes") > pairs) & (F.col("between") > 1)).select("key"), "crowded")
        last = crowded.isEmpty()
        rest = level if last else level.join(crowded, "key", "left_anti")
        index = rest.filter(own).select("key", "word", "n")
        probes = rest.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        once = (F.length("other") > F.length("word")) | (F.col("other") > F.col("word"))
        near = index.join(probes, "key").filter(once & (F.levenshtein("word", "other", 1) == 1)).drop("key")
        found = near if found is None else found.union(near)
        if last:
            return found.distinct()
        level = materialize(halved(level.join(crowded, "key", "left_semi")), "halved")


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, form (or null), form_n and n_near of (word, n) rows."""
    sides = [F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("form")).alias("near")) for x, y in (("a", "b"), ("b", "a"))]
    both = near_pairs(words).toDF("a", "a_n", "b", "b_n").select(F.explode(F.array(*sides)).alias("side")).select("side.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    enough = -F.col("near.less") >= factor * F.col("n")
    found = words.join(best, "word", "left")
    return found.select("word", "n", F.when(enough, F.col("near.form")).alias("form"), F.when(enough, -F.col("near.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def with_roots(found: DataFrame, factor: int = FACTOR) -> DataFrame:
    """The rows of ``forms`` with the last form of each word's chain (the word itself if it has none)."""
    most = found.agg(F.max("n")).first()[0] or 1
    longest = math.floor(math.log(most, factor)) + 1  # steps of a chain: counts grow by the factor at each
    links = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(longest))):  # pointers of twice as many steps
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{i}")
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, change=None) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (see ``vocabulary``)."""
    words = materialize(vocabulary(docs, least_length, least_count, *[change] * bool(change)), "words")
    return with_roots(materialize(forms(words, factor), "forms"), factor).select("word", "form", "root", "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return variants(docs, change=misspelt)


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], list_transform(range(8), lambda z: 0::BIGINT)),
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM bytes, crc_table),
results AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (
  SELECT word, unnest(range(length(word))) AS i FROM words),
parts AS (
  SELECT word, i, substr(word, 1, i) AS before, substr(word, i + 2) AS after FROM places),
replaced AS (
  SELECT x.word, y.word AS other FROM parts x JOIN parts y ON x.before = y.before AND x.after = y.after AND x.word <> y.word),
deleted AS (
  SELECT parts.word, words.word AS other FROM parts JOIN words ON words.word = before || after),
near AS (
  SELECT * FROM replaced UNION SELECT * FROM deleted UNION SELECT other, word FROM deleted),
ranked AS (
  SELECT near.word, other, words.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, encode(other)) AS r
  FROM near JOIN words ON words.word = other),
found AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 10 * words.n THEN other END AS form, CASE WHEN ranked.n >= 10 * words.n THEN ranked.n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND r = 1),
chains AS (
  SELECT word, word AS root FROM found UNION ALL SELECT chains.word, found.form FROM chains JOIN found ON found.word = chains.root WHERE found.form IS NOT NULL),
roots AS (
  SELECT chains.word, root FROM chains JOIN found ON found.word = chains.root WHERE found.form IS NULL)
SELECT found.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM found JOIN roots USING (word)
"""
