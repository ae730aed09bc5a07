"""Mixing sources to target weights by Sainte-Lague apportionment (built-in functions only).

Every source gets a target number of words: its weight's share of all words, capped at ``cap``
times what it has, with the excess reshared by weight (water filling, in closed form).  The mix is
a number of equal blocks of ``block_words`` words, dealt to sources by the highest quotients
target / (2 * seats + 1).  A block is one word unless a larger one is asked for: then the smallest
table and source come within a word of their targets, and what is less than a block is never lost.  The sequence of awards is house-monotone, so the awards between two
houses are the integer quotas of a shard.  A source's documents in a seeded order, repeated, are one
long run of words; each shard selects from it the stretch of its own quota of blocks, next to the
stretch of the shard before.  What a document gives is the sum of what the shards take from it.

Scale: one pass over the texts (sizes are written as a narrow table), sums with map-side
combination, and positions by two-level prefix sums over 4096 hash ranges a source, so that no
window holds a whole source.  Seats are not enumerated: only about three candidates a source
around its quota are, the rest is certain, so the size of a block does not matter to the cost.

Defined results: null text has size 0 and is never taken; null sources form one source, sorted
last; an empty table gives an empty result; repeated rows count each; ties in the seeded order
fall to (doc_id, size), and equal ones are interchangeable.  Columns besides the named ones are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

RANGE_BITS = 12


def seeded(value: Column, seed: int) -> Column:
    """32 seeded bits of a value, the same in any SQL engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(src_null, src, size) rows to (src_null, src, source_size, place, n, total, target), a row for each source."""
    per = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    placed = per.withColumn("place", F.row_number().over(W.orderBy("src_null", "src"))).withColumn("w", weight).withColumn("limit", F.col("source_size") * cap)
    before = W.orderBy(F.col("limit") / F.col("w"), "place").rowsBetween(W.unboundedPreceding, -1)
    level = (
        placed.withColumn("n", F.count(F.lit(1)).over(everything))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("open", F.col("left").cast("double") * F.col("w") <= F.col("limit").cast("double") * F.col("left_w"))
    )
    first = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("w"), "place", "left", "left_w"))).over(everything)
    at = level.withColumn("at", first)
    share = (F.col("w") * F.col("at.left")).cast("double") / F.col("at.left_w").cast("double")
    return at.select("src_null", "src", "source_size", "place", "n", "total", F.least(share, F.col("limit").cast("double")).alias("target"))


def shard_quotas(targets: DataFrame, block_words: int = 1, shards: int = 16) -> DataFrame:
    """(place, shard, blocks): the blocks of each source in each shard.

    With h blocks among n sources, a source's seats lie between x(1 - n/2h) - 1/2 and
    x(1 + n/2h) + 1/2 for its exact share x; one more on either side allows for rounding."""
    house = F.floor(F.floor(F.col("total") / block_words) * (F.col("shard") + 1) / shards).cast("long")
    at = targets.filter("total > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("house", house)
    share, slack = F.col("target") * F.col("house") / F.col("total"), F.col("n") / (2 * F.greatest(F.col("house"), F.lit(1)))
    bounds = at.withColumn("sure", F.greatest(F.lit(0), F.floor(share * (1 - slack) - 1.5)).cast("long")).withColumn("most", F.ceil(share * (1 + slack) + 1.5).cast("long"))
    left = F.col("house") - F.sum("sure").over(W.partitionBy("shard"))
    seats = bounds.withColumn("left", left).withColumn("seat", F.explode(F.sequence("sure", F.col("most") - 1)))
    quotient = F.col("target") / (2 * F.col("seat") + 1).cast("double")
    won = seats.withColumn("rank", F.row_number().over(W.partitionBy("shard").orderBy(quotient.desc(), "place", "seat"))).groupBy("place", "shard", "sure").agg(F.count_if(F.col("rank") <= F.col("left")).alias("more"))
    upto = won.withColumn("upto", F.col("sure") + F.col("more"))
    return upto.select("place", "shard", (F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("place").orderBy("shard")), F.lit(0))).alias("blocks"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 1, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard_words of every row of (doc_id, text, source).

    shard_words: the words that each shard takes, as shard:words, comma-joined; they sum up to taken."""
    sizes = docs.select(
        "doc_id",
        F.col("source").isNull().alias("src_null"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded(F.col("doc_id"), seed).alias("h"),
    )
    return _place(materialize(sizes, "mix-sizes"), weights, cap, block_words, shards)


def _place(sizes: DataFrame, weights, cap, block_words, shards) -> DataFrame:
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets")
    upto = F.sum("blocks").over(W.partitionBy("place").orderBy("shard")) * block_words
    quotas = shard_quotas(targets, block_words, shards).withColumn("upto", upto).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).getField("upto").alias("stops"))
    stops = F.transform(F.coalesce("stops", F.array().cast("array<long>")), lambda x: F.least(x, F.col("source_size") * cap))
    per = targets.join(quotas, "place", "left").withColumn("stops", stops)
    part = F.shiftright("h", 32 - RANGE_BITS)
    ranges = sizes.groupBy("src_null", "src", part.alias("part")).agg(F.sum("size").alias("words"))
    before = W.partitionBy("src_null", "src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(per, ["src_null", "src"])
    inside = W.partitionBy("src_null", "src", "part").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at = sizes.withColumn("part", part).join(starts, ["src_null", "src", "part"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.withColumn("words", F.transform("stops", _words_upto)).withColumn("shard_words", F.transform("words", lambda w, i: F.when(i > 0, w - F.get("words", i - 1)).otherwise(w)))
    taken = F.aggregate("shard_words", F.lit(0).cast("long"), lambda a, w: a + w)
    named = F.transform("shard_words", lambda w, i: F.when(w > 0, F.concat_ws(":", i.cast("string"), w.cast("string"))))
    return at.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_join(named, ",").alias("shard_words"))


def _words_upto(stop: Column) -> Column:
    """Words of a document among the first ``stop`` of its source's repeated run."""
    rest = F.when(F.col("source_size") > 0, stop % F.col("source_size")).otherwise(0)
    passes = F.when(F.col("source_size") > 0, F.floor((stop - rest) / F.col("source_size"))).otherwise(0)
    return (passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))).cast("long")


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed documents: each row as often as its taken words make whole copies (rounded half up).

    Rows that share doc_id and size share the copies of the first of them in the seeded order."""
    taken = mix(docs, **params).select(F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), "taken")
    copies = taken.groupBy("mix_id", "mix_size").agg(F.max(F.when(F.col("mix_size") > 0, F.floor(F.col("taken") / F.col("mix_size") + 0.5)).otherwise(0)).cast("int").alias("mix_copies"))
    sized = docs.withColumn("mix_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    met = sized.join(copies.filter("mix_copies > 0"), sized["doc_id"].eqNullSafe(copies["mix_id"]) & (sized["mix_words"] == copies["mix_size"]))
    return met.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*[docs[c] for c in docs.columns])


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS src_null, coalesce(source, '') AS src,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
per AS (
  SELECT *, row_number() OVER (ORDER BY src_null, src) AS place FROM (
    SELECT src_null, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1, 2)),
weighed AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::BIGINT AS w, source_size * 3 AS top FROM per),
level AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    (sum(source_size) OVER () - coalesce(sum(top) OVER before, 0))::BIGINT AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS rest_w
  FROM weighed
  WINDOW before AS (ORDER BY top::DOUBLE / w::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT rest, rest_w FROM level WHERE rest::DOUBLE * w <= top::DOUBLE * rest_w ORDER BY top::DOUBLE / w::DOUBLE, place LIMIT 1),
targets AS (
  SELECT level.*, least((w * water.rest)::DOUBLE / water.rest_w::DOUBLE, top::DOUBLE) AS target FROM level, water),
seats AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * seat + 1)::DOUBLE DESC, place, seat) AS rank, total AS house
  FROM (SELECT *, unnest(range(0, ceil(target)::BIGINT + (SELECT count(*) FROM targets) + 2)) AS seat FROM targets)),
quotas AS (
  SELECT place, count(*)::BIGINT AS blocks FROM seats WHERE rank <= house GROUP BY place),
cuts AS (
  SELECT place, list(upto ORDER BY s) AS stops FROM (
    SELECT place, s, (count(*) FILTER (rank <= house * s // 16))::BIGINT AS upto FROM seats, range(1, 17) AS r(s) GROUP BY place, s)
  GROUP BY place),
final AS (
  SELECT t.*, least(coalesce(blocks, 0), top) AS quota FROM targets t LEFT JOIN quotas USING (place)),
laid AS (
  SELECT sized.*, coalesce(sum(size) OVER (PARTITION BY src_null, src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sized),
given AS (
  SELECT doc_id, size, pos, source_size, target, quota, list_transform(stops, lambda x: CASE WHEN source_size = 0 THEN 0 ELSE (least(x, top) // source_size) * size + greatest(0, least(size, least(x, top) % source_size - pos)) END) AS words
  FROM laid JOIN final f ON laid.src_null = f.src_null AND laid.src = f.src LEFT JOIN cuts ON f.place = cuts.place)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
     + greatest(0, least(size, quota % source_size - pos)) END)::BIGINT AS taken,
  coalesce(array_to_string(list_filter(list_transform(range(1, 17), lambda i: CASE WHEN words[i] > coalesce(words[i - 1], 0)
     THEN (i - 1)::VARCHAR || ':' || (words[i] - coalesce(words[i - 1], 0))::VARCHAR END), lambda x: x IS NOT NULL), ','), '') AS shard_words
FROM given
"""
