"""From ranked spans to bounded packets.

What depends on order row by row (joining up to a size, dropping copies without using up a file's
quota, greedy budgets) is an aggregate over the sorted array of one request's few spans; the rest is
windows and expressions.  Python cuts texts to chunks and requests to leaves."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import deque
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

# Sizes of chunks, merged spans, long spans and requirement leaves.
CHUNK_CHARS, MERGE_CHARS, LONG_CHARS = 1600, 2400, 4000
MAX_LEAVES, LONG_LEAF, FIRST_SPLIT = 12, 80, 4
HEADING = re.compile(r"^\s{0,3}#{1,6}\s+(.+?)\s*$")
CHUNK_FIELDS = [("ordinal", T.IntegerType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("heading", T.StringType()), ("text", T.StringType())]


def break_points(lines: list[str], limit: int) -> list[int]:
    """Where chunks begin, and the end: found by looking each next one up in running widths, not by walking the lines.

    From a beginning, the next one is the nearest of three: the next heading, the first line that the
    limit leaves no room for, and the line after a blank one that a third of the limit is reached at."""
    reach = list(accumulate(len(x) + 1 for x in lines))
    heads = [i for i, x in enumerate(lines) if HEADING.match(x)] + [len(lines)]
    blanks = [i for i, x in enumerate(lines) if x == "" or x.isspace()] + [len(lines)]
    points = [0]
    while points[-1] < len(lines):
        at = points[-1]
        base = reach[at - 1] + 1 if at else 1
        heading = heads[bisect_right(heads, at)] if at < heads[-1] else len(lines)
        full = max(at + 1, bisect_right(reach, base + limit))
        pause = blanks[bisect_left(blanks, max(at, bisect_left(reach, base + limit // 3)))] + 1
        points.append(min(heading, full, pause, len(lines)))
    return points


def cut_lines(text: str, limit: int = CHUNK_CHARS) -> list[tuple]:
    """(ordinal, line_start, line_end, heading, text) of a text's chunks.

    A heading opens a chunk and names it and those after it; lines are never split; blank chunks are left out."""
    lines = re.split(r"\r\n|\r|\n", text)
    points = break_points(lines, limit)
    titles = [HEADING.match(lines[a]) for a in points[:-1]]
    titled = list(accumulate((m.group(1).strip() if m else None for m in titles), lambda held, new: held if new is None else new))
    bodies = ["\n".join(lines[a:b]).strip() for a, b in zip(points, points[1:])]
    full = [i for i, body in enumerate(bodies) if body]
    return [(ordinal, points[i] + 1, points[i + 1], titled[i], bodies[i]) for ordinal, i in enumerate(full)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, k) for n, k in CHUNK_FIELDS])))
def chunk_udf(texts: pd.Series) -> pd.Series:
    names = [n for n, _ in CHUNK_FIELDS]
    return pd.Series([[dict(zip(names, c)) for c in cut_lines(x or "")] for x in texts])


def chunks(sources: DataFrame) -> DataFrame:
    """The columns of sources but text, then the fields of each chunk and its hash."""
    each = sources.select(*[c for c in sources.columns if c != "text"], F.explode(chunk_udf("text")).alias("chunk"))
    return each.select(*[c for c in sources.columns if c != "text"], "chunk.*").withColumn("chunk_hash", F.sha2("text", 256))


# What divides a request: clause ends, then the word between two parts; and how short a part may be.
CLAUSES = re.compile(r"\s*(?:;|\n|\.(?=\s+[A-Z]))\s*")
CONJUNCTION = re.compile(r"\s+\band\b\s+", re.IGNORECASE)
SHORTEST_PART = 12


def squeezed(text: str) -> str:
    return " ".join(text.split()).strip(" .")


def parts_of(text: str, divider: re.Pattern, shortest: int = 1) -> list[str]:
    return [p for p in map(squeezed, divider.split(text)) if len(p) >= shortest]


def divided(text: str, shortest: int) -> list[str]:
    """The parts of a text by the first divider that finds two of them; none if neither does."""
    return next((p for p in (parts_of(text, CLAUSES), parts_of(text, CONJUNCTION, shortest)) if len(p) > 1), [])


def requirements(text: str, cap: int = MAX_LEAVES) -> list[str]:
    """The checkable leaves of a request.

    The leaves are those of a tree, held by their paths from the root, which sort as the text reads.
    Long compound leaves wait in a queue; each that is divided makes room for its parts while the tree
    has fewer leaves than ``cap``."""
    whole = squeezed(text)
    top = parts_of(text, CLAUSES) or ([whole] if whole else [])
    if len(top) == 1 and len(whole) > LONG_LEAF:
        halves = parts_of(whole, CONJUNCTION, SHORTEST_PART)
        top = halves if 2 <= len(halves) <= FIRST_SPLIT else top
    tree = {(i,): leaf for i, leaf in enumerate(top)}
    waiting = deque(tree)
    while waiting and len(tree) < cap:
        path = waiting.popleft()
        leaf = tree[path]
        if len(leaf) > LONG_LEAF and (";" in leaf or " and " in leaf.casefold()):
            below = {(*path, i): part for i, part in enumerate(divided(leaf, SHORTEST_PART)[: cap - len(tree) + 1])}
            if below:
                del tree[path]
                tree |= below
                waiting.extend(below)
    return [tree[path] for path in sorted(tree)[:cap]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def requirements_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([requirements(x or "") for x in texts])


def compound(leaf: Column) -> Column:
    return F.contains(leaf, F.lit(";")) | F.contains(F.lower(leaf), F.lit(" and "))


def divided_again(leaf: DataFrame) -> DataFrame:
    """request_id, leaf_no, part, leaf, blocked: the leaves of a request after those without rows are divided once more.

    leaf: request_id, leaf_no, leaf, empty (found nothing), parts (none: it has rows, or does not divide).  Parts stand where
    their leaf stood, and in its order each leaf takes the room that the ones before it have left under
    ``MAX_LEAVES``.  A leaf that gets none stays whole.  blocked: the room ended some of its parts or all."""
    by, before = W.partitionBy("request_id"), W.partitionBy("request_id").orderBy("leaf_no")
    more = F.when(F.size("parts") > 1, F.size("parts") - 1).otherwise(0)
    room = MAX_LEAVES - F.count("*").over(by)
    each = leaf.withColumn("more", more).withColumn("room", room).withColumn("asked", F.sum("more").over(before))
    given = lambda asked: F.greatest(F.lit(0), F.least(asked, F.col("room")))
    each = each.withColumn("extra", (given(F.col("asked")) - given(F.col("asked") - F.col("more"))).cast("int")).withColumn("full", F.max("asked").over(by) >= F.col("room"))
    own = F.when(F.col("extra") > 0, F.slice("parts", F.lit(1), F.col("extra") + 1)).otherwise(F.array("leaf"))
    placed = each.withColumn("own", own).select("*", F.posexplode("own").alias("part", "piece"))
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("more")) & (F.col("part") == F.col("extra"))
    whole = (F.col("extra") == 0) & F.col("full") & F.col("empty") & compound(F.col("leaf"))
    return placed.select("request_id", "leaf_no", F.when(F.col("extra") > 0, F.col("part")).otherwise(-1).alias("part"), F.col("piece").alias("leaf"), (cut | whole).alias("blocked"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def second_split_udf(texts: pd.Series) -> pd.Series:
    """Parts of a leaf that found nothing, down to three characters; empty if it does not divide."""
    return texts.map(lambda x: divided(x or "", 3))


def leaves(requests: DataFrame) -> DataFrame:
    """request_id, leaf_no, leaf."""
    return requests.select("request_id", F.posexplode(requirements_udf("text")).alias("leaf_no", "leaf"))


def select_across_leaves(hits: DataFrame) -> DataFrame:
    """One row a (request, path, chunk_hash): the first leaf's hit with the leaves that found it."""
    keys = ["request_id", "path", "chunk_hash"]
    torn = [F.max("disagreeing").alias("disagreeing")] if "disagreeing" in hits.columns else []
    rest = [c for c in hits.columns if c not in {*keys, "leaf_no", "disagreeing"}]
    best = hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("leaf_no", "rank")).alias("b"), F.sort_array(F.collect_set("leaf_no")).alias("requirements"), *torn)
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest], "requirements", *["disagreeing"] * len(torn))


def board(path: Column) -> Column:
    """Whether a folder on the way is a message board."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), t.words_in([".agent-coordination", "agent-coordination", ".board", "board", "inbox"]))


def prioritize(hits: DataFrame) -> DataFrame:
    """Adds position: fresh before stale, conflicts first, then requirement, scope, pass, board, rank, place."""
    order = ["stale", F.col("disagreeing").cast("int").desc(), F.element_at("requirements", 1), "priority", "match_pass", board(F.col("path")), "rank", "path", "line_start"]
    return hits.withColumn("position", F.row_number().over(W.partitionBy("request_id").orderBy(*order)))


def islands(spans: DataFrame) -> DataFrame:
    """Adds island: spans of a file whose lines touch or overlap share one (without the size cap of ``merge``)."""
    by = W.partitionBy("request_id", "path").orderBy("line_start", "line_end")
    reach = F.max("line_end").over(by.rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("opens", (F.col("line_start") > F.coalesce(reach, F.lit(-2)) + 1).cast("int")).withColumn("island", F.sum("opens").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def by_position(items: DataFrame, *keys: str) -> DataFrame:
    """Rows gathered in order: the keys and ``rows``, an array of (line_start or none, position, row); a request has a few dozen."""
    lead = [c for c in ("line_start",) if c in items.columns and len(keys) > 1]
    row = F.struct(*[c for c in items.columns if c not in keys]).alias("row")
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*lead, F.col("position").cast("long").alias("position"), row))).alias("rows"))


def chosen(gathered: DataFrame, places: Column, *keys: str) -> DataFrame:
    """The rows of ``by_position`` whose positions are among some."""
    kept = gathered.withColumn("places", places)
    row = F.filter("rows", lambda x: F.array_contains("places", x["position"]))
    return kept.select(*keys, F.explode(row).alias("x")).select(*keys, "x.row.*")


JOINED = "struct<marks: array<struct<island: int, adds: boolean, whole: int>>, island: int, reach: int, size: int, slack: int, stale: boolean>"


def joined(hits: DataFrame) -> DataFrame:
    """Spans of a file that touch or overlap as one, up to ``MERGE_CHARS``; adds merged (how many).

    A span opens an island of its own unless it reaches the one before it, in order of lines, is as
    stale, and its text still fits.  The island stands where the span that opened it stood, holds what all
    its spans hold of requirements, and the least of their ranks and passes; its text is that of the
    spans that brought further lines.  Hits that have a size in place of a text are joined by it, as if no
    text ended in a line break, and the island has its size."""
    keys = ["request_id", "project_id", "path"]
    sized = "text" not in hits.columns
    size = lambda x: x["row"]["size"] if sized else F.length(x["row"]["text"])
    slack = lambda x: F.lit(0) if sized else size(x) - F.length(F.rtrim(x["row"]["text"], F.lit("\n")))

    def step(s: Column, x: Column) -> Column:
        row = x["row"]
        within = (row["stale"] == s["stale"]) & (row["line_start"] <= s["reach"] + 1) & (s["size"] + size(x) <= MERGE_CHARS)
        further = row["line_end"] > s["reach"]
        island = s["island"] + F.when(within, 0).otherwise(1)
        grown = F.when(~within | within.isNull(), size(x)).when(further, s["size"] - s["slack"] + 1 + size(x)).otherwise(s["size"])
        mark = F.struct(island.alias("island"), F.coalesce(~within | further, F.lit(True)).alias("adds"), grown.alias("whole"))
        over = F.when(within & ~further, s["slack"]).otherwise(slack(x))
        reach = F.when(within, F.greatest(s["reach"], row["line_end"])).otherwise(row["line_end"])
        return F.struct(F.concat(s["marks"], F.array(mark)).alias("marks"), island.alias("island"), reach.alias("reach"), grown.alias("size"), over.alias("slack"), row["stale"].alias("stale")).cast(JOINED)

    start = F.from_json(F.lit('{"marks": [], "island": 0, "reach": -2, "size": 0, "slack": 0}'), JOINED)
    marks = F.aggregate("rows", start, step, lambda s: s["marks"])
    each = by_position(hits, *keys).withColumn("marks", marks).select(*keys, F.explode(F.arrays_zip("rows", "marks")).alias("x")).select(*keys, "x.rows.row.*", "x.marks.*")
    body = "size" if sized else "text"
    rest = [c for c in hits.columns if c not in {*keys, body, "line_end", "rank", "match_pass", "requirements"}]
    texts = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("line_start", "position", "adds", body))), lambda x: x["adds"]), lambda x: x[body])
    whole = F.max("whole") if sized else F.array_join(F.transform(texts, lambda x, i: F.when(i < F.size(texts) - 1, F.rtrim(x, F.lit("\n"))).otherwise(x)), "\n")
    found = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("requirements")))).alias("requirements")] if "requirements" in hits.columns else []
    one = each.groupBy(*keys, "island").agg(F.min_by(F.struct(*rest), F.struct("line_start", "position")).alias("first"), whole.alias(body), F.max("line_end").alias("line_end"), F.min("rank").alias("rank"), F.min("match_pass").alias("match_pass"), F.count("*").alias("merged"), *found)
    return one.select(*keys, "first.*", body, "line_end", "rank", "match_pass", "merged", *["requirements"] * len(found))


def without_copies(spans: DataFrame, max_per_file: int) -> DataFrame:
    """At most so many spans of a file, and no second span of one chunk_hash unless several chunks are joined in it.

    Spans come in their order; one that is left out counts for nothing."""
    gathered = by_position(spans, "request_id")

    def step(kept: Column, x: Column) -> Column:
        row = x["row"]
        copied = (row["merged"] == 1) & F.exists(kept, lambda k: k["chunk_hash"] == row["chunk_hash"])
        full = F.size(F.filter(kept, lambda k: (k["project_id"] == row["project_id"]) & (k["path"] == row["path"]))) >= max_per_file
        mine = F.array(F.struct(*[row[c].cast("string").alias(c) for c in ("project_id", "path", "chunk_hash")], x["position"].alias("position")))
        return F.when(F.coalesce(copied, F.lit(False)) | full, kept).otherwise(F.concat(kept, mine))

    nothing = F.array().cast("array<struct<project_id: string, path: string, chunk_hash: string, position: bigint>>")
    return chosen(gathered, F.transform(F.aggregate("rows", nothing, step), lambda k: k["position"]), "request_id")


def merge(hits: DataFrame, max_per_file: int = 2) -> DataFrame:
    """Adjacent spans joined, then copies dropped and files cut to their quota; adds merged and numbers position anew.

    Disagreeing spans come first and stay as they are: never joined, dropped or counted.

    hits: request_id, project_id, path, line_start, line_end, text (or size alone: see ``joined``), stale, rank, match_pass, chunk_hash,
    disagreeing, position (unique in a request) and perhaps requirements.  Null paths and projects are files
    of their own; an empty table gives an empty result."""
    others = without_copies(joined(hits.filter(~F.col("disagreeing"))), max_per_file)
    torn = hits.filter("disagreeing").withColumn("merged", F.lit(1).cast("long"))
    both = torn.unionByName(others.select(*torn.columns))
    order = W.partitionBy("request_id").orderBy(F.col("disagreeing").desc(), "position")
    return both.withColumn("position", F.row_number().over(order))


def clip(text: Column, terms: Column, most: int = LONG_CHARS) -> Column:
    """A long span's window that starts a quarter of its size before the first term found."""
    first = F.array_min(F.filter(F.transform(terms, lambda x: F.instr(F.lower(text), x)), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - most // 4)
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, start, F.lit(most)))


def within_budget(items: DataFrame, budget: int | Column) -> DataFrame:
    """Items in order while they fit: request_id, position, size and any others; the one that passes the budget is cut short.

    The budget is a number or a column of the items.  Adds used (before it) and kept_size."""
    room = budget if isinstance(budget, Column) else F.lit(budget)
    used = F.coalesce(F.sum("size").over(W.partitionBy("request_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("used", used).filter(F.col("used") < room).withColumn("kept_size", F.least("size", room - F.col("used")))


def fitting(items: DataFrame, budget: int | Column) -> DataFrame:
    """Items (request_id, position, size and any others) that still fit when their turn comes; a larger one is skipped and later ones may follow.

    The budget is a number or a column of the items, one value a request."""
    room = budget if isinstance(budget, Column) else F.lit(budget)
    gathered = by_position(items.withColumn("room_", room.cast("long")), "request_id")

    def step(s: Column, x: Column) -> Column:
        n = x["row"]["size"].cast("long")
        fits = n <= s["left"]
        return F.struct((s["left"] - F.when(fits, n).otherwise(0)).alias("left"), F.when(fits, F.concat(s["places"], F.array(x["position"]))).otherwise(s["places"]).alias("places"))

    start = F.struct(F.col("rows")[0]["row"]["room_"].alias("left"), F.array().cast("array<bigint>").alias("places"))
    return chosen(gathered, F.aggregate("rows", start, step, lambda s: s["places"]), "request_id").drop("room_")


def whole_budget(hits: DataFrame, claims: DataFrame, nodes: DataFrame, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, claims, nodes) that share one budget of characters a request.

    All: request_id, position, size; claims also trust_state.  Verified claims always stay; then come the
    other claims and the nodes, each if it fits when its turn comes; hits take what is left, the last
    one cut short (kept_size)."""
    total = lambda df, name: df.groupBy("request_id").agg(F.sum("size").alias(name))
    left = lambda df, *spent: reduce(lambda x, y: x.join(y, "request_id", "left"), spent, df)
    room = lambda *names: F.lit(budget) - sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    verified = claims.filter("trust_state = 'verified'")
    first = total(verified, "u1")
    others = fitting(left(claims.filter("trust_state <> 'verified'"), first), room("u1")).drop("u1")
    second = total(others, "u2")
    graph = fitting(left(nodes, first, second), room("u1", "u2")).drop("u1", "u2")
    third = total(graph, "u3")
    spans = within_budget(left(hits, first, second, third), room("u1", "u2", "u3")).drop("u1", "u2", "u3")
    return spans, verified.unionByName(others), graph


def statuses(leaf_hits: DataFrame) -> DataFrame:
    """request_id, leaf_no, status: disagreement, evidence_found, budget_exhausted or unknown.

    leaf_hits: request_id, leaf_no, found, included, conflicts (counts of spans that still hold)."""
    status = F.when(F.col("conflicts") > 0, "disagreement").when(F.col("included") > 0, "evidence_found").when(F.col("found") > 0, "budget_exhausted").otherwise("unknown")
    return leaf_hits.select("request_id", "leaf_no", status.alias("status"))


def line_groups(spans: DataFrame) -> DataFrame:
    """request_id, chunk_id, first_line, last_line: runs of consecutive lines that hold a term.

    spans: request_id, chunk_id, terms (array), text, line_start."""
    lines = spans.select("request_id", "chunk_id", "terms", "line_start", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    held = lines.filter(F.exists("terms", lambda x: F.contains(F.lower("line"), x))).withColumn("no", F.col("line_start") + F.col("i"))
    run = F.col("no") - F.row_number().over(W.partitionBy("request_id", "chunk_id").orderBy("no"))
    return held.withColumn("run", run).groupBy("request_id", "chunk_id", "run").agg(F.min("no").alias("first_line"), F.max("no").alias("last_line")).drop("run")


def protected(text: Column) -> Column:
    """Policy text that is shown whole or not at all."""
    return F.rlike(text, F.lit(t.java(t.PROTECTED))) | (t.negated(text) & F.rlike(text, F.lit(t.java(t.AFFIRM))))


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


# What a packet's hash leaves out.
UNHASHED = {"packet_hash", "checks", "empty_result", "cache", "degraded", "run"}


def packet_hash(packet: dict) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in packet.items() if k not in UNHASHED}).encode()).hexdigest()


def wire_bytes(value) -> int:
    return len(json.dumps(value, sort_keys=True, separators=(",", ":")).encode())
