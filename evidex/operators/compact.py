"""Packets within a number of bytes, and the way back from them to the text.

Spans become excerpts, excerpts rows with the bytes of their JSON, and what a packet shows is decided by
sums over a request's rows: all of them, or the conflict first, then what fits in order, then the
leading lines of the first that does not.  Bodies are put together once, from what was chosen.

Defined results: a packet without evidence has an empty list; null texts are empty; a stale span shows
no text; equal places keep the order of the evidence; an empty table gives an empty result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.store import kept
from . import evidence, packet

# References that are listed, claims that are listed and their length, least room for a cut span, least budget.
REFERENCES, CLAIMS, CLAIM_CHARS, LEAST_ROOM, LEAST_BUDGET = 3, 3, 200, 300, 256
#: Bytes of the keys and numbers around the evidence, and of the note that something is left out.
AROUND, NOTE = 110, 150


def json_bytes(*columns) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns)))


def excerpts(packets: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """request_id, place, path, requirements, disagreeing, stale, line_start, line_end, text, expand: what each span shows at most.

    That is each stretch of lines that hold a term; the whole span if it is protected or holds none; no
    text of a stale one.  ``expand`` is the reference by which the lines are found again.

    packets: request_id, query, evidence (path, line_start, line_end, text, stale, disagreeing and perhaps
    project_id, source_hash, requirements); terms: request_id, terms, in place of the query's own."""
    own = packets.select("request_id", "evidence", F.regexp_extract_all(t.fold(F.coalesce("query", F.lit(""))), F.lit("([a-z0-9_][a-z0-9_.-]{2,})"), 0).alias("terms"))
    asked = own if terms is None else own.drop("terms").join(terms, "request_id", "left")
    fields = packets.schema["evidence"].dataType.elementType.names
    of = lambda name, kind: (F.col(f"e.{name}") if name in fields else F.lit(None)).cast(kind).alias(name)
    spans = asked.select("request_id", "terms", F.posexplode("evidence").alias("no", "e")).select(
        "request_id", "terms", "no", of("project_id", "string"), of("path", "string"), of("source_hash", "string"), of("requirements", "array<int>"),
        F.coalesce(of("stale", "boolean"), F.lit(False)).alias("stale"), F.coalesce(of("disagreeing", "boolean"), F.lit(False)).alias("disagreeing"),
        F.coalesce(of("line_start", "int"), F.lit(1)).alias("first"), of("line_end", "int"), F.coalesce(of("text", "string"), F.lit("")).alias("body"),
    )
    lines = F.split("body", "\n")
    holds = lambda line: F.exists("terms", lambda x: F.contains(F.lower(line), x))
    held = F.filter(F.transform(lines, lambda line, i: F.when(holds(line), i)), lambda i: i.isNotNull())
    apart = lambda step: F.filter("held", lambda i: ~F.array_contains("held", i + step))
    last = F.greatest(F.when(F.col("stale"), F.lit(1)).otherwise(F.size(lines)), F.coalesce(F.col("line_end") - F.col("first") + 1, F.lit(1))) - 1
    whole = F.col("stale") | (F.size("held") == 0) | packet.protected(F.col("body"))
    pair = "array<struct<a: int, b: int>>"
    stretches = F.when(whole, F.array(F.struct(F.lit(0).alias("a"), last.alias("b"))).cast(pair)).otherwise(F.arrays_zip(apart(-1), apart(1)).cast(pair))
    each = spans.withColumn("held", held).withColumn("s", F.explode(stretches)).select("*", "s.a", "s.b")
    first, end = F.col("first") + F.col("a"), F.col("first") + F.col("b")
    shown = F.when(F.col("stale"), "").otherwise(F.array_join(F.slice(F.split("body", "\n"), F.col("a") + 1, F.col("b") - F.col("a") + 1), "\n"))
    back = F.struct("project_id", "path", F.col("source_hash").alias("expected_hash"), first.alias("line_start"), end.alias("line_end"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy("no", "a"))
    return each.select("request_id", place.alias("place"), "path", "requirements", "disagreeing", "stale", first.alias("line_start"), end.alias("line_end"), shown.alias("text"), back.alias("expand"))


ITEM = ("path", "requirements", "disagreeing", "stale", "line_start", "line_end", "text", "expand")


def heads(packets: DataFrame, budget: int) -> DataFrame:
    """request_id, told, head (JSON fields), head_bytes: what a packet says besides its evidence.

    The query and the claims go, and requirements keep number and status only, where they would take four tenths of the budget."""
    have = set(packets.columns)
    said = [F.col("packet_hash").alias("source_packet_hash")] if "packet_hash" in have else []
    needs = F.col("requirements") if "requirements" in have else F.array().cast("array<struct<leaf_no: int, status: string>>")
    few = F.transform(needs, lambda r: F.struct(r["leaf_no"].alias("leaf_no"), r["status"].alias("status")))
    claims = [F.transform(F.slice("claims", 1, CLAIMS), lambda c: F.struct(c["claim_id"].alias("claim_id"), c["trust_state"].alias("trust_state"), F.substring(c["display_text"], 1, CLAIM_CHARS).alias("display_text"))).alias("claims")] if "claims" in have else []
    fields = lambda *xs: F.regexp_extract(F.to_json(F.struct(*xs)), r"(?s)^\{(.*)\}$", 1)
    long, short = fields(*said, "query", needs.alias("requirements"), *claims), fields(*said, few.alias("requirements"))
    head = F.when(F.octet_length(long) > 0.4 * budget, short).otherwise(long)
    status = F.col("status") if "status" in have else F.lit("ok")
    return packets.select("request_id", status.alias("told"), head.alias("head")).withColumn("head_bytes", F.octet_length("head") + F.octet_length("told"))


def compacted(packets: DataFrame, budget: int = 4000, terms: DataFrame | None = None) -> DataFrame:
    """request_id, packet_json, n_bytes: each packet within a number of bytes (UTF-8, ``byte_count`` included).

    Everything is shown if it fits.  Else a conflict shows whole, or by its smallest witness, or not at all
    (insufficient_budget): never by one side.  Other excerpts follow in order, each that still fits; the
    first one left out shows its leading whole lines if there is room for some.  ``omitted`` names up to
    three that are left out, ``degraded`` how many were found and how many bytes all of them take."""
    budget = max(LEAST_BUDGET, budget)
    by = W.partitionBy("request_id")
    found = excerpts(packets, terms).withColumn("n", json_bytes(*ITEM) + 1).withColumn("ref", json_bytes(F.lit("conflict_set").alias("reason"), "expand") + 1)
    found = found.join(heads(packets, budget).select("request_id", "head_bytes"), "request_id")
    room = budget - F.col("head_bytes") - AROUND
    torn_bytes = F.sum(F.when(F.col("disagreeing"), F.col("n")).otherwise(0)).over(by)
    found = found.withColumn("torn", torn_bytes).withColumn("all", F.sum("n").over(by))
    found = kept(found.withColumn("fits", F.col("all") <= room).withColumn("room", room - NOTE - F.least(F.lit(REFERENCES), F.count("*").over(by)) * F.max("ref").over(by)), "excerpts")
    # a conflict that does not fit whole, by two of its excerpts
    tight = found.filter(~F.col("fits") & F.col("disagreeing") & (F.col("torn") > F.col("room")))
    sides = tight.select("request_id", F.col("place").alias("chunk_id"), "path", "text")
    shown = evidence.conflict_witness(sides).select("request_id", F.explode(F.array("negated_chunk", "affirmed_chunk")).alias("place"))
    pair = tight.join(shown, ["request_id", "place"]).select("request_id", "place", F.sum("n").over(by).alias("pair_bytes"))
    marked = found.join(pair, ["request_id", "place"], "left").withColumn("pair", F.max("pair_bytes").over(by))
    by_pair = F.col("torn") > F.col("room")
    used = F.when(~by_pair, F.col("torn")).when(F.col("pair") <= F.col("room"), F.col("pair"))
    marked = marked.withColumn("used", used).withColumn("first", F.col("fits") | (F.col("disagreeing") & F.col("used").isNotNull() & (~by_pair | F.col("pair_bytes").isNotNull())))
    marked = kept(marked, "marked")
    # the rest of the room for plain excerpts; none beside a conflict that is not shown
    plain = marked.filter(~F.col("fits") & ~F.col("disagreeing") & F.col("used").isNotNull())
    sized = plain.select("request_id", F.col("place").alias("position"), F.col("n").alias("size"), (F.col("room") - F.col("used")).alias("left"))
    taken = kept(packet.fitting(sized, F.col("left")).select("request_id", F.col("position").alias("place"), F.lit(True).alias("taken"), "size"), "taken")
    spent = taken.groupBy("request_id").agg(F.sum("size").alias("spent"))
    rest = plain.join(taken.drop("size"), ["request_id", "place"], "left_anti").join(spent, "request_id", "left").filter(~F.col("stale") & ~packet.protected(F.col("text")))
    rest = rest.withColumn("left", F.col("room") - F.col("used") - F.coalesce("spent", F.lit(0))).filter(F.col("left") >= LEAST_ROOM)
    next_one = rest.groupBy("request_id").agg(F.min_by(F.struct("place", "text", "n", "left"), "place").alias("x")).select("request_id", "x.*")
    cut = next_one.withColumn("lines", leading(F.split("text", "\n"), F.col("left") - (F.col("n") - json_bytes("text")) - 30)).filter("lines > 0").select("request_id", "place", "lines")
    each = marked.join(taken.drop("size"), ["request_id", "place"], "left").join(cut, ["request_id", "place"], "left")
    part = F.col("lines").isNotNull()
    each = each.withColumn("text", F.when(part, F.array_join(F.slice(F.split("text", "\n"), F.lit(1), F.col("lines")), "\n")).otherwise(F.col("text"))).withColumn("line_end", F.when(part, F.col("line_start") + F.col("lines") - 1).otherwise(F.col("line_end")))
    inline = F.col("first") | F.col("taken").isNotNull() | part
    reason = F.when(part, "truncated").when(F.col("disagreeing"), "conflict_set").otherwise("byte_budget")
    item = F.struct("place", F.struct(*ITEM, F.when(part, True).alias("truncated")).alias("item"))
    gone = F.struct("place", F.struct(reason.alias("reason"), "expand").alias("item"))
    sums = each.groupBy("request_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(inline, item))), lambda x: x["item"]).alias("evidence"),
        F.transform(F.sort_array(F.collect_list(F.when(~inline | part, gone))), lambda x: x["item"]).alias("omitted"),
        F.count("*").alias("found"), F.max("all").alias("all"), F.first("fits").alias("fits"), F.max("disagreeing").alias("torn"), F.max("used").alias("used"),
    )
    return bodies(heads(packets, budget).join(sums, "request_id", "left"), budget)


def bodies(chosen: DataFrame, budget: int) -> DataFrame:
    """JSON of what was chosen; by its head alone where even that is too large."""
    hidden = F.col("torn") & F.col("used").isNull() & ~F.col("fits")
    status = F.when(hidden, "insufficient_budget").otherwise(F.col("told"))
    inline, omitted = F.coalesce(F.size("evidence"), F.lit(0)), F.coalesce(F.size("omitted"), F.lit(0))
    listed = lambda name: F.coalesce(F.to_json(name), F.lit("[]"))
    why = F.when(inline == 0, "evidence_found_but_none_fits_budget").otherwise("some_evidence_left_out")
    note = F.to_json(F.struct("found", inline.alias("inline"), (F.col("all") + F.col("head_bytes") + AROUND).alias("needs_bytes"), why.alias("reason")))
    degraded = F.when(omitted > 0, F.concat(F.lit(',"degraded":'), note)).otherwise("")
    middle = F.concat(
        F.lit('{"status":"'), status, F.lit('"'), F.when(F.col("head") != "", F.concat(F.lit(","), F.col("head"))).otherwise(""), F.lit(',"evidence":'), listed("evidence"),
        F.lit(',"omitted":'), listed(F.slice("omitted", 1, REFERENCES)), F.lit(',"omitted_count":'), omitted.cast("string"), degraded, F.lit(f',"byte_budget":{budget}'),
    )
    least = F.concat(F.lit('{"status":"insufficient_budget","evidence":[],"omitted_count":'), F.coalesce("found", F.lit(0)).cast("string"), F.lit(f',"byte_budget":{budget}'))
    full, small = stamped(middle), stamped(least)
    body = F.when(F.octet_length(full) <= budget, full).otherwise(small)
    return chosen.select("request_id", body.alias("packet_json")).withColumn("n_bytes", F.octet_length("packet_json"))


def stamped(opened: Column) -> Column:
    """An open JSON object closed by its own size: the number of digits that agrees with the size it makes."""
    before = F.octet_length(opened) + len(',"byte_count":}')
    size = reduce(F.coalesce, [F.when(F.length((before + d).cast("string")) == d, before + d) for d in range(1, 10)])
    return F.concat(opened, F.lit(',"byte_count":'), size.cast("string"), F.lit("}"))


def leading(lines: Column, room: Column) -> Column:
    """How many leading lines fit into some bytes of JSON."""
    size = lambda line: F.octet_length(F.to_json(F.array(line))) - 2
    start = F.struct(room.cast("long").alias("left"), F.lit(0).alias("lines"))

    def step(s: Column, line: Column) -> Column:
        left = s["left"] - size(line)
        return F.struct(left.alias("left"), (s["lines"] + (left >= 0).cast("int")).alias("lines"))

    return F.aggregate(lines, start, step, lambda s: s["lines"])


def expand(sources: DataFrame, refs: DataFrame, budget: int = 4000, allowed: DataFrame | None = None) -> DataFrame:
    """request_id, status, text, line_end, next_line of references to spans.

    sources: project_id, path, content_hash, text, active; refs: request_id, project_id, path,
    expected_hash, line_start, line_end; allowed: project_ids a caller may read.  unavailable: no such
    active file, or not an allowed one; stale: the file has another hash by now; insufficient_budget: not
    a line fits, or the text is protected and does not fit whole; next_line: where the next reference begins."""
    budget = max(LEAST_BUDGET, budget)
    live = sources.filter("active").select("project_id", "path", "content_hash", "text")
    live = live if allowed is None else live.join(allowed.select("project_id").distinct(), "project_id", "left_semi")
    met = refs.join(live, ["project_id", "path"], "left")
    same = F.col("content_hash").eqNullSafe(F.col("expected_hash")) & F.col("content_hash").isNotNull()
    part = F.slice(F.split("text", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    read = met.withColumn("part", F.when(same, part)).withColumn("whole", F.array_join("part", "\n"))
    fits = F.octet_length(F.to_json(F.array("whole"))) - 2 <= budget
    n = F.when(fits, F.size("part")).when(packet.protected(F.col("whole")), F.lit(0)).otherwise(leading(F.col("part"), F.lit(budget)))
    cut = read.withColumn("n", F.when(F.col("part").isNotNull(), n)).withColumn("done", F.col("n") == F.size("part"))
    status = F.when(F.col("content_hash").isNull(), "unavailable").when(~same, "stale").when(F.col("done") | (F.col("n") > 0), "ok").otherwise("insufficient_budget")
    text = F.when(F.col("n").isNotNull(), F.array_join(F.slice("part", F.lit(1), F.col("n")), "\n"))
    end = F.when(F.col("done"), F.col("line_end")).when(F.col("n") > 0, F.col("line_start") + F.col("n") - 1)
    return cut.select("request_id", status.alias("status"), text.alias("text"), end.alias("line_end"), F.when(~F.col("done"), F.col("line_start") + F.col("n")).alias("next_line"))
