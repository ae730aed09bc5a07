"""Packing of documents into sequences of a fixed number of tokens by bulk-synchronous best fit.

Documents are encoded, an end id follows each, and only those longer than a sequence are cut.  A piece
of more than half a sequence opens one; the others are placed by bands of halved lengths, longest
first, so that best fit decreasing is followed at the scale of a band.  Each round of a band

* range-sorts the unplaced pieces, by length, together with the gaps, by room;
* sweeps each range from long to short: a piece takes the smallest gap at or above its length that
  the sweep has met.  Of pieces that want the same gap the longer one comes first, then the one of
  the lower hash; the next takes the gap's successor, or what the first has left of it;
* writes pieces with their sequences, pieces without, and gaps with the room they have left, and the
  next round starts from that table.

The first round of a band sorts a gap by its room.  In the next ones gaps are dealt to the lengths
that are left, in proportion to the tokens there.  When a round has placed less than half of them, as
many new sequences are opened as their tokens would fill; the last range of a band opens its own.

Scale: rounds move rows of three numbers, not texts, and gaps too small for a band stay where they
are.  A range is a task of ``rows`` rows, so there are as many as the data needs; the driver sees counts
by length, at most as many as a sequence has tokens.  A band's rounds grow with the logarithm of its
rows at most.  Each round's table lies in the shared folder, so a lost executor repeats
its ranges of one round only.

Texts are encoded word by word: this kind of tokenizer drops white space, and no token spans it.

Defined results: null text counts as empty and is one piece of the end id; repeated rows and ids, null
ids too, are pieces of their own; equal lengths are placed in the order of hashes; an empty table gives
an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, worker_memory
from .learning import slices

CAPACITY, END_ID = 4096, 1
#: Words that a worker remembers, about 200 bytes each.
CACHE = 900_000
#: Rows of a range.
ROWS = 25_000
#: Lengths up to here make the last band.
SMALL = 64
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = ".,;:!?&%$#*"
PIECES = "key long, doc_id {}, piece int, start long, length int, ids binary"
EVENTS = "kind int, id long, size int, sequence_id long"
GAP, PLACED, LEFT = 0, 1, 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Whole texts to ids, by distinct words, of a tokenizer that lower-cases and drops white space."""

    def __init__(self, path: str, most: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Lower-case Latin words need no normalizer, and many are encoded as one text: the last id of a word is marked.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        end = self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if end:
            self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(end)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """Straight from the tokenizer."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def latin(self, words: list[str]) -> list[bytes]:
        """The ids of lower-case Latin words, some hundred at a time."""
        out = []
        texts = [words[i : i + 256] for i in range(0, len(words), 256)]
        for part, e in zip(texts, self.plain.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                out += [x.tobytes() for x in np.split(ids, ends[:-1])]
            else:
                out += self.whole(part)
        return out

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of words, remembered while there is room; marks that end a Latin word are a token group of their own."""
        got, todo, cut = {}, set(), []
        for word in new:
            stem = word.rstrip(MARKS)
            if LATIN.fullmatch(stem):
                rest = word[len(stem) :]
                cut.append((word, stem.lower(), rest))
                todo.update((stem.lower(), rest))
            else:
                todo.add(word)
        known = self.words
        for x in todo:
            if (ids := known.get(x)) is not None:
                got[x] = ids
        todo.difference_update(got)
        latin = [x for x in todo if LATIN.fullmatch(x)]
        others = list(todo.difference(latin))
        fresh = dict(zip(latin, self.latin(latin))) | dict(zip(others, self.whole(others)))
        if len(known) + len(fresh) <= self.most:
            known.update(fresh)
        got |= fresh
        got |= {word: got[stem] + got[rest] for word, stem, rest in cut}
        return [got[x] for x in new]

    def special(self, text: str) -> bool:
        return "<" in text and any(x in text or x in text.lower() for x in self.added)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.special(t)]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = np.frombuffer(ids, "<u4")
        even = [i for i in range(len(texts)) if out[i] is None]
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([texts[i] for i in even], pa.large_string())))
        numbered = lists.flatten().dictionary_encode()
        distinct, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        ids = list(map(self.words.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self.learn([distinct[i] for i in new])):
            ids[i] = x
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, n = (np.cumsum(size) - size)[codes], size[codes]
        stop = np.concatenate([[0], np.cumsum(n)])
        tokens = flat[np.repeat(first - stop[:-1], n) + np.arange(stop[-1])]
        bounds = stop[lists.offsets.to_numpy()].tolist()
        for i, a, b in zip(even, bounds, bounds[1:]):
            out[i] = tokens[a:b]
        return out


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, most: int = CACHE) -> WordEncoder:
    """One a worker process: what a task has learned serves the next."""
    if (path, most) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, most] = WordEncoder(path, most)
    return _ENCODERS[path, most]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, most: int = CACHE) -> DataFrame:
    """Encoded documents as a table: key (unique), doc_id, piece, start, length, ids (little-endian, four bytes each)."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        worker_memory("packing", _ENCODERS.clear)
        encode, key = encoder(path, most), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                rows: list[list] = [[], [], [], [], []]
                for i, ids in enumerate(encode(part)):
                    ids = np.concatenate([ids, end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        for column, x in zip(rows, (at + i, k, start, len(own), own.tobytes())):
                            column.append(x)
                names = batch.column(0).take(pa.array(rows[0], pa.int64()))
                keys = pa.array(np.arange(key, key + len(names)))
                key += len(names)
                yield pa.RecordBatch.from_arrays([keys, names, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.binary())], names=["key", "doc_id", "piece", "start", "length", "ids"])
                at += len(part)
        worker_memory("packing", _ENCODERS.clear)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind)), "pieces")


class Gaps:
    """Gaps by room; the smallest room at or above a length is the lowest bit set from there on."""

    def __init__(self, capacity: int):
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.there = 0

    def put(self, sequence: int, room: int) -> None:
        self.held[room].append(sequence)
        self.there |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        above = self.there >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        sequence = self.held[room].pop()
        if not self.held[room]:
            self.there ^= 1 << room
        return sequence, room


def sweep(capacity: int, opening: bool):
    """The task of a range: rows (kind, id, size, room) by falling size, gaps first, to EVENTS rows."""

    def run(batches):
        gaps, out = Gaps(capacity), ([], [], [], [])

        def put(*row):
            for column, x in zip(out, row):
                column.append(x)

        for batch in batches:
            for kind, own, size, room in zip(*[c.to_pylist() for c in batch.columns]):
                if kind == GAP:
                    gaps.put(own, room)
                    continue
                found = gaps.take(size) or (opening and (own, capacity))
                if not found:
                    put(LEFT, own, size, None)
                    continue
                sequence, room = found
                put(PLACED, own, size, sequence)
                if room > size:
                    gaps.put(sequence, room - size)
        for room, held in enumerate(gaps.held):
            for sequence in held:
                put(GAP, sequence, room, None)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["kind", "id", "size", "sequence_id"])

    return run


def dealt(gaps: DataFrame, demand: dict[int, int], step: int) -> DataFrame:
    """The gaps (id, room) with the length each is to meet: drawn by a hash in proportion to the tokens left that fit it."""
    sizes = np.array(sorted(demand), np.int64)
    tokens = np.cumsum(sizes * np.array([demand[s] for s in sizes.tolist()], np.int64)).astype(np.float64)

    def run(batches):
        for batch in batches:
            room, share = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            fits = np.searchsorted(sizes, room, side="right") - 1
            at = np.minimum(np.searchsorted(tokens, share * tokens[fits], side="right"), fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes[at].astype(np.int32))], names=["id", "room", "size"])

    share = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(1 << 30)) / float(1 << 30)
    return gaps.select("id", "room", share.alias("share")).mapInArrow(run, "id long, room int, size int")


def best_fit(items: DataFrame, capacity: int = CAPACITY, rows: int = ROWS) -> DataFrame:
    """key and sequence_id of (key, length) rows, lengths of 1 to ``capacity``; read twice and more, so from a table."""
    own = items.select(F.col("key").alias("id"), F.col("length").alias("size"))
    lengths = {r["size"]: r["n"] for r in own.groupBy("size").agg(F.count("*").alias("n")).collect()}
    half = capacity // 2
    long = own.filter(F.col("size") > half)
    placed = long.select("id", F.col("id").alias("sequence_id"))
    gaps = long.filter(F.col("size") < capacity).select("id", (capacity - F.col("size")).cast("int").alias("room"))
    rooms = {capacity - s: n for s, n in lengths.items() if half < s < capacity}
    high, opened = half, 0
    while high > 0:
        low = high // 2 if high > SMALL else 0
        left = own.filter((F.col("size") > low) & (F.col("size") <= high))
        demand = {s: n for s, n in lengths.items() if low < s <= high}
        step, before = 0, None
        while demand:
            least, tokens = min(demand), sum(s * n for s, n in demand.items())
            meet, met = gaps.filter(F.col("room") >= least), sum(n for r, n in rooms.items() if r >= least)
            parts = max(1, math.ceil((sum(demand.values()) + met) / rows))
            alone = parts == 1 or tokens == before  # one range is left, or a round has placed nothing
            if not alone and (not met or step > 1 and 2 * tokens > before):
                new = max(1, tokens // capacity)
                fresh = own.sparkSession.range(opened, opened + new).select((-1 - F.col("id")).alias("id"), F.lit(capacity).alias("room"))
                meet, opened = meet.union(fresh), opened + new
            if parts == 1:
                aimed = meet.select("id", "room", F.least("room", F.lit(high)).alias("size"))
            elif step:
                aimed = dealt(meet, demand, step)
            else:
                aimed = dealt(meet.filter(F.col("room") > high), demand, step).union(meet.filter(F.col("room") <= high).select("id", "room", F.col("room").alias("size")))
            events = aimed.select(F.lit(GAP).alias("kind"), "id", "size", "room").union(left.select(F.lit(LEFT), "id", "size", F.lit(0)))
            order = F.col("size").desc(), F.xxhash64("id")
            ranged = events.repartitionByRange(parts, *order).sortWithinPartitions(order[0], "kind", order[1])
            table = materialize(ranged.mapInArrow(sweep(capacity, alone), EVENTS), "sweep")
            counts = table.groupBy("kind", "size").agg(F.count("*").alias("n")).filter(F.col("kind") != PLACED).collect()
            placed = placed.union(table.filter(F.col("kind") == PLACED).select("id", "sequence_id"))
            gaps = gaps.filter(F.col("room") < least).union(table.filter(F.col("kind") == GAP).select("id", F.col("size").alias("room")))
            rooms = {r: n for r, n in rooms.items() if r < least}
            for r in counts:
                if r["kind"] == GAP:
                    rooms[r["size"]] = rooms.get(r["size"], 0) + r["n"]
            left = table.filter(F.col("kind") == LEFT).select("id", "size")
            demand = {r["size"]: r["n"] for r in counts if r["kind"] == LEFT}
            step, before = step + 1, tokens
        high = low
    return placed.select(F.col("id").alias("key"), "sequence_id")


def packed(own: DataFrame, capacity: int = CAPACITY, rows: int = ROWS) -> DataFrame:
    """key, sequence_id and offset of the rows of ``pieces``: in a sequence the longer pieces come first."""
    sizes = own.select("key", "length")
    places = materialize(best_fit(sizes, capacity, rows), "places").join(sizes, "key")
    before = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "key").rowsBetween(W.unboundedPreceding, -1)
    return places.select("key", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def sequences(own: DataFrame, places: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, keys of its pieces, their lengths, and the ids one after the other."""
    each = F.sort_array(F.collect_list(F.struct("offset", "key", "length", "ids")))
    held = own.join(places, "key").groupBy("sequence_id").agg(each.alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return held.select("sequence_id", F.col("held.key").alias("keys"), F.col("held.length").alias("lengths"), ids.alias("ids"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    own = pieces(docs)
    rows = own.select("key", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(packed(own), "key").drop("key")
