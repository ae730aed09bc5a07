"""Token-ID output: fixed-width bit packing with block offsets.

Texts are encoded with a public byte-level BPE tokenizer, an end id follows each document, and the
ids of a run of documents, in ascending doc_id order, are packed into blocks of the vocabulary's
minimum number of bits.  A packed file set is a folder of Parquet parts, one row per block:

    shard, block   place of the block: shards ascend by doc_id, blocks ascend within a shard
    bits           width of an id
    n_ids          ids in the block
    doc_ids        the documents of the block, in order (an id may be null or repeat)
    offsets        n_docs + 1 positions, in ids, of the documents in the block
    payload        ceil(n_ids * bits / 8) bytes, ids from the least significant bit on

Spark's own writer commits the parts, so a lost executor's task is simply run again, and the folder
may lie in any store that Spark reads.  ``unpack`` restores a block, or any slice of it, with
numpy; ``read_document`` reads one document by its block and offsets.

Scale: one shuffle of the texts, by ranges of doc_id; within a task documents stream in order, so
memory is bounded by one Arrow batch and one block.  Global starts come from shard totals (a row a
task) and block totals within a shard, never from a window over all documents.

The encoder splits a text only where this kind of tokenizer always starts a new word: before a
single space between two non-space characters, around such a line end, and between a letter and
the punctuation that ends a word.  It encodes each distinct piece once, keeps a bounded number
of pieces a worker, and joins their ids, which are those of the whole text.

Defined results: null text counts as empty and is the end id alone; null ids come first; rows that
share an id are ordered by their texts; an empty table gives an empty result; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, worker_memory

SPLIT = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: Characters besides space and line end that are white space (to Python or to the tokenizer), and the mark used below.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["\0"]
BLOCK_IDS = 1 << 18
#: Pieces that a worker remembers, about 200 bytes each: a task beside others' memory may ask for fewer.
CACHE = 900_000
BLOCKS = "shard int, block int, bits int, n_ids long, doc_ids array<long>, offsets array<long>, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids of fewer than 2**bits, from the least significant bit on."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """ids start to stop of a block, without touching the rest of it."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    first = start * bits // 8
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, -(-stop * bits // 8) - first, first), bitorder="little")
    skip = start * bits - first * 8
    planes = raw[skip : skip + (stop - start) * bits].reshape(-1, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Encoder:
    """Whole texts to ids (as bytes of the type ``unit``), by distinct words."""

    def __init__(self, path: str, most: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.unit, self.code = ("<u2", "H") if self.vocabulary <= 1 << 16 else ("<u4", "I")
        self.width = int(self.unit[-1])
        self.pieces: dict[str, bytes] = {"": b""}
        # An added token in a text may span the places where pieces end; such texts are encoded whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = added
        # A word of letters is a single pre-token, so the pattern that finds pre-tokens need not run on it.
        self.bare = Tokenizer.from_file(path)
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.post_processor = None

    def plain(self, texts: list[str]) -> list[bytes]:
        """Straight from the tokenizer."""
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of new pieces, kept while there is room: frequent pieces come early.

        Punctuation after a letter is a pre-token of its own, so a word is encoded without it."""
        known, cut, todo = self.pieces, [], set()
        for p in new:
            c = p.rstrip(".,;:!?&%$#*")
            if c and len(c) < len(p) and c[-1].isalpha():
                rest = p[len(c) :]
                cut.append((p, c, rest))
                todo.add(c)
                todo.add(rest)
            else:
                todo.add(p)
        got = {p: x for p in todo if (x := known.get(p)) is not None}
        todo.difference_update(got)
        letters = [p for p in todo if p.isalpha() or p[1:].isalpha() and p[0] == " "]
        others = list(todo.difference(letters))
        for i in range(0, len(letters), 4096):
            part = letters[i : i + 4096]
            got.update(zip(part, [array(self.code, e.ids).tobytes() for e in self.bare.encode_batch_fast(part, add_special_tokens=False)]))
        for i in range(0, len(others), 4096):
            got.update(zip(others[i : i + 4096], self.plain(others[i : i + 4096])))
        for p, c, rest in cut:
            got[p] = got[c] + got[rest]
        if len(known) + len(got) <= self.most:
            known.update(got)
        return list(map(got.__getitem__, new))

    def regular(self, text: str) -> bool:
        """Single spaces and line ends between words, no other white space, no added token."""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return False
        return not any(x in text for x in self.added) and not any(c in text for c in OTHER_SPACE)

    def odd(self, text: str) -> bytes:
        """The ids of any other text, by the places where a new word is certain; with an added token, as a whole."""
        if any(x in text for x in self.added):
            return self.plain([text])[0]
        first, *rest = SPLIT.split(text)
        pieces = [first, *[" " + x for x in rest]]
        return b"".join(self.learn(pieces))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        even = [i for i, t in enumerate(texts) if t and self.regular(t)]
        if even:
            # Each word takes the space before it, a line end stands alone; Arrow numbers the distinct pieces.
            marked = pc.replace_substring(pc.replace_substring(pa.array([texts[i] for i in even], pa.large_string()), " ", "\0 "), "\n", "\0\n\0")
            lists = pc.split_pattern(marked, "\0")
            numbered = lists.flatten().dictionary_encode()
            distinct, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
            ids = list(map(self.pieces.get, distinct))
            new = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(new, self.learn([distinct[i] for i in new])):
                ids[i] = x
            flat, size = np.frombuffer(b"".join(ids), self.unit), np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
            start, n = np.cumsum(size) - size, size[codes]
            stop = np.cumsum(n)
            tokens = flat[np.repeat(start[codes] - (stop - n), n) + np.arange(stop[-1])]
            ends = stop[lists.offsets.to_numpy()[1:] - 1]
            for i, a, b in zip(even, [0, *ends[:-1].tolist()], ends.tolist()):
                out[i] = tokens[a:b].tobytes()
        for i in set(range(len(texts))).difference(even):
            out[i] = self.odd(texts[i]) if texts[i] else b""
        return out


def encoder(path: str, most: int = CACHE) -> Encoder:
    """One a worker process: what a task has learned serves the next."""
    if (path, most) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, pieces: int = CACHE) -> None:
    """Encode (doc_id, text) and write the packed file set at ``path``."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("tokens", _ENCODERS.clear)
        encode_texts, shard, block = encoder(tokenizer, pieces), TaskContext.get().partitionId(), 0
        width, unit = encode_texts.width, encode_texts.unit
        bits, end = bits_for(encode_texts.vocabulary), np.array([end_id], encode_texts.unit).tobytes()
        names, held, size = [], [], 0

        def full():
            nonlocal names, held, size, block
            offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in held])])
            row = {"shard": shard, "block": block, "bits": bits, "n_ids": int(offsets[-1]), "doc_ids": names, "offsets": offsets.tolist(), "payload": pack(np.frombuffer(b"".join(held), unit), bits)}
            names, held, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):  # some 8 MB of text at a time, at least one document
                to, room = at + 1, 8_000_000 - len(texts[at].as_py())
                while to < len(ids) and room > 0:
                    room -= texts[to].as_buffer().size
                    to += 1
                for name, tokens in zip(ids[at:to], encode_texts(texts.slice(at, to - at).to_pylist())):
                    names.append(name)
                    held.append(tokens + end)
                    size += len(tokens) // width + 1
                    if size >= BLOCK_IDS:
                        yield full()
                at = to
        if held:
            yield full()
        worker_memory("tokens", _ENCODERS.clear)

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    """Per document of a packed file set: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    first = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("shard_ids").over(first), F.lit(0)).alias("base"))
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = blocks.select("shard", "block", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    starts = inside.join(bases, "shard").select("shard", "block", (F.col("base") + F.col("within")).alias("block_start"))

    def documents(batches):
        worker_memory("tokens", _ENCODERS.clear)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, bits, n_ids = (batch.column(k)[i].as_py() for k in range(4))
                names, offsets = batch.column(4)[i].values, batch.column(5)[i].values.to_numpy()
                ids = memoryview(unpack(batch.column(6)[i].as_buffer(), bits, 0, n_ids)).cast("B")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((offsets[:-1] * 4).tolist(), (offsets[1:] * 4).tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), names, pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    each = blocks.mapInArrow(documents, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return each.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row that has its id), by block and offset."""
    found = []
    for row in spark.read.schema(BLOCKS).parquet(path).filter(F.array_contains("doc_ids", doc_id)).sort("shard", "block").toLocalIterator():
        at = [i for i, x in enumerate(row["doc_ids"]) if x == doc_id]
        found += [unpack(row["payload"], row["bits"], row["offsets"][i], row["offsets"][i + 1]) for i in at]
    return found


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, pieces: int = CACHE) -> DataFrame:
    """Write the packed file set to the shared folder and read it back; ``pieces``: how many a worker remembers."""
    path = scratch_path(docs.sparkSession, "packed")
    write_packed(docs, path, tokenizer or default_tokenizer(), end_id, pieces)
    return read_packed(docs.sparkSession, path)
