"""LM scoring by deleted interpolation.

The model mixes the maximum-likelihood estimate of a word after its predecessor with a smoothed
unigram estimate.  The weight depends on how often the predecessor was seen, in buckets of powers
of two, and is learned by expectation-maximisation on held-out counts: every training occurrence is
deleted from the counts that predict it.  A text's tokens are its words and one end; the
predecessor of the first is a start mark.

How it runs.  Documents are cut into blocks of about ``block_tokens`` tokens, written once as a
table with block-local word numbers.  Each block asks for the corpus counts of its distinct words
and pairs: sorted 64-bit hashes, split by ranges of the hash, travel as packed arrays; a range sums
the training counts of all blocks and answers each block.  So the shuffle carries a few bytes per
distinct pair of a block, not a row per token; a word that is in every text is one key a block; and
a range's size is bounded, because the number of ranges follows the number of keys.  The
weights come from a histogram of at most some thousand cells, summed over all blocks.  Counts,
weights and scores use every document; nothing is sampled.  Hashes of 64 bits stand for words.

Defined results: null text counts as empty and is one end token; without training documents every
word has probability 1 by the base formula (no counts, empty vocabulary); repeated rows count
each; null ids belong to the fold of the empty text; an empty table gives an empty result; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, drop_path, scratch_path
from .learning import slices

FOLDS, HELD = 10, 0
ALPHA = 0.1
START_HASH = np.uint64(0x5851F42D4C957F2D)
END_HASH = 0x14057B7EF767814F
FINE = 8  # cells of the histogram per doubling of the ratio of the two estimates
RANGE_KEYS = 2_000_000


def planes(x: np.ndarray, width: int) -> bytes:
    """Integers by byte planes, compressed: the high planes of small numbers cost nothing."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def from_planes(b: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def each_row(batches):
    """The rows of some batches as dicts, one at a time: a row is a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def write_blocks(docs: DataFrame, path: str, block_tokens: int) -> None:
    """The documents as blocks: ids, folds, offsets, block-local tokens and the hashes of the local words."""
    kind = docs.schema["doc_id"].dataType
    held = (crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held")
    arrow_kind = None

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        numbers, tokens, ids, folds, ends = Numbers(), array("I"), [], [], []
        numbers[b""] = 0  # the end

        def full():
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            hashes[0] = END_HASH
            # Frequent words get small numbers, which compress best.
            local = np.frombuffer(tokens, np.uint32)
            order = np.argsort(-np.bincount(local, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            local, hashes = rank[local], hashes[order]
            stops, fold = np.array(ends, np.int64), np.array(folds, bool)
            lengths = np.diff(stops, prepend=0)
            row = [(part << 32) | serial, len(local), ids, planes(stops, 8), planes(fold, 1), planes(local, 4), planes(hashes, 8), int(lengths[~fold].sum()), int((~fold).sum())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.list_(arrow_kind), *[pa.binary()] * 4, pa.int64(), pa.int64()))], names=["block", "n_tokens", "ids", "ends", "held", "tokens", "hashes", "train_tokens", "train_docs"])

        for batch in batches:
            arrow_kind = batch.column(0).type
            names, flags, at = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for texts in slices(batch.column(1)):
                for text in texts:
                    tokens.extend(map(numbers.__getitem__, text.encode("utf-8", "replace").lower().split()))
                    tokens.append(0)
                    ids.append(names[at])
                    folds.append(flags[at])
                    ends.append(len(tokens))
                    at += 1
                    if len(tokens) >= block_tokens:
                        yield full()
                        serial += 1
                        numbers, tokens, ids, folds, ends = Numbers(), array("I"), [], [], []
                        numbers[b""] = 0
        if ids:
            yield full()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("ends", "held", "tokens", "hashes")], T.StructField("train_tokens", T.LongType()), T.StructField("train_docs", T.LongType())])
    docs.select("doc_id", "text", held).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def pairs_of(tokens: np.ndarray, ends: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (predecessor, word) pairs as numbers, ascending, and each token's place among them."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], ends[:-1]])] = n_words
    return np.unique(before * (n_words + 1) + tokens, return_inverse=True)


def pair_hashes(pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    n = len(hashes)
    with_start = np.append(hashes, START_HASH)
    k = with_start[pairs // (n + 1)] * np.uint64(0x9E3779B97F4A7C15) + (with_start[pairs % (n + 1)] ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    k ^= k >> np.uint64(31)
    k *= np.uint64(0x94D049BB133111EB)
    return k ^ (k >> np.uint64(29))


def asked(blocks: DataFrame, bits: int) -> DataFrame:
    """(kind, range, block, keys, counts): what each block asks of each range, with its own training counts."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)

    def run(batches):
        for row in each_row(batches):
            tokens, ends = from_planes(row["tokens"], 4), from_planes(row["ends"], 8).astype(np.int64)
            hashes, held = from_planes(row["hashes"], 8), from_planes(row["held"], 1).astype(bool)
            train = np.repeat(~held, np.diff(ends, prepend=0))
            pairs, place = pairs_of(tokens.astype(np.int64), ends, len(hashes))
            out = []
            for kind, keys, counts in ((0, hashes, np.bincount(tokens[train], minlength=len(hashes))), (1, pair_hashes(pairs, hashes), np.bincount(place[train], minlength=len(pairs)))):
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                stops = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                for r, (a, b) in enumerate(zip(stops[:-1], stops[1:])):
                    if b > a:
                        out.append((kind, r, row["block"], planes(np.diff(keys[a:b], prepend=np.uint64(0)), 8), planes(counts[a:b], 8)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "range", "block", "keys", "counts"])

    return blocks.select("block", "ends", "held", "tokens", "hashes").mapInArrow(run, "kind int, range int, block long, keys binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """(block, kind, range, counts, known): the corpus counts of each question; known: words seen in training, once a range."""

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        lists = [np.cumsum(from_planes(k, 8), dtype=np.uint64) for k in pdf["keys"]]
        keys, place = np.unique(np.concatenate(lists), return_inverse=True)
        # integers, not float weights: counts may pass 2**53
        totals = np.zeros(len(keys), np.uint64)
        np.add.at(totals, place, np.concatenate([from_planes(c, 8) for c in pdf["counts"]]))
        stops = np.cumsum([len(x) for x in lists])
        replies = [planes(x, 8) for x in np.split(totals[place], stops[:-1])]
        known = int((totals > 0).sum()) if pdf["kind"].iloc[0] == 0 else 0
        return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "range": pdf["range"], "counts": replies, "known": [known, *[0] * (len(pdf) - 1)]})

    return questions.groupBy("kind", "range").applyInPandas(sum_up, "block long, kind int, range int, counts binary, known long")


def counted(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks with the corpus counts of their words and pairs, in the order of ``pairs_of``."""
    fields = [f for f in blocks.schema.fields if f.name != "hashes"]
    schema = T.StructType([*fields, T.StructField("words", T.BinaryType()), T.StructField("pairs", T.BinaryType()), T.StructField("known", T.LongType())])

    def put(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        tokens, ends = from_planes(row["tokens"], 4).astype(np.int64), from_planes(row["ends"], 8).astype(np.int64)
        hashes = from_planes(row["hashes"], 8)
        found, right = {}, right.sort_values(["kind", "range"])
        for kind, keys in ((0, hashes), (1, pair_hashes(pairs_of(tokens, ends, len(hashes))[0], hashes))):
            counts = np.empty(len(keys), np.uint64)
            counts[np.argsort(keys, kind="stable")] = np.concatenate([from_planes(c, 8) for c in right.loc[right["kind"] == kind, "counts"]])
            found[kind] = planes(counts, 8)
        return left.drop(columns="hashes").assign(words=[found[0]], pairs=[found[1]], known=int(right["known"].sum()))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(put, schema)


def estimates(row: dict, total: int, vocabulary: int, train_docs: int, deleted: bool) -> tuple[np.ndarray, ...]:
    """Per token: bucket of its predecessor, pair estimate, unigram estimate, word count.

    ``deleted``: training tokens only, each predicted from counts without itself."""
    tokens, ends = from_planes(row["tokens"], 4).astype(np.int64), from_planes(row["ends"], 8).astype(np.int64)
    words, pair_counts = from_planes(row["words"], 8), from_planes(row["pairs"], 8)
    pairs, place = pairs_of(tokens, ends, len(words))
    before = np.append(words, np.uint64(train_docs))[pairs // (len(words) + 1)].astype(np.float64)[place]
    both, word = pair_counts[place].astype(np.float64), words[tokens].astype(np.float64)
    if deleted:
        train = np.repeat(~from_planes(row["held"], 1).astype(bool), np.diff(ends, prepend=0))
        before, both, word, total = before[train] - 1, both[train] - 1, word[train] - 1, total - 1
    bucket = np.where(before > 0, np.floor(np.log2(np.maximum(before, 1))) + 1, 0).astype(np.int64)
    single = (word + ALPHA) / (total + ALPHA * (vocabulary + 1))
    return bucket, np.where(before > 0, both / np.maximum(before, 1), 0.0), single, word


def learn_weights(cells: list[tuple[int, int | None, int]], rounds: int = 500) -> np.ndarray:
    """EM by bucket from (bucket, cell of the ratio or None for 0, occurrences); 64 weights."""
    lam = np.zeros(64)
    for bucket in range(1, 64):
        own = [(c, n) for b, c, n in cells if b == bucket]
        if not own:
            lam[bucket] = lam[bucket - 1]
            continue
        r = np.array([0.0 if c is None else 2.0 ** (c / FINE) for c, _ in own])
        n, w = np.array([x for _, x in own], float), 0.5
        for _ in range(rounds):
            w = min(max((n * w * r / (w * r + 1 - w)).sum() / n.sum(), 1e-6), 1 - 1e-6)
        lam[bucket] = w
    return lam


def score(docs: DataFrame, *, block_tokens: int = 1_600_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    path, joined_path = scratch_path(spark, "lm-blocks"), scratch_path(spark, "lm-counted")
    write_blocks(docs, path, block_tokens)
    blocks = spark.read.parquet(path)
    # Distinct pairs of a block are fewer than its tokens; their sum bounds the keys.
    tokens = blocks.select(F.sum("n_tokens")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1.0, tokens / RANGE_KEYS)))))
    counted(blocks, answered(asked(blocks, bits))).write.option("compression", "zstd").parquet(joined_path)
    drop_path(spark, path)
    joined = spark.read.parquet(joined_path)
    sums = joined.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train_tokens", "train_docs", "known")]).first()
    total, train_docs, vocabulary = sums["train_tokens"], sums["train_docs"], sums["known"]

    def cells(batches):
        for row in each_row(batches):
            bucket, pair, single, _ = estimates(row, total, vocabulary, train_docs, True)
            cell = np.where(pair > 0, np.round(FINE * np.log2(np.maximum(pair, 1e-300) / single)), -(10**6)).astype(np.int64)
            found, n = np.unique(np.stack([bucket, cell]), axis=1, return_counts=True) if len(cell) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(n.astype(np.int64))], names=["bucket", "cell", "n"])

    got = joined.select("ends", "held", "tokens", "words", "pairs").mapInArrow(cells, "bucket long, cell long, n long").groupBy("bucket", "cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([(r["bucket"], None if r["cell"] == -(10**6) else r["cell"], r["n"]) for r in got])

    def scores(batches):
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                bucket, pair, single, word = estimates(row, total, vocabulary, train_docs, False)
                ends = from_planes(row["ends"], 8).astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                lam = weights[np.minimum(bucket, 63)]
                per = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                parts = [pa.array(from_planes(row["held"], 1).astype(bool)), pa.array(ends - starts), pa.array(per((word > 0).astype(np.int64))), pa.array(np.full(len(ends), total, np.int64)), pa.array(per(np.log10(single))), pa.array(per(np.log10(lam * pair + (1 - lam) * single)))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, *parts], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return joined.select("ids", "ends", "held", "tokens", "words", "pairs").mapInArrow(scores, schema)
