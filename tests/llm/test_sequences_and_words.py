"""Spelling variants, packing and periodic runs: brute force, odd rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidex.llm import packing, periodic, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(counts, factor=10):
    out = {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def variants_of(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def brute_words(rows, change):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if change and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_spelling_digest(docs, rows):
    assert variants_of(spelling.digest(docs)) == brute_variants(brute_words(rows, True))


def test_spelling_chains_and_crowded_buckets(spark):
    """Counts of three orders of magnitude, so that forms have forms; one bucket of many words that share a beginning."""
    rng = random.Random(5)
    texts = ["Weather wheather"] + ["weather " * 900 + "weathers " * 60 + "wheathers " * 5 + "wÉather wÉathers"]
    crowded = ["interna" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts, " ".join(crowded * 2), "É" * 9 + " " + "É" * 8, "É" * 9 + " " + "É" * 8, "x" * 50_000, "x" * 50_000, "x" * 49_999 + "y", "x" * 49_999 + "y"])]
    want = brute_variants(brute_words(rows, False))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants_of(spelling.variants(docs)) == want
    assert want["wheathers"][:2] == ("weathers", "weather")
    words = spark.createDataFrame([(w, v[2]) for w, v in want.items()], "word string, n long")
    for most in (4, 100):  # cut again and again
        pairs = [(r["word"], r["other"]) for r in spelling.near_pairs(words, most).collect()]
        assert len(pairs) == len(set(pairs))
        assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in want for b in want if one_edit(a, b)}


def test_spelling_short_words(spark):
    rows = [(1, "a b ab ba abc a b x ab")]
    found = variants_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least_length=1, least_count=1, factor=2))
    assert found == brute_variants(Counter(rows[0][1].split()), 2)


def test_empty(docs):
    for digest in (spelling.digest, packing.digest, periodic.digest):
        assert digest(docs.limit(0)).count() == 0
    nulls = docs.select("doc_id").limit(2).selectExpr("doc_id", "cast(null as string) text")
    assert spelling.digest(nulls).count() == 0
    assert [r["length"] for r in packing.digest(nulls).collect()] == [1, 1]
    assert {r["n_runs"] for r in periodic.digest(nulls).collect()} == {0}


# Packing


def test_packing_digest(docs, rows):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4")
            want[doc_id, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    found = packing.digest(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in found], 4096)
    assert len({r["sequence_id"] for r in found}) == -(-sum(r["length"] for r in found) // 4096)


def check_sequences(rows, capacity):
    held = defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity


def test_encoder_equals_tokenizer():
    """Odd texts: other white space, marks, contractions, capitals, combining marks, special tokens, numbers."""
    texts = ["", " ", "Don't stop!!! it's 42nd ÉCOLE, İstanbul ſtraße", "a b c\x1cd\x0be\tf\r\ng", "café ́x Å", "x <|endoftext|> y<|ENDOFTEXT|>z", "<|startoftext|>", "don't,", "你好 мир 'll 're", "😀😀 w😀rd", "ǅ ß ẞ", "well-known, #tag $5% &&& ***", "A" * 3000 + " b"]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.WordEncoder(packing.default_tokenizer(), most=5)
    for _ in range(2):
        assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("lengths", [lambda r: r.randint(1, 1000), lambda r: min(1000, int(1 / r.random())), lambda r: 7, lambda r: r.choice([334, 333, 501, 499]), lambda r: r.randint(300, 400)])
def test_best_fit_over_ranges(spark, lengths):
    """Many ranges of few rows against best fit decreasing in one list."""
    rng = random.Random(2)
    sizes = [lengths(rng) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, length int").repartition(4)
    found = packing.best_fit(items, 1000, rows=400).collect()
    assert sorted(r["key"] for r in found) == list(range(len(sizes)))
    room = Counter()
    for r in found:
        room[r["sequence_id"]] += sizes[r["key"]]
    assert max(room.values()) <= 1000
    one, gaps = 0, packing.Gaps(1000)
    for x in sorted(sizes, reverse=True):
        got = gaps.take(x)
        one += not got
        if (left := (got[1] if got else 1000) - x) > 0:
            gaps.put(0, left)
    assert len(room) <= one * 1.03 + 1  # eight ranges and more


def test_sequences(docs):
    own = packing.pieces(docs.limit(30), capacity=64)
    found = packing.sequences(own, packing.packed(own, 64)).collect()
    texts = {r["key"]: bytes(r["ids"]) for r in own.collect()}
    assert sorted(k for r in found for k in r["keys"]) == sorted(texts)
    assert all(bytes(r["ids"]) == b"".join(texts[k] for k in r["keys"]) and len(r["ids"]) == 4 * sum(r["lengths"]) <= 256 for r in found)


# Periodic runs


def brute_runs(words, least=24, repeats=3):
    found = {}
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 12)), max_size=8), st.sampled_from([(24, 3), (2, 2), (5, 2), (9, 4), (1, 3)]))
def test_runs_equal_brute_force(parts, limits):
    words = [x for unit, times in parts for x in unit * times]
    found = periodic.find_runs(np.array(words, np.int32), *limits)
    assert [tuple(r) for r in found.tolist()] == [r for r in brute_runs(words, *limits) if r[1] >= limits[0]]


def test_long_and_constant_texts():
    rng = np.random.default_rng(1)
    assert periodic.find_runs(np.zeros(60_000, np.int32)).tolist() == [[0, 60_000, 1]]
    assert len(periodic.find_runs(rng.integers(0, 50, 60_000).astype(np.int32))) == 0
    unit = rng.integers(0, 1000, 9_000).astype(np.int32)
    assert periodic.find_runs(np.concatenate([rng.integers(0, 1000, 77).astype(np.int32), np.tile(unit, 4)[:-5]])).tolist()[0][1:] in ([35995, 9000], [35996, 9000])


def test_periodic_digest(spark, rows):
    more = [(i, " ".join(["la", "li", "lo"][: 1 + i % 3] * 30 + ["end", "x"] * 14 + [f"w{i}"])) for i in range(200, 260)]
    docs = spark.createDataFrame([r[:2] for r in rows] + more, "doc_id long, text string")
    want = Counter()
    for doc_id, text in [r[:2] for r in rows] + more:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        want[(doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))] += 1
    found = periodic.digest(docs).collect()
    assert Counter((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in found) == want
    assert sum(r["n_runs"] > 1 for r in found) > 10
