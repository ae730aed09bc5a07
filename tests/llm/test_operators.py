"""Each operator on odd rows, an empty table, and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from evidex.llm import decontaminate, jaccard, language_id, language_model, learning, merkle, mixing, quality, secrets, simhash, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CALLS = {
    "op1": lambda d, la, b: quality.score_quality(d, la),
    "op2": lambda d, la, b: decontaminate.tiled(d, b),
    "op3": lambda d, la, b: mixing.mix(d),
    "op4": lambda d, la, b: simhash.components(d),
    "op5": lambda d, la, b: secrets.digest(d),
    "op6": lambda d, la, b: language_id.identify(d),
    "op7": lambda d, la, b: tokens.round_trip(d),
    "op8": lambda d, la, b: language_model.score(d),
    "op9": lambda d, la, b: toxicity.score_toxicity(d, la),
    "op10": lambda d, la, b: merkle.digest(d),
}


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.mark.parametrize("name", CALLS)
def test_empty_tables(name, docs, labels, benchmark):
    assert CALLS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op6", "op9"])
def test_scores(name, docs, labels, benchmark, rows):
    out = CALLS[name](docs, labels, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    n, held = {"op1": (5, 0), "op6": (4, 2), "op9": (4, 2)}[name]
    assert all(r["held_out"] == (crc(r["doc_id"], n) == held) for r in out)
    if name == "op6":
        by = {r["doc_id"]: r["lang_pred"] for r in out}
        assert by[100] == by[101] == by[102] == "und" and by[3] in ("en", "fr")


def oracle(spark, sql, rows, tmp_path):
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    frame["text"] = frame["text"].astype(object).where(frame["text"].notna(), None)
    path = str(tmp_path / "d.parquet")
    frame.to_parquet(path)
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    got = con.execute(sql).fetchall()
    return [d[0] for d in con.description], got


@pytest.mark.parametrize("name, module", [("op3", mixing), ("op5", secrets), ("op10", merkle)])
def test_equals_sql(name, module, spark, docs, labels, benchmark, rows, tmp_path):
    names, want = oracle(spark, module.ORACLE_SQL, rows, tmp_path)
    got = [tuple(r) for r in CALLS[name](docs, labels, benchmark).select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_mix_near_targets(docs, labels, benchmark):
    out = mixing.mix(docs, block_words=4).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        key = (r["source_size"], round(r["target"], 6))
        taken[key] += r["taken"]
        size[key] += r["size"]
        target[key] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[k] - target[k] * size[k] / k[0]) <= 8 * size[k] / k[0] for k in taken if k[0])


@pytest.mark.parametrize("sizes", [[3, 2], [1], [1, 1, 1, 1, 1, 1, 1, 1, 1], [63, 40], [2000, 5, 1, 0], [64, 64, 64]])
def test_mix_of_few_words(spark, sizes):
    """Tables and sources of less than any block: within a word of their targets."""
    rows = [(i, " ".join("w" for _ in range(n)), "en", f"s{i}", n) for i, n in enumerate(sizes)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sum(r["taken"] for r in out) == sum(sizes)
    for r in out:
        assert abs(r["taken"] - r["target"]) <= 1 + len(sizes) / 2 and r["taken"] <= 3 * r["size"]
    if sizes == [3, 2]:
        assert sorted((r["doc_id"], r["taken"]) for r in out) == [(0, 4), (1, 1)]


def test_shards_take_their_own_quotas(docs, labels, benchmark):
    """A row's shards sum up to what it gives; a shard takes of a source no more than its quota of whole blocks, and no word of another's."""
    out = mixing.mix(docs, block_words=4, shards=5).collect()
    per = Counter()
    for r in out:
        words = {int(k): int(n) for k, n in (x.split(":") for x in r["shard_words"].split(",") if x)}
        assert sum(words.values()) == r["taken"] and set(words) <= set(range(5))
        for k, n in words.items():
            per[k] += n
    assert len(per) == 5 and sum(per.values()) == sum(r["taken"] for r in out)
    one = Counter({r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_words=4, shards=1).collect()})
    assert one == Counter({r["doc_id"]: r["taken"] for r in out})


def test_apportionment_is_highest_quotients(spark):
    sizes = spark.createDataFrame([(False, f"s{i}", n) for i, n in enumerate([500, 30, 2000, 7, 900])], "src_null boolean, src string, size long")
    targets = mixing.source_targets(sizes)
    rows = {r["place"]: r["target"] for r in targets.collect()}
    got = Counter()
    for r in mixing.shard_quotas(targets, block_words=10, shards=7).collect():
        assert r["blocks"] >= 0
        got[r["place"]] += r["blocks"]
    house = int(sum([500, 30, 2000, 7, 900]) // 10)
    seats = sorted(((-t / (2 * s + 1), p) for p, t in rows.items() for s in range(house)))[:house]
    assert {p: n for p, n in got.items() if n} == dict(Counter(p for _, p in seats))


def test_simhash_brute_force(docs, rows):
    import xxhash

    def print_of(text):
        w = WORD.findall(lower(text))
        parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    small = [r for r in rows if r[0] != 106]
    out = simhash.components(docs.filter("doc_id is null or doc_id <> 106"), cell=3).collect()
    want = [(r[0], print_of(r[1])) for r in small]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in out) == sorted((str(i), f"{p:016x}") for i, p in want)
    group = {i: {i} for i in range(len(want))}
    for i, (_, a) in enumerate(want):
        for j, (_, b) in enumerate(want[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[i]:
                    group[k] = group[i]
    least = [min((want[k][0] for k in group[i] if want[k][0] is not None), default=None) for i in range(len(want))]
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == sorted((str(w[0]), str(c)) for w, c in zip(want, least))


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(0)
    for radius in (3, 4, 5, 6):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and min((m & (2**64 - 1)).bit_count() for m in masks) >= 20
        for _ in range(500):
            differ = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
            assert any(differ & m == 0 for m in masks)


def test_contract_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
    out = simhash.contract(edges).collect()
    assert len(out) == 64 and len({r["root"] for r in out}) == 2


def test_dedup_keeps_one_of_each_group(docs):
    ids = [r["doc_id"] for r in simhash.dedup(docs).collect()]
    assert ids.count(3) == 1 and not {104, 105} & set(ids) and len([i for i in ids if i is not None]) == len(set(ids) - {None})


def test_pipeline_finds_edited_copies(spark, docs):
    """Every pair of similarity 0.8 or more is linked, and no pair below it, as by brute force on all pairs."""
    import corpus_pipeline

    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        texts.append(base)
        for part in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append([f"e{rng.randrange(3000)}" if rng.random() < part else w for w in base])
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in texts]
    label = list(range(len(texts)))
    hard = 0
    for j in range(len(texts)):
        for i in range(j):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            hard += 0.8 <= s < 0.9
            if s >= 0.8:
                label = [label[i] if x == label[j] else x for x in label]
    assert hard > 20
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted({min(i for i, x in enumerate(label) if x == y) for y in label})
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == want
    assert sorted(r["doc_id"] for r in jaccard.dedup(df, block=700).collect()) == want
    assert jaccard.dedup(docs.limit(0)).columns == docs.columns
    assert jaccard.dedup(docs.limit(0)).count() == 0


def test_pipeline_links_near_fingerprints_too(spark):
    """Texts of few distinct words, often repeated: one bit apart as fingerprints, but unlike as sets."""
    import corpus_pipeline

    a = " ".join(["one two three four five"] * 300)
    rows = [(1, a), (2, a + " six seven eight nine ten eleven twelve thirteen"), (3, "another text of other words entirely, that nobody else has"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {tuple(sorted((r["doc_id"], r["component_id"]))) for r in simhash.components(df).collect()}
    assert (1, 2) in linked
    kept_ = lambda x: sorted(r["doc_id"] for r in x.collect())
    assert kept_(jaccard.dedup(df)) == [1, 2, 3, 4]
    assert kept_(corpus_pipeline.drop_near_duplicates(spark, df, "")) == [1, 3, 4]


def test_near_fingerprints_join_the_rounds_of_the_sets(spark, monkeypatch):
    """Fingerprint links are contracted with those of the sets; a round has some ten stages, whose tasks the driver remembers."""
    a = " ".join(["one two three four five"] * 300)
    tails = ["", " six seven eight nine ten eleven twelve thirteen", " six seven eight nine", " SIX seven eight nine"]
    df = spark.createDataFrame([(i, a + x) for i, x in enumerate(tails)] + [(9, "another text"), (10, "another text")], "doc_id long, text string")
    contracted = []
    for module in (jaccard, simhash):
        monkeypatch.setattr(module, "contract", lambda edges, name="groups", f=simhash.contract: contracted.append(name) or f(edges, name))
    assert sorted(r["doc_id"] for r in jaccard.dedup(df, radius=4).collect()) == [0, 9]
    assert contracted == ["candidates", "jaccard"]


@pytest.mark.parametrize("module", [simhash, jaccard])
def test_dedup_decides_by_row(spark, module):
    """Copies without id collapse, also onto one with an id; unlike texts under one id both stay."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(40)) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (7, b), (None, b), (1, c), (1, d), (1, d)]
    out = module.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted([(0, a), (7, b), (1, c), (1, d)])


def test_secrets_incremental(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, "token = abcdef1"), ("b", 1, "plain"), ("c", 1, "token = abcdef1")], "path string, version int, text string")
    ledger = str(tmp_path / "ledger")
    assert secrets.scan_versions(first, ledger).count() == 2
    second = first.union(spark.createDataFrame([("a", 2, "plain"), ("d", 1, "passwd:'zzzzzz9'")], first.schema))
    seen = secrets.scan_versions(second, ledger)
    assert seen.count() == 3  # only the new blob was scanned
    found = {(r["path"], r["version"]): len(r["spans"]) for r in secrets.findings(second, seen).collect()}
    assert found == {("a", 1): 1, ("b", 1): 0, ("c", 1): 1, ("a", 2): 0, ("d", 1): 1}


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 255, 256, 257, 1000):
        xs = list(range(1, n + 1))
        df = spark.createDataFrame([(xs,)], "x array<long>")
        assert df.select(secrets.running_sums(F.col("x"))).first()[0] == np.cumsum(xs).tolist()


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 8, 15, 16, 17, 32):
        ids = rng.integers(0, 2 ** min(bits, 31), 1001).astype("<u4")
        packed = tokens.pack(ids, bits)
        assert len(packed) == -(-1001 * bits // 8)
        assert (tokens.unpack(packed, bits, 0, 1001) == ids).all() and (tokens.unpack(packed, bits, 13, 700) == ids[13:700]).all()


def test_token_ids(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [np.array(own.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4") for r in order]
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    want = [(r[0], int(s), len(x), zlib.crc32(x.tobytes())) for r, s, x in zip(order, starts, ids)]
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.round_trip(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    path = str(tmp_path / "packed")
    tokens.write_packed(docs, path, tokens.default_tokenizer())
    assert (tokens.read_document(spark, path, 106)[0] == ids[[r[0] for r in order].index(106)]).all()
    assert len(tokens.read_document(spark, path, 105)) == 2


def test_encoder_pieces_are_exact():
    own = tokens.Encoder(tokens.default_tokenizer())
    texts = ["a  b c", "\nx y", "don't.!? it*&&, x#; y's.", "naïve, ça. 中文, 漢. x", "a\x00 b", "a b c", "<|endoftext|> hi  x", "..", " ", "\n", "a.\n.b", "A\x1c b \x85 c", "é., f g १. x ⅷ. b"]
    assert own(texts) == own.plain(texts)


def test_language_model_brute_force(docs, rows):
    small = [r for r in rows if r[0] != 106]
    out = language_model.score(docs.filter("doc_id is null or doc_id <> 106"), block_tokens=150).collect()
    texts = [(r[0], WORD.findall(lower(r[1])) + ["</s>"]) for r in small]
    train = [w for i, w in texts if crc(i, 10) != 0]
    c, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["<s>", *w], w))
    total, vocabulary = sum(c.values()), len(c)
    single = lambda x, less=0: (c[x] - less + 0.1) / (total - less + 0.1 * (vocabulary + 1))
    before = lambda p: len(train) if p == "<s>" else c[p]
    bucket = lambda n: math.floor(math.log2(n)) + 1 if n > 0 else 0
    cells = Counter()
    for w in train:
        for p, x in zip(["<s>", *w], w):
            n = before(p) - 1
            two = (pairs[p, x] - 1) / n if n else 0
            cells[bucket(n), round(8 * math.log2(two / single(x, 1))) if two else None] += 1
    lam = language_model.learn_weights([(b, k, n) for (b, k), n in cells.items()])
    want = []
    for i, w in texts:
        base = sum(math.log10(single(x)) for x in w)
        full = 0.0
        for p, x in zip(["<s>", *w], w):
            n = before(p)
            m = lam[bucket(n)]
            full += math.log10(m * (pairs[p, x] / n if n else 0) + (1 - m) * single(x))
        want.append((str(i), crc(i, 10) == 0, len(w), sum(c[x] > 0 for x in w), total, round(base, 6), round(full, 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in out]
    assert sorted(got) == sorted(want)


def test_tiling_finds_reordered_passages(docs, benchmark, rows):
    out = decontaminate.tiled(docs, benchmark).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in out}
    assert (5, 1) in found and (6, 2) in found and not [k for k in found if k[1] in (3, 4, 5)]
    assert found[5, 1]["coverage"] > 0.7 and found[6, 2]["coverage"] == 1.0
    small = {(r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.tiled(docs, benchmark, block_chars=1).collect()}
    assert small == {(r["doc_id"], r["item_id"], r["matched"]) for r in out}
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert kept == {r[0] for r in rows} - {k[0] for k in found}


def test_tiling_is_greedy():
    doc, item = list("xabcdefyabcz"), list("abcdefabc")
    number = {c: i + 1 for i, c in enumerate(sorted(set(doc + item)))}
    d, q = [number[c] for c in doc], [number[c] for c in item]
    seeds = [(p, t) for p in range(len(q) - 2) for t in range(len(d) - 2) if q[p : p + 3] == d[t : t + 3]]
    assert decontaminate.tiles(q, d, seeds, 3) == [(0, 1, 6), (6, 8, 3)]


def naive_tiling(item, doc, least):
    """Longest free match first, looked for among all places again each time."""
    taken_item, taken_doc, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                k = 0
                while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] and p + k not in taken_item and t + k not in taken_doc:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return sorted(out)
        out.append((p, t, k))
        taken_item.update(range(p, p + k))
        taken_doc.update(range(t, t + k))


def test_tiling_of_repeated_words_takes_little():
    import time
    import tracemalloc

    block = decontaminate.Block([(1, "ab " * 300), (2, "cd ef " * 150)], 5, 0.5)
    text = "ab " * 20_000 + "cd ef " * 10_000
    began = time.process_time()
    found = list(block.matches(text))
    took = time.process_time() - began
    assert found == [(1, 1.0, 300, 300, [(0, 0, 300)]), (2, 1.0, 300, 300, [(0, 20_000, 300)])]
    tracemalloc.start()
    list(block.matches(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 1 and peak < 100e6, (took, peak)


def test_tiling_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd ef gh ij".split())
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, "ab " * 40), (61, None), (None, "cd " * 9)]
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 6, 12, 20])))) for i in range(8)] + [(8, "ab " * 12), (9, "Ab, ab; AB. ab ab cd"), (10, None)]
    out = decontaminate.tiled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=4).collect()
    got = {(r["doc_id"], r["item_id"]): sorted((x["item_at"], x["doc_at"], x["n"]) for x in r["tiles"]) for r in out}
    want = {}
    cut = lambda x: decontaminate.WORDS.findall((x or "").lower())
    for d, text in docs:
        for q, test in items:
            own = cut(test)
            tiles = naive_tiling(own, cut(text), min(4, len(own) or 1))
            if tiles and sum(k for _, _, k in tiles) >= 0.5 * len(own):
                want[d, q] = tiles
    assert got == want and len(want) > 20


def test_bradley_terry_brute_force(monkeypatch):
    """The fitted weights are where plain gradient steps on the pairs' logistic loss end."""
    import math

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    monkeypatch.setattr(quality, "features", lambda t: list(x[int(t)]))
    y = (x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=200) > 0).astype(int)
    model = quality.fit([(str(i), int(b)) for i, b in enumerate(y)], pairs=2000, ridge=1.0, seed=3)
    z = model.expand(x)
    draw = np.random.default_rng(3)
    d = z[draw.choice(np.flatnonzero(y == 1), 2000)] - z[draw.choice(np.flatnonzero(y != 1), 2000)]
    w = np.zeros(d.shape[1])
    for _ in range(20_000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) - w) / len(d)
    assert np.allclose(w, model.weights, atol=2e-3)
    strengths = sorted(z @ model.weights)
    assert math.isclose(model.threshold, float(np.quantile(strengths, np.mean(y != 1))))


def test_noisy_or_brute_force():
    """A document's score is one less the chance that no sentence is toxic, over every outcome of its sentences."""
    from itertools import product

    model = toxicity.Model({"=vile": 2.0, "=calm": -1.0, "^vil": 0.5}, -1.0)
    for text in ("vile. calm. vile calm", "calm", "vile vile vile", ". . ", "no words! vile? yes"):
        logits = model.sentence_logits(text)
        chance = [1 / (1 + np.exp(-z)) for z in logits]
        some = sum(np.prod([p if b else 1 - p for p, b in zip(chance, outcome)]) for outcome in product([0, 1], repeat=len(chance)) if any(outcome))
        assert abs(model.score([text])[0] - some) < 1e-9


def test_noisy_or_fit_climbs():
    """Training ends with a higher likelihood of the document labels than any model moved a little from it."""
    sample = [(f"A calm line number {i % 7}. Another thing here.", 0) for i in range(60)] + [(f"A calm line number {i % 5}. You vile wretch now. More text.", 1) for i in range(30)] + [("calm wretch line", 0), ("vile", 0)]
    model = toxicity.fit(sample, lift=1.0)
    noise = toxicity.NOISE

    def value(weights, bias):
        p = toxicity.Model(weights, bias).score([t for t, _ in sample])
        likely = [noise + (1 - 2 * noise) * (a if b else 1 - a) for a, (_, b) in zip(p, sample)]
        return np.mean(np.log(likely)) - 0.01 / len(sample) * sum(w * w for w in weights.values()) / 2

    top = value(model.weights, model.bias)
    for name in list(model.weights)[:12]:
        for step in (-1.0, 1.0):
            assert value(model.weights | {name: model.weights[name] + step}, model.bias) <= top + 2e-3
    assert value(model.weights, model.bias + 1) <= top + 2e-3 and value(model.weights, model.bias - 1) <= top + 2e-3


def test_toxicity_locates_where_lower_case_is_longer(spark):
    model = toxicity.Model({"=vile": 9.0}, -4.0)
    text = "\u0130\u0130 calm. You vile one."
    spans = toxicity.locate(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[r["start"] : r["end"]].strip() for r in spans] == ["You vile one."]


def test_quality_separates():
    good = [(f"the quick fox number {i} runs over a lazy dog. it sleeps well.", 1) for i in range(60)]
    bad = [(f"BUY!! NOW!! {i} $$$ ### || BUY!! NOW!!", 0) for i in range(30)]
    model = quality.fit(good + bad, pairs=3000)
    s = model.score([t for t, _ in good + bad])
    assert (s[:60] >= quality.CUT).mean() > 0.95 and (s[60:] < quality.CUT).mean() > 0.95


def test_toxicity_returns_its_sentences(spark, docs, labels, rows):
    """The sentences of the query are those that a plain enumeration finds, and make up the score by noisy-or."""
    model = toxicity.Model({"^alp": 1.0, "=really": 3.0, "^nai": 0.0, "^the": 0.5}, -2.0)
    out = toxicity.judged(docs, model).collect()
    want = []
    for i, text, *_ in rows:
        spans, none, at, text = [], 1.0, 0, text or ""
        while at < len(text):
            end = at
            while end < len(text) and text[end] not in ".!?\n":
                end += 1
            body = end
            while end < len(text) and text[end] in ".!?":
                end += 1
            if body > at:
                words = {w for w in re.findall(r"[^\W\d_]+", text[at:end].lower())}
                found = {x for w in words for x in (f"={w}", f"^{w[:3]}") if x in model.weights}
                p = 1 / (1 + math.exp(-(model.bias + sum(model.weights[x] for x in found))))
                none *= 1 - p
                if p >= toxicity.CUT:
                    spans.append((at, end, round(p, 9)))
            at = max(end, at + 1) if end > at else at + 1
        want.append((str(i), round(1 - none, 9), spans))
    got = [(str(r["doc_id"]), round(r["score"], 9), [(x["start"], x["end"], round(x["score"], 9)) for x in r["sentences"]]) for r in out]
    assert sorted(got) == sorted(want) and any(x[2] for x in got)
    assert toxicity.score_toxicity(docs, labels).columns == ["doc_id", "held_out", "score", "predicted", "sentences"]


def test_toxicity_locates(spark):
    sample = [(f"A calm line number {i}. Another calm thing here.", 0) for i in range(60)] + [(f"A calm line number {i}. You vile wretch now.", 1) for i in range(30)]
    model = toxicity.fit(sample)
    assert model.score(["You vile wretch", "A calm thing", "", None or ""]).round().tolist() == [1, 0, 0, 0]
    docs = spark.createDataFrame([(1, "A calm line. You vile wretch. Fine."), (2, None)], "doc_id long, text string")
    spans = toxicity.locate(docs, model).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in spans] == [(1, 12, 29)]


def test_one_long_text_leaves_the_samples(spark, monkeypatch):
    """A text of more than the whole budget, wherever it stands in the order, takes no other text's place."""
    from pyspark.sql import functions as F

    for long in range(6):
        rows = [(i, "word " * (1000 if i == long else 4), "en", 1) for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
        sample = learning.labelled_sample(df, df, "quality", F.lit(True), 100, 1_600)
        assert len(sample) == 39 and max(len(x) for x, _ in sample) == 20
        seen = []
        monkeypatch.setattr(language_id, "fit", lambda pairs: seen.extend(pairs))  # noqa: B023
        language_id.train(df, rows=100, chars=1_600)
        learned = sum(crc(i, language_id.FOLDS) != language_id.HELD and i != long for i in range(40))
        assert len(seen) == learned > 20 and max(len(x) for x, _ in seen) == 20
    only = df.filter("doc_id = 5")
    assert [len(x) for x, _ in learning.labelled_sample(only, only, "quality", F.lit(True), 100, 1_600)] == [5000]


def test_language_words():
    sample = [("the cat sat on the mat with the other cats and then went home", "en")] * 20 + [("le chat est sur la table avec les autres chats et puis rentre", "fr")] * 20
    model = language_id.fit(sample)
    tagged = language_id.tag_words(["the cat sat on la table avec les autres"], model)[0]
    assert [t[1] for t in tagged] == ["en"] * 4 + ["fr"] * 5
    long = "the cat sat on the mat " * 300
    assert model.predict([long, "12 34", "le chat"])[0] == ["en", "und", "fr"]


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    n, k = 7, 3
    e, trans = rng.random((n, k)) + 0.1, rng.random((k, k)) + 0.1
    want = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        p = trans[:, path[0]].mean() * e[0, path[0]]
        for a, b, t in zip(path[:-1], path[1:], range(1, n)):
            p *= trans[a, b] * e[t, b]
        for t, s in enumerate(path):
            want[t, s] += p
    want /= want.sum(axis=1, keepdims=True)
    old, language_id.CHUNK = language_id.CHUNK, 3
    try:
        place, real, first = language_id.layout(np.array([n]))
        assert np.allclose(language_id.scan(e[place], real, first, trans)[0][real], want)
    finally:
        language_id.CHUNK = old


def test_merkle_locates_edits(spark):
    from pyspark.sql import functions as F

    a = "One. Two.\nThree.\n\nFour.\nFive."
    df = spark.createDataFrame([(a, a.replace("Five", "Six")), (a, a)], "a string, b string")
    p = lambda c: merkle.fingerprint(merkle.tree(F.col(c)))
    got = df.select(p("a").alias("a"), p("b").alias("b")).select(merkle.changed_leaves(F.col("a"), F.col("b")).alias("x"), (F.col("a") == F.col("b")).alias("same")).collect()
    assert [tuple(x) for x in got[0]["x"]] == [(1, 1)] and not got[0]["same"] and got[1]["x"] == [] and got[1]["same"]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_pipeline_stages(spark, docs, labels, benchmark, rows, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        at = spark.read.parquet(str(tmp_path / f"out{i}"))
    assert at.count() > 0
    empty = docs.limit(0)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0
