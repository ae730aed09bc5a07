"""Spans read from live files: against a plain reading of each file; odd encodings, paths, lines and rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from evidex.operators import live
from evidex.sources import files

REFS = "id long, path string, content_hash string, line_start int, line_end int, text string, stale string, tags map<string,string>"


def plain(path, first, last):
    lines = re.split(r"\r\n|\r|\n", files.decode_bytes(path.read_bytes()))
    return "\n".join(lines[max(1, first) - 1 : last]).strip()


@pytest.fixture
def root(tmp_path):
    (tmp_path / "r/sub").mkdir(parents=True)
    made = {
        "a.md": "".join(f"line {i} é{'\r\n' if i % 3 else '\n'}" for i in range(1, 400)).encode(),
        "sub/bom.md": b"\xef\xbb\xbffirst\rsecond\r\n\r\nlast",
        "latin.txt": "un café\nune forêt\n\n".encode("cp1252"),
        "empty.md": b"",
        "long.md": b"x" * 3_000_000 + b"\nend",
        "blob.bin": b"a\0b\nc",
    }
    for name, data in made.items():
        (tmp_path / "r" / name).write_bytes(data)
    return tmp_path / "r"


def taken(spark, root):
    rows = [(str(p.relative_to(root)), bytearray(p.read_bytes())) for p in sorted(root.rglob("*")) if p.is_file()]
    return spark.createDataFrame(rows, "path string, content binary")


def test_every_span_of_every_file(spark, root):
    index = live.line_index(taken(spark, root))
    hashes = {r["path"]: r["content_hash"] for r in index.collect()}
    asked = [(n, a, b) for n in hashes if n != "blob.bin" for a, b in ((1, 1), (1, 64), (64, 65), (63, 200), (128, 128), (129, 10_000), (0, 2), (500, 501), (3, 2), (399, 400))]
    refs = spark.createDataFrame([(i, n, hashes[n], a, b, "stored", "x", {"a": "b"}) for i, (n, a, b) in enumerate(asked)], REFS)
    got = live.hydrate(refs, str(root), index)
    assert got.columns == ["id", "path", "content_hash", "line_start", "line_end", "tags", "text", "stale", "live_state"]
    rows = got.collect()
    assert len(rows) == len(asked) and {r["live_state"] for r in rows} == {"live"} and not any(r["stale"] for r in rows)
    assert {r["id"]: r["text"] for r in rows} == {i: plain(root / n, a, b) for i, (n, a, b) in enumerate(asked)}
    bare = live.hydrate(refs, f"file://{root}", index.limit(0)).collect()
    assert {r["id"]: r["text"] for r in bare} == {r["id"]: r["text"] for r in rows}


def test_edited_gone_moved_and_odd_rows(spark, root):
    index = live.line_index(taken(spark, root))
    h = {r["path"]: r["content_hash"] for r in index.collect()}
    (root / "a.md").write_bytes((root / "a.md").read_bytes().replace(b"line 7 ", b"line 8 "))
    (root / "latin.txt").rename(root / "sub/latin.txt")
    (root / "empty.md").unlink()
    (root.parent / "secret").write_text("out")
    out = hashlib.sha256(b"out").hexdigest()
    rows = [
        (1, "a.md", h["a.md"], 7, 7, "line 7 é"), (2, "empty.md", h["empty.md"], 1, 1, None), (3, "latin.txt", h["latin.txt"], 2, 2, ""), (4, "../secret", out, 1, 1, "s"), (5, str(root.parent / "secret"), out, 1, 1, ""),
        (6, "sub/../../secret", out, 1, 1, ""), (7, None, None, None, None, None), (8, "sub", "x", 1, 1, "folder"), (9, "sub/bom.md", None, 1, 1, "no hash"), (10, "sub/bom.md", h["sub/bom.md"], None, 1, "t"), (11, "blob.bin", h["blob.bin"], 1, 1, "bin"),
        (12, "sub/bom.md", h["sub/bom.md"], 1, 2, "t"), (12, "sub/bom.md", h["sub/bom.md"], 1, 2, "t"), (13, "latin.txt", "other", 1, 1, "old"), (14, "", "x", 1, 1, "none"),
    ]
    refs = spark.createDataFrame([(*r, None, None) for r in rows], REFS)
    moved = spark.createDataFrame([("latin.txt", "sub/latin.txt")], "old_path string, path string")
    got = sorted((r["id"], r["live_state"], r["text"], r["stale"]) for r in live.hydrate(refs, str(root), index, moved).collect())
    assert got == [
        (1, "changed", "line 7 é", True), (2, "missing", "", True), (3, "live", "une forêt", False), (4, "missing", "s", True), (5, "missing", "", True), (6, "missing", "", True), (7, "missing", "", True), (8, "missing", "folder", True),
        (9, "changed", "no hash", True), (10, "live", "", False), (11, "missing", "bin", True), (12, "live", "first\nsecond", False), (12, "live", "first\nsecond", False), (13, "changed", "old", True), (14, "missing", "none", True),
    ]
    assert live.hydrate(refs.limit(0), str(root), index).count() == 0


def test_text_read_must_have_the_hash_of_its_chunk(spark, root):
    index = live.line_index(taken(spark, root))
    h = {r["path"]: r["content_hash"] for r in index.collect()}["sub/bom.md"]
    refs = spark.createDataFrame([(1, "sub/bom.md", h, 1, 1, "a", hashlib.sha256(b"first").hexdigest()), (2, "sub/bom.md", h, 2, 2, "b", "torn"), (3, "sub/bom.md", h, 4, 4, "c", None)], "id long, path string, content_hash string, line_start int, line_end int, text string, chunk_hash string")
    assert sorted((r["id"], r["live_state"], r["text"]) for r in live.hydrate(refs, str(root), index).collect()) == [(1, "live", "first"), (2, "changed", "b"), (3, "live", "last")]


def test_compaction_keeps_only_what_is_lost(spark, root):
    index = live.line_index(taken(spark, root))
    h = {r["path"]: r["content_hash"] for r in index.collect()}
    chunks = spark.createDataFrame([(1, "sub/bom.md", h["sub/bom.md"], 1, 2, "first\nsecond"), (2, "sub/bom.md", "old", 1, 1, "older"), (3, "sub/bom.md", h["sub/bom.md"], 4, 4, "else"), (4, "gone.md", "x", 1, 1, None)], "chunk_id long, path string, content_hash string, line_start int, line_end int, text string")
    slim = live.compacted(chunks, str(root), index)
    assert {r["chunk_id"]: r["text"] for r in slim.collect()} == {1: "", 2: "older", 3: "else", 4: None}
    back = live.hydrate(slim, str(root), index)
    assert {r["chunk_id"]: r["text"] for r in back.collect()} == {1: "first\nsecond", 2: "older", 3: "last", 4: ""}


def test_written_files_are_whole_and_once(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", bytearray(b"1")), ("a/b.txt", bytearray(b"2")), ("c.txt", bytearray(b"")), (None, bytearray(b"x")), ("d", None)], "path string, content binary")
    assert files.write_files(rows, f"file://{tmp_path}/w") == 2
    assert {str(p.relative_to(tmp_path / "w")): p.read_bytes() for p in (tmp_path / "w").rglob("*") if p.is_file()} == {"a/b.txt": b"2", "c.txt": b""}
    assert files.write_files(rows.limit(0), f"file://{tmp_path}/w") == 0


def test_packets_show_what_the_files_hold(spark, tmp_path):
    from evidex.operators import ingest
    from evidex.sources.store import Store

    root = tmp_path / "p"
    root.mkdir()
    (root / "rules.md").write_text("# Rules\nStudio must use bounded roots.\n")
    (root / "notes.md").write_text("intro\n\nBounded roots were chosen for the studio in spring.\n")
    found = taken(spark, root)
    index = live.line_index(found)
    rows = found.select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest(store, "p", rows)
    (root / "notes.md").write_text("Bounded roots were dropped.\n")
    requests = spark.createDataFrame([(1, "bounded roots")], "request_id long, text string")
    scope = spark.createDataFrame([(1, "p", 0)], "request_id long, project_id string, priority int")
    got = ingest.packets(store, requests, scope, files=(str(root), index)).first()
    assert {e["path"]: (e["text"], e["stale"]) for e in got["evidence"]} == {"rules.md": ("# Rules\nStudio must use bounded roots.", False), "notes.md": ("intro\n\nBounded roots were chosen for the studio in spring.", True)}
    assert got["status"] == "evidence_found" and [r["evidence_count"] for r in got["requirements"]] == [1]
    (root / "rules.md").unlink()
    gone = ingest.packets(store, requests, scope, files=(str(root), index)).first()
    assert (gone["status"], gone["empty_result"], gone["claims"]) == ("unknown", "only_stale_spans", [])
