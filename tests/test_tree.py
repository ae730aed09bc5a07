"""The walk of a file tree against a plain one, what it never enters, and continuous ingest over it."""

import os

from evidex.sources import files, rules, tree
from evidex.streaming import watch


def plain(root):
    """(path, folder, link) of all that a walk may name, by another way: recursion."""
    found = set()

    def enter(folder):
        for name in os.listdir(os.path.join(root, folder)):
            path = os.path.join(folder, name)
            full = os.path.join(root, path)
            inside = os.path.isdir(full) and not os.path.islink(full)
            found.add((path, inside, os.path.islink(full)))
            if inside and not name.startswith(".") and name.lower() not in rules.IGNORED_DIRS and ".git" not in os.listdir(full):
                enter(path)

    enter("")
    return found


def made(root):
    for path in ("a.md", "src/x/y/z/deep.py", "src/x/.cache/no.py", "Node_Modules/m/no.js", "sub/.git/HEAD", "sub/no.md", "linked/.keep", "empty/d/.keep", "w/é ü.txt", "src/big.bin"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    (root / "sub2").mkdir()
    (root / "sub2/.git").write_text("gitdir: elsewhere")
    (root / "loop").symlink_to(root / "src")
    (root / "src/link.md").symlink_to(root / "a.md")


def test_walk_equals_a_plain_one(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    assert tree.walk(spark, str(root)).count() == 0 and tree.walk(spark, str(tmp_path / "none")).count() == 0
    made(root)
    rows = tree.walk(spark, f"file://{root}").collect()
    assert {(r["relative_path"], r["folder"], r["symlink"]) for r in rows} == plain(str(root)) and len(rows) == len(plain(str(root)))
    reasons = {r["relative_path"]: r["reason"] for r in rows}
    assert {p for p, why in reasons.items() if why == "ignored_dir"} == {"src/x/.cache", "Node_Modules", "sub", "sub2"}
    assert reasons["loop"] == "symlink" and reasons["src/link.md"] == "symlink" and reasons["a.md"] is None and reasons["src/big.bin"] == "unsupported_type"
    assert {r["relative_path"]: r["text"] for r in tree.read_tree(spark, str(root)).collect()} == {p: p for p in ("a.md", "src/x/y/z/deep.py", "w/é ü.txt")}
    same = [c for c in files.read_sources(spark, str(root)).columns]
    assert tree.read_tree(spark, str(root)).columns == same


def test_folders_that_are_refused_are_never_listed(spark, tmp_path, monkeypatch):
    root = tmp_path / "t"
    root.mkdir()
    made(root)
    listed = []
    real = os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda p: (listed.append(os.path.relpath(p, root)), real(p))[1])
    todo = [""]
    while todo:
        folder = todo.pop()
        for name, inside, _, _, link, _, checkout in tree.local_entries(str(root), folder):
            if inside and not name.startswith(".") and name.lower() not in rules.IGNORED_DIRS and not checkout:
                todo.append(os.path.join(folder, name))
    assert set(listed) == {".", "src", "src/x", "src/x/y", "src/x/y/z", "linked", "empty", "empty/d", "w"}


def test_watch_sees_edits_deletions_and_restarts(spark, tmp_path):
    root, heads = tmp_path / "t", {}
    (root / "d").mkdir(parents=True)
    seen = []

    def state():
        return spark.createDataFrame([(p, *v, True) for p, v in heads.items()], "path string, size long, mtime long, active boolean")

    def commit(versions, states, batch):
        got = {r["path"]: r["state"] for r in states.collect()}
        new = {r["relative_path"]: r for r in versions.collect()}
        seen.append((got, {p: r["text"] for p, r in new.items()}))
        for p, s in got.items():
            if s == "missing":
                heads.pop(p, None)
        now = {r["path"]: (r["size"], r["mtime"]) for r in watch.listing(spark, str(root)).collect()}
        heads.update({p: now[p] for p in new})

    def run():
        watch.watch(spark, str(root), state, commit, str(tmp_path / "checkpoint"), once=True).awaitTermination(60)

    (root / "a.md").write_text("one")
    (root / "d/b.md").write_text("two")
    run()
    (root / "a.md").write_text("one, edited")
    (root / "d/b.md").rename(root / "d/c.md")
    run()
    run()
    filled = [s for s in seen if s[1] or "missing" in s[0].values()]
    assert filled[0][1] == {"a.md": "one", "d/b.md": "two"}
    assert filled[1][1] == {"a.md": "one, edited", "d/c.md": "two"} and filled[1][0]["d/b.md"] == "missing" and filled[1][0]["a.md"] == "changed"
    assert len(filled) == 2 and len(seen) > 2 and set(heads) == {"a.md", "d/c.md"}
