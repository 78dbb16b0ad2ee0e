"""The repository source: links, unreadable files, hidden paths and snapshots."""

import os

from sieveline.operators.incremental import snapshot_diff
from sieveline.sources import repository


def checkout(path):
    (path / "a" / "b" / "c" / "d").mkdir(parents=True)
    (path / ".git").mkdir()
    for name, content in (("x.md", b"# x"), ("a/y.py", b"def f():\n    return 1\n"), ("a/b/z.txt", b"z"), ("a/b/c/d/deep.txt", b"deep"), ("bin.dat", b"a\x00b"), ("latin.txt", b"\xff\xfe"), (".git/config", b"c"), ("a/.hidden", b"h")):
        (path / name).write_bytes(content)
    os.symlink(path / "x.md", path / "link.md")
    os.symlink(path / "a", path / "a" / "b" / "loop")
    os.symlink(path / "nowhere", path / "dangling")


def test_links_are_named_and_not_followed(spark, tmp_path):
    checkout(tmp_path)
    found = repository.read(spark, str(tmp_path)).cache()
    kinds = {r.path: r.kind for r in found.collect()}
    assert kinds == {"x.md": "file", "a/y.py": "file", "a/b/z.txt": "file", "a/b/c/d/deep.txt": "file", "bin.dat": "file", "latin.txt": "file", "link.md": "symlink", "a/b/loop": "symlink", "dangling": "symlink"}
    nodes, diagnostics = repository.parse(found)
    assert {r.uri for r in nodes.collect()} == {f"repo:///{p}" for p in ("x.md", "a/y.py", "a/b/z.txt", "a/b/c/d/deep.txt")}
    assert {(r.code, r.path) for r in diagnostics.collect()} == {("CTX005", "link.md"), ("CTX005", "a/b/loop"), ("CTX005", "dangling"), ("CTX001", "bin.dat"), ("CTX004", "latin.txt")}
    assert ".git/config" in {r.path for r in repository.read(spark, str(tmp_path), hidden=True).collect()}


def test_unreadable_files_have_a_row_and_no_node(spark, tmp_path):
    (tmp_path / "gone.txt").write_text("x")
    reader = repository.RepositoryReader(str(tmp_path), False)
    assert [r[1] for r in reader.read(reader.partitions()[0])] == ["file"]
    lost = repository.row(str(tmp_path), str(tmp_path / "lost.txt"))
    assert lost[:4] == ("lost.txt", "unreadable", None, None) and lost[5] == "FileNotFoundError"
    found = spark.createDataFrame([lost, repository.row(str(tmp_path), str(tmp_path / "gone.txt"))], repository.SCHEMA)
    nodes, diagnostics = repository.parse(found)
    assert [(r.code, r.path) for r in diagnostics.collect()] == [("CTX003", "lost.txt")] and nodes.count() == 1


def test_snapshots_tell_links(spark, tmp_path):
    (tmp_path / "same.txt").write_text("s")
    (tmp_path / "turned.txt").write_text("s")
    before = repository.snapshot(repository.read(spark, str(tmp_path))).cache()
    assert before.count() == 2
    os.remove(tmp_path / "turned.txt")
    os.symlink(tmp_path / "same.txt", tmp_path / "turned.txt")
    (tmp_path / "new.txt").write_text("n")
    rows = snapshot_diff(before, repository.snapshot(repository.read(spark, str(tmp_path)))).collect()
    assert {r.uri.removeprefix("repo:///"): r.status for r in rows} == {"same.txt": "unchanged", "turned.txt": "changed", "new.txt": "added"}
