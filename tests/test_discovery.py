"""Listing and reading of trees: what is excluded is never listed or opened."""

import os

import pytest

from quillscan.plans import scan
from quillscan.sources import discovery


@pytest.fixture()
def tree(tmp_path):
    for name in ("app.py", "pkg/__init__.py", "pkg/_private.py", "pkg/deep/er/a.go", "dist/b.js", "x/node_modules/y/z.js", ".git/hooks/c.py", "pkg/.hidden.py", "empty/.keep", "d.min.js", "old/gen/g.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name} ü\n")
    (tmp_path / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    os.mkfifo(tmp_path / "x/node_modules/pipe.js")  # opening it would wait for ever
    os.mkfifo(tmp_path / "pipe.py")
    os.symlink(tmp_path, tmp_path / "pkg/round")  # a walk that follows it would never end
    os.symlink(tmp_path / "nowhere", tmp_path / "x/gone.py")
    return tmp_path


def test_only_chosen_files_are_opened(spark, tree):
    got = {r["path"]: r for r in discovery.read(spark, [str(tree)], exclude=["node_modules", "dist", "old/**", "**/*.min.js"]).collect()}
    assert set(got) == {"app.py", "bad.py", "pkg/__init__.py", "pkg/_private.py", "pkg/deep/er/a.go"}
    assert got["pkg/__init__.py"]["content"] == "# pkg/__init__.py ü\n" and got["bad.py"]["content"] == "x = '��'\n"
    assert {p: r["lang"] for p, r in got.items()}["pkg/deep/er/a.go"] == "go" and all(r["unreadable"] is None for r in got.values())


def test_excluded_folders_are_never_listed(spark, tree, monkeypatch):
    listed = discovery.listing(spark, [str(tree)], ["node_modules", "dist", "old/**"])
    paths = {r["path"] for r in listed.collect()}
    assert not any(p.startswith(("dist", "x/node_modules", "old", ".git")) for p in paths) and "pkg/deep/er/a.go" in paths
    assert {r["size"] for r in listed.where("path = 'app.py'").collect()} == {len("# app.py ü\n".encode())}


def test_a_file_that_cannot_be_read_is_a_row(spark, tree):
    listed = discovery.listing(spark, [str(tree)], ["node_modules"]).where("path in ('app.py', 'bad.py')")
    os.remove(tree / "app.py")  # between listing and reading
    got = {r["path"]: r for r in discovery.contents(listed).collect()}
    assert got["app.py"]["content"] is None and "FileNotFoundError" in got["app.py"]["unreadable"] and got["bad.py"]["unreadable"] is None


def test_unreadable_files_are_skipped_with_their_reason(spark):
    files = spark.createDataFrame([("a.py", "python", "eval(x)\n", None), ("b.py", "python", None, "OSError: gone"), ("c.rb", None, "x", None)], "path string, lang string, content string, unreadable string")
    assert sorted(map(tuple, scan.skipped(files).collect())) == [("b.py", "OSError: gone"), ("c.rb", "unsupported language")]


def test_files_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(discovery, "PART_BYTES", 1000)
    for k in range(40):
        (tmp_path / f"f{k:02}.py").write_text("x" * (50 if k % 2 else 450))
    df = discovery.read(spark, [str(tmp_path)])
    from pyspark.sql import functions as F

    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("n")).collect()]
    assert sum(sizes) == 10_000 and len(sizes) >= 7 and max(sizes) <= 2000


def test_roots_of_every_kind(spark, tree):
    names = lambda roots, **how: {r["path"].removeprefix(str(tree)) for r in discovery.read(spark, roots, **how).collect()}
    assert names([str(tree / "app.py")]) == {"app.py"}
    assert names([f"file://{tree}/pkg"]) == {"__init__.py", "_private.py", "deep/er/a.go"}
    assert names([str(tree / "pkg/deep"), str(tree / "app.py")]) == {"/pkg/deep/er/a.go", "/app.py"}
    assert names([f"{tree}/pkg/**/*.go"]) == {"deep/er/a.go"}
    assert names([str(tree / "empty")]) == set()
    with pytest.raises(discovery.DiscoveryError):
        discovery.read(spark, [str(tree / "none")])
    with pytest.raises(discovery.DiscoveryError):
        discovery.read(spark, ["nosuch://host/x"])


def test_many_small_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(discovery, "PART_FILES", 8)
    monkeypatch.setattr(discovery, "ROWS_AT_ONCE", 3)
    for k in range(64):
        (tmp_path / f"f{k:02}.py").write_text("x")
    df = discovery.read(spark, [str(tmp_path)])
    from pyspark.sql import functions as F

    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 64 and len(counts) >= 5 and max(counts) <= 24
