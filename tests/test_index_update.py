"""Updates of an index: images, failures, links, one writer, versions that go, and what is read and embedded."""

import os

import numpy as np
import pytest

from lodestar.operators import chunking, embed
from lodestar.plans.search import PlanError, Route, SearchPlan, hybrid
from lodestar.service import Workspace
from lodestar.sources import files

PNG = b"\x89PNG\r\n\x1a\n" + bytes(range(256)) * 4


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "src/deep/er/still/further").mkdir(parents=True)
    (root / "a.txt").write_text("merge join\nbroken pipe\n")
    (root / "src/b.py").write_text("def spill():\n    return 1\n")
    (root / "src/deep/er/still/further/c.txt").write_text("sort merge far below\n")
    (root / "src/logo.webp").write_bytes(PNG)
    os.symlink(root / "src", root / "src/deep/again")
    return root


def test_update(spark, tree, tmp_path):
    calls = tmp_path / "calls"
    calls.write_text("")

    def model(text, path=str(calls)):
        with open(path, "a") as f:
            f.write("x")
        if "broken" in text:
            raise RuntimeError("no vector for this")
        return embed.stub_vector(text)

    space = Workspace(spark, str(tree), str(tree / "index"), model=model, no_ignore=True)
    assert space.index() == {"added": 4, "modified": 0, "pending": 0, "deleted": 0, "unchanged": 0, "failed": 1}
    # Each of the three texts is embedded once; the image has no text, and the link isn't followed.
    assert len(calls.read_text()) == 3
    rows = {r["path"]: r for r in space.files().collect()}
    assert set(rows) == {"a.txt", "src/b.py", "src/deep/er/still/further/c.txt", "src/logo.webp"}
    assert "no vector" in rows["a.txt"]["error"] and rows["a.txt"]["entity_count"] == 0 and rows["src/logo.webp"]["entity_count"] == 0
    assert rows["src/b.py"]["entity_count"] == 1 and rows["src/b.py"]["error"] is None
    assert space.index()["unchanged"] == 4 and len(calls.read_text()) == 3  # nothing is read or embedded again
    (tree / "a.txt").write_text("all is well now, merge join\n")
    (tree / "src/new.txt").write_text("not looked at yet\n")
    assert space.index(paths=["a.txt"]) == {"added": 0, "modified": 1, "pending": 0, "deleted": 0, "unchanged": 0}
    rows = {r["path"]: r for r in space.files().collect()}
    assert rows["a.txt"]["error"] is None and "src/new.txt" not in rows and len(rows) == 4
    assert {r["path"] for r in space.search(SearchPlan(routes=[Route("fts", "merge")])).collect()} == {"a.txt", "src/deep/er/still/further/c.txt"}
    # Two versions are kept: the one that is read and the one before it.
    assert sum(n.startswith("snapshot-") for n in os.listdir(tree / "index")) == 2
    (tree / "index/lock").write_text("")
    with pytest.raises(ValueError, match="another writer"):
        space.index()


def test_tracked_only_where_it_matches(spark, tree, tmp_path):
    space = Workspace(spark, str(tree), str(tmp_path / "index"), no_ignore=True)
    space.index()
    ids = {r["symbol_name"]: r["id"] for r in space.snapshots.read("entities").collect()}
    plan = hybrid("merge join", limit=1, tracked=ids["spill"])
    row = next(r for r in space.search(plan).collect() if r["id"] == ids["spill"])
    assert row["matched_by"] == "vector"  # its text has no token of the query


def test_paths_of_a_line_search(spark, tree, tmp_path):
    space = Workspace(spark, str(tree), str(tmp_path / "index"))
    assert space.lines("rg merge src").count() == 1
    with pytest.raises(PlanError):
        space.lines("rg merge nowhere")


def test_cut_failures_and_images(spark):
    rows = [("1", "code", "python", "def f():\n  pass"), ("2", "image", "png", "PNG"), ("3", "text", "text", "plain")]
    df = spark.createDataFrame(rows, "file_id string, kind string, format string, text string")
    assert {r["file_id"] for r in chunking.entities(df).collect()} == {"1", "3"}
    assert {(r["file_id"], r["symbol_type"]) for r in chunking.entities(df, images=True).collect()} == {("1", "function"), ("2", "image"), ("3", None)}


def test_listing(spark, tree):
    (tree / "src/.gitignore").write_text("*.py\n")
    found = {r["relative_path"] for r in files.listing(spark, str(tree)).collect()}
    assert found == {"a.txt", "src/b.py", "src/logo.webp", "src/.gitignore", "src/deep/er/still/further/c.txt"}
    some = {r["relative_path"] for r in files.listing(spark, str(tree), ["src/deep", "src/b.py", "gone"]).collect()}
    assert some == {"src/b.py", "src/.gitignore", "src/deep/er/still/further/c.txt"}
    assert files.overlapping(["/a", "/a/b", "/c", "/c/"]) == [("/a", "/a/b"), ("/c", "/c")]


def test_pattern_files_and_types(spark, tree, tmp_path):
    (tree / "patterns.cfg").write_text("merge join\nspill\n")
    space = Workspace(spark, str(tree), str(tmp_path / "index"))
    assert sorted(r["path"] for r in space.lines("rg -F -f patterns.cfg src a.txt").collect()) == ["a.txt", "src/b.py"]
    (tree / "patterns.cfg").write_text("\r\nspill\r\n\n")  # neither line ends nor empty lines are patterns
    assert [r["path"] for r in space.lines("rg -f patterns.cfg src").collect()] == ["src/b.py"]
    with pytest.raises(PlanError):
        space.lines("rg -f nowhere.cfg")
    with pytest.raises(PlanError) as error:
        space.search(hybrid("x", file_types=["pyton"]))
    assert error.value.code == "FILE_TYPE"


def test_budgets_and_symbols(spark, tree, tmp_path):
    (tree / "dense.txt").write_text("\n".join("1234567890" * 3 for _ in range(40)))
    (tree / "plain.txt").write_text("\n".join("words of plain text here too" for _ in range(40)))
    space = Workspace(spark, str(tree), str(tmp_path / "index"), tokens=200, no_ignore=True)
    space.index()
    found = space.snapshots.read("entities").join(space.files().select("file_id", "path"), "file_id").collect()
    longest = lambda name: max(len(r["text"]) for r in found if r["path"] == name)
    assert longest("dense.txt") <= 200 < longest("plain.txt") <= 370
    got = space.search(SearchPlan(routes=[Route("vector", "anything")], symbols=["spill"], limit=5)).collect()
    assert [r["symbol_name"] for r in got] == ["spill"]
