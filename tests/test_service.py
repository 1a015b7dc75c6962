import os
from datetime import timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestar.functions import parse
from lodestar.plans import search
from lodestar.service import Workspace


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "pkg/__init__.py": "VERSION = 1\n", "pkg/store.py": "class Store:\n    def save(self):\n        return 'orchid'\n\ndef load():\n    return None\n",
        "docs/guide.md": "# Guide\n\nThe orchid store keeps rows.\n\n## Setup\n\nRun it.\n", "notes.txt": "an orchid\nand a fern\norchid again\n",
        ".secret.txt": "orchid hidden\n", ".gitignore": "build/\n", "build/out.txt": "orchid built\n", "empty.txt": "",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


def test_workspace(spark, tree, tmp_path):
    space = Workspace(spark, str(tree), str(tmp_path / "index"))
    assert space.status() is None
    assert space.index() == {"added": 4, "modified": 0, "pending": 0, "deleted": 0, "unchanged": 0}
    assert [r["path"] for r in space.files().collect()] == ["docs/guide.md", "notes.txt", "pkg/__init__.py", "pkg/store.py"]
    assert [r["path"] for r in space.files(1, 2).collect()] == ["notes.txt", "pkg/__init__.py"]
    found = space.search(search.hybrid("orchid", limit=3)).orderBy("rank").toPandas()
    assert len(found) == 3 and found["rank"].tolist() == [1, 2, 3] and found.evidence.map(len).min() >= 1
    fts = search.SearchPlan(routes=[search.Route("fts", "orchid")])
    assert {r["path"] for r in space.search(fts).collect()} == {"docs/guide.md", "notes.txt", "pkg/store.py"}
    only = search.SearchPlan(routes=[search.Route("fts", "orchid")], file_types=["md"], exclude_paths=["pkg"])
    assert {r["path"] for r in space.search(only).collect()} == {"docs/guide.md"}
    assert space.search(search.SearchPlan(routes=[search.Route("fts", "orchid")], include_paths=["nowhere"])).count() == 0
    tracked = space.search(search.hybrid("load", limit=1)).first()["id"]
    rest = [r["id"] for r in space.search(search.hybrid("orchid", limit=50)).orderBy("rank").collect()]
    got = space.search(search.hybrid("orchid", limit=1, tracked=rest[-1])).collect()
    assert {r["id"] for r in got} == {rest[0], rest[-1]} and tracked in rest
    named = search.SearchPlan(routes=[search.Route("fts", "find load")], prefer_symbol=True)
    assert space.search(named).orderBy("rank").first()["symbol_name"] == "load"
    both = space.context(["orchid", "fern"], limit=4).orderBy("final").toPandas()
    assert both["final"].tolist() == list(range(1, len(both) + 1)) and both.reason[0] == "coverage"
    assert 0 < space.context(["orchid", "fern"], fuse=True, limit=2).count() <= 2

    (tree / "notes.txt").write_text("a rose\n")
    os.remove(tree / "docs/guide.md")
    assert space.index() == {"added": 0, "modified": 1, "pending": 0, "deleted": 1, "unchanged": 2}
    assert {r["path"] for r in space.search(fts).collect()} == {"pkg/store.py"}
    assert space.status()["total"] == 3 and space.status()["failed"] == 0
    store = space.search(fts).first()["id"]
    told = lambda plan, entity: [(r["route"], r["reason"]) for r in space.diagnose(plan, entity).collect()]
    assert told(search.hybrid("orchid"), store) == [("fts", "found"), ("vector", "found")]
    assert told(search.hybrid("fern"), store) == [("fts", "no match"), ("vector", "found")]
    assert told(search.hybrid("orchid", exclude_paths=["pkg"]), store) == [("fts", "left out by a filter"), ("vector", "left out by a filter")]
    assert told(fts, "none") == [("fts", "not indexed")]

    (tree / "notes.txt").write_text("an orchid\n")
    (tree / "pkg/new.txt").write_text("orchid\n")
    assert space.index(paths=["pkg"])["added"] == 1  # notes.txt isn't looked at
    assert {r["path"] for r in space.search(fts).collect()} == {"pkg/store.py", "pkg/new.txt"}
    os.remove(tree / "pkg/new.txt")
    spark.createDataFrame([("notes.txt",), ("pkg/new.txt",)], "path string").write.parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "changes"))
    space.follow(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {r["path"] for r in space.search(fts).collect()} == {"pkg/store.py", "notes.txt"} and space.status()["total"] == 3

    other = Workspace(spark, str(tree), str(tmp_path / "index"), model_name="other")
    with pytest.raises(ValueError):
        other.index()
    assert other.index(rebuild=True)["added"] == 3
    assert space.drop() and not space.drop()


def test_lines(spark, tree, tmp_path):
    space = Workspace(spark, str(tree), str(tmp_path / "index"))
    at = lambda command: [(r["path"], r["line"]) for r in space.lines(command).collect()]
    assert at("rg orchid") == [("docs/guide.md", 3), ("notes.txt", 1), ("notes.txt", 3), ("pkg/store.py", 3)]
    assert at("rg -m1 orchid notes.txt") == [("notes.txt", 1)]
    assert at("rg --hidden -i ORCHID -t text -g '!notes*'") == [(".secret.txt", 1)]
    assert at("rg VERSION") == [("pkg/__init__.py", 1)]
    assert at("rg --no-ignore built") == [("build/out.txt", 1)]
    cut = space.lines("rg orchid | head -n 2").collect()
    assert len(cut) == 2 and cut[0]["truncated"]
    near = space.lines("rg -C1 fern").first()
    assert (near["first_line"], near["last_line"], near["context"]) == (1, 3, "an orchid\nand a fern\norchid again")


def test_snapshots(spark, tmp_path):
    from lodestar.operators.index import Snapshots

    kept = Snapshots(spark, f"file://{tmp_path}/index")
    assert kept.manifest is None
    kept.write({"model": "a"}, rows=spark.range(3))
    kept.write({"model": "a"}, rows=kept.read("rows").where("id > 0"))
    assert kept.read("rows").count() == 2
    with pytest.raises(ValueError):
        kept.write({"model": "b"}, rows=spark.range(1))
    (tmp_path / "index" / "manifest.json").write_text("{")
    (tmp_path / "index" / ".manifest.json.crc").unlink(missing_ok=True)
    assert kept.manifest is None and len(list((tmp_path / "index").glob("manifest.json.corrupt.*"))) == 1
    with pytest.raises(ValueError):
        kept.read("rows")
    assert kept.drop() and not kept.drop()


def test_plans():
    plan = search.resolve(search.SearchPlan(routes=[search.Route("fts", " a "), search.Route("vector", "b"), search.Route("fts", "c")]))
    assert [(r.id, r.query) for r in plan.routes] == [("fts", "a"), ("vector", "b"), ("fts-2", "c")]
    one = [search.Route("fts", "a")]
    for bad in (
        search.SearchPlan(), search.SearchPlan(routes=[search.Route("fts", " ")]), search.SearchPlan(routes=one, globs=[" "]),
        search.SearchPlan(routes=one, modified_after=-1), search.SearchPlan(routes=one, modified_after=2, modified_before=1),
    ):
        with pytest.raises(search.PlanError):
            search.resolve(bad)
    assert search.symbol_names("find class Foo") == ["Foo"] and search.symbol_names("Owner::method ns::go 9x") == ["Owner::method", "go"]


@pytest.mark.parametrize("text, size", [("512", 512), ("1.5m", 3 << 19), ("10 KB", 10240), (".5g", 1 << 29), ("7b", 7), ("0.3k", 307)])
def test_byte_size(text, size):
    assert parse.byte_size(text) == size


@given(st.text(max_size=8))
def test_byte_size_refuses(text):
    try:
        assert parse.byte_size(text) >= 0
    except ValueError:
        pass


def test_modified_time():
    utc = timezone.utc
    assert parse.modified_time("1700000000000") == 1_700_000_000_000
    assert parse.modified_time("2024-01-02", utc) == parse.modified_time("2024-01-02T00:00:00Z") == parse.modified_time("2024-01-02 01:00:00+01:00") == 1_704_153_600_000
    for bad in ("", "yesterday", "2024-1-2", "-5"):
        with pytest.raises(ValueError):
            parse.modified_time(bad)


def test_line_search():
    got = parse.line_search("rg -iA2 -e 'a b' -e c --glob=*.py -t rust src 'my docs' | head -5")
    assert got.patterns == ["a b", "c"] and got.paths == ["src", "my docs"] and got.options == {"ignore_case": True}
    assert (got.before, got.after, got.limit, got.globs, got.types) == (0, 2, 5, ["*.py"], ["rust"])
    assert parse.line_search("rg '$x|y'").patterns == ["$x|y"] and parse.line_search("rg -- -x").patterns == ["-x"]
    for bad in ("rg", "rg $x", "rg a; ls", "rg a > b", "rg a | sort", "rg --unknown a", "rg `a`", "rg a && b", "rg -A"):
        with pytest.raises(ValueError):
            parse.line_search(bad)
