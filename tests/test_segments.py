"""A log of segments, an index that is one, and vector lists, against brute force."""

import glob
import os
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.operators import recall, segments, vector_lists
from lodestar.plans.search import Route, SearchPlan
from lodestar.service import Workspace


def test_log(spark, tmp_path, monkeypatch):
    """Random updates against a dictionary: what is read, what is written, merges and sums."""
    monkeypatch.setattr(segments, "LEAST_ROWS", 8)
    monkeypatch.setattr(segments, "FAN_OUT", 3)
    random.seed(2)
    words = lambda rows: rows.select("number", F.upper("word").alias("word"))
    tables = {"files": segments.Order(("path",)), "rows": segments.Order(), "upper": segments.Order(("word",), ("word",))}
    log, want, kept = segments.Log(spark, str(tmp_path / "log"), tables, whole=("files",), derived={"upper": ("rows", words)}), {}, {}
    for step in range(6):
        new = {f"f{random.randrange(12)}": [random.choice("abcdef") for _ in range(random.randrange(1, 6))] for _ in range(3)}
        noted = [f for f in want if f not in new][:1]
        gone = [f for f in new if f in want] + ([random.choice(sorted(set(want) - set(new) - set(noted)))] if len(want) > 6 else [])
        rows = spark.createDataFrame([(f, w) for f, ws in new.items() for w in ws], "file_id string, word string")
        files = spark.createDataFrame([(f, f"/{f}", step) for f in [*new, *noted]], "file_id string, path string, step int")
        marks = spark.createDataFrame([(f, True) for f in gone] + [(f, False) for f in noted], "file_id string, whole boolean")
        before = log.parts()
        log = log.append({"files": files, "rows": rows}, marks, {"rows": sum(map(len, new.values())) - sum(len(want[f]) for f in gone)})
        for f in gone:
            del want[f], kept[f]
        want |= new
        kept |= dict.fromkeys([*new, *noted], step)
        # The update's own rows alone, in order.
        (own,) = {s for t, s in log.parts() - before if t == "rows"}
        assert log.state.segments[own] == {"files": len(new) + len(noted), "rows": sum(map(len, new.values())), "upper": sum(map(len, new.values()))}
        log = log.merged()
        assert sorted((r.file_id, r.word) for r in log.read("rows").collect()) == sorted((f, w) for f, ws in want.items() for w in ws)
        both = log.read("upper", numbers=True).join(log.read("rows", numbers=True).withColumnRenamed("word", "w"), ["seq", "number"])
        assert sorted((r.file_id, r.word) for r in both.collect()) == sorted((f, w.upper()) for f, ws in want.items() for w in ws)
        assert {r.file_id: r.step for r in log.read("files").collect()} == kept and log.read("files").count() == len(kept)
        assert log.state.sums == {"rows": sum(map(len, want.values()))}
        assert segments.State.read(log.state.said()) == log.state
        sizes = [log.size(s) for s in log.state.segments]
        assert all(sizes.count(c) < 3 for c in sizes)
    assert len(log.state.segments) < 6 and log.emptied().state.next == log.state.next


def test_log_of_nothing(spark, tmp_path):
    log = segments.Log(spark, str(tmp_path), {"rows": segments.Order(("word",))})
    none = spark.createDataFrame([], "file_id string, word string")
    log = log.append({"rows": none}, spark.createDataFrame([], "file_id string, whole boolean"))
    assert log.read("rows").count() == 0 and log.parts() == set()
    with pytest.raises(ValueError, match="other columns"):
        log.append({"rows": none.withColumnRenamed("word", "term")})


def test_update_writes_its_rows_alone(spark, tmp_path):
    root, folder = tmp_path / "tree", tmp_path / "index"
    root.mkdir()
    for i in range(12):
        (root / f"{i:02}.txt").write_text(f"common words of file number{i}\n" * (i + 1))
    space = Workspace(spark, str(root), str(folder), no_ignore=True)
    space.index()
    for f in glob.glob(f"{folder}/segments/postings/*/*.parquet"):
        terms = pq.read_table(f).column("term").to_pylist()
        assert terms == sorted(terms, key=str.encode)
    find = lambda word: {r["path"] for r in space.search(SearchPlan(routes=[Route("fts", word)], limit=50)).collect()}
    (root / "05.txt").write_text("fresh content\n")
    os.remove(root / "06.txt")
    os.utime(root / "07.txt", (time.time() + 50,) * 2)  # another time, the same content
    assert space.index()["modified"] == 1
    state = space.snapshots.log(space.snapshots.manifest).state
    assert state.segments[max(state.segments)] == {"files": 2, "entities": 1, "postings": 2}  # one file was only noted
    assert find("fresh") == {"05.txt"} and find("number5") == find("number6") == set() and find("number7") == {"07.txt"}
    assert len(find("common")) == 10 and space.files().count() == 11
    entities = space.snapshots.read("entities")
    assert state.sums == {"texts": 11, "terms": sum(len(r.text.split()) for r in entities.collect())}
    assert {r.doc for r in entities.collect()} == {None} and "number" not in entities.columns
    # Nothing has changed, nothing is written; and a build from scratch gives the same.
    assert space.index()["unchanged"] == 11 and space.snapshots.log(space.snapshots.manifest).state == state
    scores = lambda: [(r.path, r.score) for r in space.search(SearchPlan(routes=[Route("fts", "common number7")], limit=5)).collect()]
    then = scores()
    space.index(rebuild=True)
    assert scores() == then and len(space.snapshots.log(space.snapshots.manifest).state.segments) == 1


def test_lock_of_a_dead_writer(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_text("words\n")
    space = Workspace(spark, str(root), str(tmp_path / "index"), no_ignore=True)
    space.index()
    (tmp_path / "index/lock").write_text("")
    with pytest.raises(ValueError, match="another writer"):
        space.index()
    os.utime(tmp_path / "index/lock", (time.time() - 7 * 3600,) * 2)
    assert space.index()["unchanged"] == 1
    assert not any(n.startswith("lock") for n in os.listdir(tmp_path / "index"))


def _vectors(spark, n, clustered):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(20, 16)) * 6
    rows = [(i, (centers[i % 20] * clustered + rng.normal(size=16)).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * 16), (n + 2, rows[3][1])], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("clustered", [0, 1])
def test_vector_lists(spark, tmp_path, clustered):
    """All lists give the exact answer; fitted probes find nine tenths of it, and few lists of clusters are enough."""
    vectors = _vectors(spark, 900, clustered)
    asked = vectors.where("vec_id % 9 = 0 or vec_id > 899")
    limits = vector_lists.Settings(rows=10, block=7)
    centers = vector_lists.centroids(vectors)
    listed = vector_lists.write_lists(vectors, centers, str(tmp_path / "lists"))
    assert listed.count() == 902 and len(centers) == 30
    rows = lambda df: {(r.query_id, r.vec_id, r["rank"]) for r in df.collect()}
    exact = rows(recall.neighbours(vectors, asked, 10))
    assert rows(vector_lists.search(listed, centers, vectors, asked, 10, len(centers), settings=limits)) == exact
    probes = vector_lists.fitted_probes(listed, centers, vectors, 10)
    found = rows(vector_lists.search(listed, centers, vectors, asked, 10, probes))
    pairs = lambda x: {p[:2] for p in x}
    assert len(pairs(found) & pairs(exact)) >= 0.9 * len(exact)
    assert probes <= 6 if clustered else probes > 6
    for f in glob.glob(str(tmp_path / "lists/*.parquet")):
        order = pq.read_table(f).column("list").to_pylist()
        assert order == sorted(order)


def test_vector_lists_of_nothing(spark, tmp_path):
    none = _vectors(spark, 5, 0).where("embedding is null")
    centers = vector_lists.centroids(none)
    listed = vector_lists.write_lists(none, centers, str(tmp_path / "lists"))
    assert vector_lists.search(listed, centers, none, none, 3, 1).count() == 0


def test_matrix():
    there, rows = recall.matrix(pa.chunked_array([pa.array([[1.0, 2.0], None]), pa.array([[3.0, 4.0]])]))
    assert there.tolist() == [0, 2] and rows.tolist() == [[1, 2], [3, 4]]
