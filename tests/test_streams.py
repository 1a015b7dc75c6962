"""Bursts of changes with state, and the source of changed files, against brute force."""

import datetime
import os
import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.plans.search import Route, SearchPlan
from lodestar.service import Workspace
from lodestar.sources import watch
from lodestar.streaming import bursts as B

T0 = datetime.datetime(2024, 1, 1)


def brute(events, waits, until):
    """Bursts that have ended by a time, of events (root, ts, event_id, path, kind)."""
    out, us = [], lambda t: (t - T0) // datetime.timedelta(microseconds=1)
    for root in {e[0] for e in events}:
        groups = []
        for _, ts, i, path, kind in sorted((e for e in events if e[0] == root), key=lambda e: e[1:3]):
            t = us(ts)
            if not groups or t >= min(groups[-1][-1][0] + waits.quiet * 1000, groups[-1][0][0] + waits.longest * 1000):
                groups.append([])
            groups[-1].append((t, path, kind))
        for g in groups:
            end = min(g[-1][0] + waits.quiet * 1000, g[0][0] + waits.longest * 1000)
            if end > us(until):
                continue
            kinds = {}
            for _, path, kind in g:
                was = kinds.get(path, (None, 0))
                kinds[path] = (B.merged(was[0], kind), was[1] + 1)
            rows = [("", B.RECONCILE, len(g))] if len(kinds) > waits.budget else B.scopes(kinds)
            out += [(root, g[0][0], end, *r) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_bursts(spark, tmp_path, seed):
    """The same whatever batches the changes come in, and in whatever order; the longest wait of 5 s cuts busy roots."""
    rng = random.Random(seed)
    paths = ["a/b/c.txt", "a/b", "a/d.txt", "a/.gitignore", "e.txt", "f/g.txt"] + [f"many/{i}" for i in range(12)]
    events = []
    for root in ("busy", "calm", "wide"):
        t = 0
        for _ in range(70):
            t += rng.choice([40, 300, 700, 749, 750, 900]) if root != "calm" else rng.choice([100, 2000])
            some = paths if root == "wide" else paths[:6]
            events.append((root, T0 + datetime.timedelta(milliseconds=t), len(events) // 2, rng.choice(some), rng.choice(["created", "changed", "deleted"])))
    waits = B.Waits(budget=5)
    end = T0 + datetime.timedelta(hours=1)
    shuffled = sorted(events, key=lambda e: (e[1].minute * 60 + e[1].second) // 15 + rng.random())  # within the watermark's delay
    batches = [shuffled[i : i + 30] for i in range(0, len(shuffled), 30)] + [[("last", end, 10**6, "x", "changed")]]
    schema = "root string, ts timestamp, event_id long, path string, kind string"
    where = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame([*rows, (None, end, 1, "x", "changed"), ("busy", None, 1, "x", "changed")][: len(rows) + 2 * (n == 0)], schema).coalesce(1).write.mode("append").parquet(str(where / f"n={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(where / "*"))
    with B.stateful(spark):
        ask = B.bursts(stream, "40 seconds", waits).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        run = ask.format("parquet").option("path", str(tmp_path / "out")).start()
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).withColumns({c: F.unix_micros(c) - int(T0.replace(tzinfo=datetime.UTC).timestamp() * 10**6) for c in ("start", "end")}).collect()
    want = [b for b in brute(events, waits, end - datetime.timedelta(seconds=40))]
    assert sorted((r.root, r.start, r.end, r.path, r.kind, r.events) for r in got) == want
    assert any(w[4] == B.RECONCILE for w in want) and any(w[2] - w[1] == 5_000_000 for w in want)


class Held:
    """The state of a key in memory, which counts the calls to it."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def _state(self, name, *_):
        return State(self, self.states.setdefault(name, {}))

    getValueState = getListState = getMapState = _state  # noqa: N815

    def registerTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.calls += 1
        self.timers.discard(t)

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return sorted(self.timers)

    def run(self, key, processor, rows, now):
        """A micro-batch: the rows, then the timers up to now."""
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
        out = list(processor.handleInputRows(key, iter([pd.DataFrame(r, columns=["root", "micros", "event_id", "path", "kind"]) for r in rows]), times)) if rows else []
        for t in sorted(t for t in self.timers if t <= now):
            out += processor.handleExpiredTimer(key, times, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
            self.timers.discard(t)
        return [row for frame in out for row in frame.itertuples(index=False)]


class State:
    """A value, a list or a map of a key."""

    def __init__(self, held, has):
        self.held, self.has = held, has

    def __getattr__(self, name):
        has = self.has
        calls = {
            "exists": lambda: bool(has), "get": lambda: has.get(0), "update": lambda v: has.update({0: v}), "put": lambda v: has.update({0: v}), "clear": has.clear,
            "appendList": lambda v: has.update({0: has.get(0, []) + v}), "getValue": has.__getitem__, "updateValue": has.__setitem__, "removeKey": has.__delitem__,
            "containsKey": has.__contains__, "keys": lambda: list(has), "iterator": lambda: list(has.items()),
        }
        self.held.calls += 1
        return calls[name]


@pytest.mark.parametrize("seed", range(8))
def test_roots_that_share_a_key(monkeypatch, seed):
    """Whatever pieces the changes of a key are held in, its roots' bursts are those of brute force, and nothing stays."""
    monkeypatch.setattr(B, "PIECE", 7)
    monkeypatch.setattr(B, "SMALL", 3)
    rng = random.Random(seed)
    us = lambda t: (t - T0) // datetime.timedelta(microseconds=1)
    events = [(f"r{rng.randrange(9)}", T0 + datetime.timedelta(microseconds=rng.randrange(90_000_000)), i, rng.choice(["a", "a/b", "c", "c/d", "e"]), rng.choice(["created", "changed", "deleted"])) for i in range(900)]
    waits, late = B.Waits(budget=3), rng.choice([0, 2_000, 30_000])
    events.sort(key=lambda e: us(e[1]) + rng.randrange(late * 1000 + 1))
    held, got, now, at = Held(), [], 0, 0
    processor = B.Bursts(waits)
    processor.init(held)
    while at < len(events) or held.timers:
        batch = events[at : (at := at + rng.choice([1, 4, 40]))]
        rows = [[(r, us(t), i, p, k) for r, t, i, p, k in batch[n : n + 10]] for n in range(0, len(batch), 10)]
        got += held.run((1,), processor, rows, now)
        now = max([now, *(us(e[1]) // 1000 - late for e in batch)]) if batch else now + 10_000
        assert len(held.timers) <= 1
    zero = pd.Timestamp(0, tz="UTC")
    found = sorted((r.root, (r.start - zero) // pd.Timedelta(1, "us"), (r.end - zero) // pd.Timedelta(1, "us"), r.path, r.kind, r.events) for r in got)
    assert found == brute(events, waits, T0 + datetime.timedelta(hours=1)) and any(r[4] == B.RECONCILE for r in found)
    assert not any(held.states.values())


def test_calls_to_the_state():
    """They don't grow with the changes of a key: a call costs far more than a change does."""
    held = Held()
    processor = B.Bursts(B.Waits(budget=10))
    processor.init(held)
    rows = [(f"r{i % 20}", i * 1000, i, f"d{i % 7}/f{i % 29}", "changed") for i in range(5_000)]
    got = held.run((1,), processor, [rows], 4_000)
    got += held.run((1,), processor, [], 10_000)
    assert held.calls < 150
    assert sum(r.events for r in got) == 5_000 and len(got) == 20


def test_scopes():
    kinds = {"a/b/c": ("changed", 2), "a/b": ("deleted", 1), "a/bc": ("created", 1), "d/.gitignore": ("changed", 3), "d/e/f": ("deleted", 1), "d": ("changed", 1), ".x": ("changed", 1)}
    assert B.scopes(kinds) == [(".x", "changed", 1), ("a/b", "deleted", 1), ("a/bc", "created", 1), ("d", "rescan", 3)]
    assert B.scopes({".gitignore": ("created", 1), "x": ("changed", 1)}) == [("", "rescan", 1)]


def test_watch(spark, tmp_path):
    """Created, changed and deleted files of a tree arrive once, over runs that go on from one checkpoint."""
    root = tmp_path / "tree"
    (root / "src/deep").mkdir(parents=True)
    (root / ".git").mkdir()
    for name in ("a.txt", "src/b.txt", "src/deep/c.txt", ".git/x"):
        (root / name).write_text("1")
    seen = tmp_path / "seen"

    def run():
        stream = watch.changed_files(spark, str(root), str(tmp_path / "state"))
        q = stream.writeStream.format("parquet").option("path", str(seen)).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        q.awaitTermination()
        rows = spark.read.schema(watch.SCHEMA).parquet(str(seen)).collect() if os.path.isdir(seen) else []
        return sorted((r.path, r.kind, r.size_bytes) for r in rows)

    assert run() == []
    (root / "a.txt").write_text("22")
    (root / "new/far").mkdir(parents=True)
    (root / "new/far/d.txt").write_text("333")
    os.remove(root / "src/deep/c.txt")
    (root / ".git/x").write_text("changed")
    first = [("a.txt", "changed", 2), ("new/far/d.txt", "created", 3), ("src/deep/c.txt", "deleted", None)]
    assert run() == first
    assert run() == first
    os.remove(root / "new/far/d.txt")
    os.rmdir(root / "new/far")
    os.rmdir(root / "new")
    assert run() == sorted([*first, ("new/far/d.txt", "deleted", None)], key=lambda r: r[:2])


def test_a_round_again(tmp_path):
    """A batch that is run again compares with the same listing."""
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a").write_text("1")
    reader = watch.ChangeReader({"path": str(root), "state": str(tmp_path / "state"), "existing": "true"})
    run = lambda start, end: sorted(r[:2] for p in reader.partitions(start, end) for r in reader.read(p))
    one = reader.latestOffset()
    assert run(reader.initialOffset(), one) == [("a", "created")] == run(reader.initialOffset(), one)
    (root / "b").write_text("1")
    two = reader.latestOffset()
    assert two["round"] == 2 and run(one, two) == [("b", "created")] == run(one, two)
    reader.commit(two)


def test_workspace_watch(spark, tmp_path):
    """An index follows its tree: a changed file is found, a removed one isn't."""
    root = tmp_path / "tree"
    root.mkdir()
    for name in ("a", "b"):
        (root / f"{name}.txt").write_text(f"words of {name}\n")
    space = Workspace(spark, str(root), str(tmp_path / "index"), no_ignore=True)
    space.index()
    found = lambda: {(r["path"], w) for w in ("late", "words") for r in space.search(SearchPlan(routes=[Route("fts", w)])).collect()}
    run = space.watch(str(tmp_path / "watch"), B.Waits(quiet=100))
    try:
        end = time.time() + 90
        while not os.path.isdir(tmp_path / "watch/listings/round-2") and time.time() < end:
            time.sleep(0.2)  # the first listing is the start
        (root / "a.txt").write_text("late words\n")
        os.remove(root / "b.txt")
        while found() != {("a.txt", "late"), ("a.txt", "words")} and run.isActive and time.time() < end:
            time.sleep(0.5)
    finally:
        run.stop()
    assert run.exception() is None and found() == {("a.txt", "late"), ("a.txt", "words")}
