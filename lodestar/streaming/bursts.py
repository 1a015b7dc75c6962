"""Bursts of changes with state: each root's changes are held until it is quiet, or until the first has waited long enough.

Time is that of the events, or the clock's; by the former what has been held is put in their order, so the result doesn't depend on how a stream is cut
into micro-batches or in which order a batch's rows come.  A burst is closed when the watermark has passed its end: the last
change and the quiet time, or the first one and the longest wait.  A path goes with the merged kind of its changes, unless a
folder above it is deleted or has to be read again; of more paths than the budget nothing is kept but that the whole root has
to be compared.  So a root's state is bounded by the budget and by what comes within the watermark's delay.  Roots share
the keys of the state by their hash.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .changes import BUDGET

OUT = "root string, start timestamp, end timestamp, path string, kind string, events long"
IGNORE = ".gitignore"
#: The kinds of what isn't one file: a folder to read again, and a whole root.
RESCAN, RECONCILE = "rescan", "reconcile"
#: Keys of the state, each of many roots (a checkpoint has to keep their number); most rows of a piece of changes; how many
#: smaller pieces of a key are kept before they are made one.
BUCKETS, PIECE, SMALL = 4096, 10_000, 64
#: Changes that are held, in the order in which they are taken.
PENDING = pa.schema([("root", pa.large_string()), ("micros", pa.int64()), ("event_id", pa.int64()), ("path", pa.large_string()), ("kind", pa.large_string())])


@dataclass(frozen=True)
class Waits:
    """In milliseconds: how long a root has to be quiet, and how long its first change may wait."""

    quiet: int = 750
    longest: int = 5000
    budget: int = BUDGET


def merged(before: str | None, kind: str) -> str:
    """One kind of change for two in order: a created file that is deleted is deleted, one that changes is created; others
    that differ are a change."""
    if before is None or before == kind:
        return kind
    if before == "created" and kind in ("deleted", "changed"):
        return "deleted" if kind == "deleted" else "created"
    return "changed"


def scopes(kinds: dict[str, tuple[str, int]]) -> list[tuple[str, str, int]]:
    """(path, kind, events) of a burst: an ignore file stands for its folder, and what is below a deleted path or a folder
    that is read again is left out."""
    wide: dict[str, tuple[str, int]] = {}
    for path, (kind, events) in kinds.items():
        folder, _, name = path.rpartition("/")
        if name == IGNORE:
            wide[folder] = (RESCAN, events + wide.get(folder, ("", 0))[1])
    for path, (kind, events) in kinds.items():
        if path.rpartition("/")[2] != IGNORE and path not in wide:
            wide[path] = (kind, events)
    covers = {p for p, (kind, _) in wide.items() if kind in ("deleted", RESCAN)}

    def covered(path: str) -> bool:
        parts = path.split("/")
        return any("/".join(parts[:n]) in covers for n in range(1, len(parts))) or ("" in covers and path != "")

    return [(p, kind, n) for p, (kind, n) in sorted(wide.items()) if not covers or not covered(p)]


def _in_order(tables: list[pa.Table]) -> Iterator[tuple]:
    """Rows by root, time, event, path and kind, few of them at once as objects."""
    rows = pa.concat_tables(tables).sort_by([(c, "ascending") for c in PENDING.names])
    for at in range(0, len(rows), PIECE):
        yield from zip(*(c.to_numpy().tolist() for c in rows.slice(at, PIECE).columns))


def _frame(out: list[tuple]) -> pd.DataFrame:
    """Rows as OUT, with instants whatever the session's time zone is."""
    found = pd.DataFrame(out, columns=["root", "start", "end", "path", "kind", "events"])
    return found.assign(**{c: pd.Series(found[c].to_numpy("datetime64[us]")).dt.tz_localize("UTC") for c in ("start", "end")})


class Bursts(StatefulProcessor):
    """The state of the roots of a bucket: changes that the watermark hasn't passed, and the open bursts with their paths.

    A call to the state and a key each cost far more than a change, so roots share a key, changes are held as pieces of many
    rows, and only what a timer is for is read: pieces with changes that have passed, and bursts that get one or have ended.
    """

    def __init__(self, waits: Waits, clock: bool = False):
        self.waits, self.clock = waits, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # As JSON: the next piece's number, (number, first time, rows) of pieces, ends of open bursts by root, and the timer.
        self.known = handle.getValueState("known", "json string")
        self.pieces = handle.getMapState("pieces", "n long", "rows binary")
        self.open = handle.getMapState("open", "root string", "first long, last long, over boolean, events long, paths string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._known()
        for batch in rows:
            self._hold(known, [pa.Table.from_pandas(batch[PENDING.names], PENDING, preserve_index=False)])
        small = [p for p in known["pieces"] if p[2] < PIECE]
        if len(small) > SMALL:
            self._hold(known, [self._taken(known, p) for p in small])
        self._wake(known)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = 1000 * (timerValues.getCurrentProcessingTimeInMs() if self.clock else timerValues.getCurrentWatermarkInMs())
        known = self._known()
        passed, left = [PENDING.empty_table()], []
        for piece in [p for p in known["pieces"] if p[1] <= until]:
            rows = self._taken(known, piece)
            due = pc.less_equal(rows["micros"], until)
            passed.append(rows.filter(due))
            left.append(rows.filter(pc.invert(due)))
        if left:
            self._hold(known, left)
        ended, out = {root for root, end in known["ends"].items() if end <= until}, []
        for root, changes in groupby(_in_order(passed), lambda c: c[0]):
            ended.discard(root)
            for row in self._passed(known, root, changes, until):
                out.append(row)
                if len(out) >= PIECE:
                    yield _frame(out)
                    out = []
        for root in sorted(ended):
            out += self._passed(known, root, (), until)
        if known["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            known["timer"] = None  # Spark takes it away
        self._wake(known)
        if out:
            yield _frame(out)

    def _passed(self, known: dict, root: str, changes: Iterable[tuple], until: int) -> Iterator[tuple]:
        """The rows of a root's bursts that have ended, after its next changes in order."""
        burst, end = None, known["ends"].get(root)
        if end is not None:
            *burst, paths = self.open.getValue((root,))
            burst.append(json.loads(paths))
        for _, ts, _, path, kind in changes:
            if burst and ts >= end:
                yield from self._rows(root, burst, end)
                burst = None
            burst = burst or [ts, ts, False, 0, {}]
            burst[1], burst[3] = ts, burst[3] + 1
            end = min(ts + self.waits.quiet * 1000, burst[0] + self.waits.longest * 1000)
            if not burst[2]:
                paths = burst[4]
                before = paths.get(path, (None, 0))
                paths[path] = (merged(before[0], kind), before[1] + 1)
                if len(paths) > self.waits.budget:
                    burst[2], burst[4] = True, {}
        if burst and until >= end:
            yield from self._rows(root, burst, end)
            burst = None
        if burst:
            self.open.updateValue((root,), (*burst[:4], json.dumps(burst[4])))
            known["ends"][root] = end
        elif known["ends"].pop(root, None) is not None:
            self.open.removeKey((root,))

    @staticmethod
    def _rows(root: str, burst: list, end: int) -> list[tuple]:
        first, _, over, events, paths = burst
        return [(root, first, end, *row) for row in ([("", RECONCILE, events)] if over else scopes(paths))]

    def _known(self) -> dict:
        found = self.known.get()
        return json.loads(found[0]) if found else {"next": 0, "pieces": [], "ends": {}, "timer": None}

    def _hold(self, known: dict, tables: list[pa.Table]) -> None:
        """Hold changes as pieces in the order of time."""
        rows = pa.concat_tables(tables).sort_by("micros")
        for at in range(0, len(rows), PIECE):
            piece, sink = rows.slice(at, PIECE).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PENDING) as writer:
                writer.write_table(piece)
            self.pieces.updateValue((known["next"],), (sink.getvalue().to_pybytes(),))
            known["pieces"].append((known["next"], piece["micros"][0].as_py(), len(piece)))
            known["next"] += 1

    def _taken(self, known: dict, piece: list) -> pa.Table:
        (rows,) = self.pieces.getValue((piece[0],))
        self.pieces.removeKey((piece[0],))
        known["pieces"].remove(piece)
        return pa.ipc.open_stream(bytes(rows)).read_all()

    def _wake(self, known: dict) -> None:
        """Set the one timer to the first change that is held or the first end, and keep what is known."""
        ends = [first for _, first, _ in known["pieces"]] + list(known["ends"].values())
        at = -(-min(ends) // 1000) if ends else None
        if at != known["timer"]:
            if known["timer"] is not None:
                self.handle.deleteTimer(known["timer"])
            if at is not None:
                self.handle.registerTimer(at)
            known["timer"] = at
        if ends:
            self.known.update((json.dumps(known),))
        else:
            self.known.clear()

    def close(self) -> None:
        pass


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for streams that are started within; the session's own is set again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bursts(events: DataFrame, late: str | None, waits: Waits = Waits()) -> DataFrame:
    """(root, start, end, path, kind, events) of a stream of (root, ts, event_id, path, kind): each burst's paths when it
    ends.  Changes that come behind the watermark, that is by more than ``late``, are left out by Spark; rows without a
    root, a time or a path are no changes.  Without ``late`` the clock tells when a burst has ended, for streams whose times
    are those of their arrival.  Start the stream within ``stateful``."""
    known = events.where("root IS NOT NULL AND ts IS NOT NULL AND path IS NOT NULL")
    known = known if late is None else known.withWatermark("ts", late)
    rows = known.select(F.col("root").cast("string").alias("root"), "ts", F.unix_micros(F.col("ts")).alias("micros"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), "path", F.coalesce("kind", F.lit("changed")).alias("kind"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(Bursts(waits, late is None), OUT, "append", "processingTime" if late is None else "eventTime")
