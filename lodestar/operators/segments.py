"""A log-structured table: immutable sorted segments, tombstones of the files that a later one replaces, merged by size.

An update writes the rows of what changed as one segment more, and the files that it replaces or removes as tombstones; no
row of another file is read or written.  A tombstone hides rows of segments before it alone.  Segments of like size are
merged once there are enough of them, without what is hidden, so a row is rewritten as often as its segment's size has
grown by the fan-out, and the number of segments stays with the logarithm of the rows.  What a log is made of at a time is a
small state that a manifest names; what a state doesn't name is no part of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments of one size that are merged, and the rows of the smallest size.
FAN_OUT, LEAST_ROWS = 8, 1 << 12
SEQ, NUMBER = "seq", "number"
#: Rows that go to Python together when a segment is written.
BATCH_ROWS = 512


@dataclass
class State:
    """What a log is made of: rows of each table by segment, tombstones, sums kept by deltas, and the tables' schemas."""

    next: int = 1
    segments: dict[int, dict[str, int]] = field(default_factory=dict)
    gone: list[int] = field(default_factory=list)
    sums: dict[str, int] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def read(said: dict | None) -> State:
        if not said:
            return State()
        return State(said["next"], {int(k): v for k, v in said["segments"].items()}, said["gone"], said["sums"], said["schemas"])

    def said(self) -> dict:
        return {"next": self.next, "segments": {str(k): v for k, v in self.segments.items()}, "gone": self.gone, "sums": self.sums, "schemas": self.schemas}


@dataclass(frozen=True)
class Order:
    """How a segment's rows of a table are dealt to files and sorted in each: by ranges of the columns that sort them, by
    hashes of SQL expressions, or as they come.  Hashes need no sample of the rows, which would have to be made twice."""

    sort: tuple[str, ...] = ()
    deal: tuple[str, ...] = ()

    def ordered(self, rows: DataFrame) -> DataFrame:
        if self.deal:
            rows = rows.repartition(*[F.expr(d) for d in self.deal])
        elif self.sort:
            rows = rows.repartitionByRange(*self.sort)
        return rows.sortWithinPartitions(*self.sort) if self.sort else rows


#: Postings by term.  The upper bits of a row's number are its part of the segment, so a term's lists come together for so
#: many parts only, and a frequent term's are in many files.
POSTED = Order(("term", "docs"), ("term", "shiftright(docs[0], 33 + 6)"))


@contextmanager
def few_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most for what runs within, so that batches of long texts stay small; the session's
    own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Log:
    """Tables that share segments and tombstones, below one folder: {table: its order}.

    Every table has the column ``key``, but for those that are derived: {table: (the table it is made of, how)}.  A table that
    others are made of numbers its rows in ``number``, within the segment, and they speak of its rows by that number, so that
    they are hidden with them.  ``whole`` names the tables whose rows go with any tombstone; those of the others go only with
    one that says so, so that a file can be noted anew while what was made of it stays.
    """

    def __init__(
        self, spark: SparkSession, folder: str, tables: dict[str, Order], key: str = "file_id", whole: tuple[str, ...] = (),
        derived: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] | None = None, state: State | None = None,
    ):
        self.spark, self.folder, self.tables, self.key, self.whole = spark, folder.rstrip("/"), tables, key, whole
        self.derived, self.state = derived or {}, state or State()
        self.numbered = {base for base, _ in self.derived.values()}

    def _path(self, table: str, seq: int) -> str:
        return f"{self.folder}/{table}/{SEQ}={seq}"

    def _gone(self, table: str, before: int | None = None) -> DataFrame | None:
        """(_key, _gone): of each file that is hidden in this table the last tombstone."""
        if not self.state.gone:
            return None
        found = self.spark.read.schema(f"`{self.key}` string, whole boolean, {SEQ} long").option("basePath", f"{self.folder}/gone").parquet(*[self._path("gone", s) for s in self.state.gone])
        found = found if table in self.whole else found.where("whole")
        return found.groupBy(F.col(self.key).alias("_key")).agg(F.max(SEQ).alias("_gone"))

    def read(self, table: str, segments: list[int] | None = None, numbers: bool = False) -> DataFrame:
        """The rows of a table that nothing hides, of all segments or of some.  With numbers, ``seq`` and ``number`` come too; those
        of a derived table speak of rows that may be hidden."""
        schema = T.StructType.fromJson(self.state.schemas[table])
        names = [s for s in (self.state.segments if segments is None else segments) if self.state.segments[s][table]]
        fields = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])
        if names:
            rows = self.spark.read.schema(fields).option("basePath", f"{self.folder}/{table}").parquet(*[self._path(table, s) for s in names])
        else:
            rows = self.spark.createDataFrame([], fields)
        gone = None if table in self.derived else self._gone(table)
        if gone is not None:
            rows = rows.join(gone, (F.col(self.key) == F.col("_key")) & (F.col(SEQ) < F.col("_gone")), "left_anti")
        return rows if numbers else rows.drop(SEQ, *([NUMBER] if table in self.numbered else []))

    def _write(self, table: str, rows: DataFrame, seq: int) -> DataFrame:
        """Write a table of a segment in its order: a sorted file's row groups tell by their smallest and largest values
        whether they can hold a value."""
        rows = self.tables[table].ordered(rows)
        rows = rows.withColumn(NUMBER, F.monotonically_increasing_id()) if table in self.numbered else rows
        with few_at_a_time(self.spark):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(self._path(table, seq))
        return self.spark.read.schema(rows.schema).parquet(self._path(table, seq))

    def _segment(self, seq: int, rows: dict[str, DataFrame], state: State) -> None:
        """Write a segment of these tables and what is derived from them into the state."""
        made: dict[str, DataFrame] = {}
        for table in self.tables:
            if table in self.derived:
                base, how = self.derived[table]
                df = how(made[base]) if base in made else None
            else:
                df = rows.get(table)
            if df is None:
                continue
            made[table] = self._write(table, df, seq)
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in made[table].schema.fields])
            if table in state.schemas and T.StructType.fromJson(state.schemas[table]).simpleString() != schema.simpleString():
                raise ValueError(f"rows of {table} have other columns than the log")
            state.schemas[table] = schema.jsonValue()
        counts = {t: made[t].count() if t in made else 0 for t in self.tables}
        if any(counts.values()):
            state.segments[seq] = counts

    def append(self, rows: dict[str, DataFrame], gone: DataFrame | None = None, sums: dict[str, int] | None = None) -> Log:
        """The log with one segment more, and with (key, whole) of gone hidden before it; sums are added to its own."""
        seq, now = self.state.next, State.read(self.state.said())
        self._segment(seq, rows, now)
        if gone is not None:
            path = self._path("gone", seq)
            gone.select(F.col(self.key).cast("string").alias(self.key), F.col("whole").cast("boolean").alias("whole")).write.mode("overwrite").parquet(path)
            if self.spark.read.schema(f"`{self.key}` string, whole boolean").parquet(path).isEmpty():
                gone = None
        if gone is not None:
            now.gone.append(seq)
        for name, delta in (sums or {}).items():
            now.sums[name] = now.sums.get(name, 0) + delta
        now.next = seq + 1
        return self._with(now)

    def _with(self, state: State) -> Log:
        return Log(self.spark, self.folder, self.tables, self.key, self.whole, self.derived, state)

    def emptied(self) -> Log:
        """A log without rows that numbers its segments on from this one's."""
        return self._with(State(next=self.state.next))

    def size(self, seq: int) -> int:
        """The size class of a segment, by its largest table."""
        rows = max(self.state.segments[seq].values())
        return max(0, math.floor(math.log(max(1, rows / LEAST_ROWS), FAN_OUT)))

    def merged(self) -> Log:
        """The log with segments of one size class merged, as often as FAN_OUT of them stand together; tombstones older than
        all segments go."""
        log = self
        while True:
            classes: dict[int, list[int]] = {}
            for seq in sorted(log.state.segments):
                classes.setdefault(log.size(seq), []).append(seq)
            full = [c for c in sorted(classes) if len(classes[c]) >= FAN_OUT]
            if not full:
                return log
            log = log._merge(classes[full[0]])

    def _merge(self, segments: list[int]) -> Log:
        seq, now = self.state.next, State.read(self.state.said())
        self._segment(seq, {t: self.read(t, segments) for t in self.tables if t not in self.derived and t in now.schemas}, now)
        for s in segments:
            del now.segments[s]
        now.gone = [g for g in now.gone if any(s < g for s in now.segments)]
        now.next = seq + 1
        return self._with(now)

    def parts(self) -> set[tuple[str, int]]:
        """(table, number) of all folders that the log is made of."""
        return {(t, s) for s, rows in self.state.segments.items() for t in rows} | {("gone", s) for s in self.state.gone}
