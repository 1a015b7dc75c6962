"""The index as tables: identity, the difference of two states, snapshots and their counters."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_id
from .segments import SEQ, Log, Order, State

VERSION = 3
#: Seconds after which a writer's lock is taken for that of a writer that has died.
LEASE = 6 * 3600


def entity_id(file_id, index):
    return hash_id(file_id, index.cast("string"))


def diff(scanned: DataFrame, stored: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """(file_id, path, state) of every file on either side: added, pending, unchanged, modified, deleted or kept.

    One full outer join on the file's id.  A stored file without index time is pending; equal size and time with a known
    hash, or else equal size and hash, is unchanged.  What lies below an unreadable folder is kept, not deleted.
    """
    s = scanned.select("file_id", F.col("path").alias("s_path"), F.col("size_bytes").alias("s_size"), F.col("last_modified").alias("s_time"), F.col("content_hash").alias("s_hash"))
    t = stored.select("file_id", F.col("path").alias("t_path"), F.col("size_bytes").alias("t_size"), F.col("last_modified").alias("t_time"), F.col("content_hash").alias("t_hash"), "indexed_time")
    both = s.join(t, "file_id", "full_outer")
    same_time = (F.col("s_size") == F.col("t_size")) & (F.col("s_time") == F.col("t_time")) & F.col("t_hash").isNotNull()
    same_hash = (F.col("s_size") == F.col("t_size")) & (F.col("s_hash") == F.col("t_hash"))
    below = F.lit(False)
    for folder in protected or []:
        below = below | (F.col("t_path") == folder) | F.col("t_path").startswith(folder.rstrip("/") + "/")
    state = (
        F.when(F.col("s_path").isNull(), F.when(below, "kept").otherwise("deleted"))
        .when(F.col("t_path").isNull(), "added")
        .when(F.col("indexed_time").isNull(), "pending")
        .when(F.coalesce(same_time, F.lit(False)) | F.coalesce(same_hash, F.lit(False)), "unchanged")
        .otherwise("modified")
    )
    return both.select("file_id", F.coalesce("s_path", "t_path").alias("path"), state.alias("state"))


def status(files: DataFrame) -> DataFrame:
    """One row of counters of a files table with indexed_time, error and entity_count."""
    done = F.col("indexed_time").isNotNull() & F.col("error").isNull()
    return files.agg(
        F.count("*").alias("total"), F.sum(done.cast("long")).alias("indexed"), F.sum(F.col("indexed_time").isNull().cast("long")).alias("pending"),
        F.sum(F.col("error").isNotNull().cast("long")).alias("failed"), F.sum("entity_count").alias("entities"),
    )


def public_entities(entities: DataFrame) -> DataFrame:
    """(file_id, entities, valid): entities that are ranked, and whether every group has exactly one major member."""
    major = F.col("group").isNull() | (F.col("group") == F.col("id"))
    per = entities.groupBy("file_id", "group").agg(F.sum(major.cast("long")).alias("majors"), F.count("*").alias("n"))
    good = F.col("group").isNull() | (F.col("majors") == 1)
    return per.groupBy("file_id").agg(F.sum("majors").alias("entities"), F.min(good.cast("int")).cast("boolean").alias("valid"))


def replaced(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The entities of the next snapshot: old ones of files that didn't change, and new ones."""
    return old.join(changed.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def mark_failed(files: DataFrame, failed: DataFrame) -> DataFrame:
    """files with the errors of failed (file_id, failure, size_bytes, last_modified); the hash stays only if neither size
    nor time changed."""
    f = failed.select("file_id", "failure", F.col("size_bytes").alias("_s"), F.col("last_modified").alias("_t"))
    joined = files.join(f, "file_id", "left")
    same = (F.col("size_bytes") == F.col("_s")) & (F.col("last_modified") == F.col("_t"))
    kept = F.when(F.col("failure").isNull() | same, F.col("content_hash"))
    out = joined.withColumn("content_hash", kept).withColumn("error", F.coalesce("failure", "error"))
    return out.withColumn("entity_count", F.when(F.col("failure").isNull(), F.col("entity_count")).otherwise(0)).drop("failure", "_s", "_t")


class Writer:
    """What writes a snapshot: tables of its own, some of them only until it is named, and the log that it ends with."""

    def __init__(self, snapshots: Snapshots, name: str, log: Log):
        self.snapshots, self.name, self.log, self.scratch = snapshots, name, log, []

    def __call__(self, table: str, df: DataFrame, scratch: bool = False) -> DataFrame:
        path = f"{self.snapshots.folder}/{self.name}/{table}"
        df.write.parquet(path)
        self.scratch += [table] if scratch else []
        return self.snapshots.spark.read.schema(df.schema).parquet(path)


class Snapshots:
    """Versions of the index's tables below one folder, and a manifest that names the one to read.

    A version is written whole and only then named, by an atomic rename in the folder's own file system, so readers see
    one version or the next; a fresh build that breaks off is never named.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Order] | None = None, whole: tuple[str, ...] = (), derived: dict | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Tables that are kept as one log of segments, with their order.
        self.tables, self.whole, self.derived = tables or {}, whole, derived

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _rename(self, name: str, to: str) -> None:
        """Rename within the folder, over what has that name."""
        spark, path = self.spark, self._fs.makeQualified(self._path(name))
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context.rename(path, self._fs.makeQualified(self._path(to)), how)

    @property
    def manifest(self) -> dict | None:
        """What names the version to read; one that can't be read is put aside."""
        if not self._fs.exists(self._path("manifest.json")):
            return None
        stream = self._fs.open(self._path("manifest.json"))
        data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        try:
            return json.loads(data)
        except ValueError:
            self._rename("manifest.json", f"manifest.json.corrupt.{uuid.uuid4().hex[:8]}")
            return None

    def read(self, table: str, numbers: bool = False) -> DataFrame:
        manifest = self.manifest
        if not manifest or manifest["version"] != VERSION:
            raise ValueError("there is no index of this version")
        if table in self.tables and manifest.get("log"):
            return self.log(manifest).read(table, numbers=numbers)
        return self.spark.read.parquet(f"{self.folder}/{manifest['snapshot']}/{table}")

    def log(self, manifest: dict | None = None) -> Log:
        """The log of the manifest's tables, or an empty one."""
        state = State.read((manifest or {}).get("log"))
        return Log(self.spark, f"{self.folder}/segments", self.tables, whole=self.whole, derived=self.derived, state=state)

    def write(self, fingerprint: dict, replace_fingerprint: bool = False, **tables: DataFrame) -> str:
        """Write a snapshot of these tables; the fingerprint of model and tokenizer has to be that of the manifest, or to
        replace it."""
        with self.writing(fingerprint, replace_fingerprint) as put:
            for table, df in tables.items():
                put(table, df)
        return self.manifest["snapshot"]

    def _locked(self) -> None:
        """Take the lock; one that is older than LEASE is a dead writer's and is taken over."""
        lock = self._path("lock")
        self._fs.mkdirs(self._path())
        for again in (False, True):
            try:
                self._fs.create(lock, False).close()  # fails if there is one
                return
            except Exception as error:
                if again or not self._fs.exists(lock) or self._age(lock) < LEASE:
                    raise ValueError(f"another writer has {self.folder}/lock") from error
                # Of several that find the lock too old, one alone can put it aside.
                self._rename("lock", f"lock.old.{uuid.uuid4().hex[:8]}")

    def _age(self, path) -> float:
        return time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000

    @contextmanager
    def writing(self, fingerprint: dict, replace_fingerprint: bool = False) -> Iterator[Writer]:
        """The next snapshot, one writer at a time: ``put(table, df)`` writes a table and gives it back as written.

        The snapshot is named when the block ends without an error, with the log that the writer has then; the one before it
        stays for its readers, and older ones, what a broken writer left and the writer's scratch tables are removed.
        """
        self._locked()
        name = f"snapshot-{uuid.uuid4().hex}"
        try:
            manifest = self.manifest
            if manifest and manifest["version"] != VERSION:
                manifest = None
            if manifest and manifest["fingerprint"] != fingerprint and not replace_fingerprint:
                raise ValueError("the index was made with another model")
            writer = Writer(self, name, self.log(manifest))
            yield writer
            said = {"version": VERSION, "snapshot": name, "fingerprint": fingerprint} | ({"log": writer.log.state.said()} if self.tables else {})
            stream = self._fs.create(self._path("manifest.tmp"), True)
            stream.write(bytearray(json.dumps(said).encode()))
            stream.hsync()
            stream.close()
            self._rename("manifest.tmp", "manifest.json")
            self._clean({name, manifest["snapshot"] if manifest else name}, writer.log.parts() | self.log(manifest).parts())
            for table in writer.scratch:
                self._fs.delete(self._path(f"{name}/{table}"), True)
        finally:
            self._fs.delete(self._path("lock"), False)

    def _clean(self, snapshots: set[str], parts: set[tuple[str, int]]) -> None:
        """Remove snapshots and segments but these, and locks that were put aside."""
        for one in self._fs.listStatus(self._path()):
            name = one.getPath().getName()
            if name.startswith("snapshot-") and name not in snapshots or name.startswith("lock.old."):
                self._fs.delete(one.getPath(), True)
        if self._fs.exists(self._path("segments")):
            for table in self._fs.listStatus(self._path("segments")):
                for one in self._fs.listStatus(table.getPath()):
                    if (table.getPath().getName(), int(one.getPath().getName().removeprefix(f"{SEQ}="))) not in parts:
                        self._fs.delete(one.getPath(), True)

    def drop(self) -> bool:
        """Remove all versions; whether there were any."""
        return self._fs.delete(self._path(), True)
