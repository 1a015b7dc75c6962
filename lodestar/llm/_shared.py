"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch at most, so that a batch of long texts stays far below a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a session that runs on this machine alone may name none, as in
    tests: it gets a fresh local one, removed when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    written().append(path)
    return path


_OWN = threading.local()


def written() -> list[str]:
    """What ``fresh_path`` gave to this thread, in order, until ``forget`` takes it away."""
    if not hasattr(_OWN, "paths"):
        _OWN.paths = []
    return _OWN.paths


def forget(spark: SparkSession, first: int, last: int | None = None) -> None:
    """Remove tables from the shared folder, by their places among this thread's, that nothing reads any more."""
    for path in written()[first:last]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del written()[first:last]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df with its lineage cut: written once, as a table in the shared folder, and read from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened until none is one of the columns, upper and lower case being alike."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, nulls told from other values: rows that agree in both are taken to be equal."""
    values = []
    for field in df.schema.fields:
        c = named(field.name)
        plain = field.dataType.simpleString()
        values += [F.to_json(F.struct(c)) if "map<" in plain or "variant" in plain else c, c.isNull()]
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def rows_but(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of df without those that gone (k1, k2, one) names by their keys; where one is true, a single one of such
    equal rows stays.

    df is dealt by its keys whatever the size of gone is, so that the plan is the same for small and large tables; rows
    that came several times, which are few as a rule, are a table of their own and have a size that Spark knows.
    """
    k1, k2 = free_names(df.columns, "k1", "k2")
    a, b = row_keys(df)
    keyed = df.withColumn(k1, a).withColumn(k2, b)
    gone = gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "one")
    once = keyed.join(cut(gone.where("one").drop("one"), "once"), [k1, k2], "left_semi").dropDuplicates([k1, k2])
    stay = keyed.join(gone.drop("one").hint("merge"), [k1, k2], "left_anti")
    return stay.unionByName(once).select(*[named(c) for c in df.columns])


def rows_times(df: DataFrame, chosen: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """The rows of df that chosen (keys, n, times) names by their keys; n says how often df has such a row, and times how
    often all of them together come out.

    Rows that stand alone pass one join; only of equal rows that came several times one is picked before.
    """
    k1, k2, times = free_names(df.columns, "k1", "k2", "times")
    a, b = row_keys(df)
    keyed = df.withColumn(k1, a).withColumn(k2, b)
    said = chosen.select(F.col(keys[0]).alias(k1), F.col(keys[1]).alias(k2), F.col("times").cast("int").alias(times), "n")
    several = said.where("n > 1").drop("n")
    once = keyed.join(several.select(k1, k2), [k1, k2], "left_semi").dropDuplicates([k1, k2])
    out = keyed.join(said.where("n = 1").drop("n"), [k1, k2]).unionByName(once.join(several, [k1, k2]))
    columns = [named(c) for c in df.columns]
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).select(*columns)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes.split cuts at exactly the characters that WORD excludes."""
    return text.encode("utf-8").split() if text else []


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of a batch of texts: (offsets of the texts, code of every word, distinct words by code).

    Arrow splits and encodes; ASCII white space is what WORD excludes.  A null text has no words.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    coded = split.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    words = coded.dictionary
    empty = words.index(pa.scalar("", pa.string())).as_py() if len(words) else -1
    if empty >= 0:  # before a leading or after a trailing space
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return offsets, codes, words


def word_count(text: Column | str) -> Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(value: object) -> int:
    """crc32 of an id written as text; of a null id, that of the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def id_crc(column: str) -> Column:
    return F.crc32(F.coalesce(named(column).cast("string"), F.lit("")).cast("binary"))
