"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent on a single machine, as in tests, a temporary one is made; on a
    cluster a folder of one machine would be of no use, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="deckframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that this process has written to the shared folder.
_written: list[str] = []


def written() -> int:
    """A mark for ``sweep``."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes the tables written after the mark, except those that ``keep`` reads.

    Call it when nothing but ``keep`` will be read again.
    """
    needed = keep.inputFiles()
    if not needed:
        return
    conf, paths = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _written[since:]:
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in needed):
            paths(path).getFileSystem(conf).delete(paths(path), True)
            _written.remove(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result is computed once, survives lost executors, is columnar, and has file sizes by
    which the optimiser decides whether a side is small enough to broadcast.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rest() -> None:
    """Gives Arrow's unused memory back; called at a task's end, as the Python process waits for the next one."""
    pa.default_memory_pool().release_unused()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` for ``body`` so that it is evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """array<string>: the words of a text that is not null."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    """long: the number of words, without building them (0 for null)."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit("x"))
    return F.length(F.translate(marks, SPACE, "")).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def same(a: Column, b: Column) -> Column:
    """Null-safe equality, which Spark still runs as an equi-join."""
    return a.eqNullSafe(b)
