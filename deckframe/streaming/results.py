"""Results that still grow, as streams.

A solver appends files: numbered members of a state family, continuations of a time history, or
Parquet parts of a sink. A file is read once it is listed, so each is a unit of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from deckframe.sources.d3plot import EOF, Control


def new_states(spark: SparkSession, folder: str, pattern: str, control: Control, block: str) -> DataFrame:
    """A stream of file, state_in_file, time, entity, vars from family members as they appear.

    Members hold whole states only; the geometry is that of the base file, whose ``control`` is given.
    """
    at, n, k = control.layout[block]
    word, size = control.word, control.state_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in range(len(data) // size):
                    words = np.frombuffer(data[s * size : (s + 1) * size], f"<f{word}").astype(float)
                    if words[0] == EOF:
                        break
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(words[at : at + n * k]))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, s, np.int32)), pa.array(np.full(n, words[0])), pa.array(np.arange(n, dtype=np.int32)), lists], names=["file", "state", "time", "entity", "vars"])

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, state int, time double, entity int, vars array<double>")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows by type over a stream (ts, event_type, value), closed by a watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select(F.col("w.start").alias("start"), "event_type", "n", "peak")


def running_peaks(samples: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """The peak of every series so far, kept as state: one row a series for each micro-batch that touches it."""
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, peak = state.get if state.exists else (0, 0.0)
        for b in batches:
            n += len(b)
            peak = max(peak, float(b[value].abs().max()))
        state.update((n, peak))
        yield pd.DataFrame({key: [k[0]], "n": [n], "peak": [peak]})

    return samples.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} long, n long, peak double", "n long, peak double", "update", GroupStateTimeout.NoTimeout)
