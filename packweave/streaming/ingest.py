"""Structured Streaming forms of reading batches and of filling sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EOS_ID
from ..operators.packing import rechunk


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files that arrive in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_rechunk(chunks: DataFrame, length: int) -> DataFrame:
    """Stateless: cut arriving sequences into pieces of ``length``."""
    return rechunk(chunks, length)


FILLED = "stream string, chunk_no long, input_ids array<int>"


def stream_fill(docs: DataFrame, length: int) -> DataFrame:
    """Fill sequences of ``length`` from arriving documents (stream, ord, token), across triggers, per stream.

    The state of a stream is its open sequence, fewer than ``length`` ids. Within a trigger documents are taken in
    the order of ``ord``; over the same arrival order the result equals that of batch concatenation. Many short
    streams share the work; a busy stream should be divided by a salt in its name.
    """

    def fill(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        ids = np.concatenate([np.asarray(held, np.int64), *[np.append(np.asarray(t if t is not None else [], np.int64), EOS_ID) for t in rows["token"]]])
        full = len(ids) // length
        out = [(key[0], done + k, ids[k * length : (k + 1) * length].astype("int32")) for k in range(full)]
        state.update((done + full, ids[full * length :].astype(int).tolist()))
        yield pd.DataFrame(out, columns=["stream", "chunk_no", "input_ids"])

    return docs.select("stream", "ord", "token").groupBy("stream").applyInPandasWithState(
        fill, FILLED, "done long, held array<int>", "append", "NoTimeout"
    )


def stream_subset_counts(docs: DataFrame, event_time: str, delay: str = "7 days", window: str = "1 day") -> DataFrame:
    """Documents per subset and window of event time, late ones within ``delay`` included."""
    marked = docs.withWatermark(event_time, delay)
    return marked.groupBy(F.window(event_time, window), "subset").agg(F.count(F.lit(1)).alias("docs"))
