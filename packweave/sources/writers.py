"""Sinks. A rerun replaces what it writes, but for ``log_results``, which appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import result_log


def split_by_subset(docs: DataFrame, path: str, keys: list[str] | None = None, form: str = "json") -> None:
    """Directories by subset (and chunk, or shard). Only the partitions that ``docs`` has are replaced."""
    writer = docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(keys or ["subset"]))
    writer.format(form).save(path)


def evaluation_split(docs: DataFrame, path: str) -> None:
    """Validation and test documents: text only, by subset."""
    split_by_subset(docs.select("subset", "text"), path)


def tokenized(docs: DataFrame, path: str) -> None:
    """Tokenized documents before they are numbered: contents and ids only, by subset."""
    split_by_subset(docs.select("subset", "contents", "token"), path)


def shards(docs: DataFrame, path: str) -> None:
    """Tokenized shards by subset and split, lines in the order of ``internal_idx``."""
    rows = docs.select("subset", "split", "contents", "token", "internal_idx").repartition("subset", "split").sortWithinPartitions("subset", "split", "internal_idx")
    split_by_subset(rows, path, ["subset", "split"])


def batches(rows: DataFrame, path: str) -> None:
    """Packed sequences (dir_idx, batch_idx, pos_in_batch, input_ids), a directory per ``dir_idx``."""
    kept = rows.select("dir_idx", "batch_idx", "pos_in_batch", "input_ids").repartition("dir_idx", "batch_idx").sortWithinPartitions("batch_idx", "pos_in_batch")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dir_idx").parquet(path)


def log_results(results: DataFrame, path: str) -> None:
    """Append one JSON line per result."""
    result_log(results).withColumnRenamed("line", "value").coalesce(1).write.mode("append").text(path)


def distraction_table(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)
