"""Burstiness of packed sequences and distraction of attention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EOS_ID
from ..functions.tokens import id_counts
from ..functions.zeta import zipf_exponent, zipf_grid_exponent


def token_histogram(chunks: DataFrame, unit: list[str]) -> DataFrame:
    """Count of each token id per unit. A unit is one row, so its ids are counted where they are, without a shuffle."""
    counted = chunks.select(*unit, id_counts("input_ids").alias("_c"))
    return counted.select(*unit, F.explode("_c").alias("_x")).select(*unit, "_x.token", "_x.cnt")


def zipf_statistics(chunks: DataFrame, unit: list[str]) -> DataFrame:
    """Per unit (a row): number of different tokens and sum of the logarithms of their counts, all that the fit needs."""
    counted = chunks.where(F.size("input_ids") > 0).select(*unit, id_counts("input_ids").alias("_c"))
    exact = "decimal(38,12)"
    total = F.aggregate("_c", F.lit(0).cast(exact), lambda a, x: (a + F.log(x["cnt"]).cast("decimal(28,12)")).cast(exact))
    return counted.select(*unit, F.size("_c").cast("bigint").alias("n"), total.cast("double").alias("log_sum"))


def zipf_grid(stats: DataFrame, unit: list[str]) -> DataFrame:
    """Exponent per unit, to two decimals: the grid point of least cost."""
    return stats.select(*unit, zipf_grid_exponent(F.col("n").cast("double"), F.col("log_sum")).alias("exponent"))


def zipf_refined(stats: DataFrame, unit: list[str]) -> DataFrame:
    return stats.select(*unit, F.round(zipf_exponent(F.col("n").cast("double"), F.col("log_sum")), 3).alias("exponent"))


def fragments(chunks: DataFrame) -> DataFrame:
    """One row per fragment of each sequence (end mark included): ``fragment`` and its ``input_ids``."""
    ids = F.col("input_ids")
    ends = F.filter(F.sequence(F.lit(1), F.size(ids)), lambda i: F.element_at(ids, i) == EOS_ID)
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(ids))))
    spans = F.transform(F.slice(bounds, 2, F.size(bounds) - 1), lambda b, i: F.struct((F.element_at(bounds, i + 1) + 1).alias("s"), (b - F.element_at(bounds, i + 1)).alias("n")))
    rows = chunks.select("*", F.posexplode(spans).alias("fragment", "_f"))
    return rows.withColumn("input_ids", F.slice("input_ids", F.col("_f.s"), F.col("_f.n"))).drop("_f")


def skip_take(chunks: DataFrame, pos: Column, skip: int, most: int) -> DataFrame:
    """Rows at positions skip .. skip + most (one more than ``most``, as the stop test follows the count)."""
    return chunks.where((pos >= skip) & (pos < skip + most + 1))


def attention_means(attention: DataFrame) -> DataFrame:
    """Mean over heads: (example, layer, head, q, k, weight) to (example, layer, q, k, weight)."""
    return attention.groupBy("example", "layer", "q", "k").agg(F.avg("weight").alias("weight"))


def distraction(attention: DataFrame, doc1_len: int) -> DataFrame:
    """Share of attention that each query of the second document gives to the first, per (example, layer)."""
    mass = F.when((F.col("q") >= doc1_len) & (F.col("k") < doc1_len), F.col("weight")).otherwise(0.0)
    return attention.groupBy("example", "layer").agg(F.sum(mass).alias("distraction"))


def batch_statistics(values: DataFrame, keys: list[str], batch: str, value: str) -> DataFrame:
    """Per batch: count, mean and sample deviation."""
    return values.groupBy(*keys, batch).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def pooled(batches: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """Mean and deviation over all batches from those of each. Exact: population deviation of all values.
    ``compat`` feeds the sample variances into the population formula, as the original does."""
    n, u = F.col("n"), F.col("mean")
    v = F.coalesce(F.col("std") * F.col("std"), F.lit(0.0))
    v = v if compat else v * (n - 1) / n
    mean = F.sum(n * u) / F.sum(n)
    return batches.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(n * (v + u * u)) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std"), F.sum("n").alias("n"))


def layer_weighted(values: DataFrame, keys: list[str], layer: str, value: str, layers: int) -> DataFrame:
    """Mean over layers with weight 1 / (layers - layer): the last layer counts most."""
    w = 1 / (layers - F.col(layer))
    return values.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("weighted"))


def uniform_baseline(doc1_len: Column, x: Column) -> Column:
    """Share of the first document if attention were even over all places so far."""
    return doc1_len / (doc1_len + x)


PAIRS = "stream string, pair_no long, input_ids array<int>"


def document_pairs(docs: DataFrame, doc1_len: int, doc2_len: int, separator: list[int], most: int | None = None) -> DataFrame:
    """Pairs for the attention analysis. ``docs``: stream, ord, token. Documents are laid together, each with the
    separator, until ``doc1_len`` ids, of which the last ``doc1_len`` stay; the next document that with the separator
    has more than ``doc2_len`` ids gives its first ``doc2_len``. Streams are independent; only one document and the
    growing pair are held. A stream is read once, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sep = np.array(separator, np.int64)
        stream, head, ready, made = None, np.zeros(0, np.int64), False, 0
        for batch in batches:
            out = []
            for s, token in zip(batch["stream"], batch["token"], strict=True):
                if s != stream:
                    stream, head, ready, made = s, np.zeros(0, np.int64), False, 0
                if most is not None and made >= most:
                    continue
                ids = np.concatenate([np.asarray(token if token is not None else [], np.int64), sep])
                if not ready:
                    head = np.concatenate([head, ids])
                    ready = len(head) >= doc1_len
                elif len(ids) >= doc2_len + 1:
                    out.append((s, made, np.concatenate([head[-doc1_len:], ids[:doc2_len]]).astype("int32")))
                    head, ready, made = np.zeros(0, np.int64), False, made + 1
            yield pd.DataFrame(out, columns=["stream", "pair_no", "input_ids"])

    return docs.select("stream", "ord", "token").repartition("stream").sortWithinPartitions("stream", "ord").mapInPandas(run, PAIRS)


def document_pairs_of_two(first: DataFrame, docs: DataFrame, doc1_len: int, doc2_len: int, separator: list[int], most: int | None = None) -> DataFrame:
    """Pairs whose first document comes from another table: the k-th group of ``first`` (stream, ord, token) that reaches
    ``doc1_len`` ids, its last ``doc1_len`` kept, before the first ``doc2_len`` ids of the k-th document of ``docs`` that
    with the separator has more than that. Streams are independent; pairs end with the shorter side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sep = np.array(separator, np.int64)
        stream, head, made = None, np.zeros(0, np.int64), 0
        for batch in batches:
            out = []
            for s, token in zip(batch["stream"], batch["token"], strict=True):
                if s != stream:
                    stream, head, made = s, np.zeros(0, np.int64), 0
                head = np.concatenate([head, np.asarray(token if token is not None else [], np.int64), sep])
                if len(head) >= doc1_len:
                    out.append((s, made, head[-doc1_len:].astype("int32")))
                    head, made = np.zeros(0, np.int64), made + 1
            yield pd.DataFrame(out, columns=["stream", "pair_no", "input_ids"])

    heads = first.select("stream", "ord", "token").repartition("stream").sortWithinPartitions("stream", "ord").mapInPandas(run, PAIRS)
    ids = F.concat(F.coalesce("token", F.array().cast("array<int>")), F.array(*[F.lit(x) for x in separator]))
    long = docs.select("stream", "ord", ids.alias("_ids")).where(F.size("_ids") >= doc2_len + 1)
    place = F.row_number().over(Window.partitionBy("stream").orderBy("ord")) - 1
    seconds = long.select("stream", place.cast("bigint").alias("pair_no"), F.slice("_ids", 1, doc2_len).alias("_second"))
    pairs = heads.join(seconds, ["stream", "pair_no"])
    pairs = pairs if most is None else pairs.where(F.col("pair_no") < most)
    return pairs.select("stream", "pair_no", F.concat("input_ids", "_second").alias("input_ids"))
