"""Blend stored sequences of several subsets in a weighted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import order_key, round_half_even
from ..session import small
from .ordering import running


def quotas(config: DataFrame, n: int) -> DataFrame:
    """Requests per subset: weight * n + 1, rounded half to even."""
    return config.select("subset_idx", "subset", "weight", round_half_even(F.col("weight") * n + 1).alias("quota"))


def blend_order(config: DataFrame, n: int, seed: int) -> DataFrame:
    """The order of requests: ``pos`` 0..n-1 with ``subset`` and ``occ``, the how-manieth request of the subset it is."""
    rows = quotas(config, n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)))
    rows = rows.withColumn("_key", order_key(seed, F.col("subset_idx"), F.col("k"))).withColumn("_tie", F.col("subset_idx") * F.lit(1 << 40) + F.col("k"))
    cut = running(rows, [], ["_key", "_tie"], F.lit(0)).where(F.col("run_pos") < n)
    cut = cut.withColumnRenamed("run_pos", "pos").drop("run_before")
    occ = running(cut.withColumn("_pk", F.lpad(F.hex("pos"), 16, "0")), ["subset"], ["_pk"], F.lit(0), digits=13, prefix="occ")
    return occ.select("pos", "subset_idx", "subset", F.col("occ_pos").alias("occ"))


def blend(order: DataFrame, chunks: DataFrame, workers: int = 1, strict: bool = False) -> DataFrame:
    """Sequences in the blended order; it ends (per worker) at the first request whose subset has none left.

    ``chunks``: subset, chunk_id (0-based per subset). ``strict``: the job fails instead of ending early.
    """
    have = chunks.select(F.col("subset").alias("_s"), F.col("chunk_id").alias("_c"), "input_ids")
    asked = order.withColumn("worker", F.pmod("pos", F.lit(workers)).cast("int"))
    got = asked.join(have, (F.col("subset") == F.col("_s")) & (F.col("occ") == F.col("_c")), "left")
    if strict:
        missing = F.when(F.col("_c").isNull(), F.raise_error(F.concat(F.lit("no sequence left in "), F.col("subset"))))
        return got.withColumn("pos", F.coalesce(missing, F.col("pos"))).drop("_s", "_c")
    ends = got.where("_c is null").groupBy("worker").agg(F.min("pos").alias("_end"))
    kept = got.join(small(ends), "worker", "left")  # a row per worker
    return kept.where(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).drop("_s", "_c", "_end")


def mix_report(blended: DataFrame, config: DataFrame) -> DataFrame:
    """Expected and obtained share of each subset; shares of nothing are 0."""
    counts = blended.groupBy(F.col("subset").alias("_s")).agg(F.count(F.lit(1)).alias("obtained"))
    every = Window.partitionBy(F.lit(0))  # one row per subset
    out = config.select("subset", "weight").join(small(counts), F.col("subset") == F.col("_s"), "left").drop("_s").fillna(0, ["obtained"])
    return out.withColumn("share", F.round(F.coalesce(F.try_divide("obtained", F.sum("obtained").over(every)), F.lit(0.0)), 6))
