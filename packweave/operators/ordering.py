"""Fixed orders, positions in them and running sums, without a window over all rows.

The order of a table is that of an md5 key. Its first hex digits cut the order into buckets of like size, as many as the
table's size asks for; totals per bucket (few rows) are summed up first, then each bucket's own rows. One partition never
holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import order_key
from ..session import estimated_bytes, small

#: There are 16 ** digits buckets per group, from LEAST_DIGITS to MOST_DIGITS, so that each has about BUCKET_BYTES.
LEAST_DIGITS, MOST_DIGITS = 2, 5
BUCKET_BYTES = 64 << 20


def bucket_digits(df: DataFrame) -> int:
    """Digits for buckets of about BUCKET_BYTES, by the optimiser's estimate; results don't depend on them."""
    size, digits = estimated_bytes(df), LEAST_DIGITS
    while digits < MOST_DIGITS and size > BUCKET_BYTES * 16**digits:
        digits += 1
    return digits


def running(
    df: DataFrame, keys: list[str], order: list[str], size: Column, digits: int | None = None, prefix: str = "run", bucket: Column | None = None
) -> DataFrame:
    """Add ``{prefix}_pos`` (0-based position) and ``{prefix}_before`` (sum of ``size`` over the rows before) within ``keys``.

    ``order[0]`` is a hex string such as ``order_key`` gives, or ``bucket`` tells the buckets in rising order; ties go by
    the other columns. Null sizes count 0.
    """
    b, n = f"_{prefix}_b", f"_{prefix}_n"
    bucket = F.substring(order[0], 1, digits or bucket_digits(df)) if bucket is None else bucket
    df = df.withColumn(b, bucket).withColumn(n, F.coalesce(size.cast("bigint"), F.lit(0)))
    # Both levels end up hash-partitioned; bucket totals are at most 16 ** digits rows per group.
    upto = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_c"), F.sum(n).alias("_s"))
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(b).alias("_kb"),
        F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    on = F.col(b) == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = df.withColumn("_rn", F.row_number().over(inside) - 1).withColumn("_in", F.coalesce(F.sum(n).over(before), F.lit(0)))
    return (
        numbered.join(small(starts), on)
        .withColumn(f"{prefix}_pos", (F.col("_c0") + F.col("_rn")).cast("bigint"))
        .withColumn(f"{prefix}_before", (F.col("_s0") + F.col("_in")).cast("bigint"))
        .drop(b, n, "_rn", "_in", "_kb", "_c0", "_s0", *[f"_k{i}" for i in range(len(keys))])
    )


def running_min_before(df: DataFrame, keys: list[str], pos: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add ``out``: the least ``value`` over the rows before in ``keys``, by the 0-based position ``pos``; null for the first."""
    df = df.withColumn("_blk", F.floor(F.col(pos) / block).cast("bigint"))
    upto = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    least = df.groupBy(*keys, "_blk").agg(F.min(value).alias("_m")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_kb"), F.min("_m").over(upto).alias("_m0")
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("_blk") == F.col("_kb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = df.withColumn("_in", F.min(value).over(inside)).join(small(least), on)
    return joined.withColumn(out, F.least("_in", "_m0")).drop("_blk", "_in", "_kb", "_m0", *[f"_k{i}" for i in range(len(keys))])


def shuffled(df: DataFrame, seed: int, key: str, digits: int | None = None) -> DataFrame:
    """Add ``pos``, the row's 0-based place in the fixed pseudo-random order of ``seed``."""
    keyed = df.withColumn("_key", order_key(seed, F.col(key)))
    out = running(keyed, [], ["_key", key], F.lit(0), digits, "shuffle")
    return out.withColumnRenamed("shuffle_pos", "pos").drop("shuffle_before", "_key")


def sample(df: DataFrame, seed: int, key: str, n: int, groups: list[str] | None = None) -> DataFrame:
    """``n`` rows without replacement (per group), the first in the fixed order of ``seed``; fewer if there are fewer."""
    keyed = df.withColumn("_key", order_key(seed, F.col(key)))
    if not groups:
        return keyed.orderBy("_key", key).limit(n).drop("_key")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_key", key))
    return keyed.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_key")


def strided(df: DataFrame, pos: str, workers: int) -> DataFrame:
    """Add ``worker`` and ``worker_pos``: row i goes to worker i % W as its (i div W)-th."""
    if workers < 1:
        raise ValueError("at least one worker is needed")
    return df.withColumn("worker", F.pmod(F.col(pos), F.lit(workers)).cast("int")).withColumn("worker_pos", F.floor(F.col(pos) / workers).cast("bigint"))
