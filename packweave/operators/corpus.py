"""Shaping a corpus: subsets, token budgets, shards and row numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import hash_tokens, order_key
from ..session import small
from .ordering import running, running_min_before


def subset_index(source: Column, n_subsets: int = 7) -> Column:
    """The subset number of a source written ``src<n>``; null if it isn't."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"^src(\d{1,18})$", 1)
    return F.when(number != "", (number.cast("bigint") % n_subsets).cast("int"))


def with_subset(docs: DataFrame, config: DataFrame, n_subsets: int = 7) -> DataFrame:
    """Add ``subset`` by source number. Rows of no configured subset are left out (the membership rule of training data)."""
    names = config.select(F.col("subset_idx").alias("_i"), F.col("subset").alias("_n"))
    numbered = docs.drop("subset").withColumn("_idx", subset_index(F.col("source"), n_subsets))
    return numbered.join(small(names), F.col("_idx") == F.col("_i")).drop("_idx", "_i").withColumnRenamed("_n", "subset")


def require_members(docs: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``docs`` unchanged; the job fails if a value of ``column`` is null or not among ``names``."""
    bad = F.col(column).isNull() | ~F.col(column).isin(names)
    return docs.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit("unknown subset: "), F.coalesce(F.col(column), F.lit("null"))))).otherwise(F.col(column)))


def tokenized(docs: DataFrame, tokenizer: Callable[[Column], Column] = hash_tokens) -> DataFrame:
    """Add ``token`` by ``tokenizer``, a function from text to ids such as ``readers.sentence_pieces`` makes; by default
    the word-hash tokenizer."""
    return docs.withColumn("token", tokenizer(F.col("text")))


def budget_sample(docs: DataFrame, config: DataFrame, total: int, seed: int, chunks: int = 10) -> DataFrame:
    """Per (subset, chunk_cid), keep documents in fixed order until the token target is reached; the one that crosses it stays.

    ``docs``: doc_id, subset, chunk_cid, n_tokens. The target is floor(weight * total / chunks).
    """
    target = config.select(F.col("subset").alias("_n"), F.floor(F.col("weight") * total / chunks).cast("bigint").alias("target"))
    keyed = docs.withColumn("_key", order_key(seed, F.col("doc_id")))
    run = running(keyed, ["subset", "chunk_cid"], ["_key", "doc_id"], F.col("n_tokens"))
    kept = run.join(small(target), F.col("subset") == F.col("_n")).where((F.col("run_pos") == 0) | (F.col("run_before") < F.col("target")))
    return kept.drop("_n", "_key")


def assign_shards(docs: DataFrame, config: DataFrame, total: int, seed: int, max_splits: int | None = None) -> DataFrame:
    """Token-balanced shards of each subset, in fixed order: adds ``split`` and ``internal_idx``.

    A document goes on the next shard once the running sum passes another multiple of ceil(target / n_splits); a
    document that passes several moves on by one shard only. Documents behind the subset's target are left out.
    """
    splits = F.least("n_splits", F.lit(max_splits)) if max_splits else F.col("n_splits")
    plan = config.select(
        F.col("subset").alias("_n"), F.floor(F.col("weight") * total).cast("bigint").alias("_target"),
        F.ceil(F.floor(F.col("weight") * total) / splits).cast("bigint").alias("_each"),
    )
    keyed = docs.withColumn("_key", order_key(seed, F.col("doc_id")))
    run = running(keyed, ["subset"], ["_key", "doc_id"], F.col("n_tokens"))
    kept = run.join(small(plan), F.col("subset") == F.col("_n")).where((F.col("run_pos") == 0) | (F.col("run_before") <= F.col("_target")))
    over = F.greatest(F.lit(0), F.ceil((F.col("run_before") + F.coalesce("n_tokens", F.lit(0))) / F.col("_each")) - 1)
    kept = kept.withColumn("_lead", (over - F.col("run_pos")).cast("bigint"))
    kept = running_min_before(kept, ["subset"], "run_pos", "_lead", "_least")
    j = F.col("run_pos")
    split = F.when(j == 0, 0).otherwise(F.least(j, j - 1 + F.col("_least"))).cast("int")
    numbered = kept.withColumn("split", split).drop("_n", "_key", "_target", "_each", "_lead", "_least")
    # a shard's documents follow each other, so its first place is all it takes to number them: one row per shard
    first = numbered.groupBy(F.col("subset").alias("_s"), F.col("split").alias("_p")).agg(F.min("run_pos").alias("_first"))
    placed = numbered.join(small(first), F.col("subset").eqNullSafe(F.col("_s")) & (F.col("split") == F.col("_p")))
    return placed.withColumn("internal_idx", (F.col("run_pos") - F.col("_first")).cast("bigint")).drop("_s", "_p", "_first")


def latest_delivery(processed: DataFrame) -> DataFrame:
    """One row per (subset, split, internal_idx): the delivery written last; of equal times the highest row_id.

    The choice is made on ids and times; rows delivered again later, of which there are few, are then left out.
    """
    keep = ["subset", "split", "internal_idx"]
    at = F.coalesce("written_at", F.lit("1900-01-01").cast("timestamp"))
    newest = Window.partitionBy(*keep).orderBy(at.desc(), F.col("row_id").desc())
    slim = processed.select(*keep, "written_at", "row_id").withColumn("_r", F.row_number().over(newest))
    late = slim.where("_r > 1").select(F.col("row_id").alias("_late"))
    kept = processed.join(late, F.col("row_id") == F.col("_late"), "left_anti")
    return kept.select(*keep, *[c for c in processed.columns if c not in keep])


#: Lines whose offsets are added up together.
LINE_BLOCK = 1 << 16


def line_offsets(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Byte offset (keys, order, ``byte_offset``) of each line, were the rows of ``keys`` lines of one file in the order
    of the whole number ``order``; null text is an empty line. Only sizes are ordered and added up, in blocks of lines."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    slim = rows.select(*keys, order, size.cast("bigint").alias("_size"))
    run = running(slim, keys, [order], F.col("_size"), prefix="line", bucket=F.floor(F.col(order) / LINE_BLOCK))
    return run.select(*keys, order, F.col("line_before").alias("byte_offset"))


def renumbered(rows: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Add ``out``: gapless numbers within ``keys`` in the order of the whole number ``order``, in blocks of rows."""
    run = running(rows, keys, [order], F.lit(0), prefix="line", bucket=F.floor(F.col(order) / LINE_BLOCK))
    return run.withColumnRenamed("line_pos", out).drop("line_before")


def file_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: lines and the global numbers [first, behind) of its rows, files in the order of ``keys``."""
    every = Window.partitionBy(F.lit(0)).orderBy(*keys)  # one row per file
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))
    behind = F.sum("lines").over(every.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("behind", behind).withColumn("first", F.col("behind") - F.col("lines"))


def locate(numbers: DataFrame, ranges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """File and line of each global row number ``idx``, by the range it falls in; numbers outside have no row.

    Ranges are laid out over blocks of numbers, so the range condition is only tried within an equal block.
    """
    spread = ranges.where("behind > first").withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("behind") - 1) / block))))
    asked = numbers.withColumn("_a", F.floor(F.col("idx") / block))
    joined = asked.join(small(spread), (F.col("_a") == F.col("_b")) & (F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("behind")))
    return joined.withColumn("line", F.col("idx") - F.col("first")).drop("first", "behind", "lines", "_a", "_b")


def id_continuity(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Per file: least and greatest id, and whether it begins where the file before ended (0 for the first)."""
    every = Window.partitionBy(F.lit(0)).orderBy(*keys)  # one row per file
    ends = rows.groupBy(*keys).agg(F.min(ident).alias("first_id"), F.max(ident).alias("last_id"))
    return ends.withColumn("continuous", F.col("first_id") == F.coalesce(F.lag("last_id").over(every), F.lit(-1)) + 1)
