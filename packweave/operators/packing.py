"""Fixed-length token sequences from documents, and the fragments within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BATCH_ROWS, BATCHES_PER_DIR, EOS_ID, IGNORE_ID, MAX_EOS, PAD_ID
from ..functions.tokens import eos_count, order_key, running_sums
from ..session import small
from .ordering import running, strided


def document_spans(docs: DataFrame, length: int, seed: int, keys: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """The part of each document in each sequence, were all documents (of ``keys``) laid end to end in fixed order.

    ``docs`` has ``key`` and ``token`` (with end marks). Adds ``chunk_id``, ``at`` (offset in the sequence) and
    ``piece``. Documents without tokens have no part. Only documents are exploded, never tokens. With a column
    ``n_tokens`` the pass that adds up sizes needn't make the tokens.
    """
    keys = keys or []
    size = F.col("n_tokens") if "n_tokens" in docs.columns else F.size("token")
    keyed = docs.where(size > 0).withColumn("_key", order_key(seed, F.col(key)))
    run = running(keyed, keys, ["_key", key], size)
    start, end = F.col("run_before"), F.col("run_before") + size
    parts = run.withColumn("chunk_id", F.explode(F.sequence(F.floor(start / length), F.floor((end - 1) / length))))
    c0 = F.col("chunk_id") * length
    lo, hi = F.greatest(start, c0), F.least(end, c0 + length)
    return parts.withColumn("at", (lo - c0).cast("int")).withColumn("piece", F.slice("token", (lo - start + 1).cast("int"), (hi - lo).cast("int"))).drop("_key", "run_pos", "run_before", "token", "n_tokens")


def concat_chunks(docs: DataFrame, length: int, seed: int, keys: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Full sequences of ``length`` ids, documents running on across their borders; the incomplete last one is left out.

    With ``keys``, each group is packed by itself. A sequence gathers at most ``length`` ids, so no group is large.
    """
    parts = document_spans(docs, length, seed, keys, key)
    gathered = parts.groupBy(*(keys or []), "chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_p"))
    chunks = gathered.withColumn("input_ids", F.flatten(F.transform("_p", lambda x: x["piece"]))).drop("_p")
    return chunks.where(F.size("input_ids") == length)


def full_chunks(sizes: DataFrame, length: int) -> DataFrame:
    """One row: ``n_chunks``, the number of full sequences that ``concat_chunks`` makes of documents of ``n_tokens``."""
    return sizes.agg(F.floor(F.coalesce(F.sum("n_tokens"), F.lit(0)) / length).cast("bigint").alias("n_chunks"))


def worker_items(chunks: DataFrame, pos: str, workers: int, most: int = MAX_EOS) -> DataFrame:
    """Stored sequences as workers read them: sequence i (by ``pos``, over all of them) is worker i % W's; those with
    more than ``most`` end marks are passed over, which leaves the others' numbers and workers as they are."""
    return few_fragments(strided(chunks, pos, workers), most)


def pad_chunks(docs: DataFrame, length: int, pad: int = PAD_ID, ignore: int = IGNORE_ID) -> DataFrame:
    """Sequences of single documents: full pieces, then the rest padded; a rest of one id is dropped.

    ``labels`` equal the ids, with ``ignore`` in place of padding. Adds ``piece_no``.
    """
    n = F.size("token")
    pieces = docs.where(n > 0).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / length).cast("int"))))
    ids = F.slice("token", F.col("piece_no") * length + 1, F.lit(length))
    pieces = pieces.withColumn("_ids", ids).where((F.size("_ids") == length) | (F.size("_ids") > 1))
    fill = F.lit(length) - F.size("_ids")
    return (
        pieces.withColumn("input_ids", F.concat("_ids", F.array_repeat(F.lit(pad), fill)))
        .withColumn("labels", F.concat("_ids", F.array_repeat(F.lit(ignore), fill)))
        .drop("_ids", "token")
    )


def rechunk(chunks: DataFrame, length: int) -> DataFrame:
    """Cut stored sequences into pieces of ``length``; the job fails if a sequence is no multiple of it."""
    n = F.size("input_ids")
    checked = chunks.withColumn("_ok", F.assert_true(n % length == 0, F.lit(f"a sequence is no multiple of {length}")))
    cut = checked.where(F.col("_ok").isNull()).drop("_ok").withColumn("part", F.explode(F.sequence(F.lit(0), (n / length).cast("int") - 1)))
    return cut.withColumn("input_ids", F.slice("input_ids", F.col("part") * length + 1, F.lit(length)))


def fragment_lens(ids: Column) -> Column:
    """Lengths of the fragments of a sequence; each end mark closes one, what follows the last is one more."""
    n = F.size(ids)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(ids, i) == EOS_ID)
    bounds = F.when(F.element_at(ids, -1) == EOS_ID, ends).otherwise(F.concat(ends, F.array(n)))
    lens = F.zip_with(bounds, F.concat(F.array(F.lit(0)), F.slice(bounds, 1, F.size(bounds) - 1)), lambda b, a: b - a)
    return F.when(n > 0, lens).otherwise(F.array().cast("array<int>"))


def with_fragments(chunks: DataFrame) -> DataFrame:
    out = chunks.withColumn("fragment_lens", fragment_lens(F.col("input_ids")))
    return out.withColumn("fragment_nums", F.size("fragment_lens"))


def few_fragments(chunks: DataFrame, most: int = MAX_EOS) -> DataFrame:
    """Sequences with at most ``most`` end marks."""
    return chunks.where(eos_count(F.col("input_ids")) <= most)


def pad_fragments(lens: Column, width: int = MAX_EOS + 1) -> Column:
    """Fragment lengths filled up with -1. The default width also holds 65 end marks and an open last fragment."""
    return F.concat(lens, F.array_repeat(F.lit(-1), F.greatest(F.lit(0), F.lit(width) - F.size(lens))))


def cumulative_boundaries(chunks: DataFrame, batch: Column, order: str = "chunk_id") -> DataFrame:
    """Per batch: ``cu_seqlens`` (0, then the running sum of fragment lengths over its sequences) and ``max_seqlen``."""
    rows = with_fragments(chunks).withColumn("batch", batch)
    gathered = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("fragment_lens").alias("l")))).alias("_g"))
    lens = F.flatten(F.transform("_g", lambda x: x["l"]))
    return gathered.select("batch", running_sums(F.concat(F.array(F.lit(0)), lens)).alias("cu_seqlens"), F.array_max(lens).alias("max_seqlen"))


def position_ids(mask: Column) -> Column:
    """Positions of a padded sequence: running count of kept places minus one, 1 where masked."""
    return F.zip_with(mask, running_sums(mask), lambda m, n: F.when(m == 0, F.lit(1)).otherwise(n - 1))


def shifted_labels(ids: Column) -> Column:
    """Targets of next-token prediction: each place's following id; one shorter than the sequence."""
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def mask_pairs(chunks: DataFrame) -> DataFrame:
    """Number of (query, key) pairs that attention within fragments allows, key at or before query."""
    pairs = F.aggregate(F.col("fragment_lens"), F.lit(0).cast("bigint"), lambda a, n: a + (n.cast("bigint") * (n + 1) / 2).cast("bigint"))
    return with_fragments(chunks).withColumn("pairs", pairs)


def mask_pair_rows(chunks: DataFrame) -> DataFrame:
    """The pairs themselves (q_pos, k_pos), for checking small sequences: their number is quadratic in a fragment."""
    at = chunks.select("chunk_id", F.posexplode("input_ids").alias("pos", "id"))
    upto = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    frag = at.withColumn("fragment", F.coalesce(F.sum((F.col("id") == EOS_ID).cast("int")).over(upto), F.lit(0)))
    q = frag.select("chunk_id", "fragment", F.col("pos").alias("q_pos"))
    k = frag.select("chunk_id", "fragment", F.col("pos").alias("k_pos"))
    return q.join(k, ["chunk_id", "fragment"]).where("k_pos <= q_pos")


def causal_valid_pairs(n: Column, valid: Column) -> Column:
    """Allowed (query, key) pairs of a padded sequence: key at or before query and not padding."""
    kept = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(valid, i) == 1)
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, i: a + (n - i + 1).cast("bigint"))


def last_token_index(ids: Column, pad: int = PAD_ID) -> Column:
    """Place of the last id that isn't padding."""
    return F.size(F.filter(ids, lambda x: x != pad)) - 1


def batched(rows: DataFrame, pos: str, n_rows: Column, batch_rows: int = BATCH_ROWS, per_dir: int = BATCHES_PER_DIR) -> DataFrame:
    """Batch, directory and place of each row by its 0-based position; an incomplete last batch is left out."""
    b = F.floor(F.col(pos) / batch_rows).cast("bigint")
    out = rows.withColumn("batch_idx", b).withColumn("dir_idx", F.floor(b / per_dir).cast("int")).withColumn("pos_in_batch", F.pmod(F.col(pos), F.lit(batch_rows)).cast("int"))
    path = F.format_string("%05d/%08d.pt", F.col("dir_idx").cast("bigint"), F.col("batch_idx"))
    return out.where(F.col("batch_idx") < F.floor(n_rows / batch_rows)).withColumn("path", path)


def combine_batches(batches: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """New gapless batch numbers per group over all shards, in the order of ``order`` (shard, directory, batch)."""
    new = F.dense_rank().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return batches.withColumn("new_batch", new.cast("bigint"))


def number_blocks(rows: DataFrame, group: list[str], blocks: list[str], seq: str, out: str) -> DataFrame:
    """Add ``out``: gapless numbers per group over blocks whose rows are numbered 0.. by ``seq``. Only a count per block
    goes through a window, so a group of any share of the rows stays spread out."""
    before = Window.partitionBy(*group).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, *blocks).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*group, *blocks, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(small(starts), [*group, *blocks]).withColumn(out, F.col("_first") + F.col(seq)).drop("_first")


def without_gaps(batches: DataFrame, batch: str = "batch_idx") -> DataFrame:
    """Batches up to the first missing number."""
    every = Window.partitionBy(F.lit(0)).orderBy(batch)  # one row per batch
    have = batches.select(batch).distinct().withColumn("_n", F.row_number().over(every) - 1).where(F.col(batch) == F.col("_n")).drop("_n")
    return batches.join(have, batch, "left_semi")
