"""Mix sources to target shares of tokens by systematic sampling.

Each document of a source has the same expected number of copies. The expected copies are added up along the source;
with one random offset per source, a document is emitted once for each whole number its step crosses. So every
document has the rounded-down or rounded-up number of its expected copies, and the total is right to within one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, stage, table
from .sizes import public_counter
from .token_budget import MAX_SUBSETS, with_subset

SEED = 42
#: The prefix sum runs within buckets of about this many documents.
BUCKET_ROWS = 50_000


def offset(seed: int, subset: str) -> float:
    """The random offset of a source, in [0, 1)."""
    return int.from_bytes(hashlib.blake2b(f"{seed}-{subset}".encode(), digest_size=6).digest()) / 2**48


def plan_rates(totals: dict[str, int], config: list[tuple[str, float, float]], target: float | None = None) -> tuple[float, dict[str, float]]:
    """The total size and the expected copies per document of each source.

    ``config``: (subset, weight, most copies). Without ``target`` the total is the largest at which every source
    with documents reaches its share. With one, a source that would need more copies than it may have gets its most.
    """
    live = [(s, w, m) for s, w, m in config if totals.get(s, 0) > 0 and w > 0 and m > 0]
    if not live:
        return 0.0, {}
    total = float(target) if target is not None else min(m * totals[s] / w for s, w, m in live)
    return total, {s: min(float(m), w * total / totals[s]) for s, w, m in live}


def mix(sized: DataFrame, config: DataFrame, target: float | None = None, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Emitted documents (doc_id, subset, copy_no, n_tokens) of ``sized`` (doc_id, subset, n_tokens).

    Rows without tokens or of a source that isn't configured are never emitted. ``config``: (subset, weight,
    max_epochs); null weights and epochs count as 0. Repeated rows are documents of their own. The prefix sum has two
    levels: counts per bucket of the order, then numbers within a bucket. The order goes by size class, hash bucket,
    then size, so each source keeps its distribution of sizes in the sample, and the largest bucket is bounded whatever
    share of the rows one source has.
    """
    rows = config.where("subset is not null").select("subset", "weight", "max_epochs").limit(MAX_SUBSETS + 1).collect()
    if len(rows) > MAX_SUBSETS:
        raise ValueError(f"more than {MAX_SUBSETS} configured subsets")
    plan = [(r.subset, float(r.weight or 0), float(r.max_epochs or 0)) for r in rows]
    usable = sized.where((F.col("n_tokens") > 0) & F.col("subset").isin([p[0] for p in plan]))
    facts = usable.groupBy("subset").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()
    _, rates = plan_rates({f.subset: f.tokens for f in facts}, plan, target)
    spread = max(1, -(-max((f.rows for f in facts), default=0) // bucket_rows))
    chosen = [(s, r, offset(seed, s)) for s, r in rates.items()]
    rate_df = sized.sparkSession.createDataFrame(chosen, "subset string, rate double, shift double")
    mixed = F.xxhash64(F.lit(seed), "doc_id", "n_tokens")
    ordered = usable.select(
        "doc_id", "subset", "n_tokens", mixed.alias("h"),
        (F.floor(F.log2("n_tokens")) * spread + F.pmod(mixed, F.lit(spread))).cast("long").alias("bucket"),
    )
    before = Window.partitionBy("subset").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("subset", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "subset", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("subset", "bucket").orderBy("n_tokens", "h", "doc_id")
    # rates: at most MAX_SUBSETS rows
    numbered = ordered.withColumn("i", F.row_number().over(within)).join(small(starts), ["subset", "bucket"]).join(F.broadcast(rate_df), "subset")
    i = F.col("first") + F.col("i")
    copies = F.floor(i * F.col("rate") + F.col("shift")) - F.floor((i - 1) * F.col("rate") + F.col("shift"))
    return (
        numbered.select("doc_id", "subset", "n_tokens", copies.cast("int").alias("copies"))
        .where("copies > 0")
        .select("doc_id", "subset", F.explode(F.expr("sequence(1, copies)")).alias("copy_no"), "n_tokens")
    )


def share_report(mixed: DataFrame, sized: DataFrame, config: DataFrame) -> DataFrame:
    """Per configured subset: target and reached share of tokens, documents at hand and used, most copies of one."""
    used = mixed.groupBy("subset", "doc_id").agg(F.count(F.lit(1)).alias("c"), F.sum("n_tokens").alias("t"))
    used = used.groupBy("subset").agg(F.count(F.lit(1)).alias("docs_used"), F.max("c").alias("most_copies"), F.sum("t").alias("tokens"))
    have = sized.groupBy("subset").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens_at_hand"))
    out = config.select("subset", "weight", "max_epochs").join(have, "subset", "left").join(used, "subset", "left")
    zero = ["docs", "tokens_at_hand", "docs_used", "most_copies", "tokens"]
    every = Window.partitionBy(F.lit(0))  # one row per configured subset
    return out.fillna(0, zero).withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(every), 6))


def subset_sizes(docs: DataFrame, config: DataFrame, tokenizer: str | None = None) -> DataFrame:
    count = public_counter(docs.sparkSession, tokenizer)
    slim = with_subset(docs.select("doc_id", "text", "source", "meta"), config)
    return slim.select("doc_id", F.col("subset_key").alias("subset"), F.coalesce(count("text"), F.lit(0)).cast("long").alias("n_tokens"))


def p6_mixture(spark, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "corpus_config")
    return mix(stage(subset_sizes(table(spark, sf_dir, "documents"), config), "sizes"), config)


def p6_shares(spark, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "corpus_config")
    sized = stage(subset_sizes(table(spark, sf_dir, "documents"), config), "sizes")
    return share_report(mix(sized, config), sized, config)
