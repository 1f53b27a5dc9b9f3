"""Fill sequences of fixed capacity with whole documents by vector best-fit.

An item is a vector (tokens, 1 document, attention cost = tokens squared). A bin has a residual of each. Items are
taken by falling size; among the bins that hold the item in every dimension, the one with the smallest weighted norm
of what would be left, each dimension as a share of its capacity, gets it (or the largest weighted dot product of
residual and item). All three capacities bind: the cost is well under that of a full piece, the documents near the mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, table
from .sizes import public_counter

CAPACITY = 2048
MAX_DOCS = 24
#: Attention cost of a sequence, as a part of that of one full piece.
COST_SHARE = 0.6
#: Items are packed in groups of about this many; a group that is larger is packed in windows of twice as many.
GROUP_ITEMS = 8192
#: Bits of a sequence's id for its number in a window; the window's number has those up to the 36th, then the group's.
WINDOW_BITS = 15
WEIGHTS = (1.0, 0.5, 0.5)
NO_BOUND = float(1 << 62)

#: Ids pass Python as strings, so nulls and large numbers stay exact.
PLACED = "sequence_id long, position int, doc_id string, piece_no int, start long, n_tokens int"


def cost_capacity(largest: int, capacity: int, max_cost: float) -> float:
    """Cost that a bin may reach whose largest item has ``largest`` tokens."""
    cost = float(largest) * largest
    return max_cost if cost <= max_cost else cost + max_cost * (capacity - largest) / capacity


def vector_best_fit(
    tokens: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights=WEIGHTS, rule: str = "norm"
) -> tuple[np.ndarray, int]:
    """Bin of each item (items by falling size), and the number of bins. Every item has 1 to ``capacity`` tokens.

    An item whose cost alone exceeds ``max_cost`` opens a bin whose other items may cost as much of ``max_cost`` as
    their part of the capacity.
    """
    n = len(tokens)
    place = np.empty(n, np.int64)
    w = np.array([weights[0] / capacity, weights[1] / max_docs, weights[2] / max_cost]) ** 2
    size = 256
    left = np.zeros((3, size))  # residual tokens, documents, cost of the open bins
    name = np.zeros(size, np.int64)
    m = bins = 0
    smallest = int(tokens[-1]) if n else 0
    for k in range(n):
        t = int(tokens[k])
        cost = float(t) * t
        r = left[:, :m]
        fits = np.flatnonzero((r[0] >= t) & (r[1] >= 1) & (r[2] >= cost)) if m else ()
        if len(fits):
            a, b, c = r[0, fits], r[1, fits], r[2, fits]
            if rule == "norm":
                best = fits[np.argmin(w[0] * (a - t) ** 2 + w[1] * (b - 1) ** 2 + w[2] * (c - cost) ** 2)]
            else:
                best = fits[np.argmax(w[0] * a * t + w[1] * b + w[2] * c * cost)]
        else:
            if m == size:
                open_ = np.flatnonzero((left[0] >= smallest) & (left[1] >= 1) & (left[2] >= float(smallest) ** 2))
                if len(open_) > size * 3 // 4:
                    size *= 2
                grown, names = np.zeros((3, size)), np.zeros(size, np.int64)
                m = len(open_)
                grown[:, :m], names[:m] = left[:, open_], name[open_]
                left, name = grown, names
            best = m
            left[:, m] = capacity, max_docs, cost_capacity(t, capacity, max_cost)
            name[m] = bins
            bins += 1
            m += 1
        place[k] = name[best]
        left[0, best] -= t
        left[1, best] -= 1
        left[2, best] -= cost
    return place, bins


def pack(
    sized: DataFrame,
    capacity: int = CAPACITY,
    max_docs: int = MAX_DOCS,
    max_cost: float | None = None,
    group_items: int = GROUP_ITEMS,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """Sequences of ``sized`` (doc_id, n_tokens), which is read twice: a staged table, best.

    A document over the capacity is cut into full pieces and a rest; all others stay whole. Documents without tokens
    (null or empty text) take no room and get no row. Repeated rows are packed once each. ``max_cost`` bounds the sum
    of squared piece sizes in a sequence (default: COST_SHARE of one full piece). Groups are formed by a hash of the
    piece, as many as the number of pieces asks for, and packed independently, so memory and time of a task don't grow
    with the data; a group that equal hashes swell is packed window by window. Only ids and sizes are shuffled.
    """
    max_cost = float(max_cost or COST_SHARE * capacity * capacity)
    pieces = sized.where("n_tokens > 0").agg(F.sum(F.expr(f"(cast(n_tokens as bigint) - 1) div {capacity} + 1"))).first()[0] or 0
    groups = max(1, -(-pieces // group_items))
    items = (
        sized.where("n_tokens > 0")
        .select(F.col("doc_id").cast("string").alias("doc_id"), F.col("n_tokens").cast("long").alias("n"))
        .select("doc_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("p"))
        .select(
            F.pmod(F.xxhash64("doc_id", "p", "n"), F.lit(groups)).alias("g"),
            "doc_id",
            F.col("p").cast("int").alias("piece_no"),
            (F.col("p") * capacity).alias("start"),
            F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("p") * capacity).cast("int").alias("n_tokens"),
        )
    )
    window = min(2 * group_items, 1 << WINDOW_BITS)

    def place(g: int, w: int, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        bins, _ = vector_best_fit(part["n_tokens"].to_numpy(), capacity, max_docs, max_cost, weights, rule)
        out = part.assign(sequence_id=(g << 36) + (w << WINDOW_BITS) + bins)
        out = out.assign(position=out.groupby("sequence_id").cumcount().astype("int32"))
        return out[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, group, w = [], 0, None, 0
        for batch in batches:
            for g, part in batch.groupby("g", sort=True):
                if g != group and held:
                    yield place(group, w, pd.concat(held))
                    held, rows, w = [], 0, 0
                elif g != group:
                    w = 0
                group = int(g)
                while rows + len(part) >= window:
                    cut = window - rows
                    yield place(group, w, pd.concat([*held, part.iloc[:cut]]))
                    part, held, rows, w = part.iloc[cut:], [], 0, w + 1
                if len(part):
                    held.append(part)
                    rows += len(part)
        if held:
            yield place(group, w, pd.concat(held))

    names = [c.split()[0] for c in PLACED.split(", ")]
    ordered = items.repartition("g").sortWithinPartitions("g", "doc_id", "piece_no", "start", "n_tokens")
    return ordered.mapInPandas(run, PLACED).withColumn("doc_id", F.col("doc_id").cast("long"))


def document_sizes(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row under the public tokenizer at ``tokenizer``; null text: 0."""
    count = public_counter(docs.sparkSession, tokenizer)
    return docs.select("doc_id", F.coalesce(count("text"), F.lit(0)).cast("long").alias("n_tokens"))


def fill_report(placed: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: float | None = None) -> DataFrame:
    """One row: sequences, pieces, tokens, share of the capacity in use, the least number of sequences possible, and how
    many sequences are closest to their capacity of tokens, documents or cost."""
    max_cost = float(max_cost or COST_SHARE * capacity * capacity)
    n = F.col("n_tokens").cast("double")
    per = placed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(n).alias("big"), F.sum(n * n).alias("cost")
    )
    most = F.when(F.col("big") * F.col("big") <= max_cost, max_cost).otherwise(F.col("big") * F.col("big") + max_cost * (capacity - F.col("big")) / capacity)
    # what is left of each, as a share; of equal ones tokens go first
    left = [F.col("tokens") / -capacity + 1, F.col("pieces") / -max_docs + 1, F.col("cost") / -most + 1]
    names = ("tokens", "documents", "cost")
    closer = F.array_min(F.array(*[F.struct(x.alias("left"), F.lit(i).alias("i")) for i, x in enumerate(left)]))["i"]
    return per.withColumn("_c", closer).agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("pieces").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.max("pieces").alias("most_documents"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
        F.ceil(F.sum("tokens") / capacity).alias("least_sequences"),
        *[F.count_if(F.col("_c") == i).alias(f"closed_by_{x}") for i, x in enumerate(names)],
    )


def _sizes(spark, sf_dir: str) -> DataFrame:
    return stage(document_sizes(table(spark, sf_dir, "documents")), "sizes")  # texts are counted once


def p5_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir))


def p5_fill(spark, sf_dir: str) -> DataFrame:
    """The report of ``p5_sequences``, beside the number of sequences that best-fit by tokens alone makes."""
    sizes = _sizes(spark, sf_dir)
    scalar = pack(sizes, max_docs=1 << 40, max_cost=NO_BOUND, weights=(1.0, 0.0, 0.0))
    beside = scalar.agg(F.count_distinct("sequence_id").alias("scalar_sequences")).withColumn("_k", F.lit(0))
    return fill_report(pack(sizes)).withColumn("_k", F.lit(0)).join(beside, "_k").drop("_k")  # one row each
