"""Whole pipelines as single calls: sequences by strategy, shards from raw documents, scores by task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEED_CORPUS, SEED_RETRIEVAL
from ..functions.text import retrieval_terms
from ..functions.tokens import hash_tokens, with_eos
from ..operators import blend, corpus, evaluation, packing, retrieval_packing
from ..operators.ordering import sample
from ..session import stage

STRATEGIES = ("mixchunk", "unichunk", "bm25chunk", "pad")


def make_shards(
    docs: DataFrame, config: DataFrame, total_tokens: int, seed: int = SEED_CORPUS, tokenizer: Callable[[Column], Column] = hash_tokens
) -> DataFrame:
    """Documents (doc_id, text, source, chunk_cid) to token-balanced shards: subset, sample, tokenize, group.

    Adds ``subset``, ``token`` (by ``tokenizer``), ``split`` and ``internal_idx``.
    """
    sized = corpus.tokenized(corpus.with_subset(docs, config), tokenizer).withColumn("n_tokens", F.size("token"))
    sampled = corpus.budget_sample(sized, config, total_tokens, seed).drop("run_pos", "run_before", "target")
    return corpus.assign_shards(sampled, config, total_tokens, seed).drop("run_pos", "run_before")


def pack(shards: DataFrame, strategy: str, config: DataFrame, length: int, n_sequences: int | None = None, **settings) -> DataFrame:
    """Sequences of ``shards`` (subset, split, internal_idx, contents, token) by one of STRATEGIES.

    ``unichunk`` and ``bm25chunk`` are blended by the weights of ``config`` if ``n_sequences`` is given. Errors are
    raised, not taken for the end of the data.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    key = F.concat_ws("-", "subset", F.col("split").cast("string"), F.col("internal_idx").cast("string"))
    items = shards.select(key.alias("item"), "subset", with_eos(F.col("token")).alias("token"))
    if strategy == "pad":
        return packing.pad_chunks(items, length)
    if strategy == "mixchunk":
        return packing.concat_chunks(items.drop("subset"), length, SEED_CORPUS, key="item")
    if strategy == "unichunk":
        made = packing.concat_chunks(items, length, SEED_CORPUS, ["subset"], "item")
    else:
        cfg = retrieval_packing.PackingConfig(length=length, **settings)
        rows = shards.select("subset", "split", "internal_idx", "token", retrieval_terms(F.col("contents")).alias("terms"))
        packed = stage(retrieval_packing.retrieval_chunks(rows, cfg), "packed")  # the kernel runs once
        made = packing.number_blocks(packed, ["subset"], ["split"], "chunk_seq", "chunk_id").select("subset", "chunk_id", "input_ids")
    if n_sequences is None:
        return made
    return blend.blend(blend.blend_order(config, n_sequences, SEED_RETRIEVAL), made)


#: Training examples of closed-book question answering that demonstrations are drawn from, and the seed of that draw.
CBQA_POOL, CBQA_POOL_SEED = 4096, 666
POOLED = ("nq", "tq")


def task_prompts(task: str, train: DataFrame, test: DataFrame, n_shot: int, seed: int) -> DataFrame:
    """``test`` with ``prompt``: ``n_shot`` demonstrations of ``train`` chosen by ``seed``, then the example's own question.
    Both have ``example_idx`` and the columns of the task (``readers.TASKS``)."""
    if task in POOLED:
        train = sample(train, CBQA_POOL_SEED, "example_idx", CBQA_POOL)
    demo, query = evaluation.task_texts(task)
    demos = evaluation.demonstrations(train.withColumn("_g", F.lit(0)), ["_g"], "example_idx", n_shot, seed, demo)
    return evaluation.prompts(test.withColumn("_g", F.lit(0)), demos, ["_g"], query).drop("_g")


def judged(task: str, test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each example of ``test`` with each prediction for it and ``hit``; an example without any has one row, no hit."""
    rows = test.join(predictions.withColumnRenamed("example_idx", "_e"), F.col("example_idx") == F.col("_e"), "left").drop("_e")
    return rows.withColumn("hit", evaluation.task_hit(task, F.col("prediction")))


def evaluate(task: str, predictions: DataFrame, references: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Score of ``predictions`` (example_idx, prediction, group columns) against ``references`` (example_idx and the
    columns of the task), by the task's rule; 100 is the best. Examples without a label or prediction are left out."""
    rows = predictions.join(references, "example_idx")
    if evaluation.TASK_FORMATS[task] == "class":
        rows = rows.where("label is not null")
    return evaluation.scores(rows.withColumn("task", F.lit(task)), ["task", *(group or [])], evaluation.task_hit(task, F.col("prediction")))


def evaluate_task(task: str, train: DataFrame, test: DataFrame, predictions: DataFrame, n_shot: int, seed: int) -> DataFrame:
    """One row (task, n_shot, seed, score, n): the whole of a task from its tables. Prompts are those that the predictions
    answer (``task_prompts``); every test example counts, an unanswered one as wrong."""
    rows = judged(task, test, predictions).select(F.lit(task).alias("task"), F.lit(n_shot).alias("n_shot"), F.lit(seed).alias("seed"), "hit")
    return evaluation.scores(rows, ["task", "n_shot", "seed"], F.col("hit"))
