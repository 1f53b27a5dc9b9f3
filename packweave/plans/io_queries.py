"""Sources and sinks: each query writes a whole table by a sink and gives what a source reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing, retrieval
from ..session import scratch, small, table
from ..sources import readers, writers
from . import common as c
from . import evaluation_queries, retrieval_queries
from .packing_queries import BATCH, PER_DIR

SHARD = ("subset", "split", "internal_idx")


def _digest(column):
    return F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def _quoted(text):
    """A string as JSON."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def source_train_chunks(s, d):
    """Raw documents as JSON lines in a directory per source chunk, read again with the number of the chunk."""
    path = scratch(s, "chunks")
    rows = table(s, d, "documents").select("text", F.struct(F.col("meta.redpajama_set_name").alias("redpajama_set_name")).alias("meta"), F.concat(F.lit("chunk"), "chunk_cid").alias("chunk"))
    for i in range(1, 11):
        rows.where(F.col("chunk") == f"chunk{i}").drop("chunk").write.json(f"{path}/chunk{i}")
    out = readers.train_chunks(s, path)
    return out.groupBy("chunk_cid", F.col("meta.redpajama_set_name").alias("set_name"), _digest("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("docs"))


def source_shards(s, d):
    """Tokenized shards by subset and split, read with both from their directories."""
    path = scratch(s, "shards")
    writers.shards(c.proc(s, d), path)
    out = readers.processed_shards(s, path)
    tokens = F.array_join(F.col("token").cast("array<string>"), ",")
    return out.select(*SHARD, _digest("contents").alias("contents_md5"), tokens.alias("tokens"))


def source_shard_line(s, d):
    """The first line of each shard, found by its number."""
    path = scratch(s, "shards")
    writers.shards(c.proc(s, d), path)
    return readers.processed_shards(s, path).where("internal_idx = 0").select(*SHARD, _digest("contents").alias("contents_md5"))


def source_tokenized(s, d):
    """Tokenized records without numbers, by subset: contents and ids only."""
    path = scratch(s, "tokenized")
    writers.tokenized(c.proc(s, d), path)
    out = s.read.schema(f"{readers.TOKENIZED}, subset string").json(path)
    return out.groupBy("subset", _digest("contents").alias("contents_md5")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.size(F.coalesce("token", F.array().cast("array<int>")))).alias("ids"))


def source_evaluation_split(s, d):
    path = scratch(s, "eval")
    writers.evaluation_split(table(s, d, "split_eval"), path)
    out = s.read.schema("text string, subset string").json(path)
    return out.groupBy("subset", _digest("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("items"))


def source_saved_batches(s, d):
    """Full batches of packed sequences in numbered directories, read up to the first missing one."""
    path = scratch(s, "batches")
    sizes = packing.full_chunks(c.eos_docs(s, d).select("n_tokens"), c.L).withColumn("_k", F.lit(0))
    rows = c.mix(s, d).withColumn("_k", F.lit(0)).join(small(sizes), "_k")  # one row
    writers.batches(packing.batched(rows, "chunk_id", F.col("n_chunks"), BATCH, PER_DIR), path)
    out = readers.saved_batches(s, path)
    return out.select(F.col("dir_idx").cast("int").alias("dir_idx"), "batch_idx", "pos_in_batch", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"))


def source_task_lines(s, d):
    """A task file of JSON lines, numbered as its lines stand."""
    path = scratch(s, "task")
    rows = table(s, d, "eval_cls").where("task = 'agnews' and split_name = 'test' and text is not null")
    rows.orderBy("example_idx", "eval_id").coalesce(1).select("text", "label").write.json(path)
    return readers.task_examples(s, "agnews", path).select("example_idx", "text", "label")


def source_task_array(s, d):
    """A task file that is one JSON array, its contexts as pairs of a title and sentences."""
    path = scratch(s, "task")
    train, _, _ = evaluation_queries.task_tables(s, d, "hotpotqa")
    pairs = F.transform("context", lambda x: F.concat(F.lit("["), _quoted(x[0]), F.lit(","), x[1], F.lit("]")))  # x[1] is JSON already
    record = F.concat(F.lit('{"question":'), _quoted(F.col("question")), F.lit(',"answer":'), _quoted(F.col("answer")), F.lit(',"context":['), F.array_join(pairs, ","), F.lit("]}"))
    lines = train.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example_idx", record.alias("r")))), lambda x: x["r"]), ","), F.lit("]")).alias("value"))  # a fixed table
    lines.coalesce(1).write.text(path)
    out = readers.task_examples(s, "hotpotqa", path).withColumn("c", readers.hotpot_contexts(F.col("context")))
    return out.select("example_idx", "question", "answer", F.array_join(F.transform("c", lambda x: F.concat(x["title"], F.lit(": "), x["text"])), "|").alias("contexts"))


def source_index(s, d):
    """The lexical index, saved and loaded."""
    path = scratch(s, "index")
    retrieval.build_index(retrieval_queries.collection(s, d)).save(path)
    return retrieval.Index.load(s, path).postings.select("shard", "term", "doc", F.col("tf").cast("bigint").alias("tf"))


def source_result_log(s, d):
    path = scratch(s, "log")
    rows = evaluation_queries.seed_average(s, d).select("task", "model", F.col("n_shot").cast("int").alias("n_shot"), F.col("seeds").cast("int").alias("seeds"))
    writers.log_results(rows, path)
    return s.read.text(path).select(F.col("value").alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        source_train_chunks, source_shards, source_shard_line, source_tokenized, source_evaluation_split, source_saved_batches,
        source_task_lines, source_task_array, source_index, source_result_log,
    )
}

_IDS = "array_to_string(token, ',')"
SQL = {
    "source_train_chunks": "SELECT chunk_cid, meta.redpajama_set_name AS set_name, md5(coalesce(replace(text, chr(65279), ''), '')) AS text_md5, count(*) AS docs FROM documents GROUP BY 1, 2, 3",
    "source_shards": c.with_(c.PROC) + f"SELECT subset, split, internal_idx, md5(coalesce(contents, '')) AS contents_md5, {_IDS} AS tokens FROM proc",
    "source_shard_line": c.with_(c.PROC) + "SELECT subset, split, internal_idx, md5(coalesce(contents, '')) AS contents_md5 FROM proc WHERE internal_idx = 0",
    "source_tokenized": c.with_(c.PROC) + "SELECT subset, md5(coalesce(contents, '')) AS contents_md5, count(*) AS items, CAST(sum(coalesce(len(token), 0)) AS BIGINT) AS ids FROM proc GROUP BY 1, 2",
    "source_evaluation_split": "SELECT subset, md5(coalesce(text, '')) AS text_md5, count(*) AS items FROM split_eval GROUP BY 1, 2",
    "source_saved_batches": c.BASE_MIX
    + f"SELECT CAST(chunk_id // {BATCH * PER_DIR} AS INTEGER) AS dir_idx, chunk_id // {BATCH} AS batch_idx, CAST(chunk_id % {BATCH} AS INTEGER) AS pos_in_batch, array_to_string(ids, ',') AS ids FROM mix WHERE chunk_id // {BATCH} < (SELECT count(*) FROM mix) // {BATCH}",
    "source_task_lines": "SELECT row_number() OVER (ORDER BY example_idx, eval_id) - 1 AS example_idx, text, label FROM eval_cls WHERE task = 'agnews' AND split_name = 'test' AND text IS NOT NULL",
    "source_task_array": "SELECT row_number() OVER (ORDER BY example_idx) - 1 AS example_idx, text AS question, ['world', 'sports', 'business', 'science'][label + 1] AS answer, "
    + " || '|' || ".join(f"'T{i} ' || example_idx || ': ' || text || ' {i} End.'" for i in (1, 2, 3))
    + " AS contexts FROM eval_cls WHERE task = 'agnews' AND split_name = 'train' AND label IS NOT NULL AND text IS NOT NULL",
    "source_index": retrieval_queries.SQL["postings"],
    "source_result_log": evaluation_queries.SQL["result_log"],
}
