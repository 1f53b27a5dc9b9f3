"""Scans: JSON lines (plain or zstd), JSON arrays, saved batches, task files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import without_bom
from ..operators.ordering import sample
from ..operators.packing import without_gaps
from ..session import small

RAW = "text string, meta struct<redpajama_set_name: string>"
TOKENIZED = "contents string, token array<int>"
PROCESSED = f"{TOKENIZED}, internal_idx bigint"
SAVED = "batch_idx bigint, pos_in_batch int, input_ids array<int>, dir_idx int"
CBQA = "question string, answer array<string>"
CLASSIFY = "text string, label int"
TITLED = "title string, content string, label int"
CONTEXTS = "question string, answers array<string>, ctxs array<struct<title: string, text: string>>, target string"
HOTPOT = "question string, answer string, context array<array<string>>"
SQUAD = "context string, question string, answers struct<text: array<string>>"

#: Schema and file form of each evaluation task.
TASKS = {
    "nq": (CBQA, "lines"), "tq": (CBQA, "lines"), "agnews": (CLASSIFY, "lines"), "yelp": (CLASSIFY, "lines"), "sst2": (CLASSIFY, "lines"),
    "tweet_hate": (CLASSIFY, "lines"), "tweet_offensive": (CLASSIFY, "lines"), "amazon": (TITLED, "lines"), "dbpedia": (TITLED, "lines"),
    "nq_obqa": (CONTEXTS, "array"), "tq_obqa": (CONTEXTS, "array"), "hotpotqa": (HOTPOT, "array"), "squad": (SQUAD, "lines"),
}


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, recursive: bool = True) -> DataFrame:
    """Records of JSON-lines files, compressed ones (.zst, .gz) too. Lines end at \\n only; a byte-order mark is dropped.

    ``strict``: a bad line fails the job; else it gives a row of nulls.
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(path)
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    clean = without_bom(F.regexp_replace("value", "\r$", ""))
    return raw.where("trim(value) <> ''").select(F.from_json(clean, T._parse_datatype_string(schema), mode).alias("r"), F.col("_metadata.file_path").alias("_path")).select("r.*", "_path")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def train_chunks(spark: SparkSession, root: str, chunks: int = 10) -> DataFrame:
    """Raw training documents of the directories chunk1 .. chunkN, with ``chunk_cid``."""
    docs = json_lines(spark, [f"{root}/chunk{i}" for i in range(1, chunks + 1)], RAW)
    return docs.withColumn("chunk_cid", F.regexp_extract("_path", r"/chunk(\d+)/", 1).cast("int")).drop("_path")


def processed_shards(spark: SparkSession, root: str) -> DataFrame:
    """Tokenized shards, with ``subset`` and ``split`` from their directories."""
    return spark.read.schema(f"{PROCESSED}, subset string, split int").option("basePath", root).json(root)


def shard_line(shards: DataFrame, subset: str, split: int, line: int) -> DataFrame:
    """One row of one shard; both partition columns prune the scan."""
    return shards.where((F.col("subset") == subset) & (F.col("split") == split) & (F.col("internal_idx") == line))


def saved_batches(spark: SparkSession, path: str, contiguous: bool = True) -> DataFrame:
    """Rows of a directory of saved batches; ``contiguous``: only up to the first missing batch."""
    rows = spark.read.schema(SAVED).parquet(path)
    return without_gaps(rows) if contiguous else rows


def task_examples(spark: SparkSession, task: str, path: str, most: int | None = None, seed: int = 666) -> DataFrame:
    """Examples of an evaluation task, numbered from 0 by ``example_idx`` in the order of files and lines; ``most``: a
    sample without replacement."""
    schema, form = TASKS[task]
    rows = json_array(spark, path, schema) if form == "array" else json_lines(spark, path, schema).drop("_path")
    rows = numbered(rows, "example_idx")
    return rows if most is None else sample(rows, seed, "example_idx", most)


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Add ``out``: gapless numbers in the order in which the rows of a scan stand in its files and lines.

    A split of a file holds lines that follow each other; a count per split and its place among the splits, which are
    few, are all that is gathered.
    """
    marked = rows.select("*", F.input_file_name().alias("_f"), F.input_file_block_start().alias("_b"), F.monotonically_increasing_id().alias("_i"))
    before = Window.partitionBy(F.lit(0)).orderBy("_f", "_b")  # one row per split of a file
    counts = marked.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i0"))
    starts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # within a split the ids of a scan go up by one
    return marked.join(small(starts), ["_f", "_b"]).withColumn(out, (F.col("_first") + F.col("_i") - F.col("_i0")).cast("bigint")).drop("_f", "_b", "_i", "_i0", "_first")


def hotpot_contexts(context):
    """Contexts of HotpotQA: [title, sentences as JSON text] pairs to title and joined sentences."""
    return F.transform(context, lambda c: F.struct(c[0].alias("title"), F.array_join(F.from_json(c[1], "array<string>"), "").alias("text")))


def sentence_pieces(spark: SparkSession, model: str):
    """A pandas UDF text -> ids of a sentencepiece model file, without special tokens; null text: null."""
    held: list = []

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pd.Series) -> pd.Series:
        if not held:
            import sentencepiece

            held.append(sentencepiece.SentencePieceProcessor(model_file=model))
        return pd.Series([None if t is None else held[0].encode(t) for t in text])

    return encode
