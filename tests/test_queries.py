"""Every query against its SQL on the smallest data; sources, sinks and streams."""

import glob
import importlib.util
import itertools
import math
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packweave.operators import packing
from packweave.plans import registry
from packweave.sources import readers, writers
from packweave.streaming import ingest


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, tiny, duck, name):
    df = registry.queries()[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    made = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(float(x)) if type(x).__name__ == "Decimal" else plain(x) for x in (row[names.index(c)] for c in cols))) for row in made.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, tiny, name):
    assert registry.queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_separate_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/packweave/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert not re.search(r"\bllm\b", f.read()), path
    assert importlib.util.find_spec("packweave") is not None


def test_json_lines_zstd_and_bom(spark, tmp_path):
    import zstandard

    d = tmp_path / "chunk1"
    d.mkdir()
    lines = '﻿{"text": "a b", "meta": {"redpajama_set_name": "X"}}\n\n{"text": "c", "meta": null}\n'
    (d / "a.jsonl").write_text(lines)
    (tmp_path / "chunk2").mkdir()
    (tmp_path / "chunk2" / "b.jsonl.zst").write_bytes(zstandard.compress(lines.encode()))
    rows = readers.train_chunks(spark, str(tmp_path), 1).collect()
    assert [(r.text, r.chunk_cid) for r in rows] == [("a b", 1), ("c", 1)]
    both = readers.json_lines(spark, str(tmp_path), readers.RAW)
    assert both.count() == 4
    (d / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(d), readers.RAW).collect()


def test_task_files(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text('[{"question": "q", "answer": "a", "context": [["T", ["s1. ", "s2."]]]}]')
    row = readers.task_examples(spark, "hotpotqa", str(p)).withColumn("c", readers.hotpot_contexts(F.col("context"))).first()
    assert (row.c[0].title, row.c[0].text) == ("T", "s1. s2.")
    q = tmp_path / "n.jsonl"
    q.write_text("\n".join('{"question": "q%d", "answer": ["x"]}' % i for i in range(20)))
    assert readers.task_examples(spark, "nq", str(q), most=5).count() == 5
    more = tmp_path / "many"
    more.mkdir()
    for k in range(3):
        (more / f"part{k}.jsonl").write_text("\n".join('{"question": "q%d", "answer": ["x"]}' % i for i in range(k * 7, k * 7 + 7)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = readers.task_examples(spark, "nq", str(more)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.example_idx, r.question) for r in rows) == [(i, f"q{i}") for i in range(21)]


def test_sinks_are_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "subset string, text string")
    for _ in range(2):
        writers.evaluation_split(docs, str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval")).count() == 2
    rows = spark.createDataFrame([("a", 0, "t", [3], 1), ("a", 0, "u", [4], 0), ("a", 1, "v", [5], 0)], "subset string, split int, contents string, token array<int>, internal_idx bigint")
    writers.shards(rows, str(tmp_path / "shards"))
    back = readers.processed_shards(spark, str(tmp_path / "shards"))
    assert readers.shard_line(back, "a", 0, 1).first().contents == "t"
    chunks = spark.range(40).select(F.col("id").alias("pos"), F.array(F.col("id").cast("int")).alias("input_ids"))
    made = packing.batched(chunks, "pos", F.lit(40), 8, 2)
    writers.batches(made.where("batch_idx <> 3"), str(tmp_path / "batches"))
    kept = readers.saved_batches(spark, str(tmp_path / "batches"))
    assert sorted(r.batch_idx for r in kept.select("batch_idx").distinct().collect()) == [0, 1, 2]
    for _ in range(2):
        writers.log_results(spark.createDataFrame([("t", 1.5)], "task string, score double"), str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"task":"t","score":1.5}'] * 2


def test_stream_fills_as_batch_does(spark, tmp_path):
    rows = [("s" if i % 2 else "t", i, list(range(3, 3 + i % 9))) for i in range(60)]
    schema = "stream string, ord int, token array<int>"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    stream = ingest.stream_fill(ingest.stream_table(spark, str(tmp_path / "in"), schema), 16)
    q = stream.writeStream.format("memory").queryName("filled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    for r in spark.table("filled").orderBy("chunk_no").collect():
        got.setdefault(r.stream, []).extend(r.input_ids)
    for s in ("s", "t"):
        total = sum(len(t) + 1 for x, _, t in rows if x == s)
        assert len(got[s]) == total // 16 * 16
        want = {}
        for k in range(3):  # files may be taken in any order, but each keeps its own
            want[k] = [t for x, i, ts in rows if x == s and i // 20 == k for t in [*ts, 2]]
        assert any(got[s] == [t for k in p for t in want[k]][: len(got[s])] for p in itertools.permutations(range(3)))
    cut = ingest.stream_rechunk(spark.table("filled").select("input_ids"), 8)
    assert cut.count() == 2 * spark.table("filled").count()
