import pytest
from pyspark.sql import functions as F

from packweave.functions.text import retrieval_terms
from packweave.operators import corpus
from packweave.plans import pipelines


def test_shards_and_every_strategy(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source", "chunk_cid")
    config = spark.read.parquet(f"{tiny}/corpus_config.parquet")
    shards = pipelines.make_shards(docs, config, 8000).withColumnRenamed("text", "contents").cache()
    names = {r.subset for r in config.collect()}
    assert {r.subset for r in shards.select("subset").distinct().collect()} <= names
    twice = shards.groupBy("subset", "split", "internal_idx").count().where("count > 1").count()
    assert twice == 0
    for s in pipelines.STRATEGIES:
        out = pipelines.pack(shards, s, config, 64, **({"buffer": 8, "query_terms": 16} if s == "bm25chunk" else {}))
        assert out.where(F.size("input_ids") != 64).count() == 0 < out.count()
    few = pipelines.pack(shards, "unichunk", config, 64, n_sequences=10)
    assert few.count() <= 10
    with pytest.raises(ValueError):
        pipelines.pack(shards, "other", config, 64)


def test_evaluate_by_task(spark):
    p = spark.createDataFrame([(0, " World \n x", "m"), (1, "sports", "m"), (2, None, "m"), (3, "business", "m")], "example_idx long, prediction string, model string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, None)], "example_idx long, label int")
    row = pipelines.evaluate("agnews", p, labels, ["model"]).first()
    assert (row.task, row.n) == ("agnews", 3) and abs(row.score - 100 / 3) < 1e-5
    q = spark.createDataFrame([(0, "apple"), (1, "pear")], "example_idx long, prediction string")
    answers = spark.createDataFrame([(0, ["apple", "orange"]), (1, ["banana"])], "example_idx long, answer array<string>")
    assert pipelines.evaluate("nq", q, answers).first().score == 50.0
    empty = spark.createDataFrame([(0, ([],)), (1, None)], "example_idx long, answers struct<text:array<string>>")
    assert pipelines.evaluate("squad", q, empty).first().score == 0.0


def test_a_whole_task_with_every_answer_counted(spark):
    ctx = "array<struct<title:string,text:string>>"
    schema = f"example_idx long, question string, answers array<string>, ctxs {ctx}, target string"
    train = spark.createDataFrame([(0, "q0", ["a0"], [("T", "x"), ("U", "y"), ("V", "z")], "t0"), (1, "q1", ["a1", "b"], [], None)], schema)
    test = spark.createDataFrame([(0, "r0", ["yes"], [("W", "w")], None), (1, "r1", ["no"], None, None), (2, "r2", [], [], None)], schema)
    asked = {r.example_idx: r.prompt for r in pipelines.task_prompts("tq_obqa", train, test, 2, 42).collect()}
    one, two = "Context: T. x\nU. y\nQuestion: q0\nAnswer: t0\n\n", "Context: Question: q1\nAnswer: a1\n\n"
    assert asked[0] in (one + two + "Context: W. w\nQuestion: r0\nAnswer:", two + one + "Context: W. w\nQuestion: r0\nAnswer:")
    assert asked[1].endswith("Context: Question: r1\nAnswer:")
    predictions = spark.createDataFrame([(0, "Yes.\nmore"), (2, None)], "example_idx long, prediction string")
    row = pipelines.evaluate_task("tq_obqa", train, test, predictions, 2, 42).first()
    assert (row.task, row.n_shot, row.seed, row.n) == ("tq_obqa", 2, 42, 3) and abs(row.score - 100 / 3) < 1e-5


def test_any_tokenizer_makes_shards(spark, tiny):
    docs = spark.createDataFrame([(i, "one two three", "src0", 1) for i in range(40)], "doc_id long, text string, source string, chunk_cid int")
    config = spark.read.parquet(f"{tiny}/corpus_config.parquet")
    made = pipelines.make_shards(docs, config, 10_000, tokenizer=lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c)))
    assert made.select(F.size("token").alias("n")).distinct().collect()[0].n == 13
    from packweave.sources import readers

    pieces = readers.sentence_pieces(spark, "/opt/tokenizers/piece_bpe_32k.model")
    assert corpus.tokenized(docs, pieces).where(F.size("token") < 3).count() == 0


def test_unknown_subset_fails(spark):
    df = spark.createDataFrame([("a",), ("zzz",)], "subset string")
    assert corpus.require_members(df.where("subset = 'a'"), "subset", ["a"]).count() == 1
    with pytest.raises(Exception, match="unknown subset"):
        corpus.require_members(df, "subset", ["a"]).collect()


def test_retrieval_terms(spark):
    df = spark.createDataFrame([("The U.S.A. café & co, it's",), (None,)], "t string")
    got = [r.x for r in df.select(retrieval_terms(F.col("t")).alias("x")).collect()]
    assert got == [["usa", "cafe", "co"], []]
