"""Queries over documents, subsets, budgets, shards and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import without_bom
from ..functions.tokens import joined, with_eos
from ..operators import corpus, ordering
from ..session import small, table
from . import common as c

FEW = 5
SAMPLED = 50
WORKERS = 8


def tokenize_docs(s, d):
    return c.tok(s, d).select("doc_id", F.size("token").cast("bigint").alias("n_tokens"), joined(F.col("token")).alias("ids"))


def eos_append(s, d):
    t = with_eos(F.col("token"))
    return c.tok(s, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.element_at(t, -1).alias("last_id"))


def min_len_filter(s, d):
    return c.sized(s, d).where("n_tokens > 1").select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))


def subset_counts(s, d):
    return c.docs(s, d).groupBy("subset").agg(F.count(F.lit(1)).alias("docs"))


def subset_project(s, d):
    return table(s, d, "documents").select("doc_id", F.col("meta.redpajama_set_name").alias("set_name"), "text")


def subset_semijoin(s, d):
    named = subset_project(s, d).select("doc_id", "set_name")
    return named.join(small(c.config(s, d).select(F.col("subset").alias("set_name"))), "set_name", "left_semi").select("doc_id", "set_name")


def budget_sample(s, d):
    out = corpus.budget_sample(c.sized(s, d), c.config(s, d), c.budget(s, d), c.SEED)
    return out.select("doc_id", "subset", "chunk_cid", F.col("run_before").alias("tokens_before"))


def _sharded(s, d):
    return corpus.assign_shards(c.sized(s, d), c.config(s, d), c.budget(s, d), c.SEED)


def shard_assign(s, d):
    return _sharded(s, d).select("doc_id", "subset", "split", "internal_idx")


def shard_token_totals(s, d):
    return _sharded(s, d).groupBy("subset", "split").agg(F.sum("n_tokens").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def internal_idx(s, d):
    """New gapless numbers of the processed items in each shard, in the order of the old ones."""
    rows = c.proc(s, d).select("row_id", "subset", "split", "internal_idx")
    return corpus.renumbered(rows, ["subset", "split"], "internal_idx", "new_idx").drop("internal_idx")


def line_offsets(s, d):
    rows = c.proc(s, d).select("subset", "split", "internal_idx", "contents")
    return corpus.line_offsets(rows, ["subset", "split"], "internal_idx", "contents")


def _ranges(s, d):
    return corpus.file_ranges(c.proc(s, d), ["subset", "split"])


def row_locate(s, d):
    """Shard and line of every global row number."""
    n = c.proc(s, d).count()
    return corpus.locate(s.range(n).withColumnRenamed("id", "idx"), _ranges(s, d)).select("idx", "subset", "split", F.col("line").cast("bigint").alias("line"))


def id_continuity(s, d):
    return corpus.id_continuity(c.proc(s, d), ["subset", "split"], "internal_idx")


def hash_shuffle(s, d):
    return ordering.shuffled(c.docs(s, d).select("doc_id"), c.SEED, "doc_id")


def fewshot_sample(s, d):
    train = table(s, d, "eval_cls").where("split_name = 'train'").select("eval_id", "task", "example_idx")
    return ordering.sample(train, 42, "eval_id", FEW, ["task"])


def downsample(s, d):
    test = table(s, d, "eval_cls").where("split_name = 'test'").select("eval_id", "task", "example_idx")
    return ordering.sample(test, 666, "eval_id", SAMPLED)


def worker_stride(s, d):
    return ordering.strided(hash_shuffle(s, d), "pos", WORKERS)


def bom_strip(s, d):
    p = table(s, d, "processed")
    return p.select("row_id", without_bom(F.col("contents")).alias("contents")).where("contents is not null")


def json_roundtrip(s, d):
    """Each item written as a JSON record and read again."""
    rows = table(s, d, "processed").select("row_id", F.to_json(F.struct("subset", "split", "internal_idx")).alias("j"))
    back = F.from_json("j", "subset string, split int, internal_idx bigint")
    return rows.select("row_id", back.alias("r")).select("row_id", "r.subset", "r.split", "r.internal_idx")


def latest_delivery(s, d):
    return c.proc(s, d).select("subset", "split", "internal_idx", "row_id")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, eos_append, min_len_filter, subset_counts, subset_project, subset_semijoin, budget_sample, shard_assign,
        shard_token_totals, internal_idx, line_offsets, row_locate, id_continuity, hash_shuffle, fewshot_sample, downsample,
        worker_stride, bom_strip, json_roundtrip, latest_delivery,
    )
}

_SIZED = (
    c.BASE_TOK.rstrip() + ", sized AS (SELECT doc_id, subset, chunk_cid, len(token) AS n FROM tok), "
    f"bud AS (SELECT CAST(greatest(1, coalesce(sum(n), 0) * {c.BUDGET[0]} // {c.BUDGET[1]}) AS BIGINT) AS t FROM sized) "
)
_SHARDS = (
    _SIZED.rstrip()
    + f""", run AS (SELECT s.*, md5('{c.SEED}-' || doc_id) AS k, floor(g.weight * t)::BIGINT AS target,
    ceil(floor(g.weight * t) / g.n_splits)::BIGINT AS each_ FROM sized s JOIN corpus_config g USING (subset), bud),
    cum AS (SELECT *, row_number() OVER w - 1 AS j, coalesce(sum(n) OVER (PARTITION BY subset ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
    FROM run WINDOW w AS (PARTITION BY subset ORDER BY k, doc_id)),
    kept AS (SELECT *, greatest(0, ceil((bef + n) / each_) - 1) - j AS lead_ FROM cum WHERE j = 0 OR bef <= target),
    spl AS (SELECT doc_id, subset, n, j, CAST(CASE WHEN j = 0 THEN 0 ELSE least(j, j - 1 + min(lead_) OVER (PARTITION BY subset ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS INTEGER) AS split FROM kept) """
)

SQL = {
    "tokenize_docs": c.BASE_TOK + "SELECT doc_id, CAST(len(token) AS BIGINT) AS n_tokens, array_to_string(token, ',') AS ids FROM tok",
    "eos_append": c.BASE_TOK + "SELECT doc_id, CAST(len(token) + 1 AS BIGINT) AS n_tokens, CAST(2 AS INTEGER) AS last_id FROM tok",
    "min_len_filter": c.BASE_TOK + "SELECT doc_id, CAST(len(token) AS BIGINT) AS n_tokens FROM tok WHERE len(token) > 1",
    "subset_counts": c.with_(c.DOCS) + "SELECT subset, count(*) AS docs FROM docs GROUP BY 1",
    "subset_project": "SELECT doc_id, meta.redpajama_set_name AS set_name, text FROM documents",
    "subset_semijoin": "SELECT doc_id, meta.redpajama_set_name AS set_name FROM documents WHERE meta.redpajama_set_name IN (SELECT subset FROM corpus_config)",
    "budget_sample": _SIZED.rstrip()
    + f""", cum AS (SELECT s.doc_id, s.subset, s.chunk_cid, floor(g.weight * t / 10)::BIGINT AS target,
    row_number() OVER (PARTITION BY s.subset, s.chunk_cid ORDER BY md5('{c.SEED}-' || doc_id), doc_id) AS j,
    coalesce(sum(n) OVER (PARTITION BY s.subset, s.chunk_cid ORDER BY md5('{c.SEED}-' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
    FROM sized s JOIN corpus_config g USING (subset), bud) SELECT doc_id, subset, chunk_cid, CAST(bef AS BIGINT) AS tokens_before FROM cum WHERE j = 1 OR bef < target""",
    "shard_assign": _SHARDS + "SELECT doc_id, subset, split, CAST(row_number() OVER (PARTITION BY subset, split ORDER BY j) - 1 AS BIGINT) AS internal_idx FROM spl",
    "shard_token_totals": _SHARDS + "SELECT subset, split, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS docs FROM spl GROUP BY 1, 2",
    "internal_idx": c.with_(c.PROC) + "SELECT row_id, subset, split, CAST(row_number() OVER (PARTITION BY subset, split ORDER BY internal_idx) - 1 AS BIGINT) AS new_idx FROM proc",
    "line_offsets": c.with_(c.PROC)
    + "SELECT subset, split, internal_idx, CAST(coalesce(sum(coalesce(strlen(contents), 0) + 1) OVER (PARTITION BY subset, split ORDER BY internal_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM proc",
    "row_locate": c.with_(c.PROC)
    + "SELECT CAST(row_number() OVER (ORDER BY subset, split, internal_idx) - 1 AS BIGINT) AS idx, subset, split, CAST(row_number() OVER (PARTITION BY subset, split ORDER BY internal_idx) - 1 AS BIGINT) AS line FROM proc",
    "id_continuity": c.with_(c.PROC).rstrip()
    + ", e AS (SELECT subset, split, min(internal_idx) AS first_id, max(internal_idx) AS last_id FROM proc GROUP BY 1, 2) SELECT *, first_id = coalesce(lag(last_id) OVER (ORDER BY subset, split), -1) + 1 AS continuous FROM e",
    "hash_shuffle": c.with_(c.DOCS) + f"SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('{c.SEED}-' || doc_id), doc_id) - 1 AS BIGINT) AS pos FROM docs",
    "fewshot_sample": f"SELECT eval_id, task, example_idx FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('42-' || eval_id), eval_id) AS r FROM eval_cls WHERE split_name = 'train') WHERE r <= {FEW}",
    "downsample": f"SELECT eval_id, task, example_idx FROM eval_cls WHERE split_name = 'test' ORDER BY md5('666-' || eval_id), eval_id LIMIT {SAMPLED}",
    "worker_stride": c.with_(c.DOCS).rstrip()
    + f", p AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('{c.SEED}-' || doc_id), doc_id) - 1 AS BIGINT) AS pos FROM docs) SELECT *, CAST(pos % {WORKERS} AS INTEGER) AS worker, pos // {WORKERS} AS worker_pos FROM p",
    "bom_strip": "SELECT row_id, replace(contents, chr(65279), '') AS contents FROM processed WHERE contents IS NOT NULL",
    "json_roundtrip": "SELECT row_id, subset, split, internal_idx FROM processed",
    "latest_delivery": c.with_(c.PROC) + "SELECT subset, split, internal_idx, row_id FROM proc",
}
