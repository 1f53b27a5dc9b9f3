"""Inputs and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SEED_CORPUS, TEST_CHUNK
from ..functions.tokens import hash_tokens, with_eos, words
from ..operators import corpus, packing
from ..session import table

L = TEST_CHUNK
SEED = SEED_CORPUS
#: Budgets are this part of what the documents hold, as a fraction.
BUDGET = (4, 5)


def config(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_config")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with ``subset``, found by the number in ``source``."""
    return corpus.with_subset(table(spark, d, "documents").select("doc_id", "text", "source", "chunk_cid"), config(spark, d))


def tok(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokenized(docs(spark, d)).select("doc_id", "subset", "chunk_cid", "token")


def sized(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "subset", "chunk_cid", F.size(words(F.col("text"))).alias("n_tokens"))


def budget(spark: SparkSession, d: str) -> int:
    """The token budget of sampling and sharding: BUDGET of all words, at least 1."""
    total = sized(spark, d).agg(F.sum("n_tokens")).first()[0] or 0
    return max(1, total * BUDGET[0] // BUDGET[1])


def eos_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with end marks; their sizes come from the words alone, without hashing them."""
    size = (F.size(words(F.col("text"))) + 1).alias("n_tokens")
    return docs(spark, d).select("doc_id", "subset", size, with_eos(hash_tokens(F.col("text"))).alias("token"))


def mix(spark: SparkSession, d: str) -> DataFrame:
    return packing.concat_chunks(eos_docs(spark, d).drop("subset"), L, SEED)


def uni(spark: SparkSession, d: str) -> DataFrame:
    return packing.concat_chunks(eos_docs(spark, d), L, SEED, ["subset"])


def proc(spark: SparkSession, d: str) -> DataFrame:
    """The processed shards, each item's last delivery."""
    return corpus.latest_delivery(table(spark, d, "processed"))


DOCS = (
    "docs AS (SELECT d.doc_id, d.text, d.chunk_cid, c.subset, c.subset_idx FROM documents d "
    "JOIN corpus_config c ON TRY_CAST(substr(d.source, 4) AS BIGINT) % 7 = c.subset_idx)"
)
TOK = (
    "tok AS (SELECT doc_id, subset, chunk_cid, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n]+'), "
    "lambda x: x <> ''), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 31986 + 14 AS INTEGER)) AS token FROM docs)"
)
EOS = "eos AS (SELECT doc_id, subset, list_append(token, 2) AS token FROM tok)"
MIX = (
    f"flat AS (SELECT md5('{SEED}-' || doc_id) AS k, doc_id, unnest(token) AS tid, generate_subscripts(token, 1) AS p FROM eos), "
    "num AS (SELECT tid, doc_id, row_number() OVER (ORDER BY k, doc_id, p) - 1 AS r FROM flat), "
    f"mix AS (SELECT r // {L} AS chunk_id, list(tid ORDER BY r) AS ids FROM num GROUP BY 1 HAVING count(*) = {L})"
)
UNI = (
    f"uflat AS (SELECT subset, md5('{SEED}-' || doc_id) AS k, doc_id, unnest(token) AS tid, generate_subscripts(token, 1) AS p FROM eos), "
    "unum AS (SELECT subset, tid, row_number() OVER (PARTITION BY subset ORDER BY k, doc_id, p) - 1 AS r FROM uflat), "
    f"uni AS (SELECT subset, r // {L} AS chunk_id, list(tid ORDER BY r) AS ids FROM unum GROUP BY 1, 2 HAVING count(*) = {L})"
)
PROC = (
    "proc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY subset, split, internal_idx "
    "ORDER BY coalesce(written_at, TIMESTAMPTZ '1900-01-01 00:00:00+00') DESC, row_id DESC) AS rn FROM processed) WHERE rn = 1)"
)
# positions of a sequence with the number of end marks before each
POS = (
    "pos AS (SELECT chunk_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM mix), "
    "frag AS (SELECT chunk_id, id, p, coalesce(sum(CASE WHEN id = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY p "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM pos), "
    "lens AS (SELECT chunk_id, f, count(*) AS n FROM frag GROUP BY 1, 2)"
)


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


BASE_TOK = with_(DOCS, TOK)
BASE_MIX = with_(DOCS, TOK, EOS, MIX)
BASE_UNI = with_(DOCS, TOK, EOS, UNI)
BASE_POS = with_(DOCS, TOK, EOS, MIX, POS)
