"""Queries over the lexical index, search and retrieval packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TEST_BUFFER, TEST_QUERY_TERMS
from ..functions.text import MARKED, PLAIN, STOPWORDS, retrieval_terms, stemmed_terms
from ..functions.tokens import joined
from ..operators import retrieval, retrieval_packing
from ..session import stage
from . import common as c

K = 10
QSEED = 666
EVERY = 100  # queries are the rows whose id is divisible by this


def collection(s, d, stem: bool = False):
    """Documents as (shard, doc, terms, chunk_cid); each subset is a shard."""
    terms = retrieval_terms(F.col("text"))
    rows = c.docs(s, d).select(F.col("subset").alias("shard"), F.col("doc_id").alias("doc"), "chunk_cid", (stemmed_terms(terms) if stem else terms).alias("terms"))
    return rows


def _asked(rows):
    queries = rows.where(F.col("doc") % EVERY == 0).select("shard", F.col("doc").alias("query"), "terms", "chunk_cid")
    return retrieval.query_terms(queries, TEST_QUERY_TERMS, QSEED)


def postings(s, d):
    return retrieval.build_index(collection(s, d)).postings.select("shard", "term", "doc", F.col("tf").cast("bigint").alias("tf"))


def doc_freq(s, d):
    return retrieval.build_index(collection(s, d)).terms


def doc_len_stats(s, d):
    index = retrieval.build_index(collection(s, d))
    return index.docs.select("shard", "doc", F.col("dl").cast("bigint").alias("dl"), F.round("rel_dl", 6).alias("rel_dl"))


def query_term_cap(s, d):
    return _asked(collection(s, d)).select("shard", "query", F.col("place").cast("bigint").alias("place"), "term")


def _search(s, d, method="bm25", stem=False, restricted=False):
    rows = stage(collection(s, d, stem), "terms")  # texts are read and cut into terms once
    keep = ["chunk_cid"] if restricted else []  # documents of the query's own source chunk
    hits = retrieval.search(retrieval.build_index(rows, keep), _asked(rows), K, method, within=keep)
    return hits.select("shard", "query", F.col("rank").cast("bigint").alias("rank"), "doc", "score")


def bm25_topk(s, d):
    return _search(s, d)


def bm25_topk_subset(s, d):
    return _search(s, d, restricted=True)


def tfidf_topk(s, d):
    return _search(s, d, "tfidf")


def bm25_topk_stemmed(s, d):
    return _search(s, d, stem=True)


def _packed(s, d, **settings):
    cfg = retrieval_packing.PackingConfig(length=c.L, buffer=TEST_BUFFER, query_terms=TEST_QUERY_TERMS, **settings)
    shards = c.proc(s, d).select("subset", "split", "internal_idx", "token", retrieval_terms(F.col("contents")).alias("terms"))
    out = retrieval_packing.retrieval_chunks(shards, cfg)
    return out.select("subset", "split", "chunk_seq", joined(F.col("input_ids")).alias("ids"), joined(F.col("docs")).alias("docs"))


def bm25chunk_star(s, d):
    return _packed(s, d)


def bm25chunk_star_compat(s, d):
    return _packed(s, d, compat=True)


def bm25chunk_chain(s, d):
    return _packed(s, d, mode="chain")


def bm25chunk_chain_shuffled(s, d):
    return _packed(s, d, mode="chain", chains=2)


def bm25chunk_chain_drop(s, d):
    return _packed(s, d, mode="chain", drop_mid=True)


QUERIES = {
    f.__name__: f
    for f in (
        postings, doc_freq, doc_len_stats, query_term_cap, bm25_topk, bm25_topk_subset, tfidf_topk, bm25_topk_stemmed, bm25chunk_star,
        bm25chunk_star_compat, bm25chunk_chain, bm25chunk_chain_shuffled, bm25chunk_chain_drop,
    )
}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TERMS = (
    c.DOCS,
    f"""cln AS (SELECT subset AS shard, doc_id AS doc, chunk_cid, regexp_replace(regexp_replace(translate(regexp_replace(lower(coalesce(text, '')), '&', ' and ', 'g'),
    '{MARKED}', '{PLAIN}'), '\\b([a-z])\\.([a-z])\\.([a-z])?\\.?', '\\1\\2\\3', 'g'), '[!-/:-@\\[-`{{-~]', ' ', 'g') AS t FROM docs)""",
    f"col AS (SELECT shard, doc, chunk_cid, list_filter(string_split_regex(t, '[ \t\r\n]+'), lambda x: x <> '' AND x NOT IN ({_STOP})) AS terms FROM cln)",
    "post AS (SELECT shard, doc, term, count(*) AS tf FROM (SELECT shard, doc, unnest(terms) AS term FROM col) GROUP BY 1, 2, 3)",
    "dfs AS (SELECT shard, term, count(*) AS df FROM post GROUP BY 1, 2)",
    "shs AS (SELECT shard, count(*) AS n, sum(len(terms)) / count(*) AS avgdl FROM col GROUP BY 1)",
    "dls AS (SELECT shard, doc, len(terms) AS dl, len(terms) / avgdl AS rel_dl FROM col JOIN shs USING (shard))",
    f"""qt AS (SELECT shard, query, place, term FROM (SELECT *, row_number() OVER (PARTITION BY shard, query ORDER BY md5('{QSEED}-' || query || '-' || place || '-' || term), place) AS r
    FROM (SELECT shard, doc AS query, generate_subscripts(terms, 1) - 1 AS place, unnest(terms) AS term FROM col WHERE doc % {EVERY} = 0)) WHERE r <= {TEST_QUERY_TERMS})""",
    "qf AS (SELECT shard, query, term, count(*) AS qtf FROM qt GROUP BY 1, 2, 3)",
)
_HITS = "hit AS (SELECT q.shard, q.query, p.doc, q.qtf, p.tf, f.df, s.n, l.rel_dl FROM qf q JOIN post p USING (shard, term) JOIN dfs f USING (shard, term) JOIN shs s USING (shard) JOIN dls l ON l.shard = q.shard AND l.doc = p.doc{more})"
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * rel_dl))"
_TFIDF = "tf * ln(n / df)"
_TOP = (
    "sc AS (SELECT shard, query, doc, round(CAST(sum(CAST(qtf * {w} AS DECIMAL(24, 9))) AS DOUBLE), 6) AS score FROM hit GROUP BY 1, 2, 3), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY shard, query ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0) "
    "SELECT shard, query, rank, doc, score FROM rk WHERE rank <= " + str(K)
)


def _top(weight: str, more: str = "") -> str:
    return c.with_(*_TERMS, _HITS.format(more=more)).rstrip() + ", " + _TOP.format(w=weight)


SQL = {
    "postings": c.with_(*_TERMS) + "SELECT shard, term, doc, tf FROM post",
    "doc_freq": c.with_(*_TERMS) + "SELECT shard, term, df FROM dfs",
    "doc_len_stats": c.with_(*_TERMS) + "SELECT shard, doc, CAST(dl AS BIGINT) AS dl, round(rel_dl, 6) AS rel_dl FROM dls",
    "query_term_cap": c.with_(*_TERMS) + "SELECT shard, query, place, term FROM qt",
    "bm25_topk": _top(_BM25),
    "tfidf_topk": _top(_TFIDF),
    "bm25_topk_subset": _top(_BM25, " JOIN col a ON a.shard = q.shard AND a.doc = q.query JOIN col b ON b.shard = q.shard AND b.doc = p.doc AND a.chunk_cid = b.chunk_cid AND a.doc <> b.doc"),
}
