"""Queries over token burstiness and distraction of attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import joined, order_key
from ..operators import analysis
from ..session import table
from . import common as c

POINTS = 900
DOC1 = 24  # places of the first document among the 64 of an embedding
BATCH = 64
LAYERS = 24
SKIP, TAKE = 100, 300


def token_hist(s, d):
    return analysis.token_histogram(c.mix(s, d), ["chunk_id"])


def _stats(s, d):
    return analysis.zipf_statistics(c.mix(s, d), ["chunk_id"])


def zipf_stats(s, d):
    return _stats(s, d).select("chunk_id", "n", F.round("log_sum", 6).alias("log_sum"))


def zipf_grid(s, d):
    return analysis.zipf_grid(_stats(s, d), ["chunk_id"])


def _masked(s, d):
    frag = analysis.fragments(c.mix(s, d))
    return analysis.zipf_statistics(frag, ["chunk_id", "fragment"])


def zipf_masked(s, d):
    """Statistics of the fit within each fragment."""
    return _masked(s, d).select("chunk_id", F.col("fragment").cast("bigint").alias("fragment"), "n", F.round("log_sum", 6).alias("log_sum"))


def zipf_summary(s, d):
    """Mean and population deviation of the exponents of all sequences."""
    return zipf_grid(s, d).agg(F.round(F.avg("exponent"), 4).alias("mean"), F.round(F.stddev_pop("exponent"), 4).alias("std"), F.count(F.lit(1)).alias("n"))


def zipf_refined(s, d):
    return analysis.zipf_refined(_stats(s, d), ["chunk_id"])


def chunk_skip_take(s, d):
    return analysis.skip_take(c.mix(s, d), F.col("chunk_id"), SKIP, TAKE).select("chunk_id")


def _attention(s, d):
    """Embeddings as attention: label is the layer, the vector's absolute values the mass on each place, in two heads."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("example"), F.col("label").alias("layer"), F.posexplode("embedding").alias("k", "x"))
    e = e.select("example", "layer", (F.col("k") % 2).alias("head"), F.floor(F.col("k") / 2).cast("int").alias("k"), F.abs(F.col("x").cast("double")).alias("weight"))
    return e.withColumn("q", F.lit(DOC1))


def attention_head_mean(s, d):
    out = analysis.attention_means(_attention(s, d))
    return out.select("example", "layer", "k", F.round("weight", 6).alias("weight"))


def _distraction(s, d):
    out = analysis.distraction(analysis.attention_means(_attention(s, d)), DOC1)
    return out.withColumn("batch", F.floor(F.col("example") / BATCH).cast("bigint"))


def distraction_sum(s, d):
    return _distraction(s, d).select("example", "layer", F.round("distraction", 6).alias("distraction"))


def _batches(s, d):
    return analysis.batch_statistics(_distraction(s, d), ["layer"], "batch", "distraction")


def distraction_batches(s, d):
    return _batches(s, d).select("layer", "batch", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def distraction_mean(s, d):
    """Mean of the batch means per layer."""
    return _batches(s, d).groupBy("layer").agg(F.round(F.avg("mean"), 6).alias("mean"))


def distraction_pooled_std(s, d):
    out = analysis.pooled(_batches(s, d), ["layer"])
    return out.select("layer", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def distraction_pooled_compat(s, d):
    out = analysis.pooled(_batches(s, d), ["layer"], compat=True)
    return out.select("layer", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def distraction_layer_weighted(s, d):
    out = analysis.layer_weighted(distraction_mean(s, d).withColumn("all", F.lit(1)), ["all"], "layer", "mean", LAYERS)
    return out.select(F.round("weighted", 5).alias("weighted"))


def distraction_baseline(s, d):
    x = s.range(0, 65).select(F.col("id").alias("x"))
    return x.select("x", F.round(analysis.uniform_baseline(F.lit(float(DOC1)), F.col("x")), 6).alias("share"))


def doc_pairs(s, d):
    """Pairs within 16 streams of each subset, so that no subset is read by one task."""
    out = analysis.document_pairs(_streams(s, d), 128, 64, [13])
    return out.select("stream", "pair_no", joined(F.col("input_ids")).alias("ids"))


def _streams(s, d):
    key = order_key(42, F.col("doc_id"))
    return c.tok(s, d).select(F.concat_ws("-", "subset", F.substring(key, 1, 1)).alias("stream"), key.alias("ord"), "token")


def doc_pairs_of_two(s, d):
    """The first document from streams of other documents (of an even id), the second from those of an odd id."""
    key = order_key(42, F.col("doc_id"))
    rows = c.tok(s, d).select(F.concat_ws("-", "subset", F.substring(key, 1, 1)).alias("stream"), key.alias("ord"), "token", "doc_id")
    out = analysis.document_pairs_of_two(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), 128, 64, [13])
    return out.select("stream", "pair_no", joined(F.col("input_ids")).alias("ids"))


def subset_token_totals(s, d):
    return c.sized(s, d).groupBy("subset").agg(F.sum("n_tokens").cast("bigint").alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        token_hist, zipf_stats, zipf_grid, zipf_masked, zipf_summary, zipf_refined, chunk_skip_take, attention_head_mean, distraction_sum,
        distraction_batches, distraction_mean, distraction_pooled_std, distraction_pooled_compat, distraction_layer_weighted,
        distraction_baseline, doc_pairs, doc_pairs_of_two, subset_token_totals,
    )
}

_HIST = c.BASE_POS.rstrip() + ", hist AS (SELECT chunk_id, id AS token, count(*) AS cnt FROM pos GROUP BY 1, 2), zs AS (SELECT chunk_id, count(*) AS n, CAST(sum(CAST(ln(cnt) AS DECIMAL(28, 12))) AS DOUBLE) AS log_sum FROM hist GROUP BY 1) "
_GRID = (
    f", g AS (SELECT CAST(round(1.01 + 0.01 * i, 6) AS DOUBLE) AS s FROM range({POINTS}) t(i)), "
    "h AS (SELECT s, sum(n ** (-s)) AS a FROM g, range(1, 30) r(n) GROUP BY 1), "
    "z AS (SELECT s, (ln(a + 30 ** (1 - s) / (s - 1) + 0.5 * 30 ** (-s) + s * 30 ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * 30 ** (-s - 3) / 720)) AS lz FROM h), "
    "fit AS (SELECT chunk_id, arg_min(s, n * lz + s * log_sum) AS exponent FROM zs, z GROUP BY 1) "
)
# the exponent to three decimals: how many half-way points have a slope of ln zeta (by a central difference) below -log_sum / n
_EM = "ln(sum(n ** (-x)) + 30 ** (1 - x) / (x - 1) + 0.5 * 30 ** (-x) + x * 30 ** (-x - 1) / 12 - x * (x + 1) * (x + 2) * 30 ** (-x - 3) / 720)"
_REFINED = (
    ", half AS (SELECT 1.0105 + 0.001 * i AS s FROM range(8990) t(i)), "
    f"lz AS (SELECT s, w, {_EM} AS v FROM (SELECT s, w, s + w * 1e-5 AS x FROM half, (VALUES (-1), (1)) v(w)), range(1, 30) r(n) GROUP BY s, w, x), "
    "slope AS (SELECT s, sum(w * v) / 2e-5 AS d FROM lz GROUP BY 1), "
    "fine AS (SELECT chunk_id, round(1.01 + 0.001 * count(*) FILTER (d < -log_sum / n), 3) AS exponent FROM zs, slope GROUP BY 1) "
)
_STREAMS = (
    "str AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ord) AS r FROM (SELECT subset || '-' || substr(md5('42-' || doc_id), 1, 1) AS stream, md5('42-' || doc_id) AS ord, list_append(token, 13) AS ids, doc_id FROM tok{where}))"
)
_PAIRS = (
    c.BASE_TOK.replace("WITH", "WITH RECURSIVE", 1).rstrip() + ", " + _STREAMS.format(where="")
    + ", go(stream, r, head, ready, made, pair) AS (SELECT DISTINCT stream, CAST(0 AS BIGINT), []::INTEGER[], false, CAST(0 AS BIGINT), NULL::INTEGER[] FROM str UNION ALL "
    "SELECT s.stream, s.r, CASE WHEN NOT ready THEN list_concat(head, ids) WHEN len(ids) > 64 THEN [] ELSE head END, CASE WHEN NOT ready THEN len(head) + len(ids) >= 128 ELSE len(ids) <= 64 END, "
    "CASE WHEN ready AND len(ids) > 64 THEN made + 1 ELSE made END, CASE WHEN ready AND len(ids) > 64 THEN list_concat(list_slice(head, -128, len(head)), list_slice(ids, 1, 64)) END "
    "FROM go JOIN str s ON s.stream = go.stream AND s.r = go.r + 1) SELECT stream, made - 1 AS pair_no, array_to_string(pair, ',') AS ids FROM go WHERE pair IS NOT NULL"
)
_PAIRS_OF_TWO = (
    c.BASE_TOK.replace("WITH", "WITH RECURSIVE", 1).rstrip() + ", " + _STREAMS.format(where=" WHERE doc_id % 2 = 0")
    + ", go(stream, r, head, done, made) AS (SELECT DISTINCT stream, CAST(0 AS BIGINT), []::INTEGER[], false, CAST(0 AS BIGINT) FROM str UNION ALL "
    "SELECT s.stream, s.r, CASE WHEN done THEN ids ELSE list_concat(head, ids) END, CASE WHEN done THEN len(ids) ELSE len(head) + len(ids) END >= 128, CASE WHEN done THEN made + 1 ELSE made END "
    "FROM go JOIN str s ON s.stream = go.stream AND s.r = go.r + 1), "
    + _STREAMS.format(where=" WHERE doc_id % 2 = 1").replace("str AS", "two AS", 1)
    + ", sec AS (SELECT stream, ids, row_number() OVER (PARTITION BY stream ORDER BY ord) - 1 AS made FROM two WHERE len(ids) > 64) "
    "SELECT go.stream, made AS pair_no, array_to_string(list_concat(list_slice(head, -128, len(head)), list_slice(ids, 1, 64)), ',') AS ids FROM go JOIN sec USING (stream, made) WHERE done"
)
_ATT = (
    "WITH e AS (SELECT vec_id AS example, label AS layer, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings), "
    "att AS (SELECT example, layer, CAST(p // 2 AS INTEGER) AS k, avg(abs(CAST(x AS DOUBLE))) AS weight FROM e GROUP BY 1, 2, 3), "
    f"dis AS (SELECT example, layer, example // {BATCH} AS batch, sum(CASE WHEN k < {DOC1} THEN weight ELSE 0 END) AS distraction FROM att GROUP BY 1, 2, 3), "
    "bat AS (SELECT layer, batch, count(*) AS n, avg(distraction) AS mean, stddev_samp(distraction) AS std FROM dis GROUP BY 1, 2) "
)

SQL = {
    "token_hist": _HIST + "SELECT chunk_id, token, cnt FROM hist",
    "zipf_stats": _HIST + "SELECT chunk_id, n, round(log_sum, 6) AS log_sum FROM zs",
    "zipf_grid": _HIST.rstrip() + _GRID + "SELECT chunk_id, exponent FROM fit",
    "zipf_refined": _HIST.rstrip() + _REFINED + "SELECT chunk_id, exponent FROM fine",
    "zipf_summary": _HIST.rstrip() + _GRID + "SELECT round(avg(exponent), 4) AS mean, round(stddev_pop(exponent), 4) AS std, count(*) AS n FROM fit",
    "zipf_masked": c.BASE_POS.rstrip()
    + ", hist AS (SELECT chunk_id, f, id, count(*) AS cnt FROM frag GROUP BY 1, 2, 3) SELECT chunk_id, CAST(f AS BIGINT) AS fragment, count(*) AS n, round(CAST(sum(CAST(ln(cnt) AS DECIMAL(28, 12))) AS DOUBLE), 6) AS log_sum FROM hist GROUP BY 1, 2",
    "chunk_skip_take": c.BASE_MIX + f"SELECT chunk_id FROM mix WHERE chunk_id >= {SKIP} AND chunk_id <= {SKIP + TAKE}",
    "attention_head_mean": _ATT + "SELECT example, layer, k, round(weight, 6) AS weight FROM att",
    "distraction_sum": _ATT + "SELECT example, layer, round(distraction, 6) AS distraction FROM dis",
    "distraction_batches": _ATT + "SELECT layer, batch, n, round(mean, 6) AS mean, round(std, 6) AS std FROM bat",
    "distraction_mean": _ATT + "SELECT layer, round(avg(mean), 6) AS mean FROM bat GROUP BY 1",
    "distraction_pooled_std": _ATT + "SELECT layer, count(*) AS n, round(avg(distraction), 5) AS mean, round(stddev_pop(distraction), 5) AS std FROM dis GROUP BY 1",
    "distraction_pooled_compat": _ATT
    + "SELECT layer, round(sum(n * mean) / sum(n), 5) AS mean, round(sqrt(sum(n * (coalesce(std, 0) ** 2 + mean ** 2)) / sum(n) - (sum(n * mean) / sum(n)) ** 2), 5) AS std FROM bat GROUP BY 1",
    "distraction_layer_weighted": _ATT.rstrip()
    + f", m AS (SELECT layer, round(avg(mean), 6) AS mean FROM bat GROUP BY 1) SELECT round(sum(mean / ({LAYERS} - layer)) / sum(1.0 / ({LAYERS} - layer)), 5) AS weighted FROM m",
    "distraction_baseline": f"SELECT CAST(x AS BIGINT) AS x, round({float(DOC1)} / ({float(DOC1)} + x), 6) AS share FROM range(65) t(x)",
    "doc_pairs": _PAIRS,
    "doc_pairs_of_two": _PAIRS_OF_TWO,
    "subset_token_totals": c.BASE_TOK + "SELECT subset, CAST(sum(len(token)) AS BIGINT) AS tokens FROM tok GROUP BY 1",
}
