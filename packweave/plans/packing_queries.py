"""Queries over packed sequences, fragments, batches and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import joined, with_eos
from ..operators import blend, packing
from ..session import small, table
from . import common as c

PART = 64
PAD_L = 256
BATCH = 8
PER_DIR = 4
CU_BATCH = 4


def _shown(df, *keys):
    return df.select(*[F.col(k) for k in keys], joined(F.col("input_ids")).alias("ids"))


def mixchunk(s, d):
    return _shown(c.mix(s, d), "chunk_id")


def unichunk(s, d):
    return _shown(c.uni(s, d), "subset", "chunk_id")


def chunk_token_totals(s, d):
    """Per subset: full sequences, tokens in them and tokens left over."""
    have = c.eos_docs(s, d).groupBy("subset").agg(F.sum("n_tokens").cast("bigint").alias("all_tokens"))
    made = c.uni(s, d).groupBy("subset").agg(F.count(F.lit(1)).alias("chunks"))
    out = have.join(made, "subset", "left").fillna(0, ["chunks"])
    return out.withColumn("tokens", F.col("chunks") * c.L).withColumn("dropped", F.col("all_tokens") - F.col("tokens"))


def chunk_doc_spans(s, d):
    spans = packing.document_spans(c.eos_docs(s, d).drop("subset"), c.L, c.SEED)
    return spans.select("chunk_id", "doc_id", F.col("at").cast("bigint").alias("at"), F.size("piece").cast("bigint").alias("n"))


def pad_chunks(s, d):
    rows = table(s, d, "processed").select("row_id", with_eos(F.col("token")).alias("token"))
    out = packing.pad_chunks(rows, PAD_L)
    return out.select("row_id", "piece_no", joined(F.col("input_ids")).alias("ids"), joined(F.col("labels")).alias("labels"))


def rechunk(s, d):
    out = packing.with_fragments(packing.rechunk(c.mix(s, d), PART))
    return out.select("chunk_id", "part", joined(F.col("input_ids")).alias("ids"), joined(F.col("fragment_lens")).alias("lens"))


def fragment_lens(s, d):
    out = packing.with_fragments(c.mix(s, d))
    return out.select("chunk_id", joined(F.col("fragment_lens")).alias("lens"), F.col("fragment_nums").cast("bigint").alias("n"))


def fragment_count_filter(s, d):
    return packing.few_fragments(c.mix(s, d), 2).select("chunk_id")


def fragment_pad(s, d):
    out = packing.with_fragments(c.mix(s, d))
    return out.select("chunk_id", joined(packing.pad_fragments(F.col("fragment_lens"))).alias("lens"))


def _cu(s, d):
    return packing.cumulative_boundaries(c.mix(s, d), F.floor(F.col("chunk_id") / CU_BATCH).cast("bigint"))


def cu_seqlens(s, d):
    return _cu(s, d).select("batch", joined(F.col("cu_seqlens")).alias("cu"))


def max_seqlen(s, d):
    return _cu(s, d).select("batch", F.col("max_seqlen").cast("bigint").alias("max_seqlen"))


def _padded(s, d):
    rows = table(s, d, "processed").select("row_id", with_eos(F.col("token")).alias("token"))
    return packing.pad_chunks(rows, PART)


def position_ids(s, d):
    mask = F.transform("input_ids", lambda x: (x != 0).cast("int"))
    return _padded(s, d).select("row_id", "piece_no", joined(packing.position_ids(mask)).alias("positions"))


def label_shift(s, d):
    return c.mix(s, d).select("chunk_id", joined(packing.shifted_labels(F.col("input_ids"))).alias("targets"))


def intra_doc_mask_pairs(s, d):
    return packing.mask_pairs(c.mix(s, d)).select("chunk_id", "pairs")


def causal_pairs(s, d):
    """Allowed attention pairs of padded sequences."""
    valid = F.transform("input_ids", lambda x: (x != 0).cast("int"))
    return _padded(s, d).select("row_id", "piece_no", packing.causal_valid_pairs(F.size("input_ids"), valid).alias("pairs"))


def last_token(s, d):
    return _padded(s, d).select("row_id", "piece_no", packing.last_token_index(F.col("input_ids")).cast("bigint").alias("last_idx"))


def batch_numbering(s, d):
    chunks = c.mix(s, d).select("chunk_id")
    total = packing.full_chunks(c.eos_docs(s, d).select("n_tokens"), c.L).withColumnRenamed("n_chunks", "_n")  # from sizes alone
    rows = chunks.withColumn("_k", F.lit(0)).join(small(total.withColumn("_k", F.lit(0))), "_k").drop("_k")  # one row
    out = packing.batched(rows, "chunk_id", F.col("_n"), BATCH, PER_DIR)
    return out.select("chunk_id", "batch_idx", "dir_idx", "pos_in_batch", "path")


def combine_renumber(s, d):
    """Batches of every shard, renumbered without gaps per subset."""
    rows = c.proc(s, d).select("subset", "split", F.floor(F.col("internal_idx") / BATCH).cast("bigint").alias("batch_idx")).distinct()
    rows = rows.withColumn("dir_idx", F.floor(F.col("batch_idx") / PER_DIR).cast("int"))
    return packing.combine_batches(rows, ["subset"], ["split", "dir_idx", "batch_idx"])


def saved_gap(s, d):
    """Stored batches up to the first missing one; the batches of the third directory are missing here."""
    have = batch_numbering(s, d).where("dir_idx <> 2").select("batch_idx", "chunk_id")
    return packing.without_gaps(have)


def blend_quota(s, d):
    return blend.quotas(c.config(s, d), _n_blend(s, d)).select("subset_idx", "subset", "quota")


def _n_blend(s, d):
    """Sequences to blend: as many as all tokens fill."""
    return packing.full_chunks(c.eos_docs(s, d).select("n_tokens"), c.L).first().n_chunks


def _order(s, d):
    return blend.blend_order(c.config(s, d), _n_blend(s, d), 666)


def blend_order(s, d):
    return _order(s, d)


def _blended(s, d):
    return blend.blend(_order(s, d), c.uni(s, d))


def blend_join(s, d):
    return _shown(_blended(s, d), "pos", "subset", "occ")


def blend_workers(s, d):
    """The blend with four workers, each ending by itself."""
    return blend.blend(_order(s, d), c.uni(s, d), 4).select("worker", "pos", "subset", "occ")


def blend_mix_report(s, d):
    """Expected and obtained shares of the finished blend, which ends early where a subset runs out."""
    return blend.mix_report(_blended(s, d).select("subset"), c.config(s, d)).select("subset", "weight", "obtained", "share")


def stored_shards(s, d):
    """Stored sequences dealt to workers before those with many fragments are passed over."""
    return packing.worker_items(c.mix(s, d), "chunk_id", 4, 2).select("chunk_id", "worker", "worker_pos")


QUERIES = {
    f.__name__: f
    for f in (
        mixchunk, unichunk, chunk_token_totals, chunk_doc_spans, pad_chunks, rechunk, fragment_lens, fragment_count_filter, fragment_pad,
        cu_seqlens, max_seqlen, position_ids, label_shift, intra_doc_mask_pairs, causal_pairs, last_token, batch_numbering, combine_renumber,
        saved_gap, stored_shards, blend_quota, blend_order, blend_join, blend_workers, blend_mix_report,
    )
}

_PADDED = (
    "src AS (SELECT row_id, list_append(coalesce(token, []::INTEGER[]), 2) AS t FROM processed), "
    "pcs AS (SELECT row_id, CAST(unnest(range(0, (len(t) - 1) // {n} + 1)) AS INTEGER) AS piece_no, t FROM src), "
    "raw AS (SELECT row_id, piece_no, list_slice(t, piece_no * {n} + 1, (piece_no + 1) * {n}) AS x FROM pcs), "
    "pad AS (SELECT row_id, piece_no, x, list_concat(x, list_transform(range(len(x), {n}), lambda i: 0::INTEGER)) AS ids FROM raw WHERE len(x) = {n} OR len(x) > 1)"
)
_ORDER = (
    f"nb AS (SELECT CAST(coalesce(sum(len(token)), 0) // {c.L} AS BIGINT) AS total FROM eos), "
    "q AS (SELECT subset_idx, subset, CAST(round_even(weight * total + 1, 0) AS BIGINT) AS quota FROM corpus_config, nb), "
    "req AS (SELECT subset_idx, subset, CAST(unnest(range(0, quota)) AS BIGINT) AS k FROM q), "
    f"ord AS (SELECT subset_idx, subset, row_number() OVER (ORDER BY md5('666-' || subset_idx || '-' || k), subset_idx, k) - 1 AS pos FROM req), "
    f"bl AS (SELECT CAST(pos AS BIGINT) AS pos, subset_idx, subset, CAST(row_number() OVER (PARTITION BY subset ORDER BY pos) - 1 AS BIGINT) AS occ FROM ord WHERE pos < (SELECT total FROM nb))"
)
_PAD_ROWS = c.with_(_PADDED.format(n=PART)) + ", pp AS (SELECT row_id, piece_no, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM pad) "
_PAD_ROWS = _PAD_ROWS.replace(" , pp", ", pp")
_BATCHED = (
    c.BASE_MIX.rstrip()
    + f", bt AS (SELECT chunk_id, chunk_id // {BATCH} AS batch_idx, CAST(chunk_id // {BATCH * PER_DIR} AS INTEGER) AS dir_idx, CAST(chunk_id % {BATCH} AS INTEGER) AS pos_in_batch FROM mix "
    f"WHERE chunk_id // {BATCH} < (SELECT count(*) FROM mix) // {BATCH}) "
)

SQL = {
    "mixchunk": c.BASE_MIX + "SELECT chunk_id, array_to_string(ids, ',') AS ids FROM mix",
    "unichunk": c.BASE_UNI + "SELECT subset, chunk_id, array_to_string(ids, ',') AS ids FROM uni",
    "chunk_token_totals": c.with_(c.DOCS, c.TOK, c.EOS)
    + f"SELECT subset, CAST(sum(len(token)) AS BIGINT) AS all_tokens, CAST(sum(len(token)) // {c.L} AS BIGINT) AS chunks, CAST(sum(len(token)) // {c.L} * {c.L} AS BIGINT) AS tokens, CAST(sum(len(token)) % {c.L} AS BIGINT) AS dropped FROM eos GROUP BY 1",
    "chunk_doc_spans": c.BASE_MIX + f"SELECT r // {c.L} AS chunk_id, doc_id, min(r) % {c.L} AS at, count(*) AS n FROM num GROUP BY 1, 2",
    "pad_chunks": c.with_(_PADDED.format(n=PAD_L))
    + f"SELECT row_id, piece_no, array_to_string(ids, ',') AS ids, array_to_string(list_concat(x, list_transform(range(len(x), {PAD_L}), lambda i: -100)), ',') AS labels FROM pad",
    "rechunk": c.BASE_POS
    + f""", part AS (SELECT chunk_id, CAST((p - 1) // {PART} AS INTEGER) AS part, p, id FROM pos),
    f2 AS (SELECT *, coalesce(sum(CASE WHEN id = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id, part ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM part),
    l2 AS (SELECT chunk_id, part, f, count(*) AS n FROM f2 GROUP BY 1, 2, 3),
    a AS (SELECT chunk_id, part, string_agg(id, ',' ORDER BY p) AS ids FROM part GROUP BY 1, 2), b AS (SELECT chunk_id, part, string_agg(n, ',' ORDER BY f) AS lens FROM l2 GROUP BY 1, 2)
    SELECT chunk_id, part, ids, lens FROM a JOIN b USING (chunk_id, part)""",
    "fragment_lens": c.BASE_POS + "SELECT chunk_id, string_agg(n, ',' ORDER BY f) AS lens, count(*) AS n FROM lens GROUP BY 1",
    "fragment_count_filter": c.BASE_MIX + "SELECT chunk_id FROM mix WHERE len(list_filter(ids, lambda x: x = 2)) <= 2",
    "fragment_pad": c.BASE_POS
    + ", a AS (SELECT chunk_id, list(n ORDER BY f) AS l FROM lens GROUP BY 1) SELECT chunk_id, array_to_string(list_concat(l, list_transform(range(len(l), 66), lambda i: -1)), ',') AS lens FROM a",
    "cu_seqlens": c.BASE_POS
    + f""", cum AS (SELECT chunk_id // {CU_BATCH} AS batch, chunk_id, f, sum(n) OVER (PARTITION BY chunk_id // {CU_BATCH} ORDER BY chunk_id, f) AS e FROM lens)
    SELECT batch, '0,' || string_agg(e, ',' ORDER BY chunk_id, f) AS cu FROM cum GROUP BY 1""",
    "max_seqlen": c.BASE_POS + f"SELECT chunk_id // {CU_BATCH} AS batch, max(n) AS max_seqlen FROM lens GROUP BY 1",
    "position_ids": _PAD_ROWS
    + ", cs AS (SELECT row_id, piece_no, p, id, sum(CASE WHEN id <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, piece_no ORDER BY p) AS n FROM pp) SELECT row_id, piece_no, string_agg(CAST(CASE WHEN id = 0 THEN 1 ELSE n - 1 END AS BIGINT), ',' ORDER BY p) AS positions FROM cs GROUP BY 1, 2",
    "label_shift": c.BASE_MIX + f"SELECT chunk_id, array_to_string(list_slice(ids, 2, {c.L}), ',') AS targets FROM mix",
    "intra_doc_mask_pairs": c.BASE_POS
    + ", o AS (SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id, f ORDER BY p) AS within FROM frag) SELECT chunk_id, CAST(sum(within) AS BIGINT) AS pairs FROM o GROUP BY 1",
    "causal_pairs": _PAD_ROWS + f"SELECT row_id, piece_no, CAST(sum(CASE WHEN id <> 0 THEN {PART} - p + 1 ELSE 0 END) AS BIGINT) AS pairs FROM pp GROUP BY 1, 2",
    "last_token": _PAD_ROWS + "SELECT row_id, piece_no, CAST(count(*) FILTER (id <> 0) - 1 AS BIGINT) AS last_idx FROM pp GROUP BY 1, 2",
    "batch_numbering": _BATCHED + "SELECT *, printf('%05d/%08d.pt', dir_idx, batch_idx) AS path FROM bt",
    "combine_renumber": c.with_(c.PROC).rstrip()
    + f""", b AS (SELECT DISTINCT subset, split, internal_idx // {BATCH} AS batch_idx, CAST(internal_idx // {BATCH * PER_DIR} AS INTEGER) AS dir_idx FROM proc)
    SELECT *, CAST(dense_rank() OVER (PARTITION BY subset ORDER BY split, dir_idx, batch_idx) - 1 AS BIGINT) AS new_batch FROM b""",
    "saved_gap": _BATCHED + f"SELECT batch_idx, chunk_id FROM bt WHERE batch_idx < {2 * PER_DIR}",
    "blend_quota": c.with_(c.DOCS, c.TOK, c.EOS, _ORDER) + "SELECT subset_idx, subset, quota FROM q",
    "blend_order": c.with_(c.DOCS, c.TOK, c.EOS, _ORDER) + "SELECT pos, subset_idx, subset, occ FROM bl",
    "blend_join": c.with_(c.DOCS, c.TOK, c.EOS, c.UNI, _ORDER)
    + ", j AS (SELECT bl.*, u.ids FROM bl LEFT JOIN uni u ON u.subset = bl.subset AND u.chunk_id = bl.occ) SELECT pos, subset, occ, array_to_string(ids, ',') AS ids FROM j WHERE pos < coalesce((SELECT min(pos) FROM j WHERE ids IS NULL), 1000000000000)",
    "blend_workers": c.with_(c.DOCS, c.TOK, c.EOS, c.UNI, _ORDER)
    + ", j AS (SELECT bl.*, CAST(pos % 4 AS INTEGER) AS worker, u.ids FROM bl LEFT JOIN uni u ON u.subset = bl.subset AND u.chunk_id = bl.occ), e AS (SELECT worker, min(pos) AS stop FROM j WHERE ids IS NULL GROUP BY 1) "
    "SELECT worker, pos, subset, occ FROM j LEFT JOIN e USING (worker) WHERE stop IS NULL OR pos < stop",
    "stored_shards": c.BASE_MIX + "SELECT chunk_id, CAST(chunk_id % 4 AS INTEGER) AS worker, chunk_id // 4 AS worker_pos FROM mix WHERE len(list_filter(ids, lambda x: x = 2)) <= 2",
    "blend_mix_report": c.with_(c.DOCS, c.TOK, c.EOS, c.UNI, _ORDER)
    + f", j AS (SELECT bl.pos, bl.subset, u.ids FROM bl LEFT JOIN uni u ON u.subset = bl.subset AND u.chunk_id = bl.occ), n AS (SELECT subset, count(*) AS obtained FROM j WHERE pos < coalesce((SELECT min(pos) FROM j WHERE ids IS NULL), 1000000000000) GROUP BY 1) SELECT g.subset, weight, coalesce(obtained, 0) AS obtained, coalesce(round(coalesce(obtained, 0) / nullif((SELECT sum(obtained) FROM n), 0), 6), 0.0) AS share FROM corpus_config g LEFT JOIN n USING (subset)",
}
