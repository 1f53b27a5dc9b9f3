"""Lexical index and search, all shards in one job. The index is three tables: postings, documents, shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BM25_B, BM25_K1
from ..functions.text import term_counts
from ..functions.tokens import order_key
from ..session import small

SCORE = "decimal(24,9)"


@dataclass
class Index:
    postings: DataFrame  # shard, term, doc, tf, dl, and the columns kept
    docs: DataFrame  # shard, doc, dl, rel_dl
    shards: DataFrame  # shard, n_docs, avgdl
    terms: DataFrame  # shard, term, df
    texts: DataFrame | None = None  # shard, doc, terms; where it is missing, the postings give it

    def save(self, path: str) -> None:
        for name in ("postings", "docs", "shards", "terms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "docs", "shards", "terms")])


def build_index(collection: DataFrame, keep: list[str] | None = None) -> Index:
    """Index ``collection`` (shard, doc, terms); a document with no terms counts with length 0.

    A document's terms are counted within its row, so postings need no shuffle and a frequent term or large shard is
    never gathered; they carry the document's length and the columns ``keep``. Only document frequencies are shuffled,
    added up in each task before.
    """
    keep = keep or []
    counted = collection.select("shard", "doc", *keep, F.size("terms").cast("int").alias("dl"), F.explode(term_counts("terms")).alias("_t"))
    postings = counted.select("shard", "_t.term", "doc", "_t.tf", "dl", *keep)
    lens = collection.select("shard", "doc", F.size("terms").cast("int").alias("dl"))
    shards = lens.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    docs = lens.join(small(shards.select("shard", "avgdl")), "shard").select("shard", "doc", "dl", (F.col("dl") / F.col("avgdl")).alias("rel_dl"))
    once = collection.select("shard", F.explode(F.array_distinct("terms")).alias("term"))
    terms = once.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df"))
    return Index(postings, docs, shards, terms, collection.select("shard", "doc", "terms"))


def query_terms(queries: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` terms of each query (shard, query, terms, other columns), chosen by a fixed hash of place and term."""
    keep = [c for c in queries.columns if c not in ("shard", "query", "terms")]
    rows = queries.select("shard", "query", *keep, F.posexplode("terms").alias("place", "term"))
    key = order_key(seed, F.col("query"), F.col("place"), F.col("term"))
    rank = F.row_number().over(Window.partitionBy("shard", "query").orderBy("_key", "place"))
    return rows.withColumn("_key", key).withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r", "_key")


def _bm25(idf, tf, rel_dl, k1: float = BM25_K1, b: float = BM25_B):
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * rel_dl))


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, df: Column, n: Column, rel_dl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    return _bm25(bm25_idf(df, n), tf, rel_dl, k1, b)


def tfidf_weight(tf: Column, df: Column, n: Column) -> Column:
    return tf * F.log(n / df)


#: A term's postings are spread over so many parts of the join; each asked term is repeated for every one.
SALTS = 16

#: About so many terms of a shard's documents are held at once to be scored.
BLOCK_TERMS = 1 << 20

#: About so many bytes of rows are held at once to be packed.
PACK_BYTES = 16 << 20


def search(
    index: Index, asked: DataFrame, k: int, method: str = "bm25", candidates: DataFrame | None = None, within: list[str] | None = None, salts: int = SALTS
) -> DataFrame:
    """The ``k`` best documents per query of its own shard, with rank and score; ties go to the lower document.

    ``asked``: (shard, query, term), a term counting as often as it stands there. ``candidates`` (shard, query, doc)
    restricts the documents; postings of no candidate are left out before they meet the queries. ``within``: columns of
    ``asked`` that the index keeps; only other documents that have them equal are looked at. Frequencies and lengths stay
    those of the whole shard. Only documents with a score above 0 are hits. Scores are added as decimals, so the order of
    addition doesn't matter.

    Without a restriction nearly every document shares a term with nearly every query, so pairs of them never become
    rows: the documents of a shard are dealt to blocks of about BLOCK_TERMS terms, a block meets all queries of its shard
    and gives the ``k`` best for each; both are packed before they are shuffled. With one, postings are joined with the terms: queries, which are few beside
    postings, are repeated for ``salts`` parts of each term, so the postings of a frequent term meet them in as many tasks.
    """
    within = within or []
    wanted = asked.groupBy("shard", "query", "term", *within).agg(F.count(F.lit(1)).alias("qtf"))
    weighted = wanted.join(index.terms, ["shard", "term"]).join(small(index.shards), "shard")
    if candidates is None and not within:
        scored = _best_of_blocks(index, weighted, k, method)
    else:
        scored = _restricted(index, weighted, method, candidates, within, salts)
    rank = F.row_number().over(Window.partitionBy("shard", "query").orderBy(F.col("score").desc(), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _restricted(index: Index, weighted: DataFrame, method: str, candidates: DataFrame | None, within: list[str], salts: int) -> DataFrame:
    weighted = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    postings = index.postings.select("shard", "term", "doc", "tf", "dl", *within)
    if candidates is not None:
        postings = postings.join(candidates.select("shard", "doc").distinct(), ["shard", "doc"], "left_semi")
    hits = weighted.join(postings.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")), ["shard", "term", *within, "_salt"])
    if within:
        hits = hits.where("doc <> query")
    if candidates is not None:
        hits = hits.join(candidates.select("shard", "query", "doc"), ["shard", "query", "doc"], "left_semi")
    if method == "bm25":
        weight = bm25_weight(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("dl") / F.col("avgdl"))
    else:
        weight = tfidf_weight(F.col("tf"), F.col("df"), F.col("n_docs"))
    scored = hits.groupBy("shard", "query", "doc").agg(F.sum((F.col("qtf") * weight).cast(SCORE)).alias("_s"))
    return scored.withColumn("score", F.round(F.col("_s").cast("double"), 6)).where(F.col("score") > 0).drop("_s")


def _best_of_blocks(index: Index, weighted: DataFrame, k: int, method: str) -> DataFrame:
    """(shard, query, doc, score) of the ``k`` best of each block of documents."""
    texts = index.texts
    if texts is None:
        texts = index.postings.groupBy("shard", "doc").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("terms"))
    n_blocks = F.coalesce(F.floor(F.col("n_docs") * (F.col("avgdl") + 1) / BLOCK_TERMS), F.lit(0)) + 1
    blocks = F.broadcast(index.shards.select("shard", "avgdl", n_blocks.cast("int").alias("_n")))
    idf = bm25_idf(F.col("df"), F.col("n_docs")) if method == "bm25" else F.log(F.col("n_docs") / F.col("df"))
    terms = F.collect_list(F.array_repeat(F.struct("term", idf.alias("idf")), F.col("qtf").cast("int")))
    asked = weighted.groupBy("shard", "query").agg(F.flatten(terms).alias("_t")).select("shard", "query", F.col("_t.term").alias("terms"), F.col("_t.idf").alias("idf"))
    queries = _packed(asked, ["shard"], "query").join(blocks, "shard").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    block = F.pmod(F.xxhash64("doc"), F.col("_n")).cast("int").alias("_block")
    packed = _packed(texts.join(blocks, "shard").select("shard", block, "doc", "terms"), ["shard", "_block"], "doc").withColumnRenamed("shard", "_shard")
    schema = T.StructType([asked.schema["shard"], asked.schema["query"], texts.schema["doc"], T.StructField("score", T.DoubleType())])

    def best(asked: pa.Table, docs: pa.Table) -> pa.Table:
        return _best_of_block(asked, docs, k, method)

    return queries.groupBy("shard", "_block").cogroup(packed.groupBy("_shard", "_block")).applyInArrow(best, schema)


def _packed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (``keys``, ``name``, terms and perhaps idf) as few rows (``keys``, ids, packed), which are what is shuffled.

    A task packs its rows of equal ``keys`` together: ``ids`` has what was in ``name``, ``packed`` the counted terms.
    """
    limit = PACK_BYTES
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("ids", T.ArrayType(rows.schema[name].dataType)), T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) >= limit:
                yield from _packets(pa.Table.from_batches(held), keys, name).to_batches()
                held = []
        if held:
            yield from _packets(pa.Table.from_batches(held), keys, name).to_batches()

    return rows.mapInArrow(pack, out)


def _packets(rows: pa.Table, keys: list[str], name: str) -> pa.Table:
    """One row for each value of ``keys``, in which every different term is spelled once."""
    n, lists = len(rows), rows["terms"].combine_chunks()
    order = pc.sort_indices(rows, [(k, "ascending") for k in keys])
    place = np.empty(n, np.int64)
    place[order.to_numpy()] = np.arange(n)
    own = rows.select([*keys, name]).take(order).combine_chunks()
    new = np.arange(n) == 0
    for k in keys:
        value = own[k].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= value[1:] != value[:-1]
    starts = np.flatnonzero(new)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()[order.to_numpy()]
    encoded, row = pc.list_flatten(lists).dictionary_encode(), place[pc.list_parent_indices(lists).to_numpy()]
    known = encoded.indices.is_valid().to_numpy(zero_copy_only=False)
    size = max(len(encoded.dictionary), 1)
    key = row[known] * size + encoded.indices.drop_null().to_numpy()
    if weighted := "idf" in rows.column_names:
        key, first, tf = np.unique(key, return_index=True, return_counts=True)
        idf = pc.list_flatten(rows["idf"].combine_chunks()).to_numpy()[known][first]
    else:
        key, tf = np.unique(key, return_counts=True)
    row, term = np.divmod(key, size)
    counts = np.bincount(row, minlength=n)
    edges, bounds = [*starts.tolist(), n], [*np.searchsorted(row, starts).tolist(), len(row)]
    packed = []
    for a, b, i, j in zip(edges, edges[1:], bounds, bounds[1:], strict=False):
        used, at, number = np.unique(term[i:j], return_index=True, return_inverse=True)
        words = encoded.dictionary.take(pa.array(used)).cast(pa.binary()).to_pylist()  # bytes, as a text may be damaged
        parts = [lengths[a:b], counts[a:b], number, tf[i:j], np.array([len(w) for w in words])]
        raw = b"".join([*map(_planes, parts), idf[i:j][at].tobytes() if weighted else b"", *words])
        packed.append(np.array([len(raw), j - i, len(words)]).tobytes() + pa.compress(raw, "zstd", asbytes=True))
    ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), own[name].combine_chunks())
    return pa.table({**{k: own[k].take(pa.array(starts)) for k in keys}, "ids": ids, "packed": pa.array(packed, pa.binary())})


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes before all second bytes and so on: small ones compress well."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


@dataclass
class _Opened:
    ids: pa.Array
    lengths: np.ndarray  # of each row
    words: pa.Array
    row: np.ndarray  # of each different term of a row: its row, its number in ``words``, how often it stands there
    term: np.ndarray
    tf: np.ndarray
    idf: np.ndarray  # of each word, where the rows had it


def _opened(packets: pa.Table, weighted: bool) -> _Opened:
    """All packets of a block together; a word is there once for each packet that has it."""
    ids = packets["ids"].combine_chunks()
    parts, n_words = [], 0
    for n, blob in zip(pc.list_value_length(ids).to_pylist(), packets["packed"].to_pylist(), strict=True):
        size, n_terms, w = np.frombuffer(blob, np.int64, 3).tolist()
        raw, at, own = pa.decompress(memoryview(blob)[24:], size, "zstd", asbytes=True), 0, []
        for m in (n, n, n_terms, n_terms, w):
            own.append(np.frombuffer(raw, np.uint8, 4 * m, at).reshape(4, m).T.copy().view("<i4").ravel())
            at += 4 * m
        own[2] = own[2] + np.int64(n_words)
        own.append(np.frombuffer(raw, np.float64, w, at) if weighted else np.empty(0))
        parts.append((*own, raw[at + 8 * w * weighted :]))
        n_words += w
    lengths, counts, term, tf, sizes, idf, spelled = zip(*parts, strict=True)
    lengths, counts, term, tf, sizes, idf = map(np.concatenate, (lengths, counts, term, tf, sizes, idf))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    words = pa.Array.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(spelled))])
    return _Opened(pc.list_flatten(ids), lengths, words, np.repeat(np.arange(len(counts)), counts), term, tf, idf)


def _units(weight: np.ndarray) -> np.ndarray:
    """Weights as whole numbers of the last digit of SCORE; sums of them are exact."""
    return np.floor(weight * 1e9 + 0.5).astype(np.int64)


def _best_of_block(asked: pa.Table, docs: pa.Table, k: int, method: str) -> pa.Table:
    """Adds up each query's terms over one row of sums, a place for each document, and keeps the ``k`` best."""
    shard, none = asked["shard"].combine_chunks(), pa.array([], pa.float64())
    if not len(asked) or not len(docs):
        return pa.table({"shard": shard[:0], "query": asked["ids"].combine_chunks().values[:0], "doc": docs["ids"].combine_chunks().values[:0], "score": none})
    wanted, held = _opened(asked, True), _opened(docs, False)
    query, doc, n = wanted.ids, held.ids, len(held.ids)
    encoded = wanted.words.dictionary_encode()
    vocabulary, codes = encoded.dictionary, encoded.indices.to_numpy()
    idfs = np.empty(len(vocabulary))
    idfs[codes] = wanted.idf
    codes, qtf, ends = codes[wanted.term], wanted.tf, np.searchsorted(wanted.row, np.arange(len(query)), "right")

    order = pc.sort_indices(doc, null_placement="at_start").to_numpy()  # so the lower of equal documents comes first
    doc = doc.take(pa.array(order))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    number = doc.dictionary_encode("encode").indices.to_numpy()  # rows of one id are one document
    doc = doc.take(pa.array(np.flatnonzero(np.diff(number, prepend=-1))))

    found = pc.fill_null(pc.index_in(held.words, value_set=vocabulary), -1).to_numpy()[held.term]
    by = np.argsort(found, kind="stable")
    by = by[np.searchsorted(found[by], 0) :]
    term, row, tf = found[by], held.row[by], held.tf[by]
    weight = _bm25(idfs[term], tf, held.lengths[row] / asked["avgdl"][0].as_py()) if method == "bm25" else tf * idfs[term]
    once, row = _units(weight), number[place[row]].astype(np.int64)
    bounds = np.searchsorted(term, np.arange(len(vocabulary) + 1)).tolist()

    sums = np.empty(len(doc), np.int64)
    codes, qtf, out, at = codes.tolist(), qtf.tolist(), [], 0
    for q, end in enumerate(ends.tolist()):
        sums.fill(0)
        for i in range(at, end):
            part = slice(bounds[codes[i]], bounds[codes[i] + 1])
            np.add.at(sums, row[part], once[part] if qtf[i] == 1 else _units(qtf[i] * weight[part]))
        at = end
        near = np.flatnonzero(sums >= 500)  # all others are 0 after six digits
        if len(near) > k:  # what is less than a unit of the sixth digit below the k-th may equal it when rounded
            near = near[sums[near] > np.partition(sums[near], -k)[-k] - 1000]
        score = (sums[near] + 500) // 1000
        best = np.lexsort((near, -score))[:k]
        out.append((np.full(len(best), q), near[best], score[best] / 1e6))
    asker, which, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"shard": shard.take(pa.array(np.zeros(len(asker), np.int64))), "query": query.take(pa.array(asker)), "doc": doc.take(pa.array(which)), "score": score})
