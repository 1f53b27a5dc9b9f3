"""Token totals per subset, source, language and host.

Counts are exact: the trie of ``linmax`` gives each text the ids that the vocabulary's longest-match rule gives.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .sizes import vocab_counter

UNKNOWN = "unknown"

# Three-letter and bibliographic language codes of common languages, and their two-letter codes.
LANGUAGE_CODES = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "zho": "zh", "chi": "zh",
    "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "jpn": "ja", "kor": "ko", "ara": "ar", "tur": "tr",
    "ces": "cs", "cze": "cs", "swe": "sv", "ukr": "uk", "hin": "hi",
}

# Names that some feeds write in place of codes.
LANGUAGE_NAMES = {
    "english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es",
    "russian": "ru", "русский": "ru", "chinese": "zh", "中文": "zh",
}


def _tidy(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s ﻿]+|[\s ﻿]+$", ""))


def language_key(lang: Column) -> Column:
    """Primary language code in lower case; region and script parts are left out; ``unknown`` if none is given."""
    first = F.regexp_extract(_tidy(lang), r"^([^-_\s]+)", 1)
    known = F.create_map(*[F.lit(x) for x in chain(*{**LANGUAGE_CODES, **LANGUAGE_NAMES}.items())])
    return F.when(first == "", F.lit(UNKNOWN)).otherwise(F.coalesce(F.element_at(known, first), first))


def host_key(url: Column) -> Column:
    """Host of a url in lower case, without scheme, user, port, ``www.`` and closing dot; ``unknown`` if none."""
    host = F.regexp_extract(_tidy(url), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\d?\.", "")
    return F.when(host == "", F.lit(UNKNOWN)).otherwise(host)


def source_key(source: Column) -> Column:
    return F.when(_tidy(source) == "", F.lit(UNKNOWN)).otherwise(_tidy(source))


#: The configuration names each subset once; more rows than this are refused.
MAX_SUBSETS = 10_000


def with_subset(docs: DataFrame, config: DataFrame) -> DataFrame:
    """Add ``subset_key``: the configured name, whatever its case and spaces; by the number in ``source`` if it is
    missing or not configured; else ``unknown``. ``config`` is the small table (subset_idx, subset)."""
    rows = config.where("subset is not null").select("subset_idx", "subset").limit(MAX_SUBSETS + 1).collect()
    if len(rows) > MAX_SUBSETS:
        raise ValueError(f"more than {MAX_SUBSETS} configured subsets")
    by_name = {re.sub(r"[^a-z0-9]", "", r.subset.lower()): r.subset for r in rows}
    by_number = {int(r.subset_idx): r.subset for r in rows if r.subset_idx is not None}
    names, numbers = ([F.lit(x) for pair in m.items() for x in pair] for m in (by_name, by_number))
    number = F.regexp_extract(_tidy(F.col("source")), r"^src(\d{1,18})$", 1)
    index = F.when(number != "", (number.cast("long") % max(1, len(by_number))).cast("int"))
    given = F.regexp_replace(_tidy(F.col("meta.redpajama_set_name")), r"[^a-z0-9]", "")
    found = [F.try_element_at(F.create_map(*names), given)] if names else []
    found += [F.try_element_at(F.create_map(*numbers), index)] if numbers else []
    return docs.withColumn("subset_key", F.coalesce(*found, F.lit(UNKNOWN)))


def document_tokens(docs: DataFrame, vocab: DataFrame, config: DataFrame) -> DataFrame:
    """One row per document: its keys and exact token count. Null text counts 0 tokens, empty text too."""
    count = vocab_counter(docs.sparkSession, vocab)
    slim = docs.select("doc_id", "text", "lang", "source", "meta")
    return with_subset(slim, config).select(
        "doc_id",
        "subset_key",
        source_key(F.col("source")).alias("source_key"),
        language_key(F.col("lang")).alias("lang_key"),
        host_key(F.col("meta.url")).alias("host_key"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(count(F.col("text")), F.lit(0)).cast("long").alias("tokens"),
    )


def token_budget(docs: DataFrame, vocab: DataFrame, config: DataFrame) -> DataFrame:
    """Totals by each of ``subset``, ``source``, ``language``, ``host`` and (``subset``, ``language``), and of all.

    Every row of ``docs`` counts once in each dimension, copies included. Each task first adds up its own rows, so
    a source that holds most rows costs no more shuffle than another. An empty table gives no rows.
    """
    per_doc = document_tokens(docs, vocab, config)
    pairs = {
        "all": F.lit("all"), "subset": F.col("subset_key"), "source": F.col("source_key"), "language": F.col("lang_key"),
        "host": F.col("host_key"), "subset_language": F.concat_ws("/", "subset_key", "lang_key"),
    }
    dims = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("slice")) for k, v in pairs.items()])
    keys = ["subset_key", "source_key", "lang_key", "host_key"]
    sums = [F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")]
    cells = per_doc.groupBy(*keys).agg(*sums)
    return (
        cells.select(F.explode(dims).alias("d"), "docs", "chars", "tokens")
        .groupBy(F.col("d.dimension").alias("dimension"), F.col("d.slice").alias("slice"))
        .agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    )


def p1_token_budget(spark, sf_dir: str) -> DataFrame:
    docs, vocab, config = (table(spark, sf_dir, n) for n in ("documents", "vocab", "corpus_config"))
    return token_budget(docs, vocab, config)


def p1_document_tokens(spark, sf_dir: str) -> DataFrame:
    docs, vocab, config = (table(spark, sf_dir, n) for n in ("documents", "vocab", "corpus_config"))
    return document_tokens(docs, vocab, config)
