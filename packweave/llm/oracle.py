"""SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from .token_budget import LANGUAGE_CODES, LANGUAGE_NAMES, UNKNOWN

_EDGE = "[\\s\\x0B\\x{a0}\\x{feff}]"


def _tidy(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^{_EDGE}+|{_EDGE}+$', '', 'g'))"


def _name(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z0-9]', '', 'g')"


_CODES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (LANGUAGE_CODES | LANGUAGE_NAMES).items())
_HOST = f"regexp_extract({_tidy('meta.url')}, '^(?:[a-z][a-z0-9+.\\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@\\s]+)', 1)"
_NUMBER = f"TRY_CAST(regexp_extract({_tidy('source')}, '^src(\\d{{1,18}})$', 1) AS BIGINT) % greatest(1, (SELECT count(DISTINCT subset_idx) FROM corpus_config))"

# A text becomes stretches that begin with a space mark or behind a newline. Of each different stretch the longest known
# piece at every place is looked up, and the places reached from the first one are followed in one fold.
_COUNTS = (
    "src AS (SELECT *, row_number() OVER () AS rid FROM documents), "
    "st AS (SELECT rid, unnest(regexp_extract_all('▁' || replace(text, ' ', '▁'), '\\n|▁[^▁\\n]*|[^▁\\n]+')) AS w FROM src WHERE text <> ''), "
    "words AS (SELECT DISTINCT w FROM st WHERE w <> chr(10)), "
    "pc AS (SELECT DISTINCT piece, length(piece) AS size FROM vocab WHERE token_id > 258 AND piece <> ''), "
    "place AS (SELECT w, unnest(range(1, length(w) + 1)) AS p FROM words), "
    "met AS (SELECT w, p, max(size) AS size FROM (SELECT w, p, unnest(range(1, (SELECT max(size) FROM pc) + 1)) AS n FROM place) JOIN pc ON size = n AND piece = substr(w, p, n) GROUP BY 1, 2), "
    "nx AS (SELECT w, p, coalesce(size, 1) AS step, CASE WHEN size IS NULL THEN strlen(substr(w, p, 1)) ELSE 1 END AS ids FROM place LEFT JOIN met USING (w, p)), "
    "path AS (SELECT w, list_prepend({'p': CAST(1 AS BIGINT), 'step': CAST(0 AS BIGINT), 'ids': CAST(0 AS BIGINT)}, list({'p': p, 'step': CAST(step AS BIGINT), 'ids': CAST(ids AS BIGINT)} ORDER BY p)) AS x FROM nx GROUP BY 1), "
    "cnt AS (SELECT w, list_reduce(x, lambda a, b: CASE WHEN b.p = a.p THEN {'p': a.p + b.step, 'step': a.step, 'ids': a.ids + b.ids} ELSE a END).ids AS n FROM path), "
    "tok AS (SELECT rid, CAST(sum(CASE WHEN w = chr(10) THEN 1 ELSE n END) AS BIGINT) AS tokens FROM st LEFT JOIN cnt USING (w) GROUP BY 1), "
)
_DOCS = (
    "WITH " + _COUNTS + f"keyed AS (SELECT rid, doc_id, {_name(_tidy('meta.redpajama_set_name'))} AS given, {_NUMBER} AS number, {_tidy('source')} AS src_key, "
    f"regexp_extract({_tidy('lang')}, '^([^-_\\s]+)', 1) AS code, regexp_replace(regexp_replace({_HOST}, '\\.+$', ''), '^www\\d?\\.', '') AS host, coalesce(length(text), 0) AS chars FROM src), "
    f"per AS (SELECT doc_id, coalesce(a.subset, b.subset, '{UNKNOWN}') AS subset_key, CASE WHEN src_key = '' THEN '{UNKNOWN}' ELSE src_key END AS source_key, "
    f"CASE code WHEN '' THEN '{UNKNOWN}' {_CODES} ELSE code END AS lang_key, CASE WHEN host = '' THEN '{UNKNOWN}' ELSE host END AS host_key, chars, coalesce(tokens, 0) AS tokens "
    f"FROM keyed LEFT JOIN corpus_config a ON {_name('lower(a.subset)')} = given LEFT JOIN corpus_config b ON b.subset_idx = number LEFT JOIN tok USING (rid)) "
)
_DIMENSIONS = {"all": "'all'", "subset": "subset_key", "source": "source_key", "language": "lang_key", "host": "host_key", "subset_language": "subset_key || '/' || lang_key"}

SQL = {
    "p1_document_tokens": _DOCS + "SELECT * FROM per",
    "p1_token_budget": _DOCS
    + " UNION ALL ".join(
        f"SELECT '{k}' AS dimension, {v} AS slice, count(*) AS docs, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens FROM per GROUP BY 2" for k, v in _DIMENSIONS.items()
    ),
    "p4_found": "SELECT row_id FROM processed WHERE len(list_filter(token, lambda x: x > 2)) > 2048",
}
