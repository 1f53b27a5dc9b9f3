"""Text normalisation for retrieval, answers and predictions."""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters with marks and the plain letters they become.
MARKED = "áàâäãåçéèêëíìîïñóòôöõøúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"

# English words that retrieval leaves out.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they "
    "them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does "
    "did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def retrieval_text(text: Column) -> Column:
    """Lower case, & as word, marked letters as plain ones, acronyms without dots, other punctuation as blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "&", " and ")
    t = F.translate(t, MARKED, PLAIN)
    t = F.regexp_replace(t, r"\b([a-z])\.([a-z])\.([a-z])?\.?", "$1$2$3")
    return F.regexp_replace(t, ASCII_PUNCTUATION, " ")


def retrieval_terms(text: Column, stopwords: list[str] | None = None) -> Column:
    """Terms of a text in order, stopwords left out."""
    stop = STOPWORDS if stopwords is None else stopwords
    words = F.split(retrieval_text(text), "[ \t\r\n]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(stop)) if stop else F.filter(words, lambda w: w != "")


_VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    if c in _VOWELS:
        return False
    return i == 0 or not _consonant(word, i - 1) if c == "y" else True


def _measure(stem: str) -> int:
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short_end(stem: str) -> bool:
    n = len(stem)
    return n >= 3 and _consonant(stem, n - 3) and not _consonant(stem, n - 2) and _consonant(stem, n - 1) and stem[-1] not in "wxy"


# Suffix tables of the published algorithm (Porter, 1980).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(table: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in table.split(" ")), key=lambda p: -len(p[0]))


_TABLE2, _TABLE3, _TABLE4 = _pairs(_STEP2), _pairs(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


def porter_stem(word: str) -> str:
    """Stem of a lower-case English word by Porter's algorithm; other words than a-z stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_TABLE2, _TABLE3):
        for suffix, new in table:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _TABLE4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StructType().add("term", T.StringType()).add("tf", T.IntegerType())))
def term_counts(terms: pd.Series) -> pd.Series:
    """How often each term stands in a row's array; null: none."""
    return pd.Series([[{"term": t, "tf": n} for t, n in Counter(x).items()] if x is not None else [] for x in terms])


_STEMS: dict[str, str] = {}
_STEMS_KEPT = 500_000


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_terms(terms: pd.Series) -> pd.Series:
    """Stems of each row's terms, without stems of stopwords. Stems are kept per process, up to _STEMS_KEPT."""
    known = _STEMS
    if len(known) > _STEMS_KEPT:
        known.clear()
    stop = {porter_stem(w) for w in STOPWORDS}
    out = []
    for row in terms:
        stems = []
        for t in row if row is not None else ():
            s = known.get(t)
            if s is None:
                s = known[t] = porter_stem(t)
            if s not in stop:
                stems.append(s)
        out.append(stems)
    return pd.Series(out)


def normalized_answer_ascii(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks; exact for ASCII texts, in JVM code."""
    t = F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, "")
    t = F.regexp_replace(t, r"(?<![a-z0-9_])(a|an|the)(?![a-z0-9_])", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\x0B\f]+", " "))


_ARTICLES = re.compile(r"\b(a|an|the)\b")
_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)


def normalize_answer(text: str) -> str:
    """Decompose, lower case, delete ASCII punctuation, articles to blanks, single blanks. Any Unicode text."""
    t = unicodedata.normalize("NFD", text).lower().translate(_NO_PUNCTUATION)
    return " ".join(_ARTICLES.sub(" ", t).split())


@F.pandas_udf(T.StringType())
def normalized_answer(text: pd.Series) -> pd.Series:
    return text.map(normalize_answer, na_action="ignore")


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+$", "")


def normalized_prediction(text: Column) -> Column:
    """Stripped, first line, stripped again."""
    return stripped(first_line(stripped(text)))


def without_bom(text: Column) -> Column:
    return F.replace(text, F.lit("\ufeff"), F.lit(""))
