"""Statistics that tell running prose from lists, tables and junk, and how far each document is from its language's prose.

Every document becomes a vector of statistics. Per language a robust mean and covariance of prose are fitted, and the
squared Mahalanobis distance over all statistics is split into one contribution per statistic, which add up to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, table

# Frequent function words by language. Words of several languages count for each.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for it as with on by at from this be are or an were which their its has had have not but a our we i you he she they them his her if when then there who what how so than every each some another no more about into over after before while because although neither nor most been will would can could should may don",
    "de": "die der das und in den von zu mit ist im für des dem nicht ein eine einer eines einem einen als auch es an auf sich aus bei nach wie am hat war wird sind oder aber um über durch gegen ohne weil keine kein ihre ihr unsere unser diese dieser dieses jede jeder damals bei vor zum zur man wenn dass",
    "fr": "le la les de des du un une et en est dans que qui pour pas sur au aux par plus ne se ce cette ces son sa ses leur leurs notre nos avec il elle ils nous vous mais ou où comme sans sous entre chaque parce après avant contre selon était sont a été",
    "es": "el la los las de del un una y en que es por para con no se su sus al lo como más pero o este esta estos ese aquel aquella nuestro nuestra cada porque sobre tras contra desde hacia sin entre ha fue son era muy ya también según",
    "ru": "и в не на что он она они с как это этот эта по но за из у от к до для о же так был была были все весь его её их наш мы вы бы тот один одна каждый или если при через про под над потому",
    "it": "il lo la gli le di del della dei delle un uno una e in che è per con non si su sono come più ma anche questo questa ogni nostro loro dal nel alla",
    "pt": "o a os as de do da dos das um uma e em que é por para com não se seu sua como mais mas ao na no pelo foi são este esta cada nosso também",
    "nl": "de het een en van in is dat op te voor met niet zijn aan er om ook als bij door maar uit naar deze dit of wordt werd geen hun onze elke",
}

# Word classes by language, for neighbours that sentences don't have: d determiners, p prepositions,
# a auxiliaries, c conjunctions, t the infinitive mark.
WORD_CLASSES = {
    "en": {
        "d": "the an every each some our their its my your another",
        "t": "to",
        "p": "of in on at by for with from during under over behind beside against through across within without beyond",
        "a": "is was are were be been has had have",
        "c": "and or but",
    },
    "de": {"d": "die das eine einen diese jede keine unsere ihre", "p": "mit von für durch gegen ohne um bei zu im am", "a": "ist wird war hat", "c": "und oder aber"},
    "fr": {"d": "le la les un une ce cette leur son notre chaque", "p": "de dans avec pour sur sous sans par", "a": "est sont a était", "c": "et ou mais"},
    "es": {"d": "el los las un una este aquel su nuestro cada", "p": "de en con para por sobre sin contra desde hacia", "a": "es son fue era", "c": "y o pero"},
}
#: Class strings of neighbours that sentences don't have.
ODD_NEIGHBOURS = "dp|dc|dd|da|dt|pp|pa|pt|cc|tp|tc|tt"
#: Least share of function words in a running sentence.
LEAST_COMMON = {"en": 0.25}
LEAST_COMMON_ELSE = 0.12

STATISTICS = (
    "log_words", "word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "sentence_share",
    "log_line_length", "repeated_share", "bullet_share", "odd_neighbours", "odd_characters",
)
#: The side of each statistic on which text is less like prose; 0: it tells the size of a text, not its kind.
ADVERSE = (0, 0, 1, 1, -1, -1, -1, 0, 1, 1, 1, 1)
#: Statistics that prose of every language has alike; the fit starts from these.
NEUTRAL = tuple(i for i, s in enumerate(STATISTICS) if ADVERSE[i] and s not in ("symbol_ratio", "digit_ratio", "common_words"))
#: Below this share of characters in running sentences a text is looked through for program code.
CODE_BELOW = 0.8
#: Each language's mean and covariance are drawn towards those of all languages as by so many documents of these.
PULL = 20
#: A statistic's deviation in prose counts as at least this part of its deviation over all documents.
LEAST_SCALE = 0.3
#: Smaller differences of a statistic tell nothing.
RESOLUTION = 0.003
#: Squared distances beyond this quantile of the chi-squared distribution mark outliers.
QUANTILE_Z = 3.09  # 0.999
REWEIGHT_Z = 1.96  # 0.975
STEPS = 3

#: Ids pass Python as strings, so nulls and large numbers stay exact.
MEASURED = "doc_id string, language string, code boolean, " + ", ".join(f"{s} double" for s in STATISTICS)

_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"</?[a-zA-Z!][^<>\n]{0,300}>")
_MATH = re.compile(r"\$[^$\n]{1,300}\$|\\[a-zA-Z]+\{[^{}\n]{0,200}\}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_ENDERS, _CLOSERS = frozenset(".!?…。！？"), "\"'”’»」)]*_"
_CUT = re.compile(r"[.!?…][\"'”’»)\]*_]*\s+|[。！？][”’»」)\]]*\s*|[\U0001F300-\U0001FAFF☺-☻]+\s*")
_BULLET = re.compile(r"\s*(?:[-*+•·–—○▪■◦‣>#]|\[[ xX]?\]|\(?[0-9]{1,3}[.)\]:]|#\d+|\(?[a-zA-Z][.)])\s")
_ODD = re.compile(r"[\xc2-\xff][\x80-\xbf]+|[\x80-\x84\x86-\x9f\ufffd□]+|\\u[0-9a-f]{4}|%20|&[a-z]{2,6};|\?{3,}|[!$]{3,}")
_CODE_START = re.compile(
    r"\s*(?:def |class |import \w|from [\w.]+ import|return\b|raise \w|except\b|elif |#include|function\b|const \w|let \w|var \w"
    r"|public |private |static |void |unsigned |int \w|size_t |struct |fn |using |package |@\w+[.(]|//|/\*|\*/|\* @|#\s|#!|\"\"\"|```)"
    r"|\s*[})\]]+[;,]?\s*$|\s*[\w.\[\]>*-]{1,80} (?:[-+*/|&^%]?=|<<=|>>=) \S"
)
_CODE_BLOCK = re.compile(r"\s*(?:if|for|while|else|try|with|switch|case)\b")
_CODE_INNER = re.compile(r"\w\(|\w\[|->|::| [-=<>+*/|&!]?[=<>] ")

_LANG_WORDS = {lang: frozenset(w.split()) for lang, w in FUNCTION_WORDS.items()}


class _Classes(dict):
    """One letter per word: its class, f for another function word, x for any other."""

    def __missing__(self, word: str) -> str:
        return "x"


def _classes(lang: str) -> _Classes:
    out = _Classes(dict.fromkeys(_LANG_WORDS.get(lang, ()), "f"))
    for mark, words in WORD_CLASSES.get(lang, {}).items():
        out |= dict.fromkeys(words.split(), mark)
    return out


_CLASS = {lang: _classes(lang) for lang in (*FUNCTION_WORDS, "zh", "xx")}
_ODD_PAIR = re.compile(f"(?=({ODD_NEIGHBOURS}))")


def is_code(line: str) -> bool:
    """Whether a line reads as program code. Each pattern runs once from the left, so long lines cost no more per sign."""
    if _CODE_START.match(line):
        return True
    last = line.rstrip()[-1:]
    return last in (";", "{") and _CODE_INNER.search(line) is not None or last in (":", "{") and _CODE_BLOCK.match(line) is not None


def ends_sentence(s: str) -> bool:
    """Whether the last character, closing marks aside, ends a sentence."""
    if not s:
        return False
    return s[-1] in _ENDERS or s[-1] in _CLOSERS and s.rstrip(_CLOSERS)[-1:] in _ENDERS


def paragraphs(text: str, wide: bool = False) -> list[str]:
    """Lines of a text; hard-wrapped lines are joined again: a full line goes on in the next one of its block."""
    out = []
    full = 20 if wide else 38
    held = ""
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            if held:
                out.append(held)
                held = ""
            continue
        if held and _BULLET.match(line + " "):
            out.append(held)
            held = ""
        held = f"{held} {line}" if held else line
        if len(line) < full or ends_sentence(line):
            out.append(held)
            held = ""
    if held:
        out.append(held)
    return out


def sentences(paragraph: str) -> list[str]:
    """The parts of a paragraph between ends of sentences (or emoji, which some writers put in their place)."""
    out, at = [], 0
    for m in _CUT.finditer(paragraph):
        out.append(paragraph[at : m.end()].rstrip())
        at = m.end()
    if at < len(paragraph):
        out.append(paragraph[at:])
    return [s for s in out if s]


def language_of(counts: Counter, n_words: int, letters: int, plain: str, wide: int) -> tuple[str, float]:
    """The language with the most function words, and their share; ``xx`` if none stands out."""
    if wide * 3 > max(letters, 1):
        return "zh", len(re.findall("[的了在是和而但因所这那不]", plain)) / wide
    best, most = "xx", 0
    keys = counts.keys()
    for lang, own in _LANG_WORDS.items():
        if (n := sum(counts[w] for w in own & keys)) > most:
            best, most = lang, n
    share = most / max(n_words, 1)
    if best == "xx" or most < 2 or share < 0.08:
        best = "ru" if letters and len(_CYRILLIC.findall(plain)) * 2 > letters else "xx"
    return best, share


def measure(text: str) -> tuple[str, bool, list[float]] | None:
    """Language, whether it is program code, and the statistics of a text; None for null and blank texts."""
    if not text:
        return None
    text = text.replace("\r", "").replace("\ufeff", "").replace("\xa0", " ").strip()
    if not text:
        return None
    plain = text
    if "<" in plain:
        plain = _TAG.sub(" ", plain)
    if "$" in plain or "\\" in plain:
        plain = _MATH.sub(" ", plain)
    size = len(text)
    words = _WORD.findall(plain.lower())
    n_words, letters = len(words), sum(map(len, words))
    counts = Counter(words)
    ascii_ = plain.isascii()
    wide = 0 if ascii_ else len(_CJK.findall(plain))
    language, common = language_of(counts, n_words, letters, plain, wide)
    odd_chars = _ODD.findall(text)
    odd_size = sum(map(len, odd_chars))
    strange = odd_size > 0.01 * size
    least = LEAST_COMMON.get(language, LEAST_COMMON_ELSE) if language not in ("zh", "xx") else 0.0
    # prose of a language that isn't known still has a few short words again and again; strung-together words don't
    foreign = language != "xx"
    if not foreign:
        often = counts.most_common(6)
        foreign = n_words < 25 or sum(c for _, c in often) >= 0.15 * n_words and sum(len(w) for w, _ in often) <= 4 * len(often)
    klass = _CLASS[language].__getitem__

    lines = [x for x in text.split("\n") if x and not x.isspace()]
    seen: dict[str, int] = {}
    running = repeated = total = odd = pairs = 0
    for p in paragraphs(plain, wide > 0):
        after = False
        for s in sentences(p):
            n_s = len(s)
            total += n_s
            times = seen[s] = seen.get(s, 0) + 1
            if times > 1:
                repeated += n_s
                if times > 2:
                    continue
            ws = _WORD.findall(s.lower())
            n = len(ws)
            w_letters = len("".join(ws))
            dense = n_s - s.count(" ")
            after_one, after = after, False
            ended = ends_sentence(s)
            numbers = False
            if wide and (w := len(_CJK.findall(s))) * 2 > w_letters:
                full = ended and (w >= 10 or w >= 5 and s.rstrip(_CLOSERS)[-1:] in "。！？…")
                after = full and w > 0.3 * dense or w >= 12 and w_letters > 0.9 * dense
                if after and not strange:
                    running += n_s + 1
                    continue
            elif (numbers := w_letters < 0.75 * dense) and not (
                ended and least > 0 and w_letters > 0.45 * dense and w_letters > 0.75 * (dense - sum(map(s.count, "0123456789")))
            ):
                continue
            elif n < 4:
                after = ended and after_one and n > 1
            else:
                code_word = "".join(map(klass, ws))
                known = n - code_word.count("x")
                if not numbers:  # else words stand apart that are no neighbours
                    odd += len(_ODD_PAIR.findall(code_word))
                    pairs += n
                if w_letters > 14 * n or ended is False and n < 8:
                    continue
                if n < 8:
                    after = known > 0 or not least
                elif ended:
                    after = foreign and known >= least * n and (least > 0 or n <= 60)
                else:
                    after = least > 0 and known >= max(least, 0.2) * n and len(set(ws)) >= min(0.3 * n, 40)
            if after and strange and sum(map(len, _ODD.findall(s))) > 0.05 * n_s:
                after = False
            if after:
                running += n_s + 1
    digits = sum(map(plain.count, "0123456789"))
    dense_all = len("".join(plain.split()))
    symbols = max(0, dense_all - letters - digits)
    odd_share = odd / max(pairs, 1)
    share = min(1.0, running / max(total + len(seen), 1))
    code_size = sum(len(x) for x in lines if is_code(x)) if share < CODE_BELOW else 0
    code = code_size > 0.5 * max(1.0, (1 - share) * size) and code_size > 0.15 * size
    values = [
        math.log10(n_words + 1), letters / max(n_words, 1) if language != "zh" else 2.0, symbols / size, digits / size,
        sum(map(ends_sentence, map(str.rstrip, lines))) / len(lines), common, share,
        math.log10(1 + (size - len(lines)) / len(lines)), repeated / max(total, 1),
        min(1 - share, sum(len(x) for x in lines if _BULLET.match(x)) / size), odd_share, odd_size / size,
    ]
    return language, code, values


def document_statistics(docs: DataFrame) -> DataFrame:
    """The statistics of each document of ``docs`` (doc_id, text) that has any text; whole texts are measured."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if got := measure(text):
                    out.append((doc_id, got[0], got[1], *got[2]))
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in MEASURED.split(", ")]
    slim = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return slim.mapInPandas(run, MEASURED).withColumn("doc_id", F.col("doc_id").cast("long"))


def chi_squared(dims: int, z: float) -> float:
    """Quantile of the chi-squared distribution at the normal quantile ``z`` (Wilson-Hilferty)."""
    return dims * (1 - 2 / (9 * dims) + z * (2 / (9 * dims)) ** 0.5) ** 3


def chi_squared_below(dims: int, x: float) -> float:
    """Probability of a chi-squared value of at most ``x``; ``dims`` is even."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))


class ProseModel:
    """Robust mean and inverse covariance of prose by language; ``""`` is that of all languages."""

    def __init__(self, center: dict[str, np.ndarray], inverse: dict[str, np.ndarray]):
        self.center, self.inverse = center, inverse

    def contributions(self, language: pd.Series, x: np.ndarray) -> np.ndarray:
        """(documents, statistics): each statistic's part of the squared distance; rows add up to it."""
        return self.parts(language, x)[0]

    def parts(self, language: pd.Series, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contributions, and for each document the sum of those on the adverse side of prose."""
        out, worse = np.zeros_like(x), np.zeros(len(x))
        if not self.center:
            return out, worse
        which = language.where(language.isin(list(self.center)), "").to_numpy()
        for lang in np.unique(which):
            own = which == lang
            if lang in self.center:
                d = x[own] - self.center[lang]
                out[own] = d * (d @ self.inverse[lang])
                worse[own] = np.where(d * np.array(ADVERSE) > 0, out[own], 0.0).sum(axis=1)
        return out, worse


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), float).reshape(len(values), len(STATISTICS))


def _distance_udf(model: ProseModel):
    @F.pandas_udf("parts array<double>, adverse double")
    def distance(language: pd.Series, values: pd.Series) -> pd.DataFrame:
        parts, worse = model.parts(language, _matrix(values))
        return pd.DataFrame({"parts": list(parts), "adverse": worse})

    return distance


SUMS = "language string, place int, amount double"


def _core_sums(measured: DataFrame, kept) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and products of the statistics by language, over the documents that ``kept`` picks (a function of
    their languages and statistics). A task hands over one set of sums per language, and only totals reach the driver."""
    k = len(STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch["v"])
            own = kept(batch["language"], x)
            x, languages = x[own], batch["language"].to_numpy()[own]
            for lang in set(languages.tolist()):
                y = x[languages == lang]
                held[lang] = held.get(lang, 0) + np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
        rows = [(lang, i, v) for lang, sums in held.items() for i, v in enumerate(sums.tolist())]
        yield pd.DataFrame(rows, columns=["language", "place", "amount"])

    values = F.array(*[F.col(s) for s in STATISTICS]).alias("v")
    sums = measured.where(~F.col("code")).select("language", values).mapInPandas(run, SUMS).groupBy("language", "place").agg(F.sum("amount").alias("amount"))
    flat: dict[str, np.ndarray] = {}
    for r in sums.collect():  # a fixed number of languages and places
        flat.setdefault(r["language"], np.zeros(1 + k + k * k))[r["place"]] = r["amount"]
    return {lang: (v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)) for lang, v in sorted(flat.items())}


def fit_prose(measured: DataFrame, steps: int = STEPS) -> ProseModel:
    """Robust mean and covariance of prose per language, in concentration steps.

    The start is the documents near the median of all documents, by median absolute deviations, in the statistics that
    prose of all languages has alike; it holds as long as most documents are prose. Each step takes mean and covariance
    of the documents kept before and keeps those within the 0.975 quantile of the new distance; the covariance makes
    up for what the cut leaves out. A language is drawn towards all languages as by PULL documents, so a rare one
    changes smoothly as it grows, and one without prose is held against that of all.
    """
    k = len(STATISTICS)
    names = list(STATISTICS)
    prose = measured.where(~F.col("code"))
    middle = [F.percentile_approx(s, 0.5).alias(f"m_{s}") for s in names]
    first = prose.agg(*middle, *[F.stddev_pop(s).alias(f"d_{s}") for s in names]).first()
    if first["m_log_words"] is None:
        return ProseModel({}, {})
    med = np.array([first[f"m_{s}"] for s in names])
    floor = np.maximum(LEAST_SCALE * np.array([first[f"d_{s}"] for s in names]), RESOLUTION)
    off = prose.agg(*[F.percentile_approx(F.abs(F.col(s) - float(m)), 0.5).alias(s) for s, m in zip(names, med, strict=True)]).first()
    scale = np.maximum(1.4826 * np.array([off[s] for s in names]), floor)
    near, cut = list(NEUTRAL), chi_squared(k, REWEIGHT_Z)
    start = chi_squared(len(near), REWEIGHT_Z)
    grow = 0.975 / chi_squared_below(k + 2, cut)

    def kept(_language: pd.Series, x: np.ndarray) -> np.ndarray:
        return (((x - med) / scale)[:, near] ** 2).sum(axis=1) <= start

    model = ProseModel({}, {})
    for _ in range(steps):
        totals = _core_sums(measured, kept)
        if not totals:
            break
        everything = [sum(t[a] for t in totals.values()) for a in range(3)]
        pull = PULL / everything[0]
        totals = {lang: [a + pull * b for a, b in zip(t, everything, strict=True)] for lang, t in totals.items()}
        totals[""] = everything
        center, inverse = {}, {}
        for lang, (n, s, m) in totals.items():
            mu = s / n
            center[lang], inverse[lang] = mu, np.linalg.inv(grow * (m / n - np.outer(mu, mu)) + np.diag(floor**2))
        model = fitted = ProseModel(center, inverse)

        def kept(language: pd.Series, x: np.ndarray, fitted: ProseModel = fitted) -> np.ndarray:
            return fitted.contributions(language, x).sum(axis=1) <= cut

    return model


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with text: language, statistics, squared distance from its language's prose, the
    contribution of each statistic, their sum on the adverse side (``adverse``), whether it is an outlier, whether it is
    program code.

    Null and blank texts have no row. Repeated rows have one row each. An empty table gives no rows.
    """
    measured = stage(document_statistics(docs), "quality")
    model = fit_prose(measured)
    got = _distance_udf(model)(F.col("language"), F.array(*[F.col(s) for s in STATISTICS]))
    limit = chi_squared(len(STATISTICS), QUANTILE_Z)
    names = F.array(*[F.lit(s) for s in STATISTICS])
    return (
        measured.withColumn("_d", got)
        .withColumn("distance", F.aggregate("_d.parts", F.lit(0.0), lambda a, b: a + b))
        .withColumn("adverse", F.col("_d.adverse"))
        .withColumn("outlier", F.col("distance") > limit)
        .withColumn("top_statistic", F.element_at(names, F.array_position("_d.parts", F.array_max("_d.parts")).cast("int")))
        .withColumn("contributions", F.map_from_arrays(names, F.col("_d.parts")))
        .drop("_d")
    )


def p2_statistics(spark, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Documents that aren't program code and whose statistics on the adverse side of prose (more symbols, digits,
    repetition, bullets or odd characters, fewer ends of sentences, common words or sentences) by themselves add up to
    an outlier's distance. So a long book or short note of prose, far out by its size alone, is no case."""
    report = p2_statistics(spark, sf_dir)
    return report.where(~F.col("code") & (F.col("adverse") > chi_squared(len(STATISTICS), QUANTILE_Z))).select("doc_id")
