"""Find e-mail addresses, phone and identity numbers, street addresses and person names, and put placeholders for them.

Wide patterns give candidate spans. Labelers (patterns, gazetteer, context) vote for or against each span or abstain.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely each
pattern is to be real. From these soft labels it is learnt which words stand around real spans; a logistic span
classifier of the votes, the form of the span and its neighbours is then trained on them and decides. All beliefs that
the fit starts from weigh as a share of the spans, so the same kinds of spans are judged alike in a corpus of any size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import model_rows, stage, table

TYPES = ("email", "phone", "id_number", "address", "name")
LABELERS = {
    "email": ("plain", "spelled", "ending", "context", "person", "technical"),
    "phone": ("international", "plan", "national", "context", "other_number", "id_label"),
    "id_number": ("label", "other_number", "form", "person", "phone_label", "bare"),
    "address": ("number", "postcode", "town", "context", "capitals", "measure"),
    "name": ("given", "family", "family_form", "before", "after", "organisation"),
}
EM_STEPS = 40
#: Strength of the first belief in each labeler, as a share of the spans of its type.
PRIOR_SHARE = 0.03
#: Strength of the belief that a word around a span tells nothing, as a share of the spans of its type.
WORD_PRIOR = 0.01
#: Words around spans are told apart by this many hash values, so their table has a fixed size.
WORD_BUCKETS = 512
#: Words looked at on either side.
WORDS_AROUND = 2
#: Spans that the classifier's penalty is set for; counts are scaled to it.
TRAIN_WEIGHT = 1000.0
THRESHOLD = 0.5

#: Ids pass Python as strings, so nulls and large numbers stay exact.
SPANS = "array<struct<t:int,s:int,e:int,v:string,p:string,f:string,b:array<int>,a:array<int>>>"
CANDIDATES = f"doc_id string, text string, spans {SPANS}"
FOUND = "doc_id string, pii_type string, value string"
REDACTED = "doc_id string, text string, n_email int, n_phone int, n_id_number int, n_address int, n_name int"

# Street words by language, endings of domains, surnames written with one sign, words around spans.
STREET_WORDS = (
    "street st avenue ave road rd lane ln court ct close terrace terr drive dr way place pl square sq crescent cres grove hill row walk "
    "park gardens boulevard blvd highway hwy mews parade quay green rise view"
)
STREET_ENDINGS_DE = "straße strasse str weg platz allee gasse ring damm ufer"
STREET_WORDS_FR = "rue avenue boulevard place quai chemin impasse allée route cours passage square"
STREET_WORDS_ES = "calle avda avenida plaza paseo camino carretera ronda travesía"
DOMAIN_ENDINGS = frozenset(
    "com org net edu gov mil int info biz io co me de fr es ru cn uk us ca it nl pl pt se no fi dk ch at be jp kr br in au eu example test invalid localhost".split()
)
FILE_ENDINGS = frozenset("png jpg jpeg gif svg js ts py css html htm md txt json xml yaml yml zip gz jar so exe java cpp hpp".split())
SURNAMES_ZH = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
TITLES = frozenset("mr mrs ms miss dr prof herr frau señor señora sr sra monsieur madame mme mlle sir dame lord lady".split())
NOT_GIVEN = frozenset(
    "the a an of and to in is was for it as with on by at from this that be are or so ask asked contact use mail name signed author edited reviewed "
    "posted words photo von und die der das le la les de du el los las y et un una une kontakt ansprechpartner said told when while if each every "
    "our their its some another todo owner regards grüßen maintainer copyright address phone id per но и в на имя контакт "
    "selon según schrieb wrote not but then than also near under over after before about into upon via who what".split()
)
ORGANISATIONS = frozenset(
    "street avenue road lane festival museum college company institute society railway library garden gardens bridge valley harbour prize council "
    "university school hospital station square court market theatre park club church hotel bakery press house field town village city river lake mount".split()
)

_EMAIL = re.compile(
    r"(?<![\w.+@＠/-])(\w[\w.+-]*)(?:[ ]?(?:@|＠|&#64;)[ ]?|\s*[\[({]\s*(?:at|AT|At)\s*[\])}]\s*|\s+(?:AT|at)\s+)"
    r"(\w[\w-]*(?:(?:\.|\s*[\[({]\s*(?:dot|DOT|Dot)\s*[\])}]\s*|\s+(?:DOT|dot)\s+)[\w-]+)+)"
)
_ID_FORMS = (
    ("licence", re.compile(r"(?<![\w-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])", re.I)),
    ("insurance", re.compile(r"(?<![\w-])[A-CEGHJ-PR-TW-Z][A-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![\w-])", re.I)),
    ("passport", re.compile(r"(?<![\w-])[A-Z]{1,2}\d{7}(?![\w-])", re.I)),
    ("dated", re.compile(r"(?<![\w-])(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])-\d{4}(?![\w-])")),
    ("resident", re.compile(r"(?<!\d)\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?![\da-zA-Z])")),
    ("tax", re.compile(r"(?<![\w.-])\d{2}\s\d{3}\s\d{3}\s\d{3}(?![\w-])")),
    ("security", re.compile(r"(?<![\w./-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")),
    ("nine", re.compile(r"(?<![\w./,+-])\d{9}(?![\w-])")),
)
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_STREET = "|".join(STREET_WORDS.split())
_UNIT = r"(?:[,\s]\s*(?:(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|Rm|No)\.?\s*#?\s*\d*[A-Z]?\d*|#\s*\w{1,5})\b)?"
_TOWN = rf"(?:\s*,\s*(?:D-)?(?:\d{{5}}\s+)?({_WORD}(?:\s+{_WORD}(?=\s+\d{{5}}\b))?)(?:\s+\d{{5}}(?:-\d{{4}})?\b)?|\s+({_WORD})\s+\d{{5}}\b)?"
_ADDRESS_EN = re.compile(rf"(?<![\w./:,-])\d{{1,5}}[A-Z]?\s+(?:{_WORD}\s+){{1,2}}?(?:{_STREET})\b\.?{_UNIT}{_TOWN}", re.I)
_ADDRESS_DE = re.compile(rf"(?<![\w-])[^\W\d_]{{3,}}(?:{'|'.join(STREET_ENDINGS_DE.split())})\.?\s+\d{{1,4}}\s?[a-z]?\b(?:\s*,\s*(?:D-)?(?:\d{{5}}\s+)?({_WORD})()|(?:)())?", re.I)
_ADDRESS_FR = re.compile(rf"(?<![\w-])\d{{1,4}}(?:\s+(?:bis|ter|quater))?\s*,?\s+(?:{'|'.join(STREET_WORDS_FR.split())})\s+(?:(?:de|du|des|la|le)\s+)*{_WORD}(?:\s*,\s*(?:\d{{5}}\s+)?({_WORD})())?", re.I)
_ADDRESS_ES = re.compile(rf"(?<!\w)(?:{'|'.join(STREET_WORDS_ES.split())}|C/)\.?\s+(?:(?:de|del|la|los)\s+)*{_WORD}\s*,?\s+(?:n[º°.]\s*)?\d{{1,4}}\s?[A-Z]?\b(?:\s*,\s*(?:\d{{5}}\s+)?({_WORD})())?", re.I)
_EN_WORDS, _FR_WORDS, _ES_WORDS = (frozenset(x.split()) for x in (STREET_WORDS, STREET_WORDS_FR, STREET_WORDS_ES))
_SMALL_PARTS = _EN_WORDS | _FR_WORDS | _ES_WORDS | NOT_GIVEN | {"bis", "ter", "quater", "du", "des", "apt", "flat", "unit", "suite"}
_DE_ENDINGS = tuple(STREET_ENDINGS_DE.split())
_LONG_NUMBER = re.compile(r"\d[\d\s().\-/ \xa0]{5,}\d|\d\d\s?\d\d\s?\d\d\s?[A-Da-d]\b")
_TOKEN = re.compile(r"[^\W\d_]+")
_LEFT_GIVEN = re.compile(r"(?:(?<=\W)|^)((?:[^\W\d_]\.[ \xa0]?-?){1,3}|[^\W\d_]{2,}(?:-[^\W\d_]{2,})?)(\s+(?:[^\W\d_]\.\s*)*)$")
_LEFT_FAMILY = re.compile(r"(?:(?<=\W)|^)([^\W\d_]{3,})-$")
_RIGHT_FAMILY = re.compile(r"-([^\W\d_]{3,})")
_RIGHT_GIVEN = re.compile(r"\s*,\s*((?:[^\W\d_]\.[ \xa0]?){1,3}(?![^\W\d_])|[^\W\d_]{2,}(?:-[^\W\d_]{2,})?(?:\s+[^\W\d_]\.(?!\w))*)(?![\w@＠]|\.\w|[-+_]\w|\s?[@＠]|\s+[\[(]?(?:at|AT)[\])\s])")
_ZH_LABELLED = re.compile(r"(?:联系人|姓名|作者|记者|收件人|经办人)\s*[:：]\s*([一-鿿·]{2,4})(?![一-鿿])")
_ZH_OWNER = re.compile(r"(?<![一-鿿])([一-鿿]{2,4})(?=的(?:身份证|电话|手机|护照|地址|邮箱)|先生|女士)")

_MAIL_CONTEXT = re.compile(r"mail|contact|write|question|rsvp|reach|correo|schreiben|crivez|escriba|пишите|邮件|邮箱|sent to|regards|ask |owner|author|maintainer", re.I)
_TECHNICAL = re.compile(r"pinned|version|import |@\w+\(", re.I)
_PHONE_CONTEXT = re.compile(
    r"phone|tel\b|tél|tel\.|call|text\b|ring|whatsapp|mobile|fax|contact|телефон|номеру|звон|контакт|电话|手机|llame|contactez|rückfragen|telefon|regards|cell", re.I
)
_OTHER_NUMBER = re.compile(
    r"\b(?:grid reference|isbn|issn|record|doi|rev|build|sku|part number|parts? no|invoice|version|order no|port|serial|release|commit|model)\W*(?:[\d.\-/x ]*\W*)?$", re.I
)
_ID_LABEL = re.compile(
    r"ssn|ss#|social security|passport|licen[cs]e|personal number|personnummer|identity|\bid\b|tax (?:id|n)|steuer|citizen|fiscal|national n|ni number|insurance n|travel doc|document|card|docum|докум|паспорт|身份证|护照|num[ée]ro|nir\b|dni\b|taxpayer", re.I
)
_ID_AFTER = re.compile(r"^[\s.,;)]*(?:(?:is|was|as)? ?(?:the|a) (?:number|no\.?) of (?:the|a|his|her|their|my|your) (?:\w+ )?(?:document|card|passport|licen|permit|visa)|выдан|\((?:[a-z' .-]*)(?:ssn|ss#|social|passport|licen|personal|identity|id|tax|steuer|ni|insurance|travel|card|citizen)|(?-i:for [A-Z][a-z]+,? (?:[A-Z]\.? )?[A-Z]))", re.I)
_ADDRESS_CONTEXT = re.compile(r"lives? at|address|moved|deliver|wohnt|anschrift|adresse|vive en|адрес|地址|住|dirección|domicilio|send|visit", re.I)
_MEASURE = re.compile(r"\b(?:cups?|tbsp|tsp|ml|g|kg|pinch|pieces|slices|oz|people|years|items|boxes|percent)\b", re.I)
_NAME_BEFORE = re.compile(
    r"(?:\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|name|contact|author|owner|signed|edited|reviewed by|words|photo|posted by|by|according to|asked|ask|told|"
    r"selon|según|schrieb|von|de|contactez|llame a|ansprechpartner ist|kontakt|контакт|на имя|todo|regards|grüßen|for|to)\b\W*|[“”\"(]\s*|,”\s*)$", re.I
)
_NAME_AFTER = re.compile(
    r"^(?:,? (?:wrote|told|said|lives|signed|wohnt|es )|\s*\((?:ssn|ss#|social|passport|driver|identity|id|tax|steuer|personal|ni|travel)|,\s*[+(\d]|\s*[|;<>]|,\s*\w+[.+\w-]*\s?[@＠(\[]|\s+[-–]\s|\s*\n|[:,.]\s|\"|\))", re.I
)


class Lexicon:
    """Given and family names of a gazetteer, and the parts that its family names are made of.

    A beginning and an ending are productive if they combine with at least three endings or beginnings each; a word
    of a productive beginning and ending has the form of a family name even if the gazetteer lacks it.
    """

    def __init__(self, names: list[tuple[str, str]]):
        self.given = {n.lower() for n, k in names if k == "given"}
        self.family = {n.lower() for n, k in names if k == "family"}
        splits = [(n[:i], n[i:]) for n in self.family for i in range(3, len(n) - 2)]
        for _ in range(3):
            heads, tails = {}, {}
            for h, t in splits:
                heads.setdefault(h, set()).add(t)
                tails.setdefault(t, set()).add(h)
            splits = [(h, t) for h, t in splits if len(heads[h]) >= 3 and len(tails[t]) >= 3]
        self.heads, self.tails = {h for h, _ in splits}, {t for _, t in splits}
        self.cache: dict[str, int] = {}

    def form(self, word: str) -> int:
        """2 in the gazetteer, 1 of the form of a family name, 0 neither."""
        got = self.cache.get(word)
        if got is None:
            low = word.lower()
            if low in self.family:
                got = 2
            else:
                got = int(any(low[:i] in self.heads and low[i:] in self.tails for i in range(3, len(low) - 2)))
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got


def value_of(span: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in span.lower() if c.isalnum())


def _flat(context: str) -> str:
    return re.sub(r"\s+", " ", context)


def _mark(*votes: int) -> str:
    return "".join("-0+"[v + 1] for v in votes)


def _emails(text: str, lex: Lexicon) -> Iterator[tuple]:
    for m in _EMAIL.finditer(text):
        local, domain = m.group(1).rstrip("."), m.group(2)
        at = text[m.end(1) : m.start(2)]
        plain = any(c in at for c in "@＠;")
        labels = [x for x in re.split(r"\W*\b(?:dot)\b\W*|\.", domain, flags=re.I) if x]
        end = m.end()
        ending = labels[-1].lower() if labels else ""
        if len(labels) < 2 or not plain and "." in domain or plain and re.search(r"\s(?:dot|DOT)\s", domain):
            continue
        if not re.fullmatch(r"[^\W\d_]{2,}", ending):
            continue
        spelled = not plain
        if spelled and at.strip().lower() == "at" and at.strip() != "AT" and local.lower() in NOT_GIVEN:
            continue
        before = text[max(0, m.start() - 60) : m.start()]
        person = bool(re.search(r"[._+\d-]", local)) or lex.form(local) > 0 or lex.form(local[1:]) > 0
        yield (
            0, m.start(), end,
            _mark(
                plain - (not plain and not spelled), 1 if spelled and re.search(r"[\[(]|AT", at) else 0,
                1 if ending in DOMAIN_ENDINGS else -1 if ending in FILE_ENDINGS else 0,
                1 if _MAIL_CONTEXT.search(before) else 0, 1 if person else 0, -1 if _TECHNICAL.search(before[-25:]) else 0,
            ),
        )


_GAP = r"(?:\s{1,3}|[.-])?"
_PLANS = tuple(
    re.compile(p.replace("_", _GAP))
    for p in (
        r"(?:\+?1_|)(?:\([2-9]\d\d\)\s{0,3}|[2-9]\d\d(?:\s{1,3}|[.-]))[2-9]\d\d(?:\s{1,3}|[.-])\d{4}|\+1[2-9]\d\d[2-9]\d{6}|\([2-9]\d\d\)\s?[2-9]\d{6}",
        r"(?:\+44_(?:\(0\)\s{0,3})?|0044_|0)7\d{3}_\d{3}_\d{3}",
        r"(?:\+33_(?:\(0\)\s{0,3})?|0033_|0)[1-9](?:_\d{2}){4}",
        r"(?:\+49_(?:\(0\))?|0049_)\d{2,4}(?:\s{1,3}|[/-])?\d{3,6}(?:_\d{1,5})?|\(0\d{2,4}\)\s{0,3}\d{3,6}(?:_\d{1,5})?|0\d{2,4}(?:/|\s{1,3})\d{4,6}(?:_\d{1,5})?",
    )
)
_PHONE = re.compile(
    (
        r"(?<![\w/.,+=*#-])(?<![\d(]\s)(?:(?:\+|00(?!0))\d{1,3}_/?(?:\(\d{1,4}\)_)?\d[\d\s.\-/]{5,24}\d|1(?:\s{1,3}|[.-])\(?[2-9]\d\d\)?(?:\s{1,3}|[.-])\d{3}(?:\s{1,3}|[.-])\d{4}|\(0?\d{2,4}\)_\d{3,7}(?:_\d{1,5})?"
        r"|0[1-9]\d{0,3}(?:\s{1,3}|[/-])\d{3,8}(?:(?:\s{1,3}|-)\d{1,6})*|0[1-9](?:(?:\s{1,3}|[.-])\d{2}){4}|\d{3}(?:\s{1,3}|[.-])\d{3}(?:\s{1,3}|[.-])\d{4}|0[1-9]\d{8,9})(?!\d|[-/.,]\d|\w)"
    ).replace("_", _GAP)
)
_TAX_FORM = re.compile(r"0\d\s+\d{3}\s+\d{3}\s+\d{3}")


def _phones(text: str) -> Iterator[tuple]:
    for m in _PHONE.finditer(text):
        s, e = m.span()
        span = m.group()
        best = max((p.match(span) for p in _PLANS), key=lambda x: x.end() if x else -1)
        if best and best.end() < len(span):  # digits behind a blank belong to something else
            rest = span[best.end() :]
            if rest[:1].isspace():
                e = s + best.end()
                span = text[s:e]
            else:
                best = None
        if "\n" in span and len(re.sub(r"\D", "", span.split("\n")[0])) >= 9:
            span = span.split("\n")[0].rstrip()
            e = s + len(span)
        digits = sum(c.isdigit() for c in span)
        if not 8 <= digits <= 15 or _TAX_FORM.fullmatch(span):
            continue
        before, after = _flat(text[max(0, s - 48) : s]), _flat(text[e : e + 12])
        other = _OTHER_NUMBER.search(before)
        yield (
            1, s, e,
            _mark(
                1 if span[0] == "+" or span.startswith("00") else 0, 1 if best else -1, 1 if span[0] in "0(" else 0,
                1 if not other and _PHONE_CONTEXT.search(before) else 0, -1 if other else 0,
                -1 if _ID_LABEL.search(before[-22:]) and not _PHONE_CONTEXT.search(before[-14:]) or _ID_AFTER.search(after) else 0,
            ),
        )


def _numbers(text: str, lex: Lexicon) -> Iterator[tuple]:
    for form, pattern in _ID_FORMS:
        for m in pattern.finditer(text):
            s, e = m.span()
            before, after = _flat(text[max(0, s - 44) : s]), _flat(text[e : e + 40])
            other = _OTHER_NUMBER.search(before)  # the words right before the number go before labels further off
            label = _ID_AFTER.search(after) or not other and _ID_LABEL.search(before[-32:])
            person = any(lex.form(w) for w in _TOKEN.findall(before + " " + after))
            yield (
                2, s, e,
                _mark(
                    1 if label else -1, -1 if other else 0, 1 if form not in ("security", "nine", "tax") else 0,
                    1 if person else 0, -1 if _PHONE_CONTEXT.search(before[-14:]) and not label else 0, -1 if form == "nine" else 0,
                ),
            )


def _addresses(text: str, words: set[str]) -> Iterator[tuple]:
    fits = (
        (_ADDRESS_EN, not words.isdisjoint(_EN_WORDS)), (_ADDRESS_DE, any(w.endswith(_DE_ENDINGS) for w in words)),
        (_ADDRESS_FR, not words.isdisjoint(_FR_WORDS)), (_ADDRESS_ES, not words.isdisjoint(_ES_WORDS) or "C/" in text),
    )
    for pattern in [p for p, fit in fits if fit]:
        for m in pattern.finditer(text):
            s, e = m.span()
            span = m.group()
            town = next((g for g in m.groups() if g), None)
            code = bool(re.search(r"\d{5}\W*\w*$", span))
            letters = [w for w in _TOKEN.findall(span) if len(w) > 1 and w.lower() not in _SMALL_PARTS]
            capital = bool(letters) and sum(w[0].isupper() for w in letters) >= 0.6 * len(letters)
            if town and not code and town[0].islower() and (capital or town.lower() in NOT_GIVEN):
                cut = span.rfind(town)  # what follows the comma is no town
                e = s + len(span[:cut].rstrip().rstrip(",").rstrip())
                town = None
                span = text[s:e]
            before = text[max(0, s - 50) : s]
            yield (
                3, s, e,
                _mark(
                    1, 1 if code else 0, 1 if town else -1, 1 if _ADDRESS_CONTEXT.search(before) else 0, 1 if capital else -1,
                    -1 if _MEASURE.search(span) else 0,
                ),
            )


def _names(text: str, lex: Lexicon) -> Iterator[tuple]:
    form, given = lex.form, lex.given
    last = -1
    for m in _TOKEN.finditer(text):
        word = m.group()
        s, e = m.span()
        if s < last or len(word) < 3:
            continue
        kind = form(word)
        if not kind:
            if word.lower() in given and word[0].isupper():
                yield from _by_given(text, word, s, e, lex)
            continue
        if text[s - 1 : s] in ("@", "＠", "_", "+", ".") and text[s - 2 : s - 1].isalnum() and text[s - 1 : s] != ".":
            continue
        if text[e : e + 1] in ("@", "＠", "_", "+") or re.match(r"[ \xa0]?[@＠]|\.\w|[-.]?\d|\s+(?:AT|at)\s|\s*[\[(]at[\])]", text[e : e + 8]):
            continue
        if double := _RIGHT_FAMILY.match(text, e):
            if form(double.group(1)) and not re.match(r"[@＠_\d]|\.\w|[ \xa0]?[@＠]|\s*[\[(]at|\s+AT\s", text[double.end() : double.end() + 6]):
                e = double.end()
            elif not form(double.group(1)):
                continue
        left = text[max(0, s - 46) : s]
        if (twin := _LEFT_FAMILY.search(left)) and not form(twin.group(1)):
            continue  # a mailbox such as given-family
        got = _LEFT_GIVEN.search(left)
        first = None
        if got:
            g = got.group(1)
            parts = [p.lower() for p in g.split("-")]
            gap, at = got.group(2), got.start(1)
            if "." in gap and (set(parts) & (NOT_GIVEN | TITLES) or "\n" in gap.split(".")[0] or g[0].islower() and word[0].isupper()):
                # the word in front isn't part of the name: for M. Family
                g, at = gap.strip(), got.start(2) + len(gap) - len(gap.lstrip())
                parts, gap = [g.lower()], " "
            ok = g.endswith(".") or g[0].isupper() or word[0].islower() and parts[0] not in NOT_GIVEN
            if (
                ok and not set(parts) & (NOT_GIVEN | TITLES) and gap.count("\n") <= 1 and not form(g)
                and left[:at][-1:] not in (*".@＠_+/-",) and not left[:at][-1:].isalnum()
                and not ("\n" in gap and _RIGHT_GIVEN.match(text, e))
                and (g[0].isupper() or all(p in given for p in parts) or not (set(parts) & ORGANISATIONS))
            ):
                first = g
                start = s - (len(left) - at)
        if first:
            span = (start, e)
            parts = [p.lower() for p in first.split("-")]
            known = 1 if any(p in given for p in parts) else 0
        elif right := _RIGHT_GIVEN.match(text, e):
            g = right.group(1)
            parts = [p.lower().rstrip(".") for p in re.split(r"[-\s]+", g) if p]
            if (not g[0].isupper() and word[0].isupper()) or set(parts) & NOT_GIVEN or any(form(p) for p in parts):
                continue
            if not g[0].isupper() and not any(p in given for p in parts):
                alone = text[right.end(1) : right.end(1) + 1] in (*".,;:)|\n", "")
                if not (alone and _NAME_BEFORE.search(text[max(0, s - 30) : s])) and not _NAME_AFTER.search(text[right.end(1) : right.end(1) + 30]):
                    continue
            span = (s, right.end(1))
            known = 1 if any(p in given for p in parts) else 0
        else:
            continue
        last = span[1]
        yield _name_span(text, span, known, kind)


def _name_span(text: str, span: tuple[int, int], known: int, kind: int) -> tuple:
    before, after = text[max(0, span[0] - 30) : span[0]], text[span[1] : span[1] + 30]
    follows = _TOKEN.match(after.lstrip(" ")) if after[:1] == " " else None
    org = follows is not None and follows.group()[0].isupper() and follows.group().lower() in ORGANISATIONS
    return 4, *span, _mark(known, 1 if kind == 2 else 0, 1 if kind else -1, 1 if _NAME_BEFORE.search(before) else 0, 1 if _NAME_AFTER.search(after) else 0, -1 if org else 0)


_NEXT_WORD = re.compile(r"[ \xa0](?:[A-Z]\.[ \xa0])?([A-Z][^\W\d_]{2,})(?![\w@＠]|[.-]\w)")


def _by_given(text: str, word: str, s: int, e: int, lex: Lexicon) -> Iterator[tuple]:
    """A listed given name before a capital word that doesn't look like a family name: a candidate that needs more."""
    m = _NEXT_WORD.match(text, e)
    if not m or lex.form(m.group(1)) or text[s - 1 : s] in ("-", ".", "@", "_") or m.group(1).lower() in NOT_GIVEN:
        return
    kind, t = 0, _name_span(text, (s, m.end()), 1, 0)
    if m.group(1).lower() in ORGANISATIONS:
        t = (*t[:3], t[3][:5] + "-")
    yield t


def _names_zh(text: str) -> Iterator[tuple]:
    for pattern, before, after in ((_ZH_LABELLED, 1, 0), (_ZH_OWNER, 0, 1)):
        for m in pattern.finditer(text):
            known = 1 if m.group(1)[0] in SURNAMES_ZH else -1
            yield 4, m.start(1), m.end(1), _mark(0, known, known, before, after, 0)


def candidates(text: str, lex: Lexicon) -> list[tuple[int, int, int, str]]:
    """Candidate spans (type, start, end, votes) of one text. Patterns run only where a text has what they need."""
    out: list[tuple[int, int, int, str]] = []
    words = set(_TOKEN.findall(text.lower()))
    if "@" in text or "＠" in text or "&#64;" in text or "dot" in words:
        out += _emails(text, lex)
    if _LONG_NUMBER.search(text):
        out += _phones(text)
        out += _numbers(text, lex)
    if any(map(text.__contains__, "0123456789")):
        out += _addresses(text, words)
    if not words.isdisjoint(lex.given) or any(map(lex.form, words)):
        out += _names(text, lex)
    if "：" in text or "的" in text or "先生" in text or "女士" in text:
        out += _names_zh(text)
    return out


# The letters that each place of a span's form can have.
FORM_LETTERS = ("012345", "01234", "n -./(@+", "nltum", "bswop", "bswop")


def _side(c: str) -> str:
    """Kind of a neighbouring character: border or line end, space, word, bracket or quote, other."""
    if not c or c == "\n":
        return "b"
    if c.isspace():
        return "s"
    return "w" if c.isalnum() else "o" if c in "()[]{}<>\"'“”«»" else "p"


def form_of(text: str, s: int, e: int) -> str:
    """A span's form: digits, letters, first mark between them, case, and the kinds of its neighbours."""
    span = text[s:e]
    digits, letters = sum(map(str.isdigit, span)), sum(map(str.isalpha, span))
    mark = next((c for c in span if c in " -./(@+"), "n")
    case = "n" if not letters else "l" if span.islower() else "u" if span.isupper() else "t" if span.istitle() else "m"
    return (
        str(sum(digits > n for n in (0, 2, 5, 8, 11))) + str(sum(letters > n for n in (0, 5, 12, 25))) + mark + case
        + _side(text[s - 1 : s] if s else "") + _side(text[e : e + 1])
    )


def words_around(text: str, s: int, e: int) -> tuple[list[int], list[int]]:
    """Hash values of the nearest words before and behind a span."""
    before = _TOKEN.findall(text[max(0, s - 40) : s].lower())[-WORDS_AROUND:]
    behind = _TOKEN.findall(text[e : e + 30].lower())[:WORDS_AROUND]
    return tuple(sorted({zlib.crc32(w.encode()) % WORD_BUCKETS for w in ws}) for ws in (before, behind))


class Words:
    """What the words around spans tell: the logarithm of how much likelier a real span has them, by type and side."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (types, 2, WORD_BUCKETS)

    def levels(self, t: int, before, behind) -> str:
        """Two letters 0..4, from words that speak against a real span to words that speak for one."""
        out = ""
        for side, words in enumerate((before, behind)):
            told = float(self.table[t, side, list(words)].sum()) if len(words) else 0.0
            out += str(sum(told > x for x in (-1.5, -0.5, 0.5, 1.5)))
        return out


class SpanModel:
    """Probability of each kind of span (votes, form, words around), by type."""

    def __init__(self, weights: list[np.ndarray], words: Words):
        self.weights, self.words = weights, words
        self.known: dict[tuple[int, str], float] = {}

    def probability(self, t: int, kind: str) -> float:
        p = self.known.get((t, kind))
        if p is None:
            p = self.known[(t, kind)] = float(1 / (1 + np.exp(-(_features([kind], t) @ self.weights[t])[0])))
        return p

    def choose(self, spans: list) -> list[tuple[int, int, int]]:
        """The spans (t, s, e, p, f, b, a) that are likelier real than not; of overlapping ones the likeliest, then the longest."""
        ranked = []
        for x in spans:
            t = x["t"]
            p = self.probability(t, x["p"] + x["f"] + self.words.levels(t, x["b"], x["a"]))
            if p >= THRESHOLD:
                ranked.append((-round(p, 6), x["s"] - x["e"], x["s"], x["e"], t))
        taken: list[tuple[int, int, int]] = []
        for _, _, s, e, t in sorted(ranked):
            if all(e <= a or b <= s for _, a, b in taken):
                taken.append((t, s, e))
        return sorted(taken, key=lambda x: x[1])


def _votes(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns], float)


def _features(kinds: list[str], t: int) -> np.ndarray:
    """Features of kinds (votes, then form, then levels): each vote for and against, each letter of the rest."""
    k = len(LABELERS[TYPES[t]])
    v = _votes([x[:k] for x in kinds])
    letters = (*FORM_LETTERS, "01234", "01234")
    ones = [np.array([[x[k + i] == c for c in row] for x in kinds]) for i, row in enumerate(letters)]
    return np.hstack([np.ones((len(v), 1)), v > 0, v < 0, *ones]).astype(float)


def estimate(patterns: list[str], counts: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Expectation-maximisation: the chance of each vote pattern to be real, from labelers that vote independently
    given the truth. Reliabilities start at a common belief worth PRIOR_SHARE of the spans."""
    v = _votes(patterns)
    k = v.shape[1]
    # chance of a vote (-, 0, +) for real and for other spans
    belief = np.array([[[0.1, 0.4, 0.5]] * k, [[0.5, 0.4, 0.1]] * k])
    index = (v + 1).astype(int)
    rate, base = belief.copy(), 0.6
    held = PRIOR_SHARE * counts.sum()
    for _ in range(steps):
        logp = np.log(np.array([base, 1 - base]))[:, None] + np.stack(
            [np.log(rate[y][np.arange(k), index]).sum(axis=1) for y in (0, 1)]
        )
        logp -= logp.max(axis=0)
        q = np.exp(logp)
        q = q[0] / q.sum(axis=0)
        for y, w in ((0, q * counts), (1, (1 - q) * counts)):
            for vote in range(3):
                seen = (w[:, None] * (index == vote)).sum(axis=0)
                rate[y][:, vote] = (seen + held * belief[y][:, vote]) / (w.sum() + held)
        base = ((q * counts).sum() + 0.6 * held) / (counts.sum() + held)
    return q


def train(x: np.ndarray, counts: np.ndarray, soft: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Weights of a logistic classifier of features ``x``, trained on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    counts = counts * (TRAIN_WEIGHT / counts.sum())
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - soft)) + penalty @ w
        hess = (x * (counts * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def soft_labels(rows: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """The chance of each vote pattern to be real, from (type, votes, count) rows."""
    out = {}
    for t in range(len(TYPES)):
        own = sorted((p, n) for i, p, n in rows if i == t)
        if own:
            got = estimate([p for p, _ in own], np.array([n for _, n in own], float))
            out |= {(t, p): float(q) for (p, _), q in zip(own, got, strict=True)}
    return out


def learn_words(rows: list[tuple[int, int, int, float, float]]) -> Words:
    """From (type, side, word, spans, soft labels added up) rows, of which there is a fixed number."""
    table = np.zeros((len(TYPES), 2, WORD_BUCKETS))
    for t in range(len(TYPES)):
        for side in (0, 1):
            own = [(w, n, real) for i, j, w, n, real in rows if (i, j) == (t, side)]
            total, real_all = sum(n for _, n, _ in own), sum(r for *_, r in own)
            if not total:
                continue
            base = min(max(real_all / total, 0.01), 0.99)
            held = WORD_PRIOR * total
            for w, n, real in own:
                table[t, side, w] = np.log((real + held * base) / base) - np.log((n - real + held * (1 - base)) / (1 - base))
    return Words(table)


def learn(rows: list[tuple[int, str, str, int]], soft: dict[tuple[int, str], float], words: Words) -> SpanModel:
    """A model from (type, votes, form and levels, count) rows; a type that never occurs keeps the first belief."""
    weights = []
    for t, name in enumerate(TYPES):
        own = sorted((p, f, n) for i, p, f, n in rows if i == t)
        if own:
            x = _features([p + f for p, f, _ in own], t)
            weights.append(train(x, np.array([n for *_, n in own], float), np.array([soft[t, p] for p, _, _ in own])))
        else:
            x = np.zeros(_features(["0" * (len(LABELERS[name]) + len(FORM_LETTERS) + 2)], t).shape[1])
            k = len(LABELERS[name])
            x[0], x[1 : k + 1], x[k + 1 : 2 * k + 1] = -1.0, 2.0, -2.0
            weights.append(x)
    return SpanModel(weights, words)


def _names_of(gazetteer: DataFrame) -> list[tuple[str, str]]:
    rows = model_rows(gazetteer.where("name is not null").select("name", "kind"), "the gazetteer")
    return [(r.name, r.kind) for r in rows]


def find_candidates(docs: DataFrame, gazetteer: DataFrame, keep_text: bool = False) -> DataFrame:
    """The candidate spans of each document (doc_id, text); whole texts are read. Without ``keep_text`` only documents
    that have any are given, without their text."""
    shared = docs.sparkSession.sparkContext.broadcast(_names_of(gazetteer))
    held: list[Lexicon] = []

    def spans(text: str) -> list[tuple]:
        found = candidates(text, held[0])
        return [(t, s, e, value_of(text[s:e]), v, form_of(text, s, e), *words_around(text, s, e)) for t, s, e, v in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(Lexicon(shared.value))
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                got = spans(text) if text else []
                if got or keep_text:
                    out.append((doc_id, text if keep_text else None, got))
            yield pd.DataFrame(out, columns=["doc_id", "text", "spans"])

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (slim if keep_text else slim.where("text is not null")).mapInPandas(run, CANDIDATES)


KINDS = "t int, p string, f string, n long"


def fit(found: DataFrame) -> SpanModel:
    """Train on counts: of vote patterns (at most 3**6 a type), of words around (WORD_BUCKETS a side and type), and of
    kinds of spans (votes, form, levels: letters of fixed alphabets). A task adds up its own before any shuffle."""
    spans = found.select(F.explode("spans").alias("x")).select("x.*")
    counted = spans.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")).collect()
    soft = soft_labels([(r["t"], r["p"], r["n"]) for r in counted])
    label_rows = [(t, p, q) for (t, p), q in soft.items()]
    labels = found.sparkSession.createDataFrame(label_rows, "t int, p string, q double")  # at most 3**6 a type
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("w")) for i, c in enumerate("ba")])
    around = spans.groupBy("t", "p", "b", "a").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(labels), ["t", "p"])
    around = around.select("t", "n", "q", F.explode(sides).alias("s")).select("t", "n", "q", "s.side", F.explode("s.w").alias("w"))
    told = around.groupBy("t", "side", "w").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("q")).collect()
    words = learn_words([(r["t"], r["side"], r["w"], float(r["n"]), r["q"]) for r in sorted(told)])

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update((x["t"], x["p"], x["f"] + words.levels(x["t"], x["b"], x["a"])) for row in batch["spans"] for x in row)
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["t", "p", "f", "n"])

    rows = found.select("spans").mapInPandas(kinds, KINDS).groupBy("t", "p", "f").agg(F.sum("n").alias("n")).collect()
    return learn([(r["t"], r["p"], r["f"], r["n"]) for r in rows], soft, words)


def personal_data(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The distinct items (doc_id, pii_type, value) of each document.

    Null and empty texts have none. The candidates of all documents are written once to the shared folder; the model
    is fitted on their counts and applied to them where they are.
    """
    found = stage(find_candidates(docs, gazetteer).drop("text"), "pii")
    model = fit(found)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.words.table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SpanModel(shared.value[0], Words(shared.value[1]))
        for batch in batches:
            out = []
            for doc_id, spans in zip(batch["doc_id"], batch["spans"], strict=True):
                value = {(x["s"], x["e"]): x["v"] for x in spans}
                out += [(doc_id, TYPES[t], value[(s, e)]) for t, s, e in model.choose(spans)]
            yield pd.DataFrame(out, columns=["doc_id", "pii_type", "value"])

    return found.mapInPandas(run, FOUND).where("value <> ''").distinct().withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(docs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Each document with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of what was found, and counts.

    One row per row of ``docs``; null text stays null, all other characters stay as they are. Texts are searched once:
    they are written beside their candidates to the shared folder, and the placeholders are put in from there.
    """
    found = stage(find_candidates(docs, gazetteer, keep_text=True), "pii")
    model = fit(found.where(F.size("spans") > 0).select("spans"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.words.table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SpanModel(shared.value[0], Words(shared.value[1]))
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                parts, at, n = [], 0, [0] * len(TYPES)
                for t, s, e in model.choose(spans) if text else ():
                    parts += [text[at:s], f"[{TYPES[t].upper()}]"]
                    at = e
                    n[t] += 1
                out.append((doc_id, "".join(parts) + text[at:] if parts else text, *n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REDACTED.split(", ")])

    return found.mapInPandas(run, REDACTED).withColumn("doc_id", F.col("doc_id").cast("long"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), table(spark, sf_dir, "person_names"))


def p7_redacted(spark, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "person_names"))
