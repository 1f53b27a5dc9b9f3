import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packweave.llm import leakage, pii, quality, queries

PROSE = "The old harbour was quiet that morning. Each boat had left before the sun came over the hill, and nobody spoke about it."


# ---- quality


@pytest.mark.parametrize(
    ("text", "low"),
    [
        (PROSE, False),
        (PROSE.lower().replace(".", "").replace(",", "") + " lol", False),
        (PROSE + "\n- one\n- two", False),
        ("\n".join(f"- item {i}" for i in range(20)), True),
        ("\n".join(f"{i},{i * 7}.5,n/a" for i in range(20)), True),
        ("aGVsbG8gd29ybGQ" * 30, True),
        ("Click here for boats " * 40, True),
        ((PROSE.split(".")[0] + ". ") * 40, True),
        ("buy cheap boats online free best deals harbour boats cheap free online buy best " * 3, True),
        ("Die alte Stadt war ruhig, und niemand sprach über den Hafen, weil es noch früh war.", False),
        ("最近，明亮的机器描述了报告，因为方法建立了安静的城市。有时，重要的森林检查了桥梁。", False),
    ],
)
def test_sentence_share_tells_prose_from_the_rest(text, low):
    _, code, values = quality.measure(text)
    assert not code and (values[quality.STATISTICS.index("sentence_share")] < 0.5) == low


def test_shuffled_words_show_odd_neighbours():
    text = "The on and and tested was for and league. Sorted with carried is cabinet it audience by the of. That for was clever on as of urban the in to."
    place = quality.STATISTICS.index("odd_neighbours")
    assert quality.measure(text)[2][place] > 0.03 and quality.measure(PROSE)[2][place] == 0


def test_bullets_count_only_outside_running_sentences():
    place = quality.STATISTICS.index("bullet_share")
    assert quality.measure("- " + PROSE + "\n- " + PROSE)[2][place] < 0.05
    assert quality.measure("\n".join(f"- item {i}" for i in range(20)))[2][place] > 0.8


def test_chi_squared():
    assert abs(quality.chi_squared(12, 3.09) - 32.9) < 0.2 and abs(quality.chi_squared_below(12, 32.909) - 0.999) < 1e-4


def _prose_rows(n=150, seed=3):
    rng = random.Random(seed)
    nouns = [a + b for a in "boat hill river mayor garden bridge letter clock".split() for b in ("", "man", "side", "yard", "song", "house", "path", "wood")]
    pick = lambda: rng.choice(nouns)
    return [(i, " ".join(f"The {pick()} was near the {pick()}. It had been there for {rng.randint(2, 90)} years with a {pick()}, and every {pick()} was old." for _ in range(rng.randint(1, 6)))) for i in range(n)]


def test_distance_alone_decides(spark):
    """Most documents are prose, a third of the others' language has none: the robust start isn't moved by them."""
    from pyspark.sql import functions as F

    junk = [(1000 + i, "\n".join(f"- thing {i * k}" for k in range(9))) for i in range(40)] + [(2000 + i, "o a os as de do da " * 9 + str(i)) for i in range(30)]
    book = [(5000, " ".join(t for _, t in _prose_rows(600, 9)))]
    got = quality.quality_report(spark.createDataFrame(_prose_rows() + junk + book, "doc_id long, text string"))
    found = {r.doc_id for r in got.where(F.col("adverse") > quality.chi_squared(len(quality.STATISTICS), quality.QUANTILE_Z)).collect()}
    assert found == {i for i, _ in junk}  # and not the long book


def test_agreement_with_hand_labels(spark):
    """Held-out accuracy: no label is used to fit. Wrong and null labels are part of the table."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/quality_labels.parquet").where("label is not null").selectExpr("doc_id", "lower(label) in ('list', 'table', 'junk') as bad").distinct()
    labels = labels.collect()
    found = {r.doc_id for r in queries.queries()["p2_found"](spark, d).collect()}
    assert np.mean([(r.doc_id in found) == r.bad for r in labels]) > 0.95


def test_models_are_bounded(spark):
    from packweave.session import model_rows

    names = spark.createDataFrame([("a" * 100, "given"), (None, "family")], "name string, kind string")
    assert len(model_rows(names, "names")) == 2 and model_rows(names.limit(0), "names") == []
    with pytest.raises(ValueError, match="names has"):
        model_rows(names, "names", 100)


def test_code_is_code():
    text = "import os\n\ndef main(x):\n    y = x[0] + 2\n    if y > 3:\n        return y\n    return os.path.join(y, 'a')\n"
    assert quality.measure(text)[1]
    assert not quality.measure("(1) Chorus;\n(2) Solid ferry;\n(3) Barley;\n")[1]


def test_quality_edges_and_contributions(spark):
    rng = random.Random(3)
    nouns = "boat hill river mayor garden bridge letter clock".split()
    prose = [f"The {rng.choice(nouns)} was near the {rng.choice(nouns)}. It had been there for {rng.randint(2, 90)} years, and every {rng.choice(nouns)} was old." for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(prose)] + [(500, None, "x"), (501, " \n", "x"), (502, "", "x"), (None, "- a\n" * 30, "x"), (503, "x" * 300_000, "x"), (503, "x" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    got = quality.quality_report(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 123 and not {500, 501, 502} & set(by)
    assert by[None].outlier and by[503].outlier and sum(by[i].outlier for i in range(120)) <= 6
    for r in got:
        assert abs(sum(r.contributions.values()) - r.distance) < 1e-6 * max(1, abs(r.distance))
    assert quality.quality_report(df.limit(0)).count() == 0


def test_robust_fit_matches_numpy(spark):
    rng = np.random.default_rng(1)
    k = len(quality.STATISTICS)
    x = rng.normal(0.9, 0.01, (400, k))
    rows = [(i, "en", False, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, quality.MEASURED)
    model = quality.fit_prose(df, steps=1)
    near = list(quality.NEUTRAL)
    med = np.sort(x, axis=0)[199]
    scale = np.maximum(1.4826 * np.sort(np.abs(x - med), axis=0)[199], np.maximum(quality.LEAST_SCALE * x.std(axis=0), quality.RESOLUTION))
    core = x[(((x - med) / scale)[:, near] ** 2).sum(axis=1) <= quality.chi_squared(len(near), quality.REWEIGHT_Z)]
    assert 350 < len(core) < 400 and np.allclose(model.center["en"], core.mean(axis=0))
    d = x - core.mean(axis=0)
    import pandas as pd

    want = (d * (d @ model.inverse["en"])).sum(axis=1)
    assert np.allclose(model.contributions(pd.Series(["en"] * 400), x).sum(axis=1), want)


def test_fit_of_a_language_changes_smoothly_with_its_count(spark):
    rng = np.random.default_rng(2)
    k = len(quality.STATISTICS)
    x, y = rng.normal(0.95, 0.001, (200, k)), rng.normal(0.85, 0.001, (50, k))

    def center(n):
        rows = [(i, lang, False, *map(float, v)) for i, (lang, v) in enumerate([("en", v) for v in x] + [("fi", v) for v in y[:n]])]
        model = quality.fit_prose(spark.createDataFrame(rows, quality.MEASURED), steps=1)
        return model.center.get("fi", model.center[""])

    assert np.abs(center(50) - center(49)).max() < 0.005


# ---- leakage


def slow_tiles(a, b, least):
    """Greedy string tiling word by word."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(n for _, _, n in out)
        n, i, j = best
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append((i, j, n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=30))
def test_tiles_do_not_overlap_and_cover_as_brute_force(a, b):
    got = leakage.tiles(np.array(a, np.int64), np.array(b, np.int64), 3)
    seen_a, seen_b = set(), set()
    for x, y, n in got:
        assert n >= 3 and a[x : x + n] == b[y : y + n]
        assert not seen_a & set(range(x, x + n)) and not seen_b & set(range(y, y + n))
        seen_a |= set(range(x, x + n))
        seen_b |= set(range(y, y + n))
    # equal longest runs may be marked in another order, so totals can differ by what that cuts off
    assert abs(sum(n for *_, n in got) - slow_tiles(a, b, 3)) <= 6


def words(n, seed, stem="w"):
    r = random.Random(seed)
    return [f"{stem}{r.randint(0, 10**6)}" for _ in range(n)]


def altered(ws, every, seed=0):
    r = random.Random(seed)
    out = []
    for i, w in enumerate(ws):
        if i % every == every - 1:
            out += ["changed" + str(r.randint(0, 99))] if i % 2 else [w, "added"]
        else:
            out.append(w)
    return out


def test_leaks_found_and_decoys_not(spark):
    item = words(90, 1)
    short = words(30, 2)
    filler = words(400, 3, "f")
    cases = {
        1: filler[:50] + item[10:50] + filler[50:],  # 40 words of 90
        2: filler[:9] + altered(item[10:60], 9) + filler[9:],  # one in nine altered
        3: item[10:44],  # 34 words
        4: filler[:40] + short[5:26] + filler[40:],  # 21 of 30
        5: filler[:40] + short[5:24] + filler[40:],  # 19 of 30
        6: altered(item[:60], 4),  # one in four
        7: ["|"] + " \n| ".join(" ".join(item[i : i + 7]) for i in range(0, 49, 7)).split(" "),
        8: ["<b>" + w.upper() + "</b>," for w in short],
        9: item[60:90] + filler[:30] + item[30:60] + filler[30:60] + item[0:30],  # reordered: coverage only
    }
    rows = [(i, " ".join(w), 1) for i, w in cases.items()] + [(20, None, 1), (21, "", 1), (1, " ".join(cases[1]), 1), (None, " ".join(item), 1)]
    rows.append((22, " ".join(filler * 600 + item), 1))  # a very long text
    corpus = spark.createDataFrame(rows, "row_id long, contents string, passage int")
    items = spark.createDataFrame([(101, " ".join(item), 1), (102, " ".join(short), 1), (103, " ".join(item), 1), (104, None, 1), (105, " ", 1), (None, " ".join(short), 1)], "eval_id long, text string, need int")
    got = leakage.find_leaks(corpus, items)
    found = sorted(((r.row_id, r.eval_id) for r in got.where("passage").collect()), key=str)
    want = [(r, e) for r in (1, 1, 2, 7, None, 22) for e in (101, 103)] + [(r, e) for r in (4, 8) for e in (102, None)]
    assert found == sorted(want, key=str)
    nine = [r for r in got.collect() if r.row_id == 9]
    assert {r.eval_id for r in nine} == {101, 103} and all(r.coverage > 0.95 and not r.passage for r in nine)
    blocks = leakage.find_leaks(corpus, items, block_chars=200)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, got.collect()))
    assert leakage.find_leaks(corpus.limit(0), items).count() == 0 == leakage.find_leaks(corpus, items.limit(0)).count()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(12, 120), st.integers(0, 30))
def test_candidates_lose_no_passage(seed, n, skip):
    """Any passage of the needed length with one word in eight altered survives the seed count."""
    item = words(n, seed)
    index = leakage.ItemIndex([(1, " ".join(item))])
    need = int(index.need[0])
    start = random.Random(seed).randint(0, n - need)
    part = [w if (i + seed) % 8 else "zz" + w for i, w in enumerate(item[start : start + need])]
    if sum(a != b for a, b in zip(part, item[start : start + need], strict=True)) * 8 > need:
        return
    row = words(skip, seed + 1, "q") + part + words(5, seed + 2, "q")
    ids = np.array([index.vocab.get(w, -1) for w in row] + [-1] * 5, np.int64)
    assert [0, 0] in leakage.candidates(index, ids, np.zeros(len(ids), np.int64)).tolist()


def test_intact_words_between_altered_ones_count(spark):
    """Runs of one or two equal words between altered words belong to the passage."""
    item = words(100, 4)
    cases = {
        1: [w if i not in (12, 14, 27, 29) else "zz" for i, w in enumerate(item[20:60])],  # 4 of 40
        2: [w if i not in (2, 4, 6, 33) else "zz" for i, w in enumerate(item[20:55])],  # 4 of 35
        3: [w if i not in (10, 11, 22, 24) else "zz" for i, w in enumerate(item[20:52])] + ["q"],  # 4 of 32
        4: [w if i not in (2, 12, 14, 27, 29) else "zz" for i, w in enumerate(item[20:59])],  # 5 of 39
    }
    corpus = spark.createDataFrame([(i, " ".join(w)) for i, w in cases.items()], "row_id long, contents string")
    items = spark.createDataFrame([(7, " ".join(item))], "eval_id long, text string")
    got = {r.row_id: (r.passage_words, r.altered, r.passage_start) for r in leakage.find_leaks(corpus, items).where("passage").collect()}
    # of 5 in 39 the words behind the first altered one are 4 in 36
    assert got == {1: (40, 4, 0), 2: (35, 4, 0), 4: (36, 4, 3)}


def slow_passage(a, b):
    """Item words of the longest passage, by edit distance from every pair of equal words."""
    best = 0
    for x in range(len(a)):
        for y in range(len(b)):
            if a[x] != b[y]:
                continue
            cost = {(0, 0): 0}
            best = max(best, 1)
            for i in range(len(a) - x):
                for j in range(len(b) - y):
                    if i and j:
                        equal = a[x + i] == b[y + j]
                        if equal and cost[i - 1, j - 1] * 8 <= j + 1:
                            best = max(best, j + 1)
                        cost[i, j] = min(cost[i - 1, j - 1] + (not equal), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
                    elif i or j:
                        cost[i, j] = i + j
    return best


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(9, 24))
def test_longest_passage_as_by_edit_distance(seed, n):
    r = random.Random(seed)
    b, a = list(range(n)), [-1] * r.randint(0, 3)
    for w in b:
        u = r.random()
        a += [-1] if u < 0.07 else [w, -1] if u < 0.11 else [] if u < 0.14 else [w]
    need, right = leakage.words_needed(n), slow_passage(a, b)
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    got = leakage.longest_passage(a, b, need, leakage.passage_runs(leakage.runs(a, b), need, n))[0]
    assert got == right if right >= need else got < need


@pytest.mark.parametrize(("n", "part", "changed"), [(34, 24, (5, 11, 17)), (10, 10, (4,)), (9, 8, (3,)), (60, 40, (7, 15, 20, 25, 32))])
def test_passage_beyond_the_needed_length_is_a_candidate(n, part, changed):
    """A passage over the next multiple of eight may have one more word altered and keep fewer seeds."""
    item = words(n, 6)
    index = leakage.ItemIndex([(1, " ".join(item))])
    row = ["q"] * 7 + [w if i not in changed else "zz" for i, w in enumerate(item[:part])] + ["q"] * 7
    ids = np.array([index.vocab.get(w, -1) for w in row], np.int64)
    assert [0, 0] in leakage.candidates(index, ids, np.zeros(len(ids), np.int64)).tolist()
    need = int(index.need[0])
    assert leakage.longest_passage(ids, index.words[0], need, leakage.runs(ids, index.words[0], min(3, need)))[0] == part


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 120))
def test_candidates_lose_no_passage_of_any_length(seed, n):
    r, item = random.Random(seed), words(n, seed)
    index = leakage.ItemIndex([(1, " ".join(item))])
    part = item[: r.randint(int(index.need[0]), n)]
    for i in sorted(r.sample(range(len(part)), len(part) // 8), reverse=True):
        part[i : i + 1] = r.choice((["zz"], ["zz", part[i]], []))
    ids = np.array([index.vocab.get(w, -1) for w in ["q"] * r.randint(0, 9) + part] + [-1] * 5, np.int64)
    assert [0, 0] in leakage.candidates(index, ids, np.zeros(len(ids), np.int64)).tolist()


def test_late_passage_of_a_very_long_item_is_a_candidate():
    item = words(9000, 8)
    index = leakage.ItemIndex([(1, " ".join(item)), (2, " ".join(words(70, 9)))])
    ids = np.array([index.vocab[w] for w in item[8900:8940]] + [-1] * 5, np.int64)
    assert leakage.candidates(index, ids, np.zeros(len(ids), np.int64)).tolist() == [[0, 0]]


@pytest.mark.parametrize("size", [3, 4, 6])
def test_reordered_items_are_found(spark, size):
    """Items whose words stand in a row in blocks of a few words, in another order; recall is 1."""
    r = random.Random(size)
    stock = words(24, 99, "s")
    items, rows = [], []
    for i in range(40):
        item = words(80, 100 + i)
        if i % 2:  # stock words that all items share
            item[:24] = stock
        blocks = [item[k : k + size] for k in range(0, 80, size)]
        r.shuffle(blocks)
        items.append((i, " ".join(item)))
        kept = blocks[: -(-len(blocks) * 6 // 10)]
        rows.append((i, " ".join(w for b in kept for w in [*b, "zz"])))
    got = leakage.find_leaks(spark.createDataFrame(rows, "row_id long, contents string"), spark.createDataFrame(items, "eval_id long, text string"))
    found = {(g.row_id, g.eval_id): g.coverage for g in got.collect()}
    assert all(found.get((i, i), 0) >= 0.5 for i in range(40)) and set(found) == {(i, i) for i in range(40)}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 40), st.integers(2, 8))
def test_candidates_lose_no_coverage(seed, n, kinds):
    """Few kinds of words, so that many seeds are shared and held back."""
    r = random.Random(seed)
    items = [[f"k{r.randint(0, kinds)}" for _ in range(n)] for _ in range(4)]
    index = leakage.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)])
    row = [f"k{r.randint(0, kinds + 2)}" for _ in range(60)]
    ids = np.array([index.vocab.get(w, -1) for w in row], np.int64)
    pairs = leakage.candidates(index, np.r_[ids, [-1] * 5], np.zeros(65, np.int64)).tolist()
    for i in range(4):
        if sum(t[2] for t in leakage.tiles(ids, index.words[i])) >= leakage.COVERAGE * n:
            assert [0, i] in pairs


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=40), st.lists(st.integers(0, 3), max_size=30), st.integers(1, 50))
def test_runs_as_by_brute_force(a, b, cells):
    want = set()
    for x in range(len(a)):
        for y in range(len(b)):
            if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if n >= 3:
                    want.add((x, y, n))
    held, leakage.SEED_CELLS = leakage.SEED_CELLS, cells
    try:
        got = leakage.runs(np.array(a, np.int64), np.array(b, np.int64))
    finally:
        leakage.SEED_CELLS = held
    assert set(zip(*map(np.ndarray.tolist, got), strict=True)) == want


def test_one_word_again_and_again_takes_bounded_room(spark):
    """A row of 100,000 equal words against an item that says the word 500 times."""
    import resource

    index = leakage.ItemIndex([(1, "ha " * 500), (2, " ".join(words(60, 1)))])
    ids = np.zeros(100_000, np.int64)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert leakage.candidates(index, ids, np.zeros(len(ids), np.int64)).tolist() == [[0, 0]]
    common = leakage.runs(ids, index.words[0])
    assert leakage.longest_passage(ids, index.words[0], 35, leakage.passage_runs(common, 35, 500))[0] == 500
    assert sum(n for *_, n in leakage.tiles(ids, index.words[0])) == 500
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB


# ---- personal data

NAMES = [(g, "given") for g in ("Anna", "Rose", "May")] + [(h + t, "family") for h in ("Kelv", "Marn", "Tross", "Bolv") for t in ("ander", "etti", "quist", "oveski")][:-1]
TEXTS = {
    1: ("Contact: Anna Kelvander, +1 212 555 0147", {("name", "annakelvander"), ("phone", "12125550147")}),
    2: ("Write to ann.k+x@post.example.org or bob [at] mail [dot] example please.", {("email", "annkxpostexampleorg"), ("email", "bobatmaildotexample")}),
    3: ("SSN: 000-12-3456. Part number 321-54-9876 replaces it.", {("id_number", "000123456")}),
    4: ("Mr. Ilja Marnetti lives at 12 Oak Street, Flat 3, Dunmere 40213.", {("name", "iljamarnetti"), ("address", "12oakstreetflat3dunmere40213")}),
    5: ("The job ran as root@localhost with pkg@1.2.3 on 192.0.2.7; the Rose Festival was open.", set()),
    6: ("联系人：林远舟，电话 +44 7700 900123。", {("name", "林远舟"), ("phone", "447700900123")}),
    7: ("They asked Bolvoveski, Anna and M. Trossquist to sign.", {("name", "bolvoveskianna"), ("name", "mtrossquist")}),
    8: ("Die Werkstatt liegt in der Hafenstraße 26, 33631 Neudorf.", {("address", "hafenstraße2633631neudorf")}),
    9: ("passport no. XX0686956 for anna kelvetti.", {("id_number", "xx0686956"), ("name", "annakelvetti")}),
}


def _docs(spark, copies=1):
    rows = [(i, t, "x") for i, (t, _) in TEXTS.items()] * copies + [(50, None, "x"), (51, "", "x"), (52, "1 " * 60_000 + "(" * 5000 + "a@" * 5000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, value string")


def test_personal_data_found_and_redacted(spark):
    names = spark.createDataFrame([*NAMES, (None, "given"), ("X", None)], "name string, kind string")
    got = {}
    for r in pii.personal_data(_docs(spark, 2), names).collect():
        got.setdefault(r.doc_id, []).append((r.pii_type, r.value))
    for i, (text, want) in TEXTS.items():
        assert sorted(got.get(i, [])) == sorted(want), text
    assert not {50, 51} & set(got)
    out = {r.doc_id: r for r in pii.redact(_docs(spark), names).collect()}
    assert out[1].text == "Contact: [NAME], [PHONE]" and out[50].text is None and out[51].text == ""
    assert out[4].text == "Mr. [NAME] lives at [ADDRESS]." and out[4].n_address == 1
    assert out[5].text == TEXTS[5][0]
    assert pii.personal_data(_docs(spark).limit(0), names).count() == 0
    assert pii.personal_data(_docs(spark), names.limit(0)).where("pii_type = 'email'").count() >= 2


def test_em_learns_that_a_labeler_is_noise():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth) for q in (0.9, 0.85, 0.8, 0.5)], axis=1)
    rows = ["".join("+" if x else "-" for x in v) for v in votes]
    patterns, counts = np.unique(rows, return_counts=True)
    q = pii.estimate(list(patterns), counts.astype(float))
    by = dict(zip(patterns, q, strict=True))
    assert by["+++-"] > 0.9 and by["---+"] < 0.1
    v = np.array([["-0+".index(c) - 1 for c in p] for p in patterns])
    w = pii.train(np.hstack([np.ones((len(v), 1)), v > 0, v < 0]).astype(float), counts.astype(float), q)
    assert abs(w[4] - w[8]) < 0.5 * abs(w[1] - w[5])  # the last labeler weighs little
    right = np.mean([(by[r] > 0.5) == t for r, t in zip(rows, truth, strict=True)])
    assert right > 0.9


def test_the_same_kinds_are_judged_alike_at_any_size():
    """Ten times the same spans give the same model."""
    rng = np.random.default_rng(4)
    kinds = {}
    for _ in range(300):
        real = rng.random() < 0.6
        p = "".join(rng.choice(["-", "0", "+"], p=[0.1, 0.4, 0.5] if real else [0.5, 0.4, 0.1]) for _ in range(6))
        k = (1, p, rng.choice(["40 nsp", "31-nsw"]) + rng.choice(["22", "42" if real else "02"]))
        kinds[k] = kinds.get(k, 0) + 1

    def model(times):
        votes = {}
        for (t, p, _), n in kinds.items():
            votes[t, p] = votes.get((t, p), 0) + n * times
        soft = pii.soft_labels([(*k, n) for k, n in votes.items()])
        words = pii.learn_words([(1, 0, 7, 100 * times, 90.0 * times), (1, 0, 9, 100 * times, 10.0 * times)])
        return pii.learn([(*k, n * times) for k, n in kinds.items()], soft, words)

    a, b = model(1), model(10)
    assert np.allclose(a.words.table, b.words.table) and a.words.table[1, 0, 7] > 1 > -1 > a.words.table[1, 0, 9]
    assert all(abs(a.probability(t, p + f) - b.probability(t, p + f)) < 1e-6 for t, p, f in kinds)


def test_form_and_words_around():
    text = "Call Ann: 020 7946 0001, please."
    assert pii.form_of(text, 10, 23) == "40 nsp"
    before, behind = pii.words_around(text, 10, 23)
    assert len(before) == 2 and len(behind) == 1 and pii.words_around("1", 0, 1) == ([], [])
    assert len(pii.FORM_LETTERS) == len(pii.form_of("", 0, 0))


def test_every_query_runs_on_the_smallest_data(spark, tiny):
    shown = {
        "p1_document_tokens": "doc_id tokens", "p1_token_budget": "dimension slice docs tokens", "p2_found": "doc_id", "p2_statistics": "doc_id distance outlier contributions",
        "p3_found": "row_id eval_id", "p3_leaks": "row_id eval_id coverage passage", "p3_item_report": "eval_id rows best_coverage", "p4_found": "row_id",
        "p4_pieces": "row_id piece_no token", "p5_sequences": "sequence_id doc_id n_tokens", "p5_fill": "fill closed_by_cost scalar_sequences",
        "p6_mixture": "doc_id subset copy_no", "p6_shares": "subset weight share", "p7_found": "doc_id pii_type value", "p7_redacted": "doc_id text n_name",
    }
    assert set(shown) == set(queries.queries())
    for name, query in queries.queries().items():
        out = query(spark, tiny)
        assert set(shown[name].split()) <= set(out.columns) and out.count() > 0, name
    assert queries.queries()["p7_redacted"](spark, tiny).count() == 100 == queries.queries()["p1_document_tokens"](spark, tiny).count()
    assert set(queries.oracle_sql()) <= set(queries.queries())
