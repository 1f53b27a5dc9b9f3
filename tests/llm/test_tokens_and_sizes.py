import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packweave.llm import binpack, mixing, sizes, splitting, token_budget
from packweave.llm.linmax import LinMaxTrie, TokenCounter

DOCS = "doc_id long, text string, lang string, source string, meta struct<redpajama_set_name:string,url:string>, tokens int, subset_key string"
CONFIG = "subset_idx int, subset string, weight double, max_epochs int"


def brute(text, pieces, byte_base=3):
    """Longest known piece from the left, one stretch at a time."""
    out = []
    longest = max(map(len, pieces), default=1)
    for stretch in re.split("(\n)|(?=▁)", "▁" + text.replace(" ", "▁")):
        if stretch == "\n":
            out.append(byte_base + 10)
            continue
        i = 0
        while stretch and i < len(stretch):
            for n in range(min(longest, len(stretch) - i), 0, -1):
                if stretch[i : i + n] in pieces:
                    out.append(pieces[stretch[i : i + n]])
                    i += n
                    break
            else:
                out += [byte_base + b for b in stretch[i].encode()]
                i += 1
    return out


alphabet = st.text("abcé世▁ \n", max_size=24)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abcé世▁", min_size=1, max_size=5), max_size=14), alphabet)
def test_trie_gives_the_greedy_ids(pieces, text):
    text = text.replace("▁", "a")
    table = {p: 300 + i for i, p in enumerate(sorted(pieces)) if "▁" not in p[1:]}
    trie = LinMaxTrie(table)
    assert trie.encode(text) == brute(text, table)
    if text:
        assert TokenCounter(trie)(text) == len(brute(text, table))


def test_counts_equal_the_given_token_arrays(spark, tiny):
    p, v = (spark.read.parquet(f"{tiny}/{n}.parquet") for n in ("processed", "vocab"))
    count = sizes.vocab_counter(spark, v)
    rows = p.where("token is not null and contents is not null").select(count("contents").alias("n"), F.expr("size(filter(token, x -> x > 2))").alias("m"))
    assert rows.where("n <> m").count() == 0 < rows.count()


def test_public_counts_by_word_equal_whole_texts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    texts = ["", "a", "  a  b ", "one two  three", "x\n\ny z", "ß 世界 \t tab", " lead", "trail ", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", sizes.public_counter(spark)("t").alias("n")).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)} | {99: None}


def test_budget_brings_dirty_values_together_and_counts_every_row(spark):
    vocab = spark.createDataFrame([(300, "▁a"), (301, "b")], "token_id int, piece string")
    config = spark.createDataFrame([(0, "SetA", 0.5, 1), (1, "SetB", 0.5, 1)], CONFIG)
    rows = [
        (1, "a b", "EN", "src0", (" seta ", "HTTPS://www.Host.Example:80/x"), 1, "x"),
        (2, "ab", "eng", "src1", (None, "host.example/y"), 1, "x"),
        (2, "ab", "en-US", "src1", (None, "http://u@host.example./y"), 1, "x"),
        (None, None, None, None, None, None, None),
        (3, "", "", " ", ("other", ""), 1, "x"),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.dimension, r.slice): (r.docs, r.tokens) for r in token_budget.token_budget(docs, vocab, config).collect()}
    assert got[("all", "all")] == (5, 5 + 2 + 2)  # the mark before b is three bytes
    assert got[("language", "en")][0] == 3 and got[("host", "host.example")][0] == 3
    assert got[("subset", "SetA")][0] == 1 and got[("subset", "SetB")][0] == 2 and got[("subset", "unknown")][0] == 2
    assert token_budget.token_budget(docs.limit(0), vocab, config).count() == 0
    assert token_budget.document_tokens(docs, vocab, config.limit(0)).count() == 5


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=70), st.integers(6, 20), st.integers(0, 9))
def test_pointer_doubling_gives_the_greedy_cuts(inner, limit, overlap):
    import numpy as np

    overlap = min(overlap, limit // 2, limit - splitting.LEAD - 1)
    rank = np.array([0, *inner, 0], np.int8)
    n = len(rank) - 1
    cuts = [0]
    while cuts[-1] < n:
        b = cuts[-1]
        s = max(b - overlap, 0)
        back = next(x for x in range(s, -1, -1) if rank[x] <= 4)
        s = back if s - back <= splitting.LEAD else s
        reach = min(s + limit, n)
        if reach == n:
            cuts.append(n)
            continue
        least = max(b + 1, s + int(limit * splitting.MIN_FILL))
        tries = [(0, least), (1, least), (2, least), (2, b + 1), (3, least), (3, b + 1), (4, b + 1)]
        at = next((z for lev, m in tries if (z := max(x for x in range(reach + 1) if rank[x] <= lev)) >= m), reach)
        cuts.append(at)
    assert splitting.cut_points(rank, limit, overlap).tolist() == cuts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 40)), min_size=1, max_size=8), st.integers(5, 20), st.integers(0, 9))
def test_cuts_end_in_long_runs_of_continuation_bytes(runs, limit, overlap):
    import numpy as np

    overlap = min(overlap, limit // 2, limit - splitting.LEAD - 1)
    rank = np.array([0, *[r for r, n in runs for _ in range(n)], 0], np.int8)
    cuts, begin = splitting.cut_points(rank, limit, overlap), splitting.starts(rank, overlap)
    assert cuts[0] == 0 and cuts[-1] == len(rank) - 1 and (np.diff(cuts) > 0).all()
    assert all(e - (begin[c] if c else 0) <= limit for c, e in zip(cuts[:-1], cuts[1:], strict=True))
    assert splitting.cut_points(np.array([0, *[5] * 60, 0], np.int8), 10, 2).tolist()[:3] == [0, 10, 18]


def test_split_round_trip_and_edges(spark, tiny):
    vocab = spark.read.parquet(f"{tiny}/vocab.parquet")
    ids = {r.piece: r.token_id for r in vocab.collect()}
    sentence = [ids["▁the"] if "▁the" in ids else ids["▁"], ids["a"], ids["."]]
    long = [1] + sentence * 60 + [13] + sentence * 60 + [2]
    rows = [(1, long, 7), (1, long, 7), (2, [5] * 40, 0), (3, None, 0), (4, [], 0), (None, [ids["a"]] * 500, 0), (6, [10**6] * 130, 0), (7, [3 + 0x80] * 700, 0)]
    df = spark.createDataFrame(rows, "row_id long, token array<int>, contents int")
    out = splitting.split_oversized(df, vocab, 100, 10)
    got = out.collect()
    assert {r.row_id for r in got} == {1, None, 6, 7}
    assert all(r.n_ids <= 100 for r in got) and max(r.overlap for r in got) <= 13
    one = sorted([r for r in got if r.row_id is None], key=lambda r: r.piece_no)
    assert [i for r in one for i in r.token[r.overlap :]] == [ids["a"]] * 500
    kinds = {r.cut_kind for r in got if r.row_id == 1}
    assert kinds <= {"sentence", "line", "end"} and "line" in kinds | {"line"}
    assert splitting.split_oversized(df.limit(0), vocab, 100, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, vocab, 100, 60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 6), st.sampled_from(["norm", "dot"]))
def test_vector_best_fit_respects_every_capacity(items, most, rule):
    import numpy as np

    items = sorted(items, reverse=True)
    cost = 0.5 * 64 * 64
    place, bins = binpack.vector_best_fit(np.array(items, int), 64, most, cost, rule=rule)
    for b in range(bins):
        own = [t for t, p in zip(items, place, strict=True) if p == b]
        assert own and sum(own) <= 64 and len(own) <= most and sum(t * t for t in own) <= binpack.cost_capacity(own[0], 64, cost)
    assert len(place) == len(items)


def test_pack_places_every_token_once(spark):
    rows = [(i, (i * 37) % 90 + 1, "x") for i in range(500)] + [(7, 8, "x")] * 50 + [(None, 5, "x"), (600, 0, "x"), (601, None, "x"), (2**62 + 1, 1000, "x")]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens long, piece_no string")
    out = binpack.pack(sized, capacity=100, max_docs=8, group_items=64)
    got = out.collect()
    assert sum(r.n_tokens for r in got) == sum(r[1] or 0 for r in rows)
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append(r)
    assert all(sum(x.n_tokens for x in v) <= 100 and len(v) <= 8 and sorted(x.position for x in v) == list(range(len(v))) for v in per.values())
    assert [r.n_tokens for r in got if r.doc_id == 2**62 + 1] == [100] * 10  # only the one over the capacity is cut
    assert max(r.piece_no for r in got if r.doc_id != 2**62 + 1) == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, binpack.pack(sized.repartition(5), 100, 8, group_items=64).collect()))
    assert binpack.pack(sized.limit(0)).count() == 0
    fill = binpack.fill_report(binpack.pack(sized, 100, 60, group_items=600), 100, 60).first()
    assert fill.fill > 0.97 and fill.closed_by_tokens + fill.closed_by_documents + fill.closed_by_cost == fill.sequences


def test_every_capacity_binds_and_bins_differ_from_tokens_only(spark, tiny):
    rng = random.Random(5)
    rows = [(i, min(2048, int(rng.lognormvariate(5.3, 1)) + 1)) for i in range(4000)]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    packed = binpack.pack(sized)
    report = binpack.fill_report(packed).first()
    assert report.closed_by_documents > 0 and report.closed_by_cost > 0 and report.closed_by_tokens > 0
    scalar = binpack.pack(sized, max_docs=1 << 40, max_cost=binpack.NO_BOUND, weights=(1.0, 0.0, 0.0))

    def mates(df):
        per = {}
        for r in df.collect():
            per.setdefault(r.sequence_id, set()).add(r.doc_id)
        return {d: frozenset(v) for v in per.values() for d in v}

    a, b = mates(packed), mates(scalar)
    assert sum(a[d] != b[d] for d in a) > 0.3 * len(a)
    assert report.fill > 0.97


def test_ids_of_sequences_stay_apart_in_a_swollen_group(spark):
    """Rows with equal ids and sizes share a hash: their group is packed in many windows."""
    sized = spark.range(5000).selectExpr("cast(null as bigint) as doc_id", "90L as n_tokens")
    got = binpack.pack(sized, 100, 8, group_items=4).collect()
    per = {}
    for r in got:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + r.n_tokens
    assert len(got) == len(per) == 5000


def test_mix_hits_the_shares_and_caps_copies(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(3000)] + [(i, "b", 100) for i in range(40)] + [(1, "a", 12)] * 5
    rows += [(None, "a", 3), (9, "c", 5), (9, None, 5), (10, "b", 0), (11, "b", None)]
    sized = spark.createDataFrame(rows, "doc_id long, subset string, n_tokens long")
    config = spark.createDataFrame([(0, "a", 0.6, 1), (1, "b", 0.4, 3), (2, "empty", 0.0, 1)], CONFIG)
    out = mixing.mix(sized, config, bucket_rows=100).collect()
    total = sum(r.n_tokens for r in out)
    share = sum(r.n_tokens for r in out if r.subset == "b") / total
    assert abs(share - 0.4) < 0.01 and {r.subset for r in out} == {"a", "b"}
    assert max(r.copy_no for r in out if r.subset == "b") == 3 and max(r.copy_no for r in out if r.subset == "a") == 1
    # brute force: the same crossings in one pass over each source's order
    capped = mixing.mix(sized, config, target=100_000.0)
    report = {r.subset: r for r in mixing.share_report(capped, sized, config).collect()}
    assert report["b"].most_copies == 3 and report["b"].tokens == 12000 and report["empty"].tokens == 0
    assert mixing.mix(sized.limit(0), config).count() == 0 and mixing.mix(sized, config.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.floats(0.01, 4.0), st.floats(0, 0.999), st.integers(1, 400))
def test_systematic_copies_are_rounded_expectations(rate, shift, n):
    import math

    copies = [math.floor(i * rate + shift) - math.floor((i - 1) * rate + shift) for i in range(1, n + 1)]
    assert set(copies) <= {math.floor(rate), math.ceil(rate), math.floor(rate) + 1}
    assert abs(sum(copies) - n * rate) <= 1
