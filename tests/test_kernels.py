"""Kernels and columns against plain loops."""

import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packweave.functions import text, tokens, zeta
from packweave.operators import analysis, blend, corpus, ordering, packing, retrieval, retrieval_packing

TEXTS = ["The Apple!", "an-other", "a_b the", "à la carte", "", "A  the\tan x", "3 Ants, a.m."]


def test_answers(spark):
    want = {t: text.normalize_answer(t) for t in TEXTS}
    assert want["The Apple!"] == "apple" and want["an-other"] == "another" and want["a_b the"] == "ab"
    assert want["à la carte"] == "̀ la carte"
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    rows = df.select("t", text.normalized_answer("t").alias("u"), text.normalized_answer_ascii(F.col("t")).alias("a")).collect()
    for r in rows:
        if r.t is None:
            assert r.u is None and r.a is None
        else:
            assert r.u == want[r.t]
            if r.t.isascii():
                assert r.a == want[r.t]


def test_prediction_rule(spark):
    df = spark.createDataFrame([("  yes \n no",), ("\n\n a\tb 　\nc",), (" ",), (None,)], "t string")
    got = [r.p for r in df.select(text.normalized_prediction(F.col("t")).alias("p")).collect()]
    assert got == ["yes", "a\tb", "", None]


def test_stems():
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing hopping:hop hoping:hope happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam triplicate:triplic hopefulness:hope goodness:good revival:reviv adoption:adopt probate:probat rate:rate controll:control roll:roll generalizations:gener oscillators:oscil"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert text.porter_stem(word) == stem, word


def test_zeta_and_grid():
    assert abs(np.exp(zeta.log_zeta(np.array([2.0])))[0] - np.pi**2 / 6) < 1e-11
    counts = np.array([1, 1, 2, 5, 9, 1, 3, 1])
    n, s = len(counts), np.log(counts).sum()
    fine = zeta.fit_exponent(np.array([n]), np.array([s]))[0]
    grid = np.arange(1.01, 10, 0.0005)
    assert abs(grid[np.argmin(n * zeta.log_zeta(grid) + grid * s)] - fine) < 1e-3
    assert zeta.fit_exponent(np.array([5]), np.array([0.0]))[0] > 9.99  # all counts 1
    g, slopes = zeta.grid()
    best = g[np.argmin(n * zeta.log_zeta(g) + g * s)]
    assert g[np.searchsorted(-slopes, -(s / n))] == best


def random_docs(seed, n=40, top=30):
    r = random.Random(seed)
    return [(i, [r.randint(3, 99) for _ in range(r.choice([0, 1, 5, r.randint(0, top)]))]) for i in range(n)]


def test_concat_chunks_equals_a_loop(spark):
    docs = random_docs(1) + [(100, [7] * 60), (101, None)]
    df = spark.createDataFrame(docs, "doc_id int, token array<int>").withColumn("token", tokens.with_eos(F.col("token")))
    got = {r.chunk_id: r.input_ids for r in packing.concat_chunks(df, 16, 5).collect()}
    import hashlib

    order = sorted(docs, key=lambda d: (hashlib.md5(f"5-{d[0]}".encode()).hexdigest(), d[0]))
    flat = [x for _, t in order for x in [*(t or []), 2]]
    assert got == {k: flat[k * 16 : k * 16 + 16] for k in range(len(flat) // 16)}


def test_running_is_the_same_for_any_partitioning(spark):
    rows = [(i, f"{random.Random(i).getrandbits(32):08x}", i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, key string, g int")
    want = {}
    for g in range(3):
        pos = total = 0
        for i, _, _ in sorted((r for r in rows if r[2] == g), key=lambda r: (r[1], r[0])):
            want[i] = (pos, total)
            pos, total = pos + 1, total + i
    for parts, digits in ((1, 1), (7, 2), (3, 4)):
        got = ordering.running(df.repartition(parts), ["g"], ["key", "id"], F.col("id"), digits)
        assert {r.id: (r.run_pos, r.run_before) for r in got.collect()} == want


def test_shards_equal_the_loop(spark):
    docs = [(i, "s", 1, len(t)) for i, t in random_docs(4, 120, 200)]
    df = spark.createDataFrame(docs, "doc_id int, subset string, chunk_cid int, n_tokens int")
    config = spark.createDataFrame([(0, "s", 1.0, 5)], "subset_idx int, subset string, weight double, n_splits int")
    total = int(sum(d[3] for d in docs) * 0.8)
    got = {r.doc_id: (r.split, r.internal_idx) for r in corpus.assign_shards(df, config, total, 9).collect()}
    import hashlib

    each = -(-total // 5)
    want, split, idx, run = {}, 0, 0, 0
    for d in sorted(docs, key=lambda d: (hashlib.md5(f"9-{d[0]}".encode()).hexdigest(), d[0])):
        if want and run > each * (split + 1):
            split, idx = split + 1, 0
        want[d[0]] = (split, idx)
        idx += 1
        run += d[3]
        if run > total:
            break
    assert got == want


def test_pad_and_fragments(spark):
    docs = [(1, list(range(3, 13))), (2, [5]), (3, []), (4, None), (5, [3, 4, 5, 6]), (6, [3, 4, 5, 6, 7])]
    df = spark.createDataFrame(docs, "doc_id int, token array<int>")
    got = {(r.doc_id, r.piece_no): (r.input_ids, r.labels) for r in packing.pad_chunks(df, 4).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (5, 0), (6, 0)}
    assert got[(1, 2)] == ([11, 12, 0, 0], [11, 12, -100, -100])
    chunks = spark.createDataFrame([(0, [3, 2, 2, 4]), (1, [2]), (2, [5, 6, 2])], "chunk_id long, input_ids array<int>")
    lens = {r.chunk_id: r.fragment_lens for r in packing.with_fragments(chunks).collect()}
    assert lens == {0: [2, 1, 1], 1: [1], 2: [3]}
    pairs = {r.chunk_id: r.pairs for r in packing.mask_pairs(chunks).collect()}
    rows = {r.chunk_id: r["count"] for r in packing.mask_pair_rows(chunks).groupBy("chunk_id").count().collect()}
    assert pairs == rows
    wide = spark.createDataFrame([(0, [2] * 65 + [3])], "chunk_id long, input_ids array<int>")
    one = wide.select(packing.pad_fragments(packing.fragment_lens(F.col("input_ids"))).alias("x")).first().x
    assert len(one) == 66 and -1 not in one and packing.few_fragments(wide).count() == 1
    frag = {(r.chunk_id, r.fragment): r.input_ids for r in analysis.fragments(chunks).collect()}
    assert frag[(0, 0)] == [3, 2] and frag[(0, 2)] == [4] and frag[(2, 0)] == [5, 6, 2] and (2, 1) not in frag


def test_blend_ends_early_or_fails(spark):
    config = spark.createDataFrame([(0, "a", 0.5, 1), (1, "b", 0.5, 1)], "subset_idx int, subset string, weight double, n_splits int")
    order = blend.blend_order(config, 20, 3)
    have = spark.createDataFrame([("a", i, [i]) for i in range(50)] + [("b", i, [i]) for i in range(4)], "subset string, chunk_id long, input_ids array<int>")
    got = sorted((r.pos, r.subset, r.occ) for r in blend.blend(order, have).collect())
    asked = sorted((r.pos, r.subset, r.occ) for r in order.collect())
    stop = next(p for p, s, o in asked if s == "b" and o >= 4)
    assert got == [x for x in asked if x[0] < stop]
    import pytest

    with pytest.raises(Exception, match="no sequence left"):
        blend.blend(order, have, strict=True).collect()


def loop_score(terms, q, d):
    """BM25 of document d for the text of q, from scratch, with the counts of all documents."""
    n, mean, s = len(terms), sum(map(len, terms.values())) / len(terms), 0.0
    for w in set(terms[q]):
        tf = terms[d].count(w)
        if tf:
            df = sum(w in t for t in terms.values())
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            s += terms[q].count(w) * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms[d]) / mean))
    return round(s, 6)


def loop_packing(docs, cfg):
    """The buffering loop one step at a time: documents are (id, tokens, terms), in packing order."""
    terms = {i: t for i, _, t in docs}
    out, buffer = [], []
    rng = np.random.RandomState(cfg.seed)

    def search(query, ids, most):
        scored = sorted(((-loop_score(terms, query, i), i) for i in ids))
        return [i for s, i in scored if s < 0][:most]

    def one():
        nonlocal buffer
        held = list(buffer)
        k = cfg.chains if cfg.mode == "chain" else 1
        current = [held.pop(0) for _ in range(k)]
        chains = [[c] for c in current]
        have = sum(len(t) for _, t in current)
        place = {i: x for x, (i, _) in enumerate(held)}
        rest = sorted(place)
        waiting, step = [], 0
        while have < cfg.length and rest:
            got = []
            for c in range(k):
                asks = chains[0][0] if cfg.mode == "star" else current[c]
                hits = search(asks[0], rest, k) or [rest[0]]
                got.append(next((h for h in hits if h not in got), None))
            for c, hit in enumerate(got):
                if hit is None:
                    continue
                rest.remove(hit)
                current[c] = held[place[hit]]
                if cfg.mode == "chain" and cfg.drop_mid and step % 2 == 0:
                    waiting.append(hit)
                    continue
                chains[c].append(held[place[hit]])
                have += len(held[place[hit]][1])
                if have >= cfg.length:
                    break
            step += 1
        if have < cfg.length:
            return False
        buffer = [held[place[i]] for i in rest + waiting]
        labels = [c for c in range(k) for _ in chains[c]]
        if k == 2:
            rng.shuffle(labels)
        each = [iter(c) for c in chains]
        order = [next(each[c]) for c in labels]
        flat = [t for _, ids in order for t in ids]
        if len(flat) - cfg.length >= 2:
            buffer.append((order[-1][0], flat[cfg.length :]))
        out.append((flat[: cfg.length], [i for i, _ in order]))
        return True

    for i, t, _ in docs:
        whole = [*t, 2]
        while len(whole) >= cfg.length:
            out.append((whole[: cfg.length], [i]))
            whole = whole[cfg.length :]
        kept = list(t) if cfg.compat else whole
        if len(kept) > 1:
            buffer.append((i, kept))
        while len(buffer) >= cfg.buffer:
            if not one():
                if cfg.compat:
                    return out
                break
    while len(buffer) > 1 and one():
        pass
    return out


def _random_shard(r, n):
    order = r.sample(range(100), n)
    docs = [(i, [1000 * i + k + 3 for k in range(r.choice([0, 1, r.randint(0, 30)]))], [r.choice("abcdefghij") for _ in range(r.randint(0, 8))]) for i in order]
    return docs if any(t for *_, t in docs) else [(i, t, ["a"]) for i, t, _ in docs]


def _kernel(docs, cfg, segment):
    return [(x.tolist(), u) for x, u in retrieval_packing.pack_shard([(i, np.array(t, np.int64), np.array([ord(c) for c in w], np.int64)) for i, t, w in docs], cfg, segment)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.booleans(), st.sampled_from([1, 3, 100]))
def test_star_packing_equals_the_loop(seed, compat, segment):
    r = random.Random(seed)
    docs = _random_shard(r, r.randint(2, 25))
    cfg = retrieval_packing.PackingConfig(length=16, buffer=5, query_terms=100, compat=compat)
    assert _kernel(docs, cfg, segment) == loop_packing(docs, cfg)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2]), st.booleans(), st.sampled_from([1, 100]))
def test_chain_packing_equals_the_loop(seed, chains, drop, segment):
    r = random.Random(seed)
    docs = _random_shard(r, r.randint(2, 25))
    cfg = retrieval_packing.PackingConfig(length=16, buffer=5, query_terms=100, mode="chain", chains=chains, drop_mid=drop)
    got = _kernel(docs, cfg, segment)
    assert got == loop_packing(docs, cfg)
    used = [t for x, _ in got for t in x if t != 2]
    assert len(used) == len(set(used)) and all(len(x) == 16 for x, _ in got)


def test_leftover_waits_behind_the_rest():
    """What is cut off a document goes behind the others, though its id is the lowest."""
    docs = [(5, [51] * 9, ["x"]), (1, [11] * 9, ["x"]), (7, [71] * 9, ["z"]), (8, [81] * 9, ["z"])]
    cfg = retrieval_packing.PackingConfig(length=15, buffer=4, query_terms=9)
    assert [u for _, u in _kernel(docs, cfg, 10)] == [[5, 1], [7, 8]]


def test_retrieval_chunks_of_shards_equal_the_kernel(spark):
    r = random.Random(4)
    shards = {("a", 0): _random_shard(r, 40), ("a", 1): _random_shard(r, 3), ("b", 0): _random_shard(r, 60), ("c", 0): [(1, [], [])]}
    rows = [(s, k, i, t or None, w, "x") for (s, k), docs in shards.items() for i, t, w in docs]
    df = spark.createDataFrame(rows, "subset string, split int, internal_idx long, token array<int>, terms array<string>, kind string").repartition(5)
    cfg = retrieval_packing.PackingConfig(length=16, buffer=6, query_terms=100)
    out = retrieval_packing.retrieval_chunks(df, cfg, 7).collect()
    import hashlib

    for (s, k), docs in shards.items():
        ordered = sorted(docs, key=lambda d: hashlib.md5(f"{cfg.seed}-{d[0]}".encode()).hexdigest())
        got = sorted([x for x in out if (x.subset, x.split) == (s, k)], key=lambda x: x.chunk_seq)
        assert [(x.input_ids, x.docs) for x in got] == loop_packing(ordered, cfg) and [x.chunk_seq for x in got] == list(range(len(got)))
    assert retrieval_packing.retrieval_chunks(df.limit(0), cfg).count() == 0


def test_search_prefers_and_restricts(spark):
    col = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["a", "a", "c"]), ("s", 3, ["d"]), ("s", 4, []), ("t", 5, ["a"])], "shard string, doc long, terms array<string>")
    index = retrieval.build_index(col)
    asked = spark.createDataFrame([("s", 9, "a"), ("s", 9, "zzz"), ("s", 8, "zzz")], "shard string, query long, term string")
    got = [(r.query, r.rank, r.doc) for r in retrieval.search(index, asked, 5).orderBy("rank").collect()]
    assert got == [(9, 1, 2), (9, 2, 1)]
    only = spark.createDataFrame([("s", 9, 1)], "shard string, query long, doc long")
    assert [r.doc for r in retrieval.search(index, asked, 5, candidates=only).collect()] == [1]
    assert retrieval.search(index, asked.limit(0), 5).count() == 0
    # only other documents of the same group, statistics of the whole shard, for any number of salts
    grouped = retrieval.build_index(col.withColumn("g", F.col("doc") % 2), ["g"])
    in_group = asked.withColumn("g", F.lit(0).cast("bigint"))
    for salts in (1, 3):
        got = retrieval.search(grouped, in_group, 5, within=["g"], salts=salts).collect()
        assert [(r.doc, r.score) for r in got] == [(r.doc, r.score) for r in retrieval.search(index, asked, 5).collect() if r.doc == 2]


def _loop_search(docs, asked, k, method):
    """Scores of every pair in decimals; rows of one document are added up."""
    n, avgdl = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(t for _, terms in docs for t in set(terms))
    out = []
    for query in sorted({q for q, _ in asked}):
        scores = {}
        for term, qtf in Counter(t for q, t in asked if q == query).items():
            for doc, terms in docs:
                tf = terms.count(term)
                if tf:
                    bm25 = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(terms) / avgdl)))
                    w = qtf * (bm25 if method == "bm25" else tf * math.log(n / df[term]))
                    scores[doc] = scores.get(doc, 0) + Decimal(repr(w)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
        rounded = [(-s.quantize(Decimal("1e-6"), ROUND_HALF_UP), d) for d, s in scores.items()]
        best = sorted(x for x in rounded if x[0] < 0)[:k]
        out += [(query, i + 1, d, float(-s)) for i, (s, d) in enumerate(best)]
    return out


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
@pytest.mark.parametrize("block", [1 << 20, 40])
def test_search_equals_a_loop_for_any_blocks(spark, monkeypatch, method, block):
    r = random.Random(7)
    texts = [[r.choice("abcdefghij") * r.choice((1, 1, 2)) for _ in range(r.choice((0, 1, 5, 12)))] for _ in range(40)]
    docs = [(i, texts[i % 25]) for i in range(40)] + [(3, ["a", "b"]), (3, ["a"])]  # equal texts, and a document in three rows
    asked = [(q, r.choice("abcdefghij")) for q in range(6) for _ in range(9)] + [(9, "zzz")]
    df = spark.createDataFrame([("s", q, t) for q, t in asked] + [("u", 1, "a")], "shard string, query long, term string")
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", block)
    for some, stored in ((docs, False), (docs[:40], True)):
        col = spark.createDataFrame([("s", d, t) for d, t in some] + [("t", 1, ["a"])], "shard string, doc long, terms array<string>").repartition(3)
        index = retrieval.build_index(col)
        if stored:  # an index that was loaded has no texts
            index = retrieval.Index(index.postings, index.docs, index.shards, index.terms)
        got = sorted((x.query, x.rank, x.doc, x.score) for x in retrieval.search(index, df, 4, method).collect())
        assert got == _loop_search(some, asked, 4, method)


@pytest.mark.parametrize("kind", ["bm25", "tfidf", "stemmed"])
def test_search_writes_no_pairs(spark, kind):
    n = 300
    often = F.when(F.col("id") % 2 == 0, "connected").otherwise("relating")
    col = spark.range(n).select(F.lit("s").alias("shard"), F.col("id").alias("doc"), F.array(often, F.lit("b"), F.concat(F.lit("x"), "id")).alias("terms"))
    if kind == "stemmed":
        col = col.withColumn("terms", text.stemmed_terms("terms"))
    asked = col.select("shard", F.col("doc").alias("query"), F.explode("terms").alias("term"))
    sc, joins = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(joins)
    spark.conf.set(joins, -1)
    sc.setJobGroup(f"no pairs {kind}", "")
    try:
        assert retrieval.search(retrieval.build_index(col), asked, 3, "tfidf" if kind == "tfidf" else "bm25").count() == 3 * n
    finally:
        spark.conf.set(joins, held)
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(f"no pairs {kind}") for s in tracker.getJobInfo(j).stageIds}
    written = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 0 < written < n * n / 4


def test_search_shuffles_a_part_of_the_terms(spark, monkeypatch):
    """What is written for the next stages is under a third of the terms' bytes, also where queries meet many blocks."""
    n, per = 3000, 80
    terms = F.transform(F.sequence(F.lit(1), F.lit(per)), lambda i: F.concat(F.lit("term"), F.pmod(F.xxhash64("id", i), F.lit(300))))
    col = spark.range(0, n, 1, 3).select(F.lit("s").alias("shard"), F.col("id").alias("doc"), terms.alias("terms"))
    asked = col.where("doc % 50 = 0").select("shard", F.col("doc").alias("query"), F.explode("terms").alias("term"))
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 1 << 15)
    sc = spark.sparkContext
    sc.setJobGroup("shuffled bytes", "")
    try:
        assert retrieval.search(retrieval.build_index(col), asked, 3, "tfidf").count() == 3 * n // 50
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("shuffled bytes") for s in tracker.getJobInfo(j).stageIds}
    written = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert 0 < written < n * per * len("term123") / 3


def test_packets_keep_ids_lengths_and_counts():
    damaged = pa.array([b"\xff\xfe"], pa.binary()).view(pa.string())
    flat = pa.concat_arrays([pa.array(["b", "a", "b", None, "", "a", "é", "c"]), damaged])
    lists = pa.ListArray.from_arrays(pa.array([0, 4, None, 4, 6, 7, 9], pa.int32()), flat)
    rows = pa.table({"shard": ["t", "s", "t", "s", "t", "s"], "_block": pa.array([1, 0, 1, 2, 0, 0], pa.int32()), "doc": [7, 8, None, 3, 3, 9], "terms": lists})
    packets = retrieval._packets(rows, ["shard", "_block"], "doc")
    assert packets.select(["shard", "_block", "ids"]).to_pylist() == [
        {"shard": "s", "_block": 0, "ids": [8, 9]}, {"shard": "s", "_block": 2, "ids": [3]}, {"shard": "t", "_block": 0, "ids": [3]}, {"shard": "t", "_block": 1, "ids": [7, None]},
    ]
    got = retrieval._opened(packets, False)
    words = got.words.to_pylist()
    assert got.ids.to_pylist() == [8, 9, 3, 3, 7, None] and got.lengths.tolist() == [0, 2, 2, 1, 4, 0]
    want = [(1, b"c", 1), (1, b"\xff\xfe", 1), (2, b"", 1), (2, b"a", 1), (3, "é".encode(), 1), (4, b"a", 1), (4, b"b", 2)]
    assert sorted((r, words[t], f) for r, t, f in zip(got.row.tolist(), got.term.tolist(), got.tf.tolist(), strict=True)) == want
    weighted = pa.table({"shard": ["s", "s"], "query": [1, 2], "terms": [["a", "b", "a"], ["b"]], "idf": [[0.1, 0.7, 0.1], [0.7]]})
    got = retrieval._opened(retrieval._packets(weighted, ["shard"], "query"), True)
    assert dict(zip(got.words.to_pylist(), got.idf.tolist(), strict=True)) == {b"a": 0.1, b"b": 0.7} and got.tf.tolist() == [2, 1, 1]
    assert len(retrieval._packets(rows.slice(0, 0), ["shard", "_block"], "doc")) == 0


def test_index_is_saved_and_loaded(spark, tmp_path):
    col = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["a", "a", "c"]), ("s", 4, [])], "shard string, doc long, terms array<string>")
    index = retrieval.build_index(col)
    index.save(str(tmp_path / "index"))
    back = retrieval.Index.load(spark, str(tmp_path / "index"))
    for name in ("postings", "docs", "shards", "terms"):
        a, b = getattr(index, name), getattr(back, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert sorted((r.term, r.doc, r.tf, r.dl) for r in back.postings.collect()) == [("a", 1, 1, 2), ("a", 2, 2, 3), ("b", 1, 1, 2), ("c", 2, 1, 3)]


def test_long_position_ids_and_boundaries(spark):
    n = 8192
    df = spark.range(3).select(F.col("id").alias("chunk_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 100 == 99, 2).otherwise(3)).alias("input_ids"))
    mask = F.transform("input_ids", lambda x: (x != 2).cast("int"))
    got = df.select(packing.position_ids(mask).alias("p")).first().p
    assert len(got) == n and got[:3] == [0, 1, 2] and got[99] == 1 and got[100] == 99
    cu = packing.cumulative_boundaries(df, F.lit(0)).first().cu_seqlens
    assert cu[0] == 0 and cu[-1] == 3 * n and cu[1] == 100 and len(cu) == 3 * 82 + 1


def test_latest_delivery_and_lines(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.UTC)
    rows = [(1, "a", 0, 0, "xx", t(1)), (2, "a", 0, 0, "new", t(2)), (3, "a", 0, 1, None, None), (4, "a", 0, 3, "é", t(1)), (5, "a", 0, 3, "é", t(1)), (6, "b", 0, 0, "z", t(1))]
    df = spark.createDataFrame(rows, "row_id long, subset string, split int, internal_idx long, contents string, written_at timestamp")
    kept = corpus.latest_delivery(df)
    assert {r.row_id for r in kept.collect()} == {2, 3, 5, 6}
    held, corpus.LINE_BLOCK = corpus.LINE_BLOCK, 2
    try:
        got = {(r.subset, r.internal_idx): r.byte_offset for r in corpus.line_offsets(kept, ["subset", "split"], "internal_idx", "contents").collect()}
        assert got == {("a", 0): 0, ("a", 1): 4, ("a", 3): 5, ("b", 0): 0}
        new = {r.row_id: r.n for r in corpus.renumbered(kept, ["subset", "split"], "internal_idx", "n").collect()}
        assert new == {2: 0, 3: 1, 5: 2, 6: 0}
    finally:
        corpus.LINE_BLOCK = held


def test_pairs_with_first_document_from_another_table(spark):
    first, docs = random_docs(8, 40, 40), random_docs(9, 60, 40)
    a, b = (spark.createDataFrame([(s, f"{i:04d}", t) for i, t in rows for s in ("s", "t")], "stream string, ord string, token array<int>") for rows in (first, docs))
    got = {}
    for r in analysis.document_pairs_of_two(a, b, 20, 10, [13]).orderBy("pair_no").collect():
        got.setdefault(r.stream, []).append(r.input_ids)
    heads, head = [], []
    for _, t in first:
        head = [*head, *t, 13]
        if len(head) >= 20:
            heads.append(head[-20:])
            head = []
    seconds = [[*t, 13][:10] for _, t in docs if len(t) + 1 >= 11]
    want = [x + y for x, y in zip(heads, seconds)]
    assert got == {"s": want, "t": want} and len(want) > 3


def test_pooled_deviation(spark):
    rng = random.Random(2)
    rows = [(1, i // 7, rng.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "layer int, batch int, v double")
    b = analysis.batch_statistics(df, ["layer"], "batch", "v")
    got = analysis.pooled(b, ["layer"]).first()
    x = np.array([r[2] for r in rows])
    assert abs(got.mean - x.mean()) < 1e-12 and abs(got.std - x.std()) < 1e-12 and got.n == 50


def test_document_pairs_equal_the_loop(spark):
    docs = random_docs(8, 60, 40)
    df = spark.createDataFrame([("s", f"{i:04d}", t) for i, t in docs], "stream string, ord string, token array<int>")
    got = [r.input_ids for r in analysis.document_pairs(df, 20, 10, [13]).orderBy("pair_no").collect()]
    want, head = [], []
    it = iter(docs)
    while True:
        try:
            while len(head) < 20:
                head += [*next(it)[1], 13]
            while True:
                t = [*next(it)[1], 13]
                if len(t) >= 11:
                    break
        except StopIteration:
            break
        want.append(head[-20:] + t[:10])
        head = []
    assert got == want


def test_blocks_are_numbered_without_gaps(spark):
    rows = [("a", b, k) for b, n in ((0, 3), (2, 5), (7, 1)) for k in range(n)] + [("b", 1, 0)]
    df = spark.createDataFrame(rows, "g string, b int, k int").repartition(4)
    out = packing.number_blocks(df, ["g"], ["b"], "k", "n").orderBy("g", "b", "k").collect()
    assert [r.n for r in out] == [*range(9), 0]


def test_locate_for_any_block(spark):
    ranges = spark.createDataFrame([("a", 0, 3, 3), ("b", 3, 3, 0), ("c", 3, 40, 37)], "f string, first long, behind long, lines long")
    want = {i: ("a", i) if i < 3 else ("c", i - 3) for i in range(40)}
    for block in (1, 4, 1 << 20):
        rows = corpus.locate(spark.range(-2, 45).withColumnRenamed("id", "idx"), ranges, block).collect()
        assert {r.idx: (r.f, r.line) for r in rows} == want and len(rows) == 40


def test_staged_tables_are_removed(spark, tmp_path):
    import os

    from packweave import session

    root = session.shared_dir(spark).removeprefix("file://") + "/packweave"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with session.staging():
        kept = session.stage(spark.range(5), "kept")
        assert kept.count() == 5 and len(set(os.listdir(root)) - before) == 1
        with pytest.raises(Exception, match="DIVIDE|divide|zero"):
            session.stage(spark.range(3).selectExpr("raise_error('divide') as x"), "failed")
        assert len(set(os.listdir(root)) - before) == 1
    assert set(os.listdir(root)) == before


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from packweave import session

    unset = SimpleNamespace(get=lambda *_: None)
    held = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: unset, _jsc=SimpleNamespace(sc=lambda: held))
    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(SimpleNamespace(conf=unset, sparkContext=context))
