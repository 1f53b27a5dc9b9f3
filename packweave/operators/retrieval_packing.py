"""Packing by lexical retrieval: similar documents of a shard go into the same sequence.

The greedy choice depends on all choices before, so a kernel runs it shard by shard. It reads a shard as a stream: first
the shard's term statistics, then its documents in packing order, of which it holds the buffer and one segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, BUFFER_SIZE, CHUNK_SIZE, EOS_ID, QUERY_TERMS, SEED_RETRIEVAL
from ..functions.tokens import order_key
from ..session import stage

MODES = ("star", "chain")
#: Most documents read ahead and indexed at once; about as many as the buffer holds.
SEGMENT = 2048
LEAST_SEGMENT = 64


@dataclass(frozen=True)
class PackingConfig:
    """Settings of retrieval packing.

    ``mode``: ``star`` asks with the first document of a sequence throughout, ``chain`` with the last one taken.
    ``chains``: 2 lets two chains grow in turn and mixes them in the fixed pseudo-random order of ``seed``.
    ``drop_mid``: a chain withholds its first, third, ... find and puts it back at the buffer's end. ``compat``:
    documents longer than a sequence are also buffered whole, buffered documents have no end marks, and a full buffer
    that can't fill a sequence ends the shard.
    """

    length: int = CHUNK_SIZE
    buffer: int = BUFFER_SIZE
    query_terms: int = QUERY_TERMS
    mode: str = "star"
    chains: int = 1
    drop_mid: bool = False
    min_rest: int = 2
    seed: int = SEED_RETRIEVAL
    compat: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.chains not in (1, 2):
            raise ValueError("one or two chains")


class Doc:
    """A buffered document: its ids still to be packed, and its place in the postings of the segment."""

    __slots__ = ("id", "ids", "terms", "slot", "text", "weights")

    def __init__(self, ident: int, ids: np.ndarray, text: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.id, self.ids, self.text, self.terms, self.weights, self.slot = ident, ids, text, terms, weights, -1

    def rest(self, ids: np.ndarray) -> Doc:
        """What is left of a document goes on as that document."""
        out = Doc(self.id, ids, self.text, self.terms, self.weights)
        out.slot = self.slot
        return out


class ShardStatistics:
    """Documents, mean length and document frequencies of a whole shard; terms are hashes."""

    def __init__(self, n: int, length: float, terms: np.ndarray, df: np.ndarray):
        order = np.argsort(terms)
        self.n, self.mean = n, max(length / max(n, 1), 1e-9)
        self.terms, self.df = terms[order], df[order]

    def doc(self, ident: int, ids: np.ndarray, text: np.ndarray) -> Doc:
        """A document with the BM25 weight of each of its terms."""
        terms, tf = np.unique(text, return_counts=True)
        df = self.df[np.searchsorted(self.terms, terms)] if len(terms) else np.zeros(0)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        weights = idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * len(text) / self.mean))
        return Doc(ident, ids, text, terms, weights)


class Postings:
    """Terms of some documents by term; gives each its slot."""

    def __init__(self, docs: list[Doc]):
        for i, d in enumerate(docs):
            d.slot = i
        self.n = len(docs)
        flat = np.concatenate([np.zeros(0, np.int64), *[d.terms for d in docs]])
        order = np.argsort(flat, kind="stable")
        self.slot = np.repeat(np.arange(self.n), [len(d.terms) for d in docs])[order] if self.n else np.zeros(0, np.int64)
        self.weight = np.concatenate([np.zeros(0), *[d.weights for d in docs]])[order]
        self.terms, self.first = np.unique(flat[order], return_index=True)
        self.last = np.r_[self.first[1:], len(flat)]

    def ranked(self, asked: Doc, among: list[Doc], cfg: PackingConfig) -> list[Doc]:
        """Documents of ``among`` with a score above 0 for the text of ``asked``, best first, ties by id.

        Of a long text, ``query_terms`` of its terms ask, chosen by a fixed random order of the document.
        """
        text = asked.text
        if len(text) > cfg.query_terms:
            text = text[np.random.default_rng([cfg.seed, asked.id]).permutation(len(text))[: cfg.query_terms]]
        terms, counts = np.unique(text, return_counts=True)
        at = np.searchsorted(self.terms, terms)
        score = np.zeros(self.n)
        for k, c in zip(at.tolist(), counts.tolist(), strict=True):
            lo, hi = self.first[k], self.last[k]
            score[self.slot[lo:hi]] += c * self.weight[lo:hi]
        s = np.round(score[[d.slot for d in among]], 6)
        order = np.lexsort(([d.id for d in among], -s))
        return [among[i] for i in order[s[order] > 0]]


Packed = tuple[np.ndarray, list[int]]


class ShardPacker:
    """The buffer of one shard and what it does with each next document."""

    def __init__(self, cfg: PackingConfig, statistics: ShardStatistics):
        self.cfg, self.statistics = cfg, statistics
        self.buffer: list[Doc] = []
        self.rng = np.random.RandomState(cfg.seed)
        self.postings = Postings([])
        self.ended = False

    def add(self, segment: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[Packed]:
        """Take documents (id, tokens, terms) in their order; gives the sequences that come out."""
        docs = [self.statistics.doc(*d) for d in segment]
        self.postings = Postings([*self.buffer, *docs])
        for d in docs:
            if self.ended:
                return
            whole, ids = np.append(d.ids, EOS_ID), d.ids
            while len(whole) >= self.cfg.length:
                yield whole[: self.cfg.length], [d.id]
                whole = whole[self.cfg.length :]
            d.ids = ids if self.cfg.compat else whole
            if len(d.ids) > 1:
                self.buffer.append(d)
            while len(self.buffer) >= self.cfg.buffer:
                got = self._sequence()
                if got is None:
                    self.ended = self.cfg.compat
                    break
                yield got

    def finish(self) -> Iterator[Packed]:
        while not self.ended and len(self.buffer) > 1 and (got := self._sequence()) is not None:
            yield got

    def _sequence(self) -> Packed | None:
        return self._star() if self.cfg.mode == "star" else self._chain()

    def _star(self) -> Packed | None:
        """The first of the buffer asks for all; where nothing is left to find, the lowest ids follow."""
        first, rest = self.buffer[0], sorted(self.buffer[1:], key=lambda d: d.id)
        hits = self.postings.ranked(first, rest, self.cfg) if rest else []
        found = set(map(id, hits))
        taken, total = [first], len(first.ids)
        for d in [*hits, *[d for d in rest if id(d) not in found]]:
            if total >= self.cfg.length:
                break
            taken.append(d)
            total += len(d.ids)
        return self._cut(taken, taken, rest, [])

    def _chain(self) -> Packed | None:
        """One or two chains in turn, each asking with its last find.

        A chain whose only find is already the other's finds nothing in that turn and asks again with the same text.
        """
        k = self.cfg.chains
        asking = self.buffer[:k]
        chains = [[d] for d in asking]
        rest = sorted(self.buffer[k:], key=lambda d: d.id)
        total, step, withheld = sum(len(d.ids) for d in asking), 0, []
        while total < self.cfg.length and rest:
            turn: list[tuple[int, Doc]] = []
            for c, d in enumerate(asking):
                hits = self.postings.ranked(d, rest, self.cfg)[:k] or rest[:1]
                new = next((h for h in hits if all(h is not x for _, x in turn)), None)
                if new is not None:
                    turn.append((c, new))
            for c, d in turn:
                rest = [x for x in rest if x is not d]
                asking[c] = d
                if self.cfg.drop_mid and step % 2 == 0:
                    withheld.append(d)
                    continue
                chains[c].append(d)
                total += len(d.ids)
                if total >= self.cfg.length:
                    break
            step += 1
        labels = [c for c, chain in enumerate(chains) for _ in chain]
        if total >= self.cfg.length and k == 2:
            self.rng.shuffle(labels)
        each = [iter(chain) for chain in chains]
        order = [next(each[c]) for c in labels]
        return self._cut(order, [*order, *withheld], rest, withheld)

    def _cut(self, order: list[Doc], gone: list[Doc], rest: list[Doc], back: list[Doc]) -> Packed | None:
        """One sequence of ``order``; the buffer becomes the rest by rising id, ``back``, then what was cut off."""
        ids = np.concatenate([d.ids for d in order])
        if len(ids) < self.cfg.length:
            return None
        out = set(map(id, gone))
        self.buffer = [*[d for d in rest if id(d) not in out], *back]
        left = ids[self.cfg.length :]
        if len(left) >= self.cfg.min_rest:
            self.buffer.append(order[-1].rest(left))
        return ids[: self.cfg.length], [d.id for d in order]


def pack_shard(docs: list[tuple[int, np.ndarray, np.ndarray]], cfg: PackingConfig, segment: int = SEGMENT) -> list[Packed]:
    """All sequences of a shard whose documents (id, tokens, term numbers) come in packing order."""
    flat = np.concatenate([np.zeros(0, np.int64), *[np.unique(t) for _, _, t in docs]])
    terms, df = np.unique(flat, return_counts=True)
    packer = ShardPacker(cfg, ShardStatistics(len(docs), float(sum(len(t) for *_, t in docs)), terms, df))
    out = [x for i in range(0, len(docs), segment) for x in packer.add(docs[i : i + segment])]
    return [*out, *packer.finish()]


PACKED = "subset string, split int, chunk_seq int, input_ids array<int>, docs array<bigint>"


def _array(x) -> np.ndarray:
    return np.asarray(x if x is not None else [], np.int64)


def retrieval_chunks(shards: DataFrame, cfg: PackingConfig, segment: int | None = None) -> DataFrame:
    """Sequences of each shard. ``shards``: subset, split, internal_idx, token, terms; documents in the fixed order of
    ``cfg.seed``. Null tokens make no part of a sequence. Terms travel as hashes; a shard's document frequencies go
    ahead of its documents in the same stream, so nothing but the buffer and these counts is held."""
    segment = segment or max(LEAST_SEGMENT, min(SEGMENT, cfg.buffer))
    hashed = shards.select(
        "subset", "split", "internal_idx", "token", F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.xxhash64(t)).alias("terms")
    )
    zero = F.lit(0).cast("bigint")  # not null: pandas would make numbers with nulls inexact
    hashed = stage(hashed, "terms")  # texts are cut into terms once, for the counts and for the documents
    docs = hashed.select(
        "subset", "split", F.lit(2).alias("kind"), order_key(cfg.seed, F.col("internal_idx")).alias("_key"), "internal_idx", "token", "terms", zero.alias("h"), zero.alias("n")
    )
    empty = [F.lit("").alias("_key"), zero.alias("internal_idx"), F.lit(None).cast("array<int>").alias("token"), F.lit(None).cast("array<bigint>").alias("terms")]
    counts = hashed.groupBy("subset", "split").agg(F.sum(F.size("terms")).alias("h"), F.count(F.lit(1)).alias("n"))
    met = hashed.select("subset", "split", F.explode(F.array_distinct("terms")).alias("h")).groupBy("subset", "split", "h").agg(F.count(F.lit(1)).alias("n"))
    stream = docs.unionAll(counts.select("subset", "split", F.lit(0), *empty, "h", "n")).unionAll(met.select("subset", "split", F.lit(1), *empty, "h", "n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packer, made, size = None, None, 0, (0, 0.0)
        terms: list[np.ndarray] = []
        df: list[np.ndarray] = []
        ahead: list = []

        def rows(found: Iterator[Packed]) -> pd.DataFrame:
            nonlocal made
            out = []
            for ids, used in found:
                out.append((*shard, made, ids.astype("int32"), used))
                made += 1
            return pd.DataFrame(out, columns=names)

        def through(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal packer, ahead
            if packer is None and shard is not None:
                packer = ShardPacker(cfg, ShardStatistics(size[0], size[1], np.concatenate([np.zeros(0, np.int64), *terms]), np.concatenate([np.zeros(0, np.int64), *df])))
            while packer is not None and (len(ahead) >= segment or last and ahead):
                yield rows(packer.add(ahead[:segment]))
                ahead = ahead[segment:]
            if packer is not None and last:
                yield rows(packer.finish())

        for batch in batches:
            for key, part in batch.groupby(["subset", "split", "kind"], sort=True, dropna=False):
                name, kind = key[:2], key[2]
                if kind == 0:
                    yield from through(True)
                    shard, packer, made, terms, df, ahead = (name[0], int(name[1])), None, 0, [], [], []
                    size = (int(part["n"].iloc[0]), float(part["h"].iloc[0]))
                elif kind == 1:
                    terms.append(part["h"].to_numpy(np.int64))
                    df.append(part["n"].to_numpy(np.int64))
                else:
                    ahead += [(int(i), _array(t), _array(w)) for i, t, w in zip(part["internal_idx"], part["token"], part["terms"], strict=True)]
                    yield from through(False)
        yield from through(True)

    names = [c.split()[0] for c in PACKED.split(", ")]
    known = stream.where("subset is not null and split is not null and internal_idx is not null")
    return known.repartition("subset", "split").sortWithinPartitions("subset", "split", "kind", "_key", "internal_idx").mapInPandas(run, PACKED)
