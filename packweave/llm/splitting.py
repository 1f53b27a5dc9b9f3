"""Cut token sequences that exceed a limit into overlapping pieces at natural boundaries, by pointer doubling.

Every position of a sequence gets the farthest position at which a piece that begins there (its overlap with the
piece before included) may end. Squaring this successor table again and again, while collecting what the known cuts
reach, gives all greedy cuts in about log2(number of pieces) whole-array steps, with no loop from cut to cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import model_rows, table

LIMIT = 2048
OVERLAP = 128
#: Kinds of cuts, best first. ``end`` is the sequence's own end.
KINDS = ("paragraph", "line", "sentence", "word", "character", "none")
#: An overlap begins at most so many ids earlier than asked, so that no character (of up to four bytes) is split.
LEAD = 3
#: A better kind is taken only if the piece is then at least this part of the limit.
MIN_FILL = 0.5

# Marks that end a sentence, and marks that may follow them.
SENTENCE_ENDS = ".!?…。！？"
CLOSERS = "\"'”’»)]*_“"
WIDE_ENDS = "。！？"

PIECES = (
    "row_id string, piece_no int, n_pieces int, start long, end long, n_ids int, overlap int, cut_kind string, "
    "contents string, token array<int>"
)


class Pieces:
    """What the vocabulary says about each id, as arrays by id."""

    def __init__(self, rows: list[tuple[int, str]], byte_base: int = 3):
        size = max((i for i, _ in rows), default=0) + 1
        self.text: list[str] = [""] * size
        self.byte = np.full(size, -1, np.int16)
        self.space = np.zeros(size, bool)
        self.ends = np.zeros(size, bool)
        self.wide = np.zeros(size, bool)
        self.closes = np.zeros(size, bool)
        for i, p in rows:
            self.text[i] = p
            if byte_base <= i < byte_base + 256:
                self.byte[i] = i - byte_base
                continue
            self.space[i] = p.startswith("▁")
            bare = p.rstrip(CLOSERS)
            self.ends[i] = bare != "" and bare[-1] in SENTENCE_ENDS
            self.wide[i] = bare != "" and bare[-1] in WIDE_ENDS
            self.closes[i] = p != "" and bare == ""
        for raw, mark in (("\n", "nl"), ("\r", "cr"), (" ", "sp"), ("\t", "tab")):
            setattr(self, mark, byte_base + ord(raw))

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(bytes([b]) if (b := self.byte[i]) >= 0 else self.text[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace("▁", " ")

    def boundaries(self, ids: np.ndarray) -> np.ndarray:
        """Rank in KINDS of a cut before each position 0..n; 0 and n themselves get rank 0."""
        n = len(ids)
        rank = np.full(n + 1, 5, np.int8)
        byte = self.byte[ids]
        cont = (byte >= 0x80) & (byte < 0xC0)
        wide3 = self._wide_bytes(byte)
        rank[:n][~cont] = 4
        blank = (ids == self.nl) | (ids == self.cr) | (ids == self.tab)
        word = self.space[ids] | blank
        rank[1:n][word[1:] | blank[:-1]] = 3
        # a sentence has ended before i if the last id, closing marks aside, ends one
        ended, wide = self.ends[ids].copy(), self.wide[ids] | wide3
        for _ in range(3):
            ended[1:] |= self.closes[ids][1:] & ended[:-1]
            wide[1:] |= self.closes[ids][1:] & wide[:-1]
        rank[1:n][(ended[:-1] & word[1:]) | (wide[:-1] & ~self.closes[ids][1:])] = 2
        nl = ids == self.nl
        soft = nl | (ids == self.cr)
        rank[1:n][nl[:-1] & ~soft[1:]] = 1
        # a blank line before i: a newline, then only newlines or carriage returns, at least two newlines in all
        run = np.where(soft, np.cumsum(nl), 0)
        before = np.maximum.accumulate(np.where(soft, 0, np.cumsum(nl)))
        rank[1:n][nl[:-1] & ~soft[1:] & ((run - before)[:-1] >= 2)] = 0
        rank[0] = rank[n] = 0
        return rank

    def _wide_bytes(self, byte: np.ndarray) -> np.ndarray:
        """Where a wide sentence mark that is not in the vocabulary ends, written as three single bytes."""
        out = np.zeros(len(byte), bool)
        if len(byte) > 2:
            for mark in WIDE_ENDS:
                a, b, c = mark.encode()
                out[2:] |= (byte[:-2] == a) & (byte[1:-1] == b) & (byte[2:] == c)
        return out


def starts(rank: np.ndarray, overlap: int) -> np.ndarray:
    """Where a piece cut at each position begins: its overlap before, up to LEAD ids more so that no character is split.

    A longer run of continuation bytes is no character; there the overlap begins where it was asked for.
    """
    at = np.arange(len(rank))
    whole = np.maximum.accumulate(np.where(rank <= 4, at, 0))  # last position at or before that splits no character
    asked = np.maximum(at - overlap, 0)
    return np.where(asked - whole[asked] <= LEAD, whole[asked], asked)


def cut_points(rank: np.ndarray, limit: int, overlap: int, min_fill: float = MIN_FILL) -> np.ndarray:
    """Greedy cuts 0 = c0 < c1 < ... = n such that each piece [start of its overlap, next cut) has at most ``limit`` ids.

    Every piece brings at least one new id, as ``limit`` exceeds ``overlap`` + LEAD.
    """
    if limit <= overlap + LEAD:
        raise ValueError("the limit must exceed the overlap by more than LEAD")
    n = len(rank) - 1
    at = np.arange(n + 1)
    start = starts(rank, overlap)
    reach = np.minimum(start + limit, n)
    succ = reach.copy()  # where nothing better exists, a hard cut
    done = reach == n
    succ[done] = n
    floor = np.maximum(at + 1, start + int(limit * min_fill))
    last = [np.maximum.accumulate(np.where(rank <= r, at, 0)) for r in range(5)]
    for level, least in [(r, floor) for r in range(3)] + [(2, at + 1), (3, floor), (3, at + 1), (4, at + 1)]:
        to = last[level][reach]
        take = ~done & (to >= least)
        succ[take] = to[take]
        done |= take
    cuts, jump = np.zeros(1, np.int64), succ
    while jump[0] < n:
        cuts = np.concatenate([cuts, jump[cuts]])
        jump = jump[jump]
    return np.unique(np.concatenate([cuts, jump[cuts], [n]]))


def split_oversized(items: DataFrame, vocab: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every row of ``items`` (row_id, token) with more than ``limit`` ids above 2.

    Control ids are left out; ``start`` and ``end`` count the remaining ids. Each piece but the first begins with the
    ``overlap`` ids before its cut (up to 3 more, so that no character is split). Cuts are at paragraphs, lines,
    sentences, words, characters, in this order, and within a run of bytes that is no character only if it is longer
    than a piece; every piece goes on by at least one id, so damaged rows end too.
    Null tokens and null ids: no piece. Ids missing in the vocabulary stand for nothing but count. Rows stay in their
    partitions: there is no shuffle, and only long rows reach Python.
    """
    if not (0 <= overlap <= limit // 2 and limit > overlap + LEAD):
        raise ValueError("the overlap must be from 0 to half of the limit, and leave it more than LEAD ids")
    rows = model_rows(vocab.where("token_id >= 0 and piece is not null").select("token_id", "piece"), "the vocabulary")
    shared = items.sparkSession.sparkContext.broadcast([(int(i), p) for i, p in rows])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pieces(shared.value)
        for batch in batches:
            out = []
            for row_id, ids in zip(batch["row_id"], batch["ids"], strict=True):
                ids = np.asarray(ids, np.int64)
                seen = np.where(ids < len(known.text), ids, 0)  # unknown ids count, but stand for no text
                rank = known.boundaries(seen)
                cuts, begin = cut_points(rank, limit, overlap), starts(rank, overlap)
                n = len(cuts) - 1
                for k in range(n):
                    c, e = int(cuts[k]), int(cuts[k + 1])
                    s = int(begin[c]) if k else 0
                    kind = "end" if k == n - 1 else KINDS[rank[e]]
                    out.append((row_id, k, n, s, e, e - s, c - s, kind, known.decode(seen[s:e]), ids[s:e]))
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in PIECES.split(", ")]
    # ids pass Python as strings, so nulls and large numbers stay exact
    long_rows = items.select(F.col("row_id").cast("string").alias("row_id"), F.filter("token", lambda x: x > 2).alias("ids")).where(F.size("ids") > limit)
    return long_rows.mapInPandas(cut, PIECES).withColumn("row_id", F.col("row_id").cast("long"))


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "processed"), table(spark, sf_dir, "vocab"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The rows that the operator cut; each row has one first piece."""
    return p4_pieces(spark, sf_dir).where("piece_no = 0").select("row_id")
