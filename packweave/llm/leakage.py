"""Find held-out items whose text stands, in one passage or in reordered parts, in corpus rows: greedy string tiling.

1. Both sides become word lists: case, punctuation, markup, line prefixes and line breaks are put aside.
2. Seeds: word n-grams (Karp-Rabin hashes) that a row shares with an item are joined. A passage with few altered words
   keeps a known least number of n-grams within a narrow band of offsets, whatever its length, so pairs below that number
   hold no passage. For coverage, n-grams of a tile's least length are joined; the most frequent ones of each item are
   held back as long as they cover less than half of what is asked, and the others must cover the rest. Neither loses
   a link.
3. Passages: for each pair left, banded edit distance to both sides of each common run of words gives the longest
   passage within the allowed share of altered words, exactly.
4. Tiling: the longest common runs of words are marked again and again, none overlapping another; the share of the item
   under any tiles is its coverage, which also shows reordered passages.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table

SEED_WORDS = 5
MIN_TILE = 3
#: Altered or added words: at most one in so many.
ALTERED = 8
PASSAGE_WORDS = 35
COVERAGE = 0.5
#: Most altered words of a passage of under 2 * PASSAGE_WORDS words.
BAND = (2 * PASSAGE_WORDS - 1) // ALTERED
#: Held-out items go to the executors in blocks of at most about so many characters each; each block scans the corpus.
BLOCK_CHARS = 16 << 20
CHUNK_WORDS = 100_000
#: Part of an item's words that held back seeds may cover; half of COVERAGE.
HELD_BACK = 0.25
#: Numbers held at once for the runs of a pair, and pairs of seeds held at once.
PASSAGE_CELLS = 1 << 20
SEED_CELLS = 1 << 20

#: Ids pass Python as strings, so nulls and large numbers stay exact.
LEAKS = "row_id string, eval_id string, item_words int, passage_words int, altered int, passage_start int, coverage double, passage boolean"

_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_BREAK = re.compile(r"[-‐\xad](?<=[^\W\d_].)[ \t]*\r?\n[ \t]*(?:[>|*#/%;]+[ \t]*)*(?=[^\W\d_])")
_PREFIX = re.compile(r"^[ \t]*(?:[^\w\s]*\d+[^\w\s]+[ \t]*)+", re.M)
_WORD = re.compile(r"[^\W_]+")
_DROP = re.compile("['\u2019\u2018\u02bc`\u00b4\u00ad\u200b\u200c\u200d\ufeff]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup, line prefixes, apostrophes and hyphens at line ends."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = _PREFIX.sub("", _BREAK.sub("", text))
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKC", text))
    else:
        text = text.replace("'", "").replace("`", "")
    return _WORD.findall(text.lower())


def words_needed(n: int) -> int:
    """Least words of a passage of an item with ``n`` words."""
    return PASSAGE_WORDS if n >= 60 else min(PASSAGE_WORDS, -(-2 * n // 3))


def passage_lengths(need: int, n: int) -> range:
    """Lengths of the passages of an item with ``n`` words that hold no shorter one: a longer one can be halved."""
    return range(need, min(2 * need - 1, n) + 1)


def seeds_kept(need: int, k: int) -> int:
    """Least number of k-grams left in a passage of ``need`` words with one word in ALTERED altered."""
    return need - k + 1 - k * (need // ALTERED)


def least_seeds(need: int, n: int, k: int) -> int:
    """Least number of k-grams left in any passage of an item with ``n`` words; a longer passage may keep fewer."""
    return min(seeds_kept(m, k) for m in passage_lengths(need, n))


def least_under(need: int, n: int) -> int:
    """Least number of words of a passage of an item with ``n`` words that stand in runs of at least MIN_TILE equal words:
    each altered word takes itself and at most two others from them."""
    return min(m - MIN_TILE * (m // ALTERED) for m in passage_lengths(need, n))


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all k-grams; 0 where a gram holds an unknown word (-1)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.int64) + 1).astype(np.uint64)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n] * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        ok &= ids[j : j + n] >= 0
    return np.where(ok, h | np.uint64(1), np.uint64(0))


class ItemIndex:
    """Held-out items as word numbers, with their seed n-grams sorted by hash."""

    def __init__(self, items: list[tuple[str | None, str]]):
        listed = [(i, w) for i, t in items if (w := words_of(t))]
        self.eval_id = [i for i, _ in listed]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64) for _, w in listed]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([words_needed(int(n)) for n in self.length], np.int64)
        best = [min(SEED_WORDS, int(n)) for n in self.need]
        sizes = list(zip(self.need.tolist(), self.length.tolist(), strict=True))
        while any(bad := [least_seeds(*n, k) < 1 for n, k in zip(sizes, best, strict=True)]):
            best = [k - b for k, b in zip(best, bad, strict=True)]
        self.least = np.array([least_seeds(*n, k) for n, k in zip(sizes, best, strict=True)], np.int64)
        self.by_k = {}
        for k in sorted(set(best)):
            own = [i for i, b in enumerate(best) if b == k]
            grams = [_grams(self.words[i], k) for i in own]
            h = np.concatenate(grams)
            item = np.repeat(np.array(own, np.int64), [len(g) for g in grams])
            pos = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            self.by_k[k] = keys, first, count, item[order], pos[order]
        self.tiles = self._tile_seeds()
        #: Words under common runs that a pair must have, for a passage or the coverage.
        self.under = np.array([min(COVERAGE * n, least_under(need, n)) if need >= MIN_TILE else 0 for need, n in sizes])

    def _tile_seeds(self) -> tuple[np.ndarray, ...]:
        """Seeds of MIN_TILE words for the coverage, without those that are held back."""
        grams = [_grams(w, MIN_TILE) for w in self.words]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        keys, which, times = np.unique(flat, return_inverse=True, return_counts=True)
        kept, at = np.ones(len(flat), bool), 0
        for g, n in zip(grams, self.length.tolist(), strict=True):
            often = times[which[at : at + len(g)]]
            covered, free = HELD_BACK * n, np.ones(n, bool)
            for p in np.argsort(-often, kind="stable").tolist():
                covered -= int(free[p : p + MIN_TILE].sum())
                if covered < 0 or often[p] < 2:
                    break
                free[p : p + MIN_TILE] = False
                kept[at + p] = False
            at += len(g)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[kept]
        pos = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])[kept]
        order = np.argsort(flat[kept], kind="stable")
        keys, first, count = np.unique(flat[kept][order], return_index=True, return_counts=True)
        return keys, first, count, item[order], pos[order]


def _blocks(reps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``reps`` that add up to about ``most``; a single one may exceed it."""
    upto = np.cumsum(reps)
    at = 0
    while at < len(reps):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _expand(first: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for each i, ``reps[i]`` numbers."""
    return np.repeat(first, reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)


def _met(seeds: tuple[np.ndarray, ...], h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``h`` of hashes that are seeds, with item and place in the item, in blocks of SEED_CELLS."""
    keys, first, count, item, pos = seeds
    if not len(keys) or not len(h):
        return
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    hit = np.flatnonzero((keys[at] == h) & (h != 0))
    at = at[hit]
    for lo, hi in _blocks(count[at], SEED_CELLS):
        post = _expand(first[at[lo:hi]], count[at[lo:hi]])
        yield np.repeat(hit[lo:hi], count[at[lo:hi]]), item[post], pos[post]


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts per key of several (sorted keys, counts), added up."""
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)


def candidates(index: ItemIndex, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Pairs (row, item) of a chunk that can hold a passage or reach the coverage; ids of rows stand apart by -1.

    Pairs of seeds are counted block by block, so a row that says one word again and again takes no more room.
    """
    found = []
    n_items = len(index.eval_id)
    longest = int(index.length.max())
    for k, seeds in index.by_k.items():
        # offsets in bands of 2 * BAND, every BAND: those of one passage differ by no more than its altered words
        wide = (len(ids) + longest) // BAND + 3
        counts: tuple[list, list] = ([], [])
        for src, it, ep in _met(seeds, _grams(ids, k)):
            pair, band = row[src] * n_items + it, (ep - src + len(ids)) // BAND
            for shift in (0, 1):
                counts[shift].append(np.unique(pair * wide + (band + shift) // 2 * 2, return_counts=True))
                if len(counts[shift]) > 8:
                    counts[shift][:] = [_sum_up(counts[shift])]
        for parts in counts:
            if parts:
                key, c = _sum_up(parts)
                own = key // wide
                found.append(own[c >= index.least[own % n_items]])
    cover = [np.unique((row[src] * n_items + it) * longest + ep) for src, it, ep in _met(index.tiles, _grams(ids, MIN_TILE))]
    if cover:
        key = cover[0] if len(cover) == 1 else np.unique(np.concatenate(cover))
        own, ep = key // longest, key % longest
        # words under the seeds, each once
        words = np.minimum(MIN_TILE, np.r_[np.where(np.diff(own) == 0, np.diff(ep), MIN_TILE), MIN_TILE])
        pair, begin = np.unique(own, return_index=True)
        need = (COVERAGE - HELD_BACK) * index.length[pair % n_items]
        found.append(pair[np.add.reduceat(words, begin) >= need])
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs // n_items, pairs % n_items], axis=1)


def sorted_grams(ids: np.ndarray, k: int = MIN_TILE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all k-grams in order, and their places."""
    h = _grams(ids, k)
    order = np.argsort(h, kind="stable")
    return h[order], order


def runs(a: np.ndarray, b: np.ndarray, least: int = MIN_TILE, grams: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least ``least`` equal words that can't grow, as starts in ``a``, starts in ``b`` and lengths.

    Karp-Rabin hashes of ``least`` words are joined, block by block; of the places that meet, only the first and the
    last of each run are kept. ``grams``: the sorted hashes of ``a``, if they are known.
    """
    hashes, order = grams or sorted_grams(a, least)
    hb = _grams(b, least)
    lo, hi = np.searchsorted(hashes, hb, "left"), np.searchsorted(hashes, hb, "right")
    reps = np.where(hb != 0, hi - lo, 0)
    place = np.flatnonzero(reps)
    edges: tuple[list, list] = ([], [])
    for i, j in _blocks(reps[place], SEED_CELLS):
        own = place[i:j]
        pb, pa = np.repeat(own, reps[own]), order[_expand(lo[own], reps[own])]
        for side, da, db, end in ((edges[0], pa - 1, pb - 1, (pa == 0) | (pb == 0)), (edges[1], pa + least, pb + least, (pa + least == len(a)) | (pb + least == len(b)))):
            at = np.flatnonzero(end | (a[np.clip(da, 0, len(a) - 1)] != b[np.clip(db, 0, len(b) - 1)]))
            side.append(np.stack([pb[at] - pa[at], pa[at]]))
    if not edges[0]:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = (np.concatenate(e, axis=1) for e in edges)
    first, last = first[:, np.lexsort(first[::-1])], last[:, np.lexsort(last[::-1])]
    return first[1], first[0] + first[1], last[1] - first[1] + least


def words_met(grams: tuple[np.ndarray, np.ndarray], item: np.ndarray) -> int:
    """Item words under n-grams of MIN_TILE words that stand in a row with the sorted hashes ``grams``."""
    hashes, h = grams[0], _grams(item, MIN_TILE)
    at = np.searchsorted(hashes, h)
    at[at == len(hashes)] = 0
    p = np.flatnonzero(hashes[at] == h) if len(hashes) else at[:0]
    return int(np.minimum(np.diff(p), MIN_TILE).sum()) + MIN_TILE if len(p) else 0


def under(found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> int:
    """Words of an item of ``n`` words that are in any of the common runs: no tiling covers more."""
    _, y, size = found
    return int(np.count_nonzero(np.cumsum(np.bincount(y, minlength=n + 1) - np.bincount(y + size, minlength=n + 1))))


def tiles(a: np.ndarray, b: np.ndarray, least: int = MIN_TILE, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word numbers ``a`` and ``b``: (start in a, start in b, length), none overlapping.

    The longest run of equal words is marked first; runs that it cuts into go back with what is left of them. ``found``:
    the runs, if they are known.
    """
    by_size: dict[int, list[tuple[int, int]]] = {}
    for x, y, n in zip(*(v.tolist() for v in found or runs(a, b, least)), strict=True):
        by_size.setdefault(n, []).append((x, y))
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out, left = [], len(b)
    n = max(by_size, default=0)
    while n >= least and left >= least:
        for x, y in sorted(by_size.pop(n, [])):
            ok = free_a[x : x + n] & free_b[y : y + n]
            if ok.all():
                free_a[x : x + n] = free_b[y : y + n] = False
                out.append((x, y, n))
                left -= n
                continue
            if left < least:
                break
            edge = np.flatnonzero(np.diff(np.r_[False, ok, False]))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= least:
                    by_size.setdefault(e - s, []).append((x + s, y + s))
            if n in by_size:  # cannot happen: the parts are shorter
                raise AssertionError
        n -= 1
    return sorted(out)


def _reach(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, most: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits (up to ``most``) of b[y:y + t] against a stretch of ``a`` from x on that ends in an equal word, for
    each start and t up to ``far``, and how many words more than t the stretch has."""
    d = np.arange(-most, most + 1)
    much = most + 1
    cost = np.where((d >= 0) & (x[:, None] + d <= len(a)), d, much)
    edits, shift = np.full((len(x), far + 1), much), np.full((len(x), far + 1), most)
    edits[:, 0] = 0
    every = np.arange(len(x))
    for t in range(1, far + 1):
        at = x[:, None] + d + (t - 1)
        inside = (y + t <= len(b))[:, None]
        equal = inside & (at >= 0) & (at < len(a))
        equal &= a[np.clip(at, 0, len(a) - 1)] == b[np.minimum(y + t, len(b)) - 1][:, None]
        met = np.where(equal, cost, much)
        shift[:, t] = met.argmin(axis=1)
        edits[:, t] = met[every, shift[:, t]]
        left_out = np.concatenate([cost[:, 1:], np.full((len(x), 1), much)], axis=1) + 1
        cost = np.minimum(np.where(equal, cost, cost + 1), left_out)
        cost = np.minimum.accumulate(cost - d, axis=1) + d
        cost = np.where(inside & (at < len(a)), np.minimum(cost, much), much)
        if cost.min() >= much:
            break
    return edits, shift - most


def _through(a: np.ndarray, b: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], far: int, altered: int) -> np.ndarray:
    """(item words, altered words, start in a) of the longest passage through each of the runs ``found``, exact up to
    ``far`` item words."""
    x, y, n = found
    most = far // altered
    right, _ = _reach(a, b, x + n, y + n, most, far)
    left, shift = _reach(a[::-1], b[::-1], len(a) - x, len(b) - y, most, far)
    t, e = np.arange(far + 1), np.arange(most + 1)
    # furthest words on either side within each number of edits
    r, s = (np.stack([np.where(v <= k, t, 0).max(axis=1) for k in e], axis=1) for v in (right, left))
    span = n[:, None, None] + r[:, :, None] + s[:, None, :]
    span = np.where((e[:, None] + e) * altered <= span, span, 0).reshape(len(n), -1)
    pick = span.argmax(axis=1)  # of equal spans the one with fewer edits on the right, then on the left
    every = np.arange(len(n))
    tr, tl = r[every, pick // len(e)], s[every, pick % len(e)]
    return np.stack([span[every, pick], right[every, tr] + left[every, tl], x - tl - shift[every, tl]], axis=1)


def longest_passage(a: np.ndarray, b: np.ndarray, need: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], altered: int = ALTERED) -> tuple[int, int, int]:
    """(item words, altered words, start in a) of the longest stretch of ``b`` that stands in ``a`` from one equal word
    to another with at most one word in ``altered`` altered, added or left out, by edit distance.

    It is looked for through each of the common runs ``found``, taken whole, at first up to 2 * need words. A passage of
    that length or more has a half that is a passage too, so only runs in so long a passage are looked at further.
    """
    x, y, n = found
    if len(n) and n.max() == len(b):
        return len(b), 0, int(x[n.argmax()])
    best, far = (0, 0, 0), 2 * need
    while len(x):
        far = min(far, len(b))
        many = max(1, PASSAGE_CELLS // ((far // altered + 1) ** 2 + 3 * far))
        got = np.concatenate([_through(a, b, (x[i : i + many], y[i : i + many], n[i : i + many]), far, altered) for i in range(0, len(x), many)])
        best = max(best, *map(tuple, got.tolist()), key=lambda v: (v[0], -v[1]))
        if far == len(b):
            break
        own = 2 * got[:, 0] >= far
        x, y, n, far = x[own], y[own], n[own], 4 * far
    return best


def passage_runs(found: tuple[np.ndarray, np.ndarray, np.ndarray], need: int, n_item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common runs through which a passage can go.

    A passage of m words with e altered has a run of at least (m - e) / (e + 1) words, which is over 3 if e is not 0. The
    altered words leave at most two words each in runs under MIN_TILE, so m - 3 * e are in other runs near this one.
    """
    x, y, n = found
    lengths = passage_lengths(need, n_item)
    least = least_under(need, n_item)
    own = np.flatnonzero(n >= min(ALTERED // 2, need))
    if n.sum() < least:
        own = own[:0]
    elif len(own) * len(n) <= PASSAGE_CELLS:
        near = np.abs((y - x) - (y - x)[own, None]) <= lengths[-1] // ALTERED
        near &= (y < (y + n)[own, None] + lengths[-1]) & (y + n > y[own, None] - lengths[-1])
        own = own[(near * n).sum(axis=1) >= least]
    return x[own], y[own], n[own]


def find_leaks(corpus: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of a row of ``corpus`` (row_id, contents) and an item of ``items`` (eval_id, text) that share a passage or
    at least COVERAGE of the item's words in tiles of MIN_TILE words.

    ``passage`` is true for one unbroken passage of words_needed(item) words with at most one in ALTERED altered.
    Null and blank texts match nothing. Items with the same text each count, as does each repeated row. Items are
    read in blocks of a set size, one pass over the corpus per block; no link is dropped and no text is cut.
    """
    items = items.where("text is not null").select(F.col("eval_id").cast("string").alias("eval_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    parts = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("eval_id"), F.lit(blocks)) == b) if blocks > 1 else items
        parts.append(_leaks_of_block(corpus, [(r.eval_id, r.text) for r in own.collect()]))  # at most about block_chars
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _leaks_of_block(corpus: DataFrame, block: list[tuple[str | None, str]]) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(block)
    held: list[ItemIndex] = []
    gap = np.full(SEED_WORDS, -1, np.int64)

    def look(index: ItemIndex, rows: list, lists: list[np.ndarray]) -> list:
        ids = np.concatenate([x for w in lists for x in (w, gap)])
        lens = np.array([len(w) + len(gap) for w in lists])
        row = np.repeat(np.arange(len(lists)), lens)
        out = []
        at, grams = -1, None
        for r, i in candidates(index, ids, row).tolist():
            item = index.words[i]
            need = int(index.need[i])
            if r != at:  # pairs come row by row
                at, grams = r, sorted_grams(lists[r])
            if need >= MIN_TILE and words_met(grams, item) < index.under[i]:
                continue
            common = runs(lists[r], item, MIN_TILE, grams) if need >= MIN_TILE else runs(lists[r], item, need)
            through = passage_runs(common, need, len(item))
            enough = under(common, len(item)) >= COVERAGE * len(item)
            if not len(through[0]) and not enough:
                continue
            span, altered, start = longest_passage(lists[r], item, need, through)
            passage = span >= need
            if not passage and not enough:
                continue
            cover = sum(n for _, _, n in tiles(lists[r], item, found=common if need >= MIN_TILE else None)) / len(item)
            if cover >= COVERAGE and not passage:
                span, altered, start = longest_passage(lists[r], item, need, common)
            if passage or cover >= COVERAGE:
                out.append((rows[r], index.eval_id[i], len(item), span, altered, start, round(cover, 6), passage))
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(ItemIndex(shared.value))
        index = held[0]
        if not len(index.eval_id):
            return
        get = index.vocab.get
        for batch in batches:
            out, rows, lists, total = [], [], [], 0
            for row_id, text in zip(batch["row_id"], batch["contents"], strict=True):
                if w := words_of(text):
                    rows.append(row_id)
                    lists.append(np.array([get(x, -1) for x in w], np.int64))
                    total += len(w)
                    if total >= CHUNK_WORDS:
                        out += look(index, rows, lists)
                        rows, lists, total = [], [], 0
            if rows:
                out += look(index, rows, lists)
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in LEAKS.split(", ")]
    slim = corpus.where("contents is not null").select(F.col("row_id").cast("string").alias("row_id"), "contents")
    return slim.mapInPandas(scan, LEAKS).withColumns({c: F.col(c).cast("long") for c in ("row_id", "eval_id")})


def held_out(spark, sf_dir: str) -> DataFrame:
    """All of split_eval and the test rows of eval_cls."""
    test = table(spark, sf_dir, "eval_cls").where("split_name = 'test'").select("eval_id", "text")
    return table(spark, sf_dir, "split_eval").select("eval_id", "text").unionAll(test)


def p3_leaks(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "processed"), held_out(spark, sf_dir))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return p3_leaks(spark, sf_dir).where("passage").select("row_id", "eval_id")


def p3_item_report(spark, sf_dir: str) -> DataFrame:
    """Per leaked item: in how many rows it stands, its longest passage and its best coverage."""
    return p3_leaks(spark, sf_dir).groupBy("eval_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("passage").cast("int")).alias("rows_with_passage"),
        F.max("passage_words").alias("longest_passage"),
        F.max("coverage").alias("best_coverage"),
    )
