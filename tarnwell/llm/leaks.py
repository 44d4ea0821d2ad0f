"""Find evaluation passages that leaked into training text, by greedy string tiling.

Shared word grams seed the candidates. For each candidate the longest non-overlapping matches are marked again
and again, found by running Karp-Rabin hashes of falling length, until no match of the least length is left.
Neighbouring tiles are joined across spelling slips into copied passages, and a document leaks an item if one
passage, or two in the item's order, cover enough of the item's words.

The items are the stated query set: their size is measured, and they are broadcast in blocks of bounded size.
The documents are read once a block, whole, and are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.forms import one_form

SEED_WORDS = 4  # words of a seed gram
LEAST_TILE = 2  # words of the shortest tile
LEAST_SHARE = 0.5  # of an item's words
LEAST_PASSAGE = 6  # words of the shortest passage that counts
SLIP_WORDS = 3  # words of the longest stretch that a slip may spoil
SLIP_EVERY = 8  # words between slips of a copy; with slips at half that distance half of its seeds are lost
BLOCK_CHARS = 4_000_000  # characters of items broadcast at a time

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[str]:
    """Words of a text, apart from case, punctuation, spacing and character forms."""
    return _WORD.findall(one_form(text, fold_case=True) or "")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base)], dtype=np.uint64)[:n]


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2 to the 64, of all windows of n, from running sums."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum((ids + 2).astype(np.uint64) * _powers(_BASE, len(ids)), dtype=np.uint64)]
    return (sums[n:] - sums[:-n]) * _powers(_INVERSE, len(ids) - n + 1)


def _free(taken: np.ndarray, n: int) -> np.ndarray:
    """Whether each window of n has no taken place."""
    sums = np.r_[0, np.cumsum(taken)]
    return sums[n:] == sums[:-n]


def tiles(item: list[int], doc: list[int], least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the greedy tiles, longest first. Negative ids never match."""
    a, b = np.asarray(item, dtype=np.int64), np.asarray(doc, dtype=np.int64)
    used_a, used_b = np.zeros(len(a), dtype=bool), ~np.isin(b, a) | (b < 0)
    found: list[tuple[int, int, int]] = []
    n = max(least, min(len(a), 32))
    while n >= least:
        at_a, at_b = (np.flatnonzero(_free(u, n)) if len(u) >= n else np.zeros(0, np.int64) for u in (used_a, used_b))
        ha, hb = _rolling(a, n)[at_a], _rolling(b, n)[at_b]
        order = np.argsort(ha, kind="stable")
        lo, hi = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
        matches = []
        for x in np.flatnonzero(hi > lo).tolist():
            d = int(at_b[x])
            for i in at_a[order[lo[x] : hi[x]]].tolist():
                if item[i : i + n] != doc[d : d + n]:
                    continue
                k = n
                while i + k < len(item) and d + k < len(doc) and not used_a[i + k] and not used_b[d + k] and item[i + k] == doc[d + k]:
                    k += 1
                matches.append((k, i, d))
        for k, i, d in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not used_a[i : i + k].any() and not used_b[d : d + k].any():
                used_a[i : i + k] = used_b[d : d + k] = True
                found.append((i, d, k))
        n = n // 2 if n > 2 * least else n - 1
    return found


def _alike(a: str, b: str) -> bool:
    """Whether two short stretches differ by spelling slips only."""
    if not a or not b:
        return max(len(a), len(b)) <= 3
    if abs(len(a) - len(b)) > 3:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= max(1, round(0.34 * min(len(a), len(b))))


def passages(found: list[tuple[int, int, int]], item: list[str], doc: list[str]) -> list[tuple[int, int, int, int]]:
    """(item start, item end, doc start, doc end) of tiles joined across slips."""
    out: list[list[int]] = []
    near: list[list[int]] = []  # passages that a later tile may still go on with
    for i, d, k in sorted(found, key=lambda t: (t[1], t[0])):
        near = [p for p in near if d - p[3] <= SLIP_WORDS]
        for p in reversed(near):
            gi, gd = i - p[1], d - p[3]
            if 0 <= gi <= SLIP_WORDS and 0 <= gd and abs(gi - gd) <= 1 and _alike("".join(item[p[1] : i]), "".join(doc[p[3] : d])):
                p[1], p[3] = i + k, d + k
                break
        else:
            near.append([i, i + k, d, d + k])
            out.append(near[-1])
    return [tuple(p) for p in out]


def covered(found: list[tuple[int, int, int, int]], size: int) -> int:
    """Words of the item of ``size`` words in its best passage, or in the best two that keep its order.

    A passage counts from LEAST_PASSAGE words, in a shorter item from all of its words.
    """
    long = sorted((p for p in found if p[1] - p[0] >= min(LEAST_PASSAGE, size)), key=lambda p: p[2])
    best = max((p[1] - p[0] for p in long), default=0)
    for x, p in enumerate(long):
        for q in long[x + 1 :]:
            if q[0] >= p[1] and q[2] >= p[3]:
                best = max(best, p[1] - p[0] + q[1] - q[0])
    return best


def _gram_hashes(ids: np.ndarray, words: int = SEED_WORDS) -> np.ndarray:
    """64-bit hashes of all grams of ``words`` known words; 0 where a word is unknown."""
    n = len(ids) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    known = np.ones(n, dtype=bool)
    for k in range(words):
        part = ids[k : k + n]
        known &= part >= 0
        h = h * np.uint64(0x9E3779B97F4A7C15) + (part + 1).astype(np.uint64)
        h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def _near(at: list[int], n: int, reach: int) -> np.ndarray:
    """Places of the document within ``reach`` words of a seed; the rest can't belong to a passage."""
    keep = np.zeros(n + 1, dtype=np.int64)
    for d in at:
        keep[max(0, d - reach)] += 1
        keep[min(n, d + reach)] -= 1
    return np.flatnonzero(np.cumsum(keep[:n]) > 0)


class ItemIndex:
    """The words and seed grams of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids: dict[str, int] = {}
        self.words: dict[int, list[str]] = {}
        self.codes: dict[int, list[int]] = {}
        grams: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for key, passage in items:
            w = words_of(passage)
            if not w:
                continue
            self.words[key] = w
            self.codes[key] = [self.ids.setdefault(x, len(self.ids)) for x in w]
            size = min(SEED_WORDS, len(w))  # an item shorter than a seed is one seed
            for h in _gram_hashes(np.array(self.codes[key], dtype=np.int64), size).tolist():
                grams[size][h].add(key)
        self.grams = {size: dict(g) for size, g in grams.items()}
        self.sorted = {size: np.array(sorted(g), dtype=np.uint64) for size, g in grams.items()}

    def _seeds(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(place, seed) of the seeds in a document by item."""
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, known in self.sorted.items():
            h = _gram_hashes(codes, size)
            if len(h):
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                for d, x in zip(at.tolist(), h[at].tolist(), strict=True):
                    for key in self.grams[size][x]:
                        places[key].append((d, x))
        return places

    def leaks(self, text: str | None, share: float = LEAST_SHARE) -> list[tuple[int, float]]:
        """(item, share of its words) of the items that a text leaks."""
        w = words_of(text)
        codes = np.array([self.ids.get(x, -1) for x in w], dtype=np.int64)
        out = []
        for key, at in self._seeds(codes).items():
            size = len(self.words[key])
            # a leak with a slip every SLIP_EVERY words still shares this many seeds
            if len({x for _, x in at}) < share * size * max(0, SLIP_EVERY - SEED_WORDS) / SLIP_EVERY / 2:
                continue
            near = _near([d for d, _ in at], len(w), size)
            c = covered(passages(tiles(self.codes[key], codes[near].tolist(), min(LEAST_TILE, size)), self.words[key], [w[d] for d in near]), size)
            if c >= share * size:
                out.append((key, c / size))
        return out


def leaked(documents: DataFrame, items: DataFrame, share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """doc_id, item_id, coverage of each document that holds at least ``share`` of an item's words.

    Null and empty texts and passages leak nothing. Repeated documents count each; other columns are ignored.
    """
    spark = documents.sparkSession
    it = items.select(F.col(item_col).cast("long").alias("k"), F.col(passage_col).alias("p")).where("k is not null and p is not null")
    chars = it.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for b in range(blocks):
        index = spark.sparkContext.broadcast(ItemIndex([(r.k, r.p) for r in it.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toLocalIterator()]))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if isinstance(t, str) for x in index.value.leaks(t, share)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage"])

        part = docs.mapInPandas(run, "doc_id long, item_id long, coverage double")
        found = part if found is None else found.unionByName(part)
    return found
