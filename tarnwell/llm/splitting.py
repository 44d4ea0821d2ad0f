"""Split oversized texts at natural boundaries into pieces under a limit, with an overlap.

Balanced targets: the least number of pieces is computed from the length, equal targets are placed, each is
snapped to the strongest boundary near it, and one more piece is tried as long as a limit fails.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1800
OVERLAP = 150
LEVELS = ["paragraph", "line", "sentence", "word", "none"]

#: Separators from coarse to fine; each also covers the coarser ones.
_NL = r"(?>\r\n|[\n\r\x0b\x0c\x85  ])"
SEPARATORS = {
    "paragraph": re.compile(rf"[^\S\n\r\x0b\x0c\x85\u2028\u2029]*{_NL}[^\S\n\r\x0b\x0c\x85  ]*(?:{_NL}\s*)+"),
    "line": re.compile(rf"\s*{_NL}\s*"),
    "sentence": re.compile(r"(?<=[.!?])\s+"),
    "word": re.compile(r"\s+"),
}

PIECES = "level string, pieces array<struct<piece:int,start:int,end:int,overlap:int,text:string>>"


def cut_points(text: str) -> list[tuple[int, int, int]]:
    """(end of the segment before, start of the segment after, level index) of every possible cut, in order."""
    found: dict[int, tuple[int, int, int]] = {}
    for level in (3, 2, 1, 0):
        for m in SEPARATORS[LEVELS[level]].finditer(text):
            if 0 < m.start() and m.end() < len(text):
                found[m.end()] = (m.start(), m.end(), level)
    return sorted(found.values())


def boundary_level(text: str, limit: int, cuts: list[tuple[int, int, int]] | None = None) -> str:
    """The coarsest level at which cutting, there and at all coarser boundaries, leaves no segment over the limit."""
    cuts = cut_points(text) if cuts is None else cuts
    for level in range(4):
        start = longest = 0
        for end, after, at in cuts:
            if at <= level:
                longest = max(longest, end - start)
                start = after
        if max(longest, len(text) - start) <= limit:
            return LEVELS[level]
    return "none"


def _overlap_start(text: str, start: int, cuts_at: list[int], overlap: int) -> int:
    """Where the repeated tail of the piece before begins: at most ``overlap`` characters before ``start``."""
    least = max(0, start - overlap)
    k = bisect_right(cuts_at, least)
    return cuts_at[k] if k < len(cuts_at) and cuts_at[k] < start else least


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str | None, list[tuple[int, int, int, int, str]]]:
    """(level, pieces) of one text; a piece is (number, start, end, characters repeated, text).

    Outer white space is not part of the text. A null or blank text has no piece and no level, a text within
    the limit is one piece with no level. New text of all pieces, with the separators between them, is the
    whole text. A piece after the first begins with the last ``overlap`` characters of the one before it, or
    with fewer where a boundary falls within them or a single segment of the level leaves less room.
    """
    text = (text or "").strip()
    if not text:
        return None, []
    if len(text) <= limit:
        return None, [(0, 0, len(text), 0, text)]
    cuts = cut_points(text)
    level = boundary_level(text, limit, cuts)
    allowed = [c for c in cuts if c[2] <= LEVELS.index(level)]
    starts = [c[1] for c in cuts]
    least = math.ceil((len(text) - overlap) / (limit - overlap))
    for n in range(least, least * 2 + 3):
        if bounds := _balanced(text, n, allowed, starts, limit, overlap, hard=level == "none"):
            break
    else:
        bounds = _greedy(text, allowed, starts, limit, overlap)
    pieces, last = [], 0
    for i, (start, end) in enumerate(bounds):
        begin = start
        if i:
            begin = max(_overlap_start(text, start, starts, overlap), end - limit, last)
        pieces.append((i, begin, end, start - begin, text[begin:end]))
        last = start
    return level, pieces


def _balanced(text, n, allowed, starts, limit, overlap, hard):
    """(start, end) of n pieces with each target snapped to the strongest near boundary; None if a limit fails.

    The limit holds for a piece with its whole overlap, from ``begin``.
    """
    size, reach = len(text), len(text) / n / 4
    bounds, start, begin = [], 0, 0
    at = 0
    for i in range(1, n):
        target = size * i / n
        while at < len(allowed) and allowed[at][1] <= start:
            at += 1
        near = []
        for k in range(at, len(allowed)):
            end, after, level = allowed[k]
            if end > target + reach or end - begin > limit:
                break
            if end >= target - reach and end > start:
                near.append((level, abs(end - target), end, after))
        if near:
            _, _, end, after = min(near)
        elif hard:
            end = after = min(round(target), begin + limit)
        else:
            return None
        if end <= start:
            return None
        bounds.append((start, end))
        start, begin = after, max(_overlap_start(text, after, starts, overlap), start)
    bounds.append((start, size))
    return bounds if start < size <= begin + limit else None


def _greedy(text, allowed, starts, limit, overlap):
    """The furthest allowed boundary within the limit each time, the overlap counted; a hard cut where there is none.

    Where the next segment leaves no room for the whole overlap, it is a piece of its own and the overlap shrinks.
    """
    bounds, start, begin, size, k = [], 0, 0, len(text), 0
    while size - begin > limit:
        while k < len(allowed) and allowed[k][0] <= start:
            k += 1
        best = allowed[k][:2] if k < len(allowed) else (size, size)
        while k < len(allowed) and allowed[k][0] - begin <= limit:
            best = allowed[k][:2]
            k += 1
        end, after = best if best[0] - start <= limit else (begin + limit, begin + limit)
        if end == size:
            break
        bounds.append((start, end))
        start, begin = after, max(_overlap_start(text, after, starts, overlap), start)
    bounds.append((start, size))
    return bounds


def split_column(df: DataFrame, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns with level and pieces of ``text``; one row for each row of ``df``, whatever its other columns."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [split_text(t, limit, overlap) for t in pdf[text]]
            yield pdf[keep].assign(level=[x[0] for x in done], pieces=[x[1] for x in done])

    kept = df.select(*dict.fromkeys([*keep, text]))
    return kept.mapInPandas(run, ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep) + ", " + PIECES)


def oversized_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, section, level, pieces of each chunk whose content, without outer white space, is over the limit."""
    long = chunks.where(F.length("content") > limit).select("chunk_id", "section", "content")
    return split_column(long, "content", ["chunk_id", "section"], limit, overlap).where("level is not null")
