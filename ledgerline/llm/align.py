"""Local alignment of two word sequences inside a band of diagonals, one numpy row at a time."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, 1

#: Every ASCII mark is a space to these word sequences; letters are lower-cased.
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def plain_words(text: str | None) -> list[bytes]:
    """Words without ASCII marks, A-Z lower-cased (letters beyond ASCII by str.lower)."""
    text = text or ""
    return (text if text.isascii() else text.lower()).encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


class Alignment(NamedTuple):
    score: int
    matched: int
    a_start: int
    a_end: int
    b_start: int
    b_end: int
    #: Places in a of the matched words, ascending.
    at: tuple[int, ...] = ()


def local_alignment(a: np.ndarray, b: np.ndarray, low: int, high: int) -> Alignment:
    """The best local alignment (Smith-Waterman, linear gaps) whose pairs i, j have low <= j - i <= high.

    Only every so many rows of the table are kept; the way back computes the rows between two of them anew. So the memory
    is that of about 2 * sqrt(len(a)) rows, not of all.
    """
    m, n, width = len(a), len(b), high - low + 1
    shift = max(0, -low) + width
    pad = np.full(max(m + n + 2 * width + abs(low) + 2, shift + n + width), -1, np.int64)
    pad[shift : shift + n] = b
    slope = np.arange(width, dtype=np.int32) * GAP

    def after(i: int, above: np.ndarray) -> np.ndarray:
        here = pad[i + low + shift : i + low + shift + width]
        if len(here) < width:
            here = np.concatenate([here, np.full(width - len(here), -1, np.int64)])
        row = above[:width] + np.where(here == a[i], MATCH, MISMATCH).astype(np.int32)
        np.maximum(row, above[1:] - GAP, out=row)
        np.maximum(row, 0, out=row)
        out = np.zeros(width + 1, np.int32)
        out[:width] = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
        return out

    every = max(32, int(m**0.5))
    row = np.zeros(width + 1, np.int32)
    kept, score, i, c = [row], 0, 0, 0
    for k in range(m):
        row = after(k, row)
        if (k + 1) % every == 0:
            kept.append(row)
        top = int(row.argmax())
        if row[top] > score:
            score, i, c = int(row[top]), k + 1, top
    if not score:
        return Alignment(0, 0, 0, 0, 0, 0)
    a_end, b_end, at = i, i - 1 + low + c + 1, []
    a_start, b_start = a_end, b_end
    rows, first = [], -1  # rows[k] is row first + k

    while i > 0:  # back along the path that gave each value
        if first < 0 or i - 1 < first:
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for k in range(first, min(first + every, m)):
                rows.append(after(k, rows[-1]))
        value, above = rows[i - first][c], rows[i - 1 - first]
        if value <= 0:
            break
        j = i - 1 + low + c
        same = 0 <= j < n and a[i - 1] == b[j]
        if value == max(0, above[c]) + (MATCH if same else MISMATCH):
            if same:
                at.append(i - 1)
            i -= 1
            a_start, b_start = i, j
        elif value == above[c + 1] - GAP:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return Alignment(score, len(at), a_start, a_end, b_start, b_end, tuple(reversed(at)))


def most_shared(a: np.ndarray) -> Callable[[np.ndarray], int]:
    """A function of b: as many words as any alignment of a to b can match, by the words' counts alone."""
    values, counts = np.unique(a, return_counts=True)

    def bound(b: np.ndarray) -> int:
        at = np.searchsorted(values, b)
        at[at == len(values)] = 0
        return int(np.minimum(np.bincount(at[values[at] == b], minlength=len(values)), counts).sum())

    return bound


def disjoint_alignments(a: np.ndarray, b: np.ndarray, longest: int, possible: Callable[[np.ndarray], bool], enough: Callable[[Alignment], bool]) -> list[Alignment]:
    """The best alignments of a to b that are enough and do not overlap in b: the best, then those on either side of it.

    What is not possible is not aligned. b is taken in blocks that overlap by `longest`, as long as an alignment gets in b,
    so the work grows with the length of b; of what blocks find twice or cut, the best is kept.
    """
    found: set[Alignment] = set()
    step = 4 * longest
    for at in range(0, max(1, len(b) - longest), step):
        pieces = [(at, min(len(b), at + step + longest))]
        while pieces:
            low, high = pieces.pop()
            part = b[low:high]
            if not possible(part):
                continue
            best = local_alignment(a, part, -len(a), len(part))
            if not best.score:
                continue
            start, end = low + best.b_start, low + best.b_end
            if enough(best):
                found.add(best._replace(b_start=start, b_end=end))
            pieces += [(low, start), (end, high)]
    return disjoint(sorted(found, key=lambda x: (-x.score, x.b_start)))


def disjoint(found: list[Alignment]) -> list[Alignment]:
    """Those of the alignments, the first ones first, that overlap none before them in b; in the order of b."""
    starts: list[int] = []
    out: list[Alignment] = []
    for x in found:
        i = bisect_left(starts, x.b_start)  # what is there is disjoint and in order, so two neighbours tell
        if (i == 0 or out[i - 1].b_end <= x.b_start) and (i == len(out) or x.b_end <= out[i].b_start):
            starts.insert(i, x.b_start)
            out.insert(i, x)
    return out
