"""Cutting oversized texts into pieces under a limit, at natural boundaries and with an overlap.

Each text is an array of boundary strengths: a place between two blocks of lines is stronger than one at another line's
start, that than one after a blank, and any character is a place to cut. A sparse table over the array answers "the
strongest place in this window, ties to the right" in constant time, so a text of n characters costs n log n however
many pieces it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters a piece may have, and how many of them may be repeated from the piece before.
LIMIT, OVERLAP = 1500, 120
#: Characters for which the tables are built at a time.
TILE = 1 << 18
#: Strengths of a cut before a character: between two blocks, any other line, after white space, anywhere.
BLOCK, LINE, BLANK, ANY = 3, 2, 1, 0

_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line (end without LF and a final CR), and whether it is blank: only blanks, tabs and CR."""
    starts, ends, blank = [], [], []
    for m in _LINE.finditer(text):
        line = m.group().removesuffix("\n")
        starts.append(m.start())
        ends.append(m.start() + len(line.removesuffix("\r")))
        blank.append(not line.strip(" \t\r"))
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(blank, bool)


def blocks_of(starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each maximal run of lines that aren't blank: its first character, its end and its first line (from 0)."""
    full = ~blank
    first = np.flatnonzero(full & np.concatenate(([True], blank[:-1])))
    last = np.flatnonzero(full & np.concatenate((blank[1:], [True])))
    return starts[first], ends[last], first


def strengths(text: str, starts: np.ndarray, blank: np.ndarray, block_starts: np.ndarray, block_ends: np.ndarray) -> np.ndarray:
    """Strength of a cut before each character."""
    s = np.zeros(len(text) + 1, np.int8)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (code == 32) | (code == 9)
    s[1:][white] = BLANK
    s[starts] = LINE
    s[starts[blank]] = BLOCK
    s[block_starts] = BLOCK
    s[block_ends] = BLOCK
    return s


class RangeMaximum:
    """A sparse table: position of the greatest value in a range of at most `longest`, in constant time.

    Of equal values the rightmost is meant, or the leftmost.
    """

    def __init__(self, values: np.ndarray, longest: int, leftmost: bool = False) -> None:
        # Value and position in one integer (values below 8, at most 2^28 of them), so that one maximum settles ties.
        self.top = len(values) - 1
        at = np.arange(len(values), dtype=np.int32)
        self.leftmost = leftmost
        level = values.astype(np.int32) << 28 | (self.top - at if leftmost else at)
        self.levels = [level]
        while 2 << (len(self.levels) - 1) <= min(longest, len(values)):
            half = 1 << (len(self.levels) - 1)
            level = np.maximum(level[:-half], level[half:])
            self.levels.append(level)

    def best(self, lo: int, hi: int) -> int:
        """Position of the maximum within lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        at = int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1])) & ((1 << 28) - 1)
        return self.top - at if self.leftmost else at


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece. A text within the limit is one piece; an empty one has none.

    The end of a piece is the strongest place after what it repeats, within the limit; a cut after a block leaves the
    blank lines to the piece that ends there, if they fit. The next piece begins up to `overlap` characters before the
    cut, at the strongest place there, ties to the left, unless that would keep it from holding the whole next block.
    The tables are built for stretches of TILE characters at a time, so a text of any length needs little memory.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    starts, ends, blank = lines_of(text)
    block_starts, block_ends, _ = blocks_of(starts, ends, blank)
    s = strengths(text, starts, blank, block_starts, block_ends)
    pieces, start, cut = [], 0, 0
    base, right, left = 0, None, None
    while n - start > limit:
        if right is None or start + limit > base + right.top:
            base = start
            some = s[base : base + TILE + 2 * limit]
            right, left = RangeMaximum(some, limit), RangeMaximum(some, limit, leftmost=True)
        end = base + right.best(cut + 1 - base, start + limit - base)
        pieces.append((start, end))
        # The block that begins or goes on at the cut should fit into the next piece with what is repeated before it.
        b = int(np.searchsorted(block_ends, end, "right"))
        room = limit - (int(block_ends[b]) - end) if b < len(block_ends) else limit
        back = max(0, min(overlap, end - 1 - cut, room if room >= 0 else overlap))
        cut = end
        start = base + left.best(end - back - base, end - base) if back else end
    pieces.append((start, n))
    return pieces


def unavoidable(text: str, pieces: list[tuple[int, int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Line numbers (from 1) of the cuts no splitter can avoid: between two neighbouring blocks that both fit with an overlap, but not together.

    Only cuts that `pieces` has are looked at: those after a block's end, up to the next block's first character.
    """
    starts, ends, blank = lines_of(text)
    block_starts, block_ends, first = blocks_of(starts, ends, blank)
    cuts = np.array([e for _, e in pieces[:-1]], np.int64)
    at = np.searchsorted(block_starts, cuts)
    found = []
    for c, i in zip(cuts, at, strict=True):
        if 0 < i < len(block_starts) and block_ends[i - 1] <= c:
            a, b, e = block_starts[i - 1], block_starts[i], block_ends[i]
            if block_ends[i - 1] - a <= limit - overlap and e - b <= limit - overlap and e - a > limit:
                found.append(int(first[i]) + 1)
    return list(dict.fromkeys(found))


def current_long_texts(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id, text of the current texts above the limit; shorter texts only travel as their lengths.

    The current row of a chunk_id has the greatest indexed_at (null first; ties by the greater hash of the text). Rows
    with a null chunk_id don't count; a null text is no text.
    """
    long = F.when(F.length("text") > limit, F.col("text"))
    newest = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(long.alias("text")), F.struct("indexed_at", F.xxhash64("text"))).alias("c"))
    return newest.select("chunk_id", "c.text").where("text is not null")


def _pieces(limit: int, overlap: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for chunk_id, text in zip(pdf.chunk_id, pdf.text, strict=True):
                starts, _, _ = lines_of(text)
                for k, (a, b) in enumerate(split(text, limit, overlap)):
                    x, y = np.searchsorted(starts, [a, b - 1], "right")
                    out.append((chunk_id, k, a, b, int(x), int(y), text[a:b]))
            yield pd.DataFrame(out, columns=["chunk_id", "piece_no", "start_char", "end_char", "start_line", "end_line", "text"])

    return run


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every current text above the limit: chunk_id, piece_no (from 0), start_char, end_char (exclusive),
    start_line, end_line (from 1, within the text) and text. Characters are code points. Every character is in a piece."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    return current_long_texts(chunks, limit).mapInPandas(_pieces(limit, overlap), "chunk_id string, piece_no int, start_char long, end_char long, start_line int, end_line int, text string")


def _cuts(limit: int, overlap: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(c, line) for c, text in zip(pdf.chunk_id, pdf.text, strict=True) for line in unavoidable(text, split(text, limit, overlap), limit, overlap)]
            yield pd.DataFrame(out, columns=["chunk_id", "line_no"])

    return run


def unavoidable_cuts(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, line_no of the splitter's cuts that cannot be avoided; line_no is where the later block starts."""
    return current_long_texts(chunks, limit).mapInPandas(_cuts(limit, overlap), "chunk_id string, line_no long")
