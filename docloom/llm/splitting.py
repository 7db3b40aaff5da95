"""Splitting oversized texts at their strongest natural boundary (problem 2).

The boundaries of a text (places just before white space or just after a full-width mark) get a
strength by the pause they make. A sparse table over the boundaries answers range-maximum queries, so
that for each piece the strongest boundary in the permissible window of lengths is found in constant
time; of equal ones the rightmost wins. The next piece steps back by the overlap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What str.strip() takes for white space (fixed values).
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PLACES = regex.compile(r"[\s\x1c-\x1f]+|(?<=[。！？；，、])(?=\S)")
_CLOSERS = "\"'”’»)]}"
_RANK = {**dict.fromkeys(".!?…。！？", 4), **dict.fromkeys(";:；：", 3), **dict.fromkeys(",，、–—", 2)}
PAGE, PARAGRAPH, LINE = 7, 6, 2
#: Boundaries in one sparse table; longer texts get one table after the other.
TABLE = 1 << 18


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places where a piece may end and how strong each is: page, paragraph, sentence, clause, line, word."""
    places, strengths = [], []
    for m in _PLACES.finditer(text):
        p = m.start()
        if not p:
            continue
        gap = m.group()
        if "\f" in gap:
            s = PAGE
        elif gap.count("\n") > 1 or "\u2029" in gap:
            s = PARAGRAPH
        else:
            c = text[p - 1]
            if c in _CLOSERS and p > 1:
                c = text[p - 2]
            s = _RANK.get(c, 1)
            if s < LINE and "\n" in gap:
                s = LINE
        places.append(p)
        strengths.append(s)
    return places, strengths


class StrongestCut:
    """Range-maximum index over strengths; of equal ones the rightmost."""

    def __init__(self, strengths: list[int], width: int) -> None:
        v = np.asarray(strengths, np.int64)
        self.value = v
        self.levels = [np.arange(len(v))]
        step = 1
        while 2 * step <= min(width, len(v)):
            a = self.levels[-1]
            x, y = a[: len(a) - step], a[step:]
            self.levels.append(np.where(v[y] >= v[x], y, x))
            step *= 2

    def best(self, i: int, j: int) -> int:
        """The place of the maximum of strengths[i:j], j > i."""
        k = (j - i).bit_length() - 1
        k = min(k, len(self.levels) - 1)
        row, v = self.levels[k], self.value
        x = int(row[i])
        at = i + (1 << k)
        while at < j:  # one step, but for windows wider than the table's widest level
            y = int(row[min(at, j - (1 << k))])
            if v[y] >= v[x]:
                x = y
            at += 1 << k
        return x


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text: each at most limit long, each but the first starting overlap before the end of the one before."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    places, strengths = boundaries(text)
    least = max(overlap + 1, limit // 2)
    out, start, base, index = [], 0, 0, None
    while n - start > limit:
        end = start + limit
        for low, high in ((start + least, end), (start + overlap + 1, start + least - 1)):
            i, j = bisect_left(places, low), bisect_right(places, high)
            if i < j:
                if index is None or j > base + len(index.value) or i < base:
                    base = i
                    index = StrongestCut(strengths[base : base + max(TABLE, j - i)], limit)
                end = places[base + index.best(i - base, j - base)]
                break
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split(chunks: DataFrame, limit: int = 2200, overlap: int = 150, text: str = "text") -> DataFrame:
    """doc_id, idx, page, piece (from 0), pieces (how many), start, stop (in text), text of each piece.

    Pieces cover the text without white space at both ends and count code points. Texts within the
    limit stay one piece and never leave the JVM. A null text and one of white space only give no
    piece. Repeated rows give repeated pieces; null doc_id, idx and page pass through. A window
    without any pause is cut at the limit. Other columns are not read.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    trimmed = F.btrim(F.col(text), F.lit(SPACE))
    lead = F.length(text) - F.length(F.ltrim(F.col(text), F.lit(SPACE)))
    base = chunks.select("doc_id", "idx", "page", F.col(text).alias("text"))
    short = base.where((F.length(trimmed) <= limit) & (F.length(trimmed) > 0)).select(
        "doc_id", "idx", "page", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), lead.alias("start"), (lead + F.length(trimmed)).alias("stop"), trimmed.alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, pieces, start, stop, out = [], [], [], [], [], []
            for r, t in enumerate(b.column(3).to_pylist()):
                body = t.strip()
                shift = len(t) - len(t.lstrip())
                found = cuts(body, limit, overlap)
                for k, (x, y) in enumerate(found):
                    row.append(r)
                    piece.append(k)
                    pieces.append(len(found))
                    start.append(shift + x)
                    stop.append(shift + y)
                    out.append(body[x:y])
            take = pa.array(row, pa.int64())
            kept = [b.column(c).take(take) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int32()) for x in (piece, pieces, start, stop)), pa.array(out, pa.string())], names=names)

    names = ["doc_id", "idx", "page", "piece", "pieces", "start", "stop", "text"]
    shape = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in names[:3]) + ", piece int, pieces int, start int, stop int, text string"
    long = base.where(F.length(trimmed) > limit).mapInArrow(run, shape)
    return short.unionByName(long)
