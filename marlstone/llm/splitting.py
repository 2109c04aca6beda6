"""Splitting of oversized records at natural boundaries (problem 3).

Dynamic programming over boundary positions: a cut's penalty says how little the source pauses there, a piece's
imbalance is its squared deviation from equal sizes; the least sum subject to the largest size and the overlap wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.tables import spread

#: How little a source pauses at a cut: between paragraphs at the outermost level, between paragraphs, before an
#: outermost line, between lines, at white space within a line, anywhere.
PARAGRAPH_TOP, PARAGRAPH, TOP, LINE, BLANK, ANYWHERE = 0.0, 0.15, 0.3, 0.6, 3.0, 6.0
KINDS = {PARAGRAPH_TOP: "paragraph", PARAGRAPH: "paragraph", TOP: "definition", LINE: "line", BLANK: "word", ANYWHERE: "byte"}
#: A piece more costs this much; the imbalance weighs 1.
PER_PIECE = 0.4
#: Within a line too long for one piece, the places where a cut may fall lie this far apart at most.
STEP = 128

ENDINGS = {"lf": b"\n", "crlf": b"\r\n", "cr": b"\r"}


def ending_of(blob: bytes, named: str | None) -> bytes:
    """The named line ending; without a known name the one that most lines have (CRLF only by a strict majority)."""
    if named in ENDINGS:
        return ENDINGS[named]
    crlf = blob.count(b"\r\n")
    cr, lf = blob.count(b"\r") - crlf, blob.count(b"\n") - crlf
    return b"\r\n" if crlf > max(cr, lf) else b"\r" if cr > lf else b"\n"


def _inside(blob: bytes, start: int, end: int) -> Iterator[tuple[int, float]]:
    """Places for cuts within a long line: the last blank of each step, else a character's start."""
    at = start
    while end - at > STEP:
        stop = at + STEP
        k = max(blob.rfind(b" ", at + 1, stop), blob.rfind(b"\t", at + 1, stop))
        if k >= 0:
            yield k + 1, BLANK
            at = k + 1
            continue
        k = stop
        while k > at + STEP - 4 and blob[k] & 0xC0 == 0x80:
            k -= 1
        k = k if k > at and blob[k] & 0xC0 != 0x80 else stop
        yield k, ANYWHERE
        at = k


def boundaries(blob: bytes, sep: bytes, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Positions where a cut may fall and their penalties; the start offset of each line."""
    starts, lines = [0], blob.split(sep)
    for x in lines[:-1]:
        starts.append(starts[-1] + len(x) + len(sep))
    pos: list[int] = []
    cost: list[float] = []
    for i, x in enumerate(lines):
        at = starts[i]
        if i and at < len(blob):
            after_blank, top = not lines[i - 1].strip(), bool(x) and x[:1] not in b" \t})]"
            pos.append(at)
            cost.append((PARAGRAPH_TOP if top else PARAGRAPH) if after_blank and x.strip() else TOP if top else LINE)
        if len(x) > min(room, STEP * 8):
            for k, c in _inside(blob, at, at + len(x)):
                if k > at:
                    pos.append(k)
                    cost.append(c)
    return np.array(pos, dtype=np.int64), np.array(cost), starts


def _cut(pos: np.ndarray, cost: np.ndarray, n: int, limit: int, overlap: int, k: int) -> tuple[float, list[int]] | None:
    """The best k - 1 cuts (indices into pos), or None where k pieces cannot do."""
    room, even = limit - overlap, (n + (k - 1) * overlap) / k
    best, lo = np.zeros(1), -1  # lo: index in pos of the first entry of best; -1 stands for the start of the record
    back: list[tuple[int, int, np.ndarray]] = []
    for j in range(1, k):
        reach_from = 0 if lo < 0 else int(pos[lo])
        first = int(np.searchsorted(pos, max(reach_from + 1, n - (k - j) * room), "left"))
        last = int(np.searchsorted(pos, min(n - 1, limit + (j - 1) * room), "right"))
        if first >= last:
            return None
        here = pos[first:last]
        prev = np.zeros(1, np.int64) if lo < 0 else pos[lo : lo + len(best)]
        size = here[:, None] - prev[None, :] + (0 if lo < 0 else overlap)
        total = best[None, :] + ((size - even) / limit) ** 2
        total[(here[:, None] <= prev[None, :]) | (size > limit)] = np.inf
        arg = total.argmin(axis=1)
        now = total[np.arange(len(here)), arg] + cost[first:last]
        back.append((first, lo, arg))
        best, lo = now, first
    tail = n - (0 if lo < 0 else pos[lo : lo + len(best)]) + (0 if lo < 0 else overlap)
    total = best + ((tail - even) / limit) ** 2
    total = np.where(tail > limit, np.inf, total)
    i = int(np.argmin(total))
    if not np.isfinite(total[i]):
        return None
    value, cuts = float(total[i]) + PER_PIECE * k, []
    for first, _, arg in reversed(back):
        cuts.append(first + i)
        i = int(arg[i])
    return value, cuts[::-1]


def _bounds(pos: np.ndarray, cost: np.ndarray, n: int, limit: int, room: int) -> tuple[int, float]:
    """The least number of pieces, 0 where these cuts cannot do, and the least sum of cut penalties for any number."""
    # of each cut, from the start on: the least pieces before it and the least penalties with it
    count, paid, lo, at = [], [], 0, pos.tolist()
    cheap: deque[int] = deque()  # cuts within reach, of rising penalties
    for j, (x, c) in enumerate(zip([*at, n], [*cost.tolist(), 0.0])):
        while lo < j and x - at[lo] > room:
            lo += 1
        while cheap and cheap[0] < lo:
            cheap.popleft()
        if x <= limit:
            count.append(1)
            paid.append(c)
        elif cheap:
            count.append(next(count[i] for i in range(lo, j) if count[i]) + 1)  # the earliest that can be reached
            paid.append(c + paid[cheap[0]])
        else:
            count.append(0)
            paid.append(float("inf"))
        if count[-1]:
            while cheap and paid[cheap[-1]] >= paid[-1]:
                cheap.pop()
            cheap.append(j)
    return count[-1], paid[-1]


def split(blob: bytes, named: str | None, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], list[int], list[int]]:
    """Pieces (start, end, kind of the cut at the end), lines that had to be cut (1-based), starts of all lines.

    Every piece but the first starts exactly `overlap` bytes before the end of the one before it, and none is longer
    than the limit. A line had to be cut if a cut falls within it and it alone is longer than the limit; no pieces
    within the limit leave such a line whole.
    """
    n, sep = len(blob), ending_of(blob, named)
    if n <= limit:
        return [(0, n, "end")], [], [0]
    room = limit - overlap
    pos, cost, starts = boundaries(blob, sep, room)
    least, floor = _bounds(pos, cost, n, limit, room)
    if not least:  # lines that fill the room leave no other way: cuts anywhere
        extra = np.arange(max(1, room // 2), n, max(1, room // 4), dtype=np.int64)
        both = np.concatenate([pos, extra])
        pos, keep = np.unique(both, return_index=True)
        cost = np.concatenate([cost, np.full(len(extra), ANYWHERE)])[keep]
        least, floor = _bounds(pos, cost, n, limit, room)
    found, k = None, least
    while found is None or PER_PIECE * k + floor < found[0]:  # no larger number of pieces can be better beyond that
        got = _cut(pos, cost, n, limit, overlap, k)
        if got:
            found = min(found or got, got)
        k += 1
    pieces, at = [], 0
    for i in found[1]:
        pieces.append((at, int(pos[i]), KINDS[float(cost[i])]))
        at = int(pos[i]) - overlap
    pieces.append((at, n, "end"))
    ends = [*(x - len(sep) for x in starts[1:]), n]
    cut = {bisect_right(starts, end) - 1 for _, end, _ in pieces[:-1]}
    long = [i + 1 for i in sorted(cut) if ends[i] - starts[i] > limit and any(starts[i] < end < ends[i] for _, end, _ in pieces)]
    return pieces, long, starts


_PIECES = "file_key string, piece_no int, start_byte long, end_byte long, start_line int, end_line int, cut string, piece binary, long_lines array<int>"


def split_records(files: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """Pieces of every record whose source_blob has more than max_size bytes: one row for each piece, in order.

    Reads file_key, source_blob and line_ending; other columns are left out. start_line and end_line are 1-based;
    cut says what the source does where the piece ends; long_lines, in the first piece, lists the lines that had to
    be cut, since they alone are longer than max_size. A null blob, or one within the limit, has no pieces; a null or unknown line_ending is
    taken from the bytes. A record delivered twice gives its pieces once (the rows are distinct by content).
    Raises ValueError unless 0 <= overlap < max_size.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap has to be smaller than the largest size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in _PIECES.split(", ")}
            for key, blob, named in zip(*(b.column(i).to_pylist() for i in range(3))):
                pieces, long, starts = split(blob, named, max_size, overlap)
                lines = np.array(starts)
                for i, (s, e, cut) in enumerate(pieces):
                    row = (key, i, s, e, int(np.searchsorted(lines, s, "right")), int(np.searchsorted(lines, e - 1, "right")), cut, blob[s:e], [] if i else long)
                    for col, v in zip(out.values(), row):
                        col.append(v)
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    over = files.select("file_key", "source_blob", "line_ending").filter(F.length("source_blob") > max_size)
    return spread(over).mapInArrow(run, _PIECES)


def found(pieces: DataFrame) -> DataFrame:
    """Of the pieces: file_key with line_no 0 for each record that came out in several, and each line that had to be cut."""
    first = pieces.filter(F.col("piece_no") == 0)
    lines = F.concat(F.array(F.lit(0)), F.coalesce("long_lines", F.array().cast("array<int>")))
    return first.select("file_key", F.explode(lines).alias("line_no")).distinct()
