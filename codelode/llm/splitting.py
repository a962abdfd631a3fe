"""Splitting oversized chunks at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 1500, 150
PIECES = "chunk_id string, file_path string, piece int, n_pieces int, start_char int, end_char int, start_line int, end_line int, chunk_type string, cut string, text string"
#: Cost of a cut, by what it falls on.
COST = {"blank": 0.0, "block": 0.15, "line": 0.5, "space": 3.0, "mark": 4.0, "hard": 8.0}
_OPENS = re.compile(r"[ \t]*(?:@|def |class |async |function |func |public |private |protected |static |type |/\*\*|//|#)")


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Positions where a piece may end, their costs and kinds; the last is the end of the text.

    Line ends count, cheaper before a blank line, a definition or shallow code.
    A line that may not fit in a piece also offers blanks, then punctuation, then,
    where it has neither, every position a quarter of the limit apart.
    """
    at: list[int] = []
    cost: list[float] = []
    kind: list[str] = []
    pos = 0
    lines = text.splitlines(keepends=True)
    for i, line in enumerate(lines):
        if len(line) > limit // 2:
            step, last = max(1, limit // 4), pos
            marks = {pos + m.end(): ("space" if m.group().isspace() else "mark") for m in re.finditer(r"\s+|[,;)}\]>]+", line)}
            for p in [*sorted(marks), pos + len(line)]:
                while p - last > step:
                    last += step
                    at.append(last), cost.append(COST["hard"]), kind.append("hard")
                # A piece has to start somewhere near: keep marks at least a few characters apart.
                if p < pos + len(line) and p - last >= max(1, limit // 50):
                    at.append(p), cost.append(COST[marks[p]]), kind.append(marks[p])
                    last = p
        pos += len(line)
        if pos < len(text):
            nxt = lines[i + 1]
            if not line.strip() or not nxt.strip():
                k, c = "blank", COST["blank"]
            elif _OPENS.match(nxt):
                k, c = "block", COST["block"]
            else:
                k, c = "line", COST["line"]
            indent = len(nxt) - len(nxt.lstrip(" \t"))
            at.append(pos), cost.append(c + min(indent, 40) * 0.02), kind.append(k)
    at.append(len(text)), cost.append(0.0), kind.append("end")
    return np.array(at), np.array(cost), kind


def overlap_start(at: np.ndarray, cut: int, overlap: int) -> int:
    """Where the piece after ``cut`` starts: the first boundary at most ``overlap`` before it."""
    if overlap <= 0 or cut == 0:
        return cut
    return int(at[np.searchsorted(at, cut - overlap)])


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """``(start, end, kind of the cut at the end)`` of the pieces of ``text``.

    best[j] is the least cost of cutting the text up to boundary j: the cost of the
    cuts, one for each piece (so fewer pieces win), and the squared difference of each
    piece from even size. Only boundaries within ``limit`` before j are looked at, so work
    grows with the length. Consecutive pieces share what overlap_start gives.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    at, cost, kind = boundaries(text, limit)
    ends = np.concatenate(([0], at))
    begin = np.array([0, *(overlap_start(at, int(c), overlap) for c in at)])
    target = n / -(-n // max(1, limit - overlap))
    best = np.full(len(ends), np.inf)
    best[0] = 0.0
    come = np.zeros(len(ends), dtype=np.int64)
    for j in range(1, len(ends)):
        # begin never decreases, so the candidates are one slice: those near enough, and
        # those whose piece starts before the one after it.
        i = int(np.searchsorted(begin[:j], ends[j] - limit))
        k = j if j == len(ends) - 1 else int(np.searchsorted(begin[:j], begin[j]))
        if i >= k:
            continue
        fresh = ends[j] - ends[i:k]
        total = best[i:k] + ((fresh - target) / target) ** 2
        k = int(np.argmin(total))
        best[j] = total[k] + cost[j - 1] + 1.0
        come[j] = i + k
    if not np.isfinite(best[-1]):  # no way under the limit: cut by length alone
        step = max(1, limit - overlap)
        starts = range(0, max(1, n - limit + step), step)
        return [(a, min(n, a + limit), "hard" if a + limit < n else "end") for a in starts]
    out = []
    j = len(ends) - 1
    while j:
        i = int(come[j])
        out.append((int(begin[i]), int(ends[j]), kind[j - 1]))
        j = i
    return out[::-1]


def _split_batches(limit: int, overlap: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk_id, path, first, kind, text in zip(pdf["chunk_id"], pdf["file_path"], pdf["start_line"], pdf["chunk_type"], pdf["text"]):
                parts = split_text(text, limit, overlap)
                for i, (a, b, cut) in enumerate(parts):
                    if first is None or first != first:
                        lo = hi = None
                    else:
                        lo = int(first) + text.count("\n", 0, a)
                        hi = int(first) + text.count("\n", 0, max(a, b - 1))
                    rows.append((chunk_id, path, i + 1, len(parts), a, b, lo, hi, kind, cut, text[a:b]))
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (PIECES) of the chunks whose text has more than ``limit`` characters.

    Lines are counted from the chunk's ``start_line``; where that is null or below 1, from
    the one in ``chunk_id``; its dirty ``end_line`` is not used. ``chunk_type`` is the
    parent's, in lower case. Repeated rows of a chunk count once. Null texts and texts within the
    limit give no rows. Characters are code points.
    """
    said = F.try_to_number(F.regexp_extract("chunk_id", r"::(\d+)-\d+::", 1), F.lit("999999999")).cast("int")
    big = chunks.where(F.char_length("text") > limit).select("chunk_id", "file_path", F.when(F.col("start_line") >= 1, F.col("start_line")).otherwise(said).alias("start_line"), F.lower("chunk_type").alias("chunk_type"), "text")
    return big.dropDuplicates(["chunk_id", "text"]).mapInPandas(_split_batches(limit, overlap), PIECES)


def p1_found(chunks: DataFrame) -> DataFrame:
    """Chunks that had to be split, taken from their pieces."""
    return split_chunks(chunks).where("n_pieces > 1").select("chunk_id").distinct()
