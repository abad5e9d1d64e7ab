"""Local alignment with affine gaps as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vocab import ALIGN_SCORES
from ..runtime import ship

RESULT = "score double, aligned int, identical int, coverage double, identity double, pairs map<int,int>"


def local_alignment(query: str, target: str, scores: tuple[float, ...] = ALIGN_SCORES) -> dict:
    """The best local alignment. Among equal ones the end with the smallest query and then target position is taken,
    and on the way back a match is preferred to a gap in the target, and that to a gap in the query.

    Rows are filled whole: gaps in the target come from the row above, and gaps in the
    query from a running maximum over the row, which a gap that opens inside of
    another never beats. One byte a cell is kept for the way back.
    """
    match, mismatch, first, more = scores
    n, m = len(query), len(target)
    if not n or not m:
        return {"score": 0.0, "aligned": 0, "identical": 0, "coverage": 0.0, "identity": 0.0, "pairs": {}}
    letters = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    above, gap = np.zeros(m + 1), np.full(m + 1, -np.inf)  # best and open-gap scores of the row above
    slope = np.arange(m + 1) * more
    way = np.zeros((n + 1, m + 1), np.uint8)  # 1 match, 2 gap in target, 4 gap in query; 8 and 16: that gap goes on
    best = (0.0, 0, 0)
    for i, letter in enumerate(np.frombuffer(query.encode("utf-32-le"), np.uint32), 1):
        opened, going = above + first, gap + more
        gap = np.maximum(opened, going)
        gap[0] = -np.inf
        diagonal = np.full(m + 1, -np.inf)
        diagonal[1:] = above[:-1] + np.where(letters == letter, match, mismatch)
        base = np.maximum(np.maximum(diagonal, gap), 0.0)
        base[0] = 0.0
        run = np.maximum.accumulate(base + first - slope)  # a gap from j on scores run[j] - more + slope of its end
        across = np.full(m + 1, -np.inf)
        across[1:] = run[:-1] + slope[1:] - more
        row = np.maximum(base, across)
        way[i] = ((row == diagonal) * np.uint8(1) | (row == gap) * np.uint8(2) | (row == across) * np.uint8(4)) * (row > 0)
        way[i] |= (gap != opened) * np.uint8(8)
        way[i, 1:] |= (across[1:] != row[:-1] + first) * np.uint8(16)
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (float(row[top]), i, top)
        above = row
    score, i, j = best
    pairs, state = {}, "h"
    while i and j and (state != "h" or way[i, j] & 7):
        step = way[i, j]
        if state == "h":
            if step & 1:
                pairs[i] = j
                i, j = i - 1, j - 1
            else:
                state = "e" if step & 2 else "f"
        elif state == "e":
            state = "e" if step & 8 else "h"
            i -= 1
        else:
            state = "f" if step & 16 else "h"
            j -= 1
    same = sum(query[a - 1] == target[b - 1] for a, b in pairs.items())
    return {"score": score, "aligned": len(pairs), "identical": same, "coverage": len(pairs) / n, "identity": same / len(pairs) if pairs else 0.0, "pairs": dict(sorted(pairs.items()))}


def aligned(query: Column, target: Column) -> Column:
    ship()

    @F.pandas_udf(RESULT)
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([local_alignment(a or "", b or "") for a, b in zip(q, t)], columns=["score", "aligned", "identical", "coverage", "identity", "pairs"])

    return run(query, target)
