"""Linear-chain decoding over tables of emissions: best path and log-partition, one sequence a row.

Null or empty sequences give an empty path and 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def viterbi(emissions: Column, transitions: list[list[float]], start: list[float], end: list[float]) -> Column:
    """Best label path of emissions (array of arrays of scores). Ties go to the smaller label."""
    a, s, e = np.array(transitions), np.array(start), np.array(end)

    @F.pandas_udf("array<int>")
    def run(col: pd.Series) -> pd.Series:
        def path(rows):
            if rows is None or len(rows) == 0:
                return []
            x = np.array([np.asarray(r, float) for r in rows])
            score, back = s + x[0], []
            for t in range(1, len(x)):
                m = score[:, None] + a
                back.append(m.argmax(0))
                score = m.max(0) + x[t]
            best = [int((score + e).argmax())]
            for b in reversed(back):
                best.append(int(b[best[-1]]))
            return best[::-1]

        return col.map(path)

    return run(emissions)


def log_partition(emissions: Column, transitions: list[list[float]], start: list[float], end: list[float]) -> Column:
    """Log of the summed scores of all paths."""
    a, s, e = np.array(transitions), np.array(start), np.array(end)

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        def total(rows):
            if rows is None or len(rows) == 0:
                return 0.0
            x = np.array([np.asarray(r, float) for r in rows])
            score = s + x[0]
            for t in range(1, len(x)):
                m = score[:, None] + a
                top = m.max(0)
                score = top + np.log(np.exp(m - top).sum(0)) + x[t]
            score = score + e
            return float(score.max() + np.log(np.exp(score - score.max()).sum()))

        return col.map(total)

    return run(emissions)


def path_score(emissions: Column, path: Column, transitions: list[list[float]], start: list[float], end: list[float]) -> Column:
    """The score of one label path, in built-in columns; 0 for null or empty sequences."""
    a, s, e = (F.array(*map(F.lit, x)) for x in ([v for row in transitions for v in row], start, end))
    width = len(start)
    at = lambda t: F.get(path, t)
    steps = F.transform(emissions, lambda x, t: F.get(x, at(t)) + F.when(t > 0, F.get(a, at(t - 1) * width + at(t))).otherwise(F.get(s, at(t))))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) + F.get(e, at(F.size(path) - 1))
    return F.when(F.size(F.coalesce(emissions, F.array().cast("array<array<double>>"))) > 0, total).otherwise(0.0)


def loss(emissions: Column, path: Column, transitions: list[list[float]], start: list[float], end: list[float]) -> Column:
    """Negative log-likelihood of a label path."""
    return log_partition(emissions, transitions, start, end) - path_score(emissions, path, transitions, start, end)
