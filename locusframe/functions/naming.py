"""Names made comparable, and their similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores of the local alignment, and the least similarity that counts.
MATCH, MISMATCH, GAP, LEAST = 1.0, -0.25, -1.0, 0.60


def normalised(name: Column) -> Column:
    """Only letters, digits and '+', in lower case."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9+]", ""))


def normalised_mark(name: Column) -> Column:
    """As normalised(); the position in the name of a histone mark loses its leading zeros: H3K04me3 is h3k4me3."""
    return F.regexp_replace(normalised(name), r"^(h\d+[a-z]+?)0+(\d)", "$1$2")


def alignment(a: str, b: str) -> float:
    """The best local alignment of two strings, divided by the shorter one's length."""
    if not a or not b:
        return 0.0
    best, above = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        row = [0.0]
        for j, y in enumerate(b, 1):
            row.append(max(0.0, above[j - 1] + (MATCH if x == y else MISMATCH), above[j] + GAP, row[j - 1] + GAP))
        best, above = max(best, *row), row
    return best / min(len(a), len(b))


def similarity(column: Column, to: str) -> Column:
    """How alike a normalised name and a normalised constant are, from 0 to 1."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in parts:
            yield names.fillna("").map(lambda x: alignment(x, to)).astype(float)

    return run(column)
