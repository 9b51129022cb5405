"""Exact tests of two-by-two tables and ranks of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tables whose probability exceeds the observed one's by less than this share count as equally likely.
TOLERANCE = 1e-7


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """The two-sided p-value: the hypergeometric probability of all tables with the same margins that are no likelier."""
    first, row, total = a + c, c + d, a + b + c + d
    low, high = max(0, first + row - total), min(first, row)
    k = np.arange(low, high, dtype=float)
    step = np.log(first - k) + np.log(row - k) - np.log(k + 1) - np.log(total - first - row + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    logs -= logs.max()
    p = np.exp(logs - np.log(np.exp(logs).sum()))  # underflows where the probability itself does
    return float(min(p[p <= p[c - low] * (1 + TOLERANCE)].sum(), 1.0))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The p-value of each row's table."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_p(*map(int, t)) if min(t) >= 0 else float("nan") for t in zip(a, b, c, d, strict=True)], dtype=float)

    return run(a, b, c, d)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a / b) / (c / d), 1 where both quotients are equal."""
    left, right = F.try_divide(a.cast("double"), b), F.try_divide(c.cast("double"), d)
    infinite = F.lit(float("inf"))
    left, right = F.when(b == 0, F.when(a > 0, infinite).otherwise(0.0)).otherwise(left), F.when(d == 0, F.when(c > 0, infinite).otherwise(0.0)).otherwise(right)
    return F.when(left == right, 1.0).when(right == 0, infinite).otherwise(F.try_divide(left, right))


def tested(tables: DataFrame) -> DataFrame:
    """tables (a, b, c, d) with p_value, log_score and odds_ratio; impossible tables are errors, without values."""
    bad = (F.col("b") < 0) | (F.col("d") < 0)
    p = F.when(~bad, fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    out = tables.withColumn("p_value", p)
    score = F.when(F.col("p_value") <= 0, F.lit(float("inf"))).otherwise(F.abs(F.log10("p_value")))
    return out.withColumns({"log_score": score, "odds_ratio": F.when(~bad, odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d"))), "error": bad})


def ranked(results: DataFrame, support: str = "a") -> DataFrame:
    """Competition ranks by support, log_score and odds_ratio, their maximum and mean; one row for each data set, so few."""
    rank = lambda c: F.rank().over(Window.orderBy(F.col(c).desc()))
    out = results.withColumns({"support_rank": rank(support), "log_rank": rank("log_score"), "odds_rank": rank("odds_ratio")})
    three = [F.col("support_rank"), F.col("log_rank"), F.col("odds_rank")]
    return out.withColumns({"max_rank": F.greatest(*three), "mean_rank": (three[0] + three[1] + three[2]) / 3})
