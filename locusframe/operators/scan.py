"""Ordered scans over positions that no single task has to do alone.

Rows are dealt by (group, block of positions); within a block a window does the scan, and what the blocks before or after contribute is an
aggregate of one row for each block, scanned on its own and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one block.
BLOCK = 1 << 17


def scan(rows: DataFrame, position: Column, order: list[str], results: dict[str, tuple], group: str = "chrom", block: int = BLOCK) -> DataFrame:
    """rows with one more column for each of results: name -> (aggregate, column, direction).

    Direction 'before' takes the rows before this one in the group, 'upto' also this one, 'after' the rows after it. aggregate is
    a function such as F.max or F.min; position must not fall along order.
    """
    dealt = rows.withColumn("_block", F.floor(position / block))
    # rows after this one are rows before it in the other order: a frame to the end of its partition would be summed anew for each row
    back = [F.col(c).desc() for c in order]
    up, down = Window.partitionBy(group, "_block").orderBy(*order), Window.partitionBy(group, "_block").orderBy(*back)
    frames = {"before": up.rowsBetween(Window.unboundedPreceding, -1), "upto": up.rowsBetween(Window.unboundedPreceding, 0), "after": down.rowsBetween(Window.unboundedPreceding, -1)}
    blocks = dealt.groupBy(group, "_block").agg(*[f(F.col(c) if isinstance(c, str) else c).alias(f"_b_{name}") for name, (f, c, _) in results.items()])
    past = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy(group).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_k"), *[f(F.col(f"_b_{name}")).over(coming if way == "after" else past).alias(f"_c_{name}") for name, (f, _, way) in results.items()])
    here = dealt.select("*", *[f(F.col(c) if isinstance(c, str) else c).over(frames[way]).alias(f"_h_{name}") for name, (f, c, way) in results.items()])
    joined = here.join(carried, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_k")))
    pick = {name: (F.greatest if f is F.max else F.least)(F.col(f"_h_{name}"), F.col(f"_c_{name}")) for name, (f, _, _) in results.items()}
    return joined.select(*[F.col(c) for c in rows.columns], *[v.alias(name) for name, v in pick.items()])
