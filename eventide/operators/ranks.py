"""Running sums in the order of a column, without a task that holds all rows or all of a hot key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(rows: DataFrame, column: str) -> Column:
    """A double that never falls as the column rises; strings count by their first six bytes, null is least."""
    kind, c = rows.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        c = F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 12), 12, "0"), 16, 10)
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    return F.coalesce(c.cast("double"), F.lit(-math.inf))


def ranged(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with out, the number of their range of the column: as many ranges as shuffle partitions, of about equal size.

    The borders are approximate quantiles, a bounded list; they only decide where rows are sorted, never a result.
    """
    from pyspark.ml.feature import Bucketizer

    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = rows.withColumn(out, number(rows, column))
    seen = numbered.where((F.col(out) > -math.inf) & (F.col(out) < math.inf)).agg(F.percentile_approx(out, [k / parts for k in range(1, parts)])).first()[0]
    borders = [-math.inf, *sorted({*(seen or ()), 0.0}), math.inf]
    placed = Bucketizer(splits=borders, inputCol=out, outputCol=f"{out}_at", handleInvalid="keep").transform(numbered)
    return placed.withColumn(out, F.col(f"{out}_at").cast("int")).drop(f"{out}_at")


def running(rows: DataFrame, order: Sequence[str], weight: str, out: str, total: str, keys: Sequence[str] = (), at: int = 0) -> DataFrame:
    """rows with out, the sum of weight over the rows before in the order, and total, the sum over all; within the keys.

    order must tell rows apart. Its column number at is cut into ranges: the ones before it have few values, and the
    ones after it order rows inside a range. Only the sums of ranges are ordered as a whole.
    """
    rows = ranged(rows, order[at], "_range")
    coarse = [*keys, *order[:at], "_range"]
    sums = rows.groupBy(*coarse).agg(F.sum(weight).alias("_held"))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.sum("_held").over(by.orderBy(*order[:at], "_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(coarse)], before.alias("_before"), F.sum("_held").over(by).alias(total))
    inside = F.sum(weight).over(W.partitionBy(*coarse).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    same = F.lit(True)
    for i, c in enumerate(coarse):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    placed = rows.withColumn("_inside", inside).join(sums, same)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return placed.withColumn(out, zero("_before") + zero("_inside")).drop("_range", "_before", "_inside", *[f"_{i}" for i in range(len(coarse))])
