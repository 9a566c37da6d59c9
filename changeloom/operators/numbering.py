"""Numbers and running sums over an order, for all rows or by group, without a task that sees them all."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written


def running(rows: DataFrame, order: list[Column], group: tuple[str, ...] = (), place: str = "place", **sums: Column) -> DataFrame:
    """Rows with ``place``, their number from 1 in ``order``, and a running sum for each of ``sums`` (name=column), up to the row.

    Rows are dealt out by ranges of group and order, so a large group lies in several parts, and written. Each part is numbered
    and added up by itself; what comes before a part is found on one row for each part and group, and added. Without a group that
    is one row for each part. The order should tell rows apart: equal rows can't be dealt out, and are numbered in any order.
    """
    keys = [F.col(c) for c in group]
    named = rows.withColumns({f"_sum_{k}": c for k, c in sums.items()}) if sums else rows
    fixed = written(named.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    here = Window.partitionBy("_part", *keys).orderBy(*order)
    to_row = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = fixed.withColumns({"_place": F.row_number().over(here).cast("long")} | {f"_to_{k}": F.sum(f"_sum_{k}").over(to_row) for k in sums})

    totals = fixed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_sum_{k}").alias(f"_all_{k}") for k in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_of_{c}" for c in ("_part", *group)}
    before = totals.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        F.sum("_n").over(earlier).alias("_before"), *[F.sum(f"_all_{k}").over(earlier).alias(f"_before_{k}") for k in sums],
    ).where("_before > 0")
    both = local.join(before, reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]), "left")
    made = [(F.col("_place") + F.coalesce("_before", F.lit(0))).alias(place)]
    made += [(F.col(f"_to_{k}") + F.coalesce(F.col(f"_before_{k}"), F.lit(0))).alias(k) for k in sums]
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *made)
