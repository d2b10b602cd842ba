"""Places of rows in a whole order, without one global window.

Rows are dealt by ranges of the order and written once with the number of their range; counts of every range
and group become offsets by a window over those counts alone; a row's place is its place in its range plus the
offset.  No task holds more than a range of a group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lynceus.operators.shared import settled


def numbered(rows: DataFrame, group: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """The rows with ``place``, how many rows of their group come before, and ``total``, how many the group has.

    A row counts ``weight`` times if such a column is named.  Nulls come first, and a null group is a group; rows
    that agree in all of ``order`` follow each other in no order of their own, so such rows should be one row with
    a weight.  An empty table stays empty; columns named ``place`` or ``total`` are replaced.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.drop("place", "total").withColumn("__n", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))
    ranges = settled(counted.repartitionByRange(n, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    parts = ranges.groupBy("__range", *group).agg(F.sum("__n").alias("__sum"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__sum").over(before), F.lit(0)), "total": F.sum("__sum").over(whole)})
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.withColumn("__local", F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias("r")
    same = F.col("r.__range") == F.col("p.__range")
    for c in group:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    kept = [F.col(f"r.{c}") for c in rows.columns if c not in ("place", "total")]
    return local.join(parts.alias("p"), same).select(*kept, (F.col("__local") + F.col("__before")).alias("place"), "total")
