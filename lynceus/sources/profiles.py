"""Profiles of nested records by path, as sketches that merge: stored by load, united over loads, compared.

The schema's paths are walked recursively (``a.b`` of structs, ``a[]`` of arrays, ``a{}`` of a map's values), and
every record gives the values that it has at each path.  One aggregate by path keeps counts, least and greatest
value, a HyperLogLog sketch of the distinct values, and one of frequent values; the path ``$`` has the records'
structure, which is the list of paths that a record fills.  What is stored has one row for each path and load,
whatever the size of the load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = "array<string>"
#: Values that a profile names as frequent, and characters of a value that its shape keeps.
FREQUENT, SHOWN = 5, 60


def _leaves(nodes: Column, kind: T.DataType, path: str):
    """(path, array of strings) of every leaf below an array of nodes of one type."""
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            yield from _leaves(_field(nodes, field.name), field.dataType, f"{path}.{field.name}" if path else field.name)
    elif isinstance(kind, T.ArrayType):
        yield from _leaves(F.flatten(F.filter(nodes, lambda x: x.isNotNull())), kind.elementType, path + "[]")
    elif isinstance(kind, T.MapType):
        values = F.flatten(F.transform(F.filter(nodes, lambda x: x.isNotNull()), lambda x: F.map_values(x)))
        yield from _leaves(values, kind.valueType, path + "{}")
    else:
        yield path, F.transform(F.filter(nodes, lambda x: x.isNotNull()), lambda x: F.base64(x) if isinstance(kind, T.BinaryType) else x.cast("string"))


def _field(nodes: Column, name: str) -> Column:
    return F.transform(nodes, lambda x: x[name])


def values(rows: DataFrame) -> DataFrame:
    """(path, values) of every record and path; ``$`` has the paths that the record fills."""
    found = [x for f in rows.schema.fields for x in _leaves(F.array(F.col(f"`{f.name}`")), f.dataType, f.name)]
    each = [F.struct(F.lit(path).alias("path"), F.coalesce(v, F.array()).cast(STRINGS).alias("values")) for path, v in found]
    held = rows.select(F.array(*each).alias("p"))
    filled = F.array_join(F.transform(F.filter("p", lambda x: F.size(x["values"]) > 0), lambda x: x["path"]), ",")
    whole = F.array(F.struct(F.lit("$").alias("path"), F.array(filled).alias("values")))
    return held.select(F.inline(F.concat("p", whole)))


def profile(rows: DataFrame, load: str) -> DataFrame:
    """(load, path, records, filled, n, least, greatest, distinct, frequent): of one load, the last two as sketches.

    ``filled`` counts records with a value at the path, ``n`` the values.  Null, missing and empty collections are
    no values, empty text is one.  An empty load has no rows.
    """
    each = values(rows).withColumn("some", F.size("values") > 0)
    each = each.select("path", F.posexplode_outer("values").alias("k", "v"), "some")
    first = F.col("k").isNull() | (F.col("k") == 0)
    return each.groupBy("path").agg(
        F.count_if(first).alias("records"), F.count_if(first & F.col("some")).alias("filled"), F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"),
        F.hll_sketch_agg(F.concat(F.lit("="), "v")).alias("distinct"), F.expr("approx_top_k_accumulate(v)").alias("frequent"),
    ).withColumn("load", F.lit(load))


def united(profiles: DataFrame, *by: str) -> DataFrame:
    """Profiles of several loads as one (by other columns, if named), from the stored sketches alone."""
    return profiles.groupBy(*by, "path").agg(
        F.sum("records").alias("records"), F.sum("filled").alias("filled"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct").alias("distinct"), F.expr("approx_top_k_combine(frequent)").alias("frequent"),
    )


def told(profiles: DataFrame) -> DataFrame:
    """The profiles with estimates in place of sketches: coverage, distinct values and the most frequent ones."""
    items = F.filter(F.expr(f"approx_top_k_estimate(frequent, {FREQUENT + 1})"), lambda x: x["item"].isNotNull())  # records without a value count there, too
    top = F.transform(F.slice(items, 1, FREQUENT), lambda x: F.struct(F.left(x["item"], F.lit(SHOWN)).alias("value"), x["count"].alias("n")))
    return profiles.withColumns({"coverage": F.round(F.col("filled") / F.col("records"), 6), "distinct": F.hll_sketch_estimate("distinct"), "frequent": top})


def compared(before: DataFrame, now: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(path, change, coverage_before, coverage_now): paths of two profiles; NEW, GONE, FILLS_LESS, FILLS_MORE or SAME."""
    side = lambda rows, as_: rows.filter("filled > 0 and path <> '$'").select("path", F.round(F.col("filled") / F.col("records"), 6).alias(as_))
    both = side(before, "coverage_before").join(side(now, "coverage_now"), "path", "full_outer")
    off = F.col("coverage_now") - F.col("coverage_before")
    change = F.when(F.col("coverage_before").isNull(), "NEW").when(F.col("coverage_now").isNull(), "GONE").when(off < -tolerance, "FILLS_LESS").when(off > tolerance, "FILLS_MORE").otherwise("SAME")
    return both.select("path", change.alias("change"), "coverage_before", "coverage_now")
