"""Folds over numeric and structured arrays, all in Spark's array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(flags: Column) -> Column:
    """Lengths of the runs of true in an array of booleans, in order."""
    fold = F.aggregate(
        flags,
        F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("now")),
        lambda acc, flag: F.when(flag, F.struct(acc["done"].alias("done"), (acc["now"] + 1).alias("now"))).otherwise(
            F.struct(F.when(acc["now"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.lit(0).alias("now"))
        ),
        lambda acc: F.when(acc["now"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]),
    )
    return fold


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets; a null array is empty."""
    clean = lambda x: F.array_sort(F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))))
    return clean(a) == clean(b)


def changed(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the pairs whose sides differ (two nulls are equal), in the order given."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in pairs.items()]))


def first_issue(rules: dict[str, Column]) -> Column:
    """Name of the first rule that holds; null if none does."""
    out = None
    for name, holds in rules.items():
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return out
