"""Summaries beyond plain aggregates: index percentiles, quartiles, streaks, rate limits, quotas and rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from ..functions.times import HOUR


SLICES = 256


def values_at(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group its number of rows `n` and, under each name, the value at a rank (from 0) that is a function of n.

    A group's range is cut into slices and only counted; then only the slices that hold a rank are sorted, each by
    itself, so no task sorts a whole group."""
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    spans = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    cut = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(SLICES - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * SLICES)))
    sliced = rows.join(spans, by).withColumn("slice", cut.cast("int"))
    before = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows a group at most
    counts = sliced.groupBy(*by, "slice").agg(F.count("*").alias("c"), F.first("n").alias("n")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    asked = counts.withColumn("ask", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()])))
    asked = asked.filter((F.col("ask.rank") >= F.col("start")) & (F.col("ask.rank") < F.col("start") + F.col("c")))
    asked = asked.select(*by, "slice", F.col("ask.name").alias("name"), (F.col("ask.rank") - F.col("start") + 1).alias("nth"))
    held = sliced.join(asked.select(*by, "slice").distinct(), [*by, "slice"], "left_semi")
    numbered = held.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "slice").orderBy("v")).cast("long"))
    found = numbered.join(asked, [*by, "slice", "nth"])
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])


def index_percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Percentiles that are values of the rows: the lower nearest rank, and the rank rounded half to even."""
    at = lambda q, cut: lambda n: cut((n - 1) * F.lit(q))
    return values_at(rows, value, [*by], {"p50_low": at(0.5, F.floor), "p95_low": at(0.95, F.floor), "p95_even": at(0.95, F.bround)})


def exclusive_quartiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Quartiles at rank q (n + 1), between neighbours in proportion; the least value thrice below four rows."""
    low = lambda i, n: F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4), n - 1))
    ranks = {f"a{i}": (lambda n, i=i: low(i, n) - 1) for i in (1, 2, 3)} | {f"b{i}": (lambda n, i=i: low(i, n)) for i in (1, 2, 3)} | {"least": lambda n: n * 0}
    out, n = values_at(rows, value, [*by], ranks), F.col("n")

    def quartile(i: int) -> Column:
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        return F.when(n < 4, F.col("least").cast("double")).otherwise(a + (b - a) * ((i * (n + 1) - low(i, n) * 4) / F.lit(4.0)))

    return out.select(*by, "n", *[quartile(i).alias(f"q{i}") for i in (1, 2, 3)])


def interpolated(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """For each group its number of rows `n` and percentiles between neighbours in proportion, from values_at()."""
    place = lambda q: lambda n: (n - 1) * F.lit(q)
    ranks = {f"{name}_{side}": (lambda n, q=q, f=f: f(place(q)(n))) for name, q in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    out = values_at(rows, value, by, ranks)
    part = lambda q: place(q)(F.col("n")) - F.floor(place(q)(F.col("n")))
    between = lambda name, q: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * part(q)
    return out.select(*by, "n", *[between(name, q).alias(name) for name, q in shares.items()])


def low_streaks(rows: DataFrame, key: str, order: str, low: Column, least: int) -> DataFrame:
    """Longest run of low rows of each key in the order of `order` (microseconds), and whether it reaches `least`.

    Runs are found hour by hour; an hour is then its rows, its longest run and those at its ends, and hours of a key are
    joined one after the other."""
    hours = rows.withColumns({"low": low, "hour": F.floor(F.col(order) / HOUR)})
    w, n = Window.partitionBy(key, "hour").orderBy(order), F.count("*").over(Window.partitionBy(key, "hour"))
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "hour", "low").orderBy(order))
    runs = (
        hours.withColumns({"island": island, "nth": F.row_number().over(w), "rows": n})
        .groupBy(key, "hour", "rows", "low", "island")
        .agg(F.count("*").alias("n"), F.min("nth").alias("first"), F.max("nth").alias("last"))
        .filter("low")
    )
    parts = runs.groupBy(key, "hour", "rows").agg(F.max("n").alias("longest"), F.max(F.when(F.col("first") == 1, F.col("n"))).alias("head"), F.max(F.when(F.col("last") == F.col("rows"), F.col("n"))).alias("tail"))
    every = hours.groupBy(key, "hour").agg(F.count("*").alias("rows")).join(parts.drop("rows"), [key, "hour"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    listed = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("hour", "rows", zero("longest").alias("longest"), zero("head").alias("head"), zero("tail").alias("tail")))).alias("hours"))
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("open"))
    step = lambda s, h: F.struct(
        F.greatest(s["best"], h["longest"], s["open"] + h["head"]).alias("best"), F.when(h["tail"] == h["rows"], s["open"] + h["rows"]).otherwise(h["tail"]).alias("open")
    )
    return listed.select(key, F.aggregate("hours", start, step)["best"].alias("longest")).withColumn("stop", F.col("longest") >= least)


def rate_limited(rows: DataFrame, key: str, us: str, limits: dict[int, int]) -> DataFrame:
    """Whether a row comes after too many of its key: limits maps seconds to the number that is too many."""
    w = Window.partitionBy(key).orderBy(us)
    over = F.lit(False)
    for seconds, most in limits.items():
        over = over | (F.count("*").over(w.rangeBetween(-seconds * 1_000_000, -1)) >= most)
    return rows.withColumn("rejected", over)


def model_summary(rows: DataFrame, baseline: int) -> DataFrame:
    """Accuracy and median price of each model and the distance from the baseline's accuracy."""
    medians = interpolated(rows, "price", ["model"], {"median_price": 0.5}).drop("n")
    out = rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("truth")).alias("n_right")).join(medians, "model")
    out = out.withColumn("accuracy", ratio(F.col("n_right"), F.col("n")))
    base = out.filter(F.col("model") == baseline).select(F.col("accuracy").alias("base"))
    return out.crossJoin(F.broadcast(base)).withColumn("delta", F.col("accuracy") - F.col("base")).drop("base")  # one row


def diversity(rows: DataFrame, stratum: str, episode: list[str], part: str) -> DataFrame:
    """Rows and episodes of a stratum, and the share of its largest part."""
    parts = rows.groupBy(stratum, part).agg(F.count("*").alias("c"), F.countDistinct(*episode).alias("e"))
    out = parts.groupBy(stratum).agg(F.sum("c").alias("n"), F.sum("e").alias("episodes"), F.max("c").alias("largest"))
    return out.withColumn("top_share", ratio(F.col("largest"), F.col("n")))


def isolated_duplicates(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows whose key is theirs alone, missing, or shared."""
    counted = rows.withColumn("key", key)
    shared = counted.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n_key"))
    out = counted.join(shared, "key", "left")
    return out.select(name, "key", F.when(F.col("key").isNull(), "missing").when(F.col("n_key") == 1, "unique").otherwise("duplicate").alias("kind"))


def repeat_consistency(rows: DataFrame, key: str, outcome: list[str], least: int) -> DataFrame:
    """Keys with at least `least` repeats and whether all came out alike."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.size(F.collect_set(F.struct(*outcome))).alias("kinds")).filter(F.col("n") >= least).withColumn("consistent", F.col("kinds") == 1)


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either side and of both."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
