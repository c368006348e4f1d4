"""Features of a clip from its neighbours in time, and folds over numeric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import runs, total
from ..functions.times import HOUR, MINUTE


def in_slices(rows: DataFrame, key: str, back: bool = True, ahead: bool = False) -> DataFrame:
    """Rows by hour, with those of the hour before (and after) as context (`own` is false).

    A window of up to an hour then needs no more than two or three hours of a key in one task, however many rows the
    key has in all."""
    at = F.floor(F.col("us") / HOUR)
    shifts = [0] + ([1] if back else []) + ([-1] if ahead else [])
    return rows.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("slice", at + F.col("shift")).withColumn("own", F.col("shift") == 0)


def trailing_counts(clips: DataFrame, minutes: tuple[int, ...] = (10, 30, 60)) -> DataFrame:
    """Clips of the same camera strictly before, within each number of minutes."""
    w = Window.partitionBy("camera_id", "slice").orderBy("us")
    counts = {f"n_{m}m": F.count("*").over(w.rangeBetween(-m * MINUTE, -1)) for m in minutes}
    return in_slices(clips, "camera_id").withColumns(counts).filter("own").select("clip_id", "camera_id", *counts)


def neighbour_seconds(clips: DataFrame, most: int = 3600) -> DataFrame:
    """Seconds since the previous and until the next clip of the camera; null beyond an hour."""
    w = Window.partitionBy("camera_id", "slice").orderBy("us", "clip_id")
    since, until = F.col("us") - F.lag("us").over(w), F.lead("us").over(w) - F.col("us")
    near = lambda d: F.when(d <= most * 1_000_000, d)
    out = in_slices(clips, "camera_id", ahead=True).withColumns({"since_us": near(since), "until_us": near(until)})
    return out.filter("own").select("clip_id", "camera_id", "since_us", "until_us")


def trailing_baseline(clips: DataFrame, value: str, most: int = 20) -> DataFrame:
    """Mean of the last `most` values of the camera in the hour before, 0 without any, and the distance from it.

    Values are numbered and summed up along a slice; the sum of the last ones is the sum so far less that at the value
    before them, which a join on its number finds. No row carries a list."""
    v = F.col(value).cast("decimal(18,4)")
    scope = Window.partitionBy("camera_id", "slice")
    before, hour = (scope.orderBy("us").rangeBetween(low, -1) for low in (Window.unboundedPreceding, -HOUR))
    upto = scope.orderBy("us", "clip_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = in_slices(clips, "camera_id").withColumns(
        {"n_before": F.count(v).over(before), "sum_before": F.sum(v).over(before), "n": F.least(F.count(v).over(hour), F.lit(most)), "number": F.count(v).over(upto), "sum": F.sum(v).over(upto)}
    )
    sums = rows.filter(F.col(value).isNotNull()).select("camera_id", "slice", F.col("number").alias("skipped"), F.col("sum").alias("sum_skipped"))
    asked = rows.filter("own").withColumn("skipped", F.col("n_before") - F.col("n"))
    summed = F.coalesce("sum_before", F.lit(0)) - F.coalesce("sum_skipped", F.lit(0))
    base = F.when(F.col("n") > 0, summed.cast("double") / F.col("n")).otherwise(0.0)
    return asked.join(sums, ["camera_id", "slice", "skipped"], "left").select("clip_id", base.alias("baseline"), (F.col(value) - base).alias("delta"))


def average_rank(value: Column, over: list[str]) -> Column:
    """Rank among rows with a value, ties sharing their mean, from 0 to 1; a single row is 0.5."""
    part = Window.partitionBy(*over, value.isNotNull())
    n = F.count("*").over(part)
    ties = F.count("*").over(Window.partitionBy(*over, value.isNotNull(), value))
    low = F.rank().over(part.orderBy(value)) - 1
    return F.when(value.isNull(), None).when(n == 1, 0.5).otherwise((low + (ties - 1) / 2) / (n - 1))


def average_ranks(rows: DataFrame, value: str, over: list[str]) -> DataFrame:
    """rows with `pct`: average_rank() of value, from counts of distinct values in slices of a group's range, so no task
    sorts a group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*over, F.col(value).alias("v")).agg(F.count("*").alias("ties"))
    spans = counts.groupBy(*over).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("ties").alias("n"))
    cut = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(255), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 256)))
    sliced = counts.join(spans, over).withColumn("slice", cut.cast("int"))
    ahead = lambda w: F.coalesce(F.sum("ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sliced.groupBy(*over, "slice").agg(F.sum("ties").alias("ties")).withColumn("start", ahead(Window.partitionBy(*over).orderBy("slice"))).drop("ties")
    low = F.col("start") + ahead(Window.partitionBy(*over, "slice").orderBy("v"))
    pct = F.when(F.col("n") == 1, 0.5).otherwise((low + (F.col("ties") - 1) / 2) / (F.col("n") - 1))
    told = sliced.join(starts, [*over, "slice"]).select(*over, "v", pct.alias("pct"))
    return rows.withColumn("v", F.col(value)).join(told, [*over, "v"], "left").drop("v")


def as_of(asked: DataFrame, rows: DataFrame, key: str, us: str) -> DataFrame:
    """asked with last_us and n_before: the last row of its key up to its time, and how many there are.

    Both sides are put in order day by day; a day starts with what the days before it leave, of which a key has one row a
    day, so a key is in no task as a whole."""
    day = F.floor(F.col(us) / (24 * HOUR)).alias("day")
    ends = rows.groupBy(key, day).agg(F.max(us).alias("last"), F.count("*").alias("c"))
    every = ends.select(key, "day", "last", "c").unionByName(asked.select(key, day).distinct().withColumns({"last": F.lit(None).cast("long"), "c": F.lit(0).cast("long")}))
    days = every.groupBy(key, "day").agg(F.max("last").alias("last"), F.sum("c").alias("c"))
    past = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(key, "day", F.max("last").over(past).alias("past_us"), F.coalesce(F.sum("c").over(past), F.lit(0)).alias("past_n"))
    both = asked.withColumns({"asks": F.lit(True), "day": day}).unionByName(rows.select(key, us).withColumns({"asks": F.lit(False), "day": day}), allowMissingColumns=True)
    here = Window.partitionBy(key, "day").orderBy(us).rangeBetween(Window.unboundedPreceding, 0)
    own = lambda c: F.when(~F.col("asks"), c)
    seen = both.withColumns({"own_us": F.max(own(F.col(us))).over(here), "own_n": F.count(own(F.lit(1))).over(here)}).filter("asks")
    told = seen.join(before, [key, "day"])
    return told.withColumns({"last_us": F.coalesce("own_us", "past_us"), "n_before": F.col("own_n") + F.col("past_n")}).drop("asks", "day", "own_us", "own_n", "past_us", "past_n")


def near_counts(asked: DataFrame, rows: DataFrame, us: str, wide: int) -> DataFrame:
    """asked with n_near, the rows within `wide` of its time, where there are any.

    Time is cut into buckets of that width. What is near begins in the bucket before that of the time and ends in the bucket
    after: the rows of the first less those before the beginning, all of the second, those of the third up to the end. Running
    counts along a bucket tell each, so nothing is joined pair by pair."""
    bucket = lambda c: F.floor(c / wide)
    here = Window.partitionBy("bucket_")
    upto = here.orderBy("us_").rangeBetween(Window.unboundedPreceding, 0)
    at = F.col(us)
    ends = F.array(*[F.struct(F.lit(side).alias("side_"), (bucket(at) + side).alias("bucket_"), t.alias("us_")) for side, t in ((-1, at - wide - 1), (0, at), (1, at + wide))])
    asks = asked.filter(at.isNotNull()).withColumn("e", F.explode(ends)).select(*asked.columns, "e.*")
    both = asks.withColumn("row_", F.lit(None).cast("int")).unionByName(rows.filter(at.isNotNull()).select(bucket(at).alias("bucket_"), at.alias("us_"), F.lit(1).alias("row_")), allowMissingColumns=True)
    told = both.withColumns({"all_": F.count("row_").over(here), "upto_": F.count("row_").over(upto)}).filter("row_ IS NULL")
    n = F.when(F.col("side_") == -1, F.col("all_") - F.col("upto_")).when(F.col("side_") == 0, F.col("all_")).otherwise(F.col("upto_"))
    return told.groupBy(*asked.columns).agg(F.sum(n).alias("n_near")).filter("n_near > 0")


def burst_stats(series: DataFrame, key: str, values: str, over: float) -> DataFrame:
    """Number of runs of values above a bound and the longest one."""
    flagged = series.withColumn("runs", runs(F.transform(values, lambda x: x > over)))
    return flagged.select(key, F.size("runs").alias("n_bursts"), F.coalesce(F.array_max("runs"), F.lit(0)).alias("longest"))


def late_ratio(series: DataFrame, key: str, values: str) -> DataFrame:
    """Sum and size of the last third of a series (from 2n/3 on) and of all of it, in millionths, and the ratio of the two
    means."""
    n = F.size(values)
    values = F.transform(values, lambda x: F.round(x.cast("double") * 1_000_000).cast("long"))
    first = F.floor(2 * n / 3).cast("int")
    late = F.slice(values, first + 1, F.greatest(n - first, F.lit(1)))
    out = series.select(key, n.alias("n"), F.size(late).alias("n_late"), total(values).alias("all"), total(late).alias("late"))
    return out.withColumn("ratio", F.when(F.col("all") == 0, 0.0).otherwise((F.col("late") / F.col("n_late")) / (F.col("all") / F.col("n"))))


def active_span(series: DataFrame, key: str, values: str, over: float) -> DataFrame:
    """First and last position (from 0) above a bound."""
    places = F.filter(F.transform(values, lambda x, i: F.when(x > over, i)), lambda i: i.isNotNull())
    return series.select(key, F.get(places, 0).alias("first_at"), F.when(F.size(places) > 0, F.element_at(places, -1)).alias("last_at"))


def reliability(mean: Column, std: Column) -> Column:
    return F.when((mean < 18) | (std < 2), "low").when(std >= 8, "high").otherwise("medium")


def long_runs(flags: Column, least: int) -> Column:
    """How many flags lie in runs of true of at least that length; a run that the end cuts counts like any other."""
    return F.aggregate(F.filter(runs(flags), lambda n: n >= least), F.lit(0), lambda a, n: a + n)


def trajectory(points: DataFrame, key: str, order: str, width: float, height: float) -> DataFrame:
    """By key, over points (ok, x, y, w, h): share of good ones, drift of the centre and spread of centres over the diagonal,
    and the last area over the first; null below two good points."""
    diagonal = (width * width + height * height) ** 0.5
    x, y, area = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w") * F.col("h")
    good = F.when(F.col("ok"), F.struct(x.alias("x"), y.alias("y"), area.alias("a")))
    at = F.when(F.col("ok"), F.col(order))
    out = points.groupBy(key).agg(
        F.count("*").alias("frames"),
        F.count_if("ok").alias("n_ok"),
        F.min_by(good, at).alias("first"),
        F.max_by(good, at).alias("last"),
        F.stddev_pop(F.when(F.col("ok"), x)).alias("sx"),
        F.stddev_pop(F.when(F.col("ok"), y)).alias("sy"),
    )
    enough = lambda c: F.when(F.col("n_ok") >= 2, c)
    dx, dy = F.col("last.x") - F.col("first.x"), F.col("last.y") - F.col("first.y")
    return out.select(
        key,
        "frames",
        (F.col("n_ok") / F.col("frames")).alias("ok_rate"),
        enough(F.sqrt(dx * dx + dy * dy) / diagonal).alias("drift"),
        enough(F.when(F.col("first.a") > 0, F.col("last.a") / F.col("first.a"))).alias("area_ratio"),
        enough((F.col("sx") + F.col("sy")) / diagonal).alias("spread"),
    )


def dense_day(rows: DataFrame, by: str, day: str, wanted: Column, last: Column, most_back: int = 30) -> DataFrame:
    """By key the latest day, up to the last closed one and not further back than `most_back`, with a wanted row; where there is
    none, the day at that floor."""
    floor = F.date_sub(F.max(last), most_back)
    found = F.max(F.when(wanted & (F.col(day) <= last) & (F.col(day) >= F.date_sub(last, most_back)), F.col(day)))
    return rows.groupBy(by).agg(F.coalesce(found, floor).alias("day"))


def reliability_of(values: Column) -> Column:
    """reliability() of the mean and the population spread of an array."""
    n = F.size(values)
    mean = total(values) / n
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return reliability(mean, spread)
