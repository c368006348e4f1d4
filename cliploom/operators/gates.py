"""Decisions from summaries: router ladders, switches of filters, capacity, resources, and variants against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from .summaries import interpolated, low_streaks

# Bounds of the two ladders of router decisions.
MOST_LEAK, RISKY_STATIC, CLOUD_BEFORE, MODEL_LIMITED, MOST_CLOUD = 0.02, 0.05, 0.7411167512690355, 0.90, 0.55
REJECT_LEAK, ADOPT_CLOUD, ADOPT_LEAK, ADOPT_MS = 0.05, 0.40, 0.02, 3000.0


def route_summary(rows: DataFrame, route: str, urgent: Column, prefix: str) -> DataFrame:
    """One row: rows, those sent at once, later and to the activity lane only, their shares, and the share of urgent rows that
    went to the activity lane only."""
    is_ = lambda name: F.col(route) == name
    one = rows.agg(
        F.count("*").alias("n"), F.count_if(is_("cloud_now")).alias("now"), F.count_if(is_("cloud_later")).alias("later"), F.count_if(is_("activity_only")).alias("only"),
        F.count_if(urgent).alias("urgent"), F.count_if(urgent & is_("activity_only")).alias("leaked"),
    )
    named = {"n": F.col("n"), "later": F.col("later"), "cloud_now_rate": ratio(F.col("now"), F.col("n")), "activity_only_rate": ratio(F.col("only"), F.col("n")), "leak_rate": ratio(F.col("leaked"), F.col("urgent"))}
    return one.select(*[c.alias(f"{prefix}_{name}") for name, c in named.items()])


def router_decision(first: DataFrame, second: DataFrame | None, still: DataFrame) -> DataFrame:
    """Why a router is adopted, held or rejected; one row.

    first, second: route_summary of the router and, if there is one, of the model behind it, with prefixes l0 and l1; still: one
    row with static_p0_rate, the share of urgent rows among those that hardly move."""
    one = first.crossJoin(F.broadcast(still))  # one row each
    if second is None:
        one = one.withColumns({"l1_leak_rate": F.lit(0.0), "l1_cloud_now_rate": F.lit(None).cast("double")})
    else:
        one = one.crossJoin(F.broadcast(second))
    fewer = (F.col("l0_cloud_now_rate") <= CLOUD_BEFORE) & (F.col("l0_later") > 0)
    subtype = (
        F.when((F.col("l0_leak_rate") > MOST_LEAK) | (F.col("l1_leak_rate") > MOST_LEAK), "reject-unsafe")
        .when((F.col("static_p0_rate") > RISKY_STATIC) & (F.col("l0_activity_only_rate") > 0), "hold-input-limited")
        .when((F.col("l1_cloud_now_rate") >= MODEL_LIMITED) & fewer, "hold-model-limited")
        .when(F.col("l0_cloud_now_rate") > MOST_CLOUD, "hold-policy-too-conservative")
        .otherwise("adopt-v1")
    )
    return one.select("l0_leak_rate", "l0_cloud_now_rate", "l0_activity_only_rate", "l1_leak_rate", "l1_cloud_now_rate", "static_p0_rate", subtype.alias("subtype"))


def router_label(first: DataFrame, latency: DataFrame, finished: Column) -> DataFrame:
    """adopt, hold or reject from a route_summary (prefix l0), one row with avg_latency_ms, and whether all calls finished."""
    one = first.crossJoin(F.broadcast(latency))  # one row each
    fits = (F.col("l0_cloud_now_rate") <= ADOPT_CLOUD) & (F.col("l0_leak_rate") <= ADOPT_LEAK) & (F.col("avg_latency_ms") <= ADOPT_MS) & finished
    return one.withColumn("label", F.when(F.col("l0_leak_rate") >= REJECT_LEAK, "reject").when(fits, "adopt").otherwise("hold"))


def filter_adoption(rows: DataFrame, told: str, human: str, least: float = 0.90) -> DataFrame:
    """For each switch of a filter (exclude_absent, exclude_static): rows it excludes, active ones among them, its precision
    (null without rows), the recall of active rows by all (null without active ones), and whether it may be turned on: no
    active row excluded and a precision of `least`. Rows without a human judgement count nowhere."""
    judged = rows.filter(F.col(human).isNotNull())
    counts = judged.groupBy(told, human).agg(F.count("*").alias("k"))
    active = counts.agg(F.sum(F.when(F.col(human) == "active", F.col("k"))).alias("active"), F.sum(F.when((F.col(human) == "active") & (F.col(told) == "active"), F.col("k"))).alias("kept"))
    switches = F.explode(F.array(*[F.struct(F.lit(f"exclude_{x}").alias("switch"), F.lit(x).alias("meant")) for x in ("absent", "static")])).alias("s")
    some = lambda holds: F.coalesce(F.sum(F.when(holds & (F.col(told) == F.col("s.switch")), F.col("k"))), F.lit(0))
    each = counts.select("*", switches).groupBy("s.switch").agg(some(F.lit(True)).alias("n_excluded"), some(F.col(human) == "active").alias("false_exclusions"), some(F.col(human) == F.col("s.meant")).alias("n_right"))
    out = each.crossJoin(F.broadcast(active))  # one row
    precision = F.when(F.col("n_excluded") > 0, F.col("n_right") / F.col("n_excluded"))
    recall = F.when(F.col("active") > 0, F.coalesce("kept", F.lit(0)) / F.col("active"))
    adopt = (F.col("false_exclusions") == 0) & F.coalesce(precision >= least, F.lit(False))
    return out.select("switch", "n_excluded", "false_exclusions", precision.alias("precision"), recall.alias("active_recall"), adopt.alias("adopt"))


def capacity_gates(calls: DataFrame, arrivals: DataFrame, rss_limit: int, disk_limit: int) -> DataFrame:
    """One row: capacity of an hour (3,600 by the 95th percentile of a call's seconds) against twice the 95th percentile of an
    hour's arrivals, and peaks of memory and disk against their limits.

    calls: seconds, rss_bytes, temp_bytes; arrivals: n, a row an hour."""
    one = lambda rows: rows.withColumn("all_", F.lit(1))
    slow = interpolated(one(calls.filter("seconds IS NOT NULL")), "seconds", ["all_"], {"p95": 0.95}).select((3600 / F.col("p95")).alias("capacity"))
    busy = interpolated(one(arrivals), "n", ["all_"], {"p95": 0.95}).select(F.col("p95").alias("inflow"))
    peaks = calls.agg(F.coalesce(F.max("rss_bytes"), F.lit(0)).alias("peak_rss"), F.coalesce(F.max("temp_bytes"), F.lit(0)).alias("peak_disk"))
    both = slow.crossJoin(F.broadcast(busy)).crossJoin(F.broadcast(peaks))  # one row each
    fast, rss, disk = F.col("capacity") >= F.col("inflow") * 2, F.col("peak_rss") <= rss_limit, F.col("peak_disk") <= disk_limit
    return both.select(
        "capacity", (F.col("inflow") * 2).alias("required"), F.when(F.col("inflow") > 0, F.col("capacity") / F.col("inflow")).otherwise(float("inf")).alias("throughput_ratio"), fast.alias("throughput_pass"),
        "peak_rss", rss.alias("rss_pass"), "peak_disk", disk.alias("disk_pass"), (fast & rss & disk).alias("all_pass"),
    )


def resource_summary(samples: DataFrame, run: str, order: str, low: float = 5, streak: int = 2) -> DataFrame:
    """Of each run: the least free share, what swap has grown since the first sample, the largest memory, whether the process
    changed, and whether so many low samples followed each other. Samples: free_percent, swap_bytes, pid, rss_kib."""
    first = lambda c: F.min_by(c, order)
    sums = samples.groupBy(run).agg(
        F.min("free_percent").alias("free_min"), (F.max("swap_bytes") - first("swap_bytes")).alias("swap_delta"), F.max("rss_kib").alias("rss_max"),
        ((F.min("pid") != first("pid")) | (F.max("pid") != first("pid"))).alias("pid_drift"),
    )
    runs = low_streaks(samples, run, order, F.col("free_percent") <= low, streak).select(run, F.col("longest").alias("low_streak"), F.col("stop").alias("low_free_abort"))
    return sums.join(runs, run)


def variants(calls: DataFrame, merged: dict[str, str]) -> DataFrame:
    """By model, prompt and representation, of the calls that went through: n, right ones (also with labels that count as one),
    means of the tokens that are known, mean and median wall time in milliseconds, and how many failed.

    calls: model, prompt, shape, ok, truth, pred, tokens_in, tokens_out, wall_ms (whole numbers)."""
    by = ["model", "prompt", "shape"]
    same = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in merged.items() for x in kv])[F.col(c)], F.col(c))
    good = F.col("ok")
    mean = lambda c: F.sum(F.when(good, F.col(c))) / F.count(F.when(good, F.col(c)))
    sums = calls.groupBy(*by).agg(
        F.count_if(good).alias("n"), F.count_if(good & (F.col("pred") == F.col("truth"))).alias("n_right"), F.count_if(good & (same("pred") == same("truth"))).alias("merged_right"),
        F.sum(F.when(good, F.col("tokens_in"))).alias("sum_in"), F.count(F.when(good, F.col("tokens_in"))).alias("n_in"), F.sum(F.when(good, F.col("tokens_out"))).alias("sum_out"), F.count(F.when(good, F.col("tokens_out"))).alias("n_out"),
        mean("wall_ms").alias("avg_wall_ms"), F.count_if(~good).alias("errors"),
    ).filter("n > 0")
    median = interpolated(calls.filter("ok AND wall_ms IS NOT NULL"), "wall_ms", by, {"median_wall_ms": 0.5}).select(*by, "median_wall_ms")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.join(median, by, "left").select(
        *by, "n", "n_right", (F.col("n_right") / F.col("n")).alias("accuracy"), (F.col("merged_right") / F.col("n")).alias("merged_accuracy"),
        over("sum_in", "n_in").alias("avg_tokens_in"), over("sum_out", "n_out").alias("avg_tokens_out"), "avg_wall_ms", "median_wall_ms", "errors",
    )


# Bounds of the two parts of a prompt comparison.
LEAST_SUPPRESSION, POOR_SUPPRESSION, MOST_NEW_ERRORS, MOST_LOST, MANY_LOST, MOST_DROP_PP = 0.60, 0.30, 2, 2, 5, -3.0


def prompt_decision(false_rows: DataFrame, regression: DataFrame, target: str, usual: str, errors: list[str], merged: list[str]) -> DataFrame:
    """One row: whether a prompt that is to stop false alarms of `target` is adopted, held or rejected.

    false_rows: before and after of rows that are `usual` in truth and were taken for the target; regression: truth, before,
    after of other rows (null: no answer). Part A: the share of alarms that stop, rows that only now alarm (broken), and rows
    that become one of `errors`. Part B: target rows that are lost, rows recovered and broken where labels of `merged` count as
    one (both sides answered), and the change of accuracy in points. Without alarms before there is no share and part A fails."""
    b, a, t = F.col("before"), F.col("after"), F.col("truth")
    part_a = false_rows.agg(
        F.count_if(b == target).alias("alarms_before"), F.count_if(a == target).alias("alarms_after"), F.count_if((b == target) & (a == usual)).alias("recovered"),
        F.count_if((b == usual) & (a == target)).alias("broken"), F.count_if(a.isin(errors)).alias("new_errors"),
    )
    right = lambda p: F.when(t.isin(merged), p.isin(merged)).otherwise(p == t)
    both = b.isNotNull() & a.isNotNull()
    part_b = regression.agg(
        F.count("*").alias("n"), F.count_if(b == t).alias("right_before"), F.count_if(a == t).alias("right_after"), F.count_if((t == target) & (b == target) & ~a.eqNullSafe(target)).alias("lost"),
        F.count_if(both & ~right(b) & right(a)).alias("merged_recovered"), F.count_if(both & right(b) & ~right(a)).alias("merged_broken"),
        F.count_if(both & (a != b) & right(b) & right(a) & t.isin(merged)).alias("harmless"),
    )
    one = part_a.crossJoin(F.broadcast(part_b))  # one row each
    share = F.when(F.col("alarms_before") > 0, (F.col("alarms_before") - F.col("alarms_after")) / F.col("alarms_before"))
    points = F.when(F.col("n") > 0, (F.col("right_after") - F.col("right_before")) * 100 / F.col("n"))
    told = one.withColumns({"suppression": share, "change_pp": points})
    ok_a = F.coalesce((F.col("suppression") >= LEAST_SUPPRESSION) & (F.col("broken") == 0) & (F.col("new_errors") <= MOST_NEW_ERRORS), F.lit(False))
    ok_b = F.coalesce((F.col("lost") <= MOST_LOST) & (F.col("merged_recovered") >= F.col("merged_broken")) & (F.col("change_pp") >= MOST_DROP_PP), F.lit(False))
    bad = F.coalesce(F.col("suppression") < POOR_SUPPRESSION, F.lit(False)) | (F.col("broken") > 0) | (F.col("lost") >= MANY_LOST) | F.coalesce(F.col("change_pp") < MOST_DROP_PP, F.lit(False))
    return told.withColumns({"ok_a": ok_a, "ok_b": ok_b}).withColumn("decision", F.when(F.col("ok_a") & F.col("ok_b"), "adopt").when(bad, "reject").otherwise("hold"))


def class_distribution(rows: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """Each class that rows or expected (class, expected) name: its number of rows, the expected one, and whether they agree."""
    counts = rows.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    both = counts.join(expected.withColumnRenamed("class", "class_"), F.col("class").eqNullSafe(F.col("class_")), "full")
    told = both.select(F.coalesce("class", "class_").alias("class"), zero("n").alias("n"), zero("expected").alias("expected"))
    return told.withColumn("agrees", F.col("n") == F.col("expected"))


def against_baseline(table: DataFrame, prompt: str, shape: str) -> DataFrame:
    """Each variant beside its model's baseline (this prompt and shape; without it, the first prompt with this shape): share of
    tokens saved, points of accuracy lost, and how much longer a call takes. `table`: rows of variants, a few a model."""
    base = table.filter(F.col("shape") == shape).withColumn("turn", F.when(F.col("prompt") == prompt, 0).otherwise(1))
    first = Window.partitionBy("model").orderBy("turn", "prompt")
    base = base.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    base = base.select("model", F.col("prompt").alias("base_prompt"), F.col("accuracy").alias("base_accuracy"), F.col("avg_tokens_in").alias("base_tokens"), F.col("avg_wall_ms").alias("base_wall"))
    other = table.join(base, "model").filter((F.col("prompt") != F.col("base_prompt")) | (F.col("shape") != shape))
    saved = F.when(F.col("base_tokens") != 0, 1 - F.col("avg_tokens_in") / F.col("base_tokens"))
    return other.select("model", "prompt", "shape", "base_prompt", saved.alias("token_reduction"), ((F.col("base_accuracy") - F.col("accuracy")) * 100).alias("accuracy_drop_pp"), (F.col("avg_wall_ms") - F.col("base_wall")).alias("wall_delta_ms"))
