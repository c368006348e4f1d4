"""Evaluation statistics: accuracy, confusion, agreement, calibration, cascades and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio, wilson


def right() -> Column:
    return F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(right()).alias("n_right")).withColumn("accuracy", ratio(F.col("n_right"), F.col("n")))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every label that is a truth or a prediction."""
    sides = confusion(rows).select("n", F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit("t").alias("side")), F.struct(F.col("pred").alias("label"), F.lit("p").alias("side")))).alias("s"), (F.col("truth") == F.col("pred")).alias("hit"))
    c = sides.groupBy("s.label").agg(
        F.sum(F.when((F.col("s.side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    return c.withColumns({"prec": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))})


def f1_averages(rows: DataFrame) -> DataFrame:
    """Number of labels, macro F1 (mean over labels) and F1 weighted by the labels' rows; one row."""
    scores = class_scores(rows)
    f1 = F.round(F.col("f1") * 1_000_000_000).cast("long")
    out = scores.agg(F.count("*").alias("labels"), F.sum("support").alias("support"), F.sum(f1).alias("all"), F.sum(f1 * F.col("support")).alias("weighted"))
    return out.select("labels", "support", (ratio(F.col("all"), F.col("labels")) / 1e9).alias("macro_f1"), (ratio(F.col("weighted"), F.col("support")) / 1e9).alias("weighted_f1"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected agreement of two raters and Cohen's kappa; 1 where all agreement is certain, else null."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    left, right_ = cells.groupBy(a).agg(F.sum("n").alias("x")), cells.groupBy(b).agg(F.sum("n").alias("y"))
    # One row for each label.
    chance = left.join(right_, left[a] == right_[b]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("chance"))
    seen = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("same"))
    po, pe = F.col("same").cast("double") / F.col("n"), F.col("chance").cast("double") / (F.col("n") * F.col("n"))
    return seen.crossJoin(chance).select("n", "same", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, F.when(po == 1, 1.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def intervals(rows: DataFrame, *by: str) -> DataFrame:
    low, high = wilson(F.col("n_right"), F.col("n"))
    return accuracy(rows, *by).withColumns({"low": low, "high": high})


def calibration(rows: DataFrame, edges: list[float]) -> DataFrame:
    """Accuracy in half-open bins of confidence; the last bin is closed."""
    bin_no = F.lit(len(edges) - 2)
    for i in range(len(edges) - 2, 0, -1):
        bin_no = F.when(F.col("conf") < edges[i], i - 1).otherwise(bin_no)
    return accuracy(rows.withColumn("bin", bin_no.cast("int")), "bin")


def cascade(rows: DataFrame, base: str, strong: str, thresholds: list[float]) -> DataFrame:
    """For each threshold: rows whose base confidence is below it go to the strong model; how many, and the accuracy.

    A row is counted at the first threshold above its confidence, and the few counts are spread over the thresholds."""
    at = sorted(thresholds)
    first = F.lit(len(at))
    for i in range(len(at) - 1, -1, -1):
        first = F.when(F.col("conf") < at[i], i).otherwise(first)
    cells = rows.groupBy(first.alias("first")).agg(F.count("*").alias("c"), F.count_if(F.col(base) == F.col("truth")).alias("b"), F.count_if(F.col(strong) == F.col("truth")).alias("s"))
    spread = cells.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(at)])))
    up = F.col("first") <= F.col("t.i")
    out = spread.groupBy("t.threshold").agg(F.sum("c").alias("n"), F.sum(F.when(up, F.col("c")).otherwise(0)).alias("n_escalated"), F.sum(F.when(up, F.col("s")).otherwise(F.col("b"))).alias("n_right"))
    return out.withColumns({"rate": ratio(F.col("n_escalated"), F.col("n")), "accuracy": ratio(F.col("n_right"), F.col("n"))})


def votes(rows: DataFrame, key: str) -> DataFrame:
    """Majority of two predictions or more; a tie goes to the larger sum of confidences, then to the first label."""
    counted = rows.groupBy(key, "pred").agg(F.count("*").alias("n"), F.sum(F.col("conf").cast("decimal(18,6)")).alias("weight"))
    best = F.min_by("pred", F.struct((-F.col("n")).alias("fewer"), (-F.col("weight")).alias("lighter"), "pred"))
    return counted.groupBy(key).agg(F.sum("n").alias("n_votes"), F.max("n").alias("n_most"), F.count("pred").alias("n_labels"), best.alias("voted")).filter("n_votes >= 2")


def transition(before: Column, after: Column, truth: Column) -> Column:
    """What a new model did to a row."""
    return (
        F.when((before == truth) & (after == truth), "held")
        .when((before != truth) & (after == truth), "recovered")
        .when((before == truth) & (after != truth), "broken")
        .when(before == after, "wrong_same")
        .otherwise("wrong_changed")
    )


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant pairs and the continuity-corrected statistic."""
    hit = lambda c: F.coalesce(F.col(c) == F.col("truth"), F.lit(False))
    out = rows.agg(F.count_if(hit(a) & ~hit(b)).alias("only_a"), F.count_if(~hit(a) & hit(b)).alias("only_b"))
    both = F.col("only_a") + F.col("only_b")
    edge = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double")
    return out.withColumn("chi2", F.when(both == 0, 0.0).otherwise(edge * edge / both))
