"""Scores of predictions and of reviewers. Every one is formed from counts of a few cells, grouped once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio, wilson


def threshold_curve(rows: DataFrame, positive: Column, score: Column, steps: int = 10) -> DataFrame:
    """threshold, tp, fp, fn, precision and recall of `score >= threshold` for steps + 1 thresholds from 0 to 1.

    A row is counted at the highest threshold that it reaches, so the grid never multiplies rows."""
    step = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(steps)), lambda s: s / float(steps) <= score)), F.lit(-1))
    cells = rows.groupBy(step.alias("reached")).agg(F.count_if(positive).alias("p"), F.count("*").alias("n"))
    spread = cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    hit = F.col("reached") >= F.col("step")
    sums = spread.groupBy("step").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"),
    )
    return sums.select(
        (F.col("step") / float(steps)).alias("threshold"), "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall")
    )


def recall_matrix(rows: DataFrame, version: str, truth: str, right: Column, classes: list[str]) -> DataFrame:
    """A row for every version and declared class; recall is null where the version saw none of the class."""
    cells = rows.groupBy(version, truth).agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))
    own = [F.struct(F.lit(c).alias("class"), F.coalesce(F.sum(F.when(F.col(truth) == c, F.col("n"))), F.lit(0)).alias("n"), F.sum(F.when(F.col(truth) == c, F.col("n_right"))).alias("n_right")) for c in classes]
    wide = cells.groupBy(version).agg(F.array(*own).alias("cells"))
    return wide.select(version, F.explode("cells").alias("c")).select(version, "c.class", "c.n", (F.col("c.n_right") / F.col("c.n").cast("double")).alias("recall"))


def accuracy_without(rows: DataFrame, truth: str, right: Column, left_out: dict[str, list[str]]) -> DataFrame:
    """Accuracy over all rows but those of the classes left out, for each named list of classes."""
    cells = rows.groupBy(truth).agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))
    inside = {name: ~F.col(truth).isin(classes) if classes else F.lit(True) for name, classes in left_out.items()}
    parts = [F.struct(F.lit(name).alias("name"), *[F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0)).alias(c) for c in ("n", "n_right")]) for name, keep in inside.items()]
    return cells.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.name", "p.n", "p.n_right", ratio(F.col("p.n_right"), F.col("p.n")).alias("accuracy"))


def unanimity(votes: DataFrame, item: str, order: str, vote: str, truth: str, least: int = 3) -> DataFrame:
    """Items with `least` votes or more: how many are unanimous, and right among these; how many majorities are right.

    A tie goes to the vote that came first (of several at once, the smallest); the truth is that of the first vote."""
    by_vote = votes.groupBy(item, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(truth, F.struct(order, truth)).alias("truth"))
    items = by_vote.groupBy(item).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("kinds"),
        F.min_by(vote, F.struct((-F.col("n")).alias("fewer"), "first", vote)).alias("winner"),
        F.min_by("truth", F.struct("first", "truth")).alias("truth"),
    )
    right = F.col("winner") == F.col("truth")
    return items.filter(F.col("n") >= least).agg(
        F.count("*").alias("n"), F.count_if(F.col("kinds") == 1).alias("n_unanimous"), F.count_if((F.col("kinds") == 1) & right).alias("unanimous_right"), F.count_if(right).alias("majority_right")
    )


def agreement(rows: DataFrame, item: str, reviewer: str, pair: tuple[int, int], dimensions: list[str], abstains: str) -> DataFrame:
    """By dimension: items with both reviewers, those where neither abstains, and those where they agree.

    Of several answers of a reviewer to the same item the largest counts."""
    said = lambda who, d: F.max(F.when(F.col(reviewer) == who, F.col(d)))
    both = rows.filter(F.col(reviewer).isin(*pair)).groupBy(item).agg(F.array(*[F.struct(F.lit(d).alias("dimension"), said(pair[0], d).alias("a"), said(pair[1], d).alias("b")) for d in dimensions]).alias("d"))
    told = both.select(F.explode("d").alias("d")).select("d.*").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    judged = (F.col("a") != abstains) & (F.col("b") != abstains)
    out = told.groupBy("dimension").agg(F.count("*").alias("pairs"), F.count_if(judged).alias("evaluable"), F.count_if(judged & (F.col("a") == F.col("b"))).alias("agreements"))
    return out.withColumn("rate", ratio(F.col("agreements"), F.col("evaluable")))


def settled(rows: DataFrame, item: str, reviewer: str, decision: str, uncertain: str) -> DataFrame:
    """Item, state and final decision of a double-blind review: reviewers 1 and 2 decide where they agree and are not
    uncertain, otherwise the owner (reviewer 3) does; an item without both reviews or without its owner waits. Of several decisions of a reviewer the largest counts."""
    said = lambda who: F.max(F.when(F.col(reviewer) == who, F.col(decision)))
    told = rows.groupBy(item).agg(said(1).alias("a"), said(2).alias("b"), said(3).alias("owner"))
    agree = (F.col("a") == F.col("b")) & (F.col("a") != uncertain)
    waits = F.col("a").isNull() | F.col("b").isNull()
    state = F.when(waits, "awaiting").when(agree, "agreed").when(F.col("owner").isNull(), "conflict").otherwise("resolved")
    return told.select(item, state.alias("state"), F.when(waits, None).when(agree, F.col("a")).otherwise(F.col("owner")).alias("final"))


def binary_score(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn; recall with its Wilson bounds."""
    n = rows.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    positives = F.col("tp") + F.col("fn")
    low, high = wilson(F.col("tp"), positives)
    return n.withColumns({"recall": ratio(F.col("tp"), positives), "recall_low": low, "recall_high": high})


def exclusion_precision(rows: DataFrame, decision: str, active: Column) -> DataFrame:
    """By decision: rows, active ones among them, and the share that is not active."""
    out = rows.groupBy(decision).agg(F.count("*").alias("n"), F.count_if(active).alias("n_active"))
    return out.withColumn("precision", ratio(F.col("n") - F.col("n_active"), F.col("n")))


def finalisation(rows: DataFrame, uncertain: str) -> DataFrame:
    """One row from a, b and owner: whether the owner decided all that the reviewers left open (they differ, or one is uncertain)
    and nothing else; and how often the two agree."""
    needs = (F.col("a") != F.col("b")) | (F.col("a") == uncertain) | (F.col("b") == uncertain)
    has = F.col("owner").isNotNull()
    one = rows.agg(F.count_if(needs & ~has).alias("missing"), F.count_if(~needs & has).alias("unneeded"), F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreed"))
    return one.withColumns({"complete": (F.col("missing") == 0) & (F.col("unneeded") == 0), "raw_agreement": ratio(F.col("agreed"), F.col("n"))})


def boundary_verdict(rows: DataFrame) -> DataFrame:
    """One row from human and told (same, different or uncertain; told may be missing): what was merged or split wrongly, and
    the verdict, safety before use."""
    human, told = F.col("human"), F.col("told")
    one = rows.agg(
        F.count("*").alias("n"),
        F.count("told").alias("valid"),
        F.count_if((human == "different") & (told == "same")).alias("over_merge"),
        F.count_if((human == "same") & (told == "different")).alias("over_split"),
        F.count_if(told == "uncertain").alias("uncertain"),
        F.count_if(human == "same").alias("n_same"),
        F.count_if((human == "same") & (told == "same")).alias("same_right"),
    )
    verdict = (
        F.when(F.col("valid") != F.col("n"), "REJECT_RELIABILITY")
        .when(F.col("over_merge") > 0, "REJECT_SAFETY")
        .when(F.col("same_right") < F.ceil(F.col("n_same") / 2), "REJECT_UTILITY")
        .otherwise("DEVELOPMENT_CANDIDATE")
    )
    return one.withColumn("verdict", verdict)


def study_bundle(rows: DataFrame, a: str, b: str, uncertain: str) -> DataFrame:
    """One row: agreement, Cohen's kappa and the share that goes to the owner, and whether the study is usable."""
    from .metrics import kappa

    k = kappa(rows, a, b)
    owner = rows.agg(F.count_if((F.col(a) != F.col(b)) | (F.col(a) == uncertain)).alias("open"))
    one = k.crossJoin(owner).select("n", F.col("observed").alias("agreement"), "kappa", ratio(F.col("open"), F.col("n")).alias("owner_rate"))  # one row each
    return one.withColumn("verdict", F.when(F.col("agreement") < 0.6, "unreliable").when(F.col("owner_rate") > 0.5, "costly").otherwise("usable"))


def evidence_issues(document: Column, texts: list[str], metrics: list[str]) -> Column:
    """Names of the fields of an evidence document (a variant) that are missing or of the wrong kind."""
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(document, path, "variant")), F.lit("VOID"))
    number = lambda path: kind(path).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)")
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(document, path, "string"))
    bad = {t: F.coalesce(F.trim(text(f"$.{t}")), F.lit("")) == "" for t in texts}
    bad["checkpoint_sha256"] = ~F.coalesce(text("$.checkpoint_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    bad["threshold"] = ~number("$.threshold")
    bad["frames_sampled"] = ~(kind("$.frames_sampled").isin("BIGINT", "INT") & (F.try_variant_get(document, "$.frames_sampled", "long") > 0))
    bad["gecko_visible"] = kind("$.gecko_visible") != "BOOLEAN"
    bad |= {f"motion_metrics.{m}": ~number(f"$.motion_metrics.{m}") for m in metrics}
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in bad.items()]))
