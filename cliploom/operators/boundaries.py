"""Analysis of a double-blind study of event boundaries. All but the event count comes from one small table of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import event_summary

# Decisions in their order, gaps in seconds that are tried as a rule, and the share of clips a rule has to save.
DECISIONS = ("same_event", "different_event", "uncertain")
THRESHOLDS = (0, 5, 15, 30, 60, 120)
LEAST_REDUCTION = 0.15
SAME, DIFFERENT, UNCERTAIN = DECISIONS


def resolved(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, resolution, owner_side) with final and adopted: two equal decisions that are not uncertain stand, otherwise
    the owner's resolution does (null while it is missing). `adopted`: the owner, who was reviewer owner_side ('a' or 'b'),
    stays with what they said first; null where nothing was resolved."""
    agreed = F.coalesce((F.col("a") == F.col("b")) & (F.col("a") != UNCERTAIN), F.lit(False))
    first = F.when(F.col("owner_side") == "a", F.col("a")).when(F.col("owner_side") == "b", F.col("b"))
    adopted = F.when(~agreed & F.col("resolution").isNotNull(), F.coalesce(first == F.col("resolution"), F.lit(False)))
    return pairs.withColumns({"final": F.when(agreed, F.col("a")).otherwise(F.col("resolution")), "adopted": adopted})


def boundary_cells(settled: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """a, b, final, adopted, reached and n: pairs by their decisions and by the place of the first threshold that their
    gap_sec does not pass (as many as there are where it passes all, or is not known). A few hundred rows at any size."""
    reached = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        reached = F.when(F.col("gap_sec") <= thresholds[i], i).otherwise(reached)
    return settled.groupBy("a", "b", "final", "adopted", reached.alias("reached")).agg(F.count("*").alias("n"))


def confusion(cells: DataFrame) -> DataFrame:
    """a, b and n for each pair of decisions, also those that nobody took; other decisions are not counted."""
    every = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x in DECISIONS for y in DECISIONS])
    frame = cells.sparkSession.range(1).select(F.explode(every).alias("c")).select("c.*")  # nine rows
    return frame.join(cells.groupBy("a", "b").agg(F.sum("n").alias("n")), ["a", "b"], "left").fillna(0, ["n"])


def _total(holds: Column | None = None) -> Column:
    """Pairs of the cells in which something holds."""
    n = F.col("n") if holds is None else F.when(holds, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0))


def _sweep(thresholds: tuple[int, ...]) -> Column:
    """Array of (threshold_sec, overmerge, oversplit), over cells: pairs within a gap that are different, and beyond it the same."""
    at = lambda i, t: F.struct(
        F.lit(t).alias("threshold_sec"),
        _total((F.col("reached") <= i) & (F.col("final") == DIFFERENT)).alias("overmerge"),
        _total((F.col("reached") > i) & (F.col("final") == SAME)).alias("oversplit"),
    )
    return F.array(*[at(i, t) for i, t in enumerate(thresholds)])


def threshold_sweep(cells: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """threshold_sec, overmerge and oversplit of each gap as a rule."""
    return cells.agg(_sweep(thresholds).alias("sweep")).select(F.inline("sweep"))


def boundary_study(pairs: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """One row of a study from pairs (left_clip, right_clip, gap_sec, a, b, resolution, owner_side).

    n_pairs, n_resolved, n_open (undecided and without resolution); agreement (share of equal decisions) and Cohen's kappa;
    decisions of either reviewer and final ones by kind; the share of uncertain submissions, of pairs that went to the owner,
    and of those in which they kept their first view (null without any); clips, events and the share saved, from the pairs
    that are one event; the threshold without overmerge that splits least (the smallest of equal ones, null if none is
    safe); both verdicts. While pairs are open or a clip has more than two pairs there is no verdict. An empty study has
    null shares."""
    settled = resolved(pairs)
    cells = boundary_cells(settled, thresholds)
    kind = lambda d: d.split("_")[0]
    counts = {f"{side}_{kind(d)}": _total(F.col(side) == d) for side in ("a", "b", "final") for d in DECISIONS}
    one = cells.agg(
        _total().alias("n_pairs"),
        _total(F.col("adopted").isNotNull()).alias("n_resolved"),
        _total(F.col("final").isNull()).alias("n_open"),
        _total(F.col("a") == F.col("b")).alias("same"),
        _total(F.col("adopted")).alias("adopted"),
        _sweep(thresholds).alias("sweep"),
        *[c.alias(name) for name, c in counts.items()],
    )
    n = F.col("n_pairs").cast("double")
    share = lambda part, whole: F.when(whole > 0, part / whole)
    chance = sum((F.col(f"a_{kind(d)}") * F.col(f"b_{kind(d)}") for d in DECISIONS), F.lit(0)) / (n * n)
    seen = share(F.col("same"), n)
    kappa = F.when(chance == 1, F.when(seen == 1, 1.0)).otherwise((seen - chance) / (1 - chance))
    safe = F.transform(F.filter("sweep", lambda s: s["overmerge"] == 0), lambda s: F.struct(s["oversplit"].alias("oversplit"), s["threshold_sec"].alias("threshold_sec")))
    events = event_summary(settled.select("left_clip", "right_clip", F.coalesce(F.col("final") == SAME, F.lit(False)).alias("same")))
    told = one.crossJoin(F.broadcast(events.select("n_clips", "n_events", "reduction", "branching")))  # one row each
    whole = (F.col("n_open") == 0) & ~F.col("branching")
    sure = F.col("final_uncertain") == 0
    useful = sure & F.coalesce(F.col("reduction") >= LEAST_REDUCTION, F.lit(False)) & F.coalesce(F.col("selected_threshold_sec") > 0, F.lit(False))
    return told.withColumn("selected_threshold_sec", F.array_min(safe)["threshold_sec"]).select(
        "n_pairs",
        "n_resolved",
        "n_open",
        seen.alias("agreement"),
        F.when(n > 0, kappa).alias("kappa"),
        *counts,
        share(F.col("a_uncertain") + F.col("b_uncertain"), 2 * n).alias("uncertain_rate"),
        share(F.col("n_resolved"), n).alias("owner_rate"),
        share(F.col("adopted"), F.col("n_resolved")).alias("adoption_rate"),
        "n_clips",
        "n_events",
        F.coalesce(F.col("reduction"), F.when(~F.col("branching"), 0.0)).alias("reduction"),
        "selected_threshold_sec",
        F.when(whole, F.when(sure, "DEVELOPMENT_EVENT_GT_READY_FOR_LOCAL_VLM_BASELINE").otherwise("HOLD_UNRESOLVED_BOUNDARY")).alias("gt_verdict"),
        F.when(whole, F.when(useful, "PASS").otherwise("EVENT_GT_READY_ROUTER_UTILITY_HOLD")).alias("utility_verdict"),
    )
