"""Scores of two reviewers who filled in the same forms without seeing each other's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import same_set
from .studies import most_matches

# Confidences that count as no answer, and decisions that agree without a form.
ABSTAINS = ("uncertain", "unjudgeable")
PLAIN = ("hold", "exclude")
DIMENSIONS = ("decision", "visibility", "primary_action", "observed_action_set", "target_context")


def _first(rows: DataFrame, reviewers: tuple[int, int], order: list[str]) -> DataFrame:
    """A row a clip: the first submission of either reviewer (a, b), and how many there are (n_a, n_b)."""
    said = []
    for name, who in zip(("a", "b"), reviewers, strict=True):
        mine = F.col("reviewer") == who
        said += [F.min_by(F.when(mine, F.struct("decision", "form")), F.when(mine, F.struct(*order))).alias(name), F.count_if(mine).alias(f"n_{name}")]
    return rows.filter(F.col("reviewer").isin(*reviewers)).groupBy("clip_id").agg(*said)


def _judged(clips: DataFrame) -> DataFrame:
    """For each clip: paired, who abstains, which dimensions can be compared and agree, and matched segments."""
    a, b = F.col("a"), F.col("b")
    yes = lambda c: F.coalesce(c, F.lit(False))
    abstains = lambda x: yes(x["form"]["human_confidence"].isin(*ABSTAINS))
    rows = clips.withColumns({"paired": (F.col("n_a") > 0) & (F.col("n_b") > 0), "abstains_a": abstains(a), "abstains_b": abstains(b)})
    open_ = F.col("paired") & ~F.col("abstains_a") & ~F.col("abstains_b") & a["decision"].isNotNull() & b["decision"].isNotNull()
    rows = rows.withColumns({"open": open_, "agree": open_ & yes(a["decision"] == b["decision"])})
    rows = rows.withColumns({"labelled": F.col("agree") & (a["decision"] == "label"), "fa": a["form"], "fb": b["form"]})
    fa, fb, labelled = F.col("fa"), F.col("fb"), F.col("labelled")
    sure = lambda f: labelled & ~yes(fa[f] == "uncertain") & ~yes(fb[f] == "uncertain")
    alike = lambda f: fa[f].eqNullSafe(fb[f])
    sets = lambda f: yes(same_set(fa[f], fb[f]))
    told = {
        "decision": (F.col("open"), F.col("agree")),
        "visibility": (sure("visibility"), alike("visibility")),
        "primary_action": (labelled, alike("primary_action")),
        "observed_action_set": (labelled, sets("observed_actions")),
        "target_context": (sure("target"), alike("target") & sets("context_tags")),
    }
    columns = {}
    for d, (can, same) in told.items():
        columns |= {f"{d}_can": can, f"{d}_same": can & same}
    rows = rows.withColumns(columns)
    none = F.array().cast("array<struct<action:string,start_sec:double,end_sec:double>>")
    listed = lambda f: F.when(labelled, F.coalesce(f["segments"], none)).otherwise(none)
    rows = rows.withColumns({"sa": listed(fa), "sb": listed(fb)}).withColumn("tp", most_matches("sa", "sb"))
    fits = (F.col("tp") == F.size("sa")) & (F.col("tp") == F.size("sb"))
    form = labelled & fits
    for d in DIMENSIONS[1:]:
        form = form & F.col(f"{d}_same")
    return rows.withColumn("automatic", form | (F.col("agree") & a["decision"].isin(*PLAIN)))


def paired_scores(rows: DataFrame, order: list[str], planned: int, reviewers: tuple[int, int] = (1, 2)) -> DataFrame:
    """One row from submissions (clip_id, reviewer, decision, form and the columns of `order`, by which a reviewer's first
    submission of a clip counts).

    How many submissions, clips, repeats and missing clips (of those planned or of those the other has) either reviewer
    has, and how many clips both have; for each dimension the clips that can be compared (both answered, and where a form
    is needed both label), those that agree and their share (null without any); segments matched one to one, with
    precision, recall and f1; who abstains how often; clips that agree in everything, and clips that go to the owner. A null
    decision is no answer: its clip goes to the owner. An empty table has zeros."""
    n = lambda c: F.count_if(c)
    parts: list[Column] = []
    for x, other in (("a", "b"), ("b", "a")):
        mine, theirs = F.col(f"n_{x}") > 0, F.col(f"n_{other}") > 0
        parts += [
            F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"submissions_{x}"),
            n(mine).alias(f"unique_{x}"),
            F.greatest(F.lit(planned) - n(mine), n(~mine & theirs), F.lit(0)).alias(f"missing_{x}"),
            n(F.col(f"abstains_{x}")).alias(f"abstains_{x}"),
        ]
    for d in DIMENSIONS:
        parts += [n(F.col(f"{d}_can")).alias(f"{d}_evaluable"), n(F.col(f"{d}_same")).alias(f"{d}_agreements")]
    size = lambda c: F.coalesce(F.sum(c), F.lit(0))
    parts += [
        n(F.col("paired")).alias("paired"),
        n(F.col("labelled")).alias("segments_evaluable"),
        size(F.col("tp").cast("long")).alias("tp"),
        size((F.size("sa") - F.col("tp")).cast("long")).alias("fp"),
        size((F.size("sb") - F.col("tp")).cast("long")).alias("fn"),
        n(F.col("automatic")).alias("automatic"),
        n(F.col("paired") & ~F.col("automatic")).alias("to_owner"),
    ]
    one = _judged(_first(rows, reviewers, order)).agg(*parts)
    any_ = F.col("segments_evaluable") > 0
    whole = lambda c: F.when(any_, F.when(F.col("tp") + F.col(c) > 0, F.col("tp") / (F.col("tp") + F.col(c))).otherwise(1.0))
    one = one.withColumns({"precision": whole("fp"), "recall": whole("fn")})
    both = F.col("precision") + F.col("recall")
    return one.withColumns(
        {f"repeats_{x}": F.col(f"submissions_{x}") - F.col(f"unique_{x}") for x in "ab"}
        | {f"{d}_rate": F.when(F.col(f"{d}_evaluable") > 0, F.col(f"{d}_agreements") / F.col(f"{d}_evaluable")) for d in DIMENSIONS}
        | {"f1": F.when(any_, F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))}
    )
