"""Comparisons of review forms, as columns over two forms of a clip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import changed, same_set

#: Fields in the order of the form; note is never compared.
FIELDS = (
    "visibility",
    "primary_action",
    "observed_actions",
    "segments",
    "target",
    "human_confidence",
    "context_tags",
    "activity_intensity",
    "highlight_recommendation",
    "enrichment_object",
    "interaction_types",
)
SET_FIELDS = ("observed_actions", "context_tags", "interaction_types")


def millis(seconds: Column) -> Column:
    """Whole milliseconds; half of one counts as a whole."""
    return F.floor(seconds * 1000 + 0.5)


def segments_equal(a: Column, b: Column, within_ms: int = 500) -> Column:
    """As many segments, and each has its counterpart's action and both bounds within so many milliseconds."""
    near = lambda x, y, end: F.abs(millis(x[end]) - millis(y[end])) <= within_ms
    pairs = F.zip_with(a, b, lambda x, y: (x["action"] == y["action"]) & near(x, y, "start_sec") & near(x, y, "end_sec"))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda p: F.coalesce(p, F.lit(False)))


def taken(free: Column, at: Column) -> Column:
    """An array without the element at a place from 1; all of it for place 0."""
    return F.when(at > 0, F.concat(F.slice(free, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(free, at + 1, F.size(free)))).otherwise(free)


def greedy_hits(reference: Column, mine: Column, mine_type: str, fits) -> Column:
    """How many of the reference's items, in order, find an unused item of mine: each takes the first that fits(item, mine)."""

    def step(state: Column, item: Column) -> Column:
        at = F.array_position(F.transform(state["free"], lambda y: fits(item, y)), F.lit(True)).cast("int")
        return F.struct(taken(state["free"], at).cast(mine_type).alias("free"), (state["hits"] + F.when(at > 0, 1).otherwise(0)).alias("hits"))

    return F.aggregate(reference, F.struct(mine.cast(mine_type).alias("free"), F.lit(0).alias("hits")), step, lambda state: state["hits"])


SEGMENTS = "array<struct<action:string,start_sec:double,end_sec:double>>"


def segments_match(mine: Column, reference: Column, seconds: float = 1.0) -> Column:
    """As many segments, and each of the reference's takes an unused one with its action and both bounds within `seconds`."""
    fits = lambda r, y: (r["action"] == y["action"]) & (F.abs(r["start_sec"] - y["start_sec"]) <= seconds) & (F.abs(r["end_sec"] - y["end_sec"]) <= seconds)
    return (F.size(mine) == F.size(reference)) & (greedy_hits(reference, mine, SEGMENTS, fits) == F.size(reference))


def differing(a: Column, b: Column) -> Column:
    """Names of the fields in which two forms differ, in the order of the form."""
    same = {f: segments_equal(a[f], b[f]) if f == "segments" else same_set(a[f], b[f]) if f in SET_FIELDS else a[f].eqNullSafe(b[f]) for f in FIELDS}
    return changed({f: (holds, F.lit(True)) for f, holds in same.items()})


def blind(a_decision: Column, b_decision: Column, a: Column, b: Column, soft_highlight: bool = False) -> Column:
    """status, final_decision, final_highlight and fields that differ, of two blind first submissions.

    Different decisions conflict; two holds or two exclusions agree whatever their reasons; two labels agree when no field
    differs. With `soft_highlight`, a highlight that alone differs agrees as uncertain, and is still listed."""
    fields = F.when(a_decision != b_decision, F.array(F.lit("decision"))).when(a_decision != "label", F.array().cast("array<string>")).otherwise(differing(a, b))
    soft = lambda d: d == F.array(F.lit("highlight_recommendation")) if soft_highlight else F.lit(False)
    agrees = lambda d: (F.size(d) == 0) | soft(d)
    told = lambda d: F.struct(
        F.when(agrees(d), "agreed").otherwise("conflict").alias("status"),
        F.when(agrees(d), a_decision).alias("final_decision"),
        F.when(soft(d), "uncertain").when((F.size(d) == 0) & (a_decision == "label"), a["highlight_recommendation"]).alias("final_highlight"),
        d.alias("fields"),
    )
    return F.transform(F.array(fields), told)[0]


def tutorial(mine: Column, reference: Column, highlights: list[str]) -> Column:
    """Array of (key, group) for a lesson's answer: matched, review or subjective. A highlight is compared only where the
    reference has one."""
    told = lambda key, same: F.struct(F.lit(key).alias("key"), F.when(same, "matched").otherwise("review").alias("group"))
    exact = lambda f: told(f, mine[f].eqNullSafe(reference[f]))
    sets = lambda f: told(f, (F.size(mine[f]) == F.size(reference[f])) & (F.size(F.array_except(mine[f], reference[f])) == 0))
    highlight = F.when(reference["highlight_recommendation"].isin(highlights), exact("highlight_recommendation"))
    subjective = lambda f: F.struct(F.lit(f).alias("key"), F.lit("subjective").alias("group"))
    return F.array_compact(
        F.array(
            exact("visibility"),
            exact("primary_action"),
            exact("target"),
            highlight,
            exact("enrichment_object"),
            sets("observed_actions"),
            sets("interaction_types"),
            told("segments", segments_match(mine["segments"], reference["segments"])),
            subjective("human_confidence"),
            subjective("context_tags"),
        )
    )


def overlap_recall(truth: Column, told: Column, but: str = "unknown") -> Column:
    """Share of the truth's members (without `but`) that are told; null where there are none."""
    wanted = F.array_except(truth, F.array(F.lit(but)))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, told)) / F.size(wanted))
