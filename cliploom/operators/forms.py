"""Rules for review forms: structure, meaning, lessons and merged labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import reviews as R

# Order of the fields in the form, and targets that go with an action.
FORM_ORDER = ["visibility", "primary_action", "observed_actions", "segments", "target", "human_confidence", "highlight_recommendation", "context_tags", "enrichment_object", "interaction_types"]
DRINKING_TARGETS = ["water", "water_bowl", "glass", "floor", "uncertain"]
FEEDING_TARGETS = ["hand", "tool"]


def issues(form: Column, seconds: Column) -> Column:
    """Array of "field:code" of the rules that a form breaks, in the order of the form. A form without the animal is held to
    its own rules and to no others."""
    seen, primary, target, segments = form["observed_actions"], form["primary_action"], form["target"], form["segments"]
    count = lambda a: F.size(F.filter(segments, lambda s: s["action"] == a))
    inside = lambda s: (s["start_sec"] >= 0) & (s["start_sec"] < s["end_sec"]) & (s["end_sec"] <= seconds)
    interacts = F.exists(seen, lambda a: a.isin("wheel_interaction", "object_interaction"))
    drinking, feeding = primary == "drinking", primary == "hand_feeding"
    absent = {
        "primary_action:absent_requires_unseen": primary != "unseen",
        "observed_actions:absent_no_observed": F.size(seen) > 0,
        "segments:absent_no_segments": F.size(segments) > 0,
        "target:absent_target_none": target != "none",
        "highlight_recommendation:absent_highlight_exclude": form["highlight_recommendation"] != "exclude",
        "enrichment_object:absent_enrichment_none": form["enrichment_object"] != "none",
        "interaction_types:absent_no_interaction": F.size(form["interaction_types"]) > 0,
    }
    present = {
        "primary_action:unseen_requires_absent": primary == "unseen",
        "observed_actions:observed_required": F.size(seen) == 0,
        "observed_actions:hand_feeding_action": feeding & ~F.exists(seen, lambda a: a.isin("licking", "prey_capture")),
        "segments:segment_missing": F.exists(seen, lambda a: count(a) == 0),
        "segments:segment_duplicate": F.exists(seen, lambda a: count(a) > 1),
        "segments:segment_orphan": F.exists(segments, lambda s: ~F.array_contains(seen, s["action"])),
        "segments:segment_range": F.exists(segments, lambda s: ~inside(s)),
        "target:drinking_target_invalid": drinking & ~target.isin(DRINKING_TARGETS),
        "target:hand_feeding_target": feeding & ~target.isin(FEEDING_TARGETS),
        "context_tags:hand_feeding_context": feeding & ~F.array_contains(form["context_tags"], "human"),
        "enrichment_object:enrichment_object_required": interacts & (form["enrichment_object"] == "none"),
        "interaction_types:interaction_type_required": interacts & (F.size(form["interaction_types"]) == 0),
    }
    told = lambda rules: F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()]))
    playing = told({"primary_action:playing_not_primary": primary == "playing"})
    return F.concat(playing, F.when(form["visibility"] == "absent", told(absent)).otherwise(told(present)))


def malformed(form: Column, note: Column) -> Column:
    """Names of the fields that are not what a form may hold: a name off the list, a bound that is no number, a long note."""
    one = {f: ~F.coalesce(form[f].isin(names), F.lit(False)) for f, (names, _) in R.SCALARS.items()}
    one["activity_intensity"] = form["activity_intensity"].isNotNull() & one["activity_intensity"]
    one["primary_action"] = one["primary_action"] & ~F.coalesce(form["primary_action"] == "playing", F.lit(False))
    among = lambda names: lambda x: x.isin(names)
    many = {f: ~F.coalesce(F.forall(form[f], among(names)), F.lit(False)) for f, (names, _) in R.SETS.items()}
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = lambda s: s["action"].isin(R.OBSERVED_ACTIONS) & number(s["start_sec"]) & number(s["end_sec"])
    rest = {"segments": ~F.coalesce(F.forall(form["segments"], good), F.lit(False)), "note": F.coalesce(F.length(note) > 2000, F.lit(False))}
    return F.array_compact(F.array(*[F.when(bad, F.lit(f)) for f, bad in (one | many | rest).items()]))


def lesson_reason(position: Column, form: Column, told_action: Column, verdict: Column, error_tags: Column) -> Column:
    """Why a reference answer does not suit its lesson (1 to 5); null where it does."""
    seen, primary, target = form["observed_actions"], form["primary_action"], form["target"]
    has = lambda a: F.array_contains(seen, a)
    suits = {
        1: (form["visibility"] == "absent") & (primary == "unseen") & (F.size(seen) == 0) & (F.size(form["segments"]) == 0) & (target == "none"),
        2: form["visibility"].isin("visible", "partial") & (primary == "moving") & has("moving") & F.exists(form["segments"], lambda s: s["action"] == "moving"),
        3: (primary == "drinking") & target.isin(DRINKING_TARGETS) & has("wheel_interaction") & (form["enrichment_object"] == "wheel") & (F.size(form["interaction_types"]) >= 1) & (F.size(seen) >= 2),
        4: (primary == "hand_feeding") & (has("licking") | has("prey_capture")) & target.isin(FEEDING_TARGETS) & F.array_contains(form["context_tags"], "human"),
        5: F.coalesce(told_action == "shedding", F.lit(False)) & (primary != "shedding") & (verdict == "incorrect") & (F.size(error_tags) >= 1),
    }
    out = F.when(position.isNull() | ~position.between(1, 5), "position")
    for at, good in suits.items():
        out = out.when((position == at) & ~good, f"lesson_{at}")
    return out


#: Labels that count as another one. The first holds for the truth only.
TRUTH_ALIASES = {"hiding": "moving", "drinking": "feeding", "eating_paste": "feeding"}
ALIASES = {"drinking": "feeding", "eating_paste": "feeding"}


def merged_label(label: Column, aliases: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[label], label)
