"""Queries on review forms: comparators, rules and lessons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparators, forms
from ..sources import reviews
from ..sources.reviews import SCALARS, SETS, SUBMISSIONS, submissions
from ..sources.tables import table
from .registry import query


def pairs(spark, sf_dir):
    rows = submissions(spark, sf_dir)
    a, b = (rows.filter(F.col("reviewer") == n).select("clip_id", F.struct("decision", "form").alias(f"s{n}")) for n in (1, 2))
    return a.join(b, "clip_id")


SET = "list_sort(list_distinct({0}.{1})) = list_sort(list_distinct({2}.{1}))"
SAME = {f: SET.format("a", f, "b") if f in comparators.SET_FIELDS else f"a.{f} IS NOT DISTINCT FROM b.{f}" for f in comparators.FIELDS} | {
    "segments": """(len(a.segments) = len(b.segments) AND list_aggregate(list_transform(list_zip(a.segments, b.segments), lambda z: CAST(z[1].action = z[2].action
      AND abs(floor(z[1].start_sec * 1000 + 0.5) - floor(z[2].start_sec * 1000 + 0.5)) <= 500 AND abs(floor(z[1].end_sec * 1000 + 0.5) - floor(z[2].end_sec * 1000 + 0.5)) <= 500 AS INTEGER)), 'min')
      IS DISTINCT FROM 0)"""
}
COMPARED = f"""{SUBMISSIONS}, cmp AS (SELECT a.clip_id, a.decision, a.highlight_recommendation AS highlight, CASE WHEN a.decision <> b.decision THEN ['decision'] WHEN a.decision <> 'label' THEN CAST([] AS VARCHAR[])
    ELSE list_filter([{", ".join(f"CASE WHEN NOT ({holds}) THEN '{f}' END" for f, holds in SAME.items())}], lambda x: x IS NOT NULL) END AS fields
  FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2)"""


def told(spark, sf_dir, soft):
    c = comparators.blind(F.col("s1.decision"), F.col("s2.decision"), F.col("s1.form"), F.col("s2.form"), soft)
    return pairs(spark, sf_dir).select("clip_id", c.alias("c")).select("clip_id", "c.status", "c.final_decision", "c.final_highlight", F.array_join("c.fields", ",").alias("fields"))


@query(f"""WITH {COMPARED} SELECT clip_id, CASE WHEN len(fields) = 0 THEN 'agreed' ELSE 'conflict' END AS status, CASE WHEN len(fields) = 0 THEN decision END AS final_decision,
  CASE WHEN len(fields) = 0 AND decision = 'label' THEN highlight END AS final_highlight, array_to_string(fields, ',') AS fields FROM cmp""")
def blind_comparator_full(spark, sf_dir):
    return told(spark, sf_dir, False)


@query(f"""WITH {COMPARED}, s AS (SELECT *, fields = ['highlight_recommendation'] AS soft FROM cmp)
SELECT clip_id, CASE WHEN len(fields) = 0 OR soft THEN 'agreed' ELSE 'conflict' END AS status, CASE WHEN len(fields) = 0 OR soft THEN decision END AS final_decision,
  CASE WHEN soft THEN 'uncertain' WHEN len(fields) = 0 AND decision = 'label' THEN highlight END AS final_highlight, array_to_string(fields, ',') AS fields FROM s""")
def blind_comparator_soft(spark, sf_dir):
    return told(spark, sf_dir, True)


GREEDY = f"""{SUBMISSIONS}, g AS (
  SELECT a.clip_id, a.segments AS free, b.segments AS wanted, 0 AS i, 0 AS hits FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2
  UNION ALL
  SELECT clip_id, CASE WHEN spot > 0 THEN free[:spot - 1] || free[spot + 1:] ELSE free END, wanted, i + 1, hits + CAST(spot > 0 AS INTEGER)
  FROM (SELECT *, coalesce(list_position(list_transform(free, lambda y: y.action = wanted[i + 1].action AND abs(y.start_sec - wanted[i + 1].start_sec) <= 1 AND abs(y.end_sec - wanted[i + 1].end_sec) <= 1), true), 0) AS spot
        FROM g WHERE i < len(wanted)))"""


@query(f"WITH RECURSIVE {GREEDY} SELECT clip_id, hits, len(wanted) - hits AS missed, len(free) AS left_over FROM g WHERE i = len(wanted)")
def segment_matches(spark, sf_dir):
    fits = lambda r, y: (r["action"] == y["action"]) & (F.abs(r["start_sec"] - y["start_sec"]) <= 1.0) & (F.abs(r["end_sec"] - y["end_sec"]) <= 1.0)
    hits = comparators.greedy_hits(F.col("s2.form.segments"), F.col("s1.form.segments"), comparators.SEGMENTS, fits)
    rows = pairs(spark, sf_dir).withColumn("hits", hits)
    return rows.select("clip_id", "hits", (F.size("s2.form.segments") - F.col("hits")).alias("missed"), (F.size("s1.form.segments") - F.col("hits")).alias("left_over"))


TUTORIAL = ["visibility", "primary_action", "target", "highlight_recommendation", "enrichment_object"]


@query(f"""WITH RECURSIVE {GREEDY}, m AS (SELECT clip_id, max(hits) = max(len(wanted)) AND min(len(free)) = 0 AS fits FROM g GROUP BY clip_id),
d AS (SELECT a.clip_id, [{", ".join(f"{{'key': '{f}', 'same': a.{f} = b.{f}}}" for f in TUTORIAL)},
    {", ".join(f"{{'key': '{f}', 'same': len(a.{f}) = len(b.{f}) AND len(list_filter(a.{f}, lambda x: NOT list_contains(b.{f}, x))) = 0}}" for f in ("observed_actions", "interaction_types"))},
    {{'key': 'segments', 'same': fits}}, {{'key': 'human_confidence', 'same': NULL}}, {{'key': 'context_tags', 'same': NULL}}] AS dims
  FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2 JOIN m ON m.clip_id = a.clip_id),
u AS (SELECT clip_id, unnest(dims) AS dim FROM d)
SELECT clip_id, dim.key AS key, CASE WHEN dim.same IS NULL THEN 'subjective' WHEN dim.same THEN 'matched' ELSE 'review' END AS "group" FROM u""")
def tutorial_comparison(spark, sf_dir):
    dims = comparators.tutorial(F.col("s1.form"), F.col("s2.form"), reviews.HIGHLIGHTS)
    return pairs(spark, sf_dir).select("clip_id", F.explode(dims).alias("d")).select("clip_id", "d.key", "d.group")


@query(f"""WITH {SUBMISSIONS} SELECT a.clip_id, CASE WHEN len(w) > 0 THEN len(list_intersect(w, b.observed_actions))::DOUBLE / len(w) END AS recall
FROM (SELECT *, list_distinct(list_filter(observed_actions, lambda x: x <> 'static')) AS w FROM sub WHERE reviewer = 1) a JOIN sub b ON a.clip_id = b.clip_id AND b.reviewer = 2""")
def overlap_recall(spark, sf_dir):
    return pairs(spark, sf_dir).select("clip_id", comparators.overlap_recall(F.col("s1.form.observed_actions"), F.col("s2.form.observed_actions"), "static").alias("recall"))


ABSENT = {
    "primary_action:absent_requires_unseen": "primary_action <> 'unseen'",
    "observed_actions:absent_no_observed": "len(observed_actions) > 0",
    "segments:absent_no_segments": "len(segments) > 0",
    "target:absent_target_none": "target <> 'none'",
    "highlight_recommendation:absent_highlight_exclude": "highlight_recommendation <> 'exclude'",
    "enrichment_object:absent_enrichment_none": "enrichment_object <> 'none'",
    "interaction_types:absent_no_interaction": "len(interaction_types) > 0",
}
INTERACTS = "len(list_filter(observed_actions, lambda a: a IN ('wheel_interaction', 'object_interaction'))) > 0"
OF = "len(list_filter(segments, lambda s: s.action = a))"
PRESENT = {
    "primary_action:unseen_requires_absent": "primary_action = 'unseen'",
    "observed_actions:observed_required": "len(observed_actions) = 0",
    "observed_actions:hand_feeding_action": "primary_action = 'hand_feeding' AND len(list_filter(observed_actions, lambda a: a IN ('licking', 'prey_capture'))) = 0",
    "segments:segment_missing": f"len(list_filter(observed_actions, lambda a: {OF} = 0)) > 0",
    "segments:segment_duplicate": f"len(list_filter(observed_actions, lambda a: {OF} > 1)) > 0",
    "segments:segment_orphan": "len(list_filter(segments, lambda s: NOT list_contains(observed_actions, s.action))) > 0",
    "segments:segment_range": "len(list_filter(segments, lambda s: NOT (s.start_sec >= 0 AND s.start_sec < s.end_sec AND s.end_sec <= duration_sec))) > 0",
    "target:drinking_target_invalid": "primary_action = 'drinking' AND target NOT IN ('water', 'water_bowl', 'glass', 'floor', 'uncertain')",
    "target:hand_feeding_target": "primary_action = 'hand_feeding' AND target NOT IN ('hand', 'tool')",
    "context_tags:hand_feeding_context": "primary_action = 'hand_feeding' AND NOT list_contains(context_tags, 'human')",
    "enrichment_object:enrichment_object_required": f"{INTERACTS} AND enrichment_object = 'none'",
    "interaction_types:interaction_type_required": f"{INTERACTS} AND len(interaction_types) = 0",
}
RULES = lambda rules: "[" + ", ".join(f"CASE WHEN {holds} THEN '{name}' END" for name, holds in rules.items()) + "]"


@query(f"""WITH {SUBMISSIONS} SELECT clip_id, reviewer, array_to_string(list_filter(CASE WHEN visibility = 'absent' THEN {RULES(ABSENT)} ELSE {RULES(PRESENT)} END, lambda x: x IS NOT NULL), ',') AS issues FROM sub""")
def form_issues(spark, sf_dir):
    return submissions(spark, sf_dir).select("clip_id", "reviewer", F.array_join(forms.issues(F.col("form"), F.col("duration_sec")), ",").alias("issues"))


@query(f"""WITH {SUBMISSIONS}, o AS (SELECT clip_id, reviewer, CASE WHEN clip_id % 11 = 0 THEN 'dancing' ELSE target END AS target, CASE WHEN clip_id % 13 = 0 THEN [NULL] ELSE context_tags END AS tags, o_comment_length
  FROM sub JOIN (SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 17 = 0 THEN 2001 ELSE 12 END AS o_comment_length FROM orders) USING (clip_id))
SELECT clip_id, reviewer, array_to_string(list_filter([CASE WHEN target = 'dancing' THEN 'target' END, CASE WHEN clip_id % 13 = 0 THEN 'context_tags' END, CASE WHEN o_comment_length > 2000 THEN 'note' END], lambda x: x IS NOT NULL), ',') AS fields FROM o""")
def malformed_forms(spark, sf_dir):
    """Forms with an unknown target, a tag that is missing or a note that is too long."""
    n = F.col("clip_id")
    form = F.col("form").withField("target", F.when(n % 11 == 0, "dancing").otherwise(F.col("form.target")))
    form = form.withField("context_tags", F.when(n % 13 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("form.context_tags")))
    note = F.repeat(F.lit("x"), F.when(n % 17 == 0, 2001).otherwise(12))
    return submissions(spark, sf_dir).select("clip_id", "reviewer", F.array_join(forms.malformed(form, note), ",").alias("fields"))


@query(f"""WITH {SUBMISSIONS}, l AS (SELECT *, clip_id % 7 AS position, CASE WHEN clip_id % 2 = 0 THEN 'shedding' END AS told, CASE WHEN clip_id % 3 = 0 THEN 'incorrect' ELSE 'correct' END AS verdict, context_tags AS tags FROM sub)
SELECT clip_id, reviewer, CASE WHEN position NOT BETWEEN 1 AND 5 THEN 'position'
  WHEN position = 1 AND NOT (visibility = 'absent' AND primary_action = 'unseen' AND len(observed_actions) = 0 AND len(segments) = 0 AND target = 'none') THEN 'lesson_1'
  WHEN position = 2 AND NOT (visibility IN ('visible', 'partial') AND primary_action = 'moving' AND list_contains(observed_actions, 'moving')) THEN 'lesson_2'
  WHEN position = 3 AND NOT (primary_action = 'drinking' AND target IN ('water', 'water_bowl', 'glass', 'floor', 'uncertain') AND list_contains(observed_actions, 'wheel_interaction') AND enrichment_object = 'wheel'
    AND len(interaction_types) >= 1 AND len(observed_actions) >= 2) THEN 'lesson_3'
  WHEN position = 4 AND NOT (primary_action = 'hand_feeding' AND (list_contains(observed_actions, 'licking') OR list_contains(observed_actions, 'prey_capture')) AND target IN ('hand', 'tool') AND list_contains(context_tags, 'human')) THEN 'lesson_4'
  WHEN position = 5 AND NOT (coalesce(told = 'shedding', false) AND primary_action <> 'shedding' AND verdict = 'incorrect' AND len(tags) >= 1) THEN 'lesson_5' END AS reason FROM l""")
def lesson_preflight(spark, sf_dir):
    n = F.col("clip_id")
    reason = forms.lesson_reason(n % 7, F.col("form"), F.when(n % 2 == 0, "shedding"), F.when(n % 3 == 0, "incorrect").otherwise("correct"), F.col("form.context_tags"))
    return submissions(spark, sf_dir).select("clip_id", "reviewer", reason.alias("reason"))


@query(f"""WITH {SUBMISSIONS}, m AS (SELECT CASE a.primary_action WHEN 'hiding' THEN 'moving' WHEN 'drinking' THEN 'feeding' WHEN 'eating_paste' THEN 'feeding' ELSE a.primary_action END AS truth,
    CASE b.primary_action WHEN 'drinking' THEN 'feeding' WHEN 'eating_paste' THEN 'feeding' ELSE b.primary_action END AS pred, a.primary_action = b.primary_action AS raw
  FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2)
SELECT truth, count(*) AS n, count(*) FILTER (WHERE raw) AS raw_right, count(*) FILTER (WHERE truth = pred) AS merged_right FROM m GROUP BY 1""")
def merged_label_accuracy(spark, sf_dir):
    """Accuracy with labels as they are and with those that count as one merged."""
    a, b = F.col("s1.form.primary_action"), F.col("s2.form.primary_action")
    rows = pairs(spark, sf_dir).select(forms.merged_label(a, forms.TRUTH_ALIASES).alias("truth"), forms.merged_label(b, forms.ALIASES).alias("pred"), (a == b).alias("raw"))
    return rows.groupBy("truth").agg(F.count("*").alias("n"), F.count_if("raw").alias("raw_right"), F.count_if(F.col("truth") == F.col("pred")).alias("merged_right"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'label' WHEN doc_id % 5 = 2 THEN 'skip' END AS decision, CASE WHEN doc_id % 2 = 0 THEN 'quarantine' ELSE 'label' END AS route, doc_id % 3 <> 0 AS row FROM documents),
s AS (SELECT doc_id, CASE WHEN NOT row THEN 'queue' WHEN decision = 'label' THEN 'labeled' WHEN decision = 'skip' THEN 'skipped' WHEN route = 'quarantine' THEN 'pending' ELSE 'queue' END AS state FROM t)
SELECT doc_id, state, state IN ('pending', 'skipped') AS hidden FROM s""")
def triage_states(spark, sf_dir):
    """The owner's decision beats the system's suggestion; without a row a clip is in the queue."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    triage = docs.filter(n % 3 != 0).select("doc_id", F.when(n % 5 == 1, "label").when(n % 5 == 2, "skip").alias("decision"), F.when(n % 2 == 0, "quarantine").otherwise("label").alias("route"), F.lit(True).alias("has"))
    state = F.when(F.col("has").isNull(), "queue").when(F.col("decision") == "label", "labeled").when(F.col("decision") == "skip", "skipped").when(F.col("route") == "quarantine", "pending").otherwise("queue")
    return docs.join(triage, "doc_id", "left").select("doc_id", state.alias("state")).withColumn("hidden", F.col("state").isin("pending", "skipped"))


#: A form as text: its fields in order of their names, lists joined, segments with whole milliseconds.
FORM_SQL = " || '|' || ".join(
    f"'{name}=' || " + (f"array_to_string({name}, ',')" if name in SETS else f"coalesce({name}, '')" if name in SCALARS else "array_to_string(list_transform(segments, lambda s: s.action || '@' || CAST(round(s.start_sec * 1000) AS BIGINT) || '-' || CAST(round(s.end_sec * 1000) AS BIGINT)), ',')")
    for name in sorted([*SCALARS, *SETS, "segments"])
)


@query(f"""WITH {SUBMISSIONS} SELECT clip_id, reviewer, md5(concat_ws('|', decision, {FORM_SQL}, 'note' || clip_id % 3)) AS digest FROM sub""")
def form_digests(spark, sf_dir):
    """Digest of a whole submission: decision, every field of the form, and the note."""
    ms = lambda c: F.round(c * 1000).cast("long").cast("string")

    def text(name):
        value = F.col(f"form.{name}")
        if name == "segments":
            value = F.array_join(F.transform(value, lambda s: F.concat(s["action"], F.lit("@"), ms(s["start_sec"]), F.lit("-"), ms(s["end_sec"]))), ",")
        elif name in SETS:
            value = F.array_join(value, ",")
        return F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("")))

    note = F.concat(F.lit("note"), (F.col("clip_id") % 3).cast("string"))
    form = F.concat_ws("|", *[text(name) for name in sorted([*SCALARS, *SETS, "segments"])])
    return submissions(spark, sf_dir).select("clip_id", "reviewer", F.md5(F.concat_ws("|", "decision", form, note)).alias("digest"))


@query(f"""WITH {SUBMISSIONS} SELECT clip_id, reviewer, md5(concat_ws('|', decision, coalesce(highlight_recommendation, ''), coalesce(target, ''), '')) AS digest,
  sha256(concat_ws('|', 'ip' || clip_id % 50, 'ua' || clip_id % 3, 'form')) AS fingerprint FROM sub""")
def submission_digests(spark, sf_dir):
    blank = lambda c: F.coalesce(c, F.lit(""))
    n = F.col("clip_id")
    return submissions(spark, sf_dir).select(
        "clip_id",
        "reviewer",
        F.md5(F.concat_ws("|", "decision", blank(F.col("form.highlight_recommendation")), blank(F.col("form.target")), F.lit(""))).alias("digest"),
        F.sha2(F.concat_ws("|", F.concat(F.lit("ip"), (n % 50).cast("string")), F.concat(F.lit("ua"), (n % 3).cast("string")), F.lit("form")), 256).alias("fingerprint"),
    )
