"""Review forms of clips, derived from order lines: two reviewers (lines 1 and 2) of each order fill in a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

# Names that fields of a form may have.
VISIBILITIES = ["visible", "partial", "absent", "uncertain"]
PRIMARY_ACTIONS = ["eating_paste", "drinking", "moving", "unknown", "eating_prey", "defecating", "shedding", "basking", "unseen", "hand_feeding"]
OBSERVED_ACTIONS = ["moving", "static", "licking", "prey_capture", "defecating", "shed_removal", "wheel_interaction", "object_interaction"]
TARGETS = ["water", "water_bowl", "food_bowl", "paste", "prey", "glass", "floor", "hand", "tool", "object", "none", "uncertain"]
CONFIDENCES = ["certain", "likely", "uncertain", "unjudgeable"]
CONTEXT_TAGS = ["ir", "glare", "occlusion", "distant", "blur", "overexposure", "edge", "human", "shadow", "camera_motion", "empty_scene"]
INTENSITIES = ["low", "medium", "high"]
HIGHLIGHTS = ["exclude", "uncertain", "include"]
ENRICHMENT_OBJECTS = ["wheel", "toy", "other", "none", "uncertain"]
INTERACTION_TYPES = ["ride", "push", "rotate", "chase", "repeated_return", "other"]

#: Scalar fields of a form: names, and what the order's number is divided by before it picks one; where the part's number
#: leaves the field's place as rest of nine, the next name is picked.
SCALARS = {
    "visibility": (VISIBILITIES, 3),
    "primary_action": (PRIMARY_ACTIONS, 4),
    "target": (TARGETS, 5),
    "human_confidence": (CONFIDENCES, 7),
    "activity_intensity": (INTENSITIES, 2),
    "highlight_recommendation": (HIGHLIGHTS, 9),
    "enrichment_object": (ENRICHMENT_OBJECTS, 6),
}
SETS = {"observed_actions": (OBSERVED_ACTIONS, 8), "context_tags": (CONTEXT_TAGS, 11), "interaction_types": (INTERACTION_TYPES, 10)}
DECISIONS = ["label", "label", "label", "hold", "exclude"]


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, reviewer (1 or 2), decision, duration_sec and form."""
    n, odd, line = F.col("l_orderkey"), F.col("l_partkey") % 9, F.col("l_linenumber")
    pick = lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), (at % len(names)).cast("int"))
    at = lambda by, place: F.floor(n / by) + (odd == place).cast("int")
    scalars = {name: pick(names, at(by, i)) for i, (name, (names, by)) in enumerate(SCALARS.items())}

    def some(names: list[str], by: int, place: int):
        """None, one or two of the names; the second reviewer gives them the other way round."""
        first, second = pick(names, at(by, place)), pick(names, at(by, place) + 3)
        two = F.when(line == 2, F.array(second, first)).otherwise(F.array(first, second))
        return F.when(n % by == 0, F.array().cast("array<string>")).when(n % by == 1, F.array(first)).otherwise(two)

    sets = {name: some(names, by, 7 + i % 2) for i, (name, (names, by)) in enumerate(SETS.items())}
    late = F.when(odd == 3, 0.7).when(line == 2, 0.3).otherwise(0.0)
    segments = F.transform(
        F.col("form.observed_actions"),
        lambda a, i: F.struct(a.alias("action"), (F.col("clip_id") % 7 + i + F.col("late")).alias("start_sec"), (F.col("clip_id") % 7 + i + 3 + F.col("late")).alias("end_sec")),
    )
    # Lines may share a number in an order; the first by part counts.
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").filter(line <= 2).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    plain = rows.select(
        n.alias("clip_id"),
        line.alias("reviewer"),
        pick(DECISIONS, at(3, 8)).alias("decision"),
        (F.col("l_quantity") / 4).alias("duration_sec"),
        late.cast("double").alias("late"),
        F.struct(*[c.alias(name) for name, c in (scalars | sets).items()]).alias("form"),
    )
    return plain.withColumn("form", F.struct("form.*", segments.alias("segments"))).drop("late")


def _sql_pick(names: list[str], at: str) -> str:
    return f"{names}[({at}) % {len(names)} + 1]"


def _sql_at(by: int, place: int) -> str:
    return f"l_orderkey // {by} + CAST(l_partkey % 9 = {place} AS INTEGER)"


def _sql_some(names: list[str], by: int, place: int) -> str:
    first, second = _sql_pick(names, _sql_at(by, place)), _sql_pick(names, _sql_at(by, place) + " + 3")
    return f"CASE WHEN l_orderkey % {by} = 0 THEN CAST([] AS VARCHAR[]) WHEN l_orderkey % {by} = 1 THEN [{first}] WHEN l_linenumber = 2 THEN [{second}, {first}] ELSE [{first}, {second}] END"


#: The same in SQL, with the fields of the form as columns.
SUBMISSIONS = f"""sub0 AS (SELECT l_orderkey AS clip_id, l_linenumber AS reviewer, {_sql_pick(DECISIONS, _sql_at(3, 8))} AS decision, l_quantity / 4 AS duration_sec,
    CASE WHEN l_partkey % 9 = 3 THEN 0.7::DOUBLE WHEN l_linenumber = 2 THEN 0.3 ELSE 0.0 END AS late,
    {", ".join(f"{_sql_pick(names, _sql_at(by, i))} AS {name}" for i, (name, (names, by)) in enumerate(SCALARS.items()))},
    {", ".join(f"{_sql_some(names, by, 7 + i % 2)} AS {name}" for i, (name, (names, by)) in enumerate(SETS.items()))}
  FROM lineitem WHERE l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
sub AS (SELECT *, list_transform(observed_actions, lambda a, i: {{'action': a, 'start_sec': clip_id % 7 + (i - 1) + late, 'end_sec': clip_id % 7 + (i - 1) + 3 + late}}) AS segments FROM sub0)"""
