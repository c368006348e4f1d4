"""Statistics and verdicts of studies: intervals, cascades, matchings, gates, validations. All are formed from counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ratios import ratio
from .graph import shared_folder


def rate(part: Column, whole: Column) -> Column:
    return ratio(F.count_if(part), F.count_if(whole))


# The distribution function of a Poisson variable of mean 1, from 0 on.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def bootstrap(rows: DataFrame, key: str, resamples: int, seed: str) -> DataFrame:
    """n, and the 2.5 % and 97.5 % places of accuracy and macro F1 over resamples.

    Rows are dealt to 256 parts by a digest of their key and counted; a resample weighs each part by a Poisson variable of
    mean 1 that is drawn from a digest. So resamples multiply counts, never rows."""
    part = F.substring(F.md5(F.col(key).cast("string")), 1, 2)
    counts = rows.groupBy(part.alias("part"), "truth", "pred").agg(F.count("*").alias("n"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "resample", "part")), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = sum(((drawn >= p).cast("long") for p in POISSON), F.lit(0).cast("long"))
    weighed = counts.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", F.col("n") * weight)
    cells = weighed.groupBy("resample", "truth", "pred").agg(F.sum("w").alias("w")).filter("w > 0")
    sides = cells.select("resample", "w", F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("t")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("t")))).alias("s"), (F.col("truth") == F.col("pred")).alias("hit"))
    t = F.col("s.t")
    labels = sides.groupBy("resample", "s.label").agg(F.sum(F.when(t & F.col("hit"), F.col("w")).otherwise(0)).alias("tp"), F.sum(F.when(t, F.col("w")).otherwise(0)).alias("support"), F.sum("w").alias("both"))
    nano = F.round(ratio(2 * F.col("tp"), F.col("both")) * 1_000_000_000).cast("long")
    scores = labels.groupBy("resample").agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), (F.sum(nano) / F.count("*")).alias("macro_e9"))
    lists = scores.agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in ("accuracy", "macro_e9")])  # one value a resample
    at = lambda c, q: F.get(F.col(c), int(q * resamples))
    ends = lists.select(*[at(c, q).alias(f"{c}_{name}") for c in ("accuracy", "macro_e9") for name, q in (("low", 0.025), ("high", 0.975))])
    return counts.agg(F.sum("n").alias("n")).crossJoin(ends)  # one row each


def presence(rows: DataFrame, by: str, present: str, abstain: str) -> DataFrame:
    """By group: recall of what is present, share of abstentions, accuracy of what was not abstained from."""
    t, p = F.col("truth"), F.col("pred")
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), rate((t == present) & (p == present), t == present).alias("present_recall"), rate(p == abstain, F.lit(True)).alias("abstained"), rate((p != abstain) & (p == t), p != abstain).alias("told_accuracy")
    )


def paired(rows: DataFrame) -> DataFrame:
    """One row from truth, base and new: recovered, broken and harmless changes, and whether the new side is adopted (gain of
    more than three points, more recovered than broken)."""
    t, b, n = F.col("truth"), F.col("base"), F.col("new")
    one = rows.agg(
        F.count("*").alias("n"),
        F.count_if((b != t) & (n == t)).alias("recovered"),
        F.count_if((b == t) & (n != t)).alias("broken"),
        F.count_if((b != t) & (n != t) & (b != n)).alias("harmless"),
        F.count_if(b == t).alias("base_right"),
        F.count_if(n == t).alias("new_right"),
    )
    gain = ratio(F.col("new_right") - F.col("base_right"), F.col("n"))
    return one.withColumns({"gain": gain, "adopt": (gain > 0.03) & (F.col("recovered") > F.col("broken"))})


def cascade_score(rows: DataFrame, baseline_tokens: float, fallback_tokens: float) -> DataFrame:
    """One row from truth, route, auto_action and baseline_action: what a cascade of rule and model gives."""
    auto = F.col("route") == "auto_label"
    chosen = F.when(auto, F.col("auto_action")).otherwise(F.col("baseline_action"))
    hit = lambda c: F.coalesce(c == F.col("truth"), F.lit(False))
    one = rows.agg(F.count("*").alias("n"), F.count_if(auto).alias("n_auto"), F.count_if(auto & ~hit(F.col("auto_action"))).alias("n_false"), F.count_if(hit(chosen)).alias("n_right"), F.count_if(hit(F.col("baseline_action"))).alias("base_right"))
    n = F.col("n")
    fallback = ratio(n - F.col("n_auto"), n)
    return one.withColumns(
        {
            "fallback_rate": fallback,
            "accuracy": ratio(F.col("n_right"), n),
            "drop_points": ratio((F.col("base_right") - F.col("n_right")) * 100, n),
            "false_rate": ratio(F.col("n_false"), F.col("n_auto")),
            "token_reduction": F.when(n > 0, 1 - fallback * fallback_tokens / baseline_tokens).otherwise(0.0),
        }
    )


def escalated(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each rule: rows that go to the strong side, accuracy then, and the share of the gap between the sides that is
    won back. One pass: each row is counted under the rules that hold for it."""
    strong, base = F.col("strong") == F.col("truth"), F.col("base") == F.col("truth")
    cells = rows.groupBy(F.array(*[F.coalesce(r, F.lit(False)) for r in rules.values()]).alias("up")).agg(F.count("*").alias("c"), F.count_if(strong).alias("s"), F.count_if(base).alias("b"))
    named = cells.select("c", "s", "b", F.posexplode("up").alias("i", "goes")).groupBy("i").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("goes"), F.col("c")).otherwise(0)).alias("n_escalated"),
        F.sum(F.when(F.col("goes"), F.col("s")).otherwise(F.col("b"))).alias("n_right"),
        F.sum("s").alias("strong_right"),
        F.sum("b").alias("base_right"),
    )
    name = F.get(F.array(*[F.lit(k) for k in rules]), F.col("i"))
    gap = F.col("strong_right") - F.col("base_right")
    return named.select(name.alias("rule"), "n", "n_escalated", "n_right", ratio(F.col("n_right") - F.col("base_right"), gap).alias("recovered"))


def escalated_with_control(rows: DataFrame, rules: dict[str, Column], key: str, digits: int = 2) -> DataFrame:
    """escalated, and beside each rule its control: as many rows as the rule takes, the first by their key read backwards, which
    has nothing to do with what a rule looks at.

    One pass counts rows, hits and rule sizes by the first digits of the reversed key. A control takes the prefixes before the
    one in which its size is reached whole, from these counts; only rows of that one prefix are ranked, those that share a
    key by their hits, so that counts are the same in every run."""
    shared_folder(rows.sparkSession)
    back = F.reverse(F.col(key).cast("string"))
    strong, base = (F.coalesce(F.col(c) == F.col("truth"), F.lit(False)).cast("long") for c in ("strong", "base"))
    told = rows.select(back.alias("back"), F.substring(back, 1, digits).alias("prefix"), strong.alias("s"), base.alias("b"), *[F.coalesce(r, F.lit(False)).cast("long").alias(f"up_{i}") for i, r in enumerate(rules.values())])
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # a row a prefix
    counts = told.groupBy("prefix").agg(F.count("*").alias("c"), F.sum("s").alias("s"), F.sum("b").alias("b"), *[F.sum(f"up_{i}").alias(f"up_{i}") for i in range(len(rules))]).checkpoint()
    sums = counts.select("prefix", "c", "b", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("c", "s", "b")])
    sizes = counts.agg(F.sum("b").alias("all_b"), F.sum("s").alias("all_s"), *[F.sum(f"up_{i}").alias(f"up_{i}") for i in range(len(rules))])
    each = sizes.select("all_b", "all_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"up_{i}").alias("size")) for i in range(len(rules))])).alias("r")).select("all_b", "all_s", "r.i", "r.size")
    # The prefix in which each rule's size is reached: a row a rule.
    cut = sums.join(F.broadcast(each), (F.col("size") > F.col("c_before")) & (F.col("size") <= F.col("c_before") + F.col("c")))
    nth = F.row_number().over(Window.partitionBy("prefix").orderBy("back", "s", "b"))
    near = told.join(F.broadcast(cut.select("prefix").distinct()), "prefix", "left_semi").withColumn("nth", nth)
    more = near.select("prefix", "nth", "s", "b").join(F.broadcast(cut.select("i", "prefix", (F.col("size") - F.col("c_before")).alias("take"))), "prefix").filter("nth <= take").groupBy("i").agg(F.sum(F.col("s") - F.col("b")).alias("won"))
    control = each.join(cut.select("i", "s_before", "b_before"), "i", "left").join(more, "i", "left")
    right = F.col("all_b") + F.coalesce(F.col("s_before") - F.col("b_before"), F.lit(0)) + F.coalesce("won", F.lit(0))
    name = F.get(F.array(*[F.lit(k) for k in rules]), F.col("i"))
    told_control = control.select(name.alias("rule"), right.alias("control_right"), ratio(right - F.col("all_b"), F.col("all_s") - F.col("all_b")).alias("control_recovered"))
    return escalated(rows, rules).join(told_control, "rule")  # a row a rule


def fallback_cascade(rows: DataFrame, threshold: float, allowed: list[str]) -> DataFrame:
    """One row from truth and, of either call, pred, conf, tokens and wall_ms (whole numbers): the first call stands unless it is
    unsure or says what is not allowed; what falls back costs both calls, in tokens and in time."""
    back = (F.col("p_conf") < threshold) | ~F.col("p_pred").isin(allowed)
    chosen = F.when(back, F.col("f_pred")).otherwise(F.col("p_pred"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    tokens = F.coalesce("p_tokens", F.lit(0)) + F.when(back, F.coalesce("f_tokens", F.lit(0))).otherwise(0)
    one = rows.agg(F.count("*").alias("n"), F.count_if(back).alias("n_back"), F.count_if(chosen == F.col("truth")).alias("n_right"), F.sum(tokens).alias("tokens"), total(F.col("f_tokens")).alias("frame_tokens"), total(F.col("p_wall_ms") + F.when(back, F.col("f_wall_ms")).otherwise(0)).alias("wall"))
    return one.withColumns({"fallback_rate": ratio(F.col("n_back"), F.col("n")), "accuracy": ratio(F.col("n_right"), F.col("n")), "token_reduction": F.when(F.col("frame_tokens") > 0, 1 - F.col("tokens") / F.col("frame_tokens")), "avg_wall_ms": ratio(F.col("wall"), F.col("n"))}).drop("wall")


def all_votes(rows: DataFrame, key: str, priority: list[str]) -> DataFrame:
    """Weighted vote (largest sum of confidences) and priority vote (the same among priority labels, if any is told) of keys
    with two predictions or more; ties go to the first label."""
    sums = rows.groupBy(key, "pred").agg(F.count("*").alias("n"), F.sum(F.col("conf").cast("decimal(18,6)")).alias("w"))
    first = F.col("pred").isin(priority)
    order = F.struct((-F.col("w")).alias("down"), "pred")
    out = sums.groupBy(key).agg(
        F.sum("n").alias("n"), F.min_by("pred", order).alias("weighted"), F.coalesce(F.min_by(F.when(first, F.col("pred")), F.when(first, order)), F.min_by("pred", order)).alias("priority"), F.max("w").alias("best"), F.sum("w").alias("all")
    )
    return out.filter("n >= 2").select(key, "n", "weighted", "priority", ratio(F.col("best"), F.col("all")).alias("share"))


def error_group(truth: Column, pred: Column, source: Column, hard: Column) -> Column:
    """Group of a row by what went wrong; null for none."""
    cam = source == "cam-motion"
    return (
        F.when(hard, "F_hardneg_face")
        .when((truth == "drinking") & (pred == "drinking"), "A_drink_hit")
        .when((truth == "drinking") & (pred == "moving") & cam, "B_drink_miss_cam")
        .when((truth == "drinking") & (pred == "moving"), "C_drink_miss_other")
        .when((truth == "drinking") & (pred == "eating_paste"), "D_drink_to_paste")
        .when((truth == "moving") & (pred == "drinking"), "E_false_pos")
        .when((truth == "moving") & (pred == "moving") & cam, "G_moving_ctrl_cam")
    )


def reviewer_scores(rows: DataFrame, informative: list[str], care: str) -> DataFrame:
    """By group: rows, judged ones (not unsure), informative, care and absent ones, and the informative share in 1/10,000."""
    v = F.col("verdict")
    judged = v != "unsure"
    out = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if(judged).alias("judged"), F.count_if(judged & v.isin(informative)).alias("informative"), F.count_if(v == care).alias("care"), F.count_if(v == "absent").alias("absent"))
    return out.withColumn("informative_rate", F.round(ratio(F.col("informative"), F.col("judged")), 4))


def probe_gate(scores: DataFrame, group: str, other: str, adopt_gap: float, hold_gap: float, least: int, most: int) -> DataFrame:
    """adopt, reject or hold, from the shares of two groups; one row."""
    one = lambda g, p: scores.filter(F.col("group") == g).select(F.col("informative").alias(f"{p}_n"), F.col("informative_rate").alias(f"{p}_rate"))
    both = one(group, "a").crossJoin(one(other, "b"))  # one row each
    gap = F.col("a_rate") - F.col("b_rate")
    verdict = F.when((gap >= adopt_gap) & (F.col("a_n") >= least), "adopt").when((gap < hold_gap) | (F.col("a_n") <= most), "reject").otherwise("hold")
    return both.withColumn("verdict", verdict)


def strata(rows: DataFrame, column: str, declared: list[str], right: Column) -> DataFrame:
    """A row for every declared stratum, also for those without rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))
    opened = rows.sparkSession.createDataFrame([(d,) for d in declared], f"{column} string")
    out = F.broadcast(opened).join(counts, column, "left")  # one row a declared stratum
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(column, zero("n"), zero("n_right")).withColumn("accuracy", ratio(F.col("n_right"), F.col("n")))


def split_score(rows: DataFrame, outside: list[str]) -> DataFrame:
    """One row: accuracy inside the distribution, recall of the classes outside it (which are not in the former's
    denominator), and cost over all."""
    out_, hit = F.col("truth").isin(outside), F.col("pred") == F.col("truth")
    one = rows.agg(
        F.count("*").alias("n"), F.count_if(~out_).alias("n_inside"), F.count_if(~out_ & hit).alias("inside_right"), F.count_if(out_).alias("n_outside"), F.count_if(out_ & hit).alias("outside_right"), F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("cost")
    )
    return one.withColumns({"accuracy": ratio(F.col("inside_right"), F.col("n_inside")), "outside_recall": ratio(F.col("outside_right"), F.col("n_outside"))})


def panel(rows: DataFrame, subsets: dict[str, Column], models: list[str], same: dict[str, str]) -> DataFrame:
    """For each subset and model: rows, right ones, and right ones when labels that count as one are merged."""
    merged = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in same.items() for x in kv])[c], c)
    hits = [f(F.col(m)) == f(F.col("truth")) for m in models for f in (lambda c: c, merged)]
    cells = rows.groupBy(F.array(*[s.cast("int") for s in subsets.values()]).alias("in")).agg(F.count("*").alias("n"), *[F.count_if(h).alias(f"h{i}") for i, h in enumerate(hits)])
    parts = [
        F.struct(F.lit(name).alias("subset"), F.lit(m).alias("model"), F.get("in", i).alias("in"), F.col(f"h{2 * j}").alias("right"), F.col(f"h{2 * j + 1}").alias("merged_right"))
        for i, name in enumerate(subsets)
        for j, m in enumerate(models)
    ]
    return cells.select("n", F.explode(F.array(*parts)).alias("p")).filter("p.in = 1").groupBy("p.subset", "p.model").agg(F.sum("n").alias("n"), F.sum("p.right").alias("n_right"), F.sum("p.merged_right").alias("merged_right"))


@F.pandas_udf(T.IntegerType())
def most_matches(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the largest matching of two lists of segments (action, start_sec, end_sec): pairs of one action that overlap by
    half of their union or whose bounds both lie within two seconds. Augmenting paths inside one row's short lists."""

    def fits(a: dict, b: dict) -> bool:
        if a["action"] != b["action"]:
            return False
        union = max(a["end_sec"], b["end_sec"]) - min(a["start_sec"], b["start_sec"])
        shared = max(0.0, min(a["end_sec"], b["end_sec"]) - max(a["start_sec"], b["start_sec"]))
        same = a["start_sec"] == b["start_sec"] and a["end_sec"] == b["end_sec"]
        overlap = shared / union if union > 0 else float(same)
        return overlap >= 0.5 or (abs(a["start_sec"] - b["start_sec"]) <= 2 and abs(a["end_sec"] - b["end_sec"]) <= 2)

    def size(a: list, b: list) -> int:
        edges = [[j for j, y in enumerate(b) if fits(x, y)] for x in a]
        holder: dict[int, int] = {}
        total = 0
        for start in range(len(a)):
            # Breadth first from a free left item to a free right one; `came` tells the way back.
            came: dict[int, int] = {}
            queue = [start]
            end = None
            while queue and end is None:
                i = queue.pop(0)
                for j in edges[i]:
                    if j not in came:
                        came[j] = i
                        if j not in holder:
                            end = j
                            break
                        queue.append(holder[j])
            if end is not None:
                total += 1
                back = {i: j for j, i in holder.items()}
                while True:
                    i = came[end]
                    before = back.get(i)
                    holder[end] = i
                    if i == start:
                        break
                    end = before
        return total

    return pd.Series([size(list(a), list(b)) for a, b in zip(left, right, strict=True)], dtype="int32")


def coverage_verdict(cameras: DataFrame, least: float) -> DataFrame:
    """One row: HOLD with the contract's reasons, else GAP with the list of gaps, else PASS. cameras: camera_id, enabled,
    eligible, with_any, ready, complete."""
    gap = (
        F.when(~F.col("enabled"), None)
        .when(F.col("eligible") == 0, F.concat(F.lit("no_eligible_clips:"), F.col("camera_id").cast("string")))
        .when(F.col("with_any") == 0, F.concat(F.lit("zero_prelabel_coverage:"), F.col("camera_id").cast("string")))
        .when(ratio(F.col("ready"), F.col("eligible")) < least, F.concat(F.lit("policy_ready_below:"), F.col("camera_id").cast("string")))
    )
    one = cameras.agg(F.count_if("enabled").alias("n_enabled"), F.sum("ready").alias("ready"), F.sum("complete").alias("complete"), F.array_sort(F.collect_list(gap)).alias("gaps"))  # one row a camera
    short = (F.col("ready") > 0) & (F.col("complete") < F.col("ready"))
    gaps = F.when(F.col("n_enabled") == 0, F.array(F.lit("no_enabled_camera"))).otherwise(F.col("gaps"))
    return one.select(
        F.when(short, "HOLD").when(F.size(gaps) > 0, "GAP").otherwise("PASS").alias("verdict"),
        F.when(short, F.concat_ws("/", F.col("complete").cast("string"), F.col("ready").cast("string"))).alias("incomplete"),
        F.array_join(gaps, ",").alias("gaps"),
    )


def first_failing(one: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """A one-row table with each gate's result and the first that fails."""
    out = None
    for name, holds in gates.items():
        out = F.when(~holds, F.lit(name)) if out is None else out.when(~holds, F.lit(name))
    return one.withColumns({f"ok_{name}": holds for name, holds in gates.items()}).withColumn("verdict", out.otherwise("pass"))


def result_errors(results: DataFrame, expected: DataFrame, classes: list[str]) -> DataFrame:
    """code and sample of every fault of a result set: schema, class, range, duplicate, mismatch, missing."""
    conf = F.col("confidence")
    faults = F.array_compact(
        F.array(
            F.when(F.col("action").isNull() | conf.isNull(), F.lit("schema")),
            F.when(F.col("action").isNotNull() & ~F.col("action").isin(classes), F.lit("class")),
            F.when(conf.isNotNull() & (F.isnan(conf) | ~conf.between(0, 1)), F.lit("range")),
        )
    )
    own = results.select("sample", F.explode(faults).alias("code")).distinct()
    seen = results.groupBy("sample").agg(F.count("*").alias("n"))
    both = seen.join(expected.select("sample").distinct().withColumn("wanted", F.lit(True)), "sample", "full")
    keyed = both.select("sample", F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("duplicate")), F.when(F.col("wanted").isNull(), F.lit("mismatch")), F.when(F.col("n").isNull(), F.lit("missing"))))).alias("code"))
    return own.unionByName(keyed).select("code", "sample")


def top_values(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n commonest values of each column; of equally common ones the first by name."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth")
