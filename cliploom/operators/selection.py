"""Selections with quotas: shares of strata, cascades of groups, splits of nights, thinning of peaks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from .comparators import greedy_hits
from .sampling import hashed, ranks


def proportional_quota(sizes: DataFrame, stratum: str, total: int) -> DataFrame:
    """Quota of each stratum: the floor of its share, at least one; what is left goes to the largest remainders. `sizes`
    has a row a stratum."""
    whole = sizes.agg(F.sum("n").alias("whole"))
    share = F.col("n") * F.lit(total) / F.col("whole")
    base = sizes.crossJoin(F.broadcast(whole)).withColumns({"floor": F.greatest(F.lit(1), F.floor(share)), "rest": share - F.floor(share)})  # one row
    given = base.agg(F.sum("floor").alias("given"))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), stratum))
    out = base.crossJoin(F.broadcast(given)).withColumn("place", place)  # one row
    return out.select(stratum, "n", F.least(F.col("n"), F.col("floor") + F.when(F.col("place") <= F.lit(total) - F.col("given"), 1).otherwise(0)).alias("quota"))


def by_quota(rows: DataFrame, quotas: DataFrame, seed: str, key: str, stratum: str) -> DataFrame:
    """The first rows by digest of each stratum, as many as its quota. Each of 64 slices of a stratum is cut to its quota
    first, so no task sorts a stratum."""
    slices = Window.partitionBy(stratum, "slice_no").orderBy("draw", key)
    whole = Window.partitionBy(stratum).orderBy("draw", key)
    told = hashed(rows, seed, key).join(quotas.select(stratum, "quota"), stratum).withColumn("slice_no", F.pmod(F.xxhash64(key), F.lit(64)))
    cut = told.withColumn("nth", F.row_number().over(slices)).filter(F.col("nth") <= F.col("quota"))
    return cut.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= F.col("quota")).drop("quota", "draw", "slice_no")


def cascade(rows: DataFrame, groups: list[tuple[str, Column, int]], *order: str) -> DataFrame:
    """Groups in turn, each up to its quota, none taking a row that an earlier one took. A row that an earlier group could
    not take may go to a later one, so groups are picked one after the other."""
    taken = None
    for name, member, quota in groups:
        left = rows.filter(member)
        if taken is not None:
            left = left.join(taken.select(order[-1]), order[-1], "left_anti")
        now = left.orderBy(*order).limit(quota).withColumn("group", F.lit(name))
        taken = now if taken is None else taken.unionByName(now)
    return taken


def one_each_then_fill(rows: DataFrame, seed: str, key: str, strata: list[str], n: int) -> DataFrame:
    """The first row by digest of each stratum, then the first of all others, up to n rows (a row of each stratum in any case)."""
    drawn = hashed(rows, seed, key)
    rest = [c for c in rows.columns if c not in strata]
    first = drawn.groupBy(*strata).agg(F.min_by(F.struct(*rest), F.struct("draw", key)).alias("r")).select(*strata, "r.*")
    others = drawn.join(first.select(key), key, "left_anti")
    more = max(0, n - first.count())  # a row a stratum
    return first.select(*rows.columns).unionByName(others.orderBy("draw", key).limit(more).select(*rows.columns))


def night_split(rows: DataFrame, night: str, part: str, attempts: int, each: int, bins: str | None = None, least_bins: int = 0) -> DataFrame:
    """The first attempt at which `each` nights by digest, and as many after them, both see two parts at least (and, with
    `bins`, so many bins). Attempts are tried side by side, a row each."""
    seen = F.collect_set(bins) if bins else F.array().cast("array<string>")
    nights = rows.groupBy(night).agg(F.collect_set(part).alias("parts"), seen.alias("bins"))
    tried = nights.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("draw", digest("night", F.col("attempt"), F.col(night)))
    nth = F.row_number().over(Window.partitionBy("attempt").orderBy("draw", night))
    placed = tried.withColumn("side", F.when(nth <= each, "dev").when(nth <= 2 * each, "holdout")).filter("side IS NOT NULL")
    sides = placed.groupBy("attempt", "side").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("n_parts"), F.size(F.array_distinct(F.flatten(F.collect_list("bins")))).alias("n_bins"))
    good = sides.filter((F.col("n") == each) & (F.col("n_parts") >= 2) & (F.col("n_bins") >= least_bins)).groupBy("attempt").agg(F.count("*").alias("k")).filter("k = 2").agg(F.min("attempt").alias("attempt"))
    return placed.join(good, "attempt").select(night, "side", "attempt")


def _walked(items: Column, per_bin: int, per_bin_camera: int, per_camera: int) -> Column:
    """The items that a walk in their order keeps: at most per_bin of a bin, per_bin_camera of a bin and camera and per_camera
    of a camera, and no clip twice. Items: bin, draw, left_clip, right_clip, camera_id and others."""

    def step(kept: Column, x: Column) -> Column:
        count = lambda holds: F.size(F.filter(kept, holds))
        used = F.exists(kept, lambda k: (k["left_clip"] == x["left_clip"]) | (k["right_clip"] == x["right_clip"]) | (k["left_clip"] == x["right_clip"]) | (k["right_clip"] == x["left_clip"]))
        free = (
            ~used
            & (count(lambda k: k["bin"] == x["bin"]) < per_bin)
            & (count(lambda k: (k["bin"] == x["bin"]) & (k["camera_id"] == x["camera_id"])) < per_bin_camera)
            & (count(lambda k: k["camera_id"] == x["camera_id"]) < per_camera)
        )
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(items, F.filter(items, lambda p: F.lit(False)), step)


def _reach(bins: list[str], per_bin: int) -> int:
    """So many pairs of a bin and camera a walk can look at: pairs are of neighbours, so a clip is in two pairs at most, and the
    per_bin pairs that are kept of each bin block no more than two others each."""
    return per_bin * (2 * len(bins) + 1)


def capped_pairs(pairs: DataFrame, scope: list[str], bins: list[str], per_bin: int, per_bin_camera: int, per_camera: int) -> DataFrame:
    """Pairs that a walk in order of draw keeps in each scope, bin after bin. `pairs`: scope, gap_bin, camera_id, left_clip,
    right_clip, draw. What a pair may still take depends on all before it, so a scope's list (short without loss, see `_reach`)
    is folded with the pairs kept so far as state."""
    order = F.create_map(*[x for i, b in enumerate(bins) for x in (F.lit(b), F.lit(i))])[F.col("gap_bin")]
    nth = F.row_number().over(Window.partitionBy(*scope, "gap_bin", "camera_id").orderBy("draw", "left_clip"))
    item = F.struct(order.alias("bin"), "draw", "left_clip", "right_clip", "camera_id", "gap_bin")
    listed = pairs.filter(F.col("gap_bin").isin(bins)).withColumn("nth", nth).filter(F.col("nth") <= _reach(bins, per_bin)).groupBy(*scope).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select(*scope, F.explode(_walked(F.col("items"), per_bin, per_bin_camera, per_camera)).alias("p")).select(*scope, "p.gap_bin", "p.camera_id", "p.left_clip", "p.right_clip")


def best_witness(pairs: DataFrame, sides: DataFrame, night: str, bins: list[str], per_bin: int, per_bin_camera: int, per_camera: int) -> DataFrame:
    """The selection with the smallest digest among all attempts (`sides`: attempt and night) and all orders of the bins.

    Pairs that no walk can reach go first: of a night, bin and camera only the first few by draw stay, whatever the attempt.
    What is left meets the attempts, is cut again by attempt and becomes one short list each; all orders are walks over that
    list, sorted anew, so no pair is copied for an order."""
    reach = _reach(bins, per_bin)
    first = F.row_number().over(Window.partitionBy(night, "gap_bin", "camera_id").orderBy("draw", "left_clip"))
    near = pairs.filter(F.col("gap_bin").isin(bins)).withColumn("nth", first).filter(F.col("nth") <= reach)
    again = F.row_number().over(Window.partitionBy("attempt", "gap_bin", "camera_id").orderBy("draw", "left_clip"))
    tried = near.join(sides, night).withColumn("nth", again).filter(F.col("nth") <= reach)
    lists = tried.groupBy("attempt").agg(F.collect_list(F.struct("gap_bin", "draw", "left_clip", "right_clip", "camera_id")).alias("items"))
    orders = list(permutations(bins))

    def walk(order: Column) -> Column:
        placed = F.transform("items", lambda x: F.struct(F.array_position(order, x["gap_bin"]).cast("int").alias("bin"), x["draw"].alias("draw"), x["left_clip"].alias("left_clip"), x["right_clip"].alias("right_clip"), x["camera_id"].alias("camera_id"), x["gap_bin"].alias("gap_bin")))
        return _walked(F.array_sort(placed), per_bin, per_bin_camera, per_camera)

    told = F.array(*[F.struct(F.lit(i).alias("order_no"), walk(F.array(*[F.lit(b) for b in p])).alias("kept")) for i, p in enumerate(orders)])
    walks = lists.select("attempt", F.explode(told).alias("w")).select("attempt", "w.order_no", "w.kept").filter(F.size("kept") > 0)
    one = F.transform("kept", lambda p: F.concat_ws("-", p["left_clip"].cast("string"), p["right_clip"].cast("string")))
    best = walks.withColumn("digest", F.sha2(F.array_join(F.array_sort(one), "|"), 256)).orderBy("digest", "attempt", "order_no").limit(1)
    return best.select("attempt", "order_no", "digest", F.explode("kept").alias("p")).select("attempt", "order_no", "digest", "p.gap_bin", "p.camera_id", "p.left_clip", "p.right_clip")


def thinned(peaks: DataFrame, keys: list[str], at: str, value: str, apart: float, most: int) -> DataFrame:
    """Peaks of a key, highest first (the earliest of equal ones), that are `apart` or more from each one kept; at most
    `most`. A key's peaks are folded in order, with those kept so far as state."""
    listed = peaks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("down"), F.col(at).alias("at")))).alias("peaks"))

    def step(kept: Column, peak: Column) -> Column:
        free = (F.size(kept) < most) & F.forall(kept, lambda k: F.abs(k["at"] - peak["at"]) >= apart)
        return F.when(free, F.concat(kept, F.array(peak))).otherwise(kept)

    none = F.filter("peaks", lambda p: F.lit(False))
    return listed.select(*keys, F.explode(F.aggregate("peaks", none, step)).alias("p")).select(*keys, F.col("p.at").alias(at), (-F.col("p.down")).alias(value))


def matched(left: DataFrame, right: DataFrame, key: str, seconds: float) -> DataFrame:
    """Greedy matching of two lists of (action, at) of a key: each left item takes the first unused right one with its
    action that is no further than `seconds`."""
    shape = "array<struct<at:double,action:string>>"
    side = lambda df, name: df.groupBy(F.col(key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), "action"))).alias(name))
    empty = F.array().cast(shape)
    both = side(left, "mine").join(side(right, "free"), key, "full").withColumns({"mine": F.coalesce("mine", empty), "free": F.coalesce("free", empty)})
    fits = lambda m, f: (m["action"] == f["action"]) & (F.abs(m["at"] - f["at"]) <= seconds)
    out = both.withColumn("hits", greedy_hits(F.col("mine"), F.col("free"), shape, fits))
    return out.select(key, "hits", (F.size("mine") - F.col("hits")).alias("only_left"), (F.size("free") - F.col("hits")).alias("only_right"))


def water_filled(sizes: DataFrame, key: str, total: int, seed: str) -> DataFrame:
    """Quota of each key: one each, then one more in turn (keys in the order of their digest) as long as a key has more, until
    total is given out. Closed form: the level up to which all fill, and who of those above it gets one more. `sizes` has a
    row a key."""
    drawn = sizes.withColumn("draw", digest(seed, "quota", F.col(key)))
    levels = sizes.select(F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(total).cast("long")))).alias("level")).groupBy("level").agg(F.count("*").alias("takes"))
    upto = levels.withColumn("given", F.sum("takes").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))  # at most total rows
    full = upto.agg(F.coalesce(F.max(F.when(F.col("given") <= total, F.col("level"))), F.lit(0)).alias("full"), F.coalesce(F.max(F.when(F.col("given") <= total, F.col("given"))), F.lit(0)).alias("given"))
    nth = F.row_number().over(Window.partitionBy(F.col("n") > F.col("full")).orderBy("draw", key))
    out = drawn.crossJoin(F.broadcast(full)).withColumn("nth", nth)  # one row
    more = (F.col("n") > F.col("full")) & (F.col("nth") <= F.lit(total) - F.col("given"))
    return out.select(key, "n", (F.least(F.col("n"), F.col("full")) + F.when(more, 1).otherwise(0)).alias("quota"))


def hash_windows(rows: DataFrame, quotas: DataFrame, key: str, order: tuple[str, str], seed: str) -> DataFrame:
    """The rows of each key's window: as long as its quota, begun where its digest says; whether the window leaves rows out
    before and after it. Rows are ranked by slices of their order (a value and a key), so no task reads a whole key."""
    start = F.conv(F.substring(digest(seed, "window", F.col(key)), 1, 8), 16, 10).cast("long") % (F.col("n") - F.col("quota") + 1)
    told = ranks(rows, [key], *order).drop("n_group").withColumnRenamed("rank", "nth").join(quotas, key).withColumn("start", start)
    inside = (F.col("nth") >= F.col("start")) & (F.col("nth") < F.col("start") + F.col("quota"))
    return told.filter(inside).withColumns({"left_cut": F.col("start") > 0, "right_cut": F.col("start") + F.col("quota") < F.col("n")}).drop("start")


def cell_quota(rows: DataFrame, cells: list[str], target: int, kept: Column) -> DataFrame:
    """Quota of each cell: its share of target rounded half to even, at least one where `kept` holds and never more than it has;
    what is over or under is repaired by one a cell in turn, larger cells first. A row a cell."""
    sizes = rows.groupBy(*cells).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("whole"))
    share = F.bround(F.col("n") * F.lit(float(target)) / F.col("whole")).cast("long")
    base = sizes.crossJoin(F.broadcast(whole)).withColumn("q", F.least(F.col("n"), F.when(kept, F.greatest(share, F.lit(1))).otherwise(share)))  # one row
    one = base.agg((F.lit(target) - F.sum("q")).alias("off"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), *cells))  # a row a cell
    ranked = base.crossJoin(F.broadcast(one)).withColumn("place", place)
    # Turns in which a cell can give or take; the first |off| of all turns, in order of turn and place, are made.
    room = F.when(F.col("off") > 0, F.col("n") - F.col("q")).otherwise(F.col("q"))
    turns = ranked.withColumn("turn", F.explode(F.when((F.col("off") != 0) & (room > 0), F.sequence(F.lit(1).cast("long"), F.least(room, F.abs(F.col("off"))))).otherwise(F.array(F.lit(0).cast("long")))))
    made = F.row_number().over(Window.partitionBy(F.col("turn") > 0).orderBy("turn", "place"))
    moves = F.sum(F.when((F.col("turn") > 0) & (F.col("made") <= F.abs(F.col("off"))), F.signum("off").cast("long")).otherwise(0))
    return turns.withColumn("made", made).groupBy(*cells, "n", "q").agg(moves.alias("moved")).select(*cells, "n", (F.col("q") + F.col("moved")).alias("quota"))


def by_class_and_outcome(rows: DataFrame, wanted: list[tuple[str, bool, int]], key: str) -> DataFrame:
    """The first k rows by key of each class and outcome; what a class lacks of right rows is filled from its wrong ones, and
    the other way round."""
    asked = rows.sparkSession.createDataFrame(wanted, "class string, right boolean, k int")
    nth = F.row_number().over(Window.partitionBy("class", "right").orderBy(key))
    have = rows.groupBy("class", "right").agg(F.count("*").alias("have"))
    plan = asked.join(have, ["class", "right"], "left").withColumn("lacks", F.greatest(F.col("k") - F.coalesce("have", F.lit(0)), F.lit(0)))
    spare = plan.select("class", (~F.col("right")).alias("right"), F.col("lacks").alias("more"))
    limits = F.broadcast(plan.join(spare, ["class", "right"], "full").select("class", "right", (F.coalesce("k", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("most")))  # two rows a class
    most = max(k for _, _, k in wanted) * 2
    slices = Window.partitionBy("class", "right", "slice_no").orderBy(key)
    cut = rows.withColumn("slice_no", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("nth", F.row_number().over(slices)).filter(F.col("nth") <= most)
    return cut.withColumn("nth", nth).join(limits, ["class", "right"]).filter(F.col("nth") <= F.col("most")).select(key, "class", "right")


def thirds(rows: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The first n rows when the lowest, middle and highest third by value take turns (rows without a value are left out)."""
    told = ranks(rows.filter(F.col(value).isNotNull()).withColumn("all", F.lit(1)), ["all"], value, key)
    a, b = F.floor(F.col("n_group") / 3), F.floor(2 * F.col("n_group") / 3)
    third = F.when(F.col("rank") < a, 0).when(F.col("rank") < b, 1).otherwise(2)
    place = F.col("rank") - F.when(third == 0, 0).when(third == 1, a).otherwise(b)
    return told.withColumns({"third": third, "place": place}).orderBy("place", "third").limit(n).drop("all", "rank", "n_group")


def spread_runs(runs: DataFrame, key: str, run: str, seed: str) -> DataFrame:
    """runs with `place` (from 0), so that no two neighbours share a key, wherever that is possible.

    Runs are lined up key by key (the key with the most runs first, the others by digest) and dealt to every other place:
    rank r of n goes to 2r in the first half and to the gaps in the second. Neighbouring places then hold ranks that are half
    of n apart, or one less, and a key's ranks lie together, so only a key with more than half of all runs meets itself. Places
    come from counts: of a key's runs and of the keys before it, by digest prefix."""
    sizes = runs.groupBy(key).agg(F.count("*").alias("n_key")).withColumn("draw", digest(seed, "spread", F.col(key)))
    largest = sizes.agg(F.max(F.struct("n_key", "draw")).alias("top"), F.sum("n_key").alias("n_all"))
    keys = sizes.crossJoin(F.broadcast(largest))  # one row
    keys = keys.withColumn("prefix", F.when(F.col("draw") == F.col("top.draw"), "").otherwise(F.substring("draw", 1, 3)))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,097 prefixes
    starts = keys.groupBy("prefix").agg(F.sum("n_key").alias("c")).select("prefix", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("prefix").orderBy("draw", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("own", F.coalesce(F.sum("n_key").over(inside), F.lit(0))).join(F.broadcast(starts), "prefix")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(run)) - 1
    rank, half = F.col("start") + F.col("own") + F.col("nth"), F.floor((F.col("n_all") + 1) / 2)
    told = runs.withColumn("nth", nth).join(placed.select(key, "start", "own", "n_all"), key)
    return told.withColumn("place", F.when(rank < half, rank * 2).otherwise((rank - half) * 2 + 1)).drop("nth", "start", "own", "n_all")
