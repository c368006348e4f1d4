"""Repair of conversation structure by a rank-compressed dynamic programme.

A conversation's rows are one layer each of a programme over four states (nothing yet, system turn last, user turn last,
assistant turn last). A step is a macro edit: a run of inserted turns and then what happens to the row (delete, keep,
rerole). Macro edits are written in a prefix-free code (`CODES`: no code begins another), so audits of as many layers
compare like their sequences of codes. Therefore a state keeps no audit string, only its cost and the rank of its audit
among all states of the layer, and a pointer to the state before; ranks are renewed from (rank before, code) layer by
layer. Audits are spelt afterwards along the pointers.

Layers compose, so no conversation is held whole. Rows are range-partitioned in order and numbered; blocks of 2,048
numbers are folded, each to the cheapest (cost, rank) between any two states; blocks of a conversation that has more
than one are folded by 2,048 again until one is left; its end state is chosen and handed down the same tree, and each
block spells its own edits. What needs a whole conversation is its audit and one hash: rows stream through in order.

Nulls in role, text and in the numbers that name a row are one space; a null conv_id is a conversation of its own, null
turns come first. Rows of the same turn are ordered by role, then text (beyond `PREFIX` code points by a hash). Repeated
rows are damaged alike and are duplicates. Roles count by their first character; an empty role fits nowhere. Very long
texts move through shuffles but stay out of the programme. An empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_width, written

PREFIX = 128
#: log2 of the rows of a block, and of the blocks folded at a time.
SHIFT = 11
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of this role ('s', 'u', 'a') in a state, where the order system, (user, assistant)+ allows it.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only role that a turn of ours can have in a state.
NEEDED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Two turns lead from any state to where they are needed; a third would only come back to a state that is reached.
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
LEGAL = {"su", "ua", "au"}
FINE, CUT, GONE = range(3)
INITIALS = "sua?"


def _macros(initial: str, fault: int, before: int) -> dict[int, tuple[int, int]]:
    """Cheapest (cost, code) to each state from one state over a row, codes by their place in CODES."""
    found: dict[int, tuple[int, int]] = {}

    def offer(state: int | None, cost: int, code: str) -> None:
        if state is not None:
            found[state] = min(found.get(state, (cost, len(CODES))), (cost, CODES.index(code)))

    state, paid = before, 0
    for n in range(3):
        offer(state, paid + DELETE, "I" * n + "D")
        if fault != GONE:
            extra = TRUNCATED * (fault == CUT)
            offer(AFTER.get((state, initial)), paid + extra, "I" * n + "K")
            offer(AFTER[state, NEEDED[state][0]], paid + extra + REROLE, "I" * n + "R")
        state, paid = AFTER[state, NEEDED[state][0]], paid + INSERT
    return found


#: By kind of row (fault * 4 + place of the initial) and state before: state after -> (cost, code).
MACROS = [[_macros(INITIALS[i], fault, p) for p in range(4)] for fault in (FINE, CUT, GONE) for i in range(4)]
#: Inserted turns that end a conversation from each state.
TAIL = [0, 2, 1, 0]

Layer = tuple[tuple[int | None, ...], tuple[int, ...]]


def _layer(kind: int) -> Layer:
    """A row as a layer: cost and code from each state to each state, flat; no cost where there is no way."""
    ways = [MACROS[kind][p].get(q) for p in range(4) for q in range(4)]
    return tuple(w and w[0] for w in ways), tuple(w[1] if w else 0 for w in ways)


ROWS = [_layer(kind) for kind in range(12)]


def compose(first: Layer, second: Layer) -> tuple[Layer, tuple[int, ...]]:
    """The layer of both, one after the other, and the state between them on each way.

    Ranks order the audits of all ways of a layer; equal ranks are equal audits. Layers hold their ways from any number of
    start states, four ways each."""
    best: list[tuple[int, int, int, int] | None] = []
    for at in range(0, len(first[0]), 4):
        for r in range(4):
            ways = [(first[0][at + q] + second[0][4 * q + r], first[1][at + q], second[1][4 * q + r], q) for q in range(4) if first[0][at + q] is not None and second[0][4 * q + r] is not None]
            best.append(min(ways, default=None))
    ranks = {pair: i for i, pair in enumerate(sorted({w[1:3] for w in best if w}))}
    return (tuple(w and w[0] for w in best), tuple(ranks[w[1:3]] if w else 0 for w in best)), tuple(w[3] if w else 0 for w in best)


@lru_cache(maxsize=1 << 15)
def _row_after(costs: tuple[int | None, ...], ranks: tuple[int, ...], kind: int) -> tuple[Layer, tuple[int, ...]]:
    return compose((costs, ranks), ROWS[kind])


def _begun(whole: bool) -> Layer:
    """The layer of no rows: from the start only, or from each state to itself."""
    states = range(4) if whole else (START,)
    return tuple(0 if p == q else None for p in states for q in range(4)), tuple(0 for _ in states for _ in range(4))


def fold_rows(kinds: list[int], whole: bool) -> tuple[Layer, list[tuple[int, ...]]]:
    """Layer of rows and, for each row, the states before it. Costs are kept relative, so few layers differ."""
    (costs, ranks), paid, befores = _begun(whole), 0, []
    for kind in kinds:
        (costs, ranks), before = _row_after(costs, ranks, kind)
        befores.append(before)
        least = min(c for c in costs if c is not None)
        costs, paid = tuple(c if c is None else c - least for c in costs), paid + least
    return (tuple(c if c is None else c + paid for c in costs), ranks), befores


def fold_layers(layers: list[Layer]) -> tuple[Layer, list[tuple[int, ...]]]:
    """As fold_rows, of layers; the first decides from which states ways are known."""
    now, befores = layers[0], [tuple(p for p in range(len(layers[0][0]) // 4) for _ in range(4))]
    for layer in layers[1:]:
        now, before = compose(now, layer)
        befores.append(before)
    return now, befores


def states_along(befores: list[tuple[int, ...]], start: int, end: int) -> list[tuple[int, int]]:
    """State before and after each part on the best way from start to end."""
    out = []
    for before in reversed(befores):
        state = before[4 * start + end]
        out.append((state, end))
        end = state
    return out[::-1]


def ending(layer: Layer) -> tuple[int, int]:
    """Least cost from the start, and its end state: the audit's rank decides between equal costs, then fewer inserts."""
    ways = [(layer[0][q] + INSERT * TAIL[q], layer[1][q], TAIL[q], q) for q in range(4) if layer[0][q] is not None]
    cost, _, _, state = min(ways)
    return cost, state


def spelt(kinds: list[int], start: int, end: int, final: bool) -> list[tuple[str, list[str], str | None, list[str]]]:
    """For each row its code, the roles inserted before it, its role (None: as it is or deleted) and those after it."""
    out = []
    for kind, (p, q) in zip(kinds, states_along(fold_rows(kinds, True)[1], start, end), strict=True):
        code = CODES[MACROS[kind][p][q][1]]
        roles = []
        for _ in code[:-1]:
            roles.append(NEEDED[p])
            p = AFTER[p, NEEDED[p][0]]
        out.append((code, roles, NEEDED[p] if code[-1] == "R" else None, []))
    if final and out:
        for _ in range(TAIL[end]):
            out[-1][3].append(NEEDED[end])
            end = AFTER[end, NEEDED[end][0]]
    return out


# ---- Spark ----------------------------------------------------------------------------------------------------------

NODE = "conv_id {0}, node long, costs array<int>, ranks array<int>, first int, last int, illegal long"


def _flat(layer: Layer) -> tuple[list[int | None], list[int]]:
    return list(layer[0]), list(layer[1])


def _illegal(first: int, second: int) -> int:
    return int(INITIALS[first] + INITIALS[second] not in LEGAL)


def _runs(table: pa.Table) -> Iterator[tuple[object, list[dict]]]:
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    for conv_id, run in groupby(rows, key=lambda r: r["conv_id"]):
        yield conv_id, list(run)


def _told(rows: list[dict], like: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=like)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated damage: by crc32('conv_id:turn') % 20, 0 drops a row, 1 empties its text,
    2 takes out [.!?], 3 repeats it, 4 makes its role user. Nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), draw.alias("draw"))
        .filter("draw <> 0")
        .withColumn("text", F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `at`, gapless in the order of conversation, turn, role and text; written, so that numbers stay.

    Narrow keys are sampled for the ranges; equal rows are told apart by a number, so they can lie in several ranges."""
    keyed = rows.withColumns({
        "k_role": F.substring("role", 1, PREFIX), "k_text": F.substring("text", 1, PREFIX),
        "k_hash": F.xxhash64("role", "text"), "k_nth": F.monotonically_increasing_id(),
    })
    order = ["conv_id", "turn", "k_role", "k_text", "k_hash", "k_nth"]
    placed = keyed.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place")))
    part = F.shiftright("place", 33)
    # One row a partition of the ranges.
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(at.alias("at"), "conv_id", "turn", "role", "text")


def faulted(rows: DataFrame) -> DataFrame:
    """Numbered rows as at, conv_id, turn, kind and fault (blank, duplicate, truncated or null).

    The first of equal rows is found by a minimum that is pre-aggregated; it comes back by its number, so no text of a
    conversation gathers its copies in a task."""
    same = rows.groupBy("conv_id", F.xxhash64("role", "text"), F.sha2(F.concat_ws(":", "role", "text"), 256)).agg(F.min("at").alias("at"))
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    lean = rows.select("at", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), ends.alias("ends"))
    fault = F.when(F.col("ends") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ends").isin(".", "!", "?"), "truncated")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    weight = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(FINE)
    return lean.join(same.select("at", F.lit(True).alias("is_first")), "at", "left").withColumn("fault", fault).select("at", "conv_id", "turn", (weight * 4 + initial).cast("int").alias("kind"), "fault")


def _block(column: str) -> Column:
    return F.shiftright(F.col(column), SHIFT)


def _nodes(facts: DataFrame, ddl: str) -> DataFrame:
    """A node for each block and conversation in it."""
    like = _arrow(ddl)

    def folded(table: pa.Table) -> pa.Table:
        out = []
        for i, (conv_id, run) in enumerate(_runs(table)):
            kinds = [r["kind"] for r in run]
            costs, ranks = _flat(fold_rows(kinds, i == 0)[0])
            wrong = sum(_illegal(a % 4, b % 4) for a, b in zip(kinds, kinds[1:], strict=False))
            out.append({"conv_id": conv_id, "node": run[0]["at"] >> SHIFT, "costs": costs, "ranks": ranks, "first": kinds[0] % 4, "last": kinds[-1] % 4, "illegal": wrong})
        return _told(out, like)

    return facts.select("at", "conv_id", "kind").groupBy(_block("at")).applyInArrow(folded, ddl)


def _layers(rows: list[dict]) -> list[Layer]:
    return [(tuple(r["costs"]), tuple(r["ranks"])) for r in rows]


def _parents(children: DataFrame, ddl: str) -> DataFrame:
    like = _arrow(ddl)

    def folded(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        costs, ranks = _flat(fold_layers(_layers(rows))[0])
        wrong = sum(r["illegal"] for r in rows) + sum(_illegal(a["last"], b["first"]) for a, b in zip(rows, rows[1:], strict=False))
        return _told([{"conv_id": rows[0]["conv_id"], "node": rows[0]["node"] >> SHIFT, "costs": costs, "ranks": ranks, "first": rows[0]["first"], "last": rows[-1]["last"], "illegal": wrong}], like)

    return children.groupBy("conv_id", _block("node")).applyInArrow(folded, ddl)


WAY = "conv_id {0}, node long, start int, stop int, final boolean"


def _handed_down(children: DataFrame, ways: DataFrame, ddl: str) -> DataFrame:
    """The ways of children, from those of their parents."""
    like = _arrow(ddl)

    def told(below: pa.Table, above: pa.Table) -> pa.Table:
        rows, way = sorted(below.to_pylist(), key=lambda r: r["node"]), above.to_pylist()[0]
        along = states_along(fold_layers(_layers(rows))[1], way["start"], way["stop"])
        last = len(rows) - 1
        return _told([{"conv_id": r["conv_id"], "node": r["node"], "start": p, "stop": q, "final": way["final"] and i == last} for i, (r, (p, q)) in enumerate(zip(rows, along, strict=True))], like)

    return children.withColumn("up", _block("node")).groupBy("conv_id", "up").cogroup(ways.groupBy("conv_id", "node")).applyInArrow(told, ddl)


def _chosen(tops: DataFrame, id_type: str) -> DataFrame:
    """conv_id, node, cost, illegal and the whole way of nodes that are all of their conversation."""
    @F.udf("cost long, stop int")
    def best(costs, ranks):  # noqa: ANN001, ANN202  four numbers a conversation
        return ending((tuple(costs), tuple(ranks)))

    return tops.withColumn("best", best("costs", "ranks")).select("conv_id", "node", F.col("best.cost").alias("cost"), "illegal", F.lit(START).alias("start"), F.col("best.stop").alias("stop"), F.lit(True).alias("final"))


EDIT = "at long, code string, before array<string>, role string, after array<string>"


def edits(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, cost, illegal), (edits by row: at, code, before, role, after)."""
    id_type = dict(facts.dtypes)["conv_id"]
    node, way = NODE.format(id_type), WAY.format(id_type)
    pending, tops, levels = checkpointed(_nodes(facts, node)), [], []
    while True:
        many = pending.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("many_id"))
        met = checkpointed(pending.join(many, F.col("conv_id").eqNullSafe(F.col("many_id")), "left_semi"))
        tops.append(_chosen(pending.join(many, F.col("conv_id").eqNullSafe(F.col("many_id")), "left_anti"), id_type))
        if met.isEmpty():
            break
        levels.append(met)
        pending = checkpointed(_parents(met, node))
    tops = [checkpointed(t) for t in tops]
    ways = tops[-1].select("conv_id", "node", "start", "stop", "final")
    for below, alone in zip(reversed(levels), reversed(tops[:-1]), strict=True):
        ways = alone.select("conv_id", "node", "start", "stop", "final").unionByName(_handed_down(below, ways, way))
    like = _arrow(EDIT)

    def spell(rows: pa.Table, known: pa.Table) -> pa.Table:
        way_of = {w["conv_id"]: w for w in known.to_pylist()}
        out = []
        for conv_id, run in _runs(rows):
            w = way_of[conv_id]
            told = spelt([r["kind"] for r in run], w["start"], w["stop"], w["final"])
            out += [{"at": r["at"], "code": code, "before": before, "role": role, "after": after} for r, (code, before, role, after) in zip(run, told, strict=True)]
        return _told(out, like)

    rows = facts.select("at", "conv_id", "kind").groupBy(_block("at")).cogroup(ways.groupBy("node")).applyInArrow(spell, EDIT)
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionByName(t)
    return whole.select("conv_id", "cost", "illegal"), rows


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, at, nth, role, text of the turns of repaired conversations, in the order of (at, nth); inserted ones are empty.

    rows: conv_id, turn, role, text."""
    placed = numbered(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))
    return _turns(placed, edits(checkpointed(faulted(placed)))[1])


def _turns(placed: DataFrame, told: DataFrame) -> DataFrame:
    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))
    kept = F.when(F.col("code").endswith("D"), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(own))
    met = placed.join(told.withColumnRenamed("role", "new_role"), "at")
    turns = met.select("conv_id", "at", F.posexplode(F.concat(empty("before"), kept, empty("after"))).alias("nth", "turn"))
    return turns.select("conv_id", "at", "nth", "turn.role", "turn.text")


def _digests(placed: DataFrame, told: DataFrame, id_type: str) -> DataFrame:
    """conv_id, audit, repaired_sha256: rows of a conversation stream by in order, one hash and the codes are held."""
    ddl = f"conv_id {id_type}, audit string, repaired_sha256 string"
    like = _arrow(ddl)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, audit, told_any, state = None, False, [], False, hashlib.sha256()

        def line(role: str, text: str) -> None:
            nonlocal told_any
            state.update(("\n" * told_any + role + ":" + text).encode("utf-8", "surrogatepass"))
            told_any = True

        def done() -> dict:
            return {"conv_id": now, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not seen or r["conv_id"] != now:
                    if seen:
                        out.append(done())
                    now, seen, audit, told_any, state = r["conv_id"], True, [], False, hashlib.sha256()
                audit.append(r["code"] + "I" * len(r["after"]))
                for role in r["before"]:
                    line(role, "")
                if r["code"][-1] != "D":
                    line(r["new_role"] or r["role"], r["text"])
                for role in r["after"]:
                    line(role, "")
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=like)
        if seen:
            yield pa.RecordBatch.from_pylist([done()], schema=like)

    met = placed.join(told.withColumnRenamed("role", "new_role"), "at").select("conv_id", "at", "role", "text", "code", "before", "new_role", "after")
    width = shuffle_width(placed.sparkSession)
    return met.repartition(width, "conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(hashed, ddl)


def _counts(facts: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated; turns first, so that distinct ones are counted by sums."""
    number = lambda fault: F.sum((F.col("fault").eqNullSafe(fault)).cast("long")).alias(fault)
    turns = facts.groupBy("conv_id", "turn").agg(*[number(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])


def repair_report(conversations: DataFrame) -> DataFrame:
    """For each conv_id of the table, after damage: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    id_type = dict(conversations.dtypes)["conv_id"]
    placed = numbered(damaged(conversations))
    facts = checkpointed(faulted(placed))
    whole, told = edits(facts)
    parts = [_counts(facts), whole, _digests(placed, checkpointed(told), id_type)]
    out = conversations.select("conv_id").distinct()
    for i, part in enumerate(parts):
        named = part.withColumnRenamed("conv_id", f"id_{i}")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col(f"id_{i}")), "left").drop(f"id_{i}")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
