import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from cliploom.llm import conversation_repair as cr

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Every sequence of edits of a short conversation: rows are (role, text, fault); cost and audit, then the least."""
    best = None
    options = [[("I" * n, e) for n in range(4) for e in "DKR"] for _ in rows]
    for way in product(*options):
        for tail in range(4):
            roles, cost, audit = [], 0, ""
            ways = [[]]
            for (ins, e), (role, _, fault) in zip(way, rows, strict=True):
                audit += ins + e
                cost += 5 * len(ins)
                ways = [w + list(x) for w in ways for x in product("ua", repeat=len(ins))]
                if e == "D":
                    cost += 2
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += 5 * (fault == "truncated")
                if e == "K":
                    ways = [w + [role[:1]] for w in ways]
                else:
                    cost += 1
                    ways = [w + [x] for w in ways for x in "ua"]
            else:
                audit += "I" * tail
                cost += 5 * tail
                if best and (cost, audit) >= best[:2]:
                    continue
                for w in ways:
                    for x in product("ua", repeat=tail):
                        roles = "".join(w + list(x))
                        if re.fullmatch("(s?(ua)+)?", roles) and len(roles) == len(w) + tail:
                            best = (cost, audit, roles)
    return best


def plain(rows):
    """Strings instead of ranks: the programme over (state, cost, audit)."""
    states = {cr.START: (0, "")}
    for role, _, fault in rows:
        after = {}
        for p, (cost, audit) in states.items():
            state, ins = p, 0
            for n in range(3):
                offers = [(state, 2, "D")]
                if fault not in ("blank", "duplicate"):
                    extra = 5 * (fault == "truncated")
                    offers += [(cr.AFTER.get((state, role[:1])), extra, "K"), (cr.AFTER[state, cr.NEEDED[state][0]], extra + 1, "R")]
                for q, c, e in offers:
                    if q is not None:
                        offer = (cost + ins + c, audit + "I" * n + e)
                        after[q] = min(after.get(q, offer), offer)
                state, ins = cr.AFTER[state, cr.NEEDED[state][0]], ins + 5
        states = after
    return min((c + 5 * cr.TAIL[q], a + "I" * cr.TAIL[q]) for q, (c, a) in states.items())


def damage(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        out[conv_id]
        told = lambda v: " " if v is None else str(v)
        role, text, draw = told(role), told(text), zlib.crc32(f"{told(conv_id)}:{told(turn)}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out[conv_id] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def report(rows):
    out = []
    for conv_id, turns in damage(rows).items():
        seen, told = set(), []
        for _, role, text in turns:
            marks = WORD.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        cost, audit = plain(told) if told else (0, "")
        lines, roles, left = [], iter(told), audit
        last = ""
        for e in left:
            needed = "user" if last != "u" else "assistant"
            if e == "I":
                lines.append(f"{needed}:")
            else:
                role, text, _ = next(roles)
                if e == "D":
                    continue
                lines.append(f"{needed if e == 'R' else role}:{text}")
            last = lines[-1][:1]
        count = lambda f: sum(x[2] == f for x in told)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in cr.repair_report(df).collect()], key=str)


def test_programme_against_every_way():
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "", rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 3))]
        kinds = [cr.INITIALS.index(r[:1]) if r[:1] and r[:1] in "sua" else 3 for r, _, _ in rows]
        weights = [cr.GONE if f in ("blank", "duplicate") else cr.CUT if f else cr.FINE for _, _, f in rows]
        kinds = [w * 4 + k for w, k in zip(weights, kinds, strict=True)]
        layer, _ = cr.fold_rows(kinds, False)
        cost, end = cr.ending(layer)
        told = cr.spelt(kinds, cr.START, end, True)
        audit = "".join(code + "I" * len(after) for code, _, _, after in told) or "I" * cr.TAIL[end]
        assert (cost, audit) == cheapest(rows)[:2] == plain(rows)


@pytest.mark.parametrize("seed", range(6))
def test_parts_compose(seed):
    """Layers folded in parts of any size give the cost and the audit of the whole."""
    rng = random.Random(seed)
    kinds = [rng.randrange(12) for _ in range(rng.randint(2, 60))]
    cuts = sorted(rng.sample(range(1, len(kinds)), min(len(kinds) - 1, rng.randint(1, 9))))
    parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True)]
    layer, befores = cr.fold_layers([cr.fold_rows(part, i > 0 or seed % 2 == 0)[0] for i, part in enumerate(parts)])
    cost, end = cr.ending(layer)
    along = cr.states_along(befores, cr.START, end)
    told = [x for i, (part, (p, q)) in enumerate(zip(parts, along, strict=True)) for x in cr.spelt(part, p, q, i == len(parts) - 1)]
    audit = "".join(code + "I" * len(after) for code, _, _, after in told)
    names = [("system", "user", "assistant", "tool")[k % 4] for k in kinds]
    faults = [(None, "truncated", "blank")[k // 4] for k in kinds]
    assert (cost, audit) == plain([(n, "", f) for n, f in zip(names, faults, strict=True)])


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi there."), (1, 2, "assistant", "Hello."), (1, 4, "user", "Why"), (1, 5, "assistant", "Because!"),
    (2, None, "user", "first"), (2, 3, None, "x."), (2, 3, "user", None), (2, 9, "assistant", "ok. \n\t"), (2, 9, "assistant", "ok. \n\t"),
    (None, 0, "user", "no name."), (None, 1, "assistant", "Right."), (None, None, None, None),
    (3, None, "user", "a."), (3, None, "assistant", "b."), (4, 0, "", "empty role."), (4, 1, "Umpire", "u."), (4, 1, "umpire", "u."),
    (9_007_199_254_740_993, 0, "user", "big id."), (9_007_199_254_740_993, 1, "assistant", "big id?"), (9_007_199_254_740_992, 0, "assistant", "near it."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_edges(spark):
    long = [(7, i, ("user", "assistant")[i % 2], "very long " * 30_000 + f"{i}.") for i in range(4)]
    dropped = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [*ROWS, *ROWS[3:6], *long, (dropped, 0, "user", "goes.")]
    df = spark.createDataFrame([(*r, 1, True, 3) for r in rows], SCHEMA + ", at int, kept boolean, node int")
    assert got(df) == report(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got(df)
    assert got(df.limit(0)) == [] and cr.repaired_turns(df.limit(0)).count() == 0


def test_hot_conversation_is_folded_in_blocks(spark, monkeypatch):
    """A third of all rows in one conversation, and a third that are one row repeated, over three levels of blocks."""
    monkeypatch.setattr(cr, "SHIFT", 4)
    rng = random.Random(3)
    rows = [(1, rng.randrange(500), rng.choice(["user", "assistant", "system", "x"]), f"t{i}" + rng.choice([".", ""])) for i in range(500)]
    rows += [(2, 5, "user", "the same.")] * 500 + [(i, t, ("user", "assistant")[t % 2], f"{i} {t}.") for i in range(10, 110) for t in range(5)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == report(rows)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(df) == report([tuple(r) for r in df.collect()])


def test_repaired_turns_are_legal(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns = defaultdict(list)
    for r in cr.repaired_turns(cr.damaged(df)).orderBy("conv_id", "at", "nth").collect():
        turns[r.conv_id].append(r.role[0])
    assert turns and all(re.fullmatch("(s?(ua)+)?", "".join(t)) for t in turns.values())
