"""Hard negatives by branch and bound over ball trees.

Vectors are dealt evenly to parts of a bounded size, and each part becomes one row that holds its rows in the order of a
forest of ball trees: one tree a label where labels have enough rows, so that a whole tree is left out by its label. For a
query q and a ball with centre c and radius r, an inner product lies between q.c - |q|r and q.c + |q|r. A node is left out
when its upper bound lies under the window or strictly under the query's k-th score so far, or its lower bound over the
window. Bounds of all nodes and all queries of a block come from one matrix product.

The anchors are a query set of their own; they go in bounded blocks to every part (a key each, no cross join), first for
the positives among rows of the same label, then with each positive's window for the negatives among other labels. A
part tells the best k of a query, and a ranked window with a limit merges them.

Rows with a null id, label or vector, or with a component that is null or not finite, take no part, nor do rows with a
component of 2**26 or more after scaling, whose products need not fit into a long. Shorter vectors count as filled up with
zeros; an empty vector scores 0. Ties go to the smaller id. Rows that repeat an id are rows of their own as candidates, and
each takes a place; as anchors, rows that repeat id, label and vector count once. An anchor's own id is none of its
positives. Anchors without positives or without rows in a window are not in the result; a negative positive score has an
empty window. Labels are compared as text. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 64
#: Components of a part, and anchors of a block.
PART = 1 << 19
BLOCK = 256
#: Blocks that one task takes with a copy of a part.
AT_ONCE = 8
LOWEST = np.iinfo(np.int64).min
HIGHEST = np.iinfo(np.int64).max


@dataclass
class Forest:
    """Rows in tree order, and nodes: centre, radius, rows from..to, children (0: a leaf) and the only label, or -1."""

    vectors: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    names: list[str]
    roots: list[int]
    centres: np.ndarray
    radii: np.ndarray
    spans: np.ndarray
    children: np.ndarray
    labels: np.ndarray


def planted(vectors: np.ndarray, ids: np.ndarray, labels: list[str]) -> Forest:
    """Split each label's rows at the median along the line between two far rows, down to leaves."""
    names = sorted(set(labels))
    place = {name: i for i, name in enumerate(names)}
    codes = np.array([place[x] for x in labels], dtype=np.int64)
    apart = len(names) * LEAF <= 2 * len(ids)
    groups = [(np.flatnonzero(codes == i), i) for i in range(len(names))] if apart else [(np.arange(len(ids)), -1)] if len(ids) else []
    order: list[np.ndarray] = []
    nodes: list[list] = []
    done = 0

    def node(rows: np.ndarray, start: int, label: int) -> int:
        x = vectors[rows].astype(float)
        centre = x.mean(axis=0)
        nodes.append([centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())), (start, start + len(rows)), (0, 0), label])
        return len(nodes) - 1

    roots = []
    for rows, label in groups:
        roots.append(node(rows, done, label))
        todo = [(roots[-1], rows)]
        final = np.empty(len(rows), dtype=np.int64)
        while todo:
            at, mine = todo.pop()
            start = nodes[at][2][0]
            if len(mine) <= LEAF or nodes[at][1] == 0:
                final[start - done : start - done + len(mine)] = mine
                continue
            x = vectors[mine].astype(float)
            far = x[((x - nodes[at][0]) ** 2).sum(axis=1).argmax()]
            along = (x[((x - far) ** 2).sum(axis=1).argmax()] - far) @ x.T
            half = len(mine) // 2
            sides = np.argpartition(along, half)
            kids = []
            for part, begin in ((sides[:half], start), (sides[half:], start + half)):
                kids.append(node(mine[part], begin, label))
                todo.append((kids[-1], mine[part]))
            nodes[at][3] = tuple(kids)
        order.append(final)
        done += len(rows)
    whole = np.concatenate(order) if order else np.empty(0, dtype=np.int64)
    columns = list(zip(*nodes, strict=True)) if nodes else [[], [], [], [], []]
    return Forest(
        vectors[whole], ids[whole], codes[whole], names, roots, np.array(columns[0]).reshape(len(nodes), vectors.shape[1]),
        np.array(columns[1]), np.array(columns[2], dtype=np.int64).reshape(-1, 2), np.array(columns[3], dtype=np.int64).reshape(-1, 2), np.array(columns[4], dtype=np.int64),
    )


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where every sum is exact there."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


@dataclass
class Queries:
    """Several windows a vector: seat is the vector of a window. names: label of each vector."""

    vectors: np.ndarray
    ids: np.ndarray
    names: list[str]
    seat: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, and its k-th score written to kth where it has k."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, dtype=np.int64)
    nth = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    full = nth == k - 1
    kth[q[full]] = score[full]
    return q[nth < k], score[nth < k], ids[nth < k]


def nearest(forest: Forest, queries: Queries, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, score, id) of the k best rows in each window, of the same label but another id, or of other labels; and the
    number of leaves that were read."""
    q, score, ids = (np.empty(0, dtype=np.int64) for _ in range(3))
    leaves = 0
    if not forest.roots or not len(queries.seat):
        return q, score, ids, leaves
    width = max(forest.vectors.shape[1], queries.vectors.shape[1])
    fill = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    v, rows, centres = fill(queries.vectors), fill(forest.vectors), fill(forest.centres)
    place = {name: i for i, name in enumerate(forest.names)}
    own = np.array([place.get(name, -2) for name in queries.names], dtype=np.int64)
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    middle, reach = centres @ v.T.astype(float), np.outer(forest.radii, norms)
    slack = 1e-6 + 1e-9 * (np.abs(middle) + reach + np.outer(np.sqrt((centres**2).sum(axis=1)), norms))
    upper, lower = middle + reach + slack, middle - reach - slack
    kth = np.full(len(queries.seat), LOWEST, dtype=np.int64)
    best_first = lambda nodes, s: sorted(nodes, key=lambda n: upper[n, s].mean())  # noqa: E731  the last one is read first
    stack = [(n, np.arange(len(queries.seat))) for n in best_first(forest.roots, queries.seat)]
    while stack:
        n, live = stack.pop()
        s = queries.seat[live]
        stay = (upper[n, s] >= np.maximum(queries.low[live], kth[live])) & (lower[n, s] <= queries.high[live])
        if forest.labels[n] >= 0:
            stay &= (own[s] == forest.labels[n]) == same
        live = live[stay]
        if not len(live):
            continue
        s = queries.seat[live]
        if forest.children[n, 0]:
            stack += [(child, live) for child in best_first(forest.children[n], s)]
            continue
        leaves += 1
        begin, end = forest.spans[n]
        seats, back = np.unique(s, return_inverse=True)
        found = _products(v[seats], rows[begin:end])[back]
        ok = (found >= np.maximum(queries.low[live], kth[live])[:, None]) & (found <= queries.high[live][:, None])
        ok &= (own[s][:, None] == forest.codes[begin:end]) == same
        if same:
            ok &= queries.ids[s][:, None] != forest.ids[begin:end]
        a, b = np.nonzero(ok)
        if len(a):
            q, score, ids = _best(np.r_[q, live[a]], np.r_[score, found[a, b]], np.r_[ids, forest.ids[begin:end][b]], k, kth)
    return q, score, ids, leaves


# ---- Spark ----------------------------------------------------------------------------------------------------------

FOREST = "part int, n int, vectors binary, ids array<long>, codes array<long>, names array<string>, roots array<int>, centres binary, radii array<double>, spans binary, children binary, labels array<long>"
ANCHORS = "block int, n int, ids array<long>, names array<string>, vectors binary"
FOUND = "block int, seat int, place int, anchor_id long, positive_id long, positive_score long, found_id long, score long"


def _matrix(lists: list[list[int]]) -> np.ndarray:
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _packed(rows: DataFrame) -> DataFrame:
    like = _arrow(FOREST)

    def pack(table: pa.Table) -> pa.Table:
        cols = table.select(["part", "vec_id", "label", "vector"]).to_pydict()
        f = planted(_matrix(cols["vector"]), np.array(cols["vec_id"], dtype=np.int64), cols["label"])
        return pa.Table.from_pylist([{
            "part": cols["part"][0], "n": len(f.ids), "vectors": f.vectors.astype("<i4").tobytes(), "ids": f.ids.tolist(), "codes": f.codes.tolist(), "names": f.names,
            "roots": f.roots, "centres": f.centres.astype("<f8").tobytes(), "radii": f.radii.tolist(), "spans": f.spans.tobytes(), "children": f.children.tobytes(), "labels": f.labels.tolist(),
        }], schema=like)

    return rows.groupBy("part").applyInArrow(pack, FOREST)


def _unpacked(row: dict) -> Forest:
    ints = lambda name: np.frombuffer(row[name], dtype=np.int64).reshape(-1, 2)
    m = len(row["radii"])
    return Forest(
        np.frombuffer(row["vectors"], dtype="<i4").reshape(row["n"], -1), np.array(row["ids"], dtype=np.int64), np.array(row["codes"], dtype=np.int64), row["names"],
        row["roots"], np.frombuffer(row["centres"], dtype="<f8").reshape(m, -1), np.array(row["radii"]), ints("spans"), ints("children"), np.array(row["labels"], dtype=np.int64),
    )


def _blocks(anchors: DataFrame) -> DataFrame:
    like = _arrow(ANCHORS)

    def pack(table: pa.Table) -> pa.Table:
        cols = table.select(["block", "vec_id", "label", "vector"]).to_pydict()
        x = _matrix(cols["vector"])
        return pa.Table.from_pylist([{"block": cols["block"][0], "n": len(x), "ids": cols["vec_id"], "names": cols["label"], "vectors": x.astype("<i4").tobytes()}], schema=like)

    return anchors.groupBy("block").applyInArrow(pack, ANCHORS)


def _searched(forests: DataFrame, blocks: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """FOUND rows of each block in each part. A task takes a part with a few blocks."""
    like = _arrow(FOUND)

    def search(part: pa.Table, mine: pa.Table) -> pa.Table:
        out = []
        for row in part.to_pylist():
            forest = _unpacked(row)
            for b in mine.to_pylist():
                vectors = np.frombuffer(b["vectors"], dtype="<i4").reshape(b["n"], -1).astype(np.int64)
                ids = np.array(b["ids"], dtype=np.int64)
                wins = b.get("windows") or [{"seat": i, "place": 0, "positive_id": 0, "positive_score": 0, "low": LOWEST, "high": HIGHEST} for i in range(b["n"])]
                ints = lambda name: np.array([w[name] for w in wins], dtype=np.int64)  # noqa: B023, E731
                q, score, found, _ = nearest(forest, Queries(vectors, ids, b["names"], ints("seat"), ints("low"), ints("high")), k, same)
                for i, s, x in zip(q.tolist(), score.tolist(), found.tolist(), strict=True):
                    w = wins[i]
                    out.append({"block": b["block"], "seat": w["seat"], "place": w["place"], "anchor_id": b["ids"][w["seat"]], "positive_id": w["positive_id"], "positive_score": w["positive_score"], "found_id": x, "score": s})
        return pa.Table.from_pylist(out, schema=like)

    group = F.floor(F.col("block") / AT_ONCE).cast("int").alias("group")
    # Keys of part and group on both sides; a part has one row, and there are as many groups as the anchors fill.
    groups = blocks.select(group).distinct()
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    sent = groups.select("group", every).join(forests, "part")
    asked = blocks.select("*", group).select("*", every)
    return sent.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("block", "seat", "place").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vector (array of whole numbers). Negatives lie between low and high per cent of the positive's score."""
    fit = ~F.exists("vector", lambda x: x.isNull() | (F.abs(x) >= 1 << 26))
    taken = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "vector", is_anchor.alias("is_anchor")).filter(fit).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    anchors = taken.filter("is_anchor").dropDuplicates(["vec_id", "label", "vector"])
    n, n_anchors, width = taken.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    parts, n_blocks = max(1, -(-n * max(width, 1) // PART)), max(1, -(-n_anchors // BLOCK))
    dealt = taken.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    forests = written(_packed(dealt))
    # Anchors that repeat are gone, so hashes fill blocks evenly.
    blocks = written(_blocks(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(n_blocks)).cast("int"))))
    first = _ranked(_searched(forests, blocks, parts, positives, True), positives)
    window = F.struct("seat", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), _share(low, True).alias("low"), _share(high, False).alias("high"))
    windows = first.filter("score >= 0").groupBy("block").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    found = _searched(forests, blocks.join(windows, "block"), parts, negatives, False)
    return _ranked(found, negatives).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _share(percent: int, up: bool) -> Column:
    """Whole per cents of a score of 0 or more, rounded up or down, exactly."""
    rest = (F.col("score") % 100) * percent / 100
    return (F.expr("score div 100") * percent + (F.ceil(rest) if up else F.floor(rest))).cast("long")


SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM ranked WHERE rank <= 3
"""
