"""Similarity join of documents on the Jaccard index of their word n-gram sets, by prefix trees.

1. A text's set holds the 64-bit hashes of its shingles, in ascending order: that is the global order of n-grams.
   Equal sets form a class, named by a hash of the set; one text stands for it from here on. (Should two sets have one
   name, which is looked for, all are named anew.)
2. Two linked sets of sizes a and b differ in at most (1 - t) / (1 + t) * (a + b) n-grams. The hash range is cut into
   more parts than that, so linked sets agree in a whole part. Sets of a size class deal the hash of each part to all
   sets with the same: what meets is nearly always near copies, never whole passages that many documents share. (An
   empty part tells nothing and is left out, but for sets that have more empty parts than there are parts to spare.)
3. Sets that meet are compared by parity bitmaps as long as the sets, whose distance is at most that of the sets; a spanning forest of
   those that may be linked, not all their pairs, gives candidate components.
4. In each candidate component the sets go into a prefix tree. A set descends the tree with the overlap of the path so
   far, which all sets below share; a subtree is left where the overlap and the n-grams that remain on either side are
   too few for its smallest set, or where all its sets are already joined to this one. This decides every link.
   A component of more than `block` sets is dealt to blocks with a tree each; what a block joins is represented by one set
   in the next round, so near copies of one text need each set once and then few. Where several parts remain, the sets
   outside the largest part ask all sets of the component, block by block.
5. Links form components; members get the smallest doc_id of their component.

Every step is exact: no link is lost, and none is made that the sets do not have.

Null and empty texts, and those without words, have an empty set and are linked with nothing. Rows that repeat doc_id
are documents of their own with one id, whatever their texts are. Rows with a null doc_id link like others, and have a
null component_id when no document of their component has an id. Of ties there are none: components do not depend on
order. A very long text is one large set; nothing of it is left out. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components

U = np.uint64
LEAST_BITS = 256
SALTS = 64
SPARE = 0.04  # parts beyond those that linked sets may differ in


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class WordHashes(dict[bytes, int]):
    """Hashes of words; the first `most` distinct words are kept."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = n
        return n


class Shingles:
    """Sets of texts."""

    def __init__(self, words: int, most: int = 1 << 19):
        self.words, self.known = words, WordHashes(most)

    def set_of(self, text: str | None) -> np.ndarray:
        # bytes.lower() lowers A-Z alone, bytes.split() splits at the blanks 20 and 09 to 0D alone.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, U)
        known = self.known
        hashes = np.fromiter([known[w] for w in words], U, len(words))
        size = min(self.words, len(hashes))
        total = np.full(len(hashes) - size + 1, size, U)
        for i in range(size):
            total = mix(total * U(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - size + 1 + i])
        return np.unique(total)


@dataclass(frozen=True)
class Threshold:
    """Jaccard index of at least percent / 100."""

    percent: int

    def needed(self, a, b):
        """Least overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def apart(self, both):
        """Most n-grams in which linked sets with so many in both can differ."""
        return (100 - self.percent) * both // (100 + self.percent)

    def bounds(self, largest: int) -> np.ndarray:
        """First size of each size class, up to one class beyond `largest`; linked sets are in one class or neighbours."""
        first = [1]
        while first[-1] <= largest or len(first) < 4:
            first.append(100 * first[-1] // self.percent + 1)
        return np.array([*first, 100 * first[-1] // self.percent + 1, 100 * (100 * first[-1] // self.percent + 1) // self.percent + 1], np.int64)


def map_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of a set's map: a power of two, at least its size."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity of the n-grams that fall on each bit, as 64-bit words. A set of half the bits falls on the same bits when
    the halves of its longer map are joined by exclusive or."""
    bits = int(map_bits(np.array([len(grams)]))[0])
    bit = (mix(grams ^ U(0xA5A5A5A5A5A5A5A5)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def halved(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (a row each) folded to so many words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


class Maps:
    """Maps of many sets, of different lengths."""

    def __init__(self, raw: list[bytes]):
        self.words = np.array([len(r) // 8 for r in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.at: dict[int, np.ndarray] = {}
        for words in np.unique(self.words):
            mine = np.flatnonzero(self.words == words)
            self.place[mine] = np.arange(len(mine))
            self.at[int(words)] = np.frombuffer(b"".join(raw[i] for i in mine), np.uint64).reshape(-1, words)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the maps of rows a and b differ, pair by pair; a difference of the sets is as large at least."""
        out = np.zeros(len(a), np.int64)
        kinds = self.words[a] * (1 << 32) + self.words[b]
        for kind in np.unique(kinds):
            these = np.flatnonzero(kinds == kind)
            wa, wb = int(kind) >> 32, int(kind) & 0xFFFFFFFF
            words = min(wa, wb)
            for some in np.array_split(these, max(1, len(these) * words // 2_000_000)):
                x, y = (halved(self.at[w][self.place[r[some]]], words) for w, r in ((wa, a), (wb, b)))
                out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


def signatures(sets: list[np.ndarray], threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of all sets, and the number of the set that each is of."""
    sizes = np.array([len(s) for s in sets], np.int64)
    first = threshold.bounds(int(sizes.max(initial=1)))
    own = np.searchsorted(first, sizes, side="right") - 1
    out, of = [], []
    for back in (0, 1):
        scheme = own - back
        last = first[np.clip(scheme, 0, None) + 1] + first[np.clip(scheme, 0, None) + 2] - 2
        differ = threshold.apart(last)
        chosen = np.flatnonzero((scheme >= 0) & (differ > 0) & (sizes > 0))  # where nothing may differ, only equal sets link
        if not len(chosen):
            continue
        spare = ((differ + 1) * SPARE).astype(np.int64)
        parts = (differ + 1 + spare)[chosen]
        starts = np.cumsum(parts) - parts
        flat = np.concatenate([sets[i] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
        slot = starts[owner] + (((flat >> U(32)) * parts[owner].astype(U)) >> U(32)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        sums = np.zeros(int(parts.sum()), U)
        full = np.zeros(len(sums), bool)
        sums[slot[edge]] = np.add.reduceat(mix(flat), edge)
        full[slot[edge]] = True
        whose = np.repeat(np.arange(len(chosen)), parts)
        empty = parts - np.bincount(whose, full, len(chosen)).astype(np.int64)
        told = full | (empty > spare[chosen])[whose]
        name = mix(scheme[chosen][whose].astype(U) * U(0x9E3779B97F4A7C15) + (np.arange(len(sums)) - starts[whose]).astype(U))
        out.append(mix(sums ^ name)[told])
        of.append(chosen[whose[told]])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, U), np.zeros(0, np.int64))


def _groups(batch: pa.RecordBatch, at: int, chars: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """Slices of a batch whose texts (column `at`) have some millions of characters together, or one long text."""
    first, texts, size = 0, [], 0
    for i, text in enumerate(batch.column(at)):
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= chars:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def named(found: np.ndarray, seed: int) -> tuple[int, int]:
    """The name of a set, and a second hash that tells sets of one name apart."""
    key = hashlib.blake2b(found.tobytes(), digest_size=16, salt=bytes([seed])).digest()
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def described(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, pick (a hash of the row), node (the name of its set), proof, n, bitmap of each document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for first, texts in _groups(batch, 2):
                sets = [shingles.set_of(t) for t in texts]
                names = np.array([named(s, seed) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        batch.column(1).slice(first, len(texts)),
                        pa.array(names[:, 0]),
                        pa.array(names[:, 1]),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "pick", "node", "proof", "n", "bitmap"],
                )

    return docs.select("doc_id", "pick", "text").mapInArrow(describe, "doc_id long, pick long, node long, proof long, n long, bitmap binary")


def meetings(docs: DataFrame, words: int, threshold: Threshold, seed: int) -> DataFrame:
    """meeting, node: sets with a part in common; the same sets meet once."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(words), set()
        for batch in batches:
            for _, texts in _groups(batch, 0):
                sets, names = [], []
                for text in texts:
                    found = shingles.set_of(text)
                    name, _ = named(found, seed)
                    # A task tells of equal sets once (until it has seen too many): one text with a third of all
                    # rows has as many rows here as there are tasks.
                    if name in seen:
                        continue
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add(name)
                    sets.append(found)
                    names.append(name)
                if sets:
                    values, of = signatures(sets, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.array(names, np.int64)[of])], names=["part", "node"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one part in sorted rows; a run can go on in the next batch."""
        left_part, left_ids, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), set()

        def told(part: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            names, members = [], []
            for i in np.flatnonzero(np.diff(edge) > 1):
                group = np.unique(ids[edge[i] : edge[i + 1]])
                name = int.from_bytes(hashlib.blake2b(group.tobytes(), digest_size=8).digest(), "little", signed=True)
                if len(group) < 2 or name in seen:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(name)
                names.append(np.full(len(group), name))
                members.append(group)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], names=["meeting", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.concatenate([left_part, batch.column(0).to_numpy()])
            ids = np.concatenate([left_ids, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(part, part[-1], side="left"))
            left_part, left_ids = part[cut:], ids[cut:]
            yield from told(part[:cut], ids[:cut])
        if len(left_part):
            yield from told(left_part, left_ids)

    dealt = docs.select("text").mapInArrow(parts, "part long, node long").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(met, "meeting long, node long").distinct()


def forest(ids: np.ndarray, sizes: np.ndarray, maps: Maps, rows: np.ndarray, threshold: Threshold) -> list[tuple[int, int]]:
    """Spanning forest of those of the rows that their maps allow to be linked. The rows of the largest tree so far need
    not ask the others: each row outside asks them."""
    n = len(rows)
    tree = np.arange(n)
    asked = np.zeros(n, bool)
    edges: list[tuple[int, int]] = []
    while True:
        outside = np.flatnonzero(~asked & (tree != np.bincount(tree, minlength=n).argmax()))
        if len(outside):
            at = int(outside[0])
        elif asked.any():
            return edges
        else:
            at = 0
        asked[at] = True
        others = np.flatnonzero(tree != tree[at])
        near = others[threshold.needed(sizes[rows[others]], sizes[rows[at]]) <= np.minimum(sizes[rows[others]], sizes[rows[at]])]
        one = np.full(len(near), rows[at])
        for other in near[maps.apart(rows[near], one) <= threshold.apart(sizes[rows[near]] + sizes[rows[at]])]:
            if tree[other] != tree[at]:
                edges.append((int(ids[rows[at]]), int(ids[rows[other]])))
                tree[tree == tree[other]] = tree[at]


def candidates(met: DataFrame, maps: DataFrame, threshold: Threshold) -> DataFrame:
    """a, b: edges whose components hold all sets that may be linked; maps: node, n, bitmap."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one meeting in sorted rows; a run can go on in the next batch."""
        left: list = [np.zeros(0, np.int64)] * 3 + [[]]

        def told(meeting: np.ndarray, ids: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
            maps = Maps(raw)
            edge = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1], True])
            length = np.diff(edge)
            first = edge[:-1][length == 2]
            a, b = sizes[first], sizes[first + 1]
            pair = first[(threshold.needed(a, b) <= np.minimum(a, b)) & (maps.apart(first, first + 1) <= threshold.apart(a + b))]
            rest = [e for i in np.flatnonzero(length > 2) for e in forest(ids, sizes, maps, np.arange(edge[i], edge[i + 1]), threshold)]
            more = np.array(rest, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[ids[pair], more[:, 0]]), pa.array(np.r_[ids[pair + 1], more[:, 1]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([left[i], batch.column(i).to_numpy()]) for i in range(3)] + [left[3] + batch.column(3).to_pylist()]
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            left = [x[cut:] for x in rows]
            if cut:
                yield told(*(x[:cut] for x in rows))
        if len(left[0]):
            yield told(*left)

    shown = met.join(maps, "node").select("meeting", "node", "n", "bitmap")
    dealt = shown.repartition("meeting").sortWithinPartitions("meeting", "node")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


class Node:
    """A path of n-grams without a branch; depth and sizes are those of whole sets."""

    __slots__ = ("children", "depth", "label", "least", "most", "pair", "row", "some")

    def __init__(self, label: np.ndarray, depth: int, row: int, size: int):
        self.label, self.depth, self.row = label, depth, row  # depth: n-grams before the label; row: the set that ends here
        self.least = self.most = size
        self.some, self.children = row, {}  # some: a set below if all below are joined, else -1
        self.pair: tuple[int, int] | None = None  # two sets below that were not joined when last looked at


class Tree:
    """`parts`: names of what is joined beforehand, one for each set."""

    def __init__(self, sets: list[np.ndarray], threshold: Threshold, parts: list[int] | None = None):
        self.sets, self.threshold = sets, threshold
        first: dict[int, int] = {}
        self.parent = list(range(len(sets))) if parts is None else [first.setdefault(p, i) for i, p in enumerate(parts)]
        self.roots: dict[int, Node] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, row: int) -> int:
        while self.parent[row] != row:
            self.parent[row] = self.parent[self.parent[row]]
            row = self.parent[row]
        return row

    def joined(self, node: Node) -> int:
        """The component that holds all sets below node; -1 if there are several. A walk in a list, as paths can be as long
        as there are sets; it ends at the first two sets apart, and the nodes around both remember them."""
        if node.some >= 0:
            return self.find(node.some)
        if node.pair and self.find(node.pair[0]) != self.find(node.pair[1]):
            return -1
        # A frame: node, children left, first set met below. All sets met in any frame are in one component.
        frames: list[list] = []
        enter: Node | None = node
        while True:
            if enter is not None:
                met = enter.some if enter.some >= 0 else enter.row
                if enter.some < 0:
                    frames.append([enter, iter(enter.children.values()), -1])
                    if enter.pair and self.find(enter.pair[0]) != self.find(enter.pair[1]):
                        for frame in frames:
                            frame[0].pair = enter.pair
                        return -1
                if met >= 0:
                    i = len(frames) - 1
                    while i >= 0 and frames[i][2] < 0:
                        frames[i][2] = met
                        i -= 1
                    if i >= 0 and self.find(frames[i][2]) != self.find(met):
                        for frame in frames[: i + 1]:
                            frame[0].pair = (frame[2], met)
                        return -1
            enter = next(frames[-1][1], None)
            if enter is None:
                done, _, first = frames.pop()
                done.some, done.pair = self.find(first), None
                if not frames:
                    return done.some

    def ask(self, row: int) -> None:
        """Join a set with those in the tree that it is linked with and not yet joined to."""
        mine = self.sets[row]
        size = len(mine)
        stack = [(node, 0) for node in self.roots.values()]
        while stack:
            node, shared = stack.pop()
            least = self.threshold.needed(size, node.least)
            start = int(np.searchsorted(mine, node.label[0]))
            if shared + min(size - start, node.most - node.depth) < least or self.joined(node) == self.find(row):
                continue
            at = np.searchsorted(mine, node.label)
            shared += int((mine[np.minimum(at, size - 1)] == node.label).sum())
            depth = node.depth + len(node.label)
            if node.row >= 0 and shared >= self.threshold.needed(size, depth) and self.find(node.row) != self.find(row):
                self.links.append((row, node.row))
                self.parent[self.find(node.row)] = self.find(row)
            after = int(np.searchsorted(mine, node.label[-1], side="right"))
            if shared + min(size - after, node.most - depth) >= least:
                stack += [(child, shared) for child in node.children.values()]

    def add(self, row: int) -> None:
        mine, size, depth = self.sets[row], len(self.sets[row]), 0
        children = self.roots
        while True:
            head = int(mine[depth])
            node = children.get(head)
            if node is None:
                children[head] = Node(mine[depth:], depth, row, size)
                return
            rest = mine[depth:]
            n = min(len(rest), len(node.label))
            differ = np.flatnonzero(rest[:n] != node.label[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(node.label):
                lower = Node(node.label[same:], node.depth + same, node.row, 0)
                lower.least, lower.most, lower.some, lower.children, lower.pair = node.least, node.most, node.some, node.children, node.pair
                node.label, node.row, node.children = node.label[:same], -1, {int(lower.label[0]): lower}
            node.least, node.most = min(node.least, size), max(node.most, size)
            if node.some >= 0 and self.find(node.some) != self.find(row):
                node.some, node.pair = -1, (node.some, row)
            depth += same
            if depth == size:
                node.row = row
                return
            children = node.children


def tree_links(sets: list[np.ndarray], threshold: Threshold, first: int | None = None, parts: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets (ascending arrays, all different) that join what is linked. With `first`, only links between
    the first so many sets and the others are looked for; then sets may be equal where `parts` says that they are joined."""
    tree = Tree(sets, threshold, parts)
    if first is None:
        for row in range(len(sets)):
            tree.ask(row)
            tree.add(row)
    else:
        for row in range(first):
            tree.add(row)
        for row in range(first, len(sets)):
            tree.ask(row)
    return tree.links


def stars(ids: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of a component's smallest name with each other one, for the components of what was found."""
    parent = list(range(len(ids)))

    def find(row: int) -> int:
        while parent[row] != row:
            parent[row] = parent[parent[row]]
            row = parent[row]
        return row

    for a, b in found:
        a, b = find(a), find(b)
        if a != b:
            low, high = (a, b) if ids[a] < ids[b] else (b, a)
            parent[high] = low
    return [(int(ids[find(row)]), int(ids[row])) for row in {r for pair in found for r in pair} if find(row) != row]


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """node, component, size, grams for each row (node, pick, component, size) of `wanted`, from one text of the class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for first, texts in _groups(batch, 3):
                found = [shingles.set_of(t) for t in texts]
                # Rows that share a pick by accident have another set.
                same = pa.array([named(f, seed)[0] == n.as_py() for f, n in zip(found, batch.column(0).slice(first, len(texts)), strict=True)], pa.bool_())
                grams = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
                part = pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in range(3)), grams], names=["node", "component", "size", "grams"])
                yield part.filter(same)

    texts = docs.join(wanted, "pick").select("node", "component", "size", "text")
    return texts.mapInArrow(sets, "node long, component long, size long, grams array<long>")


def _found(group: pd.DataFrame) -> list[np.ndarray]:
    """The order of 64-bit hashes without sign."""
    return [np.asarray(g, np.int64).view(U) for g in group["grams"]]


def block_links(sets: DataFrame, threshold: Threshold, block: int, turn: int = 0) -> DataFrame:
    """a, b: for each block of each component, links of the smallest set of what a tree joins with each other one."""

    def join(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").drop_duplicates("node")
        return pd.DataFrame(stars(group["node"].to_numpy(), tree_links(_found(group), threshold)), columns=["a", "b"], dtype="int64")

    blocks = F.ceil(F.col("size") / F.lit(block))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), blocks).cast("int"))
    return dealt.groupBy("component", "block").applyInPandas(join, "a long, b long")


def outside_links(sets: DataFrame, label: DataFrame, threshold: Threshold, block: int) -> DataFrame:
    """a, b: links between parts (label.root) of a component. Each lies between a set outside the largest part and another
    set: every block of the former asks the trees of all blocks of sets."""

    def ask(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["node", "asks"]).sort_values(["asks", "node"])
        roots = group["root"].tolist()
        found = tree_links(_found(group), threshold, int((~group["asks"]).sum()), roots)
        return pd.DataFrame([(roots[a], roots[b]) for a, b in found], columns=["a", "b"], dtype="int64").drop_duplicates()

    parts = label.groupBy("component", "root").agg(F.count("*").alias("n"))
    open_ = (
        parts.groupBy("component")
        .agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"))
        .filter(F.col("parts") > 1)
        .select("component", F.ceil(F.col("size") / F.lit(block)).alias("trees"), F.ceil((F.col("size") - F.col("most.n")) / F.lit(block)).alias("asking"), F.col("most.root").alias("largest"))
    )
    every = sets.select("node", "grams").join(label, "node").join(open_, "component")
    deal = lambda width: F.pmod(F.xxhash64("node"), F.col(width))
    spread = lambda width: F.explode(F.sequence(F.lit(0).cast("long"), F.col(width) - 1))
    base = every.select("component", "node", "root", "grams", F.lit(False).alias("asks"), deal("trees").alias("tree"), spread("asking").alias("turn"))
    asks = every.filter("root <> largest").select("component", "node", "root", "grams", F.lit(True).alias("asks"), spread("trees").alias("tree"), deal("asking").alias("turn"))
    return base.unionByName(asks).groupBy("component", "tree", "turn").applyInPandas(ask, "a long, b long")


def joined_in_rounds(sets: DataFrame, threshold: Threshold, block: int) -> DataFrame:
    """node, root: the parts of components of more than `block` sets that their links join."""
    label = sets.select("node", "component", F.col("node").alias("root")).dropDuplicates(["node"])
    turn, before = 0, None
    while True:
        label = checkpointed(label)
        left = label.filter("node = root").groupBy("component").agg(F.count("*").alias("size"))
        most, total = left.agg(F.max("size"), F.sum("size")).first()
        if (most or 0) <= 1:
            return label.select("node", "root")
        # One tree has seen all representatives of a component, or rounds no longer help.
        if before and (before[0] <= block or total > 0.9 * before[1]):
            break
        before = (most, total)
        here = sets.select("node", "grams").join(label.filter("node = root").join(left, "component").select("node", "component", "size"), "node")
        found = block_links(here, threshold, block, turn).withColumnsRenamed({"b": "root"})
        label = label.join(found, "root", "left").select("node", "component", F.coalesce("a", "root").alias("root"))
        turn += 1
    more = components(outside_links(sets, label, threshold, block)).withColumnsRenamed({"node": "root", "component": "further"})
    return label.join(more, "root", "left").select("node", F.coalesce("further", "root").alias("root"))


def jaccard_components(docs: DataFrame, *, words: int = 4, percent: int = 85, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    threshold = Threshold(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("pick", F.xxhash64("doc_id", "text"))
    seed = 0
    while True:
        rows = checkpointed(described(texts, words, seed).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
        some = rows.filter(F.col("n") > 0)
        # Members of a class with a third of all rows meet in SALTS groups, each of which meets one row of the class.
        leaves = some.groupBy("node", "salt").agg(*[f(c).alias(f"{f.__name__}_{c}") for f, c in ((F.min, "doc_id"), (F.min, "pick"), (F.min, "proof"), (F.max, "proof"))])
        classes = checkpointed(leaves.groupBy("node").agg(*[f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for f, c in ((F.min, "doc_id"), (F.min, "pick"), (F.min, "proof"), (F.max, "proof"))]))
        if not classes.filter(F.col("min_proof") != F.col("max_proof")).limit(1).count():
            break
        seed += 1
    maps = some.select("node", "n", "bitmap").dropDuplicates(["node"])
    groups = components(checkpointed(candidates(meetings(texts, words, threshold, seed), maps, threshold)))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    wanted = checkpointed(groups.join(sizes, "component").join(classes, "node").select("node", F.col("min_pick").alias("pick"), "component", "size"))
    # The texts are joined once; sets of large components are read again in each round.
    sets = checkpointed(sets_of(texts, wanted, words, seed))
    label = block_links(sets.filter(F.col("size") <= block), threshold, block).select(F.col("b").alias("node"), F.col("a").alias("root"))
    if wanted.filter(F.col("size") > block).limit(1).count():
        label = label.unionByName(joined_in_rounds(sets.filter(F.col("size") > block), threshold, block))
    of = checkpointed(classes.select("node", "min_doc_id").join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "min_doc_id"))
    told = of.select("node", "root").join(of.groupBy("root").agg(F.min("min_doc_id").alias("component_id")), "root").select("node", "component_id")
    salted = leaves.select("node", "salt").join(told, "node")
    return (
        some.join(salted, ["node", "salt"])
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .union(rows.filter(F.col("n") == 0).select("doc_id", "n", "doc_id"))
    )


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but for those whose component has a smaller doc_id. Verdicts hold for a
    doc_id: rows that repeat one stay or go together. A null doc_id is never dropped; an empty table stays empty."""
    found = jaccard_components(docs, words=words, percent=percent)
    drop = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
