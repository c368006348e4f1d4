import random

import numpy as np
import pytest

from cliploom.llm import jaccard_join as J

from .brute import jaccard_components


def rows_of(df, **how):
    return sorted((tuple(r) for r in J.jaccard_components(df, **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(seed, groups, copies, length):
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{draw.randrange(4000)}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randrange(0, max(2, length // 25))):
                text[draw.randrange(length)] = f"e{draw.randrange(10**6)}"
            rows.append(" ".join(text[draw.randrange(0, 3) :]))
    draw.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 256), (5, 80, 7), (3, 60, 3)])
def test_same_as_brute_force(spark, words, percent, block):
    rows = [r for n, length in enumerate((5, 9, 14, 30, 120, 400)) for r in near_copies(n, 4, 12, length)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(df, words=words, percent=percent, block=block) == sorted(jaccard_components(rows, words, percent), key=str)


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = [(d, n, c if n else d) for d, n, c in jaccard_components(rows, 4, 85)]
    assert rows_of(edge_docs) == sorted(want, key=str)
    assert rows_of(no_docs) == []


@pytest.mark.parametrize("block", [256, 2])
def test_repeated_and_null_ids_keep_their_links(spark, block):
    """An id with several texts links by each of them; rows without an id link others and get their component's id."""
    draw = random.Random(1)
    base = {k: [f"{k}{draw.randrange(900)}" for _ in range(80)] for k in "ABCD"}
    near = lambda k, *at: " ".join("x" if i in at else w for i, w in enumerate(base[k]))
    rows = [(5, near("A")), (5, near("B")), (2, near("A", 3)), (3, near("B", 70)), (None, near("C")), (9, near("C", 0)), (None, near("D")), (None, near("D", 79)), (4, near("A", 3, 79))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(df, block=block)
    assert got == sorted(jaccard_components(rows, 4, 85), key=str)
    assert [c for d, _, c in got if d == 5] == [2, 3]


def test_parts_of_a_large_component_are_joined_once_more(spark):
    """Chains whose ends are apart, and sets in between that only the last step joins: blocks of two against one tree."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[:i] + [f"e{j}" for j in range(i)] + words[i:]) for i in range(0, 30)]
    rows = [(i, t) for i, t in enumerate(chain + [c + " z" for c in chain])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(jaccard_components(rows, 4, 85), key=str)
    assert rows_of(df, block=2) == rows_of(df) == want


def test_documents(docs2):
    rows = [(r.doc_id, r.text) for r in docs2.orderBy("doc_id").limit(400).collect()]
    df = docs2.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(df) == sorted(jaccard_components(rows, 4, 85), key=str)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_signatures_never_miss(percent):
    """Sets that are linked agree in a part, also at the bound."""
    draw = np.random.default_rng(percent)
    t = J.Threshold(percent)
    for _ in range(300):
        a = int(draw.integers(2, 150))
        both = np.unique(draw.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        b = int(draw.integers(a, 100 * a // percent + 1))
        shared = t.needed(a, b)
        if shared > a:
            continue
        draw.shuffle(both)
        x = np.sort(both[:a])
        y = np.sort(np.r_[both[:shared], both[a : a + b - shared]])
        assert 100 * shared >= percent * (a + b - shared)
        if len(x) == len(y) and (x == y).all():
            continue
        one, two = J.signatures([x], t)[0], J.signatures([y], t)[0]
        assert len(np.intersect1d(one, two)) > 0
        maps = J.Maps([J.bitmap(x).tobytes(), J.bitmap(y).tobytes()])
        assert maps.apart(np.array([0]), np.array([1]))[0] <= t.apart(a + b)


def test_tree_joins_what_is_linked():
    draw = np.random.default_rng(3)
    base = np.sort(draw.integers(0, 1 << 40, 60).astype(np.uint64))
    sets = list({tuple(np.sort(np.r_[draw.permutation(base)[: int(draw.integers(50, 61))], draw.integers(0, 1 << 40, int(draw.integers(0, 5))).astype(np.uint64)])) for _ in range(60)})
    sets = [np.array(s, np.uint64) for s in sets]
    t = J.Threshold(85)

    def roots(links):
        parent = list(range(len(sets)))
        for a, b in links:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[a] = b
        return [next(iter([x for x in [_root(parent, i)]])) for i in range(len(sets))]

    def _root(parent, i):
        while parent[i] != i:
            i = parent[i]
        return i

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    same = lambda links: [[a == b for b in roots(links)] for a in roots(links)]
    assert same(J.tree_links(sets, t)) == same(every)


def test_stage_keeps_columns(edge_docs):
    out = J.one_of_each(edge_docs)
    assert out.columns == edge_docs.columns
    ids = sorted(str(r.doc_id) for r in out.collect())
    assert ids == sorted(["1", "1", "3", "4", "5", "6", "7", "8", "10", "11", "None", "None", "None"])


@pytest.mark.parametrize("first", [None, 1500])
def test_tree_with_a_path_longer_than_the_call_stack(first):
    """Thousands of one-word edits of one text of 5,000 words: one component, also block against block."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    shingles = J.Shingles(4)
    sets = []
    for i in range(3000):
        at = draw.randrange(5000)
        sets.append(shingles.set_of(" ".join([*words[:at], f"e{i}", *words[at + 1 :]])))
    links = J.tree_links(sets, J.Threshold(85), first)
    assert len(J.stars(np.arange(len(sets)), links)) == len(sets) - 1


def test_tree_with_a_long_path_of_sets_apart():
    """Sets that each leave a shared path one step later: the tree is as deep as there are sets, joined or not."""
    path = np.arange(1200, dtype=np.uint64) * np.uint64(1000)
    sets = [np.r_[path[: i + 1], path[i] + np.uint64(1) + np.arange(1, dtype=np.uint64)] for i in range(1200)]
    tree = J.Tree(sets, J.Threshold(85))
    for row in range(len(sets)):
        tree.add(row)
    root = next(iter(tree.roots.values()))
    assert tree.joined(root) == -1
    for row in range(1, len(sets)):
        tree.parent[tree.find(row)] = tree.find(0)
        assert (tree.joined(root) == tree.find(0)) == (row == len(sets) - 1)
