import random

import pytest

from quireforge.operators import hierarchy as h

SCHEMA = "id long, parent_id long, lft int, path string"


def build(spark, rows, **kw):
    return h.build_hierarchy(spark.createDataFrame([(a, b, None, "x") for a, b in rows], SCHEMA), **kw)


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            old = parent.get(i)
            parent[i] = p if old is None else old if p is None else min(old, p)
    parent = {i: p if p in parent else None for i, p in parent.items()}
    circle, tree = set(), {}
    for i in parent:
        path, at = [i], parent[i]
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            tree[i] = path[::-1]
        elif at == i:
            circle.add(i)
    return parent, circle, tree


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, rng.randrange(1, 90), rng.randrange(max(1, i - 3), i + 1), 999])) for i in range(1, 80)]
    rows += rows[:5]
    parent, circle, tree = brute(rows)
    got = build(spark, rows)
    assert set(ids(got.circular)) == circle
    assert set(ids(got.below)) == set(parent) - circle - set(tree)
    rows_ = {r["id"]: r for r in got.tree.collect()}
    assert {i: list(r["path"]) for i, r in rows_.items()} == tree
    below = {i: {j for j, p in tree.items() if i in p and j != i} for i in tree}
    assert all(r["depth"] == len(tree[i]) - 1 and r["root_id"] == tree[i][0] and r["size"] == len(below[i]) + 1 for i, r in rows_.items())
    # Ranges nest: a descendant's lies inside, and positions of a root are 1 to its size.
    assert all((rows_[i]["lft"] < rows_[j]["lft"] <= rows_[j]["rgt"] <= rows_[i]["rgt"]) for i in below for j in below[i])
    for root in {r["root_id"] for r in rows_.values()}:
        assert sorted(r["lft"] for r in rows_.values() if r["root_id"] == root) == list(range(1, rows_[root]["size"] + 1))
    pairs = {(r[0], r[1]) for r in h.descendants(got.tree).select("id", "descendant_id").collect()}
    assert pairs == {(i, j) for i in below for j in below[i]}
    assert {(r[1], r[0]) for r in h.ancestors(got.tree).select("id", "ancestor_id").collect()} == pairs


def test_ancestors_by_range_alone(spark):
    tree = build(spark, [(1, None), (2, 1), (3, 2), (4, 2), (5, None)]).tree.drop("path")
    assert sorted(tuple(r) for r in h.ancestors(tree).select("id", "ancestor_id", "distance").collect()) == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 2), (4, 2, 1)]


def test_long_chain_and_wide_parent(spark):
    rows = [(1, None)] + [(i, i - 1) for i in range(2, 400)] + [(10_000 + i, 1) for i in range(9000)]
    got = build(spark, rows)
    assert got.circular.count() == 0
    top = got.tree.where("id = 1").first()
    assert (top["size"], top["lft"], top["rgt"]) == (9399, 1, 9399)
    assert got.tree.where("id = 399").first()["depth"] == 398
    assert got.tree.select("lft").distinct().count() == 9399


def test_circles(spark):
    got = build(spark, [(1, 1), (2, 3), (3, 4), (4, 2), (5, 4), (6, 5), (7, None), (8, 7), (9, 77)])
    assert ids(got.circular) == [1, 2, 3, 4] and ids(got.below) == [5, 6] and ids(got.tree) == [7, 8, 9]
    assert ids(got.nodes.where("dangling")) == [9]


def test_long_tail_below_a_circle(spark):
    rows = [(1, 2), (2, 1)] + [(i, i - 1) for i in range(3, 60)]
    got = build(spark, rows)
    assert ids(got.circular) == [1, 2] and got.below.count() == 57 and got.tree.count() == 0


def test_empty_and_null_ids(spark):
    got = build(spark, [])
    assert got.circular.count() == got.tree.count() == h.descendants(got.tree).count() == 0
    got = build(spark, [(None, None), (None, 3), (3, None)])
    assert ids(got.tree) == [3]


def test_labels(spark):
    df = spark.createDataFrame([(1, None, "A"), (2, 1, None), (3, 2, "C"), (3, 2, "C")], "id long, parent_id long, title string")
    got = h.labelled_paths(h.build_hierarchy(df).tree, df)
    assert {r["id"]: r["label_path"] for r in got.collect()} == {1: "A", 2: "A > ", 3: "A >  > C"}
