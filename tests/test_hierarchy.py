"""mini_tree: the sample tree of the tree page, as an adjacency table."""

import random

from sparkvox.operators import hierarchy as HI

# (id, parent, checked, disabled); labels equal ids; key = position.
TREE = [
    ("child1", None, False, False), ("child1-1", "child1", True, True), ("child1-1-1", "child1-1", False, False),
    ("child1-1-2", "child1-1", False, False), ("child1-2", "child1", False, False), ("child2", None, False, False),
    ("child3", None, False, False), ("child3-1", "child3", True, False), ("child3-2", "child3", False, False),
    ("child3-3", "child3", False, False), ("child4", None, False, False), ("child4-1", "child4", False, False),
    ("child4-1-1", "child4-1", True, True), ("child4-1-2", "child4-1", False, False), ("child4-2", "child4", False, False),
    ("child4-3", "child4", False, False), ("child5", None, False, False), ("child6", None, False, False),
    ("child7", None, False, False),
]


def nodes(spark):
    rows = [(i, p, i, k, c, d) for k, (i, p, c, d) in enumerate(TREE)]
    return spark.createDataFrame(rows, "id string, parent_id string, label string, key long, checked boolean, disabled boolean")


def test_tree(spark):
    n = nodes(spark)
    walk = HI.tree_walk(n)
    paths = [r.path for r in HI.tree_paths(walk).orderBy("preorder_key").collect()]
    assert paths[:5] == ["child1", "child1/child1-1", "child1/child1-1/child1-1-1", "child1/child1-1/child1-1-2", "child1/child1-2"]
    assert len(paths) == len(TREE)  # pre-order, root left out
    flags = {r.id: (r.checked, r.disabled) for r in HI.tree_inherit_flags(walk).collect()}
    assert {k for k, v in flags.items() if v[0]} == {"child1-1", "child1-1-1", "child1-1-2", "child3-1", "child4-1-1"}
    assert flags["child1-1-2"][1] is True
    opened = {r.id for r in HI.tree_open_nodes(walk, HI.tree_marks(n)).collect() if r.open}
    assert opened == {"child1", "child1-1", "child1-1-1", "child1-1-2", "child3", "child3-1", "child4", "child4-1", "child4-1-1"}
    leaves = {r.id: r for r in HI.tree_leaves(walk, n).collect()}
    assert leaves["child2"].is_leaf and leaves["child2"].icon == "table" and leaves["child4"].icon == "folder"
    assert {r.selected_leaf for r in leaves.values() if r.selected_leaf} == {"child1-1-1", "child1-1-2", "child3-1", "child4-1-1"}


def plain_positions(rows):
    """(id, parent, key, checked, disabled) -> id: position, depth, checked, disabled, n_nodes, n_checked, open."""
    children = {}
    for r in rows:
        children.setdefault(r[1], []).append(r)
    out, todo = {}, [(r, 0, False, False) for r in sorted(children.get(None, []), key=lambda r: (r[2], r[0]), reverse=True)]
    order = []
    while todo:
        r, depth, c, d = todo.pop()
        c, d = c or r[3], d or r[4]
        out[r[0]] = [len(out), depth, c, d, 1, int(r[3])]
        order.append(r)
        todo += [(x, depth + 1, c, d) for x in sorted(children.get(r[0], []), key=lambda r: (r[2], r[0]), reverse=True)]
    for r in reversed(order):
        if r[1] is not None:
            out[r[1]][4] += out[r[0]][4]
            out[r[1]][5] += out[r[0]][5]
    return {i: (*v, v[2] or v[5] > 0) for i, v in out.items()}


def positions(spark, rows):
    n = spark.createDataFrame([(i, p, i, k, c, d) for i, p, k, c, d in rows], SCHEMA).repartition(4)
    found = HI.tree_positions(n).collect()
    got = {r.id: (r.position, r.depth, r.checked, r.disabled, r.n_nodes, r.n_checked, r.open) for r in found}
    assert len(got) == len(found)
    return got


def test_positions_of_the_sample(spark):
    rows = [(i, p, k, c, d) for k, (i, p, c, d) in enumerate(TREE)]
    got = positions(spark, rows)
    assert got == plain_positions(rows) and [i for i, _ in sorted(got.items(), key=lambda x: x[1][0])] == [i for i, *_ in TREE]


def test_positions_of_random_forests(spark):
    """Equal keys, orphans, cycles, and a parent of most nodes."""
    rng = random.Random(5)
    rows = [(f"n{k}", None if k < 3 else f"n{rng.randrange(k)}" if k % 3 else "n1", rng.randrange(5), rng.random() < 0.05, rng.random() < 0.05) for k in range(500)]
    lost = [("a", "b", 0, True, True), ("b", "a", 0, False, False), ("c", "b", 0, True, False), ("s", "s", 0, True, False),
            ("o", "gone", 0, True, False), ("p", "o", 0, True, True)]
    assert positions(spark, rows + lost) == plain_positions(rows)
    assert positions(spark, lost) == {} and positions(spark, rows[:1]) == plain_positions(rows[:1])


def test_chain_of_ten_thousand(spark, monkeypatch):
    depth, rounds = 10_000, []
    monkeypatch.setattr(HI, "scratch_path", lambda s, name, make=HI.scratch_path: rounds.append(name) or make(s, name))
    rows = [(f"n{i}", None if i == 0 else f"n{i - 1}", 0, i == 7000, i == 3) for i in range(depth)]
    n = spark.createDataFrame([(i, p, i, k, c, d) for i, p, k, c, d in rows], SCHEMA)
    got = {r.id: r for r in HI.tree_marks(n).collect()}
    assert len(rounds) <= 16
    assert all(got[f"n{i}"].depth == i and got[f"n{i}"].n_nodes == depth - i and got[f"n{i}"].checked == (i >= 7000)
               and got[f"n{i}"].n_checked == (i <= 7000) and got[f"n{i}"].disabled == (i >= 3) for i in range(depth))


def test_paths_beside_cycles(spark):
    """Paths of nodes in a cycle are not built."""
    rows = [("a", None), ("b", "a"), ("x", "y"), ("y", "x")] + [(f"n{k}", None) for k in range(2000)]
    n = spark.createDataFrame([(i, p, i * 50, k, False, False) for k, (i, p) in enumerate(rows)], SCHEMA)
    got = {r.id: r.path for r in HI.tree_walk(n).collect()}
    assert len(got) == 2002 and got["b"] == "a" * 50 + "/" + "b" * 50


def test_nothing(spark):
    n = spark.createDataFrame([], SCHEMA)
    assert HI.tree_walk(n).collect() == [] and HI.tree_positions(n).collect() == []


SCHEMA = "id string, parent_id string, label string, key long, checked boolean, disabled boolean"


def test_lost_nodes_are_named(spark):
    rows = [("a", None), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("o", "gone"), ("p", "o")]
    n = spark.createDataFrame([(i, p, i, k, False, False) for k, (i, p) in enumerate(rows)], SCHEMA)
    walk = HI.tree_walk(n)
    assert {r.id for r in walk.collect()} == {"a", "b"}
    lost = {r.id: r.reason for r in HI.tree_unreached(n, walk).collect()}
    assert lost.pop("o") == "orphan" and set(lost) == {"x", "y", "z", "p"} and len(set(lost.values())) == 1


def test_deep_chain(spark):
    depth = 40
    rows = [(f"n{i}", None if i == 0 else f"n{i - 1}", f"n{i}", i, i == 3, False) for i in range(depth)]
    n = spark.createDataFrame(rows, "id string, parent_id string, label string, key long, checked boolean, disabled boolean")
    walk = HI.tree_walk(n)
    got = {r.id: (r.depth, r.checked) for r in walk.collect()}
    assert len(got) == depth and got["n39"] == (39, True) and got["n2"] == (2, False)
    assert HI.tree_paths(walk).filter("id = 'n39'").first().path == "/".join(f"n{i}" for i in range(depth))
