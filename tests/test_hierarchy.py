import random

import pytest

from graphloom.operators import hierarchy, references

SCHEMA = "source_id string, target_id string, relation_type string, rel_id long, seen_at timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(s, t, r, i, None) for i, (s, t, r) in enumerate(rows)], SCHEMA)


def by_hand(parents, nodes):
    """Depths and roots by walking up from every node."""
    out = {}
    for n in nodes:
        seen, at, d = [], n, 0
        while at in parents and at not in seen:
            seen.append(at)
            at, d = parents[at], d + 1
        if at in seen:
            out[n] = (min(seen[seen.index(at):]), -1)
        else:
            out[n] = (at, d)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_depths_and_loops_as_by_walking(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i:03}" for i in range(120)]
    parents = {n: rnd.choice(nodes if rnd.random() < 0.15 else nodes[:max(1, i // 2)]) for i, n in enumerate(nodes) if i and rnd.random() < 0.9}
    rows = [(p, c, rnd.choice(["has_centre", " HAS-Centre", "offers program"])) if rnd.random() < 0.7 else (c, p, "Belongs_To") for c, p in parents.items()]
    rows += rows[:20] + [("a", None, "has_centre"), (None, "b", "has_centre"), ("", "c", "has_centre"), ("x", "y", "admission_governs")]
    got = {r.node_id: (r.root_id, r.depth) for r in hierarchy.found(frame(spark, rows)).collect()}
    assert got == by_hand(parents, {x for cp in parents.items() for x in cp} | {"a", "b", "c"})


def test_nested_sets_describe_the_trees(spark):
    rows = [("r", f"k{i}", "has_college") for i in range(5)] + [(f"k{i}", f"k{i}{j}", "has_department") for i in range(5) for j in range(i)] + [("k40", f"deep{0}", "has_centre")]
    rows += [(f"deep{i}", f"deep{i + 1}", "has_centre") for i in range(40)] + [("l1", "l2", "has_centre"), ("l2", "l1", "has_centre"), ("self", "self", "has_centre")]
    tree = hierarchy.nested_sets(hierarchy.hierarchy_links(frame(spark, rows)))
    t = {r.id: r for r in tree.collect()}
    assert t["deep40"].depth == 43 and len(t["deep40"].path) == 44
    assert (t["l2"].root, t["l2"].depth, t["self"].root) == ("l1", -1, "self")
    whole = [r for r in t.values() if r.root == "r"]
    assert sorted(r.lft for r in whole) == list(range(len(whole)))
    for a in whole:
        below = {b.id for b in whole if a.lft < b.lft <= a.rgt}
        assert below == {b.id for b in whole if a.id in b.path[:-1]} and len(below) == a.descendants
    top = spark.createDataFrame([("k4",)], "id string")
    assert {r.id for r in hierarchy.descendants(tree, top).collect()} == {b.id for b in whole if "k4" in b.path[:-1]}
    pairs = {(r.ancestor, r.id, r.distance) for r in hierarchy.descendants(tree, tree.select("id"), width=3).collect()}
    assert pairs == {(a, r.id, r.depth - i) for r in t.values() if r.path for i, a in enumerate(r.path[:-1])}


def test_references_by_kind(spark):
    e = spark.createDataFrame([("a", "2024-01-05", None), ("a", "2024-03-01", "2024-06-01"), ("b", "2024-02-01", None), (None, "2024-01-01", None)], "id string, s string, r string").selectExpr("id", "cast(s as timestamp) scraped_at", "cast(r as timestamp) removed_at")
    rel = spark.createDataFrame(
        [(1, "a", "b", "2024-02-02"), (2, "a", "zz", "2024-07-01"), (3, "b", "", "2024-01-15"), (4, None, "a", "2024-06-01"), (5, "A", "a", None)], "rel_id long, source_id string, target_id string, s string"
    ).selectExpr("*", "cast(s as timestamp) seen_at")
    got = {tuple(r) for r in references.found(rel, e).collect()}
    assert got == {(2, "source_id", "removed"), (2, "target_id", "missing"), (3, "source_id", "late"), (4, "target_id", "removed"), (5, "source_id", "missing")}
    report = {(r.ref_field, r.month): (r.refs, r.missing, r.late, r.removed) for r in references.report(rel, e).collect()}
    assert report["source_id", None] == (1, 1, 0, 0) and report["target_id", "2024-07"] == (1, 1, 0, 0)
