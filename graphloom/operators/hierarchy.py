"""Parent-child links to full hierarchies.

Links become trees in a number of rounds that grows with the logarithm of the depth. A round doubles the distance
over which each node sees: subtree sizes flow upward, then sibling ranges (prefix sums of those sizes) are
handed downward, which gives every node a nested-set range with its root and depth. Nodes that no round processes lie on a
loop or below one. Nodes that are finished stay where they are written; only those still on their way are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize, release

#: Fixed values of the data model: relation types written from parent to child, and the one written upward.
DOWNWARD = (
    "has_campus", "has_college", "has_sub_college", "has_department", "has_centre",
    "has_directorate", "has_facility", "has_admission", "offers_program",
)
UPWARD = ("belongs_to",)

#: An ancestor with more than this share of the rows is joined apart. At most 1 / HOT_SHARE ancestors can have it.
HOT_SHARE = 1 / 200


def relation_name(raw: Column) -> Column:
    """A carelessly written relation type in its plain form: lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")


def present(identifier: Column) -> Column:
    """Whether an id refers to anything; null and empty ids do not."""
    return identifier.isNotNull() & (identifier != "")


def hierarchy_links(relationship: DataFrame, downward: tuple = DOWNWARD, upward: tuple = UPWARD) -> DataFrame:
    """Columns child, parent of the hierarchy rows; either may be null where the row names only one end.

    Repeated rows count once. Extra columns are ignored.
    """
    kind = relation_name(F.col("relation_type"))
    up = kind.isin(*upward)
    end = lambda name: F.when(present(F.col(name)), F.col(name))
    return (
        relationship.filter(kind.isin(*downward, *upward))
        .select(
            F.when(up, end("source_id")).otherwise(end("target_id")).alias("child"),
            F.when(up, end("target_id")).otherwise(end("source_id")).alias("parent"),
        )
        .distinct()
    )


def _starting_state(links: DataFrame) -> DataFrame:
    """One row per node: id, parent, and as anc the ancestor one step above."""
    # One aggregation gives nodes and parents: each link says (child, parent) and (parent, nothing).
    said = links.select(F.explode(F.array(
        F.struct(F.col("child").alias("id"), F.col("parent").alias("parent")),
        F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")),
    )).alias("x")).select("x.*")
    return said.filter("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"))


def _above(active: DataFrame, state: DataFrame, carry: list[str], total: int, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(active with the columns up_* of the row of state that anc names, one row per named ancestor with what is below it).

    What is below an ancestor is counted before the exchange: n rows, and `more`, their summed size, if a size is given. So
    the ancestors named by very many rows are known; they are few and broadcast, the others are joined by key.
    """
    sums = [F.sum(size).alias("more")] if size else []
    below = active.groupBy("anc").agg(F.count("*").alias("n"), *sums)
    up = below.select("anc", "n").join(state.select(F.col("id").alias("anc"), *[F.col(c).alias(f"up_{c}") for c in carry]), "anc", "left")
    bound = F.lit(max(1000.0, total * HOT_SHARE))
    hot, cold = up.filter(F.col("n") > bound).drop("n"), up.filter(F.col("n") <= bound).drop("n")
    return active.join(F.broadcast(hot), "anc").unionByName(active.join(cold, "anc")), below


def subtree_sizes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent, size of the nodes of trees, id, parent of those that no round processed).

    size: rows of the subtree, the node itself included. If a node has several parents in links, the smallest counts.
    """
    state = materialize(_starting_state(links).select("id", "parent", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")))
    total, before = state.count(), None
    while (left := state.filter("anc IS NOT NULL").count()) and left != before:
        # Depths have no gaps: if a round finishes no node, no deeper one exists, and the rest hang on loops.
        before, old = left, state
        moved, below = _above(state.filter("anc IS NOT NULL"), state, ["anc"], total, "size")
        now = state.filter("anc IS NULL").unionByName(moved.select("id", "parent", F.col("up_anc").alias("anc"), "size"))
        grown = now.join(below.select(F.col("anc").alias("id"), "more"), "id", "left")
        state = materialize(grown.select("id", "parent", "anc", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        release(old)
    return state.filter("anc IS NULL").select("id", "parent", "size"), state.filter("anc IS NOT NULL").select("id", "parent")


def loop_roots(links: DataFrame) -> DataFrame:
    """Columns id, root (smallest id of the loop reached), of nodes whose every upward walk ends in a loop."""
    state = materialize(links.withColumn("anc", F.col("parent")))
    total, image = state.count(), None
    while (now := state.select("anc").distinct().count()) != image:
        # The image of the doubled walk shrinks until only nodes on loops are left in it.
        image, old = now, state
        state = materialize(_above(state, state, ["anc"], total)[0].select("id", "parent", F.col("up_anc").alias("anc")))
        release(old)
    on_loop = state.select(F.col("anc").alias("id")).distinct()
    ring = materialize(state.join(on_loop, "id", "left_semi").select("id", F.col("parent").alias("anc"), F.col("id").alias("low")))
    changed = ring.count()
    while changed:
        old = ring
        following = ring.select(F.col("id").alias("anc"), F.col("anc").alias("up_anc"), F.col("low").alias("up_low"))
        ring = materialize(ring.join(following, "anc").select(
            "id", F.col("up_anc").alias("anc"), F.least("low", "up_low").alias("low"), (F.col("up_low") < F.col("low")).alias("fell")
        ))
        changed = ring.filter("fell").count()
        release(old)
    return state.join(ring.select(F.col("id").alias("anc"), F.col("low").alias("root")), "anc").select("id", "root")


def sibling_offsets(nodes: DataFrame, buckets: int = 64) -> DataFrame:
    """nodes (id, parent, size) that have a parent, with offset: the summed subtree sizes of the siblings before each.

    Siblings are ordered by a hash bucket, then by id, so that a parent of very many children is summed in pieces.
    """
    kids = nodes.filter("parent IS NOT NULL").select("id", "parent", "size", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    before = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = kids.groupBy("parent", "bucket").agg(F.sum("size").alias("sum")).select("parent", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("parent", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = kids.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inside.join(starts, ["parent", "bucket"]).select("id", "parent", "size", (F.col("start") + F.col("inside")).alias("offset"))


def nested_sets(links: DataFrame, paths: bool = True) -> DataFrame:
    """Columns id, root, depth, path (ids from the root to the node), lft, rgt, descendants of every node.

    Within a root, node b lies below node a if a.lft < b.lft <= a.rgt. Nodes on a loop or below one have depth -1, as root
    the smallest id on the loop, and null path and range. Without paths there is no column path. An empty input gives no rows.
    """
    trees, stray = subtree_sizes(links)
    path = ["path"] if paths else []
    roots = trees.filter("parent IS NULL").select("id", F.lit(None).cast("string").alias("anc"), F.col("id").alias("root"), F.lit(0).alias("depth"), "size", F.lit(0).cast("long").alias("lft"))
    # On its way a node's lft and depth are those below anc; they become those below its root.
    kids = sibling_offsets(trees).select("id", F.col("parent").alias("anc"), F.col("parent").alias("root"), F.lit(1).alias("depth"), "size", (F.col("offset") + 1).alias("lft"))
    state = materialize(roots.unionByName(kids).select("*", *[F.array("id").alias(p) for p in path]))
    total = state.count()
    finished, active = state.filter("anc IS NULL"), state.filter("anc IS NOT NULL")
    while active.limit(1).count():
        moved, _ = _above(active, finished.unionByName(active), ["anc", "root", "depth", "lft", *path], total)
        # Only nodes on their way are written again; those that arrive are kept as one more part.
        round_ = materialize(moved.select(
            "id", F.col("up_anc").alias("anc"), F.col("up_root").alias("root"), (F.col("depth") + F.col("up_depth")).alias("depth"), "size", (F.col("lft") + F.col("up_lft")).alias("lft"),
            *[F.concat(f"up_{p}", p).alias(p) for p in path],
        ))
        finished, active = finished.unionByName(round_.filter("anc IS NULL")), round_.filter("anc IS NOT NULL")
    ranged = finished.select("id", "root", "depth", *path, "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("descendants"))
    if not stray.limit(1).count():
        return ranged
    kinds = {"path": "array<string>", "lft": "long", "rgt": "long", "descendants": "long"}
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in (*path, "lft", "rgt", "descendants")]
    return ranged.unionByName(loop_roots(stray).select("id", "root", F.lit(-1).alias("depth"), *nothing))


def descendants(tree: DataFrame, of: DataFrame, width: int = 1024) -> DataFrame:
    """Columns ancestor, id, distance: every node of tree (from nested_sets) below each id of `of` (column id).

    The nested-set ranges of `of` are cut into stretches of `width` places and met stretch by stretch, so a tree of any
    size is spread over as many keys, and nodes outside a range's stretches are never compared with it.
    """
    top = tree.join(of.select("id").distinct(), "id", "left_semi").filter("depth >= 0 AND descendants > 0").select(
        F.col("root").alias("top_root"), F.col("id").alias("ancestor"), F.col("lft").alias("from"), F.col("rgt").alias("to"), F.col("depth").alias("top_depth")
    )
    piece = lambda c: F.floor(c / width)
    pieces = top.withColumn("piece", F.explode(F.sequence(piece(F.col("from") + 1), piece(F.col("to")))))
    placed = tree.filter("depth >= 0").withColumn("at_piece", piece(F.col("lft")))
    inside = (F.col("root") == F.col("top_root")) & (F.col("at_piece") == F.col("piece")) & (F.col("lft") > F.col("from")) & (F.col("lft") <= F.col("to"))
    return placed.join(pieces, inside).select("ancestor", "id", (F.col("depth") - F.col("top_depth")).alias("distance"))


def found(relationship: DataFrame) -> DataFrame:
    """Columns node_id, root_id, depth of every non-empty id in a hierarchy row, as the nested sets have them."""
    tree = nested_sets(hierarchy_links(relationship), paths=False)
    return tree.select(F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))
