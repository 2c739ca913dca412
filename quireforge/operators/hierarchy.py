"""Parent-child rows to full hierarchies, as nested sets.

Sizes travel upward and preorder ranges downward by pointer doubling: round k looks 2^k links ahead, so a chain of
depth d takes log2(d) rounds instead of d, and no tree is ever gathered in one task. Rows that no round finishes lie on
a circle or hang below one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch

RANGE_BLOCK = 1024
"""Preorder positions whose ids are kept together when descendants are looked up by range."""


class Hierarchy:
    """nodes: id, parent_id (of an existing row, else null), dangling; circular: ids on a circle; below: ids hanging
    below one; tree: the finished rows with lft, rgt, size, depth, root_id, path."""

    def __init__(self, nodes: DataFrame, circular: DataFrame, below: DataFrame, tree: DataFrame | None):
        self.nodes, self.circular, self.below, self.tree = nodes, circular, below, tree


def _nodes(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null")
    one = rows.groupBy("id").agg(F.min("parent").alias("parent"))
    known = one.select(F.col("id").alias("at"), F.lit(True).alias("known"))
    # Rows without parent look for themselves, so that they do not meet in one place.
    return one.withColumn("at", F.coalesce("parent", "id")).join(known, "at", "left").select(
        "id",
        F.when(F.col("known"), F.col("parent")).alias("parent_id"),
        (F.col("parent").isNotNull() & F.col("known").isNull()).alias("dangling"),
    )


def _sizes(s: Scratch, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, size) of all rows, exact for those above no circle, and (id, up) of the rows that never end at a root."""
    state = s.cut(nodes.select("id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("size")))
    left, image = None, None
    while True:
        active = state.where("up is not null")
        now, now_image = active.agg(F.count("*"), F.count_distinct("up")).first()
        # Fewer rows stay active in every round until only those with a circle above them are left; their images
        # shrink until just the circles remain, and equal images of 2^k and 2^(k+1) steps mean that they have.
        if now == 0 or (left is not None and now == left and now_image == image):
            break
        left, image = now, now_image
        gained = active.groupBy(F.col("up").alias("id")).agg(F.try_sum("size").alias("more"))
        hop = active.select(F.col("id").alias("at"), F.col("up").alias("next"))
        # Finished rows look for themselves among the active ones: they find nothing, each in a place of its own.
        stepped = state.join(gained, "id", "left").withColumn("at", F.coalesce("up", "id")).join(hop, "at", "left")
        # Sums of rows on a circle never end; past the range of numbers they become null, as they are not used.
        fresh = s.cut(stepped.select("id", F.col("next").alias("up"), F.try_add("size", F.coalesce("more", F.lit(0))).alias("size")))
        s.drop(state)
        state = fresh
    return state.select("id", "size"), state.where("up is not null").select("id", "up")


def _offsets(s: Scratch, tree: DataFrame) -> DataFrame:
    """Offset of each row's preorder position from its parent's: 1 + sizes of the earlier siblings, by id.

    Siblings are dealt out in order of (parent, id) to ranges of about equal numbers of rows, whatever the ids are; sums
    go over the ranges of a parent first and then inside each."""
    n = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kids = tree.where("parent_id is not null").select("id", "parent_id", "size").repartitionByRange(n, "parent_id", "id")
    kids = s.cut(kids.withColumn("block", F.spark_partition_id()))
    per_block = kids.groupBy("parent_id", "block").agg(F.sum("size").alias("total"))
    over = Window.partitionBy("parent_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select("parent_id", "block", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("parent_id", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = kids.withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["parent_id", "block"])
    cols = ["id", "parent_id", "size"]
    return placed.select(*cols, (F.lit(1) + F.col("before") + F.col("earlier")).alias("offset")).unionByName(
        tree.where("parent_id is null").select(*cols, F.lit(0).cast("long").alias("offset"))
    )


def _walk_down(s: Scratch, offsets: DataFrame) -> DataFrame:
    up = F.col("parent_id")
    state = s.cut(
        offsets.select(
            "id", "parent_id", "size", up.alias("up"), F.coalesce(up, "id").alias("root_id"), F.col("offset").alias("pre"),
            F.when(up.isNull(), 0).otherwise(1).alias("depth"),
            F.when(up.isNull(), F.array("id")).otherwise(F.array(up, "id")).alias("path"),
        )
    )
    while state.where("up is not null").limit(1).count():
        far = state.select(
            F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"), F.col("pre").alias("pre2"),
            F.col("depth").alias("depth2"), F.col("path").alias("path2"),
        )
        moved = state.where("up is not null").join(far, "up").select(
            "id", "parent_id", "size", F.col("up2").alias("up"), F.col("root2").alias("root_id"), (F.col("pre") + F.col("pre2")).alias("pre"),
            (F.col("depth") + F.col("depth2")).alias("depth"),
            F.concat("path2", F.slice("path", 2, F.size("path"))).alias("path"),
        )
        fresh = s.cut(state.where("up is null").unionByName(moved))
        s.drop(state)
        state = fresh
    return state.select(
        "id", "parent_id", "root_id", "depth", "size",
        (F.col("pre") + 1).alias("lft"), (F.col("pre") + F.col("size")).alias("rgt"), "path",
    )


def build_hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", tree: bool = True) -> Hierarchy:
    """Full hierarchies from parent-child rows.

    A row's range is [lft, rgt] within its root, its own preorder position first; rgt - lft + 1 = size. Null ids are
    left out. Of rows with the same id the smallest non-null parent counts. A parent that is no row makes the row a
    root with ``dangling`` set. An empty table gives empty results. Other columns are ignored.
    """
    s = Scratch(df.sparkSession, "hierarchy")
    nodes = s.cut(_nodes(df, id_col, parent_col))
    sizes, stuck = _sizes(s, nodes)
    circular = stuck.select(F.col("up").alias("id")).distinct()
    below = stuck.select("id").join(circular, "id", "left_anti")
    if not tree:
        return Hierarchy(nodes, circular, below, None)
    sound = nodes.join(stuck.select("id"), "id", "left_anti").join(sizes, "id")
    return Hierarchy(nodes, circular, below, _walk_down(s, _offsets(s, sound)))


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant_id, distance) by range: ids of each root are kept in blocks of preorder positions, and each row
    reads the blocks that its range covers, so the work follows the result and no tree is paired with itself."""
    block = F.floor((F.col("lft") - 1) / RANGE_BLOCK)
    blocks = tree.groupBy("root_id", block.alias("block")).agg(F.collect_list(F.struct("lft", "id", "depth")).alias("held"))
    span = F.sequence(F.floor(F.col("lft") / RANGE_BLOCK), F.floor((F.col("rgt") - 1) / RANGE_BLOCK))
    asked = tree.where("rgt > lft").select("id", "root_id", "lft", "rgt", "depth", F.explode(span).alias("block"))
    inside = asked.join(blocks, ["root_id", "block"]).select(
        "id", "depth", F.explode(F.filter("held", lambda x: (x["lft"] > F.col("lft")) & (x["lft"] <= F.col("rgt")))).alias("d")
    )
    return inside.select("id", F.col("d.id").alias("descendant_id"), (F.col("d.depth") - F.col("depth")).alias("distance"))


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance), the nearest at distance 1: the ranges that hold a row's position."""
    return descendants(tree).select(F.col("descendant_id").alias("id"), F.col("id").alias("ancestor_id"), "distance")


def labelled_paths(tree: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "title", sep: str = " > ") -> DataFrame:
    """tree with ``label_path``: the labels from the root down, joined by sep; a null label counts as empty."""
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("at_id")).agg(F.min(label_col).alias("label"))
    steps = tree.select("id", F.posexplode("path").alias("at", "at_id")).join(named, "at_id", "left")
    joined = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("label", F.lit("")).alias("label")))).alias("steps"))
    return tree.join(joined.select("id", F.array_join(F.transform("steps", lambda x: x["label"]), sep).alias("label_path")), "id")
