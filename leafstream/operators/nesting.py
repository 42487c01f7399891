"""Element trees from begin and end marks, by windows only.

An end pops one element whatever its type; an end on an empty stack does nothing.  With S the running
sum of +1 and -1, the stack's height is S less the running minimum of S below 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Shelf


def nested(log: DataFrame, keys: list[str], order: list[str], begin: Column, end: Column, node_id: str) -> DataFrame:
    """depth (height before the row) and parent (node_id of the innermost open element, or null)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(begin, 1).when(end, -1).otherwise(0)
    heights = log.withColumns({"__step": step, "__s": F.sum(step).over(by)})
    heights = heights.withColumn("__h", F.col("__s") - F.least(F.lit(0), F.min("__s").over(by)))
    heights = heights.withColumn("depth", F.lag("__h", 1, 0).over(by))
    # the parent of a row at height d is the last begin that raised the stack to d
    level = F.col("depth")
    need = heights.withColumns({"__key": level, "__give": F.lit(None).cast(log.schema[node_id].dataType), "__row": F.lit(True)})
    give = heights.where("__step = 1").withColumns({"__key": F.col("__h"), "__give": F.col(node_id), "__row": F.lit(False)})
    both = need.unionByName(give)
    up = Window.partitionBy(*keys, "__key").orderBy(*order, F.col("__row").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("parent", F.last("__give", ignorenulls=True).over(up)).where("__row")
    out = out.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))
    return out.drop("__step", "__s", "__h", "__key", "__give", "__row")


def subtrees(log: DataFrame, keys: list[str], order: list[str], begin: Column, end: Column, node_id: str, behind: Column) -> DataFrame:
    """For every element: nodes (rows from its begin to its end) and end_offset (the largest behind of them).

    An element that nothing closes runs to the key's last row.  The closing row is found by a window
    at its level, the counts by running row numbers: no row meets its ancestors.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(begin, 1).when(end, -1).otherwise(0)
    rows = log.withColumns({"__step": step, "__s": F.sum(step).over(by), "__rn": F.row_number().over(by), "__behind": behind})
    rows = rows.withColumn("__h", F.col("__s") - F.least(F.lit(0), F.min("__s").over(by)))
    rows = rows.withColumns({"__before": F.lag("__h", 1, 0).over(by), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "__all": F.max("__behind").over(Window.partitionBy(*keys))})
    marks = rows.where((F.col("__step") == 1) | ((F.col("__step") == -1) & (F.col("__before") > 0))).withColumn("__level", F.greatest("__h", "__before"))
    at = Window.partitionBy(*keys, "__level").orderBy(*order)
    spans = marks.withColumns({"__end": F.lead("__rn").over(at), "__to": F.lead("__behind").over(at)}).where("__step = 1")
    return spans.select(*keys, node_id, F.col("__before").alias("depth"), (F.coalesce("__end", "__n") - F.col("__rn") + 1).cast("long").alias("nodes"), F.coalesce("__to", "__all").alias("end_offset"))


def with_paths(tree: DataFrame, keys: list[str], node_id: str, levels: int | None = None) -> DataFrame:
    """path: the ancestors from the root down (levels: the tree's height, counted if not given).

    By doubling: a row knows the ancestors up to 1, 2, 4, ... levels above; each round puts those of its furthest one before
    them, so a tree of height 10,000 takes 14 joins.  A round's pieces of paths are a table in the shared folder.
    """
    levels = (tree.agg(F.max("depth")).first()[0] or 0) if levels is None else levels
    kind = tree.schema[node_id].dataType.simpleString()
    start = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast(f"array<{kind}>"))
    now = tree.select(*keys, F.col(node_id).alias("__n"), F.col("parent").alias("__far"), start.alias("path"))
    with Shelf(tree.sparkSession) as shelf:
        for _ in range(max(levels - 1, 0).bit_length()):
            now, last = shelf.put(now), now
            up = now.where("__n IS NOT NULL").select(*keys, F.col("__n").alias("__far"), F.col("__far").alias("__further"), F.col("path").alias("__above"))
            longer = F.when(F.col("__above").isNotNull(), F.concat("__above", "path")).otherwise(F.col("path"))
            now = now.join(up, [*keys, "__far"], "left").select(*keys, "__n", F.col("__further").alias("__far"), longer.alias("path"))
            shelf.drop(last)
        paths = shelf.keep(shelf.put(now.select(*keys, F.col("__n").alias(node_id), "path")))
    return tree.join(paths, [*keys, node_id]).select(*tree.columns, "path")


def visible(tree: DataFrame, expanded: list, type_id: str | None = None, hide_ends: bool = False) -> DataFrame:
    """Rows all of whose ancestors (path) are expanded."""
    shown = tree.where(F.forall("path", lambda x: F.array_contains(F.lit(expanded) if expanded else F.array().cast("array<bigint>"), x)))
    return shown.where(F.substring(type_id, 3, 2) != "A9") if hide_ends and type_id else shown
