"""State within a key, in parallel: counts, latest values and element trees over splits of a key.

A window over a whole key (a print file, say) is one task.  Here the windows run within splits of a key; a split's summary
(its sums; its last values; for a stack its sum, its lowest point and the elements it leaves open a level) is one row, or
one a level.  The summaries are combined by a window over the splits, and every split gets what came before it.  The rows are
dealt once, by key and split; the summaries are as many as there are splits.

split: a column whose values follow the order of the rows, as floor(offset / 1048576) does.
Defined results: the same as over the whole key, wherever the splits are cut; keys and split are never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a file in a split, where nothing else is asked for.
SPLIT = 1 << 20


def by_offset(size: int = SPLIT, at: str = "offset") -> Column:
    """Splits of size bytes."""
    return F.floor(F.col(at) / size)


def _within(keys: list[str], order: list[str]) -> tuple:
    rows = Window.partitionBy(*keys, "__split").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    return rows, rows.rowsBetween(Window.unboundedPreceding, 0), before


def running(rows: DataFrame, keys: list[str], split: Column, order: list[str], counts: dict[str, Column]) -> DataFrame:
    """rows with running sums up to each row, itself included."""
    _, upto, before = _within(keys, order)
    dealt = rows.withColumn("__split", split)
    sums = dealt.groupBy(*keys, "__split").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in counts.items()])
    earlier = sums.select(*keys, "__split", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in counts])
    local = dealt.withColumns({n: F.sum(c).over(upto) for n, c in counts.items()}).join(earlier, [*keys, "__split"])
    return local.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in counts}).drop("__split", *[f"__b_{n}" for n in counts])


def last_values(rows: DataFrame, keys: list[str], split: Column, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with the last values that aren't null, up to each row, itself included."""
    _, upto, before = _within(keys, order)
    dealt = rows.withColumn("__split", split)
    last = dealt.groupBy(*keys, "__split").agg(*[F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"__s_{n}") for n, c in values.items()])
    earlier = last.select(*keys, "__split", *[F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__b_{n}") for n in values])
    local = dealt.withColumns({n: F.last(c, ignorenulls=True).over(upto) for n, c in values.items()}).join(earlier, [*keys, "__split"])
    return local.withColumns({n: F.coalesce(n, f"__b_{n}") for n in values}).drop("__split", *[f"__b_{n}" for n in values])


def nested(log: DataFrame, keys: list[str], split: Column, order: list[str], begin: Column, end: Column, node_id: str) -> DataFrame:
    """depth and parent as nesting.nested() gives them.

    A row's parent is the last begin that raised the stack to the row's depth: one in its split, or what the splits before leave at that depth.
    """
    from .asof import asof_backward

    at, upto, before = _within(keys, order)
    step = F.when(begin, 1).when(end, -1).otherwise(0)
    local = log.withColumns({"__split": split, "__step": step}).withColumn("__s", F.sum("__step").over(upto)).withColumn("__low", F.min("__s").over(upto))
    sums = local.groupBy(*keys, "__split").agg(F.sum("__step").alias("__sum"), F.min("__s").alias("__least"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    earlier = sums.select(*keys, "__split", "__base", F.least(F.lit(0), F.min(F.col("__base") + F.col("__least")).over(before)).alias("__floor"))
    height = F.col("__base") + F.col("__s") - F.least("__floor", F.col("__base") + F.col("__low"))
    rows = local.join(earlier, [*keys, "__split"]).withColumn("__h", height)
    rows = rows.withColumn("depth", F.coalesce(F.lag("__h").over(at), F.col("__base") - F.col("__floor")))

    kind = log.schema[node_id].dataType
    need = rows.withColumns({"__key": F.col("depth"), "__give": F.lit(None).cast(kind), "__row": F.lit(True)})
    give = rows.where("__step = 1").withColumns({"__key": F.col("__h"), "__give": F.col(node_id), "__row": F.lit(False)})
    up = Window.partitionBy(*keys, "__split", "__key").orderBy(*order, F.col("__row").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = need.unionByName(give).withColumn("__parent", F.last("__give", ignorenulls=True).over(up)).where("__row").drop("__key", "__give", "__row")

    left = rows.where("__step = 1").groupBy(*keys, "__split", F.col("__h").alias("__level")).agg(F.max_by(node_id, F.struct(*order)).alias("__node"))
    asked = found.where("depth > 0 AND __parent IS NULL").select(*keys, "__split", F.col("depth").alias("__level")).distinct()
    known = asof_backward(asked, left.withColumnRenamed("__split", "__from"), [*keys, "__level"], "__split", "__from", ["__node"], strict=True)
    known = known.select(*keys, "__split", F.col("__level").alias("depth"), "__node")
    out = found.join(known, [*keys, "__split", "depth"], "left").withColumn("parent", F.when(F.col("depth") > 0, F.coalesce("__parent", "__node")))
    return out.select(*log.columns, "depth", "parent")


def numbered(sf: DataFrame, split: Column | None = None) -> DataFrame:
    """Fields with sf_no (from 0) and page_number (pages begun so far): what the splits of a file can't tell alone."""
    counts = {"sf_no": F.lit(1).cast("long"), "page_number": (F.col("type_id") == "D3A8AD").cast("long")}
    counted = running(sf.drop("sf_no"), ["file_id"], by_offset() if split is None else split, ["offset"], counts)
    return counted.withColumn("sf_no", F.col("sf_no") - 1)
