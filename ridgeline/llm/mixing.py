"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import written

#: Bits of the hash that a histogram level looks at, and levels: bucket, then boundary bucket's sub-bucket, and so on. The key gives
#: the first KEY_BITS, and the whole row the rest, so that a key with many rows can be split.
BITS, LEVELS, KEY_BITS = 12, 5, 24


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """From (source, source_size), one row a source: adds `target`.

    Sources by code point, null last, take the weights in turn. Water filling: a source's target is level * weight, but
    at most most * source_size. The level is the one at which targets sum to share * all sizes. Works on one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    each = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    total = Window.partitionBy()
    each = each.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(total)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    # If exactly the sources that fill before this one are capped, the others' level is (budget - their caps) / other weights.
    before = Window.orderBy("fills_at", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    each = each.withColumn("level", (F.col("budget") - capped) / rest)
    level = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(total)  # capping too many sources gives lower levels
    return each.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "weight", "target")


def _hash(docs: DataFrame, key: Sequence[str]) -> Column:
    rest = [docs[f.name] for f in docs.schema if f.name not in key and not isinstance(f.dataType, MapType)]
    low = 64 - KEY_BITS
    whole = F.xxhash64(*[docs[c] for c in key], *rest).bitwiseAND(F.lit(2**low - 1))
    return F.xxhash64(*[docs[c] for c in key]).bitwiseAND(F.lit(-(2**low))).bitwiseOR(whole)


def _digit(h: Column, level: int) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS * (level + 1)).bitwiseAND(F.lit(2**BITS - 1)).cast("int")


def mix(docs: DataFrame, size: Column, key: Sequence[str], source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """docs' columns in a struct `row`, with size, source_size, target, copies and taken = copies * size.

    Each source takes every document floor(target / source_size) times, and once more those whose hash, of `key` first and
    then of the whole row, lies under the source's threshold. The threshold comes from sums of sizes by source and leading hash bits (at most 4096 rows a
    source), the boundary bucket alone being refined by the next bits. Larger budgets take supersets. Nothing is sorted by
    document, and results don't depend on partitions. Null sizes count 0; a source of size 0 has target 0; rows that are
    equal in all columns are taken alike, while others under one key may part; null sources form a source. No rows give no rows.
    """
    size = F.coalesce(size, F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].alias("source"), size.alias("size"), _hash(docs, key).alias("h"))
    slim = written(rows.select("source", "size", "h"), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most, share).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("base", F.floor(F.col("ratio") + 1e-12).cast("int")).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size")))
    plan = written(plan.select(F.struct("source").alias("s"), "source_size", "target", "base", "left", F.lit(0).cast("long").alias("below")), "mix-plan")
    inside = slim.select(F.struct("source").alias("s"), "size", "h")
    for level in range(LEVELS):
        if level:  # only the boundary bucket of each source
            bits = 64 - BITS * level
            inside = inside.join(F.broadcast(plan.select("s", "below")) if _few(plan) else plan.select("s", "below"), "s").where(
                F.shiftrightunsigned("h", bits) == F.shiftrightunsigned("below", bits)
            ).drop("below")
        sums = inside.groupBy("s", _digit(F.col("h"), level).alias("d")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("d")))
        # Buckets that fit whole in what is left; the first that doesn't is the boundary.
        got = plan.select("s", "left").join(run, "s").groupBy("s").agg(
            F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("took"), F.min(F.when(F.col("upto") > F.col("left"), F.col("d"))).alias("edge")
        )
        step = F.shiftleft(F.coalesce("edge", F.lit(2**BITS - 1)).cast("long"), 64 - BITS * (level + 1))
        plan = written(
            plan.join(got, "s", "left").select("s", "source_size", "target", "base", (F.col("left") - F.coalesce("took", F.lit(0))).alias("left"), F.col("below").bitwiseOR(step).alias("below"), F.lit(level).alias("level")),
            "mix-plan",
        ).drop("level")
    # What is left lies inside the last sub-bucket: its documents go if that comes nearer to the target.
    bits = 64 - BITS * LEVELS
    last = inside.join(plan.select("s", "below"), "s").where(F.shiftrightunsigned("h", bits) == F.shiftrightunsigned("below", bits)).groupBy("s").agg(F.sum("size").alias("n"))
    plan = plan.join(last, "s", "left").select("s", "source_size", "target", "base", F.shiftrightunsigned("below", bits).alias("edge"), (F.coalesce(F.col("n") - F.col("left") <= F.col("left"), F.lit(False))).alias("with_edge"))
    plan = written(plan, "mix-plan")
    out = rows.withColumn("s", F.struct("source")).join(F.broadcast(plan) if _few(plan) else plan, "s")
    at = F.shiftrightunsigned("h", bits)
    more = (at < F.col("edge")) | ((at == F.col("edge")) & F.col("with_edge"))
    copies = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.lit(math.ceil(most)), F.col("base") + more.cast("int"))).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _few(plan: DataFrame, most: int = 100_000) -> bool:
    """Whether the plan, a row a source, is small enough to broadcast; beyond that it is joined by shuffle."""
    return plan.count() <= most
