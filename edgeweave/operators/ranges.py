"""Sets of nodes below others as ranges of numbers: a node and all below it lie next to each other where there is one way up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import MAX_BROADCAST, materialize, numbered
from . import traverse

#: Numbers in a row of the table that says which node has which.
BLOCK = 128


def small(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` to be broadcast, if it has up to ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ways_up(edges: DataFrame) -> DataFrame:
    """(id, up): each node of ``edges`` (src_id below dst_id) with all nodes above it and itself.

    Where one way leads up, ``up`` goes from the top to the node; those paths are put together by doubling. Nodes below a fork,
    or on or below a cycle, have theirs from the closure.
    """
    steps = materialize(edges.toDF("id", "above").distinct())
    below = steps.select("id").distinct()
    top = materialize(steps.select(F.col("above").alias("id")).distinct().join(below, "id", "left_anti"))
    one = steps.groupBy("id").agg(F.min("above").alias("head"), F.count(F.lit(1)).alias("ways")).where("ways = 1")
    heads = one.select(F.col("id").alias("head"), F.lit(True).alias("open"))
    # ``up`` begins with ``head``; where one way leads on from there, the path is open.
    paths = materialize(one.join(heads, "head", "left").select("id", "head", F.array("head", "id").alias("up"), F.coalesce("open", F.lit(False)).alias("open")))
    while paths.where("open").take(1):
        ahead = paths.select(F.col("id").alias("head"), F.col("head").alias("next"), F.slice("up", 1, F.size("up") - 1).alias("more"), F.col("open").alias("on"))
        longer = paths.where("open").join(ahead, "head").select("id", F.col("next").alias("head"), F.concat("more", "up").alias("up"), F.col("on").alias("open"))
        # A path that meets a node twice is on a cycle or leads there.
        paths = materialize(paths.where("not open").union(longer.where(F.size(F.array_distinct("up")) == F.size("up"))))
    plain = paths.join(top.select(F.col("id").alias("head")), "head", "left_semi").select("id", "up")
    rest = materialize(below.join(plain.select("id"), "id", "left_anti"))
    parts = [top.select("id", F.array("id").alias("up")), plain]
    if rest.take(1):
        above = traverse.closure(steps.toDF("src", "dst"), rest).toDF("id", "above").union(rest.select("id", "id"))
        parts.append(above.groupBy("id").agg(F.array_sort(F.collect_set("above")).alias("up")))
    return reduce(DataFrame.union, parts)


def overrides_in_order(overrides: DataFrame, symbols: DataFrame, called: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of methods and of whatever else is ``called`` (id), by which what a call can land in is ranges.

    ``overrides`` (src_id, dst_id) lead from a method to what it overrides; ``symbols`` (id, pure, stub) say which methods are
    pure and which are known by name only. The result: (id, n, inside), numbers from 0, ``inside`` where a call can land;
    (id, lo, hi), the ranges below each method, itself included, without pure ones; (id) of methods with a target that is a stub.
    """
    ups = ways_up(overrides).join(symbols, "id", "left").where(~F.coalesce("pure", F.lit(False)))
    ups = materialize(ups.select("id", "up", F.coalesce("stub", F.lit(False)).alias("stub"), F.lit(True).alias("inside")))
    others = called.distinct().join(ups.select("id"), "id", "left_anti").select("id", F.array("id").alias("up"), F.lit(False), F.lit(False))
    every = materialize(numbered(ups.union(others).withColumn("outside", ~F.col("inside")), [], ["outside", "up", "id"], "n").withColumn("n", F.col("n") - 1))
    each = every.where("inside").select(F.explode("up").alias("at"), "n", "stub")
    spans = materialize(each.groupBy("at").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("nodes"), F.max("stub").alias("stub")))
    ranges = spans.where("nodes = hi - lo + 1").select(F.col("at").alias("id"), "lo", "hi")
    torn = spans.where("nodes < hi - lo + 1").select("at")
    if torn.take(1):
        row = F.row_number().over(Window.partitionBy("at").orderBy("n"))
        runs = each.join(torn, "at", "left_semi").withColumn("run", F.col("n") - row).groupBy("at", "run").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        ranges = materialize(ranges.union(runs.select("at", "lo", "hi")))
    return every.select("id", "n", "inside"), ranges, spans.where("stub").select(F.col("at").alias("id"))


def covered(ranges: DataFrame) -> DataFrame:
    """(src, lo, hi): ranges that cover the same numbers of each ``src`` and do not overlap."""
    before = F.max("hi").over(Window.partitionBy("src").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.select("src", F.greatest("lo", before + 1).alias("lo"), "hi").where("lo <= hi")


def expand(ranges: DataFrame, numbers: DataFrame, most: int = 4 * MAX_BROADCAST) -> DataFrame:
    """(src, dst): the nodes of ``ranges`` (src, lo, hi) by ``numbers`` (id, n), which count from 0 without a gap.

    The table of numbers, 8 bytes each, is broadcast if there are up to ``most``.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    held = numbers.groupBy(block("n").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("held"))
    held = held.select("block", F.transform("held", lambda x: x["id"]).alias("held"))
    pieces = ranges.select("src", "lo", "hi", F.explode(F.sequence(block("lo"), block("hi"))).alias("block"))
    first = F.greatest(F.lit(0), F.col("lo") - F.col("block") * BLOCK).cast("int")
    last = F.least(F.lit(BLOCK - 1), F.col("hi") - F.col("block") * BLOCK).cast("int")
    met = pieces.join(small(held, most // BLOCK), "block")
    return met.select("src", F.explode(F.slice("held", first + 1, last - first + 1)).alias("dst"))
