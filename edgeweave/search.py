"""Logical operators of the search language: expansion, quantification, cardinality with truth values, interpolation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import interpolate
from .ir import PlanError
from .operators import traverse

#: Comparisons of a count that may be cut off: [lower, upper], upper unknown where truncated.
CARDINALITIES = ("at least", "at most", "exactly", "more than", "fewer than")


def navigate(df: DataFrame, relation: DataFrame, on: str, as_: str) -> DataFrame:
    """Inner expansion: each row once per related node, which is named ``as_``; the origin's columns stay."""
    return df.join(relation.select(F.col("src").alias(on), F.col("dst").alias(as_)), on)


def show(df: DataFrame, relation: DataFrame, on: str, as_: str) -> DataFrame:
    """Outer expansion: rows without a related node stay, with null."""
    return df.join(relation.select(F.col("src").alias(on), F.col("dst").alias(as_)), on, "left")


def having(df: DataFrame, relation: DataFrame, on: str) -> DataFrame:
    """Rows that have a related node."""
    return df.join(relation.select(F.col("src").alias(on)), on, "left_semi")


def lacking(df: DataFrame, relation: DataFrame, on: str, complete: bool) -> DataFrame:
    """Rows without a related node; only a complete relation can prove that."""
    if not complete:
        raise PlanError("E_UNKNOWN", "a partial relation cannot prove that nothing is related")
    return df.join(relation.select(F.col("src").alias(on)), on, "left_anti")


def for_all(df: DataFrame, relation: DataFrame, on: str, holds: DataFrame, complete: bool) -> DataFrame:
    """``df`` with ``every``: whether all related nodes hold (id, holds); null where a node or the relation is not known."""
    judged = relation.join(holds.select(F.col("id").alias("dst"), "holds"), "dst", "left")
    counts = judged.groupBy(F.col("src").alias(on)).agg(F.count_if(~F.col("holds")).alias("no"), F.count_if(F.col("holds").isNull()).alias("maybe"))
    no, maybe = F.coalesce("no", F.lit(0)), F.coalesce("maybe", F.lit(0))
    return df.join(counts, on, "left").withColumn("every", F.when(no > 0, F.lit(False)).when(F.lit(complete) & (maybe == 0), F.lit(True))).drop("no", "maybe")


@dataclass(frozen=True)
class CountValue:
    lower: Column
    upper: Column
    truncated: Column

    def compare(self, how: str, n: int) -> Column:
        """Three-valued: true or false where the interval decides, else null."""
        low, high = self.lower, F.when(~self.truncated, self.upper)
        at_least = F.when(low >= n, F.lit(True)).when(high < n, F.lit(False))
        more = F.when(low > n, F.lit(True)).when(high <= n, F.lit(False))
        return {
            "at least": at_least,
            "at most": ~more,
            "more than": more,
            "fewer than": ~at_least,
            "exactly": F.when((low > n) | (high < n), F.lit(False)).when((low == n) & (high == n), F.lit(True)),
        }[how]


def counted(df: DataFrame, relation: DataFrame, on: str, cap: int | None = None) -> tuple[DataFrame, CountValue]:
    """``df`` with the number of related nodes as an interval: beyond ``cap`` only the lower bound is known."""
    n = relation.distinct().groupBy(F.col("src").alias(on)).agg(F.count(F.lit(1)).alias("related"))
    out = df.join(n, on, "left").withColumn("related", F.coalesce("related", F.lit(0)))
    cut = F.lit(False) if cap is None else F.col("related") > cap
    return out, CountValue(F.when(cut, F.lit(cap)).otherwise(F.col("related")), F.col("related"), cut)


def call_closure(starts: DataFrame, adjacency: DataFrame, depth: int | None = None) -> DataFrame:
    """(origin, id) of everything called from each origin, in cycles too, but never the origin itself."""
    pairs = traverse.closure(adjacency, starts, depth)
    return pairs.where("src <> dst").select(F.col("src").alias("origin"), F.col("dst").alias("id"))


def rendered(df: DataFrame, template: str, as_: str, unknown: Column | None = None) -> DataFrame:
    """``df`` with the template filled from its columns; after filters, before distinct, sort and limit."""
    return df.withColumn(as_, interpolate(template, {c: F.col(c) for c in df.columns}, unknown))


def policy(df: DataFrame, truth: Column, unknown: str = "exclude") -> DataFrame:
    """Rows whose truth holds; unknown ones are excluded, included, or an error."""
    if unknown == "include":
        return df.where(F.coalesce(truth, F.lit(True)))
    if unknown == "error" and df.where(truth.isNull()).take(1):
        raise PlanError("E_UNKNOWN", "the condition is unknown for a row")
    return df.where(truth)


def truth_and(a: Column, b: Column) -> Column:
    return a & b


def truth_or(a: Column, b: Column) -> Column:
    return a | b


def truth_not(a: Column) -> Column:
    return ~a
