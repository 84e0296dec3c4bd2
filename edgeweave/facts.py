"""Fact snapshots: named relations with completeness and freshness, and their composition by left joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .derive import content_hash

#: From best to worst; a composition is as good as the worst of its parts. Fixed values of the data model.
COMPLETENESS = ("complete", "partial", "unknown")
FRESHNESS = ("current", "stale", "unverifiable")


@dataclass
class Relation:
    rows: DataFrame
    completeness: str = "complete"
    provider: str = ""


@dataclass
class FactSnapshot:
    relations: dict[str, Relation] = field(default_factory=dict)
    identity: str = ""
    freshness: str = "current"

    def rows(self, name: str) -> DataFrame:
        return self.relations[name].rows

    def content(self) -> dict[str, int]:
        return {n: content_hash(r.rows) for n, r in sorted(self.relations.items())}


@dataclass(frozen=True)
class JoinSpec:
    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    output: str


def defaults(df: DataFrame) -> DataFrame:
    """Nulls filled by type: 0, false, empty text."""
    fill = {"integer": F.lit(0), "boolean": F.lit(False), "string": F.lit("")}

    def kind(t: T.DataType) -> str:
        return "boolean" if isinstance(t, T.BooleanType) else "string" if isinstance(t, T.StringType) else "integer"

    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), fill[kind(f.dataType)].cast(f.dataType)).alias(f.name) for f in df.schema.fields])


def worst(scale: tuple[str, ...], *values: str) -> str:
    return scale[max(scale.index(v) for v in values)]


def compose(left: FactSnapshot, right: FactSnapshot, joins: list[JoinSpec]) -> FactSnapshot:
    """Left outer joins between relations of two snapshots.

    Columns come out prefixed ``left_`` and ``right_``, with ``join_status`` resolved or unresolved; a miss has default
    values. Null keys match nothing. All misses are listed in ``analysis/unresolved_join`` (join, left relation, right
    relation, misses). Snapshots of different identity have nothing to say to each other: every row is unresolved.
    """
    compatible = left.identity == right.identity
    out = FactSnapshot({}, left.identity, worst(FRESHNESS, left.freshness, right.freshness))
    missed = None
    for j in joins:
        a, b = left.relations[j.left], right.relations[j.right]
        l_rows = a.rows.select(*[F.col(f"`{c}`").alias(f"left_{c}") for c in a.rows.columns])
        r_rows = defaults(b.rows).select(*[F.col(f"`{c}`").alias(f"right_{c}") for c in b.rows.columns]).withColumn("__hit", F.lit(True))
        if not compatible:
            r_rows = r_rows.limit(0)
        on = [l_rows[f"left_{x}"] == r_rows[f"right_{y}"] for x, y in j.on]
        # Rows with a null key match nothing; they do not go to one task with all others of their kind.
        whole = reduce(lambda a, b: a & b, [l_rows[f"left_{x}"].isNotNull() for x, _ in j.on])
        met = l_rows.where(whole).join(r_rows, on, "left")
        rows = met.unionByName(l_rows.where(~whole), allowMissingColumns=True).withColumn("join_status", F.when(F.col("__hit"), "resolved").otherwise("unresolved")).drop("__hit")
        rows = defaults(rows)
        state = worst(COMPLETENESS, a.completeness, b.completeness) if compatible else "unknown"
        out.relations[j.output] = Relation(rows, state, "composition")
        miss = rows.where("join_status = 'unresolved'").agg(F.count(F.lit(1)).alias("misses")).select(F.lit(j.output).alias("join"), F.lit(j.left).alias("left_relation"), F.lit(j.right).alias("right_relation"), "misses")
        missed = miss if missed is None else missed.union(miss)
    if missed is not None:
        out.relations["analysis/unresolved_join"] = Relation(missed.where("misses > 0"), "complete", "composition")
    return out
