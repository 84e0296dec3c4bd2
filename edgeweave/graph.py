"""A typed property graph: named fact tables as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .runtime import exists, table
from .schemas import SCHEMAS, conform, empty


class PropertyGraph:
    """Fact tables by name; a table that is not given is empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.tables = {name: conform(df, name) for name, df in tables.items()}

    def t(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = empty(self.spark, name)
        return self.tables[name]

    def replaced(self, **tables: DataFrame) -> "PropertyGraph":
        return PropertyGraph(self.spark, {**self.tables, **tables})

    def adjacency(self, relation: catalog.Relation | str, inbound: bool = False) -> DataFrame:
        """(src, dst), each pair once, of a relation between symbols or entities; turned round when inbound."""
        r = catalog.RELATIONS[relation] if isinstance(relation, str) else relation
        edges = self.t("entity_edge" if r.layer == "entity" else "edge").where(F.col("kind") == r.id)
        ends = ("dst_id", "src_id") if inbound else ("src_id", "dst_id")
        return edges.where("src_id is not null and dst_id is not null").select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")).distinct()

    def domain(self, view: str) -> DataFrame:
        """(id) of all nodes of the symbol or entity view; entities are those listed and all ends of entity edges."""
        if view == "symbol":
            return self.t("symbol").select("id")
        edges = self.t("entity_edge")
        ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
        return self.t("entity_node").select("id").union(ends).where("id is not null").distinct()

    @classmethod
    def from_directory(cls, spark: SparkSession, directory: str) -> "PropertyGraph":
        """The fact tables that lie as ``<name>.parquet`` in a directory."""
        found = [n for n in SCHEMAS if exists(spark, f"{directory}/{n}.parquet")]
        return cls(spark, {n: table(spark, directory, n) for n in found})


def current_rows(df: DataFrame, keys: list[str], loaded: str = "loaded_at", deleted: str | None = "deleted_at") -> DataFrame:
    """The living row of each key, of several deliveries the last; rows that tie agree. Null keys are left out."""
    living = df.where(F.col(deleted).isNull()) if deleted else df
    for k in keys:
        living = living.where(F.col(k).isNotNull())
    # Column by column, so that columns nobody asks for are not read.
    return living.groupBy(*keys).agg(*[F.max_by(c, loaded).alias(c) for c in df.columns if c not in keys])


def code_index(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The property graph of the code-index tables.

    Symbols are the living rows. Entity edges are as delivered, each once. Edges between symbols follow from them: a
    parent contains its children; fields and methods belong to their parent; generalizations and implementations are
    inheritance; a use names the member it goes through, which is a call.
    """
    symbols = current_rows(table(spark, sf_dir, "symbol"), ["id"])
    raw = table(spark, sf_dir, "entity_edge")
    identity = ["src_id", "dst_id", "kind", "via_member_id", "create_form"]
    rest = ["count", "multiplicity", "access", "is_virtual", "partial"]
    entity = raw.where("src_id is not null and dst_id is not null and kind is not null").groupBy(*identity).agg(*[F.max(c).alias(c) for c in rest])
    owned = symbols.where("parent_id is not null").select("id", "parent_id", "kind")
    pairs = [
        owned.select(F.col("parent_id").alias("src_id"), F.col("id").alias("dst_id"), F.lit(3).alias("kind"), F.lit(1).cast("long").alias("count")),
        owned.where("kind = 6").select(F.col("id").alias("src_id"), F.col("parent_id").alias("dst_id"), F.lit(8), F.lit(1).cast("long")),
        owned.where("kind in (21, 24, 25)").select(F.col("id").alias("src_id"), F.col("parent_id").alias("dst_id"), F.lit(9), F.lit(1).cast("long")),
        entity.where("kind in (1, 2)").select("src_id", "dst_id", F.lit(2), "count"),
        entity.where("kind = 8 and via_member_id is not null").select("src_id", F.col("via_member_id").alias("dst_id"), F.lit(1), "count"),
        entity.where("kind = 3").select("src_id", "dst_id", F.lit(4), "count"),
        entity.where("kind = 11").select("src_id", "dst_id", F.lit(5), "count"),
        entity.where("kind = 10").select("src_id", "dst_id", F.lit(17), "count"),
    ]
    every = pairs[0]
    for p in pairs[1:]:
        every = every.union(p)
    edges = every.groupBy("src_id", "dst_id", "kind").agg(F.sum("count").alias("count")).withColumn("id", F.xxhash64("src_id", "dst_id", "kind"))
    listed = symbols.where("kind in (2, 3, 4, 5, 22, 31)").select("id", F.when(F.col("kind") == 5, 5).when(F.col("kind") == 3, 4).when(F.col("kind") == 22, 9).when(F.col("kind") == 31, 6).otherwise(1).alias("kind"))
    return PropertyGraph(spark, {"symbol": symbols, "entity_edge": entity, "edge": edges, "entity_node": listed})
