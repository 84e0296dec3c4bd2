"""Property graphs over the order tables: orders contain parts, each line an occurrence; typed slots; hand-overs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..runtime import table


def order_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders, parts and customers as symbols (ids apart by kind), an edge per order and part, its lines as sites.

    Customers place orders (kind 3), orders use parts (kind 7). Parts are defined once per supplier that ships them;
    orders call the parts they contain from a body of their own.
    """
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    blank = F.lit(None)
    symbols = (
        orders.select((F.col("o_orderkey") * 4 + 1).alias("id"), F.concat(F.lit("order:"), "o_orderkey").alias("usr"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("spelling"), F.lit(8).alias("kind"), F.col("o_orderstatus").alias("callable_kind"), blank.cast("string").alias("template_form"))
        .union(parts.select(F.col("p_partkey") * 4 + 2, F.concat(F.lit("part:"), "p_partkey"), "p_name", F.lit(4), "p_brand", "p_type"))
        .union(customers.select(F.col("c_custkey") * 4 + 3, F.concat(F.lit("customer:"), "c_custkey"), "c_name", F.lit(22), "c_mktsegment", blank.cast("string")))
    )
    used = lines.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    edges = used.select(F.col("l_orderkey") * 10_000_000_000 + F.col("l_partkey"), F.col("l_orderkey") * 4 + 1, F.col("l_partkey") * 4 + 2, F.lit(7), F.lit(0).cast("long")).toDF("id", "src_id", "dst_id", "kind", "count")
    placed = orders.select(-F.col("o_orderkey") - 1, F.col("o_custkey") * 4 + 3, F.col("o_orderkey") * 4 + 1, F.lit(3), F.lit(1).cast("long"))
    sites = lines.select((F.col("l_orderkey") * 10_000_000_000 + F.col("l_partkey")).alias("edge_id"), F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("line"), F.lit(0).alias("col"), F.lit(0).alias("conditional"))
    bodies = lines.select("l_partkey", "l_suppkey").distinct()
    definitions = bodies.select((F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("id"), (F.col("l_partkey") * 4 + 2).alias("symbol_id"), F.col("l_suppkey").alias("file_id"))
    calls = used.select(F.col("l_orderkey").alias("src_def_id"), (F.col("l_partkey") * 4 + 2).alias("dst_id"), F.lit(1).alias("kind"), F.col("n").alias("count"))
    return PropertyGraph(spark, {"symbol": symbols, "edge": edges.union(placed), "edge_site": sites, "definition": definitions, "def_edge": calls})


def type_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Typed slots over orders: an order's lines are its parameters, its parts their types, its suppliers template arguments.

    A part's type points to the type of the part with half its key, so types nest as deep as the keys have bits.
    """
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    place = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    lines = lines.withColumn("pack", F.row_number().over(place) - 1)
    parts = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    symbols = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order:"), "o_orderkey").alias("usr"), F.col("o_orderkey").cast("string").alias("spelling"), F.lit(8).alias("kind"))
    parameters = lines.select(F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("position"), F.col("pack").alias("pack_index"), F.col("l_partkey").alias("type_id"), F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("line"))
    arguments = lines.select(F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("position"), F.col("pack").alias("pack_index"), F.lit(1).alias("arg_kind"), F.col("l_suppkey").alias("ref_id"), F.col("l_partkey").alias("type_id"))
    types = parts.select(F.col("p_partkey").alias("id"), F.concat(F.lit("part:"), "p_partkey").alias("type_key"), F.col("p_type").alias("spelling"), F.lit(2).alias("kind"), (F.col("p_size") % 2).alias("is_const"), (F.col("p_size") % 3 == 0).cast("int").alias("is_volatile"), F.lit(0).alias("is_restrict"))
    nested = parts.where("p_partkey > 0").select(F.col("p_partkey").alias("src_id"), F.lit(1).alias("kind"), F.lit(0).alias("position"), F.floor(F.col("p_partkey") / 2).alias("dst_id"))
    returns = orders.select(F.col("o_orderkey").alias("symbol_id"), F.lit(1).alias("kind"), (F.col("o_custkey") % 100).alias("type_id"))
    return PropertyGraph(spark, {"symbol": symbols, "parameter": parameters, "template_arg": arguments, "type_node": types, "type_edge": nested, "symbol_type": returns})


def handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): consecutive, different suppliers within an order."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    ahead = lines.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"))
    return ahead.where("dst is not null and src <> dst").distinct()


ORDER_SQL = """
used AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)"""

TYPES_SQL = """
lines AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
parameter AS (SELECT l_orderkey AS owner_id, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) - 1 AS pack_index, l_partkey AS type_id, l_suppkey AS ref_id FROM lines)"""

HANDOVER_SQL = """
hand AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
         WHERE dst IS NOT NULL AND src <> dst)"""
