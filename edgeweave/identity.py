"""Portable identities: keys of nodes that say the same in every copy of an index, whatever numbers it gave out.

A symbol is its identity key, else its universe and usr; a file its component's owner, its component and its path in it; an
edge its ends and its kind; a type its key. Everything else is made of these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .ir import PlanError

SEPARATOR = "\x1f"


def symbols(g: PropertyGraph) -> DataFrame:
    """(id, portable)."""
    universe = g.t("semantic_universe").groupBy(F.col("id").alias("semantic_universe_id")).agg(F.min("key").alias("universe"))
    s = g.t("symbol").select("id", "usr", "identity_key", "semantic_universe_id").join(universe, "semantic_universe_id", "left")
    own = F.when(F.col("identity_key") != "", F.col("identity_key"))
    return s.select("id", F.coalesce(own, F.concat(F.coalesce("universe", F.lit("")), F.lit(SEPARATOR), F.coalesce("usr", F.lit("")))).alias("portable"))


def types(g: PropertyGraph) -> DataFrame:
    """(id, portable)."""
    return g.t("type_node").select("id", F.coalesce(F.when(F.col("type_key") != "", F.col("type_key")), F.col("spelling"), F.lit("")).alias("portable"))


def edges(g: PropertyGraph) -> DataFrame:
    """(id, portable): source, kind, target."""
    s = symbols(g)
    e = g.t("edge").select("id", "src_id", "dst_id", "kind")
    e = e.join(s.toDF("src_id", "a"), "src_id", "left").join(s.toDF("dst_id", "b"), "dst_id", "left")
    return e.select("id", F.concat_ws(":", _or_missing("a", "symbol", "src_id"), F.col("kind").cast("string"), _or_missing("b", "symbol", "dst_id")).alias("portable"))


def components(g: PropertyGraph) -> DataFrame:
    """(component_id, owner, name, path, ambiguous): where the path is absolute, the name must tell components of an owner apart."""
    universe = g.t("semantic_universe").groupBy(F.col("id").alias("universe_id")).agg(F.min("key").alias("universe"))
    r = g.t("repository").groupBy(F.col("id").alias("repository_id")).agg(F.min("name").alias("repository"), F.min("remote_url").alias("remote"), F.min("semantic_universe_id").alias("of_repository"))
    c = g.t("component").select(F.col("id").alias("component_id"), "repository_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("path", F.lit("")).alias("path"), "semantic_universe_id").join(r, "repository_id", "left")
    c = c.withColumn("universe_id", F.coalesce("semantic_universe_id", "of_repository", F.lit(1))).join(universe, "universe_id", "left")
    owner = F.when(F.col("remote") != "", F.concat(F.lit("remote:"), "remote")).when(F.col("repository") != "", F.concat(F.lit("repo:"), "repository"))
    c = c.withColumn("owner", F.coalesce(owner, F.concat(F.lit("universe:"), F.coalesce(F.when(F.col("universe") != "", F.col("universe")), F.lit("legacy")))))
    absolute = F.col("path").startswith("/")
    same = c.where(absolute).groupBy("owner", "name").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    c = c.join(same, ["owner", "name"], "left")
    return c.select("component_id", "owner", "name", "path", (absolute & ((F.col("name") == "") | (F.col("least") != F.col("most")))).alias("ambiguous"))


def files(g: PropertyGraph) -> DataFrame:
    """(id, portable, ambiguous): owner, component and path in it, each with its length in bytes before it."""
    d = g.t("directory").select(F.col("id").alias("directory_id"), "component_id", F.col("path").alias("directory"))
    f = g.t("file").select("id", "directory_id", F.col("name").alias("file_name")).join(d, "directory_id").join(components(g), "component_id")
    part = F.when(F.col("path").startswith("/"), F.concat(F.lit("ungrouped:"), "name")).otherwise(F.concat(F.lit("grouped:"), "name", F.lit(SEPARATOR), "path"))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    inside = F.array_join(F.filter(F.array(bare("directory"), bare("file_name")), lambda x: x != ""), "/")
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return f.select("id", F.concat(F.lit("file:"), sized(F.col("owner")), sized(part), sized(inside)).alias("portable"), "ambiguous")


def _or_missing(column: str, what: str, key: str) -> Column:
    return F.coalesce(F.col(column), F.concat(F.lit(f"missing-{what}:"), F.col(key).cast("string")))


#: What the first keys of each view stand for; the other keys are written as they are.
_PARTS: dict[str, tuple[str, ...]] = {
    "parameter": ("symbol",), "template_parameter": ("symbol",), "template_argument": ("symbol",), "call_argument": ("edge", "file"), "site": ("edge", "file"), "evidence": ("edge", "file"), "edge": ("edge",),
    "type": ("type",), "type_layer": ("type",), "signature_slot": ("", "symbol"),
}
_TABLES: dict[str, Callable[[PropertyGraph], DataFrame]] = {"symbol": symbols, "edge": edges, "file": files, "type": types}


def with_identity(g: PropertyGraph, view: str, df: DataFrame, keys: list[str], name: str = "identity_key") -> DataFrame:
    """``df`` with the portable identity of each node, by its key columns. Defaults of template parameters are named by their owner."""
    parts = [F.col(k).cast("string") for k in keys]
    for i, what in enumerate(_PARTS.get(view, ())):
        if what:
            known = _TABLES[what](g).select(F.col("id").alias(keys[i]), F.col("portable").alias(f"__p{i}"))
            df = df.join(known, keys[i], "left")
            parts[i] = _or_missing(f"__p{i}", what, keys[i])
    own = F.concat_ws(":", F.lit(view), *(parts[:-1] if view == "evidence" else parts))
    if view == "evidence":
        owner = symbols(g).select(F.col("id").alias(keys[0]), F.col("portable").alias("__owner"))
        df = df.join(owner, keys[0], "left")
        default = F.concat_ws(":", F.lit("evidence:template_default"), _or_missing("__owner", "symbol", keys[0]), parts[1] if isinstance(parts[1], str) else F.col(keys[1]).cast("string"))
        own = F.when(F.col(keys[-1]) == 1, default).otherwise(own)
    return df.withColumn(name, own).drop("__p0", "__p1", "__owner")


def require_unambiguous(g: PropertyGraph, view: str, stream: DataFrame, keys: list[str]) -> None:
    """E_IDENTITY where a node of the stream lies in a file that its component's name does not tell apart from others."""
    if view not in ("call_argument", "site", "evidence"):
        return
    rows = stream.where(F.col(keys[4]) != 1) if view == "evidence" else stream
    bad = files(g).where("ambiguous").select(F.col("id").alias(keys[1]))
    if rows.select(keys[1]).join(bad, keys[1], "left_semi").take(1):
        raise PlanError("E_IDENTITY", "a component without an unambiguous name")


#: The sections of a canonical dump: table, and what its id columns stand for. Columns not named are written as they are.
SECTIONS: dict[str, dict[str, str]] = {
    "symbol": {"id": "symbol", "file_id": "file", "parent_id": "symbol", "decl_file_id": "file"},
    "decl_site": {"symbol_id": "symbol", "file_id": "file"},
    "edge": {"id": "", "src_id": "symbol", "dst_id": "symbol"},
    "edge_site": {"edge_id": "edge", "file_id": "file", "recv_type_id": "type", "recv_decl_id": "symbol", "recv_type_identity_id": "", "recv_decl_identity_id": ""},
    "call_arg": {"edge_id": "edge", "file_id": "file", "type_id": "type", "decl_id": "symbol", "callee_id": "symbol", "type_identity_id": "", "decl_identity_id": "", "callee_identity_id": ""},
    "template_arg": {"owner_id": "symbol", "ref_id": "symbol", "type_id": "type"},
    "template_param": {"owner_id": "symbol", "type_id": "type", "default_type_id": "type", "default_ref_id": "symbol"},
    "definition": {"id": "", "symbol_id": "symbol", "component_id": "", "file_id": "file"},
    "type_node": {"id": "type", "decl_id": "symbol", "canonical_id": "type"},
    "type_edge": {"src_id": "type", "dst_id": "type"},
    "parameter": {"owner_id": "symbol", "type_id": "type", "declared_type_id": "type", "adjusted_type_id": "type", "file_id": "file"},
    "symbol_type": {"symbol_id": "symbol", "type_id": "type"},
}


def canonical(g: PropertyGraph, section: str) -> DataFrame:
    """The rows of a table with portable identities in place of numbers; numbers that nothing else names are left out."""
    df = g.t(section)
    for column, what in SECTIONS[section].items():
        if what:
            known = _TABLES[what](g).select(F.col("id").alias(column), F.col("portable").alias("__p"))
            df = df.join(known, column, "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("__p", F.lit(f"missing-{what}")))).drop("__p")
    return df.select(*[c for c in g.t(section).columns if SECTIONS[section].get(c) != "" and c != "semantic_universe_id"])


def dump(g: PropertyGraph) -> DataFrame:
    """(section, rows, digest) of the canonical tables: equal for two indexes that say the same, however they are numbered."""
    out = None
    for section in SECTIONS:
        df = canonical(g, section)
        row = F.xxhash64(*[x for c in df.columns for x in (F.col(c), F.col(c).isNull())])
        part = df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", F.coalesce(F.bit_xor(row), F.lit(0)).cast("string"), F.coalesce(F.sum(F.pmod(row, F.lit(1_000_000_007))), F.lit(0)).cast("string")).alias("digest"))
        part = part.select(F.lit(section).alias("section"), "rows", "digest")
        out = part if out is None else out.union(part)
    return out
