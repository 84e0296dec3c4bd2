"""The twelve typed views over the fact tables, and the one-step relations between them, table-driven."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalog
from .functions.text import fnv63
from .graph import PropertyGraph
from .identity import with_identity
from .runtime import materialize

_KEYS = {
    "symbol": ("id",), "entity": ("id",), "parameter": ("owner_id", "position", "pack_index"), "template_parameter": ("owner_id", "position"),
    "template_argument": ("owner_id", "position", "pack_index"), "signature_slot": ("tag", "owner_id", "position", "pack_index", "kind"),
    "call_argument": ("edge_id", "file_id", "line", "col", "position"), "edge": ("id",), "site": ("edge_id", "file_id", "line", "col"),
    "evidence": ("edge_id", "file_id", "line", "col", "tag"), "type": ("id",), "type_layer": ("root_id", "index"),
}
_TABLE = {"parameter": "parameter", "template_parameter": "template_param", "template_argument": "template_arg", "call_argument": "call_arg"}
#: Slots of a signature: return types, parameters, template parameters, template arguments.
RETURNS, PARAMETER, TEMPLATE_PARAMETER, TEMPLATE_ARGUMENT = 1, 2, 3, 4


def keys(view: str) -> list[str]:
    return [f"k{i}" for i in range(len(_KEYS[view]))]


def key_names(view: str) -> tuple[str, ...]:
    return _KEYS[view]


def _keyed(df: DataFrame, view: str) -> DataFrame:
    """Key columns in front; null positions in a site count as 0."""
    zero = ("line", "col", "file_id", "pack_index")
    cols = [(F.coalesce(F.col(n), F.lit(0)) if n in zero else F.col(n)).cast("long").alias(k) for n, k in zip(_KEYS[view], keys(view))]
    return df.select(*cols, *df.columns)


def _symbol_frame(g: PropertyGraph, view: str, wants) -> DataFrame:
    df = g.t("symbol")
    if wants("semantic_universe"):
        universe = g.t("semantic_universe").groupBy(F.col("id").alias("semantic_universe_id")).agg(F.min("key").alias("semantic_universe"))
        df = df.join(universe, "semantic_universe_id", "left")
    if wants("owner"):
        parent = g.t("symbol").where("usr is not null").groupBy(F.col("usr").alias("parent_usr")).agg(F.min(F.coalesce("qual_name", "spelling")).alias("owner"))
        df = df.join(parent, "parent_usr", "left")
    if view == "entity":
        df = g.domain("entity").join(df, "id", "left")
    if wants("entity_type"):
        df = df.join(g.t("entity_node").groupBy("id").agg(F.min("kind").alias("entity_type")), "id", "left")
    name, have = F.coalesce("qual_name", "spelling"), set(df.columns)
    own = {
        "name": name, "file": F.col("file_id"), "name_length": F.length(name), "negative_multi_def": -F.col("multi_def"),
        "negative_count": F.lit(None).cast("long"), "effective_count": F.lit(None).cast("long"),
    }
    fields = [own.get(f, F.col(f) if f in have else F.lit(None)).alias(f) for f in catalog.FIELDS[view]]
    return df.select(F.col("id").alias("k0"), *fields)


def effective_edges(g: PropertyGraph) -> DataFrame:
    """Edges with the count that holds: once the graph is resolved the stored one, before that the number of sites; never below 1."""
    resolved = g.t("meta").where("key = 'graph_resolved_at' and value <> ''").agg((F.count(F.lit(1)) > 0).alias("resolved"))
    seen = g.t("edge_site").groupBy(F.col("edge_id").alias("id")).agg(F.count(F.lit(1)).alias("sites"))
    sites, stored = F.coalesce("sites", F.lit(0)), F.when(F.coalesce("count", F.lit(0)) != 0, F.col("count")).otherwise(F.lit(1))
    df = g.t("edge").join(seen, "id", "left").join(F.broadcast(resolved))
    return df.withColumn("effective_count", F.when(F.col("resolved") | (sites == 0), stored).otherwise(sites)).withColumn(
        "negative_count", -F.when(F.col("resolved"), F.col("count")).otherwise(sites)
    ).drop("sites", "resolved")


def _provenance(g: PropertyGraph, df: DataFrame, edge: str) -> DataFrame:
    """relation, source, target, evidence, status, partial, unknown of the edge in column ``edge``; unresolved ends make it unknown."""
    rows = [(r.id, r.name, r.source, r.target, "partial" if not r.complete else "complete") for r in catalog.RELATIONS.values() if r.layer == "symbol" and not r.virtual]
    kinds = F.broadcast(g.spark.createDataFrame(rows, "kind int, relation string, source string, target string, completeness string"))
    loose = g.t("symbol").where("resolved = 0").select("id")
    ends = g.t("edge").select(F.col("id").alias("eid"), "kind", F.col("src_id").alias("e_src"), F.col("dst_id").alias("e_dst"))
    bad = ends.select("eid", F.explode(F.array("e_src", "e_dst")).alias("id")).join(loose, "id", "left_semi").select("eid").distinct().withColumn("loose", F.lit(True))
    site_bad = g.t("edge_site").where("(recv_type_usr is not null and recv_type_id is null and recv_type_identity_id is null) or (recv_decl_usr is not null and recv_decl_id is null and recv_decl_identity_id is null)")
    args_bad = g.t("call_arg").where("(type_usr is not null and type_id is null and type_identity_id is null) or (decl_usr is not null and decl_id is null and decl_identity_id is null) or (callee_usr is not null and callee_id is null and callee_identity_id is null)")
    gaps = site_bad.select(F.col("edge_id").alias("eid")).union(args_bad.select(F.col("edge_id").alias("eid"))).distinct().withColumn("gap", F.lit(True))
    facts = ends.join(kinds, "kind", "left").join(bad, "eid", "left").join(gaps, "eid", "left")
    unknown = F.col("loose").isNotNull() | F.col("gap").isNotNull()
    facts = facts.select(
        F.col("eid").alias("p_edge"), "relation", "source", "target", F.lit("call_site").alias("evidence"), F.when(unknown, "unknown").otherwise(F.col("completeness")).alias("status"),
        (~unknown & (F.col("completeness") == "partial")).cast("int").alias("partial"), unknown.cast("int").alias("unknown"), "e_src", "e_dst",
    )
    return df.join(facts, F.col(edge) == F.col("p_edge"), "left").drop("p_edge")


def slots(g: PropertyGraph) -> DataFrame:
    """Signature slots of all callables: return types, parameters, template parameters and template arguments."""
    none = lambda t: F.lit(None).cast(t)

    def one(df: DataFrame, tag: int, label: str, **own: Column) -> DataFrame:
        base = {
            "tag": F.lit(tag), "owner_id": F.col("owner_id"), "position": F.col("position"), "pack_index": F.lit(0), "kind": F.lit(0), "slot_kind": F.lit(label), "name": none("string"), "type_id": F.col("type_id"),
            "declared_type_id": none("long"), "adjusted_type_id": none("long"), "default_text": none("string"), "default_origin": none("string"), "reference_semantics": none("string"), "mode": none("string"),
            "value_kind": none("string"), "named_decl": none("string"),
        }
        return df.select(*[c.alias(n) for n, c in (base | own).items()])

    same = lambda *names: {n: F.col(n) for n in names}
    parts = [
        one(g.t("symbol_type").where("kind = 1"), RETURNS, "return", owner_id=F.col("symbol_id"), position=F.lit(0), kind=F.col("kind")),
        one(g.t("parameter"), PARAMETER, "parameter", **same("pack_index", "name", "declared_type_id", "adjusted_type_id", "default_text", "default_origin", "reference_semantics")),
        one(g.t("template_param"), TEMPLATE_PARAMETER, "template_parameter", name=F.col("name"), default_text=F.col("default_txt"), value_kind=F.col("param_kind")),
        one(g.t("template_arg"), TEMPLATE_ARGUMENT, "template_argument", pack_index=F.col("pack_index"), kind=F.col("arg_kind"), named_decl=F.col("ref_id").cast("string"), default_text=F.col("literal")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def layers(g: PropertyGraph, roots: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """(root_id, index, path, relation, position, depth, status, type_id): the types nested in each type, outermost first.

    A type met again on its own path is listed with status ``cycle`` and not opened, so every path ends. With ``deepest``,
    types at that depth that go on are listed with status ``truncated``. Rows are numbered in the order of their paths.
    """
    types = g.t("type_node").select("id")
    seeds = types if roots is None else types.join(roots.select("id").distinct(), "id", "left_semi")
    names = F.create_map(*[F.lit(x) for k, v in catalog.TYPE_EDGE_KINDS.items() for x in (v, k)])
    edges = materialize(g.t("type_edge").select(F.col("src_id").alias("at"), names[F.col("kind")].alias("e_rel"), F.col("position").alias("e_pos"), F.col("dst_id").alias("next")))
    row = ["root_id", "type_id", "path", "relation", "position", "depth", "status", "trail", "sort"]
    level = seeds.select(
        F.col("id").alias("root_id"), F.col("id").alias("type_id"), F.lit("").alias("path"), F.lit("").alias("relation"), F.lit(0).alias("position"), F.lit(0).alias("depth"),
        F.lit("complete").alias("status"), F.array("id").alias("trail"), F.array().cast("array<struct<r:string,p:int>>").alias("sort"),
    )
    every = [level]
    for depth in count(1):
        if deepest is not None and depth > deepest:
            goes_on = F.when((F.col("status") == "complete") & F.col("at").isNotNull(), "truncated").otherwise(F.col("status"))
            every[-1] = level.join(edges.select("at").distinct(), F.col("type_id") == F.col("at"), "left").withColumn("status", goes_on).select(*row)
            break
        again = F.array_contains("trail", F.col("next"))
        level = level.where("status = 'complete'").join(edges, F.col("type_id") == F.col("at")).select(
            "root_id", F.col("next").alias("type_id"), F.concat("path", F.lit("/"), F.col("e_rel"), F.lit("["), F.col("e_pos").cast("string"), F.lit("]")).alias("path"), F.col("e_rel").alias("relation"), F.col("e_pos").alias("position"),
            F.lit(depth).alias("depth"), F.when(again, "cycle").otherwise("complete").alias("status"), F.concat("trail", F.array("next")).alias("trail"),
            F.concat("sort", F.array(F.struct(F.col("e_rel").alias("r"), F.col("e_pos").alias("p")))).alias("sort"),
        )
        level = materialize(level.select(*row))
        if not level.take(1):
            break
        every.append(level)
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    at = F.row_number().over(Window.partitionBy("root_id").orderBy("sort", "type_id")) - 1
    return out.withColumn("index", at).drop("trail", "sort")


_DERIVED = ("relation", "source", "target", "evidence", "status", "partial", "unknown")


def frame(g: PropertyGraph, view: str, needed: set[str] | None = None) -> DataFrame:
    """All nodes of a view with its fields, lazily; columns that a plan does not use are never read.

    With ``needed`` fields, joins that only other fields need are left out, and those fields are missing or null.
    """
    wants = lambda *names: needed is None or any(n in needed for n in names)
    if view in ("symbol", "entity"):
        return _symbol_frame(g, view, wants)
    if view == "edge":
        df = effective_edges(g) if wants("effective_count", "negative_count") else g.t("edge")
        df = (_provenance(g, df, "id") if wants(*_DERIVED) else df).withColumn("edge_id", F.col("id"))
    elif view in ("site", "evidence"):
        df = g.t("edge_site").withColumn("file", F.col("file_id"))
        if wants(*_DERIVED):
            df = _provenance(g, df, "edge_id").withColumn("src_id", F.col("e_src")).withColumn("dst_id", F.col("e_dst"))
        elif wants("src_id", "dst_id"):
            df = df.join(g.t("edge").select(F.col("id").alias("edge_id"), "src_id", "dst_id"), "edge_id", "left")
        if view == "evidence":
            df = df.withColumn("tag", F.lit(0)).withColumn("owner_id", F.lit(None).cast("long")).withColumn("position", F.lit(None).cast("int"))
            d = g.t("template_param").where("default_txt is not null or default_type_id is not null or default_ref_id is not null")
            given = d.select(F.col("owner_id").alias("edge_id"), F.col("position").cast("long").alias("file_id"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(1).alias("tag"), "owner_id", "position", "default_txt", "default_type_id", "default_ref_id", F.lit("declaration").alias("evidence"), F.lit("partial").alias("status"), F.lit(1).alias("partial"), F.lit(0).alias("unknown"))
            df = df.unionByName(given, allowMissingColumns=True)
    elif view == "signature_slot":
        df = slots(g)
    elif view == "type":
        df = g.t("type_node").withColumn("cv_qualifiers", F.coalesce("is_const", F.lit(0)) + 2 * F.coalesce("is_volatile", F.lit(0)) + 4 * F.coalesce("is_restrict", F.lit(0)))
    elif view == "type_layer":
        t = g.t("type_node").withColumnRenamed("id", "type_id")
        df = layers(g).join(t, "type_id", "left").withColumn("element_type", F.when(F.col("relation") == "element_type", F.col("spelling")))
    else:
        df = g.t(_TABLE[view])
    out = _keyed(df, view)
    if not wants("identity_key", "id"):
        return out
    out = with_identity(g, view, out, keys(view))
    return out if "id" in out.columns else out.withColumn("id", fnv63("identity_key"))


# --- One-step relations -----------------------------------------------------------------------------------------------


def _pairs(g: PropertyGraph, r: catalog.Relation) -> DataFrame:
    """(s0.., t0..): source and target keys of a typed relation; every relation is one of these pair tables."""
    t = g.t
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")

    def link(df: DataFrame, source: tuple[str, ...], target: tuple[str, ...]) -> DataFrame:
        cols = [(c if isinstance(c, Column) else long(c)).alias(f"{side}{i}") for side, part in (("s", source), ("t", target)) for i, c in enumerate(part)]
        for name in (*source, *target):
            if isinstance(name, str) and name not in ("line", "col", "file_id", "pack_index", "position"):
                df = df.where(F.col(name).isNotNull())
        return df.select(*cols)

    K = _KEYS
    site, arg = ("edge_id", "file_id", "line", "col"), K["call_argument"]
    tag = F.lit(0).cast("long")
    evidence = (*site, tag)
    match r.qualified:
        case "symbol.has_parameter":
            return link(t("parameter"), ("owner_id",), K["parameter"])
        case "symbol.has_template_parameter":
            return link(t("template_param"), ("owner_id",), K["template_parameter"])
        case "symbol.has_template_argument":
            return link(t("template_arg"), ("owner_id",), K["template_argument"])
        case "symbol.has_signature_slot":
            return link(slots(g), ("owner_id",), K["signature_slot"])
        case "symbol.has_call_edge":
            return link(t("edge").where("kind = 1"), ("src_id",), ("id",))
        case "symbol.has_evidence":
            return link(t("edge_site").join(t("edge").select(F.col("id").alias("edge_id"), "src_id"), "edge_id"), ("src_id",), evidence)
        case "symbol.of_type":
            return link(t("symbol_type"), ("symbol_id",), ("type_id",))
        case "parameter.of_type":
            return link(t("parameter"), K["parameter"], ("type_id",))
        case "parameter.declared_type":
            return link(t("parameter"), K["parameter"], ("declared_type_id",))
        case "parameter.adjusted_type":
            return link(t("parameter"), K["parameter"], ("adjusted_type_id",))
        case "parameter.references_symbol":
            return link(t("parameter").join(_type_symbols(g), "type_id"), K["parameter"], ("symbol_id",))
        case "parameter.has_evidence":
            where = ["file_id", "line", "col"]
            return link(t("parameter").join(t("edge_site").select("edge_id", *where), where), K["parameter"], evidence)
        case "template_parameter.of_type":
            return link(t("template_param"), K["template_parameter"], ("type_id",))
        case "template_parameter.has_default":
            d = t("template_param").where("default_txt is not null or default_type_id is not null or default_ref_id is not null")
            return link(d, K["template_parameter"], ("owner_id", "position", tag, tag, F.lit(1).cast("long")))
        case "template_argument.of_type":
            return link(t("template_arg"), K["template_argument"], ("type_id",))
        case "template_argument.references_symbol":
            return link(t("template_arg"), K["template_argument"], ("ref_id",))
        case "edge.has_argument":
            return link(t("call_arg"), ("edge_id",), arg)
        case "edge.has_evidence":
            return link(t("edge_site"), ("edge_id",), evidence)
        case "edge.has_site":
            return link(t("edge_site"), ("edge_id",), site)
        case "call_argument.of_type":
            return link(t("call_arg"), arg, ("type_id",))
        case "call_argument.references_symbol":
            return link(t("call_arg"), arg, ("decl_id",))
        case "evidence.of_edge":
            return link(t("edge_site"), evidence, ("edge_id",))
        case "evidence.of_occurrence":
            return link(t("call_arg"), evidence, arg)
        case "site.of_edge":
            return link(t("edge_site"), site, ("edge_id",))
        case "type.references_symbol":
            return link(_type_symbols(g), ("type_id",), ("symbol_id",))
        case "type.has_type_edge":
            return link(t("type_edge"), ("src_id",), ("dst_id",))
        case "type.has_layer":
            return link(layers(g), ("root_id",), ("root_id", "index"))
        case "signature_slot.of_callable":
            return link(slots(g), K["signature_slot"], ("owner_id",))
        case "signature_slot.of_type":
            return link(slots(g), K["signature_slot"], ("type_id",))
        case "type_layer.of_type":
            return link(layers(g), ("root_id", "index"), ("root_id",))
        case "type_layer.child":
            a = materialize(layers(g))
            up = a.select("root_id", F.col("index").alias("a"), "path")
            down = a.where("depth > 0").select("root_id", F.col("index").alias("b"), F.regexp_replace("path", "/[^/]*$", "").alias("path"))
            near = up.join(down, ["root_id", "path"])
            return link(near, ("root_id", "a"), ("root_id", "b"))
    raise KeyError(r.qualified)


def _type_symbols(g: PropertyGraph) -> DataFrame:
    """(type_id, symbol_id): the declaration that a type names, and the symbols that have the type."""
    named = g.t("type_node").select(F.col("id").alias("type_id"), F.col("decl_id").alias("symbol_id"))
    return named.union(g.t("symbol_type").select("type_id", "symbol_id")).where("type_id is not null and symbol_id is not null").distinct()


def typed_step(g: PropertyGraph, r: catalog.Relation, inbound: bool, stream: DataFrame) -> DataFrame:
    """The keys on the other side of a typed relation, each once."""
    pairs = _pairs(g, r)
    a, b, here, there = ("t", "s", r.target, r.source) if inbound else ("s", "t", r.source, r.target)
    on = [stream[k].cast("long") == pairs[f"{a}{i}"] for i, k in enumerate(keys(here))]
    return stream.join(pairs, on).select(*[F.col(f"{b}{i}").alias(k) for i, k in enumerate(keys(there))]).distinct()


# --- Who uses a type --------------------------------------------------------------------------------------------------


def type_seeds(g: PropertyGraph, view: str, stream: DataFrame) -> DataFrame:
    """(id) of the types that a stream of types or type layers stands for."""
    if view == "type":
        return stream.select(F.col("k0").alias("id")).distinct()
    at = layers(g, stream.select(F.col("k0").alias("id")))
    return stream.join(at, (stream["k0"] == at["root_id"]) & (stream["k1"] == at["index"])).select(F.col("type_id").alias("id")).distinct()


def reverse_type_use(g: PropertyGraph, seeds: DataFrame, deepest: int) -> tuple[DataFrame, bool]:
    """Witnesses from a type up to every declaration that uses it, directly or nested, at most ``deepest`` levels up.

    Each level climbs to the types built on the ones before (and to spellings of them); a type is not met twice on one
    chain. The owners found at each level end a witness. The flag tells that there was more above the last level.
    """
    up = g.t("type_edge").select(F.col("dst_id").alias("at"), F.col("src_id").alias("next"))
    up = materialize(up.union(g.t("type_node").where("canonical_id is not null and canonical_id <> id").select("canonical_id", "id")).distinct())
    # Chains of types differ, and so do owners with their role and position; so witnesses need not be made distinct once they
    # are whole texts and trails.
    role = F.when(F.col("kind") == 1, 0).when(F.col("kind") == 2, 1).otherwise(2)
    used = F.array_distinct(F.array_compact(F.array("type_id", "declared_type_id", "adjusted_type_id")))
    owners = (
        g.t("symbol_type").select("type_id", F.col("symbol_id").alias("owner"), role.alias("role"), F.lit(None).cast("int").alias("position"))
        .union(g.t("parameter").select(F.explode(used), "owner_id", F.lit(3), "position"))
        .union(g.t("template_param").select("type_id", "owner_id", F.lit(4), "position"))
        .union(g.t("template_arg").select("type_id", "owner_id", F.lit(5), "position"))
        .where("type_id is not null").distinct()
    )
    level = seeds.select(F.col("id").alias("at"), F.array("id").alias("trail")).distinct()
    chains, more = [level], False
    for depth in range(deepest + 1):
        above = level.join(up, "at").where(~F.array_contains("trail", F.col("next"))).select(F.col("next").alias("at"), F.concat("trail", F.array("next")).alias("trail"))
        if depth == deepest:
            more = bool(above.take(1))
            break
        level = materialize(above)
        if not level.take(1):
            break
        chains.append(level)
    # All chains meet the owners in one join, so owners are shuffled once and not at every level.
    every = chains[0]
    for c in chains[1:]:
        every = every.union(c)
    places = F.array(*[F.lit(x) for x in ("symbol", "symbol", "symbol", "parameter", "template_parameter", "template_argument")])
    plain = F.array(*[F.lit(x) for x in ("returns", "of_type", "underlying_type")])
    through = F.when(F.col("role") < 3, F.get(plain, F.col("role"))).otherwise(F.concat(F.get(places, F.col("role")), F.lit("["), F.col("position").cast("string"), F.lit("]")))
    met = every.join(owners.withColumnRenamed("type_id", "at"), "at")
    out = met.select(
        F.get("trail", F.lit(0)).alias("start"), F.col("owner").alias("target"), F.size("trail").alias("length"), F.concat("trail", F.array("owner")).alias("trail"),
        F.get(places, F.col("role")).alias("domain"), through.alias("through"), F.lit("in").alias("direction"), F.lit("partial").alias("status"),
    )
    return out, more
