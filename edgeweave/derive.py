"""Derived facts: roll-ups, dispatch, and the projection of symbols onto design entities.

Each transform takes a graph and gives a table; ``TRANSFORMS`` names them with their inputs, ``run`` applies them in
order, and ``affected`` recomputes only the keys that a change set touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import field_shape, value_type
from .graph import PropertyGraph
from .runtime import materialize, numbered, salted_join

#: Kinds of symbols that are entities; with class templates.
RECORDS, RECORDS_AND_TEMPLATES = (2, 3, 4, 5), (2, 3, 4, 5, 31)
#: create_form of the construct edges. Fixed values of the data model.
CREATE_FORMS = {10: 3, 11: 4, 12: 5, 13: 7, 14: 8, 15: 6}
#: Access of a field as an integer; without one it is public. Fixed values of the data model.
ACCESS = {"public": 0, "protected": 1, "private": 2}
ENTITY_IDENTITY = ["src_id", "dst_id", "kind", "via_member_id", "create_form"]


# --- Roll-ups -----------------------------------------------------------------------------------------------------------


def site_counts(g: PropertyGraph) -> DataFrame:
    """Edges whose count, for calls and uses with any site, is their number of sites."""
    sites = g.t("edge_site").groupBy(F.col("edge_id").alias("id")).agg(F.count(F.lit(1)).alias("sites"))
    rolled = F.col("kind").isin(1, 7) & F.col("sites").isNotNull()
    return g.t("edge").join(sites, "id", "left").withColumn("count", F.when(rolled, F.col("sites")).otherwise(F.col("count"))).drop("sites")


def multi_definitions(g: PropertyGraph) -> DataFrame:
    """Symbols whose multi_def is their number of definitions; 0 without any."""
    n = g.t("definition").groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.t("symbol").join(n, "id", "left").withColumn("multi_def", F.coalesce("n", F.lit(0)).cast("int")).drop("n")


def possible_calls(g: PropertyGraph) -> DataFrame:
    """(src_def_id, dst_def_id, count): calls from a body to every body of a symbol that is defined more than once."""
    many = g.t("symbol").where("multi_def > 1").select(F.col("id").alias("dst_id"))
    bodies = g.t("definition").select(F.col("symbol_id").alias("dst_id"), F.col("id").alias("dst_def_id")).distinct().join(many, "dst_id", "left_semi")
    calls = g.t("def_edge").where("kind = 1").groupBy("src_def_id", "dst_id").agg(F.sum("count").alias("count"))
    # A body belongs to one symbol, so its calls are added up before they meet the bodies. A symbol that is called from
    # everywhere is split.
    return salted_join(materialize(calls), bodies, ["dst_id"]).select("src_def_id", "dst_def_id", "count")


def override_closure(g: PropertyGraph, bases: DataFrame | None = None) -> DataFrame:
    """(base, method): every method that overrides ``base``, directly or through others; of the ``bases`` (id) only, if given."""
    from .operators.traverse import closure

    down = g.t("edge").where("kind = 6").select(F.col("dst_id").alias("src"), F.col("src_id").alias("dst")).distinct()
    return closure(down, bases).select(F.col("src").alias("base"), F.col("dst").alias("method"))


def dispatch_calls(g: PropertyGraph) -> DataFrame:
    """Edges of kind 18: a call of a method may land in any method that overrides it, other than the caller.

    Where several calls lead to one (caller, target), the call edge with the smallest id gives the count.
    """
    calls = g.t("edge").where("kind = 1").select("id", "src_id", F.col("dst_id").alias("base"), "count")
    called = override_closure(g, calls.select(F.col("base").alias("id")).distinct())
    lands = calls.join(called, "base").where("src_id <> method")
    one = lands.groupBy("src_id", F.col("method").alias("dst_id")).agg(F.min_by("count", "id").alias("count"))
    return one.select(F.xxhash64("src_id", "dst_id", F.lit(18)).alias("id"), "src_id", "dst_id", F.lit(18).alias("kind"), "count")


# --- Entities -----------------------------------------------------------------------------------------------------------


def entity_nodes(g: PropertyGraph) -> DataFrame:
    """(id, kind) of the entities: records by what they declare, class templates likewise, namespaces.

    An interface has a pure method, no other method, and no field; an abstract class has a pure method.
    """
    s = g.t("symbol").select("id", "kind", "is_pure")
    owned = g.t("edge").where("kind in (8, 9)").select(F.col("src_id").alias("id"), F.col("dst_id").alias("owner"), F.col("kind").alias("link"))
    m = owned.join(s, "id")
    facts = m.groupBy(F.col("owner").alias("id")).agg(
        F.max((F.col("link") == 9) & (F.coalesce("is_pure", F.lit(0)) == 1)).alias("pure"),
        F.max((F.col("link") == 9) & (F.col("kind") == 21) & (F.coalesce("is_pure", F.lit(0)) == 0)).alias("solid"),
        F.max((F.col("link") == 8) & (F.col("kind") == 6)).alias("data"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    template = F.col("kind") == 31
    level = F.when(yes("pure") & ~yes("solid") & ~yes("data"), F.when(template, 8).otherwise(3)).when(yes("pure"), F.when(template, 7).otherwise(2)).otherwise(F.when(template, 6).otherwise(1))
    kind = F.when(F.col("kind") == 22, 9).when(F.col("kind") == 5, 5).when(F.col("kind") == 3, 4).otherwise(level)
    return s.where(F.col("kind").isin(22, *RECORDS_AND_TEMPLATES)).join(facts, "id", "left").select("id", kind.cast("int").alias("kind"))


def primaries(g: PropertyGraph) -> DataFrame:
    """(id, primary): specializations and instances followed to the template they come from.

    The first edge by (kind, target) of kind 4 or 5 counts; chains are followed by pointer jumping. On a cycle the
    smallest id is the primary of all of it.
    """
    edges = g.t("edge").where("kind in (4, 5) and src_id <> dst_id")
    first = edges.groupBy(F.col("src_id").alias("id")).agg(F.min(F.struct("kind", "dst_id")).alias("m")).select("id", F.col("m.dst_id").alias("next"))
    state = materialize(first.withColumn("least", F.least("id", "next")))
    for _ in range(64):
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
        moved = state.join(ahead, "next", "left").select(
            "id", F.coalesce("next2", "next").alias("after"), F.least("least", F.coalesce("least2", "least")).alias("least"), ((F.col("next2").isNotNull() & (F.col("next2") != F.col("next"))) | (F.col("least2") < F.col("least"))).alias("moved"), F.col("next2").isNotNull().alias("on")
        )
        moved = materialize(moved)
        state = moved.select("id", F.col("after").alias("next"), "least", "on")
        if not moved.where("moved").take(1):
            break
    # Whoever still has someone ahead ends on a cycle, and by now stands on it; there the least id covers all of it.
    ring = state.select(F.col("id").alias("next"), F.col("least").alias("ring_least"))
    ends = state.select("id", "next", "on").join(ring, "next", "left")
    return ends.select("id", F.when(F.col("on"), F.col("ring_least")).otherwise(F.col("next")).alias("primary"))


def _collapsed(df: DataFrame, column: str, p: DataFrame) -> DataFrame:
    return df.join(p.select(F.col("id").alias(column), F.col("primary").alias("__p")), column, "left").withColumn(column, F.coalesce("__p", column)).drop("__p")


def _records(g: PropertyGraph, kinds: Iterable[int] = RECORDS) -> DataFrame:
    return g.t("symbol").where(F.col("kind").isin(*kinds)).select("id", "kind")


def _both_ends(df: DataFrame, ends: DataFrame) -> DataFrame:
    return df.join(ends.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(ends.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")


def _rows(df: DataFrame, kind: Column | int, **own: Column) -> DataFrame:
    """Entity edges before they are merged; what is not given has its default. No edge leads to itself."""
    base = {
        "src_id": F.col("src_id"), "dst_id": F.col("dst_id"), "kind": kind if isinstance(kind, Column) else F.lit(kind), "via_member_id": F.lit(None).cast("long"), "create_form": F.lit(None).cast("int"),
        "count": F.lit(1).cast("long"), "multiplicity": F.lit(1), "access": F.lit(0), "is_virtual": F.lit(0), "partial": F.lit(0), "at": F.lit(0).cast("long"),
    }
    return df.where("src_id <> dst_id").select(*[c.alias(n) for n, c in (base | own).items()])


def owners(g: PropertyGraph) -> DataFrame:
    """(member, owner): the record of each method, the smallest of several."""
    return g.t("edge").where("kind = 9").join(_records(g).select(F.col("id").alias("dst_id")), "dst_id", "left_semi").groupBy(F.col("src_id").alias("member")).agg(F.min("dst_id").alias("owner"))


def entity_edges(g: PropertyGraph) -> DataFrame:
    """All entity edges of the graph: each phase gives raw rows, one aggregation by identity merges them.

    Counts add up, ``partial`` is the most, access and virtuality of an inheritance are those of its last edge.
    """
    edges, symbols, rec = g.t("edge"), g.t("symbol"), _records(g)
    nodes = entity_nodes(g)
    prim = materialize(primaries(g))
    own = materialize(owners(g))
    parts: list[DataFrame] = []

    faces = nodes.where("kind in (3, 8)").select(F.col("id").alias("dst_id"), F.lit(True).alias("face"))
    inherit = _collapsed(_both_ends(edges.where("kind = 2"), rec), "src_id", prim).join(faces, "dst_id", "left")
    parts.append(_rows(inherit, F.when(F.col("face"), 2).otherwise(1), access=F.coalesce("base_access", F.lit(0)), is_virtual=F.coalesce("is_virtual", F.lit(0)), at=F.col("id")))

    wide = _records(g, RECORDS_AND_TEMPLATES)
    for edge_kind, entity_kind in ((4, 3), (5, 11)):
        parts.append(_rows(_collapsed(_both_ends(edges.where(F.col("kind") == edge_kind), wide), "dst_id", prim), entity_kind))

    parts.append(_field_relations(g, rec, prim))
    parts.append(_instance_fields(g))
    parts.append(_returned(g, own, prim))

    made = edges.where("kind between 10 and 16").join(own.select(F.col("member").alias("src_id"), "owner"), "src_id")
    target = symbols.select(F.col("id").alias("dst_id"), F.col("kind").alias("dst_kind"), F.col("parent_usr").alias("dst_parent"))
    by_usr = symbols.where(F.col("kind").isin(*RECORDS) & F.col("usr").isNotNull()).groupBy(F.col("usr").alias("dst_parent")).agg(F.min("id").alias("record"))
    made = made.join(target, "dst_id").join(by_usr, "dst_parent", "left")
    made = made.withColumn("to", F.coalesce("record", F.when(F.col("dst_kind").isin(*RECORDS), F.col("dst_id")))).where("to is not null")
    made = made.select("kind", F.col("owner").alias("src_id"), F.col("to").alias("dst_id"))
    made = _collapsed(_collapsed(made, "src_id", prim), "dst_id", prim)
    form = F.create_map(*[F.lit(x) for k, v in CREATE_FORMS.items() for x in (k, v)])[F.col("kind")]
    parts.append(_rows(made, F.when(F.col("kind") == 16, 9).otherwise(7), create_form=form.cast("int"), partial=(F.col("kind") == 15).cast("int")))

    code = symbols.where("kind in (21, 8, 24, 25, 30)").select("id", "is_pure")
    used = edges.where("kind in (1, 7)").join(code.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(code.select(F.col("id").alias("dst_id"), "is_pure"), "dst_id")
    used = used.select(F.col("src_id").alias("from"), F.col("dst_id").alias("via"), "is_pure")
    used = used.join(own.select(F.col("member").alias("from"), F.col("owner").alias("src_id")), "from").join(own.select(F.col("member").alias("via"), F.col("owner").alias("dst_id")), "via")
    used = _collapsed(_collapsed(used, "src_id", prim), "dst_id", prim)
    parts.append(_rows(used, 8, via_member_id=F.col("via"), partial=F.coalesce("is_pure", F.lit(0))))

    parts.append(_rows(_both_ends(edges.where("kind = 17"), rec), 10))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    latest = F.struct("at", "access", "is_virtual")
    merged = out.groupBy(*ENTITY_IDENTITY).agg(F.sum("count").alias("n"), F.max("multiplicity").alias("multiplicity"), F.max("partial").alias("partial"), F.max(latest).alias("last"))
    merged = merged.select(
        "src_id", "dst_id", "kind", F.when(F.col("kind").isin(1, 2), F.lit(1)).otherwise(F.col("n")).cast("long").alias("count"), "via_member_id", "multiplicity",
        F.col("last.access").alias("access"), F.col("last.is_virtual").alias("is_virtual"), "create_form", "partial",
    )
    spaces = symbols.where("kind = 22").select(F.col("id").alias("src_id"))
    declared = edges.where("kind = 3").join(spaces, "src_id", "left_semi").join(nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id").distinct()
    return merged.unionByName(_rows(declared, 12).drop("at").select(*merged.columns))


def _record_names(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(type_name, by_name) and (type_name, by_spelling): the record of a qualified name, and of a spelling."""
    records = g.t("symbol").where(F.col("kind").isin(*RECORDS))
    by_name = records.where("qual_name is not null").groupBy(F.col("qual_name").alias("type_name")).agg(F.min("id").alias("by_name"))
    return by_name, records.where("spelling is not null").groupBy(F.col("spelling").alias("type_name")).agg(F.min("id").alias("by_spelling"))


def _access(column: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in ACCESS.items() for x in (k, v)])[F.coalesce(column, F.lit("public"))], F.lit(0))


def _instance_fields(g: PropertyGraph) -> DataFrame:
    """Fields of a template, seen from its named instances: a type parameter stands for what the instance binds to it.

    The instance keeps its own identity. A parameter bound to nothing in the index gives no row.
    """
    symbols = g.t("symbol")
    named = symbols.where("is_named_instance = 1").select(F.col("id").alias("src_id"))
    primary = symbols.where("kind = 31").select(F.col("id").alias("template"))
    instances = g.t("edge").where("kind = 5").select("src_id", F.col("dst_id").alias("template")).join(named, "src_id", "left_semi").join(primary, "template", "left_semi").distinct()
    typed = symbols.where("kind = 6 and type_info is not null and type_info <> ''").select(F.col("id").alias("field"), "type_info", F.col("access").alias("field_access"))
    fields = g.t("edge").where("kind = 8").select(F.col("src_id").alias("field"), F.col("dst_id").alias("template")).join(typed, "field")
    params = g.t("template_param").where("param_kind = 1 and name <> ''").groupBy(F.col("owner_id").alias("template"), F.col("name").alias("type_name")).agg(F.min("position").alias("position"))
    bound = g.t("template_arg").where("arg_kind = 1").groupBy(F.col("owner_id").alias("src_id"), "position").agg(F.max_by("ref_id", "pack_index").alias("bound"))
    by_name, by_spelling = _record_names(g)
    relation, many = field_shape(F.col("type_info"))
    df = instances.join(fields, "template").withColumn("type_name", value_type(F.col("type_info"))).withColumn("rel", relation).withColumn("many", many)
    df = df.join(params, ["template", "type_name"], "left").join(bound, ["src_id", "position"], "left").join(by_name, "type_name", "left").join(by_spelling, "type_name", "left")
    df = df.withColumn("dst_id", F.when(F.col("position").isNotNull(), F.col("bound")).otherwise(F.coalesce("by_name", "by_spelling"))).where("dst_id is not null")
    df = df.join(_records(g).select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    return _rows(df, F.col("rel"), via_member_id=F.col("field"), multiplicity=F.col("many"), access=_access("field_access"))


def _returned(g: PropertyGraph, own: DataFrame, prim: DataFrame) -> DataFrame:
    """Records that methods return, as far as their spelling before the parameters names one: partial creations, form 2."""
    by_name, by_spelling = _record_names(g)
    methods = g.t("symbol").where("kind in (21, 24) and type_info is not null").select(F.col("id").alias("member"), F.trim(F.substring_index("type_info", "(", 1)).alias("spelled"))
    methods = methods.where("spelled not in ('', 'void', 'auto')").withColumn("type_name", value_type(F.col("spelled")))
    df = methods.join(own, "member").join(by_name, "type_name", "left").join(by_spelling, "type_name", "left")
    df = df.withColumn("to", F.coalesce("by_name", "by_spelling")).where("to is not null").select(F.col("owner").alias("src_id"), F.col("to").alias("dst_id"))
    return _rows(_collapsed(_collapsed(df, "src_id", prim), "dst_id", prim), 7, create_form=F.lit(2), partial=F.lit(1))


def _field_relations(g: PropertyGraph, rec: DataFrame, prim: DataFrame) -> DataFrame:
    """Fields as compositions, aggregations and associations of the record that their type names.

    The referent is the named instance of the field's type, else the last type argument, else the record that the type
    spelling names (by qualified name, then by spelling; the smallest id of several).
    """
    edges, symbols = g.t("edge"), g.t("symbol")
    fields = edges.where("kind = 8").select(F.col("src_id").alias("field"), F.col("dst_id").alias("owner")).join(rec.select(F.col("id").alias("owner")), "owner", "left_semi")
    typed = symbols.where("kind = 6 and type_info is not null and type_info <> ''").select(F.col("id").alias("field"), "type_info", F.col("access").alias("field_access"))
    fields = fields.join(typed, "field")
    instances = symbols.where("is_named_instance = 1").select(F.col("id").alias("dst_id"))
    named = edges.where("kind = 20").join(instances, "dst_id", "left_semi").groupBy(F.col("src_id").alias("field")).agg(F.min("dst_id").alias("named"))
    args = g.t("template_arg").where("arg_kind = 1 and ref_id is not null").groupBy(F.col("owner_id").alias("field")).agg(F.max_by("ref_id", "position").alias("argument"))
    by_name, by_spelling = _record_names(g)
    relation, many = field_shape(F.col("type_info"))
    df = fields.withColumn("type_name", value_type(F.col("type_info"))).withColumn("rel", relation).withColumn("many", many)
    df = df.join(named, "field", "left").join(args, "field", "left").join(by_name, "type_name", "left").join(by_spelling, "type_name", "left")
    df = df.withColumn("to", F.coalesce("named", "argument", "by_name", "by_spelling")).where("to is not null")
    df = df.join(rec.select(F.col("id").alias("to")), "to", "left_semi")
    collapsed = _collapsed(df.withColumn("plain", F.col("to")), "to", prim).withColumn("dst_id", F.when(F.col("named").isNotNull(), F.col("plain")).otherwise(F.col("to")))
    collapsed = _collapsed(collapsed.withColumn("src_id", F.col("owner")), "src_id", prim)
    return _rows(collapsed, F.col("rel"), via_member_id=F.col("field"), multiplicity=F.col("many"), access=_access("field_access"))


# --- Registry -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transform:
    name: str
    inputs: tuple[str, ...]
    output: str
    build: Callable[[PropertyGraph], DataFrame]


TRANSFORMS = (
    Transform("edge-site-counts", ("edge", "edge_site"), "edge", site_counts),
    Transform("multi-definitions", ("symbol", "definition"), "symbol", multi_definitions),
    Transform("possible-calls", ("symbol", "definition", "def_edge"), "possible_call", possible_calls),
    Transform("entity-nodes", ("symbol", "edge"), "entity_node", entity_nodes),
    Transform("entity-edges", ("symbol", "edge", "template_arg"), "entity_edge", entity_edges),
)


def content_hash(df: DataFrame) -> int:
    """A hash of the rows of a table, in any order: the identity that says whether a transform's input has changed."""
    row = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("s")).first()
    return hash((r["n"], r["x"], r["s"]))


def run(g: PropertyGraph, previous: tuple[PropertyGraph, dict[str, tuple]] | None = None) -> tuple[PropertyGraph, dict[str, tuple]]:
    """(graph with derived tables, identity of each transform's raw inputs).

    With the outcome of a ``previous`` run, a transform whose inputs have the same identity is not run again; its output
    is taken from there.
    """
    hashes: dict[str, int] = {}

    def raw(name: str) -> int:
        if name not in hashes:
            hashes[name] = content_hash(g.t(name))
        return hashes[name]

    seen: dict[str, tuple] = {}
    made: dict[str, str] = {}
    out = g
    for t in TRANSFORMS:
        seen[t.name] = (*[raw(i) for i in t.inputs], *[seen[made[i]] for i in t.inputs if i in made])
        made[t.output] = t.name
        if previous and previous[1].get(t.name) == seen[t.name]:
            table = previous[0].t(t.output)
            # Dispatched calls are added at the end, to the edges of either run.
            out = out.replaced(**{t.output: table.where("kind <> 18") if t.output == "edge" else table})
        else:
            out = out.replaced(**{t.output: materialize(t.build(out))})
    calls = materialize(dispatch_calls(out))
    return out.replaced(edge=out.t("edge").where("kind <> 18").unionByName(calls, allowMissingColumns=True)), seen


def readiness(transforms: dict[str, tuple], recorded: dict[str, tuple]) -> dict[str, str]:
    """Whether each derived table may be used: ``ready`` if it was made from these inputs, ``stale`` if from others, else ``missing``."""
    return {name: "missing" if name not in recorded else "ready" if recorded[name] == inputs else "stale" for name, inputs in transforms.items()}


def ordinals(df: DataFrame, owner: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """``df`` with the place of each row among those of its owner, from 0: how many of them come before it."""
    return numbered(df, [owner], order, "__n").withColumn(name, (F.col("__n") - 1).cast("int")).drop("__n")


def affected(old: DataFrame, fresh: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """A derived table after a change: rows of ``touched`` keys replaced by what is computed afresh, the others kept."""
    touched = touched.select(*keys).distinct()
    return old.join(touched, keys, "left_anti").unionByName(fresh.join(touched, keys, "left_semi"))


def call_signature(symbols: DataFrame) -> DataFrame:
    """(id, display): names that do not collide. Equal names get their place, equal names and places a number."""
    place = F.concat_ws(":", F.coalesce(F.col("file_id").cast("string"), F.lit("?")), F.coalesce(F.col("line").cast("string"), F.lit("?")))
    named = materialize(symbols.select("id", F.coalesce("qual_name", "spelling").alias("nm"), place.alias("loc")))
    # Counts are combined before they are shuffled; what collides in name and place is numbered in ranges.
    places = materialize(named.groupBy("nm", "loc").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id")))
    names = places.groupBy("nm").agg(F.sum("m").alias("n"))
    alone = places.where("m = 1").select("id", "nm", "loc").alias("p").join(names.withColumnRenamed("nm", "nm2"), F.col("nm").eqNullSafe(F.col("nm2")))
    alone = alone.select("id", F.when(F.col("n") == 1, F.col("nm")).otherwise(F.concat("nm", F.lit("@"), "loc")).alias("display"))
    many = places.where("m > 1").select(F.col("nm").alias("nm2"), F.col("loc").alias("loc2"))
    same = named.join(many, F.col("nm").eqNullSafe(F.col("nm2")) & (F.col("loc") == F.col("loc2")), "left_semi")
    ranked = numbered(same, ["nm", "loc"], ["id"], "r")
    return alone.unionByName(ranked.select("id", F.concat("nm", F.lit("@"), "loc", F.lit("#"), F.col("r").cast("string")).alias("display")))
