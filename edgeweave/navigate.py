"""Navigation over the graph: neighbours, walks, hierarchies, dispatch, callers and callees, members, definitions."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog, derive
from .functions.text import fuzzy, glob, segments_match
from .graph import PropertyGraph
from .ir import PlanError
from .operators import traverse
from .runtime import materialize

INHERITS, OVERRIDES = 2, 6


def _sites(sites: DataFrame) -> DataFrame:
    return sites.select(*[F.col(c).alias(f"at_{c}") for c in ("edge_id", "file_id", "line", "col")]).distinct()


def _same_site(side: str):
    on = F.col(f"{side}.edge_id") == F.col("at_edge_id")
    for c in ("file_id", "line", "col"):
        on = on & F.col(f"{side}.{c}").eqNullSafe(F.col(f"at_{c}"))
    return on


def _kinds(names: Iterable[str] | None, layer: str = "symbol") -> list[int] | None:
    return None if names is None else [catalog.RELATIONS[f"{layer}.{n}"].id for n in names]


def decoded_kind(column: str) -> Column:
    """The name of a kind of source, by its id."""
    return F.create_map(*[F.lit(x) for k, v in catalog.SOURCE_KINDS.items() for x in (v, k)])[F.col(column)]


class Navigator:
    """Lazy answers about a graph; every method gives a DataFrame. ``ids`` are DataFrames with a column id."""

    def __init__(self, graph: PropertyGraph):
        self.g = graph

    def ids(self, *values: int) -> DataFrame:
        return self.g.spark.createDataFrame([(v,) for v in values], "id bigint")

    # -- lookups

    def get(self, id_: int) -> DataFrame:
        return self.g.t("symbol").where(F.col("id") == id_)

    def by_name(self, name: str) -> DataFrame:
        return self.g.t("symbol").where((F.col("spelling") == name) | (F.col("qual_name") == name))

    def find(self, text: str, limit: int | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
        """Symbols by name in tiers: equal, beginning with, containing; the first tier with any hit, shortest names first."""
        s = self.g.t("symbol").withColumn("name", F.coalesce("qual_name", "spelling"))
        if kinds is not None:
            s = s.where(F.col("kind").isin([catalog.SYMBOL_KINDS[k] for k in kinds]))
        low, name = text.lower(), F.lower("name")
        tier = F.when((name == low) | (F.lower("spelling") == low), 1).when(name.startswith(low) | F.lower("spelling").startswith(low), 2).when(name.contains(low), 3)
        hits = s.withColumn("tier", tier).where("tier is not null")
        best = hits.agg(F.min("tier").alias("tier"))
        hits = hits.join(F.broadcast(best), "tier").orderBy(F.length("name"), "name", "id").drop("tier")
        return hits.limit(limit) if limit else hits

    def search(self, text: str, limit: int | None = None) -> DataFrame:
        """Symbols whose name has the ``::`` parts of ``text`` in order; shortest names first."""
        s = self.g.t("symbol").withColumn("name", F.coalesce("qual_name", "spelling"))
        hits = s.where(segments_match(F.col("name"), text)).orderBy(F.length("name"), "name", "id")
        return hits.limit(limit) if limit else hits

    def fuzzy(self, text: str) -> DataFrame:
        s = self.g.t("symbol").withColumn("name", F.coalesce("qual_name", "spelling"))
        return s.where(fuzzy(F.col("name"), text))

    def matching(self, pattern: str) -> DataFrame:
        return self.g.t("symbol").where(glob(F.coalesce("qual_name", "spelling"), pattern))

    def symbols_in_file(self, file_id: int) -> DataFrame:
        return self.g.t("symbol").where(F.col("file_id") == file_id)

    def unresolved(self) -> DataFrame:
        return self.g.t("symbol").where("resolved = 0")

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.g.t("symbol").where(F.col("kind").isin([catalog.SYMBOL_KINDS[k] for k in kinds]))

    # -- edges

    def edges(self, ids: DataFrame | None, direction: str = "out", kinds: Iterable[str] | None = None, limit: int | None = None, sites: bool = False, sites_cap: int = 1000) -> DataFrame:
        """Edges at the given nodes, most frequent first; with ``sites``, the first of them as an array."""
        e = self.g.t("edge")
        if (wanted := _kinds(kinds)) is not None:
            e = e.where(F.col("kind").isin(wanted))
        if ids is not None:
            end = {"out": "src_id", "in": "dst_id"}[direction]
            e = e.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")
        if limit:
            e = e.orderBy(F.desc("count"), "kind", "id").limit(limit)
        if sites:
            e = self.with_sites(e, sites_cap)
        return e

    def with_sites(self, edges: DataFrame, cap: int = 1000) -> DataFrame:
        """``edges`` with ``sites`` (at most ``cap``, by place) and whether there were more."""
        from pyspark.sql import Window

        own = self.g.t("edge_site").join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
        place = Window.partitionBy("edge_id").orderBy("file_id", "line", "col")
        own = own.withColumn("r", F.row_number().over(place)).where(F.col("r") <= cap + 1)
        at = F.struct("file_id", "line", "col", "conditional")
        packed = own.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("r") <= cap, at))).alias("sites"), (F.max("r") > cap).alias("more_sites"))
        return edges.join(packed, "id", "left").withColumn("more_sites", F.coalesce("more_sites", F.lit(False)))

    def references(self, ids: DataFrame) -> DataFrame:
        return self.edges(ids, "in", ["calls", "uses", "alias_of", "of_type"])

    def aliased_by(self, ids: DataFrame) -> DataFrame:
        return self.edges(ids, "in", ["alias_of"])

    def adjacency(self, kinds: Iterable[str] | None, direction: str = "out") -> DataFrame:
        e = self.g.t("edge")
        if (wanted := _kinds(kinds)) is not None:
            e = e.where(F.col("kind").isin(wanted))
        ahead, back = e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), e.select(F.col("dst_id").alias("src"), F.col("src_id").alias("dst"))
        return {"out": ahead, "in": back, "both": ahead.union(back)}[direction].where("src is not null and dst is not null").distinct()

    def neighbors(self, ids: DataFrame, kinds: Iterable[str] | None = None, direction: str = "out") -> DataFrame:
        return traverse.window(ids, self.adjacency(kinds, direction), 1, 1).nodes

    def walk(self, ids: DataFrame, kinds: Iterable[str] | None = None, direction: str = "out", depth: int | None = None) -> DataFrame:
        """(id, depth, parent) at least depth; of several parents the smallest."""
        return traverse.bfs(ids, self.adjacency(kinds, direction), depth)

    def reaches(self, start: int, end: int, kinds: Iterable[str] | None = None, max_depth: int = 8) -> DataFrame:
        """(id, depth, route): one shortest route, the least by ids; no row where there is none within ``max_depth``.

        Distances to the end are kept, not routes; the route is then walked forward, one node at a time.
        """
        route = traverse.one_route(self.adjacency(kinds), start, end, max_depth)
        rows = [(end, len(route) - 1, route)] if route else []
        return self.g.spark.createDataFrame(rows, "id bigint, depth int, route array<bigint>")

    # -- hierarchy and members

    def bases(self, ids: DataFrame, direct: bool = False, depth: int = 16) -> DataFrame:
        return self.walk(ids, ["inherits"], "out", 1 if direct else depth).where("depth > 0")

    def subclasses(self, ids: DataFrame, direct: bool = False, depth: int = 16) -> DataFrame:
        return self.walk(ids, ["inherits"], "in", 1 if direct else depth).where("depth > 0")

    def members(self, ids: DataFrame, access: str | None = None) -> DataFrame:
        """What a record contains, its fields and methods, each once."""
        inside = self.neighbors(ids, ["contains"], "out").union(self.neighbors(ids, ["field_of", "method_of"], "in")).distinct()
        m = self.g.t("symbol").join(inside, "id", "left_semi")
        return m.where(F.col("access") == access) if access else m

    def fields(self, ids: DataFrame) -> DataFrame:
        return self.neighbors(ids, ["field_of"], "in")

    def methods(self, ids: DataFrame) -> DataFrame:
        return self.neighbors(ids, ["method_of"], "in")

    def overrides(self, ids: DataFrame) -> DataFrame:
        return self.neighbors(ids, ["overrides"], "out")

    def overridden_by(self, ids: DataFrame) -> DataFrame:
        return self.neighbors(ids, ["overrides"], "in")

    def virtual_methods(self) -> DataFrame:
        """(id) of methods that are pure or take part in an override."""
        e = self.g.t("edge").where("kind = 6").select(F.explode(F.array("src_id", "dst_id")).alias("id"))
        return e.union(self.g.t("symbol").where("is_pure = 1").select("id")).distinct()

    # -- calls

    def dispatch_targets(self, ids: DataFrame) -> DataFrame:
        """(origin, id): where a call of each method can land: itself and all that override it, without pure ones."""
        own = ids.select(F.col("id").alias("origin"), "id")
        below = derive.override_closure(self.g, ids.select("id").distinct()).select(F.col("base").alias("origin"), F.col("method").alias("id"))
        pure = self.g.t("symbol").where("is_pure = 1").select("id")
        return own.union(below).distinct().join(pure, "id", "left_anti").select("origin", "id")

    def selection(self, method_ids: DataFrame) -> DataFrame:
        """(origin, receiver, id): for each record at or below a method's record, the override that a call picks there.

        It is the one of the nearest record upwards; of equally near ones the smallest id.
        """
        own = derive.owners(self.g)
        targets = self.dispatch_targets(method_ids).join(own.select(F.col("member").alias("id"), F.col("owner").alias("at")), "id")
        up = materialize(self.ancestors())
        records = targets.join(up.select("record", F.col("ancestor").alias("at"), "distance"), "at")
        return records.groupBy("origin", F.col("record").alias("receiver")).agg(F.min_by("id", F.struct("distance", "id")).alias("id"))

    def dispatch_sites(self, method_ids: DataFrame) -> DataFrame:
        """(origin, receiver, prunable, reasons): whether the targets of a call of each method can be trusted to be all.

        Reasons against it: ``unknown-symbol``; ``not-virtual``; ``no-receiver-type``, its record is not in the index;
        ``target-stub``, a target is known by name only; ``pure-no-targets``. The receiver is the method's record.
        """
        s = self.g.t("symbol").select("id", "parent_usr", "resolved")
        by_usr = self.g.t("symbol").where("usr is not null").groupBy(F.col("usr").alias("parent_usr")).agg(F.min("id").alias("receiver"))
        origins = method_ids.select(F.col("id").alias("origin")).distinct()
        known = origins.join(s.select(F.col("id").alias("origin"), "parent_usr", F.lit(True).alias("there")), "origin", "left").join(by_usr, "parent_usr", "left")
        virtual = self.virtual_methods().select(F.col("id").alias("origin"), F.lit(True).alias("virtual"))
        lands = self.dispatch_targets(method_ids.select("id").distinct()).join(s.select("id", "resolved"), "id", "left")
        lands = lands.groupBy("origin").agg(F.count(F.lit(1)).alias("targets"), F.max(F.coalesce("resolved", F.lit(1)) == 0).alias("stub"))
        df = known.join(virtual, "origin", "left").join(lands, "origin", "left")
        no = lambda c: F.col(c).isNull()
        open_ = F.array_compact(
            F.array(F.when(no("receiver"), "no-receiver-type"), F.when(F.col("stub"), "target-stub"), F.when(no("targets"), "pure-no-targets"))
        )
        reasons = F.when(no("there"), F.array(F.lit("unknown-symbol"))).when(no("virtual"), F.array(F.lit("not-virtual"))).otherwise(open_)
        return df.select("origin", "receiver", (F.size(reasons) == 0).alias("prunable"), reasons.alias("reasons"))

    def ancestors(self, depth: int | None = None) -> DataFrame:
        """(record, ancestor, distance) with each record as its own ancestor at 0, at the least distance; all, or up to ``depth``."""
        steps = materialize(self.adjacency(["inherits"]))
        here = self.g.t("symbol").where("kind in (2, 3, 4, 31)").select(F.col("id").alias("record"), F.col("id").alias("ancestor"))
        known = here.withColumn("distance", F.lit(0))
        level = here
        for d in count(1) if depth is None else range(1, depth + 1):
            level = materialize(level.join(steps, level["ancestor"] == steps["src"]).select("record", F.col("dst").alias("ancestor")).distinct().join(known, ["record", "ancestor"], "left_anti"))
            if not level.take(1):
                break
            known = known.unionByName(level.withColumn("distance", F.lit(d)))
        return known

    def callees(self, ids: DataFrame, dispatch: bool = True) -> DataFrame:
        """(origin, id, via): whom each node calls, directly or by dispatch; direct ones win."""
        return self._calls(ids, "src_id", "dst_id", dispatch)

    def callers(self, ids: DataFrame, dispatch: bool = True, include_instantiations: bool = False) -> DataFrame:
        if include_instantiations:
            made = self.g.t("edge").where("kind = 5").select(F.col("src_id").alias("id"), "dst_id").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
            ids = ids.select("id").union(made.select("id")).distinct()
        return self._calls(ids, "dst_id", "src_id", dispatch)

    def _calls(self, ids: DataFrame, end: str, other: str, dispatch: bool) -> DataFrame:
        e = self.g.t("edge").where(F.col("kind").isin([1, 18] if dispatch else [1]))
        hit = e.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")
        best = hit.groupBy(F.col(end).alias("origin"), F.col(other).alias("id")).agg(F.min("kind").alias("kind"))
        return best.select("origin", "id", F.when(F.col("kind") == 1, "direct").otherwise("dispatch").alias("via"))

    def call_graph(self, ids: DataFrame, depth: int | None = None, dispatch: bool = False) -> DataFrame:
        """(id, depth, parent) of everything called from the given nodes."""
        return self.walk(ids, ["calls", "dispatch_calls"] if dispatch else ["calls"], "out", depth)

    # -- templates, definitions, types

    def template_params(self, ids: DataFrame) -> DataFrame:
        return self.g.t("template_param").join(ids.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")

    def template_args(self, ids: DataFrame) -> DataFrame:
        return self.g.t("template_arg").join(ids.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")

    def instantiations(self, ids: DataFrame) -> DataFrame:
        return self.neighbors(ids, ["instantiates"], "in")

    def specializations(self, ids: DataFrame) -> DataFrame:
        return self.neighbors(ids, ["specializes"], "in")

    def template_of(self, ids: DataFrame) -> DataFrame:
        return self.neighbors(ids, ["instantiates", "specializes"], "out")

    def definitions(self, ids: DataFrame) -> DataFrame:
        return self.g.t("definition").join(ids.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")

    def redefined(self) -> DataFrame:
        """(id, bodies): symbols with more than one definition, most first."""
        return self.g.t("definition").groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1")

    def possible_callees(self, definition_ids: DataFrame) -> DataFrame:
        return self.g.t("possible_call").join(definition_ids.select(F.col("id").alias("src_def_id")), "src_def_id", "left_semi")

    def callees_of_definition(self, definition_ids: DataFrame, kind: int = 1) -> DataFrame:
        return self.g.t("def_edge").where(F.col("kind") == kind).join(definition_ids.select(F.col("id").alias("src_def_id")), "src_def_id", "left_semi")

    def uses_of_definition(self, definition_ids: DataFrame) -> DataFrame:
        return self.callees_of_definition(definition_ids, 7)

    def referencing_definitions(self, ids: DataFrame) -> DataFrame:
        return self.g.t("def_edge").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_def_id").alias("id")).distinct()

    def signature(self, ids: DataFrame) -> DataFrame:
        from .views import slots

        return slots(self.g).join(ids.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")

    def signature_text(self, ids: DataFrame) -> DataFrame:
        """(owner_id, text): ``returns name(type name, ...)`` of callables, in the spelling of their types; unknown ones are ``?``."""
        t = self.g.t("type_node").groupBy(F.col("id").alias("type_id")).agg(F.min("spelling").alias("spelled"))
        s = self.signature(ids).where("tag in (1, 2)").select("owner_id", "tag", "position", "pack_index", "name", F.coalesce("declared_type_id", "type_id").alias("type_id")).join(t, "type_id", "left")
        shown = F.concat_ws(" ", F.coalesce("spelled", F.lit("?")), "name")
        listed = F.array_sort(F.collect_list(F.when(F.col("tag") == 2, F.struct("position", "pack_index", shown.alias("shown")))))
        per = s.groupBy("owner_id").agg(F.min(F.when(F.col("tag") == 1, F.coalesce("spelled", F.lit("?")))).alias("returns"), listed.alias("params"))
        names = self.g.t("symbol").select(F.col("id").alias("owner_id"), F.coalesce("qual_name", "spelling").alias("called"))
        args = F.array_join(F.transform("params", lambda x: x["shown"]), ", ")
        return per.join(names, "owner_id").select("owner_id", F.concat(F.coalesce(F.concat("returns", F.lit(" ")), F.lit("")), "called", F.lit("("), args, F.lit(")")).alias("text"))

    def call_tree(self, start: int, depth: int = 8, fan_out: int = 64, most: int = 100_000) -> list[tuple[int, int, int | None]]:
        """(node, depth, caller) of what a function calls, in the order of a depth-first walk: each node once, callees in the
        order of their first call sites, at most ``fan_out`` of them. A printed answer: more than ``most`` calls are an error."""
        from pyspark.sql import Window

        near = self.walk(self.ids(start), ["calls"], "out", depth).select(F.col("id").alias("src_id"))
        first = self.g.t("edge_site").groupBy(F.col("edge_id").alias("id")).agg(F.min(F.struct("file_id", "line", "col")).alias("at"))
        calls = self.g.t("edge").where("kind = 1").join(near, "src_id", "left_semi").select("id", "src_id", "dst_id").join(first, "id", "left")
        place = Window.partitionBy("src_id").orderBy(F.col("at").asc_nulls_last(), "dst_id")
        rows = calls.withColumn("n", F.row_number().over(place)).where(F.col("n") <= fan_out).select("src_id", "dst_id", "n").limit(most + 1).collect()
        if len(rows) > most:
            raise PlanError("E_LIMIT", f"more than {most} calls")
        ahead: dict[int, list[int]] = {}
        for r in sorted(rows, key=lambda r: (r["src_id"], r["n"])):
            ahead.setdefault(r["src_id"], []).append(r["dst_id"])
        out, seen, todo = [], set(), [(start, 0, None)]
        while todo:
            node, at, caller = todo.pop()
            if node not in seen:
                seen.add(node)
                out.append((node, at, caller))
                if at < depth:
                    todo += [(d, at + 1, node) for d in reversed(ahead.get(node, ()))]
        return out

    def type_closure(self, type_ids: DataFrame) -> DataFrame:
        """(id) of types built on the given ones, and themselves."""
        up = self.g.t("type_edge").select(F.col("dst_id").alias("src"), F.col("src_id").alias("dst")).union(self.g.t("type_node").where("canonical_id is not null").select("canonical_id", "id")).distinct()
        return traverse.bfs(type_ids, up).select("id")

    def type_users(self, type_ids: DataFrame) -> DataFrame:
        """(symbol_id) of symbols with a type, a parameter or a template argument built on the given types."""
        t = materialize(self.type_closure(type_ids)).select(F.col("id").alias("type_id"))
        parts = [self.g.t("symbol_type").select("symbol_id", "type_id"), self.g.t("parameter").select("owner_id", "type_id"), self.g.t("template_param").select("owner_id", "type_id"), self.g.t("template_arg").select("owner_id", "type_id")]
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        return every.join(t, "type_id", "left_semi").select("symbol_id").distinct()

    def call_args(self, edge_ids: DataFrame) -> DataFrame:
        """Call arguments with their sources decoded: stored text, else the name of the id."""
        return self.decoded_args(self.g.t("call_arg").join(edge_ids.select(F.col("id").alias("edge_id")), "edge_id", "left_semi"))

    def decoded_args(self, args: DataFrame) -> DataFrame:
        """Rows of ``call_arg`` with their sources decoded."""
        names = self.g.t("external_identity").select(F.col("id").alias("type_identity_id"), F.col("identity_text").alias("type_text"))
        usr = self.g.t("symbol").select(F.col("id").alias("decl_id"), F.col("usr").alias("decl_text"))
        a = args.join(names, "type_identity_id", "left").join(usr, "decl_id", "left")
        return a.withColumn("src_kind", F.coalesce("src_kind", decoded_kind("src_kind_id"), F.lit("unknown"))).withColumn("type_usr", F.coalesce("type_usr", "type_text")).withColumn("decl_usr", F.coalesce("decl_usr", "decl_text"))

    def call_args_at(self, sites: DataFrame) -> DataFrame:
        """The decoded arguments at given sites (edge_id, file_id, line, col); null positions of a site equal each other."""
        return self.call_args(sites.select(F.col("edge_id").alias("id")).distinct()).alias("a").join(_sites(sites), _same_site("a"), "left_semi")

    def receiver_provenance(self, sites: DataFrame) -> DataFrame:
        """What is known of the receiver at given sites (edge_id, file_id, line, col): its source, type, declaration and place
        among the caller's parameters, and whether its type is exact. Stored text, else the name of the id."""
        return self.receivers().alias("a").join(_sites(sites), _same_site("a"), "left_semi")

    def receivers(self) -> DataFrame:
        """The decoded receivers of all call sites."""
        return self.decoded_receivers(self.g.t("edge_site"))

    def decoded_receivers(self, sites: DataFrame) -> DataFrame:
        """Rows of ``edge_site`` with their receivers decoded."""
        types = self.g.t("type_node").select(F.col("id").alias("recv_type_id"), F.col("decl_usr").alias("type_text"))
        decls = self.g.t("symbol").select(F.col("id").alias("recv_decl_id"), F.col("usr").alias("decl_text"))
        s = sites.join(types, "recv_type_id", "left").join(decls, "recv_decl_id", "left")
        return s.select(
            "edge_id", "file_id", "line", "col", (F.coalesce("conditional", F.lit(0)) != 0).alias("conditional"), "args_sig", F.coalesce("recv_src_kind", decoded_kind("recv_src_kind_id")).alias("recv_src_kind"),
            F.coalesce("recv_type_usr", "type_text").alias("recv_type_usr"), F.coalesce("recv_decl_usr", "decl_text").alias("recv_decl_usr"), "recv_param_pos", "recv_type_is_value",
        )

    def call_sites_into(self, ids: DataFrame, dispatch: bool = False) -> DataFrame:
        """(callee, caller, edge_id, via, file_id, line, col, args): every call into the given nodes, with the first of its
        sites (null without any) and the number of arguments known of it; ``call_args`` gives those.

        With ``dispatch``, calls of a method that a given node overrides come in, too, via ``dispatch``.
        """
        calls = self.g.t("edge").where("kind = 1").select(F.col("id").alias("edge_id"), F.col("src_id").alias("caller"), "dst_id")
        wanted = ids.select(F.col("id").alias("callee")).distinct()
        into = calls.join(wanted.withColumn("dst_id", F.col("callee")), "dst_id").select("callee", "caller", "edge_id", F.lit("direct").alias("via"))
        if dispatch:
            up = traverse.closure(self.g.t("edge").where("kind = 6").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct(), wanted.select(F.col("callee").alias("id")))
            far = calls.join(up.select(F.col("src").alias("callee"), F.col("dst").alias("dst_id")), "dst_id").where("callee <> dst_id and caller <> callee")
            into = into.union(far.select("callee", "caller", "edge_id", F.lit("dispatch")))
        first = self.g.t("edge_site").groupBy("edge_id").agg(F.min(F.struct("file_id", "line", "col")).alias("s"))
        known = self.g.t("call_arg").groupBy("edge_id").agg(F.count(F.lit(1)).alias("args"))
        into = into.join(first, "edge_id", "left").join(known, "edge_id", "left")
        return into.select("callee", "caller", "edge_id", "via", "s.file_id", "s.line", "s.col", F.coalesce("args", F.lit(0)).alias("args"))

    # -- entities

    def entity_edges(self, *kinds: str) -> DataFrame:
        e = self.g.t("entity_edge")
        return e.where(F.col("kind").isin(_kinds(kinds, "entity"))) if kinds else e

    def entity_relation(self, ids: DataFrame, kind: str, direction: str = "out", transitive: bool = False, depth: int | None = None) -> DataFrame:
        """(id) related to the given entities; a transitive closure leaves the starts out unless a step leads back."""
        r = catalog.RELATIONS[f"entity.{kind}"]
        a = self.g.adjacency(r)
        if direction != "out":
            back = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            a = back if direction == "in" else a.union(back).distinct()
        if not transitive:
            return traverse.window(ids, a, 1, 1).nodes
        return traverse.bfs(ids, a, depth).where("depth > 0").select("id")

    def entity_stats(self) -> DataFrame:
        names = self.g.spark.createDataFrame([(r.id, r.name) for r in catalog.RELATIONS.values() if r.layer == "entity"], "kind int, name string")
        return self.g.t("entity_edge").groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("count").alias("total")).join(F.broadcast(names), "kind", "left")

    def symbols_by_kind(self) -> DataFrame:
        return self.g.t("symbol").groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"))

    def edges_by_kind(self) -> DataFrame:
        return self.g.t("edge").groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))

    def cross_repository_edges(self) -> DataFrame:
        """Edges whose ends lie in files of different repositories."""
        place = self.g.t("file").select(F.col("id").alias("file_id"), "directory_id").join(self.g.t("directory").select(F.col("id").alias("directory_id"), "component_id"), "directory_id")
        place = place.join(self.g.t("component").select(F.col("id").alias("component_id"), "repository_id"), "component_id").select("file_id", "repository_id")
        at = self.g.t("symbol").select("id", "file_id").join(place, "file_id").select("id", "repository_id")
        e = self.g.t("edge").join(at.select(F.col("id").alias("src_id"), F.col("repository_id").alias("src_repository")), "src_id")
        return e.join(at.select(F.col("id").alias("dst_id"), F.col("repository_id").alias("dst_repository")), "dst_id").where("src_repository <> dst_repository")


# The named steps between entities: relation and direction of each. Fixed values of the API.
ENTITY_STEPS = {
    "bases": ("generalizes", "out"), "derived": ("generalizes", "in"), "implements": ("implements", "out"), "implementors": ("implements", "in"),
    "uses": ("uses", "out"), "used_by": ("uses", "in"), "composes": ("composes", "out"), "composed_in": ("composes", "in"), "creates": ("creates", "out"),
    "created_by": ("creates", "in"), "friends": ("befriends", "out"), "befriended_by": ("befriends", "in"), "instantiates": ("instantiates", "out"),
    "instances": ("instantiates", "in"), "specializes": ("specializes", "out"), "specialized_by": ("specializes", "in"), "aggregates": ("aggregates", "out"),
    "aggregated_in": ("aggregates", "in"), "associates": ("associates", "out"), "associated_with": ("associates", "in"), "destroys": ("destroys", "out"),
    "destroyed_by": ("destroys", "in"),
}


class Entities:
    """A set of entities and the steps from it: ``Entities(nav, ids).bases().where(...).names()``. Every step is lazy."""

    def __init__(self, nav: Navigator, ids: DataFrame):
        self.nav, self.ids = nav, ids.select("id")

    def step(self, name: str, transitive: bool = False, depth: int | None = None) -> "Entities":
        kind, direction = ENTITY_STEPS[name]
        return Entities(self.nav, self.nav.entity_relation(self.ids, kind, direction, transitive, depth))

    def __getattr__(self, name: str):
        if name not in ENTITY_STEPS:
            raise AttributeError(name)
        return lambda transitive=False, depth=None: self.step(name, transitive, depth)

    def of_kind(self, *kinds: str) -> "Entities":
        wanted = self.nav.g.t("entity_node").where(F.col("kind").isin([catalog.ENTITY_KINDS[k] for k in kinds]))
        return Entities(self.nav, self.ids.join(wanted.select("id"), "id", "left_semi"))

    def interfaces(self) -> "Entities":
        return self.of_kind("interface", "interface_template")

    def abstract(self) -> "Entities":
        return self.of_kind("abstract_class", "abstract_class_template")

    def concrete(self) -> "Entities":
        return self.of_kind("class", "class_template")

    def where(self, condition) -> "Entities":
        """Those whose symbol meets a column condition."""
        return Entities(self.nav, self.ids.join(self.nav.g.t("symbol").where(condition).select("id"), "id", "left_semi"))

    def named(self, pattern: str) -> "Entities":
        return self.where(glob(F.coalesce("qual_name", "spelling"), pattern))

    def exclude(self, other: "Entities") -> "Entities":
        return Entities(self.nav, self.ids.join(other.ids, "id", "left_anti"))

    def nodes(self) -> DataFrame:
        return self.ids.distinct()

    def names(self) -> DataFrame:
        s = self.nav.g.t("symbol").select("id", F.coalesce("qual_name", "spelling").alias("name"))
        return self.nodes().join(s, "id", "left")

    def edges(self) -> DataFrame:
        """Entity edges with both ends in the set."""
        n = self.nodes()
        return self.nav.g.t("entity_edge").join(n.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(n.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")

    def count(self) -> int:
        return self.nodes().count()

    def first(self) -> int | None:
        row = self.nodes().orderBy("id").first()
        return row[0] if row else None


def devirtualized_calls(g: PropertyGraph, starts: DataFrame, low: int, high: int) -> DataFrame:
    """(id) reached by walks of low..high calls, virtual calls narrowed by the types that their receivers can have."""
    from .typesets import devirtualized

    return traverse.window(starts, devirtualized(g, starts), low, high).nodes
