"""Plans to DataFrames: every stage rewrites a stream, which stays lazy unless a budget or a policy asks for an answer."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog, identity, ir, views
from .functions.text import glob_regex
from .graph import PropertyGraph
from .operators import traverse
from .runtime import is_empty, materialize


@dataclass(frozen=True)
class Budgets:
    """Most nodes enumerated, states walked, partial walks and witnesses per path stage, and rows returned; None: no bound."""

    enumerate: int | None = 10_000
    traverse: int | None = 10_000
    walks: int | None = 10_000
    witnesses: int | None = 1_000
    rows: int | None = 1_000
    sites_per_hop: int = 1_000


#: What a stream of symbols shows where nothing is selected.
DEFAULT_FIELDS = ("id", "usr", "semantic_universe", "identity_key", "name", "kind")
UNBOUNDED = Budgets(None, None, None, None, None)


@dataclass
class Stream:
    """``df`` has the key columns of the view; ``wide`` says that it has the view's fields, too."""

    view: str
    df: DataFrame | None
    wide: bool = False
    shape: str = "nodes"
    order: list[Column] = field(default_factory=list)
    sort: tuple[str, ...] = ()  # fields that a stream of nodes is ordered by
    fields: tuple[str, ...] = ()
    truncated: bool = False
    partial: bool = False
    unknown: bool = False
    limited: bool = False

    def __post_init__(self) -> None:
        self.keys = views.keys(self.view)


@dataclass
class Result:
    """What a plan gives. ``df`` holds the rows (keys of nodes, selected fields, one count, or witnesses) without order."""

    shape: str
    view: str
    df: DataFrame
    truncated: bool
    partial: bool
    unknown: bool
    order: list[Column]
    columns: list[str]

    def frame(self) -> DataFrame:
        return self.df.select(*self.columns)

    def rows(self, cap: int | None = None) -> list[dict]:
        """The rows in their order, collected; at most ``cap``."""
        df = self.df.orderBy(*self.order) if self.order else self.df
        df = df.limit(cap) if cap is not None else df
        return [r.asDict(recursive=True) for r in df.select(*self.columns).collect()]


class Engine:
    """Runs plans on a graph."""

    def __init__(self, graph: PropertyGraph, budgets: Budgets = Budgets(), after_id: int | None = None):
        self.graph, self.budgets, self.after_id = graph, budgets, after_id
        self.needed: set[str] | None = None

    # -- entry points

    def run(self, plan: ir.Plan) -> Result:
        plan = ir.validate(plan)
        self.needed = _fields_of(plan) | (set() if any(s.op in ("select", "count") for s in plan.stages) else set(DEFAULT_FIELDS))
        return self.finish(self.stream(plan))

    def frame(self, plan: ir.Plan) -> DataFrame:
        return self.run(plan).frame()

    def stream(self, plan: ir.Plan) -> Stream:
        st = self.open(plan.source)
        for stage in plan.stages:
            st = getattr(self, "_" + stage.op)(st, stage)
        return st

    # -- sources

    def open(self, source: ir.Source) -> Stream:
        if source.kind == "codebase":
            return Stream("symbol", None)
        found = self.resolve(source.ref, source.kind == "entity")
        return Stream(source.kind, found)

    def resolve(self, ref: str, entities: bool = False) -> DataFrame:
        """Symbols named ``ref``: by usr, else by qualified name, else by spelling; one scan, the best tier kept."""
        s = self.graph.t("symbol")
        tier = F.when(F.col("usr") == ref, 1).when(F.col("qual_name") == ref, 2).when(F.col("spelling") == ref, 3)
        hits = s.select(F.col("id").alias("k0"), tier.alias("tier")).where("tier is not null")
        if entities:
            hits = hits.join(self.graph.t("entity_node").select(F.col("id").alias("k0")), "k0", "left_semi")
        best = hits.agg(F.min("tier").alias("best"))  # one row
        return hits.join(F.broadcast(best), F.col("tier") == F.col("best"), "left_semi").select("k0").distinct()

    # -- helpers

    def wide(self, st: Stream) -> DataFrame:
        """The stream with the fields of its view; keys that the view does not have are dropped."""
        return st.df if st.wide else st.df.join(views.frame(self.graph, st.view, self.needed), st.keys)

    def narrow(self, st: Stream) -> DataFrame:
        return st.df.select(*st.keys)

    def _cut(self, st: Stream, budget: int | None) -> Stream:
        if budget is None:
            return st
        some = materialize(st.df.orderBy(*st.keys).limit(budget + 1))
        if some.count() > budget:
            return replace(st, df=some.orderBy(*st.keys).limit(budget), truncated=True)
        return replace(st, df=some)

    # -- filters

    def _keep(self, st: Stream, df: DataFrame, pred: ir.Pred, policy: str) -> tuple[DataFrame, bool]:
        plain = list(df.columns)
        df, cond = self.condition(df, pred, st.view)
        if policy == "include":
            return df.where(F.coalesce(cond, F.lit(True))).select(*plain), True
        if policy == "error":
            ir.require(is_empty(df.where(cond.isNull())), "E_UNKNOWN", "the predicate is unknown for a node")
        return df.where(cond).select(*plain), False

    def _nodes(self, st: Stream, stage: ir.Stage) -> Stream:
        df = views.frame(self.graph, st.view, self.needed)
        if self.after_id is not None and st.view in ("symbol", "entity", "edge"):
            df = df.where(F.col("k0") > self.after_id)
        out, unknown = replace(st, df=df, wide=True), False
        if stage.pred:
            kept, unknown = self._keep(out, df, stage.pred, stage.unknown)
            out = replace(out, df=kept)
        return replace(self._cut(out, self.budgets.enumerate), unknown=unknown, wide=True)

    def _where(self, st: Stream, stage: ir.Stage) -> Stream:
        df, unknown = self._keep(st, self.wide(st), stage.pred, stage.unknown)
        return replace(st, df=df, wide=True, unknown=st.unknown or unknown, order=[], sort=())

    def _view(self, st: Stream, stage: ir.Stage) -> Stream:
        if st.df is None or stage.level == st.view:
            return replace(st, view=stage.level)
        df = self.narrow(st)
        if stage.level == "entity":
            df = df.join(self.graph.domain("entity").select(F.col("id").alias("k0")), "k0", "left_semi")
        return replace(st, view=stage.level, df=df, wide=False, order=[], sort=())

    def condition(self, df: DataFrame, pred: ir.Pred, view: str) -> tuple[DataFrame, Column]:
        """(``df`` with the columns that the condition needs, the condition): true, false, or null where it is not known."""
        if pred.op in ("all_of", "any_of"):
            parts = []
            for kid in pred.kids:
                df, c = self.condition(df, kid, view)
                parts.append(c)
            return df, reduce((lambda a, b: a & b) if pred.op == "all_of" else (lambda a, b: a | b), parts)
        if pred.op == "not":
            df, c = self.condition(df, pred.kids[0], view)
            return df, ~c
        if pred.op in ir.QUANTIFIERS:
            return self._quantify(df, pred, view)
        return df, self._compare(pred, view)

    def _compare(self, p: ir.Pred, view: str) -> Column:
        col, values = F.col(p.field), list(p.values)
        names = {("symbol", "kind"): catalog.SYMBOL_KINDS, ("entity", "kind"): catalog.SYMBOL_KINDS, ("symbol", "entity_type"): catalog.ENTITY_KINDS, ("entity", "entity_type"): catalog.ENTITY_KINDS}.get((view, p.field))
        if names:
            values = [names[v] for v in values]
        if view == "edge" and p.field == "kind" and isinstance(values[0], str):
            values = [catalog.RELATIONS["symbol." + v.removeprefix("symbol.")].id if "symbol." + v.removeprefix("symbol.") in catalog.RELATIONS else -1 for v in values]
        if p.op == "glob":
            return col.rlike(glob_regex(values[0]))
        if p.op == "in":
            cond = col.isin(values)
        else:
            cond = (col == values[0]) if p.op == "eq" else (col != values[0])
        if view in ("symbol", "entity"):
            return cond
        # Typed views know two values only: a null differs from everything.
        return F.coalesce(cond, F.lit(p.op == "ne"))

    def _quantify(self, df: DataFrame, p: ir.Pred, view: str) -> tuple[DataFrame, Column]:
        """Counts of the related nodes for which the target predicate is true, false, and unknown, joined to each node.

        The target predicate is evaluated once per node of its view, not once per pair.
        """
        relation = catalog.RELATIONS[p.relation]
        adjacency = self.graph.adjacency(relation, p.inbound)
        if p.max_depth == 1:
            pairs = adjacency.select(F.col("src").alias("origin"), F.col("dst").alias("id"))
        else:
            pairs = traverse.pair_window(df.select(F.col("k0").alias("id")), adjacency, p.min_depth, p.max_depth)
        if p.target:
            target_view = relation.source if p.inbound else relation.target
            inner, cond = self.condition(views.frame(self.graph, target_view, self.needed), p.target, target_view)
            judged = inner.select(F.col("k0").alias("id"), cond.alias("holds"), F.lit(True).alias("seen"))
            pairs = pairs.join(judged, "id", "left").withColumn("holds", F.when(F.col("seen"), F.col("holds")))
        else:
            pairs = pairs.withColumn("holds", F.lit(True))
        n = sum(c.startswith("q_") for c in df.columns)
        t, f, u = f"q_true{n}", f"q_false{n}", f"q_null{n}"
        counts = pairs.groupBy(F.col("origin").alias("k0")).agg(F.count_if(F.col("holds")).alias(t), F.count_if(~F.col("holds")).alias(f), F.count_if(F.col("holds").isNull()).alias(u))
        df = df.join(counts, "k0", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        yes, no, maybe, whole = zero(t), zero(f), zero(u), F.lit(relation.complete)
        true, false = F.lit(True), F.lit(False)
        closed = whole & (maybe == 0)
        cond = {
            "exists": F.when(yes > 0, true).when(closed, false),
            "none": F.when(yes > 0, false).when(closed, true),
            "all": F.when(no > 0, false).when(closed, true),
            "at_least": F.when(yes >= p.threshold, true).when(closed, false),
            "exactly": F.when(yes > p.threshold, false).when(closed, yes == p.threshold),
        }[p.op]
        return df, cond

    # -- traversal

    def _out(self, st: Stream, stage: ir.Stage) -> Stream:
        return self._step(st, stage, False)

    def _in(self, st: Stream, stage: ir.Stage) -> Stream:
        return self._step(st, stage, True)

    def _step(self, st: Stream, stage: ir.Stage, inbound: bool) -> Stream:
        r = catalog.RELATIONS[stage.relation]
        to = r.source if inbound else r.target
        partial = st.partial or not r.complete
        if stage.mode == "devirtualized":
            from .navigate import devirtualized_calls

            ids = devirtualized_calls(self.graph, self.narrow(st).withColumnRenamed("k0", "id"), stage.min_depth, stage.max_depth)
            return self._cut(Stream(to, ids.select(F.col("id").alias("k0")), truncated=st.truncated, partial=True, unknown=st.unknown), self.budgets.traverse)
        if r.typed:
            df = views.typed_step(self.graph, r, inbound, self.narrow(st))
            return self._cut(Stream(to, df, truncated=st.truncated, partial=partial, unknown=st.unknown), self.budgets.traverse)
        walk = traverse.window(self.narrow(st).withColumnRenamed("k0", "id"), self.graph.adjacency(r, inbound), stage.min_depth, stage.max_depth, self.budgets.traverse)
        return Stream(to, walk.nodes.select(F.col("id").alias("k0")), truncated=st.truncated or walk.truncated, partial=partial, unknown=st.unknown)

    def _sites(self, st: Stream, stage: ir.Stage) -> Stream:
        df = views.typed_step(self.graph, catalog.RELATIONS["edge.has_site"], False, self.narrow(st))
        return self._cut(Stream("site", df, truncated=st.truncated, partial=True, unknown=st.unknown), self.budgets.enumerate)

    # -- set operations

    def _combine(self, st: Stream, stage: ir.Stage) -> Stream:
        other = self.stream(stage.plan)
        a, b = self.narrow(st), self.narrow(other)
        df = {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[stage.op]()
        out = replace(st, df=df, wide=False, order=[], sort=(), truncated=st.truncated or other.truncated, partial=st.partial or other.partial, unknown=st.unknown or other.unknown)
        return out if st.view in ("symbol", "entity") else self._cut(out, self.budgets.enumerate)

    _union = _intersect = _except = _combine

    # -- shaping

    def _select(self, st: Stream, stage: ir.Stage) -> Stream:
        if {"id", "identity_key"} & set(stage.fields):
            identity.require_unambiguous(self.graph, st.view, st.df, st.keys)
        # Keys stay as hidden columns: ties are ordered by them.
        df = self.wide(st).select(*st.keys, *[F.col(f).alias(f"f_{f}") for f in stage.fields], *[F.col(f).alias(f"o_{f}") for f in st.sort])
        order = [F.col(f"o_{f}").asc_nulls_last() for f in st.sort] + [F.col(k) for k in st.keys]
        return replace(st, df=df, wide=False, shape="rows", fields=stage.fields, order=order, sort=())

    def _order_by(self, st: Stream, stage: ir.Stage) -> Stream:
        if st.shape == "rows":
            return replace(st, order=[F.col(f"f_{f}").asc_nulls_last() for f in stage.fields] + [F.col(k) for k in st.keys])
        return replace(st, df=self.wide(st), wide=True, sort=stage.fields, order=[F.col(f).asc_nulls_last() for f in stage.fields] + [F.col(k) for k in st.keys])

    def _distinct(self, st: Stream, stage: ir.Stage) -> Stream:
        if st.shape == "nodes":
            return replace(st, order=[], sort=())  # nodes are a set already
        if st.shape == "path":
            return replace(st, df=st.df.dropDuplicates(["start", "target", "length", "trail"]))
        names = [f"f_{f}" for f in st.fields]
        rest = [c for c in st.df.columns if c not in names and c not in st.keys]
        # The first row of each: an aggregate that is combined before it is shuffled. Nulls come last, then ties go by keys.
        first = F.struct(*[x for c in rest for x in (F.col(c).isNull().alias(f"null_{c}"), F.col(c))], *st.keys)
        one = st.df.groupBy(*names).agg(F.min(first).alias("m"))
        return replace(st, df=one.select(*[F.col(f"m.{k}").alias(k) for k in st.keys], *names, *[F.col(f"m.{c}").alias(c) for c in rest]))

    def _limit(self, st: Stream, stage: ir.Stage) -> Stream:
        order = st.order or (_rank_order() if st.shape == "path" else [F.col(k) for k in st.keys])
        return replace(st, df=st.df.orderBy(*order).limit(stage.n), limited=True)

    def _count(self, st: Stream, stage: ir.Stage) -> Stream:
        return replace(st, df=st.df.agg(F.count(F.lit(1)).alias("count")), shape="scalar", order=[])

    # -- paths

    def _path(self, st: Stream, stage: ir.Stage) -> Stream:
        r = catalog.RELATIONS[stage.relation]
        goal = self.stream(stage.plan)
        found = traverse.simple_paths(
            self.narrow(st).withColumnRenamed("k0", "id"), self.narrow(goal).withColumnRenamed("k0", "id"),
            self.graph.adjacency(r, stage.inbound), stage.min_depth, stage.max_depth, self.budgets.walks,
        )
        rows = found.rows.select("start", "target", "length", "trail", F.lit(r.layer).alias("domain"), F.lit(r.name).alias("through"), F.lit("in" if stage.inbound else "out").alias("direction"), F.lit("complete" if r.complete else "partial").alias("status"))
        out = replace(st, df=rows, wide=False, shape="path", order=_rank_order(), truncated=st.truncated or goal.truncated or found.truncated or found.depth_limited, partial=st.partial or goal.partial or not r.complete)
        return self._top(out, stage.n)

    def _top(self, st: Stream, n: int) -> Stream:
        if n:
            return replace(st, df=st.df.orderBy(*_rank_order()).limit(n))
        if self.budgets.witnesses is None:
            return st
        some = materialize(st.df.orderBy(*_rank_order()).limit(self.budgets.witnesses + 1))
        if some.count() > self.budgets.witnesses:
            return replace(st, df=some.orderBy(*_rank_order()).limit(self.budgets.witnesses), truncated=True)
        return replace(st, df=some)

    def _rank(self, st: Stream, stage: ir.Stage) -> Stream:
        return self._top(replace(st, order=_rank_order()), stage.n)

    def _reverse_type_use(self, st: Stream, stage: ir.Stage) -> Stream:
        found, limited = views.reverse_type_use(self.graph, views.type_seeds(self.graph, st.view, self.narrow(st)), stage.max_depth)
        return self._top(replace(st, df=found, wide=False, shape="path", order=_rank_order(), partial=True, truncated=st.truncated or limited), 0)

    # -- result

    def finish(self, st: Stream) -> Result:
        flags = dict(truncated=st.truncated, partial=st.partial, unknown=st.unknown)
        if st.shape == "scalar":
            return Result("scalar", st.view, st.df, order=[], columns=["count"], **flags)
        if st.shape == "path":
            return Result("path", st.view, st.df, order=st.order, columns=["start", "target", "length", "trail", "domain", "through", "direction", "status"], **flags)
        if st.shape == "nodes":
            chosen = DEFAULT_FIELDS if st.view in ("symbol", "entity") else ("id", "identity_key")
            st = self._select(st, ir.Stage("select", fields=chosen))
            names = [F.col(f"f_{f}").alias(f) for f in chosen]
        else:
            names = [F.col(f"f_{f}").alias(f) for f in st.fields]
        cap = self.budgets.rows
        if cap is not None and not st.limited:
            some = materialize(st.df.orderBy(*st.order).limit(cap + 1))
            if some.count() > cap:
                st = replace(st, df=some.orderBy(*st.order).limit(cap), truncated=True)
                flags["truncated"] = True
        return Result(st.shape, st.view, st.df, order=st.order, columns=names, **flags)


def _fields_of(plan: ir.Plan) -> set[str]:
    """Every field that the plan names, in operands and predicates, too."""
    found: set[str] = set()

    def of(p: ir.Pred | None) -> None:
        if p is not None:
            found.update([p.field] if p.field else [])
            of(p.target)
            for k in p.kids:
                of(k)

    for s in plan.stages:
        found.update(s.fields)
        of(s.pred)
        if s.plan is not None:
            found |= _fields_of(s.plan)
    return found


def _rank_order() -> list[Column]:
    """Shorter first, then by the ids along the path; arrays compare element by element."""
    return [F.col("length"), F.col("trail")]
