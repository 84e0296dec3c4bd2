"""What types a receiver can have: type sets that flow through arguments, receivers and parameters of a call graph.

A location is a name inside a function: a declaration, a type whose object is meant (``this`` of a record), or the place of a
parameter (``@0``). Calls bind locations of the callee to what their arguments and receivers are in the caller: a type, all
types (TOP), or whatever another location holds. So the sets are what reaches each location along the bindings, a closure that
does not depend on any order; a location that is read but never bound holds all types.
"""

from __future__ import annotations

import gc
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import derive
from .graph import PropertyGraph
from .operators import traverse
from .operators.ranges import covered, expand, overrides_in_order, small
from .runtime import materialize, tidy
from .schemas import conform

#: The type that stands for all types.
TOP = ""
# Kinds of sources whose type is exact where they hold a value, and those that name a location. Fixed values of the data model.
EXACT, NAMED = ("local", "this", "member", "global", "call_result"), ("local", "this", "member", "global")
#: Call sites that are looked at together.
SHARE = 16_000_000


def _what(kind: Column, type_usr: Column, decl_usr: Column, is_value: Column) -> tuple[Column, Column]:
    """(type or TOP, else null; location that is read, else null) of a source."""
    exact = kind.isin(*EXACT) & (is_value == 1) & type_usr.isNotNull()
    read = kind.isin(*NAMED) & decl_usr.isNotNull()
    base = F.when(kind == "construct", F.coalesce(type_usr, F.lit(TOP))).when(exact, type_usr).when(read, F.lit(None)).otherwise(F.lit(TOP))
    return base, F.when(base.isNull(), decl_usr)


def _bindings(calls: DataFrame, args: DataFrame, sites: DataFrame, owners: DataFrame) -> DataFrame:
    """(fn, loc, type, src, ref): location ``loc`` of the callee ``fn`` holds ``type``, or what ``ref`` of ``src`` holds."""
    a = calls.join(args, "edge_id")
    base, ref = _what(F.col("src_kind"), F.col("type_usr"), F.col("decl_usr"), F.col("type_is_value"))
    a = a.withColumn("base", base).withColumn("ref", ref)
    one = lambda df, loc, what, back: df.select(F.col("dst_id").alias("fn"), loc.alias("loc"), what.alias("type"), F.col("src_id").alias("src"), back.alias("ref"))
    none, made = F.lit(None).cast("string"), a.where("src_kind = 'construct' and type_usr is not null")
    got = calls.join(sites.where("recv_src_kind is not null"), "edge_id").join(owners.withColumnRenamed("id", "dst_id"), "dst_id")
    recv, back = _what(F.col("recv_src_kind"), F.col("recv_type_usr"), F.col("recv_decl_usr"), F.col("recv_type_is_value"))
    got = got.withColumn("base", recv).withColumn("ref", back)
    parts = [
        one(a, F.concat(F.lit("@"), F.col("position").cast("string")), F.col("base"), F.col("ref")),
        one(a.where("decl_usr is not null"), F.col("decl_usr"), F.col("base"), F.col("ref")),
        one(made, F.col("type_usr"), F.col("type_usr"), none),
        one(got, F.col("parent_usr"), F.col("base"), F.col("ref")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _made(calls: DataFrame, args: DataFrame) -> DataFrame:
    """(fn, loc, type, src, ref): what the arguments of a call say of locations of the caller ``fn`` itself."""
    a = calls.join(args, "edge_id")
    made, known = a.where("src_kind = 'construct' and type_usr is not null"), a.where("src_kind in ('local', 'this') and decl_usr is not null and type_usr is not null")
    both = made.select("src_id", F.col("type_usr").alias("loc"), "type_usr").union(known.select("src_id", "decl_usr", "type_usr")).distinct()
    return both.select(F.col("src_id").alias("fn"), "loc", F.col("type_usr").alias("type"), F.col("src_id").alias("src"), F.lit(None).cast("string").alias("ref"))


def _some(df: DataFrame) -> DataFrame | None:
    df = materialize(df)
    return df if df.take(1) else None


def _read(nav, calls: DataFrame) -> DataFrame | None:
    """The bindings of ``calls`` that can matter to a receiver; None if there are none.

    Only callers read locations. So of what calls bind in their callees, callees that call themselves count; of what they say of
    the caller, locations with the name of one that some receiver or binding reads. Names are compared before any row is decoded.
    """
    g = nav.g
    names = lambda table, key, text: g.t(table).select(F.col("id").alias(key), F.col(text).alias("text"))
    decls, types, idents = (lambda key: names("symbol", key, "usr")), (lambda key: names("type_node", key, "decl_usr")), (lambda key: names("external_identity", key, "identity_text"))

    def named(rows: DataFrame, own: str, key: str, by: DataFrame) -> DataFrame:
        """(own, key, loc), each once, with the text of the id where there is no own."""
        return rows.select(own, key).distinct().join(by, key, "left").select(own, key, F.coalesce(own, "text").alias("loc")).where("loc is not null")

    inner = _some(calls.select(F.col("dst_id").alias("id")).distinct().join(calls.select(F.col("src_id").alias("id")), "id", "left_semi"))
    bound = None
    if inner is not None:
        into = materialize(calls.join(inner.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("edge_id", "src_id", "dst_id"))
        at = g.t("edge_site").join(into, "edge_id", "left_semi")
        bound = materialize(_bindings(into, nav.call_args(into.select(F.col("edge_id").alias("id"))), nav.decoded_receivers(at), g.t("symbol").where("parent_usr is not null").select("id", "parent_usr")))
    sites, args = g.t("edge_site"), g.t("call_arg")
    asked = [named(sites, "recv_decl_usr", "recv_decl_id", decls("recv_decl_id")), named(sites, "recv_type_usr", "recv_type_id", types("recv_type_id"))]
    asked = [x.select("loc") for x in asked] + [sites.where("recv_param_pos is not null").select(F.concat(F.lit("@"), F.col("recv_param_pos").cast("string")).alias("loc")).distinct()]
    if bound is not None:
        asked.append(bound.where("ref is not null").select(F.col("ref").alias("loc")))
    asked = materialize(reduce(DataFrame.union, asked).distinct())
    from .navigate import decoded_kind

    kind = F.coalesce("src_kind", decoded_kind("src_kind_id"))
    parts = []
    for kinds, own, key, by in ((("construct",), "type_usr", "type_identity_id", idents), (("local", "this"), "decl_usr", "decl_id", decls)):
        rows = args.where(kind.isin(*kinds))
        hit = _some(named(rows, own, key, by(key)).join(asked, "loc", "left_semi").select(F.col(own).alias("own"), F.col(key).alias("key")))
        if hit is not None:
            parts.append(rows.join(hit, rows[own].eqNullSafe(hit["own"]) & rows[key].eqNullSafe(hit["key"]), "left_semi"))
    if parts:
        said = _made(calls, nav.decoded_args(reduce(DataFrame.unionByName, parts))).join(asked, "loc", "left_semi").select("fn", "loc", "type", "src", "ref")
        bound = said if bound is None else bound.union(said)
    return None if bound is None else _some(bound)


def type_sets(every: DataFrame) -> DataFrame:
    """(fn, loc, type) of every location that bindings (fn, loc, type, src, ref; materialised) bind; TOP is the empty type."""
    key = ["fn", "loc"]
    links = every.where("ref is not null").select(F.col("src").alias("from_fn"), F.col("ref").alias("from_loc"), *key)
    bound = every.select(*key).distinct()
    loose = links.join(bound.toDF("from_fn", "from_loc"), ["from_fn", "from_loc"], "left_anti").select(*key, F.lit(TOP).alias("type"))
    known = materialize(every.where("ref is null").select(*key, "type").union(loose).distinct())
    new, parts = known, [known]
    while new.take(1):
        sent = new.withColumnsRenamed({"fn": "from_fn", "loc": "from_loc"}).join(links, ["from_fn", "from_loc"]).select(*key, "type").distinct()
        new = materialize(sent.join(known, [*key, "type"], "left_anti"))
        parts.append(new)
        known = reduce(DataFrame.union, parts)
        if len(parts) > traverse.DELTAS:
            known = materialize(known)
            parts = [known]
    return known


def receiver_types(calls: DataFrame, sites: DataFrame, sets: DataFrame | None, nav) -> DataFrame:
    """(edge_id, dst_id, type): what the receiver of each call can be at its first site, for calls where that is known.

    An exact value is its type. Else the first of these locations that is bound in the caller says it: the receiver's
    declaration, its declared type, its place among the parameters. A constructed receiver is its type; all others can be
    anything, as can those of which a location says so. ``sites`` are not decoded; ``sets`` None stands for no locations.
    """
    from .navigate import decoded_kind

    kind = F.coalesce("recv_src_kind", decoded_kind("recv_src_kind_id"))
    if sets is None:
        valued = kind.isin("local", "member", "global", "call_result") & (F.col("recv_type_is_value") == 1)
        said = [F.when(valued | (kind == "construct"), F.col(c)).alias(c) for c in ("recv_type_usr", "recv_type_id")]
        first = sites.groupBy("edge_id").agg(F.min(F.struct("file_id", "line", "col", *said)).alias("s")).select("edge_id", "s.recv_type_usr", "s.recv_type_id")
        types = nav.g.t("type_node").select(F.col("id").alias("recv_type_id"), F.col("decl_usr").alias("type_text"))
        c = calls(first.where("recv_type_usr is not null or recv_type_id is not null")).join(types, "recv_type_id", "left")
        return c.select("edge_id", "dst_id", F.coalesce("recv_type_usr", "type_text").alias("type")).where("type is not null")
    of = ["recv_src_kind", "recv_src_kind_id", "recv_type_usr", "recv_type_id", "recv_type_is_value", "recv_decl_usr", "recv_decl_id", "recv_param_pos"]
    first = sites.groupBy("edge_id").agg(F.min(F.struct("file_id", "line", "col", *of)).alias("s")).select("edge_id", *[f"s.{c}" for c in of])
    c = materialize(calls(nav.decoded_receivers(conform(first, "edge_site"))))
    exact = F.coalesce(F.col("recv_src_kind").isin("local", "member", "global", "call_result") & (F.col("recv_type_is_value") == 1) & F.col("recv_type_usr").isNotNull(), F.lit(False))
    places = F.array(F.col("recv_decl_usr"), F.col("recv_type_usr"), F.concat(F.lit("@"), F.col("recv_param_pos").cast("string")))
    asked = c.where(~exact).select("edge_id", F.col("src_id").alias("fn"), F.posexplode(places).alias("rank", "loc")).where("loc is not null")
    hit = asked.join(sets.select("fn", "loc").distinct(), ["fn", "loc"]).groupBy("edge_id", "fn").agg(F.min_by("loc", "rank").alias("loc"))
    said = hit.join(sets, ["fn", "loc"]).groupBy("edge_id").agg(F.collect_set("type").alias("types")).where(~F.array_contains("types", TOP)).select("edge_id", F.explode("types").alias("type"))
    rest = c.where(~exact & (F.col("recv_src_kind") == "construct") & F.col("recv_type_usr").isNotNull()).join(hit.select("edge_id"), "edge_id", "left_anti")
    plain = c.where(exact).unionByName(rest).select("edge_id", "dst_id", F.col("recv_type_usr").alias("type"))
    return plain.union(c.select("edge_id", "dst_id").join(said, "edge_id").select("edge_id", "dst_id", "type")).distinct()


def _picked(g: PropertyGraph, pairs: DataFrame, methods: DataFrame, ranges: DataFrame) -> DataFrame:
    """(dst_id, receiver, n): which override a call of ``dst_id`` picks where the object is a ``receiver``, for the pairs asked.

    It is the one of the nearest record upwards; of equally near ones the smallest id. As ``Navigator.selection``, but records
    are walked up only as far as none is found.
    """
    owned = derive.owners(g).select(F.col("member").alias("id"), F.col("owner").alias("at")).join(methods, "id")
    owned, up = materialize(owned.select("at", "id", "n")), materialize(g.adjacency("symbol.inherits"))
    key, last = ["dst_id", "receiver"], traverse.LEVELS_AT_ONCE - 1
    near = ranges.toDF("to", "lo", "hi")
    level = seen = pairs.select(*key, F.col("receiver").alias("at")).distinct()
    found = []
    while True:
        # A few levels in one job; of a pair that is found in one of them, the nearer counts.
        levels = [level.select(*key, "at", F.lit(0).alias("d"))]
        for d in range(1, last + 1):
            levels.append(levels[-1].join(up, levels[-1]["at"] == up["src"]).select(*key, F.col("dst").alias("at"), F.lit(d).alias("d")).distinct())
        every = reduce(DataFrame.union, levels).join(owned, "at", "left")
        every = every.join(near, (F.col("dst_id") == F.col("to")) & F.col("n").between(F.col("lo"), F.col("hi")), "left")
        every = materialize(every.where(F.col("to").isNotNull() | (F.col("d") == last)).select(*key, "at", "d", "id", "n", F.col("to").isNotNull().alias("hit")))
        hits = every.where("hit").groupBy(*key).agg(F.min_by("n", F.struct("d", "id")).alias("n"))
        found.append(hits)
        ahead = every.where(F.col("d") == last).join(hits, key, "left_anti").join(up, F.col("at") == up["src"]).select(*key, F.col("dst").alias("at")).distinct()
        level = _some(ahead.join(seen, [*key, "at"], "left_anti"))
        if level is None:
            return materialize(reduce(DataFrame.union, found))
        seen = materialize(seen.union(level)) if len(found) % traverse.DELTAS == 0 else seen.union(level)


def _reachable(g: PropertyGraph, every: DataFrame, starts: DataFrame) -> DataFrame:
    """Those of the calls ``every`` whose callers ``starts`` can reach; callers that are no starts are looked at only if there are."""
    start = starts.select(F.col("id").alias("src_id")).distinct()
    loose = _some(every.select("src_id").distinct().join(start, "src_id", "left_anti"))
    if loose is None:
        return every
    # Overrides are reached through calls of what they override, so both are followed here.
    ways = every.select("src_id", "dst_id").union(g.t("edge").where("kind = 6").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
    first = ways.join(start, "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct()
    reached = traverse.bfs(first, ways.join(start, "src_id", "left_anti").toDF("src", "dst").distinct()).select(F.col("id").alias("src_id"))
    return every.join(materialize(start.union(reached).distinct()), "src_id", "left_semi")


def devirtualized(g: PropertyGraph, starts: DataFrame) -> DataFrame:
    """(src, dst) of the calls of all functions that ``starts`` (id) can reach, virtual ones narrowed to their receivers.

    A call leads to the method it names, and where that is virtual, to the overrides that the types of its receiver pick.
    All overrides count where the types are not known, none of them picks any, or the targets of the method cannot be
    trusted to be all (``Navigator.dispatch_sites``).

    Methods are numbered so that what a call can land in is a range of numbers, or few of them. Calls carry ranges until those
    of a caller are put together, and only then become rows, so nothing is shuffled for each row of the result.
    """
    from .navigate import Navigator

    nav = Navigator(g)
    every = g.t("edge").where("kind = 1 and src_id is not null and dst_id is not null").select(F.col("id").alias("edge_id"), "src_id", "dst_id")
    calls = _reachable(g, every, starts)
    symbols = g.t("symbol")
    real = symbols.groupBy("id").agg(F.max(F.coalesce("is_pure", F.lit(0)) == 1).alias("pure"), F.max(F.coalesce("resolved", F.lit(1)) == 0).alias("stub"))
    numbers, ranges, open_ = overrides_in_order(g.t("edge").where("kind = 6 and src_id is not null and dst_id is not null").select("src_id", "dst_id"), real, calls.select(F.col("dst_id").alias("id")))
    there = symbols.where("parent_usr is not null").select("id", F.col("parent_usr").alias("usr")).join(symbols.select("usr"), "usr", "left_semi")
    trusted = materialize(ranges.select("id").distinct().join(open_, "id", "left_anti").join(there, "id", "left_semi").select(F.col("id").alias("dst_id")))
    bound = _read(nav, calls)
    sets = None if bound is None else type_sets(bound)
    records = symbols.where("kind in (2, 3, 4, 31) and usr is not null").select(F.col("id").alias("receiver"), F.col("usr").alias("type"))
    # Calls and sites are brought together in shares, one after the other, so that what they shuffle does not lie there all at once.
    shares = 1 + g.t("edge_site").count() // SHARE
    parts = []
    for i in range(shares):
        own = (lambda df: df) if shares == 1 else (lambda df, i=i: df.where(F.pmod(F.xxhash64("edge_id"), F.lit(shares)) == i))
        asked = lambda first, own=own: own(calls).join(first, "edge_id").join(trusted, "dst_id", "left_semi")
        types = receiver_types(asked, own(g.t("edge_site")), sets, nav)
        parts.append(materialize(types.join(records, "type").select("edge_id", "dst_id", "receiver")))
        del types
        gc.collect()
        tidy(g.spark)
    known = reduce(DataFrame.union, parts)
    picked = _picked(g, known.select("dst_id", "receiver"), numbers, ranges)
    kept = known.join(picked, ["dst_id", "receiver"]).select("edge_id", F.col("n").alias("pick")).distinct()
    gc.collect()
    tidy(g.spark)
    lands = ranges.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("lands"))
    to = numbers.join(lands, "id", "left").select(F.col("id").alias("dst_id"), "n", "lands", "inside")
    itself = lambda c: F.array(F.struct(F.col(c).alias("lo"), F.col(c).alias("hi")))
    wide = F.when(F.col("lands").isNull(), itself("n")).when(F.col("inside"), F.col("lands")).otherwise(F.concat("lands", itself("n")))
    runs = F.when(F.col("pick").isNull(), wide).otherwise(F.concat(itself("n"), itself("pick")))
    landed = calls.join(kept, "edge_id", "left").select("src_id", "dst_id", "pick").join(small(to), "dst_id")
    return expand(covered(landed.select(F.col("src_id").alias("src"), F.inline(runs))), numbers)
