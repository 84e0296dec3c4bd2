"""Queries on a call graph and on a class design made of the order tables, so that every kind of fact has rows.

Calls: orders call the parts they contain, each line is a call site with its arguments, and a part overrides the part of
half its number. Design: parts are records and templates, orders their methods, customers their fields, suppliers files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import derive, ir, navigate, rules, typesets
from ..engine import UNBOUNDED, Engine
from ..graph import PropertyGraph
from ..query_text import parse
from ..runtime import table
from .business import handovers, type_graph
from .graph_queries import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- Calls ------------------------------------------------------------------------------------------------------------------


def call_graph(spark: SparkSession, sf_dir: str, repeated: bool = False) -> PropertyGraph:
    """Order o is function 4 o + 1, part p method 4 p + 2 of record 4 p + 3. Some methods are pure, known by name only, or of
    an unknown record. The receiver of a call is exact where the line number is even.

    ``repeated``: sites and arguments that are delivered several times stay so, and count; for answers that do not depend on it."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    lines = lines if repeated else lines.distinct()
    orders, parts = table(spark, sf_dir, "orders", "o_orderkey"), table(spark, sf_dir, "part", "p_partkey", "p_size")
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    usr = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    one = F.lit(1)
    symbols = (
        orders.select((o * 4 + 1).alias("id"), usr("o:", o).alias("usr"), usr("o", o).alias("spelling"), F.lit(8).alias("kind"), F.lit(0).alias("is_pure"), one.alias("resolved"), F.lit(None).cast("string").alias("parent_usr"))
        .union(parts.select(p * 4 + 2, usr("p:", p), usr("p", p), F.lit(21), (F.col("p_size") % 5 == 0).cast("int"), (F.col("p_size") % 11 != 0).cast("int"), F.when(F.col("p_size") % 7 != 0, usr("r:", p))))
        .union(parts.select(p * 4 + 3, usr("r:", p), usr("r", p), F.lit(4), F.lit(0), one, F.lit(None)))
    )
    src, dst = F.col("l_orderkey") * 4 + 1, F.col("l_partkey") * 4 + 2
    edge = F.col("l_orderkey") * 10_000_000_000 + F.col("l_partkey")
    if repeated:  # laid out by id, as the sites of a call are
        calls = lines.groupBy(edge.alias("id")).agg(F.min(src).alias("src_id"), F.min(dst).alias("dst_id"), one.alias("kind"), F.count(one).alias("count"))
    else:
        calls = lines.groupBy("l_orderkey", "l_partkey").agg(F.count(one).alias("n")).select(edge.alias("id"), src.alias("src_id"), dst.alias("dst_id"), one.alias("kind"), F.col("n").alias("count"))
    over = parts.where("p_partkey > 0").select((-p * 3 - 1).alias("id"), (p * 4 + 2).alias("src_id"), (F.floor(p / 2) * 4 + 2).alias("dst_id"), F.lit(6).alias("kind"), one.cast("long").alias("count"))
    member = parts.select(-p * 3 - 2, p * 4 + 2, p * 4 + 3, F.lit(9), one.cast("long"))
    base = parts.where("p_partkey > 0").select(-p * 3 - 3, p * 4 + 3, F.floor(p / 2) * 4 + 3, F.lit(2), one.cast("long"))
    at = [edge.alias("edge_id"), F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("line"), F.lit(0).alias("col")]
    sites = lines.select(*at, (F.col("l_linenumber") % 2).alias("conditional"), F.col("l_suppkey").cast("string").alias("args_sig"), (F.col("l_suppkey") % 8 + 1).cast("int").alias("recv_src_kind_id"), F.col("l_partkey").alias("recv_type_id"), F.when(F.col("l_linenumber") % 3 == 0, dst).alias("recv_decl_id"), F.col("l_linenumber").alias("recv_param_pos"), (F.col("l_linenumber") % 2 == 0).cast("int").alias("recv_type_is_value"))
    args = lines.select(*at, F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), (F.col("l_partkey") % 8 + 1).cast("int").alias("src_kind_id"), F.when(F.col("l_linenumber") == 1, "given").alias("type_usr"), F.col("l_suppkey").alias("type_identity_id"), src.alias("decl_id"))
    types = parts.select(p.alias("id"), usr("t:", p).alias("type_key"), usr("r:", p).alias("decl_usr"), (p * 4 + 3).alias("decl_id"), F.lit(2).alias("kind"))
    names = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"), one.alias("identity_kind"), usr("s:", F.col("s_suppkey")).alias("identity_text"))
    return PropertyGraph(spark, {"symbol": symbols, "edge": calls.union(over).union(member).union(base), "edge_site": sites, "call_arg": args, "type_node": types, "external_identity": names})


_LINES = """lines AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
calls AS (SELECT o, p, count(*) AS n, min((s, n)) AS fst FROM lines GROUP BY ALL)"""
_BELOW = "below(base, p) AS (SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey > 0 UNION SELECT part.p_partkey // 2, b.p FROM below b JOIN part ON part.p_partkey = b.base AND b.base > 0)"
_EDGE_ID = "o * 10000000000 + p"
_SOURCE = "['literal', 'local', 'construct', 'member', 'global', 'call_result', 'this', 'unknown']"


def _parts(g: PropertyGraph) -> DataFrame:
    return g.t("symbol").where("kind = 21").select("id")


@entry("call_sites_into", f"""WITH {_LINES} SELECT p * 4 + 2 AS callee, o * 4 + 1 AS caller, {_EDGE_ID} AS edge_id, 'direct' AS via, struct_extract(fst, 1) AS file_id, struct_extract(fst, 2) AS line, 0 AS col, 2 * n AS args
FROM calls""")
def call_sites_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every method, with its first site: callers call several methods, and each call comes out once."""
    g = call_graph(spark, sf_dir)
    return navigate.Navigator(g).call_sites_into(_parts(g))


@entry("call_sites_by_dispatch", f"""WITH RECURSIVE {_LINES}, {_BELOW}, far AS (SELECT b.p AS callee, c.o FROM calls c JOIN below b ON b.base = c.p WHERE b.p <> c.p)
SELECT callee * 4 + 2 AS callee, count(*) AS calls, count(DISTINCT o) AS callers FROM far GROUP BY callee""")
def call_sites_by_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls come in through methods that a method overrides."""
    g = call_graph(spark, sf_dir)
    into = navigate.Navigator(g).call_sites_into(_parts(g), dispatch=True).where("via = 'dispatch'")
    return into.groupBy("callee").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("caller").alias("callers"))


@entry("call_args_at", f"""WITH {_LINES} SELECT {_EDGE_ID} AS edge_id, s AS file_id, n AS line, pos AS position, {_SOURCE}[p % 8 + 1] AS src_kind, coalesce(CASE WHEN n = 1 THEN 'given' END, 's:' || s) AS type_usr, 'o:' || o AS decl_usr
FROM lines, (VALUES (0), (1)) AS v(pos) WHERE n <= 2""")
def call_args_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded arguments at all sites in the first two lines."""
    g = call_graph(spark, sf_dir)
    return navigate.Navigator(g).call_args_at(g.t("edge_site").where("line <= 2")).select("edge_id", "file_id", "line", "position", "src_kind", "type_usr", "decl_usr")


@entry("receiver_provenance", f"""WITH {_LINES} SELECT {_EDGE_ID} AS edge_id, s AS file_id, n AS line, (n % 2) AS conditional, s::VARCHAR AS args_sig, {_SOURCE}[s % 8 + 1] AS recv_src_kind, 'r:' || p AS recv_type_usr,
  CASE WHEN n % 3 = 0 THEN 'p:' || p END AS recv_decl_usr, n AS recv_param_pos, (n % 2 = 0)::INTEGER AS recv_type_is_value FROM lines""")
def receiver_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = call_graph(spark, sf_dir)
    r = navigate.Navigator(g).receiver_provenance(g.t("edge_site"))
    return r.select("edge_id", "file_id", "line", F.col("conditional").cast("int").alias("conditional"), "args_sig", "recv_src_kind", "recv_type_usr", "recv_decl_usr", "recv_param_pos", "recv_type_is_value")


@entry("dispatch_targets", f"""WITH RECURSIVE {_BELOW}, t AS (SELECT p_partkey AS base, p_partkey AS p FROM part UNION SELECT base, p FROM below)
SELECT base * 4 + 2 AS origin, p * 4 + 2 AS id FROM t JOIN part ON p_partkey = p WHERE p_size % 5 <> 0""")
def dispatch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = call_graph(spark, sf_dir)
    return navigate.Navigator(g).dispatch_targets(_parts(g))


@entry("dispatch_sites", f"""WITH RECURSIVE {_BELOW}, t AS (SELECT p_partkey AS base, p_partkey AS p FROM part UNION SELECT base, p FROM below),
lands AS (SELECT base, count(*) AS targets, bool_or(p_size % 11 = 0) AS stub FROM t JOIN part ON p_partkey = p WHERE p_size % 5 <> 0 GROUP BY base),
ids AS (SELECT p_partkey * 4 + 2 AS origin, p_partkey AS base, p_size FROM part UNION ALL SELECT o_orderkey * 4 + 1, NULL, NULL FROM orders UNION ALL SELECT -1, NULL, NULL)
SELECT origin, CASE WHEN base IS NOT NULL AND p_size % 7 <> 0 THEN base * 4 + 3 END AS receiver,
  array_to_string(CASE WHEN origin = -1 THEN ['unknown-symbol'] WHEN base IS NULL THEN ['not-virtual'] ELSE list_filter([CASE WHEN p_size % 7 = 0 THEN 'no-receiver-type' END, CASE WHEN stub THEN 'target-stub' END, CASE WHEN targets IS NULL THEN 'pure-no-targets' END], lambda x: x IS NOT NULL) END, ';') AS reasons
FROM ids LEFT JOIN lands USING (base)""")
def dispatch_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods, functions and an id that nobody has."""
    g = call_graph(spark, sf_dir)
    ids = g.t("symbol").where("kind in (8, 21)").select("id").union(spark.range(-1, 0).select("id"))
    return navigate.Navigator(g).dispatch_sites(ids).select("origin", "receiver", F.array_join("reasons", ";").alias("reasons"))


@entry("dispatch_selection", f"""WITH RECURSIVE {_BELOW}, t AS (SELECT p_partkey AS base, p_partkey AS p FROM part UNION SELECT base, p FROM below),
lands AS (SELECT base, p FROM t JOIN part ON p_partkey = p WHERE p_size % 5 <> 0),
up(r, a, d) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT r, a // 2, d + 1 FROM up WHERE a > 0)
SELECT l.base * 4 + 2 AS origin, r * 4 + 3 AS receiver, arg_min(p, d) * 4 + 2 AS id FROM lands l JOIN up ON up.a = l.p GROUP BY l.base, r""")
def dispatch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every method and every record at or below one of its targets' records: the override that is picked."""
    g = call_graph(spark, sf_dir)
    return navigate.Navigator(g).selection(_parts(g))


@entry("dispatch_calls_counted", f"""WITH RECURSIVE {_LINES}, {_BELOW}
SELECT o * 4 + 1 AS src_id, b.p * 4 + 2 AS dst_id, arg_min(c.n, {_EDGE_ID.replace('p', 'c.p')}) AS count FROM calls c JOIN below b ON b.base = c.p GROUP BY o, b.p""")
def dispatch_calls_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several calls that may land in one method, the edge with the smallest id gives the count."""
    return derive.dispatch_calls(call_graph(spark, sf_dir)).select("src_id", "dst_id", "count")


@entry("edges_in", f"WITH {_LINES} SELECT {_EDGE_ID} AS id, o * 4 + 1 AS src_id, p * 4 + 2 AS dst_id, n AS count FROM calls JOIN part ON p_partkey = p WHERE p_size % 5 = 0")
def edges_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = call_graph(spark, sf_dir)
    return navigate.Navigator(g).edges(g.t("symbol").where("is_pure = 1").select("id"), "in", ["calls"]).select("id", "src_id", "dst_id", "count")


@entry("edges_with_sites", f"""WITH {_LINES}, r AS (SELECT {_EDGE_ID} AS id, s, n, row_number() OVER (PARTITION BY o, p ORDER BY s, n) AS k, count(*) OVER (PARTITION BY o, p) AS every FROM lines)
SELECT id, string_agg(s || ':' || n, ' ' ORDER BY s, n) FILTER (WHERE k <= 2) AS sites, (max(every) > 2)::INTEGER AS more FROM r GROUP BY id""")
def edges_with_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its first two sites, and whether there are more."""
    nav = navigate.Navigator(call_graph(spark, sf_dir))
    e = nav.edges(None, "out", ["calls"], sites=True, sites_cap=2)
    shown = F.transform("sites", lambda s: F.concat(s["file_id"].cast("string"), F.lit(":"), s["line"].cast("string")))
    return e.select("id", F.array_join(shown, " ").alias("sites"), F.col("more_sites").cast("int").alias("more"))


@entry("overrides", "SELECT DISTINCT (p_partkey // 2) * 4 + 2 AS id FROM part WHERE p_partkey > 0")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = call_graph(spark, sf_dir)
    return navigate.Navigator(g).overrides(_parts(g))


@entry("virtual_methods", "SELECT p_partkey * 4 + 2 AS id FROM part UNION SELECT (p_partkey // 2) * 4 + 2 FROM part WHERE p_partkey > 0")
def virtual_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.Navigator(call_graph(spark, sf_dir)).virtual_methods()


@entry("engine_path", """WITH RECURSIVE goal AS (SELECT p_partkey AS p FROM part WHERE p_size % 11 = 0), w(start, p, d, trail) AS (SELECT p_partkey, p_partkey // 2, 1, [p_partkey * 4 + 2, (p_partkey // 2) * 4 + 2] FROM part WHERE p_partkey > 0
  UNION ALL SELECT start, p // 2, d + 1, list_append(trail, (p // 2) * 4 + 2) FROM w WHERE p > 0 AND d < 8 AND p NOT IN (SELECT p FROM goal))
SELECT start * 4 + 2 AS start, p * 4 + 2 AS target, d::INTEGER AS length, array_to_string(trail, '/') AS trail, 'complete' AS status FROM w WHERE p IN (SELECT p FROM goal) AND start IN (SELECT p_partkey FROM part)""")
def engine_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every method the way up its overrides to the nearest that is known by name only."""
    g = call_graph(spark, sf_dir)
    marked = g.replaced(symbol=g.t("symbol").withColumn("is_static", F.when(F.col("resolved") == 0, 1).otherwise(0)))
    found = Engine(marked, UNBOUNDED).frame(parse("codebase() | nodes(kind = method) | path(to=codebase() | nodes(kind = method and is_static = 1), overrides, 1..8)"))
    return found.select("start", "target", "length", F.array_join("trail", "/").alias("trail"), "status")


@entry("devirtualized_calls", f"""WITH RECURSIVE {_LINES}, {_BELOW}, t AS (SELECT p_partkey AS base, p_partkey AS p FROM part UNION SELECT base, p FROM below),
lands AS (SELECT base, p FROM t JOIN part ON p_partkey = p WHERE p_size % 5 <> 0),
trusted AS (SELECT base FROM t JOIN part a ON a.p_partkey = base LEFT JOIN part b ON b.p_partkey = p AND b.p_size % 5 <> 0 WHERE a.p_size % 7 <> 0 GROUP BY base HAVING count(b.p_partkey) > 0 AND NOT bool_or(coalesce(b.p_size % 11 = 0, false))),
first AS (SELECT o, p, struct_extract(fst, 1) AS s, struct_extract(fst, 2) AS n FROM calls),
exact AS (SELECT o, p FROM first JOIN trusted ON base = p JOIN part ON p_partkey = p WHERE p_size % 5 <> 0 AND ((n % 2 = 0 AND s % 8 IN (1, 3, 4, 5)) OR s % 8 = 2)),
hit AS (SELECT o, p, p AS q FROM calls UNION SELECT c.o, c.p, l.p FROM calls c JOIN lands l ON l.base = c.p WHERE (c.o, c.p) NOT IN (SELECT o, p FROM exact))
SELECT DISTINCT o * 4 + 1 AS src, q * 4 + 2 AS dst FROM hit""")
def devirtualized_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each call may land, given what can be known of its receiver: nobody calls the callers here, so a receiver is
    known where it is an exact value or constructed on the spot."""
    g = call_graph(spark, sf_dir, repeated=True)
    return typesets.devirtualized(g, g.t("symbol").where("kind = 8").select("id"))


# --- Design -----------------------------------------------------------------------------------------------------------------


def design_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Part p is record 16 p + 1 (a template where p is a multiple of 7, a struct where p % 7 = 1), named ``P<p>``; order o is
    method 16 o + 2 and customer c field 16 c + 3 of parts; nation n is namespace 16 n + 4."""
    parts, orders = table(spark, sf_dir, "part", "p_partkey", "p_size"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers, nations = table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "nation", "n_nationkey")
    p, o, c, n = F.col("p_partkey"), F.col("o_orderkey"), F.col("c_custkey"), F.col("n_nationkey")
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, F.Column) else F.lit(x) for x in xs])
    none, zero, one = F.lit(None).cast("string"), F.lit(0), F.lit(1)
    target = c % 90
    spelled = (
        F.when(c % 8 == 0, text("std::vector<P", target, ">")).when(c % 8 == 1, text("std::shared_ptr<P", target, ">")).when(c % 8 == 2, text("const P", target, " *")).when(c % 8 == 3, text("std::map<int, std::unique_ptr<P", target, "> >"))
        .when(c % 8 == 4, text("P", target, "[3]")).when(c % 8 == 5, text("P", target)).when(c % 8 == 6, text("std::vector<" * 7, "std::weak_ptr<P", target, ">" * 8)).otherwise(text("std::optional<P", target, ">"))
    )
    kind = F.when(p % 7 == 0, 31).when(p % 7 == 1, 2).otherwise(4)
    symbols = (
        parts.select((p * 16 + 1).alias("id"), text("p:", p).alias("usr"), text("P", p).alias("spelling"), text("design::P", p).alias("qual_name"), kind.alias("kind"), none.alias("type_info"), none.alias("access"), zero.alias("is_pure"), (p % 5 == 0).cast("int").alias("is_named_instance"), none.alias("parent_usr"), (F.col("p_size") * 1).cast("long").alias("file_id"))
        .union(orders.select(o * 16 + 2, text("o:", o), text("m", o), none, F.lit(21), F.when(o % 6 == 0, text("P", o % 90, " (int)")).when(o % 6 == 1, F.lit("void ()")), none, ((o % 9 == 0) | (F.col("o_custkey") % 200 % 4 == 0)).cast("int"), zero, none, (o % 100).cast("long")))
        .union(customers.select(c * 16 + 3, text("c:", c), text("f", c), none, F.lit(6), spelled, F.when(c % 3 == 1, "private").when(c % 3 == 2, "protected"), zero, zero, none, F.lit(None).cast("long")))
        .union(nations.select(n * 16 + 4, text("n:", n), text("n", n), none, F.lit(22), none, none, zero, zero, none, F.lit(None).cast("long")))
    )

    def edges(df: DataFrame, number: int, src, dst, edge_kind, key) -> DataFrame:
        code = edge_kind if isinstance(edge_kind, F.Column) else F.lit(edge_kind)
        return df.select((key * 100 + number).alias("id"), src.cast("long").alias("src_id"), dst.cast("long").alias("dst_id"), code.cast("int").alias("kind"), one.cast("long").alias("count"), (key % 3).cast("int").alias("base_access"), (key % 2).cast("int").alias("is_virtual"))

    rec = lambda x: x * 16 + 1
    met = lambda x: x * 16 + 2
    owner = F.col("o_custkey") % 200
    every = [
        edges(parts.where("p_partkey > 0"), 1, rec(p), rec(F.floor(p / 2)), 2, p),
        edges(parts.where("p_partkey % 7 = 2"), 2, rec(p), rec(p - 2), 4, p),
        edges(parts.where("p_partkey % 7 = 3"), 3, rec(p), rec(p - 3), 5, p),
        edges(orders, 4, met(o), rec(owner), 9, o),
        edges(customers, 5, c * 16 + 3, rec(c % 150 * 2 + 1), 8, c),
        edges(orders, 6, met(o), rec(o % 400), (F.lit(10) + o % 7), o),
        edges(orders.where("o_orderkey > 0"), 7, met(o), met(F.floor(o / 2)), F.when(o % 2 == 0, 1).otherwise(7), o),
        edges(parts.where("p_partkey % 10 = 0"), 8, rec(p), rec(p + 1), 17, p),
        edges(parts, 9, (p % 25) * 16 + 4, rec(p), 3, p),
        edges(customers.where("c_custkey % 8 = 5 and c_custkey % 11 = 0"), 10, c * 16 + 3, rec(F.floor(c % 90 / 5) * 5), 20, c),
    ]
    out = every[0]
    for e in every[1:]:
        out = out.union(e)
    bound = parts.where("p_partkey % 7 = 3").select(rec(p).alias("owner_id"), F.lit(0).alias("position"), F.lit(0).alias("pack_index"), one.alias("arg_kind"), rec(p % 50).alias("ref_id"))
    return PropertyGraph(spark, {"symbol": symbols, "edge": out, "template_arg": bound})


_DESIGN = """part_ AS (SELECT p_partkey AS p FROM part), met AS (SELECT o_orderkey AS o, o_custkey % 200 AS own, o_orderkey % 9 = 0 OR o_custkey % 200 % 4 = 0 AS pure FROM orders WHERE (o_custkey % 200) % 7 <> 0 AND o_custkey % 200 IN (SELECT p_partkey FROM part)),
rec AS (SELECT p FROM part_ WHERE p % 7 <> 0),
prim(p, q) AS (SELECT p, CASE WHEN p % 7 = 2 AND p - 2 >= 0 THEN p - 2 WHEN p % 7 = 3 AND p - 3 >= 0 THEN p - 3 ELSE p END FROM part_),
face AS (SELECT p FROM part_ JOIN (SELECT o_custkey % 200 AS own, bool_or(o_orderkey % 9 = 0 OR o_custkey % 200 % 4 = 0) AS pure, bool_or(NOT (o_orderkey % 9 = 0 OR o_custkey % 200 % 4 = 0)) AS solid FROM orders GROUP BY 1) ON own = p WHERE pure AND NOT solid AND p NOT IN (SELECT c_custkey % 150 * 2 + 1 FROM customer)),
every_field AS (SELECT c_custkey AS c, c_custkey % 150 * 2 + 1 AS own, c_custkey % 90 AS t, c_custkey % 8 AS form, CASE c_custkey % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS acc,
  CASE WHEN c_custkey % 8 = 5 AND c_custkey % 11 = 0 AND ((c_custkey % 90) // 5) * 5 IN (SELECT p FROM part_) THEN ((c_custkey % 90) // 5) * 5 END AS named FROM customer),
fields AS (SELECT * FROM every_field WHERE own % 7 <> 0 AND own IN (SELECT p FROM part_)),
pointed AS (SELECT f.*, coalesce(named, CASE WHEN t % 7 <> 0 AND t IN (SELECT p FROM part_) THEN t END) AS dst FROM fields f),
raw AS (
  SELECT a.q AS src, e.p // 2 AS dst, CASE WHEN e.p // 2 IN (SELECT p FROM face) THEN 2 ELSE 1 END AS kind, NULL::BIGINT AS via, NULL::INTEGER AS form, 1 AS many, e.p % 3 AS acc, e.p % 2 AS virt, 0 AS part, e.p * 100 + 1 AS ord
    FROM part_ e JOIN prim a ON a.p = e.p WHERE e.p > 0 AND e.p % 7 <> 0 AND (e.p // 2) % 7 <> 0
  UNION ALL SELECT e.p, a.q, 3, NULL, NULL, 1, 0, 0, 0, 0 FROM part_ e JOIN prim a ON a.p = e.p - 2 WHERE e.p % 7 = 2
  UNION ALL SELECT e.p, a.q, 11, NULL, NULL, 1, 0, 0, 0, 0 FROM part_ e JOIN prim a ON a.p = e.p - 3 WHERE e.p % 7 = 3
  UNION ALL SELECT a.q, CASE WHEN named IS NOT NULL THEN named ELSE b.q END, CASE form WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 6 THEN 6 ELSE 4 END, c * 16 + 3, NULL, CASE form WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 1 WHEN 6 THEN 3 ELSE 2 END, acc, 0, 0, 0
    FROM pointed f JOIN prim a ON a.p = own JOIN prim b ON b.p = dst WHERE dst % 7 <> 0
  UNION ALL SELECT i.p, t, CASE form WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 6 THEN 6 ELSE 4 END, c * 16 + 3, NULL, CASE form WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 1 WHEN 6 THEN 3 ELSE 2 END, acc, 0, 0, 0
    FROM part_ i JOIN every_field f ON f.own = i.p - 3 WHERE i.p % 7 = 3 AND i.p % 5 = 0 AND t % 7 <> 0 AND t IN (SELECT p FROM part_)
  UNION ALL SELECT a.q, b.q, 7, NULL, 2, 1, 0, 0, 1, 0 FROM met m JOIN prim a ON a.p = own JOIN prim b ON b.p = m.o % 90 WHERE m.o % 6 = 0 AND (m.o % 90) % 7 <> 0
  UNION ALL SELECT a.q, b.q, CASE WHEN m.o % 7 = 6 THEN 9 ELSE 7 END, NULL, CASE m.o % 7 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 7 WHEN 4 THEN 8 WHEN 5 THEN 6 END, 1, 0, 0, (m.o % 7 = 5)::INTEGER, 0
    FROM met m JOIN prim a ON a.p = own JOIN prim b ON b.p = m.o % 400 WHERE (m.o % 400) % 7 <> 0
  UNION ALL SELECT a.q, b.q, 8, d.o * 16 + 2, NULL, 1, 0, 0, d.pure::INTEGER, 0 FROM met m JOIN met d ON d.o = m.o // 2 AND m.o > 0 JOIN prim a ON a.p = m.own JOIN prim b ON b.p = d.own
  UNION ALL SELECT e.p, e.p + 1, 10, NULL, NULL, 1, 0, 0, 0, 0 FROM rec e WHERE e.p % 10 = 0 AND e.p + 1 IN (SELECT p FROM rec)),
kept AS (SELECT * FROM raw WHERE src <> dst),
merged AS (SELECT src, dst, kind, via, form, CASE WHEN kind IN (1, 2) THEN 1 ELSE count(*) END AS count, max(many) AS many, max((ord, acc, virt)) AS last, max(part) AS part FROM kept GROUP BY src, dst, kind, via, form),
design AS (SELECT src * 16 + 1 AS src_id, dst * 16 + 1 AS dst_id, kind, count, via AS via_member_id, many AS multiplicity, struct_extract(last, 2)::INTEGER AS access, struct_extract(last, 3)::INTEGER AS is_virtual, form AS create_form, part AS partial FROM merged
  UNION ALL SELECT (p % 25) * 16 + 4, p * 16 + 1, 12, 1, NULL, 1, 0, 0, NULL, 0 FROM part_ WHERE p % 25 IN (SELECT n_nationkey FROM nation))"""


@entry("entity_design", f"WITH {_DESIGN} SELECT * FROM design")
def entity_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection onto entities where every phase gives rows: inheritance and implementation, specialisation,
    instantiation, fields by type spelling, creation and destruction, by-value returns, uses, friends, declarations."""
    return derive.entity_edges(design_graph(spark, sf_dir))


@entry("entity_design_kinds", f"WITH {_DESIGN} SELECT kind, count(*) AS edges, sum(count)::BIGINT AS total FROM design GROUP BY kind")
def entity_design_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges each phase gives: none is empty."""
    return entity_design(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("count").alias("total"))


@entry("entity_design_nodes", """WITH facts AS (SELECT o_custkey % 200 AS p, bool_or(o_orderkey % 9 = 0 OR o_custkey % 200 % 4 = 0) AS pure, bool_or(NOT (o_orderkey % 9 = 0 OR o_custkey % 200 % 4 = 0)) AS solid FROM orders GROUP BY 1),
d AS (SELECT DISTINCT c_custkey % 150 * 2 + 1 AS p FROM customer)
SELECT p_partkey * 16 + 1 AS id, (CASE WHEN pure AND NOT solid AND d.p IS NULL THEN 3 WHEN pure THEN 2 ELSE 1 END + CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 0 END)::INTEGER AS kind
FROM part LEFT JOIN facts ON facts.p = p_partkey LEFT JOIN d ON d.p = p_partkey UNION ALL SELECT n_nationkey * 16 + 4, 9 FROM nation""")
def entity_design_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, abstract ones and interfaces, templates likewise, namespaces."""
    return derive.entity_nodes(design_graph(spark, sf_dir))


@entry("cross_repository_edges", """WITH place AS (SELECT s_suppkey AS f, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey), placed AS (SELECT p_partkey AS p, r FROM part JOIN place ON f = p_size)
SELECT a.p * 16 + 1 AS src_id, b.p * 16 + 1 AS dst_id, a.r AS src_repository, b.r AS dst_repository FROM placed a JOIN placed b ON b.p = a.p // 2 AND a.p > 0 WHERE a.r <> b.r""")
def cross_repository_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inheritance over the border of repositories: suppliers are files, nations directories and components, regions repositories."""
    g = design_graph(spark, sf_dir)
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("repository_id"))
    files = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("directory_id"))
    placed = g.replaced(file=files, directory=nation.select("id", F.col("id").alias("component_id")), component=nation)
    e = navigate.Navigator(placed).cross_repository_edges().where("kind = 2")
    return e.select("src_id", "dst_id", F.col("src_repository").cast("int").alias("src_repository"), F.col("dst_repository").cast("int").alias("dst_repository"))


@entry("template_bindings", "SELECT p_partkey * 16 + 1 AS owner_id, 0 AS position, (p_partkey % 50) * 16 + 1 AS ref_id FROM part WHERE p_partkey % 7 = 3")
def template_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = design_graph(spark, sf_dir)
    return navigate.Navigator(g).template_args(g.t("symbol").select("id")).select("owner_id", "position", "ref_id")


@entry("instantiations", "SELECT p_partkey * 16 + 1 AS id FROM part WHERE p_partkey % 7 = 3 AND p_partkey >= 3")
def instantiations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = navigate.Navigator(design_graph(spark, sf_dir))
    return nav.instantiations(nav.of_kind("class-template").select("id"))


for _name, _pred, _where in (
    ("macro_inherits_from", ir.inherits_from("P1"), "p_partkey // 2 = 1 AND p_partkey > 0"),
    ("macro_has_field", ir.has_field(), "p_partkey IN (SELECT c_custkey % 150 * 2 + 1 FROM customer)"),
    ("macro_is_specialization_of", ir.is_specialization_of("P7"), "p_partkey = 9"),
    ("macro_is_instance", ir.is_instance(), "p_partkey % 7 = 3 AND p_partkey >= 3"),
    ("macro_is_template", ir.is_template(), "p_partkey % 7 = 0"),
    ("macro_any_target", ir.inherits_from(ir.any_target(["P1", "P2"])), "p_partkey // 2 IN (1, 2) AND p_partkey > 0"),
    ("macro_no_target", ir.inherits_from(ir.no_targets(["P1", "P2"])), "(p_partkey = 0 OR p_partkey // 2 NOT IN (1, 2))"),
):

    @entry(_name, f"SELECT p_partkey * 16 + 1 AS id FROM part WHERE {_where}")
    def _macro(spark: SparkSession, sf_dir: str, pred: ir.Pred = _pred) -> DataFrame:
        g = design_graph(spark, sf_dir)
        plan = ir.start(ir.codebase()) | ir.nodes(ir.all_of([ir.in_list("kind", ["class", "struct", "class-template"]), pred])) | ir.select(["id"])
        return Engine(g, UNBOUNDED).frame(plan)


@entry("macro_has_ancestor", "WITH RECURSIVE w(p, a) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT p, a // 2 FROM w WHERE a > 0) SELECT DISTINCT p * 16 + 1 AS id FROM w WHERE a = 3")
def macro_has_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(design_graph(spark, sf_dir), UNBOUNDED).frame(ir.start(ir.codebase()) | ir.nodes(ir.has_ancestor("P3")) | ir.select(["id"]))


@entry("source_entity", "SELECT 49 AS id, 'P3' AS spelling")
def source_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity by name; a method of that name would be none."""
    g = design_graph(spark, sf_dir)
    return Engine(g.replaced(entity_node=derive.entity_nodes(g)), UNBOUNDED).frame(parse('entity("P3") | select(id, spelling)'))


@entry("result_cap", "SELECT o_orderkey * 16 + 2 AS id FROM orders ORDER BY 1 LIMIT 1000")
def result_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a limit of its own, a plan gives the first thousand rows: the cap is what is shown here."""
    from ..engine import Budgets

    return Engine(design_graph(spark, sf_dir), Budgets(enumerate=None)).frame(parse("codebase() | nodes(kind = method) | select(id)"))


# --- Identities and signatures ------------------------------------------------------------------------------------------------


@entry("portable_edges", f"""WITH {_LINES} SELECT 'edge:' || chr(31) || 'o:' || o || ':1:' || chr(31) || 'p:' || p AS identity_key, n AS count FROM calls""")
def portable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges by identities that do not depend on the numbers of this index."""
    return Engine(call_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | view(edge) | nodes(kind = 1) | select(identity_key, count)"))


@entry("signature_text", """WITH lines AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
placed AS (SELECT *, row_number() OVER (PARTITION BY o, n ORDER BY p, s) - 1 AS pack FROM lines),
params AS (SELECT o, string_agg(p_type, ', ' ORDER BY n, pack, p_type) AS t FROM placed JOIN part ON p_partkey = p GROUP BY o)
SELECT o_orderkey AS owner_id, p_type || ' ' || o_orderkey || '(' || coalesce(t, '') || ')' AS text FROM orders JOIN part ON p_partkey = o_custkey % 100 LEFT JOIN params ON o = o_orderkey""")
def signature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = type_graph(spark, sf_dir)
    return navigate.Navigator(g).signature_text(g.t("symbol").select("id"))


@entry("parameter_index", """SELECT l_orderkey AS owner_id, l_linenumber AS position, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS ordinal
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)""")
def parameter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each parameter among those of its function."""
    return derive.ordinals(type_graph(spark, sf_dir).t("parameter"), "owner_id", ["position", "pack_index"]).select("owner_id", "position", "ordinal")


# --- Rules ------------------------------------------------------------------------------------------------------------------


def _handover_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    hand = handovers(spark, sf_dir)
    return {"edge": hand.select("src", F.lit(1).alias("kind"), "dst"), "symbol": table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", F.lit(8).alias("kind"), F.lit(1).alias("d"))}


_HAND = """hand AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
reach(src, dst) AS (SELECT src, dst FROM hand UNION SELECT r.src, h.dst FROM reach r JOIN hand h ON h.src = r.dst)"""


@entry("handover_cycle_edges", f"WITH RECURSIVE {_HAND} SELECT src, dst FROM hand WHERE (dst, src) IN (SELECT src, dst FROM reach)")
def handover_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-overs that lie on a cycle."""
    return rules.cycle_edges(_handover_facts(spark, sf_dir))


@entry("handover_impact", f"WITH RECURSIVE {_HAND} SELECT s_suppkey AS id, coalesce(n, 0) AS radius FROM supplier LEFT JOIN (SELECT dst, count(*) AS n FROM reach GROUP BY 1) ON dst = s_suppkey")
def handover_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From how many suppliers goods can come to each."""
    return rules.impact_radius(_handover_facts(spark, sf_dir))


_PROGRAM = """
// Suppliers two hand-overs apart that do not hand over directly, and how many there are of them for each.
.decl two(a: number, c: number)
two(a, c) :- edge(a, 1, b), edge(b, 1, c), a < c, !direct(a, c).
direct(a, c) :- edge(a, 1, c).
apart(a, n) :- n = count : { two(a, _) }.
.output apart
"""


@entry("rule_program_text", f"""WITH RECURSIVE {_HAND}, two AS (SELECT DISTINCT a.src, b.dst FROM hand a JOIN hand b ON b.src = a.dst WHERE a.src < b.dst AND (a.src, b.dst) NOT IN (SELECT src, dst FROM hand))
SELECT src AS id, count(*) AS n FROM two GROUP BY src""")
def rule_program_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program as text, with a condition, a negation and a count."""
    program, outputs = rules.parse_program(_PROGRAM)
    return program.run(_handover_facts(spark, sf_dir), outputs)["apart"].toDF("id", "n")
