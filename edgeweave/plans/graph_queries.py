"""Queries of the graph engine over the code-index and order tables, each with its SQL equivalent.

All run on whole tables. Budgets are off, except where the budget is what is shown.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import derive, facts, graphview, includes, ir, navigate, rules, search
from ..query_text import parse
from ..diff import match
from ..engine import UNBOUNDED, Budgets, Engine
from ..functions.text import basename, fuzzy, interpolate, top_level_namespace
from ..graph import code_index
from ..operators import traverse
from ..runtime import materialize, table
from ..streaming.rollups import first_claims, incremental
from .business import HANDOVER_SQL, ORDER_SQL, TYPES_SQL, handovers, order_graph, type_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- SQL of the code graph ----------------------------------------------------------------------------------------------

SYM = "sym AS (SELECT * FROM symbol WHERE deleted_at IS NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
EE = """ee AS (SELECT src_id, dst_id, kind, via_member_id, create_form, max(count) AS count FROM entity_edge
  WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND kind IS NOT NULL GROUP BY ALL)"""
EDGE = f"""{SYM}, {EE}, edge AS (SELECT src_id, dst_id, kind, sum(count)::BIGINT AS count FROM (
  SELECT parent_id AS src_id, id AS dst_id, 3 AS kind, 1 AS count FROM sym WHERE parent_id IS NOT NULL
  UNION ALL SELECT id, parent_id, 8, 1 FROM sym WHERE parent_id IS NOT NULL AND kind = 6
  UNION ALL SELECT id, parent_id, 9, 1 FROM sym WHERE parent_id IS NOT NULL AND kind IN (21, 24, 25)
  UNION ALL SELECT src_id, dst_id, 2, count FROM ee WHERE kind IN (1, 2)
  UNION ALL SELECT src_id, via_member_id, 1, count FROM ee WHERE kind = 8 AND via_member_id IS NOT NULL
  UNION ALL SELECT src_id, dst_id, 4, count FROM ee WHERE kind = 3
  UNION ALL SELECT src_id, dst_id, 5, count FROM ee WHERE kind = 11
  UNION ALL SELECT src_id, dst_id, 17, count FROM ee WHERE kind = 10) GROUP BY ALL)"""
NAME = "coalesce(qual_name, spelling)"
ENT = "ent AS (SELECT id FROM sym WHERE kind IN (2, 3, 4, 5, 22, 31) UNION SELECT src_id FROM ee UNION SELECT dst_id FROM ee)"


def entry(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def plan_query(name: str, text: str | ir.Plan, sql: str, budgets: Budgets = UNBOUNDED, after_id: int | None = None) -> None:
    """A query that is a plan on the code graph."""

    @entry(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(code_index(spark, sf_dir), budgets, after_id).frame(parse(text) if isinstance(text, str) else text)


# --- Enumeration, predicates, shaping -------------------------------------------------------------------------------------

plan_query("enumerate_eq", "codebase() | nodes(kind = class) | select(id, name, kind)", f"WITH {SYM} SELECT id, {NAME} AS name, kind FROM sym WHERE kind = 4")
plan_query("enumerate_glob", 'codebase() | nodes(name ~ "co?e::[A-M]*") | select(id, name)', f"WITH {SYM} SELECT id, {NAME} AS name FROM sym WHERE {NAME} GLOB 'co?e::[A-M]*'")
plan_query("enumerate_in", "codebase() | nodes(kind in [method, constructor, destructor]) | select(id, spelling)", f"WITH {SYM} SELECT id, spelling FROM sym WHERE kind IN (21, 24, 25)")
plan_query(
    "enumerate_bool_tree", 'codebase() | nodes((kind = class or kind = struct) and not (name ~ "*Chain*" or is_definition = 0)) | select(id, usr)',
    f"WITH {SYM} SELECT id, usr FROM sym WHERE kind IN (2, 4) AND NOT ({NAME} GLOB '*Chain*' OR is_definition = 0)",
)
plan_query("where_unknown_excluded", 'codebase() | nodes() | where(qual_name != "core") | select(id)', f"WITH {SYM} SELECT id FROM sym WHERE qual_name <> 'core'")
plan_query("where_unknown_included", 'codebase() | nodes() | where(qual_name != "core", unknown=include) | select(id)', f"WITH {SYM} SELECT id FROM sym WHERE coalesce(qual_name <> 'core', true)")
plan_query(
    "resolve_source_tiers", 'symbol("buffer_") | select(id, usr, spelling)',
    f"""WITH {SYM}, t AS (SELECT id, usr, spelling, CASE WHEN usr = 'buffer_' THEN 1 WHEN qual_name = 'buffer_' THEN 2 WHEN spelling = 'buffer_' THEN 3 END AS tier FROM sym)
SELECT id, usr, spelling FROM t WHERE tier = (SELECT min(tier) FROM t)""",
)
plan_query("enumerate_budget", "codebase() | nodes() | select(id, kind)", f"WITH {SYM} SELECT id, kind FROM sym ORDER BY id LIMIT 1000", Budgets(enumerate=1000, rows=None))
plan_query("cursor_page", "codebase() | nodes() | select(id, spelling)", f"WITH {SYM} SELECT id, spelling FROM sym WHERE id > 1000 ORDER BY id LIMIT 500", Budgets(enumerate=500, rows=None), 1000)
plan_query("select_order_limit", "codebase() | nodes() | select(id, qual_name, kind) | order_by(qual_name, kind) | limit(500)", f"WITH {SYM} SELECT id, qual_name, kind FROM sym ORDER BY qual_name ASC NULLS LAST, kind, id LIMIT 500")
plan_query("order_nulls_last", "codebase() | nodes() | select(id, qual_name) | order_by(qual_name) | limit(100000000)", f"WITH {SYM} SELECT id, qual_name FROM sym")
plan_query("distinct_rows", "codebase() | nodes() | select(kind, is_definition, semantic_universe) | distinct()", f"WITH {SYM} SELECT DISTINCT kind, is_definition, NULL::VARCHAR AS semantic_universe FROM sym")
plan_query("count_scalar", "codebase() | nodes(kind = method) | count()", f"WITH {SYM} SELECT count(*) AS count FROM sym WHERE kind = 21")
plan_query("default_projection", "codebase() | nodes(kind = namespace)", f"WITH {SYM} SELECT id, usr, NULL::VARCHAR AS semantic_universe, identity_key, {NAME} AS name, kind FROM sym WHERE kind = 22")
plan_query("view_entity", "codebase() | nodes() | view(entity) | select(id)", f"WITH {SYM}, {EE}, {ENT} SELECT id FROM ent SEMI JOIN sym USING (id)")
plan_query("entity_domain", "codebase() | view(entity) | nodes() | count()", f"WITH {SYM}, {EE}, {ENT} SELECT count(*) AS count FROM ent")

# --- Set operations -------------------------------------------------------------------------------------------------------

_A, _B = "kind IN (4, 2)", "is_definition = 1"
for _op in ("union", "intersect", "except"):
    plan_query(
        f"set_{_op}", f"codebase() | nodes(kind in [class, struct]) | {_op}(codebase() | nodes(is_definition = 1)) | select(id)",
        f"WITH {SYM} SELECT id FROM sym WHERE {_A} {_op.upper()} SELECT id FROM sym WHERE {_B}",
    )

# --- Quantifiers ------------------------------------------------------------------------------------------------------------


def _quantified_sql(kind: int, value: str, target: str = "true", policy: str = "IS TRUE", inbound: bool = False) -> str:
    """t, f, u: related entities for which the target condition is true, false, unknown."""
    a, b = ("dst_id", "src_id") if inbound else ("src_id", "dst_id")
    return f"""WITH {SYM}, {EE}, {ENT}, pairs AS (SELECT DISTINCT {a} AS id, {b} AS other FROM ee WHERE kind = {kind}),
judged AS (SELECT p.id, CASE WHEN s.id IS NULL AND '{target}' <> 'true' THEN NULL ELSE ({target}) END AS holds FROM pairs p LEFT JOIN sym s ON s.id = p.other),
counts AS (SELECT id, count(*) FILTER (holds) AS t, count(*) FILTER (NOT holds) AS f, count(*) FILTER (holds IS NULL) AS u FROM judged GROUP BY id),
truth AS (SELECT e.id, {value} AS v FROM (SELECT ent.id, coalesce(t, 0) AS t, coalesce(f, 0) AS f, coalesce(u, 0) AS u FROM ent LEFT JOIN counts USING (id)) e)
SELECT id FROM truth WHERE v {policy}"""


# generalizes (1) is complete; uses (8) is partial: without a witness it is unknown there.
_E = "codebase() | view(entity) | nodes({}) | select(id)"
_CLOSED = {"exists": "CASE WHEN t > 0 THEN true WHEN u = 0 THEN false END", "none": "CASE WHEN t > 0 THEN false WHEN u = 0 THEN true END", "all": "CASE WHEN f > 0 THEN false WHEN u = 0 THEN true END"}
_OPEN = {"exists": "CASE WHEN t > 0 THEN true END", "none": "CASE WHEN t > 0 THEN false END", "all": "CASE WHEN f > 0 THEN false END"}
for _q in ("exists", "none", "all"):
    plan_query(f"quant_{_q}_complete", _E.format(f"{_q}(generalizes, kind = class)"), _quantified_sql(1, _CLOSED[_q], "s.kind = 4"))
    plan_query(f"quant_{_q}_partial", _E.format(f"{_q}(uses, kind = class), unknown=include"), _quantified_sql(8, _OPEN[_q], "s.kind = 4", "IS NOT FALSE"))
plan_query("quant_at_least_complete", _E.format("at_least(2, in generalizes)"), _quantified_sql(1, "CASE WHEN t >= 2 THEN true WHEN u = 0 THEN false END", inbound=True))
plan_query("quant_at_least_partial", _E.format("at_least(3, uses)"), _quantified_sql(8, "CASE WHEN t >= 3 THEN true END"))
plan_query("quant_exactly_complete", _E.format("exactly(1, generalizes)"), _quantified_sql(1, "CASE WHEN t > 1 THEN false WHEN u = 0 THEN t = 1 END"))
plan_query("quant_exactly_partial", _E.format("not exactly(1, composes)"), _quantified_sql(4, "NOT CASE WHEN t > 1 THEN false END"))
plan_query(
    "quant_nested", _E.format("exists(in generalizes, exists(in generalizes, kind = class))"),
    f"""WITH {SYM}, {EE}, {ENT}, g AS (SELECT DISTINCT src_id, dst_id FROM ee WHERE kind = 1)
SELECT id FROM ent WHERE id IN (SELECT a.dst_id FROM g a JOIN g b ON b.dst_id = a.src_id JOIN sym s ON s.id = b.src_id WHERE s.kind = 4)""",
)
plan_query(
    "quant_multihop", _E.format("exists(generalizes, kind = class, 2..4)"),
    f"""WITH RECURSIVE {SYM}, {EE}, {ENT}, g AS (SELECT DISTINCT src_id, dst_id FROM ee WHERE kind = 1),
w(origin, id, d) AS (SELECT src_id, dst_id, 1 FROM g UNION SELECT w.origin, g.dst_id, d + 1 FROM w JOIN g ON g.src_id = w.id WHERE d < 4)
SELECT id FROM ent WHERE id IN (SELECT origin FROM w JOIN sym s ON s.id = w.id WHERE d BETWEEN 2 AND 4 AND s.kind = 4)""",
)
plan_query("has_method_macro", ir.start(ir.codebase()) | ir.nodes(ir.has_method(ir.eq("is_definition", 1))) | ir.select(["id"]),
    f"WITH {SYM} SELECT id FROM sym WHERE id IN (SELECT parent_id FROM sym WHERE kind IN (21, 24, 25) AND is_definition = 1)")

# --- Traversal ----------------------------------------------------------------------------------------------------------------


def _window_sql(kind: int, low: int, high: int, inbound: bool = False, starts: str = "SELECT id FROM sym WHERE kind = 4") -> str:
    a, b = ("dst_id", "src_id") if inbound else ("src_id", "dst_id")
    return f"""WITH RECURSIVE {SYM}, {EE}, g AS (SELECT DISTINCT {a} AS a, {b} AS b FROM ee WHERE kind = {kind}),
w(id, d) AS (SELECT id, 0 FROM ({starts}) UNION SELECT g.b, d + 1 FROM w JOIN g ON g.a = w.id WHERE d < {high}),
hit AS (SELECT DISTINCT id FROM w WHERE d BETWEEN {low} AND {high})
SELECT id FROM hit"""


plan_query("traverse_one_hop_out", "codebase() | nodes(kind = class) | out(\"entity.uses\") | select(id)", _window_sql(8, 1, 1))
plan_query("traverse_one_hop_in", "codebase() | nodes(kind = class) | view(entity) | in(uses) | select(id)", _window_sql(8, 1, 1, True, "SELECT id FROM ent_c").replace("WITH RECURSIVE " + SYM + ", " + EE, f"WITH RECURSIVE {SYM}, {EE}, {ENT}, ent_c AS (SELECT id FROM ent SEMI JOIN (SELECT id FROM sym WHERE kind = 4) USING (id))"))
plan_query("traverse_window_2_2", "codebase() | nodes(kind = class) | out(\"entity.generalizes\", 2) | select(id)", _window_sql(1, 2, 2))
plan_query("traverse_window_1_4", "codebase() | nodes(kind = class) | out(\"entity.generalizes\", 1..4) | select(id)", _window_sql(1, 1, 4))
plan_query("traverse_window_5_9", "codebase() | nodes(kind = class) | out(\"entity.composes\", 5..9) | select(id)", _window_sql(4, 5, 9))
plan_query("traverse_in_window", "codebase() | nodes(kind = class) | view(entity) | in(generalizes, 1..3) | select(id)", _window_sql(1, 1, 3, True))
plan_query(
    "traverse_diamond", 'codebase() | nodes(kind = namespace) | out("entity.declares") | out(uses, 1..2) | where(kind = struct) | select(id, name)',
    f"""WITH {SYM}, {EE}, a AS (SELECT DISTINCT dst_id AS id FROM ee WHERE kind = 12 AND src_id IN (SELECT id FROM sym WHERE kind = 22)),
b AS (SELECT DISTINCT dst_id AS id FROM ee WHERE kind = 8 AND src_id IN (SELECT id FROM a)), c AS (SELECT DISTINCT dst_id AS id FROM ee WHERE kind = 8 AND src_id IN (SELECT id FROM b))
SELECT id, {NAME} AS name FROM sym WHERE kind = 2 AND id IN (SELECT id FROM b UNION SELECT id FROM c)""",
)
plan_query(
    "traverse_budget_cut", 'codebase() | nodes(kind = class) | out("entity.uses", 1..2) | select(id)',
    f"""WITH {SYM}, {EE}, g AS (SELECT DISTINCT src_id, dst_id FROM ee WHERE kind = 8),
l1 AS (SELECT DISTINCT dst_id AS id FROM g WHERE src_id IN (SELECT id FROM sym WHERE kind = 4)), k1 AS (SELECT id FROM l1 ORDER BY id LIMIT 100),
n AS (SELECT 100 - count(*) AS left_over FROM k1), l2 AS (SELECT DISTINCT dst_id AS id FROM g WHERE src_id IN (SELECT id FROM k1) AND (SELECT count(*) FROM l1) <= 100),
k2 AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM l2) WHERE r <= (SELECT left_over FROM n))
SELECT id FROM k1 UNION SELECT id FROM k2""",
    Budgets(None, 100, None, None, None),
)

for _n in ("traverse_one_hop_out", "traverse_one_hop_in", "traverse_window_2_2", "traverse_window_1_4", "traverse_window_5_9", "traverse_in_window"):
    # Selecting fields keeps the nodes that are symbols; the entity view has all its ends.
    SQL[_n] = SQL[_n].replace("SELECT id FROM hit", "SELECT id FROM hit SEMI JOIN (SELECT id FROM sym UNION SELECT src_id FROM ee UNION SELECT dst_id FROM ee) USING (id)")

_GEN = f"WITH RECURSIVE {SYM}, {EE}, g AS (SELECT DISTINCT src_id AS src, dst_id AS dst FROM ee WHERE kind = 1)"


def _gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(code_index(spark, sf_dir).adjacency("entity.generalizes"))


def _tops(adjacency: DataFrame) -> DataFrame:
    """(id) of nodes that nothing leads to."""
    return adjacency.select(F.col("src").alias("id")).distinct().join(adjacency.select(F.col("dst").alias("id")), "id", "left_anti")


@entry("walk_min_depth", _GEN + """, s AS (SELECT DISTINCT src AS id FROM g WHERE src NOT IN (SELECT dst FROM g)),
w(id, d) AS (SELECT id, 0 FROM s UNION SELECT g.dst, d + 1 FROM w JOIN g ON g.src = w.id WHERE d < 200)
SELECT id, min(d)::INTEGER AS depth FROM w GROUP BY id""")
def walk_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _gen(spark, sf_dir)
    return traverse.bfs(_tops(a), a).select("id", "depth")


@entry("closure_pairs", _GEN + """, w(src, dst) AS (SELECT src, dst FROM g UNION SELECT w.src, g.dst FROM w JOIN g ON g.src = w.dst) SELECT src, dst FROM w""")
def closure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.closure(_gen(spark, sf_dir))


_ROOTS = "goal AS (SELECT DISTINCT dst AS id FROM g WHERE dst NOT IN (SELECT src FROM g))"


@entry("path_shortest", _GEN + f""", {_ROOTS},
w(start, id, trail, d) AS (SELECT src, dst, [src, dst], 1 FROM g WHERE src <> dst UNION ALL
  SELECT w.start, g.dst, list_append(trail, g.dst), d + 1 FROM w JOIN g ON g.src = w.id WHERE NOT list_contains(trail, g.dst) AND w.id NOT IN (SELECT id FROM goal)),
hit AS (SELECT * FROM w WHERE id IN (SELECT id FROM goal))
SELECT start, id AS target, d::INTEGER AS length, array_to_string(trail, '/') AS trail FROM hit QUALIFY d = min(d) OVER (PARTITION BY start)""")
def path_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _gen(spark, sf_dir)
    goals = a.select(F.col("dst").alias("id")).distinct().join(a.select(F.col("src").alias("id")), "id", "left_anti")
    found = traverse.simple_paths(a.select(F.col("src").alias("id")), goals, a, 1, None)
    return found.rows.select("start", "target", "length", F.array_join("trail", "/").alias("trail"))


@entry("path_rank_topn", _GEN + f""", {_ROOTS},
w(start, id, trail, d) AS (SELECT src, dst, [src, dst], 1 FROM g WHERE src <> dst UNION ALL
  SELECT w.start, g.dst, list_append(trail, g.dst), d + 1 FROM w JOIN g ON g.src = w.id WHERE NOT list_contains(trail, g.dst) AND w.id NOT IN (SELECT id FROM goal)),
hit AS (SELECT * FROM w WHERE id IN (SELECT id FROM goal) QUALIFY d = min(d) OVER (PARTITION BY start))
SELECT start, length, array_to_string(trail, '/') AS trail FROM (SELECT start, d::INTEGER AS length, trail, row_number() OVER (ORDER BY d, trail) AS r FROM hit) WHERE r <= 200""")
def path_rank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _gen(spark, sf_dir)
    goals = a.select(F.col("dst").alias("id")).distinct().join(a.select(F.col("src").alias("id")), "id", "left_anti")
    rows = traverse.simple_paths(a.select(F.col("src").alias("id")), goals, a, 1, None).rows
    return rows.orderBy("length", "trail").limit(200).select("start", "length", F.array_join("trail", "/").alias("trail"))


@entry("path_cycles", f"""WITH RECURSIVE {SYM}, {EE}, g AS (SELECT DISTINCT src_id AS src, dst_id AS dst FROM ee WHERE kind = 1),
w(start, id, trail, d) AS (SELECT src, dst, [src, dst], 1 FROM g UNION ALL
  SELECT w.start, g.dst, list_append(trail, g.dst), d + 1 FROM w JOIN g ON g.src = w.id WHERE w.id <> w.start AND (g.dst = w.start OR NOT list_contains(trail, g.dst)))
SELECT start, d::INTEGER AS length, array_to_string(trail, '/') AS trail FROM w WHERE id = start QUALIFY d = min(d) OVER (PARTITION BY start)""")
def path_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest cycles through each node: a node's own name is its only target. They stay inside its component."""
    a = _gen(spark, sf_dir)
    parts = traverse.components(a).where("size > 1").select("id", "component")
    inner = a.join(parts.toDF("src", "here"), "src").join(parts.toDF("dst", "there"), "dst").where("here = there").select("src", "dst")
    a = materialize(inner.union(a.where("src = dst")).distinct())
    walks = a.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("trail"))
    found: list[DataFrame] = []
    while not found or walks.take(1):
        hit = walks.where("node = start").select("start", F.lit(len(found) + 1).alias("length"), "trail")
        found.append(hit)
        walks = walks.join(hit.select("start"), "start", "left_anti").join(a, F.col("node") == F.col("src")).where((F.col("dst") == F.col("start")) | ~F.array_contains("trail", F.col("dst")))
        walks = materialize(walks.select("start", F.col("dst").alias("node"), F.concat("trail", F.array("dst")).alias("trail")))
    return reduce(DataFrame.unionByName, found).select("start", "length", F.array_join("trail", "/").alias("trail"))


# --- Aggregates, occurrences, typed views -------------------------------------------------------------------------------------


@entry("symbols_by_kind", f"WITH {SYM} SELECT kind, count(*) AS symbols FROM sym GROUP BY kind")
def symbols_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.Navigator(code_index(spark, sf_dir)).symbols_by_kind()


@entry("edges_by_kind", f"WITH {EDGE} SELECT kind, count(*) AS edges FROM edge GROUP BY kind")
def edges_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.Navigator(code_index(spark, sf_dir)).edges_by_kind()


@entry("entity_stats", f"WITH {EE} SELECT kind, count(*) AS edges, sum(count)::BIGINT AS total FROM ee GROUP BY kind")
def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.Navigator(code_index(spark, sf_dir)).entity_stats().select("kind", "edges", "total")


@entry("edge_rollup_counts", f"""WITH {ORDER_SQL} SELECT l_orderkey * 4 + 1 AS src_id, l_partkey * 4 + 2 AS dst_id, n AS count FROM used""")
def edge_rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.site_counts(order_graph(spark, sf_dir)).where("kind = 7").select("src_id", "dst_id", "count")


@entry("effective_count", f"""WITH {ORDER_SQL} SELECT l_orderkey * 4 + 1 AS src_id, l_partkey * 4 + 2 AS dst_id, n AS effective_count FROM used
UNION ALL SELECT o_custkey * 4 + 3, o_orderkey * 4 + 1, 1 FROM orders""")
def effective_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(order_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | view(edge) | nodes() | select(src_id, dst_id, effective_count)"))


@entry("sites_expand", """SELECT DISTINCT l_orderkey * 4 + 1 AS src_id, l_partkey * 4 + 2 AS dst_id, l_suppkey AS file_id, l_linenumber AS line FROM lineitem""")
def sites_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(order_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | view(edge) | nodes(kind = 7) | sites() | select(src_id, dst_id, file_id, line)")).distinct()


@entry("multi_def_count", """SELECT p_partkey * 4 + 2 AS id, coalesce(n, 0)::INTEGER AS multi_def FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def multi_def_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.multi_definitions(order_graph(spark, sf_dir)).where("kind = 4").select("id", "multi_def")


@entry("possible_calls_sum", f"""WITH {ORDER_SQL}, body AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), many AS (SELECT l_partkey FROM body GROUP BY 1 HAVING count(*) > 1)
SELECT l_orderkey AS src_def_id, b.l_partkey * 1000000 + l_suppkey AS dst_def_id, sum(n)::BIGINT AS count FROM used JOIN body b USING (l_partkey) SEMI JOIN many USING (l_partkey) GROUP BY ALL""")
def possible_calls_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    return derive.possible_calls(g.replaced(symbol=derive.multi_definitions(g)))


@entry("typed_slots_union_all", f"""WITH {TYPES_SQL}
SELECT 'return' AS slot_kind, o_orderkey AS owner_id, 0 AS position, 0 AS pack_index, o_custkey % 100 AS type_id FROM orders
UNION ALL SELECT 'parameter', owner_id, position, pack_index, type_id FROM parameter UNION ALL SELECT 'template_argument', owner_id, position, pack_index, type_id FROM parameter""")
def typed_slots_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(type_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | nodes() | out(has_signature_slot) | select(slot_kind, owner_id, position, pack_index, type_id)"))


@entry("typed_composite_join", f"""WITH {TYPES_SQL} SELECT DISTINCT p_partkey AS id_key, p_type AS spelling, (p_size % 2) + 2 * (p_size % 3 = 0)::INTEGER AS cv_qualifiers
FROM part WHERE p_partkey IN (SELECT type_id FROM parameter)""")
def typed_composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(type_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | nodes() | out(has_parameter) | out(of_type) | select(type_key, spelling, cv_qualifiers)"))
    return df.select(F.split("type_key", ":")[1].cast("long").alias("id_key"), "spelling", "cv_qualifiers")


@entry("typed_users", f"""WITH {TYPES_SQL} SELECT DISTINCT owner_id AS id FROM parameter JOIN part ON p_partkey = type_id WHERE p_size % 2 = 1""")
def typed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(type_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | view(type) | nodes(is_const = 1) | in(\"parameter.of_type\") | in(has_parameter) | select(id)"))


@entry("layer_expand", """WITH RECURSIVE l(root_id, type_id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part
UNION ALL SELECT root_id, type_id // 2, depth + 1 FROM l WHERE type_id > 0) SELECT root_id, depth, type_id FROM l""")
def layer_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..views import layers

    return layers(type_graph(spark, sf_dir)).select("root_id", "depth", "type_id")


@entry("layer_prefix_join", """WITH RECURSIVE l(root_id, type_id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part
UNION ALL SELECT root_id, type_id // 2, depth + 1 FROM l WHERE type_id > 0) SELECT root_id, depth FROM l WHERE depth > 0""")
def layer_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(type_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | view(type_layer) | nodes() | out(child) | select(root_id, depth)"))


@entry("type_closure_users", f"""WITH RECURSIVE {TYPES_SQL}, c(id) AS (SELECT p_partkey FROM part UNION SELECT p_partkey FROM part JOIN c ON p_partkey // 2 = c.id AND p_partkey > 0)
SELECT DISTINCT symbol_id FROM (SELECT owner_id AS symbol_id, type_id FROM parameter UNION SELECT o_orderkey, o_custkey % 100 FROM orders) WHERE type_id IN (SELECT id FROM c)""")
def type_closure_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of any type."""
    g = type_graph(spark, sf_dir)
    return navigate.Navigator(g).type_users(g.t("type_node").select("id"))


@entry("reverse_type_use", f"""WITH RECURSIVE {TYPES_SQL}, c(id, trail, d) AS (SELECT p_partkey, [p_partkey], 0 FROM part UNION ALL SELECT p_partkey, list_append(trail, p_partkey), d + 1 FROM c JOIN part ON p_partkey // 2 = c.id AND p_partkey > 0 WHERE NOT list_contains(trail, p_partkey)),
own AS (SELECT type_id, owner_id, 'parameter' AS domain, 'parameter[' || position || ']' AS through FROM parameter UNION SELECT type_id, owner_id, 'template_argument', 'template_argument[' || position || ']' FROM parameter
  UNION SELECT o_custkey % 100, o_orderkey, 'symbol', 'returns' FROM orders)
SELECT DISTINCT owner_id AS target, d + 1 AS length, array_to_string(list_append(trail, owner_id), '/') AS trail, domain, through FROM c JOIN own ON type_id = id""")
def reverse_type_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every type, as deep as plans go: enough for keys below 2 ** 32, which halve at each level."""
    df = Engine(type_graph(spark, sf_dir), UNBOUNDED).frame(parse("codebase() | view(type) | nodes() | reverse_type_use(32)"))
    return df.select("target", "length", F.array_join("trail", "/").alias("trail"), "domain", "through")


# --- Derived facts ------------------------------------------------------------------------------------------------------------


@entry("dispatch_closure", _GEN + """, r AS (SELECT dst AS src, src AS dst FROM g), w(src, dst) AS (SELECT src, dst FROM r UNION SELECT w.src, r.dst FROM w JOIN r ON r.src = w.dst) SELECT src AS base, dst AS method FROM w""")
def dispatch_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalizations read as overrides: who overrides whom, directly or through others."""
    g = code_index(spark, sf_dir)
    overrides = g.t("entity_edge").where("kind = 1").select("src_id", "dst_id", F.lit(6).alias("kind")).distinct()
    return derive.override_closure(g.replaced(edge=overrides))


@entry("dispatch_calls", f"""WITH RECURSIVE {SYM}, {EE}, r AS (SELECT DISTINCT dst_id AS src, src_id AS dst FROM ee WHERE kind = 1),
w(src, dst) AS (SELECT src, dst FROM r UNION SELECT w.src, r.dst FROM w JOIN r ON r.src = w.dst),
c AS (SELECT src_id, dst_id, sum(count)::BIGINT AS count FROM ee WHERE kind = 9 GROUP BY ALL)
SELECT DISTINCT c.src_id, w.dst AS dst_id FROM c JOIN w ON w.src = c.dst_id WHERE c.src_id <> w.dst""")
def dispatch_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destructions read as calls, generalizations as overrides: where each call may land besides its target."""
    g = code_index(spark, sf_dir)
    e = g.t("entity_edge").groupBy("src_id", "dst_id", "kind").agg(F.sum("count").alias("count"))
    edges = e.where("kind in (1, 9)").select("src_id", "dst_id", F.when(F.col("kind") == 1, 6).otherwise(1).alias("kind"), "count", F.xxhash64("src_id", "dst_id").alias("id"))
    return derive.dispatch_calls(g.replaced(edge=edges)).select("src_id", "dst_id")


@entry("collapse_primary", f"""WITH RECURSIVE {EDGE}, f AS (SELECT src_id AS id, arg_min(dst_id, kind * 1000000000000 + dst_id) AS nxt FROM edge WHERE kind IN (4, 5) AND src_id <> dst_id GROUP BY src_id),
w(id, pos, n) AS (SELECT id, nxt, 1 FROM f UNION ALL SELECT w.id, f.nxt, n + 1 FROM w JOIN f ON f.id = w.pos WHERE n < 400),
ends AS (SELECT id, pos AS prim FROM w WHERE pos NOT IN (SELECT id FROM f)),
ring AS (SELECT id, min(pos) AS prim FROM w WHERE n > 200 AND id NOT IN (SELECT id FROM ends) GROUP BY id)
SELECT id, prim AS primary_id FROM ends UNION ALL SELECT id, prim FROM ring""")
def collapse_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.primaries(code_index(spark, sf_dir)).withColumnRenamed("primary", "primary_id")


_CLASSES = f"""{SYM}, m AS (SELECT parent_id AS id, bool_or(kind = 21) AS solid, bool_or(kind = 6) AS data FROM sym WHERE kind IN (6, 21, 24, 25) AND parent_id IS NOT NULL GROUP BY 1),
node AS (SELECT id, (CASE WHEN kind = 22 THEN 9 WHEN kind = 5 THEN 5 WHEN kind = 3 THEN 4 WHEN kind = 31 THEN 6 ELSE 1 END)::INTEGER AS kind FROM sym WHERE kind IN (2, 3, 4, 5, 22, 31))"""


@entry("entity_classify", f"WITH {_CLASSES} SELECT id, kind FROM node")
def entity_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.entity_nodes(code_index(spark, sf_dir))


@entry("entity_relations", f"""WITH {EDGE}, rec AS (SELECT id FROM sym WHERE kind IN (2, 3, 4, 5)), node AS (SELECT id FROM sym WHERE kind IN (2, 3, 4, 5, 22, 31))
SELECT src_id, dst_id, 10 AS kind, sum(n)::BIGINT AS count FROM (SELECT src_id, dst_id, 1 AS n FROM edge WHERE kind = 17 AND src_id <> dst_id AND src_id IN (SELECT id FROM rec) AND dst_id IN (SELECT id FROM rec)) GROUP BY 1, 2
UNION ALL SELECT src_id, dst_id, 12, 1 FROM edge WHERE kind = 3 AND src_id <> dst_id AND src_id IN (SELECT id FROM sym WHERE kind = 22) AND dst_id IN (SELECT id FROM node)""")
def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friendships and declarations of the projection of symbols onto entities."""
    return derive.entity_edges(code_index(spark, sf_dir)).where("kind in (10, 12)").select("src_id", "dst_id", "kind", "count")


@entry("entity_projection")
def entity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.entity_edges(code_index(spark, sf_dir))


@entry("display_name_collisions", f"""WITH {SYM}, n AS (SELECT id, {NAME} AS nm, coalesce(file_id::VARCHAR, '?') || ':' || coalesce(line::VARCHAR, '?') AS loc FROM sym),
r AS (SELECT id, nm, loc, count(*) OVER (PARTITION BY nm) AS a, count(*) OVER (PARTITION BY nm, loc) AS b, row_number() OVER (PARTITION BY nm, loc ORDER BY id) AS k FROM n)
SELECT id, CASE WHEN a = 1 THEN nm WHEN b = 1 THEN nm || '@' || loc ELSE nm || '@' || loc || '#' || k END AS display FROM r""")
def display_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.call_signature(code_index(spark, sf_dir).t("symbol"))


# --- Rules --------------------------------------------------------------------------------------------------------------------


#: Kinds of entity edges that are a kind of edge between symbols, too.
_AS_EDGE = {1: 2, 2: 2, 3: 4, 8: 7, 9: 16, 10: 17, 11: 5, 12: 3}


def _rule_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Facts of the code graph: its edges and all its entity edges.

    Entity edges have the kind of edge they stand for (see ``_AS_EDGE``), those without one 100 more than their own.
    """
    g = code_index(spark, sf_dir)
    kinds = F.create_map(*[F.lit(x) for k, v in _AS_EDGE.items() for x in (k, v)])
    e = g.t("entity_edge").select("src_id", F.coalesce(kinds[F.col("kind")], F.col("kind") + 100).alias("kind"), "dst_id")
    e = g.t("edge").select("src_id", "kind", "dst_id").union(e).distinct()
    s = g.t("symbol")
    return {
        "edge": materialize(e), "symbol": materialize(s.select("id", "kind", F.coalesce("is_definition", F.lit(0)).alias("d"))), "entry_point": s.where("spelling = 'main'").select("id"),
        "file_of": s.where("file_id is not null").select("id", "file_id"),
    }


_FACTS = f"""WITH RECURSIVE {EDGE}, fact AS (SELECT src_id AS x, kind, dst_id AS y FROM edge
  UNION SELECT src_id, CASE kind {' '.join(f'WHEN {k} THEN {v}' for k, v in _AS_EDGE.items())} ELSE kind + 100 END, dst_id FROM ee),
c AS (SELECT x, y FROM fact WHERE kind = 1), reach(x, y) AS (SELECT x, y FROM c UNION SELECT r.x, c.y FROM reach r JOIN c ON c.x = r.y)"""


@entry("rule_reach", f"{_FACTS} SELECT x AS src, y AS dst FROM reach")
def rule_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.call_graph().run(_rule_facts(spark, sf_dir))["reaches"].toDF("src", "dst")


@entry("rule_cycles", f"{_FACTS} SELECT x AS src, y AS dst FROM c WHERE (y, x) IN (SELECT x, y FROM reach)")
def rule_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cycle_edges(_rule_facts(spark, sf_dir))


@entry("rule_unused", f"""{_FACTS} SELECT id FROM sym WHERE kind IN (8, 21, 24, 25, 30) AND is_definition = 1 AND id NOT IN (SELECT y FROM c) AND spelling <> 'main'""")
def rule_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unused().run(_rule_facts(spark, sf_dir))["unused"].toDF("id")


@entry("rule_fan_in_out", f"""{_FACTS} SELECT id, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM sym LEFT JOIN (SELECT y AS id, count(*) AS i FROM c GROUP BY 1) USING (id) LEFT JOIN (SELECT x AS id, count(*) AS o FROM c GROUP BY 1) USING (id)""")
def rule_fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.metrics().run(_rule_facts(spark, sf_dir))
    return out["fan_in"].toDF("id", "fan_in").join(out["fan_out"].toDF("id", "fan_out"), "id")


@entry("rule_hierarchy", f"""{_FACTS}, h(x, y) AS (SELECT x, y FROM fact WHERE kind = 2 UNION SELECT h.x, e.y FROM h JOIN fact e ON e.x = h.y AND e.kind = 2) SELECT x AS src, y AS dst FROM h""")
def rule_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hierarchy().run(_rule_facts(spark, sf_dir))["ancestor"].toDF("src", "dst")


@entry("rule_impact", f"""{_FACTS}, d AS (SELECT DISTINCT x, y FROM fact WHERE kind IN (1, 7)), imp(y, x) AS (SELECT y, x FROM d UNION SELECT d.y, i.x FROM imp i JOIN d ON d.x = i.y)
SELECT id, coalesce(n, 0) AS radius FROM sym LEFT JOIN (SELECT y AS id, count(*) AS n FROM imp GROUP BY 1) USING (id)""")
def rule_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over calls and uses."""
    return rules.impact_radius(_rule_facts(spark, sf_dir))


@entry("rule_all_paths", f"""{_FACTS}, src AS (SELECT id FROM sym WHERE kind = 4), snk AS (SELECT id FROM sym WHERE kind = 2),
d(x) AS (SELECT id FROM src UNION SELECT c.y FROM d JOIN c ON c.x = d.x), u(x) AS (SELECT id FROM snk UNION SELECT c.x FROM u JOIN c ON c.y = u.x)
SELECT x AS src, y AS dst FROM c WHERE x IN (SELECT x FROM d) AND y IN (SELECT x FROM u)""")
def rule_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _rule_facts(spark, sf_dir)
    f |= {"source": f["symbol"].where("kind = 4").select("id"), "sink": f["symbol"].where("kind = 2").select("id")}
    return rules.all_paths().run(f, ["on_path"])["on_path"].toDF("src", "dst")


@entry("rule_arch_cone", f"""{_FACTS}, k(x) AS (SELECT y FROM c WHERE x IN (SELECT id FROM sym WHERE kind = 4) UNION SELECT c.y FROM k JOIN c ON c.x = k.x) SELECT x AS id FROM k""")
def rule_arch_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _rule_facts(spark, sf_dir)
    f["seed"] = f["symbol"].where("kind = 4").select("id")
    return rules.cone(1).run(f)["cone"].toDF("id")


@entry("rule_file_dependency", f"""{_FACTS} SELECT a.file_id AS src_file, b.file_id AS dst_file, count(DISTINCT (x, y)) AS edges FROM fact JOIN sym a ON a.id = x JOIN sym b ON b.id = y WHERE a.file_id <> b.file_id GROUP BY ALL""")
def rule_file_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cross_file().run(_rule_facts(spark, sf_dir), ["file_depends"])["file_depends"].toDF("src_file", "dst_file", "edges")


# --- Files, snapshots, search ---------------------------------------------------------------------------------------------------

_FILES = f"WITH RECURSIVE {SYM}, {EE}, inc AS (SELECT a.file_id AS src, b.file_id AS dst, sum(e.count)::BIGINT AS count FROM ee e JOIN sym a ON a.id = e.src_id JOIN sym b ON b.id = e.dst_id WHERE e.kind = 11 AND a.file_id IS NOT NULL AND b.file_id IS NOT NULL GROUP BY ALL)"


def _file_graph(spark: SparkSession, sf_dir: str) -> includes.IncludeGraph:
    """Files that instantiate what other files define."""
    g = code_index(spark, sf_dir)
    s = g.t("symbol").where("file_id is not null").select("id", "file_id")
    e = g.t("entity_edge").where("kind = 11").join(s.select(F.col("id").alias("src_id"), F.col("file_id").alias("src")), "src_id").join(s.select(F.col("id").alias("dst_id"), F.col("file_id").alias("dst")), "dst_id")
    return includes.IncludeGraph(materialize(e.groupBy("src", "dst").agg(F.sum("count").alias("count"))))


@entry("include_hotspots", f"""{_FILES} SELECT coalesce(a.f, b.f) AS path, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out
FROM (SELECT dst AS f, count(*) AS i FROM inc GROUP BY 1) a FULL JOIN (SELECT src AS f, count(*) AS o FROM inc GROUP BY 1) b ON a.f = b.f""")
def include_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_graph(spark, sf_dir).hotspots()


@entry("include_scc", f"""{_FILES}, r(a, b) AS (SELECT src, dst FROM inc UNION SELECT r.a, i.dst FROM r JOIN inc i ON i.src = r.b),
n AS (SELECT src AS id FROM inc UNION SELECT dst FROM inc)
SELECT n.id, coalesce(least(n.id, min(x.b)), n.id) AS component, count(DISTINCT x.b) FILTER (x.b <> n.id) + 1 AS size
FROM n LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON q.a = p.b AND q.b = p.a) x ON x.a = n.id GROUP BY n.id""")
def include_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.components(_file_graph(spark, sf_dir).edges.select("src", "dst"))


@entry("include_shortest_path", f"""{_FILES}, f AS (SELECT min(src) AS id FROM inc), w(id, route, d) AS (SELECT id, [id], 0 FROM f UNION ALL
  SELECT dst, min(list_append(route, dst)), d + 1 FROM w JOIN inc ON src = id WHERE d < (SELECT count(*) FROM (SELECT src FROM inc UNION SELECT dst FROM inc)) GROUP BY dst, d)
SELECT id, d::INTEGER AS depth, array_to_string(min(route), '/') AS route FROM w GROUP BY id, d QUALIFY d = min(d) OVER (PARTITION BY id)""")
def include_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest routes from the file with the smallest number."""
    e = _file_graph(spark, sf_dir).edges
    start = e.agg(F.min("src").alias("id"))
    return traverse.first_routes(start, e.select("src", "dst")).select("id", "depth", F.array_join("route", "/").alias("route"))


_DEPS = "SELECT DISTINCT snapshot_no, source, destination, conditional_context FROM tu_dependency WHERE resolved = 1"


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "tu_dependency", "snapshot_no", "source", "destination", "conditional_context", "resolved").where("resolved = 1").drop("resolved").distinct()
    return d.select(F.col("source").alias("src"), F.col("destination").alias("dst"), F.col("conditional_context").alias("config"), F.lit(1).alias("count"), F.lit(None).cast("long").alias("dst_id"))


@entry("include_merge", f"""SELECT source AS src, destination AS dst, count(*) AS count, array_to_string(list_sort(list_distinct(list(conditional_context))), ';') AS configs FROM ({_DEPS}) GROUP BY ALL""")
def include_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return includes.merge_configurations(_dependencies(spark, sf_dir)).select("src", "dst", "count", F.array_join("configs", ";").alias("configs"))


@entry("include_invariant", f"""WITH d AS ({_DEPS}), a AS (SELECT source, count(DISTINCT conditional_context) AS n FROM d GROUP BY 1)
SELECT source AS src, destination AS dst FROM d JOIN a USING (source) GROUP BY source, destination, n HAVING count(DISTINCT conditional_context) = n""")
def include_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return includes.invariant_edges(_dependencies(spark, sf_dir))


_MAPS = f"{SYM}, m AS (SELECT DISTINCT artifact_id, local_identity, identity_kind, core_symbol_id FROM artifact_identity_map)"


def _snapshots(spark: SparkSession, sf_dir: str) -> facts.FactSnapshot:
    m = table(spark, sf_dir, "artifact_identity_map", "artifact_id", "local_identity", "identity_kind", "core_symbol_id").distinct()
    left = facts.FactSnapshot({"map": facts.Relation(m)}, "index")
    right = facts.FactSnapshot({"symbol": facts.Relation(code_index(spark, sf_dir).t("symbol").select("id", "kind", "spelling"), "partial")}, "index")
    return facts.compose(left, right, [facts.JoinSpec("map", "symbol", (("core_symbol_id", "id"),), "mapped")])


@entry("compose_left_join_status", f"""WITH {_MAPS} SELECT artifact_id AS left_artifact_id, local_identity AS left_local_identity, coalesce(core_symbol_id, 0) AS left_core_symbol_id,
  coalesce(kind, 0) AS right_kind, coalesce(spelling, '') AS right_spelling, CASE WHEN id IS NULL THEN 'unresolved' ELSE 'resolved' END AS join_status FROM m LEFT JOIN sym ON id = core_symbol_id""")
def compose_left_join_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).rows("mapped").select("left_artifact_id", "left_local_identity", "left_core_symbol_id", "right_kind", "right_spelling", "join_status")


@entry("compose_unresolved", f"""WITH {_MAPS} SELECT 'mapped' AS "join", 'map' AS left_relation, 'symbol' AS right_relation, count(*) AS misses FROM m LEFT JOIN sym ON id = core_symbol_id WHERE id IS NULL""")
def compose_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).rows("analysis/unresolved_join")


@entry("find_tiers", f"""WITH {SYM}, t AS (SELECT id, {NAME} AS name, CASE WHEN lower({NAME}) = 'merge' OR lower(spelling) = 'merge' THEN 1 WHEN lower({NAME}) LIKE 'merge%' OR lower(spelling) LIKE 'merge%' THEN 2 WHEN lower({NAME}) LIKE '%merge%' THEN 3 END AS tier FROM sym)
SELECT id, name FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def find_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.Navigator(code_index(spark, sf_dir)).find("merge").select("id", "name")


@entry("search_segments", f"WITH {SYM} SELECT id, {NAME} AS name FROM sym WHERE lower({NAME}) LIKE '%core%chain%' ORDER BY length({NAME}), {NAME}, id LIMIT 50")
def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.Navigator(code_index(spark, sf_dir)).search("core::chain", 50).select("id", "name")


@entry("fuzzy_match", f"WITH {SYM} SELECT id FROM sym WHERE lower({NAME}) LIKE '%s%p%i%l%l%_%' ESCAPE '\\'".replace("%_%", "%\\_%"))
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.Navigator(code_index(spark, sf_dir)).fuzzy("spill_").select("id")


@entry("name_parts", r"""SELECT DISTINCT destination AS path, list_extract(string_split(destination, '/'), -1) AS base FROM tu_dependency""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tu_dependency", "destination").distinct().select(F.col("destination").alias("path"), basename(F.col("destination")).alias("base"))


@entry("namespaces", f"WITH {SYM} SELECT regexp_extract(qual_name, '^(.*)::[^:]*$', 1) AS namespace, count(*) AS symbols FROM sym WHERE qual_name IS NOT NULL GROUP BY 1")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = code_index(spark, sf_dir).t("symbol").where("qual_name is not null")
    return s.groupBy(top_level_namespace(F.col("qual_name")).alias("namespace")).agg(F.count(F.lit(1)).alias("symbols"))


@entry("interpolate", f"WITH {SYM} SELECT id, coalesce(file_id::VARCHAR, '<null>') || ':' || coalesce(line::VARCHAR, '<null>') || ' $' || coalesce(spelling, '<null>') AS text FROM sym")
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = code_index(spark, sf_dir).t("symbol")
    return s.select("id", interpolate("$file_id:${line} $$$spelling", {c: F.col(c) for c in s.columns}).alias("text"))


@entry("navigate_inner_expand", f"WITH {SYM}, {EE} SELECT s.id, dst_id AS other FROM sym s JOIN (SELECT DISTINCT src_id, dst_id FROM ee WHERE kind = 4) ON src_id = s.id")
def navigate_inner_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_index(spark, sf_dir)
    return search.navigate(g.t("symbol").select("id"), g.adjacency("entity.composes"), "id", "other")


@entry("show_outer_expand", f"WITH {SYM}, {EE} SELECT s.id, dst_id AS other FROM sym s LEFT JOIN (SELECT DISTINCT src_id, dst_id FROM ee WHERE kind = 4) ON src_id = s.id")
def show_outer_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_index(spark, sf_dir)
    return search.show(g.t("symbol").select("id"), g.adjacency("entity.composes"), "id", "other")


@entry("forall_every", f"""WITH {SYM}, {EE}, j AS (SELECT e.src_id AS id, s.is_definition = 1 AS holds FROM (SELECT DISTINCT src_id, dst_id FROM ee WHERE kind = 1) e LEFT JOIN sym s ON s.id = e.dst_id),
c AS (SELECT id, count(*) FILTER (NOT holds) AS no, count(*) FILTER (holds IS NULL) AS maybe FROM j GROUP BY 1)
SELECT id, (CASE WHEN coalesce(no, 0) > 0 THEN false WHEN coalesce(maybe, 0) = 0 THEN true END)::INTEGER AS every FROM sym LEFT JOIN c USING (id)""")
def forall_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_index(spark, sf_dir)
    holds = g.t("symbol").select("id", (F.col("is_definition") == 1).alias("holds"))
    return search.for_all(g.t("symbol").select("id"), g.adjacency("entity.generalizes"), "id", holds, True).select("id", F.col("every").cast("int").alias("every"))


@entry("having_cardinality", f"""WITH {SYM}, {EE}, c AS (SELECT id, coalesce(n, 0) AS n FROM sym LEFT JOIN (SELECT src_id AS id, count(DISTINCT dst_id) AS n FROM ee WHERE kind = 8 GROUP BY 1) USING (id))
SELECT id, (n >= 3)::INTEGER AS at_least, (n <= 3)::INTEGER AS at_most, (CASE WHEN n > 5 THEN NULL ELSE n > 5 END)::INTEGER AS more_than FROM c""")
def having_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_index(spark, sf_dir)
    df, n = search.counted(g.t("symbol").select("id"), g.adjacency("entity.uses"), "id", cap=5)
    return df.select("id", n.compare("at least", 3).cast("int").alias("at_least"), n.compare("at most", 3).cast("int").alias("at_most"), n.compare("more than", 5).cast("int").alias("more_than"))


@entry("semi_join", f"WITH {SYM}, {EE} SELECT id FROM sym WHERE id IN (SELECT src_id FROM ee WHERE kind = 1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_index(spark, sf_dir)
    return search.having(g.t("symbol").select("id"), g.adjacency("entity.generalizes"), "id")


@entry("anti_join_complete", f"WITH {SYM}, {EE} SELECT id FROM sym WHERE id NOT IN (SELECT src_id FROM ee WHERE kind = 1)")
def anti_join_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_index(spark, sf_dir)
    return search.lacking(g.t("symbol").select("id"), g.adjacency("entity.generalizes"), "id", True)


# --- Navigation and views -----------------------------------------------------------------------------------------------------


@entry("entity_steps", f"""WITH {SYM}, {EE}, a AS (SELECT DISTINCT dst_id AS id FROM ee WHERE kind = 1 AND src_id IN (SELECT id FROM sym WHERE kind = 4)),
b AS (SELECT DISTINCT src_id AS id FROM ee WHERE kind = 8 AND dst_id IN (SELECT id FROM a)) SELECT id, {NAME} AS name FROM b LEFT JOIN sym USING (id)""")
def entity_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who uses a base of any class."""
    nav = navigate.Navigator(code_index(spark, sf_dir))
    return navigate.Entities(nav, nav.of_kind("class")).bases().used_by().names()


@entry("members", f"""WITH {SYM} SELECT id, access FROM sym WHERE parent_id IN (SELECT id FROM sym WHERE kind = 4) AND access = 'public'""")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = navigate.Navigator(code_index(spark, sf_dir))
    return nav.members(nav.of_kind("class").select("id"), "public").select("id", "access")


@entry("subclasses_closure", f"""WITH RECURSIVE {EDGE}, w(id, d) AS (SELECT id, 0 FROM sym WHERE kind = 31 UNION SELECT e.src_id, d + 1 FROM w JOIN edge e ON e.dst_id = w.id AND e.kind = 2 WHERE d < 16)
SELECT id, min(d)::INTEGER AS depth FROM w GROUP BY id HAVING min(d) > 0""")
def subclasses_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = navigate.Navigator(code_index(spark, sf_dir))
    return nav.subclasses(nav.of_kind("class-template").select("id")).select("id", "depth")


@entry("callers", f"""WITH {EDGE} SELECT dst_id AS origin, src_id AS id, 'direct' AS via FROM edge WHERE kind = 1 AND dst_id IN (SELECT id FROM sym WHERE kind = 21)""")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = navigate.Navigator(code_index(spark, sf_dir))
    return nav.callers(nav.of_kind("method").select("id"))


@entry("neighbors_both", f"""WITH {EDGE} SELECT DISTINCT id FROM (SELECT dst_id AS id FROM edge WHERE kind = 2 AND src_id IN (SELECT id FROM sym WHERE kind = 4) UNION SELECT src_id FROM edge WHERE kind = 2 AND dst_id IN (SELECT id FROM sym WHERE kind = 4))""")
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = navigate.Navigator(code_index(spark, sf_dir))
    return nav.neighbors(nav.of_kind("class").select("id"), ["inherits"], "both")


@entry("top_edges", f"WITH {EDGE} SELECT src_id, dst_id, kind, count FROM edge ORDER BY count DESC, kind, src_id, dst_id LIMIT 100")
def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_index(spark, sf_dir).t("edge").orderBy(F.desc("count"), "kind", "src_id", "dst_id").limit(100).select("src_id", "dst_id", "kind", "count")


@entry("graph_view_filtered_edges", f"""WITH {EDGE}, n AS (SELECT id FROM sym WHERE kind IN (2, 4) AND qual_name LIKE 'core::%')
SELECT src_id, dst_id, kind, count FROM edge WHERE kind IN (1, 2, 5) AND src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n)""")
def graph_view_filtered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graphview.ViewRequest(kinds=("class", "struct"), namespace="core", edge_kinds=("calls", "inherits", "instantiates"), max_nodes=None, max_edges=None)
    return graphview.build(code_index(spark, sf_dir), r).edges.select("src_id", "dst_id", "kind", "count")


@entry("view_page", f"WITH {SYM} SELECT id FROM sym WHERE kind = 4 ORDER BY id LIMIT 50 OFFSET 50")
def view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the classes, by the continuation of the first."""
    g, r = code_index(spark, sf_dir), graphview.ViewRequest(kinds=("class",), max_nodes=50)
    first = graphview.build(g, r)
    return graphview.build(g, r, first.next_token).nodes.select("id")


# --- Change -------------------------------------------------------------------------------------------------------------------


@entry("incremental_rollup_equals_full", "SELECT l_orderkey, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1")
def incremental_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up of the lines shipped before 1997, brought up to date for the orders that later lines touch."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_shipdate")

    def build(df: DataFrame) -> DataFrame:
        return df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))

    late = lines.where("l_shipdate >= '1997-01-01'")
    old = materialize(build(lines.where("l_shipdate < '1997-01-01'")))
    return incremental(old, lines, ["l_orderkey"], late, build)


@entry("header_claims", "SELECT destination, source, snapshot_no FROM tu_dependency QUALIFY row_number() OVER (PARTITION BY destination ORDER BY snapshot_no, source) = 1")
def header_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source claimed each header first."""
    return first_claims(table(spark, sf_dir, "tu_dependency", "destination", "source", "snapshot_no"), "destination", "snapshot_no")


@entry("diff_match", """WITH p AS (SELECT DISTINCT snapshot_no, symbol_id AS id, usr FROM cidx_pending_symbol_identity WHERE snapshot_no IS NOT NULL),
s AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM p)),
a AS (SELECT s.snapshot_no, p.id, p.usr FROM s JOIN p ON p.snapshot_no = s.before), b AS (SELECT p.snapshot_no, p.id, p.usr FROM p JOIN s ON s.snapshot_no = p.snapshot_no AND before IS NOT NULL),
u AS (SELECT snapshot_no, a.id AS old_id, b.id AS new_id FROM (SELECT snapshot_no, usr, min(id) AS id FROM a GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT snapshot_no, usr, min(id) AS id FROM b GROUP BY ALL HAVING count(*) = 1) b USING (snapshot_no, usr)),
n AS (SELECT a.snapshot_no, a.id AS old_id, b.id AS new_id FROM (SELECT snapshot_no, id FROM a WHERE (snapshot_no, id) NOT IN (SELECT snapshot_no, old_id FROM u) GROUP BY ALL HAVING count(*) = 1) a
  JOIN (SELECT snapshot_no, id FROM b WHERE (snapshot_no, id) NOT IN (SELECT snapshot_no, new_id FROM u) GROUP BY ALL HAVING count(*) = 1) b ON a.id = b.id AND a.snapshot_no = b.snapshot_no)
SELECT snapshot_no, old_id, new_id, 'usr' AS tier, 100 AS confidence FROM u UNION ALL SELECT snapshot_no, old_id, new_id, 'name', 85 FROM n
UNION ALL SELECT snapshot_no, id, NULL, NULL, 0 FROM a WHERE (snapshot_no, id) NOT IN (SELECT snapshot_no, old_id FROM u UNION SELECT snapshot_no, old_id FROM n)
UNION ALL SELECT snapshot_no, NULL, id, NULL, 0 FROM b WHERE (snapshot_no, id) NOT IN (SELECT snapshot_no, new_id FROM u UNION SELECT snapshot_no, new_id FROM n)""")
def diff_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol identities of each snapshot matched to the preceding one that exists: by usr, then by id in the place of the name.

    snapshot_no is the later of the two.
    """
    p = table(spark, sf_dir, "cidx_pending_symbol_identity", "snapshot_no", "symbol_id", "usr").where("snapshot_no is not null").distinct()
    none = F.lit(None).cast("string")
    p = materialize(p.select("snapshot_no", F.col("symbol_id").alias("id"), "usr", none.alias("signature"), F.col("symbol_id").cast("string").alias("name"), none.alias("fingerprint")))
    numbers = p.select("snapshot_no").distinct()
    pairs = numbers.join(numbers.select(F.col("snapshot_no").alias("before")), F.col("before") < F.col("snapshot_no")).groupBy("snapshot_no").agg(F.max("before").alias("before"))
    pairs = materialize(pairs)
    old = p.withColumnRenamed("snapshot_no", "before").join(pairs, "before").drop("before")
    return match(old, p.join(pairs.select("snapshot_no"), "snapshot_no"), ("snapshot_no",))


@entry("handover_window", f"""WITH RECURSIVE {HANDOVER_SQL}, w(id, d) AS (SELECT s_suppkey, 0 FROM supplier UNION SELECT dst, d + 1 FROM w JOIN hand ON src = id WHERE d < 2)
SELECT DISTINCT id FROM w WHERE d = 2""")
def handover_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers two hand-overs away from any."""
    starts = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"))
    return traverse.window(starts, handovers(spark, sf_dir), 2, 2).nodes


@entry("next_event_hops", """WITH e AS (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT event_type AS src, nxt AS dst, count(*) AS hops FROM e WHERE nxt IS NOT NULL GROUP BY ALL""")
def next_event_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an event of one type follows one of another, per user."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    ahead = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("src"), ahead.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("hops"))
