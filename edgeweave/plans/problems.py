"""Queries of the general data problems p1 to p5 over the tables of a code index, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import Hierarchy, peel
from ..operators.nested import Level, NestedTables, occurrences, shred
from ..operators.orphans import orphan_references
from ..operators.snapshots import plain_path, snapshot_changes
from ..operators.tree_aggregate import tree_select, tree_stats
from ..runtime import materialize, table

#: Members of a Result's objects that queries give out, by level.
RESULT_MEMBERS = {0: ("shape", "view"), 1: ("length", "status"), 2: ("id",), 3: ("file_id",)}
#: Result -> paths -> steps -> sites.
RESULT_LEVELS = (
    Level("result", "paths", ("count",)),
    Level("path", "steps", ("length",)),
    Level("step", "sites", ("id", "position", "pack_index")),
    Level("site", None, ("file_id", "line", "col")),
)


def _results(spark: SparkSession, sf_dir: str) -> NestedTables:
    source = table(spark, sf_dir, "query_result", "result_id", "loaded_at", "body")
    return shred(source, "result_id", "body", "loaded_at", RESULT_LEVELS, envelope="result", marks=("shape", "paths"), members=RESULT_MEMBERS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occurrences(_results(spark, sf_dir), {2: [("id", "bigint")], 3: [("file_id", "bigint")]}, "result_id")
    gone = F.lit(-1)
    return rows.select(
        "result_id",
        *[F.coalesce(f"{x}_pos", gone).cast("int").alias(f"{x}_pos") for x in ("path", "step", "site")],
        F.coalesce("step_id", gone.cast("long")).alias("node_id"),
        F.coalesce("site_file_id", gone.cast("long")).alias("file_id"),
    )


def p1_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each level's objects occur below distinct parents, and how many distinct objects are stored for them."""
    t = _results(spark, sf_dir)
    stored = t.objects.groupBy("level").agg(F.count(F.lit(1)).alias("stored"))
    linked = t.bridges.groupBy((F.col("level") + 1).alias("level")).agg(F.count(F.lit(1)).alias("linked"))
    return stored.join(linked, "level", "left").select("level", "stored", F.coalesce("linked", F.lit(0)).cast("long").alias("linked"))


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of paths: one row per path of each Result, with its parent and its place in it."""
    t = _results(spark, sf_dir)
    upper = NestedTables(t.roots, t.objects, t.shapes, t.bridges, t.levels[:2], t.members)
    rows = occurrences(upper, {0: [("shape", "string"), ("view", "string")], 1: [("length", "bigint"), ("status", "string")]}, "result_id")
    return rows.where("path_pos is not null").select("result_id", "path_pos", "result_shape", "result_view", "path_length", "path_status")


def _hierarchy(spark: SparkSession, sf_dir: str, with_descendants: bool = False) -> Hierarchy:
    edges = table(spark, sf_dir, "entity_edge", "src_id", "dst_id", "kind").where("kind in (1, 12)")
    down = F.col("kind") == 12
    links = edges.select(
        F.col("kind").cast("string").alias("tree"),
        F.when(down, F.col("dst_id")).otherwise(F.col("src_id")).alias("child"),
        F.when(down, F.col("src_id")).otherwise(F.col("dst_id")).alias("parent"),
    )
    return peel(links, with_descendants)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _hierarchy(spark, sf_dir).nodes
    return nodes.select(F.col("tree").cast("int").alias("kind"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "path", "state")


def p2_subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _hierarchy(spark, sf_dir).nodes.where("state = 'tree'")
    return nodes.select(F.col("tree").cast("int").alias("kind"), F.col("node").alias("node_id"), F.col("below").alias("descendants"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hierarchy(spark, sf_dir, with_descendants=True).descendants
    return rows.select(F.col("tree").cast("int").alias("kind"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def _distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge once; rows without source, target or kind are no edges. A null count adds nothing."""
    edges = table(spark, sf_dir, "entity_edge", "src_id", "dst_id", "kind", "via_member_id", "create_form", "count")
    whole = edges.where("src_id is not null and dst_id is not null and kind is not null")
    return whole.groupBy("src_id", "dst_id", "kind", "via_member_id", "create_form").agg(F.max("count").alias("count"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _distinct_edges(spark, sf_dir).groupBy("src_id", "kind", "dst_id").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("weight"))
    middle = tree_select(materialize(weights), ["src_id", "kind"], ["weight", "dst_id"], F.floor((F.col("n") + 1) / 2), chunk=1024)
    return middle.select("src_id", "kind", "dst_id")


def p3_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = {"edges": F.count(F.lit(1)), "total": F.sum("count"), "least": F.min("count"), "most": F.max("count")}
    stats = tree_stats(_distinct_edges(spark, sf_dir), ["src_id", "kind"], leaf, {"edges": "sum", "total": "sum", "least": "min", "most": "max"})
    return stats.select("src_id", "kind", *leaf)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = table(spark, sf_dir, "tu_dependency", "snapshot_no", "source", "destination", "kind", "conditional_context", "destination_content_sha256")
    deps = deps.select(
        "snapshot_no",
        F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (plain_path(F.col("source")), plain_path(F.col("destination")), F.col("kind"), F.col("conditional_context"))]).alias("record_key"),
        F.lower(F.coalesce("destination_content_sha256", F.lit(""))).alias("value"),
    )
    pending = table(spark, sf_dir, "cidx_pending_symbol_identity", "snapshot_no", "symbol_id", "usr")
    pending = pending.select("snapshot_no", F.col("symbol_id").cast("string").alias("record_key"), F.col("usr").alias("value"))
    out = None
    for name, rows in (("tu_dependency", deps), ("cidx_pending_symbol_identity", pending)):
        part = snapshot_changes(rows, "snapshot_no", ["record_key"], "value").select(F.lit(name).alias("table_name"), "snapshot_no", "record_key", "change")
        out = part if out is None else out.unionByName(part)
    return out


def p4_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("table_name", "snapshot_no", "change").agg(F.count(F.lit(1)).alias("records"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "artifact_identity_map", "artifact_id", "local_identity", "identity_kind", "resolution_state", "core_symbol_id", "recorded_at", "loaded_at")
    repos = table(spark, sf_dir, "repository", "id", "active_clone_id", "recorded_at", "loaded_at", "deleted_at")
    clones = table(spark, sf_dir, "clone", "id", "repository_id", "recorded_at", "loaded_at", "deleted_at")
    symbols = table(spark, sf_dir, "symbol", "id", "loaded_at", "deleted_at")

    def refs(df: DataFrame, parent: str, name: str, column: str, key) -> DataFrame:
        return df.where(F.col(column) != 0).select(
            F.lit(parent).alias("parent"),
            F.lit(name).alias("table"),
            F.lit(column).alias("column"),
            key.alias("key"),
            F.col(column).alias("target"),
            F.date_format("recorded_at", "yyyy-MM").alias("period"),
            F.col("loaded_at").alias("loaded"),
        )

    whole = F.concat_ws("|", F.coalesce(F.col("artifact_id").cast("string"), F.lit("")), F.coalesce("local_identity", F.lit("")), F.coalesce("identity_kind", F.lit("")))
    own = F.col("id").cast("string")
    references = (
        refs(mapped.where("resolution_state = 'resolved'"), "symbol", "artifact_identity_map", "core_symbol_id", whole)
        .unionByName(refs(repos.where("deleted_at is null"), "clone", "repository", "active_clone_id", own))
        .unionByName(refs(clones.where("deleted_at is null"), "repository", "clone", "repository_id", own))
    )
    parents = None
    for name, df in (("symbol", symbols), ("clone", clones), ("repository", repos)):
        part = df.select(F.lit(name).alias("parent"), "id", F.col("deleted_at").isNotNull().alias("deleted"), F.col("loaded_at").alias("loaded"))
        parents = part if parents is None else parents.unionByName(part)
    return orphan_references(references, parents)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select(
        F.col("table").alias("ref_table"), F.col("column").alias("ref_column"), F.col("key").alias("ref_key"), F.col("target").alias("target_id"), "period", "cause"
    )


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, column, period and cause."""
    return p5_found(spark, sf_dir).groupBy("ref_table", "ref_column", "period", "cause").agg(F.count(F.lit(1)).alias("references"))


QUERIES = {f.__name__: f for f in (p1_found, p1_objects, p1_paths, p2_found, p2_subtree_sizes, p2_descendants, p3_found, p3_key_stats, p4_found, p4_change_counts, p5_found, p5_report)}

_RESULTS_SQL = """
good AS (SELECT result_id, loaded_at, body FROM query_result
         WHERE result_id IS NOT NULL AND body IS NOT NULL AND json_valid(body) AND json_type(body) = 'OBJECT'),
one AS (SELECT result_id, body FROM good QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at NULLS LAST) = 1),
res AS (SELECT result_id, CASE WHEN json_type(body, '$.result') = 'OBJECT' AND NOT json_exists(body, '$.shape')
                                AND NOT json_exists(body, '$.paths') THEN json_extract(body, '$.result') ELSE json(body) END AS r FROM one),
paths AS (SELECT result_id, i AS path_pos, json_extract(r, '$.paths[' || i || ']') AS p
          FROM (SELECT result_id, r, unnest(range(coalesce(json_array_length(r, '$.paths'), 0)::BIGINT)) AS i FROM res))"""

_TREE_SQL = """
links AS (SELECT DISTINCT kind, CASE kind WHEN 12 THEN dst_id ELSE src_id END AS child, CASE kind WHEN 12 THEN src_id ELSE dst_id END AS parent
          FROM entity_edge WHERE kind IN (1, 12)),
nodes AS (SELECT kind, child AS node_id FROM links UNION SELECT kind, parent FROM links),
tree(kind, node_id, root_id, depth, path) AS (
  SELECT kind, node_id, node_id, 0, node_id::VARCHAR FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.kind = n.kind AND l.child = n.node_id)
  UNION ALL
  SELECT l.kind, l.child, t.root_id, t.depth + 1, t.path || '/' || l.child FROM tree t JOIN links l ON l.kind = t.kind AND l.parent = t.node_id)"""

_EDGES_SQL = """edges AS (SELECT src_id, dst_id, kind, via_member_id, create_form, max(count) AS count FROM entity_edge
  WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND kind IS NOT NULL GROUP BY ALL)"""


def _plain_sql(column: str) -> str:
    """A path in plain form: its parts folded from the left, each ``..`` taking the part before it."""
    slashed = f"replace({column}, chr(92), '/')"
    parts = f"list_filter(string_split({slashed}, '/'), lambda x: x <> '' AND x <> '.')"
    kept = f"list_reduce(list_transform({parts}, lambda x: [x]), lambda a, b: CASE WHEN b[1] = '..' THEN a[:len(a) - 1] ELSE list_concat(a, b) END, []::VARCHAR[])"
    return f"(CASE WHEN starts_with({slashed}, '/') THEN '/' ELSE '' END || array_to_string({kept}, '/'))"


_SNAPSHOT_SQL = f"""
rows AS (
  SELECT DISTINCT 'tu_dependency' AS table_name, snapshot_no, {_plain_sql("source")} || '|' || {_plain_sql("destination")} || '|' || coalesce(kind, '') || '|' || coalesce(conditional_context, '') AS record_key,
         lower(coalesce(destination_content_sha256, '')) AS v FROM tu_dependency
  UNION SELECT DISTINCT 'cidx_pending_symbol_identity', snapshot_no, symbol_id::VARCHAR, usr FROM cidx_pending_symbol_identity),
steps AS (SELECT table_name, snapshot_no, lag(snapshot_no) OVER (PARTITION BY table_name ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT table_name, snapshot_no FROM rows)),
cur AS (SELECT s.table_name, s.snapshot_no, r.record_key, r.v FROM steps s JOIN rows r ON r.table_name = s.table_name AND r.snapshot_no = s.snapshot_no WHERE s.before IS NOT NULL),
old AS (SELECT s.table_name, s.snapshot_no, r.record_key, r.v FROM steps s JOIN rows r ON r.table_name = s.table_name AND r.snapshot_no = s.before),
changes AS (
  SELECT coalesce(c.table_name, o.table_name) AS table_name, coalesce(c.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(c.record_key, o.record_key) AS record_key,
         CASE WHEN o.record_key IS NULL THEN 'added' WHEN c.record_key IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT * FROM cur EXCEPT ALL SELECT * FROM old) c
  FULL JOIN (SELECT * FROM old EXCEPT ALL SELECT * FROM cur) o ON o.table_name = c.table_name AND o.snapshot_no = c.snapshot_no AND o.record_key = c.record_key)"""

_ORPHAN_SQL = """
refs AS (
  SELECT 'artifact_identity_map' AS ref_table, 'core_symbol_id' AS ref_column, artifact_id || '|' || local_identity || '|' || identity_kind AS ref_key,
         core_symbol_id AS target_id, strftime(recorded_at, '%Y-%m') AS period, loaded_at, 'symbol' AS parent FROM artifact_identity_map WHERE resolution_state = 'resolved'
  UNION ALL SELECT 'repository', 'active_clone_id', id::VARCHAR, active_clone_id, strftime(recorded_at, '%Y-%m'), loaded_at, 'clone' FROM repository WHERE deleted_at IS NULL
  UNION ALL SELECT 'clone', 'repository_id', id::VARCHAR, repository_id, strftime(recorded_at, '%Y-%m'), loaded_at, 'repository' FROM clone WHERE deleted_at IS NULL),
one AS (SELECT ref_table, ref_column, ref_key, target_id, period, parent, min(loaded_at) AS seen FROM refs WHERE target_id <> 0 GROUP BY ALL),
ids AS (SELECT parent, id, bool_and(gone) AS gone, min(loaded_at) AS came FROM (
  SELECT 'symbol' AS parent, id, deleted_at IS NOT NULL AS gone, loaded_at FROM symbol
  UNION ALL SELECT 'clone', id, deleted_at IS NOT NULL, loaded_at FROM clone
  UNION ALL SELECT 'repository', id, deleted_at IS NOT NULL, loaded_at FROM repository) GROUP BY ALL),
orphans AS (SELECT ref_table, ref_column, ref_key, target_id, period,
    CASE WHEN i.id IS NULL THEN 'missing' WHEN i.gone THEN 'deleted' WHEN i.came > o.seen THEN 'late' END AS cause
  FROM one o LEFT JOIN ids i ON i.parent = o.parent AND i.id = o.target_id)"""

SQL = {
    "p1_found": f"""WITH {_RESULTS_SQL},
steps AS (SELECT result_id, path_pos, j AS step_pos, json_extract(p, '$.steps[' || j || ']') AS s
          FROM (SELECT result_id, path_pos, p, unnest(range(coalesce(json_array_length(p, '$.steps'), 0)::BIGINT)) AS j FROM paths)),
sites AS (SELECT result_id, path_pos, step_pos, k AS site_pos, json_extract_string(s, '$.sites[' || k || '].file_id') AS f
          FROM (SELECT result_id, path_pos, step_pos, s, unnest(range(coalesce(json_array_length(s, '$.sites'), 0)::BIGINT)) AS k FROM steps))
SELECT r.result_id, coalesce(p.path_pos, -1)::INTEGER AS path_pos, coalesce(s.step_pos, -1)::INTEGER AS step_pos, coalesce(t.site_pos, -1)::INTEGER AS site_pos,
       coalesce(TRY_CAST(json_extract_string(s.s, '$.id') AS BIGINT), -1) AS node_id, coalesce(TRY_CAST(t.f AS BIGINT), -1) AS file_id
FROM res r LEFT JOIN paths p ON p.result_id = r.result_id LEFT JOIN steps s ON s.result_id = p.result_id AND s.path_pos = p.path_pos
LEFT JOIN sites t ON t.result_id = s.result_id AND t.path_pos = s.path_pos AND t.step_pos = s.step_pos""",
    "p1_paths": f"""WITH {_RESULTS_SQL}
SELECT r.result_id, path_pos::INTEGER AS path_pos, json_extract_string(r, '$.shape') AS result_shape, json_extract_string(r, '$.view') AS result_view,
       TRY_CAST(json_extract_string(p, '$.length') AS BIGINT) AS path_length, json_extract_string(p, '$.status') AS path_status
FROM res r JOIN paths p ON p.result_id = r.result_id""",
    "p2_found": f"""WITH RECURSIVE {_TREE_SQL},
walk(kind, start, pos, least, n) AS (
  SELECT kind, child, parent, least(child, parent), 1 FROM links WHERE (kind, child) NOT IN (SELECT kind, node_id FROM tree)
  UNION ALL
  SELECT r.kind, r.start, l.parent, least(r.least, l.parent), r.n + 1 FROM walk r JOIN links l ON l.kind = r.kind AND l.child = r.pos WHERE r.pos <> r.start AND r.n < 2000),
ring AS (SELECT kind, start AS node_id, least AS root_id FROM walk WHERE pos = start),
under(kind, node_id, root_id) AS (
  SELECT l.kind, l.child, r.root_id FROM ring r JOIN links l ON l.kind = r.kind AND l.parent = r.node_id WHERE (l.kind, l.child) NOT IN (SELECT kind, node_id FROM ring)
  UNION ALL SELECT l.kind, l.child, u.root_id FROM under u JOIN links l ON l.kind = u.kind AND l.parent = u.node_id)
SELECT kind, node_id, root_id, depth, path, 'tree' AS state FROM tree
UNION ALL SELECT kind, node_id, root_id, -1, '', 'in_cycle' FROM ring
UNION ALL SELECT kind, node_id, root_id, -1, '', 'below_cycle' FROM under""",
    "p2_subtree_sizes": f"""WITH RECURSIVE {_TREE_SQL},
pairs AS (SELECT kind, unnest(string_split(path, '/'))::BIGINT AS node_id FROM tree)
SELECT kind, node_id, count(*) - 1 AS descendants FROM pairs GROUP BY ALL""",
    "p2_descendants": f"""WITH RECURSIVE {_TREE_SQL},
pairs AS (SELECT kind, node_id, depth, unnest(string_split(path, '/'))::BIGINT AS above, unnest(range(depth + 1)) AS i FROM tree)
SELECT kind, above AS node_id, node_id AS descendant_id, (depth - i)::INTEGER AS distance FROM pairs WHERE i < depth""",
    "p3_found": f"""WITH {_EDGES_SQL}, w AS (SELECT src_id, kind, dst_id, coalesce(sum(count), 0) AS weight FROM edges GROUP BY ALL)
SELECT src_id, kind, dst_id FROM (SELECT *, row_number() OVER (PARTITION BY src_id, kind ORDER BY weight, dst_id) AS r, count(*) OVER (PARTITION BY src_id, kind) AS n FROM w)
WHERE r = (n + 1) // 2""",
    "p3_key_stats": f"""WITH {_EDGES_SQL} SELECT src_id, kind, count(*) AS edges, sum(count)::BIGINT AS total, min(count) AS least, max(count) AS most FROM edges GROUP BY ALL""",
    "p4_found": f"WITH {_SNAPSHOT_SQL} SELECT table_name, snapshot_no, record_key, change FROM changes",
    "p4_change_counts": f"WITH {_SNAPSHOT_SQL} SELECT table_name, snapshot_no, change, count(DISTINCT record_key) AS records FROM changes GROUP BY ALL",
    "p5_found": f"WITH {_ORPHAN_SQL} SELECT * FROM orphans WHERE cause IS NOT NULL",
    "p5_report": f"""WITH {_ORPHAN_SQL} SELECT ref_table, ref_column, period, cause, count(*) AS "references" FROM orphans WHERE cause IS NOT NULL GROUP BY ALL""",
}
