"""Include graphs: merging of configurations, reach, shortest routes, cycles, hot spots, and the use of each directive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import traverse

#: Verdicts on a directive, by weight when configurations disagree. Fixed values of the data model.
VERDICTS = {"unused_by_reference": 0, "duplicate": 1, "manual_review": 2, "used": 3}


def merge_configurations(edges: DataFrame) -> DataFrame:
    """(src, dst, count, configs, dst_id): rows of all configurations merged; counts add up, digests are a sorted set."""
    return edges.groupBy("src", "dst").agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("config")).alias("configs"), F.max("dst_id").alias("dst_id"))


def invariant_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) of the includes that every configuration of their source has."""
    every = edges.select("src", "config").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("all"))
    have = edges.select("src", "dst", "config").distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("some"))
    return have.join(every, "src").where(F.col("some") == F.col("all")).select("src", "dst")


@dataclass
class IncludeGraph:
    """Files by path; ``edges`` has src, dst, count."""

    edges: DataFrame

    def nodes(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()

    def has_node(self, path: str) -> bool:
        return bool(self.edges.where((F.col("src") == path) | (F.col("dst") == path)).take(1))

    def direct_from(self, path: str) -> DataFrame:
        return self.edges.where(F.col("src") == path).select(F.col("dst").alias("path"), "count")

    def direct_to(self, path: str) -> DataFrame:
        return self.edges.where(F.col("dst") == path).select(F.col("src").alias("path"), "count")

    def numbered(self) -> tuple[DataFrame, DataFrame]:
        """(id, path) and (src, dst) by number, so that walks shuffle numbers instead of paths; a number is a path's hash.

        Two paths with one number would be one node; that is checked, and reported as an error.
        """
        ids = self.nodes().withColumn("id", F.xxhash64("path"))
        if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            raise ValueError("two paths share a hash")
        return ids, self.edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst")).distinct()

    def reach(self, path: str, max_depth: int = 0, inbound: bool = False) -> DataFrame:
        """(path, depth) of all files that ``path`` includes (or that include it), without itself; depth 0 is no bound."""
        ids, a = self.numbered()
        if inbound:
            a = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = ids.where(F.col("path") == path).select("id")
        return traverse.bfs(start, a, max_depth or None).where("depth > 0").join(ids, "id").select("path", "depth")

    def shortest_path(self, start: str, end: str) -> DataFrame:
        """One row with the least of the shortest routes, as an array of paths; none where there is no way."""
        kind = self.edges.schema["src"].dataType.simpleString()
        route = traverse.one_route(self.edges, start, end) if self.has_node(start) else []
        return self.edges.sparkSession.createDataFrame([(len(route) - 1, route)] if route else [], f"depth int, route array<{kind}>")

    def cycles(self) -> DataFrame:
        """(component, size, paths): strongly connected components of more than one file, and files that include themselves."""
        ids, a = self.numbered()
        own = a.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop"))
        parts = traverse.components(a).join(own, "id", "left").join(ids, "id")
        grouped = parts.groupBy("component").agg(F.max("size").alias("size"), F.max(F.coalesce("loop", F.lit(False))).alias("loop"), F.array_sort(F.collect_list(F.when((F.col("size") > 1) | F.col("loop"), F.col("path")))).alias("paths"))
        return grouped.where("size > 1 or loop").select(F.element_at("paths", 1).alias("component"), "size", "paths")

    def hotspots(self) -> DataFrame:
        """(path, fan_in, fan_out), 0 where there are none."""
        fan_in = self.edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("fan_in"))
        fan_out = self.edges.groupBy(F.col("src").alias("path")).agg(F.count_distinct("dst").alias("fan_out"))
        return fan_in.join(fan_out, "path", "full").select("path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def classify(g: PropertyGraph) -> DataFrame:
    """(site_id, src_file_id, dst_file_id, verdict, evidence): whether each include directive is needed.

    What a file refers to are the targets of the edges and definition bodies of its symbols; a directive is used if any
    of them is a symbol of the included file. The first that holds: repeated and unguarded, for review; repeated, a
    duplicate; referred to, used; nothing and no doubt, unused; else for review. Doubts: unresolved, a special directive,
    a conditional region, a system header, a macro of it in use, a file without symbols.
    """
    s = g.t("symbol").where("file_id is not null").select("id", "file_id")
    refs = g.t("edge").select(F.col("src_id").alias("id"), "dst_id").join(s, "id").select("file_id", "dst_id")
    bodies = g.t("definition").select(F.col("id").alias("src_def_id"), "file_id").join(g.t("def_edge").select("src_def_id", "dst_id"), "src_def_id").select("file_id", "dst_id")
    refs = refs.union(bodies).distinct()
    used = refs.join(s.select(F.col("id").alias("dst_id"), F.col("file_id").alias("target")), "dst_id").where("file_id <> target")
    used = used.groupBy(F.col("file_id").alias("src_file_id"), F.col("target").alias("dst_file_id")).agg(F.array_sort(F.collect_set("dst_id")).alias("evidence"))
    macros = g.t("macro_use").select("file_id", "symbol_id").join(s.select(F.col("id").alias("symbol_id"), F.col("file_id").alias("target")), "symbol_id")
    macros = macros.select(F.col("file_id").alias("src_file_id"), F.col("target").alias("dst_file_id"), F.lit(True).alias("macro")).distinct()
    owned = s.select(F.col("file_id").alias("dst_file_id"), F.lit(True).alias("owned")).distinct()
    from pyspark.sql import Window

    sites = g.t("include_site").join(g.t("include_edge").select(F.col("id").alias("edge_id"), "src_file_id", "dst_file_id", "is_system", "config_id"), "edge_id")
    pair = Window.partitionBy("src_file_id", "dst_file_id", "config_id")
    sites = sites.withColumn("times", F.count(F.lit(1)).over(pair)).withColumn("nth", F.row_number().over(pair.orderBy("begin_offset", "id")))
    df = sites.join(used, ["src_file_id", "dst_file_id"], "left").join(macros, ["src_file_id", "dst_file_id"], "left").join(owned, "dst_file_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    doubt = no("resolved") | F.coalesce(F.col("directive").isin("include_next", "import", "include_macros"), F.lit(False)) | F.coalesce(F.col("cond_fingerprint") != "", F.lit(False)) | ~no("is_system") | F.coalesce("macro", F.lit(False)) | F.col("owned").isNull()
    verdict = (
        F.when(no("guarded") & (F.col("times") > 1), "manual_review").when(F.col("nth") > 1, "duplicate").when(F.col("evidence").isNotNull(), "used").when(~doubt, "unused_by_reference").otherwise("manual_review")
    )
    return df.select(F.col("id").alias("site_id"), "config_id", "src_file_id", "dst_file_id", verdict.alias("verdict"), F.coalesce("evidence", F.array().cast("array<bigint>")).alias("evidence"))


def removal_plan(g: PropertyGraph) -> DataFrame:
    """(site_id, file_id, begin_offset, end_offset, spelling, action, content): what an include clean-up would do.

    Directives that no configuration needs are to be removed, duplicates likewise; the rest is kept or for review. ``content``
    is the digest of the file as indexed: a plan is stale for a file with another one.
    """
    c = classify(g)
    whole = agree(c).withColumnRenamed("verdict", "overall")
    sites = g.t("include_site").select(F.col("id").alias("site_id"), "begin_offset", "end_offset", "spelling")
    content = g.t("file").select(F.col("id").alias("src_file_id"), F.col("md5").alias("content"))
    df = c.join(whole, ["src_file_id", "dst_file_id"]).join(sites, "site_id").join(content, "src_file_id", "left")
    gone = F.col("verdict").isin("unused_by_reference", "duplicate") & (F.col("overall") == F.col("verdict"))
    action = F.when(gone, "remove").when((F.col("overall") == "manual_review") | (F.col("verdict") == "manual_review"), "review").otherwise("keep")
    return df.select("site_id", F.col("src_file_id").alias("file_id"), "begin_offset", "end_offset", "spelling", action.alias("action"), "content")


def stale(plan: DataFrame, present: DataFrame) -> DataFrame:
    """(file_id) of the files of a plan whose digest in ``present`` (file_id, content) is another one, or is not there."""
    now = present.select("file_id", F.col("content").alias("now"))
    return plan.select("file_id", "content").distinct().join(now, "file_id", "left").where("now is null or content is null or now <> content").select("file_id").distinct()


def agree(classified: DataFrame) -> DataFrame:
    """(src_file_id, dst_file_id, verdict) over all configurations: used anywhere is used, then for review; else all must agree."""
    weight = F.create_map(*[F.lit(x) for k, v in VERDICTS.items() for x in (k, v)])[F.col("verdict")]
    per = classified.groupBy("src_file_id", "dst_file_id").agg(F.max(weight).alias("top"), F.count_distinct("verdict").alias("kinds"), F.max_by("verdict", weight).alias("best"))
    return per.select("src_file_id", "dst_file_id", F.when((F.col("top") >= 2) | (F.col("kinds") == 1), F.col("best")).otherwise("manual_review").alias("verdict"))
