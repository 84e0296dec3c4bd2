"""Filtered, budgeted views of a graph, and continuation tokens to page through them."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog
from .graph import PropertyGraph
from .ir import PlanError
from .navigate import Navigator


@dataclass(frozen=True)
class ViewRequest:
    """Filters of a view; empty ones do not filter. Budgets None are no bound. Fixed defaults of the API."""

    kinds: tuple[str, ...] = ()
    files: tuple[int, ...] = ()
    components: tuple[int, ...] = ()
    repositories: tuple[int, ...] = ()
    namespace: str = ""
    statuses: tuple[int, ...] = ()  # resolved flags
    edge_kinds: tuple[str, ...] = ()
    config: int | None = None
    max_nodes: int | None = 250
    max_edges: int | None = 500
    max_sites: int = 200

    def identity(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, default=list).encode()).hexdigest()


@dataclass
class View:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool = False
    next_token: str | None = None
    facts: dict = field(default_factory=dict)


def filtered_nodes(g: PropertyGraph, r: ViewRequest) -> DataFrame:
    """Symbols that pass all filters of a request."""
    s = g.t("symbol")
    if r.kinds:
        s = s.where(F.col("kind").isin([catalog.SYMBOL_KINDS[k] for k in r.kinds]))
    if r.files:
        s = s.where(F.col("file_id").isin(list(r.files)))
    if r.components or r.repositories:
        place = g.t("file").select(F.col("id").alias("file_id"), F.col("directory_id").alias("d")).join(g.t("directory").select(F.col("id").alias("d"), F.col("component_id").alias("c")), "d")
        place = place.join(g.t("component").select(F.col("id").alias("c"), "repository_id"), "c")
        if r.components:
            place = place.where(F.col("c").isin(list(r.components)))
        if r.repositories:
            place = place.where(F.col("repository_id").isin(list(r.repositories)))
        s = s.join(place.select("file_id").distinct(), "file_id", "left_semi")
    if r.namespace:
        s = s.where(F.col("qual_name").startswith(r.namespace + "::"))
    if r.statuses:
        s = s.where(F.col("resolved").isin(list(r.statuses)))
    if r.config is not None:
        known = g.t("fact_applicability").where((F.col("fact_kind") == "symbol") & (F.col("config_id") == r.config))
        s = s.join(known.select(F.col("fact_id").alias("id")), "id", "left_semi")
    return s


def filtered_edges(g: PropertyGraph, nodes: DataFrame, r: ViewRequest) -> DataFrame:
    """Edges of the wanted kinds with both ends among ``nodes``."""
    e = g.t("edge")
    if r.edge_kinds:
        e = e.where(F.col("kind").isin([catalog.RELATIONS[f"symbol.{k}"].id for k in r.edge_kinds]))
    ends = nodes.select("id")
    return e.join(ends.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ends.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def encode_token(identity: str, after: tuple) -> str:
    return base64.urlsafe_b64encode(json.dumps([identity, list(after)]).encode()).decode()


def decode_token(token: str, identity: str) -> tuple:
    """Where to go on; a token of another request is an error."""
    try:
        owner, after = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as e:
        raise PlanError("E_STAGE", "the continuation cannot be read") from e
    if owner != identity:
        raise PlanError("E_IDENTITY", "the continuation belongs to another request")
    return tuple(after)


def page(df: DataFrame, keys: list[str], size: int, identity: str, token: str | None = None) -> tuple[DataFrame, str | None]:
    """One page in the order of unique, not null ``keys``, and the token of the next, or None after the last.

    Pages follow each other by key, so no page counts over the ones before it.
    """
    if token:
        after = decode_token(token, identity)
        more = F.lit(False)
        for i in reversed(range(len(keys))):
            more = (F.col(keys[i]) > F.lit(after[i])) | ((F.col(keys[i]) == F.lit(after[i])) & more)
        df = df.where(more)
    some = df.orderBy(*keys).limit(size + 1).collect()
    spark = df.sparkSession
    last = some[size - 1] if len(some) > size else None
    out = spark.createDataFrame(some[:size], df.schema)
    return out, encode_token(identity, tuple(last[k] for k in keys)) if last else None


def build(g: PropertyGraph, r: ViewRequest, token: str | None = None) -> View:
    """Nodes that pass the filters, in order of their ids, as many as the budget allows, and the edges between them."""
    nodes = filtered_nodes(g, r)
    following = None
    if r.max_nodes is not None:
        nodes, following = page(nodes, ["id"], r.max_nodes, r.identity(), token)
    edges = filtered_edges(g, nodes, r)
    cut = following is not None
    if r.max_edges is not None:
        cut = cut or edges.count() > r.max_edges
        edges = edges.orderBy("src_id", "dst_id", "kind").limit(r.max_edges)
    return View(nodes, edges, cut, following)


def search_candidates(g: PropertyGraph, text: str, limit: int = 50) -> DataFrame:
    return Navigator(g).find(text, limit)


def edge_evidence(g: PropertyGraph, edge_id: int, size: int = 200, token: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of the sites of one edge."""
    own = g.t("edge_site").where(F.col("edge_id") == edge_id).select("file_id", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"), "conditional")
    return page(own, ["file_id", "line", "col"], size, f"edge:{edge_id}", token)
