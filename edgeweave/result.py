"""Results as documents: legacy JSON, envelopes with status and diagnostics, and explanations of plans."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog, ir
from .engine import Budgets, Engine, Result
from .graph import PropertyGraph
from .navigate import Navigator
from .sources.artifacts import freshness

SCHEMA = "edgeweave.result/v1"
#: Keys of the index that an explanation lists; longest text in an answer, in bytes; deepest nesting of one.
META_KEYS, TEXT_BYTES, DEPTH = 1000, 65_536, 64
# What secrets are assigned to, and what stands in place of what is left out. Fixed values of the format.
_SECRET, _HIDDEN, _CUT = re.compile(r"(TOKEN|PASSWORD|SECRET)([=:])[^\s,;]+"), "<redacted:secret>", "...<redacted:size-limit>"


def redact(value: object, most: int = TEXT_BYTES, depth: int = 0) -> object:
    """``value`` as an answer may show it: assigned secrets and what is beyond ``most`` bytes of a text are left out.

    Floating-point numbers, integers beyond 64 bits, other types and too deep a nesting are errors.
    """
    if depth > DEPTH:
        raise ValueError("an answer is nested too deeply")
    if isinstance(value, str):
        raw = _SECRET.sub(rf"\1\2{_HIDDEN}", value).encode()
        if len(raw) > most:
            raw = (raw[: max(0, most - len(_CUT))] + _CUT.encode())[: max(most, 0)]
        return raw.decode(errors="ignore")
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError("an integer does not fit 64 bits")
        return value
    if isinstance(value, (list, tuple)):
        return [redact(v, most, depth + 1) for v in value]
    if isinstance(value, dict):
        return {k: redact(v, most, depth + 1) for k, v in value.items()}
    raise ValueError(f"no {type(value).__name__} in an answer")


def relations_of(plan: ir.Plan) -> list[str]:
    """Qualified names of all relations that a plan touches, those of operands and predicates included."""
    found: set[str] = set()

    def of_pred(p: ir.Pred | None) -> None:
        if p is not None:
            if p.relation:
                found.add(p.relation)
            of_pred(p.target)
            for k in p.kids:
                of_pred(k)

    def of_plan(p: ir.Plan) -> None:
        for s in p.stages:
            if s.relation:
                found.add(s.relation)
            of_pred(s.pred)
            if s.op == "reverse_type_use":
                found.update(("type.has_type_edge", "symbol.of_type"))
            if s.plan is not None:
                of_plan(s.plan)

    of_plan(ir.validate(plan))
    return sorted(found)


def index_identity(graph: PropertyGraph, present: str | None = None) -> dict:
    """What the index says of itself in ``meta``: its revision and the others, and whether that is the ``present`` revision."""
    told = {r["key"]: r["value"] for r in graph.t("meta").where("key is not null").orderBy("key").limit(META_KEYS).collect()}
    return {"revision": told.get("revision"), "freshness": freshness(told.get("revision"), present), "meta": told}


def explain(plan: ir.Plan, budgets: Budgets = Budgets(), graph: PropertyGraph | None = None, present: str | None = None) -> dict:
    """The plan in normal form, its shape, what it reads and how complete that is, the budgets, and the identity of the index."""
    names = relations_of(plan)
    state = {n: "complete" if catalog.RELATIONS[n].complete else "partial" for n in names}
    return {
        "plan": ir.plan_dict(ir.validate(plan)),
        "shape": ir.final_shape(plan),
        "relations": state,
        "partial_inputs": [n for n in names if state[n] == "partial"],
        "index": index_identity(graph, present) if graph is not None else {},
        "budgets": {"enumerate": budgets.enumerate, "traverse": budgets.traverse, "walks": budgets.walks, "witnesses": budgets.witnesses, "rows": budgets.rows},
    }


def to_dict(result: Result, index: dict | None = None, cap: int | None = 1000) -> dict:
    """shape, view, count, truncated, index, and rows or paths. Paths list their steps without evidence; see ``witnesses``."""
    if result.shape == "scalar":
        n = result.rows()[0]["count"]
        return {"shape": "scalar", "view": result.view, "count": n, "truncated": result.truncated, "index": index or {}}
    rows = result.rows(cap)
    head = {"shape": result.shape, "view": result.view, "count": len(rows), "truncated": result.truncated, "index": index or {}}
    if result.shape != "path":
        return head | {"rows": rows}
    return head | {"paths": [_witness(r) for r in rows]}


def _witness(row: dict, sites: dict | None = None) -> dict:
    steps = []
    for i, node in enumerate(row["trail"]):
        first = i == 0
        step = {"id": node, "domain": row["domain"], "through": "" if first else row["through"]}
        if not first and row["direction"] == "in":
            step["direction"] = "in"
        step["status"] = "complete" if first else row["status"]
        step["sites"] = (sites or {}).get((row["trail"][i - 1], node), []) if not first else []
        steps.append(step)
    return {"length": row["length"], "status": row["status"], "steps": steps}


def hop_evidence(graph: PropertyGraph, paths: DataFrame, relation: str, inbound: bool = False, cap: int = 1000) -> DataFrame:
    """(src, dst, sites, more_sites): evidence of every hop on any of the paths, each hop once, at most ``cap`` sites."""
    hops = paths.select(F.explode(F.arrays_zip(F.slice("trail", 1, F.size("trail") - 1).alias("a"), F.slice("trail", 2, F.size("trail") - 1).alias("b"))).alias("h"))
    a, b = ("h.b", "h.a") if inbound else ("h.a", "h.b")
    hops = hops.select(F.col(a).alias("src_id"), F.col(b).alias("dst_id")).distinct()
    r = catalog.RELATIONS[relation]
    own = graph.t("edge").where(F.col("kind") == r.id).join(hops, ["src_id", "dst_id"], "left_semi")
    return Navigator(graph).with_sites(own, cap).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "sites", "more_sites")


def witnesses(engine: Engine, plan: ir.Plan, cap: int = 1000) -> list[dict]:
    """The paths of a plan with the evidence of each hop; a hop with more sites than the budget makes its path partial."""
    result = engine.run(plan)
    stage = next(s for s in reversed(ir.validate(plan).stages) if s.op == "path")
    rows = result.rows(cap)
    sites, more = {}, set()
    if stage.relation.startswith("symbol."):
        shown = engine.graph.spark.createDataFrame([(r["trail"],) for r in rows], "trail array<bigint>")
        for h in hop_evidence(engine.graph, shown, stage.relation, stage.inbound, engine.budgets.sites_per_hop).collect():
            key = (h["dst"], h["src"]) if stage.inbound else (h["src"], h["dst"])
            sites[key] = [x.asDict() for x in h["sites"] or [] if x is not None]
            if h["more_sites"]:
                more.add(key)
    out = []
    for r in rows:
        w = _witness(r, sites)
        if any(k in more for k in zip(r["trail"], r["trail"][1:])):
            w["status"] = "partial"
        out.append(w)
    return out


@dataclass
class Envelope:
    operation: str
    result: dict
    status: str = "complete"
    completeness: dict = field(default_factory=dict)
    diagnostics: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        body = {"schema": SCHEMA, "operation": self.operation, "status": self.status, "result": self.result, "completeness": self.completeness, "diagnostics": self.diagnostics}
        return json.dumps(body, indent=2)


def envelope(result: Result, index: dict | None = None, operation: str = "query") -> Envelope:
    """The result with its status: unknown wins over partial, truncation makes a complete one partial."""
    status = "unknown" if result.unknown else "partial" if result.partial or result.truncated else "complete"
    notes = [{"code": "truncated_budget"}] if result.truncated else []
    return Envelope(operation, to_dict(result, index), status, {"truncated": result.truncated, "partial": result.partial, "unknown": result.unknown}, notes)


def serve(engine: Engine, line: str) -> str:
    """One request of the line protocol, ``{"id": .., "query": ".."}``, to one line of answer."""
    from .query_text import parse

    request = {}
    try:
        request = json.loads(line)
        result = engine.run(parse(request["query"]))
        return json.dumps({"id": request.get("id"), "ok": True, "result": redact(json.loads(envelope(result).to_json()))})
    except (ir.PlanError, KeyError, ValueError) as e:
        return json.dumps({"id": request.get("id") if isinstance(request, dict) else None, "ok": False, "error": str(e)})
