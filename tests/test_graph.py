import json
import random
import sqlite3
from collections import defaultdict, deque

import pytest
from fixtures import make, seeded
from pyspark.sql import functions as F

from edgeweave import catalog, derive, diff, facts, graphview, includes, navigate, rules, search
from edgeweave.functions import text
from edgeweave.engine import Engine
from edgeweave.ir import PlanError
from edgeweave.operators import traverse
from edgeweave.query_text import parse
from edgeweave.sources import artifacts, files
from edgeweave.streaming import rollups

rows = lambda df: sorted(tuple(r) for r in df.collect())


def digraph(spark, kind, n=24):
    rng = random.Random(kind)
    pairs = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)],
        "chain": [(i, i + 1) for i in range(11)],
        "dense": [(i, j) for i in range(6) for j in range(6)],
        "rings": [(i, i // 4 * 4 + (i + 1) % 4) for i in range(16)] + [(0, 4), (4, 8), (20, 20), (9, 21)],
        "empty": [],
    }[kind]
    return pairs, spark.createDataFrame(pairs, "src bigint, dst bigint")


def reach_of(pairs, start):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seen, todo = {}, deque((b, 1) for b in out[start])
    while todo:
        x, d = todo.popleft()
        if x not in seen:
            seen[x] = d
            todo += [(y, d + 1) for y in out[x]]
    return seen


@pytest.mark.parametrize("kind", ["random", "chain", "dense", "rings", "empty"])
def test_walks(spark, kind, monkeypatch):
    monkeypatch.setattr(traverse, "DOUBLE_FROM", 2)
    pairs, df = digraph(spark, kind)
    nodes = {x for p in pairs for x in p}
    reach = {n: reach_of(pairs, n) for n in nodes}
    assert rows(traverse.closure(df)) == sorted((a, b) for a in nodes for b in reach[a])
    start = spark.createDataFrame([(0,)], "id bigint")
    depths = {0: 0} | {b: d for b, d in reach.get(0, {}).items() if b != 0}
    assert rows(traverse.bfs(start, df).select("id", "depth")) == sorted(depths.items())
    level, want = {0}, set()
    for d in range(1, 5):
        level = {b for a, b in pairs if a in level}
        want |= level if d >= 2 else set()
    assert rows(traverse.window(start, df, 2, 4).nodes) == sorted((x,) for x in want)
    comps = {(n, min([n, *(b for b in reach[n] if n in reach[b])]), len({n, *(b for b in reach[n] if n in reach[b])})) for n in nodes}
    assert rows(traverse.components(df)) == sorted(comps)
    routes = {r["id"]: r["route"] for r in traverse.first_routes(start, df).collect()}
    assert {k: len(v) - 1 for k, v in routes.items()} == depths
    for k, v in routes.items():
        best = [[0]]
        for _ in range(len(v) - 1):
            best = sorted([*b, y] for b in best for x, y in set(pairs) if x == b[-1])
        assert v == min(b for b in best if b[-1] == k)


def test_simple_paths_match_brute_force(spark):
    pairs, df = digraph(spark, "random")
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    goals = {3, 7}

    def brute(start, low, high):
        walks, hits = [[start]], []
        for d in range(1, high + 1):
            walks = [[*w, y] for w in walks for y in out[w[-1]] if (y not in w or (y == start and y in goals and d >= low)) and (len(w) == 1 or w[-1] != start)]
            hits = [w for w in walks if w[-1] in goals and d >= low]
            if hits:
                return hits
        return []

    starts = spark.createDataFrame([(i,) for i in range(24)], "id bigint")
    for low, high in ((1, 6), (2, 5), (3, 3)):
        got = traverse.simple_paths(starts, spark.createDataFrame([(g,) for g in goals], "id bigint"), df, low, high).rows
        assert sorted(r["trail"] for r in got.collect()) == sorted(w for s in range(24) for w in brute(s, low, high)), (low, high)


def test_rules(spark):
    facts_ = {
        "edge": spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 1), (3, 1, 4), (5, 18, 4), (6, 6, 7), (9, 2, 8), (8, 2, 7)], "a bigint, k int, b bigint"),
        "symbol": spark.createDataFrame([(i, 8, 1) for i in range(1, 8)] + [(10, 4, 1), (11, 8, 0)], "id bigint, kind int, d int"),
        "entry_point": spark.createDataFrame([(5,)], "id bigint"),
        "file_of": spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "id bigint, f bigint"),
    }
    out = rules.cycles().run(facts_)
    assert rows(out["in_cycle"]) == [(1,), (2,), (3,)] and rows(out["cycle_edge"]) == [(1, 2), (2, 3), (3, 1)]
    assert rows(rules.unused().run(facts_)["unused"]) == []
    assert rows(rules.metrics().run(facts_)["fan_in"]) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0), (7, 0), (10, 0), (11, 0)]
    assert rows(rules.hierarchy().run(facts_)["ancestor"]) == [(8, 7), (9, 7), (9, 8)]
    assert rows(rules.cross_file().run(facts_)["file_depends"]) == [(1, 2, 1), (2, 1, 1)]
    tree = {
        "defines": spark.createDataFrame([(1, 100), (5, 200)], "n bigint, s bigint"), "child": spark.createDataFrame([(1, 2, 0), (2, 3, 0), (2, 5, 1), (5, 6, 0)], "p bigint, n bigint, o int"),
        "node": spark.createDataFrame([(1, "fn"), (2, "if"), (3, "call"), (5, "fn"), (6, "call")], "n bigint, k string"), "refers": spark.createDataFrame([(3, 200), (6, 300)], "n bigint, s bigint"),
    }
    assert rows(rules.ast_calls().run(tree)["ast_call"]) == [(100, 200), (200, 300)]
    assert rows(rules.ast_metrics().run(tree)["branches"]) == [(1, 1), (5, 0)]
    p = {"pointee": spark.createDataFrame([(2, 1), (3, 2)], "a bigint, b bigint"), "type": spark.createDataFrame([(1,), (2,), (3,)], "t bigint")}
    assert rows(rules.pointer_depth().run(p, ["depth"])["depth"]) == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(rules.RuleError):
        rules.Program().rule("a(x)", "b(x)", "!a(x)").strata()
    with pytest.raises(rules.RuleError):
        rules.Program().rule("a(x, y)", "b(x)", "b(y)").run({"b": p["type"]})


def test_derived_facts(spark):
    m = lambda i, kind, **kw: dict(id=i, usr=f"u{i}", spelling=f"s{i}", kind=kind, **kw)
    symbols = [
        m(1, 4), m(2, 4), m(3, 2), m(4, 31), m(5, 4), m(6, 22), m(7, 5), m(11, 21, is_pure=1), m(12, 21), m(13, 21, is_pure=0), m(14, 21), m(20, 6, type_info="std::vector<std::unique_ptr<s1>>", access="private"),
        m(21, 6, type_info="const s3 &", access="public"), m(22, 6, type_info="s7[4]"), m(30, 24, parent_usr="u3"), m(40, 4, is_named_instance=1), m(41, 6, type_info="std::shared_ptr<T>"), m(42, 6, type_info="s3"),
        m(43, 6, type_info="U"), m(15, 21, type_info="std::vector<s7> (int)"), m(16, 21, type_info="void ()"),
    ]
    pairs = [
        (2, 1, 2), (11, 1, 9), (12, 2, 9), (13, 5, 9), (14, 3, 9), (12, 11, 6), (13, 12, 6), (14, 11, 1), (5, 4, 5), (20, 2, 8), (21, 2, 8), (22, 2, 8), (14, 30, 11), (12, 14, 7), (1, 2, 17), (6, 1, 3), (6, 7, 3), (6, 12, 3),
        (40, 4, 5), (41, 4, 8), (42, 4, 8), (43, 4, 8), (15, 3, 9), (16, 3, 9),
    ]
    bound = dict(template_param=[dict(owner_id=4, position=0, param_kind=1, name="T"), dict(owner_id=4, position=1, param_kind=1, name="U")], template_arg=[dict(owner_id=40, position=0, pack_index=0, arg_kind=1, ref_id=2)])
    g = make(spark, **bound, symbol=symbols, edge=[dict(id=i + 1, src_id=a, dst_id=b, kind=k, count=1) for i, (a, b, k) in enumerate(pairs)], edge_site=[dict(edge_id=8, file_id=1, line=i, col=1) for i in range(3)])
    nodes = dict(rows(derive.entity_nodes(g)))
    assert nodes == {1: 3, 2: 1, 3: 1, 4: 6, 5: 1, 6: 9, 7: 5, 40: 1}
    e = {(r["src_id"], r["dst_id"], r["kind"], r["via_member_id"]): r for r in derive.entity_edges(g).collect()}
    assert (2, 1, 2, None) in e  # inherits an interface: implements
    assert (5, 4, 11, None) in e and (1, 2, 10, None) in e and {(6, 1, 12, None), (6, 7, 12, None)} <= set(e) and (6, 12, 12, None) not in e
    assert (e[2, 1, 4, 20]["multiplicity"], e[2, 1, 4, 20]["access"]) == (3, 2) and e[2, 3, 6, 21]["multiplicity"] == 2 and e[2, 7, 4, 22]["multiplicity"] == 4
    # A named instance: T is bound to 2, U to nothing known, the plain member is its own, too.
    assert {k for k in e if k[0] == 40} == {(40, 4, 11, None), (40, 2, 5, 41), (40, 3, 4, 42)}
    assert [e[k]["create_form"] for k in e if k[:3] == (3, 7, 7)] == [2]  # returned by value
    assert (2, 3, 8, 14) in e and e[3, 1, 8, 11]["partial"] == 1
    assert rows(derive.dispatch_calls(g).select("src_id", "dst_id")) == [(14, 12), (14, 13)]
    assert dict(rows(derive.site_counts(g).where("id = 8").select("id", "count"))) == {8: 3}
    done, seen = derive.run(g)
    assert done.t("edge").where("kind = 18").count() == 2
    same, again = derive.run(g, (done, seen))
    assert again == seen and rows(same.t("edge").select("src_id", "dst_id", "kind", "count")) == rows(done.t("edge").select("src_id", "dst_id", "kind", "count"))
    nav = navigate.Navigator(done)
    assert rows(nav.dispatch_targets(nav.ids(11))) == [(11, 12), (11, 13)]
    assert rows(nav.callees(nav.ids(14))) == [(14, 11, "direct"), (14, 12, "dispatch"), (14, 13, "dispatch")]
    assert rows(nav.members(nav.ids(2)).select("id")) == [(12,), (20,), (21,), (22,)]
    assert rows(navigate.Entities(nav, nav.ids(2)).implements().nodes()) == [(1,)]
    assert rows(navigate.devirtualized_calls(done, nav.ids(14), 1, 1)) == [(11,), (12,), (13,)]
    exact = done.replaced(
        edge_site=make(spark, edge_site=[dict(edge_id=8, file_id=1, line=1, col=1, recv_src_kind="local", recv_type_id=9, recv_type_is_value=1)]).t("edge_site"), type_node=make(spark, type_node=[dict(id=9, decl_usr="u2")]).t("type_node"),
        symbol=done.t("symbol").withColumn("parent_usr", F.when(F.col("id") == 11, "u1").otherwise(F.col("parent_usr"))),
    )
    assert rows(navigate.devirtualized_calls(exact, nav.ids(14), 1, 1)) == [(11,), (12,)]


def test_primaries_on_cycles(spark):
    pairs = [(1, 2, 4), (2, 3, 5), (5, 6, 4), (6, 7, 4), (7, 6, 4), (1, 9, 5)]
    g = make(spark, edge=[dict(id=i, src_id=a, dst_id=b, kind=k) for i, (a, b, k) in enumerate(pairs)])
    assert rows(derive.primaries(g)) == [(1, 3), (2, 3), (5, 6), (6, 6), (7, 6)]


def test_composition(spark):
    left = facts.FactSnapshot({"a": facts.Relation(spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "id bigint, t string"))}, "i")
    right = facts.FactSnapshot({"b": facts.Relation(spark.createDataFrame([(1, None), (3, "q")], "id bigint, v string"), "partial")}, "i", "stale")
    spec = [facts.JoinSpec("a", "b", (("id", "id"),), "ab")]
    out = facts.compose(left, right, spec)
    assert rows(out.rows("ab")) == [(0, "z", 0, "", "unresolved"), (1, "x", 1, "", "resolved"), (2, "", 0, "", "unresolved")]
    assert rows(out.rows("analysis/unresolved_join")) == [("ab", "a", "b", 2)]
    assert (out.relations["ab"].completeness, out.freshness) == ("partial", "stale")
    right.identity = "j"
    assert {r[-1] for r in rows(facts.compose(left, right, spec).rows("ab"))} == {"unresolved"}


def test_includes(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("d", "d", 1), ("d", "a", 1)], "src string, dst string, count bigint")
    g = includes.IncludeGraph(e)
    assert rows(g.reach("d")) == [("a", 1), ("b", 2), ("c", 3)] and rows(g.reach("d", 1)) == [("a", 1)] and rows(g.reach("a", inbound=True)) == [("b", 2), ("c", 1), ("d", 1)]
    assert g.shortest_path("d", "c").first()["route"] == ["d", "a", "b", "c"] and g.shortest_path("a", "d").count() == 0
    assert [(r["component"], r["paths"]) for r in g.cycles().orderBy("component").collect()] == [("a", ["a", "b", "c"]), ("d", ["d"])]
    sites = [dict(id=i, edge_id=e, begin_offset=i, directive="include", resolved=1, guarded=1) for i, e in ((1, 1), (2, 1), (3, 2), (4, 3))] + [dict(id=5, edge_id=4, begin_offset=1, directive="import", resolved=1, guarded=1)]
    own = make(
        spark, symbol=[dict(id=i, file_id=f, kind=8) for i, f in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 5))], edge=[dict(id=1, src_id=1, dst_id=2, kind=1)], include_site=sites,
        include_edge=[dict(id=i, src_file_id=1, dst_file_id=f, config_id=1, is_system=0) for i, f in ((1, 2), (2, 3), (3, 9), (4, 4))],
    )
    c = includes.classify(own)
    assert dict(rows(c.select("site_id", "verdict"))) == {1: "used", 2: "duplicate", 3: "unused_by_reference", 4: "manual_review", 5: "manual_review"}
    assert dict(rows(includes.agree(c).select("dst_file_id", "verdict"))) == {2: "used", 3: "unused_by_reference", 4: "manual_review", 9: "manual_review"}


def test_search_operators(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    r = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 2)], "src bigint, dst bigint")
    holds = spark.createDataFrame([(2, True), (3, True), (1, False)], "id bigint, holds boolean")
    assert rows(search.for_all(df, r, "id", holds, True)) == [(1, True), (2, False), (3, True)]
    assert search.for_all(df, r, "id", holds, False).where("every is null").count() == 2
    out, n = search.counted(df, r, "id", cap=1)
    # Beyond the cap of one the lower bound is one and the count is not known.
    assert [x[0] for x in out.orderBy("id").select(n.compare("at least", 2)).collect()] == [None, None, False]
    assert [x[0] for x in out.orderBy("id").select(n.compare("more than", 0)).collect()] == [True, True, False]
    assert [x[0] for x in out.orderBy("id").select(n.compare("exactly", 0)).collect()] == [False, False, True]
    assert rows(search.call_closure(df, r)) == [(1, 2), (1, 3), (2, 1), (2, 3)]
    with pytest.raises(PlanError):
        search.lacking(df, r, "id", complete=False)
    assert rows(search.rendered(df, "n$id$$", "t")) == [(1, "n1$"), (2, "n2$"), (3, "n3$")]
    with pytest.raises(KeyError):
        text.interpolate("$nothing", {})


def test_graph_views(spark):
    g = seeded(spark)
    r = graphview.ViewRequest(kinds=("function",), max_nodes=2)
    first = graphview.build(g, r)
    second = graphview.build(g, r, first.next_token)
    assert rows(first.nodes.select("id")) == [(1,), (2,)] and rows(second.nodes.select("id")) == [(3,)] and second.next_token is None
    with pytest.raises(PlanError, match="E_IDENTITY"):
        graphview.build(g, graphview.ViewRequest(kinds=("class",), max_nodes=2), first.next_token)
    with pytest.raises(PlanError, match="E_STAGE"):
        graphview.decode_token("nonsense", "x")


def test_text(spark):
    cases = [("a*c", "abc", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[]]x", "]x", True), ("a.c", "abc", False), ("[ab", "[ab", False), ("*\n*", "a\nb", True), ("A*", "abc", False), ("", "", True)]
    for pattern, value, want in cases:
        df = spark.createDataFrame([(value,)], "v string")
        assert df.select(text.glob(F.col("v"), pattern)).first()[0] is want, pattern
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "v string")
    assert [r[0] for r in df.select(text.fnv63(F.col("v"))).collect()] == [0xCBF29CE484222325 & (2**63 - 1), 0xAF63DC4C8601EC8C & (2**63 - 1), 0x85944171F73967E8 & (2**63 - 1), None]
    df = spark.createDataFrame([("a::b<x::y>::f(p::q)",), ("f",), ("a::b",)], "v string")
    assert [r[0] for r in df.select(text.top_level_namespace(F.col("v"))).collect()] == ["a::b", "", "a"]


def test_type_spellings(spark):
    cases = {
        "s": (4, 1, "s"), "const s &": (6, 2, "s"), "s *": (6, 2, "s"), "s[4]": (4, 4, "s"), "std::vector<s>": (4, 3, "s"), "std::map<std::string, std::pair<int, s>>": (4, 3, "std::pair<int, s>"),
        "vector<vector<std::shared_ptr<const s>>>": (5, 3, "s"), "std::unique_ptr<s>": (4, 2, "s"), "weak_ptr<s>": (6, 2, "s"), "map<int, s>": (4, 1, "map<int, s>"), "std::list<s *>": (6, 3, "s"),
        "std::optional<ns::s>": (4, 2, "ns::s"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    kind, many = text.field_shape(F.col("t"))
    assert {r[0]: tuple(r[1:]) for r in df.select("t", kind, many, text.value_type(F.col("t"))).collect()} == cases


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc"), (None, None), (3, 'q"x')], "i bigint, t string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert rows(files.read_tsv(spark, str(tmp_path / "t"), "i bigint, t string").fillna("")) == [(0, ""), (1, "a b c"), (3, 'q"x')]
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE rel (id INTEGER PRIMARY KEY, name TEXT, ok BOOLEAN, w REAL)")
        con.executemany("INSERT INTO rel VALUES (?, ?, ?, ?)", [(i, None if i % 5 == 0 else f"n{i}", i % 2, i / 2) for i in range(1, 101)])
    back = files.read_sqlite(spark, db, "rel", slices=4)
    assert [t for _, t in back.dtypes] == ["bigint", "string", "boolean", "double"] and back.count() == 100 and rows(back)[4] == (5, None, True, 2.5)
    (tmp_path / "cc.json").write_text(json.dumps([{"directory": "/d", "file": "a.c", "arguments": ["cc", "a.c"]}]))
    assert rows(files.read_compile_commands(spark, str(tmp_path / "cc.json"))) == [("/d", "a.c", "cc a.c")]


def test_artifacts(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, None)], "i bigint, t string")
    first = store.publish("facts", {"r": df})
    assert store.publish("facts", {"r": df.orderBy(F.desc("i"))}) == first and store.validate("facts")
    pin = store.hold(first)
    second = store.publish("facts", {"r": df.limit(1)})
    assert second != first and store.recover() == [] and rows(store.attach("facts").rows("r")) == [(1, "a")]
    store.release(pin)
    assert store.recover() == [first] and artifacts.freshness(first, second) == "stale" and artifacts.freshness(None, second) == "unverifiable"
    with pytest.raises(artifacts.ArtifactError):
        store.attach("nothing")


def test_rollups_in_batches(spark, tmp_path):
    make_batch = lambda i, data: spark.createDataFrame(data, "k string, v bigint").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    make_batch(0, [("a", 1), ("b", 2)])
    up = rollups.RollUp(spark, str(tmp_path / "out"), ["k"], {"n": (F.count(F.lit(1)), "sum"), "most": (F.max("v"), "max")})
    stream = lambda: spark.readStream.schema("k string, v bigint").parquet(str(tmp_path / "in" / "*"))
    up.start(stream(), str(tmp_path / "cp")).awaitTermination()
    assert rows(up.current()) == [("a", 1, 1), ("b", 1, 2)]
    make_batch(1, [("a", 7), ("c", 3)])
    up.start(stream(), str(tmp_path / "cp")).awaitTermination()
    assert rows(up.current()) == [("a", 2, 7), ("b", 1, 2), ("c", 1, 3)]
    up.apply(spark.createDataFrame([("a", 100)], "k string, v bigint"), 1)  # delivered again
    assert rows(up.current()) == [("a", 2, 7), ("b", 1, 2), ("c", 1, 3)]
    for _ in range(2):  # compaction keeps the rows, and the numbers of the batches it holds
        up.compact()
        up.apply(spark.createDataFrame([("a", 100)], "k string, v bigint"), 1)
        assert rows(up.current()) == [("a", 2, 7), ("b", 1, 2), ("c", 1, 3)]
    up.apply(spark.createDataFrame([("a", 3)], "k string, v bigint"), 2)
    up.compact()
    assert rows(up.current()) == [("a", 3, 7), ("b", 1, 2), ("c", 1, 3)]
    claims = spark.createDataFrame([("h", 2, "b"), ("h", 1, "c"), ("g", 1, "a")], "h string, r int, s string")
    assert rows(rollups.first_claims(claims, "h", "r")) == [("g", 1, "a"), ("h", 1, "c")]


def test_diff(spark):
    cols = "id bigint, usr string, signature string, name string, fingerprint string"
    old = spark.createDataFrame([(1, "u1", "s1", "n1", None), (2, "u2", "s2", "n2", None), (3, "x", "s3", "n3", "f"), (4, None, None, None, None)], cols)
    new = spark.createDataFrame([(11, "u1", "s9", "n9", None), (12, "v2", "s2", "n2", None), (13, "y", "t", "m", "f"), (14, None, None, None, None)], cols)
    got = {(r["old_id"], r["new_id"], r["tier"]) for r in diff.match(old, new).collect()}
    assert got == {(1, 11, "usr"), (2, 12, "signature"), (3, 13, "fingerprint"), (4, None, None), (None, 14, None)}
    e = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>").select(diff.edit_script("a", "b").alias("e")).first()["e"]
    assert [x["op"] for x in e] == ["replace", "insert"]


def test_catalogue():
    assert len([r for r in catalog.RELATIONS.values() if r.layer == "entity"]) == 12 and catalog.find_relation("uses", "entity").qualified == "entity.uses"
    assert catalog.find_relation("of_edge", "edge", inbound=True).qualified == "evidence.of_edge"
    with pytest.raises(ValueError):
        catalog.register_relation("symbol", "calls", 1, "symbol", "symbol")


def test_type_spellings_of_any_depth(spark):
    from edgeweave.functions.text import field_shape, top_level_namespace, value_type

    deep = "std::vector<" * 40 + "std::map<int, std::pair<Foo, Bar> >" + ">" * 40
    cases = {
        "std::vector<" * 7 + "Foo" + ">" * 7: ("Foo", 4, 3), deep: ("std::pair<Foo, Bar>", 4, 3), "const Foo *": ("Foo", 6, 2), "Foo": ("Foo", 4, 1), "Foo &&": ("Foo", 6, 2), "Foo[3][4]": ("Foo", 4, 4),
        "std::vector<std::shared_ptr<const Foo> >": ("Foo", 5, 3), "std::map<std::string, std::vector<Foo *>>": ("Foo", 6, 3), "map<int, Foo>": ("map<int, Foo>", 4, 1), "std::unique_ptr<Foo[]>": ("Foo", 4, 2),
        "std::set<Foo>[2]": ("Foo", 4, 4), "weak_ptr<Foo>": ("Foo", 6, 2), None: (None, None, None), "": ("", 4, 1),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    kind, many = field_shape(F.col("t"))
    assert {r[0]: tuple(r)[1:] for r in df.select("t", value_type(F.col("t")), kind, many).collect()} == cases
    names = spark.createDataFrame([("a::b<c::d<e::f<" + "g::h<" * 12 + "x" + ">" * 15 + "::z",), ("a::b(c::d)",), ("x",), (None,)], "n string")
    assert [r[0] for r in names.select(top_level_namespace(F.col("n"))).collect()] == ["a::b", "a", "", None]


def test_layers_have_no_bound(spark):
    from edgeweave.views import layers

    wide = [dict(src_id=1, kind=5, position=i, dst_id=100 + i) for i in range(300)]
    deep = [dict(src_id=1000 + i, kind=1, position=0, dst_id=1001 + i) for i in range(66)]
    ids = {1} | {e[k] for e in wide + deep for k in ("src_id", "dst_id")}
    g = make(spark, type_node=[dict(id=i, type_key=str(i)) for i in ids], type_edge=wide + deep + [dict(src_id=1066, kind=1, position=0, dst_id=1000)])
    roots = spark.createDataFrame([(1,), (1000,)], "id bigint")
    got = layers(g, roots).groupBy("root_id").agg(F.count("*"), F.max("depth"), F.max("index"), F.count_if(F.col("status") == "cycle"))
    assert rows(got) == [(1, 301, 1, 300, 0), (1000, 68, 67, 67, 1)]
    cut = layers(g, roots, deepest=1).where("status = 'truncated'")
    assert rows(cut.select("root_id", "depth")) == [(1000, 1)]


def test_dispatch_over_many_levels(spark):
    """An override twenty records above the receiver is found."""
    records = [dict(id=i, usr=f"r{i}", kind=4) for i in range(1, 22)]
    methods = [dict(id=101, usr="m1", kind=21, parent_usr="r1"), dict(id=102, usr="m2", kind=21, parent_usr="r2", is_pure=1), dict(id=103, usr="m3", kind=21)]
    edges = [dict(id=i, src_id=i + 1, dst_id=i, kind=2) for i in range(1, 21)] + [dict(id=50, src_id=101, dst_id=1, kind=9), dict(id=51, src_id=102, dst_id=2, kind=9), dict(id=52, src_id=102, dst_id=101, kind=6)]
    nav = navigate.Navigator(make(spark, symbol=records + methods, edge=edges))
    assert rows(nav.selection(nav.ids(101))) == [(101, i, 101) for i in range(1, 22)]
    got = {r["origin"]: (r["receiver"], r["reasons"]) for r in nav.dispatch_sites(nav.ids(101, 102, 103, 999)).collect()}
    assert got == {101: (1, []), 102: (2, ["pure-no-targets"]), 103: (None, ["not-virtual"]), 999: (None, ["unknown-symbol"])}


def test_type_sets_flow_to_receivers(spark):
    """A is a base of B and C, which override rank. main makes a B and hands it down; other callers decide what is left open."""
    s = [dict(id=i, usr=u, kind=4) for i, u in ((1, "A"), (2, "B"), (3, "C"))] + [dict(id=i, usr=u, kind=21, parent_usr=p) for i, u, p in ((11, "A.rank", "A"), (12, "B.rank", "B"), (13, "C.rank", "C"))]
    s += [dict(id=i, usr=u, kind=8) for i, u in ((20, "main"), (21, "f"), (22, "g"), (23, "other"))]
    pairs = [(2, 1, 2), (3, 1, 2), (11, 1, 9), (12, 2, 9), (13, 3, 9), (12, 11, 6), (13, 11, 6)]
    calls = {50: (20, 21), 51: (21, 22), 52: (22, 11), 53: (23, 22)}
    edges = [dict(id=i, src_id=a, dst_id=b, kind=k) for i, (a, b, k) in enumerate(pairs)] + [dict(id=i, src_id=a, dst_id=b, kind=1) for i, (a, b) in calls.items()]
    at = dict(file_id=1, line=1, col=1)
    args = [dict(edge_id=50, position=0, src_kind="construct", type_usr="B", **at), dict(edge_id=51, position=0, src_kind="local", decl_usr="f.p", **at)]
    here = dict(edge_id=52, recv_src_kind="local", recv_decl_usr="g.q", recv_type_usr="A", recv_param_pos=0, **at)

    def lands(start, extra=(), **site):
        g = make(spark, symbol=s, edge=edges, edge_site=[here | site], call_arg=[*args, *extra])
        return [r[0] for r in rows(navigate.devirtualized_calls(g, spark.createDataFrame([(start,)], "id bigint"), 1, 9)) if r[0] < 20]

    named = dict(edge_id=50, position=0, src_kind="local", decl_usr="f.p", type_usr="B", type_is_value=1, **at)  # says that f.p is a B
    passed = lambda kind, **kw: dict(edge_id=53, position=0, src_kind=kind, **kw, **at)
    assert lands(20) == [11, 12, 13]  # f.p is never bound, so what f hands on is anything
    assert lands(20, [named]) == [11, 12]  # a B comes through both calls
    assert lands(23, [passed("construct", type_usr="C")]) == [11, 13]
    both = [named, passed("construct", type_usr="C")]
    g = make(spark, symbol=s, edge=edges, edge_site=[here], call_arg=[*args, *both])
    every = navigate.devirtualized_calls(g, spark.createDataFrame([(20,), (23,)], "id bigint"), 1, 9)
    assert [r[0] for r in rows(every) if r[0] < 20] == [11, 12, 13]  # B from one, C from the other
    assert lands(23, [passed("unknown")]) == [11, 12, 13]
    assert lands(23, [passed("construct", type_usr="A")]) == [11]
    assert lands(23, [passed("construct", type_usr="nobody")]) == [11, 12, 13]  # nothing picked: all count
    assert lands(23, [], recv_type_usr="C", recv_type_is_value=1) == [11, 13]
    assert lands(23, [], recv_src_kind="construct", recv_decl_usr=None, recv_param_pos=None, recv_type_usr="B") == [11, 12]


def test_call_sites_into(spark):
    """A caller that calls two functions: only the calls into the one asked for come out."""
    edges = [dict(id=1, src_id=10, dst_id=20, kind=1), dict(id=2, src_id=10, dst_id=30, kind=1), dict(id=3, src_id=40, dst_id=30, kind=1), dict(id=4, src_id=20, dst_id=30, kind=6)]
    sites = [dict(edge_id=1, file_id=1, line=9, col=1), dict(edge_id=1, file_id=1, line=5, col=1), dict(edge_id=2, file_id=1, line=6, col=1)]
    args = [dict(edge_id=1, file_id=1, line=5, col=1, position=0, src_kind_id=2, type_usr="T"), dict(edge_id=2, file_id=1, line=6, col=1, position=0)]
    nav = navigate.Navigator(make(spark, edge=edges, edge_site=sites, call_arg=args))
    direct = (20, 10, 1, "direct", 1, 5, 1, 1)
    assert rows(nav.call_sites_into(nav.ids(20))) == [direct]
    far = sorted([tuple(r) for r in nav.call_sites_into(nav.ids(20), dispatch=True).collect()], key=lambda r: r[2])
    assert far == [direct, (20, 10, 2, "dispatch", 1, 6, 1, 1), (20, 40, 3, "dispatch", None, None, None, 0)]
    at = nav.g.t("edge_site").where("line = 5")
    assert [(r["position"], r["src_kind"], r["type_usr"]) for r in nav.call_args_at(at).collect()] == [(0, "local", "T")]
    assert nav.receiver_provenance(at).count() == 1 and nav.receiver_provenance(at.limit(0)).count() == 0


def test_one_route(spark):
    for kind in ("random", "rings", "chain", "empty"):
        pairs, a = digraph(spark, kind)
        out = defaultdict(set)
        for x, y in pairs:
            out[x].add(y)
        for start, end in ((0, 5), (0, 9), (5, 0), (3, 3)):
            best = {start: [start]}
            level = [start]
            while level and end not in best:
                found = {}
                for x in sorted(level, key=lambda n: best[n]):
                    for y in sorted(out[x]):
                        if y not in best and y not in found:
                            found[y] = best[x] + [y]
                best |= found
                level = list(found)
            assert traverse.one_route(a, start, end) == best.get(end, []), (kind, start, end)
    assert traverse.one_route(digraph(spark, "chain")[1], 0, 9, 8) == []


def test_steps_with_salts(spark):
    pairs, a = digraph(spark, "dense")
    steps = traverse.Steps(a.union(a.where("src = 0")), rows_per_salt=3)
    front = spark.createDataFrame([(0, "x"), (4, "y"), (None, "z")], "src bigint, tag string")
    assert rows(steps.ahead(front).select("src", "tag", "dst")) == sorted([(0, "x", j) for j in range(6)] * 2 + [(4, "y", j) for j in range(6)])


def test_numbers_in_ranges(spark):
    from edgeweave.runtime import lookup, numbered

    data = [("a", i % 7, i) for i in range(200)] + [(None, 1, 5), (None, 1, 2), ("b", 9, 9)]
    df = spark.createDataFrame(data, "k string, j int, i bigint").repartition(5)
    want, seen = [], defaultdict(int)
    for k, j, i in sorted(data, key=lambda x: (x[0] or "", x[1], x[2])):
        seen[k, j] += 1
        want.append((k, j, i, seen[k, j]))
    key = lambda r: (r[0] or "", r[1], r[2])
    assert sorted((tuple(r) for r in numbered(df, ["k", "j"], ["i"], "n").collect()), key=key) == want
    names = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    for most in (1, 10):  # joined with salts, and broadcast
        got = lookup(df, names, ["k"], "left", most)
        assert {(r["k"], r["v"]) for r in got.collect()} == {("a", 1), (None, 2), ("b", None)} and got.count() == len(data)


def test_rule_programs_as_text(spark):
    text = """.decl edge(x: number, y: number)
    far(x, y) :- edge(x, y).  /* all
    of it */ far(x, z) :- far(x, y), edge(y, z).
    odd(x) :- edge(x, _), !edge(_, x), x != 3.
    many(x, n) :- n = count : { far(x, _) }.
    top(x, m) :- m = max y : { edge(x, y) }.
    .output many
    .output top(IO=stdout)"""
    program, outputs = rules.parse_program(text)
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "x bigint, y bigint")
    got = program.run({"edge": edge}, [*outputs, "odd"])
    assert outputs == ["many", "top"] and rows(got["many"]) == [(1, 3), (2, 2), (3, 1)] and rows(got["top"]) == [(1, 4), (2, 3), (3, 4)] and rows(got["odd"]) == [(1,)]
    for bad in ("a(x) :- b(x)", "a(x).", "a(x) :- b(x), x ~ 2.", "a(x, n) :- b(x), n = count : { c(x) }."):
        with pytest.raises(rules.RuleError):
            rules.parse_program(bad)


def test_two_steps_are_put_together_before_the_shuffle(spark):
    """60 * 60 ends over 60 nodes: 216000 ways, of which no more rows than bit sets are shuffled; ends may be negative."""
    ends = [i * 37 - 900 for i in range(60)]
    left, right = [(a, m) for a in ends for m in range(60)], [(m, c) for m in range(60) for c in ends]
    df = lambda data, cols: spark.createDataFrame(data, cols)
    got = traverse.compose(df(left, "src bigint, mid bigint"), df(right, "mid bigint, dst bigint"))
    assert "bit_or" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == sorted((a, c) for a in ends for c in ends)
    few = traverse.compose(df([(1, 2), (1, 3)], "src bigint, mid bigint"), df([(2, -7), (3, -7), (3, 5000)], "mid bigint, dst int"))
    assert rows(few) == [(1, -7), (1, 5000)] and few.schema["dst"].dataType.simpleString() == "int"
    assert rows(traverse.compose(df([], "src bigint, mid bigint"), df([], "mid bigint, dst bigint"))) == []


def test_rules_evaluate_what_is_asked(spark):
    """The closure over a chain takes more than one round; who asks for its edges only does not pay for it."""
    facts = {"edge": spark.createDataFrame([(i, 1, i + 1) for i in range(6)], "src bigint, kind int, dst bigint")}
    assert rows(rules.call_graph().run(facts, ["calls"], rounds=1)["calls"]) == [(i, i + 1) for i in range(6)]
    assert list(rules.call_graph().run(facts, [])) == ["calls", "reaches"]
    with pytest.raises(rules.RuleError):
        rules.call_graph().run(facts, ["reaches"], rounds=1)


def test_cycles_and_impact_by_components(spark):
    """The same as the rules that make all pairs."""
    for kind in ("random", "rings", "dense", "chain"):
        pairs, _ = digraph(spark, kind)
        facts = {
            "edge": spark.createDataFrame([(a, 1 if (a + b) % 3 else 7, b) for a, b in pairs], "src bigint, kind int, dst bigint"),
            "symbol": spark.createDataFrame([(i, 8, 1) for i in range(30)], "id bigint, kind int, d int"),
        }
        assert rows(rules.cycle_edges(facts)) == rows(rules.cycles().run(facts, ["cycle_edge"])["cycle_edge"])
        assert rows(rules.impact_radius(facts)) == rows(rules.impact().run(facts, ["radius"])["radius"])


def test_reaching_makes_no_pairs_across_hubs(spark, monkeypatch):
    """150 nodes lead to a hub and it to 150 others: 22500 pairs that are counted; the rest is made, and counts agree."""
    pairs = [(i, 1000) for i in range(150)] + [(1000, 2000 + i) for i in range(150)] + [(3000, 2000), (0, 3001), (3001, 3002), (5, 2001), (4000, 2002), (4001, 2002), (2002, 4002), (2002, 4003)]
    sizes = {n: n % 3 + 1 for p in pairs for n in p}
    made, old = [], traverse.closure
    monkeypatch.setattr(traverse, "closure", lambda *a, **k: (made.append(old(*a, **k)), made[-1])[1])
    edges, weights = spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.createDataFrame(list(sizes.items()), "id bigint, size bigint")
    back = defaultdict(set)
    for _ in range(4):
        for a, b in pairs:
            back[b] |= back[a] | {a}
    want = sorted((n, sum(sizes[a] for a in ends)) for n, ends in back.items() if ends)
    for hubs in (1, 2, 8):
        assert rows(traverse.reaching(edges, weights, hubs)) == want
        assert made[-1].count() < 20


def renumbered(spark, base):
    """One small index, numbered from ``base`` on."""
    n = lambda i: base + (i * 7) % 31
    return make(
        spark,
        semantic_universe=[dict(id=1, key="u")], repository=[dict(id=1, name="r", remote_url="git://r")],
        component=[dict(id=n(1), name="c", path="/a/c", repository_id=1), dict(id=n(2), name="", path="lib", repository_id=None)],
        directory=[dict(id=n(3), component_id=n(1), path="src/"), dict(id=n(4), component_id=n(2), path="")], file=[dict(id=n(5), directory_id=n(3), name="x.h"), dict(id=n(6), directory_id=n(4), name="y.h")],
        symbol=[dict(id=n(7), usr="f", kind=8, spelling="f", file_id=n(5), semantic_universe_id=1), dict(id=n(8), usr="g", kind=8, spelling="g", qual_name="ns::g", file_id=n(6), identity_key="key of g")],
        type_node=[dict(id=n(9), type_key="int", spelling="int"), dict(id=n(10), spelling="S", decl_id=n(8))],
        parameter=[dict(owner_id=n(8), position=0, pack_index=0, name="a", type_id=n(9)), dict(owner_id=n(8), position=1, pack_index=0, type_id=n(30))], symbol_type=[dict(symbol_id=n(8), kind=1, type_id=n(10))],
        edge=[dict(id=n(11), src_id=n(7), dst_id=n(8), kind=1, count=1)], edge_site=[dict(edge_id=n(11), file_id=n(5), line=3, col=4, recv_type_id=n(10))],
    ), n


def test_portable_identities(spark):
    from edgeweave import identity

    (a, n), (b, m) = renumbered(spark, 100), renumbered(spark, 5000)
    e = lambda g, q: sorted(r["identity_key"] for r in Engine(g).run(parse(q)).rows())
    for view, want in {
        "edge": ["edge:u\x1ff:1:key of g"], "site": ["site:u\x1ff:1:key of g:file:14:remote:git://r11:ungrouped:c7:src/x.h:3:4"], "type": ["type:S", "type:int"],
        "parameter": ["parameter:key of g:0:0", "parameter:key of g:1:0"],
    }.items():
        q = f"codebase() | view({view}) | nodes()"
        assert e(a, q) == e(b, q) == want
        assert [r["id"] for r in Engine(a).run(parse(q)).rows()] or view == "edge"
    mine = rows(identity.dump(a))
    assert mine == rows(identity.dump(b)) and sum(n > 0 for _, n, _ in mine) == 6
    other = b.replaced(parameter=b.t("parameter").where("position = 0"))
    assert len(set(mine) - set(rows(identity.dump(other)))) == 1
    # A second component of that name elsewhere makes files of both ambiguous.
    two = a.replaced(component=a.t("component").union(a.t("component").where("name = 'c'").withColumn("id", F.lit(1).cast("long")).withColumn("path", F.lit("/b/c"))))
    assert Engine(two).run(parse("codebase() | view(site) | nodes() | select(line)")).rows() == [{"line": 3}]
    with pytest.raises(PlanError, match="E_IDENTITY"):
        Engine(two).run(parse("codebase() | view(site) | nodes()"))


def test_signatures_and_call_trees(spark):
    a, n = renumbered(spark, 100)
    nav = navigate.Navigator(a)
    assert rows(nav.signature_text(nav.ids(n(8), n(7)))) == [(n(8), "S ns::g(int a, ?)")]
    calls = [(1, 2, 9), (1, 3, 5), (3, 2, 1), (2, 4, 1), (4, 1, 1), (3, 5, 2), (1, 6, 12)]
    g = make(spark, edge=[dict(id=i, src_id=x, dst_id=y, kind=1) for i, (x, y, _) in enumerate(calls)], edge_site=[dict(edge_id=i, file_id=1, line=k, col=0) for i, (_, _, k) in enumerate(calls)])
    nav = navigate.Navigator(g)
    assert nav.call_tree(1) == [(1, 0, None), (3, 1, 1), (2, 2, 3), (4, 3, 2), (5, 2, 3), (6, 1, 1)]
    assert nav.call_tree(1, depth=1, fan_out=2) == [(1, 0, None), (3, 1, 1), (2, 1, 1)]
    with pytest.raises(PlanError, match="E_LIMIT"):
        nav.call_tree(1, most=3)


def test_answers_are_redacted(spark):
    from edgeweave.result import explain, redact

    assert redact({"a": ["PASSWORD=x1,y", "TOKEN:abc d", 5, None, True]}) == {"a": ["PASSWORD=<redacted:secret>,y", "TOKEN:<redacted:secret> d", 5, None, True]}
    long = redact("é" * 100, 50)
    assert long.endswith("...<redacted:size-limit>") and len(long.encode()) <= 50
    for bad in (1.5, 1 << 63, object()):
        with pytest.raises(ValueError):
            redact([bad])
    nested = []
    for _ in range(80):
        nested = [nested]
    with pytest.raises(ValueError):
        redact(nested)
    g = make(spark, meta=[dict(key="revision", value="abc"), dict(key="graph_resolved_at", value="1")])
    plan = parse("codebase() | nodes()")
    assert explain(plan, graph=g, present="abc")["index"]["freshness"] == "current" and explain(plan, graph=g, present="x")["index"]["freshness"] == "stale"
    assert explain(plan, graph=make(spark), present="x")["index"] == {"revision": None, "freshness": "unverifiable", "meta": {}}


def test_include_plans(spark):
    g = make(
        spark,
        symbol=[dict(id=1, file_id=1), dict(id=2, file_id=2), dict(id=3, file_id=3)], edge=[dict(id=1, src_id=1, dst_id=2, kind=7)], file=[dict(id=1, md5="m")],
        include_edge=[dict(id=1, src_file_id=1, dst_file_id=2, config_id=1), dict(id=2, src_file_id=1, dst_file_id=3, config_id=1)],
        include_site=[dict(id=10, edge_id=1, begin_offset=0, end_offset=9, resolved=1, guarded=1), dict(id=11, edge_id=2, begin_offset=10, end_offset=19, resolved=1, guarded=1)],
    )
    plan = includes.removal_plan(g)
    assert rows(plan.select("site_id", "action", "content")) == [(10, "keep", "m"), (11, "remove", "m")]
    now = spark.createDataFrame([(1, "m")], "file_id bigint, content string")
    assert rows(includes.stale(plan, now)) == [] and rows(includes.stale(plan, now.limit(0))) == [(1,)]
    assert derive.readiness({"a": (1,), "b": (2,), "c": (3,)}, {"a": (1,), "b": (9,)}) == {"a": "ready", "b": "stale", "c": "missing"}


def test_programs_on_trees(spark):
    df = lambda data, schema: spark.createDataFrame(data, schema)
    # int f(p, q) { return p; }  int u; int v = f(u, 1); int w = v;
    facts = {
        "child": df([(1, 10, 0), (10, 11, 0), (20, 21, 0), (21, 22, 0), (21, 23, 1), (21, 24, 2), (30, 31, 0)], "p bigint, c bigint, o int"), "reads": df([(11, 101), (23, 103), (31, 104)], "n bigint, v bigint"),
        "initialises": df([(20, 104), (30, 105)], "n bigint, v bigint"), "callee": df([(21, 1)], "c bigint, f bigint"), "parameter": df([(1, 102, 7), (1, 101, 3)], "f bigint, p bigint, o int"), "returns": df([(10, 1)], "n bigint, f bigint"),
    }
    out = rules.dataflow().run(facts, ["parameter_index", "flow", "influences"])
    assert rows(out["parameter_index"]) == [(1, 101, 0), (1, 102, 1)]
    assert rows(out["flow"]) == [(101, 104), (103, 101), (103, 104), (104, 105)]
    assert (101, 105) in rows(out["influences"]) and (103, 105) in rows(out["influences"])
    tree = {"child": df([(1, 2, 0), (2, 3, 0), (3, 4, 0), (1, 5, 1)], "p bigint, c bigint, o int"), "node": df([(1, "function"), (2, "if"), (3, "call"), (4, "for"), (5, "while")], "n bigint, k string")}
    assert rows(rules.control_flow().run(tree, ["nesting"])["nesting"]) == [(2, 0), (4, 1), (5, 0)]
    assert rows(rules.inventory().run(tree)["of_kind"]) == [("call", 1), ("for", 1), ("function", 1), ("if", 1), ("while", 1)]
    shape = {"base": df([(2, 1), (3, 2)], "c bigint, b bigint"), "method": df([(1, 9)], "c bigint, m bigint"), "pure": df([(9,)], "m bigint")}
    out = rules.design().run(shape, ["derives", "leaf", "abstract"])
    assert rows(out["derives"]) == [(2, 1), (3, 1), (3, 2)] and rows(out["leaf"]) == [(3,)] and rows(out["abstract"]) == [(1,)]
    refs = {"refers": df([(5, 1), (6, 1), (6, 2)], "n bigint, s bigint"), "in_file": df([(5, 10), (6, 11)], "n bigint, f bigint"), "defined_in": df([(1, 10), (2, 10)], "s bigint, f bigint")}
    assert rows(rules.dependencies().run(refs, ["file_needs"])["file_needs"]) == [(11, 10, 2)]


def test_devirtualized_calls_stay_ranges(spark):
    """Forks and cycles of overrides, calls that meet in a target: each pair once, and nothing is shuffled per pair."""
    from edgeweave import typesets

    up = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 7), (7, 6), (8, 7), (9, 3)]  # method, what it overrides
    below = {1: {1, 2, 3, 4, 5, 9}, 2: {2, 4, 5}, 3: {3, 4, 5, 9}, 4: {4, 5}, 6: {6, 7, 8}, 7: {6, 7, 8}, 40: {40}}
    calls = [(20, 1), (20, 4), (21, 2), (21, 3), (22, 6), (22, 8), (23, 40), (23, 40), (24, 9), (4, 7), (41, 1)]
    symbols = [dict(id=i, usr=f"m{i}", kind=21, is_pure=int(i == 3)) for i in range(1, 10)] + [dict(id=i, usr=f"f{i}", kind=8) for i in (20, 21, 22, 23, 24, 40)]
    edges = [dict(id=i, src_id=a, dst_id=b, kind=6) for i, (a, b) in enumerate(up)] + [dict(id=100 + i, src_id=a, dst_id=b, kind=1) for i, (a, b) in enumerate(calls)]
    g = make(spark, symbol=symbols, edge=edges)
    got = typesets.devirtualized(g, spark.createDataFrame([(i,) for i in range(20, 25)], "id bigint"))
    want = {(a, b) for a, b in calls if a != 41} | {(a, m) for a, b in calls if a != 41 for m in below.get(b, {b}) if m != 3}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any(line.startswith(("Aggregate", "+- Aggregate")) for line in plan[:2])
