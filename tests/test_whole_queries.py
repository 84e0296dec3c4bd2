"""Registered queries do the whole job: small tables on disk, results by brute force."""

from collections import Counter, defaultdict

from edgeweave.plans import graph_queries
from edgeweave.schemas import SCHEMAS

QUERIES = graph_queries.QUERIES
rows = lambda df: sorted(tuple(r) for r in df.collect())


def tables(spark, path, **given):
    """A data directory of the tables given as lists of dicts; loaded_at is the same for all."""
    for name, data in given.items():
        fields = [(f.name, f.dataType.simpleString()) for f in SCHEMAS[name].fields]
        fields += [(c, t) for c, t in (("deleted_at", "timestamp"), ("loaded_at", "bigint")) if name == "symbol" and c not in dict(fields)]
        spark.createDataFrame([tuple(r.get(c, 1 if c == "loaded_at" else None) for c, _ in fields) for r in data], ", ".join(f"{c} {t}" for c, t in fields)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def code(spark, path, edges, n, **more):
    """Symbols 1 to n, each in a file of its own, and entity edges (src, dst, kind[, via])."""
    symbols = [dict(id=i, usr=f"u{i}", spelling=f"s{i}", kind=more.get("kinds", {}).get(i, 4), is_definition=1, file_id=100 + i, parent_id=more.get("parents", {}).get(i)) for i in range(1, n + 1)]
    return tables(spark, path, symbol=symbols, entity_edge=[dict(src_id=e[0], dst_id=e[1], kind=e[2], via_member_id=e[3] if len(e) > 3 else None, count=1) for e in edges])


def reached(pairs):
    """From each node all that it reaches in one step or more."""
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seen = {}
    for n in {x for p in pairs for x in p}:
        seen[n], todo = set(), [n]
        while todo:
            new = out[todo.pop()] - seen[n]
            seen[n] |= new
            todo += new
    return seen


def test_rule_impact_follows_uses(spark, tmp_path):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 3)]
    d = code(spark, tmp_path, [(a, b, 8) for a, b in pairs], 6)
    radius = Counter(b for ends in reached(pairs).values() for b in ends)
    assert rows(QUERIES["rule_impact"](spark, d)) == [(i, radius[i]) for i in range(1, 7)]


def test_rules_get_every_edge(spark, tmp_path):
    """Implementations are inheritance, calls are those of the code index, and files depend over all kinds."""
    edges = [(1, 2, 1), (2, 3, 2), (4, 5, 8, 6), (6, 4, 9), (7, 8, 4), (8, 9, 12)]
    d = code(spark, tmp_path, edges, 9, kinds={5: 21, 6: 21}, parents={6: 5})
    assert rows(QUERIES["rule_hierarchy"](spark, d)) == [(1, 2), (1, 3), (2, 3)]
    assert rows(QUERIES["rule_reach"](spark, d)) == [(4, 6)]
    assert rows(QUERIES["rule_unused"](spark, d)) == [(5,)]
    pairs = {(a, b) for a, b, *_ in edges} | {(4, 6), (5, 6), (6, 5)}
    assert rows(QUERIES["rule_file_dependency"](spark, d)) == sorted((100 + a, 100 + b, 1) for a, b in pairs)


def test_paths_have_no_depth_bound(spark, tmp_path):
    chain = [(i, i + 1, 1) for i in range(1, 10)] + [(1, 11, 1), (11, 3, 1)]
    ring = [(20 + i, 20 + (i + 1) % 10, 1) for i in range(10)]
    d = code(spark, tmp_path, chain + ring, 1)
    ways = [list(range(i, 11)) for i in range(1, 10)] + [[1, 11, *range(3, 11)], [11, *range(3, 11)]]
    assert rows(QUERIES["path_shortest"](spark, d)) == sorted((w[0], 10, len(w) - 1, "/".join(map(str, w))) for w in ways)
    assert len(rows(QUERIES["path_rank_topn"](spark, d))) == len(ways)
    assert rows(QUERIES["path_cycles"](spark, d)) == [(20 + i, 10, "/".join(str(20 + (i + j) % 10) for j in range(11))) for i in range(10)]


def test_include_routes_have_no_depth_bound(spark, tmp_path):
    d = code(spark, tmp_path, [(i, i + 1, 11) for i in range(1, 8)], 8)
    assert rows(QUERIES["include_shortest_path"](spark, d)) == [(101 + i, i, "/".join(str(101 + j) for j in range(i + 1))) for i in range(8)]


def test_diff_match_takes_every_neighbouring_pair(spark, tmp_path):
    held = {1: [(1, "a"), (2, "b")], 3: [(1, "a"), (2, "c")], 5: [(7, "a"), (2, "c"), (4, "d")]}
    data = [(n, i, u) for n, rows_ in held.items() for i, u in rows_]
    spark.createDataFrame(data, "snapshot_no int, symbol_id bigint, usr string").write.parquet(f"{tmp_path}/cidx_pending_symbol_identity.parquet")
    got = QUERIES["diff_match"](spark, str(tmp_path)).select("snapshot_no", "old_id", "new_id", "tier")
    want = {(3, 1, 1, "usr"), (3, 2, 2, "name"), (5, 1, 7, "usr"), (5, 2, 2, "usr"), (5, None, 4, None)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_types_and_handovers_start_everywhere(spark, tmp_path):
    data = {
        "part": ([(i, f"t{i}", i) for i in range(1, 41)], "p_partkey bigint, p_type string, p_size int"), "orders": ([(500, 3)], "o_orderkey bigint, o_custkey bigint"),
        "supplier": ([(i, i) for i in range(1, 5)], "s_suppkey bigint, s_nationkey int"),
        "lineitem": ([(500, 40, 1, 1), (500, 5, 2, 2), (500, 5, 3, 3)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int"),
    }
    for name, (values, schema) in data.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    owned = [(3, "symbol")] + [(t, d) for t in (40, 5, 5) for d in ("parameter", "template_argument")]
    want = []
    for t, domain in owned:
        chain = [t]
        while chain:
            want.append((len(chain), "/".join(map(str, [*reversed(chain), 500])), domain))
            chain = [*chain, chain[-1] // 2] if chain[-1] > 1 else []
    got = QUERIES["reverse_type_use"](spark, str(tmp_path)).select("length", "trail", "domain")
    assert rows(got) == sorted(want)
    assert rows(QUERIES["type_closure_users"](spark, str(tmp_path))) == [(500,)]
    assert rows(QUERIES["handover_window"](spark, str(tmp_path))) == [(3,)]


def test_reverse_type_use_meets_owners_once(spark):
    """However deep types nest, owners are joined once; owners given twice make one witness."""
    from fixtures import make

    from edgeweave import views

    g = make(
        spark, type_edge=[dict(src_id=i + 1, kind=1, position=k, dst_id=i) for i in range(1, 6) for k in (0, 1)], symbol_type=[dict(symbol_id=10, kind=k, type_id=6) for k in (1, 1, 2)],
        parameter=[dict(owner_id=11, position=p, pack_index=k, type_id=5) for p, k in ((0, 0), (0, 1), (1, 0))],
    )
    out, more = views.reverse_type_use(g, spark.createDataFrame([(1,)], "id bigint"), 32)
    assert not more and out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = sorted((r["start"], r["target"], r["length"], tuple(r["trail"]), r["domain"], r["through"]) for r in out.collect())
    up = (1, 2, 3, 4, 5)
    want = [(1, 10, 6, (*up, 6, 10), "symbol", w) for w in ("of_type", "returns")] + [(1, 11, 5, (*up, 11), "parameter", f"parameter[{p}]") for p in (0, 1)]
    assert got == want
