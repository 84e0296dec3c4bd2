import datetime as dt
import json
import random
from collections import defaultdict

import pytest

from edgeweave.operators import hierarchy, nested, orphans, snapshots, tree_aggregate
from edgeweave.plans.problems import RESULT_LEVELS, RESULT_MEMBERS
from edgeweave.runtime import hot_keys, salted_join

T0 = dt.datetime(2025, 1, 1)
day = lambda n: T0 + dt.timedelta(days=n)
rows = lambda df: sorted(tuple(r) for r in df.collect())


# --- p1


def flat(spark, data):
    df = spark.createDataFrame([(i, t, b, "clash") for i, t, b in data], "result_id bigint, loaded_at timestamp, body string, identity string")
    return nested.shred(df, "result_id", "body", "loaded_at", RESULT_LEVELS, "result", ("shape", "paths"), RESULT_MEMBERS)


def found(tables, salt=100_000):
    df = nested.occurrences(tables, {2: [("id", "bigint")], 3: [("file_id", "bigint")]}, "result_id", salt)
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select("result_id", "path_pos", "step_pos", "site_pos", "step_id", "site_file_id").collect())


def test_nested_records(spark):
    r = {"shape": "path", "paths": [{"steps": [{"id": 7, "sites": [{"file_id": 1}, {"file_id": None}, {}]}, {"id": "8", "sites": []}, {"sites": None}, None]}, {"steps": []}, {"length": 2}, {"steps": [{"id": 7, "sites": [{"file_id": "1"}]}]}]}
    again = json.dumps({k: r[k] for k in reversed(r)}, indent=3)
    t = flat(
        spark,
        [
            (1, day(1), json.dumps(r)), (1, day(0), again), (1, day(0), '{"paths": ['), (2, day(0), "error"), (2, day(1), None), (3, day(0), '{"schema": "x", "result": {"paths": null}}'),
            (4, day(0), '{"paths": []} x'), (5, day(0), "[1]"), (6, None, '{"paths": "none", "other": {"a": [1, {"b": NaN}]}}'), (7, day(0), '{"shape": "rows", "result": {"paths": [{}]}}'), (None, day(0), '{"paths": []}'),
            (8, day(0), '{"paths": [{"steps": [{"id": 1.0, "sites": [{"file_id": 99999999999999999999}]}]}]}'),
        ],
    )
    assert found(t) == sorted(
        [
            (1, 0, 0, 0, 7, 1), (1, 0, 0, 1, 7, -1), (1, 0, 0, 2, 7, -1), (1, 0, 1, -1, 8, -1), (1, 0, 2, -1, -1, -1), (1, 0, 3, -1, -1, -1), (1, 1, -1, -1, -1, -1), (1, 2, -1, -1, -1, -1),
            (1, 3, 0, 0, 7, 1), (3, -1, -1, -1, -1, -1), (7, -1, -1, -1, -1, -1), (8, 0, 0, 0, 1, -1),
        ]
    )
    # Equal objects are stored once: the site of file 1 occurs under two steps, an empty and a null one are the same.
    assert t.objects.where("level = 3").count() == 3
    assert t.bridges.where("level = 2").count() == 5


def test_nested_merkle_identity_ignores_layout_only():
    seen = {}
    emit = lambda level, identity, width, payload, cells, children: seen.setdefault(identity, payload)
    m = lambda o: nested.merkle(o, RESULT_LEVELS, 0, emit)
    assert m({"a": 1, "paths": [{"steps": []}]}) == m({"paths": [{"steps": []}], "b": None, "a": 1})
    assert m({"count": "5"}) == m({"count": 5}) != m({"count": 6})
    assert m({"paths": []}) != m({"paths": [{}]}) != m({"paths": [{}, {}]})
    assert m({"paths": [{"steps": [{"id": 1}]}]}) != m({"paths": [{"steps": [{"id": 2}]}]})


def test_nested_empty_and_hot(spark):
    assert found(flat(spark, [])) == []
    body = '{"paths": [{"steps": [{"id": 1, "sites": [{"file_id": 2}]}]}]}'
    t = flat(spark, [(i, day(0), body) for i in range(300)] + [(1000, day(0), '{"paths": []}')])
    left, key = t.roots, ["h1", "h2"]
    right = t.objects.where("level = 0").select(*key, "payload")
    spread = salted_join(left, right, key, rows_per_salt=20)
    assert [r[1] for r in hot_keys(left, key, 20).collect()] == [15]
    assert rows(spread.select("record_id")) == rows(left.select("record_id"))
    assert len(found(t)) == 301


def test_nested_salts_change_nothing(spark):
    """A common child, a wide parent and a common record, with salts from 20 rows on."""
    wide = {"paths": [{"steps": [{"id": j % 3, "sites": [{"file_id": k % 2} for k in range(j % 4)]} for j in range(40)]}] * 2}
    t = flat(spark, [(i, day(0), json.dumps(wide)) for i in range(30)] + [(100 + i, day(0), json.dumps({"paths": [{"steps": [{"id": i, "sites": [{}]}]}]})) for i in range(40)])
    assert found(t, 20) == found(t) and len(found(t)) == 30 * 2 * sum(max(j % 4, 1) for j in range(40)) + 40


# --- p2


def brute_hierarchy(links):
    parent, nodes = {}, set()
    for t, c, p in links:
        for x in (c, p):
            if x is not None:
                nodes.add((t, x))
        if c is not None and p is not None:
            parent[t, c] = min(p, parent.get((t, c), p))
    out = []
    for t, n in nodes:
        trail, x = [n], n
        while (t, x) in parent and parent[t, x] not in trail:
            x = parent[t, x]
            trail.append(x)
        if (t, x) not in parent:
            out.append((t, n, x, len(trail) - 1, "/".join(map(str, reversed(trail))), "tree"))
        else:
            ring = trail[trail.index(parent[t, x]) :]
            out.append((t, n, min(ring), -1, "", "in_cycle" if n in ring else "below_cycle"))
    return sorted(out)


@pytest.mark.parametrize("salt", [5, 100_000])
def test_hierarchies(spark, salt):
    rng = random.Random(salt)
    links = [("a", c, rng.randrange(c)) for c in range(1, 60)] + [("a", 100 + i, 100 + (i + 1) % 9) for i in range(9)] + [("a", 200 + i, 100 + i % 3) for i in range(5)]
    links += [("b", 1, 2), ("b", 1, 2), ("b", 5, 5), ("b", 6, 5), ("b", 7, None), ("b", None, 8), (None, 1, 2)] + [("c", i, i + 1) for i in range(6)] + [("d", i, 0) for i in range(1, 40)]
    big = 1 << 60
    links += [("e", big + 1, big), ("e", big + 2, big + 1), ("f", 1, 3), ("f", 1, 2)]
    links += [("g", i + 1, i) for i in range(1, 40)] + [("g", 100 + i, i) for i in range(1, 40, 7)] + [("h", i % 30, (i * 7) % 30) for i in range(30)]
    df = spark.createDataFrame([(*x, "clash") for x in links], "tree string, child bigint, parent bigint, node string")
    h = hierarchy.peel(df, with_descendants=True, rows_per_salt=salt)
    want = brute_hierarchy([x for x in links if x[0] is not None])
    assert rows(h.nodes.select("tree", "node", "root", "depth", "path", "state")) == want
    below = [(t, int(a), n, d - i) for t, n, _, d, path, s in want if s == "tree" for i, a in enumerate(path.split("/")[:-1])]
    assert rows(h.descendants.select("tree", "node", "descendant", "distance")) == sorted(below)
    counts = defaultdict(int)
    for t, a, _, _ in below:
        counts[t, a] += 1
    assert h.rounds < 20  # the chain has 40 levels
    assert {(r["tree"], r["node"]): r["below"] for r in h.nodes.where("state = 'tree'").collect()} == {(t, n): counts[t, n] for t, n, *_, s in want if s == "tree"}


def test_hierarchy_of_nothing(spark):
    h = hierarchy.peel(spark.createDataFrame([], "tree string, child bigint, parent bigint"), True)
    assert rows(h.nodes) == [] and rows(h.descendants) == []


# --- p3


@pytest.mark.parametrize("chunk, fan_in, stride", [(64, 2, 2), (10_000, 8, 8)])
def test_tree_select(spark, chunk, fan_in, stride):
    rng = random.Random(5)
    data = [("hot", rng.randrange(50), i) for i in range(3000)] + [("warm", 1, i) for i in range(200)] + [("one", 4, 4), (None, 2, 1), (None, 1, 9), (None, None, 3)]
    df = spark.createDataFrame(data, "k string, w bigint, d bigint").repartition(5)
    from pyspark.sql import functions as F

    got = tree_aggregate.tree_select(df, ["k"], ["w", "d"], F.floor((F.col("n") + 1) / 2), chunk, fan_in, stride)
    groups = defaultdict(list)
    for k, w, d in data:
        groups[k].append((w is not None, w, d))
    want = {k: (sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))[(len(v) + 1) // 2 - 1][1:], len(v)) for k, v in groups.items()}
    assert {r["k"]: ((r["w"], r["d"]), r["n"]) for r in got.collect()} == want


def test_tree_select_of_nothing_and_bad_chunk(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([], "k string, w bigint")
    assert rows(tree_aggregate.tree_select(df, ["k"], ["w"], F.lit(1))) == []
    with pytest.raises(ValueError):
        tree_aggregate.tree_select(df, ["k"], ["w"], F.lit(1), chunk=8)


def test_tree_stats(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", i) for i in range(1000)] + [(None, 5), ("b", None)], "k string, v bigint").repartition(7)
    got = tree_aggregate.tree_stats(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v"), "m": F.max("v")}, {"n": "sum", "s": "sum", "m": "max"}, chunk=10, fan_in=4)
    assert {r["k"]: (r["n"], r["s"], r["m"]) for r in got.collect()} == {"a": (1000, 499500, 999), None: (1, 5, 5), "b": (1, None, None)}


# --- p4


def test_snapshot_changes(spark):
    data = [
        (1, "a", "x"), (1, "a", "x"), (1, "b", "1"), (1, "c", None), (1, None, "n"), (3, "a", "x"), (3, "b", "2"), (3, "d", None), (3, None, "m"), (4, "a", "x"), (4, "a", "y"), (4, "b", "2"), (4, "d", None),
        (None, "z", "z"),
    ]
    df = spark.createDataFrame(data, "s int, k string, v string")
    got = {(r["s"], r["k"], r["change"]) for r in snapshots.snapshot_changes(df, "s", ["k"], "v").collect()}
    assert got == {(3, "b", "changed"), (3, "c", "removed"), (3, "d", "added"), (3, None, "changed"), (4, "a", "added"), (4, None, "removed")}
    one = df.where("s = 1")
    assert rows(snapshots.snapshot_changes(one, "s", ["k"], "v")) == []
    assert rows(snapshots.snapshot_changes(df.limit(0), "s", ["k"], "v")) == []


def test_plain_paths(spark):
    from pyspark.sql import functions as F

    cases = {
        "/a/b.h": "/a/b.h", "/a//b": "/a/b", "\\a\\b\\c.h": "/a/b/c.h", "/a/./b": "/a/b", "/a/x/../b": "/a/b", "/a/x/./..//b": "/a/b", "/../a": "/a", "/a/b/..": "/a", "/a/b/": "/a/b", "/": "/",
        "/a/..": "/", "/a/...b/c": "/a/...b/c", "a/../b": "b", "/a/b.": "/a/b.", None: None, "": "", "/x/../../../y": "/y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", snapshots.plain_path(F.col("p"))).collect()} == cases


# --- p5


def brute_orphans(refs, parents):
    ids = defaultdict(list)
    for parent, i, deleted, loaded in parents:
        ids[parent, i].append((deleted, loaded))
    first = {}
    for r in refs:
        if r[4] is not None:
            first[r[:6]] = min(x for x in (first.get(r[:6]), r[6]) if x is not None)
    out = []
    for (parent, t, c, k, target, period), seen in first.items():
        have = ids.get((parent, target))
        cause = "missing" if not have else "deleted" if all(d for d, _ in have) else "late" if min(x for _, x in have) > seen else None
        if cause:
            out.append((t, c, k, target, period, cause))
    return sorted(out)


def test_orphans(spark):
    rng = random.Random(3)
    parents = [(p, i, rng.random() < 0.3, day(rng.randrange(30))) for p in ("x", "y") for i in (*range(40), 65535, 65536, 65537, 1 << 40) if rng.random() < 0.8 for _ in range(rng.choice((1, 1, 2)))]
    parents.append(("x", -5, False, day(0)))
    refs = [(p, "t" + p, "c", f"k{n}", rng.choice([None, -5, -6, 65535, 65536, 1 << 40, *range(45)]), "2025-01", day(rng.randrange(30))) for p in ("x", "y") for n in range(200)]
    refs += [("x", "tx", "c", f"hot{n}", 99, "2025-02", day(0)) for n in range(300)] + refs[:20]
    r = spark.createDataFrame(refs, "parent string, table string, column string, key string, target bigint, period string, loaded timestamp")
    p = spark.createDataFrame([(*x, "clash") for x in parents] + [("x", None, False, day(0), "")], "parent string, id bigint, deleted boolean, loaded timestamp, target string")
    assert rows(orphans.orphan_references(r, p)) == brute_orphans(refs, parents)
    assert rows(orphans.orphan_references(r, p.limit(0))) == brute_orphans(refs, [])
    assert rows(orphans.orphan_references(r.limit(0), p)) == []


def test_runs_compress(spark):
    df = spark.createDataFrame([("x", i, True, day(0)) for i in (*range(10, 20), 25, 26, 65535, 65536)], "parent string, id bigint, living boolean, loaded timestamp")
    runs = orphans.key_runs(df).where("living")
    assert rows(runs.select("first", "last")) == [(10, 19), (25, 26), (65535, 65535), (65536, 65536)]
