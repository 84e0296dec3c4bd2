import pytest
from fixtures import make, seeded

from edgeweave import ir
from edgeweave.query_text import parse
from edgeweave.engine import UNBOUNDED, Budgets, Engine
from edgeweave.ir import PlanError
from edgeweave.result import envelope, explain, serve, to_dict, witnesses

ids = lambda result: sorted(r["id"] for r in result.rows())


@pytest.fixture(scope="module")
def g(spark):
    return seeded(spark)


@pytest.fixture(scope="module")
def run(g):
    return lambda plan, **kw: Engine(g, **kw).run(parse(plan) if isinstance(plan, str) else plan)


def test_flagship(run):
    r = run('symbol("USR::A") | out(calls, 1..2) | where(kind = function) | select(name) | order_by(name)')
    assert [x["name"] for x in r.rows()] == ["funcB", "funcC"] and r.partial and not r.truncated


def test_source_tiers(run):
    assert ids(run('symbol("Thing")')) == [7]
    assert ids(run('symbol("ns::funcA")')) == [1]
    assert ids(run('entity("ClassD")')) == [4]
    assert ids(run('entity("funcA")')) == []
    assert ids(run('symbol("nothing")')) == []


def test_enumerate_and_predicates(run):
    assert ids(run("codebase() | nodes(kind in [class, struct])")) == [4, 5, 6, 8]
    assert ids(run('codebase() | nodes(name ~ "func?")')) == [2, 3]
    assert ids(run('codebase() | nodes(name ~ "*func[A-B]")')) == [1, 2]
    assert ids(run("codebase() | nodes(not kind = function and not kind = class)")) == [6, 7]
    assert ids(run("codebase() | view(entity) | nodes(entity_type = class)")) == [4, 5]


def test_null_is_unknown_on_symbols(run):
    assert ids(run('codebase() | nodes(qual_name != "x")')) == [1]
    assert len(ids(run('codebase() | nodes(qual_name != "x", unknown=include)'))) == 8
    with pytest.raises(PlanError, match="E_UNKNOWN"):
        run('codebase() | nodes(qual_name != "x", unknown=error)')


def test_quantifiers_know_what_they_do_not_know(run):
    # calls is partial: no witness proves nothing; inherits is complete.
    assert ids(run("codebase() | nodes(exists(calls))")) == [1, 2]
    assert ids(run("codebase() | nodes(none(calls))")) == []
    assert ids(run("codebase() | nodes(none(inherits))")) == [1, 2, 3, 4, 6, 7, 8]
    assert ids(run("codebase() | nodes(exists(inherits, kind = class))")) == [5]
    assert ids(run("codebase() | nodes(all(inherits, kind = class) and exists(inherits))")) == []
    assert ids(run("codebase() | nodes(exactly(2, inherits))")) == [5]
    assert ids(run("codebase() | nodes(exactly(0, inherits))")) == [1, 2, 3, 4, 6, 7, 8]
    assert ids(run("codebase() | nodes(at_least(1, in inherits))")) == [3, 4]
    assert ids(run("codebase() | nodes(exists(calls, kind = function, 2..2))")) == [1]
    assert ids(run("codebase() | nodes(not exists(inherits))")) == [1, 2, 3, 4, 6, 7, 8]
    assert len(ids(run("codebase() | nodes(none(calls), unknown=include)"))) == 6
    assert ids(run("codebase() | nodes(exists(calls, exists(calls, kind = function)))")) == [1]


def test_windows_have_no_visited_set(spark):
    g = make(spark, symbol=[dict(id=i, usr=str(i), spelling=str(i), kind=8) for i in (1, 2, 3)], edge=[dict(id=1, src_id=1, dst_id=2, kind=1), dict(id=2, src_id=2, dst_id=1, kind=1), dict(id=3, src_id=3, dst_id=3, kind=1)])
    e = Engine(g)
    assert ids(e.run(parse('symbol("1") | out(calls, 2)'))) == [1]
    assert ids(e.run(parse('symbol("1") | out(calls, 1..3)'))) == [1, 2]
    assert ids(e.run(parse('symbol("3") | out(calls, 30..32)'))) == [3]
    assert ids(e.run(parse('symbol("1") | in(calls, 5)'))) == [2]


def test_set_operations(run):
    a = 'codebase() | nodes(kind = class) | {}(codebase() | nodes(name ~ "Class*"))'
    assert ids(run(a.format("union"))) == [4, 5, 8]
    assert ids(run(a.format("intersect"))) == [4, 5]
    assert ids(run(a.format("except"))) == [8]


def test_shaping(run):
    assert run("codebase() | nodes() | count()").rows() == [{"count": 8}]
    assert [r["qual_name"] for r in run("codebase() | nodes() | select(qual_name, spelling) | order_by(qual_name, spelling) | limit(2)").rows()] == ["ns::funcA", None]
    assert [r["kind"] for r in run("codebase() | nodes() | select(kind) | distinct()").rows()] == [8, 4, 2, 31]
    assert [r["id"] for r in run("codebase() | nodes() | order_by(spelling) | limit(3)").rows()] == [6, 4, 5]
    assert run("symbol(\"nothing\") | select(name)").rows() == []


def test_views(run):
    assert ids(run('symbol("ClassD") | view(entity) | out(uses)')) == [5]
    assert ids(run('symbol("funcA") | view(entity)')) == []
    assert ids(run('symbol("ClassE") | out("entity.generalizes")')) == [4]
    assert ids(run("codebase() | view(entity) | nodes()")) == [4, 5, 6]


def test_typed_views(spark):
    g = seeded(
        spark,
        parameter=[dict(owner_id=1, position=0, pack_index=0, name="a", type_id=1, file_id=1, line=3, col=4), dict(owner_id=1, position=1, pack_index=0, name="b", type_id=2)],
        type_node=[dict(id=1, type_key="int", spelling="int", kind=1), dict(id=2, type_key="int *", spelling="int *", kind=5, is_const=1), dict(id=3, type_key="D", spelling="D", kind=2, decl_id=4)],
        type_edge=[dict(src_id=2, kind=1, position=0, dst_id=1)],
        symbol_type=[dict(symbol_id=1, kind=1, type_id=3)],
        edge_site=[dict(edge_id=1, file_id=1, line=3, col=4), dict(edge_id=1, file_id=1, line=None, col=None)],
        call_arg=[dict(edge_id=1, file_id=1, line=3, col=4, position=0, type_id=1, decl_id=3)],
    )
    e = Engine(g)
    rows = lambda q: e.run(parse(q)).rows()
    assert [r["name"] for r in rows('symbol("funcA") | out(has_parameter) | select(name)')] == ["a", "b"]
    assert [r["spelling"] for r in rows('symbol("funcA") | out(has_parameter) | out(of_type) | select(spelling)')] == ["int", "int *"]
    assert [(r["slot_kind"], r["position"]) for r in rows('symbol("funcA") | out(has_signature_slot) | select(slot_kind, position)')] == [("return", 0), ("parameter", 0), ("parameter", 1)]
    assert ids(e.run(parse('symbol("funcA") | out(of_type) | out(references_symbol)'))) == [1, 4]
    assert [r["line"] for r in rows('symbol("funcA") | out(has_call_edge) | sites() | select(line)')] == [None, 3]
    assert len(rows('symbol("funcA") | out(has_call_edge) | sites()')) == 2
    assert len(rows('symbol("funcA") | out(has_parameter) | out(has_evidence)')) == 1
    assert [r["position"] for r in rows('symbol("funcA") | out(has_call_edge) | out(has_argument) | select(position)')] == [0]
    assert [(r["depth"], r["spelling"]) for r in rows('codebase() | view(type) | nodes(spelling = "int *") | out(has_layer) | select(depth, spelling)')] == [(0, "int *"), (1, "int")]
    assert [r["cv_qualifiers"] for r in rows("codebase() | view(type) | nodes(is_const = 1) | select(cv_qualifiers)")] == [1]
    assert len(rows('codebase() | view(type) | nodes(spelling = "int") | in(has_type_edge)')) == 1
    # On typed views a null differs from everything, and is never unknown.
    assert len(rows('codebase() | view(parameter) | nodes(default_text != "x")')) == 2
    r = e.run(parse('codebase() | view(type) | nodes(spelling = "int") | reverse_type_use(4)'))
    assert sorted((x["target"], x["length"]) for x in r.rows()) == [(1, 1), (1, 2)] and r.partial


def test_paths(spark):
    pairs = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (6, 6)]
    g = make(spark, symbol=[dict(id=i, usr=f"u{i}", spelling=f"n{i}", kind=8) for i in range(1, 7)], edge=[dict(id=i, src_id=a, dst_id=b, kind=1) for i, (a, b) in enumerate(pairs)], edge_site=[dict(edge_id=0, file_id=1, line=2, col=3)])
    e = Engine(g)
    trails = lambda q: [r["trail"] for r in e.run(parse(q)).rows()]
    assert trails('symbol("n1") | path(to=symbol("n4"), calls, 1..4)') == [[1, 2, 4], [1, 3, 4]]
    assert trails('symbol("n1") | path(to=symbol("n4"), calls, 1..4) | rank(1)') == [[1, 2, 4]]
    assert trails('symbol("n1") | path(to=symbol("n1"), calls, 1..8)') == [[1, 2, 4, 5, 1], [1, 3, 4, 5, 1]]
    assert trails('symbol("n6") | path(to=symbol("n6"), calls, 1..8)') == [[6, 6]]
    assert trails('symbol("n1") | path(to=symbol("n4"), calls, 3..8)') == []  # longer walks would repeat a node
    assert trails('symbol("n1") | path(to=symbol("n6"), calls, 1..8)') == []
    assert e.run(parse('symbol("n1") | path(to=symbol("n4"), calls, 1..4) | count()')).rows() == [{"count": 2}]
    w = witnesses(e, parse('symbol("n1") | path(to=symbol("n4"), calls, 1..4)'))
    assert w[0]["steps"][1]["sites"] == [{"file_id": 1, "line": 2, "col": 3, "conditional": None}] and w[1]["steps"][1]["sites"] == []


def test_budgets_cut_in_order(spark):
    star = [dict(id=i, src_id=1, dst_id=i + 2, kind=1) for i in range(12)]
    g = make(spark, symbol=[dict(id=i, usr=str(i), spelling=str(i), kind=8) for i in range(1, 14)], edge=star)
    for budget, truncated in ((11, True), (12, False), (13, False)):
        r = Engine(g, Budgets(traverse=budget)).run(parse('symbol("1") | out(calls)'))
        assert (len(r.rows()), r.truncated) == (min(budget, 12), truncated)
        assert ids(r) == list(range(2, 2 + min(budget, 12)))
    r = Engine(g, Budgets(enumerate=5)).run(parse("codebase() | nodes()"))
    assert ids(r) == [1, 2, 3, 4, 5] and r.truncated
    r = Engine(g, Budgets(rows=3)).run(parse("codebase() | nodes() | select(id)"))
    assert [x["id"] for x in r.rows()] == [1, 2, 3] and r.truncated
    assert ids(Engine(g, UNBOUNDED, after_id=10).run(parse("codebase() | nodes()"))) == [11, 12, 13]


def test_empty_graph(spark):
    e = Engine(make(spark))
    assert e.run(parse("codebase() | nodes() | count()")).rows() == [{"count": 0}]
    assert e.run(parse('symbol("x") | out(calls, 1..4)')).rows() == []
    assert e.run(parse('symbol("x") | path(to=symbol("y"), calls, 1..3)')).rows() == []


def test_documents(run, g):
    plan = parse('symbol("USR::A") | out(calls) | where(exists(inherits))')
    assert explain(plan)["relations"] == {"symbol.calls": "partial", "symbol.inherits": "complete"}
    r = run("codebase() | nodes() | limit(2)")
    assert to_dict(r)["count"] == 2 and envelope(r).status == "complete"
    assert '"ok": true' in serve(Engine(g), '{"id": 1, "query": "codebase() | nodes() | count()"}')
    assert "E_PARSE" in serve(Engine(g), '{"id": 1, "query": "codebase( | nodes()"}')
    assert '"ok": false' in serve(Engine(g), "no json")


@pytest.mark.parametrize(
    "text, code",
    [
        ("codebase() | out(calls)", "E_STAGE"), ("codebase() | nodes() | out(nothing)", "E_RELATION"), ("codebase() | nodes() | out(calls, 0..2)", "E_DEPTH"),
        ("codebase() | nodes() | out(calls, 1..33)", "E_DEPTH"), ("codebase() | nodes(nothing = 1)", "E_FIELD"), ("codebase() | nodes(kind = thing)", "E_KIND"),
        ("codebase() | nodes() | limit(0)", "E_LIMIT"), ("codebase() | nodes() | count() | limit(1)", "E_STAGE"), ("codebase() | view(nothing)", "E_VIEW"),
        ("codebase() | nodes() | select(name) | order_by(kind)", "E_FIELD"), ('symbol("") | count()', "E_SOURCE"), ("codebase() | nodes() | sites()", "E_VIEW"),
        ("codebase() | nodes() | union(codebase() | view(entity) | nodes())", "E_SETOP"), ("codebase() | nodes(kind ~ \"a*\")", "E_FIELD"), ("codebase() | nodes() | rank()", "E_STAGE"),
        ("codebase() | nodes(is_pure = \"yes\")", "E_FIELD"), ("codebase() | nodes() | out(has_parameter, 1..2)", "E_DEPTH"), ("codebase() | nodes() x", "E_PARSE"),
    ],
)
def test_errors(text, code):
    with pytest.raises(PlanError) as e:
        ir.validate(parse(text))
    assert e.value.code == code


def test_normal_form():
    p = ir.validate(parse("codebase() | nodes((kind = class and (kind = struct and name = a)) or not not kind = enum)"))
    assert ir.pred_dict(p.stages[0].pred)["preds"][0]["preds"][2] == {"op": "eq", "field": "name", "value": "a"}
    assert ir.pred_dict(p.stages[0].pred)["preds"][1] == {"op": "eq", "field": "kind", "value": "enum"}
    p = ir.start(ir.symbol("a")) | ir.out("calls", 1, 2) | ir.where(ir.calls(ir.is_static())) | ir.select(["name"])
    assert ir.plan_dict(ir.validate(p)) == {
        "cxq": 1,
        "source": {"kind": "symbol", "ref": "a"},
        "stages": [
            {"op": "out", "relation": "symbol.calls", "min_depth": 1, "max_depth": 2},
            {"op": "where", "pred": {"op": "exists", "relation": "symbol.calls", "min_depth": 1, "max_depth": 1, "pred": {"op": "eq", "field": "is_static", "value": 1}}},
            {"op": "select", "fields": ["name"]},
        ],
    }
    # not binds tighter than and, and tighter than or
    p = parse('codebase() | nodes(not name = "a" and name = "b" or name = "c")').stages[0].pred
    assert p.op == "any_of" and p.kids[0].op == "all_of" and p.kids[0].kids[0].op == "not"
