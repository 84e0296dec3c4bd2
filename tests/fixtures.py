"""Small graphs for tests."""

from edgeweave.graph import PropertyGraph
from edgeweave.schemas import SCHEMAS


def make(spark, **tables):
    """A graph of tables given as lists of dicts."""
    out = {}
    for name, rows in tables.items():
        schema = SCHEMAS[name]
        out[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
    return PropertyGraph(spark, out)


def seeded(spark, **more):
    """Eight symbols: three functions, two classes that are entities, an abstract struct, a template and its instance."""
    names = [
        ("A", "funcA", 8, "ns::funcA"), ("B", "funcB", 8, None), ("C", "funcC", 8, None), ("D", "ClassD", 4, None), ("E", "ClassE", 4, None),
        ("S", "AbsS", 2, None), ("T", "Thing", 31, None), ("I", "Thing<int>", 4, None),
    ]
    symbols = [dict(id=i + 1, usr=f"USR::{u}", spelling=s, kind=k, qual_name=q, is_definition=1, resolved=1) for i, (u, s, k, q) in enumerate(names)]
    pairs = [(1, 2, 1), (2, 3, 1), (1, 3, 7), (5, 4, 2), (5, 3, 2), (8, 7, 5)]
    edges = [dict(id=i + 1, src_id=a, dst_id=b, kind=k, count=1) for i, (a, b, k) in enumerate(pairs)]
    tables = dict(
        symbol=symbols, edge=edges, entity_node=[dict(id=4, kind=1), dict(id=5, kind=1), dict(id=6, kind=2)],
        entity_edge=[dict(src_id=4, dst_id=5, kind=8, count=1), dict(src_id=5, dst_id=4, kind=1, count=1)],
    )
    return make(spark, **{**tables, **more})
