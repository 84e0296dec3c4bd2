"""Deeply nested records to related flat tables through Merkle subtree identities.

Every object of a record gets the hash of its canonical form: its own members (sorted keys, nulls left out, declared
integers as numbers) followed by the hashes of the objects in its declared child array. Objects are hashed bottom-up, so
equal subtrees have equal identities, are stored once, and a parent refers to its children by identity and ordinal.

``shred`` gives three tables:

* ``roots``   (record id, root identity): one row per record, of its earliest complete delivery
* ``objects`` (level, identity, payload): every distinct object once, payload in canonical JSON
* ``shapes``  (level, identity, width, cells, children): the same objects without their texts, which is what joins carry
* ``bridges`` (level of the parent, parent identity, ordinal, child identity): one row per occurrence below a distinct parent

An identity is 128 bits in two columns, h1 and h2. ``occurrences`` puts the tables together again and gives every occurrence
with its positions.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ROWS_PER_SALT, hot_keys, materialize, salted_join

_INTEGER = re.compile(r"\s*[+-]?\d{1,19}\s*\Z", re.ASCII)
_LONG = 1 << 63


@dataclass(frozen=True)
class Level:
    """One level of nesting: the member that holds its child array, and the members that are integers."""

    name: str
    child: str | None
    integers: tuple[str, ...] = ()


@dataclass(frozen=True)
class NestedTables:
    roots: DataFrame
    objects: DataFrame
    shapes: DataFrame
    bridges: DataFrame
    levels: tuple[Level, ...]
    members: dict[int, tuple[str, ...]]


def as_long(value: object) -> int | None:
    """The 64-bit integer that a JSON value stands for; an integer may be written as a string."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        value = int(value) if _INTEGER.match(value) else None
    elif isinstance(value, float):
        value = int(value) if value.is_integer() else None
    return value if isinstance(value, int) and -_LONG <= value < _LONG else None


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def parse_complete(body: str | None) -> dict | None:
    """The object that ``body`` is, or None where it is null, damaged, cut off, followed by more text, or no object."""
    if body is None:
        return None
    try:
        value = json.loads(body, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def unwrap(value: dict, envelope: str | None, marks: tuple[str, ...]) -> dict:
    """The record itself, where an envelope holds it; an object with a record's own members is no envelope."""
    inner = value.get(envelope) if envelope else None
    return inner if isinstance(inner, dict) and not any(m in value for m in marks) else value


def _encoder() -> Callable[[object], str]:
    """Text of a JSON value with sorted keys and no blanks. The encoder in C is made once, where there is one, not per value."""
    plain = json.JSONEncoder(sort_keys=True, separators=(",", ":"))
    if (make := json.encoder.c_make_encoder) is None:
        return plain.encode
    chunks = make(None, plain.default, json.encoder.encode_basestring_ascii, None, ":", ",", True, False, True)
    return lambda value: "".join(chunks(value, 0))


_canonical = _encoder()


def _cell(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else _canonical(value)


def merkle(value: object, levels: tuple[Level, ...], at: int, emit, members: dict[int, tuple[str, ...]] = {}) -> tuple[bytes, int]:
    """(identity, width) of ``value`` as an object of level ``at``, hashed bottom-up; width is its rows when written out flat.

    ``emit(level, identity, width, payload, cells, children)`` gets every object; cells are the texts of its ``members``.
    """
    level = levels[at]
    own, children, width = value, [], 0
    cells: list[str | None] = []
    if isinstance(value, dict):
        below = value.get(level.child) if level.child else None
        listed = isinstance(below, list)
        own = {k: v for k, v in value.items() if v is not None and not (listed and k == level.child)}
        for k in level.integers:
            if k in own and own[k].__class__ is not int and (n := as_long(own[k])) is not None:
                own[k] = n
        if listed:
            for x in below:
                identity, wide = merkle(x, levels, at + 1, emit, members)
                children.append(identity)
                width += wide
        cells = [_cell(own.get(k)) for k in members.get(at, ())]
    payload = _canonical(own)
    h = hashlib.blake2b(f"{at}:{len(children)}:{payload}".encode(), digest_size=16)
    if children:
        h.update(b"".join(children))
    identity, width = h.digest(), max(width, 1)
    emit(at, identity, width, payload, cells, children)
    return identity, width


def _halves(identities: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Both halves of identities, as numbers."""
    both = np.frombuffer(b"".join(identities), "<i8")
    return pa.array(both[0::2]), pa.array(both[1::2])


def _lists(counts: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


_ARROW = pa.schema(
    [
        ("tag", pa.int32()),  # 0: a record, whose id is h1 and whose root is in c1, c2; 1: an object
        ("h1", pa.int64()), ("h2", pa.int64()), ("loaded_us", pa.int64()), ("level", pa.int32()), ("width", pa.int64()), ("payload", pa.string()),
        ("cells", pa.list_(pa.string())), ("c1", pa.list_(pa.int64())), ("c2", pa.list_(pa.int64())),
    ]
)
_SHREDDED = "tag int, h1 bigint, h2 bigint, loaded_us bigint, level int, width bigint, payload string, cells array<string>, c1 array<bigint>, c2 array<bigint>"


def _shredder(levels: tuple[Level, ...], envelope: str | None, marks: tuple[str, ...], members: dict[int, tuple[str, ...]], flush_rows: int = 20_000, remember: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        ids, depths, widths, payloads, cells, cell_counts, kids, kid_counts = ([] for _ in range(8))
        records: list[tuple] = []

        def emit(level: int, identity: bytes, width: int, payload: str, own: list, children: list[bytes]) -> None:
            if identity not in seen:
                seen.add(identity)
                ids.append(identity)
                depths.append(level)
                widths.append(width)
                payloads.append(payload)
                cells.extend(own)
                cell_counts.append(len(own))
                kids.extend(children)
                kid_counts.append(len(children))

        def flush() -> Iterator[pa.RecordBatch]:
            none = lambda n, kind: pa.nulls(n, kind)
            if n := len(ids):
                h1, h2 = _halves(ids)
                c1, c2 = (_lists(kid_counts, half) for half in _halves(kids))
                own = _lists(cell_counts, pa.array(cells, pa.string()))
                one = pa.array(np.ones(n, np.int32))
                yield pa.RecordBatch.from_arrays([one, h1, h2, none(n, pa.int64()), pa.array(depths, pa.int32()), pa.array(widths, pa.int64()), pa.array(payloads, pa.string()), own, c1, c2], schema=_ARROW)
            if n := len(records):
                rid, loaded, roots, wide = zip(*records)
                c1, c2 = (_lists([1] * n, half) for half in _halves(roots))
                zero = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [zero.cast(pa.int32()), pa.array(rid, pa.int64()), zero, pa.array(loaded, pa.int64()), none(n, pa.int32()), pa.array(wide, pa.int64()), none(n, pa.string()), none(n, pa.list_(pa.string())), c1, c2], schema=_ARROW
                )
            for column in (ids, depths, widths, payloads, cells, cell_counts, kids, kid_counts, records):
                column.clear()
            if len(seen) > remember:  # what is forgotten is emitted again and removed by the distinct
                seen.clear()

        for batch in batches:
            for rid, loaded, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                value = parse_complete(body)
                if rid is None or value is None:
                    continue
                root, width = merkle(unwrap(value, envelope, marks), levels, 0, emit, members)
                records.append((rid, loaded, root, width))
                if len(ids) >= flush_rows or len(records) >= flush_rows:
                    yield from flush()
        yield from flush()

    return run


def shred(
    df: DataFrame,
    id_col: str,
    body_col: str,
    loaded_col: str,
    levels: tuple[Level, ...],
    envelope: str | None = None,
    marks: tuple[str, ...] = (),
    members: dict[int, tuple[str, ...]] | None = None,
) -> NestedTables:
    """Flat tables of the JSON records in ``body_col``.

    A record that is delivered again counts once: the earliest complete delivery stands (equal load times: the smallest
    identity; a null load time comes last). Null ids, null bodies and bodies that are not one complete JSON object count
    for nothing. A child member that is absent, null or no array has no children; elements that are no objects keep their
    ordinal and have no members. ``members`` names those that ``occurrences`` can give out, by level. Each body is parsed
    once, in Arrow batches; objects are made distinct per worker before they are shuffled by identity. An empty table gives empty tables.
    """
    source = df.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.unix_micros(F.col(loaded_col).cast("timestamp")).alias("loaded_us"),
        F.col(body_col).alias("body"),
    )
    members = members or {}
    stored = materialize(source.mapInArrow(_shredder(levels, envelope, marks, members), _SHREDDED))
    first = F.struct(F.coalesce("loaded_us", F.lit(_LONG - 1)).alias("l"), F.col("c1")[0].alias("a"), F.col("c2")[0].alias("b"))
    roots = stored.where("tag = 0").groupBy("h1", "h2").agg(F.min(first).alias("m")).select(F.col("h1").alias("record_id"), F.col("m.a").alias("h1"), F.col("m.b").alias("h2"))
    objects = stored.where("tag = 1").select("level", "h1", "h2", "payload").distinct()
    shapes = materialize(stored.where("tag = 1").select("level", "h1", "h2", "width", "cells", "c1", "c2").distinct())
    bridges = shapes.select("level", F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.posexplode(F.arrays_zip("c1", "c2")).alias("ordinal", "child"))
    bridges = bridges.select("level", "p1", "p2", "ordinal", F.col("child.c1").alias("h1"), F.col("child.c2").alias("h2"))
    return NestedTables(roots, objects, shapes, bridges, levels, members)


def occurrences(tables: NestedTables, columns: dict[int, list[tuple[str, str]]], id_col: str = "record_id", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Every occurrence of every object, outer-joined downwards: a parent without children gives one row.

    ``columns`` says which of the ``members`` to give out per level, as (name, SQL type); they come out as
    ``<level name>_<member>``, null where they are not of that type, and positions as ``<level name>_pos``, null where the
    object does not exist. The subtrees are put together bottom-up per distinct object; only the last join, with the
    records, multiplies by occurrences. Each join is salted: common children by how often they occur, large parents by
    their width, common records by their number.
    """
    key = ["h1", "h2"]
    common = hot_keys(tables.bridges, key, rows_per_salt)
    large = tables.shapes.where(F.col("width") > rows_per_salt)
    large = large.groupBy(F.xxhash64(*key).alias("__hash")).agg(F.max(F.ceil(F.col("width") / rows_per_salt)).cast("int").alias("__salts")) if large.take(1) else None
    below: DataFrame | None = None
    for at in range(len(tables.levels) - 1, -1, -1):
        level = tables.levels[at]
        at_level = tables.shapes.where(F.col("level") == at)
        cell = lambda n: F.get("cells", F.lit(tables.members[at].index(n)))  # noqa: E731, B023
        named = [cell(n).try_cast(t).alias(f"{level.name}_{n}") for n, t in columns.get(at, [])]
        own = at_level.select(*key, *named)
        if below is not None:
            has = F.size("c1") > 0
            grown = salted_join(below, at_level.where(has).select(*key, *named), key, rows_per_salt=rows_per_salt, hot=large)
            own = grown.unionByName(at_level.where(~has).select(*key, *named), allowMissingColumns=True)
        if at == 0:
            return salted_join(materialize(tables.roots), own, key, rows_per_salt=rows_per_salt).drop(*key).withColumnRenamed("record_id", id_col)
        links = tables.bridges.where(F.col("level") == at - 1).select("p1", "p2", F.col("ordinal").alias(f"{level.name}_pos"), *key)
        below = salted_join(links, own, key, rows_per_salt=rows_per_salt, hot=common).drop(*key).withColumnsRenamed({"p1": "h1", "p2": "h2"})
    raise ValueError("a nesting needs at least one level")
