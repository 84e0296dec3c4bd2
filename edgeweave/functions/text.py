"""Text helpers: glob patterns, names, paths, identities. Column in, column out, on the JVM wherever it can say it."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def glob_regex(pattern: str) -> str:
    """The Java regular expression of a case-sensitive glob over the whole text: ``*``, ``?``, ``[set]``, ``[^set]``.

    A set may start with ``]``; a bracket that is never closed matches nothing.
    """
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = i < len(pattern) and pattern[i] == "^"
            begin = i + negated
            end = pattern.find("]", begin + 1)
            if end < 0:
                return "(?!)"
            members = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[begin:end])
            out.append(f"[{'^' if negated else ''}{members}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
    return "".join(out) + "$"


def glob(column: Column, pattern: str) -> Column:
    return column.rlike(glob_regex(pattern))


def like_escape(text: str) -> str:
    return re.sub(r"([%_\\])", r"\\\1", text)


def fuzzy(column: Column, text: str) -> Column:
    """Whether the letters of ``text`` occur in the column in this order, whatever is between them and in any case."""
    return F.lower(column).like("%" + "%".join(like_escape(c) for c in text.lower()) + "%")


def segments_match(column: Column, text: str) -> Column:
    """Each ``::`` part of ``text`` occurs, in order, in the column; case is ignored."""
    return F.lower(column).like("%" + "%".join(like_escape(p) for p in text.lower().split("::") if p) + "%")


def top_level_namespace(column: Column) -> Column:
    """The part of a qualified name before its last ``::`` outside of ``()`` and ``<>``; empty without one.

    Nested brackets are removed from the inside out, as many times as there are opening ones.
    """
    opening = F.length(column) - F.length(F.regexp_replace(column, r"[(<]", ""))
    flat = F.aggregate(F.array_repeat(F.lit(0), opening), column, lambda t, _: F.regexp_replace(t, r"\([^()<>]*\)|<[^()<>]*>", ""))
    return F.regexp_extract(flat, r"^(.*)::[^:]*$", 1)


def basename(column: Column) -> Column:
    return F.element_at(F.split(column, "/"), -1)


def join_path(directory: Column, name: Column) -> Column:
    """``directory/name``; an empty or null directory leaves the name, a trailing slash is not doubled."""
    clean = F.regexp_replace(F.coalesce(directory, F.lit("")), "/+$", "")
    return F.when(clean == "", name).otherwise(F.concat(clean, F.lit("/"), name))


def interpolate(template: str, bindings: dict[str, Column], unknown: Column | None = None) -> Column:
    """``$name`` and ``${name}`` (a name may have a ``.field``) filled from ``bindings``; ``$$`` is a dollar.

    A null value reads ``<null>``; where ``unknown`` is true every value reads ``<unknown>``. A name without a binding is
    an error.
    """
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\$(?:\$|\{([\w.]+)\}|(\w+))", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        name = m.group(1) or m.group(2)
        if name is None:
            parts.append(F.lit("$"))
            continue
        if name not in bindings:
            raise KeyError(f"no binding '{name}'")
        value = F.coalesce(bindings[name].cast("string"), F.lit("<null>"))
        parts.append(value if unknown is None else F.when(unknown, F.lit("<unknown>")).otherwise(value))
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def _fnv(data: list[bytes]) -> np.ndarray:
    """FNV-1a, 64 bit, of many texts at once: one step per byte position, over all texts that are long enough."""
    length = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-length, kind="stable")
    joined, begin = np.frombuffer(b"".join(data), np.uint8), np.cumsum(length) - length
    out = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    longest = np.sort(length)
    for at in range(int(length.max(initial=0))):
        on = order[: len(data) - int(np.searchsorted(longest, at, "right"))]
        out[on] = (out[on] ^ joined[begin[on] + at]) * np.uint64(0x100000001B3)
    return out


@F.pandas_udf(T.LongType())
def fnv63(texts: pd.Series) -> pd.Series:
    """FNV-1a, 64 bit, without its sign bit; null stays null. There is no built-in of it, so Arrow batches go to Python."""
    hashed = _fnv([(t or "").encode() for t in texts]) & np.uint64(0x7FFFFFFFFFFFFFFF)
    return pd.Series(hashed.astype(np.int64), dtype="Int64").where(texts.notna().to_numpy())


# Wrappers of a type spelling; maps count only with std::. Fixed values of the data model.
_CONTAINER = re.compile(r"((std::)?(vector|list|deque|set|unordered_set)|std::map|std::unordered_map)<")
_OWNED, _SHARED, _WEAK = re.compile(r"(std::)?(unique_ptr|optional)<"), re.compile(r"(std::)?shared_ptr<"), re.compile(r"(std::)?weak_ptr<")
_MODIFIERS = re.compile(r"(\s*(\*|&|\[[^\]]*\]))+$")


def _unqualified(spelling: str) -> str:
    return re.sub("const |volatile ", "", spelling).strip()


def _last_argument(spelling: str) -> str:
    """The last argument, at the top level, of ``wrapper<...>``: what follows the last comma that no bracket encloses."""
    inner = spelling[spelling.index("<") + 1 :].strip().removesuffix(">").strip()
    depth = 0
    for i in range(len(inner) - 1, -1, -1):
        depth += (inner[i] == ">") - (inner[i] == "<")
        if inner[i] == "," and not depth:
            return inner[i + 1 :].strip()
    return inner


def _shape(spelling: str) -> tuple[int, int]:
    outer = held = _unqualified(spelling)
    while _CONTAINER.match(held) and not held.endswith("]"):
        held = _unqualified(_last_argument(held))
    if held.endswith("]") or _OWNED.match(held):
        kind = 4
    elif _SHARED.match(held):
        kind = 5
    else:
        kind = 6 if _WEAK.match(held) or held.endswith(("*", "&")) else 4
    if outer.endswith("]"):
        return kind, 4
    if _CONTAINER.match(outer):
        return kind, 3
    return kind, 2 if any(w.match(outer) for w in (_OWNED, _SHARED, _WEAK)) or outer.endswith(("*", "&")) else 1


def _value(spelling: str) -> str:
    while True:
        spelling = _unqualified(_MODIFIERS.sub("", _unqualified(spelling)))
        if not any(w.match(spelling) for w in (_CONTAINER, _OWNED, _SHARED, _WEAK)):
            return spelling
        spelling = _last_argument(spelling)


def _each(texts: pd.Series, of) -> list:
    """``of`` every distinct text, once; null stays null."""
    known = {t: of(t) for t in texts.dropna().unique()}
    return [known.get(t) for t in texts]


# Wrappers nest to any depth, which no expression of the JVM can follow, so Arrow batches of spellings go to Python.
@F.pandas_udf(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("many", T.IntegerType())]))
def _shapes(spellings: pd.Series) -> pd.DataFrame:
    pairs = [s or (None, None) for s in _each(spellings, _shape)]
    return pd.DataFrame({"kind": pd.array([a for a, _ in pairs], "Int32"), "many": pd.array([b for _, b in pairs], "Int32")})


@F.pandas_udf(T.StringType())
def _values(spellings: pd.Series) -> pd.Series:
    return pd.Series(_each(spellings, _value), dtype=object)


def field_shape(spelling: Column) -> tuple[Column, Column]:
    """(entity relation kind, multiplicity) that a field's type spelling stands for.

    composes 4, aggregates 5, associates 6; multiplicity 1 one, 2 optional, 3 many, 4 fixed array. A container takes the
    kind of its last argument.
    """
    shape = _shapes(spelling)
    return shape["kind"], shape["many"]


def value_type(spelling: Column) -> Column:
    """The record name in a type spelling: qualifiers, pointers, references and array bounds off, wrappers opened to their last argument."""
    return _values(spelling)
