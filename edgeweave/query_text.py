"""Query text to plans: ``symbol("A") | out(calls, 1..3) | where(kind = function and not name ~ "x*") | select(name)``.

``not`` binds tighter than ``and``, ``and`` tighter than ``or``; parentheses group. Names may be bare or quoted.
"""

from __future__ import annotations

import re

from . import ir
from .ir import PlanError, require

_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?\d+)|(?P<name>[A-Za-z_][\w.\-]*)|(?P<mark>\.\.|!=|[|(),=~\[\]]))""")
_SIMPLE = {"distinct": ir.distinct, "count": ir.count, "sites": ir.sites}
_SETS = {"union": ir.union, "intersect": ir.intersect, "except": ir.except_}
_QUANTIFIED = {"exists": ir.exists, "none": ir.none, "all": ir.every}


class _Reader:
    def __init__(self, text: str):
        self.items: list[tuple[str, object]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            require(m, "E_PARSE", f"cannot read '{text[at : at + 12]}'")
            kind = m.lastgroup
            value: object = m.group(kind)
            if kind == "text":
                value = re.sub(r"\\(.)", r"\1", value[1:-1])
            elif kind == "number":
                value = int(value)
            self.items.append((kind, value))
            at = m.end()
        self.at = 0

    def peek(self, value: object = None) -> bool:
        return self.at < len(self.items) and (value is None or self.items[self.at][0] in ("mark", "name") and self.items[self.at][1] == value)

    def take(self, kind: str | None = None, value: object = None) -> object:
        require(self.at < len(self.items), "E_PARSE", "the text ends too early")
        got = self.items[self.at]
        require((kind is None or got[0] == kind) and (value is None or got[1] == value), "E_PARSE", f"'{value or kind}' expected, '{got[1]}' found")
        self.at += 1
        return got[1]

    def word(self) -> str:
        require(self.at < len(self.items) and self.items[self.at][0] in ("name", "text"), "E_PARSE", "a name expected")
        return self.take()

    def listed(self, item, close: str = ")") -> list:
        out = []
        while not self.peek(close):
            out.append(item())
            if not self.peek(close):
                self.take("mark", ",")
        self.take("mark", close)
        return out

    # plan := source { '|' stage }
    def plan(self) -> ir.Plan:
        head = self.take("name")
        require(head in ("codebase", "symbol", "entity"), "E_PARSE", f"no source '{head}'")
        self.take("mark", "(")
        source = ir.Source(head, "" if head == "codebase" else self.word())
        self.take("mark", ")")
        plan = ir.start(source)
        while self.peek("|"):
            self.take()
            plan = plan | self.stage()
        return plan

    def window(self) -> tuple[int, int]:
        """``, 1..3`` or ``, 1, 3`` or ``, 2``, or nothing, which is one step."""
        if not self.peek(","):
            return 1, 1
        self.take()
        low = self.take("number")
        if self.peek("..") or self.peek(","):
            self.take()
            return low, self.take("number")
        return low, low

    def stage(self) -> ir.Stage:
        op = self.take("name")
        self.take("mark", "(")
        if op in _SIMPLE:
            self.take("mark", ")")
            return _SIMPLE[op]()
        if op in _SETS:
            done = _SETS[op](self.plan())
        elif op in ("nodes", "where"):
            if op == "nodes" and self.peek(")"):
                self.take()
                return ir.nodes()
            pred, policy = self.any(), "exclude"
            if self.peek(","):
                self.take()
                self.take("name", "unknown")
                self.take("mark", "=")
                policy = self.word()
            done = ir.nodes(pred, policy) if op == "nodes" else ir.where(pred, policy)
        elif op == "view":
            done = ir.view(self.word())
        elif op in ("out", "in"):
            relation = self.word()
            low, high = self.window()
            mode = "static"
            if self.peek(","):
                self.take()
                self.take("name", "mode")
                self.take("mark", "=")
                mode = self.word()
            done = ir.out(relation, low, high, mode) if op == "out" else ir.in_(relation, low, high)
        elif op in ("select", "order_by"):
            names = self.listed(self.word)
            return ir.select(names) if op == "select" else ir.order_by(names)
        elif op in ("limit", "rank", "reverse_type_use"):
            n = 0 if self.peek(")") else self.take("number")
            done = ir.limit(n) if op == "limit" else ir.rank(n) if op == "rank" else ir.reverse_type_use(n or 8)
        elif op == "path":
            self.take("name", "to")
            self.take("mark", "=")
            to = self.plan()
            self.take("mark", ",")
            relation = self.word()
            low, high = self.window() if self.peek(",") else (1, 8)
            done = ir.path(to, relation, low, high)
        else:
            raise PlanError("E_PARSE", f"no stage '{op}'")
        self.take("mark", ")")
        return done

    # any := both { or both }; both := one { and one }; one := not one | ( any ) | quantifier | comparison
    def any(self) -> ir.Pred:
        parts = [self.both()]
        while self.peek("or"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ir.any_of(parts)

    def both(self) -> ir.Pred:
        parts = [self.one()]
        while self.peek("and"):
            self.take()
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else ir.all_of(parts)

    def one(self) -> ir.Pred:
        if self.peek("not"):
            self.take()
            return ir.not_(self.one())
        if self.peek("("):
            self.take()
            inner = self.any()
            self.take("mark", ")")
            return inner
        name = self.word()
        if self.peek("(") and name in (*_QUANTIFIED, "at_least", "exactly"):
            return self.quantifier(name)
        return self.comparison(name)

    def quantifier(self, op: str) -> ir.Pred:
        self.take("mark", "(")
        n = None
        if op in ("at_least", "exactly"):
            n = self.take("number")
            self.take("mark", ",")
        inbound = self.peek("in")
        if inbound:
            self.take()
        relation, target, low, high = self.word(), None, 1, 1
        while self.peek(","):
            self.take()
            if self.at < len(self.items) and self.items[self.at][0] == "number":
                low = self.take("number")
                self.take("mark", "..")
                high = self.take("number")
            else:
                target = self.any()
        self.take("mark", ")")
        if n is None:
            return _QUANTIFIED[op](relation, target, low, high, inbound)
        return (ir.at_least if op == "at_least" else ir.exactly)(n, relation, target, low, high, inbound)

    def value(self) -> object:
        kind, v = self.items[self.at] if self.at < len(self.items) else ("", None)
        require(kind in ("text", "number", "name"), "E_PARSE", "a value expected")
        self.at += 1
        return {"true": 1, "false": 0}.get(v, v) if kind == "name" else v

    def comparison(self, name: str) -> ir.Pred:
        if self.peek("in"):
            self.take()
            self.take("mark", "[")
            return ir.in_list(name, self.listed(self.value, "]"))
        mark = self.take("mark")
        require(mark in ("=", "!=", "~"), "E_PARSE", f"no comparison '{mark}'")
        return {"=": ir.eq, "!=": ir.ne, "~": ir.glob}[mark](name, self.value())


def parse(text: str) -> ir.Plan:
    """The plan of a query text; ``PlanError`` E_PARSE where it cannot be read. It is not validated yet."""
    reader = _Reader(text)
    plan = reader.plan()
    require(reader.at == len(reader.items), "E_PARSE", f"'{reader.items[reader.at][1] if reader.at < len(reader.items) else ''}' after the end")
    return plan
