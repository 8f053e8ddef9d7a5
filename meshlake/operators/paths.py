"""Path queries: ``MATCH (a {k: 1})-[:label]->(b) WHERE a.x > 2 AND b.name == "n" RETURN a, b``.

A query is parsed on the driver into a chain of joins along edges, which Catalyst plans. Rows are a bag: repeated edges
multiply them, and nodes may repeat within a path. AND and OR have one precedence and group to the left. A
comparison of different types, or with a missing field, is false. A variable that is bound again takes its later
node. Names in RETURN that no node binds are left out. Text after the RETURN list is an error.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.errors import QueryParseError
from meshlake.functions import payload as P

TOKEN = re.compile(
    r"""\s*(?:(?P<float>\d+\.\d+)|(?P<int>\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<sign>->|==|!=|<=|>=|[-(){}\[\]:,.<>]))""", re.ASCII
)
KEYWORDS = {"MATCH", "WHERE", "RETURN", "AND", "OR", "TRUE", "FALSE"}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
EPSILON = 2.220446049250313e-16


@dataclass
class NodePattern:
    name: str | None
    props: list[tuple[str, object]]


@dataclass
class Field:
    var: str
    key: str


@dataclass
class PathQuery:
    nodes: list[NodePattern]
    labels: list[str | None]
    where: list[tuple[str, object, str, object]]
    returns: list[str]


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryParseError(f"unexpected character at {at}: {text[at : at + 10]!r}")
            at, group = m.end(), m.lastgroup
            word = m[group]
            if group == "name" and word.upper() in KEYWORDS:
                self.tokens.append(("key", word.upper()))
            elif group in ("d", "s"):
                self.tokens.append(("str", word))
            else:
                self.tokens.append((group, word))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str | None:
        """The next token's text if it is of that kind and text, else None."""
        k, v = self.peek()
        if k == "end" or (kind and k != kind) or (value is not None and v != value):
            return None
        self.at += 1
        return v

    def need(self, kind: str, value: str | None = None) -> str:
        got = self.take(kind, value)
        if got is None:
            raise QueryParseError(f"expected {value or kind}, got {self.peek()[1] or 'the end'}")
        return got

    def literal(self) -> object:
        k, v = self.peek()
        self.at += 1
        if k == "int":
            return int(v) if int(v) < 1 << 63 else float(v)
        if k == "float":
            return float(v)
        if k == "str":
            return v
        if (k, v) in (("key", "TRUE"), ("key", "FALSE")):
            return v == "TRUE"
        raise QueryParseError(f"expected a literal, got {v or 'the end'}")

    def node(self) -> NodePattern:
        self.need("sign", "(")
        name, props = self.take("name"), []
        if self.take("sign", "{"):
            while not self.take("sign", "}"):
                key = self.need("name")
                self.need("sign", ":")
                props.append((key, self.literal()))
                self.take("sign", ",")
        self.need("sign", ")")
        return NodePattern(name, props)

    def operand(self) -> object:
        name = self.take("name")
        if name is None:
            return self.literal()
        return Field(name, self.need("name")) if self.take("sign", ".") else name

    def parse(self) -> PathQuery:
        self.need("key", "MATCH")
        nodes, labels = [self.node()], []
        while self.take("sign", "-"):
            self.need("sign", "[")
            labels.append(self.need("name") if self.take("sign", ":") else None)
            self.need("sign", "]")
            self.need("sign", "->")
            nodes.append(self.node())
        if labels and any(n.name is None for n in nodes):
            raise QueryParseError("the nodes of a path need names")
        where = []
        if self.take("key", "WHERE"):
            link = "AND"
            while link:
                left, op = self.operand(), self.need("sign")
                if op not in COMPARE:
                    raise QueryParseError(f"unknown comparison {op}")
                where.append((link, left, op, self.operand()))
                link = self.take("key", "AND") or self.take("key", "OR")
        self.need("key", "RETURN")
        returns = [self.need("name")]
        while self.take("sign", ","):
            returns.append(self.need("name"))
        if self.peek()[0] != "end":
            raise QueryParseError(f"unexpected text after RETURN: {self.peek()[1]}")
        return PathQuery(nodes, labels, where, returns)


def _props(props: list[tuple[str, object]], node: Column) -> Column:
    ok = F.lit(True)
    for key, v in props:
        if key == "id":
            if isinstance(v, int) and not isinstance(v, bool):
                ok = ok & (node["id"] == v)
            continue
        t = P.Typed.of(P.field(node["payload"], key))
        c = t.boolean if isinstance(v, bool) else t.integer if isinstance(v, int) else t.number if isinstance(v, float) else t.string
        ok = ok & F.coalesce(c == F.lit(v), F.lit(False))
    return ok


def _compare(left: P.Typed, op: str, right: P.Typed) -> Column:
    f, gap = COMPARE[op], F.abs(left.number - right.number)
    number = gap < EPSILON if op == "==" else gap >= EPSILON if op == "!=" else f(left.number, right.number)
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    out = F.when(both(left.integer, right.integer), f(left.integer, right.integer)).when(both(left.number, right.number), number)
    out = out.when(both(left.string, right.string), f(left.string, right.string))
    if op in ("==", "!="):
        out = out.when(both(left.boolean, right.boolean), f(left.boolean, right.boolean))
    return out.otherwise(False)


def run(query: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A struct column (id, payload, num_edges) for each returned variable. ``nodes``: id, payload (variant); ``edges``: src, dst, label."""
    q = Parser(query).parse()
    names = [n.name or "" for n in q.nodes]
    last = {n: i for i, n in enumerate(names)}  # a name bound again: its later node
    returns = [v for v in dict.fromkeys(q.returns) if v in last and v]

    def matched(i: int) -> DataFrame:
        return nodes.where(_props(q.nodes[i].props, {"id": F.col("id"), "payload": F.col("payload")})).select(F.struct(F.col("id"), F.col("payload")).alias(f"n{i}"), F.col("id").alias(f"id{i}"))

    rows = matched(0)
    for i, label in enumerate(q.labels):
        hop = edges if label is None else edges.where(F.col("label") == label)
        hop = hop.select(F.col("src").alias(f"src{i}"), F.col("dst").alias(f"dst{i}"))
        rows = rows.join(hop, F.col(f"id{i}") == F.col(f"src{i}")).join(matched(i + 1), F.col(f"dst{i}") == F.col(f"id{i + 1}")).drop(f"src{i}", f"dst{i}", f"id{i}")

    def typed(x: object) -> P.Typed:
        if not isinstance(x, Field):
            return P.Typed.lit(x)
        if x.var not in last:
            return P.Typed.lit(None)
        node = F.col(f"n{last[x.var]}")
        if x.key == "id":
            return P.Typed(node["id"], node["id"].cast("double"), *[F.lit(None).cast(t) for t in ("string", "boolean")])
        return P.Typed.of(P.field(node["payload"], x.key))

    ok = None
    for link, left, op, right in q.where:
        c = _compare(typed(left), op, typed(right))
        ok = c if ok is None else ok & c if link == "AND" else ok | c
    rows = rows if ok is None else rows.where(ok)
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    for v in returns:
        d = degree.select(F.col("src").alias(f"s_{v}"), F.col("d").alias(f"d_{v}"))
        rows = rows.join(d, F.col(f"n{last[v]}.id") == F.col(f"s_{v}"), "left")
    return rows.select(*[F.struct(F.col(f"n{last[v]}.id").alias("id"), F.col(f"n{last[v]}.payload").alias("payload"), F.coalesce(F.col(f"d_{v}"), F.lit(0).cast("long")).alias("num_edges")).alias(v) for v in returns])
