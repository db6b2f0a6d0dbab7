"""Read-only pattern queries over node tables and an edge table, as DataFrame plans.

    MATCH (a:L {p: $x})-[r:KIND|OTHER*m..n]->(b), (b)<--(c:M) [WHERE condition]
    RETURN [DISTINCT] item [AS name], ... [ORDER BY expression [DESC], ...] [SKIP n] [LIMIT n]

Conditions have OR, AND, NOT, comparisons, IN, STARTS WITH, ENDS WITH, CONTAINS, IS [NOT] NULL, arithmetic and
parentheses, with the precedence they have in that language; items may have count, sum, avg, min, max and collect.
Patterns are walks: an edge may occur twice in a match.  Nodes may lack a label and variables may occur again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ordering import running

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+\.\d+|\d+)|(?P<name>[^\W\d]\w*)|(?P<param>\$\w+)|(?P<sign><>|<=|>=|\.\.|[-+*/%=<>()\[\]{}:,.|]))""")
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}
_FUNCTIONS = {"coalesce": F.coalesce, "tolower": F.lower, "toupper": F.upper, "size": F.length, "abs": F.abs}
_BINARY = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "OR": lambda a, b: a | b, "AND": lambda a, b: a & b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "STARTS WITH": lambda a, b: a.startswith(b), "ENDS WITH": lambda a, b: a.endswith(b), "CONTAINS": lambda a, b: a.contains(b)}


class _Reader:
    """Expressions as tuples: (kind, ...)."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read from: {text[at : at + 30].strip()}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.unnamed = 0, 0

    def word(self, k: int = 0) -> str:
        kind, value = self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")
        return value.upper() if kind == "name" else value if kind == "sign" else ""

    def take(self, *words: str) -> bool:
        """Goes on if these words or signs come next."""
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ValueError(f"{' '.join(words)} expected, not {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'}")

    def get(self, kind: str) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise ValueError(f"a {kind} expected, not {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'}")

    def listed(self, one: Callable, end: str | None = None) -> list:
        if end and self.take(end):
            return []
        out = [one()]
        while self.take(","):
            out.append(one())
        if end:
            self.need(end)
        return out

    def condition(self) -> tuple:
        left = self.all_of()
        while self.take("OR"):
            left = ("two", "OR", left, self.all_of())
        return left

    def all_of(self) -> tuple:
        left = self.negation()
        while self.take("AND"):
            left = ("two", "AND", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            if self.take("IS", "NOT", "NULL"):
                left = ("not", ("null", left))
            elif self.take("IS", "NULL"):
                left = ("null", left)
            elif self.take("IN"):
                if self.tokens[self.at : self.at + 1] and self.tokens[self.at][0] == "param":
                    left = ("in", left, self.primary())
                else:
                    self.need("[")
                    left = ("in", left, ("list", self.listed(self.sum, "]")))
            else:
                for op in (("STARTS", "WITH"), ("ENDS", "WITH"), ("CONTAINS",), ("=",), ("<>",), ("<=",), (">=",), ("<",), (">",)):
                    if self.take(*op):
                        left = ("two", " ".join(op), left, self.sum())
                        break
                else:
                    return left

    def _chain(self, one: Callable, *signs: str) -> tuple:
        left = one()
        while self.word() in signs:
            op = self.word()
            self.at += 1
            left = ("two", op, left, one())
        return left

    def sum(self) -> tuple:
        return self._chain(self.product, "+", "-")

    def product(self) -> tuple:
        return self._chain(self.primary, "*", "/", "%")

    def primary(self) -> tuple:
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        if self.take("-"):
            return ("two", "-", ("value", 0), self.primary())
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")
        self.at += 1
        if kind == "text":
            return ("value", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "number":
            return ("value", float(value) if "." in value else int(value))
        if kind == "param":
            return ("param", value[1:])
        if kind == "name":
            if value.upper() in ("TRUE", "FALSE", "NULL"):
                return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[value.upper()])
            if self.take("("):
                if self.take("*"):
                    self.need(")")
                    return ("call", value.lower(), False, [("value", 1)])
                return ("call", value.lower(), self.take("DISTINCT"), self.listed(self.condition, ")"))
            if self.take("."):
                return ("of", value, self.get("name"))
            return ("name", value)
        raise ValueError(f"not an expression: {value}")

    def node(self) -> tuple[str, str | None, dict]:
        self.need("(")
        self.unnamed += 1
        name = self.get("name") if self.tokens[self.at][0] == "name" else f"_{self.unnamed}"
        label = self.get("name") if self.take(":") else None
        props = {}
        if self.take("{"):
            for k, v in self.listed(lambda: (self.get("name"), (self.need(":"), self.sum())[1]), "}"):
                props[k] = v
        self.need(")")
        return name, label, props

    def hop(self) -> dict:
        back = self.take("<")
        self.need("-")
        name, kinds, reach = None, [], None
        if self.take("["):
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
                name = self.get("name")
            if self.take(":"):
                kinds.append(self.get("name"))
                while self.take("|"):
                    self.take(":")
                    kinds.append(self.get("name"))
            if self.take("*"):
                low = int(self.get("number"))
                self.need("..")
                reach = low, int(self.get("number"))
                if low > reach[1]:
                    raise ValueError(f"{low}..{reach[1]} is no range")
            self.need("]")
        self.need("-")
        return {"name": name, "kinds": kinds, "reach": reach, "back": back, "ahead": self.take(">")}

    def path(self) -> list:
        out = [self.node()]
        while self.word() in ("-", "<"):
            out += [self.hop(), self.node()]
        return out

    def item(self) -> tuple[tuple, str | None]:
        return self.condition(), self.get("name") if self.take("AS") else None

    def ordered(self) -> tuple[tuple, bool]:
        x = self.condition()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return x, down

    def whole(self) -> dict:
        self.need("MATCH")
        q = {"paths": self.listed(self.path), "where": self.condition() if self.take("WHERE") else None}
        self.need("RETURN")
        q["distinct"], q["items"] = self.take("DISTINCT"), self.listed(self.item)
        q["order"] = self.listed(self.ordered) if self.take("ORDER", "BY") else []
        q["skip"] = int(self.get("number")) if self.take("SKIP") else 0
        q["limit"] = int(self.get("number")) if self.take("LIMIT") else None
        if self.at < len(self.tokens):
            raise ValueError(f"only MATCH ... RETURN is supported, not {self.tokens[self.at][1]}")
        return q


def _parts(x: tuple, kind: str) -> list[tuple]:
    """All expressions of a kind within x."""
    own = [x] if x[0] == kind else []
    return own + [y for part in x[1:] for z in (part if isinstance(part, list) else [part]) if isinstance(z, tuple) for y in _parts(z, kind)]


def _conjuncts(x: tuple | None) -> list[tuple]:
    return [] if x is None else _conjuncts(x[2]) + _conjuncts(x[3]) if x[:2] == ("two", "AND") else [x]


def _name(x: tuple) -> str:
    """How an item without AS is called."""
    if x[0] == "of":
        return x[2]
    if x[0] == "call":
        return f"{x[1]}({', '.join('*' if y == ('value', 1) else '.'.join(map(str, y[1:])) for y in x[3])})"
    return str(x[1])


def walks(edges: DataFrame, starts: DataFrame, low: int, high: int, distinct: bool, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(l1, s, l2, t, n): for the starts (l, v) the ends of walks of low to high of the edges (l1, s, l2, t), and their number n.

    Level by level, one row for each start and end, never one for each path.  If only distinct ends are wanted (then n
    is 1), from level low on an end that a start has met is not gone on from: what follows it has been or will be met
    from there with fewer steps.  So a circle ends, and the work is in proportion to the ends reached.
    """
    step = edges.groupBy(F.col("l1").alias("l2"), F.col("s").alias("t"), F.col("l2").alias("l3"), F.col("t").alias("u")).agg(F.count(F.lit(1)).alias("m"))
    step = written(step)
    front = written(starts.distinct().select(F.col("l").alias("l1"), F.col("v").alias("s"), F.col("l").alias("l2"), F.col("v").alias("t"), F.lit(1).cast("long").alias("n")))
    met = front if low == 0 else None
    for depth in range(1, high + 1):
        new = front.join(step, ["l2", "t"]).groupBy("l1", "s", F.col("l3").alias("l2"), F.col("u").alias("t"))
        new = new.agg((F.lit(1).cast("long") if distinct else F.sum(F.col("n") * F.col("m"))).alias("n"))
        if distinct and met is not None:
            new = new.join(met.select("l1", "s", "l2", "t"), ["l1", "s", "l2", "t"], "left_anti").select("l1", "s", "l2", "t", "n")
        front = written(new)
        if depth >= low:
            met = front if met is None else met.unionByName(front)
        if front.isEmpty():
            break
    if met is None:
        return front
    return met if distinct else met.groupBy("l1", "s", "l2", "t").agg(F.sum("n").alias("n"))


def _apart(q: dict, items: list, rest: list) -> tuple | None:
    """(shared node, (expression, path) of the smaller side, that of the larger, strictly) if count(*) is asked of two paths that share but one node, under one comparison between them."""
    if len(items) != 1 or items[0][0] != ("call", "count", False, [("value", 1)]) or q["order"] or q["skip"] or q["limit"] is not None:
        return None
    if len(q["paths"]) != 2 or len(rest) != 1 or rest[0][0] != "two" or rest[0][1] not in ("<", "<=", ">", ">="):
        return None
    ends = [{n[0] for n in path[::2]} for path in q["paths"]]
    if len(ends[0] & ends[1]) != 1 or any(h["name"] for path in q["paths"] for h in path[1::2]):
        return None
    shared, (_, op, *both) = next(iter(ends[0] & ends[1])), rest[0]
    where = [[i for i in (0, 1) if x[0] == "of" and x[1] in ends[i] - {shared}] for x in both]
    if sorted(where) != [[0], [1]]:
        return None
    sides = [(x, q["paths"][w[0]]) for x, w in zip(both, where, strict=True)]
    return shared, *(sides if op[0] == "<" else sides[::-1]), len(op) == 1


def pairs_in_order(low: DataFrame, high: DataFrame, group: list[str], strict: bool, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(n): how many pairs of a row of low and one of high are in one group with the former's x below the latter's (or equal, if not strict).

    Pairs are not made: each value of x meets the number of rows of low before it, by running sums over ranges, so
    a group of any size is split.
    """
    value = lambda df, left: df.dropna(subset=[*group, "x"]).select(*group, "x", F.lit(int(left)).alias("a"), F.lit(int(not left)).alias("b"))
    both = value(low, True).unionByName(value(high, False)).groupBy(*group, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranged = written(running(both, [F.col(c) for c in (*group, "x")], {"before": F.col("a")}, written))
    first = ranged.groupBy(*group).agg(F.min("before").alias("_first"))
    under = F.col("before") - F.col("_first") + (F.lit(0) if strict else F.col("a"))
    return ranged.where("b > 0").join(first, group).agg(F.coalesce(F.sum(F.col("b") * under), F.lit(0)).alias("n"))


def cypher(text: str, nodes: dict[str, DataFrame], edges: DataFrame, written: Callable[[DataFrame], DataFrame], **params) -> DataFrame:
    """The rows of a pattern query; node tables have a column id, edges (kind, src_label, src, dst_label, dst, uid).

    Hops become joins.  Conditions on one node go to its table, and only columns that are asked for are read.  Of a
    variable length hop both ends are reduced first to what the pattern leaves of them, and it is walked from the end
    that has fewer; where repeated rows make no difference, nodes met before are not gone on from.
    A property that no table of a node has is an error, as are parts of a pattern that share no node.
    """
    q = _Reader(text).whole()
    items = [(x, name or _name(x)) for x, name in q["items"]]
    names = [n for _, n in items]
    items = [(x, ".".join(x[1:]) if x[0] == "of" and names.count(n) > 1 else n) for x, n in items]
    asked = [x for x, _ in items] + [x for x, _ in q["order"]] + [q["where"] or ("value", None)]
    wanted: dict[str, set[str]] = {}
    for x in asked:
        for _, v, p in _parts(x, "of"):
            wanted.setdefault(v, set()).add(p)
    inline = [("two", "=", ("of", node[0], k), v) for path in q["paths"] for node in path[::2] for k, v in node[2].items()]
    for _, _, (_, v, p), _ in inline:
        wanted.setdefault(v, set()).add(p)
    aggregated = any(c[1] in _AGGREGATES for x in asked for c in _parts(x, "call"))
    calls = [c for x in asked for c in _parts(x, "call") if c[1] in _AGGREGATES]
    only_ends = all(c[2] or c[1] in ("min", "max") for c in calls) if aggregated else q["distinct"]

    def value(x: tuple) -> Column:
        kind = x[0]
        if kind == "value":
            return F.lit(x[1])
        if kind == "param":
            if x[1] not in params:
                raise ValueError(f"no value for ${x[1]}")
            return F.lit(params[x[1]])
        if kind == "of":
            return F.col(f"`{x[1]}.{x[2]}`")
        if kind == "two":
            return _BINARY[x[1]](value(x[2]), value(x[3]))
        if kind == "not":
            return ~value(x[1])
        if kind == "null":
            return value(x[1]).isNull()
        if kind == "in":
            found = params.get(x[2][1]) if x[2][0] == "param" else [value(y) for y in x[2][1]]
            return value(x[1]).isin(list(found or []))
        if kind == "call" and x[1] == "label":
            return F.col(f"`{x[3][0][1]}.label`")
        if kind == "call" and x[1] in _AGGREGATES:
            args = [value(y) for y in x[3]]
            if x[2]:
                return {"count": F.countDistinct, "sum": F.sum_distinct, "collect": F.collect_set}.get(x[1], _AGGREGATES[x[1]])(*args)
            return _AGGREGATES[x[1]](*args)
        if kind == "call" and x[1] in _FUNCTIONS:
            return _FUNCTIONS[x[1]](*[value(y) for y in x[3]])
        raise ValueError(f"not an expression here: {_name(x)}")

    rest, own = [], {}
    for x in inline + _conjuncts(q["where"]):
        about = {v for _, v, _ in _parts(x, "of")} | {c[3][0][1] for c in _parts(x, "call") if c[1] == "label"}
        if len(about) == 1:
            own.setdefault(about.pop(), []).append(x)
        else:
            rest.append(x)
    labels: dict[str, str | None] = {}
    hops = {h["name"] for path in q["paths"] for h in path[1::2]} - {None}
    for path in q["paths"]:
        for v, label, _ in path[::2]:
            if label is not None and label not in nodes:
                raise ValueError(f"there are no nodes labelled {label}")
            if label and labels.get(v) and labels[v] != label:
                raise ValueError(f"{v} can't have two labels")
            labels[v] = labels.get(v) or label
    for v in wanted:
        if v not in labels and v not in hops:
            raise ValueError(f"nothing in the pattern is called {v}")

    def node_table(v: str) -> DataFrame:
        need, out = wanted.get(v, set()) - {"id"}, []
        for label in [labels[v]] if labels[v] else sorted(nodes):
            df = nodes[label]
            out.append(df.select(F.lit(label).alias(f"{v}.label"), F.col("id").alias(f"{v}.id"), *[F.col(p).alias(f"{v}.{p}") for p in sorted(need) if p in df.columns]))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
        if missing := [p for p in need if f"{v}.{p}" not in df.columns]:
            raise ValueError(f"{v} has no {missing[0]}")
        for x in own.get(v, []):
            df = df.where(value(x))
        return df

    place = lambda v: [f"`{v}.label`", f"`{v}.id`"]

    def matched(paths: list) -> DataFrame:
        df, known, pending, hop_n = None, set(), list(paths), 0
        while pending:
            path = next((p for p in pending if known & {x[0] for x in p[::2]}), None) if known else pending[0]
            if path is None:
                raise ValueError("the parts of a pattern must share a node")
            pending.remove(path)
            start = next((i for i in range(0, len(path), 2) if path[i][0] in known), 0)
            if df is None:
                df, known = node_table(path[0][0]), {path[0][0]}
            # From a node that is known outwards, first ahead, then back.
            for i in [*range(start + 1, len(path), 2), *range(start - 1, 0, -2)]:
                forth = i > start
                a, b = (path[i - 1][0], path[i + 1][0]) if forth else (path[i + 1][0], path[i - 1][0])
                h, hop_n = path[i], hop_n + 1
                one = edges if not h["kinds"] else edges.where(F.col("kind").isin(h["kinds"]))
                name = h["name"] or f"_hop{hop_n}"
                extra = [F.col(c).alias(f"{name}.{c}") for c in sorted(wanted.get(name, set()))]
                if extra and h["reach"]:
                    raise ValueError(f"{name} is more than one edge")
                ends = lambda x, y: one.select(F.col(f"{x}_label").alias("l1"), F.col(x).alias("s"), F.col(f"{y}_label").alias("l2"), F.col(y).alias("t"), *extra)  # noqa: E731, B023
                along = h["ahead"] if forth else h["back"]
                against = h["back"] if forth else h["ahead"]
                e = ends("src", "dst") if along and not against else ends("dst", "src") if against and not along else ends("src", "dst").unionByName(ends("dst", "src"))
                other = None if b in known else node_table(b)
                if h["reach"]:
                    df = written(df)
                    first = df.select(*[F.col(c).alias(k) for c, k in zip(place(a), ("l", "v"), strict=True)]).distinct()
                    last = written((df if other is None else other).select(*[F.col(c).alias(k) for c, k in zip(place(b), ("l", "v"), strict=True)]).distinct())
                    if last.count() < first.count():
                        turned = e.select(F.col("l2").alias("l1"), F.col("t").alias("s"), F.col("l1").alias("l2"), F.col("s").alias("t"))
                        e = walks(turned, last, *h["reach"], only_ends, written).select(F.col("l2").alias("l1"), F.col("t").alias("s"), F.col("l1").alias("l2"), F.col("s").alias("t"), "n")
                    else:
                        e = walks(e, first, *h["reach"], only_ends, written)
                        e = e.join(last.select(F.col("l").alias("l2"), F.col("v").alias("t")), ["l2", "t"], "left_semi").select("l1", "s", "l2", "t", "n")
                    if not only_ends:
                        e = e.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
                    e = e.drop("n")
                # A label that the pattern names becomes a filter on the edges, which reaches their scan.
                for v, c in ((a, "l1"), (b, "l2")):
                    if labels[v]:
                        e = e.where(F.col(c) == labels[v])
                met = (F.col(place(a)[0]) == F.col("l1")) & (F.col(place(a)[1]) == F.col("s"))
                to = (F.col(place(b)[0]) == F.col("l2")) & (F.col(place(b)[1]) == F.col("t"))
                df = df.join(e, met & to) if other is None else df.join(e, met).join(other, to)
                df = df.drop("l1", "s", "l2", "t")
                known.add(b)
        return df

    if apart := _apart(q, items, rest):
        shared, (low, left), (high, right), strict = apart
        sides = [matched([path]).select(*[F.col(c).alias(k) for c, k in zip(place(shared), ("l", "v"), strict=True)], value(x).alias("x")) for x, path in ((low, left), (high, right))]
        return pairs_in_order(*sides, ["l", "v"], strict, written).toDF(names[0])
    df = matched(q["paths"])
    for x in rest:
        df = df.where(value(x))
    out = [value(x).alias(n) for x, n in items]
    by_name = {n: n for _, n in items} | {".".join(x[1:]): n for x, n in items if x[0] == "of"}
    order, hidden = [], []
    for x, down in q["order"]:
        n = by_name.get(".".join(map(str, x[1:])) if x[0] in ("of", "name") else _name(x))
        if n is None and (q["distinct"] or aggregated):
            raise ValueError("with DISTINCT or aggregates, ORDER BY takes what is returned")
        if n is None:
            n = f"_order{len(hidden)}"
            hidden.append(value(x).alias(n))
        order.append(F.desc(f"`{n}`") if down else F.asc(f"`{n}`"))
    if aggregated:
        grouped = [i for i, (x, _) in enumerate(items) if not any(c[1] in _AGGREGATES for c in _parts(x, "call"))]
        df = df.groupBy(*[out[i] for i in grouped]).agg(*[c for i, c in enumerate(out) if i not in grouped]).select(*[F.col(f"`{n}`") for _, n in items])
    else:
        df = df.select(*out, *hidden)
    df = df.distinct() if q["distinct"] else df
    df = df.orderBy(*order) if order else df
    df = df.offset(q["skip"]) if q["skip"] else df
    df = df.limit(q["limit"]) if q["limit"] is not None else df
    return df.drop(*[f"_order{k}" for k in range(len(hidden))])
