"""Formulas: text to an expression tree, simplified, differentiated, and turned
into a Column that Spark compiles with the rest of the plan.

    Formula("x^2 + sin(y)", ["x", "y"]).diff("x").column()
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import ufuncs as u

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(.))")
CONSTANTS = {"pi": math.pi, "e": math.e}
FUNCTIONS = ("sin", "cos", "tan", "asin", "acos", "atan", "exp", "log", "sqrt", "abs", "sinh", "cosh", "tanh")


@dataclass(frozen=True)
class Node:
    """op is 'num', 'var', one of + - * / ^, 'neg', or a function's name."""

    op: str
    args: tuple = ()

    def __str__(self) -> str:
        if self.op == "num":
            return f"{self.args[0]:g}"
        if self.op == "var":
            return self.args[0]
        if self.op == "neg":
            return f"-({self.args[0]})"
        if self.op in "+-*/^":
            return f"({self.args[0]} {self.op} {self.args[1]})"
        return f"{self.op}({self.args[0]})"


def num(x: float) -> Node:
    return Node("num", (float(x),))


def parse(text: str, variables: list[str]) -> Node:
    """Recursive descent: sums, products, signs, right-associative powers, calls."""
    tokens = [next(t for t in m if t) for m in _TOKEN.findall(text.strip()) if any(t.strip() for t in m)]
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def pop(want: str = "") -> str:
        nonlocal at
        got = peek()
        if not got or (want and got != want):
            raise ValueError(f"{want or 'more'} expected at {got or 'the end'} in {text!r}")
        at += 1
        return got

    def total() -> Node:
        out = product()
        while peek() in ("+", "-"):
            out = Node(pop(), (out, product()))
        return out

    def product() -> Node:
        out = signed()
        while peek() in ("*", "/"):
            out = Node(pop(), (out, signed()))
        return out

    def signed() -> Node:
        if peek() == "-":
            pop()
            return Node("neg", (signed(),))
        if peek() == "+":
            pop()
            return signed()
        return raised()

    def raised() -> Node:
        base = atom()
        if peek() == "^":
            pop()
            return Node("^", (base, signed()))
        return base

    def atom() -> Node:
        t = pop()
        if t == "(":
            out = total()
            pop(")")
            return out
        if t[0].isdigit() or t[0] == ".":
            return num(float(t))
        if peek() == "(" and t in FUNCTIONS:
            pop("(")
            out = Node(t, (total(),))
            pop(")")
            return out
        if t in variables:
            return Node("var", (t,))
        if t in CONSTANTS:
            return num(CONSTANTS[t])
        raise ValueError(f"unknown name {t!r} in {text!r}")

    out = total()
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} is left over in {text!r}")
    return out


_PLAIN = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan, "exp": math.exp, "log": math.log, "sqrt": math.sqrt, "abs": abs, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh}


def evaluate(n: Node, at: dict[str, float]) -> float:
    if n.op == "num":
        return n.args[0]
    if n.op == "var":
        return float(at[n.args[0]])
    a = [evaluate(x, at) for x in n.args]
    if n.op == "neg":
        return -a[0]
    if n.op == "+":
        return a[0] + a[1]
    if n.op == "-":
        return a[0] - a[1]
    if n.op == "*":
        return a[0] * a[1]
    if n.op == "/":
        return a[0] / a[1]
    if n.op == "^":
        return a[0] ** a[1]
    return _PLAIN[n.op](a[0])


def is_num(n: Node, x: float | None = None) -> bool:
    return n.op == "num" and (x is None or n.args[0] == x)


@lru_cache(maxsize=4096)
def simplify(n: Node) -> Node:
    """Constants folded; neutral and absorbing elements removed."""
    if n.op in ("num", "var"):
        return n
    a = tuple(simplify(x) for x in n.args)
    if all(is_num(x) for x in a):
        try:
            return num(evaluate(Node(n.op, a), {}))
        except (ArithmeticError, ValueError):
            return Node(n.op, a)
    if n.op == "neg":
        return a[0].args[0] if a[0].op == "neg" else Node("neg", a)
    if n.op in "+-":
        if is_num(a[1], 0):
            return a[0]
        if is_num(a[0], 0):
            return a[1] if n.op == "+" else simplify(Node("neg", (a[1],)))
        if n.op == "-" and a[0] == a[1]:
            return num(0)
    if n.op == "*":
        if is_num(a[0], 0) or is_num(a[1], 0):
            return num(0)
        if is_num(a[0], 1):
            return a[1]
        if is_num(a[1], 1):
            return a[0]
    if n.op == "/" and is_num(a[1], 1):
        return a[0]
    if n.op == "/" and is_num(a[0], 0):
        return num(0)
    if n.op == "^":
        if is_num(a[1], 1):
            return a[0]
        if is_num(a[1], 0):
            return num(1)
    return Node(n.op, a)


def differentiate(n: Node, x: str) -> Node:
    return simplify(_derivative(n, x))


def _derivative(n: Node, x: str) -> Node:
    if n.op == "num":
        return num(0)
    if n.op == "var":
        return num(1 if n.args[0] == x else 0)
    d = [_derivative(a, x) for a in n.args]
    f = n.args[0]
    mul = lambda p, q: Node("*", (p, q))
    div = lambda p, q: Node("/", (p, q))
    neg = lambda p: Node("neg", (p,))
    sub = lambda p, q: Node("-", (p, q))
    square = lambda p: Node("^", (p, num(2)))
    if n.op == "neg":
        return neg(d[0])
    if n.op in "+-":
        return Node(n.op, (d[0], d[1]))
    if n.op == "*":
        return Node("+", (mul(d[0], n.args[1]), mul(f, d[1])))
    if n.op == "/":
        g = n.args[1]
        return div(sub(mul(d[0], g), mul(f, d[1])), square(g))
    if n.op == "^":
        g = n.args[1]
        if is_num(simplify(g)):
            return mul(mul(g, Node("^", (f, sub(g, num(1))))), d[0])
        return mul(n, Node("+", (mul(d[1], Node("log", (f,))), div(mul(g, d[0]), f))))
    outer = {
        "sin": lambda: Node("cos", (f,)),
        "cos": lambda: neg(Node("sin", (f,))),
        "tan": lambda: div(num(1), square(Node("cos", (f,)))),
        "asin": lambda: div(num(1), Node("sqrt", (sub(num(1), square(f)),))),
        "acos": lambda: neg(div(num(1), Node("sqrt", (sub(num(1), square(f)),)))),
        "atan": lambda: div(num(1), Node("+", (num(1), square(f)))),
        "exp": lambda: n,
        "log": lambda: div(num(1), f),
        "sqrt": lambda: div(num(1), mul(num(2), n)),
        "abs": lambda: div(f, n),
        "sinh": lambda: Node("cosh", (f,)),
        "cosh": lambda: Node("sinh", (f,)),
        "tanh": lambda: sub(num(1), square(n)),
    }[n.op]()
    return mul(outer, d[0])


_COLUMNS = {"asin": u.arcsin, "acos": u.arccos, "atan": u.arctan, "abs": u.absolute}


def to_column(n: Node, at: dict[str, Column]) -> Column:
    if n.op == "num":
        return F.lit(n.args[0])
    if n.op == "var":
        return at[n.args[0]].cast("double")
    a = [to_column(x, at) for x in n.args]
    if n.op == "neg":
        return -a[0]
    if n.op == "^":
        if is_num(n.args[1], 2):
            return a[0] * a[0]
        return F.pow(a[0], a[1])
    if n.op in "+-*/":
        return {"+": u.add, "-": u.subtract, "*": u.multiply, "/": u.divide}[n.op](a[0], a[1])
    return _COLUMNS.get(n.op, getattr(u, n.op, None))(a[0])


class Formula:
    """A function of named variables."""

    def __init__(self, text: str | Node, variables: list[str] = ("x",)):
        self.variables = list(variables)
        self.tree = simplify(parse(text, self.variables) if isinstance(text, str) else text)

    def __call__(self, *point: float) -> float:
        return evaluate(self.tree, dict(zip(self.variables, point, strict=True)))

    def column(self, **at: Column) -> Column:
        """The value as a Column; variables are columns of the same names unless given."""
        return to_column(self.tree, {v: at.get(v, F.col(v)) for v in self.variables})

    def diff(self, x: str | None = None) -> Formula:
        return Formula(differentiate(self.tree, x or self.variables[0]), self.variables)

    def dual(self, wrt: str, /, **at: Column) -> Column:
        """struct<value, slope>: forward differentiation in one pass."""
        return F.struct(self.column(**at).alias("value"), self.diff(wrt).column(**at).alias("slope"))

    def gradient(self) -> list[Formula]:
        return [self.diff(v) for v in self.variables]

    def hessian(self) -> list[list[Formula]]:
        return [[self.diff(a).diff(b) for b in self.variables] for a in self.variables]

    def laplacian(self) -> Formula:
        out = num(0)
        for v in self.variables:
            out = Node("+", (out, differentiate(differentiate(self.tree, v), v)))
        return Formula(simplify(out), self.variables)

    def __str__(self) -> str:
        return str(self.tree)


class Form:
    """A differential k-form: coefficients by increasing index tuples."""

    def __init__(self, degree: int, variables: list[str], parts: dict[tuple[int, ...], Node]):
        self.degree, self.variables = degree, list(variables)
        self.parts = {k: s for k, n in parts.items() if not is_num(s := simplify(n), 0)}

    @staticmethod
    def of(f: Formula) -> Form:
        return Form(0, f.variables, {(): f.tree})

    def d(self) -> Form:
        """The exterior derivative."""
        out: dict[tuple[int, ...], Node] = {}
        for idx, n in self.parts.items():
            for k, v in enumerate(self.variables):
                _collect(out, (k, *idx), differentiate(n, v))
        return Form(self.degree + 1, self.variables, out)

    def wedge(self, other: Form) -> Form:
        out: dict[tuple[int, ...], Node] = {}
        for a, n in self.parts.items():
            for b, m in other.parts.items():
                _collect(out, a + b, Node("*", (n, m)))
        return Form(self.degree + other.degree, self.variables, out)

    def column(self, *idx: int) -> Column:
        return Formula(self.parts.get(idx, num(0)), self.variables).column()


def _collect(out: dict, idx: tuple[int, ...], n: Node) -> None:
    if len(set(idx)) < len(idx):
        return
    swaps = sum(idx[i] > idx[j] for i in range(len(idx)) for j in range(i + 1, len(idx)))
    key = tuple(sorted(idx))
    term = Node("neg", (n,)) if swaps % 2 else n
    out[key] = Node("+", (out[key], term)) if key in out else term


def divergence(field: list[Formula]) -> Formula:
    out = num(0)
    for f, v in zip(field, field[0].variables, strict=True):
        out = Node("+", (out, differentiate(f.tree, v)))
    return Formula(simplify(out), field[0].variables)


def curl(field: list[Formula]) -> list[Formula]:
    v = field[0].variables
    d = lambda i, k: differentiate(field[i].tree, v[k])
    return [Formula(simplify(Node("-", (d(b, a), d(a, b)))), v) for a, b in ((1, 2), (2, 0), (0, 1))]
