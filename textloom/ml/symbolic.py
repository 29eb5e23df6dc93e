"""A small symbolic expression graph: simplification, differentiation, evaluation, source text."""

from __future__ import annotations

import math
from dataclasses import dataclass


class Expr:
    def __add__(self, o): return add(self, lift(o))
    def __radd__(self, o): return add(lift(o), self)
    def __sub__(self, o): return add(self, mul(Const(-1.0), lift(o)))
    def __rsub__(self, o): return add(lift(o), mul(Const(-1.0), self))
    def __mul__(self, o): return mul(self, lift(o))
    def __rmul__(self, o): return mul(lift(o), self)
    def __neg__(self): return mul(Const(-1.0), self)


@dataclass(frozen=True)
class Const(Expr):
    value: float


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Add(Expr):
    a: Expr
    b: Expr


@dataclass(frozen=True)
class Mul(Expr):
    a: Expr
    b: Expr


@dataclass(frozen=True)
class Call(Expr):
    f: str
    x: Expr


#: function -> (value, derivative as an expression of the argument)
FUNCTIONS = {
    "tanh": (math.tanh, lambda x: 1 - Call("tanh", x) * Call("tanh", x)),
    "exp": (math.exp, lambda x: Call("exp", x)),
    "sin": (math.sin, lambda x: Call("cos", x)),
    "cos": (math.cos, lambda x: -Call("sin", x)),
    "sigmoid": (lambda v: 1 / (1 + math.exp(-v)), lambda x: Call("sigmoid", x) * (1 - Call("sigmoid", x))),
}


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Const(float(x))


def add(a: Expr, b: Expr) -> Expr:
    if isinstance(a, Const) and isinstance(b, Const):
        return Const(a.value + b.value)
    if a == Const(0.0):
        return b
    if b == Const(0.0):
        return a
    return mul(Const(2.0), a) if a == b else Add(a, b)


def mul(a: Expr, b: Expr) -> Expr:
    if isinstance(a, Const) and isinstance(b, Const):
        return Const(a.value * b.value)
    if Const(0.0) in (a, b):
        return Const(0.0)
    if a == Const(1.0):
        return b
    if b == Const(1.0):
        return a
    return Mul(a, b)


def call(f: str, x: Expr) -> Expr:
    return Const(FUNCTIONS[f][0](x.value)) if isinstance(x, Const) else Call(f, x)


def diff(e: Expr, v: str) -> Expr:
    match e:
        case Const():
            return Const(0.0)
        case Var(name):
            return Const(1.0 if name == v else 0.0)
        case Add(a, b):
            return add(diff(a, v), diff(b, v))
        case Mul(a, b):
            return add(mul(diff(a, v), b), mul(a, diff(b, v)))
        case Call(f, x):
            return mul(lift(FUNCTIONS[f][1](x)), diff(x, v))
    raise TypeError(e)


def evaluate(e: Expr, env: dict[str, float]) -> float:
    match e:
        case Const(value):
            return value
        case Var(name):
            return env[name]
        case Add(a, b):
            return evaluate(a, env) + evaluate(b, env)
        case Mul(a, b):
            return evaluate(a, env) * evaluate(b, env)
        case Call(f, x):
            return FUNCTIONS[f][0](evaluate(x, env))
    raise TypeError(e)


def source(e: Expr) -> str:
    """Spark SQL text of an expression: generated code that runs inside code generation."""
    match e:
        case Const(value):
            return f"{value!r}D"
        case Var(name):
            return f"`{name}`"
        case Add(a, b):
            return f"({source(a)} + {source(b)})"
        case Mul(a, b):
            return f"({source(a)} * {source(b)})"
        case Call("sigmoid", x):
            return f"(1D / (1D + exp(-{source(x)})))"
        case Call(f, x):
            return f"{f}({source(x)})"
    raise TypeError(e)
