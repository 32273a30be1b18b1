"""Symbolic expressions that compile to Columns.

An expression is simplified and differentiated here, where algebra that Catalyst does not apply to
doubles (x * 0) is still sound for a model, and evaluated there, with whole-stage code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "**": lambda a, b: a**b}
_UNARY = {"sin": (math.sin, F.sin), "cos": (math.cos, F.cos), "exp": (math.exp, F.exp), "log": (math.log, F.log), "sqrt": (math.sqrt, F.sqrt)}


@dataclass(frozen=True)
class Expression:
    """A number, a variable, or an operator over expressions."""

    op: str
    args: tuple = ()

    def __add__(self, o):
        return Expression("+", (self, wrap(o)))

    def __radd__(self, o):
        return Expression("+", (wrap(o), self))

    def __sub__(self, o):
        return Expression("-", (self, wrap(o)))

    def __rsub__(self, o):
        return Expression("-", (wrap(o), self))

    def __mul__(self, o):
        return Expression("*", (self, wrap(o)))

    def __rmul__(self, o):
        return Expression("*", (wrap(o), self))

    def __truediv__(self, o):
        return Expression("/", (self, wrap(o)))

    def __rtruediv__(self, o):
        return Expression("/", (wrap(o), self))

    def __pow__(self, o):
        return Expression("**", (self, wrap(o)))

    def __neg__(self):
        return Constant(-1.0) * self

    def variables(self) -> set[str]:
        return {self.args[0]} if self.op == "var" else set() if self.op == "num" else set().union(*(a.variables() for a in self.args))

    def evaluate(self, **env: float) -> float:
        if self.op == "num":
            return self.args[0]
        if self.op == "var":
            return env[self.args[0]]
        v = [a.evaluate(**env) for a in self.args]
        return _BINARY[self.op](*v) if self.op in _BINARY else _UNARY[self.op][0](*v)

    def column(self, **env: Column | float) -> Column:
        """The expression over columns named as its variables, or as env says."""
        if self.op == "num":
            return F.lit(float(self.args[0]))
        if self.op == "var":
            v = env.get(self.args[0], F.col(self.args[0]))
            return v if isinstance(v, Column) else F.lit(float(v))
        v = [a.column(**env) for a in self.args]
        return F.pow(*v) if self.op == "**" else _BINARY[self.op](*v) if self.op in _BINARY else _UNARY[self.op][1](*v)

    def to_func(self, *names: str):
        return lambda *v: self.evaluate(**dict(zip(names, v)))

    def subs(self, **env) -> Expression:
        if self.op == "var":
            return wrap(env.get(self.args[0], self))
        return self if self.op == "num" else Expression(self.op, tuple(a.subs(**env) for a in self.args))

    def simplify(self) -> Expression:
        if self.op in ("num", "var"):
            return self
        a = tuple(x.simplify() for x in self.args)
        if all(x.op == "num" for x in a):
            try:
                return Constant(Expression(self.op, a).evaluate())
            except (ValueError, ZeroDivisionError, OverflowError):
                return Expression(self.op, a)
        is_ = lambda x, v: x.op == "num" and x.args[0] == v
        if len(a) == 2:
            x, y = a
            if self.op == "+" and (is_(x, 0) or is_(y, 0)):
                return y if is_(x, 0) else x
            if self.op == "-" and is_(y, 0):
                return x
            if self.op == "*":
                if is_(x, 0) or is_(y, 0):
                    return Constant(0.0)
                if is_(x, 1) or is_(y, 1):
                    return y if is_(x, 1) else x
            if self.op == "/" and (is_(x, 0) or is_(y, 1)):
                return x
            if self.op == "**" and (is_(y, 0) or is_(y, 1)):
                return Constant(1.0) if is_(y, 0) else x
        return Expression(self.op, a)

    def diff(self, name: str) -> Expression:
        return self._diff(name).simplify()

    def _diff(self, name: str) -> Expression:
        if self.op in ("num", "var"):
            return Constant(float(self.op == "var" and self.args[0] == name))
        d = [a._diff(name) for a in self.args]
        u = self.args[0]
        if self.op in "+-":
            return Expression(self.op, tuple(d))
        if self.op == "*":
            return d[0] * self.args[1] + u * d[1]
        if self.op == "/":
            return (d[0] * self.args[1] - u * d[1]) / (self.args[1] ** 2)
        if self.op == "**":
            n = self.args[1]
            if name not in n.variables():
                return n * u ** (n - 1) * d[0]
            return self * (d[1] * Log(u) + n * d[0] / u)
        return {"sin": lambda: Cos(u), "cos": lambda: -Sin(u), "exp": lambda: self, "log": lambda: 1 / u, "sqrt": lambda: 1 / (2 * self)}[self.op]() * d[0]

    def latex(self) -> str:
        if self.op in ("num", "var"):
            return f"{self.args[0]:g}" if self.op == "num" else str(self.args[0])
        a = [x.latex() for x in self.args]
        if self.op == "/":
            return rf"\frac{{{a[0]}}}{{{a[1]}}}"
        if self.op == "**":
            return f"({a[0]})^{{{a[1]}}}"
        if self.op in _BINARY:
            return f"({a[0]} {r'\cdot' if self.op == '*' else self.op} {a[1]})"
        return rf"\{self.op}({a[0]})" if self.op != "sqrt" else rf"\sqrt{{{a[0]}}}"


def wrap(x) -> Expression:
    return x if isinstance(x, Expression) else Constant(x)


def Constant(v: float) -> Expression:  # noqa: N802
    return Expression("num", (float(v),))


def Variable(name: str) -> Expression:  # noqa: N802
    return Expression("var", (name,))


def _unary(op: str):
    return lambda x: Expression(op, (wrap(x),))


Sin, Cos, Exp, Log, Sqrt = (_unary(op) for op in _UNARY)


@dataclass
class MathModel:
    """Named equations over parameters and variables."""

    name: str
    equations: list[tuple[str, Expression]]
    parameters: dict[str, float] = field(default_factory=dict)

    def evaluate(self, **env: float) -> dict[str, float]:
        return {n: e.evaluate(**(self.parameters | env)) for n, e in self.equations}

    def columns(self, df: DataFrame, **env: Column | float) -> DataFrame:
        return df.withColumns({n: e.column(**(self.parameters | env)) for n, e in self.equations})


def solve_equation(expr: Expression, variable: str, x0: float = 1.0, tol: float = 1e-10, max_iter: int = 1000) -> dict:
    """A root, by Newton's method with the exact derivative."""
    d, x = expr.diff(variable), x0
    for k in range(max_iter):
        y = expr.evaluate(**{variable: x})
        if abs(y) <= tol:
            return {"x": x, "residual": y, "iterations": k, "converged": True}
        if not (g := d.evaluate(**{variable: x})):
            break
        x -= y / g
    return {"x": x, "residual": expr.evaluate(**{variable: x}), "iterations": max_iter, "converged": False}


def fit_parameters(expr: Expression, df: DataFrame, target: str, parameters: Sequence[str], x0: Sequence[float] | None = None, max_iter: int = 50, tol: float = 1e-10) -> dict:
    """Least squares by damped Gauss-Newton steps; each step is one aggregate over exact derivative columns.

    Returns parameters, residual (sum of squares), rmse, r_squared, standard_errors, iterations, converged.
    """
    names, grads = list(parameters), [expr.diff(p) for p in parameters]
    p = np.array(x0 if x0 is not None else [1.0] * len(names), float)
    damping, k, n = 1e-3, 0, 0

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        env = dict(zip(names, at.tolist()))
        r = F.col(target) - expr.column(**env)
        g = [e.column(**env) for e in grads]
        s = df.agg(F.sum(r * r), F.count(F.lit(1)), *[F.sum(x * r) for x in g], *[F.sum(g[i] * g[j]) for i in range(len(g)) for j in range(len(g))]).first()
        return s[0], np.array(s[2 : 2 + len(g)]), np.array(s[2 + len(g) :]).reshape(len(g), len(g)), s[1]

    sse, b, a, n = sums(p)
    done = False
    for k in range(1, max_iter + 1):
        step = np.linalg.solve(a + damping * np.diag(np.diag(a) + 1e-12), b)
        new = sums(p + step)
        if new[0] <= sse:
            done = bool(np.linalg.norm(step) <= tol * (1 + np.linalg.norm(p)) or sse - new[0] <= tol * tol)
            p, damping = p + step, damping / 10
            sse, b, a, n = new
        else:
            damping *= 10
            done = damping > 1e12
        if done:
            break
    sst = df.agg(F.var_pop(target) * F.count(F.lit(1))).first()[0] or 0.0
    dof = n - len(names)
    se = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(a)) * sse / dof)).tolist() if dof > 0 else None
    return {"parameters": dict(zip(names, p.tolist())), "residual": sse, "rmse": math.sqrt(sse / max(1, n)), "r_squared": 1 - sse / sst if sst else 0.0, "standard_errors": dict(zip(names, se)) if se else None, "iterations": k, "converged": done}


def fit_parameters_advanced(expr: Expression, df: DataFrame, target: str, parameters: Sequence[str], starts: Sequence[Sequence[float]] | None = None) -> dict:
    """The best of several starts."""
    tries = [fit_parameters(expr, df, target, parameters, x0) for x0 in (starts or [[s] * len(parameters) for s in (1.0, 0.1, -1.0)])]
    return min(tries, key=lambda t: t["residual"]) | {"starts_tried": len(tries)}
