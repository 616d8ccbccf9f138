"""Band expressions as text, read by a small grammar into Columns. Nothing is evaluated as code."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.functions.numeric import filled, ratio

_TOKENS = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(\*\*|<=|>=|==|!=|<<|>>|[-+*/%<>()&|~,^]))")


def _positive(fn: Callable[[Column], Column], least: float = 0.0, open_: bool = True) -> Callable[[Column], Column]:
    return lambda x: F.when((x > least) if open_ else (x >= least), fn(x))


_FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "where": (3, lambda c, a, b: F.when(_truth(c), a).otherwise(b)),
    "nan_to_num": (1, lambda x: filled(x, 0.0)),
    "sqrt": (1, _positive(F.sqrt, open_=False)),
    "abs": (1, F.abs),
    "exp": (1, F.exp),
    "expm1": (1, F.expm1),
    "log": (1, _positive(F.log)),
    "log10": (1, _positive(F.log10)),
    "log1p": (1, _positive(F.log1p, -1.0)),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
    "tan": (1, F.tan),
    "arcsin": (1, F.asin),
    "arccos": (1, F.acos),
    "arctan": (1, F.atan),
    "arctan2": (2, F.atan2),
    "sinh": (1, F.sinh),
    "cosh": (1, F.cosh),
    "tanh": (1, F.tanh),
    "floor": (1, lambda x: F.floor(x).cast("double")),
    "ceil": (1, lambda x: F.ceil(x).cast("double")),
    "minimum": (2, F.least),
    "maximum": (2, F.greatest),
}


class _Boolean:
    """Marks Columns that hold a truth value."""

    def __init__(self, column: Column):
        self.column = column


def _value(x) -> Column:
    return x.column.cast("double") if isinstance(x, _Boolean) else x


def _truth(x) -> Column:
    return x.column if isinstance(x, _Boolean) else x != 0


class _Parser:
    def __init__(self, text: str, names: dict[str, Column]):
        self.names, self.at, self.items = names, 0, []
        end = 0
        while end < len(text.rstrip()):
            m = _TOKENS.match(text, end)
            if not m:
                raise ValueError(f"unexpected {text[end:].strip()[:10]!r} in expression")
            self.items.append((m.lastindex, m[m.lastindex]))
            end = m.end()

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) else None

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] == 3 and self.peek() in wanted:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign!r} expected, found {self.peek()!r}")

    def either(self):
        out = self.both()
        while op := self.take("|", "^"):
            b = self.both()
            if isinstance(out, _Boolean) and isinstance(b, _Boolean):
                out = _Boolean(out.column | b.column) if op == "|" else _Boolean(out.column != b.column)
            else:
                x, y = _value(out).cast("bigint"), _value(b).cast("bigint")
                out = (x.bitwiseOR(y) if op == "|" else x.bitwiseXOR(y)).cast("double")
        return out

    def both(self):
        out = self.compare()
        while self.take("&"):
            b = self.compare()
            if isinstance(out, _Boolean) and isinstance(b, _Boolean):
                out = _Boolean(out.column & b.column)
            else:
                out = _value(out).cast("bigint").bitwiseAND(_value(b).cast("bigint")).cast("double")
        return out

    def compare(self):
        out = self.shift()
        if op := self.take("<", "<=", ">", ">=", "==", "!="):
            a, b = _value(out), _value(self.shift())
            out = _Boolean({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op])
        return out

    def shift(self):
        out = self.sum()
        while op := self.take("<<", ">>"):
            a, b = _value(out).cast("bigint"), _value(self.sum()).cast("int")
            out = F.call_function("shiftleft" if op == "<<" else "shiftright", a, b).cast("double")
        return out

    def sum(self):
        out = self.product()
        while op := self.take("+", "-"):
            a, b = _value(out), _value(self.product())
            out = a + b if op == "+" else a - b
        return out

    def product(self):
        out = self.sign()
        while op := self.take("*", "/", "%"):
            a, b = _value(out), _value(self.sign())
            out = a * b if op == "*" else ratio(a, b) if op == "/" else F.when(b != 0, F.pmod(a, F.when(b != 0, b)))
        return out

    def sign(self):
        if self.take("-"):
            return -_value(self.sign())
        if self.take("+"):
            return self.sign()
        if self.take("~"):
            x = self.sign()
            return _Boolean(~x.column) if isinstance(x, _Boolean) else F.bitwise_not(_value(x).cast("bigint")).cast("double")
        return self.power()

    def power(self):
        base = self.atom()
        return F.pow(_value(base), _value(self.sign())) if self.take("**") else base

    def atom(self):
        if self.at >= len(self.items):
            raise ValueError("expression ends early")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == 1:
            return F.lit(float(text))
        if kind == 2:
            if self.take("("):
                if text not in _FUNCTIONS:
                    raise ValueError(f"unknown function {text!r}")
                n, fn = _FUNCTIONS[text]
                args = [self.either()]
                while self.take(","):
                    args.append(self.either())
                self.need(")")
                if len(args) != n:
                    raise ValueError(f"{text} takes {n} arguments")
                return fn(args[0], *map(_value, args[1:])) if text == "where" else fn(*map(_value, args))
            if text in self.names:
                return self.names[text].cast("double")
            if text == "pi":
                return F.lit(math.pi)
            raise ValueError(f"unknown name {text!r}")
        if text == "(":
            out = self.either()
            self.need(")")
            return out
        raise ValueError(f"unexpected {text!r}")


def expression(text: str, names: dict[str, Column]) -> Column:
    """A Column for ``text`` over named Columns; division by 0 and roots and logarithms outside their range give null.

    Operators: + - * / % ** comparisons & | ^ ~ << >>; functions as in ``_FUNCTIONS``; comparisons count as 1 and 0."""
    p = _Parser(text, names)
    out = p.either()
    if p.at < len(p.items):
        raise ValueError(f"unexpected {p.peek()!r}")
    return _value(out)


def expressions(text: str, names: dict[str, Column], no_data: float = 0.0) -> list[Column]:
    """One Column for each part between ``&&``, nulls and values that aren't finite replaced by ``no_data``."""
    return [filled(expression(part, names), no_data) for part in text.split("&&")]
