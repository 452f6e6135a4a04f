"""The wiki's arithmetic expressions as Columns: one text, evaluated over the columns of every row.

All values are doubles. A result that is not finite is an error, shown as null; so is a text that is too
long, has an unknown name or a wrong number of arguments.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import regions
from scriptorium.functions.text import number_text, truth

LENGTH_MOST = 256


def _flag(rule: Column) -> Column:
    return F.when(rule, 1.0).when(~rule, 0.0)


def _number(x: Column) -> Column:
    """Whether a value is a number: what isn't compares with nothing."""
    return ~F.isnan(x)


def quotient(a: Column, b: Column) -> Column:
    """By zero an infinite value, or none for zero by zero: only a result has to be finite."""
    endless = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, F.when(F.isnan(a), a).otherwise(endless))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % b).when(b == 0, float("nan"))


def logarithm(x: Column, make: Callable[[Column], Column]) -> Column:
    return F.when(x > 0, make(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


#: Functions by name, with the least and most arguments.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs),
    "min": (1, 99, lambda *a: F.least(*a) if len(a) > 1 else a[0]),
    "max": (1, 99, lambda *a: F.greatest(*a) if len(a) > 1 else a[0]),
    "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "ceil": (1, 1, lambda x: F.ceil(x).cast("double")),
    "round": (1, 1, lambda x: F.floor(x + 0.5).cast("double")),
    "sqrt": (1, 1, F.sqrt),
    "sin": (1, 1, F.sin),
    "cos": (1, 1, F.cos),
    "tan": (1, 1, F.tan),
    "ln": (1, 1, lambda x: logarithm(x, F.ln)),
    "log": (1, 1, lambda x: logarithm(x, F.log10)),
    "exp": (1, 1, F.exp),
    "pow": (2, 2, F.pow),
}
#: Operators by how tightly they bind, loosest first; comparisons don't chain.
LEVELS: list[dict[str, Callable[[Column, Column], Column]]] = [
    {"or": lambda a, b: _flag((a != 0) | (b != 0))},
    {"and": lambda a, b: _flag((a != 0) & (b != 0))},
    {
        sign: (lambda rule: lambda a, b: _flag(rule(a, b) & _number(a) & _number(b)))(rule)
        for sign, rule in (("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b), ("<", lambda a, b: a < b), (">", lambda a, b: a > b), ("=", lambda a, b: a == b), ("==", lambda a, b: a == b))
    }
    | dict.fromkeys(("<>", "!="), lambda a, b: _flag((a != b) | ~_number(a) | ~_number(b))),
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
    {"*": lambda a, b: a * b, "/": quotient, "%": remainder},
]
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|(<=|>=|<>|!=|==|[-+*/%^()<>=!,]))")


class ExpressionError(ValueError):
    """A text that is no expression."""


class _Reader:
    def __init__(self, source: str, names: dict[str, Column]):
        self.tokens, self.names, at = [], names, 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ExpressionError(f"unexpected character at {at}")
            self.tokens.append(("number", m[1]) if m[1] else ("name", m[2].lower()) if m[2] else ("sign", m[3]))
            at = m.end()
        self.tokens.append(("end", ""))

    def take(self, *texts: str) -> str | None:
        if self.tokens[0][0] != "number" and self.tokens[0][1] in texts:
            return self.tokens.pop(0)[1]
        return None

    def level(self, n: int) -> Column:
        if n == len(LEVELS):
            return self.power()
        if n == 2 and self.take("not"):
            return _flag(self.level(2) == 0)
        left = self.level(n + 1)
        while op := self.take(*LEVELS[n]):
            left = LEVELS[n][op](left, self.level(n + 1))
            if n == 2:
                break
        return left

    def power(self) -> Column:
        base = self.unary()
        return F.pow(base, self.power()) if self.take("^") else base

    def unary(self) -> Column:
        if self.take("-"):
            return -self.unary()
        if self.take("+"):
            return self.unary()
        if self.take("!"):
            return _flag(self.unary() == 0)
        return self.value()

    def value(self) -> Column:
        kind, word = self.tokens.pop(0)
        if kind == "number":
            return F.lit(float(word))
        if word == "(":
            inner = self.level(0)
            if not self.take(")"):
                raise ExpressionError("missing )")
            return inner
        if kind == "name" and self.take("("):
            args = [] if self.take(")") else [self.level(0)]
            while args and self.take(","):
                args.append(self.level(0))
            if args and not self.take(")"):
                raise ExpressionError("missing )")
            least, most, make = FUNCTIONS.get(word, (1, 0, None))
            if not least <= len(args) <= most:
                raise ExpressionError(f"{word}: wrong number of arguments" if make else f"unknown function {word}")
            return make(*args)
        if kind == "name" and word in ("true", "false"):
            return F.lit(float(word == "true"))
        if kind == "name" and word in self.names:
            return self.names[word].cast("double")
        raise ExpressionError(f"undefined constant {word}" if kind == "name" else f"unexpected {word or 'end'}")


def expression(source: str, **names: Column) -> Column:
    """The expression's value as a double, null where it is not finite; raises ExpressionError for a bad text."""
    if len(source) > LENGTH_MOST:
        raise ExpressionError("expression too long")
    reader = _Reader(source, names)
    value = reader.level(0)
    if reader.tokens[0][0] != "end":
        raise ExpressionError(f"unexpected {reader.tokens[0][1]}")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


#: A directive without another one in it, and the deepest nesting that is resolved (fixed value).
_DIRECTIVE = re.compile(r"\[\[#(expr|ifexpr|if)(?:\s+([^\[\]]*?))?\s*\]\]", re.I)
NESTING_MOST = 64
#: What stands for a directive that is resolved: characters of the private use area around its number.
_MARK = re.compile("\ue002(\\d+)\ue003")


def directives(source: str, **names: Column) -> Column:
    """A source text with ``[[#expr e]]``, ``[[#ifexpr e | then | else]]`` and ``[[#if text | then | else]]`` resolved,
    innermost first, as one Column over the columns of every row. Raw regions stay as they are.

    A directive inside an expression has to be an ``#expr``. An expression that can't be read or isn't finite shows
    ``ERROR``, an empty one nothing, and a condition without branches nothing. A text that nests deeper than
    NESTING_MOST stays as it is.
    """
    texts: list[Column] = []
    values: dict[str, Column] = dict(names)

    def joined(part: str) -> Column:
        pieces = _MARK.split(part)
        return F.concat(F.lit(""), *[texts[int(p)] if n % 2 else F.lit(regions.restored_text(p, raw)) for n, p in enumerate(pieces) if p])

    def number(head: str) -> Column | None:
        """The value of an expression, null where it has none; None for no expression at all."""
        if not head:
            return None
        try:
            return expression(_MARK.sub(lambda m: f"(v_{m[1]})", head), **values)
        except ExpressionError:
            return F.lit(None).cast("double")

    def resolved(kind: str, body: str) -> Column:
        head, *branches = (p.strip() for p in body.split("|", 2))
        value = number(head) if kind != "if" else None
        if kind == "expr":
            values[f"v_{len(texts)}"] = value if value is not None else F.lit(None).cast("double")
            return F.lit("") if value is None else F.coalesce(number_text(value), F.lit("ERROR"))
        if not branches:
            return F.lit("")
        then, other = joined(branches[0]), joined(branches[1]) if len(branches) > 1 else F.lit("")
        if kind == "if":
            return F.when(truth(joined(head)), then).otherwise(other)
        return F.lit("ERROR") if value is None else F.when(value.isNull(), "ERROR").when(value != 0, then).otherwise(other)

    def mark(found: re.Match) -> str:
        texts.append(resolved(found[1].lower(), found[2] or ""))
        return f"\ue002{len(texts) - 1}\ue003"

    text, raw = regions.masked_text(source)
    for _ in range(NESTING_MOST):
        after = _DIRECTIVE.sub(mark, text)
        if after == text:
            return joined(text)
        text = after
    return F.lit(source) if _DIRECTIVE.search(text) else joined(text)
