"""Expressions that differ by row: each distinct text is put into postfix form once, and a stack runs it over a row's values.

Both steps are folds over arrays in built-in functions. The language is that of ``expressions``: the same operators,
functions, limits and errors, shown as null. A text is compiled from its tokens by a stack of open operators; what binds at least as
tightly as the next operator goes out before it, in one slice of the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.expressions import FUNCTIONS, LENGTH_MOST, LEVELS, _flag

_TOKEN = r"\d+\.?\d*|\.\d+|[A-Za-z_]\w*|<=|>=|<>|!=|==|[^\s]"
#: How tightly operators bind; prefixes have names of their own, and an open bracket (0) holds everything back.
_COMPARED = ("<", ">", "<=", ">=", "=", "==", "<>", "!=")
BINDS = {"or": 1, "and": 2, "not": 3, **dict.fromkeys(_COMPARED, 4), "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "^": 7, "u-": 8, "u+": 8, "u!": 8}
_STEP = "struct<op:string,value:double,args:int>"
_OPEN = "struct<op:string,binds:int,args:int>"


def _step(op: Column, value: Column | None = None, args: Column | None = None) -> Column:
    return F.struct(op.alias("op"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if args is None else args).cast("int").alias("args")).cast(_STEP)


def _open(op: Column, binds: Column, args: Column | None = None) -> Column:
    return F.struct(op.alias("op"), binds.cast("int").alias("binds"), (F.lit(0) if args is None else args).cast("int").alias("args")).cast(_OPEN)


def postfix(source: Column) -> Column:
    """The steps of an expression's text in postfix order, null for a text that is none."""
    binds = F.create_map(*[F.lit(x) for pair in BINDS.items() for x in pair])
    tokens = F.transform(F.regexp_extract_all(source, F.lit(_TOKEN), 0), F.lower)
    ends = F.slice(F.concat(tokens, F.array(F.lit(""))), 2, F.size(tokens) + 1)
    words = F.zip_with(F.concat(tokens, F.array(F.lit(""))), F.concat(ends, F.array(F.lit(""))), lambda t, after: F.struct(t.alias("t"), after.alias("after")))
    # The stack's top stands first. ``operand``: a value or a prefix is what may come next.
    start = F.struct(F.array().cast(f"array<{_STEP}>").alias("out"), F.array().cast(f"array<{_OPEN}>").alias("stack"), F.lit(True).alias("operand"), F.lit(True).alias("fine"))

    def state(out: Column, stack: Column, operand: bool, fine: Column) -> Column:
        return F.struct(out.alias("out"), stack.alias("stack"), F.lit(operand).alias("operand"), fine.alias("fine"))

    def closed(s: Column, least: Column | int) -> tuple[Column, Column]:
        """The output and the stack after all on top that binds at least so tightly has gone out."""
        stay = F.array_position(F.transform(s["stack"], lambda x: x["binds"] < least), True)
        n = F.when(stay == 0, F.size(s["stack"])).otherwise(stay - 1).cast("int")
        gone = F.transform(F.slice(s["stack"], 1, n), lambda x: _step(x["op"]))
        return F.concat(s["out"], gone), F.slice(s["stack"], n + 1, F.size(s["stack"]))

    def advance(s: Column, word: Column) -> Column:
        t, top = word["t"], F.get(s["stack"], F.lit(0))
        last, fine = t == "", s["fine"]
        number, name = t.rlike(r"^(\d|\.\d)"), t.rlike(r"^[a-z_]") & ~t.isin("or", "and", "not")
        call = name & (word["after"] == "(")
        # ``not`` stands where a comparison can: at the start of a text, a bracket, an argument, or after a word operator.
        roomy = top.isNull() | (F.coalesce(top["binds"], F.lit(0)) <= 3)
        prefix = F.when(t.isin("-", "+", "!"), F.concat(F.lit("u"), t)).when((t == "not") & roomy, "not")
        pushed = lambda op, weight, args=None: F.concat(F.array(_open(op, weight, args)), s["stack"])
        value = F.when(t == "true", 1.0).when(t == "false", 0.0).when(number, t.try_cast("double"))
        atom = _step(F.when(number | t.isin("true", "false"), F.lit("number")).otherwise(F.concat(F.lit("name:"), t)), value)
        opened = F.when(call, state(s["out"], pushed(t, F.lit(-1), F.lit(1)), True, fine)).when(t == "(", F.when(top["binds"] == -1, state(s["out"], F.concat(F.array(_open(F.lit("("), F.lit(0), F.lit(1))), s["stack"]), True, fine)).otherwise(state(s["out"], pushed(F.lit("("), F.lit(0)), True, fine)))
        at_operand = opened.when(prefix.isNotNull(), state(s["out"], pushed(prefix, F.try_element_at(binds, prefix)), True, fine)).when(number | name, state(F.concat(s["out"], F.array(atom)), s["stack"], False, fine)).otherwise(state(s["out"], s["stack"], False, F.lit(False)))

        weight = F.try_element_at(binds, t)
        # The power binds to the right; a comparison beside another one is an error.
        out, rest = closed(s, F.when(t == "^", weight + 1).otherwise(weight))
        chained = t.isin(*_COMPARED) & F.exists(F.slice(s["stack"], 1, F.size(s["stack"]) - F.size(rest)), lambda x: x["op"].isin(*_COMPARED))
        operator = state(out, F.concat(F.array(_open(t, weight)), rest), True, fine & ~chained)
        out, rest = closed(s, 1)
        bracket, under = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
        called = _step(F.concat(F.lit("call:"), under["op"]), None, bracket["args"])
        shut = F.when(bracket["binds"] != 0, state(out, rest, False, F.lit(False))).when(bracket["args"] > 0, state(F.concat(out, F.array(called)), F.slice(rest, 3, F.size(rest)), False, fine)).otherwise(state(out, F.slice(rest, 2, F.size(rest)), False, fine))
        comma = F.when(bracket["args"] > 0, state(out, F.concat(F.array(_open(F.lit("("), F.lit(0), bracket["args"] + 1)), F.slice(rest, 2, F.size(rest))), True, fine)).otherwise(state(out, rest, True, F.lit(False)))
        done = state(out, rest, False, fine & (F.size(rest) == 0))
        after_operand = F.when(last, done).when(t == ")", F.when(F.size(rest) > 0, shut).otherwise(state(out, rest, False, F.lit(False)))).when(t == ",", comma).when(weight.isNotNull() & ~t.isin("not"), operator).otherwise(state(s["out"], s["stack"], False, F.lit(False)))
        return F.when(~fine, s).when(s["operand"], at_operand).otherwise(after_operand)

    read = F.aggregate(words, start, advance)
    arity = F.create_map(*[x for f, (least, most, _) in FUNCTIONS.items() for x in (F.lit(f"call:{f}"), F.struct(F.lit(least).alias("least"), F.lit(most).alias("most")))])
    known = F.forall(read["out"], lambda x: ~x["op"].startswith("call:") | F.coalesce(x["args"].between(F.try_element_at(arity, x["op"])["least"], F.try_element_at(arity, x["op"])["most"]), F.lit(False)))
    return F.when((F.length(source) <= LENGTH_MOST) & read["fine"] & known, read["out"])


_TWO = {op: make for level in LEVELS for op, make in level.items()} | {"^": F.pow}
_ONE = {"not": lambda a: _flag(a == 0), "u!": lambda a: _flag(a == 0), "u-": lambda a: -a, "u+": lambda a: a}


def evaluated(steps: Column, values: dict[str, Column]) -> Column:
    """The value of postfix steps over a row's named values; null where it has none, isn't finite, or a name is unknown."""
    names = F.create_map(*[x for n, v in values.items() for x in (F.lit(f"name:{n.lower()}"), v.cast("double"))]) if values else F.create_map(F.lit(""), F.lit(0.0))

    def run(stack: Column, x: Column) -> Column:
        """The stack's top stands first; a null on it stays null in all that it goes into."""
        a, b = F.get(stack, F.lit(1)), F.get(stack, F.lit(0))
        under = lambda n: F.slice(stack, n + 1, F.size(stack))
        args = F.reverse(F.slice(stack, 1, F.coalesce(x["args"], F.lit(0))))
        whole = ~F.exists(args, lambda v: v.isNull())
        many = {"min": F.when(whole, F.array_min(args)), "max": F.when(whole, F.array_max(args)), "pow": F.pow(F.get(args, F.lit(0)), F.get(args, F.lit(1)))}
        one = {f: make(b) for f, (least, most, make) in FUNCTIONS.items() if most == 1}
        push = lambda v, n: F.concat(F.array(v.cast("double")), under(n))
        rest = F.when(x["op"] == "number", push(x["value"], 0)).when(x["op"].startswith("name:"), push(F.try_element_at(names, x["op"]), 0))
        for op, make in _TWO.items():
            rest = rest.when(x["op"] == op, push(make(a, b), 2))
        for op, make in _ONE.items():
            rest = rest.when(x["op"] == op, push(make(b), 1))
        for f, v in many.items():
            rest = rest.when(x["op"] == f"call:{f}", F.concat(F.array(v.cast("double")), F.slice(stack, x["args"] + 1, F.size(stack))))
        for f, v in one.items():
            rest = rest.when(x["op"] == f"call:{f}", push(v, 1))
        return rest

    last = F.get(F.aggregate(steps, F.array().cast("array<double>"), run), F.lit(0))
    return F.when(~F.isnan(last) & (F.abs(last) < float("inf")), last)


def with_values(rows: DataFrame, source: str, values: dict[str, Column], name: str = "value") -> DataFrame:
    """``rows`` with the value of the expression in their column ``source``. Texts are compiled once each and joined back; a null
    text is no expression."""
    steps = rows.select(F.col(source).alias("_text")).filter("_text is not null").distinct().withColumn("_steps", postfix(F.col("_text")))
    joined = rows.join(steps, F.col(source) == F.col("_text"), "left")
    return joined.withColumn(name, evaluated(F.col("_steps"), values)).drop("_text", "_steps")
