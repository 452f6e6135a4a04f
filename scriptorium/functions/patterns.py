"""Patterns that users write: which are understood, how they read in Spark, and what matching one can cost.

The dialect is that of linear-time matchers: no looking around, no back references, nothing possessive or atomic. Spark's own
matcher goes back and tries again, so a pattern is first looked at as an automaton. If a text can run through one of its loops in
two ways, trying them all takes exponential time and the pattern is refused. Else the time is a power of
the text's runs of loop characters, and a row's text is matched only if that stays within a budget.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest pattern, most repeats of one part, most places of one loop, most places outside of loops with a choice, most steps of one text.
PATTERN_MOST, REPEATS_MOST, LOOP_MOST, CHOICES_MOST, STEPS_MOST = 4096, 1000, 160, 16, 1_000_000_000
_UNROLLED = 4  # repeats up to so many are looked at one by one, more as a loop
_LAST = 0x10FFFF
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": "\\t-\\r ", "word": "\\w", "xdigit": "0-9A-Fa-f", "punct": "!-/:-@\\[-`{-~", "blank": "\\t ", "cntrl": "\\x00-\\x1F\\x7F", "print": " -~", "graph": "!-~", "ascii": "\\x00-\\x7F"}

Ranges = list[tuple[int, int]]


class Refused(ValueError):
    """A pattern of another dialect, or one that could take exponential time."""


@dataclass(frozen=True)
class Pattern:
    """``source`` for Spark; names of groups by number; ``loops``: classes of the characters of each loop; ``degree``: how many
    loops of a row can share one run of characters."""

    source: str
    groups: int
    names: dict[str, int]
    loops: tuple[str, ...]
    degree: int

    def group(self, wanted: int | str) -> int | None:
        number = self.names.get(wanted) if isinstance(wanted, str) else wanted
        return number if number is not None and 0 <= number <= self.groups else None

    def affordable(self, text: Column) -> Column:
        """Whether the steps of a text are within the budget: its length, times its longest run of a loop for each loop."""
        steps = F.length(text).cast("double")
        for loop in self.loops:
            runs = F.transform(F.regexp_extract_all(text, F.lit(loop + "+"), 0), F.length)
            longest = F.coalesce(F.array_max(runs), F.lit(0)) + 1
            steps = F.greatest(steps, F.length(text) * F.pow(longest.cast("double"), F.lit(float(self.degree))))
        # No run is longer than its text, so the runs of short texts needn't be looked for.
        short = F.length(text) * F.pow(F.length(text).cast("double") + 1, F.lit(float(self.degree))) <= STEPS_MOST
        return short | (steps <= STEPS_MOST)


def _translated(source: str, multiline: bool) -> tuple[str, str]:
    """The pattern for Spark, and one for the parser that it is looked at with."""
    spark, mine, at = [], [], 0

    def put(a: str, b: str | None = None) -> None:
        spark.append(a)
        mine.append(a if b is None else b)

    def escape(at: int, inside: bool) -> int:
        c = source[at + 1 : at + 2]
        if m := re.compile(r"\\[pP](?:[A-Z]|\{\^?[A-Za-z]+\})").match(source, at):
            name = re.sub(r"\{([A-Za-z]{3,})\}", r"{Is\1}", m[0])
            put(name, "\\w\\W" if inside else "[\\w\\W]")
            return m.end()
        if m := re.compile(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))").match(source, at):
            put(f"\\x{{{m[1] or m[2]}}}", f"\\U{int(m[1] or m[2], 16):08x}")
            return m.end()
        space = "\\t\\n\\f\\r "
        known = {"d": "0-9", "s": space, "w": "0-9A-Za-z_"}
        if c and c in "dsw":
            put(known[c] if inside else f"[{known[c]}]")
        elif c and c in "DSW":
            if inside:
                put(f"[^{known[c.lower()]}]", "\\" + c)  # a class in a class: their union
            else:
                put(f"[^{known[c.lower()]}]")
        elif c in ("b", "B") and not inside:
            put(_EDGE if c == "b" else f"(?!{_EDGE})", "\\" + c)
        elif c in ("A", "z") and not inside:
            put("\\" + c, "\\A" if c == "A" else "\\Z")
        elif c and c in "tnrfa":
            put("\\" + c)
        elif c == "v":
            put("\\x0B")
        elif c and not c.isalnum() and c.isascii():
            put("\\" + c)
        else:
            raise Refused(f"escape \\{c}")
        return at + 2

    while at < len(source):
        c = source[at]
        if c == "\\":
            at = escape(at, False)
        elif c == "[":
            put("[")
            at += 1
            if source[at : at + 1] == "^":
                put("^")
                at += 1
            first = True
            while at < len(source) and (first or source[at] != "]"):
                first = False
                if m := re.compile(r"\[:(\^?)([a-z]+):\]").match(source, at):
                    if m[1] or m[2] not in _POSIX:
                        raise Refused("class")
                    put(_POSIX[m[2]])
                    at = m.end()
                elif source[at] == "\\":
                    at = escape(at, True)
                else:
                    put("\\" + source[at] if source[at] in "[]&^~|#" else source[at])
                    at += 1
            if at >= len(source):
                raise Refused("open class")
            put("]")
            at += 1
        elif source.startswith("(?", at):
            m = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|([ims]*(?:-[ims]+)?)([:)]))").match(source, at)
            if not m:
                raise Refused("group")
            put("(" if m[1] else m[0], f"(?P<{m[1]}>" if m[1] else "(?:" if m[3] == ":" else "")
            at = m.end()
        elif c in "*+?" or c == "{" and re.compile(r"\{\d+(?:,\d*)?\}").match(source, at):
            m = re.compile(r"(?:[*+?]|\{(\d+)(?:,(\d*))?\})(\??)(?![*+?])").match(source, at)
            if not m or max(int(m[1] or 0), int(m[2] or 0)) > REPEATS_MOST:
                raise Refused("repeat")
            put(m[0])
            at = m.end()
        else:
            # An edge after each bar keeps the parser from joining branches, which the matcher tries one by one.
            put({"$": "$" if multiline else "\\z", "{": "\\{", "}": "\\}"}.get(c, c), {"$": "$", "{": "\\{", "|": "|\\b"}.get(c, c))
            at += 1
    return "".join(spark), "".join(mine)


def _union(ranges: Ranges) -> Ranges:
    out: Ranges = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(ranges: Ranges) -> Ranges:
    edges = [-1, *(x for r in _union(ranges) for x in r), _LAST + 1]
    return [(a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2]) if a + 1 <= b - 1]


_CATEGORIES = {op.CATEGORY_DIGIT: [(48, 57)], op.CATEGORY_SPACE: [(9, 13), (32, 32)], op.CATEGORY_WORD: [(48, 57), (65, 90), (95, 95), (97, 122)]}
_CATEGORIES |= {getattr(op, f"CATEGORY_NOT_{k}"): _without(_CATEGORIES[getattr(op, f"CATEGORY_{k}")]) for k in ("DIGIT", "SPACE", "WORD")}


def _ranges(kind, value, ignore_case: bool) -> Ranges:
    if kind is op.ANY:
        return _without([(10, 10)])
    if kind is op.NOT_LITERAL:
        return _without(_ranges(op.LITERAL, value, ignore_case))
    if kind is op.LITERAL:
        both = {value, *(ord(c) for c in (chr(value).lower(), chr(value).upper()) if len(c) == 1)} if ignore_case else {value}
        return _union([(v, v) for v in both])
    found: Ranges = []
    for k, v in value:
        if k is op.RANGE:
            found.append(v)
            if ignore_case:
                found += [(max(v[0], a) + d, min(v[1], b) + d) for a, b, d in ((65, 90, 32), (97, 122, -32)) if max(v[0], a) <= min(v[1], b)]
        elif k is op.CATEGORY:
            found += _CATEGORIES[v]
        elif k is op.LITERAL:
            found += _ranges(k, v, ignore_case)
    return _without(found) if value and value[0][0] is op.NEGATE else _union(found)


class _Automaton:
    """Places of a pattern's characters and which may follow which; a step that can be made in two ways is in ``twice``."""

    def __init__(self, tree, ignore_case: bool):
        self.ignore_case, self.sets, self.follow, self.twice = ignore_case, [], [], set()
        self._items(list(tree))

    def _link(self, lasts: set[int], firsts: set[int]) -> None:
        for a in lasts:
            self.twice |= {(a, b) for b in firsts & self.follow[a]}
            self.follow[a] |= firsts

    def _items(self, items) -> tuple[bool, set[int], set[int]]:
        """(may be empty, first places, last places) of a sequence."""
        empty, first, last = True, set(), set()
        for kind, value in items:
            e, f, z = self._one(kind, value)
            self._link(last, f)
            first |= f if empty else set()
            last, empty = (last | z if e else z), empty and e
        return empty, first, last

    def _one(self, kind, value) -> tuple[bool, set[int], set[int]]:
        if kind in (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN):
            self.sets.append(_ranges(kind, value, self.ignore_case))
            self.follow.append(set())
            if len(self.sets) > PATTERN_MOST:
                raise Refused("too large")
            return False, {len(self.sets) - 1}, {len(self.sets) - 1}
        if kind is op.AT:
            return True, set(), set()
        if kind is op.SUBPATTERN:
            return self._items(list(value[-1]))
        if kind is op.BRANCH:
            parts = [self._items(list(b)) for b in value[1]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            body, copies, loop = list(body), min(least, _UNROLLED), most is op.MAXREPEAT or most > _UNROLLED
            parts = [self._items(body) for _ in range(max(copies, 1) if loop else most)]
            if loop:
                self._link(parts[-1][2], parts[-1][1])
                if parts[0][0] and most is not op.MAXREPEAT:
                    raise Refused("many repeats of what may be empty")
            empty, first, last = True, set(), set()
            for n, (e, f, z) in enumerate(parts):
                e = e or n >= least
                self._link(last, f)
                first |= f if empty else set()
                last, empty = (last | z if e else z), empty and e
            return empty, first, last
        raise Refused(str(kind))

    def loops(self) -> list[list[int]]:
        """Sets of places that reach one another, in the order of a run through the pattern."""
        number, low, stack, on, out = {}, {}, [], set(), []
        for root in range(len(self.follow)):
            work = [(root, iter(()))] if root not in number else []
            while work:
                node, rest = work[-1]
                if node not in number:
                    number[node] = low[node] = len(number)
                    stack.append(node)
                    on.add(node)
                    rest = iter(sorted(self.follow[node]))
                    work[-1] = (node, rest)
                for after in rest:
                    if after not in number:
                        work.append((after, iter(())))
                        break
                    if after in on:
                        low[node] = min(low[node], number[after])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[node])
                    if low[node] == number[node]:
                        part = []
                        while not part or part[-1] != node:
                            part.append(stack.pop())
                            on.discard(part[-1])
                        if len(part) > 1 or node in self.follow[node]:
                            out.append(part)
        return out[::-1]

    def meet(self, a: int, b: int) -> bool:
        return any(x[0] <= y[1] and y[0] <= x[1] for x in self.sets[a] for y in self.sets[b])

    def two_ways(self, loop: list[int]) -> bool:
        """Whether one text can lead from a place of the loop back to it in two ways."""
        inside = set(loop)
        if any(a in inside and b in inside for a, b in self.twice):
            return True
        if len(loop) > LOOP_MOST:
            raise Refused("too large a loop")
        meets = {(a, b) for a in loop for b in loop if self.meet(a, b)}

        def reached(start: set[tuple[int, int]]) -> set[tuple[int, int]]:
            seen, new = set(), start
            while new:
                new = {(c, d) for a, b in new for c in self.follow[a] & inside for d in self.follow[b] & inside if (c, d) in meets} - seen
                seen |= new
            return seen

        parted = {(a, b) for a, b in reached({(a, a) for a in loop}) if a != b}
        return any(a == b for a, b in reached(parted)) if parted else False

    def choices(self, loops: list[list[int]]) -> int:
        """Places outside of loops after which one character can stand at two places: each can double the ways to try."""
        inside = {p for loop in loops for p in loop}
        return sum(any(a < b and self.meet(a, b) for a in f for b in f) for p, f in enumerate(self.follow) if p not in inside)

    def chains(self, loops: list[list[int]]) -> int:
        """Most loops in a row that one run of characters can be dealt out to."""
        longest: dict[int, int] = {}
        for n in range(len(loops) - 1, -1, -1):
            own = _union([r for p in loops[n] for r in self.sets[p]])
            fits = {p for p in range(len(self.sets)) if any(x[0] <= y[1] and y[0] <= x[1] for x in own for y in self.sets[p])}
            seen, new = set(), set(loops[n])
            while new:
                new = {b for a in new for b in self.follow[a] & fits} - seen
                seen |= new
            longest[n] = 1 + max((longest[m] for m in range(n + 1, len(loops)) if seen & set(loops[m])), default=0)
        return max(longest.values(), default=0)


def _class(ranges: Ranges) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=1024)
def compiled(source: str, flags: str = "") -> Pattern:
    """A user's pattern; raises Refused where it isn't one, or where matching it could take exponential time."""
    if len(source) > PATTERN_MOST or len(set(flags)) != len(flags) or not set(flags) <= set("ims"):
        raise Refused("flags or length")
    inline = re.findall(r"\(\?([ims]*)", source)
    spark, mine = _translated(source, "m" in flags or any("m" in i for i in inline))
    ignore_case = "i" in flags or any("i" in i for i in inline)
    dot_all = re.S if "s" in flags or any("s" in i for i in inline) else 0
    try:
        tree = _parser.parse(mine, dot_all)
    except (re.error, OverflowError, RecursionError) as problem:
        raise Refused(str(problem)) from None
    automaton = _Automaton(tree, ignore_case)
    if dot_all:
        automaton.sets = [[(0, _LAST)] if s == _without([(10, 10)]) else s for s in automaton.sets]
    loops = automaton.loops()
    if any(automaton.two_ways(loop) for loop in loops):
        raise Refused("a loop can be gone through in two ways")
    if automaton.choices(loops) > CHOICES_MOST:
        raise Refused("too many choices")
    classes = sorted({_class(_union([r for p in loop for r in automaton.sets[p]])) for loop in loops})
    marked = f"(?d{''.join(sorted(flags))}){spark}"
    return Pattern(marked, tree.state.groups - 1, dict(tree.state.groupdict), tuple(classes), automaton.chains(loops))
