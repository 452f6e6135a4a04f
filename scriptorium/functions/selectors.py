"""Page selectors as Columns: categories, tags, numbers, dates, parents and tag conditions.

A selector that can't be read is dropped (the function gives None), as a wiki's listing does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_predicate(selector: str | None, column: Column, current: str) -> Column:
    """``*`` is all, ``.`` the current category, ``-x`` excludes; without a selector, the current category.
    Exclusions alone mean all others, and an exclusion beats an inclusion."""
    names = re.split(r"[,;\s]+", selector.strip().lower()) if selector and selector.strip() else ["."]
    wanted = [current if n == "." else n for n in names if not n.startswith("-")]
    unwanted = [current if n == "-." else n[1:] for n in names if n.startswith("-") and n != "-"]
    keep = F.lit(True) if "*" in wanted or not wanted else column.isin(wanted)
    return keep & ~column.isin(unwanted) if unwanted else keep


def tags_predicate(selector: str | None, visible: Column, hidden: Column, current: list[str] = ()) -> Column | None:
    """``+t`` required, ``-t`` forbidden, bare: any of them; ``-`` alone: no tags; ``==`` the same visible tags
    as the current page; ``=`` at least one of its visible tags. Tags are case-sensitive; hidden ones count."""
    tokens = (selector or "").split()
    if not tokens:
        return None
    every = F.array_union(visible, hidden)
    own = sorted({t for t in current if not t.startswith("_")})
    mine = F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")
    if tokens == ["=="]:
        return F.array_sort(F.array_distinct(visible)) == mine
    if tokens == ["-"]:
        return F.size(every) == 0
    rule = F.lit(True)
    for t in (t[1:] for t in tokens if t.startswith("+") and len(t) > 1):
        rule = rule & F.array_contains(every, t)
    forbidden = [t[1:] for t in tokens if t.startswith("-") and len(t) > 1]
    if forbidden:
        rule = rule & ~F.arrays_overlap(every, F.array(*map(F.lit, forbidden)))
    anyone = [t for t in tokens if t[0] not in "+-="]
    if anyone:
        rule = rule & F.arrays_overlap(every, F.array(*map(F.lit, anyone)))
    if "=" in tokens:
        rule = rule & F.arrays_overlap(visible, mine)
    return rule


_NUMBER = re.compile(r"(<=|>=|<|>|=)?\s*(-?\d+(?:\.\d+)?)")


def _compared(column: Column, op: str, value: Column) -> Column:
    return {"<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value, "=": column == value, "<>": column != value}[op]


def number_predicate(selector: str | None, column: Column) -> Column | None:
    """``>=3``, ``<2``; a bare number is equality. Other spellings of numbers (``+3``, ``3.``, ``.5``) are no selector."""
    found = _NUMBER.fullmatch((selector or "").strip())
    return _compared(column, found[1] or "=", F.lit(float(found[2]))) if found else None


_UNITS = ("day", "week", "month")


def _back(words: list[str]) -> tuple[int, str] | None:
    """Count and unit of ``last [n] days``."""
    if len(words) not in (2, 3) or words[0] != "last":
        return None
    count, unit = words[1] if len(words) == 3 else "1", words[-1].removesuffix("s")
    return (int(count), unit) if count.isdecimal() and unit in _UNITS else None


def _first_day(text: str, form: str) -> datetime | None:
    try:
        return datetime.strptime(text, form)
    except ValueError:
        return None


def date_predicate(selector: str | None, column: Column, now: datetime) -> Column | None:
    """``2024``, ``2024.3``, ``>= 2024-03-01``, ``last 2 weeks``: ranges that a scan can be pruned by."""
    text = (selector or "").strip()
    back = _back(text.lower().split())
    if back:
        count, unit = back
        return column >= F.lit(now) - F.make_interval(**{f"{unit}s": F.lit(count)}) if count else None
    if len(text) == 4 and (year := _first_day(text, "%Y")):
        return (column >= F.lit(year)) & (column < F.lit(year) + F.make_interval(years=F.lit(1)))
    if text[4:5] == "." and (month := _first_day(text, "%Y.%m")):
        return (column >= F.lit(month)) & (column < F.lit(month) + F.make_interval(months=F.lit(1)))
    op = text[: len(text) - len(text.lstrip("<>="))]
    day = text[len(op) :].strip()
    if op in ("<", ">", "<=", ">=", "=", "<>") and len(day) == 10 and (first := _first_day(day, "%Y-%m-%d")):
        return _compared(column, op, F.lit(first))
    return None


def parent_predicate(selector: str | None, parent: Column, current: int, current_parent: int | None) -> Column | None:
    """``-`` no parent, ``=`` the current page's parent, ``-=`` another, ``.`` children of the current page. A page's
    name is no rule over the row alone: see ``parent_name``."""
    own = F.lit(current_parent).cast("long")
    rules = {"-": parent.isNull(), "=": parent.eqNullSafe(own), "-=": ~parent.eqNullSafe(own), ".": parent == current}
    return rules.get((selector or "").strip())


def parent_name(selector: str | None) -> str | None:
    """The fullname that a parent selector names, if it names one."""
    text = (selector or "").strip()
    return text if text and text not in ("-", "=", "-=", ".") else None


@dataclass(frozen=True)
class TagCondition:
    """``+a`` required, ``-a`` forbidden, bare ones: any. A bare ``+`` never holds, a lone ``-`` always, nothing never."""

    text: str

    def predicate(self, tags: Column, ignore_case: bool = False) -> Column:
        """Null tags give null: the condition can't be decided yet. ``ignore_case`` is how page rendering reads
        a condition: case and bare signs don't matter there."""
        tokens = self.text.lower().split() if ignore_case else self.text.split()
        if ignore_case:
            tokens, tags = [t for t in tokens if t not in "+-"], F.transform(tags, F.lower)
        known = tags.isNotNull()
        if not tokens or "+" in tokens:
            return F.when(known, F.lit(False))
        rule = F.lit(True)
        for t in (t[1:] for t in tokens if t[0] == "+"):
            rule = rule & F.array_contains(tags, t)
        for t in (t[1:] for t in tokens if t[0] == "-" and len(t) > 1):
            rule = rule & ~F.array_contains(tags, t)
        anyone = [t for t in tokens if t[0] not in "+-"]
        if anyone:
            rule = rule & F.arrays_overlap(tags, F.array(*map(F.lit, anyone)))
        return F.when(known, rule)
