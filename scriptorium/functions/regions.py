"""Raw regions of a source text: parts that directives don't act in, put aside while something is done to the rest.

A text is parted into raw and open stretches. Raw ones are code blocks (an open one to the end of the text), closed
HTML blocks, and ``@<...>@`` and ``@@...@@`` inside a line. A closed comment is open text, but nothing in it opens a region.
Each raw stretch leaves a mark with its number, so what spans one still is one, and comes back where its mark is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENT = r"\[!--.*?--\]"
_CODE = r"\[\[code\b[^\]]*\]\](?:.*?\[\[/code\]\]|.*\Z)"
_HTML = r"\[\[html\b[^\]]*\]\].*?\[\[/\s*html\s*\]\]"
_LINE = r"@<[^\n]*?>@|@@[^\n]*?@@"
#: Characters of the private use area around a stretch's number; a mark that a text has already is a raw stretch too, so it comes
#: back as it was.
OPEN, CLOSE = "\ue000", "\ue001"
MARK = rf"{OPEN}(\d+){CLOSE}"
RAW = rf"{_CODE}|{_HTML}|{_LINE}|{OPEN}\d+{CLOSE}"
#: Raw stretches, and comments before them, so that a comment hides what is in it.
_UNITS = rf"(?is){_COMMENT}|{RAW}"
_JAVA = _UNITS.replace(r"\Z", r"\z")


def _parts(text: Column) -> tuple[Column, Column]:
    """The text between units, one more than units, and the units."""
    return F.split(text, _JAVA, -1), F.regexp_extract_all(text, F.lit(_JAVA), 0)


def segments(text: Column) -> Column:
    """The text as an array of (raw, text) in order; joined they are the text."""
    gaps, units = _parts(text)
    rows = F.zip_with(gaps, F.concat(units, F.array(F.lit(""))), lambda gap, unit: F.array(F.struct(F.lit(False).alias("raw"), gap.alias("text")), F.struct((~unit.startswith("[!--") & (unit != "")).alias("raw"), unit.alias("text"))))
    return F.filter(F.flatten(rows), lambda s: s["text"] != "")


def masked(text: Column) -> tuple[Column, Column]:
    """The text with marks in place of its raw stretches, and its units, null where it has no raw stretch."""
    gaps, units = _parts(text)
    # A unit's number is its place among the units; comments stay where they are.
    shown = F.zip_with(F.sequence(F.lit(0), F.size(units)), F.concat(units, F.array(F.lit(""))), lambda n, u: F.when(u.startswith("[!--") | (u == ""), u).otherwise(F.concat(F.lit(OPEN), n.cast("string"), F.lit(CLOSE))))
    made = F.array_join(F.zip_with(gaps, shown, lambda gap, u: F.concat(gap, u)), "")
    found = text.rlike(rf"(?is){RAW}".replace(r"\Z", r"\z"))
    return F.when(found, made).otherwise(text), F.when(found, units)


def restored(text: Column, units: Column) -> Column:
    """A masked text, or a part of one, with its raw stretches back in place."""
    gaps, numbers = F.split(text, MARK, -1), F.regexp_extract_all(text, F.lit(MARK), 1)
    back = F.concat(F.transform(numbers, lambda n: F.coalesce(F.get(units, n.try_cast("int")), F.lit(""))), F.array(F.lit("")))
    return F.when(text.contains(OPEN), F.array_join(F.zip_with(gaps, back, lambda gap, raw: F.concat(gap, raw)), "")).otherwise(text)


def outside(text: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to a text's open stretches as one text."""
    open_text, units = masked(text)
    return restored(change(open_text), units)


def masked_text(text: str) -> tuple[str, list[str]]:
    """As ``masked``, for one text at plan time."""
    units: list[str] = []

    def mark(m: re.Match) -> str:
        units.append(m[0])
        return m[0] if m[0].startswith("[!--") else f"{OPEN}{len(units) - 1}{CLOSE}"

    return re.sub(_UNITS, mark, text), units


def restored_text(text: str, units: list[str]) -> str:
    return re.sub(MARK, lambda m: units[int(m[1])] if int(m[1]) < len(units) else "", text)
