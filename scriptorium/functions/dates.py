"""Date texts as Columns; sessions run in UTC."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import escape_html


#: Characters besides letters, digits and ``-._`` that a form keeps in a class name.
PLAIN = "'!()*~"


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def strftime(ts: Column, pattern: str) -> Column:
    """The usual percent tokens; one that isn't known stays as it is."""
    parts = {
        "Y": F.date_format(ts, "yyyy"), "y": F.date_format(ts, "yy"), "m": F.date_format(ts, "MM"), "d": F.date_format(ts, "dd"),
        "e": F.date_format(ts, "d"), "H": F.date_format(ts, "HH"), "I": F.date_format(ts, "hh"), "M": F.date_format(ts, "mm"),
        "S": F.date_format(ts, "ss"), "p": F.date_format(ts, "a"), "b": F.date_format(ts, "MMM"), "B": F.date_format(ts, "MMMM"),
        "a": F.date_format(ts, "EEE"), "A": F.date_format(ts, "EEEE"), "w": (F.dayofweek(ts) - 1).cast("string"),
        "j": F.lpad(F.dayofyear(ts).cast("string"), 3, "0"), "Z": F.lit("UTC"), "z": F.lit("+0000"), "%": F.lit("%"),
    }
    pieces = re.split(r"(%[YymdeHIMSpbBaAwjZz%])", pattern)
    return F.concat(*[parts[p[1]] if n % 2 else F.lit(p) for n, p in enumerate(pieces) if p or n % 2])


def elapsed(ts: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit."""
    seconds = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ts), F.lit(0))
    out = None
    for unit, size in (("year", 31536000), ("month", 2592000), ("day", 86400), ("hour", 3600), ("minute", 60)):
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(seconds >= size, text) if out is None else out.when(seconds >= size, text)
    return out.otherwise("just now")


def date_element(seconds: Column, form: str | None = None, hover: bool = False) -> Column:
    """A rendered date: its UTC label in an element whose classes carry the time and the form that a browser shows it in."""
    shown, *extras = (form or "").split("|")
    if hover:
        shown, extras = shown or "%c", extras if "agohover" in extras else [*extras, "agohover"]
    named = "|".join([shown, *extras])
    classes = ["odate", F.concat(F.lit("time_"), seconds.cast("string")), *([f"format_{quote(named, safe=PLAIN)}"] if named else [])]
    attribute = escape_html(F.concat_ws(" ", *[c if isinstance(c, Column) else F.lit(c) for c in classes]))
    return F.format_string('<span class="%s">%s</span>', attribute, F.date_format(F.timestamp_seconds(seconds), "dd MMM yyyy HH:mm"))


def valid_date(text: Column) -> Column:
    """A timestamp from its text; one that can't be read is an error, not a null."""
    found = F.try_to_timestamp(text)
    return F.when(text.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("Invalid page date: "), text)).cast("timestamp")).otherwise(found)


def defaulted(ts: Column) -> Column:
    """A time that was given, else the time of the query."""
    return F.coalesce(ts, F.current_timestamp())
