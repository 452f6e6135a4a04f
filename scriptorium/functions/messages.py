"""Messages in the reader's language: a table of translations joined to rows, with the default wherever one can't be shown.

A message's text has ``{name}`` for values; a doubled apostrophe is one, and what stands between apostrophes after an opening
brace is plain text. A translation with braces that don't close, with a form that isn't known (plurals, choices), or with a name
that has no value gives way to the default message; so does a language without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECES = r"'[{}][^']*'|''|\{\s*[A-Za-z_][A-Za-z0-9_]*\s*\}|[^{}']+|[\s\S]"


def formatted(text: Column, values: Column) -> Column:
    """A message's text with the values of a map in place; null where it can't be shown. Values are put in as they are."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), 0)
    name = lambda p: F.regexp_extract(p, r"^\{\s*(\w+)\s*\}$", 1)

    def shown(piece: Column) -> Column:
        quoted = F.when(piece == "''", F.lit("'")).when(piece.rlike("^'[{}]"), piece.substr(F.lit(2), F.length(piece) - 2))
        return F.coalesce(quoted, F.when(name(piece) != "", F.try_element_at(values, name(piece))).when(~piece.isin("{", "}"), piece))

    parts = F.transform(pieces, shown)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def translated(rows: DataFrame, translations: DataFrame, defaults: DataFrame) -> DataFrame:
    """``rows`` (with id, locale and values, a map) with ``message`` and ``fallback``: whether the default had to stand in.

    ``translations`` are (id, locale, text) and ``defaults`` (id, text); where a language has a message twice the least text counts. An
    id without a default gives null.
    """
    known = translations.groupBy("id", "locale").agg(F.min("text").alias("_text"))
    basic = defaults.groupBy("id").agg(F.min("text").alias("_basic"))
    joined = rows.join(known, ["id", "locale"], "left").join(basic, "id", "left").withColumn("_shown", formatted(F.col("_text"), F.col("values")))
    plain = F.coalesce(formatted(F.col("_basic"), F.col("values")), F.col("_basic"))
    return joined.withColumns({"message": F.coalesce("_shown", plain), "fallback": F.col("_shown").isNull()}).drop("_text", "_basic", "_shown")
