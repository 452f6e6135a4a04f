"""Wiki markup with built-in functions: tables of headings, links and modules, inline and line markup to
HTML, HTML back to markup, and readable text.

Rules are regular expressions that run inside Spark's generated code, one after the other; markers that are
not closed on their line stay as they are. Nested block structures are out of scope (see the README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import escape_html
from scriptorium.operators.trees import depth_tree

#: Inline markers and their HTML (fixed values of the markup).
INLINE = [
    (r"\*\*(\S(?:[^*\n]*\S)?)\*\*", "<strong>$1</strong>"),
    (r"(^|[^:])//(\S(?:[^/\n]*\S)?)//", "$1<em>$2</em>"),
    (r"__(\S(?:[^_\n]*\S)?)__", '<span style="text-decoration: underline;">$1</span>'),
    (r"--([^\s-](?:[^\n-]*[^\s-])?)--", '<span style="text-decoration: line-through;">$1</span>'),
    (r"\^\^([^^\n]+)\^\^", "<sup>$1</sup>"),
    (r",,([^,\n]+),,", "<sub>$1</sub>"),
    (r"\{\{([^}\n]+)\}\}", "<tt>$1</tt>"),
    (r"##([a-z]+)\|([^#\n]+)##", '<span style="color: $1">$2</span>'),
    (r"\[\[\[([^\]|\n]+)\|([^\]\n]+)\]\]\]", '<a href="/$1">$2</a>'),
    (r"\[\[\[([^\]|\n]+)\]\]\]", '<a href="/$1">$1</a>'),
    (r"\[\*?(https?://[^\s\]]+) ([^\]\n]+)\]", '<a href="$1">$2</a>'),
    (r"--", "—"),
]
#: Lines that are a block by themselves.
LINES = [
    (r"(?m)^-{4,}[^\n]*$", "<hr />"),
    (r"(?m)^={4,}[ ]*$", '<div class="content-separator"></div>'),
    (r"(?m)^~{4,}[ ]*$", '<div style="clear:both; height: 0"></div>'),
    (r"(?m)^= ([^\n]+)$", '<div style="text-align: center;">$1</div>'),
    (r"(?m)^&gt; ([^\n]+)$", "<blockquote><p>$1</p></blockquote>"),
    *[(rf"(?m)^\+{{{n}}}\*? ([^\n]+)$", f"<h{n}><span>$1</span></h{n}>") for n in range(1, 7)],
]
COMMENT = r"(?s)\[!--.*?--\]"


def without_comments(source: Column) -> Column:
    """Closed comments go; an open one is literal text."""
    return F.regexp_replace(source, COMMENT, "")


def to_html(source: Column) -> Column:
    """Escaped text with line blocks and inline markers as HTML."""
    out = escape_html(without_comments(source))
    for pattern, html in LINES + INLINE:
        out = F.regexp_replace(out, pattern, html)
    return out


def readable(source: Column) -> Column:
    """Text without marks: what a reader sees."""
    out = without_comments(source)
    for pattern, html in INLINE[:-1]:
        shown = "$1$2" if pattern.startswith("(^") else "$2" if "$2" in html else "$1"
        out = F.regexp_replace(out, pattern, shown)
    out = F.regexp_replace(out, r"(?m)^\+{1,6}\*? |^= |^> |^(?:-{4,}[^\n]*|={4,}[ ]*|~{4,}[ ]*)$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\[\[[^\]\n]*\]\]", ""), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"^\s+|\s+$", "")


def without_headings(source: Column) -> Column:
    """A blank line in place of each heading: what is left are the paragraphs."""
    return F.regexp_replace(source, r"(?md)^\+{1,6}\*? [^\n]*$", "\n")


#: HTML elements back to markup (fixed values).
BACK = [
    (r"(?is)<(script|style|head|nav|footer)\b.*?</\1>", ""),
    (r"(?s)<!--.*?-->", ""),
    *[(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", "\n\n" + "+" * n + " $1\n\n") for n in range(1, 7)],
    (r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", "**$1**"),
    (r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>", "//$1//"),
    (r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$1 $2]"),
    (r"(?i)<li\b[^>]*>", "\n* "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<hr\s*/?>", "\n----\n"),
    (r"(?i)</?(?:p|div|article|ul|ol|table|tr)\b[^>]*>", "\n\n"),
    (r"<[^>]+>", ""),
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def from_html(html: Column, entities: list[tuple[str, str]] = ENTITIES) -> Column:
    """Markup of a page's HTML; three or more line ends become two. ``entities`` that aren't listed stay as they are."""
    for pattern, mark in BACK:
        html = F.regexp_replace(html, pattern, mark)
    for entity, char in entities:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(html, r"\n\s*\n\s*", "\n\n"), r"^\s+|\s+$", "")


def headings(texts: DataFrame) -> DataFrame:
    """(page_id, number, level, title): a table of contents; ``+*`` headings aren't in it. Numbers are per page."""
    found = F.regexp_extract_all("source_text", F.lit(r"(?m)^\+{1,6} [^\n]+$"), 0)
    rows = texts.select("page_id", F.posexplode(found).alias("number", "line"))
    return rows.select("page_id", "number", F.length(F.regexp_extract("line", r"^\++", 0)).alias("level"), F.regexp_replace("line", r"^\++ ", "").alias("title"))


def heading_parents(found: DataFrame) -> DataFrame:
    """Each heading with the number of the last heading before it on a smaller level, null at the top."""
    others = tuple(c for c in found.columns if c not in ("page_id", "number", "level"))
    return depth_tree(found, "page_id", "number", "level", also=others).select(*found.columns, "parent")


def page_links(texts: DataFrame) -> DataFrame:
    """(page_id, ord, target, label) of ``[[[target|label]]]`` links."""
    rows = texts.select("page_id", F.posexplode(F.regexp_extract_all("source_text", F.lit(r"\[\[\[([^\]\n]+)\]\]\]"), 1)).alias("ord", "body"))
    label = F.when(F.col("body").contains("|"), F.trim(F.regexp_replace("body", r"^[^|]*\|", ""))).otherwise(F.trim("body"))
    return rows.select("page_id", "ord", F.trim(F.substring_index("body", "|", 1)).alias("target"), label.alias("label"))


def modules(texts: DataFrame) -> DataFrame:
    """(page_id, ord, name, arguments): modules with their attributes, names in lower case; of one given twice the last counts."""
    opening = r"(?i)\[\[module(?:654)?\s+([A-Za-z]+)([^\]]*)\]\]"
    rows = texts.select("page_id", F.posexplode(F.regexp_extract_all("source_text", F.lit(opening), 0)).alias("ord", "open"))
    given = F.regexp_extract_all(F.regexp_extract("open", opening, 2), F.lit(r'[A-Za-z_-]+="[^"]*"'), 0)
    pairs = F.transform(given, lambda g: F.struct(F.lower(F.substring_index(g, "=", 1)).alias("key"), F.regexp_extract(g, '"([^"]*)"', 1).alias("value")))
    last = F.filter(pairs, lambda p, n: ~F.exists(F.slice(pairs, n + 2, F.size(pairs)), lambda later: later["key"] == p["key"]))
    return rows.select("page_id", "ord", F.lower(F.regexp_extract("open", opening, 1)).alias("name"), F.map_from_entries(last).alias("arguments"))


def module_instances(texts: DataFrame) -> DataFrame:
    """Modules with ``instance``: their place among the modules of their own kind on the page, from 0."""
    mine = Window.partitionBy("page_id", "name").orderBy("ord")
    return modules(texts).withColumn("instance", F.row_number().over(mine) - 1)


def module_counts(texts: DataFrame) -> DataFrame:
    """(page_id, name, modules): how many modules of each kind a page has."""
    return modules(texts).groupBy("page_id", "name").agg(F.count("*").alias("modules"))


def footnotes(texts: DataFrame) -> DataFrame:
    """(page_id, number, body): footnotes in order, numbered from 1, each reference with its body."""
    found = F.regexp_extract_all("source_text", F.lit(r"(?is)\[\[footnote\]\](.*?)\[\[/footnote\]\]"), 1)
    return texts.select("page_id", F.posexplode(found).alias("ord", "body")).select("page_id", (F.col("ord") + 1).alias("number"), F.trim("body").alias("body"))


#: What a text's reader gets beside the text, by kind: how each is written.
COLLECTED = {
    "code": r"(?is)^\[\[code\b[^\]]*\]\]\n?(.*?)\n?(?:\[\[/code\]\])?$",
    "html": r"(?is)^\[\[html\b[^\]]*\]\]\n?(.*?)\n?\[\[/html\]\]$",
    "footnote": r"(?is)^\[\[footnote\]\](.*?)\[\[/footnote\]\]$",
    "equation": r"(?is)^\[\[math\b[^\]]*\]\]\n?(.*?)\n?\[\[/math\]\]$",
    "tabview": r"(?is)^\[\[tab(?:view|s)\b([^\]]*)\]\]$",
    "heading": r"(?s)^\+{1,6} (.*)$",
}
_COLLECTED = (
    r"(?is)\[\[code\b[^\]]*\]\](?:.*?\[\[/code\]\]|.*\z)|\[\[html\b[^\]]*\]\].*?\[\[/html\]\]|\[\[footnote\]\].*?\[\[/footnote\]\]|\[\[math\b[^\]]*\]\].*?\[\[/math\]\]"
    r"|\[\[tab(?:view|s)\b[^\]]*\]\]|(?<![^\n])\+{1,6} [^\n]+"
)


def collected(texts: DataFrame) -> DataFrame:
    """(page_id, ord, kind, number, body): code and HTML blocks, footnotes, equations, tab views and headings of each text in one
    order, each numbered among its own kind from 0. What stands inside another one isn't looked at; comments go before."""
    found = F.regexp_extract_all(without_comments(F.col("source_text")), F.lit(_COLLECTED), 0)
    rows = texts.select("page_id", F.posexplode(found).alias("ord", "whole"))
    kind, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, form in reversed(COLLECTED.items()):
        kind, body = F.when(F.col("whole").rlike(form), name).otherwise(kind), F.when(F.col("whole").rlike(form), F.regexp_extract("whole", form, 1)).otherwise(body)
    mine = Window.partitionBy("page_id", "kind").orderBy("ord")
    return rows.select("page_id", "ord", kind.alias("kind"), body.alias("body")).withColumn("number", F.row_number().over(mine) - 1).select("page_id", "ord", "kind", "number", "body")


def bibliography(texts: DataFrame) -> DataFrame:
    """(page_id, number, label, entry): entries of the bibliographies of a page, numbered from 1; of a label that
    stands there twice the first entry counts."""
    blocks = F.array_join(F.regexp_extract_all("source_text", F.lit(r"(?is)\[\[bibliography\]\](.*?)\[\[/bibliography\]\]"), 1), "\n")
    rows = texts.select("page_id", F.posexplode(F.regexp_extract_all(blocks, F.lit(r"(?m)^: *([^:\n]+?) *: *[^\n]*$"), 0)).alias("ord", "line"))
    label, entry = (F.trim(F.regexp_extract("line", r"^: *([^:\n]+?) *: *([^\n]*)$", n)) for n in (1, 2))
    first = rows.select("page_id", "ord", label.alias("label"), entry.alias("entry")).groupBy("page_id", "label").agg(F.min(F.struct("ord", "entry")).alias("e"))
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("e.ord")).alias("number"), "label", "e.entry")


def citations(texts: DataFrame) -> DataFrame:
    """(page_id, ord, label, number, entry): references to bibliography entries; number and entry are null for an unknown label."""
    found = F.regexp_extract_all("source_text", F.lit(r"\(\(bibcite +([^)\s]+) *\)\)"), 1)
    return texts.select("page_id", F.posexplode(found).alias("ord", "label")).join(bibliography(texts), ["page_id", "label"], "left").select("page_id", "ord", "label", "number", "entry")


def equation_references(texts: DataFrame) -> DataFrame:
    """(page_id, ord, name, number): references to named equations with their numbers, which all equations of a page count in."""
    maths = F.regexp_extract_all("source_text", F.lit(r"(?i)\[\[math(?: +([^\]\s]+))? *\]\]"), 1)
    numbered = texts.select("page_id", F.posexplode(maths).alias("at", "name")).filter("name <> ''").groupBy("page_id", "name").agg((F.min("at") + 1).alias("number"))
    refs = texts.select("page_id", F.posexplode(F.regexp_extract_all("source_text", F.lit(r"(?i)\[\[eref +([^\]\s]+) *\]\]"), 1)).alias("ord", "name"))
    return refs.join(numbered, ["page_id", "name"], "left").select("page_id", "ord", "name", "number")


def tokens(texts: DataFrame) -> DataFrame:
    """(page_id, ord, kind, value, start): marks, words, white space and other characters, in order; they make up the text."""
    pattern = r"\[\[\[|\]\]\]|\[\[/?|\]\]|\*\*|//|__|--|\^\^|,,|\{\{|\}\}|@@|##|\|\||\n|[ \t]+|[\p{L}\p{N}]+|[\s\S]"
    found = F.regexp_extract_all("source_text", F.lit(pattern), 0)
    rows = texts.select("page_id", F.posexplode(found).alias("ord", "value"))
    kind = F.when(F.col("value") == "\n", "newline").when(F.col("value").rlike(r"^[ \t]+$"), "space").when(F.col("value").rlike(r"^[\p{L}\p{N}]"), "text").otherwise("mark")
    before = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "ord", kind.alias("kind"), "value", F.coalesce(F.sum(F.length("value")).over(before), F.lit(0)).alias("start"))


def gallery_order(files: Column, order: str) -> Column:
    """Files (name, created_at) in a gallery's order: by name, or by time with files without one last and ties by name."""
    by, _, way = order.partition(" ")
    sign = -1 if way == "desc" else 1
    name = lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    if by == "name":
        return F.array_sort(files, lambda a, b: sign * name(a, b))
    time = lambda a, b: F.when(a["created_at"] < b["created_at"], -sign).when(a["created_at"] > b["created_at"], sign).otherwise(name(a, b))
    return F.array_sort(files, lambda a, b: F.when(a["created_at"].isNull(), F.when(b["created_at"].isNull(), name(a, b)).otherwise(1)).when(b["created_at"].isNull(), -1).otherwise(time(a, b)))
