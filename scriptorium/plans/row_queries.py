"""Queries of expressions that differ by row, raw regions, excerpts' options and number texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import markup, messages, regions, text
from scriptorium.functions.expressions import directives
from scriptorium.functions.row_expressions import with_values
from scriptorium.operators import aggregates
from scriptorium.operators.listing import Current, Listing, PageQuery, Template, rendered
from scriptorium.plans.base_sql import LINKS, PAGES, sql
from scriptorium.registry import query
from scriptorium.sources.wiki import Wiki, spread

#: Expressions with a number in them, and what each is in SQL.
_FORMS = [
    ("Quantity * {0} - line", "l_quantity * {0} - l_linenumber"),
    ("-line ^ 2 + {0}", "CAST(l_linenumber AS DOUBLE) * l_linenumber + {0}"),
    ("quantity > {0} and not line = 1 or line = 7", "CASE WHEN (l_quantity > {0} AND l_linenumber <> 1) OR l_linenumber = 7 THEN 1 ELSE 0 END"),
    ("min(quantity, {0}, line) + max(line, 2) * 2", "least(l_quantity, {0}, l_linenumber) + greatest(l_linenumber, 2) * 2"),
    ("round(price / {0}) % 7", "floor(l_extendedprice / {0} + 0.5) % 7"),
    ("quantity / (line - {0})", "CASE WHEN l_linenumber <> {0} THEN l_quantity / (l_linenumber - {0}) END"),
    ("1 + ({0} *", "NULL"),
    ("abs(line - {0}, 2) + unknown", "NULL"),
    ("abs(line - {0}) * 2 ^ 3 ^ 0", "abs(l_linenumber - {0}) * 2"),
    ("(line < {0}) + (line >= {0}) * 10 + !line + (1 / (line - {0}) > 2)", "CASE WHEN l_linenumber < {0} THEN 1 ELSE 10 END + CASE WHEN l_linenumber = {0} THEN 1 ELSE 0 END"),
]
_NUMBERS = (1, 2, 3, 5, 7)
_PLACE = "(l_orderkey * 7 + l_linenumber) % 50"
_SQL_CASES = " ".join(f"WHEN {n * len(_NUMBERS) + m} THEN {form.format(c)}" for n, (_, form) in enumerate(_FORMS) for m, c in enumerate(_NUMBERS))


@query("mx_row_expressions", f"SELECT l_orderkey, l_linenumber, CAST(CASE {_PLACE} {_SQL_CASES} END AS DOUBLE) AS value FROM lineitem")
def row_expressions(spark, folder: str) -> DataFrame:
    """Fifty expressions, each row with its own, over every row of lineitem; some of them are none."""
    texts = F.array(*[F.lit(source.format(c)) for source, _ in _FORMS for c in _NUMBERS])
    rows = Wiki(spark, folder).table("lineitem").withColumn("source", F.get(texts, F.expr(_PLACE).cast("int")))
    names = {"quantity": F.col("l_quantity"), "line": F.col("l_linenumber"), "price": F.col("l_extendedprice")}
    return with_values(rows, "source", names).select("l_orderkey", "l_linenumber", "value")


_FACTORS = ("1e0", "1e3", "1e6", "1e10", "1e14", "1e17", "1e30", "1e-6", "1e-10", "1e-13", "-1e1", "1e-320")
_SHOWN = """CASE WHEN x = 0 THEN '0' ELSE CASE WHEN x < 0 THEN '-' ELSE '' END
  || CASE WHEN p >= length(d) AND p <= 21 THEN rpad(d, CAST(p AS INTEGER), '0') WHEN p > 0 AND p <= 21 THEN substr(d, 1, p) || '.' || substr(d, p + 1)
  WHEN p > -6 AND p <= 0 THEN '0.' || repeat('0', -p) || d
  ELSE substr(d, 1, 1) || CASE WHEN length(d) > 1 THEN '.' || substr(d, 2) ELSE '' END || 'e' || CASE WHEN p > 0 THEN '+' ELSE '-' END || abs(p - 1) END END"""


@query(
    "mx_number_text_wide",
    f"""WITH v AS (SELECT o_orderkey, o_totalprice * [{', '.join(_FACTORS)}][o_orderkey % {len(_FACTORS)} + 1] AS x FROM orders),
    s AS (SELECT *, string_split(CAST(abs(x) AS VARCHAR), 'e') AS s FROM v),
    t AS (SELECT *, string_split(s[1], '.') AS m, coalesce(CAST(s[2] AS BIGINT), 0) AS e FROM s),
    d AS (SELECT *, m[1] || coalesce(m[2], '') AS whole FROM t),
    n AS (SELECT *, regexp_replace(whole, '^0+|0+$', '', 'g') AS d, length(m[1]) + e - length(regexp_extract(whole, '^0*')) AS p FROM d)
    SELECT o_orderkey, {_SHOWN} AS text FROM n""",
)
def number_texts(spark, folder: str) -> DataFrame:
    """Numbers from subnormal ones to 1e35 as a script prints them."""
    factor = F.get(F.array(*[F.lit(float(f)) for f in _FACTORS]), (F.col("o_orderkey") % len(_FACTORS)).cast("int"))
    return Wiki(spark, folder).table("orders").select("o_orderkey", text.number_text(F.col("o_totalprice") * factor).alias("text"))


_RAW_SOURCE = (
    "[!-- @@ --][[#expr line + 1]] @@[[#expr 1 + 1]] [[iftags +x]]@@ [[#if 1 | yes @@|@@ | no]]\n[[code type=\"a\"]]\n[[#expr 2]]\n[[/code]]\n"
    "[[html]] [[#expr 3]] [[/html]] @<[[#expr 4]]>@ @@ [[#expr 5]]\n@@[[html]] [[#expr 6]] [[code]] [[#expr 7]]"
)


def _key() -> Column:
    return F.col("page_id").cast("string")


@query(
    "mx_raw_directives",
    """SELECT l_orderkey, l_linenumber, '[!-- @@ --]' || (l_linenumber + 1) || ' @@[[#expr 1 + 1]] [[iftags +x]]@@ yes @@|@@' || chr(10) || '[[code type="a"]]' || chr(10) || '[[#expr 2]]' || chr(10) || '[[/code]]' || chr(10)
      || '[[html]] [[#expr 3]] [[/html]] @<[[#expr 4]]>@ @@ 5' || chr(10) || '@@[[html]] 6 [[code]] [[#expr 7]]' AS text FROM lineitem""",
)
def raw_directives(spark, folder: str) -> DataFrame:
    """Directives outside and inside raw regions."""
    made = directives(_RAW_SOURCE, line=F.col("l_linenumber"))
    return Wiki(spark, folder).table("lineitem").select("l_orderkey", "l_linenumber", made.alias("text"))


@query(
    "it_raw_regions",
    sql(PAGES, body="""SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'in @@[[iftags +a]]x[[/iftags]]@@ ' || page_id || ' [[code]][[iftags]]no[[/iftags]]' ELSE '[!-- [[code]] --] end' END AS source_text FROM w_pages"""),
)
def raw_conditions(spark, folder: str) -> DataFrame:
    """Tag conditions around and inside raw regions."""
    odd, rest = "[[iftags +a]]in @@[[iftags +a]]x[[/iftags]]@@ ", "[[/iftags]] [[code]][[iftags]]no[[/iftags]]"
    source = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit(odd), _key(), F.lit(rest))).otherwise(F.lit("[!-- [[code]] --][[iftags +b]]out @@ [[/iftags]] @@[[/iftags]] end"))
    return aggregates.expand_iftags(Wiki(spark, folder).pages().select("page_id", F.array(F.lit("a")).alias("tags"), source.alias("source_text")))


@query(
    "dt_include_raw",
    sql(PAGES, body="""SELECT page_id, 'Box @@ | ' || page_id || ' @@.' || chr(10) || '[[code]]' || chr(10) || '[[include part | a = ' || page_id || ']]' || chr(10) || '[[/code]]' || chr(10) || 'Box {$a}.' || chr(10) || '[[html]]' || chr(10) || 'Box 1.' AS source_text,
      1 AS rounds, false AS too_long FROM w_pages"""),
)
def raw_includes(spark, folder: str) -> DataFrame:
    """Includes outside and inside raw regions, one with a raw region in its value."""
    source = F.concat(F.lit("[[include part | a=@@ | "), _key(), F.lit(" @@]]\n[[code]]\n[[include part | a = "), _key(), F.lit("]]\n[[/code]]\n[[include part | b = x]]\n[[html]]\n[[include part | a = 1]]"))
    pages = Wiki(spark, folder).pages().select("page_id", F.lit("here").alias("fullname"), source.alias("source_text"))
    library = spark.createDataFrame([("part", "Box {$a}.")], "page string, content string")
    return aggregates.expand_includes(pages, library)


@query("rg_segments", r"SELECT page_id, length(html) + 8 AS whole, 1 AS raws FROM pages")
def raw_segments(spark, folder: str) -> DataFrame:
    """Every web page's HTML with a raw stretch before it: the segments make up the text."""
    parts = regions.segments(F.concat(F.lit("@< @@ >@"), F.regexp_replace("html", "@@|@<|(?i)\\[\\[(html|code)", "##")))
    rows = Wiki(spark, folder).table("pages").select("page_id", parts.alias("parts"))
    whole = F.length(F.array_join(F.transform("parts", lambda s: s["text"]), ""))
    return rows.select("page_id", whole.cast("long").alias("whole"), F.size(F.filter("parts", lambda s: s["raw"])).alias("raws"))


@query("st_summary_of_headings", r"SELECT doc_id, coalesce(regexp_replace(regexp_extract(text, '^\s*(\S+)', 1), '^\s+|\s+$', '', 'g'), '') AS summary FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[A-Za-z]')")
def summaries(spark, folder: str) -> DataFrame:
    """The first paragraph of texts that begin with headings."""
    docs = Wiki(spark, folder).table("documents").filter(F.col("text").rlike("^[A-Za-z]"))
    source = F.concat(F.lit("+ Title\n\n++* Not in contents\n"), F.regexp_extract("text", r"^\s*(\S+)", 1), F.lit("\n+++ Next\n\nBody"))
    return docs.select("doc_id", text.first_paragraph(markup.readable(markup.without_headings(source))).alias("summary"))


_OPTIONS = [
    (r"""%%excerpt{pattern="([a-z]{2,})[ ]([a-z]+)" group='2' max="4"}%%""", r"left(regexp_extract(t, '([a-z]{2,})[ ]([a-z]+)', 2), 4)"),
    (r"""%%excerpt{ match = "2" pattern='(?P<first>[A-Z])\w*' group="first" }%%""", r"coalesce(regexp_extract_all(t, '([A-Z])[0-9A-Za-z_]*', 1)[2], '')"),
    ("%%excerpt{pattern=[a-z]+}%%", "''"),
    ("""%%excerpt{pattern="a(" flags="i"}%%""", "''"),
    ("""%%excerpt{pattern="(a+)+$"}%%""", "''"),
    (r"""%%excerpt{pattern="TH[a-z\"}]+" flags="i"}%%""", r"regexp_extract(t, '(?i)TH[a-z\"}]+')"),
]


@query(
    "st_excerpt_options",
    "SELECT doc_id AS page_id, " + " || '|' || ".join(f"({value})" for _, value in _OPTIONS) + r" AS item FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM documents WHERE text IS NOT NULL)",
)
def excerpt_options(spark, folder: str) -> DataFrame:
    """Excerpts of every document, by quoted options, names of groups, bad and hostile patterns; shown without their wrapping."""
    docs = spread(Wiki(spark, folder).table("documents").filter("text is not null").select("doc_id", "text"), "doc_id")  # a text takes long, and its table may have few row groups
    docs = docs.select(F.col("doc_id").alias("page_id"), F.regexp_replace("text", "[^ -~]", "?").alias("readable"))
    parts = [F.array_join(F.transform(F.regexp_extract_all(Template(source).column(), F.lit(r"&#(\d+);"), 1), lambda c: F.char(c.cast("int"))), "") for source, _ in _OPTIONS]
    return docs.select("page_id", F.concat_ws("|", *parts).alias("item"))


@query(
    "pj_summary_large_page",
    sql(PAGES, """r AS (SELECT doc_id AS page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\*\\*(\\S(?:[^*\\n]*\\S)?)\\*\\*', '\\1', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents)""",
        body="""SELECT p.page_id, "index", total || ' ' || coalesce(length_grapheme(t), size) AS item FROM (SELECT *, row_number() OVER (ORDER BY page_id) AS "index" FROM (
      SELECT *, count(*) OVER () AS total FROM w_pages WHERE NOT starts_with(name, '_') ORDER BY fullname, page_id LIMIT 250)) p LEFT JOIN r USING (page_id)""".replace('row_number() OVER (ORDER BY page_id)', 'row_number() OVER (ORDER BY fullname, page_id)')),
)
def large_page(spark, folder: str) -> DataFrame:
    """The largest page that a listing has, with the readable size of its pages."""
    listing = Listing(Wiki(spark, folder), PageQuery(category="*", order="fullname asc", per_page=250), Current())
    return rendered(listing, Template("%%total%% %%size%%"))


_READ = "w_read AS (SELECT doc_id AS page_id, length_grapheme(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\*\\*(\\S(?:[^*\\n]*\\S)?)\\*\\*', '\\1', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS n FROM documents)"


@query(
    "so_readable_size",
    sql(PAGES, _READ, body="""SELECT page_id, row_number() OVER (ORDER BY n DESC NULLS LAST, page_id DESC) AS "index", total FROM (
      SELECT page_id, n, count(*) OVER () AS total FROM w_pages LEFT JOIN w_read USING (page_id) WHERE NOT starts_with(name, '_') ORDER BY n DESC NULLS LAST, page_id DESC LIMIT 250)"""),
)
def readable_sizes(spark, folder: str) -> DataFrame:
    """Pages by what a reader sees of them; those without a text come last."""
    listing = Listing(Wiki(spark, folder), PageQuery(category="*", order="size desc", per_page=250, readable_sizes=True), Current())
    return listing.page().select("page_id", "index", "total")


@query(
    "wn_collected",
    """WITH s AS (SELECT doc_id AS page_id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') AS t FROM documents)
      SELECT page_id, ord, kind, number, CASE ord WHEN 0 THEN 'Title' WHEN 2 THEN t WHEN 4 THEN 'b' WHEN 6 THEN 'end [[footnote]]x[[/footnote]]' WHEN 5 THEN ' x="1"' WHEN 3 THEN '[[math]] ' || page_id ELSE 'note ' || page_id END AS body
      FROM s, (VALUES (0, 'heading', 0), (1, 'footnote', 0), (2, 'code', 0), (3, 'html', 0), (4, 'equation', 0), (5, 'tabview', 0), (6, 'code', 1)) v(ord, kind, number)""",
)
def collected(spark, folder: str) -> DataFrame:
    """What each text gives beside itself, in one order, with a counter for each kind."""
    key = F.col("doc_id").cast("string")
    source = F.concat(
        F.lit("+ Title\n[!-- [[code]] --]a[[footnote]]note "), key, F.lit("[[/footnote]]\n[[code type=\"x\"]]\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", ""), F.lit("\n[[/code]]\n[[html]]\n[[math]] "), key,
        F.lit("\n[[/html]]\n++no heading\n[[math eq]]\nb\n[[/math]]\n[[tabview x=\"1\"]]\n[[code]]end [[footnote]]x[[/footnote]]"),
    )
    return markup.collected(Wiki(spark, folder).table("documents").select(F.col("doc_id").alias("page_id"), source.alias("source_text")))


_MESSAGES = [("hello", "ja", "{name} さん、{ n }"), ("hello", "de", "Hallo {name"), ("note", "de", "It''s '{'{n}'}' {name}"), ("note", "ja", "{missing}"), ("plain", "ja", "{n, plural, other {x}}")]
_DEFAULTS = [("hello", "Hello {name} ({n})"), ("note", "Note {n}"), ("plain", "Plain {other}")]


@query(
    "st_messages",
    """SELECT c_custkey AS user_id, CASE WHEN k = 0 AND l = 1 THEN c_name || ' さん、' || c_custkey WHEN k = 0 THEN 'Hello ' || c_name || ' (' || c_custkey || ')'
      WHEN k = 1 AND l = 2 THEN 'It''s {' || c_custkey || '} ' || c_name WHEN k = 1 THEN 'Note ' || c_custkey WHEN k = 2 THEN 'Plain {other}' END AS message,
      NOT ((k = 0 AND l = 1) OR (k = 1 AND l = 2)) AS fallback FROM (SELECT *, c_custkey % 4 AS k, c_custkey % 3 AS l FROM customer)""",
)
def message_texts(spark, folder: str) -> DataFrame:
    """A message to every customer in a language of theirs, with defaults for those that can't be shown."""
    users, k = Wiki(spark, folder).users(), F.col("user_id")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    rows = users.select("user_id", pick(("hello", "note", "plain", "none"), k % 4).alias("id"), pick(("en", "ja", "de"), k % 3).alias("locale"), F.create_map(F.lit("name"), "name", F.lit("n"), k.cast("string")).alias("values"))
    translations = spark.createDataFrame(_MESSAGES, "id string, locale string, text string")
    return messages.translated(rows, translations, spark.createDataFrame(_DEFAULTS, "id string, text string")).select("user_id", "message", "fallback")


@query(
    "st_escapes",
    r"""SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS element,
      sha256(replace(replace(replace(replace(replace(replace(replace(html, '\', '\\'), '''', '\x27'), '"', '\x22'), '<', '\x3c'), '>', '\x3e'), '&', '\x26'), chr(10), '\n')) AS script,
      'a<\/style>b<\/style' || page_id AS style FROM pages""",
)
def escapes(spark, folder: str) -> DataFrame:
    """Every page's HTML as text and as a script's string, and a style sheet that tries to end its element."""
    style = text.escape_style(F.concat(F.lit("a</STYLE>b</style"), F.col("page_id").cast("string")))
    return Wiki(spark, folder).table("pages").select("page_id", F.sha2(text.escape_text(F.col("html")), 256).alias("element"), F.sha2(text.escape_script(F.col("html")), 256).alias("script"), style.alias("style"))


@query(
    "dt_include_sites",
    sql(PAGES, body="""SELECT page_id, 'Own part.' || chr(10) || 'Far part ' || page_id || '.' || chr(10) || '[[div class="error-block"]]' || chr(10) || 'Page to be included "part" cannot be found!' || chr(10) || '[[/div]]' AS source_text,
      1 AS rounds, false AS too_long FROM w_pages"""),
)
def included_sites(spark, folder: str) -> DataFrame:
    """Includes from this site, from another one and from one that isn't known, into every page."""
    source = F.concat(F.lit("[[include part]]\n[[include :Far:part | n = "), _key(), F.lit("]]\n[[include :none:part]]"))
    library = spark.createDataFrame([("part", None, "Own part."), ("part", "far", "Far part {$n}."), ("other", "none", "x")], "page string, site string, content string")
    return aggregates.expand_includes(Wiki(spark, folder).pages().select("page_id", F.lit("here").alias("fullname"), source.alias("source_text")), library)


@query("st_lookup_name", r"SELECT p_partkey, regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[\s/]+', '-', 'g') AS name FROM part")
def lookup_names(spark, folder: str) -> DataFrame:
    return Wiki(spark, folder).table("part").select("p_partkey", text.lookup_name(F.concat("p_name", F.lit(" / "), "p_brand")).alias("name"))


@query("fi_link_to", sql(PAGES, LINKS, body="SELECT page_id FROM w_pages WHERE NOT starts_with(name, '_') AND page_id IN (SELECT page_id FROM w_links WHERE target = (SELECT min(target) FROM w_links))"))
def linking_pages(spark, folder: str) -> DataFrame:
    """The pages that link to one target."""
    wiki = Wiki(spark, folder)
    target = wiki.links().agg(F.min("target").alias("target")).first()["target"]
    return Listing(wiki, PageQuery(category="*", link_to=target), Current()).matching().select("page_id")
